"""Similarity joins of short strings by the indel ratio, 200 * LCS / (a + b).

Strings of a ratio of at least ``least`` are at most D insertions and deletions apart. A
term is cut into D + 1 segments; D edits leave one of them whole, no further than D places
from where it stood. So pairs meet by (length of the term, number of the segment, its
letters), never by all pairs, and each pair that met is verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Least ratio of a brand's term, and how many letters its length may differ.
BRAND_SCORE, LETTERS = 85.0, 2


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a letter of ``b`` at a time over all of ``a``."""
    whole = (1 << len(a)) - 1
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    left = whole
    for c in b:
        hit = left & places.get(c, 0)
        left = ((left + hit) | (left - hit)) & whole
    return len(a) - left.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def _most(n: Column, least: float) -> Column:
    """Letters at most of a string whose ratio with one of ``n`` letters is ``least``."""
    return F.floor(n * F.lit((200.0 - least) / least) + 1e-9).cast("int")


def _edits(b: Column, least: float, off: int | None) -> Column:
    """Edits at most, for a term of ``b`` letters and a text of up to ``off`` more."""
    together = b + _most(b, least) if off is None else 2 * b + off
    return F.floor(together * F.lit((100.0 - least) / 100.0) + 1e-9).cast("int")


def _segment(b: Column, parts: Column, i: Column) -> tuple[Column, Column]:
    """Where segment ``i`` of a term of ``b`` letters begins, from 0, and its length."""
    short = F.floor(b / parts).cast("int")
    long = b - short * parts  # so many at the end have a letter more
    return i * short + F.greatest(i - (parts - long), F.lit(0)), short + (i >= parts - long).cast("int")


def _upto(low: Column, high: Column) -> Column:
    return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def term_keys(term: Column, least: float, off: int | None) -> Column:
    b = F.length(term)
    parts = _edits(b, least, off) + 1

    def key(i: Column) -> Column:
        start, n = _segment(b, parts, i)
        return F.concat_ws(":", b, i, F.substring(term, start + 1, n))

    return F.transform(F.sequence(F.lit(0), parts - 1), key)


def text_keys(text: Column, least: float, off: int | None) -> Column:
    """Of every term's length that fits, every segment, every place it may have moved to."""
    a = F.length(text)

    def of_length(b: Column) -> Column:
        edits = _edits(b, least, off)

        def of_segment(i: Column) -> Column:
            start, n = _segment(b, edits + 1, i)
            return F.transform(_upto(F.greatest(start - edits, F.lit(0)), F.least(start + edits, a - n)), lambda s: F.concat_ws(":", b, i, F.substring(text, s + 1, n)))

        return F.flatten(F.transform(F.sequence(F.lit(0), edits), of_segment))

    low = F.ceil(a * F.lit(least / (200.0 - least)) - 1e-9).cast("int") if off is None else a - off
    high = _most(a, least) if off is None else a + off
    return F.array_distinct(F.flatten(F.transform(_upto(F.greatest(low, F.lit(1)), high), of_length)))


def similar(texts: DataFrame, terms: DataFrame, by: list[str], least: float = BRAND_SCORE, off: int | None = LETTERS) -> DataFrame:
    """by, text, term, score of every pair of a group whose lengths differ by ``off`` at most (None:
    by what the ratio allows) and whose ratio is ``least`` or more. ``texts``: by, text. ``terms``: by, term. A term of which
    D + 1 segments can't be cut is too short for ``least`` and raises an error."""
    if (least < 70 if off is None else math.floor((2 + off) * (100.0 - least) / 100.0 + 1e-9) + 1 > 1):
        raise ValueError("so low a ratio leaves short terms without a segment")
    left = texts.filter("text <> ''").select(*by, "text").distinct().withColumn("_k", F.explode(text_keys(F.col("text"), least, off)))
    right = terms.filter("term <> ''").select(*by, "term").distinct().withColumn("_k", F.explode(term_keys(F.col("term"), least, off)))
    met = left.join(right, [*by, "_k"]).select(*by, "text", "term").distinct()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [ratio(a, b) for a, b in zip(batch.column("text").to_pylist(), batch.column("term").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    scored = met.mapInArrow(work, T.StructType([*met.schema.fields, T.StructField("score", T.DoubleType())]))
    near = scored.filter(F.col("score") >= least)
    return near if off is None else near.filter(F.abs(F.length("text") - F.length("term")) <= off)


def without_misspelt(titles: DataFrame, terms: DataFrame, by: list[str], least: float = BRAND_SCORE, off: int = LETTERS) -> DataFrame:
    """``titles`` (by, title, tokens) without the words of misspelt terms: of each term the
    first window of as many words that is like it goes. ``terms``: by, term (words joined by
    blanks). Titles are distinct, so each is looked at once, however many rows have it."""
    sizes = terms.select(*by, "term", F.size(F.split("term", " ")).alias("_n"))
    each = sizes.select(*by, "_n").distinct()
    last = F.size("tokens") - F.col("_n")
    spots = titles.join(each, by).filter(last >= 0).select(*by, "title", "tokens", "_n", F.explode(F.sequence(F.lit(0), last)).alias("_at"))
    windows = spots.select(*by, "title", "_n", "_at", F.array_join(F.slice("tokens", F.col("_at") + 1, F.col("_n")), " ").alias("text"))
    keyed = [*by, "_n"]
    near = similar(windows, sizes, keyed, least, off)
    hits = windows.join(near, [*keyed, "text"]).groupBy(*by, "title", "term", "_n").agg(F.min("_at").alias("_at"))
    gone = hits.groupBy(*by, "title").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("_at"), F.col("_at") + F.col("_n") - 1)))).alias("_gone"))
    kept = F.filter("tokens", lambda t, i: ~F.array_contains("_gone", i))
    return titles.join(gone, [*by, "title"], "left").withColumn("tokens", F.when(F.col("_gone").isNull(), F.col("tokens")).otherwise(kept)).drop("_gone")

