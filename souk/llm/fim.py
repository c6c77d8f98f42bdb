"""Fill-in-middle transformation (13).

A text is cut into units, by default code points, by the ``Split`` pre-tokenizer of
the tokenizers library, whose isolated matches of one pattern need no training. What
the matches leave between them are units, too, so units always join to the text.
Their number is n, and two draws of 0 .. n, ranked among the units' offsets, cut the
text into prefix, middle and suffix.

For the default pattern a unit's own bytes decide, whatever stands around it; each
Python worker then keeps a table from stretches of text to the byte lengths of their
units, and only stretches that the table lacks pass through the library. Texts of
other patterns pass whole.

Draws are the first four groups of eight digits of the hex SHA-256 of ``seed:id``, so
they depend on nothing but the id, however often a task runs.

Edge cases: a null text is empty, and an empty text is plain; a null id draws as
``seed:``; repeated rows give repeated rows; a text of any length is cut whole; a text
that holds a marker is plain, so an output can always be taken apart; an empty
table gives no row; columns beside the id and the text aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm.common import slices, text_buffer, text_of
from souk.llm.token_cache import Encoder, shared_encoder

#: A code point.
POINT = r"[\s\S]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def draws(id_col: str, seed: int = 1) -> list[Column]:
    """Four 32-bit numbers of an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _encoder(pattern: str) -> Encoder:
    """Units' lengths in bytes in the place of token ids."""

    def make() -> Encoder:
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        split = Split(Regex(pattern), "isolated")

        def units(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            cut = [split.pre_tokenize_str(t) for t in texts]
            sizes = np.fromiter((len(t[a:b].encode()) for t, found in zip(texts, cut, strict=True) for _, (a, b) in found), np.uint32)
            return sizes, np.array([len(found) for found in cut], np.int64)

        def whole(text: str) -> np.ndarray:
            if pattern != POINT:
                return units([text])[0]
            parts = (text[i : i + 65536] for i in range(0, len(text), 65536))  # the library's results are large objects
            return np.fromiter(chain.from_iterable(units([p])[0] for p in parts), np.uint32)

        return Encoder(units, whole, cut=pattern == POINT)

    return shared_encoder(("fim", pattern), make)


def transform(docs: DataFrame, plain_of_100: int = 10, spm_of_100: int = 20, seed: int = 1, pattern: str = POINT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars and middle_chars
    (code points; null if plain), output. Narrow: no row leaves its task."""
    text, (h1, h2, h3, h4) = text_of(text_col), draws(id_col, seed)
    plain = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (h3 % 100 >= 100 - plain_of_100)
    form = F.when(plain, "plain").when(h4 % 100 < spm_of_100, "spm").otherwise("psm")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), form.alias("form"), h1.alias("h1"), h2.alias("h2"))
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(pattern)
        for batch in slices(batches):
            sizes, first = encoder.encode(batch.column("text"))
            raw, offsets = text_buffer(batch.column("text"))
            ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])  # offsets of units, over all texts of the slice
            points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            n = np.diff(first)
            own = [batch.column(c).to_numpy() % (n + 1) for c in ("h1", "h2")]
            low, high = ends[first[:-1] + np.minimum(*own)], ends[first[:-1] + np.maximum(*own)]
            data, out = raw.tobytes(), []
            forms = batch.column("form").to_pylist()
            for kind, a, x, y, b in zip(forms, offsets[:-1].tolist(), low.tolist(), high.tolist(), offsets[1:].tolist(), strict=True):
                if kind == "plain":
                    out.append(data[a:b])
                elif kind == "psm":
                    out.append(b"".join((p, data[a:x], s, data[y:b], m, data[x:y])))
                else:
                    out.append(b"".join((s, data[y:b], p, data[a:x], m, data[x:y])))
            none = np.array([f == "plain" for f in forms])
            columns = [batch.column("doc_id"), pa.array(n), batch.column("form"), pa.array(points[low] - points[offsets[:-1]], mask=none), pa.array(points[high] - points[low], mask=none), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(work, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text, from an output and its form. No text that is cut holds a marker, and
    no marker can begin in one part and end in the next, so each stands once."""
    head, tail = F.split_part(output, F.lit(MIDDLE), F.lit(1)), F.split_part(output, F.lit(MIDDLE), F.lit(2))
    between = lambda mark, k: F.split_part(head, F.lit(mark), F.lit(k))
    psm = F.concat(F.split_part(between(SUFFIX, 1), F.lit(PREFIX), F.lit(2)), tail, between(SUFFIX, 2))
    spm = F.concat(between(PREFIX, 2), tail, F.split_part(between(PREFIX, 1), F.lit(SUFFIX), F.lit(2)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
