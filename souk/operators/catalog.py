"""Catalogue: search, pages by key, cursors, pivots, exports."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions.text import cell


def keyset_page(rows: DataFrame, key: str, size: int, after: int | None = None, upto: int | None = None) -> DataFrame:
    """The next ``size`` rows by falling key, of those a snapshot's bound admits;
    the filter reaches the scan and the limit is a top-k."""
    if upto is not None:
        rows = rows.filter(F.col(key) <= upto)
    if after is not None:
        rows = rows.filter(F.col(key) < after)
    return rows.orderBy(F.col(key).desc()).limit(size)


def _begins(term: str, token: Column) -> Column:
    return token.startswith(term)


def prefix_search(text: Column, terms: list[str]) -> Column:
    """Every term begins some word of the text."""
    tokens = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    found = [F.exists(tokens, partial(_begins, term)) for term in terms]
    out = F.lit(True)
    for f in found:
        out = out & f
    return out


def cursor(endpoint: str, position: Column, parameters: dict) -> Column:
    """An opaque cursor that is bound to its request's parameters."""
    import hashlib
    import json

    stamp = hashlib.sha256(json.dumps(parameters, sort_keys=True).encode()).hexdigest()
    return F.base64(F.to_json(F.struct(F.lit(1).alias("v"), F.lit(endpoint).alias("e"), position.cast("long").alias("p"), F.lit(stamp).alias("f"))).cast("binary"))


def cursor_position(token: Column, endpoint: str, parameters: dict) -> Column:
    """The position, or null if the cursor is of another request."""
    import hashlib
    import json

    stamp = hashlib.sha256(json.dumps(parameters, sort_keys=True).encode()).hexdigest()
    read = F.from_json(F.unbase64(token).cast("string"), "v int, e string, p long, f string")
    return F.when((read["v"] == 1) & (read["e"] == endpoint) & (read["f"] == stamp), read["p"])


def status_counts(listings: DataFrame, *by: str) -> DataFrame:
    return listings.groupBy(*by).pivot("status", ["sold", "active", "removed"]).count().na.fill(0)


def export(rows: DataFrame) -> DataFrame:
    """All rows, all columns as cells."""
    return rows.select(*(cell(F.col(c), kind).alias(c) for c, kind in rows.dtypes))


def export_trends(rows: DataFrame, *order: Column | str, limit: int = 50_000) -> DataFrame:
    """The first rows of a list of trends in its order, as cells."""
    return export(rows.orderBy(*order).limit(limit))


def write_sheet(rows: DataFrame, path: str) -> None:
    export(rows).write.option("header", True).option("lineSep", "\n").csv(path)
