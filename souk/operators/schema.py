"""What fields JSON payloads have, and how that changes."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of an array that are looked at.
ITEMS = 10


def _paths(value, path: str = "") -> Iterator[tuple[str, str]]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _paths(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for v in value[:ITEMS]:
            yield from _paths(v, f"{path}[]")
    else:
        kind = {bool: "boolean", int: "integer", float: "number", str: "string", type(None): "null"}[type(value)]
        yield path, kind


def _found(payload: str | None) -> list[tuple[str, str]]:
    """Dotted paths of a JSON text and the types found there, each once."""
    try:
        return sorted(set(_paths(json.loads(payload)))) if payload else []
    except ValueError:
        return []


def paths(rows: DataFrame, payload: str) -> DataFrame:
    """path, type, n, share of the rows. The nesting of a payload has no bound, so paths
    are found in a Python map over Arrow batches; they are counted there first."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter(pair for text in batch.column(0).to_pylist() for pair in _found(text))
            if counts:
                names, kinds = zip(*counts, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(kinds), pa.array(list(counts.values()), pa.int64())], names=["path", "type", "n"])

    seen = rows.select(F.col(payload).cast("string")).mapInArrow(work, "path string, type string, n long")
    total = rows.agg(F.count("*").alias("total"))
    counted = seen.groupBy("path", "type").agg(F.sum("n").alias("n"))
    return counted.join(F.broadcast(total)).select("path", "type", "n", F.round((F.col("n") / F.col("total")).cast("decimal(24,8)"), 6).alias("share"))


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths removed, added or of another type; path, change, severity."""
    types = lambda df: df.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("type")), "|").alias("type"))
    a, b = types(before).withColumnRenamed("type", "old"), types(after).withColumnRenamed("type", "new")
    change = F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "added").when(F.col("old") != F.col("new"), "type_changed")
    return a.join(b, "path", "full_outer").select("path", change.alias("change"), F.when(change == "added", "info").otherwise("high").alias("severity")).filter("change is not null")
