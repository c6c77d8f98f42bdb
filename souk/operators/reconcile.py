"""Tables and sheets of several versions under one schema.

Versions are united by name: a column that a version lacks has its default, one that the
schema doesn't know is left out, and types are widened by a cast that fails as a null and is
told. Sheets (CSV) are read with the line that each row begins at, typed, and what is wrong
comes back as rows: file, line, column, message.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a sheet that leave Python at a time.
ROWS = 8192


@dataclass(frozen=True)
class Field:
    """A column of the schema. ``default`` (as text) stands for a column that is not there; an
    empty cell is null. ``required``: neither null nor, without a default, missing."""

    name: str
    kind: str
    default: str | None = None
    required: bool = False

    def value(self, raw: Column | None) -> Column:
        text = F.lit(self.default) if raw is None else raw
        return text.try_cast(self.kind) if self.kind != "string" else text.cast("string")

    def fault(self, raw: Column | None) -> Column:
        """A message, or null."""
        if raw is None:
            return F.lit(f"missing column {self.name}") if self.required and self.default is None else F.lit(None).cast("string")
        text = raw.cast("string")
        bad = F.when(text.isNotNull() & self.value(raw).isNull(), F.concat(F.lit(f"bad {self.kind}: "), text))
        return bad.when(text.isNull(), f"{self.name} is empty") if self.required else bad


def _judged(rows: DataFrame, fields: list[Field], raw: dict[str, Column | None], keep: list[str]) -> DataFrame:
    faults = F.array_compact(F.array(*(F.when(f.fault(raw[f.name]).isNotNull(), F.struct(F.lit(f.name).alias("column"), f.fault(raw[f.name]).alias("message"))) for f in fields)))
    return rows.select(*keep, *(f.value(raw[f.name]).alias(f.name) for f in fields), faults.alias("faults"))


def united(versions: dict[str, DataFrame], fields: list[Field]) -> DataFrame:
    """version, the fields, and faults (column, message) of every row of every version."""

    def one(name: str, rows: DataFrame) -> DataFrame:
        there = {c.lower(): c for c in rows.columns}
        raw = {f.name: F.col(f"`{there[f.name.lower()]}`") if f.name.lower() in there else None for f in fields}
        return _judged(rows, fields, raw, []).select(F.lit(name).alias("version"), "*")

    return reduce(DataFrame.unionByName, (one(name, rows) for name, rows in versions.items()))


def sheets(spark: SparkSession, path: str) -> DataFrame:
    """file, line (at which the row ends in its file, the header's is 1), cells (by the header's
    names, trimmed; empty cells are null). A byte order mark and either line end are fine,
    and cells may hold both in quotes. A sheet is read by one task, in batches of rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("file", pa.string()), ("line", pa.int64()), ("cells", pa.map_(pa.string(), pa.string()))])
        for batch in batches:
            for place, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                reader = csv.DictReader(io.StringIO(content.decode("utf-8-sig"), newline=""))
                held: list[dict] = []
                for row in reader:
                    cells = [(k.strip(), v.strip() or None) for k, v in row.items() if k is not None and isinstance(v, str)]
                    held.append({"file": place.rsplit("/", 1)[-1], "line": reader.line_num, "cells": cells})
                    if len(held) >= ROWS:
                        yield pa.RecordBatch.from_pylist(held, kinds)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, kinds)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(work, "file string, line long, cells map<string,string>")


def typed(rows: DataFrame, fields: list[Field], key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of ``sheets`` as (file, line and the fields of sound rows; file, line, column and
    message of the others). A column that a sheet lacks has its default. Of rows that repeat
    ``key`` in a file the first stays."""
    there = lambda f: F.map_contains_key("cells", F.lit(f.name))
    raw = {f.name: F.when(there(f), F.try_element_at("cells", F.lit(f.name))).otherwise(F.lit(f.default)) for f in fields}
    out = _judged(rows, fields, raw, ["file", "line"])
    if key:
        first = out.filter(F.col(key).isNotNull()).groupBy("file", key).agg(F.min("line").alias("_first"))
        again = F.col("_first") < F.col("line")
        told = F.struct(F.lit(key).alias("column"), F.concat(F.lit("repeats line "), F.col("_first").cast("string")).alias("message"))
        out = out.join(first, ["file", key], "left").withColumn("faults", F.when(again, F.array_append("faults", told)).otherwise(F.col("faults")))
    good = out.filter(F.size("faults") == 0).select("file", "line", *(f.name for f in fields))
    return good, out.select("file", "line", F.explode("faults").alias("f")).select("file", "line", "f.column", "f.message")
