"""Tables between the steps of a query, in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


@cache
def _own() -> str:
    return "file://" + tempfile.mkdtemp(prefix="souk-")


def path(spark: SparkSession, name: str) -> str:
    """A path that no other run uses, under ``spark.checkpoint.dir``. Only where that is
    unset and one machine does all the work a folder of this process's own serves."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines see")
    return f"{(base or _own()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Whether Spark deletes a query's shuffle files when it ends, not when their plan is collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries run herein leave no shuffle files behind: what they wrote is in a table."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


#: Tables of the steps under way, the innermost step last.
_passing: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is ``stored`` herein is deleted at the end: what was made of it is a table by then."""
    _passing.append([])
    try:
        yield
    finally:
        for where in _passing.pop():
            forget(spark, where)


def _new(spark: SparkSession, name: str) -> str:
    where = path(spark, name)
    if _passing:
        _passing[-1].append(where)
    return where


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df``, computed once: later steps read the table."""
    where, schema = _new(df.sparkSession, name), df.schema
    with tidy(df.sparkSession):
        df.write.parquet(where)
    return df.sparkSession.read.schema(schema).parquet(where)


def _write(spark: SparkSession, parts: list[Callable[[], DataFrame]], where: str) -> DataFrame:
    for part in parts:
        with passing(spark), tidy(spark):
            (rows := part()).write.mode("append").parquet(where)
    return spark.read.schema(rows.schema).parquet(where)


def gathered(spark: SparkSession, parts: list[Callable[[], DataFrame]], name: str) -> DataFrame:
    """The parts as one table, each made when those before are written and what they were
    made of is deleted: disk is needed for one part's steps, not for those of all."""
    return _write(spark, parts, _new(spark, name))


def forget(spark: SparkSession, where: str) -> None:
    """Deletes a table of this folder; nothing happens if it is gone."""
    place = spark._jvm.org.apache.hadoop.fs.Path(where)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def exists(spark: SparkSession, where: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(where)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def stamp(spark: SparkSession, *places: str) -> tuple:
    """Names, sizes and times of the files under some places, so that what was made of
    them can be told from what was made of others."""
    found = []
    for where in places:
        place = spark._jvm.org.apache.hadoop.fs.Path(where)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(place, True)
        while files.hasNext():
            own = files.next()
            found.append((own.getPath().toString(), own.getLen(), own.getModificationTime()))
    return tuple(sorted(found))


_held: dict[tuple, str] = {}


def held(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame | list[Callable[[], DataFrame]]], anew: bool = False) -> DataFrame:
    """A table that later queries of the application read again, as they would the stored
    rows of the last recomputation; made ``anew`` on demand, if it is gone, or if the files
    of the tables it comes from are others now. ``build`` gives the rows, or parts to gather."""
    files = stamp(spark, *(f"{sf_dir}/{t}.parquet" for t in ("lineitem", "part", "orders", "customer")))
    key = (spark.sparkContext.applicationId, files, name)
    if key in _held and not anew:
        try:
            return spark.read.parquet(_held[key])
        except AnalysisException:
            pass
    where = path(spark, name)
    with passing(spark):
        rows = build()
        _write(spark, rows if isinstance(rows, list) else [lambda: rows], where)
    _held[key] = where
    return spark.read.parquet(where)
