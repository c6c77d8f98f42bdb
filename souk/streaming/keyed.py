"""Keyed state that bears late rows, walks them in order of time, and forgets.

A key's rows wait in a list until the watermark has passed them, so rows that come out of
order within the allowed lateness are told in order. One timer a key releases them, and
drops the key's state after a silence. What a key holds at once is its rows of the last
``late`` of event time, and its last price.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Changes(StatefulProcessor):
    """First sight of a key, and each change of its price. After ``forget`` microseconds
    without a row a key is unknown: its next row is a first sight again, whether or not the
    timer came first."""

    def __init__(self, forget: int) -> None:
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, value double")
        self.last = handle.getValueState("last", "at long, value double")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for batch in rows:
            at = batch["at"].astype("int64")
            self.waiting.appendList(list(zip(at.tolist(), batch["value"].tolist(), strict=True)))
            first = int(at.min()) if first is None else min(first, int(at.min()))
        if first is not None:
            self._wake(_due(first), always=False)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(self.waiting.get()) if self.waiting.exists() else []
        later = [row for row in held if row[0] > passed]
        seen, price = self.last.get() if self.last.exists() else (None, None)
        told = []
        for at, value in held[: len(held) - len(later)]:
            if seen is None or at - seen >= self.forget:
                told.append((key[0], at, value, None))
            elif value != price:
                told.append((key[0], at, value, price))
            seen, price = at, value
        self.timer.clear()
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        if not later and (seen is None or seen + self.forget <= passed):
            self.last.clear()
        else:
            self.last.update((seen, price)) if seen is not None else None
            self._wake(_due(later[0][0] if later else seen + self.forget), always=True)
        if told:
            yield pd.DataFrame(told, columns=["key", "at", "value", "before"]).astype({"before": "float64"})

    def _wake(self, due: int, always: bool) -> None:
        """The key's one timer, moved forward only for a row that is due before it."""
        if not always and self.timer.exists():
            (set_for,) = self.timer.get()
            if set_for <= due:
                return
            self.handle.deleteTimer(set_for)
        self.handle.registerTimer(due)
        self.timer.update((due,))


def _due(at: int) -> int:
    """The first millisecond by which a watermark has passed a moment in microseconds."""
    return -(-at // 1000)


def price_changes(events: DataFrame, key: str, at: str, price: str, late: str = "2 hours", forget_days: float = 90) -> DataFrame:
    """``key``, ``at``, ``price``, ``before`` (null at first sight) of each change, once the
    watermark has passed it. Rows without key, moment or price tell nothing; rows of one
    moment go by price; rows later than ``late`` are dropped once a batch has been released
    past them, and take their place in order before that."""
    rows = events.select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("moment"), F.col(price).cast("double").alias("value")).dropna()
    timed = rows.withWatermark("moment", late).withColumn("at", F.unix_micros("moment"))
    kind = timed.schema["key"].dataType.simpleString()
    out = timed.groupBy("key").transformWithStateInPandas(Changes(round(forget_days * 86_400_000_000)), f"key {kind}, at long, value double, before double", "append", "eventTime")
    return out.select(F.col("key").alias(key), F.timestamp_micros("at").cast("timestamp_ntz").alias(at), F.col("value").alias(price), F.when(~F.isnan("before"), F.col("before")).alias("before"))


def drained(stream: DataFrame, folder: str) -> tuple[DataFrame, dict]:
    """All there is, into a table under ``folder``, exactly once by the checkpoint: the
    table, and the rows of state held at the end (``rows``) and at most (``most``). State of
    several variables needs the store that keeps its rows on disk; the session's own choice
    is put back."""
    spark = stream.sparkSession
    own = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/table").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, own)
    held = [operator["numRowsTotal"] for progress in query.recentProgress for operator in progress["stateOperators"]]
    return spark.read.schema(stream.schema).parquet(f"{folder}/table"), {"rows": held[-1] if held else 0, "most": max(held, default=0)}


def arriving(spark: SparkSession, sf_dir: str, folder: str, parts: int = 6, jitter_seconds: int = 5400) -> DataFrame:
    """The events as files of a micro-batch each, in the order in which they would arrive if
    every row came up to ``jitter_seconds`` late."""
    delay = F.make_dt_interval(secs=F.pmod(F.xxhash64("event_id"), F.lit(jitter_seconds)).cast("decimal(18,6)"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.withColumn("arrives", F.col("ts") + delay)
    first, last = rows.agg(F.min("arrives"), F.max("arrives")).first()
    for i in range(parts if first is not None else 0):
        low, high = (first + (last - first) * k / parts for k in (i, i + 1))
        inside = (F.col("arrives") >= F.lit(low)) & ((F.col("arrives") < F.lit(high)) | F.lit(i == parts - 1))
        rows.filter(inside).drop("arrives").coalesce(1).write.mode("append").parquet(f"{folder}/{i:04d}")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(folder)
