"""Incremental behaviour: changes, repeats, removal after silence, upserts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from souk.operators.history import CONFIRM_HOURS, last_of_each


def observed(spark: SparkSession, sf_dir: str, per_trigger: int = 100) -> DataFrame:
    """The events as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*")


def price_changes(events: DataFrame) -> DataFrame:
    """First sight of a key, and each change of its price: the last price is the
    key's state. Rows of a micro-batch are taken in order of time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).sort_values(["ts", "value"])
        before = rows["value"].shift()
        before.iloc[0] = state.get[0] if state.exists else float("nan")
        state.update((float(rows["value"].iloc[-1]),))
        changed = rows["value"].ne(before)
        out = rows.loc[changed, ["user_id", "ts", "value"]].assign(before=before[changed])
        yield out

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, ts timestamp_ntz, value double, before double", "price double", "append", GroupStateTimeout.NoTimeout)


def once(events: DataFrame, key: str = "event_id", late: str = "2 hours") -> DataFrame:
    """Each key once, while it can still come late."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark([key]).drop("at")


def silent(events: DataFrame, hours: int = CONFIRM_HOURS) -> DataFrame:
    """Silences of so many hours of event time that ended: user_id, last_seen,
    gap_hours. A key that never returns has none here; ``removed`` has a timer."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).sort_values("ts")
        seen = rows["ts"].astype("int64") // 1_000 if rows["ts"].dtype != "datetime64[us]" else rows["ts"].astype("int64")
        before = seen.shift()
        before.iloc[0] = state.get[0] if state.exists else seen.iloc[0]
        gap = (seen - before) / 3.6e9
        state.update((int(seen.iloc[-1]),))
        out = pd.DataFrame({"user_id": key[0], "last_seen": pd.to_datetime(before.astype("int64"), unit="us"), "gap_hours": gap})
        yield out[out["gap_hours"] >= hours]

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, last_seen timestamp_ntz, gap_hours double", "seen long", "append", GroupStateTimeout.NoTimeout)


def in_parts(spark: SparkSession, sf_dir: str, folder: str, parts: int = 6, order: str = "ts") -> DataFrame:
    """The events as files in the order of time, one to a micro-batch, so that state lives
    on from batch to batch."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    first, last = events.agg(F.min(order), F.max(order)).first()
    for i in range(parts):
        low, high = (first + (last - first) * k / parts for k in (i, i + 1))
        inside = (F.col(order) >= F.lit(low)) & ((F.col(order) < F.lit(high)) | F.lit(i == parts - 1))
        events.filter(inside).coalesce(1).write.mode("append").parquet(f"{folder}/{i:04d}")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(folder)


def removed(events: DataFrame, hours: int = CONFIRM_HOURS, late: str = "0 seconds") -> DataFrame:
    """Each silence of so many hours of event time, once: user_id, last_seen, removed_at
    (so many hours after). It is told when the key returns after it, or by a timer when the
    stream's time has passed it, whichever is first; rows later than ``late`` are dropped by
    the watermark. Batches of a key are taken one at a time: their times alone are held."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        limit = hours * 3_600_000_000
        last, told = state.get if state.exists else (None, True)
        gone: list[int] = []
        if state.hasTimedOut:
            if not told:
                gone.append(last)
            state.update((last, True))
        else:
            for moment in np.sort(np.concatenate([b["at"].astype("int64").to_numpy() // 1000 for b in batches])).tolist():
                if last is not None and moment < last:
                    continue
                if last is not None and moment - last >= limit and not told:
                    gone.append(last)
                last, told = moment, False
            state.update((last, told))
            if (last + limit) // 1000 > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp((last + limit) // 1000)
            else:
                gone.append(last)
                state.update((last, True))
        yield pd.DataFrame({"user_id": key[0], "last_seen": pd.to_datetime(gone, unit="us"), "removed_at": pd.to_datetime([x + limit for x in gone], unit="us")})

    timed = events.select("user_id", F.col("ts").cast("timestamp").alias("at")).withWatermark("at", late)
    return timed.groupBy("user_id").applyInPandasWithState(step, "user_id long, last_seen timestamp_ntz, removed_at timestamp_ntz", "last long, told boolean", "append", GroupStateTimeout.EventTimeTimeout)


def run_once(stream: DataFrame, folder: str) -> DataFrame:
    """Everything there is, into a table; exactly once by the checkpoint."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/table").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/table")


def upsert_buckets(stream: DataFrame, key: str, order: list[str], folder: str, buckets: int = 16) -> DataFrame:
    """As ``upsert``, over buckets of the key's hash: a micro-batch reads and writes the
    buckets it touches alone, each in a version named by the batch's number; a bucket's last
    version counts, so a batch that runs again writes the same files."""
    spark = stream.sparkSession
    schema = T.StructType([*stream.schema.fields, T.StructField("_bucket", T.IntegerType()), T.StructField("_version", T.LongType())])
    held = f"{folder}/buckets"

    def current(before: int | None = None) -> DataFrame:
        rows = spark.read.schema(schema).parquet(held)
        rows = rows if before is None else rows.filter(F.col("_version") < before)
        newest = rows.groupBy("_bucket").agg(F.max("_version").alias("_version"))
        return rows.join(F.broadcast(newest), ["_bucket", "_version"])

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        if number:
            touched = [r[0] for r in rows.select("_bucket").distinct().collect()]  # at most ``buckets``
            rows = rows.unionByName(current(number).filter(F.col("_bucket").isin(touched)).drop("_version"))
        latest = last_of_each(rows, key, *order).select(*stream.columns, "_bucket").withColumn("_version", F.lit(number).cast("long"))
        latest.write.partitionBy("_version", "_bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(held)

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return current().select(*stream.columns)


def upsert(stream: DataFrame, key: str, order: list[str], folder: str) -> DataFrame:
    """Keeps the last row of each key: each micro-batch writes a new version of the
    table from the one before, named by its number, so a batch that runs again
    writes the same version."""
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        rows = batch if not number else spark.read.schema(stream.schema).parquet(f"{folder}/v{number - 1}").unionByName(batch)
        last_of_each(rows, key, *order).select(*stream.columns).write.mode("overwrite").parquet(f"{folder}/v{number}")

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    done = query.lastProgress
    return spark.read.schema(stream.schema).parquet(f"{folder}/v{done['batchId'] if isinstance(done, dict) else done.batchId}")
