"""Structured Streaming: incremental counters, idempotent events, promotion tiers, sessions and windows.

Each query runs what is available, writes its results to the shared folder and returns them as a
table, so that batch code can go on from there.  Without ``late`` nothing is too late: results are
kept whole (mode complete) and hold what is still open when the stream is drained.  A stream that
never ends is given a ``late`` instead: state beyond it is let go, and results come once they are
final (mode append).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from agora.session import shared_dir
from agora.streaming.trees import merged_ring

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
#: Counts of like units at which a region is scored anew; then every tenth.
TIERS = (2, 3, 5, 8, 15)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table, a file or a folder, as a stream; its times have no zone and are taken as UTC."""
    return spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs a stream over all that is available into Parquet (append), or its last full result (complete)."""
    base = f"{shared_dir(stream.sparkSession)}/stream-{name}-{uuid.uuid4().hex}"
    spark, schema = stream.sparkSession, stream.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/{number if mode == 'append' else 'last'}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/out")


def counters(stream: DataFrame, key: str = "event_type") -> DataFrame:
    return stream.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("n_high"))


def once(stream: DataFrame, key: list[str], late: str | None = None) -> DataFrame:
    """Events whose key was not seen before (with ``late``: not within the watermark)."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(key) if late else stream.dropDuplicates(key)


def windowed(stream: DataFrame, width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Events of each type in each window: mode append with ``late``, else complete."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    held = stream.withWatermark("ts", late) if late else stream
    return held.groupBy(window, "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(stream: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Bursts of a user's events with no pause as long as ``gap``: mode append with ``late``, else complete."""
    held = stream.withWatermark("ts", late) if late else stream
    return held.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def tier(count: int) -> int:
    """The last tier that a count has reached: 2, 3, 5, 8, 15, then 25, 35, ..."""
    reached = 0
    for t in TIERS:
        if count >= t:
            reached = t
    return reached if count < TIERS[-1] + 10 else TIERS[-1] + 10 * ((count - TIERS[-1]) // 10)


def crossed(before: int, after: int) -> list[int]:
    """The tiers above one count, up to another."""
    beyond = range(TIERS[-1] + 10 * max(1, (before - TIERS[-1]) // 10 + 1), after + 1, 10)
    return [t for t in TIERS if before < t <= after] + list(beyond)


def promotions(stream: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, tier, count) whenever a key's running count crosses into a higher tier."""

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        after = before + sum(map(len, frames))
        state.update((after,))
        yield pd.DataFrame([(name[0], t, t) for t in crossed(before, after)], columns=[key, "tier", "count"])

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} long, tier int, count int", "count int", "append", GroupStateTimeout.NoTimeout)


def ring(stream: DataFrame, keys: list[str], by: list[Column], size: int, name: str) -> tuple[DataFrame, str]:
    """(the last ``size`` rows of each key by ``by``, the folder of all its versions), a version a micro-batch.

    A version is the one before with the batch's rows, of which Spark ranks both; so no task holds
    more than a key's ring and its new rows, and a batch that is run again writes the same version.
    """
    spark, schema = stream.sparkSession, stream.schema
    base = f"{shared_dir(spark)}/ring-{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        before = spark.read.schema(schema).parquet(f"{base}/versions/{number - 1}") if number else None
        merged_ring(before, batch, keys, by, size).write.mode("overwrite").parquet(f"{base}/versions/{number}")

    query = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    last = query.lastProgress["batchId"] if query.lastProgress else -1
    return (spark.read.schema(schema).parquet(f"{base}/versions/{last}") if last >= 0 else spark.createDataFrame([], schema)), f"{base}/versions"


def numbered(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs a stream over all that is available; its rows with the ``batch`` that they came from."""
    base = f"{shared_dir(stream.sparkSession)}/stream-{name}-{uuid.uuid4().hex}"
    spark, schema = stream.sparkSession, stream.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{base}/out/{number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(schema.add("batch", "long")).option("recursiveFileLookup", "true").parquet(f"{base}/out")
