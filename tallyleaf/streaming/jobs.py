"""Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyleaf.operators.services import fan_out, fan_out_counts
from tallyleaf.session import scratch_path

WATERMARK = "10 minutes"


def minute_counts(requests: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Requests per minute and endpoint; rows beyond the watermark are left out here and counted by ``late.run_counting_late``."""
    w = F.window("ts", "1 minute")
    return requests.withWatermark("ts", watermark).groupBy(w, "endpoint").agg(F.count("*").alias("requests")).select(
        F.col("window.start").alias("minute"), "endpoint", "requests")


def sliding_shares(requests: DataFrame, flag, window: str = "5 minutes", step: str = "30 seconds", watermark: str = WATERMARK) -> DataFrame:
    """Share of flagged requests in sliding windows."""
    w = F.window("ts", window, step)
    return requests.withWatermark("ts", watermark).groupBy(w).agg(F.count("*").alias("requests"), F.count_if(flag).alias("flagged")).select(
        F.col("window.end").alias("window_end"), "requests", "flagged", (F.col("flagged") / F.col("requests")).alias("share"))


def first_alerts(alerts: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """One alert per (field, value) within the watermark."""
    return alerts.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["field", "value"])


def alerting_audit(audit: DataFrame, actions) -> DataFrame:
    return audit.where(F.col("action").isin(list(actions)) | (F.col("status") == "failure"))


def write_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", name: str | None = None,
                  shape: Callable[[DataFrame], DataFrame] | None = None):
    """Start a query that writes each micro-batch, or what ``shape`` makes of it, under its own folder, so that a replay overwrites itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch if shape is None else shape(batch)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream if name is None else stream.writeStream.queryName(name)
    return writer.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def run_to_end(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append", shape: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over all available input and return the written rows with their batch number."""
    path = scratch_path(spark, name)
    write_batches(stream, path, path + "-checkpoint", mode, shape=shape).awaitTermination()
    return spark.read.option("basePath", path).parquet(path)


def latest_update(written: DataFrame, keys: list[str]) -> DataFrame:
    """Last version of each key of an update-mode result."""
    values = [c for c in written.columns if c not in (*keys, "batch")]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def idle_sessions(calls: DataFrame, keys: list[str], gap_minutes: int, watermark: str = WATERMARK) -> DataFrame:
    """Sessions of each key that an idle gap of ``gap_minutes`` ended: first and last call and the number of calls; append mode."""
    # A session window takes in a call exactly at its end; a gap of the whole length ends a session here.
    session = F.session_window("ts", f"{gap_minutes * 60_000_000 - 1} microseconds")
    return calls.withWatermark("ts", watermark).groupBy(session, *keys).agg(
        F.min(F.unix_micros("ts")).alias("started"), F.max(F.unix_micros("ts")).alias("ended"), F.count("*").alias("calls")).select(*keys, "started", "ended", "calls")


def state_partitions(spark: SparkSession) -> int:
    """Partitions for a stream's state: as many as cores, or as the session's shuffles have, if that is fewer.

    In every micro-batch each partition of each stateful operator opens and commits a store, and typed state starts a Python worker, with rows or without.
    More of them than cores only cost time. A checkpoint keeps the number that it was begun with.
    """
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which typed state and timers need, in ``state_partitions``."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
              "spark.sql.shuffle.partitions": str(state_partitions(spark))}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def in_parts(rows: DataFrame, parts: list[Column], name: str, beat: DataFrame | None = None) -> Iterator[str]:
    """Rows as they would arrive: after each part, and after ``beat`` in the end, the folder that holds all up to then."""
    path = scratch_path(rows.sparkSession, name)
    for part in [*[rows.where(p) for p in parts], *([] if beat is None else [beat])]:
        part.write.mode("append").parquet(path)
        yield path


def deliver(spark: SparkSession, events: DataFrame, subscriptions: DataFrame, name: str = "deliveries") -> DataFrame:
    """Fan events out to subscriptions as they arrive (stream-static join)."""
    return run_to_end(spark, fan_out(events, subscriptions), name)


def delivery_counts(spark: SparkSession, events: DataFrame, subscriptions: DataFrame, name: str = "delivery-counts") -> DataFrame:
    """Deliveries per subscription and type of each micro-batch: what ``deliver`` would write, counted as it arrives."""
    return run_to_end(spark, events, name, shape=lambda batch: fan_out_counts(batch, subscriptions))
