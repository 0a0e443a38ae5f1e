"""How many rows a stream's watermark left out, written beside its result."""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "batch bigint, watermark string, rows_read bigint, late_groups bigint"
OBSERVED = "rows_read"


def observed(stream: DataFrame, filled: str | None = None) -> DataFrame:
    """The stream with a count of its rows (those with a value in ``filled``) in every batch's progress, taken before any of them is left out."""
    return stream.observe(OBSERVED, F.count(F.lit(1) if filled is None else F.col(filled)).alias("n"))


class ProgressRows(StreamingQueryListener):
    """Keeps each batch's rows read and groups left out by watermark of one query; a batch that is run again replaces itself."""

    def __init__(self, query_name: str):
        self.query_name, self.rows, self.ended, self.run = query_name, {}, threading.Event(), None

    def onQueryStarted(self, event) -> None:
        if event.name == self.query_name:
            self.run = event.runId

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if event.progress.name == self.query_name:
            p = json.loads(event.progress.json)
            dropped = sum(o.get("numRowsDroppedByWatermark", 0) for o in p.get("stateOperators", []))
            seen = (p.get("observedMetrics") or {}).get(OBSERVED) or {}
            self.rows[p["batchId"]] = (p["batchId"], (p.get("eventTime") or {}).get("watermark"), int(seen.get("n") or 0), dropped)

    def onQueryTerminated(self, event) -> None:
        if event.runId == self.run:
            self.ended.set()


def run_counting_late(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str, metrics: str, name: str) -> None:
    """Run a stream of windows over all available input in append mode; its batches go to ``path``, their progress to ``metrics``.

    Progress is a row a batch, so what passes through the driver does not grow with the rows.
    """
    from tallyleaf.streaming.jobs import write_batches

    listener = ProgressRows(name)
    spark.streams.addListener(listener)
    try:
        write_batches(stream, path, checkpoint, name=name).awaitTermination()
        listener.ended.wait(30)
    finally:
        spark.streams.removeListener(listener)
    if listener.rows:
        spark.createDataFrame(list(listener.rows.values()), SCHEMA).coalesce(1).write.mode("append").parquet(metrics)


def late_report(windows: DataFrame, metrics: DataFrame, counted: str = "requests") -> DataFrame:
    """``rows_read, rows_counted, late_rows, late_groups`` once every window is closed.

    What was read and is in no window was late. The state's own figure counts a task's late rows of one window as one, so it is a lower bound
    that is there at once.
    """
    last = metrics.groupBy("batch").agg(F.max("rows_read").alias("rows_read"), F.max("late_groups").alias("late_groups"))
    read = last.agg(F.coalesce(F.sum("rows_read"), F.lit(0)).alias("rows_read"), F.coalesce(F.sum("late_groups"), F.lit(0)).alias("late_groups"), F.lit(0).alias("one"))
    sums = windows.agg(F.coalesce(F.sum(counted), F.lit(0)).alias("rows_counted"), F.lit(0).alias("one"))
    return read.join(sums, "one").select("rows_read", "rows_counted", (F.col("rows_read") - F.col("rows_counted")).alias("late_rows"), "late_groups")
