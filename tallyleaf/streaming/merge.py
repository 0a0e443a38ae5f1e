"""Monthly usage kept current by merge: a batch changes only the months of its rows, and a row that comes again changes nothing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyleaf.operators.metering import period, usage_totals


class MonthlyUsage:
    """Three tables under ``path``, all partitioned by month:

    ``seen`` holds the request ids of each batch, ``parts`` each batch's totals per tenant, ``monthly`` the sums of the parts. A batch reads
    the ids of its own months only, keeps requests not seen in other batches, and replaces its own partitions; a batch that is run
    again therefore writes the same rows in the same places. Then the months it touched are summed anew from the parts and
    replaced whole. A request belongs to the month of its own time; the folder belongs to one checkpoint, whose batch numbers it holds.
    """

    def __init__(self, spark: SparkSession, path: str, totals: list | None = None):
        self.spark, self.path = spark, path
        self.totals = usage_totals() if totals is None else totals

    def _table(self, name: str, months: list[str]) -> DataFrame | None:
        """The rows of some months, if the table is there."""
        try:
            rows = self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return rows.withColumn("period", F.col("period").cast("string")).where(F.col("period").isin(months))

    def _replace(self, rows: DataFrame, name: str, *by: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.path}/{name}")

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Take in one micro-batch (``request_id, tenant_id, ts`` and what the totals need)."""
        rows = batch.withColumn("period", period()).dropDuplicates(["period", "request_id"]).persist()
        try:
            months = [r.period for r in rows.select("period").distinct().collect()]  # a batch's months, not its rows
            if not months:
                return
            seen = self._table("seen", months)
            fresh = rows
            if seen is not None:
                others = seen.where(F.col("batch") != batch_id).select("period", "request_id")
                fresh = rows.join(others, ["period", "request_id"], "left_anti")
            fresh = fresh.withColumn("batch", F.lit(batch_id)).persist()
            try:
                parts = fresh.groupBy("period", "batch", "tenant_id").agg(*self.totals)
                self._replace(parts, "parts", "period", "batch")
                self._replace(fresh.select("period", "batch", "request_id"), "seen", "period", "batch")
            finally:
                fresh.unpersist()
            whole = self._table("parts", months)
            if whole is not None:
                names = [c for c in parts.columns if c not in ("period", "batch", "tenant_id")]
                summed = whole.groupBy("period", "tenant_id").agg(*[F.sum(n).cast(parts.schema[n].dataType).alias(n) for n in names])
                self._replace(summed, "monthly", "period")
        finally:
            rows.unpersist()

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Take in all that is available."""
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(self.merge).start().awaitTermination()

    def monthly(self) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/monthly")
        return rows.withColumn("period", F.col("period").cast("string"))
