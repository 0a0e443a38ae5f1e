"""Adapters that run the folds over tables and streams, and the keyed jobs that need no Python at all."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyleaf.operators.scale import hour_chunk, idle_segments, join_keys, running_totals
from tallyleaf.streaming.folds import load, save


def _schema(df: DataFrame, columns: list[str], extra: str) -> T.StructType:
    fields = [df.schema[c] for c in columns]
    return T.StructType(fields + T._parse_datatype_string(extra).fields)


def run_fold(df: DataFrame, keys: list[str], order: list[str], make: Callable, partitions: int | None = None) -> DataFrame:
    """Run a fold over every key in order, holding one key's small state and one Arrow batch at a time.

    Keys are hashed to partitions and ordered inside them by Spark's spilling sort; the state starts anew when the
    key changes. No key is gathered in memory.
    """
    probe = make()
    out_cols = list(df.columns)
    out_schema = _schema(df, out_cols, probe.outputs)
    names = [f.name for f in out_schema.fields[len(out_cols):]]
    inputs = probe.inputs

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, fold = None, None
        for pdf in batches:
            results = []
            key_rows = zip(*[pdf[k].tolist() for k in keys])
            for key, args in zip(key_rows, zip(*[pdf[c].tolist() for c in inputs])):
                if key != current:
                    current, fold = key, make()
                results.append(fold.step(*args))
            yield pdf.assign(**{n: [r[i] for r in results] for i, n in enumerate(names)})

    spread = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    return spread.sortWithinPartitions(*keys, *order).mapInPandas(scan, out_schema)


def stream_fold(df: DataFrame, key: str, order: str, make: Callable, ties: list[str] | None = None) -> DataFrame:
    """The same fold over a stream: one state per key in the state store, events ordered inside each batch, then by ``ties``.

    A key's events of one micro-batch are held in memory; the size of micro-batches is the caller's to set.
    """
    ties = ties or []
    probe = make()
    columns = [key, order, *ties, *[c for c in probe.inputs if c not in (key, order, *ties)]]
    out_schema = _schema(df, columns, probe.outputs)
    names = [f.name for f in out_schema.fields[len(columns):]]
    inputs = probe.inputs

    def update(_key, batches, state):
        fold = load(make(), state.get[0]) if state.exists else make()
        rows = pd.concat(list(batches)).sort_values([order, *ties])
        results = [fold.step(*args) for args in zip(*[rows[c].tolist() for c in inputs])]
        state.update((save(fold),))
        yield rows[columns].assign(**{n: [r[i] for r in results] for i, n in enumerate(names)})

    return df.select(*columns).groupBy(key).applyInPandasWithState(update, out_schema, "state string", "append", "NoTimeout")


def seconds(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def limiter_segments(calls: DataFrame, key: str, gap_seconds: int) -> DataFrame:
    """Split each key where an idle gap resets the limiter, so that the pieces are independent."""
    return idle_segments(calls, [key], "ts", gap_seconds).withColumn("ts_s", seconds())


def quota_segments(calls: DataFrame, key: str, daily: float, budget: float) -> DataFrame:
    """The widest window that can bind for each call: its minute, its day or its 30-day period.

    Where a period's whole cost stays within the budget the budget never rejects, so its days are independent;
    where a day's tokens stay within the daily quota its minutes are. Decided on small per-minute totals.
    """
    rows = calls.withColumn("ts_s", seconds())
    rows = rows.withColumn("_m", F.floor(F.col("ts_s") / 60).cast("bigint")).withColumn("_d", F.floor(F.col("ts_s") / 86400).cast("bigint")).withColumn(
        "_p", F.floor(F.col("ts_s") / 2592000).cast("bigint"))
    days = rows.groupBy(key, "_p", "_d").agg(F.sum("tokens").alias("_dt"), F.sum("cost").alias("_dc"))
    periods = days.groupBy(key, "_p").agg((F.sum("_dc") <= budget).alias("_period_free"))
    flags = join_keys(days, periods, [key, "_p"]).select(key, "_d", "_period_free", (F.col("_dt") <= daily).alias("_day_free"))
    segment = (F.when(F.col("_period_free") & F.col("_day_free"), F.concat(F.lit("m"), F.col("_m").cast("string")))
               .when(F.col("_period_free"), F.concat(F.lit("d"), F.col("_d").cast("string"))).otherwise(F.concat(F.lit("p"), F.col("_p").cast("string"))))
    return join_keys(rows, flags, [key, "_d"]).withColumn("segment", segment).drop("_m", "_d", "_p", "_period_free", "_day_free")


def state_timeline(decisions: DataFrame, key: str) -> DataFrame:
    """Seconds spent in each breaker state up to the next event."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(key).orderBy("ts_s", "request_id")
    spans = decisions.withColumn("_next", F.lead("ts_s").over(w))
    return spans.groupBy(key, "state").agg(F.count("*").alias("calls"), F.sum(F.col("_next") - F.col("ts_s")).alias("seconds"))


def smoothed(calls: DataFrame, key: str, alpha: float = 0.3) -> DataFrame:
    """Final smoothed success (from 1) and latency (from 0) per key over all its events, for any ``alpha``.

    A step is affine, so steps compose: an event weighs ``alpha * (1 - alpha) ** (events after it)``. Each (key, hour)
    sums its own weighted events and counts them; the hours of a key are then put together by the counts after them, so
    a busy key is never ordered in one task.
    """
    keep = 1.0 - alpha
    rows = calls.select(key, hour_chunk("ts").alias("_chunk"), "ts", "request_id", F.col("success").cast("double").alias("_ok"), F.col("latency_ms").cast("double").alias("_ms"))
    newest = Window.partitionBy(key, "_chunk").orderBy(F.col("ts").desc(), F.col("request_id").desc())
    weight = alpha * F.pow(F.lit(keep), F.row_number().over(newest) - 1)
    hours = rows.withColumn("_w", weight).groupBy(key, "_chunk").agg(
        F.count("*").alias("_n"), F.sum(F.col("_w") * F.col("_ok")).alias("_ok"), F.sum(F.col("_w") * F.col("_ms")).alias("_ms"))
    after = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    aged = hours.withColumn("_f", F.pow(F.lit(keep), after))
    return aged.groupBy(key).agg((F.sum(F.col("_f") * F.col("_ok")) + F.pow(F.lit(keep), F.sum("_n"))).alias("success_rate"),
                                 F.sum(F.col("_f") * F.col("_ms")).alias("response_ms"))


def healthy_response(calls: DataFrame, key: str, alpha: float = 0.3) -> DataFrame:
    """Smoothed response time per key over its successful calls; the first time that is not zero is taken whole."""
    good = calls.where("success")
    place = F.struct("ts", "request_id")
    first = good.where("latency_ms <> 0").groupBy(key).agg(F.min(F.struct("ts", "request_id", "latency_ms")).alias("_first"))
    rows = join_keys(good, first, [key]).where(place >= F.struct(F.col("_first.ts").alias("ts"), F.col("_first.request_id").alias("request_id")))
    begun = rows.groupBy(key).agg(F.count("*").alias("_n"), F.max("_first.latency_ms").alias("_start"))
    response = F.col("response_ms") + F.pow(F.lit(1.0 - alpha), F.col("_n")) * F.col("_start")
    smooth = join_keys(smoothed(rows.drop("_first"), key, alpha), begun, [key]).select(key, response.alias("_response"))
    every = good.groupBy(key).agg(F.count("*").alias("calls"))
    return join_keys(every, smooth, [key], "left").select(key, "calls", F.coalesce("_response", F.lit(0.0)).alias("response_ms"))


def adjusted_limit(smooth: DataFrame, base: Column, unit_seconds: float = 1000.0) -> DataFrame:
    """Limit scaled by smoothed success (up to +20 %, down to half) and by slow responses."""
    ok, slow = F.col("success_rate"), F.col("response_ms") / unit_seconds
    factor = (F.when(ok >= 0.95, 1.0 + F.least(F.lit(0.2), (ok - 0.95) * 4)).when(ok >= 0.8, 1.0).when(ok >= 0.5, 0.7).otherwise(0.5))
    factor = factor * F.when(slow > 10.0, 0.8).when(slow > 5.0, 0.9).otherwise(1.0)
    return smooth.withColumn("adjusted", F.floor(base * factor + 1e-9).cast("bigint"))


def unhealthy_spans(calls: DataFrame, key: str, in_a_row: int = 3) -> DataFrame:
    """Runs of at least ``in_a_row`` failures. The run number is a chunked running count of successes."""
    rows = running_totals(calls, [key], hour_chunk("ts", 24), ["ts", "request_id"], {"run": F.col("success").cast("bigint")})
    bad = rows.where(~F.col("success")).groupBy(key, "run").agg(F.count("*").alias("failures"), F.min("request_id").alias("first_id"))
    return bad.where(F.col("failures") >= in_a_row)
