"""Request monitoring: percentiles, heat maps, histograms, rolling statistics, alert rules, audit search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyleaf import fixed_values as fv
from tallyleaf.operators.scale import (
    hour_chunk, join_keys, literal_table, nearest_rank_percentiles, newest_per_key, rolling_blocks, running_totals,
)

PERCENTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def latency_percentiles(requests: DataFrame, keys: list[str], value: str = "duration_ms") -> DataFrame:
    """Exact nearest-rank percentiles with mean, minimum, maximum and count per key; a null key is a key."""
    base = requests.groupBy(*keys).agg(
        F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"), F.count("*").alias("count"))
    return join_keys(base, nearest_rank_percentiles(requests, keys, value, PERCENTILES), keys, "left")


def top_endpoints(requests: DataFrame, n: int = 10) -> DataFrame:
    """The busiest endpoints with error rate and percentiles.

    The requests are reduced to the top endpoints before their durations are counted, so the rest never reaches a shuffle.
    """
    counts = requests.groupBy("endpoint").agg(
        F.count("*").alias("requests"), F.count_if(F.col("status_code") >= 400).alias("errors"))
    top = counts.orderBy(F.col("requests").desc(), "endpoint").limit(n)
    theirs = requests.join(F.broadcast(top.select(F.col("endpoint").alias("_top"))), F.col("endpoint").eqNullSafe(F.col("_top")), "left_semi")
    pct = nearest_rank_percentiles(theirs, ["endpoint"], "duration_ms", PERCENTILES)
    return join_keys(top, pct, ["endpoint"], "left").select(
        "endpoint", "requests", "errors",
        F.round(100.0 * F.col("errors") / F.greatest("requests", F.lit(1)), 2).alias("error_rate"),
        *[F.round(p, 2).alias(f"{p}_ms") for p in PERCENTILES])


def overview(requests: DataFrame) -> DataFrame:
    span = F.greatest((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6, F.lit(1.0))
    failed = F.count_if(F.col("status_code") >= 400)
    return requests.agg(
        F.count("*").alias("total_requests"),
        F.round(F.count("*") / span, 6).alias("requests_per_second"),
        F.countDistinct("endpoint").alias("unique_endpoints"),
        failed.alias("total_errors"),
        F.round(100.0 * failed / F.greatest(F.count("*"), F.lit(1)), 2).alias("error_rate"))


def heat_map(requests: DataFrame, asof: Column, minutes: int = 60) -> DataFrame:
    """Requests per minute and endpoint over the last ``minutes`` before ``asof``, with the minute's total."""
    recent = requests.where((F.col("ts") > asof - F.expr(f"INTERVAL {minutes} MINUTES")) & (F.col("ts") <= asof))
    per = recent.groupBy(F.date_trunc("minute", "ts").alias("minute"), "endpoint").agg(F.count("*").alias("requests"))
    return per.withColumn("total", F.sum("requests").over(Window.partitionBy("minute")))


def bucket_counts(seconds: Column, bounds: tuple = fv.LATENCY_BUCKETS) -> dict[str, Column]:
    """A conditional count per bucket bound and one of all rows."""
    return {**{f"b{i}": F.count_if(seconds <= b) for i, b in enumerate(bounds)}, "b_all": F.count("*")}


def cumulative_buckets(wide: DataFrame, keys: list[str], bounds: tuple = fv.LATENCY_BUCKETS) -> DataFrame:
    """Rows (keys, le, cumulative) out of one column per bound; the last bound is infinity."""
    items = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate(bounds)]
    items.append(F.struct(F.lit(float("inf")).alias("le"), F.col("b_all").alias("cumulative")))
    return wide.select(*keys, F.inline(F.array(*items)))


def latency_histogram(requests: DataFrame, keys: list[str], seconds: Column,
                      bounds: tuple = fv.LATENCY_BUCKETS) -> DataFrame:
    """Cumulative counts per bucket bound, one row per key and bound (the last bound is infinity).

    One pass: a conditional count per bound, unpivoted after the aggregate, so rows are never multiplied.
    """
    wide = requests.groupBy(*keys).agg(*[c.alias(n) for n, c in bucket_counts(seconds, bounds).items()])
    return cumulative_buckets(wide, keys, bounds)


def histogram_quantile(histogram: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Quantile estimated by linear interpolation inside the bucket that holds it; the last finite bound otherwise."""
    w = Window.partitionBy(*keys).orderBy("le")
    whole = Window.partitionBy(*keys)
    rows = (
        histogram.withColumn("_total", F.max("cumulative").over(whole))
        .withColumn("_prev", F.coalesce(F.lag("cumulative").over(w), F.lit(0)))
        .withColumn("_low", F.coalesce(F.lag("le").over(w), F.lit(0.0)))
        .withColumn("_rank", F.lit(q) * F.col("_total"))
    )
    rows = rows.where((F.col("cumulative") >= F.col("_rank")) & ((F.col("_prev") < F.col("_rank")) | (F.col("_low") == 0.0) & (F.col("_rank") == 0)))
    width = F.col("le") - F.col("_low")
    share = (F.col("_rank") - F.col("_prev")) / (F.col("cumulative") - F.col("_prev"))
    value = F.when(F.col("le") == float("inf"), F.col("_low")).otherwise(F.col("_low") + width * share)
    return rows.select(*keys, value.alias("quantile"))


def latency_sketches(requests: DataFrame, keys: list[str], value: str = "duration_ms", size: int = 400) -> DataFrame:
    """``keys, hour, sketch, n``: a quantile sketch of the values of each key and hour, to be kept and merged to any span.

    One pass with partial aggregates; a sketch has a few kilobytes however many rows it stands for. The rank of a quantile taken from it, or from any
    merge of such sketches, is off by no more than ``sketch_rank_error(size)`` of the rows, but for one case in a hundred. Null values do not count.
    """
    hour = F.date_trunc("hour", "ts").alias("hour")
    kept = requests.where(F.col(value).isNotNull())
    return kept.groupBy(*keys, hour).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size)).alias("sketch"), F.count("*").alias("n"))


def sketch_rank_error(size: int = 400) -> float:
    """Bound of the error in rank of one quantile, as a share of the rows: the published fit for sketches of this kind."""
    return 2.296 / size**0.9021


def sketch_percentiles(sketches: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """Percentiles over all hours of each key, from merged sketches alone: one column per label, and the rows they stand for."""
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("_s"), F.sum("n").alias("n"))
    return merged.select(*keys, "n", *[F.kll_sketch_get_quantile_double("_s", F.lit(p)).alias(label) for label, p in probs.items()])


def label_counters(metrics: DataFrame) -> DataFrame:
    """Counter totals over a long table (metric, labels, value)."""
    entries = F.array_sort(F.map_entries("labels"))
    series = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return metrics.groupBy("metric", series.alias("series")).agg(F.sum("value").alias("value"))


def node_summary(runs: DataFrame) -> DataFrame:
    """Mean latency and confidence, calls and success rate per pipeline node."""
    return runs.groupBy("node").agg(
        F.count("*").alias("calls"), F.avg("latency_ms").alias("avg_latency_ms"),
        F.avg("confidence").alias("avg_confidence"),
        (F.count_if("success") / F.count("*")).alias("success_rate"))


def pipeline_summary(runs: DataFrame) -> DataFrame:
    """Runs per scenario with their share of all, share of attempted fields that were extracted, and share of good runs.

    A rollup: the row without a scenario covers all runs.
    """
    sums = runs.groupBy("scenario").agg(
        F.count("*").alias("runs"), F.sum("fields_extracted").alias("fields_extracted"), F.sum("fields_attempted").alias("fields_attempted"),
        F.count_if("success").alias("good"))
    names = ("runs", "fields_extracted", "fields_attempted", "good")
    both = sums.withColumn("_all", F.lit(False)).unionByName(
        sums.agg(*[F.sum(c).alias(c) for c in names]).select(F.lit(None).cast("string").alias("scenario"), *names, F.lit(True).alias("_all")))
    total = F.max(F.when(F.col("_all"), F.col("runs"))).over(Window.partitionBy())
    return both.withColumn("share", F.col("runs") / total).select(
        "scenario", "runs", "share", F.try_divide("fields_extracted", "fields_attempted").alias("extraction_success_rate"),
        (F.col("good") / F.col("runs")).alias("batch_success_rate"))


def cache_outcome(calls: DataFrame, key: str = "cache_key") -> DataFrame:
    """Hits and misses of a cache whose entries never expire: all but the first call of a key hit.

    Only counts per key are needed, so no key's calls are ordered or collected.
    """
    per_key = calls.groupBy(key).agg(F.count("*").alias("n"))
    return per_key.agg(
        F.sum(F.col("n") - 1).alias("hits"), F.count("*").alias("misses"),
        F.round(F.sum(F.col("n") - 1) / F.sum("n"), 4).alias("hit_rate"))


def availability_credit(requests: DataFrame, plans: DataFrame, keys: list[str]) -> DataFrame:
    """Monthly availability per key against its plan's target and the credit owed as a share of the fee."""
    month = F.date_format("ts", "yyyyMM").alias("period")
    monthly = requests.groupBy(*keys, month).agg(
        F.count("*").alias("requests"), F.count_if(F.col("status_code") >= 500).alias("server_errors"))
    dims = literal_table(
        requests.sparkSession, [(p, t, c) for p, (t, c) in fv.SLA_PLANS.items()], "plan string; target double; credit double")
    out = monthly.join(plans, keys).join(F.broadcast(dims), "plan")
    availability = 100.0 * (F.col("requests") - F.col("server_errors")) / F.col("requests")
    return out.withColumn("availability", F.round(availability, 4)).withColumn(
        "credit_share", F.when(availability < F.col("target"), F.col("credit")).otherwise(F.lit(0.0))).drop("credit")


def operation_summary(samples: DataFrame, key: str, newest: int = 1000) -> DataFrame:
    """Mean, minimum, maximum and p95 over the newest samples of each operation."""
    kept = newest_per_key(samples, [key], [F.col("ts").desc(), F.col("request_id").desc()], newest)
    base = kept.groupBy(key).agg(F.avg("duration_ms").alias("avg"), F.min("duration_ms").alias("min"),
                                 F.max("duration_ms").alias("max"), F.count("*").alias("count"))
    return join_keys(base, nearest_rank_percentiles(kept, [key], "duration_ms", {"p95": 0.95}), [key], "left")


def exact_mean(total: str, n: str, digits: int = 4) -> Column:
    """Mean of an exact decimal total, rounded half up in decimals."""
    share = F.col(total).cast("decimal(18,2)") / F.col(n).cast("decimal(12,0)")
    return F.round(share, digits).cast("double")


def rolling_call_stats(calls: DataFrame, key: str, window: int = 100, chunk_hours: int = 1) -> DataFrame:
    """Success rate, mean and p95 duration over each call's last ``window`` calls, with all-time figures beside.

    The key's timeline is cut into blocks that overlap by ``window - 1`` rows, so one busy key uses many tasks.
    """
    order = ["ts", "request_id"]
    ok = F.col("success").cast("bigint")
    placed = running_totals(calls, [key], hour_chunk("ts", chunk_hours), order, {
        "pos": F.lit(1).cast("bigint"), "ok_so_far": ok,
        "duration_so_far": F.col("latency_ms").cast("decimal(18,2)")})
    blocks = rolling_blocks(placed, "pos", window)
    w = Window.partitionBy(key, "_block").orderBy("pos").rowsBetween(-(window - 1), 0)
    sorted_durations = F.sort_array(F.collect_list("latency_ms").over(w))
    out = (
        blocks.withColumn("window_size", F.count("*").over(w)).withColumn("window_ok", F.sum(ok).over(w))
        .withColumn("window_duration", F.sum(F.col("latency_ms").cast("decimal(18,2)")).over(w))
        .withColumn("_sorted", sorted_durations).where("_owned")
    )
    index = F.least(F.floor(F.col("window_size") * 0.95), F.col("window_size") - 1).cast("int")
    return out.select(
        key, "request_id", "pos", "window_size",
        F.round(F.col("window_ok") / F.col("window_size"), 4).alias("window_success_rate"),
        exact_mean("window_duration", "window_size").alias("window_avg_duration"),
        F.element_at("_sorted", index + 1).alias("window_p95_duration"),
        F.round(F.col("ok_so_far") / F.col("pos"), 4).alias("all_time_success_rate"),
        exact_mean("duration_so_far", "pos").alias("all_time_avg_duration"))


def firing_spans(points: DataFrame, keys: list[str], breach: str, hold_seconds: int, step_seconds: int = 30) -> DataFrame:
    """Unbroken runs of breaching points that last at least ``hold_seconds``, per rule series.

    ``points`` holds one row per evaluation instant, so its size follows time, not traffic. Instants without traffic
    have no point: neighbours more than ``step_seconds`` apart do not belong to one run.
    """
    w = Window.partitionBy(*keys).orderBy("ts")
    apart = F.coalesce(F.unix_seconds("ts") - F.unix_seconds(F.lag("ts").over(w)) > step_seconds, F.lit(False))
    ends = F.when(F.coalesce(F.col(breach), F.lit(False)) & ~F.col("_apart"), 0).otherwise(1)
    run = F.sum(ends).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = points.withColumn("_apart", apart).withColumn("_run", run).where(F.col(breach)).groupBy(*keys, "_run").agg(
        F.min("ts").alias("since"), F.max("ts").alias("until"), F.count("*").alias("points"))
    held = F.unix_seconds("until") - F.unix_seconds("since")
    return runs.withColumn("held_seconds", held).where(held >= hold_seconds).drop("_run")


def sliding_sums(rows: DataFrame, keys: list[str], counts: dict[str, Column], window_seconds: int = 300, step_seconds: int = 30) -> DataFrame:
    """Counts in sliding windows, one row per key and window end.

    Rows are reduced to one per key and step first; only those are repeated into the windows they belong to.
    """
    step = F.floor(F.unix_seconds("ts") / step_seconds).cast("bigint")
    steps = rows.groupBy(*keys, step.alias("step")).agg(*[c.alias(n) for n, c in counts.items()])
    spread = steps.withColumn(
        "window_end", F.explode(F.sequence(F.col("step") + 1, F.col("step") + window_seconds // step_seconds)))
    return spread.groupBy(*keys, (F.col("window_end") * step_seconds).alias("window_end")).agg(*[F.sum(n).alias(n) for n in counts])


def sliding_error_share(requests: DataFrame, flag: Column, window_seconds: int = 300, step_seconds: int = 30) -> DataFrame:
    """Share of flagged requests in sliding windows, one row per window end."""
    sums = sliding_sums(requests, [], {"requests": F.count("*"), "flagged": F.count_if(flag)}, window_seconds, step_seconds)
    return sums.withColumn("share", F.col("flagged") / F.col("requests"))


def alert_points(requests: DataFrame, runs: DataFrame, hits: DataFrame, stretch: int = 1) -> DataFrame:
    """Value of each alert rule at each evaluation instant: (rule, series, window_end, value, breach).

    ``requests`` holds ts, endpoint, status_code and seconds; ``runs`` ts and fallback; ``hits`` one row with ts per call
    that a limiter rejected. ``stretch`` multiplies windows and steps, for sparse traffic. An instant whose window holds
    no row has no point. Latencies are taken from bucket counts, so no window is ever ordered.
    """
    step = fv.ALERT_STEP_SECONDS * stretch

    def width(rule: str) -> int:
        return fv.ALERT_RULES[rule][0] * stretch

    def point(df: DataFrame, rule: str, value: Column, series: Column | None = None) -> DataFrame:
        return df.select(F.lit(rule).alias("rule"), (F.lit("") if series is None else series).alias("series"), "window_end",
                         value.cast("double").alias("value"), (value > fv.ALERT_RULES[rule][1]).alias("breach"))

    failed = F.col("status_code").between(500, 599)
    shares = [point(sliding_error_share(rows, flag, width(rule), step), rule, F.col("share")) for rule, rows, flag in (
        ("error_share", requests, failed), ("hourly_error_share", requests, failed), ("fallback_share", runs, F.col("fallback")))]
    buckets = sliding_sums(requests, ["endpoint"], bucket_counts(F.col("seconds")), width("p95_latency"), step)
    keys = ["endpoint", "window_end"]
    slow = point(histogram_quantile(cumulative_buckets(buckets, keys), keys, 0.95), "p95_latency", F.col("quantile"), F.col("endpoint"))
    rejected = sliding_sums(hits, [], {"hits": F.count("*")}, width("limiter_hits"), step)
    out = point(rejected, "limiter_hits", F.col("hits") / width("limiter_hits")).unionByName(slow)
    for share in shares:
        out = out.unionByName(share)
    return out


def audit_search(audit: DataFrame, tenant=None, action=None, start=None, end=None, limit: int = 100) -> DataFrame:
    """Newest matching entries. All filters run before the limit and reach the scan."""
    hits = audit
    if tenant is not None:
        hits = hits.where(F.col("tenant_id") == tenant)
    if action is not None:
        hits = hits.where(F.col("action") == action)
    if start is not None:
        hits = hits.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        hits = hits.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    return hits.orderBy(F.col("ts").desc(), F.col("audit_id").desc()).limit(limit)


def security_alerts(audit: DataFrame, window_minutes: int = 60) -> DataFrame:
    """Counts of alerting actions and failures per window."""
    alerting = audit.where(F.col("action").isin(list(fv.ALERTING_ACTIONS)) | (F.col("status") == "failure"))
    window = F.window("ts", f"{window_minutes} minutes")
    return alerting.groupBy(window["start"].alias("window_start"), "action").agg(
        F.count("*").alias("alerts"), F.countDistinct("tenant_id").alias("tenants"))


def unacknowledged_firsts(alerts: DataFrame, key: list[str], chunk_hours: int = 24) -> DataFrame:
    """The first alert of each key since the key's last acknowledgement; later equal alerts are duplicates.

    ``alerts`` mixes rows of kind 'alert' and 'ack'. The number of earlier acknowledgements (a chunked running
    count) names the epoch, and each epoch keeps its earliest alert by a combinable minimum.
    """
    rows = running_totals(alerts, key, hour_chunk("ts", chunk_hours), ["ts", "alert_id"],
                          {"epoch": F.when(F.col("kind") == "ack", 1).otherwise(0)})
    first = F.min(F.struct("ts", "alert_id")).alias("first")
    return rows.where(F.col("kind") == "alert").groupBy(*key, "epoch").agg(first, F.count("*").alias("seen")).select(
        *key, "epoch", "first.ts", "first.alert_id", "seen")


def alert_statistics(alerts: DataFrame) -> DataFrame:
    """Total, active and acknowledged alerts, per level and over all."""
    return alerts.rollup("level").agg(
        F.count("*").alias("total"), F.count_if(~F.col("acknowledged")).alias("active"),
        F.count_if("acknowledged").alias("acknowledged"))


def idle_sessions(calls: DataFrame, keys: list[str], gap_minutes: int = 30) -> DataFrame:
    """Sessions of a key's calls that end after an idle gap of ``gap_minutes``.

    Rows are reduced to (first, last, calls) per gap-long bucket before the sessions are cut, because a gap that
    long cannot lie inside a bucket.
    """
    gap = gap_minutes * 60 * 1_000_000
    micros = F.unix_micros("ts")
    spans = calls.groupBy(*keys, F.floor(micros / gap).cast("bigint").alias("_b")).agg(
        F.min(micros).alias("_first"), F.max(micros).alias("_last"), F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_b")
    fresh = F.coalesce((F.col("_first") - F.lag("_last").over(w) >= gap).cast("int"), F.lit(0))
    spans = spans.withColumn("_new", fresh)
    spans = spans.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1)
    return spans.groupBy(*keys, "session").agg(
        F.min("_first").alias("started"), F.max("_last").alias("ended"), F.sum("_n").alias("calls"))
