"""Registered monitoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyleaf import fixed_values as fv
from tallyleaf.operators import monitoring as mon
from tallyleaf.plans.metering import priced
from tallyleaf.plans.oracle_views import sql_list
from tallyleaf.plans.registry import query
from tallyleaf.sources import views as v


def rounded(df, digits, *names):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


RANKED = """ranked AS (SELECT endpoint, duration_ms, row_number() OVER (PARTITION BY endpoint ORDER BY duration_ms) - 1 AS r,
    count(*) OVER (PARTITION BY endpoint) AS n FROM requests),
  pct AS (SELECT endpoint, max(duration_ms) FILTER (r = least(CAST(floor(n * 0.5::DOUBLE) AS BIGINT), n - 1)) AS p50,
    max(duration_ms) FILTER (r = least(CAST(floor(n * 0.95::DOUBLE) AS BIGINT), n - 1)) AS p95,
    max(duration_ms) FILTER (r = least(CAST(floor(n * 0.99::DOUBLE) AS BIGINT), n - 1)) AS p99 FROM ranked GROUP BY 1)"""


@query("A06_latency_percentiles", "WITH " + RANKED + """ SELECT r.endpoint, ROUND(avg(duration_ms), 6) AS avg, min(duration_ms) AS min,
    max(duration_ms) AS max, count(*) AS count, any_value(p50) AS p50, any_value(p95) AS p95, any_value(p99) AS p99
    FROM requests r JOIN pct USING (endpoint) GROUP BY 1""")
def latency_percentiles(spark, d):
    return rounded(mon.latency_percentiles(v.requests(spark, d), ["endpoint"]), 6, "avg")


@query("A06_sketch_percentiles", """SELECT endpoint, label, count(*) AS n, true AS within_bound FROM requests, (VALUES ('p50'), ('p95'), ('p99')) AS l(label) GROUP BY 1, 2""")
def sketch_percentiles(spark, d):
    """Percentiles of each endpoint from hourly sketches, held against the exact ranks of the values they name."""
    probs = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    requests = v.requests(spark, d)
    found = mon.sketch_percentiles(mon.latency_sketches(requests, ["endpoint"]), ["endpoint"], probs)
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.lit(p).alias("p"), F.col(k).alias("q")) for k, p in probs.items()])).alias("w")
    long = found.select("endpoint", "n", wanted).select("endpoint", "n", "w.*")
    ranked = requests.join(F.broadcast(long), "endpoint").groupBy("endpoint", "label", "n", "p").agg(
        F.count_if(F.col("duration_ms") < F.col("q")).alias("below"), F.count_if(F.col("duration_ms") <= F.col("q")).alias("upto"))
    # The value named holds all ranks from below to upto; the nearest of them counts.
    slack = mon.sketch_rank_error() * F.col("n") + 1
    within = (F.col("below") - slack <= F.col("p") * F.col("n")) & (F.col("p") * F.col("n") <= F.col("upto") + slack)
    return ranked.select("endpoint", "label", "n", within.alias("within_bound"))


@query("A07_top_endpoints", "WITH " + RANKED + """ SELECT c.endpoint, requests, errors,
    ROUND(100.0::DOUBLE * errors / greatest(requests, 1), 2) AS error_rate, ROUND(p50, 2) AS p50_ms, ROUND(p95, 2) AS p95_ms, ROUND(p99, 2) AS p99_ms
    FROM (SELECT endpoint, count(*) AS requests, count(*) FILTER (status_code >= 400) AS errors FROM requests GROUP BY 1
          ORDER BY 2 DESC, 1 LIMIT 3) c JOIN pct USING (endpoint)""")
def top_endpoints(spark, d):
    return mon.top_endpoints(v.requests(spark, d), 3)


@query("A08_overview", """SELECT count(*) AS total_requests,
    ROUND(count(*) / greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 1.0), 6) AS requests_per_second,
    count(DISTINCT endpoint) AS unique_endpoints, count(*) FILTER (status_code >= 400) AS total_errors,
    ROUND(100.0::DOUBLE * count(*) FILTER (status_code >= 400) / greatest(count(*), 1), 2) AS error_rate FROM requests""")
def overview(spark, d):
    return mon.overview(v.requests(spark, d))


@query("A09_heat_map", """WITH per AS (SELECT date_trunc('minute', ts) AS m, endpoint, count(*) AS requests FROM requests
    WHERE ts > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 2880 MINUTES AND ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1, 2)
  SELECT strftime(m, '%Y-%m-%d %H:%M') AS minute, endpoint, requests, CAST(sum(requests) OVER (PARTITION BY m) AS BIGINT) AS total FROM per""")
def heat_map(spark, d):
    out = mon.heat_map(v.requests(spark, d), F.lit("2024-01-20 12:00:00").cast("timestamp"), 2880)
    return out.withColumn("minute", F.date_format("minute", "yyyy-MM-dd HH:mm"))


BOUNDS = ", ".join(f"({b}::DOUBLE)" for b in fv.LATENCY_BUCKETS) + ", ('inf'::DOUBLE)"
HIST = f"""hist AS (SELECT endpoint, le, count(*) FILTER (duration_ms / 10.0::DOUBLE <= le) AS cumulative
    FROM requests, (VALUES {BOUNDS}) AS b(le) GROUP BY 1, 2)"""


@query("A25_latency_histogram", "WITH " + HIST + " SELECT endpoint, CASE WHEN le = 'inf'::DOUBLE THEN -1 ELSE le END AS le, cumulative FROM hist")
def latency_histogram(spark, d):
    out = mon.latency_histogram(v.requests(spark, d), ["endpoint"], F.col("duration_ms") / 10.0)
    return out.withColumn("le", F.when(F.col("le") == float("inf"), F.lit(-1.0)).otherwise(F.col("le")))


@query("A25_histogram_quantile", "WITH " + HIST + """, w AS (SELECT *, max(cumulative) OVER (PARTITION BY endpoint) AS total,
    coalesce(lag(cumulative) OVER (PARTITION BY endpoint ORDER BY le), 0) AS prev,
    coalesce(lag(le) OVER (PARTITION BY endpoint ORDER BY le), 0.0) AS low FROM hist)
  SELECT endpoint, ROUND(CASE WHEN le = 'inf'::DOUBLE THEN low ELSE low + (le - low) * (0.95::DOUBLE * total - prev) / (cumulative - prev) END, 6) AS quantile
  FROM w WHERE cumulative >= 0.95::DOUBLE * total AND prev < 0.95::DOUBLE * total""")
def histogram_quantile(spark, d):
    hist = mon.latency_histogram(v.requests(spark, d), ["endpoint"], F.col("duration_ms") / 10.0)
    return rounded(mon.histogram_quantile(hist, ["endpoint"], 0.95), 6, "quantile")


@query("A26_label_counters", """SELECT 'requests' AS metric, 'endpoint=' || endpoint || ',status=' || status_code AS series, count(*)::DOUBLE AS value
    FROM requests GROUP BY 1, 2 UNION ALL
    SELECT 'tokens', 'model=' || model, sum(total_tokens)::DOUBLE FROM priced GROUP BY 2 UNION ALL
    SELECT 'cost_usd', 'model=' || model, ROUND(sum(cost_usd)::DOUBLE, 6) FROM priced GROUP BY 2 UNION ALL
    SELECT 'audit', 'action=' || action, count(*)::DOUBLE FROM audit GROUP BY 2""")
def label_counters(spark, d):
    """Counted per table on its own columns first, so label maps are built on aggregates only."""
    req = v.requests(spark, d).groupBy("endpoint", "status_code").agg(F.count("*").cast("double").alias("value")).select(
        F.lit("requests").alias("metric"),
        F.create_map(F.lit("endpoint"), "endpoint", F.lit("status"), F.col("status_code").cast("string")).alias("labels"), "value")
    tokens = priced(spark, d).groupBy("model").agg(
        F.sum("total_tokens").cast("double").alias("tokens"), F.round(F.sum("cost_usd").cast("double"), 6).alias("cost_usd"))
    tokens = tokens.select(F.create_map(F.lit("model"), "model").alias("labels"),
                           F.expr("stack(2, 'tokens', tokens, 'cost_usd', cost_usd) AS (metric, value)"))
    audit = v.audit(spark, d).groupBy("action").agg(F.count("*").cast("double").alias("value")).select(
        F.lit("audit").alias("metric"), F.create_map(F.lit("action"), "action").alias("labels"), "value")
    return mon.label_counters(req.unionByName(tokens).unionByName(audit))


@query("A27_node_summary", """SELECT scenario AS node, count(*) AS calls, ROUND(avg(latency_ms), 6) AS avg_latency_ms,
    ROUND(avg((request_id % 100) / 100.0::DOUBLE), 6) AS avg_confidence, ROUND(count(*) FILTER (success) / count(*)::DOUBLE, 6) AS success_rate
    FROM usage GROUP BY 1""")
def node_summary(spark, d):
    runs = v.usage(spark, d).select(F.col("scenario").alias("node"), "latency_ms", "success",
                                    ((F.col("request_id") % 100) / 100.0).alias("confidence"))
    return rounded(mon.node_summary(runs), 6, "avg_latency_ms", "avg_confidence", "success_rate")


@query("A27_pipeline_summary", """SELECT coalesce(scenario, 'all') AS scenario, count(*) AS runs, ROUND(count(*)::DOUBLE / (SELECT count(*) FROM usage), 6) AS share,
    ROUND(sum(input_tokens // 200)::DOUBLE / sum(input_tokens // 100), 6) AS extraction_success_rate, ROUND(count(*) FILTER (success)::DOUBLE / count(*), 6) AS batch_success_rate
    FROM usage GROUP BY ROLLUP (scenario)""")
def pipeline_summary(spark, d):
    runs = v.usage(spark, d).select("scenario", "success", F.floor(F.col("input_tokens") / 100).alias("fields_attempted"), F.floor(F.col("input_tokens") / 200).alias("fields_extracted"))
    out = rounded(mon.pipeline_summary(runs), 6, "share", "extraction_success_rate", "batch_success_rate")
    return out.withColumn("scenario", F.coalesce("scenario", F.lit("all")))


@query("A28_cache_outcome", """WITH k AS (SELECT tenant_id, model, input_tokens, count(*) AS n FROM usage GROUP BY 1, 2, 3)
    SELECT CAST(sum(n - 1) AS BIGINT) AS hits, count(*) AS misses, ROUND(sum(n - 1)::DOUBLE / sum(n), 4) AS hit_rate FROM k""")
def cache_outcome(spark, d):
    key = F.sha2(F.to_json(F.struct("tenant_id", "model", "input_tokens")), 256)
    return mon.cache_outcome(v.usage(spark, d).select(key.alias("cache_key")))


@query("A37_availability_credit", """WITH m AS (SELECT tenant_id, strftime(ts, '%Y%m') AS period, count(*) AS requests,
    count(*) FILTER (status_code >= 500) AS server_errors FROM requests GROUP BY 1, 2),
  p AS (SELECT m.*, (['starter', 'pro', 'enterprise'])[tenant_id % 3 + 1] AS plan, ([99.5, 99.9, 99.95])[tenant_id % 3 + 1]::DOUBLE AS target,
    ([0.0, 0.10, 0.25])[tenant_id % 3 + 1]::DOUBLE AS credit FROM m)
  SELECT tenant_id, period, plan, requests, server_errors, target, ROUND(100.0::DOUBLE * (requests - server_errors) / requests, 4) AS availability,
    CASE WHEN 100.0::DOUBLE * (requests - server_errors) / requests < target THEN credit ELSE 0.0::DOUBLE END AS credit_share FROM p""")
def availability_credit(spark, d):
    plans = v.tenants(spark, d).select("tenant_id", v.pick(F.col("tenant_id") % 3, list(fv.SLA_PLANS)).alias("plan"))
    return mon.availability_credit(v.requests(spark, d), plans, ["tenant_id"])


@query("A39_operation_summary", """WITH k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY ts DESC, request_id DESC) AS rn
    FROM requests) WHERE rn <= 1000), r AS (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY duration_ms) - 1 AS q, count(*) OVER (PARTITION BY endpoint) AS n FROM k)
  SELECT endpoint, ROUND(avg(duration_ms), 6) AS avg, min(duration_ms) AS min, max(duration_ms) AS max, count(*) AS count,
    max(duration_ms) FILTER (q = least(CAST(floor(n * 0.95::DOUBLE) AS BIGINT), n - 1)) AS p95 FROM r GROUP BY 1""")
def operation_summary(spark, d):
    return rounded(mon.operation_summary(v.requests(spark, d), "endpoint"), 6, "avg")


@query("W01_rolling_call_stats", """WITH w AS (SELECT tenant_id, request_id, latency_ms, success,
    row_number() OVER (PARTITION BY tenant_id ORDER BY ts, request_id) AS pos,
    list(latency_ms) OVER f AS ds, sum(CASE WHEN success THEN 1 ELSE 0 END) OVER f AS oks, sum(CAST(latency_ms AS DECIMAL(18,2))) OVER f AS dur,
    sum(CASE WHEN success THEN 1 ELSE 0 END) OVER a AS all_ok, sum(CAST(latency_ms AS DECIMAL(18,2))) OVER a AS all_dur
    FROM usage WINDOW f AS (PARTITION BY tenant_id ORDER BY ts, request_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW),
      a AS (PARTITION BY tenant_id ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING))
  SELECT tenant_id, request_id, pos, len(ds) AS window_size, ROUND(oks::DOUBLE / len(ds), 4) AS window_success_rate,
    (CAST(dur * 100 AS HUGEINT) * 200 + len(ds)) // (2 * len(ds)) / 10000.0::DOUBLE AS window_avg_duration,
    list_sort(ds)[least(CAST(floor(len(ds) * 0.95::DOUBLE) AS BIGINT), len(ds) - 1) + 1] AS window_p95_duration,
    ROUND(all_ok::DOUBLE / pos, 4) AS all_time_success_rate, (CAST(all_dur * 100 AS HUGEINT) * 200 + pos) // (2 * pos) / 10000.0::DOUBLE AS all_time_avg_duration FROM w""")
def rolling_call_stats(spark, d):
    return mon.rolling_call_stats(v.usage(spark, d), "tenant_id")


SHARE = """steps AS (SELECT CAST(floor(epoch(ts) / 1800) AS BIGINT) AS step, count(*) AS n, count(*) FILTER (status_code >= 500) AS bad FROM requests GROUP BY 1),
  spread AS (SELECT unnest(range(step + 1, step + 13)) AS e, n, bad FROM steps),
  share AS (SELECT e * 1800 AS window_end, CAST(sum(n) AS BIGINT) AS requests, CAST(sum(bad) AS BIGINT) AS flagged, sum(bad)::DOUBLE / sum(n) AS share FROM spread GROUP BY 1)"""


@query("T02_sliding_error_share", "WITH " + SHARE + " SELECT window_end, requests, flagged, ROUND(share, 6) AS share FROM share")
def sliding_error_share(spark, d):
    """Six-hour windows every half hour over the sparse test traffic; the job takes any width and step."""
    return rounded(mon.sliding_error_share(v.requests(spark, d), F.col("status_code") >= 500, 21600, 1800), 6, "share")


@query("W11_firing_spans", "WITH " + SHARE + """, runs AS (SELECT window_end, share > 0.25 AS hit,
    sum(CASE WHEN share > 0.25 AND window_end - before <= 1800 THEN 0 ELSE 1 END) OVER (ORDER BY window_end ROWS UNBOUNDED PRECEDING) AS run
    FROM (SELECT *, lag(window_end) OVER (ORDER BY window_end) AS before FROM share))
  SELECT min(window_end) AS since, max(window_end) AS until, count(*) AS points, max(window_end) - min(window_end) AS held_seconds
  FROM runs WHERE hit GROUP BY run HAVING max(window_end) - min(window_end) >= 3600""")
def firing_spans(spark, d):
    share = mon.sliding_error_share(v.requests(spark, d), F.col("status_code") >= 500, 21600, 1800)
    points = share.select(F.lit("error_share").alias("rule"), F.timestamp_seconds("window_end").alias("ts"), (F.col("share") > 0.25).alias("hit"))
    out = mon.firing_spans(points, ["rule"], "hit", 3600, 1800)
    return out.select(F.unix_seconds("since").alias("since"), F.unix_seconds("until").alias("until"), "points", "held_seconds")


@query("P01_audit_search", """SELECT audit_id, action, status, epoch_us(ts) AS ts_us FROM audit WHERE tenant_id = 3 AND action = 'data.export'
    AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25' ORDER BY ts DESC, audit_id DESC LIMIT 20""")
def audit_search(spark, d):
    hits = mon.audit_search(v.audit(spark, d), 3, "data.export", "2024-01-05", "2024-01-25", 20)
    return hits.select("audit_id", "action", "status", F.unix_micros("ts").alias("ts_us"))


ALERTING = "(" + ", ".join(f"'{a}'" for a in fv.ALERTING_ACTIONS) + ")"


@query("T07_security_alerts", f"""SELECT epoch(date_trunc('hour', ts))::BIGINT AS window_start, action, count(*) AS alerts, count(DISTINCT tenant_id) AS tenants
    FROM audit WHERE action IN {ALERTING} OR status = 'failure' GROUP BY 1, 2""")
def security_alerts(spark, d):
    return mon.security_alerts(v.audit(spark, d)).withColumn("window_start", F.unix_seconds("window_start"))


@query("W06_unacknowledged_firsts", """WITH a AS (SELECT event_id AS alert_id, ts, event_type AS field, CAST(user_id % 5 AS VARCHAR) AS value,
    CASE WHEN k % 10 = 0 THEN 'ack' ELSE 'alert' END AS kind FROM ev),
  e AS (SELECT *, sum(CASE WHEN kind = 'ack' THEN 1 ELSE 0 END) OVER (PARTITION BY field, value ORDER BY ts, alert_id ROWS UNBOUNDED PRECEDING) AS epoch FROM a)
  SELECT field, value, CAST(epoch AS BIGINT) AS epoch, arg_min(alert_id, (ts, alert_id)) AS alert_id, count(*) AS seen FROM e WHERE kind = 'alert' GROUP BY 1, 2, 3""")
def unacknowledged_firsts(spark, d):
    alerts = v.events(spark, d).select(
        F.col("event_id").alias("alert_id"), "ts", F.col("event_type").alias("field"),
        (F.col("user_id") % 5).cast("string").alias("value"), F.when(F.col("k") % 10 == 0, "ack").otherwise("alert").alias("kind"))
    return mon.unacknowledged_firsts(alerts, ["field", "value"]).drop("ts")


@query("A22_alert_statistics", """SELECT coalesce(level, 'all') AS level, count(*) AS total, count(*) FILTER (NOT ack) AS active, count(*) FILTER (ack) AS acknowledged
    FROM (SELECT (['info', 'warning', 'critical'])[k % 3 + 1] AS level, k % 4 = 0 AS ack FROM ev) GROUP BY ROLLUP (level)""")
def alert_statistics(spark, d):
    alerts = v.events(spark, d).select(v.pick(F.col("k") % 3, ["info", "warning", "critical"]).alias("level"),
                                       (F.col("k") % 4 == 0).alias("acknowledged"))
    return mon.alert_statistics(alerts).withColumn("level", F.coalesce("level", F.lit("all")))


SESSIONS = """WITH g AS (SELECT tenant_id, epoch_us(ts) AS us, coalesce(CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY tenant_id ORDER BY ts) >= 1800000000 THEN 1 END, 0) AS fresh FROM usage),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY tenant_id ORDER BY us ROWS UNBOUNDED PRECEDING) + 1 AS session FROM g)
  SELECT tenant_id, CAST(session AS BIGINT) AS session, min(us) AS started, max(us) AS ended, count(*) AS calls FROM s GROUP BY 1, 2"""


@query("T08_idle_sessions", SESSIONS)
def idle_sessions(spark, d):
    return mon.idle_sessions(v.usage(spark, d), ["tenant_id"], 30)
