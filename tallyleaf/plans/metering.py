"""Registered metering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyleaf import fixed_values as fv
from tallyleaf.operators import metering as m
from tallyleaf.plans.oracle_views import sql_list, sql_rows
from tallyleaf.plans.registry import query
from tallyleaf.sources import views as v


def priced(spark, d):
    return m.price_usage(v.usage(spark, d), m.price_list(spark))


def monthly(spark, d):
    return m.monthly_usage(priced(spark, d))


def dbl(*names):
    return [F.col(n).cast("double").alias(n) for n in names]


@query("J04_call_cost", """SELECT model, count(*) AS calls, CAST(sum(cost_usd) AS DOUBLE) AS cost_usd,
    count(*) FILTER (cost_usd = 0) AS free_calls FROM priced GROUP BY model""")
def call_cost(spark, d):
    return priced(spark, d).groupBy("model").agg(
        F.count("*").alias("calls"), F.sum("cost_usd").cast("double").alias("cost_usd"),
        F.count_if(F.col("cost_usd") == 0).alias("free_calls"))


@query("A01_monthly_usage", """SELECT tenant_id, period, input_tokens, output_tokens, total_tokens, call_count,
    failed_count, CAST(cost_usd AS DOUBLE) AS cost_usd, CAST(cost_cny AS DOUBLE) AS cost_cny FROM monthly""")
def monthly_usage(spark, d):
    return monthly(spark, d).select("tenant_id", "period", "input_tokens", "output_tokens", "total_tokens",
                                    "call_count", "failed_count", *dbl("cost_usd", "cost_cny"))


@query("A02_usage_by_model", """SELECT tenant_id, model, strftime(ts, '%Y%m') AS period,
    CAST(sum(total_tokens) AS BIGINT) AS tokens, count(*) AS call_count, CAST(sum(cost_usd) AS DOUBLE) AS cost_usd
    FROM priced GROUP BY 1, 2, 3""")
def usage_by_model(spark, d):
    return m.usage_by_model(priced(spark, d)).withColumn("cost_usd", F.col("cost_usd").cast("double"))


@query("A03_usage_maps", """SELECT tenant_id, 'model' AS kind, model AS name, CAST(sum(total_tokens) AS BIGINT) AS amount
    FROM priced GROUP BY 1, 3 UNION ALL
    SELECT tenant_id, 'scenario', scenario, count(*) FROM priced GROUP BY 1, 3""")
def usage_maps(spark, d):
    maps = m.usage_maps(priced(spark, d))
    models = maps.select("tenant_id", F.lit("model").alias("kind"), F.explode("by_model").alias("name", "amount"))
    scenarios = maps.select("tenant_id", F.lit("scenario").alias("kind"), F.explode("by_scenario").alias("name", "amount"))
    return models.unionByName(scenarios)


INVOICE_SQL = """invoiced AS (
    SELECT b.*, CASE WHEN packaged THEN fee ELSE 0 END AS package_fee,
        CASE WHEN packaged AND total_tokens > quota THEN total_tokens - quota ELSE 0 END AS overage_tokens
    FROM (SELECT mo.*, t.tier, t.mode, t.discount, p.fee, p.quota, p.rate,
                 t.mode NOT IN ('by_token', 'by_call') AS packaged
          FROM monthly mo JOIN tenants t ON mo.tenant_id = t.tenant_id
          JOIN packages p ON p.tier = CASE WHEN t.tier IN (SELECT tier FROM packages) THEN t.tier ELSE 'free' END) b),
  charged AS (SELECT *, ROUND(CAST(overage_tokens AS DECIMAL(18,0)) * rate * CAST(0.001 AS DECIMAL(4,3)), 2) AS overage_cost,
        CASE WHEN mode = 'by_token' THEN ROUND(cost_cny, 2) ELSE 0 END AS by_token_cost,
        CASE WHEN mode = 'by_call' THEN CAST(call_count AS DECIMAL(12,0)) * CAST(0.1 AS DECIMAL(4,2)) ELSE 0 END AS by_call_cost
    FROM invoiced)"""


@query("A04_invoices", "WITH " + INVOICE_SQL + """
    SELECT tenant_id, period, tier, mode, total_tokens, overage_tokens, CAST(package_fee AS DOUBLE) AS package_fee,
        CAST(overage_cost AS DOUBLE) AS overage_cost, CAST(by_token_cost AS DOUBLE) AS by_token_cost,
        CAST(by_call_cost AS DOUBLE) AS by_call_cost,
        CAST(greatest(0, package_fee + overage_cost + by_token_cost + by_call_cost - discount) AS DOUBLE) AS total_amount,
        substr(period, 1, 4) || '-' || substr(period, 5, 2) || '-01' AS period_start,
        strftime(strptime(period || '01', '%Y%m%d') + INTERVAL 1 MONTH, '%Y-%m-%d') AS period_end FROM charged""")
def invoices(spark, d):
    inv = m.invoices(monthly(spark, d), v.tenants(spark, d), m.package_list(spark))
    return inv.select(
        "tenant_id", "period", "tier", "mode", "total_tokens", "overage_tokens",
        *dbl("package_fee", "overage_cost", "by_token_cost", "by_call_cost", "total_amount"),
        F.col("period_start").cast("string").alias("period_start"), F.col("period_end").cast("string").alias("period_end"))


@query("A05_invoice_lines", "WITH " + INVOICE_SQL + """
    SELECT tenant_id, period, 1 AS line_no, upper(tier) || ' 套餐月费' AS description, 1::BIGINT AS quantity,
        CAST(package_fee AS DOUBLE) AS amount FROM charged WHERE package_fee > 0 UNION ALL
    SELECT tenant_id, period, 2, '超额Token费', overage_tokens, CAST(overage_cost AS DOUBLE) FROM charged WHERE overage_tokens > 0 UNION ALL
    SELECT tenant_id, period, 3, '按Token计费', total_tokens, CAST(by_token_cost AS DOUBLE) FROM charged WHERE by_token_cost > 0 UNION ALL
    SELECT tenant_id, period, 4, '按调用计费', call_count, CAST(by_call_cost AS DOUBLE) FROM charged WHERE by_call_cost > 0 UNION ALL
    SELECT tenant_id, period, 5, '优惠折扣', 1, -CAST(discount AS DOUBLE) FROM charged WHERE discount > 0""")
def invoice_lines(spark, d):
    inv = m.invoices(monthly(spark, d), v.tenants(spark, d), m.package_list(spark))
    return m.invoice_lines(inv).select("tenant_id", "period", "line_no", "description", "quantity", "amount")


@query("J05_tier_package", """SELECT t.tenant_id, t.tier, CAST(p.fee AS DOUBLE) AS fee, p.quota FROM tenants t JOIN packages p
    ON p.tier = CASE WHEN t.tier IN (SELECT tier FROM packages) THEN t.tier ELSE 'free' END""")
def tier_package(spark, d):
    return m.with_package(v.tenants(spark, d), m.package_list(spark)).select(
        "tenant_id", "tier", *dbl("fee"), "quota")


@query("J06_tier_limits", """SELECT t.tenant_id, t.tier, CAST(base_rpm + elastic_rpm + burst_rpm AS BIGINT) AS rpm_limit,
    CAST(base_tpm + elastic_tpm + burst_tpm AS BIGINT) AS tpm_limit FROM tenants t JOIN quotas q
    ON q.tier = CASE WHEN t.tier IN (SELECT tier FROM quotas) THEN t.tier ELSE 'free' END""")
def tier_limits(spark, d):
    return m.with_quota(v.tenants(spark, d), m.quota_list(spark)).select("tenant_id", "tier", "rpm_limit", "tpm_limit")


@query("W02_newest_per_tenant", """SELECT tenant_id, request_id FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id
    ORDER BY ts DESC, request_id DESC) AS rn FROM usage) WHERE rn <= 100""")
def newest_per_tenant(spark, d):
    return m.newest_usage(v.usage(spark, d), 100).select("tenant_id", "request_id")


@query("A23_tenant_overview", """SELECT t.tier, count(*) AS tenants, count(*) FILTER (t.status = 'active') AS active,
    CAST(coalesce(sum(mo.total_tokens), 0) AS BIGINT) AS total_tokens, CAST(coalesce(sum(mo.call_count), 0) AS BIGINT) AS call_count
    FROM tenants t LEFT JOIN (SELECT * FROM monthly WHERE period = '202401') mo ON t.tenant_id = mo.tenant_id GROUP BY 1""")
def tenant_overview(spark, d):
    return m.tenant_overview(v.tenants(spark, d), monthly(spark, d), "202401")


@query("J14_suspended_usage", """SELECT tenant_id, count(*) AS calls, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM priced
    WHERE tenant_id IN (SELECT tenant_id FROM tenants WHERE status = 'suspended') GROUP BY 1""")
def suspended_usage(spark, d):
    rows = m.usage_of_status(priced(spark, d), v.tenants(spark, d), "suspended")
    return rows.groupBy("tenant_id").agg(F.count("*").alias("calls"), F.sum("total_tokens").alias("tokens"))


ALLOWED = v.USAGE_MODELS[:2]


@query("P13_model_violations", f"""SELECT tenant_id, count(*) AS calls,
    count(*) FILTER (tenant_id % 4 <> 0 AND model NOT IN ('{ALLOWED[0]}', '{ALLOWED[1]}')) AS violations FROM usage GROUP BY 1""")
def model_violations(spark, d):
    lists = v.tenants(spark, d).select("tenant_id", F.when(F.col("tenant_id") % 4 == 0, F.array().cast("array<string>"))
                                       .otherwise(F.array(*[F.lit(a) for a in ALLOWED])).alias("allowed_models"))
    return m.model_violations(v.usage(spark, d), lists)


LOAD_SQL = """loads AS (SELECT tenant_id, date_trunc('minute', ts) AS minute, count(*) AS rpm,
    CAST(sum(total_tokens) AS BIGINT) AS tpm, count(*) FILTER (NOT success) AS errors,
    arg_max(model, (ts, request_id)) AS model FROM priced GROUP BY 1, 2),
  limited AS (SELECT l.*, CAST(base_rpm + elastic_rpm + burst_rpm AS BIGINT) AS rpm_limit, CAST(base_tpm + elastic_tpm + burst_tpm AS BIGINT) AS tpm_limit
    FROM loads l JOIN tenants t ON l.tenant_id = t.tenant_id JOIN quotas q
    ON q.tier = CASE WHEN t.tier IN (SELECT tier FROM quotas) THEN t.tier ELSE 'free' END)"""


@query("A10_limiter_utilisation", "WITH " + LOAD_SQL + """ SELECT tenant_id, epoch(minute)::BIGINT AS minute, rpm, tpm,
    ROUND(100.0::DOUBLE * rpm / greatest(rpm_limit, 1), 1) AS rpm_pct, ROUND(100.0::DOUBLE * tpm / greatest(tpm_limit, 1), 1) AS tpm_pct FROM limited""")
def limiter_utilisation(spark, d):
    out = m.limiter_utilisation(m.minute_load(priced(spark, d)), v.tenants(spark, d), m.quota_list(spark))
    return out.select("tenant_id", F.unix_seconds("minute").alias("minute"), "rpm", "tpm", "rpm_pct", "tpm_pct")


CHAIN_ROWS = ", ".join(f"('{k}', {sql_list(c)})" for k, c in fv.FALLBACK_CHAINS.items())


@query("P07_degradation", "WITH " + LOAD_SQL + f""", chained AS (
    SELECT l.*, l.tpm::DOUBLE / l.tpm_limit AS r, l.errors::DOUBLE / l.rpm AS er, coalesce(len(c.chain), 0) AS steps, c.chain
    FROM limited l LEFT JOIN (VALUES {CHAIN_ROWS}) AS c(model, chain) ON l.model = c.model),
  decided AS (SELECT *, CASE WHEN er >= 0.1 AND steps >= 1 THEN 'lite' WHEN r >= 1.0 THEN 'reject'
    WHEN r >= 0.95 AND steps >= 2 THEN 'mini' WHEN r >= 0.85 AND steps >= 1 THEN 'lite' ELSE 'normal' END AS level FROM chained)
  SELECT level, CASE level WHEN 'lite' THEN chain[1] WHEN 'mini' THEN chain[-1] WHEN 'normal' THEN model END AS target_model,
    count(*) AS minutes, count(*) FILTER (r >= 0.7) AS warned FROM decided GROUP BY 1, 2""")
def degradation(spark, d):
    load = m.with_quota(m.minute_load(priced(spark, d)).join(v.tenants(spark, d).select("tenant_id", "tier"), "tenant_id"),
                        m.quota_list(spark))
    load = load.withColumn("error_rate", F.col("errors") / F.col("rpm")).withColumn("sessions", F.lit(0))
    out = m.degradation(load, m.chain_list(spark))
    return out.groupBy("level", "target_model").agg(F.count("*").alias("minutes"), F.count_if("warn").alias("warned"))


@query("J12_cost_anomalies", """WITH hourly AS (SELECT tenant_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour,
    sum(cost_usd) AS cost FROM priced GROUP BY 1, 2),
  past AS (SELECT *, CAST(sum(cost) OVER (PARTITION BY tenant_id ORDER BY hour RANGE BETWEEN 47 PRECEDING AND 24 PRECEDING) AS DOUBLE) / 24 AS past_rate FROM hourly)
  SELECT tenant_id, hour, CAST(cost AS DOUBLE) AS cost, ROUND(past_rate, 8) AS past_rate FROM past WHERE CAST(cost AS DOUBLE) > 2 * past_rate""")
def cost_anomalies(spark, d):
    return m.cost_anomalies(priced(spark, d)).select(
        "tenant_id", "hour", *dbl("cost"), F.round("past_rate", 8).alias("past_rate"))


@query("T04_quota_crossings", """WITH q AS (SELECT tenant_id, 400000 + tenant_id * 50000 AS monthly_quota FROM tenants),
  run AS (SELECT tenant_id, strftime(ts, '%Y%m') AS period, request_id, total_tokens,
    sum(total_tokens) OVER (PARTITION BY tenant_id, strftime(ts, '%Y%m') ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING) AS used FROM priced)
  SELECT r.tenant_id, period, request_id, CAST(used AS BIGINT) AS used, t.threshold FROM run r JOIN q ON r.tenant_id = q.tenant_id,
    (VALUES (0.7::DOUBLE), (0.85::DOUBLE), (0.95::DOUBLE), (1.0::DOUBLE)) AS t(threshold)
  WHERE used - total_tokens < t.threshold * monthly_quota AND used >= t.threshold * monthly_quota""")
def quota_crossings(spark, d):
    quotas = v.tenants(spark, d).select("tenant_id", (F.lit(400000) + F.col("tenant_id") * 50000).alias("monthly_quota"))
    return m.quota_crossings(priced(spark, d), quotas, [0.7, 0.85, 0.95, 1.0])
