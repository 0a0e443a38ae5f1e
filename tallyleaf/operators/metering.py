"""Usage metering, invoices, quotas and degradation decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyleaf import fixed_values as fv
from tallyleaf.operators.scale import hour_chunk, literal_table, newest_per_key, running_totals

THOUSANDTH = "CAST(0.001 AS DECIMAL(4,3))"


def price_list(spark: SparkSession) -> DataFrame:
    rows = [(m, a, b) for m, (a, b) in fv.MODEL_PRICES.items()]
    return literal_table(spark, rows, "model string; price_in decimal(10,6); price_out decimal(10,6)")


def package_list(spark: SparkSession) -> DataFrame:
    rows = [(t, *r) for t, r in fv.PACKAGES.items()]
    return literal_table(spark, rows, "tier string; fee decimal(12,2); quota bigint; rate decimal(10,6)")


def quota_list(spark: SparkSession) -> DataFrame:
    rows = [(t, *r) for t, r in fv.TIER_QUOTAS.items()]
    return literal_table(spark, rows, "tier string; base_rpm bigint; base_tpm bigint; elastic_rpm bigint; "
                                      "elastic_tpm bigint; burst_rpm bigint; burst_tpm bigint")


def price_usage(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of each call; a model that is not on the list costs nothing. The list is a fixed, tiny table."""
    zero = F.lit(0).cast("decimal(10,6)")
    cost = (
        F.col("input_tokens").cast("decimal(18,0)") * F.coalesce("price_in", zero)
        + F.col("output_tokens").cast("decimal(18,0)") * F.coalesce("price_out", zero)
    ) * F.expr(THOUSANDTH)
    return (
        usage.join(prices, "model", "left")
        .withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
        .withColumn("cost_usd", F.round(cost, 6).cast("decimal(20,6)"))
        .drop("price_in", "price_out")
    )


def period(ts: str = "ts") -> Column:
    return F.date_format(ts, "yyyyMM")


def usage_totals() -> list[Column]:
    return [
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
        F.count("*").alias("call_count"),
        F.count_if(~F.col("success")).alias("failed_count"),
        F.sum("cost_usd").cast("decimal(20,6)").alias("cost_usd"),
    ]


def monthly_usage(priced: DataFrame) -> DataFrame:
    """One row per tenant and month; partial sums are combined before the shuffle, so a hot tenant is harmless."""
    out = priced.groupBy("tenant_id", period().alias("period")).agg(*usage_totals())
    return out.withColumn(
        "cost_cny", F.round(F.col("cost_usd") * F.lit(fv.USD_TO_CNY).cast("decimal(4,2)"), 4))


def usage_by_model(priced: DataFrame) -> DataFrame:
    return priced.groupBy("tenant_id", "model", period().alias("period")).agg(
        F.sum("total_tokens").alias("tokens"), F.count("*").alias("call_count"),
        F.sum("cost_usd").cast("decimal(20,6)").alias("cost_usd"))


def usage_maps(priced: DataFrame) -> DataFrame:
    """Per tenant: totals with maps of tokens per model and calls per scenario.

    Aggregated by (tenant, model, scenario) first, so the map step sees a handful of rows per tenant.
    """
    fine = priced.groupBy("tenant_id", "model", "scenario").agg(
        F.sum("total_tokens").alias("t"), F.count("*").alias("n"))
    per_model = fine.groupBy("tenant_id", "model").agg(F.sum("t").alias("t"))
    per_scenario = fine.groupBy("tenant_id", "scenario").agg(F.sum("n").alias("n"))
    models = per_model.groupBy("tenant_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("model", "t")))).alias("by_model"),
        F.sum("t").alias("total_tokens"))
    scenarios = per_scenario.groupBy("tenant_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("scenario", "n")))).alias("by_scenario"),
        F.sum("n").alias("call_count"))
    return models.join(scenarios, "tenant_id")


def with_package(df: DataFrame, packages: DataFrame, default: str = "free") -> DataFrame:
    """Package of each row's tier; an unknown tier is priced as ``default``."""
    names = list(fv.PACKAGES)
    known = F.when(F.col("tier").isin(names), F.col("tier")).otherwise(F.lit(default))
    return (
        df.withColumn("package_tier", known)
        .join(packages.withColumnRenamed("tier", "package_tier"), "package_tier", "left")
    )


def with_quota(df: DataFrame, quotas: DataFrame, default: str = "free") -> DataFrame:
    """Quota of each row's tier and the effective per-minute limits."""
    known = F.when(F.col("tier").isin(list(fv.TIER_QUOTAS)), F.col("tier")).otherwise(F.lit(default))
    return (
        df.withColumn("quota_tier", known)
        .join(quotas.withColumnRenamed("tier", "quota_tier"), "quota_tier", "left")
        .withColumn("rpm_limit", F.col("base_rpm") + F.col("elastic_rpm") + F.col("burst_rpm"))
        .withColumn("tpm_limit", F.col("base_tpm") + F.col("elastic_tpm") + F.col("burst_tpm"))
    )


def invoices(monthly: DataFrame, tenants: DataFrame, packages: DataFrame) -> DataFrame:
    """One invoice per tenant and month in four modes: package, by_token, by_call, hybrid (the default)."""
    money = "decimal(18,2)"
    zero = F.lit(0).cast(money)
    billed = with_package(monthly.join(tenants, "tenant_id"), packages)
    packaged = ~F.col("mode").isin("by_token", "by_call")
    over = F.when(packaged & (F.col("total_tokens") > F.col("quota")),
                  F.col("total_tokens") - F.col("quota")).otherwise(F.lit(0).cast("bigint"))
    out = (
        billed.withColumn("package_fee", F.when(packaged, F.col("fee").cast(money)).otherwise(zero))
        .withColumn("overage_tokens", over)
        .withColumn("overage_cost", F.round(
            F.col("overage_tokens").cast("decimal(18,0)") * F.col("rate") * F.expr(THOUSANDTH), 2).cast(money))
        .withColumn("by_token_cost", F.when(F.col("mode") == "by_token", F.round("cost_cny", 2).cast(money))
                    .otherwise(zero))
        .withColumn("by_call_cost", F.when(
            F.col("mode") == "by_call",
            (F.col("call_count").cast("decimal(12,0)") * F.lit(fv.PRICE_PER_CALL_CNY).cast("decimal(4,2)"))
            .cast(money)).otherwise(zero))
        .withColumn("discount", F.greatest(F.coalesce(F.col("discount").cast(money), zero), zero))
    )
    gross = F.col("package_fee") + F.col("overage_cost") + F.col("by_token_cost") + F.col("by_call_cost")
    start = F.to_date(F.concat("period", F.lit("01")), "yyyyMMdd")
    return (
        out.withColumn("total_amount", F.greatest(zero, (gross - F.col("discount")).cast(money)))
        .withColumn("period_start", start)
        .withColumn("period_end", F.add_months(start, 1))
        .withColumn("due_date", F.add_months(start, 1))
    )


def invoice_lines(invoiced: DataFrame) -> DataFrame:
    """One row per charge of an invoice, in the order fee, overage, tokens, calls, discount."""
    text = {k: F.lit(d) for k, (d, _) in fv.INVOICE_LINE_TEXT.items()}
    units = {k: u for k, (_, u) in fv.INVOICE_LINE_TEXT.items()}

    def line(n, description, quantity, unit, price, amount, present):
        item = F.struct(
            F.lit(n).alias("line_no"), description.alias("description"), quantity.cast("bigint").alias("quantity"),
            F.lit(unit).alias("unit"), price.cast("double").alias("unit_price"), amount.cast("double").alias("amount"))
        return F.when(present, item)

    one = F.lit(1)
    lines = F.array_compact(F.array(
        line(1, F.concat(F.upper("tier"), text["fee"]), one, units["fee"], F.col("package_fee"),
             F.col("package_fee"), F.col("package_fee") > 0),
        line(2, text["overage"], F.col("overage_tokens"), units["overage"], F.col("rate").cast("double") / 1000,
             F.col("overage_cost"), F.col("overage_tokens") > 0),
        line(3, text["tokens"], F.col("total_tokens"), units["tokens"],
             F.col("cost_cny").cast("double") / F.greatest(F.lit(1), "total_tokens"), F.col("by_token_cost"),
             F.col("by_token_cost") > 0),
        line(4, text["calls"], F.col("call_count"), units["calls"], F.lit(float(fv.PRICE_PER_CALL_CNY)),
             F.col("by_call_cost"), F.col("by_call_cost") > 0),
        line(5, text["discount"], one, units["discount"], -F.col("discount"), -F.col("discount"), F.col("discount") > 0),
    ))
    return invoiced.select("tenant_id", "period", F.inline(lines))


def newest_usage(usage: DataFrame, n: int = 1000) -> DataFrame:
    """The newest ``n`` detail records of each tenant."""
    return newest_per_key(usage, ["tenant_id"], [F.col("ts").desc(), F.col("request_id").desc()], n)


def tenant_overview(tenants: DataFrame, monthly: DataFrame, month: str) -> DataFrame:
    """Tenants per tier with their status and the usage of one month."""
    used = monthly.where(F.col("period") == month).select("tenant_id", "total_tokens", "call_count")
    return (
        tenants.join(used, "tenant_id", "left").groupBy("tier").agg(
            F.count("*").alias("tenants"),
            F.count_if(F.col("status") == "active").alias("active"),
            F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
            F.coalesce(F.sum("call_count"), F.lit(0)).alias("call_count"))
    )


def usage_of_status(usage: DataFrame, tenants: DataFrame, status: str) -> DataFrame:
    """Usage rows of tenants in ``status``; the tenant list is joined by size, never forced to be broadcast."""
    return usage.join(tenants.where(F.col("status") == status).select("tenant_id"), "tenant_id", "left_semi")


def model_violations(usage: DataFrame, allowed: DataFrame) -> DataFrame:
    """Calls per tenant that used a model outside its list; an empty list allows every model.

    Calls are counted per (tenant, model) before the join with the tenants' lists.
    """
    counted = usage.groupBy("tenant_id", "model").agg(F.count("*").alias("n"))
    ok = (F.size("allowed_models") == 0) | F.array_contains("allowed_models", F.col("model"))
    return (
        counted.join(allowed, "tenant_id").groupBy("tenant_id").agg(
            F.sum("n").alias("calls"), F.sum(F.when(ok, 0).otherwise(F.col("n"))).alias("violations"))
    )


def minute_load(priced: DataFrame) -> DataFrame:
    """Calls, tokens and errors per tenant and minute."""
    minute = F.date_trunc("minute", "ts").alias("minute")
    return priced.groupBy("tenant_id", minute).agg(
        F.count("*").alias("rpm"), F.sum("total_tokens").alias("tpm"),
        F.count_if(~F.col("success")).alias("errors"), F.max_by("model", F.struct("ts", "request_id")).alias("model"))


def limiter_utilisation(load: DataFrame, tenants: DataFrame, quotas: DataFrame) -> DataFrame:
    """Share of the per-minute limits in use, in percent with one decimal."""
    joined = with_quota(load.join(tenants.select("tenant_id", "tier"), "tenant_id"), quotas)
    return joined.withColumn("rpm_pct", F.round(100.0 * F.col("rpm") / F.greatest("rpm_limit", F.lit(1)), 1)).withColumn(
        "tpm_pct", F.round(100.0 * F.col("tpm") / F.greatest("tpm_limit", F.lit(1)), 1))


def chain_list(spark: SparkSession) -> DataFrame:
    return literal_table(spark, [(m, c) for m, c in fv.FALLBACK_CHAINS.items()], "model string; chain array<string>")


def degradation(load: DataFrame, chains: DataFrame) -> DataFrame:
    """Decision per row of (model, tpm, tpm_limit, error_rate, sessions), strongest reason first.

    A step down needs a model to step down to, so a row whose chain is too short falls through to the next rule.
    """
    ratio = F.when(F.col("tpm_limit") > 0, F.col("tpm") / F.col("tpm_limit")).otherwise(F.lit(0.0))
    steps = F.coalesce(F.size("chain"), F.lit(0))
    first, last = F.element_at("chain", 1), F.element_at("chain", -1)
    failing = (F.col("error_rate") >= fv.ERROR_RATE_DEGRADE) & (steps >= 1)
    level = (
        F.when(failing, "lite").when(F.col("usage_ratio") >= fv.USAGE_REJECT, "reject")
        .when((F.col("usage_ratio") >= fv.USAGE_MINI) & (steps >= 2), "mini")
        .when((F.col("usage_ratio") >= fv.USAGE_LITE) & (steps >= 1), "lite")
        .when(F.col("sessions") > fv.SESSION_LIMIT, "cached").otherwise("normal")
    )
    target = (
        F.when(F.col("level") == "lite", first).when(F.col("level") == "mini", last)
        .when(F.col("level") == "normal", F.col("model"))
    )
    return (
        load.join(chains, "model", "left").withColumn("usage_ratio", ratio).withColumn("level", level)
        .withColumn("target_model", target)
        .withColumn("retry_after", F.when(F.col("level") == "reject", 60).otherwise(0))
        .withColumn("warn", F.col("usage_ratio") >= fv.USAGE_WARN).drop("chain")
    )


def cost_anomalies(priced: DataFrame, factor: float = 2.0) -> DataFrame:
    """Hours in which a tenant's cost rate exceeds ``factor`` times its rate in the 24 hours one day earlier.

    The facts are reduced to one row per tenant and hour before any window runs.
    """
    hour = F.floor(F.unix_seconds("ts") / 3600).alias("hour")
    hourly = priced.groupBy("tenant_id", hour).agg(F.sum("cost_usd").cast("decimal(20,6)").alias("cost"))
    past = Window.partitionBy("tenant_id").orderBy("hour").rangeBetween(-47, -24)
    out = hourly.withColumn("past_rate", F.sum("cost").over(past).cast("double") / 24)
    return out.where(F.col("cost").cast("double") > factor * F.col("past_rate"))


def quota_crossings(priced: DataFrame, tenants: DataFrame, thresholds: list[float], chunk_hours: int = 1) -> DataFrame:
    """The call at which a tenant's running monthly tokens cross each share of its quota.

    The running sum is split by hour, so a tenant with most of the traffic is spread over many tasks.
    """
    rows = priced.select("tenant_id", "ts", "request_id", "total_tokens", period().alias("period"))
    run = running_totals(rows, ["tenant_id", "period"], hour_chunk("ts", chunk_hours), ["ts", "request_id"],
                         {"used": F.col("total_tokens")})
    run = run.join(tenants.select("tenant_id", "monthly_quota"), "tenant_id")
    marks = F.array(*[F.lit(t) for t in thresholds])
    before = F.col("used") - F.col("total_tokens")
    crossed = F.filter(marks, lambda t: (before < t * F.col("monthly_quota")) & (F.col("used") >= t * F.col("monthly_quota")))
    return run.select("tenant_id", "period", "request_id", "used", F.explode(crossed).alias("threshold"))
