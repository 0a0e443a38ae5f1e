"""Expiry and stock alerts, ledgers, transaction and contract checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyleaf import fixed_values as fv
from tallyleaf.functions.dates import dates_in, expiry_status, parse_date
from tallyleaf.operators.registry import Registry, failing_rules
from tallyleaf.operators.scale import newest_per_key


def with_status(items: DataFrame, asof: Column, near_days: int = 30) -> DataFrame:
    return items.withColumn("days_to_expiry", F.datediff("expiry_date", asof)).withColumn(
        "status", expiry_status(F.col("expiry_date"), asof, near_days))


def dates_in_texts(docs: DataFrame, asof: Column, near_days: int = 30) -> DataFrame:
    """Production and expiry date of each text, and its status: of two or more dates the first is production and the second
    expiry, a single one is expiry; a text without a date is 'unknown'.
    """
    first, second = F.get("_dates", F.lit(0)), F.get("_dates", F.lit(1))
    found = docs.withColumn("_dates", dates_in(F.col("text"))).withColumn("production_date", F.when(second.isNotNull(), first)).withColumn(
        "expiry_date", F.coalesce(second, first))
    return with_status(found.drop("_dates"), asof, near_days)


def validate_expiry(items: DataFrame, asof: Column, extra: Registry | None = None) -> DataFrame:
    """Reason and confidence for written production and expiry dates, first failing check first.

    Where these find nothing, the rules of ``extra`` are tried in turn; they may use the columns of ``items`` and the parsed dates ``_p`` and ``_e``,
    and the first that does not hold gives its name as the reason.
    """
    p, e = F.col("_p"), F.col("_e")
    left = F.datediff(e, asof)
    reason = (
        F.when(p.isNull(), "production_unreadable").when(e.isNull(), "expiry_unreadable").when(p > asof, "production_in_future")
        .when(e < p, "reversed").when(F.datediff(e, p) > 3650, "over_ten_years").when(left < 0, "expired")
        .when(left <= 30, "near_expiry").otherwise("ok")
    )
    sure = (F.when(F.col("reason").endswith("unreadable"), 0.0).when(F.col("reason").isin("production_in_future", "reversed"), 0.5)
            .when(F.col("reason") == "over_ten_years", 0.7).when(F.col("reason") == "near_expiry", 0.9).otherwise(1.0))
    parsed = items.withColumn("_p", parse_date(F.col("production"))).withColumn("_e", parse_date(F.col("expiry")))
    judged = parsed.withColumn("reason", reason)
    if extra is not None:
        broken = F.get(F.col("_broken"), F.lit(0))
        judged = failing_rules(judged, extra, "_broken").withColumn("reason", F.when(F.col("reason").isin("ok", "near_expiry"), F.coalesce(broken, "reason")).otherwise(F.col("reason"))).drop("_broken")
    return judged.withColumn("confidence", sure).withColumn(
        "is_valid", F.col("reason").isin("ok", "near_expiry")).drop("_p", "_e")


def expiry_alerts(items: DataFrame, shown: int = 10) -> DataFrame:
    """One alert per status that needs one, with its count and the first items by id.

    The items shown come from a per-status top-k that Spark trims before the shuffle; no status is collected.
    """
    due = items.where(F.col("status").isin("expired", "near_expiry"))
    counts = due.groupBy("status").agg(F.count("*").alias("count"))
    top = newest_per_key(due.select("status", "item_id", "days_to_expiry"), ["status"], ["item_id"], shown)
    lists = top.groupBy("status").agg(F.array_sort(F.collect_list(F.struct("item_id", F.abs("days_to_expiry").alias("days")))).alias("items"))
    level = F.when(F.col("status") == "expired", "critical").otherwise("warning")
    return counts.join(lists, "status").withColumn("level", level).withColumn("type", F.lit("expiry"))


def stock_alerts(stock: DataFrame, low: int, over: int | None = None) -> DataFrame:
    """Low, over and out-of-stock alerts from a stock table (key, total_items)."""
    n = F.col("total_items")
    rules = [F.when((n > 0) & (n < low), F.struct(F.lit("warning").alias("level"), F.lit("low_stock").alias("alert"))),
             F.when(n == 0, F.struct(F.lit("critical").alias("level"), F.lit("out_of_stock").alias("alert")))]
    if over is not None:
        rules.append(F.when(n > over, F.struct(F.lit("info").alias("level"), F.lit("overstock").alias("alert"))))
    return stock.select(*stock.columns, F.inline(F.array_compact(F.array(*rules))))


def compliance_alerts(items: DataFrame, by: list[str]) -> DataFrame:
    """Groups whose expired share exceeds 5 % (warning) or 10 % (critical)."""
    shares = items.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "expired").alias("expired"))
    rate = F.col("expired") / F.col("total")
    return shares.withColumn("expired_rate", rate).where(rate > 0.05).withColumn("level", F.when(rate > 0.1, "critical").otherwise("warning"))


def alert_summary(alerts: DataFrame) -> DataFrame:
    """Alert counts by type and level with subtotals."""
    return alerts.rollup("type", "level").agg(F.count("*").alias("alerts"))


def expiry_ledger(items: DataFrame, alerts: DataFrame) -> DataFrame:
    """Fact rows and alert rows of the expiry report in one table."""
    facts = items.select(F.lit("item").alias("row_kind"), F.col("item_id").cast("string").alias("name"),
                         F.col("production_date").cast("string").alias("production"), F.col("expiry_date").cast("string").alias("expiry"),
                         "status", F.col("days_to_expiry").cast("bigint").alias("number"))
    rows = alerts.select(F.lit("alert").alias("row_kind"), F.col("status").alias("name"), F.lit("").alias("production"), F.lit("").alias("expiry"),
                         F.col("level").alias("status"), F.col("count").alias("number"))
    return facts.unionByName(rows)


def compliance_ledger(items: DataFrame) -> DataFrame:
    """Totals per status and the expired share as report rows, from one aggregate."""
    totals = items.agg(F.count("*").alias("n"), *[F.count_if(F.col("status") == s).alias(s) for s in ("expired", "valid", "near_expiry")])
    row = lambda name, n, state: F.struct(F.lit(name).alias("name"), n.cast("double").alias("number"), state.alias("state"))
    share = F.col("expired") / F.col("n")
    return totals.select(F.inline(F.array(
        row("total", F.col("n"), F.lit("counted")), row("expired", F.col("expired"), F.when(F.col("expired") > 0, "act").otherwise("normal")),
        row("valid", F.col("valid"), F.lit("normal")), row("near_expiry", F.col("near_expiry"), F.when(F.col("near_expiry") > 0, "watch").otherwise("normal")),
        row("expired_rate", F.round(share, 6), F.when(share > 0.1, "critical").when(share > 0.05, "warning").otherwise("normal")))))


def inventory_ledger(stock: DataFrame, category: str, alerts: DataFrame) -> DataFrame:
    """Inventory report: total stock, number of categories, one row per category, one row per kind of stock alert."""
    per = stock.groupBy(category).agg(F.sum("total_items").alias("n"))
    totals = per.agg(F.sum("n").alias("items"), F.count("*").alias("categories")).select(F.inline(F.array(
        F.struct(F.lit("total").alias("row_kind"), F.lit("items").alias("name"), F.col("items").cast("bigint").alias("number")),
        F.struct(F.lit("total").alias("row_kind"), F.lit("categories").alias("name"), F.col("categories").cast("bigint").alias("number")))))
    rows = per.select(F.lit("category").alias("row_kind"), F.col(category).alias("name"), F.col("n").cast("bigint").alias("number"))
    warned = alerts.groupBy("alert").agg(F.count("*").alias("number")).select(F.lit("alert").alias("row_kind"), F.col("alert").alias("name"), "number")
    return totals.unionByName(rows).unionByName(warned)


def category_breakdown(items: DataFrame, category: str) -> DataFrame:
    """Items per category and in total."""
    return items.rollup(category).agg(F.count("*").alias("items"))


def flag_transactions(txns: DataFrame, watch: DataFrame, limit: float = 50000) -> DataFrame:
    """Each transaction flagged once: large amount or a listed counterparty.

    The watch list may grow, so it is joined as a table and the planner picks the join by its size.
    """
    listed = watch.select("counterparty").distinct().withColumn("_listed", F.lit(True))
    joined = txns.join(listed, "counterparty", "left")
    return joined.withColumn("flagged", (F.col("amount") > limit) | F.coalesce("_listed", F.lit(False))).drop("_listed")


def auto_clear_rate(flagged: DataFrame, by: list[str]) -> DataFrame:
    return flagged.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("flagged").alias("flagged")).withColumn(
        "auto_clear_rate", 1 - F.col("flagged") / F.col("total"))


def contract_risks(contracts: DataFrame, clauses: dict[str, str] = fv.REQUIRED_CLAUSES) -> DataFrame:
    """Contracts per clause that lacks its required word; ``contracts`` holds a map of clause texts."""
    risk = F.array_compact(F.array(*[
        F.when(~F.coalesce(F.try_element_at("clauses", F.lit(c)), F.lit("")).contains(word), F.lit(c)) for c, word in clauses.items()]))
    return contracts.select("contract_id", F.explode(risk).alias("clause")).groupBy("clause").agg(F.count("*").alias("contracts"))
