"""Registered expiry, stock and transaction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyleaf.functions import dates as dt
from tallyleaf.operators import expiry as ops
from tallyleaf.plans.registry import query
from tallyleaf.sources import views as v



def asof():
    return F.lit(v.SHELF_ASOF).cast("date")


def shelf(spark, d):
    s = v.shelf(spark, d)
    s = s.withColumn("expiry_date", dt.add_shelf_life(F.col("production_date"), F.col("life"), F.lit("个月")))
    return ops.with_status(s, asof())


TEXT_DATE = """ld AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_shipdate AS dt,
    CASE l_orderkey % 8 WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 1 THEN strftime(l_shipdate, '%Y/%m/%d') WHEN 2 THEN strftime(l_shipdate, '%Y%m%d')
      WHEN 3 THEN year(l_shipdate) || '年' || month(l_shipdate) || '月' || day(l_shipdate) || '日' WHEN 4 THEN month(l_shipdate) || '/' || day(l_shipdate) || '/' || year(l_shipdate)
      WHEN 5 THEN '20251345' WHEN 6 THEN month(l_shipdate) || '/' || day(l_shipdate) || '/' || strftime(l_shipdate, '%y') ELSE 'soon' END AS text FROM lineitem)"""


def text_dates(spark, d):
    ts = F.col("l_shipdate").cast("timestamp")
    y, mo, da = F.year(ts).cast("string"), F.month(ts).cast("string"), F.day(ts).cast("string")
    k = F.col("l_orderkey") % 8
    text = (F.when(k == 0, F.date_format(ts, "yyyy-MM-dd")).when(k == 1, F.date_format(ts, "yyyy/MM/dd")).when(k == 2, F.date_format(ts, "yyyyMMdd"))
            .when(k == 3, F.concat(y, F.lit("年"), mo, F.lit("月"), da, F.lit("日"))).when(k == 4, F.concat(mo, F.lit("/"), da, F.lit("/"), y))
            .when(k == 5, "20251345").when(k == 6, F.concat(mo, F.lit("/"), da, F.lit("/"), F.date_format(ts, "yy"))).otherwise("soon"))
    return v.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), text.alias("text"), ts.alias("dt"))


@query("X05_date_layouts", "WITH " + TEXT_DATE + """, p AS (SELECT CASE WHEN regexp_matches(text, '^[0-9]{4}-') THEN 'dash' WHEN regexp_matches(text, '^[0-9]{4}/') THEN 'slash'
      WHEN regexp_matches(text, '^[0-9]{8}$') AND text <> '20251345' THEN 'compact' WHEN contains(text, '年') THEN 'cjk' WHEN regexp_matches(text, '/[0-9]{4}$') THEN 'us_long' WHEN regexp_matches(text, '/[0-9]{2}$') THEN 'us_short' ELSE 'none' END AS layout, CAST(dt AS DATE) AS dt FROM ld)
  SELECT layout, count(*) AS texts, CAST(sum(CASE WHEN layout <> 'none' THEN datediff('day', DATE '1970-01-01', dt) END) AS BIGINT) AS day_sum FROM p GROUP BY 1""")
def date_layouts(spark, d):
    rows = text_dates(spark, d).select(dt.layout_and_date(F.col("text")).alias("p"))
    return rows.groupBy(F.coalesce("p.layout", F.lit("none")).alias("layout")).agg(
        F.count("*").alias("texts"), F.sum(F.unix_date("p.date").cast("bigint")).alias("day_sum"))


@query("X06_expiry_dates", """SELECT item_id, strftime(expiry_date, '%Y-%m-%d') AS expiry FROM shelf_status""")
def expiry_dates(spark, d):
    s = v.shelf(spark, d)
    exp = dt.compute_expiry(F.col("production_date").cast("string"), F.concat(F.col("life").cast("string"), F.lit("个月")))
    return s.select("item_id", exp.cast("string").alias("expiry"))


@query("X07_expiry_status", "SELECT status, l_returnflag, count(*) AS items, CAST(sum(days_to_expiry) AS BIGINT) AS days FROM shelf_days GROUP BY 1, 2")
def expiry_status(spark, d):
    return shelf(spark, d).groupBy("status", "l_returnflag").agg(F.count("*").alias("items"), F.sum("days_to_expiry").alias("days"))


def found_sql(pattern: str) -> str:
    part = "regexp_extract(m, '(\\d{4})\\D?(\\d{1,2})\\D?(\\d{1,2})', %d)"
    day = f"TRY_CAST({part % 1} || '-' || lpad({part % 2}, 2, '0') || '-' || lpad({part % 3}, 2, '0') AS DATE)"
    return f"list_filter(list_transform(regexp_extract_all(text, '{pattern}'), lambda m: {day}), lambda x: x IS NOT NULL)"


WRITTEN = "\\d{4}[-/年]\\d{1,2}[-/月]\\d{1,2}"
FOUND = " || ".join(found_sql(p) for p in ("生产日期[:：]" + WRITTEN, "有效期至[:：]" + WRITTEN, WRITTEN, "\\d{8}"))


@query("X07_dates_in_texts", f"""WITH t AS (SELECT doc_id, text || CASE WHEN doc_id % 5 = 0 THEN '' ELSE ' 有效期至：' || strftime(DATE '1999-01-01' + CAST(doc_id % 900 AS INT), '%Y/%m/%d') END
      || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' 生产日期：' || strftime(DATE '1998-01-01' + CAST(doc_id % 400 AS INT), '%Y-%m-%d') END AS text FROM documents),
  f AS (SELECT doc_id, {FOUND} AS ds FROM t),
  e AS (SELECT doc_id, ds[1] AS a, list_filter(ds, lambda x: x <> ds[1])[1] AS b FROM f),
  r AS (SELECT doc_id, CASE WHEN b IS NOT NULL THEN a END AS production, coalesce(b, a) AS expiry FROM e)
  SELECT doc_id, CAST(production AS VARCHAR) AS production_date, CAST(expiry AS VARCHAR) AS expiry_date, CASE WHEN expiry IS NULL THEN 'unknown'
    WHEN expiry < DATE '{v.SHELF_ASOF}' THEN 'expired' WHEN expiry - DATE '{v.SHELF_ASOF}' <= 30 THEN 'near_expiry' ELSE 'valid' END AS status FROM r""")
def dates_in_texts(spark, d):
    """Each document's whole text with dates written behind it; labelled dates come before others, production before expiry."""
    k = F.col("doc_id")

    def dated(start, days, form):
        return F.date_format(F.date_add(F.lit(start).cast("date"), (k % days).cast("int")), form)

    texts = v.table(spark, d, "documents").select("doc_id", F.concat(
        "text", F.when(k % 5 == 0, "").otherwise(F.concat(F.lit(" 有效期至："), dated("1999-01-01", 900, "yyyy/MM/dd"))),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(" 生产日期："), dated("1998-01-01", 400, "yyyy-MM-dd")))).alias("text"))
    out = ops.dates_in_texts(texts, asof())
    return out.select("doc_id", F.col("production_date").cast("string").alias("production_date"), F.col("expiry_date").cast("string").alias("expiry_date"), "status")


@query("X08_validate_expiry", f"""WITH x AS (SELECT l_orderkey AS k, CAST(l_shipdate AS DATE) AS p, CASE WHEN l_orderkey % 9 = 0 THEN NULL WHEN l_orderkey % 11 = 0 THEN CAST(l_shipdate AS DATE) - 5
      WHEN l_orderkey % 13 = 0 THEN CAST(l_shipdate AS DATE) + 4000 ELSE CAST(l_shipdate AS DATE) + CAST(l_quantity * 30 AS INT) END AS e FROM lineitem),
  r AS (SELECT CASE WHEN e IS NULL THEN 'expiry_unreadable' WHEN p > DATE '{v.SHELF_ASOF}' THEN 'production_in_future' WHEN e < p THEN 'reversed' WHEN e - p > 3650 THEN 'over_ten_years'
      WHEN e < DATE '{v.SHELF_ASOF}' THEN 'expired' WHEN e - DATE '{v.SHELF_ASOF}' <= 30 THEN 'near_expiry' ELSE 'ok' END AS reason FROM x)
  SELECT reason, reason IN ('ok', 'near_expiry') AS is_valid, count(*) AS items FROM r GROUP BY 1, 2""")
def validate_expiry(spark, d):
    k, p = F.col("l_orderkey"), F.to_date(F.col("l_shipdate").cast("timestamp"))
    e = (F.when(k % 9 == 0, F.lit("unknown")).when(k % 11 == 0, F.date_sub(p, 5).cast("string")).when(k % 13 == 0, F.date_add(p, 4000).cast("string"))
         .otherwise(F.date_add(p, (F.col("l_quantity") * 30).cast("int")).cast("string")))
    rows = v.table(spark, d, "lineitem").select(p.cast("string").alias("production"), e.alias("expiry"))
    return ops.validate_expiry(rows, asof()).groupBy("reason", "is_valid").agg(F.count("*").alias("items"))


BATCH = "b AS (SELECT CASE p_partkey % 5 WHEN 0 THEN 'N/A' WHEN 1 THEN 'B#' || p_partkey WHEN 2 THEN 'L20240' || (100 + p_partkey % 20) WHEN 3 THEN 'AB-' || p_brand ELSE 'LOT' || (p_partkey % 100 + 1000) END AS batch FROM part)"


@query("X09_batch_check", "WITH " + BATCH + """ SELECT CASE WHEN batch = 'N/A' THEN 'empty' WHEN NOT regexp_matches(batch, '^[A-Za-z0-9\\-\\.]{4,20}$') THEN 'format'
    WHEN try_strptime(nullif(regexp_extract(batch, '[0-9]{8}'), ''), '%Y%m%d') IS NOT NULL OR try_strptime(nullif(regexp_extract(batch, '[0-9]{6}'), ''), '%y%m%d') IS NOT NULL THEN 'dated' ELSE 'valid' END AS outcome, count(*) AS parts FROM b GROUP BY 1""")
def batch_check(spark, d):
    k = F.col("p_partkey")
    batch = (F.when(k % 5 == 0, "N/A").when(k % 5 == 1, F.concat(F.lit("B#"), k.cast("string"))).when(k % 5 == 2, F.concat(F.lit("L20240"), (100 + k % 20).cast("string")))
             .when(k % 5 == 3, F.concat(F.lit("AB-"), "p_brand")).otherwise(F.concat(F.lit("LOT"), (k % 100 + 1000).cast("string"))))
    return v.table(spark, d, "part").groupBy(dt.batch_check(batch).alias("outcome")).agg(F.count("*").alias("parts"))


@query("X10_barcode_check", """WITH c AS (SELECT CAST(4000000000000 + o_orderkey * 7919 % 900000000000 AS VARCHAR) AS code, o_orderkey FROM orders),
  d AS (SELECT CASE WHEN o_orderkey % 6 = 0 THEN substr(code, 1, 7) ELSE code END AS code FROM c),
  s AS (SELECT code, list_sum(list_transform(range(1, 14), lambda i: CAST(substr(code, 14 - i, 1) AS INT) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) AS t FROM d WHERE length(code) = 13)
  SELECT CASE WHEN t % 10 = 0 THEN 'valid' ELSE 'bad_check_digit' END AS outcome, count(*) AS codes FROM s GROUP BY 1 UNION ALL SELECT 'bad_length', count(*) FROM d WHERE length(code) = 7""")
def barcode_check(spark, d):
    code = (F.lit(4000000000000) + F.col("o_orderkey") * 7919 % 900000000000).cast("string")
    rows = v.table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 6 == 0, F.substring(code, 1, 7)).otherwise(code).alias("code"))
    return rows.groupBy(dt.barcode_check(F.col("code")).alias("outcome")).agg(F.count("*").alias("codes"))


@query("A17_expiry_alerts", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY item_id) AS rn FROM shelf_days WHERE status <> 'valid'),
  n AS (SELECT status, count(*) AS count FROM r GROUP BY 1)
  SELECT r.status, CASE WHEN r.status = 'expired' THEN 'critical' ELSE 'warning' END AS level, count, item_id, abs(days_to_expiry) AS days FROM r JOIN n ON r.status = n.status WHERE rn <= 10""")
def expiry_alerts(spark, d):
    return ops.expiry_alerts(shelf(spark, d)).select("status", "level", "count", F.inline("items"))


STOCK = "stock AS (SELECT p_partkey, count(l_partkey) AS total_items FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1)"


def stock(spark, d):
    items = v.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return v.table(spark, d, "part").select("p_partkey").join(items, "p_partkey", "left").select(
        "p_partkey", F.coalesce("n", F.lit(0)).alias("total_items"))


@query("A18_stock_alerts", "WITH " + STOCK + """ SELECT p_partkey, total_items, 'warning' AS level, 'low_stock' AS alert FROM stock WHERE total_items > 0 AND total_items < 25 UNION ALL
    SELECT p_partkey, total_items, 'critical', 'out_of_stock' FROM stock WHERE total_items = 0 UNION ALL SELECT p_partkey, total_items, 'info', 'overstock' FROM stock WHERE total_items > 40""")
def stock_alerts(spark, d):
    return ops.stock_alerts(stock(spark, d), 25, 40)


@query("A19_compliance_alerts", """WITH s AS (SELECT l_returnflag, count(*) AS total, count(*) FILTER (status = 'expired') AS expired FROM shelf_days GROUP BY 1)
  SELECT l_returnflag, total, expired, ROUND(expired::DOUBLE / total, 6) AS expired_rate, CASE WHEN expired::DOUBLE / total > 0.1 THEN 'critical' ELSE 'warning' END AS level FROM s WHERE expired::DOUBLE / total > 0.05""")
def compliance_alerts(spark, d):
    return ops.compliance_alerts(shelf(spark, d), ["l_returnflag"]).withColumn("expired_rate", F.round("expired_rate", 6))


@query("A19_alert_summary", "WITH " + STOCK + """, a AS (SELECT 'expiry' AS type, CASE status WHEN 'expired' THEN 'critical' ELSE 'warning' END AS level FROM (SELECT DISTINCT status FROM shelf_days WHERE status <> 'valid') UNION ALL
    SELECT 'inventory', CASE WHEN total_items = 0 THEN 'critical' WHEN total_items < 25 THEN 'warning' ELSE 'info' END FROM stock WHERE total_items < 25 OR total_items > 40)
  SELECT coalesce(type, 'all') AS type, coalesce(level, 'all') AS level, count(*) AS alerts FROM a GROUP BY ROLLUP (type, level)""")
def alert_summary(spark, d):
    a = ops.expiry_alerts(shelf(spark, d)).select("type", "level").unionByName(
        ops.stock_alerts(stock(spark, d), 25, 40).select(F.lit("inventory").alias("type"), "level"))
    return ops.alert_summary(a).select(F.coalesce("type", F.lit("all")).alias("type"), F.coalesce("level", F.lit("all")).alias("level"), "alerts")


LEDGER = """SELECT 'item' AS row_kind, CAST(item_id AS VARCHAR) AS name, strftime(production_date, '%Y-%m-%d') AS production, strftime(expiry_date, '%Y-%m-%d') AS expiry, status, days_to_expiry AS number FROM shelf_days
    UNION ALL SELECT 'alert', status, '', '', CASE status WHEN 'expired' THEN 'critical' ELSE 'warning' END, count(*) FROM shelf_days WHERE status <> 'valid' GROUP BY status"""


@query("A20_expiry_ledger", LEDGER)
def expiry_ledger(spark, d):
    s = shelf(spark, d)
    return ops.expiry_ledger(s, ops.expiry_alerts(s))


@query("E03_ledger_union", f"SELECT row_kind, status, count(*) AS rows, CAST(sum(number) AS BIGINT) AS total FROM ({LEDGER}) GROUP BY 1, 2")
def ledger_union(spark, d):
    return expiry_ledger(spark, d).groupBy("row_kind", "status").agg(F.count("*").alias("rows"), F.sum("number").alias("total"))


@query("A20_compliance_ledger", """WITH t AS (SELECT count(*) AS n, count(*) FILTER (status = 'expired') AS ex, count(*) FILTER (status = 'valid') AS va, count(*) FILTER (status = 'near_expiry') AS ne FROM shelf_days)
  SELECT 'total' AS name, n::DOUBLE AS number, 'counted' AS state FROM t UNION ALL SELECT 'expired', ex, CASE WHEN ex > 0 THEN 'act' ELSE 'normal' END FROM t UNION ALL SELECT 'valid', va, 'normal' FROM t
  UNION ALL SELECT 'near_expiry', ne, CASE WHEN ne > 0 THEN 'watch' ELSE 'normal' END FROM t UNION ALL SELECT 'expired_rate', ROUND(ex::DOUBLE / n, 6), CASE WHEN ex::DOUBLE / n > 0.1 THEN 'critical' WHEN ex::DOUBLE / n > 0.05 THEN 'warning' ELSE 'normal' END FROM t""")
def compliance_ledger(spark, d):
    return ops.compliance_ledger(shelf(spark, d))


@query("A20_inventory_ledger", "WITH " + STOCK + """, c AS (SELECT p_type, sum(total_items) AS n FROM stock JOIN part USING (p_partkey) GROUP BY 1)
  SELECT 'total' AS row_kind, 'items' AS name, CAST(sum(n) AS BIGINT) AS number FROM c UNION ALL SELECT 'total', 'categories', count(*) FROM c UNION ALL SELECT 'category', p_type, CAST(n AS BIGINT) FROM c
  UNION ALL SELECT 'alert', CASE WHEN total_items = 0 THEN 'out_of_stock' WHEN total_items < 25 THEN 'low_stock' ELSE 'overstock' END, count(*) FROM stock WHERE total_items < 25 OR total_items > 40 GROUP BY 2""")
def inventory_ledger(spark, d):
    s = stock(spark, d)
    typed = s.join(v.table(spark, d, "part").select("p_partkey", "p_type"), "p_partkey")
    return ops.inventory_ledger(typed, "p_type", ops.stock_alerts(s, 25, 40))


@query("A21_category_breakdown", "SELECT coalesce(p_type, 'all') AS category, count(*) AS items FROM part GROUP BY ROLLUP (p_type)")
def category_breakdown(spark, d):
    return ops.category_breakdown(v.table(spark, d, "part"), "p_type").select(F.coalesce("p_type", F.lit("all")).alias("category"), "items")


@query("P09_flag_transactions", """SELECT status, count(*) AS total, count(*) FILTER (f) AS flagged, ROUND(1 - count(*) FILTER (f) / count(*)::DOUBLE, 6) AS auto_clear_rate
    FROM (SELECT status, amount > 400000 OR counterparty IN (SELECT counterparty FROM watch) AS f FROM txn) GROUP BY 1""")
def flag_transactions(spark, d):
    out = ops.auto_clear_rate(ops.flag_transactions(*v.transactions(spark, d), 400000), ["status"])
    return out.withColumn("auto_clear_rate", F.round("auto_clear_rate", 6))


@query("P10_contract_risks", "SELECT '争议解决' AS clause, count(*) AS contracts FROM documents WHERE doc_id % 3 <> 0")
def contract_risks(spark, d):
    docs = v.table(spark, d, "documents").select(F.col("doc_id").alias("contract_id"), F.create_map(
        F.lit("争议解决"), F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" 管辖法院"))).otherwise(F.col("text"))).alias("clauses"))
    return ops.contract_risks(docs)
