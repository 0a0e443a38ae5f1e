"""Domain tables derived from the parquet tables of a data folder.

Each function reads one table (column-pruned by what the caller selects) and renames it into the shape the jobs
expect. The same definitions exist as SQL in ``plans.oracle_views``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyleaf import fixed_values as fv

SHELF_ASOF = "2000-06-01"
USAGE_MODELS = list(fv.MODEL_PRICES)[:3] + ["unlisted-model"]
TIERS = ["free", "basic", "pro", "enterprise", "unknown"]
MODES = ["hybrid", "package", "by_token", "by_call"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(index, values: list[str]):
    """values[index] as an expression; the list is short and fixed."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
        F.regexp_extract("props", "[0-9]+", 0).cast("bigint").alias("k"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        (F.col("user_id") % 20).alias("tenant_id"),
        F.col("event_id").alias("request_id"),
        "ts",
        pick(F.col("user_id") % 4, USAGE_MODELS).alias("model"),
        (F.col("k") * 100).alias("input_tokens"),
        F.floor(F.col("value") * 10).cast("bigint").alias("output_tokens"),
        (F.col("event_type") != "error").alias("success"),
        F.col("event_type").alias("scenario"),
        F.col("value").alias("latency_ms"),
    )


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("tenant_id")
    return (
        table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("tenant_id")).distinct()
        .select(
            "tenant_id",
            F.concat(F.lit("tenant-"), t.cast("string")).alias("tenant_name"),
            pick(t % 5, TIERS).alias("tier"),
            F.when(t % 7 == 0, "suspended").otherwise("active").alias("status"),
            pick(F.floor(t / 5) % 4, MODES).alias("mode"),
            F.when(t % 3 == 0, F.lit(20)).otherwise(F.lit(0)).cast("decimal(12,2)").alias("discount"),
        )
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select(
        F.col("event_id").alias("request_id"), "ts", (F.col("user_id") % 20).alias("tenant_id"),
        F.concat(F.lit("/"), F.col("event_type")).alias("endpoint"),
        F.col("value").alias("duration_ms"),
        F.when(F.col("event_type") == "error", F.lit(500) + F.col("k") % 4).otherwise(F.lit(200))
        .cast("int").alias("status_code"),
    )


AUDIT_ACTIONS = {"click": "data.read", "view": "api.success", "purchase": "billing.deduct", "signup": "apikey.create",
                 "error": "api.fail"}


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_of(events(spark, sf_dir))


def audit_of(e: DataFrame) -> DataFrame:
    """Audit entries of a table or stream of events."""
    action = F.when(F.col("k") % 10 == 0, F.lit("data.export"))
    for event_type, name in AUDIT_ACTIONS.items():
        action = action.when(F.col("event_type") == event_type, F.lit(name))
    return e.select(
        F.col("event_id").alias("audit_id"), "ts", (F.col("user_id") % 20).alias("tenant_id"), "user_id",
        action.alias("action"),
        F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("status"),
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per text line of a document, with a derived box."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    pos, doc = F.col("pos"), F.col("doc_id")
    x1 = (pos % 3) * 200 + doc % 7
    y1 = F.floor(pos / 3).cast("bigint") * 30 + (pos * 7) % 11
    return d.select(
        "doc_id", F.col("pos").cast("bigint").alias("region_id"), "text",
        x1.cast("bigint").alias("x1"), y1.cast("bigint").alias("y1"),
        (x1 + 20 + F.length("text") % 230).cast("bigint").alias("x2"),
        (y1 + 18 + pos % 25).cast("bigint").alias("y2"),
        (((doc * 31 + pos * 17) % 100) / 100.0).alias("confidence"),
    )


def channels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two recognition channels in long form (doc_id, field, value, conf) derived from the part table."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    long = p.select(key.alias("doc_id"), F.col("p_type").alias("category"), F.expr(
        "stack(4, 'brand', p_brand, 0, 'product_name', p_name, 1, 'specification', concat(cast(p_size AS string), 'ml'), 2, "
        "'package_type', p_type, 3) AS (field, value, i)"))
    salt = F.col("doc_id") + F.col("i")
    ocr = long.where(salt % 7 != 0).select(
        "doc_id", "category", "field", "value",
        F.when(F.col("doc_id") % 11 == 0, F.lit(None).cast("double"))
        .otherwise(F.lit(50) + F.col("doc_id") % 50).alias("conf"))
    changed = (
        F.when(salt % 6 == 0, F.upper("value"))
        .when(salt % 6 == 3, F.reverse("value"))
        .when(salt % 9 == 1, F.concat(F.col("value"), F.lit(" pack of twelve")))
        .when(salt % 9 == 4, F.lit("Zq"))
        .otherwise(F.col("value"))
    )
    vl = long.where(salt % 5 != 0).select(
        "doc_id", "category", "field", changed.alias("value"),
        F.when(F.col("doc_id") % 13 == 0, F.lit(None).cast("double"))
        .otherwise(F.lit(50) + F.col("doc_id") % 40).alias("conf"))
    scale = (F.col("conf") / 100.0).alias("conf")
    cols = ["doc_id", "category", "field", "value", scale]
    return ocr.select(*cols), vl.select(*cols)


def shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"), "l_partkey", "l_returnflag",
        "l_linestatus",
        F.to_date(F.col("l_shipdate").cast("timestamp")).alias("production_date"),
        F.col("l_quantity").cast("int").alias("life"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("txn_id"), F.col("o_custkey").alias("counterparty"),
        F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status"))
    watch = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("counterparty"))
    return o, watch


def lineage(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of chains: each conversation turn points at the next one."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    nodes = c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("node_id"), F.col("conv_id").alias("run_id"),
        (F.col("conv_id") % 20).alias("tenant_id"), F.col("role").alias("node_type"), "turn")
    edges = nodes.select(F.col("node_id").alias("src"), (F.col("node_id") + 1).alias("dst"), "run_id")
    edges = edges.join(nodes.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    return nodes, edges.select("src", "dst", "run_id")


def webhooks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, subscriptions, attempts)."""
    e = events(spark, sf_dir)
    wh = e.select("event_id", "ts", (F.col("user_id") % 20).alias("tenant_id"), "event_type")
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    types = (
        F.when(key % 3 == 0, F.array(F.lit("click"), F.lit("purchase")))
        .when(key % 3 == 1, F.array(F.lit("error")))
        .otherwise(F.array(F.lit("view"), F.lit("signup"), F.lit("error")))
    )
    subs = s.select(key.alias("sub_id"), (key % 20).alias("tenant_id"), types.alias("events"),
                    (F.col("s_acctbal") >= 0).alias("active"))
    attempts = e.select(
        F.floor(F.col("event_id") / 6).alias("delivery_id"), (F.col("event_id") % 6 + 1).alias("attempt"),
        (F.floor(F.col("event_id") / 6) % 20).alias("tenant_id"), "ts",
        (F.col("k") % 4 == 0).alias("success"), F.col("value").alias("duration_ms"))
    return wh, subs, attempts
