"""Registered service queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyleaf import fixed_values as fv
from tallyleaf.operators import services as ops
from tallyleaf.plans.oracle_views import sql_list
from tallyleaf.plans.registry import query
from tallyleaf.sources import views as v

VARIANTS = [("control", 50), ("short", 30), ("long", 20)]
BUCKET = "CAST(('0x' || md5('exp:' || user_id))::UHUGEINT % 100 AS BIGINT)"
VARIANT = f"CASE WHEN {BUCKET} < 50 THEN 'control' WHEN {BUCKET} < 80 THEN 'short' ELSE 'long' END"


@query("X16_bucket_balance", f"SELECT {VARIANT} AS variant, count(*) AS users, CAST(sum({BUCKET}) AS BIGINT) AS bucket_sum FROM (SELECT c_custkey AS user_id FROM customer) GROUP BY 1")
def bucket_balance(spark, d):
    users = v.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return users.groupBy(ops.assign_variant("exp", F.col("user_id"), VARIANTS).alias("variant")).agg(
        F.count("*").alias("users"), F.sum(ops.hash_bucket(F.concat(F.lit("exp:"), F.col("user_id").cast("string")))).alias("bucket_sum"))


@query("X16_canary", "SELECT count(*) FILTER (CAST(('0x' || md5('can:' || c_custkey))::UHUGEINT % 100 AS BIGINT) < 15) AS canary, count(*) AS users FROM customer")
def canary(spark, d):
    return v.table(spark, d, "customer").agg(F.count_if(ops.in_canary("can", F.col("c_custkey"), 15)).alias("canary"), F.count("*").alias("users"))


@query("A29_experiment_report", f"""WITH r AS (SELECT {VARIANT} AS variant, event_type = 'purchase' AS ok FROM events),
  p AS (SELECT variant, count(*) AS n, count(*) FILTER (ok) AS k, count(*) FILTER (ok)::DOUBLE / count(*) AS rate FROM r GROUP BY 1),
  x AS (SELECT c.n AS n1, c.k AS k1, c.rate AS p1, b.variant, b.n AS n2, b.k AS k2, b.rate AS p2 FROM p c, (SELECT * FROM p WHERE variant <> 'control' ORDER BY rate DESC, variant DESC LIMIT 1) b WHERE c.variant = 'control'),
  z AS (SELECT *, (p2 - p1) / sqrt((k1 + k2)::DOUBLE / (n1 + n2) * (1 - (k1 + k2)::DOUBLE / (n1 + n2)) * (1.0 / n1 + 1.0 / n2)) AS z FROM x)
  SELECT 'control' AS control, variant AS best, ROUND(p1, 6) AS control_rate, ROUND(p2, 6) AS best_rate, ROUND(z, 6) AS z_score, abs(z) > 1.96 AS significant FROM z""")
def experiment_report(spark, d):
    e = v.events(spark, d).select(ops.assign_variant("exp", F.col("user_id"), VARIANTS).alias("variant"), (F.col("event_type") == "purchase").alias("success"))
    out = ops.experiment_report(e, "control")
    return out.select("control", "best", *[F.round(c, 6).alias(c) for c in ("control_rate", "best_rate", "z_score")], "significant")


@query("A29_experiment_p_value", f"""WITH r AS (SELECT {VARIANT} AS variant, event_type = 'purchase' AS ok FROM events),
  p AS (SELECT variant, count(*) AS n, count(*) FILTER (ok) AS k, count(*) FILTER (ok)::DOUBLE / count(*) AS rate FROM r GROUP BY 1),
  x AS (SELECT c.n AS n1, c.k AS k1, c.rate AS p1, b.variant, b.n AS n2, b.k AS k2, b.rate AS p2 FROM p c, (SELECT * FROM p WHERE variant <> 'control' ORDER BY rate DESC, variant DESC LIMIT 1) b WHERE c.variant = 'control'),
  z AS (SELECT variant, abs((p2 - p1) / sqrt((k1 + k2)::DOUBLE / (n1 + n2) * (1 - (k1 + k2)::DOUBLE / (n1 + n2)) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2))) AS z FROM x),
  t AS (SELECT variant, z, 1.0::DOUBLE / (1.0::DOUBLE + 0.3275911::DOUBLE * z / sqrt(2.0::DOUBLE)) AS t FROM z)
  SELECT variant AS best, ROUND(t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE)))) * exp(-z * z / 2), 4) AS p_value,
    CASE WHEN z > 1.96 THEN variant END AS winner FROM t""")
def experiment_p_value(spark, d):
    e = v.events(spark, d).select(ops.assign_variant("exp", F.col("user_id"), VARIANTS).alias("variant"), (F.col("event_type") == "purchase").alias("success"))
    return ops.experiment_report(e, "control").select("best", F.round("p_value", 4).alias("p_value"), "winner")


EXAMPLES = "ex AS (SELECT doc_id AS example_id, lang AS scenario, (doc_id * 37 % 100) / 100.0::DOUBLE AS score, n_chars % 10 AS uses FROM documents)"


def examples(spark, d):
    return v.table(spark, d, "documents").select(F.col("doc_id").alias("example_id"), F.col("lang").alias("scenario"),
                                                 ((F.col("doc_id") * 37 % 100) / 100.0).alias("score"), (F.col("n_chars") % 10).alias("uses"))


@query("A30_example_counts", "WITH " + EXAMPLES + " SELECT scenario, count(*) AS examples FROM ex GROUP BY 1")
def example_counts(spark, d):
    return ops.example_counts(examples(spark, d))


@query("W10_select_examples", "WITH " + EXAMPLES + """ SELECT scenario, example_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY score DESC, uses DESC, example_id) AS rank FROM ex WHERE score >= 0.2) WHERE rank <= 3""")
def select_examples(spark, d):
    return ops.select_examples(examples(spark, d), 3, 0.2).select("scenario", "example_id", "rank")


@query("W10_keep_capacity", "WITH " + EXAMPLES + """ SELECT scenario, count(*) AS kept, min(score) AS lowest FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY score DESC, example_id DESC) AS rn FROM ex) WHERE rn <= 50 GROUP BY 1""")
def keep_capacity(spark, d):
    return ops.keep_capacity(examples(spark, d)).groupBy("scenario").agg(F.count("*").alias("kept"), F.min("score").alias("lowest"))


@query("P02_search_nodes", "SELECT node_id, run_id, turn FROM lnodes WHERE tenant_id = 3 AND node_type = 'user' ORDER BY node_id LIMIT 25")
def search_nodes(spark, d):
    return ops.search_nodes(v.lineage(spark, d)[0], 25, tenant_id=3, node_type="user").select("node_id", "run_id", "turn")


@query("A31_lineage_totals", "SELECT count(*) AS records, count(DISTINCT tenant_id) AS tenants, count(DISTINCT run_id) AS runs FROM lnodes")
def lineage_totals(spark, d):
    return ops.lineage_totals(v.lineage(spark, d)[0])


@query("S09_purge_tenant", """SELECT 'nodes' AS kind, count(*) AS rows FROM lnodes WHERE tenant_id <> 3 UNION ALL
    SELECT 'runs', count(DISTINCT run_id) FROM lnodes WHERE run_id NOT IN (SELECT run_id FROM lnodes WHERE tenant_id = 3)""")
def purge_tenant(spark, d):
    nodes = v.lineage(spark, d)[0]
    left, runs = ops.purge_tenant(nodes, nodes.select("run_id").distinct(), 3)
    return left.agg(F.count("*").alias("rows")).select(F.lit("nodes").alias("kind"), "rows").unionByName(
        runs.agg(F.count("*").alias("rows")).select(F.lit("runs").alias("kind"), "rows"))


WALK = """WITH RECURSIVE walk AS (SELECT node_id AS root, node_id, 0 AS depth FROM lnodes WHERE node_id NOT IN (SELECT dst FROM ledges)
    UNION ALL SELECT w.root, e.dst, w.depth + 1 FROM walk w JOIN ledges e ON e.src = w.node_id)"""


@query("J13_roots_and_depth", WALK + " SELECT node_id, root, depth FROM walk")
def roots_and_depth(spark, d):
    return ops.roots_and_depth(*v.lineage(spark, d))


@query("J13_descendants", """WITH RECURSIVE walk AS (SELECT node_id AS source, node_id, 0 AS depth FROM lnodes WHERE turn = 1
    UNION ALL SELECT w.source, e.dst, w.depth + 1 FROM walk w JOIN ledges e ON e.src = w.node_id) SELECT source, count(*) AS nodes, max(depth) AS depth FROM walk GROUP BY 1""")
def descendants(spark, d):
    nodes, edges = v.lineage(spark, d)
    return ops.descendants(edges, nodes.where("turn = 1")).groupBy("source").agg(F.count("*").alias("nodes"), F.max("depth").alias("depth"))


#: A graph with several parents: nations lead to customers and suppliers, both lead to orders; a few orders lead back to a nation.
MADE_FROM = """made(src, dst) AS (SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier
    UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION SELECT 's' || l_suppkey, 'o' || l_orderkey FROM lineitem)"""
BACK = "SELECT 'o' || o_orderkey, 'n' || c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 5000 = 0"


def made_from(spark, d):
    def edges(name, src, dst, *keys):
        return v.table(spark, d, name).select(F.concat(F.lit(src), keys[0]).alias("src"), F.concat(F.lit(dst), keys[1]).alias("dst"))

    there = edges("customer", "n", "c", "c_nationkey", "c_custkey").unionByName(edges("supplier", "n", "s", "s_nationkey", "s_suppkey")).unionByName(
        edges("orders", "c", "o", "o_custkey", "o_orderkey")).unionByName(edges("lineitem", "s", "o", "l_suppkey", "l_orderkey"))
    nations = v.table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"))
    return there, nations, v.table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("node_id"))


@query("J13_source_output_paths", f"""WITH RECURSIVE {MADE_FROM}, e AS (SELECT * FROM made UNION {BACK}),
  p AS (SELECT 'n' || n_nationkey AS source, 'n' || n_nationkey AS node, ['n' || n_nationkey] AS path FROM nation UNION ALL
    SELECT p.source, e.dst, list_append(p.path, e.dst) FROM p JOIN e ON e.src = p.node WHERE NOT list_contains(p.path, e.dst) AND len(p.path) <= 4)
  SELECT source, node AS output, array_to_string(path, '>') AS path, CAST(len(path) - 1 AS INTEGER) AS length FROM p WHERE node LIKE 'o%'""")
def source_output_paths(spark, d):
    there, nations, orders = made_from(spark, d)
    customers = v.table(spark, d, "customer")
    back = v.table(spark, d, "orders").where("o_orderkey % 5000 = 0").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("o"), "o_orderkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"))
    return ops.lineage_paths(there.unionByName(back), nations, orders, 4).withColumn("path", F.array_join("path", ">"))


@query("J13_path_counts", f"""WITH RECURSIVE {MADE_FROM},
  p AS (SELECT 'n' || n_nationkey AS source, 'n' || n_nationkey AS node, 0 AS length FROM nation UNION ALL SELECT p.source, made.dst, p.length + 1 FROM p JOIN made ON made.src = p.node)
  SELECT source, node AS output, count(*) AS paths, min(length) AS shortest, max(length) AS longest FROM p WHERE node LIKE 'o%' GROUP BY 1, 2""")
def path_counts(spark, d):
    return ops.path_counts(*made_from(spark, d), 3).withColumn("paths", F.col("paths").cast("bigint"))


@query("J09_fan_out", """SELECT s.sub_id, e.event_type, count(*) AS deliveries FROM wh_events e JOIN (SELECT sub_id, tenant_id, unnest(events) AS event_type FROM wh_subs WHERE active) s
    ON e.tenant_id = s.tenant_id AND e.event_type = s.event_type GROUP BY 1, 2""")
def fan_out(spark, d):
    wh, subs, _ = v.webhooks(spark, d)
    return ops.fan_out_counts(wh, subs)


@query("W16_retry_timetable", """WITH del AS (SELECT DISTINCT delivery_id FROM wh_attempts), r AS (SELECT delivery_id, unnest(range(1, 6)) AS retry FROM del),
  w AS (SELECT *, least(600.0::DOUBLE, pow(5.0, retry - 1)) AS wait FROM r) SELECT delivery_id, retry, wait, sum(wait) OVER (PARTITION BY delivery_id ORDER BY retry) AS instant FROM w""")
def retry_timetable(spark, d):
    return ops.retry_timetable(v.webhooks(spark, d)[2].select("delivery_id").distinct())


STATES = """states AS (SELECT delivery_id, tenant_id, max(attempt) AS attempts, bool_or(success) AS delivered, max(ts) AS last_ts, arg_max(duration_ms, attempt) AS last_duration_ms FROM wh_attempts GROUP BY 1, 2),
  st AS (SELECT *, CASE WHEN delivered THEN 'success' WHEN attempts >= 6 THEN 'dead_lettered' ELSE 'failed' END AS status FROM states)"""


@query("W18_delivery_states", "WITH " + STATES + " SELECT delivery_id, attempts, status FROM st")
def delivery_states(spark, d):
    return ops.delivery_states(v.webhooks(spark, d)[2]).select("delivery_id", "attempts", "status")


@query("T06_dead_letters", "WITH " + STATES + " SELECT delivery_id, tenant_id, attempts FROM st WHERE status = 'dead_lettered'")
def dead_letters(spark, d):
    return ops.dead_letters(ops.delivery_states(v.webhooks(spark, d)[2]))


@query("A24_delivery_statistics", "WITH " + STATES + """ SELECT tenant_id, count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed,
    count(*) FILTER (status = 'dead_lettered') AS dead_lettered, ROUND(avg(last_duration_ms), 6) AS avg_duration_ms, epoch_us(max(last_ts)) AS last_us FROM st GROUP BY 1""")
def delivery_statistics(spark, d):
    out = ops.delivery_statistics(ops.delivery_states(v.webhooks(spark, d)[2]))
    return out.withColumn("avg_duration_ms", F.round("avg_duration_ms", 6)).withColumn("last_us", F.unix_micros("last_ts")).drop("last_ts")


@query("J10_resolve_layers", """WITH l AS (SELECT c_nationkey AS tenant_id, c_mktsegment || '.k' || (c_custkey % 40) AS path, c_custkey % 3 AS level, c_custkey AS version, c_acctbal AS value FROM customer),
  o AS (SELECT tenant_id, path, arg_max(value, (level, version)) AS own FROM l WHERE level > 0 GROUP BY 1, 2), f AS (SELECT path, arg_max(value, version) AS fallback FROM l WHERE level = 0 GROUP BY 1)
  SELECT tenant_id, path, own AS value, 'override' AS origin FROM o UNION ALL SELECT NULL, path, fallback, 'default' FROM f""")
def resolve_layers(spark, d):
    c = v.table(spark, d, "customer")
    layers = c.select(F.col("c_nationkey").alias("tenant_id"), F.concat("c_mktsegment", F.lit(".k"), (F.col("c_custkey") % 40).cast("string")).alias("path"),
                      (F.col("c_custkey") % 3).alias("level"), F.col("c_custkey").alias("version"), F.col("c_acctbal").alias("value"))
    return ops.resolve_layers(layers)


@query("J11_localised_names", """WITH n AS (SELECT DISTINCT ON (key, locale) key, locale, name FROM (SELECT p_name AS key, (['zh', 'en', 'de'])[p_partkey % 3 + 1] AS locale, p_name || '-' || (p_partkey % 3) AS name, p_partkey FROM part)),
  k AS (SELECT p_partkey, p_name AS key FROM part)
  SELECT k.p_partkey, coalesce(a.name, b.name, k.key) AS name FROM k LEFT JOIN n a ON k.key = a.key AND a.locale = 'zh' LEFT JOIN n b ON k.key = b.key AND b.locale = 'en'""")
def localised_names(spark, d):
    p = v.table(spark, d, "part")
    names = p.select(F.col("p_name").alias("key"), v.pick(F.col("p_partkey") % 3, ["zh", "en", "de"]).alias("locale"),
                                                F.concat("p_name", F.lit("-"), (F.col("p_partkey") % 3).cast("string")).alias("name")).distinct()
    return ops.localised_names(p.select("p_partkey", F.col("p_name").alias("key")), names, "zh").select("p_partkey", "name")


ROLES = list(fv.ROLE_TEMPLATES)
ROLE_ROWS = ", ".join(f"('{r}', {sql_list(p)})" for r, p in fv.ROLE_TEMPLATES.items())


@query("J15_permissions", f"""WITH ur AS (SELECT DISTINCT user_id, user_id % 20 AS tenant_id, ({sql_list(ROLES)})[k % 5 + 1] AS role FROM ev WHERE k % 3 = 0 OR k % 20 = user_id % 20)
  SELECT tenant_id, permission, count(DISTINCT user_id) AS users FROM (SELECT user_id, tenant_id, unnest(permissions) AS permission FROM ur JOIN (VALUES {ROLE_ROWS}) AS r(role, permissions) ON ur.role = r.role) GROUP BY 1, 2""")
def permissions(spark, d):
    e = v.events(spark, d)
    ur = e.select("user_id", (F.col("user_id") % 20).alias("tenant_id"), v.pick(F.col("k") % 5, ROLES).alias("role"),
                  F.when(F.col("k") % 3 != 0, F.col("k") % 20).alias("role_tenant_id"))
    return ops.effective_permissions(ur, ops.role_table(e)).groupBy("tenant_id", "permission").agg(F.count("*").alias("users"))


@query("S04_batch_outcome", """WITH i AS (SELECT doc_id // 50 AS batch_id, doc_id AS item_no, text, CASE WHEN n_chars < 200 THEN 'text too short: ' || n_chars END AS error FROM documents)
  SELECT batch_id, count(*) AS total, count(*) FILTER (error IS NULL) AS success, count(*) FILTER (error IS NOT NULL) AS failed, arg_min(error, item_no) FILTER (error IS NOT NULL) AS first_error,
    md5(coalesce(string_agg(text, chr(10) ORDER BY item_no) FILTER (error IS NULL), '')) AS text_md5 FROM i GROUP BY 1""")
def batch_outcome(spark, d):
    docs = v.table(spark, d, "documents").select(F.floor(F.col("doc_id") / 50).alias("batch_id"), F.col("doc_id").alias("item_no"), "text",
                                                 F.when(F.col("n_chars") < 200, F.concat(F.lit("text too short: "), F.col("n_chars").cast("string"))).alias("error"))
    return ops.batch_outcome(docs).withColumn("text_md5", F.md5("joined_text")).drop("joined_text")


@query("S05_batch_progress", """WITH r AS (SELECT o_custkey AS batch_task_id, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status FROM orders),
  p AS (SELECT batch_task_id, count(*) AS total, count(*) FILTER (status <> 'pending') AS processed, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed FROM r GROUP BY 1)
  SELECT *, CASE WHEN processed = 0 THEN 'pending' WHEN processed < total THEN 'running' WHEN failed = total THEN 'failed' WHEN failed > 0 THEN 'partial' ELSE 'completed' END AS status FROM p""")
def batch_progress(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed")
    return ops.batch_progress(v.table(spark, d, "orders").select(F.col("o_custkey").alias("batch_task_id"), status.alias("status")))


@query("S08_restore_plan", "SELECT CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'skip' ELSE 'add' END AS action, count(*) AS rows FROM documents GROUP BY 1")
def restore_plan(spark, d):
    return ops.restore_plan(v.table(spark, d, "documents").select("doc_id"), v.table(spark, d, "labels"), "doc_id")
