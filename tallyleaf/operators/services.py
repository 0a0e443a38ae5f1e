"""Jobs around the service: experiments, lineage, webhooks, configuration, roles, batches, tenant copies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyleaf import fixed_values as fv
from tallyleaf.operators.scale import literal_table, salted_join
from tallyleaf.session import cut_lineage, scratch_path

# --- experiments --------------------------------------------------------------------------------------------


def hash_bucket(text: Column) -> Column:
    """int(md5(text), 16) % 100 from four 32-bit parts (16**8 leaves 96 modulo 100)."""
    h = F.md5(text)
    parts = [F.conv(F.substring(h, i, 8), 16, 10).cast("bigint") for i in (1, 9, 17, 25)]
    acc = parts[0] % 100
    for p in parts[1:]:
        acc = (acc * 96 + p) % 100
    return acc


def assign_variant(experiment: str, user: Column, variants: list[tuple[str, int]]) -> Column:
    """Variant by hash bucket; bounds use whole percents and the last variant takes the remainder."""
    bucket = hash_bucket(F.concat(F.lit(f"{experiment}:"), user.cast("string")))
    total = sum(w for _, w in variants)
    bound, chain = 0, None
    for name, weight in variants[:-1]:
        bound += weight * 100 // total
        chain = F.when(bucket < bound, name) if chain is None else chain.when(bucket < bound, name)
    return F.lit(variants[-1][0]) if chain is None else chain.otherwise(variants[-1][0])


def in_canary(canary: str, user: Column, percentage: int) -> Column:
    return hash_bucket(F.concat(F.lit(f"{canary}:"), user.cast("string"))) < percentage


def normal_tail(z: Column) -> Column:
    """Two-sided p value by a five-term polynomial for erf (absolute error below 1.5e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def experiment_report(results: DataFrame, control: str, min_samples: int = 30) -> DataFrame:
    """Control against the best other variant: pooled z, p value, significance at 1.96, winner.

    ``results`` is reduced to one row per variant before anything is compared.
    """
    per = results.groupBy("variant").agg(F.count("*").alias("total"), F.count_if("success").alias("ok"))
    per = per.withColumn("rate", F.col("ok") / F.col("total"))
    row = F.struct("variant", "total", "ok", "rate")
    both = per.agg(
        F.max(F.when(F.col("variant") == control, row)).alias("c"),
        F.max_by(F.when(F.col("variant") != control, row), F.when(F.col("variant") != control, F.struct("rate", "variant"))).alias("b"))
    pool = (F.col("c.ok") + F.col("b.ok")) / (F.col("c.total") + F.col("b.total"))
    se = F.sqrt(pool * (1 - pool) * (1 / F.col("c.total") + 1 / F.col("b.total")))
    z = F.when(se > 0, (F.col("b.rate") - F.col("c.rate")) / se).otherwise(0.0)
    tested = both.where((F.col("c.total") >= min_samples) & F.col("b").isNotNull()).withColumn("z_score", z)
    return tested.select(
        F.col("c.variant").alias("control"), F.col("b.variant").alias("best"), F.col("c.rate").alias("control_rate"), F.col("b.rate").alias("best_rate"),
        "z_score", normal_tail(F.col("z_score")).alias("p_value"), (F.abs("z_score") > 1.96).alias("significant"),
        F.when(F.abs("z_score") > 1.96, F.col("b.variant")).alias("winner"))


def example_counts(examples: DataFrame) -> DataFrame:
    return examples.groupBy("scenario").agg(F.count("*").alias("examples"))


def select_examples(examples: DataFrame, k: int = 3, min_score: float = 0.0) -> DataFrame:
    """Best ``k`` examples per scenario by score, then uses, then id."""
    w = Window.partitionBy("scenario").orderBy(F.col("score").desc(), F.col("uses").desc(), "example_id")
    return examples.where(F.col("score") >= min_score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def keep_capacity(examples: DataFrame, capacity: int = 50) -> DataFrame:
    """The examples that stay when a scenario is full: highest score, newest first on a tie."""
    w = Window.partitionBy("scenario").orderBy(F.col("score").desc(), F.col("example_id").desc())
    return examples.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= capacity).drop("_rn")


# --- lineage ------------------------------------------------------------------------------------------------


def search_nodes(nodes: DataFrame, limit: int | None = None, **equal) -> DataFrame:
    """Nodes that match every given column value; an unknown column is an error."""
    unknown = set(equal) - set(nodes.columns)
    if unknown:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    hits = nodes
    for name, value in equal.items():
        hits = hits.where(F.col(name) == value)
    return hits if limit is None else hits.orderBy("node_id").limit(limit)


def lineage_totals(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("records"), F.countDistinct("tenant_id").alias("tenants"), F.countDistinct("run_id").alias("runs"))


def purge_tenant(nodes: DataFrame, runs: DataFrame, tenant) -> tuple[DataFrame, DataFrame]:
    """Lineage and run index without one tenant; the caller overwrites the tables with the result."""
    gone = nodes.where(F.col("tenant_id") == tenant).select("run_id").distinct()
    return nodes.where(F.col("tenant_id") != tenant), runs.join(gone, "run_id", "left_anti")


def roots_and_depth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Root and distance of every node in a forest (each node has at most one parent), by pointer doubling.

    Rounds grow with the logarithm of the depth. A row whose pointer stands on a root is done and is not joined again;
    each round is cut by a reliable checkpoint so that a lost executor does not replay the whole history. A cycle is an
    error: its rows are still open after as many doublings as a chain of all nodes would need. Runs jobs when called.
    """
    parents = edges.select(F.col("dst").alias("node_id"), F.col("src").alias("up"))
    state = cut_lineage(nodes.select("node_id").join(parents, "node_id", "left").select(
        "node_id", "up", F.when(F.col("up").isNotNull(), 1).otherwise(0).alias("d"), F.col("up").isNotNull().alias("open")))
    total, reach = state.count(), 1
    while not state.where("open").isEmpty():
        if reach > 2 * total:
            raise ValueError("the lineage has a cycle")
        above = state.select(F.col("node_id").alias("up"), F.col("up").alias("up2"), F.col("d").alias("d2"))
        moved = state.where("open").join(above, "up", "left").select(
            "node_id", F.coalesce("up2", "up").alias("up"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"), F.col("up2").isNotNull().alias("open"))
        state, reach = cut_lineage(moved.unionByName(state.where("NOT open"))), 2 * reach
    return state.select("node_id", F.coalesce("up", "node_id").alias("root"), F.col("d").alias("depth"))


def descendants(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Every node reachable from each source, with its distance, level by level until no new node appears.

    The result holds a row per (source, reachable node): with every node as a source that is the whole reachability
    relation. Each level is written once; the levels are put together at the end. Runs jobs when called.
    """
    levels = [cut_lineage(sources.select(F.col("node_id").alias("source"), "node_id", F.lit(0).alias("depth")).distinct())]
    while True:
        step = levels[-1].join(edges.select(F.col("src").alias("node_id"), "dst"), "node_id").select("source", F.col("dst").alias("node_id")).distinct()
        seen = reduce(DataFrame.unionByName, levels)
        level = cut_lineage(step.join(seen, ["source", "node_id"], "left_anti").withColumn("depth", F.lit(len(levels))))
        if level.isEmpty():
            return seen
        levels.append(level)


def graph(edges: DataFrame, outputs: DataFrame) -> tuple[DataFrame, int]:
    """``src, dst, hit``, each edge once and written, ``hit`` where it ends on an output; and a number of tasks that keeps to a million edges each."""
    spark = edges.sparkSession
    ends = outputs.select(F.col("node_id").alias("dst"), F.lit(True).alias("hit")).distinct()
    known = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")
    tasks = max(spark.sparkContext.defaultParallelism, known.count() // 1_000_000 + 1)
    once = known.repartition(tasks, "dst").join(ends, "dst", "left").select("src", "dst", F.col("hit").isNotNull().alias("hit")).distinct()
    path = scratch_path(spark, "edges")
    once.write.parquet(path)
    return spark.read.parquet(path), tasks


def met(level: DataFrame, edges: DataFrame, tasks: int) -> DataFrame:
    """A written level joined with edges on its last node ``src``; the edges stay where they are while the level is a short list."""
    if level.limit(10_001).count() <= 10_000:
        return edges.join(F.broadcast(level), "src")
    return edges.repartition(tasks, "src").join(level, "src")


def lineage_paths(edges: DataFrame, sources: DataFrame, outputs: DataFrame, max_depth: int) -> DataFrame:
    """``source, output, path, length``: every path from a source to an output over at most ``max_depth`` edges that visits no node twice.

    ``edges`` has ``src, dst``; nodes may have several parents, repeated edges count once. The graph is first walked backwards from the outputs: a path
    is carried on only over edges from whose end an output can still be reached in the edges left, so open paths that lead nowhere are never made. A hot
    node's paths are spread by Spark's skew handling, as the join key alone carries no order. The number of
    paths can grow with the power of the depth: ``path_counts`` says how many there are without listing them. Runs jobs when called.
    """
    edges, tasks = graph(edges, outputs)
    ending = edges.where("hit").select("src", "dst")
    onward, reached = [], cut_lineage(ending.select(F.col("src").alias("dst")).distinct())
    near = reached
    for ahead in range(1, max_depth):
        small = near.limit(10_001).count() <= 10_000
        step = cut_lineage(edges.join(F.broadcast(near) if small else near, "dst", "left_semi").select("src", "dst", F.lit(ahead).alias("ahead")))
        if step.isEmpty():
            break
        onward.append(step)
        near = cut_lineage(step.select(F.col("src").alias("dst")).distinct().join(reached, "dst", "left_anti"))
        reached = reached.unionByName(near)
    level = cut_lineage(sources.select(F.col("node_id").alias("source"), F.col("node_id").alias("src"), F.array("node_id").alias("path")).distinct())
    found = []

    def longer(edges: DataFrame) -> DataFrame:
        return met(level, edges, tasks).where(~F.array_contains("path", F.col("dst"))).select("source", "dst", F.concat("path", F.array("dst")).alias("path"))

    for length in range(1, max_depth + 1):
        found.append(longer(ending).select("source", F.col("dst").alias("output"), "path", F.lit(length).alias("length")))
        if length == max_depth or not onward:
            break
        level = cut_lineage(longer(reduce(DataFrame.unionByName, onward).where(F.col("ahead") <= max_depth - length)).withColumnRenamed("dst", "src"))
        if level.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def path_counts(edges: DataFrame, sources: DataFrame, outputs: DataFrame, max_depth: int) -> DataFrame:
    """``source, output, paths, shortest, longest`` over at most ``max_depth`` edges, without listing a path.

    Numbers of ways are summed per (source, node) and level, so a wide graph costs its pairs, not its paths. For graphs without cycles; one that
    still goes on after ``max_depth`` edges is an error, since ways and paths part there. Counts are decimals of 38 digits. Only nodes with edges of
    their own are kept as a level; the number of tasks follows the edges, so none holds more of them in a larger graph. Runs jobs when called.
    """
    edges, tasks = graph(edges, outputs)
    inner = edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
    level = cut_lineage(sources.select(F.col("node_id").alias("source"), F.col("node_id").alias("src"), F.lit(1).cast("decimal(38,0)").alias("ways")).distinct())
    ends = []
    for length in range(1, max_depth + 1):
        ends.append(met(level, edges.where("hit").select("src", "dst"), tasks).select("source", F.col("dst").alias("output"), "ways", F.lit(length).alias("length")))
        level = cut_lineage(met(level, inner, tasks).groupBy("source", "dst").agg(F.sum("ways").cast("decimal(38,0)").alias("ways")).select("source", F.col("dst").alias("src"), "ways"))
        if level.isEmpty():
            break
    else:
        raise ValueError(f"the lineage goes on after {max_depth} edges: a cycle, or a larger max_depth is needed")
    return reduce(DataFrame.unionByName, ends).repartition(tasks, "source", "output").groupBy("source", "output").agg(
        F.sum("ways").cast("decimal(38,0)").alias("paths"), F.min("length").alias("shortest"), F.max("length").alias("longest"))


# --- webhooks -----------------------------------------------------------------------------------------------


def fan_out(events: DataFrame, subscriptions: DataFrame, salts: int = 8) -> DataFrame:
    """Active subscriptions of the event's tenant that list its type.

    The list is exploded once so the match is an equi-join; a busy (tenant, type) is spread over salted tasks.
    """
    return salted_join(events, wanted_types(subscriptions), ["tenant_id", "event_type"], "event_id", salts)


def wanted_types(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.where("active").select("sub_id", "tenant_id", F.explode("events").alias("event_type")).distinct()


def fan_out_counts(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """``sub_id, event_type, deliveries``: how many rows ``fan_out`` gives each subscription and type, without making them.

    Events are counted per tenant and type before they meet the subscriptions, so the work grows with events plus subscriptions
    where the deliveries grow with their product.
    """
    counts = events.groupBy("tenant_id", "event_type").agg(F.count("*").alias("n"))
    return wanted_types(subscriptions).join(counts, ["tenant_id", "event_type"]).groupBy("sub_id", "event_type").agg(F.sum("n").alias("deliveries"))


def retry_timetable(deliveries: DataFrame) -> DataFrame:
    """Wait before each retry and the seconds since the first attempt."""
    n = F.col("retry")
    wait = F.least(F.lit(fv.RETRY_MAX), F.lit(fv.RETRY_BASE) * F.pow(F.lit(fv.RETRY_MULTIPLIER), n - 1))
    rows = deliveries.withColumn("retry", F.explode(F.sequence(F.lit(1), F.lit(fv.RETRY_ATTEMPTS - 1)))).withColumn("wait", wait)
    w = Window.partitionBy("delivery_id").orderBy("retry").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("instant", F.sum("wait").over(w))


def delivery_states(attempts: DataFrame, max_attempts: int = fv.RETRY_ATTEMPTS) -> DataFrame:
    """One terminal state per delivery, from combinable aggregates."""
    per = attempts.groupBy("delivery_id", "tenant_id").agg(
        F.max("attempt").alias("attempts"), F.bool_or("success").alias("delivered"), F.max("ts").alias("last_ts"),
        F.max_by("duration_ms", "attempt").alias("last_duration_ms"), F.avg("duration_ms").alias("mean_duration_ms"))
    state = F.when(F.col("delivered"), "success").when(F.col("attempts") >= max_attempts, "dead_lettered").otherwise("failed")
    return per.withColumn("status", state)


def dead_letters(states: DataFrame) -> DataFrame:
    return states.where(F.col("status") == "dead_lettered").select("delivery_id", "tenant_id", "attempts")


def delivery_statistics(states: DataFrame) -> DataFrame:
    return states.groupBy("tenant_id").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("success", "failed", "dead_lettered")],
        F.avg("last_duration_ms").alias("avg_duration_ms"), F.max("last_ts").alias("last_ts"))


# --- configuration and roles --------------------------------------------------------------------------------


def resolve_layers(layers: DataFrame) -> DataFrame:
    """Effective values: run-time over tenant over default, each layer reduced to its newest value first.

    Overrides come out per tenant and path. Every default comes out once with a null tenant, also where some tenants
    override it: it holds for all tenants without a row of their own, and there may be more of them than any layer names.
    """
    own = layers.where("level > 0").groupBy("tenant_id", "path").agg(F.max_by("value", F.struct("level", "version")).alias("value"))
    default = layers.where("level = 0").groupBy("path").agg(F.max_by("value", "version").alias("value"))
    nobody = F.lit(None).cast(layers.schema["tenant_id"].dataType).alias("tenant_id")
    return own.where("value IS NOT NULL").select("tenant_id", "path", "value", F.lit("override").alias("origin")).unionByName(
        default.select(nobody, "path", "value", F.lit("default").alias("origin")))


def localised_names(keys: DataFrame, names: DataFrame, locale: str, fallback: str = "en") -> DataFrame:
    """Name in the asked locale, else in the fallback locale, else the key itself."""
    asked = names.where(F.col("locale") == locale).select("key", F.col("name").alias("_asked"))
    common = names.where(F.col("locale") == fallback).select("key", F.col("name").alias("_common"))
    return keys.join(asked, "key", "left").join(common, "key", "left").select(
        *keys.columns, F.coalesce("_asked", "_common", "key").alias("name"))


def role_table(df: DataFrame) -> DataFrame:
    return literal_table(df.sparkSession, [(r, p) for r, p in fv.ROLE_TEMPLATES.items()], "role string; permissions array<string>")


def effective_permissions(user_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """Distinct (user, tenant, permission) over roles that are global or of that tenant."""
    scoped = user_roles.where(F.col("role_tenant_id").isNull() | (F.col("role_tenant_id") == F.col("tenant_id")))
    return scoped.select("user_id", "tenant_id", "role").distinct().join(roles, "role").select(
        "user_id", "tenant_id", F.explode("permissions").alias("permission")).distinct()


# --- batches and copies -------------------------------------------------------------------------------------


def batch_outcome(items: DataFrame) -> DataFrame:
    """Success and failure totals per batch, the first error and the joined text in item order."""
    failed = F.col("error").isNotNull()
    item = F.when(~failed, F.struct("item_no", "text"))
    texts = F.transform(F.array_sort(F.array_compact(F.collect_list(item))), lambda s: s["text"])
    return items.groupBy("batch_id").agg(
        F.count("*").alias("total"), F.count_if(~failed).alias("success"), F.count_if(failed).alias("failed"),
        F.min_by("error", F.when(failed, F.col("item_no"))).alias("first_error"), F.array_join(texts, "\n").alias("joined_text"))


def batch_progress(results: DataFrame) -> DataFrame:
    """Progress counters and derived status per batch task."""
    done = F.col("status").isin("success", "failed")
    per = results.groupBy("batch_task_id").agg(
        F.count("*").alias("total"), F.count_if(done).alias("processed"), F.count_if(F.col("status") == "success").alias("success"),
        F.count_if(F.col("status") == "failed").alias("failed"))
    status = (F.when(F.col("processed") == 0, "pending").when(F.col("processed") < F.col("total"), "running")
              .when(F.col("failed") == F.col("total"), "failed").when(F.col("failed") > 0, "partial").otherwise("completed"))
    return per.withColumn("status", status)


def restore_plan(backup: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """What a restore would do: rows it would add and rows it would skip because they exist."""
    present = current.select(key).distinct().withColumn("_here", F.lit(True))
    action = F.when(F.col("_here"), "skip").otherwise("add")
    return backup.join(present, key, "left").groupBy(action.alias("action")).agg(F.count("*").alias("rows"))


def write_tenant_copy(df: DataFrame, path: str) -> None:
    """Rows of every tenant under its own partition folder."""
    df.write.mode("overwrite").partitionBy("tenant_id").parquet(path)
