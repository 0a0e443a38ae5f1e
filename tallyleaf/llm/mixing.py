"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, gone through up to ``MAX_PASSES`` times. A document's
virtual start and finish are its source's words before and after it, divided by the source's target: all queues then
progress alike, and the budget of all words is spent at virtual time 1, where the line is cut. The document that each
queue is serving at that moment is cut there, so every source gets its target to the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyleaf.operators.scale import running_totals

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """``source, source_size, weight, target`` from ``source, source_size`` (one row per source).

    Sources by code point, null last, get ``weights`` in turn and share the sum of all sizes. Where a share exceeds
    ``max_passes`` times the source, it stops there and the rest is shared again: in the order of size per weight, a
    source is capped exactly if its cap lies under its share of what the sources before it left. All in integers
    but for the last division. The windows order one row per source.
    """
    turn = Window.orderBy(F.col("source").isNull(), "source")
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", pick.cast("bigint")).withColumn("cap", F.col("source_size") * max_passes)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    seen = (
        ranked.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("shares", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("capped", F.col("cap") * F.col("shares") <= F.col("left") * F.col("weight"))
    )
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    share = (rest * F.col("weight")).cast("double") / open_weight
    return seen.select("source", "source_size", "weight", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """The rows of ``docs`` as struct ``_row`` with ``_size, _source_size, _target, _taken`` and virtual finish ``_finish``.

    Needs ``doc_id, text, source``; other columns stay in ``_row`` whatever their names. ``taken`` counts the words taken, repeats counted, at most
    ``max_passes`` times the size. The shuffle is an MD5 order of ``seed`` and ``doc_id`` (null as ``null``), ties by
    size and text, so reruns agree; fully equal rows are interchangeable. Null and empty texts have size 0 and
    take nothing. An empty table gives no rows. A source is never ordered in one task: its documents fall into buckets of
    the order key, small bucket totals are summed over the source and handed back.
    """
    return _queued(_rows(docs, seed), weights, max_passes)


def _rows(docs: DataFrame, seed: str) -> DataFrame:
    return docs.select(
        F.struct("*").alias("_row"), F.col("source").alias("_source"), word_count(F.col("text")).alias("_size"), F.xxhash64("text").alias("_tie"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("_order"))


def _queued(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    targets = source_targets(rows.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size")), weights, max_passes)
    totals = targets.select(F.struct("source").alias("_at"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    bucket = F.substring("_order", 1, BUCKET_DIGITS)
    queued = running_totals(rows, ["_source"], bucket, ["_order", "_size", "_tie"], {"_after": F.col("_size")})
    queued = queued.withColumn("_at", F.struct(F.col("_source").alias("source"))).join(totals, "_at")
    # Words served of pass p up to this document: p * source_size + _after - size .. p * source_size + _after.
    budget = F.floor("_target").cast("bigint")
    taken, finish = F.lit(0).cast("bigint"), F.lit(None).cast("double")
    for p in range(max_passes):
        start = F.col("_source_size") * p + F.col("_after") - F.col("_size")
        part = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("_size"), budget - start))
        taken = taken + part
        finish = F.when(part > 0, (start + part) / F.col("_target")).otherwise(finish)
    return queued.select("_row", "_size", "_source_size", "_target", taken.alias("_taken"), finish.alias("_finish"))


def mixed_sizes(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document; the texts are not shuffled."""
    rows = _rows(docs, seed).withColumn("_row", F.col("_row.doc_id"))
    return _queued(rows).select(F.col("_row").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                                F.col("_target").alias("target"), F.col("_taken").alias("taken"))


def mixed_documents(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself: a row of ``docs`` for each pass begun, by virtual finish; a pass that the budget ends keeps its first words.

    The rows are range-sorted over the cluster by virtual finish, so a reader of the first part of the files sees every
    source in proportion.
    """
    out = mix(docs, seed)
    passes = F.ceil(F.col("_taken") / F.col("_size")).cast("int")
    rows = out.where("_taken > 0").withColumn("_pass", F.explode(F.sequence(F.lit(1), passes)))
    left = F.least(F.col("_size"), F.col("_taken") - F.col("_size") * (F.col("_pass") - 1)).cast("int")
    finish = F.col("_finish") - (passes - F.col("_pass")) * F.col("_source_size") / F.col("_target")
    text = F.col("_row.text")
    words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.when(left == F.col("_size"), text).otherwise(F.array_join(F.slice(words, F.lit(1), left), ""))
    return rows.select(F.col("_row").withField("text", cut).alias("_row"), finish.alias("_at")).orderBy("_at", "_row.doc_id").select("_row.*")
