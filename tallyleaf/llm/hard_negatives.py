"""Hard negatives by the threshold algorithm over per-dimension sorted lists.

Candidates are dealt into shards. A shard keeps for each dimension its rows sorted by component. An anchor goes down all lists
in step, from the large end where its own component is positive and from the small end where it is negative; rows met are looked up
whole and scored in integers. What the lists stand at bounds every row not yet met: the sum of the anchor's components
times the last values is the threshold. A search ends once the threshold lies strictly below the k-th best score of every window it
fills (below the window's lower edge where fewer are found), so ties by identifier are whole. Shards answer with their own
first rows of each window, of which the first are taken: no cap, and the same result for any dealing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyleaf.llm.manifest import written
from tallyleaf.operators.scale import newest_per_key

SHARD_ROWS, ANCHOR_ROWS = 8192, 2048
FIRST_DEPTH, DEEPER = 16, 2
LABELS = 10


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


class SortedLists:
    """The rows of one shard, sorted along every dimension."""

    def __init__(self, vectors: np.ndarray, reach: int):
        """``reach`` is the largest absolute component of any anchor that will ask."""
        self.count, width = vectors.shape
        order = np.argsort(vectors, axis=0, kind="stable")
        self.values = np.ascontiguousarray(np.take_along_axis(vectors, order, axis=0).T)
        self.order = np.ascontiguousarray(order.T.astype(np.int32))
        largest = width * (int(np.abs(vectors).max(initial=0)) + 1) * (reach + 1)
        # Sums of products this small are whole numbers in the type, so the fast product is exact.
        self.kind = np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64 if largest < 1 << 63 else object
        self.vectors = vectors.astype(self.kind)

    def product(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        return rows @ anchor if self.kind is object else (rows @ anchor).astype(np.int64)

    def rounds(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
        """Rows newly met, their scores and the threshold for those not met; no threshold once all are."""
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        own, depth, step = anchor.astype(self.kind), 0, FIRST_DEPTH
        if not len(up) and not len(down):  # every score is zero and no list orders anything
            yield np.arange(self.count), np.zeros(self.count, np.int64), None
            return
        seen = np.zeros(self.count, dtype=bool)
        while depth < self.count:
            to = min(self.count, depth + step)
            met = np.zeros(self.count, dtype=bool)
            met[self.order[up, self.count - to: self.count - depth]] = True
            met[self.order[down, depth:to]] = True
            fresh = np.flatnonzero(met & ~seen)
            seen |= met
            depth, step = to, step * DEEPER
            bound = sum(int(a) * int(v) for a, v in zip(anchor[up], self.values[up, self.count - to])) + sum(int(a) * int(v) for a, v in zip(anchor[down], self.values[down, to - 1]))
            done = bool(seen.all())
            yield fresh, self.product(self.vectors[fresh], own), None if done else bound
            if done:
                return

    def first(self, anchor: np.ndarray, ids: np.ndarray, allowed: np.ndarray, windows: list[tuple[int | None, int | None]], k: int) -> list[list[tuple[int, int]]]:
        """For each window of scores (lowest, highest; None is open) the first ``k`` allowed rows as (score, row), best first, ties by id."""
        live = [(lo, hi) for lo, hi in windows if lo is None or hi is None or lo <= hi]
        if not live:
            return [[] for _ in windows]
        floor = None if any(lo is None for lo, _ in live) else min(lo for lo, _ in live)
        ceiling = None if any(hi is None for _, hi in live) else max(hi for _, hi in live)
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for fresh, found, bound in self.rounds(anchor):
            good = allowed[fresh]
            if floor is not None:
                good &= found >= floor
            if ceiling is not None:
                good &= found <= ceiling
            rows, scores = np.concatenate([rows, fresh[good]]), np.concatenate([scores, found[good]])
            if bound is None or (all(hi is None or bound < hi for _, hi in live) and all(self._settled(scores, bound, lo, hi, k) for lo, hi in live)):
                break
        return [self._best(rows, scores, ids, lo, hi, k) if lo is None or hi is None or lo <= hi else [] for lo, hi in windows]

    @staticmethod
    def _settled(scores: np.ndarray, bound: int, lo: int | None, hi: int | None, k: int) -> bool:
        inside = scores if lo is None and hi is None else scores[(scores >= (lo if lo is not None else scores)) & (scores <= (hi if hi is not None else scores))]
        if len(inside) >= k:
            return bound < np.partition(inside, len(inside) - k)[len(inside) - k]
        return lo is not None and bound < lo

    @staticmethod
    def _best(rows, scores, ids, lo, hi, k) -> list[tuple[int, int]]:
        inside = np.ones(len(rows), dtype=bool)
        if lo is not None:
            inside &= scores >= lo
        if hi is not None:
            inside &= scores <= hi
        at = np.flatnonzero(inside)
        if len(at) > k:  # everything as good as the k-th, then by id
            at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
        at = at[np.lexsort((ids[rows[at]], -scores[at]))][:k]
        return [(int(scores[i]), int(rows[i])) for i in at]


def usable(vector: Column) -> Column:
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, vector, width, row``: usable rows with the shifted labels and whole components."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")).cast("long")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), wide.alias("wide")).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("wide")))
    rows = rows.select("vec_id", "label", F.transform("wide", lambda x: F.floor(x * 256).cast("long")).alias("vector")).distinct()
    return rows.withColumn("width", F.size("vector")).withColumn("row", F.xxhash64("vec_id", "label", "vector"))


def dealt(rows: DataFrame, asked: DataFrame, keys: list[str], shard_rows: int, anchor_rows: int) -> tuple[DataFrame, DataFrame]:
    """Shards and blocks of anchors with the key ``at`` under which they meet: each shard with each block of the same ``keys``."""
    key = F.struct(*keys)
    shards = rows.groupBy(key.alias("key")).agg(F.ceil(F.count("*") / F.lit(shard_rows)).cast("int").alias("shards"))
    blocks = asked.groupBy(key.alias("key")).agg(F.ceil(F.count("*") / F.lit(anchor_rows)).cast("int").alias("blocks"))
    sized = shards.join(blocks, "key")
    shard, block = F.pmod("row", F.col("shards")).cast("int"), F.pmod(F.xxhash64("row", F.lit(1)), F.col("blocks")).cast("int")
    left = rows.withColumn("key", key).join(sized, "key").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("shard", shard)
    right = asked.withColumn("key", key).join(sized, "key").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumn("block", block)
    at = F.struct("key", "shard", "block").alias("at")
    return left.select(at, *rows.columns), right.select(at, *asked.columns).toDF("q_at", *[f"q_{c}" for c in asked.columns])


def met(shards: DataFrame, anchors: DataFrame, answer, schema: str) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if left.num_rows and right.num_rows:
            vectors, asked = matrix(left["vector"]), matrix(right["q_vector"])
            lists = SortedLists(vectors, int(np.abs(asked).max(initial=0)))
            ids, own = left["vec_id"].to_numpy(), left["row"].to_numpy()
            labels = left["label"].to_numpy()
            for i, anchor in enumerate(asked):
                rows += answer(lists, ids, own, labels, anchor, {c[2:]: right[c][i].as_py() for c in right.column_names if c not in ("q_at", "q_vector")})
        columns = list(zip(*rows)) if rows else [()] * len(names)
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})

    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    return shards.groupBy("at").cogroup(anchors.groupBy("q_at")).applyInArrow(run, schema)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, lowest: int = 50, highest: int = 95,
                   shard_rows: int = SHARD_ROWS, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``vec_id, embedding, label``; other columns are ignored. ``is_anchor`` names its columns (``vec_id``, ``label``). Each anchor's ``positives`` are its best rows of its own label; for each,
    the ``negatives`` best rows of another label whose score lies between ``lowest`` and ``highest`` hundredths of the positive's are returned.
    Scores are inner products of ``floor(256 * x)``; higher ones come first, ties by smaller ``vec_id``. Rows without ``vec_id`` or label, with a null
    vector or a null or non-finite component take no part. Fully equal rows count once; rows that share a ``vec_id`` otherwise are
    rows of their own, as anchors too. Vectors meet those of their own length only; a vector of zeros scores 0 with all. A
    positive whose score is negative has no window and gives no row, as do anchors without a positive and an empty table. Sums
    beyond 64 bits fail the job when they would be returned.

    Anchors meet the shards of their label for positives and all shards for negatives, in blocks: a shard is copied once per block of
    ``anchor_rows`` anchors, an anchor once per shard. A hot label is as many shards as its rows need.
    """
    rows = written(whole_vectors(vectors), "whole-vectors")
    asked = rows.where(is_anchor)

    def best_positives(lists, ids, own, labels, anchor, row):
        allowed = (own != row["row"]) | (ids != row["vec_id"])
        return [(row["row"], row["vec_id"], int(ids[i]), int(own[i]), score) for score, i in lists.first(anchor, ids, allowed, [(None, None)], positives)[0]]

    def best_negatives(lists, ids, own, labels, anchor, row):
        windows = [(-(-lowest * p["score"] // 100), highest * p["score"] // 100) for p in row["positives"]]
        found = lists.first(anchor, ids, labels != row["label"], windows, negatives)
        return [(row["row"], row["vec_id"], p["positive_id"], p["positive_row"], p["score"], int(ids[i]), score) for p, hits in zip(row["positives"], found) for score, i in hits]

    near = met(*dealt(rows, asked, ["width", "label"], shard_rows, anchor_rows), best_positives, "row long, anchor_id long, positive_id long, positive_row long, score long")
    near = newest_per_key(near, ["row", "anchor_id"], [F.desc("score"), "positive_id", "positive_row"], positives)
    paired = near.groupBy("row", F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_row", "score")).alias("positives"))
    paired = written(asked.join(paired, ["row", "vec_id"]), "anchors-with-positives")
    far = met(*dealt(rows, paired, ["width"], shard_rows, anchor_rows), best_negatives,
              "row long, anchor_id long, positive_id long, positive_row long, positive_score long, negative_id long, negative_score long")
    key = ["row", "anchor_id", "positive_row", "positive_id", "positive_score"]
    far = newest_per_key(far, key, [F.desc("negative_score"), "negative_id"], negatives)
    packed = far.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct((-F.col("negative_score")).alias("minus"), "negative_id"))).alias("found"))
    return packed.select("anchor_id", "positive_id", "positive_score", F.posexplode("found").alias("at", "n")).select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), "n.negative_id", "positive_score", (-F.col("n.minus")).alias("negative_score"))
