"""Approximate nearest neighbours by collision counting over single projections.

The vectors are dealt into shards by hash of ``vec_id``; a shard keeps, for each of ``PROJECTIONS`` random directions,
its vectors sorted by projected value. A query opens on every direction a window centred at its own projected value, of
half-width ``REACH`` times a radius; a vector that lies in at least ``threshold`` windows is verified by its true
distance. Virtual rehashing begins a little below a bound on the k-th distance, taken from the rows that collide most in narrow windows,
widens the windows radius by radius, counting only what they newly
cover, and ends when the k-th best verified distance is within the radius, at that bound at the latest: every vector that near would be in a window with
probability ``P1`` on each direction, so it has been counted often enough but for a chance of about ``MISS``. There is no cap
on candidates: in the worst case the windows cover the shard and everything is verified.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROJECTIONS, REACH, GROWTH, MISS = 64, 0.9, 1.1, 0.02
#: Rows that bound the first radius, and where the windows begin below that bound.
SEEDS, NARROW = 64, 0.9
SHARD_ROWS, QUERY_ROWS = 32768, 512
SEED = 11


def collision_threshold(projections: int = PROJECTIONS, reach: float = REACH, miss: float = MISS) -> int:
    """The largest count that a vector inside the radius misses with probability ``miss`` at most (exact binomial)."""
    p = 2 * NormalDist().cdf(reach) - 1
    below, least = 0.0, 0
    for k in range(projections):
        below += math.comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if below > miss:
            break
        least = k + 1
    return max(least, 1)


class Shard:
    """Sorted projections of one shard's vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int = PROJECTIONS):
        self.ids, self.vectors = ids, vectors
        self.directions = np.random.default_rng(SEED).standard_normal((vectors.shape[1], projections))
        projected = (vectors @ self.directions).T
        order = np.argsort(projected, axis=1, kind="stable")
        self.order = order.astype(np.int32)
        self.sorted = np.take_along_axis(projected, order, axis=1)
        self.squares = (vectors**2).sum(axis=1)
        self.threshold = collision_threshold(projections)

    def nearest(self, own_id: int, query: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k nearest found, by distance then id."""
        count = len(self.ids)
        centre = query @ self.directions
        gap = 1e-9 * (1.0 + np.abs(centre))
        low = np.array([s.searchsorted(c) for s, c in zip(self.sorted, centre)])
        high = low.copy()
        hits = np.zeros(count, dtype=np.int32)
        verified = np.zeros(count, dtype=bool)
        best: list[tuple[float, int]] = []

        def verify(rows: np.ndarray) -> None:
            nonlocal best
            verified[rows] = True
            own = self.ids[rows] == own_id
            own[own] = (self.vectors[rows[own]] == query).all(axis=1)
            rows = rows[~own]
            if len(rows):
                if len(rows) > k:  # all that are about as near as the k-th of them; the rest cannot come in
                    about = self.squares[rows] - 2.0 * (self.vectors[rows] @ query)
                    rows = rows[about <= np.partition(about, k - 1)[k - 1] + 1e-9 * (1.0 + self.squares.max() + (query**2).sum())]
                distance = np.sqrt(((self.vectors[rows] - query) ** 2).sum(axis=1))
                order = np.lexsort((self.ids[rows], distance))[:k]
                best = sorted([*best, *zip(distance[order].tolist(), self.ids[rows][order].tolist())])[:k]

        def widen(radius: float) -> np.ndarray:
            """Count what the windows of this radius newly cover; the rows counted often enough and not yet verified."""
            nonlocal low, high
            half = REACH * radius + gap
            new_low = np.array([s.searchsorted(v, "left") for s, v in zip(self.sorted, centre - half)])
            new_high = np.array([s.searchsorted(v, "right") for s, v in zip(self.sorted, centre + half)])
            fresh = [part for o, a, b, c, d in zip(self.order, new_low, low, high, new_high) for part in (o[a:b], o[c:d])]
            np.add(hits, np.bincount(np.concatenate(fresh), minlength=count), out=hits, casting="unsafe")
            low, high = np.minimum(low, new_low), np.maximum(high, new_high)
            return np.flatnonzero((hits >= self.threshold) & ~verified)

        # A few rows that collide most in narrow windows bound the k-th distance from above: it lies at or below that of the k-th of them.
        firsts = [max(abs(s[min(j + SEEDS, count - 1)] - c), abs(s[max(j - SEEDS, 0)] - c)) for s, j, c in zip(self.sorted, low, centre)]
        widen(float(np.median(firsts)) / REACH)
        verify(np.argpartition(-hits, min(SEEDS, count) - 1)[: min(SEEDS, count)])
        radius = NARROW * best[-1][0] if len(best) == k else math.inf
        while True:
            over = widen(radius)
            if len(over):
                verify(over)
            if (len(best) == k and best[-1][0] <= radius) or verified.all():
                return best
            # No wider than the k-th distance known: there the search ends at the latest.
            radius = min(radius * GROWTH, best[-1][0]) if len(best) == k and radius > 0 else math.inf
            if min(high) == count and max(low) == 0:
                radius = math.inf


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            left = left.sort_by("vec_id")
            shard = Shard(left["vec_id"].to_numpy(), _matrix(left["vector"]))
            for own, row, query in zip(right["vec_id"].to_pylist(), right["row"].to_pylist(), _matrix(right["vector"])):
                rows += [(own, row, other, distance) for distance, other in shard.nearest(own, query, k)]
        a, r, b, c = zip(*rows) if rows else ((), (), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "row": pa.array(r, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    return run


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows found for each query row, by Euclidean distance, ties to the smaller id.

    ``vectors`` has ``vec_id`` and ``embedding``; other columns are ignored. Vectors that are null, empty, all zero or hold
    a null or non-finite component take no part, nor rows without ``vec_id``. Rows that repeat both ``vec_id`` and vector count
    once; rows that repeat a ``vec_id`` with another vector all count, as candidates (of each other too) and as queries, each with
    its own ranks. Vectors are compared with those of their own length only. A query with fewer candidates gets all of them; an empty
    table gives no rows. All rows are indexed; the query set is held against them shard by shard in blocks, so it is
    copied once per shard, and each shard answers with k rows a query, of which the best k stay.
    """
    vector = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select("vec_id", vector.alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    rows = rows.distinct().withColumn("width", F.size("vector")).withColumn("row", F.xxhash64("vec_id", "vector"))
    counts = rows.groupBy("width").agg(F.ceil(F.count("*") / F.lit(shard_rows)).cast("int").alias("shards"),
                                       F.ceil(F.sum(is_query.cast("int")) / F.lit(query_rows)).cast("int").alias("blocks"))
    sized = rows.join(F.broadcast(counts), "width")
    place, block = F.pmod("row", F.col("shards")).cast("int"), F.pmod(F.xxhash64("row", F.lit(1)), F.col("blocks")).cast("int")
    data = sized.where("blocks > 0").select("width", place.alias("shard"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vec_id", "vector")
    asked = sized.where(is_query).select("width", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), block.alias("block"), "vec_id", "row", "vector")
    asked = asked.toDF("q_width", "q_shard", "q_block", "vec_id", "row", "vector")
    found = data.groupBy("width", "shard", "block").cogroup(asked.groupBy("q_width", "q_shard", "q_block")).applyInArrow(_search(k), "query_id long, row long, vec_id long, score double")
    best = F.slice(F.sort_array(F.collect_list(F.struct("score", "vec_id"))), 1, k)
    return found.groupBy("query_id", "row").agg(best.alias("b")).select("query_id", F.posexplode("b").alias("at", "b")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")
