"""Hard negatives against a full sort of all scores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyleaf.llm.hard_negatives import SortedLists, hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, row string, at string, key string"


def brute(rows, every=50, positives=5, negatives=3):
    clean = set()
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        clean.add((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, tuple(math.floor(256 * x) for x in vector)))
    out = []
    for a in clean:
        if a[0] % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in clean if b != a and len(b[2]) == len(a[2]))
        for minus, p, _ in [s for s in scored if s[2] == a[1]][:positives]:
            fit = [s for s in scored if s[2] != a[1] and 50 * -minus <= 100 * -s[0] <= 95 * -minus][:negatives]
            out += [(a[0], p, k, s[1], -minus, -s[0]) for k, s in enumerate(fit, 1)]
    return sorted(out)


def compared(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    got = hard_negatives(df, F.col("vec_id") % 50 == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(map(tuple, got.collect()))
    assert got == brute(rows)
    return got


def clustered(count, width, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((10, width))
    labels = rng.integers(0, 10, count)
    return [(i, (centres[label] + rng.standard_normal(width)).round(3).tolist(), int(label)) for i, label in enumerate(labels)]


def test_many_shards_and_odd_rows(spark):
    rows = clustered(1500, 12)
    rows[300:340] = [(i, rows[300][1], i % 3) for i in range(300, 340)]  # forty equal vectors
    rows += [(2000, None, 1), (2050, [1.0] * 12, None), (2100, [None] + [1.0] * 11, 1), (2150, [float("nan")] * 12, 1), (2200, [float("inf")] * 12, 1), (None, [1.0] * 12, 1),
             (2250, [0.0] * 12, 1), (2251, [0.0] * 12, 2), (2300, [1.0, 2.0], 1), (2301, [2.0, 2.0], 1), (2302, [0.9, 1.0], 2), (2350, [], 1), (2351, [], 1), (2352, [], 2),
             (50, rows[50][1], rows[50][2]), (100, rows[3][1], 4), (-50, rows[7][1], 3)]
    assert len(compared(spark, rows, shard_rows=200, anchor_rows=8)) > 300


def test_hot_label_and_ties(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-2, 3, 6).astype(float).tolist(), int(rng.integers(0, 9)) if rng.random() < 0.3 else 5) for i in range(900)]
    compared(spark, rows, shard_rows=128, anchor_rows=5)


def test_few_rows_and_empty_table(spark):
    compared(spark, [(0, [1.0, 0.0], 2), (50, [1.0, 0.1], 3)])
    compared(spark, [])


def test_search_stops_early_and_is_whole():
    rng = np.random.default_rng(5)
    vectors = np.floor(256 * rng.standard_normal((20_000, 3)) * np.array([8.0, 1.0, 0.2])).astype(np.int64)
    lists, ids = SortedLists(vectors, 4000), rng.permutation(20_000)
    for anchor in (np.array([900, -40, 3]), np.array([-5, 1, 0]), np.array([0, 7, 0])):
        scores = vectors @ anchor
        met = 0
        for fresh, found, bound in lists.rounds(anchor):
            met += len(fresh)
            assert (found == scores[fresh]).all()
            if bound is not None and (scores > bound).sum() >= 3:
                break
        assert met < 10_000
        order = np.lexsort((ids, -scores))
        middle = int(np.sort(scores)[-200])
        below = [i for i in order if scores[i] <= middle]
        got = lists.first(anchor, ids, np.ones(20_000, bool), [(None, None), (0, middle), (5, 4)], 3)
        assert [r for _, r in got[0]] == order[:3].tolist() and [r for _, r in got[1]] == below[:3] and got[2] == []


@pytest.mark.parametrize("size", [3, 10**6, 2**40])
def test_scores_are_whole_numbers_of_any_size(size):
    rng = np.random.default_rng(6)
    vectors = rng.integers(-size, size, (50, 5))
    anchor = rng.integers(-size, size, 5)
    found = SortedLists(vectors, size).first(anchor, np.arange(50), np.ones(50, bool), [(None, None)], 50)[0]
    assert sorted(found) == sorted((sum(int(a) * int(b) for a, b in zip(v, anchor)), i) for i, v in enumerate(vectors))
