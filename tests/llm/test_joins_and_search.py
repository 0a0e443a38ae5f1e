"""N-gram join, neighbours and components against brute force."""

import itertools
import random
import re

import numpy as np
import pytest

from tallyleaf.llm.components import connected_components
from tallyleaf.llm.neighbours import collision_threshold, nearest_neighbours
from tallyleaf.llm.ngram_join import near_duplicates, spanning_links

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text):
    words = WORD.findall(lower(text or ""))
    if not words:
        return set()
    return {tuple(words)} if len(words) < 5 else {tuple(words[i: i + 5]) for i in range(len(words) - 4)}


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute_groups(rows):
    sets = {i: shingles(t) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), g) for i, g in groups(pairs, sets).items()}


def corpus():
    rnd = random.Random(5)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for family in range(4):
        base = [f"w{family}_{rnd.randint(0, 400)}" for _ in range(90)]
        for _ in range(25):
            words = base[:]
            for _ in range(rnd.randint(0, 9)):
                words[rnd.randrange(len(words))] = f"x{rnd.randint(0, 10**6)}"
            rows.append(" ".join(words))
    for _ in range(30):
        rows.append(" ".join(passage + [f"y{rnd.randint(0, 10**6)}" for _ in range(12)]))
    rows += ["", None, " \n", "one", "One", "one two", "one two three four", "ONE two three four", "a b c d e", "a b c d e f", "A\tb\nc d e"]
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("family_rows", [8192, 7])
def test_components_match_brute_force(spark, family_rows):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, node string, size string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, family_rows=family_rows).collect()}
    assert got == brute_groups(rows)


def chained(order, step=10, words=74):
    """Documents of ``words`` words each, at starts ``step`` apart: only neighbours link (60 of 80 n-grams)."""
    sets = [set(range(k * step, k * step + words - 4)) for k in order]
    return lambda x: [y for y in range(len(sets)) if 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y])]


def test_links_are_whole_when_the_largest_component_moves():
    rnd = random.Random(3)
    chains = [list(order) for order in itertools.permutations(range(5))] + [rnd.sample(range(50), 50) for _ in range(200)]
    for order in chains:
        n, linked = len(order), chained(order)
        pairs = spanning_links(n, linked)
        assert len(pairs) == n - 1 and set(groups(pairs, range(n)).values()) == {0}
        assert all(b in linked(a) for a, b in pairs)


def test_chains_in_any_order_of_rows(spark):
    rnd, rows = random.Random(4), []
    for chain in range(12):
        rows += [f"c{chain}w" + f" c{chain}w".join(str(i) for i in range(10 * k, 10 * k + 74)) for k in range([5, 50][chain % 2])]
    rnd.shuffle(rows)
    rows = list(enumerate(rows))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_groups(rows) and len({c for _, c in got.values()}) == 12


def test_rows_without_or_with_repeated_ids(spark):
    text = "a b c d e f g h"
    docs = spark.createDataFrame([(None, text), (7, text), (7, text), (9, text), (7, "other words stand here now"), (None, "alone in the whole wide world")],
                                 "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in near_duplicates(docs).collect())
    assert got == sorted([(True, 0, 4, 7), (False, 7, 4, 7), (False, 7, 4, 7), (False, 9, 4, 7), (False, 7, 1, 7), (True, 0, 2, 0)])


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_chain_and_star_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(5, 5), (None, 3)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}


def brute_nearest(rows, queries, k=10):
    out = {}
    for q in queries:
        found = sorted((float(np.sqrt(((np.array(rows[q]) - np.array(v)) ** 2).sum())), i) for i, v in rows.items() if i != q and len(v) == len(rows[q]))
        out[q] = found[:k]
    return out


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = {i: rng.standard_normal(24).tolist() for i in range(1200)}
    for i in range(300, 330):
        rows[i] = rows[300]  # thirty copies: ties go to the smaller id
    data = [(i, v, "z") for i, v in rows.items()]
    data += [(5000, None, ""), (5100, [0.0] * 24, ""), (5200, [None] + [1.0] * 23, ""), (5300, [float("nan")] * 24, ""), (5400, [float("inf")] * 24, ""),
             (None, [1.0] * 24, ""), (5500, [1.0, 2.0], ""), (5600, [], ""), (0, rows[0], "again")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, shard string").repartition(4)
    got = {}
    for r in nearest_neighbours(df, df["vec_id"] % 100 == 0, shard_rows=400, query_rows=8).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute_nearest(rows, [q for q in rows if q % 100 == 0])
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11))
        hits += len({i for _, i, _ in found} & {i for _, i in want[q]})
        for _, i, score in found:
            assert score == pytest.approx(dict((b, a) for a, b in want[q]).get(i, score), abs=0)
    assert hits >= 0.97 * 10 * len(want)
    assert [i for _, i, _ in got[300]] == list(range(301, 311))


def test_few_candidates_and_empty_table(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r.rank, r.vec_id) for r in nearest_neighbours(df, df["vec_id"] % 100 == 0).collect())
    assert got == [(1, 2), (2, 1)]
    assert nearest_neighbours(df.limit(0), df["vec_id"] % 100 == 0).count() == 0


def test_rows_that_repeat_an_id_with_other_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [5.0, 0.0]), (1, [0.0, 1.0]), (1, [2.0, 0.0]), (1, [5.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r["rank"], r.vec_id, round(r.score, 6)) for r in nearest_neighbours(df, df["vec_id"] % 100 == 0).collect() if r.query_id == 0)
    want = []
    for q in ([1.0, 0.0], [5.0, 0.0]):
        found = sorted((float(np.hypot(q[0] - v[0], q[1] - v[1])), i) for i, v in [rows[0], *rows[2:]] if (i, v) != (0, q))
        want += [(k, i, round(d, 6)) for k, (d, i) in enumerate(found, 1)]
    assert got == sorted(want)


def test_threshold_bounds_the_miss():
    from math import comb
    from statistics import NormalDist

    p, at = 2 * NormalDist().cdf(0.9) - 1, collision_threshold(96, 0.9, 0.002)
    assert sum(comb(96, k) * p**k * (1 - p) ** (96 - k) for k in range(at)) <= 0.002
