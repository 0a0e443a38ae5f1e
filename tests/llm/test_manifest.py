"""The manifest against a plain walk over one tree per source."""

import hashlib
import random
import zlib

from tallyleaf.llm.manifest import FANOUT, build_manifest, verified_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree string, pos string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def climb(nodes):
    """The root, and for each node its siblings level by level as (before, after)."""
    paths = [[] for _ in nodes]
    where, level = list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        runs = [level[i: i + FANOUT] for i in range(0, len(level), FANOUT)]
        for k, at in enumerate(where):
            run, slot = runs[at // FANOUT], at % FANOUT
            paths[k].append(("".join(run[:slot]), "".join(run[slot + 1:])))
            where[k] = at // FANOUT
        level = [digest(*run) for run in runs]
    return level[0], paths


def brute(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf_of(*r), r))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in names}
    root, upper = climb([trees[s][0] for s in names])
    out = []
    for s, above in zip(names, upper):
        for (_, _, leaf, r), path in zip(sorted(by_source[s], key=lambda x: x[:3]), trees[s][1]):
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            again = leaf_of(r[0], text, *r[2:])
            for before, after in path + above:
                again = digest(before, again, after)
            out.append((r[0], leaf, trees[s][0], root, digest(*[b + a for b, a in path + above]), again, again == root))
    return sorted(out, key=str)


def compared(spark, rows, parts=3):
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(parts)
    got = verified_manifest(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == brute(rows)
    return got


def test_many_sources_and_odd_rows(spark):
    rnd = random.Random(7)
    rows = [(i, f"line {i}\nnext" if i % 3 else f"one line {i}", "en", f"s{min(rnd.randint(0, 9), 4)}", i) for i in range(900)]
    rows += [(None, "no id\n", "en", "s1", 3), (None, None, None, None, None), (5, "", "", "", 0), (7, "é日本\n\n", "zz", "é", 4), (8, "a\n", None, "s1", None),
             (9, "word " * 40000 + "\n", "en", "long", 1), (3, "same\n", "en", "twice", 1), (3, "same\n", "en", "twice", 1), (3, "other", "en", "twice", 1), (-12, "\n", "en", "s2", 1)]
    got = compared(spark, rows)
    assert {r[6] for r in got} == {True, False}


def test_more_leaves_than_two_stretches(spark):
    compared(spark, [(i * 7 % 4999, f"t{i}\n", "en", "all", 1) for i in range(4999)])


def test_one_row_and_none(spark):
    got = compared(spark, [(2, "a\nb", "en", "s", 3)], 1)
    assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == digest("")
    assert verified_manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_row_equal(spark):
    compared(spark, [(1, "a\nb", "en", "s", 3)] * 400)


def test_paths_of_the_manifest(spark):
    rows = [(i, f"t{i}", "en", f"s{i % 2}", 1) for i in range(50)]
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    out = build_manifest(docs)
    assert {len(r.path) for r in out.collect()} == {4} and out.where("changed_leaf is not null").count() == 0
