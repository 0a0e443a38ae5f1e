"""The pipeline's stages against brute force over the smallest test table."""

import re

import pytest

import corpus_pipeline as cp
from tallyleaf.llm import pii
from tests.llm.test_documents import WORD, brute_counts, brute_mix
from tests.llm.test_joins_and_search import brute_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        kept = spark.read.parquet(str(folder / name))
        out.append((docs, kept))
        docs = kept
    return out


def test_columns_stay(stages):
    for docs, kept in stages[:-1]:
        assert kept.columns == docs.columns


def test_quality_keeps_labelled_good_documents(spark, stages):
    docs, kept = stages[0]
    left = {r.doc_id for r in kept.collect()}
    for r in docs.collect():
        n, _, _, _, repeated = brute_counts(r.text)
        if n < 50 or 2 * repeated > n:
            assert r.doc_id not in left
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    sound = [r.doc_id for r in docs.collect() if quality.get(r.doc_id) == 1 and brute_counts(r.text)[0] >= 50 and 2 * brute_counts(r.text)[4] <= brute_counts(r.text)[0]]
    assert sum(i in left for i in sound) >= 0.97 * len(sound)


def test_one_document_of_each_group(stages):
    docs, kept = stages[1]
    want = brute_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if c == i)


def test_groups_go_by_text_where_ids_repeat_or_are_missing(spark):
    said = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdefg"}
    near = lambda k: said[k] + " tail"
    rows = [(7, said["a"]), (7, said["b"]), (7, near("c")), (3, said["c"]), (None, said["c"]), (None, said["d"]), (None, said["d"]), (None, near("d")),
            (7, said["e"]), (7, near("e")), (7, said["e"]), (None, said["f"]), (9, near("f")), (4, ""), (4, " "), (5, None), (None, ""), (None, None)]
    docs = spark.createDataFrame([(t, i, "s") for i, t in rows], "text string, doc_id long, source string").repartition(3)
    kept = cp.unique(spark, docs, SF)
    assert kept.columns == docs.columns
    want = [(7, said["a"]), (7, said["b"]), (3, said["c"]), (None, said["d"]), (7, said["e"]), (9, near("f")), (4, ""), (5, None), (None, ""), (None, None)]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(repr, want))


def test_masked_texts(stages):
    docs, kept = stages[2]
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in kept.collect():
        assert r.text == pii.masked(texts[r.doc_id]) and not re.search(r"[a-z0-9]@[a-z]+\.[a-z]", r.text)


def test_mixed_words(stages):
    docs, kept = stages[3]
    want = brute_mix([(r.doc_id, r.text, r.source) for r in docs.collect()])
    words = dict.fromkeys(want, 0)
    for r in kept.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert words == {i: w[3] for i, w in want.items()}


def test_encoded_texts_round_trip(stages):
    docs, kept = stages[4]
    assert kept.where("not round_trip").count() == 0 and kept.count() == docs.count()
