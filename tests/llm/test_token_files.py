"""Entropy-coded token files against the tokenizer's own library, and the coder against itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tallyleaf.llm import token_files as tf

MODEL = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, part string, n_tokens string"


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(MODEL)


def brute(rows, end_id=1):
    lib = library()
    made = []
    for doc_id, text in rows:
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, end_id], dtype="<u4")
        made.append((doc_id is not None, doc_id or 0, ids))
    made.sort(key=lambda x: x[:2])
    start, out = 0, []
    for known, doc_id, ids in made:
        out.append((doc_id if known else None, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def odd_texts():
    rnd = random.Random(5)
    letters = "aZé ßΣςIİ日本́  \t\n\r\x1c\x85'sdl09_<|>😀한글가" + " " * 6
    texts = ["", None, " ", "\n\n", "word " * 30000, "<|endoftext|>", "a<|startoftext|>b <|endoftext|> c", "don't we'll I'M", "x" * 5000, "a\x00b", "é ́e", "a b c\x0bd"]
    texts += [" ".join(rnd.choice(("ERERHA", "straße", "Œuvre", "ciónjarrez", "ŉ", "ªº", "naïve", "ĲIJ", "x", "İx")) + rnd.choice(("", ",", ".", "&&&", "***!", "'s", "|>", "(a)")) for _ in range(20)) for _ in range(60)]
    return texts + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60))) for _ in range(600)]


def test_pieces_are_encoded_as_whole_texts():
    words, lib = tf.WordIds(MODEL), library()
    texts = [t or "" for t in odd_texts()]
    assert words.split
    got = words.encode(pa.array(odd_texts()), "<u4")
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def read_back(spark, rows, path, **options):
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA).repartition(3)
    tf.write_token_files(docs, path, MODEL, scratch=path + "/scratch", **options)
    return tf.read_token_files(spark, path)


def digests(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in df.collect()), key=lambda r: r[1])


def test_files_hold_every_text(spark, tmp_path):
    rows = [(3 * i - 100, t) for i, t in enumerate(odd_texts())] + [(None, "no id")]
    random.Random(1).shuffle(rows)
    path = str(tmp_path / "files")
    assert digests(read_back(spark, rows, path, block_tokens=5000)) == brute(rows)
    some = digests(tf.read_token_files(spark, path, (50, 200)))
    assert some == [r for r in brute(rows) if r[0] is not None and 50 <= r[0] <= 200]
    assert spark.read.parquet(path + "/blocks").count() >= 5


def test_repeated_ids_and_rows(spark, tmp_path):
    rows = [(7, "same text here")] * 300 + [(7, "another"), (7, ""), (8, None)]
    got = digests(read_back(spark, rows, str(tmp_path / "files")))
    want = brute(rows)
    assert sorted((r[0], r[2], r[3]) for r in got) == sorted((r[0], r[2], r[3]) for r in want)
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()] and got[-1][0] == 8


def test_empty_table(spark, tmp_path):
    assert read_back(spark, [], str(tmp_path / "files")).count() == 0


def skewed(count, symbols, seed=2):
    rng = np.random.default_rng(seed)
    return np.minimum(rng.zipf(1.3, count) - 1, symbols - 1).astype(np.uint16)


@pytest.mark.parametrize("count", [1, 511, 512, 513, 131072, 131073, 400_001])
def test_coder_round_trip_from_every_checkpoint(count):
    ids = skewed(count, 49_000)
    table = tf.Table.of_counts(np.bincount(ids))
    payload = tf.pack(ids, [None, 5], np.array([count - 1, 1]), table)
    block = tf.Block(payload, table)
    assert (block.ids() == ids).all() and block.doc_ids == [None, 5] and block.lengths.tolist() == [count - 1, 1]
    step = tf.MARK_STEPS * tf.LANES
    for mark in range(block.marks):
        assert (block.ids(mark, mark + 1) == ids[mark * step: (mark + 1) * step]).all()
    if count > 300_000:
        share = np.bincount(ids) / count
        entropy = -(share[share > 0] * np.log2(share[share > 0])).sum() * count / 8
        assert len(payload) < 1.06 * entropy


def test_frequencies_fill_the_scale():
    for counts in (np.array([0, 3]), np.arange(40_000), np.array([1] * 49_000 + [10**12]), np.array([10**9, 1, 0, 1])):
        table = tf.Table.of_counts(counts)
        assert int(table.frequency.sum()) == 1 << tf.SCALE_BITS and ((table.frequency > 0) == (counts > 0)).all()


def test_damage_is_found():
    ids = skewed(5000, 300)
    table = tf.Table.of_counts(np.bincount(ids))
    payload = bytearray(tf.pack(ids, [1], np.array([5000]), table))
    payload[len(payload) // 2] ^= 1
    with pytest.raises(ValueError):
        tf.Block(bytes(payload), table)
    with pytest.raises(ValueError):
        tf.Block(tf.pack(ids, [1], np.array([5000]), table), tf.Table.of_counts(np.bincount(ids) + 1))
