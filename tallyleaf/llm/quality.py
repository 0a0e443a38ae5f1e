"""Quality rules: fixed limits on document statistics, then gradient-boosted trees over the same statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyleaf.llm import textscan as ts
from tallyleaf.llm.boosted_trees import Forest, fit

#: At most so many labelled documents are used to fit the trees: the first by hash of ``doc_id``.
LABELLED_ROWS = 4000
#: Bytes of text whose statistics are worked out at once; one longer text is taken alone.
CHUNK_BYTES = 1 << 19
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: Below this probability of good quality a document is rejected.
LEAST_SCORE = 0.3

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_EXTRA = ("n_lines", "n_letters", "n_upper", "n_digits", "n_marks")
#: Features of the trees with their signs: -1 where more may only lower the score.
FEATURES = {"log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "words_per_line": 0,
            "upper_share": 0, "digit_share": 0, "mark_share": 0}


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars.encode())] = True
    return out


SYMBOLS, NEWLINE = _bytes("#*$%&|<>"), _bytes("\n")
UPPER, DIGIT, MARKS = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes("0123456789"), _bytes(".,;:!?\"'()-")
FIRST_BYTE = (np.arange(256) & 0xC0) != 0x80
LETTER = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 0xC0)


def _distinct_rows(keys: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    """Distinct keys of each row; ``keys`` already hold the row."""
    _, at = np.unique(keys, return_index=True)
    return ts.per_row(rows[at], count)


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All counts of each text of a chunk."""
    count = len(offsets) - 1
    starts, ends, row = ts.word_spans(data, offsets)
    salt = ts.mix(np.arange(1, count + 1, dtype=np.uint64))

    def bytes_of(kind: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kind[data])])
        return total[offsets[1:]] - total[offsets[:-1]]

    out = {"n_words": ts.per_row(row, count), "word_chars": bytes_of(FIRST_BYTE & ~ts.SPACE), "n_symbols": bytes_of(SYMBOLS),
           "n_letters": bytes_of(LETTER), "n_upper": bytes_of(UPPER), "n_digits": bytes_of(DIGIT), "n_marks": bytes_of(MARKS)}
    first, last, line_row = ts.word_spans(data, offsets, NEWLINE)
    seen = np.concatenate([[0], np.cumsum(~ts.SPACE[data])])
    full = seen[last] > seen[first]
    first, last, line_row = first[full], last[full], line_row[full]
    out["n_lines"] = ts.per_row(line_row, count)
    lines = ts.span_hashes(data, first, last, lower=False)
    out["n_dup_lines"] = out["n_lines"] - _distinct_rows(ts.mix(lines ^ salt[line_row]), line_row, count)
    runs = ts.window_hashes(ts.span_hashes(data, starts, ends, lower=False), 3)
    covered = np.zeros(len(starts), dtype=bool)
    if len(runs):
        inside = np.flatnonzero(row[: len(runs)] == row[2:])
        _, back, times = np.unique(ts.mix(runs[inside] ^ salt[row[inside]]), return_inverse=True, return_counts=True)
        again = inside[times[back] > 1]
        for k in range(3):
            covered[again + k] = True
    out["n_repeat_words"] = ts.per_row(row[covered], count)
    return out


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    words, letters = np.maximum(s["n_words"], 1), np.maximum(s["n_letters"], 1)
    chars, lines = np.maximum(s["word_chars"], 1), np.maximum(s["n_lines"], 1)
    return np.column_stack([np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / chars, s["n_dup_lines"] / lines,
                            s["n_repeat_words"] / words, s["n_words"] / lines, s["n_upper"] / letters, s["n_digits"] / chars, s["n_marks"] / chars])


def column_statistics(column) -> dict[str, np.ndarray]:
    data, offsets = ts.text_bytes(column)
    parts = [statistics(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a]) for a, b in ts.chunks(offsets, CHUNK_BYTES)]
    return {k: np.concatenate([p[k] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for k in (*COUNTS, *_EXTRA)}


def fit_trees(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> Forest:
    """Trees for ``labels.quality`` over at most ``labelled_rows`` labelled documents.

    Labels without ``doc_id`` or ``quality`` are left out; of several for one ``doc_id`` the smallest counts, and of several documents that share one
    the first by a hash of the text, so at most ``labelled_rows`` rows reach the driver. Without labels, or with one class, every document
    scores alike and only the fixed limits decide.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("_quality")).where("doc_id is not null and _quality is not null")
    sample = known.groupBy("doc_id").agg(F.min("_quality").alias("_quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_order")).join(F.broadcast(sample), "doc_id")

    def run(batches):
        ts.claim("quality")
        for batch in batches:
            x = features(column_statistics(batch.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column("_quality"), batch.column("doc_id"), batch.column("_order")],
                                             ["x", "y", "doc_id", "place"])

    seen = rows.select("text", "_quality", "doc_id", "_order").mapInArrow(run, "x array<double>, y int, doc_id long, place long")
    got = seen.groupBy("doc_id").agg(F.min_by(F.struct("y", "x"), "place").alias("first")).select("doc_id", "first.*").collect()
    got.sort(key=lambda r: (r.doc_id, r.y, r.x))
    x = np.array([r.x for r in got], dtype=float).reshape(len(got), len(FEATURES))
    return fit(x, np.array([float(r.y > 0) for r in got]), np.array(list(FEATURES.values())))


def judge(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """All rows and columns of ``docs`` (with ``doc_id`` and ``text``) and the verdict.

    Added: ``_n_words, _word_chars, _n_symbols, _n_dup_lines, _n_repeat_words, _base_failed, _score, _kept``. Words are runs of
    anything but white space (space and \\x09 to \\x0D). Repeated lines count from the second on, if they hold a word;
    repeated words lie in three-word windows found twice in the text. A text under 50 words, or with over half of its words
    repeated, fails; else the trees decide. A null or empty text has zero counts and fails. Repeated rows are judged
    alike; an empty table gives no rows.
    """
    ts.bound_batches(docs.sparkSession)
    forest = fit_trees(docs, labels, labelled_rows)
    added = [*[f"_{c}" for c in COUNTS], "_base_failed", "_score", "_kept"]
    schema = T.StructType([*[f for f in docs.schema.fields if f.name not in added], *[T.StructField(f"_{c}", T.LongType()) for c in COUNTS],
                           T.StructField("_base_failed", T.BooleanType()), T.StructField("_score", T.DoubleType()), T.StructField("_kept", T.BooleanType())])
    own = [n for n in docs.columns if n not in added]

    def run(batches):
        ts.claim("quality")
        for batch in batches:
            s = column_statistics(batch.column("text"))
            failed = (s["n_words"] < LEAST_WORDS) | (100 * s["n_repeat_words"] > MOST_REPEATED_PERCENT * s["n_words"])
            score = forest.score(features(s))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in own], *[pa.array(s[c]) for c in COUNTS], pa.array(failed),
                                              pa.array(score), pa.array(~failed & (score >= LEAST_SCORE))], [*own, *added])

    return docs.select(*own).mapInArrow(run, schema)


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``score`` and ``kept`` of every document."""
    out = judge(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", *[F.col(f"_{c}").alias(c) for c in COUNTS], F.col("_base_failed").alias("base_failed"),
                      F.col("_score").alias("score"), F.col("_kept").alias("kept"))
