"""Language identification with hyperdimensional profiles.

Every letter symbol has a random vector of +1 and -1. A trigram's vector binds (multiplies) the vectors of its letters,
each rotated by its place; a text's vector bundles (adds) its trigrams' vectors. A language's prototype bundles all its
training texts, each at unit length, and has the mean over languages taken off, which they share. A text goes to the
language with the largest cosine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyleaf.llm import textscan as ts

DIMENSIONS = 512
#: Letters a-z and a break have numbers below ``PLAIN``; any other letter has ``PLAIN`` plus the code point of its lower-case form.
PLAIN, BREAK = 27, 26
#: Trigrams of other letters bound at once, and vectors of such letters remembered at most.
BOUND_AT_ONCE, MOST_LETTERS = 4096, 1 << 16
SEED = 7

_tables: dict[str, np.ndarray] = {}
_letters: dict[int, np.ndarray] = {}


def symbol_of(code: int) -> int:
    c = chr(code)
    if not c.isalpha():
        return BREAK
    low = c.lower()[0]
    return ord(low) - 97 if "a" <= low <= "z" else PLAIN + ord(low)


def symbol_table() -> np.ndarray:
    """Code point -> symbol for the basic plane."""
    if "symbols" not in _tables:
        _tables["symbols"] = np.array([symbol_of(code) for code in range(1 << 16)], dtype=np.int64)
    return _tables["symbols"]


def symbols_of(codes: np.ndarray) -> np.ndarray:
    symbols = symbol_table()[codes & 0xFFFF]
    far = codes >= 1 << 16
    if far.any():
        seen, place = np.unique(codes[far], return_inverse=True)
        symbols[far] = np.array([symbol_of(int(c)) for c in seen], dtype=np.int64)[place]
    return symbols


def plain_letters() -> np.ndarray:
    if "letters" not in _tables:
        _tables["letters"] = np.random.default_rng(SEED).choice(np.array([-1, 1], dtype=np.int8), size=(PLAIN, DIMENSIONS))
    return _tables["letters"]


def letter_vector(symbol: int) -> np.ndarray:
    """The vector of a symbol; letters outside a-z are drawn by their own number, alike in every task."""
    if symbol < PLAIN:
        return plain_letters()[symbol]
    if symbol not in _letters:
        if len(_letters) >= MOST_LETTERS:
            _letters.clear()
        _letters[symbol] = np.random.default_rng([SEED, symbol]).choice(np.array([-1, 1], dtype=np.int8), size=DIMENSIONS)
    return _letters[symbol]


def trigram_vectors() -> np.ndarray:
    """Bound vectors of all trigrams of a-z and breaks, by number."""
    if "vectors" not in _tables:
        letters = plain_letters()
        first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
        pairs = (first[:, None, :] * second[None, :, :]).reshape(PLAIN * PLAIN, DIMENSIONS)
        _tables["vectors"] = (pairs[:, None, :] * letters[None, :, :]).reshape(PLAIN**3, DIMENSIONS)
    return _tables["vectors"]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and where each begins."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32), at


def trigram_counts(data: np.ndarray, offsets: np.ndarray):
    """Per row of a chunk: the numbers of its plain trigrams and their counts, then its other trigrams (three symbols of 21 bits) and theirs.

    Runs of non-letters are one break.
    """
    codes, at = code_points(data)
    symbols = symbols_of(codes)
    row = np.searchsorted(offsets, at, side="right") - 1
    kept = np.ones(len(symbols), dtype=bool)
    kept[1:] = (symbols[1:] != BREAK) | (symbols[:-1] != BREAK) | (row[1:] != row[:-1])
    symbols, row = symbols[kept], row[kept]
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    letters = np.concatenate([[0], np.cumsum(symbols != BREAK)])
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if letters[b] == letters[a]:
            out.append(None)
            continue
        s = np.concatenate([[BREAK], symbols[a:b], [BREAK]])
        other = np.maximum(np.maximum(s[:-2], s[1:-1]), s[2:]) >= PLAIN
        numbers = (s[:-2] * PLAIN + s[1:-1]) * PLAIN + s[2:]
        count = np.bincount(numbers[~other])
        seen = np.flatnonzero(count)
        packed = (s[:-2] << 42 | s[1:-1] << 21 | s[2:])[other]
        out.append((seen, count[seen], *np.unique(packed, return_counts=True)))
    return out


def bundle(counted) -> np.ndarray:
    seen, count, others, other_count = counted
    total = count.astype(np.float32) @ trigram_vectors()[seen].astype(np.float32)
    for k in range(0, len(others), BOUND_AT_ONCE):
        packed = others[k: k + BOUND_AT_ONCE]
        symbols, place = np.unique(np.concatenate([packed >> 42, packed >> 21 & 0x1FFFFF, packed & 0x1FFFFF]), return_inverse=True)
        letters = np.array([letter_vector(int(x)) for x in symbols])
        first, second, third = place.reshape(3, -1)
        bound = np.roll(letters, 2, axis=1)[first] * np.roll(letters, 1, axis=1)[second] * letters[third]
        total += other_count[k: k + BOUND_AT_ONCE].astype(np.float32) @ bound.astype(np.float32)
    return total


def row_vectors(column) -> list[np.ndarray | None]:
    """Unit vector of each text; None without a letter."""
    data, offsets = ts.text_bytes(column)
    out: list[np.ndarray | None] = []
    for a, b in ts.chunks(offsets):
        for counted in trigram_counts(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a]):
            v = None if counted is None else bundle(counted)
            out.append(None if v is None else v / max(float(np.linalg.norm(v)), 1e-9))
    return out


def held_out(doc_id: Column) -> Column:
    """The quarter of documents that is never learned from; a null ``doc_id`` counts as the text ``null``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 4 == 2


def fit_prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and their prototypes from all documents with a ``lang`` outside the held-out quarter.

    Each task adds up its texts by language, so a task sends one vector per language; only the sums reach the driver, whose
    size is languages times dimensions.
    """
    train = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, v in zip(batch.column("lang").to_pylist(), row_vectors(batch.column("text"))):
                if v is not None:
                    sums[lang] = sums.get(lang, 0.0) + np.rint(v * 2.0**20).astype(np.int64)  # whole numbers add up alike in any order
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.int64()))], ["lang", "sums"])

    parts = train.select("text", "lang").mapInArrow(run, "lang string, sums array<long>")
    total = parts.select("lang", F.posexplode("sums").alias("at", "v")).groupBy("lang", "at").agg(F.sum("v").alias("v"))
    rows = total.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("v")).orderBy("lang").collect()
    langs = [r.lang for r in rows]
    prototypes = np.array([[x.v for x in r.v] for r in rows], dtype=float).reshape(len(langs), DIMENSIONS)
    prototypes /= np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-9)
    if len(langs) > 1:
        prototypes -= prototypes.mean(axis=0)
        prototypes /= np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-9)
    return langs, prototypes.astype(np.float32)


def identify(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, from the text alone; ties go to the first language."""

    def run(batches):
        for batch in batches:
            vectors = row_vectors(batch.column("text"))
            known = [i for i, v in enumerate(vectors) if v is not None] if langs else []
            pred, score = ["und"] * len(vectors), np.zeros(len(vectors))
            if known:
                cosine = np.array([vectors[i] for i in known]) @ prototypes.T
                best = cosine.argmax(axis=1)
                for i, k, c in zip(known, best, cosine[np.arange(len(known)), best]):
                    pred[i] = langs[k]
                    score[i] = min(max(float(c), 0.0), 1.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    named = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return named.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def language_of_documents(docs: DataFrame) -> DataFrame:
    """Fit on ``docs`` and identify every row of it (columns ``doc_id, text, lang``; others are ignored).

    A text that is null, empty or without a letter gives ``und`` with score 0, as does everything when nothing could be
    learned. The score is the cosine, cut to 0..1. Whole texts count, whatever their length; repeated rows are learned as often as
    they occur. An empty table gives no rows.
    """
    return identify(docs, *fit_prototypes(docs))
