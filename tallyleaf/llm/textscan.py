"""Vectorised scanning of Arrow text columns inside tasks: words, word hashes and per-document counts.

All functions work on the bytes of many documents at once, so no Python loop runs per word. Memory is bounded by
the chunk size (one document larger than a chunk is a chunk of its own).
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

CHUNK_BYTES = 1 << 21
CHUNK_ROWS = 1 << 16
#: Bytes of an Arrow batch handed to a Python worker (one longer row is a batch of its own).
BATCH_BYTES = 8 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_powers: dict[str, np.ndarray] = {}


_held: dict = {"owner": None, "drop": None}


def claim(owner: str, drop=None) -> None:
    """Called when a task begins: what another operator has kept in this Python worker is released."""
    if _held["owner"] != owner and _held["drop"] is not None:
        _held["drop"]()
        gc.collect()
        pa.default_memory_pool().release_unused()
    _held.update(owner=owner, drop=drop)


def bound_batches(spark: SparkSession) -> None:
    """Batches of long texts are cut by bytes, not by the default number of rows alone; holds for the session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and the offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, starts, data = column.buffers()
    offsets = np.frombuffer(starts, dtype=np.int64)[column.offset: column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offsets[0]: offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ``limit`` bytes of ``column`` (or of one row), so that few texts are held as strings."""
    _, offsets = text_bytes(batch.column(column))
    for a, b in chunks(offsets, limit):
        yield batch.slice(a, b - a)


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (or of one row) and ``CHUNK_ROWS`` rows."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), first + CHUNK_ROWS, rows)
        yield first, last
        first = last


def powers(kind: str, size: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < size:
        step = np.uint64(_MULTIPLIER if kind == "up" else _INVERSE)
        have = np.full(max(size, CHUNK_BYTES + 1), step, dtype=np.uint64)
        have[0] = 1
        _powers[kind] = have = np.multiply.accumulate(have)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE):
    """Byte starts and ends of the words, and the row of each."""
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each span of bytes: polynomial sums taken from one running sum, then mixed."""
    terms = (_BYTE_LOWER if lower else _BYTE)[data]
    terms *= powers("up", len(data) + 1)[: len(data)]
    running = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(terms, out=running[1:])
    return mix((running[ends] - running[starts]) * powers("down", len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` neighbouring words (runs may cross rows; the caller masks those)."""
    count = len(words) - width + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(count, dtype=np.uint64)
    for k in range(width):
        out = mix(out + words[k: k + count] + np.uint64(k + 1))
    return out


def per_row(rows: np.ndarray, count: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, weights=weights, minlength=count)
