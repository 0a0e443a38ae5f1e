"""Token identifiers in entropy-coded binary blocks.

A data set is a folder with ``table`` (one frequency per identifier, shared by all blocks) and ``blocks``, Parquet as container for
binary blocks of whole documents in ascending order. A block is coded alone by a static range asymmetric numeral system: token ``j``
belongs to lane ``j % LANES``, and all lanes share one stream of 32-bit words. Coding runs backwards, so at every
``MARK_STEPS`` steps the lanes' states and the place in the stream are kept: a reader may begin at any such checkpoint. Checksums
cover the block's bytes and its identifiers. The columns beside the bytes let a reader choose blocks without reading them.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyleaf.llm import textscan as ts
from tallyleaf.llm.sentence_pieces import Remembered

SCALE_BITS, LANES, MARK_STEPS = 20, 512, 256
BLOCK_TOKENS = 2 * LANES * MARK_STEPS
LOW, WORD_BITS = 1 << 31, 32
MAGIC, HEADER = b"TLRA", struct.Struct("<4s4H6I")
#: Bytes of text whose words are worked out together, and words that are remembered.
TEXT_BYTES, REMEMBERED = 8 << 20, 400_000
BLOCK_SCHEMA = "part int, block int, first_token long, n_tokens long, n_docs long, first_doc long, last_doc long, payload binary"


class Table:
    """Frequencies that sum to ``2 ** SCALE_BITS``, at least 1 for every identifier counted."""

    def __init__(self, frequency: np.ndarray):
        self.frequency = frequency.astype(np.uint64)
        if len(frequency) and int(self.frequency.sum()) != 1 << SCALE_BITS:
            raise ValueError("frequencies do not fill the scale")
        self.start = np.cumsum(self.frequency) - self.frequency
        self.symbol = np.repeat(np.arange(len(frequency), dtype=np.uint32), frequency.astype(np.int64))
        self.check = zlib.crc32(self.frequency.astype("<u4").tobytes())

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        """Shares rounded down, none below 1; what is over goes to the most frequent, what is lacking is taken from them."""
        seen = counts > 0
        if not seen.any():
            return cls(np.zeros(0, np.int64))
        if seen.sum() > 1 << SCALE_BITS:
            raise ValueError(f"more than 2 ** {SCALE_BITS} different identifiers")
        share = counts / counts.sum() * (1 << SCALE_BITS)
        frequency = np.where(seen, np.maximum(1, share.astype(np.int64)), 0)
        over = (1 << SCALE_BITS) - int(frequency.sum())
        for i in np.argsort(-frequency, kind="stable"):
            step = over if over > 0 else max(over, 1 - int(frequency[i]))
            frequency[i] += step
            over -= step
            if over == 0:
                break
        return cls(frequency)


def pack(ids: np.ndarray, doc_ids: list, lengths: np.ndarray, table: Table) -> bytes:
    """One block: header, documents, checkpoints, words, checksum."""
    steps = -(-len(ids) // LANES)
    frequency, start = table.frequency[ids], table.start[ids]
    limit = frequency << np.uint64(WORD_BITS + 31 - SCALE_BITS)
    state, words, marks, out = np.full(LANES, LOW, np.uint64), [], [], 0
    bits, low, scale = np.uint64(WORD_BITS), np.uint64((1 << WORD_BITS) - 1), np.uint64(SCALE_BITS)
    for step in range(steps - 1, -1, -1):
        at = slice(step * LANES, (step + 1) * LANES)
        f = frequency[at]
        lane = state[: len(f)]
        over = np.flatnonzero(lane >= limit[at])
        if len(over):
            full = lane[over]
            words.append((full & low).astype("<u4"))
            out += len(over)
            lane[over] = full >> bits
        quotient = lane // f
        lane += (quotient << scale) - quotient * f + start[at]
        if step % MARK_STEPS == 0:
            marks.append((out, state.copy()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    marks.reverse()
    known = np.array([i is not None for i in doc_ids], dtype=np.uint8)
    numbers = np.array([0 if i is None else i for i in doc_ids], dtype="<i8")
    body = b"".join([
        HEADER.pack(MAGIC, 1, LANES, MARK_STEPS, SCALE_BITS, len(ids), len(doc_ids), len(marks), len(stream), zlib.crc32(ids.astype("<u4").tobytes()), table.check),
        numbers.tobytes(), lengths.astype("<u4").tobytes(), known.tobytes(),
        np.array([len(stream) - done for done, _ in marks], dtype="<u4").tobytes(), b"".join(s.astype("<u8").tobytes() for _, s in marks), stream.tobytes()])
    return body + struct.pack("<I", zlib.crc32(body))


class Block:
    """A packed block, read: its documents at once, its identifiers when asked for."""

    def __init__(self, payload: bytes, table: Table):
        if zlib.crc32(payload[:-4]) != struct.unpack("<I", payload[-4:])[0]:
            raise ValueError("a block's bytes do not have its checksum")
        magic, version, lanes, mark_steps, scale, self.count, docs, self.marks, words, self.check, made_by = HEADER.unpack_from(payload)
        if (magic, version, lanes, mark_steps, scale) != (MAGIC, 1, LANES, MARK_STEPS, SCALE_BITS) or made_by != table.check:
            raise ValueError("not a block of this format, or of another frequency table")
        self.table, at = table, HEADER.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(payload, kind, count, at)
            at += part.nbytes
            return part

        numbers, self.lengths = take("<i8", docs), take("<u4", docs).astype(np.int64)
        self.doc_ids = [int(i) if k else None for i, k in zip(numbers, take("u1", docs))]
        self.places, self.states, self.words = take("<u4", self.marks), take("<u8", self.marks * LANES).reshape(-1, LANES), take("<u4", words)

    def ids(self, first_mark: int = 0, last_mark: int | None = None) -> np.ndarray:
        """Identifiers from one checkpoint to another (by default all, whose checksum is then compared)."""
        last_mark = self.marks if last_mark is None else last_mark
        out = np.zeros(max(0, min(self.count, last_mark * MARK_STEPS * LANES) - first_mark * MARK_STEPS * LANES), dtype=np.uint32)
        table, mask, scale, bits, low = self.table, np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), np.uint64(WORD_BITS), np.uint64(LOW)
        if len(out):
            state, place = self.states[first_mark].copy(), int(self.places[first_mark])
            for first in range(0, len(out), LANES):
                lane = state[: min(LANES, len(out) - first)]
                slot = lane & mask
                symbol = table.symbol[slot]
                out[first: first + len(lane)] = symbol
                lane[:] = table.frequency[symbol] * (lane >> scale) + slot - table.start[symbol]
                short = np.flatnonzero(lane < low)
                if len(short):
                    lane[short] = lane[short] << bits | self.words[place: place + len(short)]
                    place += len(short)
        if (first_mark, last_mark) == (0, self.marks) and zlib.crc32(out.astype("<u4").tobytes()) != self.check:
            raise ValueError("a block's identifiers do not have their checksum")
        return out


class WordIds:
    """Identifiers of texts whose tokenizer keeps nothing of white space and joins nothing over it.

    Texts are cut at blanks and line feeds, where any such tokenizer separates; each different piece of a batch is worked out once by the
    tokenizer's own library, and remembered (two generations bound the memory). Marks after a Latin letter are a tokenizer word of their
    own, so they are cut off, and words of Latin letters go straight to the library's model; whether that gives what whole texts
    give is tried on examples when the tokenizer is loaded.
    """

    MARKS, LATIN = ".,;:!?&*#$%()", "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
    EXAMPLES = ("word", "Word,", "STRASSE.", "Straße&&&", "été!?", "ŒUVRE***", "naïveté", "zzqxv")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        if any(self.whole(x) for x in (" ", "\n", " \n ")) or self.whole("a b\nc") != self.whole("a") + self.whole("b") + self.whole("c"):
            raise ValueError("needs a tokenizer that drops white space")
        #: How the bytes of a word are written in the model: visible ones as they are, the others from 256 on.
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in visible)}
        self.letter = [hidden.get(b, chr(b)) for b in range(256)]
        self.known = Remembered(self._word, REMEMBERED)
        added = "".join(t.content for t in self.library.get_added_tokens_decoder().values())
        self.split = not set(added) & set(self.MARKS)
        self.split = self.split and [np.frombuffer(b, np.uint32).tolist() for b in self.encode(pa.array(self.EXAMPLES), np.uint32)] == [self.whole(w) for w in self.EXAMPLES]
        self.known.clear()

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _word(self, word: str) -> bytes:
        if not self.split or not word.isalpha() or not word.isascii() and (max(word) > "\u00ff"):
            return array("I", self.whole(word)).tobytes()
        word = word.lower()
        written = word if word.isascii() else "".join([self.letter[b] for b in word.encode()])
        return array("I", [t.id for t in self.library.model.tokenize(written)]).tobytes()

    def encode(self, texts: pa.Array, kind) -> list[bytes]:
        """The identifiers of each text as bytes of ``kind``; a null is an empty text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        texts = pc.replace_substring(texts, "\n", " ")
        if self.split:
            texts = pc.replace_substring_regex(texts, f"([{self.LATIN}])([{self.MARKS}]+)( |$)", r"\1 \2\3")
        cut = pc.split_pattern(texts, " ")
        words = cut.flatten().dictionary_encode()
        found = [self.known[w] for w in words.dictionary.to_pylist()]
        sizes = np.array([len(b) // 4 for b in found], dtype=np.int64)
        ids, firsts = np.frombuffer(b"".join(found), np.uint32).astype(kind), np.cumsum(sizes) - sizes
        at = words.indices.to_numpy(zero_copy_only=False)
        counts = sizes[at]
        ends = np.concatenate([[0], np.cumsum(counts)])
        flat = ids[np.repeat(firsts[at] - ends[:-1], counts) + np.arange(ends[-1])]
        borders = ends[np.asarray(cut.offsets) - cut.offsets[0].as_py()]
        return [flat[a:b].tobytes() for a, b in zip(borders[:-1].tolist(), borders[1:].tolist())]


_tokenizers: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def id_width(path: str) -> int:
    """Bytes of an identifier between the jobs: 2 where the vocabulary allows it, else 4."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> DataFrame:
    """``doc_id, ids, n_tokens``: the identifiers as little-endian bytes, the end identifier among them."""

    def run(batches):
        ts.claim("word ids", _tokenizers.clear)
        words, kind = word_ids(tokenizer), f"<u{width}"
        end = np.array([end_id], dtype=kind).tobytes()
        for batch in (part for whole in batches for part in ts.slices(whole, "text", TEXT_BYTES)):
            ids = [b + end for b in words.encode(batch.column("text"), kind)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(b) // width for b in ids], pa.int64())],
                                             ["doc_id", "ids", "n_tokens"])

    ts.bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, n_tokens long")


def identifier_counts(encoded: DataFrame, width: int) -> DataFrame:
    """``id, count`` over all rows; each task counts its own before anything is shuffled."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            column = batch.column("ids")
            _, offsets, data = column.buffers()
            first, last = np.frombuffer(offsets, np.int32)[[column.offset, column.offset + len(column)]] if len(column) else (0, 0)
            found = np.bincount(np.frombuffer(data, f"<u{width}", (last - first) // width, first) if last > first else np.zeros(0, np.int64), minlength=len(total))
            found[: len(total)] += total
            total = found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "count"])

    return encoded.select("ids").mapInArrow(run, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))


def blocks_of(rows: Iterator[tuple], width: int, table: Table, most: int) -> Iterator[tuple]:
    """Blocks of whole documents: one closes as soon as it holds ``most`` identifiers."""
    part, block, first, docs, held, count = None, 0, 0, [], [], 0

    def close() -> tuple:
        ids = np.frombuffer(b"".join(held), f"<u{width}")
        return part, block, first, count, len(docs), docs[0], docs[-1], pack(ids, docs, np.array([len(b) // width for b in held]), table)

    for part, doc_id, ids in rows:
        docs.append(doc_id)
        held.append(ids)
        count += len(ids) // width
        if count >= most:
            yield close()
            block, first, docs, held, count = block + 1, first + count, [], [], 0
    if docs:
        yield close()


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, scratch: str | None = None, block_tokens: int = BLOCK_TOKENS) -> None:
    """Writes the identifiers of ``docs`` (``doc_id, text``; other columns are ignored) to the folder ``path``.

    Documents stand in ascending ``doc_id``, null first; rows that share one by length, then a hash of their identifiers (fully equal
    ones are interchangeable). A null text is empty: the end identifier alone. A very long text makes a long block
    of its own. An empty table makes a folder without blocks. Each text is encoded once; the identifiers go to ``scratch`` (by
    default a new folder in the shared one), are counted, and dealt by ranges of the order. Each task codes its range alone and
    holds one block; lost tasks are made again from ``scratch``. The counts come to the driver: at most one row an identifier.
    """
    from tallyleaf.session import scratch_path

    spark, width = docs.sparkSession, id_width(tokenizer)
    scratch = scratch or scratch_path(spark, "token-ids")
    tokenised(docs, tokenizer, end_id, width).write.option("compression", "zstd").parquet(scratch)
    encoded = spark.read.parquet(scratch)
    counted = identifier_counts(encoded, width).toPandas()
    counts = np.zeros(int(counted["id"].max()) + 1 if len(counted) else 0, np.int64)
    counts[counted["id"]] = counted["count"]
    table = Table.of_counts(counts)
    frequencies = [(i, int(f)) for i, f in enumerate(table.frequency) if f]
    spark.createDataFrame(frequencies, "id int, frequency int").coalesce(1).write.parquet(os.path.join(path, "table"))

    def run(batches):
        rows = ((p, d, i) for b in batches for p, d, i in zip(b.column("part").to_pylist(), b.column("doc_id").to_pylist(), b.column("ids").to_pylist()))
        for made in blocks_of(rows, width, table, block_tokens):
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(made, (pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.binary()))], names)

    names = [c.strip().split(" ")[0] for c in BLOCK_SCHEMA.split(",")]
    order = [F.col("doc_id").asc_nulls_first(), F.col("n_tokens"), F.xxhash64("ids"), F.col("_tie")]
    ranged = encoded.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    ts.bound_batches(spark)
    made = ranged.select(F.spark_partition_id().alias("part"), "doc_id", "ids").mapInArrow(run, BLOCK_SCHEMA)
    made.write.option("compression", "none").option("parquet.block.size", str(16 << 20)).parquet(os.path.join(path, "blocks"))


def token_table(spark: SparkSession, path: str) -> Table:
    rows = spark.read.parquet(os.path.join(path, "table")).toPandas()
    frequency = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 0, np.int64)
    frequency[rows["id"]] = rows["frequency"]
    return Table(frequency)


def read_token_files(spark: SparkSession, path: str, between: tuple[int, int] | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document in the folder; ``ids`` as little-endian unsigned 32-bit integers.

    ``start`` counts the identifiers of all documents before it. ``between`` asks for the documents from one ``doc_id`` to another
    (both included): only blocks that may hold them are read, by the columns beside their bytes. Blocks are read independently of each other; a block whose bytes or
    identifiers do not have their checksum fails the job.
    """
    table = token_table(spark, path)

    def run(batches):
        for batch in batches:
            for first, payload in zip(batch.column("first").to_pylist(), batch.column("payload").to_pylist()):
                block = Block(payload, table)
                ids = block.ids().astype("<u4")
                ends = np.cumsum(block.lengths)
                starts = ends - block.lengths
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.doc_ids, pa.int64()), pa.array(first + starts, pa.int64()), pa.array(block.lengths, pa.int64()),
                     pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int32)), pa.py_buffer(ids)])],
                    ["doc_id", "start", "n_tokens", "ids"])

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(os.path.join(path, "blocks"))
    # A row a range, so this order is as small as the list of shuffle partitions.
    before = F.coalesce(F.sum("_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("_tokens")).select("part", before.alias("_before"))
    if between is not None:
        blocks = blocks.where(F.coalesce(F.col("first_doc") <= between[1], F.lit(True)) & (F.col("last_doc") >= between[0]))
    ts.bound_batches(spark)
    found = blocks.join(parts, "part").select((F.col("_before") + F.col("first_token")).alias("first"), "payload").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids binary")
    return found if between is None else found.where(F.col("doc_id").between(*between))
