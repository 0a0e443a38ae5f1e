"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are made."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyleaf.llm import textscan as ts
from tallyleaf.llm.sentence_pieces import CHUNKS, Remembered, Vocabulary, vocabulary

REMEMBERED = 400_000
_counters: dict[str, "Counter"] = {}


class Counter:
    def __init__(self, voc: Vocabulary, most: int = REMEMBERED):
        self.voc = voc
        self.part = Remembered(self._part, most)
        self.chunk = Remembered(self._chunk, most)

    def _part(self, part: str) -> int:
        """Initial symbols minus merges. A symbol without a piece stands for its UTF-8 bytes, which never merge."""
        letter = self.voc.letter
        left = self.voc.merge([letter[c] for c in part])
        lone = left.count(-1)
        return len(left) if not lone else len(left) - lone + sum(len(c.encode()) for c in part if letter[c] < 0)

    def _chunk(self, chunk: str) -> int:
        return sum(map(self.part.__getitem__, self.voc.parts(chunk)))

    def __call__(self, text: str) -> int:
        return sum(map(self.chunk.__getitem__, CHUNKS.findall(self.voc.normalise(text))))


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(vocabulary(path))
    return _counters[path]


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    The count is that of the model's own library without begin or end tokens; control strings inside a text are
    ordinary text. A null text is empty and has no tokens. Ties and repeated rows are counted row by row, long texts
    chunk by chunk; other columns are ignored. An empty table gives no rows. ``model`` is a path that every
    executor can open.
    """

    def run(batches):
        ts.claim("counter", _counters.clear)
        count = counter(model)
        for batch in (part for whole in batches for part in ts.slices(whole, "text")):
            texts = batch.column("text").to_pylist()
            tokens = [count(t) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                                              pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
