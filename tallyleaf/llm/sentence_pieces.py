"""A SentencePiece BPE vocabulary: its pieces, its normaliser and the merge rule, read from a model file.

Merging never crosses the border between two characters that no piece holds side by side, so a text falls into
independent chunks, and equal chunks are worked out once per task worker.
"""

from __future__ import annotations

import re
from collections import defaultdict
from heapq import heapify, heappop, heappush

SPACE_MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PIECE_BITS, PLACE_BITS, GONE = 24, 40, -2
PIECE_MASK, PLACE_MASK = (1 << PIECE_BITS) - 1, (1 << PLACE_BITS) - 1

_loaded: dict[str, "Vocabulary"] = {}


class Vocabulary:
    """Pieces of a BPE model with byte fallback and an identity normaliser; other models are refused."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or norm.precompiled_charsmap or USER_DEFINED in kinds:
            raise ValueError("needs a BPE model with byte fallback, an identity normaliser and no user-defined pieces")
        if norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("needs a model that keeps and escapes spaces")
        self.prefix = norm.add_dummy_prefix
        self.piece = [p.piece for p in model.pieces]
        self.kind = [p.type for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (NORMAL, UNUSED)}
        self.cost = {p.piece: -p.score for p in model.pieces if p.type in (NORMAL, UNUSED)}
        self.bytes = [0] * 256
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
        self.beside = {p[i: i + 2] for p in self.cost for i in range(len(p) - 1)}
        if any(x[1] == SPACE_MARK and x[0] != SPACE_MARK for x in self.beside):
            raise ValueError("a piece ends inside a word's space mark")
        # Characters without a piece get the number -1, which is part of no pair.
        self.letter = defaultdict(lambda: -1, {p: i for p, i in self.ids.items() if len(p) == 1})
        #: Two neighbours' numbers -> rank and number of their joint piece.
        self.pairs = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    self.pairs[a << PIECE_BITS | b] = int(self.cost[p]) << PIECE_BITS | i

    def normalise(self, text: str) -> str:
        if not text:
            return ""
        return (SPACE_MARK if self.prefix else "") + text.replace(" ", SPACE_MARK)

    def parts(self, chunk: str) -> list[str]:
        """Cut where no piece holds the two characters side by side; plain words are left whole, which is as right."""
        if chunk[1:].isalpha():
            return [chunk]
        cuts = [i for i in range(1, len(chunk)) if chunk[i - 1: i + 1] not in self.beside]
        return [chunk[a:b] for a, b in zip([0, *cuts], [*cuts, len(chunk)])]

    def merge(self, symbols: list[int]) -> list[int]:
        """Symbols left after merging: a heap of adjacent pairs, lowest rank then leftmost first, over a linked list.

        A popped pair counts only if the two symbols that stand there now still have that rank.
        """
        count = len(symbols)
        if count == 1:
            return symbols
        pairs, heap = self.pairs, []
        for i in range(count - 1):
            v = pairs.get(symbols[i] << PIECE_BITS | symbols[i + 1])
            if v is not None:
                heap.append((v >> PIECE_BITS) << PLACE_BITS | i)
        if not heap:
            return symbols
        heapify(heap)
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        while heap:
            top = heappop(heap)
            left = top & PLACE_MASK
            right = after[left]
            if right >= count or symbols[left] == GONE:
                continue
            v = pairs.get(symbols[left] << PIECE_BITS | symbols[right])
            if v is None or v >> PIECE_BITS != top >> PLACE_BITS:
                continue
            symbols[left] = joined = v & PIECE_MASK
            symbols[right] = GONE
            follow = after[left] = after[right]
            if follow < count:
                before[follow] = left
                v = pairs.get(joined << PIECE_BITS | symbols[follow])
                if v is not None:
                    heappush(heap, (v >> PIECE_BITS) << PLACE_BITS | left)
            lead = before[left]
            if lead >= 0:
                v = pairs.get(symbols[lead] << PIECE_BITS | joined)
                if v is not None:
                    heappush(heap, (v >> PIECE_BITS) << PLACE_BITS | lead)
        return [s for s in symbols if s != GONE]


def vocabulary(path: str) -> Vocabulary:
    """The model of ``path``, loaded once per worker."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


CHUNKS = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+")


class Remembered(dict):
    """Results by key, worked out when first asked for.

    Two generations bound the memory: when ``most`` keys are held they become the old ones, from which a key asked
    for again returns; older ones are forgotten and worked out anew.
    """

    def __init__(self, work, most: int):
        super().__init__()
        self.work, self.most, self.old = work, most, {}

    def absent(self, keys) -> list:
        """The keys for which nothing is held; what is held of old is taken over."""
        out = []
        for key in keys:
            if key not in self:
                value = self.old.get(key)
                if value is None:
                    out.append(key)
                else:
                    self[key] = value
        return out

    def turn(self) -> None:
        """Called after results were put in: beyond ``most`` they become the old ones; long texts are not kept."""
        if len(self) > self.most:
            self.old = {k: v for k, v in self.items() if not isinstance(k, str) or len(k) <= 64}
            self.clear()

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.work(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if not isinstance(key, str) or len(key) <= 64:
            self[key] = value
        return value
