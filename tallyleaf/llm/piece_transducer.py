"""SentencePiece encoding and decoding as shortest paths through a weighted transducer.

Three machines are compiled from the model: the normaliser (spaces to marks, one mark in front), the pieces (an
arc per piece that matches at a position, with its negated score as tropical weight, found through the set of piece
beginnings) and byte fallback (an arc from a character without a piece to its bytes). Their composition with one
input is an acyclic lattice. A merge-based model accepts a path exactly when each two neighbouring pieces
stay apart if merged on their own, so an arc is composed only with arcs it is stable beside; the arc bigram is the
state. The shortest path over the lattice is then the model's own segmentation.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyleaf.llm import textscan as ts
from tallyleaf.llm.sentence_pieces import BYTE, CHUNKS, CONTROL, PIECE_BITS, PIECE_MASK, SPACE_MARK, UNKNOWN, Remembered, Vocabulary, vocabulary

#: Results remembered; parts of at most so many characters are composed together, so many at a time.
REMEMBERED, TOGETHER, TOGETHER_PARTS = 150_000, 40, 8192
START, LONE = PIECE_MASK, PIECE_MASK - 1
_machines: dict[str, "Transducer"] = {}


class Transducer:
    def __init__(self, voc: Vocabulary, most: int = REMEMBERED):
        self.voc = voc
        self.derived = Remembered(self._derivation, len(voc.piece))
        self.stable = Remembered(self._stable, 2 * most)
        self.part = Remembered(self._path, most)
        self.chunk = Remembered(self._chunk, most)
        self.weight = [voc.cost.get(p, math.inf) for p in voc.piece]
        self.letters = [[voc.letter[c] for c in p] for p in voc.piece]
        self.output = [bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else " \u2047 ".encode() if k == UNKNOWN else p.encode()
                       for p, k in zip(voc.piece, voc.kind)]
        #: The pieces as a trie: character -> [further characters, number of the piece that ends here].
        self.trie: dict = {}
        for p, i in voc.ids.items():
            below, node = self.trie, None
            for c in p:
                node = below.setdefault(c, [{}, -1])
                below = node[0]
            node[1] = i
        self._compile()

    def _derivation(self, piece: int) -> tuple[list, list, list] | None:
        """How a piece is merged on its own: ranks of the merges in order, and the first and last symbol before each and in the end; null if it is not reached."""
        symbols, pairs = self.letters[piece][:], self.voc.pairs
        ranks, firsts, lasts = [], [symbols[0]], [symbols[-1]]
        while len(symbols) > 1:
            best, at = min(((v, i) for i in range(len(symbols) - 1) if (v := pairs.get(symbols[i] << PIECE_BITS | symbols[i + 1])) is not None), default=(None, 0))
            if best is None:
                return None
            symbols[at: at + 2] = [best & PIECE_MASK]
            ranks.append(best >> PIECE_BITS)
            firsts.append(symbols[0])
            lasts.append(symbols[-1])
        return ([*ranks, math.inf], firsts, lasts) if symbols == [piece] else None

    def _stable(self, pair: int) -> bool:
        """Whether two pieces stay apart when merged side by side; START before a piece: whether it is reached at all.

        Until something is merged over their border each side goes its own way, lowest rank first and the left one of equals. So only the
        two symbols at the border are followed: they are merged as soon as their pair's rank is below the left side's next and not
        above the right side's.
        """
        left, right = pair >> PIECE_BITS, pair & PIECE_MASK
        b = self.derived[right]
        if left == START:
            return b is not None
        pairs = self.voc.pairs
        a = self.derived[left]
        if a is None or b is None or left << PIECE_BITS | right in pairs:
            return False
        (ours, _, lasts), (theirs, firsts, _) = a, b
        i = j = 0
        while True:
            joint = pairs.get(lasts[i] << PIECE_BITS | firsts[j])
            if joint is not None and joint >> PIECE_BITS < ours[i] and joint >> PIECE_BITS <= theirs[j]:
                return False
            if ours[i] <= theirs[j]:
                if ours[i] == math.inf:
                    return True
                i += 1
            else:
                j += 1

    def _path(self, part: str) -> bytes:
        """Shortest path through one part's lattice, as int32 identifiers.

        At each position at most one arc bigram is stable, so a position is a state; weights still decide.
        """
        count, stable, trie, cost = len(part), self.stable, self.trie, self.weight
        weight, last, origin = [math.inf] * (count + 1), [START] * (count + 1), [0] * (count + 1)
        weight[0] = 0.0
        for at in range(count):
            here = weight[at]
            if here == math.inf:
                continue
            before = last[at]
            key, below, end, single = before << PIECE_BITS, trie, at, False
            while end < count and (node := below.get(part[end])) is not None:
                below, piece = node
                end += 1
                if piece >= 0:
                    single |= end == at + 1
                    if before == LONE or stable[key | piece]:
                        there = here + cost[piece]
                        if there < weight[end]:
                            weight[end], last[end], origin[end] = there, piece, at
            if not single and here < weight[at + 1]:  # byte fallback: stable beside everything
                weight[at + 1], last[at + 1], origin[at + 1] = here, LONE, at
        path, at = [], count
        while at:
            piece = last[at]
            path.append([piece] if piece != LONE else [self.voc.bytes[b] for b in part[origin[at]].encode()])
            at = origin[at]
        return array("i", [i for step in reversed(path) for i in step]).tobytes()

    def _compile(self) -> None:
        """The trie as arrays: (node, character) -> node in order of their joint number, and the piece that ends at a node."""
        edges, pieces, todo = [], [-1], [(self.trie, 0)]
        characters = np.array(sorted({ord(c) for p in self.voc.ids for c in p}), dtype=np.uint32)
        place = {chr(c): i for i, c in enumerate(characters.tolist())}
        for below, node in todo:
            for c, (more, piece) in below.items():
                edges.append((node * len(characters) + place[c], len(pieces)))
                todo.append((more, len(pieces)))
                pieces.append(piece)
        edges.sort()
        self.characters = characters
        self.keys, self.nodes = (np.array(x, dtype=np.int64) for x in zip(*edges))
        self.ends, self.costs = np.array(pieces, dtype=np.int64), np.array(self.weight)

    def _stable_pairs(self, before: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        pairs, back = np.unique(before << PIECE_BITS | pieces, return_inverse=True)
        stable = self.stable
        return np.array([stable[k] for k in pairs.tolist()], dtype=bool)[back]

    def _paths(self, parts: list[str]) -> list[bytes]:
        """Shortest paths of many parts at once: the same composition as ``_path``, a step of all their lattices at a time.

        Only for parts whose characters all have a piece, so that byte fallback has no arc in them.
        """
        size = np.array([len(p) for p in parts])
        longest, rows = int(size.max()), np.arange(len(parts))
        text = np.full((len(parts), longest), -1, dtype=np.int64)
        flat = np.frombuffer("".join(parts).encode("utf-32-le"), dtype=np.uint32)
        text[np.repeat(rows, size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = np.searchsorted(self.characters, flat)
        weight = np.full((len(parts), longest + 1), np.inf)
        last, origin = np.full((len(parts), longest + 1), START, dtype=np.int64), np.zeros((len(parts), longest + 1), dtype=np.int64)
        weight[:, 0] = 0.0
        for at in range(longest):
            live = np.flatnonzero((size > at) & (weight[:, at] < np.inf))
            node = np.zeros(len(live), dtype=np.int64)
            for end in range(at, longest):
                character = text[live, end]
                key = node * len(self.characters) + character
                found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                go = (self.keys[found] == key) & (character >= 0)
                live, node = live[go], self.nodes[found[go]]
                if not len(live):
                    break
                piece = self.ends[node]
                arc = np.flatnonzero(piece >= 0)
                row, piece = live[arc], piece[arc]
                kept = self._stable_pairs(last[row, at], piece) if len(row) else np.zeros(0, bool)
                row, piece = row[kept], piece[kept]
                there = weight[row, at] + self.costs[piece]
                better = there < weight[row, end + 1]
                row, piece = row[better], piece[better]
                weight[row, end + 1], last[row, end + 1], origin[row, end + 1] = there[better], piece, at
        steps, at = [], size.copy()
        while (at > 0).any():
            steps.append(np.where(at > 0, last[rows, at], -1))
            at = np.where(at > 0, origin[rows, at], 0)
        path = np.array(steps[::-1]).T
        ids = path[path >= 0].astype(np.int32)
        ends = np.cumsum((path >= 0).sum(axis=1)).tolist()
        return [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends)]

    def learn(self, texts: list[str]) -> None:
        """Works out the chunks of these texts that are not remembered, each once and most of them together."""
        cut = [CHUNKS.findall(self.voc.normalise(t)) for t in texts]
        chunks = {c: self.voc.parts(c) for c in self.chunk.absent(set().union(*cut))}
        parts = self.part.absent(set().union(*chunks.values()))
        known = [p for p in parts if len(p) <= TOGETHER and self._all_known(p)]
        for first in range(0, len(known), TOGETHER_PARTS):
            block = known[first: first + TOGETHER_PARTS]
            self.part.update(zip(block, self._paths(block)))
        for chunk, own in chunks.items():
            self.chunk[chunk] = b"".join([self.part[p] for p in own])
        self.part.turn()

    def _all_known(self, part: str) -> bool:
        return all(map(self.voc.ids.__contains__, part))

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.part.__getitem__, self.voc.parts(chunk)))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.chunk.__getitem__, CHUNKS.findall(self.voc.normalise(text)))), dtype=np.int32)

    def decode(self, ids) -> str:
        """Pieces back to text; bytes that form no character become U+FFFD, control pieces vanish."""
        voc = self.voc
        out = b"".join(map(self.output.__getitem__, ids))
        text = out.decode("utf-8", "replace").replace(SPACE_MARK, " ")
        return text[1:] if voc.prefix and text.startswith(" ") else text


def transducer(path: str) -> Transducer:
    if path not in _machines:
        _machines[path] = Transducer(vocabulary(path))
    return _machines[path]


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids, n_tokens, round_trip`` for every row: the identifiers and whether decoding gives the text back.

    A null text gives a null list, no tokens and a null round trip; an empty text an empty list. A text that holds the
    space mark itself decodes it to a space, as the model's own library does, so its round trip is false. Rows are
    independent: repeats and ties need nothing; other columns are ignored. A very long text is composed part by part, whole; an empty table
    gives no rows. ``model`` is a path every executor can open.
    """

    def run(batches):
        ts.claim("transducer", _machines.clear)
        machine = transducer(model)
        for batch in (part for whole in batches for part in ts.slices(whole, "text")):
            texts = batch.column("text").to_pylist()
            machine.learn([t for t in texts if t])
            ids = [None if t is None else machine.encode(t) for t in texts]
            machine.chunk.turn()
            same = [None if i is None else machine.decode(i.tolist()) == t for i, t in zip(ids, texts)]
            length = np.array([0 if i is None else len(i) for i in ids], dtype=np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32(), mask=np.array([i is None for i in ids] + [False]))
            flat = pa.array(np.concatenate([i for i in ids if i is not None] or [np.zeros(0, np.int32)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, flat), pa.array(length),
                                              pa.array(same, pa.bool_())], ["doc_id", "ids", "n_tokens", "round_trip"])

    ts.bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, round_trip boolean")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; a null list gives a null text, an empty table no rows."""

    def run(batches):
        ts.claim("transducer", _machines.clear)
        machine = transducer(model)
        for batch in batches:
            texts = [None if i is None else machine.decode(i) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    ts.bound_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
