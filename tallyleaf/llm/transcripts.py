"""Transcript parsing: a hidden Markov model over lines recovers the roles, then turns are rendered canonically.

A hidden state is a role and whether the line opens a turn or goes on with it. A line is observed by its speaker marker, by what
stands before it (the start, a blank line, a line) and by its length. Start, transition and emission
probabilities are counts over transcripts whose turns are known, plus one.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyleaf.operators.scale import positions

ROLES = ("system", "user", "assistant")
STATES = [(role, opens) for role in ROLES for opens in (True, False)]
#: Marker words of each role, and the styles in which transcripts are written.
MARKERS = {"system": ("system", "instructions"), "user": ("user", "human", "question", "instruction"), "assistant": ("assistant", "ai", "bot", "answer", "response")}
STYLES = [{"system": "System: ", "user": "User: ", "assistant": "Assistant: "}, {"system": "### System\n", "user": "### Instruction\n", "assistant": "### Response\n"},
          {"system": "System: ", "user": "Human: ", "assistant": "AI: "}, {"system": "", "user": "", "assistant": ""}]
_WORDS = {w: role for role, words in MARKERS.items() for w in words}
MARKER = re.compile(r"^\s*(?:#+\s*|<\|)?(" + "|".join(sorted(_WORDS, key=len, reverse=True)) + r")\s*(?:\|>|:|$)[ \t]*", re.I)
FEATURES = (len(ROLES) + 1, 3, 8)
SEGMENT_TURNS = 1024


def lines_of(text: str) -> list[tuple[str, tuple[int, int, int], int]]:
    """Non-blank lines with their observation and the number of blank lines before each."""
    out, blank = [], 0
    for line in text.split("\n"):
        if not line.strip():
            blank += 1
            continue
        hit = MARKER.match(line)
        mark = 1 + ROLES.index(_WORDS[hit[1].lower()]) if hit else 0
        out.append((line, (mark, 0 if not out else 1 if blank else 2, min(7, len(line.split()).bit_length())), blank))
        blank = 0
    return out


class Model:
    """Log probabilities from counts: ``start[s]``, ``step[s, s2]``, and one table per feature."""

    def __init__(self, counts: dict[str, int]):
        n = len(STATES)
        self.start, self.step = np.ones(n), np.ones((n, n))
        self.emit = [np.ones((n, k)) for k in FEATURES]
        for key, c in counts.items():
            kind, a, b = (int(x) for x in key.split(":"))
            if kind == 0:
                self.start[a] += c
            elif kind == 1:
                self.step[a, b] += c
            else:
                self.emit[kind - 2][a, b] += c
        self.start[1::2] = 1e-9  # the first line opens a turn
        for role in range(len(ROLES)):
            for other in range(len(ROLES)):
                if role != other:  # a turn goes on in its own role only
                    self.step[2 * role: 2 * role + 2, 2 * other + 1] = 1e-9
        self.start = np.log(self.start / self.start.sum())
        self.step = np.log(self.step / self.step.sum(axis=1, keepdims=True))
        self.emit = [np.log(e / e.sum(axis=1, keepdims=True)) for e in self.emit]

    def states(self, observed: list[tuple[int, int, int]]) -> list[int]:
        """Viterbi: the likeliest state of each line; ties to the earlier state."""
        if not observed:
            return []
        seen = sum(e[:, [o[k] for o in observed]] for k, e in enumerate(self.emit))
        score, back = self.start + seen[:, 0], []
        for t in range(1, len(observed)):
            ways = score[:, None] + self.step
            back.append(ways.argmax(axis=0))
            score = ways.max(axis=0) + seen[:, t]
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


def parse(text: str, model: Model) -> list[tuple[str, str]]:
    """Turns (role, text) of a transcript; a marker at the head of a turn is not part of its text."""
    lines = lines_of(text)
    turns: list[tuple[str, list[str]]] = []
    for (line, _, blank), state in zip(lines, model.states([o for _, o, _ in lines])):
        role, opens = STATES[state]
        if opens or not turns:
            head = MARKER.sub("", line, count=1)
            turns.append((role, [head] if head else []))
        else:
            body = turns[-1][1]
            body += [""] * (blank if body else 0)
            body.append(line)
    return [(role, "\n".join(body)) for role, body in turns]


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text}<|end|>\n" for role, text in turns)


def write_transcript(turns: list[tuple[str | None, str]], style: int) -> str:
    """Turns of no known role stand unmarked between blank lines, as all do in a style without markers."""
    out = []
    for k, (role, text) in enumerate(turns):
        if k:
            out.append("\n" if STYLES[style].get(role) and STYLES[style].get(turns[k - 1][0]) else "\n\n")
        out.append(STYLES[style].get(role, "") + text)
    return "".join(out)


def known_states(turns: list[tuple[str, str]], style: int) -> tuple[list[int], list[tuple[int, int, int]]]:
    """States and observations of the lines of a transcript whose turns are known."""
    states: list[int] = []
    for role, text in turns:
        count = len(lines_of(STYLES[style][role] + text))
        states += [2 * ROLES.index(role) + (k > 0) for k in range(count)]
    return states, [o for _, o, _ in lines_of(write_transcript(turns, style))]


def held_out(conv_id: Column) -> Column:
    return F.crc32(F.coalesce(conv_id.cast("string"), F.lit("null")).cast("binary")) % 4 == 2


def style_of(conv_id: Column) -> Column:
    return F.pmod(F.xxhash64(conv_id), F.lit(len(STYLES))).cast("int")


def turn_lists(conversations: DataFrame) -> DataFrame:
    """``conv_id, segment, turns``: all turns in order, cut after each ``SEGMENT_TURNS`` rows so that no row grows without bound.

    A role that is not known is null; a null text is an empty turn; turns without a number come first, equal numbers are ordered by role and
    text, fully equal rows stand one after the other. The place of a row is found by running counts over blocks of turn numbers: a
    conversation with a large share of all rows is never ordered in one task.
    """
    role = F.when(F.col("role").isin(*ROLES), F.col("role"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    block = F.coalesce(F.floor(F.col("turn") / SEGMENT_TURNS), F.lit(-(1 << 62))).cast("bigint")
    placed = positions(rows, ["conv_id"], block, [F.col("turn").asc_nulls_first(), "role", "text"], "place")
    turns = F.sort_array(F.collect_list(F.struct("place", "role", "text")))
    return placed.groupBy("conv_id", F.floor((F.col("place") - 1) / SEGMENT_TURNS).cast("bigint").alias("segment")).agg(turns.alias("turns"))


def fit_model(conversations: DataFrame) -> Model:
    """Counts over the transcripts of all conversations outside the held-out quarter, turns of known roles; only the counts reach the driver."""
    known = turn_lists(conversations.where(~held_out(F.col("conv_id")) & F.col("role").isin(*ROLES))).withColumn("style", style_of(F.col("conv_id")))

    def run(batches):
        counts: dict[str, int] = {}
        for batch in batches:
            for turns, style in zip(batch.column("turns").to_pylist(), batch.column("style").to_pylist()):
                states, seen = known_states([(t["role"], t["text"]) for t in turns], style)
                keys = [f"0:{states[0]}:0"] if states else []
                keys += [f"1:{a}:{b}" for a, b in zip(states, states[1:])]
                keys += [f"{k + 2}:{s}:{o[k]}" for s, o in zip(states, seen) for k in range(len(FEATURES))]
                for key in keys:
                    counts[key] = counts.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["key", "n"])

    rows = known.select("turns", "style").mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    return Model({r["key"]: r["n"] for r in rows})


def parse_transcripts(transcripts: DataFrame, model: Model) -> DataFrame:
    """``conv_id, segment, turns, rendered`` from ``conv_id, segment, text``; a null or blank text has no turns. Other columns are ignored."""

    def run(batches):
        for batch in batches:
            parsed = [parse(t or "", model) for t in batch.column("text").to_pylist()]
            turns = pa.array([[{"role": r, "text": t} for r, t in p] for p in parsed], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("segment"), turns, pa.array([render(p) for p in parsed], pa.string())],
                                             ["conv_id", "segment", "turns", "rendered"])

    return transcripts.select("conv_id", "segment", "text").mapInArrow(
        run, "conv_id long, segment long, turns array<struct<role: string, text: string>>, rendered string")


def write_transcripts(conversations: DataFrame) -> DataFrame:
    """``conv_id, segment, text``: conversations as loose transcripts, one of ``STYLES`` each; roles are not kept elsewhere."""

    def run(batches):
        for batch in batches:
            texts = [write_transcript([(t["role"], t["text"]) for t in turns], style)
                     for turns, style in zip(batch.column("turns").to_pylist(), batch.column("style").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("segment"), pa.array(texts, pa.string())], ["conv_id", "segment", "text"])

    lists = turn_lists(conversations).select("conv_id", "segment", "turns", style_of(F.col("conv_id")).alias("style"))
    return lists.mapInArrow(run, "conv_id long, segment long, text string")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """``conv_id, segment, held_out, n_turns, roles, rendered_sha256``: every conversation as a transcript, parsed and rendered again.

    ``roles`` are the recovered roles in order, comma-joined. Turns without a known role are given one by their lines; a conversation without
    any text has a row with zero turns. Very long texts are lines like others; equal likelihoods go to the earlier state. Other columns
    are ignored; a null ``conv_id`` is a conversation. An empty table gives no rows.
    """
    parsed = parse_transcripts(write_transcripts(conversations), fit_model(conversations))
    roles = F.array_join(F.transform("turns", lambda t: t["role"]), ",")
    return parsed.select("conv_id", "segment", held_out(F.col("conv_id")).alias("held_out"), F.size("turns").cast("bigint").alias("n_turns"),
                         roles.alias("roles"), F.sha2("rendered", 256).alias("rendered_sha256"))
