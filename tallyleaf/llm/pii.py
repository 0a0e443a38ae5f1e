"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors of a whole text in one pass: at-signs, plus signs, digits, URL schemes,
identifier cues and heads of keys, cues in any case. Each kind has a small deterministic parser that expands from its anchors to both sides and validates
the result. Texts without an anchor are left after the automaton's pass.
"""

from __future__ import annotations

import hashlib
import string

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyleaf.llm import textscan as ts

KINDS = ("email", "ip", "card", "phone", "url_login", "iban", "ssn", "secret")
BASE = KINDS[:4]
DIGITS = frozenset(string.digits)
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
LABEL = frozenset(string.ascii_letters + string.digits + "-")
CALL = frozenset(" ().-" + string.digits)
ALNUM = frozenset(string.ascii_letters + string.digits)
LETTERS = frozenset(string.ascii_letters)
NAME = frozenset(string.ascii_letters + string.digits + "_-")
KEY = frozenset(string.ascii_letters + string.digits + "_-+/=.~")
#: Least length of what is assigned after a cue, and what follows the head of a key: characters and least length.
CUES = {"token": 16, "secret": 8, "api_key": 16, "api-key": 16, "apikey": 16, "api key": 16, "access_key": 16, "private_key": 16, "client_key": 16,
        "password": 6, "passwd": 6, "passphrase": 6, "pwd": 6, "authorization": 16, "bearer": 16}
HEADS = {"akia": (frozenset(string.ascii_uppercase + string.digits), 16), "asia": (frozenset(string.ascii_uppercase + string.digits), 16),
         "ghp_": (ALNUM, 30), "gho_": (ALNUM, 30), "ghs_": (ALNUM, 30), "glpat-": (NAME, 16), "xoxb-": (NAME, 16), "xoxp-": (NAME, 16), "sk-": (NAME, 20), "aiza": (NAME, 30)}
#: Anchors of each parser, in lower case.
ANCHORS = {"@": "at", "+": "plus", "http://": "scheme", "https://": "scheme", "ftp://": "scheme",
           "iban": "iban", "ssn": "ssn", "social security": "ssn", "-----begin": "block",
           **{c: "cue" for c in CUES}, **{h: "head" for h in HEADS}, **{d: "digit" for d in string.digits}}

Span = tuple[str, int, int]


def _automaton():
    machine = ahocorasick.Automaton()
    for word, kind in ANCHORS.items():
        machine.add_word(word, (kind, len(word)))
    machine.make_automaton()
    return machine


_machine = None
_LOWER = {ord(c): c.lower() for c in string.ascii_uppercase}


def anchors(text: str) -> dict[str, list[int]]:
    """Start positions (``at``, ``plus``, ``digit``) or end positions (the others) of the anchors, ascending."""
    global _machine
    if _machine is None:
        _machine = _automaton()
    found: dict[str, list[int]] = {}
    low = text.lower()
    if len(low) != len(text):  # some letters are longer in lower case; the anchors hold none of them
        low = text.translate(_LOWER)
    for end, (kind, length) in _machine.iter(low):
        found.setdefault(kind, []).append(end + 1 if length > 1 else end)
    return found


def run_end(text: str, at: int, members: frozenset) -> int:
    while at < len(text) and text[at] in members:
        at += 1
    return at


def emails(text: str, at_signs: list[int]) -> list[Span]:
    """The local part expands left to the previous match at most, the domain right over dotted labels."""
    out, free = [], 0
    for at in at_signs:
        if at < free:
            continue
        first = at
        while first > free and text[first - 1] in LOCAL:
            first -= 1
        end = run_end(text, at + 1, LABEL)
        if first == at or end == at + 1:
            continue
        dots = 0
        while end < len(text) and text[end] == "." and (more := run_end(text, end + 1, LABEL)) > end + 1:
            end, dots = more, dots + 1
        if dots:
            out.append(("email", first, end))
            free = end
    return out


def digit_runs(text: str, digits: list[int]) -> list[tuple[int, int]]:
    runs: list[tuple[int, int]] = []
    for d in digits:
        if runs and runs[-1][1] == d:
            runs[-1] = (runs[-1][0], d + 1)
        else:
            runs.append((d, d + 1))
    return runs


def addresses(text: str, runs: list[tuple[int, int]]) -> list[Span]:
    """Four digit runs joined by single dots; what fails the range check is passed over whole."""
    out, i = [], 0
    while i + 3 < len(runs):
        four = runs[i: i + 4]
        if all(b[0] == a[1] + 1 and text[a[1]] == "." for a, b in zip(four, four[1:])):
            parts = [text[a:b].lstrip("0") for a, b in four]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append(("ip", four[0][0], four[3][1]))
            i += 4
        else:
            i += 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def cards(text: str, runs: list[tuple[int, int]]) -> list[Span]:
    """Digit runs joined by single blanks or hyphens, taken as far as they go, then checked."""
    out, i = [], 0
    while i < len(runs):
        j = i
        while j + 1 < len(runs) and runs[j + 1][0] == runs[j][1] + 1 and text[runs[j][1]] in " -":
            j += 1
        count = sum(b - a for a, b in runs[i: j + 1])
        if 14 <= count <= 19 and luhn("".join(text[a:b] for a, b in runs[i: j + 1])):
            out.append(("card", runs[i][0], runs[j][1]))
        i = j + 1
    return out


def phones(text: str, plus_signs: list[int]) -> list[Span]:
    """From a plus sign and a digit over digits and their separators to the last digit."""
    out, free = [], 0
    for plus in plus_signs:
        if plus < free or plus + 1 >= len(text) or text[plus + 1] not in DIGITS:
            continue
        end = run_end(text, plus + 2, CALL)
        while end > plus + 3 and text[end - 1] not in DIGITS:
            end -= 1
        if end <= plus + 3 or text[end - 1] not in DIGITS:
            continue
        free = end
        if 10 <= sum(c in DIGITS for c in text[plus:end]) <= 15:
            out.append(("phone", plus, end))
    return out


def logins(text: str, after_scheme: list[int]) -> list[Span]:
    """``user:password@`` right after a URL scheme."""
    out = []
    for at in after_scheme:
        end = run_end(text, at, LOCAL)
        if end > at and end < len(text) and text[end] == ":":
            stop = run_end(text, end + 1, LOCAL)
            if stop > end + 1 and stop < len(text) and text[stop] == "@":
                out.append(("url_login", at, stop))
    return out


def ibans(text: str, after_cue: list[int]) -> list[Span]:
    """After the cue: two letters, two digits and 11 to 30 more, blanks allowed, with remainder 1 modulo 97."""
    out, free = [], 0
    for at in after_cue:
        while at < len(text) and text[at] in " :=#":
            at += 1
        if at < free:
            continue
        end, signs, best = at, [], None
        while end < len(text) and len(signs) < 34 and (text[end] in ALNUM or (text[end] == " " and signs and text[end - 1] != " ")):
            if text[end] != " ":
                signs.append(text[end])
                if len(signs) >= 15 and int("".join(str(int(c, 36)) for c in signs[4:] + signs[:4])) % 97 == 1:
                    best = end + 1
            end += 1
        if best and signs[0] in LETTERS and signs[1] in LETTERS and signs[2] in DIGITS and signs[3] in DIGITS:
            out.append(("iban", at, best))
            free = best
    return out


def social_numbers(text: str, after_cue: list[int]) -> list[Span]:
    """``ddd-dd-dddd`` within a few separators of the cue, with no part all zero."""
    out, free = [], 0
    for at in after_cue:
        while at < len(text) and text[at] in " :=#.":
            at += 1
        body = text[at: at + 11]
        parts = body.split("-")
        if at >= free and [len(p) for p in parts] == [3, 2, 4] and all(set(p) <= DIGITS and set(p) != {"0"} for p in parts) and text[at + 11: at + 12] not in DIGITS:
            out.append(("ssn", at, at + 11))
            free = at + 11
    return out


def assigned_secrets(text: str, after_cue: list[int]) -> list[Span]:
    """What a name with a cue is given: past the name's rest and a quote, ``:`` or ``=`` (a blank after ``bearer``), then key characters with a digit."""
    out, free = [], 0
    for cue_end in after_cue:
        if cue_end <= free:
            continue
        name = next(c for c in CUES if text[cue_end - len(c): cue_end].lower() == c)
        at = run_end(text, cue_end, NAME)
        while at < len(text) and text[at] in "\"'` ":
            at += 1
        if at < len(text) and text[at] in ":=":
            at = run_end(text, at, frozenset(":=>"))
        elif name != "bearer" or at == cue_end:
            continue
        while at < len(text) and text[at] in "\"'` ":
            at += 1
        if text[at: at + 7].lower() == "bearer ":
            at += 7
        end = run_end(text, at, KEY)
        while end > at and text[end - 1] in ".=":
            end -= 1
        if end - at >= CUES[name] and at >= free and any(c in DIGITS for c in text[at:end]):
            out.append(("secret", at, end))
            free = end
    return out


def headed_keys(text: str, after_head: list[int]) -> list[Span]:
    """Keys known by how they begin, where no letter or digit stands before them."""
    out = []
    for head_end in after_head:
        head = next(h for h in HEADS if text[head_end - len(h): head_end].lower() == h)
        first, (members, least) = head_end - len(head), HEADS[head]
        end = run_end(text, head_end, members)
        exact = text[first:head_end] == ("AIza" if head == "aiza" else head.upper() if head in ("akia", "asia") else head)
        if exact and end - head_end >= least and (first == 0 or text[first - 1] not in ALNUM) and any(c in DIGITS for c in text[head_end:end]):
            out.append(("secret", first, end))
    return out


def key_blocks(text: str, after_begin: list[int]) -> list[Span]:
    """A block from its opening line to its closing one, if it names a private key."""
    out, free = [], 0
    for at in after_begin:
        line = text.find("\n", at)
        opening = text[at: line if line >= 0 else len(text)]
        if at < free or "PRIVATE KEY-----" not in opening:
            continue
        close = text.find("-----END", at)
        end = text.find("-----", close + 8) + 5 if close >= 0 and text.find("-----", close + 8) >= 0 else at + len(opening)
        out.append(("secret", at - len("-----BEGIN"), end))
        free = end
    return out


def find(text: str) -> list[Span]:
    """All spans (kind, start, end) in code points, by start, then kind as listed."""
    hits = anchors(text)
    if not hits:
        return []
    runs = digit_runs(text, hits.get("digit", []))
    spans = [*emails(text, hits.get("at", [])), *addresses(text, runs), *cards(text, runs), *phones(text, hits.get("plus", [])),
             *logins(text, hits.get("scheme", [])), *ibans(text, hits.get("iban", [])), *social_numbers(text, hits.get("ssn", [])),
             *assigned_secrets(text, hits.get("cue", [])), *headed_keys(text, hits.get("head", [])), *key_blocks(text, hits.get("block", []))]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every row.

    Spans are ``kind:start:end`` in code points, end exclusive, joined by commas. A null text is empty: counts 0, empty
    spans and the hash of the empty string. Spans of different kinds may overlap; of one kind never. Repeated rows give
    equal rows; other columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        ts.claim("personal data")
        for batch in (part for whole in batches for part in ts.slices(whole, "text")):
            found = [find(t) if t else [] for t in batch.column("text").to_pylist()]
            base = [[s for s in f if s[0] in BASE] for f in found]
            counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in BASE]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b in base]),
                 pa.array([listed(f) for f in found], pa.string())],
                ["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans"])

    ts.bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str) -> str:
    """The text with each span, or each chain of overlapping spans, replaced by its first kind in brackets."""
    out, at, i, spans = [], 0, 0, find(text)
    if not spans:
        return text
    while i < len(spans):
        kind, first, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:first], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def mask_personal_data(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with all personal data of ``column`` masked; every other column, null and row stays as it is."""
    names = docs.columns

    def run(batches):
        ts.claim("personal data")
        for batch in (part for whole in batches for part in ts.slices(whole, column)):
            arrays = list(batch.columns)
            at = names.index(column)
            arrays[at] = pa.array([None if t is None else masked(t) for t in arrays[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names)

    ts.bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
