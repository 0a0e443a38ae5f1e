"""Column expressions for text: clean-up, matching, similarity. All stay on the JVM side."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyleaf import fixed_values as fv

BLANK = r"[\s　 ]"
BLANKS = " \t\n\x0b\f\r\u3000\u00a0"
WORD = r"\p{L}\p{N}_"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for use in several places of ``body``, so nested steps do not multiply the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Remove white space at both ends, including the full-width and no-break spaces."""
    return F.btrim(text, F.lit(BLANKS))


def is_missing(value: Column) -> Column:
    """Null, empty and the written forms of "no value"."""
    return value.isNull() | F.trim(value).isin(*fv.MISSING_MARKS)


def char_count(text: Column, pattern: str) -> Column:
    """How many characters (or matches) of ``pattern`` the text holds."""
    if re.fullmatch(r"\[[^\[\]&]+\]", pattern):
        # One class of characters: whole runs of them are cut out, where counting would make a string of each.
        return F.length(text) - F.length(F.regexp_replace(text, pattern + "+", ""))
    return F.regexp_count(text, F.lit(pattern))


def map_matches(text: Column, pattern: str, fn: Callable[[Column], Column]) -> Column:
    """Rewrite every match of ``pattern`` by ``fn``, exactly once and only where it matched.

    The text is split at the matches and stitched together again, so equal text elsewhere is left alone and
    look-around in the pattern keeps its context.
    """
    def rewritten(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        pieces = F.zip_with(F.split(t, pattern, -1), F.array_append(F.transform(found, fn), F.lit("")),
                            lambda gap, m: F.concat(gap, F.coalesce(m, F.lit(""))))
        return F.when(t.rlike(pattern), F.array_join(pieces, "")).otherwise(t)

    return let(text, rewritten)


# --- clean-up -----------------------------------------------------------------------------------------------

def has_cjk(text: Column) -> Column:
    return text.rlike("[一-鿿]")


def contains_any(text: Column, words) -> Column:
    """Whether any of the words occurs; plain searches, far cheaper than one long alternation."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def correct_line(line: Column) -> Column:
    """Word corrections, CJK corrections, letter/digit swaps beside digits and blank runs of one line."""
    bounded = [(f"(?<![{WORD}]){wrong}(?![{WORD}])", right) for wrong, right in fv.LATIN_CORRECTIONS.items()]

    def latin(x: Column) -> Column:
        fixed = reduce(lambda acc, rule: F.regexp_replace(acc, rule[0], rule[1]), bounded, x)
        return F.when(contains_any(x, fv.LATIN_CORRECTIONS), fixed).otherwise(x)

    def cjk(x: Column) -> Column:
        fixed = reduce(lambda acc, rule: F.replace(acc, F.lit(rule[0]), F.lit(rule[1])), fv.CJK_CORRECTIONS.items(), x)
        return F.when(has_cjk(x) & contains_any(x, fv.CJK_CORRECTIONS), fixed).otherwise(x)

    def digits(x: Column) -> Column:
        fixed = x
        for letter, digit in fv.DIGIT_SWAPS.items():
            fixed = F.regexp_replace(fixed, rf"([0-9]){letter}", rf"$1{digit}")
            fixed = F.regexp_replace(fixed, rf"{letter}([0-9])", rf"{digit}$1")
        return F.when(x.rlike("[0-9]{2,}"), fixed).otherwise(x)

    return F.regexp_replace(let(let(let(line, latin), cjk), digits), f"{BLANK}{{2,}}", " ")


def kept_lines(text: Column) -> Column:
    """Trimmed non-empty lines, each once, without bar codes, noise fragments and tiny non-CJK pieces."""
    lines = F.array_distinct(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != ""))
    return F.filter(lines, lambda x: ~x.rlike(fv.NOISE_LINES) & ((F.length(x) > 2) | has_cjk(x)))


# --- normalisation ------------------------------------------------------------------------------------------

def half_width(text: Column) -> Column:
    return F.translate(text, fv.FULL_WIDTH, fv.HALF_WIDTH)


def fix_terms(text: Column) -> Column:
    return reduce(lambda acc, rule: F.regexp_replace(acc, rule[0], rule[1]), fv.TERM_FIXES, text)


DATE_FORMS = [r"(?<![0-9])([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日", r"(?<![0-9])([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})(?![0-9])",
              r"(?<![0-9])([0-9]{4})\.([0-9]{1,2})\.([0-9]{1,2})(?![0-9])", r"(?<![0-9])([0-9]{4})([0-9]{2})([0-9]{2})(?![0-9])"]
MARK = "\u0001"


def iso_dates(text: Column) -> Column:
    """Rewrite dates in four layouts as YYYY-MM-DD; a marked separator pads single digits afterwards."""
    out = text
    for form in DATE_FORMS:
        out = F.regexp_replace(out, form, f"$1{MARK}0$2{MARK}0$3")
    return F.replace(F.regexp_replace(out, f"{MARK}0([0-9]{{2}})", "-$1"), F.lit(MARK), F.lit("-"))


def group_thousands(text: Column) -> Column:
    """Comma groups for whole numbers of four digits or more that are not part of an ISO date."""
    number = rf"(?<![{WORD}])(?<![0-9]-)[0-9]{{4,}}(?![{WORD}])(?!-[0-9])"

    def grouped(m: Column) -> Column:
        plain = F.regexp_replace(m, "^0+(?=[0-9])", "")
        return F.regexp_replace(plain, "(?<=[0-9])(?=(?:[0-9]{3})+$)", ",")

    return map_matches(text, number, grouped)


def tidy_whitespace(text: Column) -> Column:
    """Trim lines, keep at most one blank line in a row, drop trailing blank lines, squeeze spaces."""
    trimmed = F.array_join(F.transform(F.split(text, "\n"), strip), "\n")
    squeezed = F.regexp_replace(F.regexp_replace(trimmed, "\n{3,}", "\n\n"), "^\n\n", "\n")
    return F.regexp_replace(F.regexp_replace(squeezed, "\n+$", ""), " +", " ")


# --- similarity ---------------------------------------------------------------------------------------------

def charset(text: Column) -> Column:
    """The distinct characters of the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)))


def value_agreement(a: Column, b: Column) -> Column:
    """0.6 x overlap of the character sets + 0.4 x length ratio; 1 when equal but for case, 0 when either is empty."""
    la, lb = F.lower(a), F.lower(b)
    sa, sb = charset(la), charset(lb)
    jaccard = F.size(F.array_intersect(sa, sb)) / F.size(F.array_union(sa, sb))
    ratio = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))
    empty = a.isNull() | b.isNull() | (a == "") | (b == "")
    return F.when(empty, 0.0).when(la == lb, 1.0).otherwise(0.6 * jaccard + 0.4 * ratio)


def character_overlap(a: Column, b: Column) -> Column:
    """Share of the shorter text's characters that occur in the longer one."""
    la, lb = F.lower(strip(a)), F.lower(strip(b))
    shorter = F.when(F.length(la) <= F.length(lb), la).otherwise(lb)
    longer = F.when(F.length(la) <= F.length(lb), lb).otherwise(la)
    chars = F.regexp_extract_all(shorter, F.lit("(?s)."), F.lit(0))
    hits = F.size(F.filter(chars, lambda c: longer.contains(c)))
    empty = a.isNull() | b.isNull() | (la == "") | (lb == "")
    return F.when(empty, 0.0).when(la == lb, 1.0).otherwise(hits / F.length(shorter))


# --- languages ----------------------------------------------------------------------------------------------

def script_counts(text: Column) -> dict[str, Column]:
    return {lang: char_count(text, pattern) for lang, pattern in fv.SCRIPT_RANGES.items()}


def dominant_language(counts: dict[str, Column], total: Column) -> Column:
    """Script with most characters, first of the list on a tie; zh gives way to ja above 15 %, to ko above 10 %."""
    best = F.greatest(*counts.values())
    chain = F.when(best == 0, "en")
    for lang, n in counts.items():
        if lang == "zh":
            chain = (chain.when((n == best) & (counts["ja"] / total > 0.15), "ja")
                     .when((n == best) & (counts["ko"] / total > 0.1), "ko"))
        chain = chain.when(n == best, lang)
    return chain


def language_quality(text: Column, lang: Column) -> Column:
    """Share of characters that fit the language, stretched and capped at one."""
    clean = strip(text)
    total = F.length(clean)

    def score(pattern: str, stretch: float) -> Column:
        return F.least(F.lit(1.0), char_count(clean, pattern) / total * stretch)

    q = (
        F.when(lang.isin("zh", "ja"), score("[一-鿿぀-ゟ゠-ヿ]", 1.5)).when(lang == "ko", score("[가-힯]", 1.5))
        .when(lang == "en", score(r"[a-zA-Z0-9\s]", 1.2)).otherwise(score(r"[a-zA-Z0-9À-ɏ\s]", 1.2))
    )
    return F.when(total < 5, 0.0).otherwise(F.round(q, 3))


# --- sensitive data -----------------------------------------------------------------------------------------

def sensitive_pattern(name: str) -> str:
    return "(?i)" + fv.SENSITIVE_PATTERNS[name]


def may_hold(text: Column, name: str) -> Column:
    """Cheap necessary condition of a sensitive-data pattern, tested before the pattern itself."""
    if name == "email":
        return text.contains("@")
    if name == "ipv4":
        return text.rlike(r"[0-9]\.[0-9]")
    if name == "api_key":
        return text.rlike("(?i)key|token|secret")
    return text.rlike("[0-9]{10}")


def holds(text: Column, name: str) -> Column:
    return may_hold(text, name) & text.rlike(sensitive_pattern(name))


def detected_types(text: Column) -> Column:
    """Names of the sensitive-data types found in the text, in catalogue order."""
    return F.array_compact(F.array(*[F.when(holds(text, n), F.lit(n)) for n in fv.SENSITIVE_PATTERNS]))


def mask_text(text: Column, kind: str = "partial", types: list[str] | None = None) -> Column:
    """Mask sensitive data, one type after another on the already masked text.

    ``full`` writes a marker, ``partial`` keeps the ends, ``hash`` writes the first eight digits of the MD5.
    """
    def partial(m: Column) -> Column:
        n = F.length(m)
        return (
            F.when(n <= 2, F.repeat(F.lit("*"), n))
            .when(n <= 6, F.concat(F.substring(m, 1, 1), F.repeat(F.lit("*"), n - 2), F.right(m, F.lit(1))))
            .otherwise(F.concat(F.substring(m, 1, 2), F.repeat(F.lit("*"), n - 4), F.right(m, F.lit(2))))
        )

    def hashed(m: Column) -> Column:
        return F.concat(F.lit("***"), F.substring(F.md5(m), 1, 8), F.lit("***"))

    out = text
    for name in types or list(fv.SENSITIVE_PATTERNS):
        if kind == "full":
            out = F.regexp_replace(out, sensitive_pattern(name), f"***{name}已脱敏***")
        else:
            out = map_matches(out, sensitive_pattern(name), partial if kind == "partial" else hashed)
    return out
