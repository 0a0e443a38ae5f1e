"""Extracted fields: channel fusion, validation, coverage, classification, rule extraction, accuracy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyleaf import fixed_values as fv
from tallyleaf.functions import text as tx
from tallyleaf.operators.scale import exact_median, literal_table, salted_join
from tallyleaf.session import cut_lineage


def align_channels(ocr: DataFrame, vl: DataFrame) -> DataFrame:
    """Two channels field by field (full outer on document and field), without metadata fields."""
    a = ocr.where(~F.col("field").isin(*fv.META_FIELDS)).select("doc_id", "field", F.trim("value").alias("ocr_value"), F.col("conf").alias("ocr_conf"))
    b = vl.where(~F.col("field").isin(*fv.META_FIELDS)).select("doc_id", "field", F.trim("value").alias("vl_value"), F.col("conf").alias("vl_conf"))
    return a.join(b, ["doc_id", "field"], "full_outer")


def channel_fields(ocr: DataFrame, vl: DataFrame) -> DataFrame:
    """Field names seen in either channel, without metadata names."""
    both = ocr.select("field").unionByName(vl.select("field"))
    return both.where(~F.col("field").isin(*fv.META_FIELDS)).distinct()


def fuse_fields(aligned: DataFrame) -> DataFrame:
    """Choose a value per field: agreement bands .7 and .3, then weighted scores with a 1.2 margin in conflict.

    A missing confidence counts as .7; the weights are a fixed list. No shuffle beyond the alignment.
    """
    weights = literal_table(aligned.sparkSession, [(f, a, b) for f, (a, b) in fv.CHANNEL_WEIGHTS.items()],
                            "field string; w_ocr double; w_vl double")
    half = F.lit(0.5)
    has_o = F.coalesce(F.col("ocr_value"), F.lit("")) != ""
    has_v = F.coalesce(F.col("vl_value"), F.lit("")) != ""
    rows = (
        aligned.where(has_o | has_v).join(F.broadcast(weights), "field", "left")
        .withColumn("ocr_score", F.when(has_o, F.coalesce("w_ocr", half) * F.coalesce("ocr_conf", F.lit(0.7))).otherwise(0.0))
        .withColumn("vl_score", F.when(has_v, F.coalesce("w_vl", half) * F.coalesce("vl_conf", F.lit(0.7))).otherwise(0.0))
        .withColumn("consistency", F.when(has_o & has_v, tx.value_agreement(F.col("ocr_value"), F.col("vl_value"))))
    )
    c, o, v = F.col("consistency"), F.col("ocr_score"), F.col("vl_score")
    decision = (F.when(~has_v, "ocr_only").when(~has_o, "vl_only").when(c > 0.7, "consensus_ocr")
                .when(c > 0.3, "weighted_choice").otherwise("conflict_resolution"))
    chosen = (
        F.when(~has_v, "ocr").when(~has_o, "vl").when(c > 0.7, "ocr")
        .when(c > 0.3, F.when(o >= v, "ocr").otherwise("vl"))
        .when(o > v * 1.2, "ocr").when(v > o * 1.2, "vl").otherwise("both")
    )
    value = (F.when(F.col("chosen") == "ocr", F.col("ocr_value")).when(F.col("chosen") == "vl", F.col("vl_value"))
             .otherwise(F.concat_ws(" | ", "ocr_value", "vl_value")))
    return rows.withColumn("decision", decision).withColumn("chosen", chosen).withColumn("fused_value", value).drop("w_ocr", "w_vl")


def fusion_by_document(fused: DataFrame, digits: int = 4) -> DataFrame:
    """Fused confidence and counts of agreement and conflict per document; one-channel fields count as .5."""
    mean_conf = (F.coalesce(F.max("ocr_conf"), F.lit(0.7)) + F.coalesce(F.max("vl_conf"), F.lit(0.7))) / 2
    return fused.groupBy("doc_id").agg(
        F.count("*").alias("fields"),
        F.count_if(F.col("decision") == "consensus_ocr").alias("consensus"),
        F.count_if(F.col("decision") == "conflict_resolution").alias("conflicts"),
        F.round(mean_conf * (0.7 + 0.3 * F.avg(F.coalesce("consistency", F.lit(0.5)))), digits).alias("fused_confidence"))


def conflicting(a: Column, b: Column, limit: float = 0.5) -> Column:
    """Edit distance above ``limit`` of the longer value; equal or empty values never conflict."""
    sa, sb = F.trim(a), F.trim(b)
    far = F.levenshtein(sa, sb) / F.greatest(F.length(sa), F.length(sb)) > limit
    return F.coalesce((sa != "") & (sb != "") & (sa != sb) & far, F.lit(False))


def second_look(fields: DataFrame, asof: Column) -> DataFrame:
    """Reason for which a field (name, value, conf) needs a second look, strongest first; null when none."""
    name, value, conf = F.col("field"), F.col("value"), F.col("conf")
    threshold = None
    for f, t in fv.SECOND_LOOK_THRESHOLDS.items():
        threshold = F.when(name == f, t) if threshold is None else threshold.when(name == f, t)
    threshold = threshold.otherwise(fv.SECOND_LOOK_DEFAULT)
    text = F.trim(value)
    filled = F.coalesce(text != "", F.lit(False))
    is_date = name.isin("expiry", "production_date")
    date_like = text.rlike(r"\d{4}[-/年]\d{1,2}[-/月]\d{1,2}日?|\d{8}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}")
    bad_format = filled & ((is_date & ~date_like) | ((name == "batch") & ~text.rlike(fv.BATCH_FORMAT)))
    parts = [F.regexp_extract(text, r"(\d{4})[年/\-]?(\d{1,2})[月/\-]?(\d{1,2})", i) for i in (1, 2, 3)]
    parsed = F.try_to_date(F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0")), "yyyy-MM-dd")
    wrong_time = F.coalesce(((name == "production_date") & (parsed > asof)) | ((name == "expiry") & (parsed < asof)), F.lit(False))
    reason = (F.when(conf < threshold, "low_confidence").when(bad_format, "format_error").when(wrong_time, "date_logic")
              .when(tx.is_missing(value), "empty"))
    return fields.withColumn("reason", reason)


def required_table(df: DataFrame) -> DataFrame:
    rows = [(c, f) for c, fields in fv.REQUIRED_FIELDS.items() for f in fields]
    return literal_table(df.sparkSession, rows, "category string; field string")


def completion_suggestions(covered: DataFrame) -> DataFrame:
    """A suggestion for each required field that a document lacks."""
    return covered.select("doc_id", "category", F.explode("missing").alias("field")).select(
        "doc_id", "category", "field", F.lit("high").alias("priority"), F.concat(F.lit("Please extract field: "), "field").alias("hint"))


def corpus_coverage(covered: DataFrame) -> DataFrame:
    """Mean coverage and complete documents per category and over all (the row without a category)."""
    return covered.rollup("category").agg(F.count("*").alias("docs"), F.avg("coverage").alias("mean_coverage"), F.count_if(F.size("missing") == 0).alias("complete"))


def coverage(fields: DataFrame) -> DataFrame:
    """Required fields present and missing per document, with the coverage ratio.

    One row per document and a handful of field names each, so the per-document set is bounded by the catalogue.
    """
    required = literal_table(fields.sparkSession, [(c, f) for c, f in fv.REQUIRED_FIELDS.items()], "category string; required array<string>")
    present = fields.where(~tx.is_missing(F.col("value")) & (F.col("field") != "product_type")).groupBy("doc_id", "category").agg(
        F.collect_set("field").alias("present"))
    docs = fields.select("doc_id", "category").distinct().join(present, ["doc_id", "category"], "left").join(F.broadcast(required), "category")
    have = F.coalesce("present", F.array().cast("array<string>"))
    missing = F.array_except("required", have)
    return docs.select("doc_id", "category", F.sort_array(missing).alias("missing"),
                       (F.size("required") - F.size(missing)).alias("present_required"), F.size("required").alias("required_count"),
                       ((F.size("required") - F.size(missing)) / F.size("required")).alias("coverage"))


def pattern_failures(fields: DataFrame) -> DataFrame:
    """Values checked and values not matching their category's pattern, per category and field."""
    rules = literal_table(fields.sparkSession, [(c, f, p) for (c, f), p in fv.FIELD_PATTERNS.items()],
                          "category string; field string; pattern string")
    checked = fields.where(~tx.is_missing(F.col("value"))).join(F.broadcast(rules), ["category", "field"])
    return checked.groupBy("category", "field").agg(
        F.count("*").alias("checked"), F.count_if(~F.regexp_like("value", "pattern")).alias("failed"))


def priority_order(fields: DataFrame) -> DataFrame:
    """Position of each field of a document by its category's priority, then by name."""
    rows = [(c, f, p) for c, fields_ in fv.FIELD_PRIORITY.items() for f, p in fields_.items()]
    dims = literal_table(fields.sparkSession, rows, "category string; field string; priority int")
    w = Window.partitionBy("doc_id").orderBy(F.coalesce("priority", F.lit(0)).desc(), "field")
    return fields.join(F.broadcast(dims), ["category", "field"], "left").withColumn("position", F.row_number().over(w))


def category_scores(docs: DataFrame) -> DataFrame:
    """Best category by keyword hits; catalogue order breaks ties; no hit gives the default."""
    low = F.lower("text")
    out = docs
    for i, words in enumerate(fv.CATEGORY_KEYWORDS.values()):
        out = out.withColumn(f"_s{i}", sum((low.contains(w.lower()).cast("int") for w in words), F.lit(0)))
    scores = [F.col(f"_s{i}") for i in range(len(fv.CATEGORY_KEYWORDS))]
    best = F.greatest(*scores)
    chain = F.when(best == 0, fv.CATEGORY_DEFAULT)
    for name, s in zip(fv.CATEGORY_KEYWORDS, scores):
        chain = chain.when(s == best, name)
    return out.withColumn("category", chain).withColumn("score", best).drop(*[f"_s{i}" for i in range(len(scores))])


def keyword_hits(text: Column, words: list[str]) -> Column:
    """Number of keywords present; Latin words count only as whole words, in any case."""
    total = F.lit(0)
    for w in words:
        hit = text.rlike(f"(?i)(?<![A-Za-z0-9_]){w}(?![A-Za-z0-9_])") if w.isascii() else text.contains(w)
        total = total + hit.cast("int")
    return total


def scenarios(docs: DataFrame) -> DataFrame:
    """Scenario by ordered keyword thresholds; receipts with enough statement words are statements."""
    chain = None
    for name, (need, words) in fv.SCENARIO_KEYWORDS.items():
        test = keyword_hits(F.col("text"), words) >= need
        value = F.lit(name)
        if name == "finance_receipt":
            need_s, words_s = fv.STATEMENT_KEYWORDS
            value = F.when(keyword_hits(F.col("text"), words_s) >= need_s, "finance_statement").otherwise(name)
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return docs.withColumn("scenario", chain.otherwise(fv.SCENARIO_DEFAULT))


def all_rules() -> dict[str, list[str]]:
    return fv.FIELD_RULES


def needs_han(pattern: str) -> bool:
    """Whether a rule begins with Han characters in each of its alternatives, so that other texts need not be tried."""
    head = re.match(r"\((?:\?:)?([^()]*)", pattern)
    return head is not None and all(re.match(r"\[?[一-龥]", word) for word in head[1].split("|"))


#: How a rule for a name in Latin letters begins. In any case of letters it takes in whole runs of letters, digits and white space.
LATIN_RUN = r"([A-Z][A-Za-z0-9\s]+"


def once_a_run(pattern: str) -> str:
    """The same first match for a rule that begins with ``LATIN_RUN``, found in time linear in the text.

    What does not match from the first letter of a run does not match from a later one, so only that letter is tried;
    tried from each letter, a text without marks costs the square of its length. Holds where case is ignored.
    """
    return r"(?<![A-Za-z0-9\s])[0-9\s]*+" + pattern if pattern.startswith(LATIN_RUN) else pattern


def extract_fields(docs: DataFrame, rules: dict[str, list[str]]) -> DataFrame:
    """First matching rule per field, plus the number of key fields filled and a confidence band."""
    out = docs.withColumn("_han", F.col("text").rlike("[一-龥]"))
    for field, patterns in rules.items():
        # A place without a Han character is passed over at once by the rules that begin with one.
        tries = [F.nullif(tx.strip(F.regexp_extract("text", "(?imd)" + ("(?=[一-龥])" if needs_han(p) else "") + once_a_run(p), 1)), F.lit("")) for p in patterns]
        out = out.withColumn(field, F.coalesce(*[F.when(F.col("_han"), t) if needs_han(p) else t for p, t in zip(patterns, tries)]))
    return with_band(out.drop("_han"))


def with_band(out: DataFrame) -> DataFrame:
    filled = sum((F.col(f).isNotNull().cast("int") for f in fv.KEY_FIELDS), F.lit(0))
    ratio = F.col("filled_key") / len(fv.KEY_FIELDS)
    band = (F.when(ratio >= 0.8, "high").when(ratio >= 0.4, "medium").when(F.col("filled_key") > 0, "low").otherwise("failed"))
    return out.withColumn("filled_key", filled).withColumn("band", band)


def first_rule(col: Column, rules: list[tuple[str, str]]) -> Column:
    """The name of the first pattern that the text holds."""
    chain = None
    for pattern, name in rules:
        chain = F.when(col.rlike(pattern), name) if chain is None else chain.when(col.rlike(pattern), name)
    return chain


def product_types(docs: DataFrame) -> DataFrame:
    """Product type by phrase groups in order, and the type inferred from an ingredient list."""
    return docs.withColumn("product_type", first_rule(F.col("text"), fv.PRODUCT_TYPES)).withColumn(
        "inferred_type", first_rule(F.lower("ingredients"), fv.INFERRED_TYPES))


def best_reading(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Most confident reading and the reading with the largest confidence x length, per key (combinable maxima)."""
    return readings.groupBy(*keys).agg(
        F.max_by("engine", F.struct("confidence", "engine")).alias("most_confident"),
        F.max_by("engine", F.struct((F.col("confidence") * F.length("text")).alias("w"), F.col("engine"))).alias("largest_mass"))


def engine_precedence(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Reading by precedence: first engine at .4 or more (joined by the second when 1.3 times longer), second, third.

    Where none clears its floor, the filled reading with the largest confidence x length is taken; without any, ``none``.
    The confidence is that of the reading, the larger of both for a joined one, 0 for none.
    """
    def pick(engine, col):
        return F.max(F.when(F.col("engine") == engine, F.col(col)))

    mass = F.when(F.col("text") != "", F.struct((F.col("confidence") * F.length("text")).alias("m"), F.col("engine")))
    wide = readings.groupBy(*keys).agg(
        *[pick(e, c).alias(f"{e}_{c}") for e in ("first", "second", "third") for c in ("text", "confidence")],
        F.max_by(F.struct("engine", "text", "confidence"), mass).alias("heaviest"))
    def has(e, floor):
        return F.coalesce((F.col(f"{e}_text") != "") & (F.col(f"{e}_confidence") >= floor), F.lit(False))

    fused = has("first", 0.4) & has("second", 0.5)
    longer = F.length("second_text") > F.length("first_text") * 1.3
    source = (F.when(fused, "first_fused").when(has("first", 0.4), "first").when(has("second", 0.4), "second")
              .when(has("third", 0.0), "third").when(F.col("heaviest").isNotNull(), F.concat("heaviest.engine", F.lit("_fallback"))).otherwise("none"))
    text = (F.when(fused & longer, F.concat_ws("\n", "first_text", "second_text")).when(has("first", 0.4), F.col("first_text"))
            .when(has("second", 0.4), F.col("second_text")).when(has("third", 0.0), F.col("third_text")).otherwise(F.coalesce("heaviest.text", F.lit(""))))
    sure = (F.when(fused, F.greatest("first_confidence", "second_confidence")).when(has("first", 0.4), F.col("first_confidence"))
            .when(has("second", 0.4), F.col("second_confidence")).when(has("third", 0.0), F.col("third_confidence")).otherwise(F.coalesce("heaviest.confidence", F.lit(0.0))))
    return wide.select(*keys, source.alias("source"), text.alias("text"), sure.alias("confidence"))


# --- accuracy -----------------------------------------------------------------------------------------------

def compare_fields(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Match type of every true field; ``predicted`` may also hold it under a nested name ``category_info.<field>``.

    A filled top-level value wins over a nested one; of repeated values of one level the smallest counts.
    """
    named = predicted.withColumn("_nested", F.col("field").startswith("category_info.").cast("int")).withColumn(
        "field", F.regexp_replace("field", r"^category_info\.", ""))
    top = named.groupBy("doc_id", "field").agg(F.min_by("value", F.struct(F.col("value").isNull().cast("int").alias("n"), "_nested", "value")).alias("predicted"))
    joined = truth.withColumnRenamed("value", "truth").join(top, ["doc_id", "field"], "left")
    p, t = F.col("predicted"), F.col("truth")
    kind = (F.when(p.isNull() & t.isNull(), "both_null").when(p.isNull() | t.isNull(), "null_mismatch")
            .when(F.lower(F.trim(p)) == F.lower(F.trim(t)), "exact").otherwise("text_mismatch"))
    return joined.withColumn("match_type", kind).withColumn("matched", F.col("match_type").isin("both_null", "exact"))


def accuracy_report(compared: DataFrame) -> DataFrame:
    """Accuracy overall, per field, per category and per match type in one pass of grouping sets."""
    pre = compared.groupBy("field", "category", "match_type").agg(
        F.count("*").alias("n"), F.count_if("matched").alias("ok"))
    rolled = pre.groupingSets([["field"], ["category"], ["match_type"], []], "field", "category", "match_type").agg(
        F.sum("n").alias("total"), F.sum("ok").alias("matched"), F.grouping_id().alias("g"))
    # grouping id bits: field, category, match_type; a bit is 1 when the column is rolled up
    scope = F.when(F.col("g") == 3, "field").when(F.col("g") == 5, "category").when(F.col("g") == 6, "match_type").otherwise("all")
    return rolled.select(scope.alias("scope"), F.coalesce("field", "category", "match_type", F.lit("all")).alias("name"), "total", "matched",
                         F.round(F.col("matched") / F.col("total") * 100, 1).alias("accuracy"))


def score_cases(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Score of each evaluation case against its constraint texts; results without a case drop out."""
    expected = cases.select("case_id", "accuracy_threshold", F.explode("expected_fields").alias("field", "rule"))
    joined = expected.join(results.select("case_id", "structured_data"), "case_id")
    value = F.try_element_at("structured_data", F.col("field"))
    rule = F.col("rule")
    number = value.try_cast("double")
    filled = F.coalesce(value != "", F.lit(False))
    def wants(*words):
        return F.lit(False) if not words else F.array_contains(F.array(*[rule.contains(w) for w in words]), True)

    ok = (F.when(~filled, False).when(wants("非空", "non-empty"), True).when(wants("YYYY-MM-DD"), F.length(value) >= 8)
          .when(wants("浮点数", "float"), F.coalesce(number > 0, F.lit(False))).otherwise(True))
    per_case = joined.groupBy("case_id", "accuracy_threshold").agg(F.count_if(ok).alias("correct"), F.count("*").alias("total"))
    accuracy = F.col("correct") / F.col("total")
    return per_case.withColumn("accuracy", accuracy).withColumn("passed", accuracy >= F.coalesce("accuracy_threshold", F.lit(0.9)))


def robustness_report(runs: DataFrame) -> DataFrame:
    """Per segment: runs, mean, minimum, maximum, best and worst case of the extraction rate."""
    return runs.groupBy("segment").agg(
        F.count("*").alias("runs"), F.avg("rate").alias("mean_rate"), F.min("rate").alias("min_rate"), F.max("rate").alias("max_rate"),
        F.max_by("case_id", F.struct("rate", F.negate("case_id"))).alias("best_case"),
        F.min_by("case_id", F.struct("rate", "case_id")).alias("worst_case"))


def rate_totals(runs: DataFrame) -> DataFrame:
    """Overall mean and exact median."""
    base = runs.agg(F.count("*").alias("runs"), F.avg("rate").alias("mean_rate"))
    return base.withColumn("_one", F.lit(1)).join(exact_median(runs.withColumn("_one", F.lit(1)), ["_one"], "rate", "median_rate"), "_one").drop("_one")


def engine_comparison(found: DataFrame, engines: list[str]) -> DataFrame:
    """Mean fields found per category and engine, with the advantage of the first engine."""
    wide = found.groupBy("category").pivot("engine", engines).agg(F.avg("fields"))
    return wide.withColumn("advantage", F.col(engines[0]) - F.col(engines[1]))


def remaining_items(items: DataFrame, done: DataFrame, key: str, keep: Column | None = None, sample: int | None = None) -> DataFrame:
    """Items not processed yet, optionally filtered and cut to a repeatable sample ordered by a hash of the key."""
    left = items.join(done.select(key), key, "left_anti")
    if keep is not None:
        left = left.where(keep)
    return left if sample is None else left.orderBy(F.md5(F.col(key).cast("string")), key).limit(sample)


def close_sets(sets: DataFrame, share: float, salts: int) -> DataFrame:
    """``set, set2, shared, joint``: the sets of characters, each written as one text in order, of which at least ``share`` is shared, in both directions.

    Two sets of a and b characters that share so much differ in at most (a + b) (1 - share) / (1 + share) of them. Dealt by code point into one group
    more than that, they have a group in common; pairs are found by such a group and counted exactly. Numbers of groups over eight are rounded up.
    """
    size = F.length("set")

    def groups(other: Column) -> Column:
        apart = F.floor((size + other) * F.lit((1 - share) / (1 + share)))
        step = F.when(apart < 8, F.lit(1.0)).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(apart)) - 2))
        return (F.ceil(apart / step) * step + 1).cast("int")

    codes = F.transform(F.filter(F.split("set", ""), lambda c: c != ""), lambda c: F.ascii(c))
    others = F.sequence(F.ceil(size * F.lit(share)).cast("int"), F.floor(size / F.lit(share)).cast("int"))
    marked = sets.select("set", codes.alias("codes"), F.explode(F.array_distinct(F.transform(others, groups))).alias("groups")).select(
        "set", "codes", "groups", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
    # A hash may bring other groups together too: what is met is counted.
    marked = marked.select("set", "codes", F.xxhash64("groups", "group", F.filter("codes", lambda c: c % F.col("groups") == F.col("group"))).alias("mark"))
    met = salted_join(marked, marked.select("mark", F.col("set").alias("set2"), F.col("codes").alias("codes2")), ["mark"], "set", salts).where(F.col("set") < F.col("set2"))
    met = met.withColumn("shared", F.size(F.array_intersect("codes", "codes2"))).withColumn("joint", F.size("codes") + F.size("codes2") - F.col("shared"))
    near = met.where(F.col("shared") >= F.lit(share) * F.col("joint")).select("set", "set2", "shared", "joint").distinct()
    return near.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("turned")).select(
        F.when(F.col("turned"), F.col("set2")).otherwise(F.col("set")).alias("set"), F.when(F.col("turned"), F.col("set")).otherwise(F.col("set2")).alias("set2"), "shared", "joint")


def agreement_links(docs: DataFrame, threshold: float = 0.95, text: str = "text", salts: int = 8) -> DataFrame:
    """``doc_id, links, best``: with how many other rows a row's text agrees by ``threshold`` or more, and the best such agreement (null without one).

    Agreement is ``value_agreement``: .6 of the shared part of the character sets and .4 of the ratio of lengths. It depends on set and length alone,
    so rows are counted by these, and no pairs of rows or of lengths are made: for two sets the lengths that agree with a length are an interval, whose
    rows are a difference of running counts, and the best is a neighbour of that length. Sets are matched by ``close_sets``; the counts of a set are
    held against by factors of two of the length. Ends of intervals are set by the score itself. The texts are read once, into a
    checkpoint of sets and lengths. Null and empty texts agree with nothing. Needs ``threshold`` over .6.
    """
    if not 0.6 < threshold <= 1:
        raise ValueError("the bounds need a threshold over .6, and 1 at most")
    ratio, share = (threshold - 0.6) / 0.4 - 1e-9, (threshold - 0.4) / 0.6 - 1e-9
    low = F.lower(F.col(text))
    chars = F.array_join(F.sort_array(F.array_distinct(F.split(low, ""))), "")
    rows = cut_lineage(docs.select("doc_id", F.when(F.coalesce(F.length(text), F.lit(0)) > 0, F.struct(chars.alias("set"), F.length(low).alias("length"))).alias("sign")))
    signs = rows.where("sign IS NOT NULL").groupBy("sign").agg(F.count("*").alias("n")).select("sign.*", "n")
    sets = signs.select("set").distinct()
    pairs = close_sets(sets, share, salts).unionByName(sets.select("set", F.col("set").alias("set2"), F.length("set").alias("shared"), F.length("set").alias("joint")))

    def octave(length: Column) -> Column:
        return F.floor(F.log2(length)).cast("int")

    length = F.col("length")
    ours = signs.groupBy("set", octave(length).alias("octave")).agg(F.collect_list("length").alias("lengths"))
    theirs = signs.withColumn("octave", F.explode(F.sequence(octave(length * F.lit(ratio)), octave(length / F.lit(ratio))))).groupBy(F.col("set").alias("set2"), "octave").agg(
        F.sort_array(F.collect_list(F.struct("length", "n"))).alias("near"))
    met = pairs.join(ours, "set").join(theirs, ["set2", "octave"]).select(
        "set", "shared", "joint", (F.col("set") == F.col("set2")).alias("same"), "lengths", F.col("near.length").alias("near"), F.col("near.n").alias("n"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = dict(zip(batch.schema.names, batch.columns))
            sizes, near_sizes = (np.diff(column[c].offsets.to_numpy()) for c in ("lengths", "near"))
            row, near_row = (np.repeat(np.arange(batch.num_rows), s) for s in (sizes, near_sizes))
            length, near, n = (column[c].flatten().to_numpy().astype("int64") for c in ("lengths", "near", "n"))
            same = column["same"].to_numpy(zero_copy_only=False)[row]
            alike = 0.6 * (column["shared"].to_numpy() / column["joint"].to_numpy())[row]
            end = np.cumsum(near_sizes)
            first, end = (end - near_sizes)[row], end[row]
            top = max(length.max(), near.max()) + 1
            # All rows' lengths in one ascending line.
            place, before = near_row * (top + 1) + near, np.concatenate([[0], np.cumsum(n)])

            def score(other):
                return alike + 0.4 * (np.minimum(length, other) / np.maximum(length, other))

            def where(other, side):
                return np.searchsorted(place, row * (top + 1) + other, side)

            part = (threshold - alike) / 0.4
            low = np.clip(np.ceil(length * part), 1, length + 1).astype("int64")
            high = np.clip(np.floor(length / part), length - 1, top).astype("int64")
            while (step := (low > 1) & (score(low - 1) >= threshold)).any():
                low -= step
            while (step := (low <= length) & (score(low) < threshold)).any():
                low += step
            while (step := (high < top) & (score(high + 1) >= threshold)).any():
                high += step
            while (step := (high >= length) & (score(high) < threshold)).any():
                high -= step
            here, after = where(length, "left"), where(length, "right")
            itself = same & (after > here)
            links = np.maximum(before[where(high, "right")] - before[where(low, "left")], 0) - itself
            alone = itself & (before[after] - before[here] == 1)
            below, above = np.where(alone, here, after) - 1, np.where(alone, after, here)
            best = np.maximum(np.where(below >= first, score(near[np.maximum(below, 0)]), -1), np.where(above < end, score(near[np.minimum(above, len(near) - 1)]), -1))
            starts = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            lists = [pa.ListArray.from_arrays(starts, pa.array(v, kind)) for v, kind in ((length, pa.int32()), (links, pa.int64()), (best, pa.float64()))]
            yield pa.RecordBatch.from_arrays([column["set"], *lists], ["set", "length", "links", "best"])

    counts = met.mapInArrow(count, "set string, length array<int>, links array<bigint>, best array<double>")
    linked = counts.select("set", F.explode(F.arrays_zip("length", "links", "best")).alias("r")).where("r.links > 0").groupBy(F.struct("set", "r.length").alias("sign")).agg(
        F.sum("r.links").alias("links"), F.max("r.best").alias("best"))
    return rows.join(linked, "sign", "left").select("doc_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"), "best")
