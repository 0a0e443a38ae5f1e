"""Registered queries over extracted fields and accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyleaf import fixed_values as fv
from tallyleaf.functions import text as tx
from tallyleaf.operators import fields as ops
from tallyleaf.operators import free_form
from tallyleaf.operators.scale import spread_scan
from tallyleaf.plans.oracle_views import sql_list, sql_rows
from tallyleaf.plans.registry import query
from tallyleaf.sources import views as v

CHARS = "list_distinct(string_split({0}, ''))"


def agreement_sql(a: str, b: str) -> str:
    sa, sb = CHARS.format(f"lower({a})"), CHARS.format(f"lower({b})")
    return (f"CASE WHEN {a} IS NULL OR {b} IS NULL OR {a} = '' OR {b} = '' THEN 0.0::DOUBLE WHEN lower({a}) = lower({b}) THEN 1.0::DOUBLE "
            f"ELSE 0.6::DOUBLE * (len(list_intersect({sa}, {sb}))::DOUBLE / len(list_distinct(list_concat({sa}, {sb})))) "
            f"+ 0.4::DOUBLE * (least(length({a}), length({b}))::DOUBLE / greatest(length({a}), length({b}))) END")


ALIGNED = """aligned AS (SELECT coalesce(o.doc_id, w.doc_id) AS doc_id, coalesce(o.field, w.field) AS field, trim(o.value) AS ov, o.conf AS oc,
    trim(w.value) AS vv, w.conf AS vc FROM ocr o FULL OUTER JOIN vl w ON o.doc_id = w.doc_id AND o.field = w.field)"""
WEIGHTS = sql_rows([(f, a, b) for f, (a, b) in fv.CHANNEL_WEIGHTS.items()])
FUSED = ALIGNED + f""", scored AS (SELECT a.*, CASE WHEN ov IS NULL THEN 0.0::DOUBLE ELSE coalesce(w.o::DOUBLE, 0.5) * coalesce(oc, 0.7::DOUBLE) END AS os,
      CASE WHEN vv IS NULL THEN 0.0::DOUBLE ELSE coalesce(w.v::DOUBLE, 0.5) * coalesce(vc, 0.7::DOUBLE) END AS vs,
      CASE WHEN ov IS NOT NULL AND vv IS NOT NULL THEN {agreement_sql('ov', 'vv')} END AS c
      FROM aligned a LEFT JOIN (VALUES {WEIGHTS}) AS w(field, o, v) ON a.field = w.field),
  fused AS (SELECT *, CASE WHEN vv IS NULL THEN 'ocr_only' WHEN ov IS NULL THEN 'vl_only' WHEN c > 0.7::DOUBLE THEN 'consensus_ocr'
      WHEN c > 0.3::DOUBLE THEN 'weighted_choice' ELSE 'conflict_resolution' END AS decision,
    CASE WHEN vv IS NULL THEN 'ocr' WHEN ov IS NULL THEN 'vl' WHEN c > 0.7::DOUBLE THEN 'ocr' WHEN c > 0.3::DOUBLE THEN CASE WHEN os >= vs THEN 'ocr' ELSE 'vl' END
      WHEN os > vs * 1.2::DOUBLE THEN 'ocr' WHEN vs > os * 1.2::DOUBLE THEN 'vl' ELSE 'both' END AS chosen FROM scored)"""


def fused(spark, d):
    return ops.fuse_fields(ops.align_channels(*v.channels(spark, d)))


@query("J02_align_channels", "WITH " + ALIGNED + """ SELECT field, count(*) AS pairs, count(ov) AS ocr_values, count(vv) AS vl_values,
    count(*) FILTER (ov = vv) AS equal_values FROM aligned GROUP BY 1""")
def align_channels(spark, d):
    return ops.align_channels(*v.channels(spark, d)).groupBy("field").agg(
        F.count("*").alias("pairs"), F.count("ocr_value").alias("ocr_values"), F.count("vl_value").alias("vl_values"),
        F.count_if(F.col("ocr_value") == F.col("vl_value")).alias("equal_values"))


@query("A13_fuse_fields", "WITH " + FUSED + """ SELECT doc_id, field, decision, chosen, ROUND(coalesce(c, -1), 6) AS consistency,
    CASE chosen WHEN 'ocr' THEN ov WHEN 'vl' THEN vv ELSE ov || ' | ' || vv END AS fused_value FROM fused""")
def fuse_fields(spark, d):
    return fused(spark, d).select("doc_id", "field", "decision", "chosen",
                                  F.round(F.coalesce("consistency", F.lit(-1.0)), 6).alias("consistency"), "fused_value")


@query("A13_fusion_by_document", "WITH " + FUSED + """ SELECT doc_id, count(*) AS fields, count(*) FILTER (decision = 'consensus_ocr') AS consensus,
    count(*) FILTER (decision = 'conflict_resolution') AS conflicts,
    ROUND((coalesce(max(oc), 0.7::DOUBLE) + coalesce(max(vc), 0.7::DOUBLE)) / 2 * (0.7::DOUBLE + 0.3::DOUBLE * avg(coalesce(c, 0.5::DOUBLE))), 8) AS fused_confidence FROM fused GROUP BY 1""")
def fusion_by_document(spark, d):
    return ops.fusion_by_document(fused(spark, d), 8)


@query("E01_channel_fields", "SELECT DISTINCT field FROM (SELECT field FROM ocr UNION ALL SELECT field FROM vl)")
def channel_fields(spark, d):
    return ops.channel_fields(*v.channels(spark, d))


def pairs(spark, d):
    return ops.align_channels(*v.channels(spark, d)).where("ocr_value IS NOT NULL AND vl_value IS NOT NULL")


@query("X03_value_agreement", "WITH " + ALIGNED + f""", p AS (SELECT field, ov, vv, {agreement_sql('ov', 'vv')} AS a,
    CASE WHEN lower(ov) = lower(vv) THEN 1.0::DOUBLE WHEN length(ov) <= length(vv) THEN len(list_filter(string_split(lower(ov), ''), lambda x: contains(lower(vv), x)))::DOUBLE / length(ov)
      ELSE len(list_filter(string_split(lower(vv), ''), lambda x: contains(lower(ov), x)))::DOUBLE / length(vv) END AS o
    FROM aligned WHERE ov IS NOT NULL AND vv IS NOT NULL)
  SELECT field, count(*) AS pairs, ROUND(avg(a), 6) AS agreement, ROUND(avg(o), 6) AS overlap FROM p GROUP BY 1""")
def value_agreement(spark, d):
    a, b = F.col("ocr_value"), F.col("vl_value")
    return pairs(spark, d).groupBy("field").agg(
        F.count("*").alias("pairs"), F.round(F.avg(tx.value_agreement(a, b)), 6).alias("agreement"),
        F.round(F.avg(tx.character_overlap(a, b)), 6).alias("overlap"))


@query("E04_character_sets", "WITH " + ALIGNED + f""" SELECT doc_id, field, len(list_intersect({CHARS.format('ov')}, {CHARS.format('vv')})) AS shared,
    len(list_distinct(list_concat({CHARS.format('ov')}, {CHARS.format('vv')}))) AS joint FROM aligned WHERE ov IS NOT NULL AND vv IS NOT NULL""")
def character_sets(spark, d):
    a, b = tx.charset(F.col("ocr_value")), tx.charset(F.col("vl_value"))
    return pairs(spark, d).select("doc_id", "field", F.size(F.array_intersect(a, b)).alias("shared"), F.size(F.array_union(a, b)).alias("joint"))


@query("X03_document_agreement", """WITH d AS (SELECT doc_id, list_distinct(string_split(lower(text), '')) AS cs, length(text) AS n FROM documents),
  p AS (SELECT a.doc_id, 0.6::DOUBLE * (len(list_intersect(a.cs, b.cs))::DOUBLE / (len(a.cs) + len(b.cs) - len(list_intersect(a.cs, b.cs)))) + 0.4::DOUBLE * (least(a.n, b.n)::DOUBLE / greatest(a.n, b.n)) AS s
    FROM d a JOIN d b ON a.doc_id <> b.doc_id AND a.n > 0 AND b.n > 0 AND least(a.n, b.n) >= 0.87 * greatest(a.n, b.n) AND least(len(a.cs), len(b.cs)) >= 0.91 * greatest(len(a.cs), len(b.cs)))
  SELECT d.doc_id, count(s) AS links, ROUND(max(s), 8) AS best FROM d LEFT JOIN p ON p.doc_id = d.doc_id AND s >= 0.95 GROUP BY 1""")
def document_agreement(spark, d):
    out = ops.agreement_links(v.table(spark, d, "documents"))
    return out.withColumn("best", F.round("best", 8))


@query("X04_conflict_rate", "WITH " + ALIGNED + """ SELECT field, count(*) AS pairs, count(*) FILTER (ov <> '' AND vv <> '' AND ov <> vv
    AND levenshtein(ov, vv)::DOUBLE / greatest(length(ov), length(vv)) > 0.5) AS conflicts FROM aligned WHERE ov IS NOT NULL AND vv IS NOT NULL GROUP BY 1""")
def conflict_rate(spark, d):
    return pairs(spark, d).groupBy("field").agg(
        F.count("*").alias("pairs"), F.count_if(ops.conflicting(F.col("ocr_value"), F.col("vl_value"))).alias("conflicts"))


LOOK = """look AS (SELECT i, (['expiry', 'batch', 'production_date', 'brand'])[i % 4 + 1] AS field,
    CASE WHEN i % 17 = 0 THEN 'N/A' WHEN i % 4 IN (0, 2) THEN CASE WHEN i % 5 = 0 THEN strftime(dt, '%m.%Y') ELSE strftime(dt, '%Y-%m-%d') END
         WHEN i % 4 = 1 THEN CASE WHEN i % 3 = 0 THEN 'b#' ELSE 'LOT' || i END ELSE 'acme' END AS value,
    (70 + i % 30) / 100.0::DOUBLE AS conf FROM (SELECT o_orderkey AS i, o_orderdate AS dt FROM orders))"""


@query("P04_second_look", "WITH " + LOOK + """, r AS (SELECT field, CASE
    WHEN conf < CASE field WHEN 'expiry' THEN 0.85::DOUBLE WHEN 'batch' THEN 0.80::DOUBLE WHEN 'production_date' THEN 0.85::DOUBLE WHEN 'brand' THEN 0.75::DOUBLE END THEN 'low_confidence'
    WHEN field IN ('expiry', 'production_date') AND NOT regexp_matches(value, '[0-9]{4}[-/年][0-9]{1,2}[-/月][0-9]{1,2}日?|[0-9]{8}|[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}') THEN 'format_error'
    WHEN field = 'batch' AND NOT regexp_matches(value, '^[A-Za-z0-9\\-\\.]{4,20}$') THEN 'format_error'
    WHEN field = 'production_date' AND try_cast(value AS DATE) > DATE '1998-01-01' THEN 'date_logic'
    WHEN field = 'expiry' AND try_cast(value AS DATE) < DATE '1998-01-01' THEN 'date_logic'
    WHEN value IN ('', 'N/A', 'null', 'None') THEN 'empty' ELSE 'none' END AS reason FROM look)
  SELECT field, reason, count(*) AS fields FROM r GROUP BY 1, 2""")
def second_look(spark, d):
    i, dt = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    date_text = F.when(i % 5 == 0, F.date_format(dt, "MM.yyyy")).otherwise(F.date_format(dt, "yyyy-MM-dd"))
    value = (F.when(i % 17 == 0, "N/A").when((i % 4).isin(0, 2), date_text)
             .when(i % 4 == 1, F.when(i % 3 == 0, "b#").otherwise(F.concat(F.lit("LOT"), i.cast("string")))).otherwise("acme"))
    rows = v.table(spark, d, "orders").select(v.pick(i % 4, ["expiry", "batch", "production_date", "brand"]).alias("field"),
                                              value.alias("value"), ((F.lit(70) + i % 30) / 100.0).alias("conf"))
    return ops.second_look(rows, F.lit("1998-01-01").cast("date")).groupBy("field", F.coalesce("reason", F.lit("none")).alias("reason")).agg(
        F.count("*").alias("fields"))


CATS = list(fv.REQUIRED_FIELDS)
CATEGORISED = f"cat AS (SELECT doc_id, ({sql_list(CATS)})[doc_id % {len(CATS)} + 1] AS category, field, value FROM ocr)"


def categorised(spark, d):
    return v.channels(spark, d)[0].withColumn("category", v.pick(F.col("doc_id") % len(CATS), CATS)).select("doc_id", "category", "field", "value")


REQ = ", ".join(f"('{c}', {sql_list(f)})" for c, f in fv.REQUIRED_FIELDS.items())


@query("P11_coverage", "WITH " + CATEGORISED + f""", p AS (SELECT doc_id, category, list(DISTINCT field) AS present FROM cat GROUP BY 1, 2)
  SELECT doc_id, p.category, array_to_string(list_sort(list_filter(r.required, lambda x: NOT list_contains(present, x))), ',') AS missing,
    ROUND(len(list_filter(r.required, lambda x: list_contains(present, x)))::DOUBLE / len(r.required), 6) AS coverage
  FROM p JOIN (VALUES {REQ}) AS r(category, required) ON p.category = r.category""")
def coverage(spark, d):
    return ops.coverage(categorised(spark, d)).select("doc_id", "category", F.array_join("missing", ",").alias("missing"), F.round("coverage", 6).alias("coverage"))


COVERED = "WITH " + CATEGORISED + f""", p AS (SELECT doc_id, category, list(DISTINCT field) AS present FROM cat GROUP BY 1, 2),
  m AS (SELECT doc_id, p.category, list_filter(r.required, lambda x: NOT list_contains(present, x)) AS missing, len(r.required) AS n
    FROM p JOIN (VALUES {REQ}) AS r(category, required) ON p.category = r.category)"""


@query("P11_suggestions", COVERED + """ SELECT doc_id, category, field, 'high' AS priority, 'Please extract field: ' || field AS hint
  FROM (SELECT doc_id, category, unnest(missing) AS field FROM m)""")
def suggestions(spark, d):
    return ops.completion_suggestions(ops.coverage(categorised(spark, d)))


@query("P11_corpus_coverage", COVERED + """ SELECT coalesce(category, 'all') AS category, count(*) AS docs, ROUND(avg((n - len(missing))::DOUBLE / n), 6) AS mean_coverage,
    count(*) FILTER (len(missing) = 0) AS complete FROM m GROUP BY ROLLUP (category)""")
def corpus_coverage(spark, d):
    out = ops.corpus_coverage(ops.coverage(categorised(spark, d)))
    return out.select(F.coalesce("category", F.lit("all")).alias("category"), "docs", F.round("mean_coverage", 6).alias("mean_coverage"), "complete")


@query("E02_required_minus_present", "WITH " + CATEGORISED + f""" SELECT category, field, count(*) AS docs FROM (
    SELECT dc.doc_id, dc.category, r.field FROM (SELECT DISTINCT doc_id, category FROM cat) dc
      JOIN (SELECT category, unnest(required) AS field FROM (VALUES {REQ}) AS q(category, required)) r ON dc.category = r.category
    EXCEPT SELECT doc_id, category, field FROM cat) GROUP BY 1, 2""")
def required_minus_present(spark, d):
    cat = categorised(spark, d)
    required = cat.select("doc_id", "category").distinct().join(F.broadcast(ops.required_table(cat)), "category").select("doc_id", "category", "field")
    missing = required.join(cat.select("doc_id", "category", "field"), ["doc_id", "category", "field"], "left_anti")
    return missing.groupBy("category", "field").agg(F.count("*").alias("docs"))


PATS = sql_rows([(c, f, p) for (c, f), p in fv.FIELD_PATTERNS.items()])


@query("P12_pattern_failures", "WITH " + CATEGORISED + f""" SELECT c.category, c.field, count(*) AS checked, count(*) FILTER (NOT regexp_matches(value, pattern)) AS failed
    FROM cat c JOIN (VALUES {PATS}) AS r(category, field, pattern) ON c.category = r.category AND c.field = r.field GROUP BY 1, 2""")
def pattern_failures(spark, d):
    return ops.pattern_failures(categorised(spark, d))


PRIO = sql_rows([(c, f, p) for c, m in fv.FIELD_PRIORITY.items() for f, p in m.items()])


@query("W09_priority_order", "WITH " + CATEGORISED + f""" SELECT doc_id, c.field, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(priority, 0) DESC, c.field) AS position
    FROM cat c LEFT JOIN (VALUES {PRIO}) AS r(category, field, priority) ON c.category = r.category AND c.field = r.field""")
def priority_order(spark, d):
    return ops.priority_order(categorised(spark, d)).select("doc_id", "field", "position")


def hits_sql(words, lower=True):
    return " + ".join(f"CAST(contains(lower(text), '{w.lower()}') AS INT)" for w in words)


SCORES = ", ".join(f"{hits_sql(words)} AS s{i}" for i, words in enumerate(fv.CATEGORY_KEYWORDS.values()))
BEST = "greatest(" + ", ".join(f"s{i}" for i in range(len(fv.CATEGORY_KEYWORDS))) + ")"


@query("X13_category_scores", f"""WITH s AS (SELECT *, {BEST} AS best FROM (SELECT doc_id, {SCORES} FROM documents))
  SELECT CASE WHEN best = 0 THEN '{fv.CATEGORY_DEFAULT}' {' '.join(f"WHEN s{i} = best THEN '{c}'" for i, c in enumerate(fv.CATEGORY_KEYWORDS))} END AS category,
    count(*) AS docs, CAST(sum(best) AS BIGINT) AS hits FROM s GROUP BY 1""")
def category_scores(spark, d):
    return ops.category_scores(spread_scan(v.table(spark, d, "documents").select("doc_id", "text"), "doc_id")).groupBy("category").agg(
        F.count("*").alias("docs"), F.sum("score").alias("hits"))


def kw_sql(words):
    return " + ".join(f"CAST({'regexp_matches(text, ' + chr(39) + '(?i)(?:^|[^A-Za-z0-9_])' + w + '(?:$|[^A-Za-z0-9_])' + chr(39) + ')' if w.isascii() else 'contains(text, ' + chr(39) + w + chr(39) + ')'} AS INT)" for w in words)


SCEN = " ".join(
    f"WHEN {kw_sql(words)} >= {need} THEN " + (f"CASE WHEN {kw_sql(fv.STATEMENT_KEYWORDS[1])} >= 2 THEN 'finance_statement' ELSE 'finance_receipt' END" if n == "finance_receipt" else f"'{n}'")
    for n, (need, words) in fv.SCENARIO_KEYWORDS.items())


@query("X14_scenarios", f"""SELECT CASE {SCEN} ELSE 'general_document' END AS scenario, count(*) AS docs FROM
    (SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN ' Invoice tax' WHEN 1 THEN ' CONTRACT agreement' WHEN 2 THEN ' tracking express' WHEN 3 THEN ' 配料 成分' ELSE '' END AS text FROM documents) GROUP BY 1""")
def scenarios(spark, d):
    docs = v.table(spark, d, "documents").select("doc_id", F.concat(
        "text", v.pick(F.col("doc_id") % 5, [" Invoice tax", " CONTRACT agreement", " tracking express", " 配料 成分", ""])).alias("text"))
    return ops.scenarios(docs).groupBy("scenario").agg(F.count("*").alias("docs"))


#: What the other engine cannot state, look-around, restated for the twin: the neighbours are taken into the match. The words that may not
#: follow a quantity or a date are Han ones, which no document holds after one; a digit after it is restated.
RESTATED = [("(?=\\n\\s*(?:", "(?:\\n\\s*(?:"), ("(?:^|(?<!\\d)(?<![每]))(", "(?:^|[^\\d每])("), ("(?<!\\d)(\\d{4}", "(?:^|\\D)(\\d{4}"),
            ("(?!\\s*(?:千焦|蛋白质|脂肪|碳水|钠|能量|膳食纤维|反式|营养|参考值|\\d|米|克|毫克|微克))", "(?:\\s*[^\\s\\d]|\\s*\\z)"),
            ("(?!\\s*(?:千焦|蛋白质|脂肪|碳水|钠|能量|克|毫升))", ""), ("(?<![一-龥])(", "(?:^|[^一-龥])("), ("(?![一-龥])", "(?:[^一-龥]|\\z)"), ("(?<![每])(", "(?:^|[^每])(")]


def restated(pattern: str) -> str:
    for old, new in RESTATED:
        pattern = pattern.replace(old, new)
    assert not any(x in pattern for x in ("(?<", "(?=", "(?!")), pattern
    return pattern


BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(12288) || chr(160)"


def found_sql(text: str, pattern: str, group: int = 1, flags: str = "") -> str:
    return f"nullif(trim(regexp_extract({text}, '{flags}{restated(pattern)}', {group}), {BLANKS}), '')"


RULES = ", ".join("coalesce(" + ", ".join(found_sql("text", p, 1, "(?im)") for p in ps) + f") AS {f}" for f, ps in fv.FIELD_RULES.items())
BAND = ("CASE WHEN filled_key / 6.0 >= 0.8 THEN 'high' WHEN filled_key / 6.0 >= 0.4 THEN 'medium' WHEN filled_key > 0 THEN 'low' ELSE 'failed' END AS band")
FILLED = " + ".join(f"CAST({f} IS NOT NULL AS INT)" for f in fv.KEY_FIELDS)
LABELLED = """ || chr(10) || CASE doc_id % 3 WHEN 0 THEN 'Brand: Acme' || doc_id || chr(10) || 'Net Weight: 500 g' || chr(10) || 'Shelf Life: 12 months'
    WHEN 1 THEN 'Product Name: Oat Milk' || chr(10) || 'Production Date: 2025/1/' || (doc_id % 28 + 1) || chr(10) || 'Manufacturer: Foo Bar Inc.' || chr(10) || 'LOT No: AB12' || doc_id ELSE '' END"""


@query("X11_extract_latin", f"""WITH x AS (SELECT doc_id, {RULES} FROM (SELECT doc_id, text{LABELLED} AS text FROM documents)),
  y AS (SELECT *, {FILLED} AS filled_key FROM x)
  SELECT doc_id, {', '.join(fv.FIELD_RULES)}, {BAND} FROM y""")
def extract_latin(spark, d):
    return ops.extract_fields(labelled(spark, d), ops.all_rules()).select("doc_id", *fv.FIELD_RULES, "band")


def labelled(spark, d):
    i = F.col("doc_id")
    extra = (F.when(i % 3 == 0, F.concat(F.lit("Brand: Acme"), i.cast("string"), F.lit("\nNet Weight: 500 g\nShelf Life: 12 months")))
             .when(i % 3 == 1, F.concat(F.lit("Product Name: Oat Milk\nProduction Date: 2025/1/"), (i % 28 + 1).cast("string"),
                                        F.lit("\nManufacturer: Foo Bar Inc.\nLOT No: AB12"), i.cast("string"))).otherwise(""))
    docs = spread_scan(v.table(spark, d, "documents").select("doc_id", "source", "text"), "doc_id")
    return docs.select("doc_id", "source", F.concat("text", F.lit("\n"), extra).alias("text"))


@query("X11_fill_rate", f"""WITH x AS (SELECT source, {RULES} FROM (SELECT source, text{LABELLED} AS text FROM documents)),
  y AS (SELECT *, {FILLED} AS filled_key FROM x)
  SELECT source, {BAND}, count(*) AS docs, {', '.join(f'count({f}) AS {f}' for f in fv.FIELD_RULES)} FROM y GROUP BY 1, 2""")
def fill_rate(spark, d):
    rules = ops.all_rules()
    out = ops.extract_fields(labelled(spark, d), rules)
    return out.groupBy("source", "band").agg(F.count("*").alias("docs"), *[F.count(f).alias(f) for f in rules])


def first_sql(column: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}') THEN '{n}'" for p, n in rules) + " END"


#: Package lines that follow the documents' own: names without labels, one label beside them, labels with gaps, nothing.
PACKAGE_LINES = [
    "NIVEA妮维雅 温和\n温和沐浴露\n水 甘油 Aloe  Vera\n无酒精 无香料\n++ 长久保湿不油腻\n温和不刺激配方\n每100 g 含水\n不刺激配方\n净含量：500ml",
    "净含量：5克\n妙洁\n厨房湿巾\n+J 去污除菌真方便\nGlycerin, panthenol\n80 片",
    "品牌：海天\n生产日期：2025年3月4日\n草菇老抽酱油\n水 苯甲酸钠\n1.9L",
    "",
]


def packaged(spark, d):
    """Documents with package lines: before their own where ``doc_id % 8`` is under 4, so that places in the text count, else after."""
    docs = spread_scan(v.table(spark, d, "documents").select("doc_id", "source", "text"), "doc_id")
    own, lines = F.col("text"), v.pick(F.col("doc_id") % 4, PACKAGE_LINES)
    return docs.withColumn("text", F.when(F.col("doc_id") % 8 < 4, F.concat(lines, F.lit("\n"), own)).otherwise(F.concat(own, F.lit("\n"), lines)))


def alternatives(column: str, patterns, flags: str = "") -> str:
    return "coalesce(" + ", ".join(found_sql(column, p, 1, flags) for p in patterns) + ")"


def head_free(line: str) -> str:
    for p in fv.FREE_NOISE_HEADS:
        line = f"trim(regexp_replace({line}, '{p}', ''), {BLANKS})"
    return line


ALIKE = "coalesce(contains({0}, {1}) OR contains({1}, {0}), false)"
FIRST_LIST = "(CASE WHEN len({0}) > 0 THEN array_to_string(({0})[:" + str(fv.FREE_LISTED) + "], '，') END)"
PACKAGE_TEXT = """package AS (SELECT doc_id, source, CASE WHEN doc_id % 8 < 4 THEN lines || chr(10) || text ELSE text || chr(10) || lines END AS text
    FROM (SELECT doc_id, source, text, ([""" + ", ".join("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in PACKAGE_LINES) + """])[doc_id % 4 + 1] AS lines FROM documents))"""
FREE_SQL = PACKAGE_TEXT + f""", l AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {BLANKS})), lambda x: x <> '') AS lines FROM package),
  b AS (SELECT *, array_to_string(lines, '') AS joined, coalesce(
      list_filter(flatten(list_transform(lines, lambda x: [{', '.join(found_sql('x', p) for p in fv.MIXED_BRAND)}])), lambda x: x IS NOT NULL)[1],
      list_filter(list_transform(lines, lambda x: regexp_replace(x, '{fv.HAN_BRAND_CUT.replace("'", "''")}', '', 'g')), lambda x: regexp_matches(x, '^[一-龥]{{2,6}}$') AND NOT regexp_matches(x, '{fv.HAN_BRAND_BARRED}'))[1],
      list_filter(lines[:3], lambda x: regexp_matches(x, '{fv.LATIN_BRAND}'))[1]) AS free_brand FROM l),
  t AS (SELECT *, {first_sql('joined', fv.PRODUCT_TYPES)} AS free_product_type, coalesce({', '.join(f"nullif(regexp_extract(coalesce(lines[1], ''), '{p}'), '')" for p, _ in fv.PRODUCT_TYPES)}) AS word FROM b),
  n AS (SELECT *, CASE WHEN trim(split_part(lines[1], word, 1), {BLANKS}) <> '' THEN trim(split_part(lines[1], word, 1), {BLANKS}) || word
      ELSE coalesce(free_brand, '') || free_product_type END AS free_product_name FROM t),
  k AS (SELECT *, list_filter(list_transform(list_filter(lines, lambda x: NOT regexp_matches(x, '(?i)^(?:{'|'.join(fv.FREE_NOISE_LINES)})')), lambda x: {head_free('x')}),
      lambda x: len(x) >= {fv.FREE_LEAST_FEATURE} AND regexp_matches(x, '[一-龥]') AND NOT {ALIKE.format('x', 'free_brand')} AND NOT {ALIKE.format('x', 'free_product_name')}) AS kept,
      flatten(list_transform(list_filter(lines, lambda x: NOT starts_with(x, '无')), lambda x: flatten([{', '.join(f"regexp_extract_all(x, '(?i){p}')" for p in fv.FREE_INGREDIENTS)}]))) AS named FROM n),
  free AS (SELECT *, {FIRST_LIST.format("list_transform(list_filter(range(1, len(named) + 1), lambda i: list_position(named, named[i]) = i), lambda i: named[i])")} AS free_ingredients,
      {FIRST_LIST.format(f"list_reduce(list_concat([CAST([] AS VARCHAR[])], list_transform(kept, lambda x: [x])), lambda have, x: CASE WHEN len(have) >= {fv.FREE_LISTED} OR len(list_filter(have, lambda h: {ALIKE.format('h', 'x[1]')})) > 0 THEN have ELSE list_concat(have, x) END)")} AS free_features,
      {alternatives('joined', fv.FREE_SPECIFICATION)} AS free_specification FROM k)"""


@query("X11_free_form", "WITH " + FREE_SQL + f" SELECT doc_id, {', '.join('free_' + f for f in free_form.FREE)} FROM free")
def free_form_fields(spark, d):
    return free_form.free_form_fields(packaged(spark, d)).select("doc_id", *[f"free_{f}" for f in free_form.FREE])


def settled_sql() -> str:
    few = "(" + " + ".join(f"CAST({f} IS NOT NULL AS INT)" for f in fv.FIELD_RULES) + ") <= 1"
    any_free = "coalesce(" + ", ".join(f"free_{f}" for f in free_form.FREE) + ") IS NOT NULL"
    own = "coalesce(" + ", ".join(fv.FIELD_RULES) + ") IS NOT NULL"
    gaps = " OR ".join(f"({f} IS NULL AND free_{f} IS NOT NULL)" for f in fv.FILLED_FIELDS)
    value = {f: f"CASE WHEN {few} THEN coalesce({'free_' + f if f in free_form.FREE else 'NULL'}, {f}) ELSE " + (f"coalesce({f}, free_{f})" if f in fv.FILLED_FIELDS else f) + " END" for f in fv.FIELD_RULES}
    value |= {f: f"CASE WHEN {few} THEN free_{f} END" for f in free_form.FREE if f not in fv.FIELD_RULES}
    return f"""{FREE_SQL}, x AS (SELECT *, {RULES} FROM free),
  z AS (SELECT doc_id, source, CASE WHEN {few} THEN CASE WHEN {any_free} THEN 'free' WHEN {own} THEN 'labels' ELSE 'none' END WHEN {gaps} THEN 'both' ELSE 'labels' END AS layer,
      {', '.join(f'{e} AS {f}' for f, e in value.items())} FROM x),
  settled AS (SELECT *, {BAND} FROM (SELECT *, {FILLED} AS filled_key FROM z))"""


SETTLED = settled_sql()
OUTPUT = (*fv.FIELD_RULES, *[f for f in free_form.FREE if f not in fv.FIELD_RULES])


@query("X11_settled_fields", "WITH " + SETTLED + f" SELECT doc_id, layer, {', '.join(OUTPUT)}, band FROM settled")
def settled_fields(spark, d):
    return free_form.settled_fields(packaged(spark, d)).select("doc_id", "layer", *OUTPUT, "band")


@query("X11_layer_fill", "WITH " + SETTLED + f" SELECT layer, count(*) AS docs, {', '.join(f'count({f}) AS {f}' for f in OUTPUT)} FROM settled GROUP BY 1")
def layer_fill(spark, d):
    return free_form.layer_fill(free_form.settled_fields(packaged(spark, d)), fv.FIELD_RULES)


@query("X23_product_types", f"""SELECT {first_sql('text', fv.PRODUCT_TYPES)} AS product_type, {first_sql('ingredients', fv.INFERRED_TYPES)} AS inferred_type, count(*) AS docs
  FROM (SELECT text || ([' 纯牛奶', ' 洗衣液', ' 挂面', ''])[doc_id % 4 + 1] AS text, lower((['小麦', '甘油', '中药'])[doc_id % 3 + 1]) AS ingredients FROM documents) GROUP BY 1, 2""")
def product_types(spark, d):
    docs = v.table(spark, d, "documents").select("doc_id", F.concat("text", v.pick(F.col("doc_id") % 4, [" 纯牛奶", " 洗衣液", " 挂面", ""])).alias("text"),
                                                 v.pick(F.col("doc_id") % 3, ["小麦", "甘油", "中药"]).alias("ingredients"))
    return ops.product_types(docs).groupBy("product_type", "inferred_type").agg(F.count("*").alias("docs"))


READ = """readings AS (SELECT doc_id, field, 'first' AS engine, value AS text, coalesce(conf, 0.7::DOUBLE) - 0.3::DOUBLE AS confidence FROM ocr UNION ALL
    SELECT doc_id, field, 'second', value, coalesce(conf, 0.7::DOUBLE) - 0.3::DOUBLE FROM vl UNION ALL
    SELECT doc_id, field, 'third', CASE WHEN doc_id % 4 = 1 THEN '' ELSE value END, 0.35::DOUBLE FROM part_fields)"""


def readings(spark, d):
    ocr, vl = v.channels(spark, d)
    part = v.table(spark, d, "part").select("p_partkey", "p_brand", "p_name", "p_size", "p_type")
    third = part.select(F.col("p_partkey").alias("doc_id"), F.expr("stack(4, 'brand', p_brand, 'product_name', p_name, 'specification', concat(cast(p_size as string), 'ml'), 'package_type', p_type) AS (field, text)"))
    def channel(df, name):
        """Confidences are lowered by .3 so that they fall on both sides of the floors; a missing one counts as .7."""
        return df.select("doc_id", "field", F.lit(name).alias("engine"), F.col("value").alias("text"), (F.coalesce("conf", F.lit(0.7)) - 0.3).alias("confidence"))

    # The third engine reads nothing in every fourth document.
    seen = F.when(F.col("doc_id") % 4 == 1, "").otherwise(F.col("text"))
    return channel(ocr, "first").unionByName(channel(vl, "second")).unionByName(
        third.select("doc_id", "field", F.lit("third").alias("engine"), seen.alias("text"), F.lit(0.35).alias("confidence")))


@query("W07_best_reading", "WITH " + READ + """ SELECT doc_id, field, arg_max(engine, (confidence, engine)) AS most_confident,
    arg_max(engine, (confidence * length(text), engine)) AS largest_mass FROM readings GROUP BY 1, 2""")
def best_reading(spark, d):
    return ops.best_reading(readings(spark, d), ["doc_id", "field"])


@query("W08_engine_precedence", "WITH " + READ + """, w AS (SELECT doc_id, field, max(text) FILTER (engine = 'first') AS t1, max(confidence) FILTER (engine = 'first') AS c1,
    max(text) FILTER (engine = 'second') AS t2, max(confidence) FILTER (engine = 'second') AS c2, max(text) FILTER (engine = 'third') AS t3, max(confidence) FILTER (engine = 'third') AS c3,
    arg_max(confidence, (confidence * length(text), engine)) FILTER (text <> '') AS hc,
    arg_max(engine, (confidence * length(text), engine)) FILTER (text <> '') AS he, arg_max(text, (confidence * length(text), engine)) FILTER (text <> '') AS ht FROM readings GROUP BY 1, 2)
  SELECT doc_id, field, CASE WHEN coalesce(c1 >= 0.4::DOUBLE, false) AND coalesce(c2 >= 0.5::DOUBLE, false) THEN 'first_fused' WHEN coalesce(c1 >= 0.4::DOUBLE, false) THEN 'first'
      WHEN coalesce(c2 >= 0.4::DOUBLE, false) THEN 'second' WHEN t3 <> '' THEN 'third' WHEN he IS NOT NULL THEN he || '_fallback' ELSE 'none' END AS source,
    CASE WHEN coalesce(c1 >= 0.4::DOUBLE, false) THEN CASE WHEN coalesce(c2 >= 0.5::DOUBLE, false) AND length(t2) > length(t1) * 1.3 THEN t1 || chr(10) || t2 ELSE t1 END
         WHEN coalesce(c2 >= 0.4::DOUBLE, false) THEN t2 WHEN t3 <> '' THEN t3 ELSE coalesce(ht, '') END AS text,
    ROUND(CASE WHEN coalesce(c1 >= 0.4::DOUBLE, false) THEN CASE WHEN coalesce(c2 >= 0.5::DOUBLE, false) THEN greatest(c1, c2) ELSE c1 END
         WHEN coalesce(c2 >= 0.4::DOUBLE, false) THEN c2 WHEN t3 <> '' THEN c3 ELSE coalesce(hc, 0) END, 6) AS confidence FROM w""")
def engine_precedence(spark, d):
    return ops.engine_precedence(readings(spark, d), ["doc_id", "field"]).withColumn("confidence", F.round("confidence", 6))


COMPARED = """compared AS (SELECT t.doc_id, t.field, t.category, CASE WHEN p.value IS NULL AND t.value IS NULL THEN 'both_null' WHEN p.value IS NULL OR t.value IS NULL THEN 'null_mismatch'
    WHEN lower(trim(p.value)) = lower(trim(t.value)) THEN 'exact' ELSE 'text_mismatch' END AS match_type
    FROM (SELECT doc_id, category, field, CASE WHEN (doc_id + i) % 5 = 0 AND doc_id % 2 = 0 THEN NULL ELSE value END AS value FROM part_fields) t
    LEFT JOIN vl p ON t.doc_id = p.doc_id AND t.field = p.field)"""


def compared(spark, d):
    i = F.expr("CASE field WHEN 'brand' THEN 0 WHEN 'product_name' THEN 1 WHEN 'specification' THEN 2 ELSE 3 END")
    part = v.table(spark, d, "part")
    truth = part.select(F.col("p_partkey").alias("doc_id"), F.col("p_type").alias("category"), F.expr(
        "stack(4, 'brand', p_brand, 'product_name', p_name, 'specification', concat(cast(p_size as string), 'ml'), 'package_type', p_type) AS (field, value)"))
    truth = truth.withColumn("value", F.when(((F.col("doc_id") + i) % 5 == 0) & (F.col("doc_id") % 2 == 0), None).otherwise(F.col("value")))
    vl = v.channels(spark, d)[1]
    predicted = vl.select("doc_id", F.when(F.col("field") == "package_type", F.concat(F.lit("category_info."), "field")).otherwise(F.col("field")).alias("field"), "value")
    return ops.compare_fields(truth, predicted)


@query("J03_compare_fields", "WITH " + COMPARED + " SELECT field, match_type, count(*) AS n FROM compared GROUP BY 1, 2")
def compare_fields(spark, d):
    return compared(spark, d).groupBy("field", "match_type").agg(F.count("*").alias("n"))


@query("A11_accuracy_report", "WITH " + COMPARED + """ SELECT CASE grouping_id(field, category, match_type) WHEN 3 THEN 'field' WHEN 5 THEN 'category' WHEN 6 THEN 'match_type' ELSE 'all' END AS scope,
    coalesce(field, category, match_type, 'all') AS name, count(*) AS total, count(*) FILTER (match_type IN ('exact', 'both_null')) AS matched,
    ROUND(count(*) FILTER (match_type IN ('exact', 'both_null'))::DOUBLE / count(*) * 100, 1) AS accuracy FROM compared GROUP BY GROUPING SETS ((field), (category), (match_type), ())""")
def accuracy_report(spark, d):
    return ops.accuracy_report(compared(spark, d))


@query("J01_score_cases", """WITH c AS (SELECT p_partkey AS case_id, p_size AS size, p_brand AS brand, p_retailprice AS price FROM part),
  s AS (SELECT case_id, CAST(size % 3 <> 0 AS INT) + CAST(price > 1000 AS INT) + 1 AS correct, 3 AS total FROM c)
  SELECT correct, count(*) AS cases, count(*) FILTER (correct / 3.0 >= 0.6) AS passed FROM s GROUP BY 1""")
def score_cases(spark, d):
    """Each part is one case: brand must be filled, size is missing for every third, price must be a positive number."""
    part = v.table(spark, d, "part").select("p_partkey", "p_size", "p_brand", "p_retailprice")
    rules = F.create_map(F.lit("brand"), F.lit("non-empty string"), F.lit("size"), F.lit("string"), F.lit("price"), F.lit("float > 0"))
    cases = part.select(F.col("p_partkey").alias("case_id"), F.lit(0.6).alias("accuracy_threshold"), rules.alias("expected_fields"))
    size = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_size").cast("string"))
    price = F.when(F.col("p_retailprice") > 1000, F.col("p_retailprice").cast("string")).otherwise("-1")
    results = part.select(F.col("p_partkey").alias("case_id"), F.create_map(F.lit("brand"), "p_brand", F.lit("size"), size, F.lit("price"), price).alias("structured_data"))
    out = ops.score_cases(cases, results)
    return out.groupBy("correct").agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"))


@query("A12_pass_rate", """WITH s AS (SELECT CAST(p_size % 3 <> 0 AS INT) + CAST(p_retailprice > 1000 AS INT) + 1 AS correct FROM part)
  SELECT count(*) AS total_cases, count(*) FILTER (correct / 3.0 >= 0.6) AS passed_cases, ROUND(count(*) FILTER (correct / 3.0 >= 0.6)::DOUBLE / count(*), 6) AS pass_rate, ROUND(avg(correct / 3.0::DOUBLE), 6) AS avg_accuracy FROM s""")
def pass_rate(spark, d):
    per = score_cases(spark, d)
    n = F.sum("cases")
    return per.agg(n.alias("total_cases"), F.sum("passed").alias("passed_cases"), F.round(F.sum("passed") / n, 6).alias("pass_rate"),
                   F.round(F.sum(F.col("cases") * (F.col("correct") / 3)) / n, 6).alias("avg_accuracy"))


def runs(spark, d):
    return v.table(spark, d, "documents").select(F.col("doc_id").alias("case_id"), F.col("source").alias("segment"), (F.col("n_chars") % 1000 / 10.0).alias("rate"))


RUNS = "runs AS (SELECT doc_id AS case_id, source AS segment, n_chars % 1000 / 10.0::DOUBLE AS rate FROM documents)"


@query("A14_robustness_report", "WITH " + RUNS + """ SELECT segment, count(*) AS runs, ROUND(avg(rate), 6) AS mean_rate, min(rate) AS min_rate, max(rate) AS max_rate,
    arg_max(case_id, (rate, -case_id)) AS best_case, arg_min(case_id, (rate, case_id)) AS worst_case FROM runs GROUP BY 1""")
def robustness_report(spark, d):
    return ops.robustness_report(runs(spark, d)).withColumn("mean_rate", F.round("mean_rate", 6))


@query("A14_rate_totals", "WITH " + RUNS + " SELECT count(*) AS runs, ROUND(avg(rate), 6) AS mean_rate, median(rate) AS median_rate FROM runs")
def rate_totals(spark, d):
    return ops.rate_totals(runs(spark, d)).withColumn("mean_rate", F.round("mean_rate", 6))


@query("A15_engine_comparison", """WITH f AS (SELECT category, doc_id, 'ocr' AS engine, count(*) AS fields FROM ocr GROUP BY 1, 2 UNION ALL SELECT category, doc_id, 'vl', count(*) FROM vl GROUP BY 1, 2)
  SELECT category, ROUND(avg(fields) FILTER (engine = 'ocr'), 6) AS ocr, ROUND(avg(fields) FILTER (engine = 'vl'), 6) AS vl,
    ROUND(avg(fields) FILTER (engine = 'ocr') - avg(fields) FILTER (engine = 'vl'), 6) AS advantage FROM f GROUP BY 1""")
def engine_comparison(spark, d):
    ocr, vl = v.channels(spark, d)
    found = ocr.withColumn("engine", F.lit("ocr")).unionByName(vl.withColumn("engine", F.lit("vl")))
    found = found.groupBy("category", "doc_id", "engine").agg(F.count("*").alias("fields"))
    out = ops.engine_comparison(found, ["ocr", "vl"])
    return out.select("category", *[F.round(c, 6).alias(c) for c in ("ocr", "vl", "advantage")])


@query("S06_remaining_sample", """SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND lang = 'en' ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 50""")
def remaining_sample(spark, d):
    docs = v.table(spark, d, "documents").select("doc_id", "lang")
    return ops.remaining_items(docs, v.table(spark, d, "labels"), "doc_id", F.col("lang") == "en", 50).select("doc_id")


@query("E05_unlabelled", "SELECT source, count(*) AS docs FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1")
def unlabelled(spark, d):
    docs = v.table(spark, d, "documents").select("doc_id", "source")
    return ops.remaining_items(docs, v.table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.count("*").alias("docs"))
