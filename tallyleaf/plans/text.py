"""Registered corpus queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyleaf import fixed_values as fv
from tallyleaf.functions import text as tx
from tallyleaf.operators import text as ops
from tallyleaf.operators.scale import spread_scan
from tallyleaf.plans.registry import query
from tallyleaf.sources import views as v

B = "[\\s　 ]"


def docs(spark, d, *extra):
    return spread_scan(v.table(spark, d, "documents").select("doc_id", "text", *extra), "doc_id")


def q(s: str) -> str:
    return s.replace("'", "''")


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{B}+|{B}+$', '', 'g')"


def correct_sql(x: str) -> str:
    """The line corrections as nested calls; look-around becomes captured borders, applied twice."""
    out = x
    for wrong, right in fv.LATIN_CORRECTIONS.items():
        for _ in range(2):
            out = f"regexp_replace({out}, '(^|[^\\p{{L}}\\p{{N}}_]){wrong}($|[^\\p{{L}}\\p{{N}}_])', '\\1{right}\\2', 'g')"
    for wrong, right in fv.CJK_CORRECTIONS.items():
        out = f"replace({out}, '{wrong}', '{right}')"
    return out


def digits_sql(x: str) -> str:
    out = x
    for letter, digit in fv.DIGIT_SWAPS.items():
        out = f"regexp_replace({out}, '([0-9]){letter}', '\\1{digit}', 'g')"
        out = f"regexp_replace({out}, '{letter}([0-9])', '{digit}\\1', 'g')"
    return out


# Corrections run on the whole text (they never cross a line), then line by line.
KEPT_SQL = f"""trimmed AS (SELECT doc_id, len(string_split(text, chr(10))) AS lines_in,
      list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '') AS l FROM documents),
  uniq AS (SELECT doc_id, lines_in, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM trimmed),
  kept AS (SELECT doc_id, lines_in, list_filter(l, lambda x: NOT regexp_matches(x, '{q(fv.NOISE_LINES)}')
      AND (length(x) > 2 OR regexp_matches(x, '[一-鿿]'))) AS l FROM uniq)"""
FIXED_SQL = KEPT_SQL + f""", corrected AS (SELECT doc_id, lines_in, l, string_split({correct_sql("array_to_string(l, chr(10))")}, chr(10)) AS c FROM kept),
  fixed AS (SELECT doc_id, lines_in, l, CASE WHEN len(l) = 0 THEN [] ELSE list_transform(c, lambda x: regexp_replace(CASE WHEN regexp_matches(x, '[0-9]{{2,}}')
      THEN {digits_sql('x')} ELSE x END, '{B}{{2,}}', ' ', 'g')) END AS f FROM corrected)"""


@query("X01_clean_corpus", "WITH " + FIXED_SQL + f""" SELECT doc_id, lines_in, len(list_filter(f, lambda x: {strip_sql('x')} <> '')) AS lines_out,
    len(list_filter(list_zip(l, f), lambda p: p[1] <> p[2])) AS lines_changed,
    md5(array_to_string(list_filter(f, lambda x: {strip_sql('x')} <> ''), chr(10))) AS clean_md5 FROM fixed""")
def clean_corpus(spark, d):
    return ops.clean_corpus(docs(spark, d)).select(
        "doc_id", "lines_in", "lines_out", "lines_changed", F.md5("clean_text").alias("clean_md5"))


@query("X19_line_changes", "WITH " + FIXED_SQL + """, pairs AS (SELECT doc_id, unnest(range(0, len(l))) AS line_no, unnest(l) AS a, unnest(f) AS b FROM fixed)
    SELECT doc_id, line_no, a AS original, b AS corrected FROM pairs WHERE a <> b""")
def line_changes(spark, d):
    kept = docs(spark, d).select("doc_id", tx.kept_lines(F.col("text")).alias("k"))
    pairs = kept.select("doc_id", F.array_join("k", "\n").alias("before"),
                        F.array_join(F.transform("k", tx.correct_line), "\n").alias("after"))
    return ops.line_changes(pairs, "before", "after")


def iso_sql(x: str) -> str:
    forms = ["([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日()", "([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})($|[^0-9])",
             "([0-9]{4})\\.([0-9]{1,2})\\.([0-9]{1,2})($|[^0-9])", "([0-9]{4})([0-9]{2})([0-9]{2})($|[^0-9])"]
    for form in forms:
        for _ in range(2):
            x = f"regexp_replace({x}, '(^|[^0-9]){form}', '\\1\\2' || chr(1) || '0\\3' || chr(1) || '0\\4\\5', 'g')"
    return f"replace(regexp_replace({x}, chr(1) || '0([0-9]{{2}})', '-\\1', 'g'), chr(1), '-')"


def terms_sql(x: str) -> str:
    x = f"replace({x}, '生产曰期', '生产日期')"
    x = f"regexp_replace({x}, '(^|[^有])效期', '\\1有效期', 'g')"
    x = f"replace({x}, '保质期', '有效期')"
    x = f"regexp_replace({x}, '产品名($|[^称])', '产品名称\\1', 'g')"
    return f"replace({x}, '规恪', '规格')"


TIDY = "array_to_string(list_transform(string_split(dates, chr(10)), lambda x: " + strip_sql("x") + "), chr(10))"


@query("X02_normalise_corpus", f"""WITH s AS (SELECT doc_id, text, translate(text, '{fv.FULL_WIDTH}', '{fv.HALF_WIDTH}') AS w FROM documents),
  t AS (SELECT *, {terms_sql('w')} AS terms FROM s), u AS (SELECT *, {iso_sql('terms')} AS dates FROM t),
  x AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace({TIDY}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n\\n', chr(10)), '\\n+$', ''), ' +', ' ', 'g') AS tidy FROM u)
  SELECT doc_id, w <> text AS fixed_width, terms <> w AS fixed_terms, dates <> terms AS fixed_dates, tidy <> dates AS fixed_whitespace, md5(tidy) AS normal_md5 FROM x""")
def normalise_corpus(spark, d):
    """Without the thousands step, whose borders the other engine cannot state; that step is tested on its own."""
    t = docs(spark, d)
    text = F.col("text")
    w = tx.half_width(text)
    terms = tx.fix_terms(F.col("w"))
    return (
        t.withColumn("w", w).withColumn("terms", terms).withColumn("dates", tx.iso_dates(F.col("terms")))
        .withColumn("tidy", tx.tidy_whitespace(F.col("dates")))
        .select("doc_id", (F.col("w") != text).alias("fixed_width"), (F.col("terms") != F.col("w")).alias("fixed_terms"),
                (F.col("dates") != F.col("terms")).alias("fixed_dates"),
                (F.col("tidy") != F.col("dates")).alias("fixed_whitespace"), F.md5("tidy").alias("normal_md5")))


@query("X02_correction_kinds")
def correction_kinds(spark, d):
    """All five steps, documents corrected per kind and source."""
    out = ops.normalise_corpus(docs(spark, d, "source"))
    kinds = ["width", "terms", "dates", "thousands", "whitespace"]
    return out.groupBy("source").agg(*[F.count_if(f"fixed_{k}").alias(k) for k in kinds])


SCRIPTS = ", ".join(f"len(regexp_extract_all(text, '{p}')) AS n_{k}" for k, p in fv.SCRIPT_RANGES.items())
BEST = "greatest(" + ", ".join(f"n_{k}" for k in fv.SCRIPT_RANGES) + ")"
DETECT = "CASE WHEN best = 0 THEN 'en' " + " ".join(
    ("WHEN n_zh = best AND n_ja::DOUBLE / total_chars > 0.15 THEN 'ja' WHEN n_zh = best AND n_ko::DOUBLE / total_chars > 0.1 THEN 'ko' "
     if k == "zh" else "") + f"WHEN n_{k} = best THEN '{k}'" for k in fv.SCRIPT_RANGES) + " END"
PROFILE = f"""counted AS (SELECT doc_id, lang, source, text, length({strip_sql('text')}) AS total_chars, {SCRIPTS} FROM documents),
  profile AS (SELECT *, {DETECT} AS detected FROM (SELECT *, {BEST} AS best FROM counted))"""


@query("A35_script_profile", "WITH " + PROFILE + " SELECT doc_id, total_chars, n_zh, n_de, n_fr, n_en, detected FROM profile")
def script_profile(spark, d):
    return ops.script_profile(docs(spark, d)).select("doc_id", "total_chars", "n_zh", "n_de", "n_fr", "n_en", "detected")


@query("A35_language_confusion", "WITH " + PROFILE + " SELECT lang, detected, count(*) AS docs FROM profile GROUP BY 1, 2")
def language_confusion(spark, d):
    return ops.language_confusion(ops.script_profile(docs(spark, d, "lang")))


CLEAN = strip_sql("text")


@query("A36_text_quality", "WITH " + PROFILE + f""", scored AS (SELECT *, CASE WHEN total_chars < 5 THEN 0.0::DOUBLE ELSE ROUND(least(1.0::DOUBLE,
    len(regexp_extract_all({CLEAN}, CASE WHEN detected IN ('zh', 'ja') THEN '[一-鿿぀-ゟ゠-ヿ]' WHEN detected = 'ko' THEN '[가-힯]'
      WHEN detected = 'en' THEN '[a-zA-Z0-9\\s]' ELSE '[a-zA-Z0-9À-ɏ\\s]' END))::DOUBLE / total_chars * (CASE WHEN detected IN ('zh', 'ja', 'ko') THEN 1.5::DOUBLE ELSE 1.2::DOUBLE END)), 3) END AS quality FROM profile)
  SELECT source, count(*) AS docs, ROUND(avg(quality), 6) AS quality, ROUND(avg(least(1.0::DOUBLE, (doc_id % 100) / 100.0::DOUBLE * 0.6::DOUBLE + quality * 0.4::DOUBLE)), 6) AS blended
  FROM scored GROUP BY 1""")
def text_quality(spark, d):
    scored = ops.text_quality(ops.script_profile(docs(spark, d, "source")), (F.col("doc_id") % 100) / 100.0)
    return scored.groupBy("source").agg(
        F.count("*").alias("docs"), F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("blended"), 6).alias("blended"))


def border(p: str) -> str:
    """Digit look-around as consumed borders, enough for an existence test."""
    return p.replace("(?<!\\d)", "(?:^|[^0-9])").replace("(?!\\d)", "(?:$|[^0-9])")


DETECTS = ", ".join(f"CASE WHEN regexp_matches(text, '(?i){q(border(p))}') THEN '{n}' END" for n, p in fv.SENSITIVE_PATTERNS.items())
FOUND = f"found AS (SELECT doc_id, source, list_filter([{DETECTS}], lambda x: x IS NOT NULL) AS types FROM documents)"


@query("A38_sensitive_inventory", "WITH " + FOUND + " SELECT source, type, count(*) AS docs FROM (SELECT source, unnest(types) AS type FROM found) GROUP BY 1, 2")
def sensitive_inventory(spark, d):
    return ops.sensitive_inventory(docs(spark, d, "source"), ["source"])


@query("A38_unsafe_share", "WITH " + FOUND + """ SELECT source, count(*) AS docs, count(*) FILTER (len(types) > 0) AS unsafe,
    ROUND(count(*) FILTER (len(types) > 0) / count(*)::DOUBLE, 6) AS unsafe_share FROM found GROUP BY 1""")
def unsafe_share(spark, d):
    return ops.unsafe_share(docs(spark, d, "source"), ["source"]).withColumn("unsafe_share", F.round("unsafe_share", 6))


def leak_sql(path, column, table):
    checks = ", ".join(f"CASE WHEN regexp_matches({column}, '(?i){q(border(p))}') THEN '{n}' END" for n, p in fv.SENSITIVE_PATTERNS.items())
    return f"SELECT 'root.{path}' AS path, unnest(list_filter([{checks}], lambda x: x IS NOT NULL)) AS type FROM {table}"


@query("A38_leak_paths", "SELECT path, type, count(*) AS rows FROM (" + " UNION ALL ".join(
    [leak_sql("source", "source", "documents"), leak_sql("body.text", "text", "documents"), leak_sql("body.lang", "lang", "documents")]) + ") GROUP BY 1, 2")
def leak_paths(spark, d):
    nested = docs(spark, d, "lang", "source").select("doc_id", "source", F.struct("text", "lang").alias("body"))
    return ops.leak_paths(nested)


def full_mask_sql(x: str) -> str:
    for name, p in fv.SENSITIVE_PATTERNS.items():
        if "(?<!" in p:
            inner = p.replace("(?<!\\d)", "").replace("(?!\\d)", "")
            for _ in range(2):
                x = (f"regexp_replace({x}, '(?i)(^|[^0-9])(?:{q(inner)})($|[^0-9])', "
                     f"'\\1***{name}已脱敏***\\{border_group(inner)}', 'g')")
        else:
            x = f"regexp_replace({x}, '(?i){q(p)}', '***{name}已脱敏***', 'g')"
    return x


def border_group(inner: str) -> int:
    """Number of the closing border's group: one opening border plus the capturing groups inside."""
    inside = inner.replace("(?:", "").count("(") - inner.replace("(?:", "").count("\\(")
    return 2 + inside


@query("X15_full_mask", f"SELECT doc_id, md5({full_mask_sql('text')}) AS masked_md5 FROM documents")
def full_mask(spark, d):
    return docs(spark, d).select("doc_id", F.md5(tx.mask_text(F.col("text"), "full")).alias("masked_md5"))


@query("X15_partial_mask")
def partial_mask(spark, d):
    out = ops.mask_corpus(docs(spark, d, "source"), "partial")
    return out.groupBy("source").agg(
        F.count_if(F.col("types_before") > 0).alias("before"), F.count_if(F.col("types_after") > 0).alias("after"),
        F.count_if(F.col("masked") != F.col("text")).alias("changed"))


@query("X15_nested_mask")
def nested_mask(spark, d):
    nested = docs(spark, d, "lang", "source").select("doc_id", F.struct("text", "lang").alias("body"), F.array("source").alias("tags"))
    out = ops.mask_table(nested, "hash")
    return out.select("doc_id", F.md5("body.text").alias("masked_md5"), "body.lang", F.col("tags")[0].alias("tag"))


TRIMMED = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '')"


@query("W17_recurring_lines", f"""WITH l AS (SELECT doc_id, unnest(list_distinct({TRIMMED})) AS line FROM documents)
    SELECT md5(line) AS line_md5, count(*) AS docs FROM l GROUP BY 1 HAVING count(*) >= 3""")
def recurring_lines(spark, d):
    return ops.recurring_lines(docs(spark, d), 3).select(F.md5("line").alias("line_md5"), "docs")


@query("W17_unique_lines", "WITH " + KEPT_SQL + " SELECT doc_id, lines_in - len(l) AS lines_removed, md5(array_to_string(l, chr(10))) AS unique_md5 FROM kept")
def unique_lines(spark, d):
    return ops.unique_lines(docs(spark, d)).select("doc_id", "lines_removed", F.md5("unique_text").alias("unique_md5"))


@query("X17_content_groups", """SELECT sha256(text) AS content_key, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1""")
def content_groups(spark, d):
    return ops.content_groups(docs(spark, d), F.col("text"))


@query("X17_short_keys", "SELECT page_id, substr(md5(url), 1, 12) AS url_key FROM pages")
def short_keys(spark, d):
    return v.table(spark, d, "pages").select("page_id", ops.short_key(F.col("url")).alias("url_key"))


@query("X18_salvage_json", """SELECT form, count(*) AS replies, count(*) FILTER (form = 'broken') AS failed, CAST(coalesce(sum(CASE WHEN form <> 'broken' THEN k END), 0) AS BIGINT) AS k_total
    FROM (SELECT (['fenced', 'prose', 'broken', 'plain'])[event_id % 4 + 1] AS form, k FROM ev) GROUP BY 1""")
def salvage_json(spark, d):
    e = v.table(spark, d, "events").select("event_id", "props")
    form = F.col("event_id") % 4
    text = (F.when(form == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
            .when(form == 1, F.concat(F.lit("The result is "), "props", F.lit(" as asked.")))
            .when(form == 2, F.concat(F.lit("{ broken "), F.substring("props", 2, 6))).otherwise(F.col("props")))
    out = ops.salvage_json(e.select(v.pick(form, ["fenced", "prose", "broken", "plain"]).alias("form"), text.alias("text")))
    k = F.try_variant_get("parsed", "$.k", "bigint")
    return out.groupBy("form").agg(F.count("*").alias("replies"), F.count_if("failed").alias("failed"),
                                   F.coalesce(F.sum(k), F.lit(0)).alias("k_total"))


@query("X20_markdown_to_text", f"""SELECT doc_id, md5({strip_sql("regexp_replace(regexp_replace(text, '[#*_~`>|\\[\\]()\\-]', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")}) AS plain_md5 FROM documents""")
def markdown_to_text(spark, d):
    return docs(spark, d).select("doc_id", F.md5(ops.markdown_to_text(F.col("text"))).alias("plain_md5"))


HTML_SQL = strip_sql("""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<(script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->', '', 'g'), '(?i)<(?:br|/p|/li|/h[1-6]|/div|/tr|/ul)[^>]*>', chr(10), 'g'),
    '<[^>]+>', '', 'g'), '[ \t]+', ' ', 'g'), '\\s*\\n\\s*', chr(10), 'g')""")


@query("X20_html_to_text", f"SELECT page_id, md5({HTML_SQL}) AS text_md5, length({HTML_SQL}) AS n_chars FROM pages")
def html_to_text(spark, d):
    p = spread_scan(v.table(spark, d, "pages").select("page_id", "html"), "page_id").select("page_id", ops.html_to_text(F.col("html")).alias("t"))
    return p.select("page_id", F.md5("t").alias("text_md5"), F.length("t").alias("n_chars"))


@query("X20_list_items", """SELECT tag, count(*) AS items, count(DISTINCT page_id) AS pages FROM
    (SELECT page_id, lower(unnest(regexp_extract_all(html, '(?is)<(li|h[1-6])(?:\\s[^>]*)?>', 1))) AS tag FROM pages) GROUP BY 1""")
def list_items(spark, d):
    return ops.list_items(v.table(spark, d, "pages"))


@query("X20_html_tables", """WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<(/?)ul[^>]*>', '<\\1table>', 'g'), '(?i)<(/?)li[^>]*>', '<\\1tr>', 'g'),
      '(?i)<a [^>]*>', '<td>', 'g'), '(?i)</a>', '</td>', 'g') AS html FROM pages),
  t AS (SELECT page_id, unnest(range(0, len(b))) AS table_no, unnest(b) AS body FROM (SELECT page_id, regexp_extract_all(html, '(?is)<table[^>]*>(.*?)</table>', 1) AS b FROM p)),
  l AS (SELECT page_id, table_no, unnest(range(0, len(b))) AS row_no, unnest(b) AS body FROM (SELECT page_id, table_no, regexp_extract_all(body, '(?is)<tr[^>]*>(.*?)</tr>', 1) AS b FROM t)),
  c AS (SELECT page_id, table_no, row_no, unnest(regexp_extract_all(body, '(?is)<t[dh][^>]*>(.*?)</t[dh]>', 1)) AS cell FROM l)
  SELECT page_id, CAST(table_no AS INTEGER) AS table_no, CAST(max(row_no) + 1 AS INTEGER) AS total_rows, count(*) FILTER (row_no = 0) AS total_cols, CAST(max(row_no) AS INTEGER) AS data_rows,
    count(*) AS total_cells FROM c GROUP BY 1, 2""")
def html_tables(spark, d):
    """Table statistics over each page's list rendered as a table, because the pages hold no table element."""
    p = v.table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace(
        "html", r"(?i)<(/?)ul[^>]*>", "<$1table>"), r"(?i)<(/?)li[^>]*>", "<$1tr>").alias("html"))
    p = p.withColumn("html", F.regexp_replace(F.regexp_replace("html", r"(?i)<a [^>]*>", "<td>"), "(?i)</a>", "</td>"))
    return ops.table_statistics(ops.html_tables(p))


ATTR = " UNION ALL ".join(
    f"SELECT '{k}' AS kind, unnest(regexp_extract_all(text, '{p}', {g})) AS value FROM documents" for k, p, g in [
        ("specification", "(?i)[0-9]+(?:ml|g|kg|L)", 0), ("specification", "(?i)[0-9]+\\*[0-9]+(?:ml|g|kg)", 0),
        ("capacity", "(?i)[0-9]+(?:ml|毫升|L|升)", 0), ("capacity", "(?i)[0-9]+(?:g|克|kg|千克)", 0),
        ("batch", "(?i)batch[:：]?([A-Za-z0-9]+)", 1), ("batch", "(?i)lot[:：]?([A-Za-z0-9]+)", 1), ("year", "(?:19|20)[0-9]{2}", 0)])


@query("X12_product_attributes", f"SELECT kind, value, count(*) AS found FROM ({ATTR}) GROUP BY 1, 2")
def product_attributes(spark, d):
    return ops.product_attributes(docs(spark, d), "text").groupBy("kind", "value").agg(F.count("*").alias("found"))


HARVEST = " UNION ALL ".join(f"SELECT '{k}' AS pattern, unnest(regexp_extract_all(text, '{p}')) AS value FROM documents"
                             for k, p in fv.HARVEST_PATTERNS.items())


@query("X24_harvest_identifiers", f"SELECT pattern, count(*) AS found, count(DISTINCT value) AS distinct_values FROM ({HARVEST}) GROUP BY 1")
def harvest_identifiers(spark, d):
    return ops.harvest_identifiers(docs(spark, d)).groupBy("pattern").agg(
        F.count("*").alias("found"), F.countDistinct("value").alias("distinct_values"))


IMG = ", ".join(f"'{e}'" for e in fv.IMAGE_EXTENSIONS)
DOC = ", ".join(f"'{e}'" for e in fv.DOCUMENT_EXTENSIONS)


@query("S03_route_urls", f"""WITH e AS (SELECT regexp_extract(lower(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', '')), '\\.([a-z0-9]+)(?:\\?|#|$)', 1) AS extension FROM pages)
    SELECT extension, CASE WHEN extension IN ({DOC}) THEN 'document' ELSE 'image' END AS input_type,
      CASE WHEN extension = '' THEN 0.5::DOUBLE WHEN extension IN ({DOC}, {IMG}) THEN 0.95::DOUBLE ELSE 0.3::DOUBLE END AS confidence, count(*) AS urls FROM e GROUP BY 1, 2, 3""")
def route_urls(spark, d):
    out = ops.route_urls(v.table(spark, d, "pages").select("url"))
    return out.groupBy("extension", "input_type", "confidence").agg(F.count("*").alias("urls"))


@query("P05_second_recognition", f"""WITH c AS (SELECT (doc_id * 7 % 100) / 100.0::DOUBLE AS conf, length({CLEAN}) AS n, len(regexp_extract_all(text, '[一-鿿]')) AS cjk FROM documents)
    SELECT coalesce(CASE WHEN conf < 0.75 THEN 'low_confidence' WHEN n < 10 THEN 'short_text' WHEN n > 20 AND cjk > 0 AND cjk::DOUBLE / n < 0.1 THEN 'garbled_cjk' END, 'none') AS reason, count(*) AS docs FROM c GROUP BY 1""")
def second_recognition(spark, d):
    rows = docs(spark, d).withColumn("confidence", (F.col("doc_id") * 7 % 100) / 100.0)
    return ops.second_recognition(rows).groupBy(F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("docs"))


KINDS = " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{k}'" for k, p in fv.LINE_KINDS)


@query("P08_line_kinds", f"SELECT CASE {KINDS} ELSE 'other' END AS kind, count(*) AS lines FROM doc_lines GROUP BY 1")
def line_kinds(spark, d):
    lines = docs(spark, d).select(F.explode(F.split("text", "\n")).alias("text"))
    return ops.line_kinds(lines).groupBy("kind").agg(F.count("*").alias("lines"))


HITS = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in
                 fv.LABEL_PATTERNS + [("mail", "@"), ("amount", "[0-9]+")])


@query("A16_label_hits", f"""WITH h AS (SELECT lang, list_filter([{HITS}], lambda x: x IS NOT NULL) AS labels FROM documents)
    SELECT lang, count(*) AS docs, CAST(sum(len(labels)) AS BIGINT) AS hits, ROUND(avg(len(labels)), 6) AS mean_hits,
      ROUND(avg(len(labels)) / 8, 6) AS fill_rate FROM h GROUP BY 1""")
def label_hits(spark, d):
    out = ops.label_hits(docs(spark, d, "lang"), fv.LABEL_PATTERNS + [("mail", "@"), ("amount", "[0-9]+")])
    mean = F.avg("n_labels")
    return out.groupBy("lang").agg(
        F.count("*").alias("docs"), F.sum("n_labels").alias("hits"), F.round(mean, 6).alias("mean_hits"),
        F.round(mean / F.max(ops.expected_label_count(F.col("lang"))), 6).alias("fill_rate"))


@query("X21_rearrange_nutrition")
def rearrange_nutrition(spark, d):
    """Nutrition sections in which labels and numbers stand on separate lines, built from each document's own lines."""
    rows = docs(spark, d).select("doc_id", F.concat(
        F.col("text"), F.lit("\nNutrition Facts\nProtein Fat\n"), (F.col("doc_id") % 90 + 10).cast("string"), F.lit(" "),
        (F.col("doc_id") % 80 + 10).cast("string"), F.lit("\nStorage: dry")).alias("text"))
    return ops.rearrange_nutrition(rows).select("doc_id", "rearranged", F.md5("table_text").alias("text_md5"))
