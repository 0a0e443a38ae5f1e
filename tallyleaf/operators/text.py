"""Corpus jobs over document, page and line tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyleaf import fixed_values as fv
from tallyleaf.functions import text as tx


def clean_corpus(docs: DataFrame) -> DataFrame:
    """Cleaned text of each document with the number of lines read, kept and changed. No shuffle."""
    lines = docs.withColumn("_kept", tx.kept_lines(F.col("text")))
    lines = lines.withColumn("_fixed", F.transform("_kept", tx.correct_line))
    changed = F.size(F.filter(F.zip_with("_kept", "_fixed", lambda a, b: a != b), lambda x: x))
    final = F.filter("_fixed", lambda x: tx.strip(x) != "")
    return lines.select(
        *docs.columns, F.array_join(final, "\n").alias("clean_text"),
        F.size(F.split("text", "\n")).alias("lines_in"), F.size(final).alias("lines_out"), changed.alias("lines_changed"))


def normalise_corpus(docs: DataFrame) -> DataFrame:
    """Half-width characters, term fixes, ISO dates, grouped thousands, tidy white space, with a flag per kind."""
    steps = [("width", tx.half_width), ("terms", tx.fix_terms), ("dates", tx.iso_dates),
             ("thousands", tx.group_thousands), ("whitespace", tx.tidy_whitespace)]
    out = docs.withColumn("_t0", F.col("text"))
    for i, (name, step) in enumerate(steps):
        out = out.withColumn(f"_t{i + 1}", step(F.col(f"_t{i}"))).withColumn(
            f"fixed_{name}", F.col(f"_t{i + 1}") != F.col(f"_t{i}"))
    return out.withColumn("normal_text", F.col(f"_t{len(steps)}")).drop(*[f"_t{i}" for i in range(len(steps) + 1)])


def script_profile(docs: DataFrame) -> DataFrame:
    """Characters per script and the dominant language of each document."""
    clean = tx.strip(F.col("text"))
    counts = tx.script_counts(F.col("text"))
    out = docs.withColumn("total_chars", F.length(clean))
    for lang, n in counts.items():
        out = out.withColumn(f"n_{lang}", n)
    named = {lang: F.col(f"n_{lang}") for lang in counts}
    return out.withColumn("detected", tx.dominant_language(named, F.col("total_chars")))


def language_confusion(profiled: DataFrame) -> DataFrame:
    """Declared language against detected language, in long form."""
    return profiled.groupBy("lang", "detected").agg(F.count("*").alias("docs"))


def text_quality(profiled: DataFrame, confidence: Column) -> DataFrame:
    """Quality by language and its 60/40 blend with the recognition confidence."""
    out = profiled.withColumn("quality", tx.language_quality(F.col("text"), F.col("detected")))
    return out.withColumn("blended", F.least(F.lit(1.0), confidence * 0.6 + F.col("quality") * 0.4))


def sensitive_inventory(docs: DataFrame, by: list[str]) -> DataFrame:
    """Documents per sensitive-data type. One pass of regexes per document, then a small aggregate."""
    found = docs.withColumn("type", F.explode(tx.detected_types(F.col("text"))))
    return found.groupBy(*by, "type").agg(F.count("*").alias("docs"))


def unsafe_share(docs: DataFrame, by: list[str]) -> DataFrame:
    unsafe = F.size(tx.detected_types(F.col("text"))) > 0
    return docs.groupBy(*by).agg(F.count("*").alias("docs"), F.count_if(unsafe).alias("unsafe")).withColumn(
        "unsafe_share", F.col("unsafe") / F.col("docs"))


def string_leaves(col: Column, dtype: T.DataType, path: Column) -> Column | None:
    """All strings of a nested value as an array of (path, text); None where the type holds none.

    Elements of an array have the path of their index, values of a map that of their key.
    """
    if isinstance(dtype, T.StringType):
        return F.array(F.struct(path.alias("path"), col.alias("text")))
    if isinstance(dtype, T.StructType):
        parts = [string_leaves(col[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in dtype.fields]
        parts = [p for p in parts if p is not None]
        return F.concat(*parts) if parts else None
    if isinstance(dtype, T.ArrayType):
        if string_leaves(F.lit(None), dtype.elementType, path) is None:
            return None
        found = F.transform(col, lambda x, i: string_leaves(x, dtype.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
    elif isinstance(dtype, T.MapType):
        if string_leaves(F.lit(None), dtype.valueType, path) is None:
            return None
        found = F.transform(F.map_entries(col), lambda e: string_leaves(
            e["value"], dtype.valueType, F.concat(path, F.lit("."), e["key"].cast("string"))))
    else:
        return None
    return F.coalesce(F.flatten(found), F.array().cast("array<struct<path: string, text: string>>"))


def leak_paths(df: DataFrame) -> DataFrame:
    """Rows per string path of a (nested) table that holds sensitive data, by type; arrays and maps are walked."""
    fields = [string_leaves(F.col(f"`{f.name}`"), f.dataType, F.lit(f"root.{f.name}")) for f in df.schema.fields]
    fields = [f for f in fields if f is not None]
    leaves = F.concat(*fields) if fields else F.array().cast("array<struct<path: string, text: string>>")
    hits = df.select(F.explode(leaves).alias("c")).select("c.path", F.explode(tx.detected_types(F.col("c.text"))).alias("type"))
    return hits.groupBy("path", "type").agg(F.count("*").alias("rows"))


def mask_corpus(docs: DataFrame, kind: str = "partial", types: list[str] | None = None) -> DataFrame:
    """Masked text of each document with the number of types found before and after.

    A document in which no pattern matches is its own masked form, so only the others pay for the masking.
    """
    found = docs.withColumn("types_before", F.size(tx.detected_types(F.col("text"))))
    touched = F.col("types_before") > 0
    masked = found.withColumn("masked", F.when(touched, tx.mask_text(F.col("text"), kind, types)).otherwise(F.col("text")))
    return masked.withColumn("types_after", F.when(touched, F.size(tx.detected_types(F.col("masked")))).otherwise(0))


def mask_table(df: DataFrame, kind: str = "partial") -> DataFrame:
    """Mask what is sensitive in every string of a table; values decide, the names of their keys do not.

    Nested structs, arrays and map values are walked through the schema; the masking itself only rewrites matched text.
    """
    def walk(col: Column, dtype: T.DataType) -> Column:
        if isinstance(dtype, T.StringType):
            return tx.mask_text(col, kind)
        if isinstance(dtype, T.StructType):
            fields = [walk(col[f.name], f.dataType).alias(f.name) for f in dtype.fields]
            return F.when(col.isNotNull(), F.struct(*fields))
        if isinstance(dtype, T.ArrayType):
            return F.transform(col, lambda x: walk(x, dtype.elementType))
        if isinstance(dtype, T.MapType):
            return F.transform_values(col, lambda _, x: walk(x, dtype.valueType))
        return col

    return df.select(*[walk(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def recurring_lines(docs: DataFrame, min_docs: int = 2) -> DataFrame:
    """Lines that occur in at least ``min_docs`` documents.

    Lines are made distinct inside their document first, so a plain count with map-side combine is enough.
    """
    lines = docs.select("doc_id", F.explode(F.array_distinct(F.filter(
        F.transform(F.split("text", "\n"), tx.strip), lambda x: x != ""))).alias("line"))
    return lines.groupBy("line").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)


def unique_lines(docs: DataFrame) -> DataFrame:
    """Each document with repeated lines removed, order kept, and junk lines dropped."""
    kept = tx.kept_lines(F.col("text"))
    return docs.withColumn("unique_text", F.array_join(kept, "\n")).withColumn(
        "lines_removed", F.size(F.split("text", "\n")) - F.size(kept))


def content_groups(df: DataFrame, content: Column, key: str = "content_key") -> DataFrame:
    """Groups of rows with equal content, by hash; only key counts are shuffled."""
    return df.groupBy(F.sha2(content, 256).alias(key)).agg(
        F.count("*").alias("copies"), F.min(df.columns[0]).alias("first_id")).where(F.col("copies") > 1)


def short_key(content: Column) -> Column:
    return F.substring(F.md5(content), 1, 12)


def salvage_json(replies: DataFrame) -> DataFrame:
    """JSON object inside a model reply: fences stripped, the outermost braces taken when the rest is prose."""
    body = F.trim(F.regexp_replace(F.trim("text"), r"^```(?:json)?|```$", ""))
    whole = F.try_parse_json(body)
    inner = F.regexp_extract("text", r"(?s)\{.*\}", 0)
    parsed = F.coalesce(whole, F.try_parse_json(F.when(inner != "", inner)))
    return replies.withColumn("parsed", parsed).withColumn("failed", F.col("parsed").isNull())


def line_changes(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """Changed lines with their position; lines are paired by position up to the shorter text."""
    zipped = F.arrays_zip(F.split(before, "\n").alias("original"), F.split(after, "\n").alias("corrected"))
    shorter = F.least(F.size(F.split(before, "\n")), F.size(F.split(after, "\n")))
    return pairs.select("doc_id", F.posexplode(F.slice(zipped, F.lit(1), shorter)).alias("line_no", "z")).select(
        "doc_id", "line_no", "z.original", "z.corrected"
    ).where(F.col("original") != F.col("corrected"))


def markdown_to_text(text: Column) -> Column:
    """Strip Markdown marks and collapse blank lines."""
    plain = F.regexp_replace(text, r"[#*_~`>|\[\]()\-]", "")
    return tx.strip(F.regexp_replace(plain, "\n{3,}", "\n\n"))


def html_to_text(html: Column) -> Column:
    """Readable text of an HTML page: scripts, styles and comments dropped, block ends become line breaks."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?i)<(?:br|/p|/li|/h[1-6]|/div|/tr|/ul)[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    return tx.strip(F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), r"\s*\n\s*", "\n"))


def html_tables(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Cells of every HTML table: (id, table_no, row_no, col_no, text)."""
    tables = pages.select(id_col, F.posexplode(F.regexp_extract_all(
        "html", F.lit(r"(?is)<table[^>]*>(.*?)</table>"), F.lit(1))).alias("table_no", "body"))
    rows = tables.select(id_col, "table_no", F.posexplode(F.regexp_extract_all(
        "body", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row_no", "row"))
    cells = rows.select(id_col, "table_no", "row_no", F.posexplode(F.regexp_extract_all(
        "row", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))).alias("col_no", "cell"))
    return cells.withColumn("text", tx.strip(F.regexp_replace("cell", "<[^>]+>", ""))).drop("cell")


def table_statistics(cells: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Rows, columns of the header, data rows and cells of each table."""
    return cells.groupBy(id_col, "table_no").agg(
        (F.max("row_no") + 1).alias("total_rows"),
        F.count_if(F.col("row_no") == 0).alias("total_cols"),
        F.max("row_no").alias("data_rows"), F.count("*").alias("total_cells"))


def list_items(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """List items and headings of HTML pages by tag."""
    items = F.regexp_extract_all("html", F.lit(r"(?is)<(li|h[1-6])(?:\s[^>]*)?>"), F.lit(1))
    return pages.select(id_col, F.explode(F.transform(items, F.lower)).alias("tag")).groupBy("tag").agg(
        F.count("*").alias("items"), F.countDistinct(id_col).alias("pages"))


def tagged(values: Column, name: str, label: str) -> Column:
    """Each value of an array beside a fixed label."""
    return F.transform(values, lambda x: F.struct(F.lit(label).alias(name), x.alias("value")))


def product_attributes(df: DataFrame, text: str) -> DataFrame:
    """Every size, capacity, batch and year found in a text, in long form (kind, value)."""
    def every(pattern, group=0):
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    flavours = F.filter(F.array(*[F.lit(w) for w in fv.FLAVOURS]), lambda w: F.col(text).contains(w))
    kinds = [
        (kind, flavours) if kind == "flavor" else (kind, F.concat(*[every(p, g) for p, g in patterns])) for kind, patterns in fv.ATTRIBUTE_PATTERNS.items()
    ]
    pairs = F.flatten(F.array(*[tagged(values, "kind", kind) for kind, values in kinds]))
    return df.select(*[c for c in df.columns if c != text], F.inline(pairs))


def harvest_identifiers(docs: DataFrame) -> DataFrame:
    """Every date-like and batch-like string, one row per match. Explodes inside the scan stage."""
    pairs = F.flatten(F.array(*[
        tagged(F.regexp_extract_all("text", F.lit(p), F.lit(0)), "pattern", kind) for kind, p in fv.HARVEST_PATTERNS.items()]))
    return docs.select("doc_id", F.inline(pairs))


def route_urls(urls: DataFrame, url: str = "url") -> DataFrame:
    """Input class of each address by its file extension, with a confidence."""
    path = F.lower(tx.strip(F.regexp_replace(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "")))
    ext = F.regexp_extract(path, r"\.([a-z0-9]+)(?:\?|#|$)", 1)
    kind = F.when(ext.isin(*fv.DOCUMENT_EXTENSIONS), "document").otherwise("image")
    sure = (F.when(ext == "", 0.5).when(ext.isin(*fv.DOCUMENT_EXTENSIONS, *fv.IMAGE_EXTENSIONS), 0.95).otherwise(0.3))
    return urls.withColumn("extension", ext).withColumn("input_type", kind).withColumn("confidence", sure)


def second_recognition(docs: DataFrame, threshold: float = 0.75, min_chars: int = 10) -> DataFrame:
    """Why a document needs a second recognition: low confidence, short text, garbled CJK; null when it does not."""
    n = F.length(tx.strip(F.col("text")))
    cjk = tx.char_count(F.col("text"), "[一-鿿]")
    reason = (
        F.when(F.col("confidence") < threshold, "low_confidence").when(n < min_chars, "short_text")
        .when((n > 20) & (cjk > 0) & (cjk / n < 0.1), "garbled_cjk")
    )
    return docs.withColumn("reason", reason)


def line_kinds(lines: DataFrame) -> DataFrame:
    """Field kind of each text line by ordered patterns; digits-only kinds look at the whole line."""
    low = F.lower("text")
    chain = None
    for kind, pattern in fv.LINE_KINDS:
        test = low.rlike(pattern)
        chain = F.when(test, kind) if chain is None else chain.when(test, kind)
    return lines.withColumn("kind", chain.otherwise("other"))


def label_hits(docs: DataFrame, patterns: list[tuple[str, str]] = fv.LABEL_PATTERNS) -> DataFrame:
    """Which label patterns occur in each document, with their number."""
    found = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(name)) for name, p in patterns]))
    return docs.withColumn("labels", found).withColumn("n_labels", F.size("labels"))


def expected_label_count(category: Column) -> Column:
    """Fields expected for a category word; the first word contained in the category decides."""
    chain = None
    for word, n in fv.EXPECTED_FIELD_COUNTS.items():
        test = category.contains(word)
        chain = F.when(test, n) if chain is None else chain.when(test, n)
    return chain.otherwise(fv.EXPECTED_FIELD_DEFAULT)


def rearrange_nutrition(docs: DataFrame) -> DataFrame:
    """Pair label rows with number rows inside the nutrition section when their totals agree within 30 %.

    Section bounds come from the first start marker and the next end marker; the pairing is a fold over the
    label rows that hands out number rows in order and takes back one that does not fit.
    """
    def has_any(line, words):
        test = None
        for w in words:
            test = line.contains(w) if test is None else test | line.contains(w)
        return test

    lines = F.split("text", "\n")
    d = docs.withColumn("_l", lines)
    d = d.withColumn("_i", F.transform("_l", lambda x, i: F.struct(i.alias("i"), x.alias("x"))))
    d = d.withColumn("_start", F.array_min(F.transform(F.filter("_i", lambda p: has_any(p["x"], fv.NUTRITION_START)), lambda p: p["i"])))
    d = d.withColumn("_end", F.coalesce(F.array_min(F.transform(F.filter(
        "_i", lambda p: (p["i"] > F.col("_start")) & has_any(p["x"], fv.NUTRITION_END)), lambda p: p["i"])), F.size("_l")))
    d = d.withColumn("_section", F.when(F.col("_start").isNotNull(), F.slice("_l", F.col("_start") + 1, F.col("_end") - F.col("_start"))))
    body = F.transform(F.filter("_section", lambda x: ~has_any(x, fv.NUTRITION_SKIP)), tx.strip)
    d = d.withColumn("_body", body)
    digits = lambda x: tx.char_count(x, "[0-9]") / F.greatest(F.length(x), F.lit(1))
    d = d.withColumn("_numbers", F.filter("_body", lambda x: digits(x) > 0.5)).withColumn(
        "_labels", F.filter("_body", lambda x: digits(x) <= 0.5))
    fields = lambda x: F.regexp_extract_all(x, F.lit(fv.NUTRITION_FIELD), F.lit(1))
    values = lambda x: F.split(x, r"\s+")
    zero = F.lit(0)
    d = d.withColumn("_nf", F.aggregate("_labels", zero, lambda a, x: a + F.size(fields(x)))).withColumn(
        "_nv", F.aggregate("_numbers", zero, lambda a, x: a + F.size(values(x))))
    fits = F.abs(F.col("_nf") - F.col("_nv")) <= F.greatest("_nf", "_nv") * 0.3
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("next"))

    def pair(acc, row):
        row_fields = fields(row)
        number = F.get("_numbers", acc["next"])
        row_values = F.coalesce(values(number), F.array().cast("array<string>"))
        usable = (F.size(row_fields) > 0) & number.isNotNull() & (F.size(row_values) >= F.size(row_fields))
        named = F.array_join(F.zip_with(row_fields, F.slice(row_values, F.lit(1), F.size(row_fields)),
                                        lambda f, x: F.concat(f, F.lit(": "), x)), " | ")
        left = F.array_join(F.slice(row_values, F.size(row_fields) + 1, F.size(row_values)), " ")
        paired = F.filter(F.array(named, left), lambda s: s != "")
        return F.when(usable, F.struct(F.concat(acc["out"], paired).alias("out"), (acc["next"] + 1).alias("next"))).otherwise(
            F.struct(F.array_append(acc["out"], row).alias("out"), acc["next"].alias("next")))

    folded = F.aggregate("_labels", start, pair)
    d = d.withColumn("_folded", folded)
    rest = F.slice("_numbers", F.col("_folded.next") + 1, F.size("_numbers"))
    table = F.concat(F.col("_folded.out"), rest)
    usable = (F.size("_section") >= 3) & (F.size("_labels") > 0) & (F.size("_numbers") > 0) & fits
    d = d.withColumn("rearranged", F.coalesce(usable, F.lit(False)))
    new_lines = F.concat(F.slice("_l", F.lit(1), F.col("_start")), table,
                         F.slice("_l", F.col("_end") + 1, F.size("_l")))
    d = d.withColumn("table_text", F.when(F.col("rearranged"), F.array_join(new_lines, "\n")).otherwise(F.col("text")))
    return d.drop(*[c for c in d.columns if c.startswith("_")])
