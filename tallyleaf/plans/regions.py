"""Registered queries over text regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyleaf import fixed_values as fv
from tallyleaf.operators import regions as ops
from tallyleaf.plans.registry import query
from tallyleaf.sources import views as v


@query("P03_drop_weak", """WITH r AS (SELECT *, max(confidence) OVER (PARTITION BY doc_id) AS top,
    row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, region_id) AS rn FROM regions)
  SELECT doc_id, count(*) AS kept, CAST(sum(region_id) AS BIGINT) AS id_sum FROM r WHERE confidence >= 0.15 OR (top < 0.15 AND rn = 1) GROUP BY 1""")
def drop_weak(spark, d):
    return ops.drop_weak(v.regions(spark, d)).groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum("region_id").alias("id_sum"))


WORDS = " OR ".join(f"contains(lower(text), '{w}')" for w in fv.WATERMARK_WORDS)


@query("P14_watermarks", f"""SELECT doc_id, CASE WHEN {WORDS} THEN 'keyword_match' ELSE 'low_confidence' END AS reason, count(*) AS regions FROM regions
    WHERE {WORDS} OR (confidence <> 0 AND confidence < 0.3) GROUP BY 1, 2""")
def watermarks(spark, d):
    return ops.watermark_regions(v.regions(spark, d), 0.3).groupBy("doc_id", "reason").agg(F.count("*").alias("regions"))


AREAS = "areas AS (SELECT doc_id, region_id AS area_id, x1 - 30 AS x1, y1 - 40 AS y1, x1 + 90 AS x2, y1 + 60 AS y2 FROM regions WHERE confidence < 0.1)"


def areas(spark, d):
    return v.regions(spark, d).where("confidence < 0.1").select(
        "doc_id", F.col("region_id").alias("area_id"), (F.col("x1") - 30).alias("x1"), (F.col("y1") - 40).alias("y1"),
        (F.col("x1") + 90).alias("x2"), (F.col("y1") + 60).alias("y2"))


INSIDE = "r.doc_id = a.doc_id AND (r.x1 + r.x2) / 2 BETWEEN a.x1 AND a.x2 AND (r.y1 + r.y2) / 2 BETWEEN a.y1 AND a.y2"


@query("J07_outside_ignored_areas", "WITH " + AREAS + f""" SELECT doc_id, count(*) AS kept, CAST(sum(region_id) AS BIGINT) AS id_sum FROM regions r
    WHERE NOT EXISTS (SELECT 1 FROM areas a WHERE {INSIDE}) GROUP BY 1""")
def outside_ignored_areas(spark, d):
    out = ops.center_inside(v.regions(spark, d), areas(spark, d), how="left_anti")
    return out.groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum("region_id").alias("id_sum"))


@query("J07_texts_in_areas", "WITH " + AREAS + f""" SELECT r.doc_id, a.area_id, count(*) AS regions, CAST(sum(length(text)) AS BIGINT) AS chars
    FROM regions r JOIN areas a ON {INSIDE} GROUP BY 1, 2""")
def texts_in_areas(spark, d):
    return ops.center_inside(v.regions(spark, d), areas(spark, d)).groupBy("doc_id", "area_id").agg(
        F.count("*").alias("regions"), F.sum(F.length("text")).alias("chars"))


def passes(spark, d):
    """Every region in both passes: moved a little in the second, or far enough to miss the first for one in three."""
    r = v.regions(spark, d)
    moved = r.withColumn("region_id", F.col("region_id") + 100000)
    for c in ("x1", "x2"):
        moved = moved.withColumn(c, F.col(c) + F.when(F.col("region_id") % 3 == 1, 5000).otherwise(F.col("region_id") % 40))
    return r, moved


PASSES = """pa AS (SELECT * FROM regions), pb AS (SELECT doc_id, region_id, text, x1 + m AS x1, y1, x2 + m AS x2, y2, confidence FROM
      (SELECT * REPLACE (region_id + 100000 AS region_id), CASE WHEN (region_id + 100000) % 3 = 1 THEN 5000 ELSE (region_id + 100000) % 40 END AS m FROM regions)),
  ov AS (SELECT a.doc_id, a.region_id AS a_id, b.region_id AS b_id, (least(a.x2, b.x2) - greatest(a.x1, b.x1)) AS w, (least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS h,
    (a.x2 - a.x1) * (a.y2 - a.y1) AS sa, (b.x2 - b.x1) * (b.y2 - b.y1) AS sb FROM pa a JOIN pb b ON a.doc_id = b.doc_id),
  hit AS (SELECT * FROM ov WHERE w > 0 AND h > 0 AND (w * h)::DOUBLE / (sa + sb - w * h) > 0.3)"""


@query("J08_overlapping_pairs", "WITH " + PASSES + " SELECT doc_id, count(*) AS pairs, CAST(sum(a_id * 7 + b_id) AS BIGINT) AS id_sum FROM hit GROUP BY 1")
def overlapping_pairs(spark, d):
    a, b = passes(spark, d)
    return ops.overlapping_pairs(a, b, 0.3).groupBy("doc_id").agg(F.count("*").alias("pairs"), F.sum(F.col("a_id") * 7 + F.col("b_id")).alias("id_sum"))


@query("J08_merge_passes", "WITH " + PASSES + """, m AS (SELECT doc_id, region_id FROM pa UNION ALL SELECT doc_id, region_id FROM pb b
    WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.doc_id = b.doc_id AND hit.b_id = b.region_id))
  SELECT doc_id, count(*) AS regions, CAST(sum(region_id) AS BIGINT) AS id_sum FROM m GROUP BY 1""")
def merge_passes(spark, d):
    a, b = passes(spark, d)
    return ops.merge_passes(a, b, 0.3).groupBy("doc_id").agg(F.count("*").alias("regions"), F.sum("region_id").alias("id_sum"))


BOX = "[{'id': region_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}]"
SIDE = "(least(k.{0}2, b[1].{0}2) - greatest(k.{0}1, b[1].{0}1))"
W, H = SIDE.format("x"), SIDE.format("y")
SIZES = "(k.x2 - k.x1) * (k.y2 - k.y1) + (b[1].x2 - b[1].x1) * (b[1].y2 - b[1].y1)"
#: Greedy suppression as a reduction over the boxes of a group in order; each box is a list of one, the result the list of kept boxes.
GREEDY = f"""list_reduce(list({BOX} ORDER BY confidence DESC, region_id), lambda acc, b: CASE WHEN len(list_filter(acc, lambda k:
    {W} > 0 AND {H} > 0 AND ({W} * {H})::DOUBLE / ({SIZES} - {W} * {H}) > 0.5)) > 0 THEN acc ELSE list_concat(acc, b) END)"""
KEPT = "SELECT doc_id, CAST(sum(len(kept)) AS BIGINT) AS kept, CAST(sum(list_sum(list_transform(kept, lambda k: k.id))) AS BIGINT) AS id_sum FROM g GROUP BY 1"
BOTH = "WITH " + PASSES + ", u AS (SELECT * FROM pa UNION ALL SELECT * FROM pb), "


@query("W13_suppress_overlaps", BOTH + f"g AS (SELECT doc_id, {GREEDY} AS kept FROM u GROUP BY 1) " + KEPT)
def suppress_overlaps(spark, d):
    a, b = passes(spark, d)
    return ops.suppress_overlaps(a.unionByName(b), 0.5).groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum("region_id").alias("id_sum"))


@query("W13_same_text", BOTH + f"g AS (SELECT doc_id, {GREEDY} AS kept FROM u WHERE trim(text, ' ') <> '' GROUP BY doc_id, trim(text, ' ')) " + KEPT)
def same_text(spark, d):
    a, b = passes(spark, d)
    return ops.suppress_overlaps(a.unionByName(b), 0.5, same_text=True).groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum("region_id").alias("id_sum"))


LINES = """c AS (SELECT *, (y1 + y2) / 2.0::DOUBLE AS cy, (x1 + x2) / 2.0::DOUBLE AS cx FROM {0}),
  n AS (SELECT *, CASE WHEN cy - lag(cy) OVER (PARTITION BY doc_id ORDER BY cy, region_id) > greatest(y2 - y1, 1) * 0.5 THEN 1 ELSE 0 END AS fresh FROM c),
  l AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY doc_id ORDER BY cy, region_id ROWS UNBOUNDED PRECEDING) + 1 AS BIGINT) AS line_no FROM n),
  o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, cx, region_id) AS position FROM l)"""


@query("W03_reading_order", "WITH " + LINES.format("regions") + " SELECT doc_id, region_id, line_no, position FROM o")
def reading_order(spark, d):
    return ops.reading_order(v.regions(spark, d)).select("doc_id", "region_id", "line_no", "position")


@query("A32_assemble_pages", "WITH full_text AS (SELECT *, max(confidence) OVER (PARTITION BY doc_id) AS top, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, region_id) AS rn "
       "FROM regions WHERE trim(text, ' ') <> ''), strong AS (SELECT * FROM full_text WHERE confidence >= 0.15 OR (top < 0.15 AND rn = 1)), " + LINES.format("strong") + """
    SELECT doc_id, md5(string_agg(trim(text, ' '), chr(10) ORDER BY position)) AS text_md5, ROUND(avg(confidence), 6) AS confidence, count(*) AS regions FROM o GROUP BY 1""")
def assemble_pages(spark, d):
    """Pages of the regions that stay: equal overlapping texts once (none overlap by half here), then those over the floor."""
    kept = ops.drop_weak(ops.suppress_overlaps(v.regions(spark, d), 0.5, same_text=True))
    out = ops.assemble_pages(ops.reading_order(kept))
    return out.select("doc_id", F.md5("page_text").alias("text_md5"), F.round("confidence", 6).alias("confidence"), "regions")


CHAIN = " ".join(f"WHEN contains(label, '{k}') THEN '{f}'" for k, f in fv.LABEL_FIELDS.items())


@query("W04_label_values", f"""WITH b AS (SELECT doc_id, region_id, x1, (y1 + y2) / 2.0::DOUBLE AS cy, CASE region_id % 6 WHEN 0 THEN 'Brand: ' WHEN 3 THEN 'Net Weight: ' ELSE '' END || text AS text FROM regions),
  n AS (SELECT *, CASE WHEN abs(cy - lag(cy) OVER (PARTITION BY doc_id ORDER BY cy, region_id)) > 20 THEN 1 ELSE 0 END AS fresh FROM b),
  l AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY cy, region_id ROWS UNBOUNDED PRECEDING) AS line_no FROM n),
  t AS (SELECT doc_id, line_no, coalesce(string_agg(trim(text, ' '), ' ' ORDER BY x1, region_id) FILTER (trim(text, ' ') <> ''), '') AS line FROM l GROUP BY 1, 2),
  p AS (SELECT doc_id, line_no, lower(trim(regexp_extract(line, '^([^:：]+)[:：]\\s*(.+)$', 1), ' ')) AS label, trim(regexp_extract(line, '^([^:：]+)[:：]\\s*(.+)$', 2), ' ') AS value FROM t),
  f AS (SELECT *, CASE {CHAIN} END AS field FROM p WHERE label <> '')
  SELECT doc_id, field, arg_min(value, line_no) AS value FROM f WHERE field IS NOT NULL GROUP BY 1, 2""")
def label_values(spark, d):
    prefix = F.when(F.col("region_id") % 6 == 0, "Brand: ").when(F.col("region_id") % 6 == 3, "Net Weight: ").otherwise("")
    return ops.label_values(v.regions(spark, d).withColumn("text", F.concat(prefix, "text"))).select("doc_id", "field", "value")


@query("W05_paragraphs", """WITH n AS (SELECT *, coalesce(y1 - lag(y1) OVER (PARTITION BY doc_id ORDER BY y1, region_id) > (y2 - y1) * 1.5, false) AS p FROM regions)
  SELECT doc_id, md5(string_agg(CASE WHEN p THEN chr(10) || text ELSE text END, chr(10) ORDER BY y1, region_id)) AS paragraphs_md5,
    md5(string_agg(repeat(' ', CAST(x1 // 10 AS INT)) || text, chr(10) ORDER BY y1, region_id)) AS indented_md5, count(*) FILTER (p) AS breaks FROM n WHERE text <> '' GROUP BY 1""")
def paragraphs(spark, d):
    out = ops.paragraph_text(v.regions(spark, d))
    return out.select("doc_id", F.md5("paragraphs").alias("paragraphs_md5"), F.md5("indented").alias("indented_md5"), "breaks")


@query("A34_layout_kind", """SELECT CASE WHEN s > 100 THEN 'multi_column' ELSE 'single_column' END AS layout, count(*) AS pages
    FROM (SELECT doc_id, stddev_pop((x1 + x2) / 2) AS s FROM regions GROUP BY 1) GROUP BY 1""")
def layout_kind(spark, d):
    return ops.layout_kind(v.regions(spark, d)).groupBy("layout").agg(F.count("*").alias("pages"))


@query("A33_table_text", """WITH c AS (SELECT doc_id, region_id // 3 AS r, region_id % 3 AS c, text AS t FROM regions),
  w AS (SELECT doc_id, c, max(length(t)) AS width FROM c GROUP BY 1, 2), g AS (SELECT DISTINCT doc_id, r FROM c),
  f AS (SELECT g.doc_id, g.r, w.c, rpad(coalesce(c.t, ''), CAST(w.width AS INT), ' ') AS t FROM g JOIN w ON g.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = g.doc_id AND c.r = g.r AND c.c = w.c),
  l AS (SELECT doc_id, r, string_agg(t, ' | ' ORDER BY c) AS t FROM f GROUP BY 1, 2)
  SELECT doc_id, count(*) AS rows, md5(string_agg(t, chr(10) ORDER BY r)) AS table_md5 FROM l GROUP BY 1""")
def table_text(spark, d):
    cells = v.regions(spark, d).select("doc_id", F.floor(F.col("region_id") / 3).alias("row"), (F.col("region_id") % 3).alias("col"), "text")
    return ops.table_text(cells, ["doc_id"]).select("doc_id", "rows", F.md5("table_text").alias("table_md5"))


NAMED = " OR ".join(f"contains(text, '{w}')" for w in fv.TABLE_WORDS)


@query("W07_chosen_table", f"""WITH c AS (SELECT doc_id, region_id // (4 + doc_id % 3) AS table_no, CASE WHEN (doc_id + region_id) % 50 = 0 THEN text || ' Sodium' ELSE text END AS text FROM regions),
  t AS (SELECT doc_id, table_no, count(*) AS cells, bool_or({NAMED}) AS named FROM c GROUP BY 1, 2),
  o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY named DESC, CASE WHEN named THEN 0 ELSE -cells END, table_no) AS rn FROM t)
  SELECT doc_id, table_no, cells, named FROM o WHERE rn = 1""")
def chosen_table(spark, d):
    k = F.col("doc_id")
    cells = v.regions(spark, d).select("doc_id", F.floor(F.col("region_id") / (4 + k % 3)).alias("table_no"), F.when(
        (k + F.col("region_id")) % 50 == 0, F.concat("text", F.lit(" Sodium"))).otherwise(F.col("text")).alias("text"))
    return ops.chosen_table(cells, ["doc_id"])


@query("W14_merge_close_lines", """WITH y AS (SELECT doc_id, list([y1] ORDER BY y1) AS ys FROM (SELECT DISTINCT doc_id, y1 FROM regions) GROUP BY 1)
  SELECT doc_id, CAST(len(ys) AS INTEGER) AS coords, array_to_string(list_reduce(ys, lambda acc, c: CASE WHEN c[1] - acc[-1] > 12 THEN list_concat(acc, c) ELSE acc END), ',') AS kept FROM y""")
def merge_close_lines(spark, d):
    coords = v.regions(spark, d).groupBy("doc_id").agg(F.collect_set("y1").alias("ys"))
    return coords.select("doc_id", F.size("ys").alias("coords"), F.array_join(ops.merge_close_lines(F.col("ys"), 12), ",").alias("kept"))


@query("W15_assign_columns")
def assign_columns(spark, d):
    return ops.assign_columns(v.regions(spark, d))


def scatter_sql(i: str, j: str) -> str:
    total = f"(p[{j} + 1] - p[{i} + 1])"
    return f"(q[{j} + 1] - q[{i} + 1] - {total} * {total} / ({j} - {i}))"


def cuts_sql(k: int) -> str:
    way = f"struct_pack(s := b{k - 1}[i + 1].s + {scatter_sql('i', 'j')}, cuts := list_append(b{k - 1}[i + 1].cuts, CAST(i AS INTEGER)))"
    return f"c{k} AS (SELECT *, list_transform(range(0, n + 1), lambda j: CASE WHEN j >= {k} THEN list_min(list_transform(range({k - 1}, j), lambda i: {way})) END) AS b{k} FROM c{k - 1})"


@query("W15_exact_columns", f"""WITH g AS (SELECT doc_id, list_sort(list(struct_pack(x := (x1 + x2) / 2.0::DOUBLE, region_id := region_id))) AS r FROM regions GROUP BY 1),
  h AS (SELECT *, len(r) AS n, list_reduce(list_concat([[0.0::DOUBLE]], list_transform(r, lambda s: [s.x])), lambda a, x: list_append(a, a[-1] + x[1])) AS p,
    list_reduce(list_concat([[0.0::DOUBLE]], list_transform(r, lambda s: [s.x * s.x])), lambda a, x: list_append(a, a[-1] + x[1])) AS q FROM g),
  c1 AS (SELECT *, list_transform(range(0, n + 1), lambda j: CASE WHEN j > 0 THEN struct_pack(s := {scatter_sql('0', 'j')}, cuts := CAST([] AS INTEGER[])) END) AS b1 FROM h),
  {', '.join(cuts_sql(k) for k in range(2, 6))},
  f AS (SELECT doc_id, r, coalesce({', '.join(f'CASE WHEN b{k}[n + 1].s < n * 100.0 THEN b{k}[n + 1].cuts END' for k in range(2, 6))}, []) AS cuts FROM c5)
  SELECT doc_id, r[i].region_id AS region_id, CAST(len(list_filter(cuts, lambda c: c <= i - 1)) AS BIGINT) AS column_no, CAST(len(cuts) + 1 AS BIGINT) AS columns
  FROM (SELECT *, unnest(range(1, len(r) + 1)) AS i FROM f)""")
def exact_columns(spark, d):
    return ops.exact_columns(v.regions(spark, d))


@query("W15_embedding_clusters")
def embedding_clusters(spark, d):
    return ops.vector_clusters(v.table(spark, d, "embeddings"), 10)


def blocks(spark, d):
    r = v.regions(spark, d)
    kinds = ["text", "text", "text", "table", "seal", "chart", "formula", "image"]
    return r.select("doc_id", "region_id", "y1", v.pick(F.col("region_id") % 8, kinds).alias("type"),
                    v.pick(F.col("region_id") % 3, ["title", "list", "paragraph"]).alias("category"), F.col("text").alias("content"))


@query("A40_block_counts", "SELECT doc_id, " + ", ".join(f"count(*) FILTER (k IN ({i})) AS {n}" for n, i in
       [("text", "0, 1, 2"), ("table", "3"), ("seal", "4"), ("chart", "5"), ("formula", "6"), ("image", "7")]).replace("AS table", 'AS "table"')
       + " FROM (SELECT doc_id, region_id % 8 AS k FROM regions) GROUP BY 1")
def block_counts(spark, d):
    return ops.block_counts(blocks(spark, d))


@query("A40_page_markdown", """WITH m AS (SELECT doc_id, region_id, y1, CASE WHEN region_id % 8 < 3 AND region_id % 3 = 0 THEN chr(10) || '## ' || text || chr(10) WHEN region_id % 8 < 3 AND region_id % 3 = 1 THEN '- ' || text
      WHEN region_id % 8 < 3 THEN text || chr(10) WHEN region_id % 8 = 3 THEN chr(10) || '### 表格' || chr(10) || chr(10) || text || chr(10) WHEN region_id % 8 = 4 THEN chr(10) || '> **印章**: ' || text || chr(10)
      WHEN region_id % 8 = 5 THEN chr(10) || '### 图表' || chr(10) || chr(10) || text || chr(10) WHEN region_id % 8 = 6 THEN chr(10) || '$$ ' || text || ' $$' || chr(10) END AS t FROM regions),
  p AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY y1, region_id) AS markdown FROM m WHERE t IS NOT NULL GROUP BY 1)
  SELECT doc_id, md5(markdown) AS markdown_md5, length(markdown) AS n_chars FROM p""")
def page_markdown(spark, d):
    return ops.page_markdown(blocks(spark, d)).select("doc_id", F.md5("markdown").alias("markdown_md5"), F.length("markdown").alias("n_chars"))


def metrics(spark, d):
    k = F.col("page_id")
    n = F.length("html")
    return v.table(spark, d, "pages").select(
        k, (n % 2600 + 100).alias("width"), (k * 37 % 2400 + 200).alias("height"), (n % 70).alias("sharpness"), (k * 13 % 256).alias("brightness"),
        (n % 7).alias("edge_energy"), (k * 7 % 110).alias("contrast"), ((n % 30) / 1000.0).alias("edge_density"))


@query("P06_quality_route", """WITH m AS (SELECT length(html) % 2600 + 100 AS w, page_id * 37 % 2400 + 200 AS h, length(html) % 70 AS sh, page_id * 13 % 256 AS br, length(html) % 7 AS ed FROM pages),
  s AS (SELECT *, CASE WHEN least(w, h) >= 2000 THEN 40 WHEN least(w, h) >= 1200 THEN 30 WHEN least(w, h) >= 800 THEN 20 WHEN least(w, h) >= 500 THEN 10 ELSE 0 END
    + CASE WHEN sh > 50 THEN 30 WHEN sh > 30 THEN 20 WHEN sh > 15 THEN 10 ELSE 0 END + CASE WHEN br BETWEEN 60 AND 200 THEN 15 WHEN br BETWEEN 40 AND 220 THEN 10 ELSE 5 END
    + CASE WHEN ed > 5 THEN 15 WHEN ed > 2 THEN 10 ELSE 5 END AS score, w::DOUBLE / h AS ratio FROM m)
  SELECT score, CASE WHEN score >= 70 AND ratio > 0.3 AND ratio < 3.0 THEN 'full' WHEN ratio < 0.2 OR ratio > 5.0 THEN 'ocr_only' WHEN score < 25 THEN 'vl_only'
    WHEN sh < 10 THEN 'enhance_full' ELSE 'full' END AS route, count(*) AS pages FROM s GROUP BY 1, 2""")
def quality_route(spark, d):
    return ops.quality_route(metrics(spark, d)).groupBy("score", "route").agg(F.count("*").alias("pages"))


@query("P06_strategy", """WITH m AS (SELECT length(html) % 70 AS sh, page_id * 13 % 256 AS br, page_id * 7 % 110 AS co, (length(html) % 30) / 1000.0::DOUBLE AS de FROM pages),
  s AS (SELECT CASE WHEN br < 40 AND co < 30 THEN 'dark_low_contrast' WHEN sh < 30 AND co < 30 THEN 'blurry' WHEN co < 30 THEN 'low_contrast' WHEN br < 40 THEN 'dark' WHEN co > 80 THEN 'high_contrast' ELSE 'normal' END AS strategy,
    greatest(0, 100 - CASE WHEN sh < 30 THEN 30 WHEN sh < 60 THEN 10 ELSE 0 END - CASE WHEN br < 40 THEN 25 WHEN br < 80 THEN 10 ELSE 0 END
      - CASE WHEN co < 30 THEN 20 WHEN co > 80 THEN 5 ELSE 0 END - CASE WHEN de < 0.001::DOUBLE THEN 15 WHEN de < 0.01::DOUBLE THEN 5 ELSE 0 END) AS q FROM m)
  SELECT strategy, count(*) AS pages, avg(q) AS quality FROM s GROUP BY 1""")
def strategy(spark, d):
    return ops.preprocessing_strategy(metrics(spark, d)).groupBy("strategy").agg(F.count("*").alias("pages"), F.avg("quality_score").alias("quality"))
