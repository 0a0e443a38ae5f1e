"""Registered reader and export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyleaf.plans.registry import query
from tallyleaf.sources import files, views as v


@query("S01_explode_records", "SELECT doc_id, region_id, text, confidence, x1::DOUBLE AS x1, y2::DOUBLE AS y2 FROM regions")
def explode_records(spark, d):
    """Each document becomes a record with a JSON region column, which the job reads back."""
    docs = v.table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    def region(x, i):
        x1 = i % 3 * 200 + F.col("doc_id") % 7
        y1 = F.floor(i / 3) * 30 + (i * 7) % 11
        return F.struct(x.alias("text"), (((F.col("doc_id") * 31 + i * 17) % 100) / 100.0).alias("confidence"),
                        F.array(*[c.cast("double") for c in (x1, y1, x1 + 20 + F.length(x) % 230, y1 + 18 + i % 25)]).alias("bbox"), F.lit("text").alias("type"))

    records = docs.select("doc_id", F.to_json(F.transform("l", region)).alias("ocr_regions"))
    return files.explode_records(records).select("doc_id", F.col("region_id").cast("bigint").alias("region_id"), "text", "confidence", "x1", "y2")


@query("S07_record_json", """SELECT p_partkey, json_object('p_partkey', p_partkey, 'p_brand', p_brand, 'p_size', p_size) AS document FROM part""")
def record_json(spark, d):
    return v.table(spark, d, "part").select("p_partkey", files.record_json(["p_partkey", "p_brand", "p_size"]).alias("document"))


@query("S07_field_sheet", """SELECT p_partkey, unnest(['p_brand', 'p_type', 'p_size']) AS field, unnest([p_brand, p_type, CAST(p_size AS VARCHAR)]) AS value FROM part""")
def field_sheet(spark, d):
    return files.field_sheet(v.table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size"), "p_partkey").drop("n")


@query("S02_corpus_round_trip", "SELECT lang, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1")
def corpus_round_trip(spark, d):
    """Documents written as JSON lines and read back by schema."""
    from tallyleaf.session import scratch_path

    path = scratch_path(spark, "corpus")
    files.export_json(v.table(spark, d, "documents").select("doc_id", "lang", "text"), path)
    return files.read_corpus(spark, path, "json", "doc_id bigint, lang string, text string").groupBy("lang").agg(
        F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))
