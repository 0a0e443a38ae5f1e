"""Readers and writers: recognised pages with a JSON region column, text corpora, result exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REGION_JSON = "array<struct<text:string, confidence:double, bbox:array<double>, type:string>>"


def explode_records(records: DataFrame, json_column: str = "ocr_regions", id_column: str = "doc_id") -> DataFrame:
    """One row per region of a record table whose regions are stored as a JSON array; records without regions stay.

    Parsing and exploding are one stage: nothing is shuffled.
    """
    parsed = records.withColumn("_r", F.from_json(json_column, REGION_JSON))
    rows = parsed.select(*[c for c in records.columns if c != json_column], F.posexplode_outer("_r").alias("region_id", "_one"))
    box = [F.get("_one.bbox", F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]
    return rows.select(*[c for c in rows.columns if c != "_one"], "_one.text", "_one.confidence", *box, "_one.type")


def read_corpus(spark: SparkSession, path: str, kind: str, schema: str | None = None, row_tag: str = "row") -> DataFrame:
    """Text-like files: csv, json and xml by schema; html, md and txt as (path, text), one row per file."""
    if kind == "csv":
        return spark.read.schema(schema).option("header", "true").option("multiLine", "true").csv(path)
    if kind == "json":
        return spark.read.schema(schema).json(path)
    if kind == "xml":
        return spark.read.schema(schema).option("rowTag", row_tag).xml(path)
    if kind in ("html", "md", "txt"):
        return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    raise ValueError(f"unknown kind: {kind}")


def record_json(columns: list[str]) -> Column:
    """One JSON document per record."""
    return F.to_json(F.struct(*columns))


def field_sheet(records: DataFrame, id_column: str) -> DataFrame:
    """Two-column sheet per record: (id, field, value), fields in column order."""
    names = [c for c in records.columns if c != id_column]
    pairs = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for i, c in enumerate(names)])
    return records.select(id_column, F.inline(pairs))


def export_json(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def export_sheet(records: DataFrame, id_column: str, path: str) -> None:
    field_sheet(records, id_column).drop("n").write.mode("overwrite").option("header", "true").csv(path)
