"""Readers and writers."""

import json
import os

from pyspark.sql import functions as F

from tallyleaf.operators.scale import literal_table
from tallyleaf.operators.services import restore_plan, write_tenant_copy
from tallyleaf.sources import files


def test_records_with_and_without_regions(spark):
    regions = json.dumps([{"text": "a", "confidence": 0.5, "bbox": [1, 2, 3, 4], "type": "text"}, {"text": "b", "confidence": 0.9, "bbox": [], "type": "text"}])
    df = literal_table(spark, [(1, regions), (2, None)], "doc_id bigint; ocr_regions string")
    rows = files.explode_records(df).orderBy("doc_id", "region_id").collect()
    assert [(r.doc_id, r.region_id, r.text, r.x2) for r in rows] == [(1, 0, "a", 3.0), (1, 1, "b", None), (2, None, None, None)]


def test_text_corpora(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,text\n1,x\n2,y\n")
    (tmp_path / "a.xml").write_text("<rows><row><id>1</id><text>x</text></row></rows>")
    (tmp_path / "a.md").write_text("# t\nbody")
    schema = "id int, text string"
    assert files.read_corpus(spark, str(tmp_path / "a.csv"), "csv", schema).count() == 2
    assert files.read_corpus(spark, str(tmp_path / "a.xml"), "xml", schema).first().text == "x"
    assert files.read_corpus(spark, str(tmp_path / "a.md"), "md").first().text == "# t\nbody"


def test_exports_and_tenant_copy(spark, tmp_path):
    df = literal_table(spark, [(1, 7, "a"), (2, 8, "b")], "id bigint; tenant_id bigint; name string")
    files.export_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    files.export_sheet(df, "id", str(tmp_path / "sheet"))
    assert spark.read.option("header", True).csv(str(tmp_path / "sheet")).count() == 4
    write_tenant_copy(df, str(tmp_path / "copy"))
    assert {p for p in os.listdir(tmp_path / "copy") if p.startswith("tenant")} == {"tenant_id=7", "tenant_id=8"}
    plan = restore_plan(spark.read.parquet(str(tmp_path / "copy")), df.where(F.col("id") == 1), "id")
    assert {r.action: r.rows for r in plan.collect()} == {"skip": 1, "add": 1}
