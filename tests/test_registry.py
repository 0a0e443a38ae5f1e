"""Rules, triggers, scenarios and call-backs added at run time; lineage with several parents; sketches."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallyleaf.operators import expiry, fields, monitoring, services
from tallyleaf.operators import registry as reg
from tallyleaf.session import scratch_path


def test_rules_are_checked_when_added():
    rules = reg.Registry().add("positive", lambda x: x > 0, ["amount"])
    with pytest.raises(ValueError):
        rules.add("positive", lambda x: x > 1, ["amount"])
    with pytest.raises(TypeError):
        rules.add("two", lambda a, b: a > b, ["amount"])
    with pytest.raises(KeyError):
        rules.column("absent")


def test_column_and_pandas_rules(spark):
    rows = spark.createDataFrame([(1, 5.0, "aa"), (2, -1.0, "ab"), (3, None, "")], "id long, amount double, code string")
    rules = reg.Registry().add("positive", lambda x: x > 0, ["amount"]).add_pandas("mirrored", lambda s: s == s.str[::-1], ["code"], "boolean")
    got = sorted((r.id, r.rule, r.passed) for r in reg.check_rules(rows, rules, ["id"]).collect())
    assert got == [(1, "mirrored", True), (1, "positive", True), (2, "mirrored", False), (2, "positive", False), (3, "mirrored", True), (3, "positive", False)]
    assert {r.id: r.failed for r in reg.failing_rules(rows, rules).collect()} == {1: [], 2: ["positive", "mirrored"], 3: ["positive"]}
    assert {r.id: r.trigger for r in reg.first_trigger(rows, rules).collect()} == {1: "positive", 2: "none", 3: "mirrored"}
    assert reg.check_rules(rows, reg.Registry(), ["id"]).count() == 0
    with pytest.raises(TypeError):
        reg.Registry().add("no column", lambda x: True, ["amount"]).column("no column")


def test_expiry_with_an_added_rule(spark):
    rows = spark.createDataFrame([("2025-01-01", "2025-01-03"), ("2025-01-01", "2025-06-01"), ("2025-01-01", "bad")], "production string, expiry string")
    rules = reg.Registry().add("too_short", lambda p, e: F.datediff(e, p) >= 7, ["_p", "_e"])
    asof = F.lit("2025-01-02").cast("date")
    got = {r.expiry: (r.reason, r.is_valid) for r in expiry.validate_expiry(rows, asof, rules).collect()}
    assert got == {"2025-01-03": ("too_short", False), "2025-06-01": ("ok", True), "bad": ("expiry_unreadable", False)}
    plain = {r.expiry: r.reason for r in expiry.validate_expiry(rows, asof).collect()}
    assert plain["2025-01-03"] == "near_expiry"


def test_field_rules_added(spark):
    rows = spark.createDataFrame([("food", "code", "12"), ("food", "code", "13"), ("food", "code", "N/A"), ("food", "name", "x"), ("drug", "code", "13")], "category string, field string, value string")
    rules = reg.Registry().add("food.code", lambda v: v.cast("int") % 2 == 0, ["value"])
    assert [tuple(r) for r in reg.failures_by_field(rows, rules).collect()] == [("food", "code", 2, 1)]


def test_scenarios_as_rows(spark):
    docs = spark.createDataFrame([(1, "a passport and a visa"), (2, "甲方 乙方 签约"), (3, "plain")], "doc_id long, text string")
    rows = reg.scenario_rows(spark, [("travel", 2, ["passport", "visa"])])
    assert {r.doc_id: r.scenario for r in reg.scenarios_of(docs, rows).collect()} == {1: "travel", 2: "contract", 3: "general_document"}
    assert {r.doc_id: r.scenario for r in fields.scenarios(docs).collect()} == {1: "general_document", 2: "contract", 3: "general_document"}


def test_call_backs_of_alerts(spark):
    source, seen = scratch_path(spark, "alerts"), []
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("id long, name string").parquet(source)
    calls = [lambda b, n: seen.append(("count", n, b.count())), lambda b, n: seen.append(("names", n, sorted(r.name for r in b.collect())))]
    reg.on_alerts(stream, calls, source + "-checkpoint").awaitTermination()
    assert seen == [("count", 0, 2), ("names", 0, ["a", "b"])]


def walked(edges, sources, outputs, depth):
    found, todo = [], [[s] for s in sources]
    while todo:
        path = todo.pop()
        if len(path) > 1 and path[-1] in outputs:
            found.append(tuple(path))
        if len(path) <= depth:
            todo += [[*path, b] for a, b in edges if a == path[-1] and b not in path]
    return sorted(found)


def graph(spark, edges, sources, outputs):
    frame = spark.createDataFrame([*edges, *edges[:2], (None, "x")], "src string, dst string")
    return frame, spark.createDataFrame([(s,) for s in sources], "node_id string"), spark.createDataFrame([(o,) for o in outputs], "node_id string")


def test_paths_with_diamonds_and_cycles(spark):
    edges = [("s", "a"), ("s", "b"), ("a", "c"), ("b", "c"), ("c", "o"), ("c", "a"), ("o", "p"), ("p", "s"), ("t", "b"), ("b", "b"), ("t", "o")]
    for depth in (1, 3, 6):
        got = sorted(tuple(r.path) for r in services.lineage_paths(*graph(spark, edges, ["s", "t"], ["o", "p"]), depth).collect())
        assert got == walked(edges, ["s", "t"], {"o", "p"}, depth)
    assert services.lineage_paths(*graph(spark, edges, ["o"], ["nowhere"]), 3).count() == 0


def test_counts_of_paths_without_listing(spark):
    layers = [[f"{k}{i}" for i in range(4)] for k in "abcdefgh"]  # 4 ** 7 paths from each source
    edges = [e for up, down in zip(layers, layers[1:]) for e in itertools.product(up, down)] + [("a0", "h1")]
    rows = services.path_counts(*graph(spark, edges, layers[0][:2], layers[-1]), 7).collect()
    assert {(r.source, r.output): (int(r.paths), r.shortest, r.longest) for r in rows} == {
        (s, o): (4**6 + ((s, o) == ("a0", "h1")), 1 if (s, o) == ("a0", "h1") else 7, 7) for s in ("a0", "a1") for o in layers[-1]}
    with pytest.raises(ValueError):
        services.path_counts(*graph(spark, [("a", "b"), ("b", "a")], ["a"], ["b"]), 5)


def test_merged_sketches_keep_their_bound(spark):
    rnd = random.Random(3)
    rows = [(f"/{i % 2}", i * 60, rnd.lognormvariate(0, 2) if i % 3 else float(i % 7)) for i in range(20_000)] + [("/0", 5, None)]
    df = spark.createDataFrame(rows, "endpoint string, s long, duration_ms double").withColumn("ts", F.timestamp_seconds("s"))
    sketches = monitoring.latency_sketches(df, ["endpoint"])
    assert sketches.count() > 300
    for r in monitoring.sketch_percentiles(sketches, ["endpoint"], {"p5": 0.05, "p50": 0.5, "p99": 0.99}).collect():
        values = [v for e, _, v in rows if e == r.endpoint and v is not None]
        assert r.n == len(values)
        for p, q in ((0.05, r.p5), (0.5, r.p50), (0.99, r.p99)):
            slack = monitoring.sketch_rank_error() * r.n + 1
            assert sum(v < q for v in values) - slack <= p * r.n <= sum(v <= q for v in values) + slack


def test_paths_that_lead_to_no_output_are_not_carried_on(spark, monkeypatch):
    edges = [("s", "a"), ("a", "o"), ("o", "n"), *[("n", f"leaf{i}") for i in range(300)]]
    kept = []

    def cut(df, plain=services.cut_lineage):
        kept.append(plain(df))
        return kept[-1]

    monkeypatch.setattr(services, "cut_lineage", cut)
    rows = services.lineage_paths(*graph(spark, edges, ["s"], ["o"]), 4).collect()
    assert [tuple(r.path) for r in rows] == [("s", "a", "o")]
    assert max(df.count() for df in kept if "path" in df.columns) < 10
