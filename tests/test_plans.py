"""The plans keep what matters at scale: pruned scans, pushed filters, checked broadcasts, no cross joins."""

import os
import subprocess
import sys

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_invoice_plan_reads_only_what_it_needs(spark):
    text = plan(entry.queries()["A01_monthly_usage"](spark, DIR))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double,props:string>" in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_watch_list_filter_is_pushed(spark):
    text = plan(entry.queries()["P09_flag_transactions"](spark, DIR))
    assert "IsNotNull(c_acctbal), LessThan(c_acctbal,0.0)" in text


def test_range_joins_have_an_equality(spark):
    for name in ("J07_texts_in_areas", "J08_merge_passes", "J09_fan_out"):
        text = plan(entry.queries()[name](spark, DIR))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_are_read_without_a_session():
    """The check tool lists the queries before it starts Spark."""
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(entry.__file__), capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_alert_points_count_the_calls_the_limiter_rejects(spark):
    """Each rejected call lies in ten windows of half-hour steps; the rate is per second of the window."""
    from tallyleaf.plans.streams import half_hour_limit

    points = entry.queries()["T02_alert_points"](spark, DIR).where("rule = 'limiter_hits'").collect()
    rejected = half_hour_limit(spark, DIR).where("NOT admitted").count()
    assert rejected > 0 and round(sum(p["value"] for p in points) * 18000 / 10, 0) == rejected


def test_fan_out_is_counted_before_it_is_multiplied(spark):
    from pyspark.sql import functions as F
    from tallyleaf.operators import services as ops
    from tallyleaf.streaming import jobs

    events = spark.createDataFrame([(i, i % 3, ["a", "b", None][i % 3 - i % 2]) for i in range(60)] + [(99, None, "a")], "event_id bigint, tenant_id bigint, event_type string")
    subs = spark.createDataFrame([(1, 0, ["a", "b"], True), (2, 0, ["a"], True), (3, 1, ["b"], False), (4, 2, ["b", "b"], True), (5, None, ["a"], True)],
                                 "sub_id bigint, tenant_id bigint, events array<string>, active boolean")
    rows = sorted(map(tuple, ops.fan_out(events, subs).groupBy("sub_id", "event_type").agg(F.count("*")).collect()))
    assert rows and sorted(map(tuple, ops.fan_out_counts(events, subs).collect())) == rows
    assert "sum(n" in plan(entry.queries()["J09_fan_out"](spark, DIR))
    written = []
    kept, jobs.run_to_end = jobs.run_to_end, lambda *args, **more: written.append(kept(*args, **more)) or written[-1]
    try:
        out = entry.queries()["T06_stream_fan_out"](spark, DIR)
    finally:
        jobs.run_to_end = kept
    assert out.count() > 0 and written[0].count() <= 10 * 3  # ten subscriptions, three types at most
