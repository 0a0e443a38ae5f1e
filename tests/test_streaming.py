"""Folds alone, folds over tables against folds over streams, late data."""

from pyspark.sql import functions as F

from tallyleaf.operators.scale import literal_table
from tallyleaf.session import scratch_path
from tallyleaf.streaming import folds, jobs, stateful


def test_sliding_window():
    f = folds.SlidingWindowLimit()
    assert [f.step(t, 2) for t in (0, 10, 20, 59, 60, 65)] == [(True, 0), (True, 0), (False, 40), (False, 1), (True, 0), (False, 5)]


def test_token_bucket():
    f = folds.TokenBucket()
    assert [f.step(t, n, 1.0, 100) for t, n in ((0, 80), (10, 50), (30, 50))] == [(True, 20, 0), (False, 30, 20), (True, 0, 0)]


def test_breaker():
    f = folds.Breaker(3, 3, 60.0, 30.0)
    got = [f.step(t, ok) for t, ok in ((0, False), (1, False), (2, False), (20, True), (32, True), (33, True), (34, True))]
    assert got[2] == (True, "open") and got[3] == (False, "open") and got[4] == (True, "half_open") and got[6] == (True, "closed")
    stuck = folds.Breaker(3, 3, 60.0, 30.0, keep_slot=True)
    got = [stuck.step(t, ok) for t, ok in ((0, False), (1, False), (2, False), (32, True), (33, True), (34, True))]
    assert got[-1] == (False, "half_open")


def test_cache_and_windows():
    f = folds.ExpiringEntry()
    assert [f.step(t)[0] for t in (0, 10, 3700)] == [False, True, False]
    w = folds.FixedWindows(tpm=100, rpm=3, qps=3)
    assert [w.step(t, n, 0.0)[1] for t, n in ((0, 60), (1, 60), (2, 40), (3, 0), (4, 0), (61, 60))] == ["ok", "tpm", "ok", "ok", "rpm", "ok"]


def test_segmented_fold_equals_whole_fold(spark):
    calls = spark.range(600).select((F.col("id") % 3).alias("tenant_id"), F.col("id").alias("request_id"),
                                    F.timestamp_seconds((F.col("id") * 7919 % 4001) * 5).alias("ts"), F.lit(2).alias("limit"))
    parts = stateful.limiter_segments(calls, "tenant_id", 60)
    assert parts.select("tenant_id", "segment").distinct().count() > 3
    got = {r.request_id: r.admitted for r in stateful.run_fold(parts, ["tenant_id", "segment"], ["ts_s", "request_id"], folds.SlidingWindowLimit).collect()}
    for t in range(3):
        f = folds.SlidingWindowLimit()
        rows = sorted((((i * 7919 % 4001) * 5), i) for i in range(600) if i % 3 == t)
        for s, i in rows:
            assert got[i] == f.step(float(s), 2)[0]


def test_quota_segments_equal_whole_fold(spark):
    calls = spark.range(400).select((F.col("id") % 2).alias("tenant_id"), F.col("id").alias("request_id"), F.timestamp_seconds(F.col("id") * 997).alias("ts"),
                                    (F.col("id") % 7 * 100).cast("bigint").alias("tokens"), F.lit(0.5).alias("cost"))
    make = lambda: folds.FixedWindows(tpm=500, daily=9000, budget=60.0)
    parts = stateful.quota_segments(calls, "tenant_id", 9000, 60.0)
    got = {r.request_id: r.reason for r in stateful.run_fold(parts, ["tenant_id", "segment"], ["ts_s", "request_id"], make).collect()}
    for t in range(2):
        f = make()
        for i in range(t, 400, 2):
            assert got[i] == f.step(i * 997.0, i % 7 * 100, 0.5)[1]


def test_smoothing(spark):
    rows = literal_table(spark, [(1, i, ok, 1000.0) for i, ok in enumerate((False, False, True))], "tenant_id bigint; request_id bigint; success boolean; latency_ms double")
    out = stateful.smoothed(rows.withColumn("ts", F.timestamp_seconds("request_id")), "tenant_id")
    r = stateful.adjusted_limit(out, F.lit(100)).first()
    assert round(r.success_rate, 4) == .643 and r.adjusted == 70


def test_stream_fold_keeps_state_between_batches(spark):
    src = scratch_path(spark, "calls")
    rows = [(1, float(t), 2) for t in (0, 10, 20, 59, 60, 65)]
    schema = "tenant_id bigint, ts_s double, limit int"
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = jobs.run_to_end(spark, stateful.stream_fold(stream, "tenant_id", "ts_s", folds.SlidingWindowLimit), "fold")
    assert [r.admitted for r in out.orderBy("ts_s").collect()] == [True, True, False, False, True, False]


def test_late_rows(spark):
    src = scratch_path(spark, "late")
    schema = "s bigint, endpoint string"
    base = 1_700_000_000 // 60 * 60
    # a row is judged late by the watermark of the batch before, so one batch passes between the jump and the late row
    for part in ([(base, "/a"), (base + 1, "/a")], [(base + 1260, "/a")], [(base + 1261, "/a")], [(base + 2, "/a")], [(base + 4000, "/a")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src).withColumn("ts", F.timestamp_seconds("s"))
    out = jobs.run_to_end(spark, jobs.minute_counts(stream), "late")
    got = {r.minute.timestamp(): r.requests for r in out.collect()}
    assert got == {base: 2, base + 1260: 2}


def test_first_alerts_over_batches(spark):
    schema, src, path = "s bigint, field string, value string", scratch_path(spark, "alerts"), scratch_path(spark, "alerts-out")
    parts = [[(1, "a", "x"), (2, "a", "x"), (3, "b", "x")], [(50, "a", "x"), (51, "a", "y")], [(5000, "c", "x")], [(5001, "a", "x")]]
    for part in parts:  # the second is within the watermark of the first; by the fourth the first alert is forgotten
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src).withColumn("ts", F.timestamp_seconds("s"))
        jobs.write_batches(jobs.first_alerts(stream), path, path + "-checkpoint").awaitTermination()
    got = sorted((r.s, r.field, r.value) for r in spark.read.option("basePath", path).parquet(path).collect())
    assert [(f, x) for _, f, x in got] == [("a", "x"), ("b", "x"), ("a", "y"), ("c", "x"), ("a", "x")] and got[0][0] in (1, 2) and got[-1][0] == 5001


def test_quota_watch_crosses_once():
    f = folds.QuotaWatch()
    got = [f.step(t, p, n, 100)[1] for t, p, n in ((0, "a", 60), (1, "a", 20), (2, "a", 30), (3, "a", 5), (4, "b", 75))]
    assert got == ["", "0.7", "0.85,0.95,1.0", "", "0.7"]
