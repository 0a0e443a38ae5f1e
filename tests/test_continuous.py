"""Streams with typed state, timers, merges and counted late rows: parts, restarts and replays against plain walks and batch jobs."""

import os
import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tallyleaf import fixed_values as fv
from tallyleaf.operators import monitoring
from tallyleaf.session import scratch_path
from tallyleaf.streaming import alerts, jobs, late, quota
from tallyleaf.streaming.merge import MonthlyUsage

BASE = 1_700_000_000 // 3600 * 3600


def run_parts(spark, parts, schema, make, name):
    """Every part is put into the folder and the stream run to its end, from its checkpoint; gives what was written, with the batch."""
    source, path = scratch_path(spark, name), scratch_path(spark, name + "-out")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source).withColumn("ts", F.timestamp_seconds("s"))
        with jobs.rocksdb(spark):
            jobs.write_batches(make(stream), path, path + "-checkpoint").awaitTermination()
    return spark.read.option("basePath", path).parquet(path), path + "-checkpoint"


# alerts -----------------------------------------------------------------------------------------------------------

EVENT = "s bigint, endpoint string, status_code int, seconds double, fallback boolean, limited boolean"


def noisy_events(seconds=5400, seed=3):
    rnd, out = random.Random(seed), []
    for s in range(seconds):
        if 2000 < s < 2900:  # silence
            continue
        bad = 0.3 if s // 700 % 2 else 0.0
        for _ in range(rnd.randint(0, 2)):
            out.append((BASE + s, rnd.choice(("/a", "/b")), 503 if rnd.random() < bad else 200, rnd.random() * (20 if s // 900 % 2 else 2), rnd.random() < bad * 1.5, rnd.random() < bad))
    return out


def test_all_rules_as_one_stream_with_restarts(spark):
    rows = noisy_events()
    n, beat = len(rows), [(BASE + 40_000, None, None, None, None, None)]
    parts = [rows[: n // 3], rows[n // 3: n // 2], rows[n // 2:], beat]
    written, checkpoint = run_parts(spark, parts, EVENT, lambda e: alerts.alert_stream(e, 1, "1 minute"), "alerts")
    events = spark.createDataFrame(rows, EVENT).withColumn("ts", F.timestamp_seconds("s"))
    want = monitoring.alert_points(events, events.select("ts", "fallback"), events.where("limited").select("ts"))
    point = lambda r: (r.rule, r.series, r.window_end, round(r.value, 9), r.breach)
    got = [point(r) for r in written.where("kind = 'point'").withColumnRenamed("at", "window_end").collect()]
    assert sorted(got) == sorted(point(r) for r in want.collect()) and len(got) > 800
    held = written.where("kind <> 'point'").collect()
    spans = []
    for rule, (_, _, hold) in fv.ALERT_RULES.items():
        points = want.where(F.col("rule") == rule).withColumn("ts", F.timestamp_seconds("window_end"))
        spans += [(rule, r.series, int(r.since.timestamp()), int(r.until.timestamp()), r.points) for r in monitoring.firing_spans(points, ["series"], "breach", hold).collect()]
    assert sorted((r.rule, r.series, r.since, r["at"], r.points) for r in held if r.kind == "resolved") == sorted(spans) and len(spans) > 3
    firing = [(r.rule, r.series, r.since) for r in held if r.kind == "firing"]
    assert sorted(firing) == sorted(s[:3] for s in spans)  # once for each run
    assert all(r["at"] - r.since == fv.ALERT_RULES[r.rule][2] for r in held if r.kind == "firing")
    state = spark.read.format("statestore").option("path", checkpoint).option("operatorId", 0).option("stateVarName", "run").load()
    assert state.count() == 0


def test_an_alert_fires_only_after_its_hold(spark):
    steps = [True] * 10 + [False] + [True] * 11  # breaches per step of the fixture: ten span 4.5 minutes, eleven 5
    rows = []
    for i, bad in enumerate(steps):
        rows.append((BASE + 30 * i, "/a", 503 if bad else 200, 1.0, None, False))
    rules = {**fv.ALERT_RULES, "error_share": (30, 0.05, 300)}  # windows of one step, so that each step is a point
    make = lambda e: alerts.alert_stream(e, 1, "0 seconds", rules)
    written, _ = run_parts(spark, [rows[:14], rows[14:], [(BASE + 9000, None, None, None, None, None)]], EVENT, make, "hold")
    held = [(r.kind, r.since, r["at"], r.points) for r in written.where("rule = 'error_share' and kind <> 'point'").orderBy("at", "kind").collect()]
    since = BASE + 30 * 12
    assert held == [("firing", since, since + 300, 11), ("resolved", since, since + 300, 11)]


# quota ------------------------------------------------------------------------------------------------------------

CALL = "s bigint, tenant_id bigint, request_id bigint, tokens bigint, quota bigint"


def walked_quota(rows):
    used, crossed = {}, []
    for s, tenant, request, tokens, limit in sorted(rows, key=lambda r: (r[0], r[2])):
        key = tenant, datetime.fromtimestamp(s, timezone.utc).strftime("%Y%m")
        before, used[key] = used.get(key, 0), used.get(key, 0) + tokens
        crossed += [(*key, request, used[key], x) for x in quota.SHARES if before < x * limit <= used[key]]
    return sorted(crossed), sorted((*k, n) for k, n in used.items())


def test_quota_state_ends_with_its_month(spark):
    rnd, start = random.Random(5), int(datetime(2024, 1, 20, tzinfo=timezone.utc).timestamp())
    rows = sorted((start + rnd.randint(0, 20 * 86400) // 40 * 40, rnd.choice((1, 1, 1, 2)), i, rnd.randint(1, 90), 9000) for i in range(900))
    rows += [(rows[-1][0], 3, 5000 + i, 1500, 9000) for i in range(8)]  # several shares within one minute
    cut = [r for r in rows if r[0] < start + 6 * 86400]
    parts = [cut, rows[len(cut):], [(rows[-1][0] + 86400, None, None, None, None)]]
    make = lambda e: quota.quota_stream(e.withColumn("period", F.date_format("ts", "yyyyMM")))
    written, checkpoint = run_parts(spark, parts, CALL, make, "quota")
    crossed, closed = walked_quota(rows)
    got = [(r.tenant_id, r.period, r.request_id, r.used, r.share) for r in written.where("kind = 'crossed'").collect()]
    assert sorted(got) == crossed and len(crossed) > 6
    ended = [(r.tenant_id, r.period, r.used) for r in written.where("kind = 'closed'").collect()]
    assert sorted(ended) == [c for c in closed if c[1] == "202401"]

    def state(name):
        return spark.read.format("statestore").option("path", checkpoint).option("operatorId", 0).option("stateVarName", name).load()

    assert {r.key.period for r in state("used").collect()} == {"202402"}  # January is gone
    assert state("minutes").count() == 0


def test_state_is_dealt_over_no_more_partitions_than_cores(spark):
    name, cores, start = "spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism, int(datetime(2024, 1, 20, tzinfo=timezone.utc).timestamp())
    before, rows = spark.conf.get(name), [(start + 60 * i, i % 7, i, 100, 1000) for i in range(90)]
    make = lambda e: quota.quota_stream(e.withColumn("period", F.date_format("ts", "yyyyMM")))
    try:
        spark.conf.set(name, 5 * cores)
        written, checkpoint = run_parts(spark, [rows, [(start + 40 * 86400, None, None, None, None)]], CALL, make, "quota-partitions")
        assert {(r.operatorId, r.numPartitions) for r in spark.read.format("state-metadata").load(checkpoint).collect()} == {(0, cores), (1, cores)}
        assert int(spark.conf.get(name)) == 5 * cores
        assert sorted((r.tenant_id, r.period, r.used) for r in written.where("kind = 'closed'").collect()) == walked_quota(rows)[1]
        spark.conf.set(name, 1)
        with jobs.rocksdb(spark):
            assert spark.conf.get(name) == "1"
    finally:
        spark.conf.set(name, before)


class Counted:
    """A store of values in memory that counts the calls made to it."""

    def __init__(self):
        self.held, self.calls, self.now = {}, 0, 0

    def getValueState(self, name, schema):
        return self

    def getMapState(self, name, *schemas):
        return self.__class__.Map(self)

    def registerTimer(self, at):
        self.calls += 1

    def exists(self):
        return "used" in self.held

    def get(self):
        return self.held["used"]

    def update(self, value):
        self.calls, self.held["used"] = self.calls + 1, value

    def getCurrentWatermarkInMs(self):
        return self.now

    class Map:
        def __init__(self, store):
            self.store, self.held = store, {}

        def keys(self):
            return iter(list(self.held))

        def getValue(self, key):
            self.store.calls += 1
            return self.held[key]

        def updateValue(self, key, value):
            self.store.calls += 1
            self.held[key] = value

        def removeKey(self, key):
            self.store.calls += 1
            del self.held[key]


def test_minutes_that_are_due_cost_the_store_a_few_calls():
    import numpy as np
    import pandas as pd

    month, frames, crossed, used = quota.QuotaMonth(), [], [], 0
    start = int(datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp()) // 60
    calls = [(start + m, m * 10 + c, 5 + (m + c) % 3) for m in range(4000) for c in range(3)]
    for _, request, tokens in calls:
        crossed += [(request, used + tokens, s) for s in quota.SHARES if used < s * 60_000 <= used + tokens]
        used += tokens
    for at in (slice(2000, 4000), slice(0, 2000)):  # not in order
        minutes = [calls[i:i + 3] for i in range(0, len(calls), 3)][at]
        frames.append(pd.DataFrame({"minute": [m[0][0] for m in minutes], "tokens": [sum(c[2] for c in m) for m in minutes], "quota": 60_000,
                                    "ids": [np.array([c[1] for c in m]) for m in minutes], "parts": [np.array([c[2] for c in m]) for m in minutes]}))
    store = Counted()
    month.init(store)
    store.now = (start + 3990) * 60_000  # ten minutes wait
    out = list(month.handleInputRows((1, "202401"), iter(frames), store))
    assert [(r.request_id, r.used, r.share) for f in out for r in f.itertuples()] == crossed and len(crossed) == 4
    assert store.calls < 50 and len(month.minutes.held) == 10 and store.held["used"] == (used - sum(c[2] for c in calls[-30:]),)
    store.now += 600_000
    list(month.handleInputRows((1, "202401"), iter([]), store))
    assert store.held["used"] == (used,) and not month.minutes.held and not month.frames.held


# merge ------------------------------------------------------------------------------------------------------------

USAGE = "request_id bigint, tenant_id bigint, day string, total_tokens bigint, success boolean"


def usage_frame(spark, rows):
    df = spark.createDataFrame(rows, USAGE).withColumn("ts", F.col("day").cast("timestamp"))
    return df.withColumns({"input_tokens": F.col("total_tokens"), "output_tokens": F.lit(0).cast("bigint"), "cost_usd": F.lit("0.1").cast("decimal(20,6)")})


def files(path):
    return {os.path.join(at, f): os.stat(os.path.join(at, f)).st_mtime_ns for at, _, names in os.walk(path.removeprefix("file:")) for f in names if f.endswith(".parquet")}


def month_of(name):
    return name.split("period=")[1][:6]


def totals(table):
    return sorted((r.tenant_id, r.period, r.total_tokens, r.call_count, r.failed_count, str(r.cost_usd)) for r in table.monthly().collect())


def test_a_batch_changes_only_its_months(spark, tmp_path):
    table = MonthlyUsage(spark, str(tmp_path))
    first = [(1, 1, "2024-01-05", 5, True), (1, 1, "2024-01-05", 5, True), (2, 1, "2024-01-06", 6, False), (3, 2, "2024-02-01", 7, True)]
    table.merge(usage_frame(spark, first), 0)
    want = [(1, "202401", 11, 2, 1, "0.200000"), (2, "202402", 7, 1, 0, "0.100000")]
    assert totals(table) == want
    table.merge(usage_frame(spark, first), 0)  # the batch is run again
    assert totals(table) == want
    table.merge(usage_frame(spark, [(2, 1, "2024-01-06", 6, False)]), 1)  # a row that was counted comes again
    assert totals(table) == want
    before = files(str(tmp_path))
    table.merge(usage_frame(spark, [(9, 1, "2024-01-20", 100, True), (1, 1, "2024-01-05", 5, True)]), 2)  # forty days late
    after = files(str(tmp_path))
    assert totals(table) == [(1, "202401", 111, 3, 1, "0.300000"), want[1]]
    changed = {f for f in before.keys() | after.keys() if before.get(f) != after.get(f)}
    assert {month_of(f) for f in changed} == {"202401"} and all(f in after for f in before if "monthly" not in f)
    table.merge(usage_frame(spark, []), 3)
    assert totals(table)[0][2] == 111


# late rows --------------------------------------------------------------------------------------------------------

def test_three_events_give_one_late_row_and_usage_holds_it(spark, tmp_path):
    schema = "s bigint, endpoint string, request_id bigint"
    start = BASE // 60 * 60
    parts = [[(start + 1000, "/a", 1)], [(start + 1010, "/a", 2)], [(start + 1000 - 660, "/a", 3)], [(start + 90_000, None, None)]]
    source, path, metrics = scratch_path(spark, "late"), str(tmp_path / "windows"), str(tmp_path / "metrics")
    table = MonthlyUsage(spark, str(tmp_path / "usage"), [F.count("*").alias("call_count")])
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source).withColumn("ts", F.timestamp_seconds("s"))
        late.run_counting_late(spark, jobs.minute_counts(late.observed(stream, "endpoint")), path, str(tmp_path / "c"), metrics, "late-test")
        table.run(stream.where("endpoint is not null").withColumn("tenant_id", F.lit(1)), str(tmp_path / "c2"))
    windows = spark.read.option("basePath", path).parquet(path)
    r = late.late_report(windows, spark.read.parquet(metrics)).first()
    assert (r.rows_read, r.rows_counted, r.late_rows, r.late_groups) == (3, 2, 1, 1)
    assert table.monthly().first().call_count == 3


def test_idle_sessions_stream(spark):
    rows = [(BASE + s, t) for t in (1, 2) for s in (0, 60, 1799 + 60, 3659 + 10_000 * t, 3660 + 10_000 * t)] + [(BASE + 1860 + 1799, 1)]
    parts = [rows[:3], rows[3:], [(BASE + 200_000, 9)]]
    written, _ = run_parts(spark, [sorted(p) for p in parts], "s bigint, tenant_id bigint", lambda e: jobs.idle_sessions(e, ["tenant_id"], 30, "3 hours"), "sessions")
    got = sorted((r.tenant_id, r.started // 10**6 - BASE, r.ended // 10**6 - BASE, r.calls) for r in written.collect())
    assert got == [(1, 0, 1859, 3), (1, 3659, 3659, 1), (1, 13659, 13660, 2), (2, 0, 1859, 3), (2, 23659, 23660, 2)]


def test_month_ends():
    for period in ("202312", "202401", "202402"):
        end = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=quota.month_end_ms(period))
        assert end.day == 1 and (end - timedelta(days=1)).strftime("%Y%m") == period
