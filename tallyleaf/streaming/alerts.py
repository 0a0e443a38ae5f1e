"""Alert rules over one event stream: counts per step, then a keyed state that slides the windows and holds breaches.

The first operator is a window aggregate: each step's counts per rule and series, written once when the watermark closes the
step. The second keeps, per rule and series, the steps that still lie in some window and the run of breaches. A timer stands at
each instant that is due next, so instants are judged in order, also where no event arrives; when the last step has left
its windows nothing is kept. Its size follows time and series, not traffic.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tallyleaf import fixed_values as fv
from tallyleaf.operators.monitoring import bucket_counts

COUNTS = [f"c{i}" for i in range(len(fv.LATENCY_BUCKETS) + 1)]
OUTPUT = "rule string, series string, kind string, at bigint, since bigint, value double, breach boolean, points bigint"


def signals(events: DataFrame) -> DataFrame:
    """``ts, rule, series`` and counts for every rule an event speaks to.

    ``events`` has ``ts, endpoint, status_code, seconds`` of a request, ``fallback`` (null where it is no run) and ``limited``. Every test looks at
    ``ts`` too: one that does not would be moved below the watermark, and events that only move the time on would be lost.
    """
    def row(rule: str, when: Column, counts: list[Column], series: Column | None = None) -> Column:
        filled = [c.cast("bigint") for c in counts] + [F.lit(0).cast("bigint")] * (len(COUNTS) - len(counts))
        return F.when(F.col("ts").isNotNull() & when, F.struct(F.lit(rule).alias("rule"), (F.lit("") if series is None else series).alias("series"),
                                     *[c.alias(n) for c, n in zip(filled, COUNTS)]))

    request, one = F.col("endpoint").isNotNull(), F.lit(1)
    failed = F.coalesce(F.col("status_code").between(500, 599), F.lit(False)).cast("int")
    under = [F.coalesce(F.col("seconds") <= b, F.lit(False)).cast("int") for b in fv.LATENCY_BUCKETS]
    assert list(bucket_counts(F.col("seconds"))) == [f"b{i}" for i in range(len(under))] + ["b_all"]
    rows = F.array(row("error_share", request, [one, failed]), row("hourly_error_share", request, [one, failed]),
                   row("fallback_share", F.col("fallback").isNotNull(), [one, F.col("fallback").cast("int")]),
                   row("limiter_hits", F.coalesce("limited", F.lit(False)), [one]), row("p95_latency", request, [*under, one], F.col("endpoint")))
    return events.select("ts", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("ts", "r.*")


def step_counts(rows: DataFrame, step_seconds: int) -> DataFrame:
    """Counts per rule, series and step; with a watermark on ``ts`` each is given once, when it is closed."""
    return rows.groupBy(F.window("ts", f"{step_seconds} seconds"), "rule", "series").agg(*[F.sum(c).alias(c) for c in COUNTS])


def quantile(cumulative: list[int], q: float = 0.95) -> float:
    """Interpolated inside the bucket that holds it; the last finite bound beyond all of them."""
    rank, before, low = q * cumulative[-1], 0, 0.0
    for bound, count in zip(fv.LATENCY_BUCKETS, cumulative):
        if count >= rank and before < rank:
            return low + (bound - low) * (rank - before) / (count - before)
        before, low = count, float(bound)
    return low


def judged(rule: str, sums: list[int], width_seconds: int) -> float:
    if rule == "p95_latency":
        return quantile(sums)
    if rule == "limiter_hits":
        return sums[0] / width_seconds
    return sums[1] / sums[0]


class HeldAlerts(StatefulProcessor):
    """Rows of three kinds: a ``point`` for each instant, ``firing`` once when a run of breaches has lasted, ``resolved`` when that run ends."""

    def __init__(self, step_seconds: int, stretch: int, rules: dict):
        #: Window in steps, limit and hold in seconds of each rule.
        self.step, self.rules = step_seconds, {r: (w * stretch // step_seconds, limit, hold * stretch) for r, (w, limit, hold) in rules.items()}

    def init(self, handle) -> None:
        self.handle = handle
        self.steps = handle.getMapState("steps", "step long", "counts array<long>")
        #: Next instant to judge; first and last instant, points and firing of the present run of breaches.
        self.run = handle.getValueState("run", "due long, since long, until long, points long, fired boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            for step, counts in zip(pdf["step"].tolist(), pdf[COUNTS].values.tolist()):
                self.steps.updateValue((int(step),), ([int(c) for c in counts],))
                first = step if first is None else min(first, step)
        if not self.run.exists():
            self.run.update((int(first) + 1, None, None, 0, False))
            self.handle.registerTimer((int(first) + 1) * self.step * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rule, series = key
        width, limit, hold = self.rules[rule]
        held = {k[0]: list(v[0]) for k, v in self.steps.iterator()}
        due, since, until, points, fired = self.run.get()
        last = timerValues.getCurrentWatermarkInMs() // (1000 * self.step)
        steps = sorted(held)
        totals = [list(accumulate((held[s][i] for s in steps), initial=0)) for i in range(len(COUNTS))]
        out = []

        def end_run() -> None:
            nonlocal since, until, points, fired
            if fired:
                out.append((rule, series, "resolved", until * self.step, since * self.step, None, None, points))
            since, until, points, fired = None, None, 0, False

        at, over = due, False
        while at <= last:
            a, b = bisect_left(steps, at - width), bisect_left(steps, at)
            if a == b:  # no event in the window: no point, and a run of breaches is broken
                end_run()
                if b == len(steps):
                    over = True
                    break
                at = steps[b] + 1
                continue
            value = judged(rule, [t[b] - t[a] for t in totals], width * self.step)
            breach = value > limit
            out.append((rule, series, "point", at * self.step, None, value, breach, None))
            if breach:
                since, until, points = at if since is None else since, at, points + 1
                if not fired and (until - since) * self.step >= hold:
                    fired = True
                    out.append((rule, series, "firing", at * self.step, since * self.step, value, True, points))
            else:
                end_run()
            at += 1
        for s in steps:
            if s < at - width:
                self.steps.removeKey((s,))
        if over:  # an instant without any event has passed: nothing is left in any window
            self.steps.clear()
            self.run.clear()
        else:
            self.run.update((at, since, until, points, fired))
            self.handle.registerTimer(at * self.step * 1000)
        yield pd.DataFrame(out, columns=[c.strip().split(" ")[0] for c in OUTPUT.split(",")]).astype(
            {"at": "int64", "since": "Int64", "points": "Int64", "breach": "boolean"})

    def close(self) -> None:
        pass


def alert_stream(events: DataFrame, stretch: int = 1, watermark: str = "10 minutes", rules: dict | None = None) -> DataFrame:
    """All rules continuously: points, firings and ends of firings. ``stretch`` multiplies windows, steps and holds, for sparse traffic.

    ``rules`` gives (window seconds, limit, hold seconds) by rule in place of the fixed ones.

    Output mode append; the state store must be RocksDB (see ``rocksdb``). Instants are judged once the watermark has passed them, so a stream that
    falls silent needs an event, of any kind, to move it on.
    """
    step = fv.ALERT_STEP_SECONDS * stretch
    counted = step_counts(signals(events.withWatermark("ts", watermark)), step)
    rows = counted.select("rule", "series", (F.unix_seconds(F.col("window.start")) / step).cast("bigint").alias("step"), *COUNTS)
    return rows.groupBy("rule", "series").transformWithStateInPandas(HeldAlerts(step, stretch, fv.ALERT_RULES if rules is None else rules), OUTPUT, "Append", "EventTime")
