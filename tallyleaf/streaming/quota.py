"""Quota watch with a state that ends: monthly totals per tenant in a typed value, minutes waiting in a map, timers that close a month."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

SHARES = (0.7, 0.85, 0.95, 1.0)
OUTPUT = "tenant_id bigint, period string, kind string, request_id bigint, used bigint, share double"


def month_end_ms(period: str) -> int:
    year, month = int(period[:4]), int(period[4:])
    return int(datetime(year + month // 12, month % 12 + 1, 1, tzinfo=timezone.utc).timestamp() * 1000)


class QuotaMonth(StatefulProcessor):
    """One month of one tenant: a ``crossed`` row for each share of the quota, a ``closed`` row with the month's total when its timer fires.

    Minutes that the watermark has passed, as all do that the first operator closes, are added up in order as they arrive; others wait in the store
    until it has. The calls of a frame of minutes are put aside in the store as one value: only those of a minute that crosses a share are fetched.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.used = handle.getValueState("used", "used long")
        self.minutes = handle.getMapState("minutes", "minute long", "tokens long, quota long, ids binary, parts binary")
        self.frames = handle.getMapState("frames", "frame long", "ids binary, parts binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        due, frames, ready = timerValues.getCurrentWatermarkInMs(), 0, []
        for pdf in rows:
            if pdf.empty:
                continue
            ids, parts = (np.concatenate(pdf[c].to_numpy()).astype("int64") for c in ("ids", "parts"))
            end = pdf["ids"].str.len().cumsum().tolist()
            numbers = list(zip(pdf["minute"].tolist(), pdf["tokens"].tolist(), pdf["quota"].tolist(), [0, *end[:-1]], end))
            for minute, tokens, quota, a, b in numbers:
                if (minute + 1) * 60_000 > due:
                    self.minutes.updateValue((minute,), (tokens, quota, ids[a:b].tobytes(), parts[a:b].tobytes()))
                else:
                    ready.append((minute, tokens, quota, frames, a, b))
            self.frames.updateValue((frames,), (ids.tobytes(), parts.tobytes()))
            frames += 1
        if not self.used.exists():
            self.used.update((0,))
            self.handle.registerTimer(month_end_ms(key[1]))
        added = self._added(key, due, ready)
        for frame in range(frames):
            self.frames.removeKey((frame,))
        return iter([added])

    def _added(self, key, watermark_ms: int, ready: list[tuple]) -> pd.DataFrame:
        used, out = self.used.get()[0], []
        for minute in [k[0] for k in self.minutes.keys() if (k[0] + 1) * 60_000 <= watermark_ms]:
            ready.append((minute, *self.minutes.getValue((minute,))[:2], None, 0, None))
        # Only numbers of minutes are put in order: a month has at most 44 640.
        for minute, tokens, quota, frame, a, b in sorted(ready, key=lambda r: r[0]):
            if any(used < s * quota <= used + tokens for s in SHARES):
                ids, parts = self.minutes.getValue((minute,))[2:] if frame is None else self.frames.getValue((frame,))
                at = used
                for request_id, n in zip(*(np.frombuffer(x, "int64")[a:b].tolist() for x in (ids, parts))):
                    out += [(*key, "crossed", request_id, at + n, s) for s in SHARES if at < s * quota <= at + n]
                    at += n
            used += tokens
            if frame is None:
                self.minutes.removeKey((minute,))
        self.used.update((used,))
        return self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._added(key, month_end_ms(key[1]), [])
        yield self._frame([(*key, "closed", None, self.used.get()[0], None)])
        self.used.clear()
        self.minutes.clear()

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in OUTPUT.split(",")]).astype({"tenant_id": "int64", "request_id": "Int64", "used": "int64", "share": "float64"})

    def close(self) -> None:
        pass


def quota_stream(calls: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Crossings of a tenant's monthly quota as they happen, each named by the call that crossed, and each month's total when it has ended.

    ``calls`` has ``tenant_id, request_id, ts, period, tokens, quota``. The first operator closes a minute of a tenant once, with its calls in
    order; the second adds the minutes up. Nothing of a month is kept after the watermark has passed its end. Append mode, RocksDB.
    """
    call = F.struct(F.unix_micros("ts").alias("ts"), "request_id", "tokens")
    # The test names ``ts``, so that it stays above the watermark: rows without a tenant or tokens only move the time on.
    known = F.when(F.col("ts").isNotNull(), F.col("tenant_id").isNotNull() & F.col("tokens").isNotNull())
    minutes = calls.withWatermark("ts", watermark).where(known).groupBy(F.window("ts", "1 minute"), "tenant_id", "period").agg(
        F.sum("tokens").cast("bigint").alias("tokens"), F.max("quota").cast("bigint").alias("quota"), F.sort_array(F.collect_list(call)).alias("calls"))
    rows = minutes.select("tenant_id", "period", (F.unix_seconds(F.col("window.start")) / 60).cast("bigint").alias("minute"), "tokens", "quota",
                          F.transform("calls", lambda c: c["request_id"]).alias("ids"), F.transform("calls", lambda c: c["tokens"]).alias("parts"))
    return rows.groupBy("tenant_id", "period").transformWithStateInPandas(QuotaMonth(), OUTPUT, "Append", "EventTime")
