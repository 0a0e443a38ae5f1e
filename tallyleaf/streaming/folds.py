"""Small sequential decision rules. Each holds the state of one key and handles one event at a time.

They are the only per-row Python here, because every step depends on the previous decision. Spark partitions and
orders the events; see ``stateful`` for the batch and streaming adapters.
"""

from __future__ import annotations

import json


class SlidingWindowLimit:
    """Admit while fewer than ``limit`` calls were admitted in the last ``window`` seconds; else seconds to wait."""

    inputs = ("ts_s", "limit")
    outputs = "admitted boolean, retry_after double"

    def __init__(self, window: float = 60.0):
        self.window, self.admitted = window, []

    def step(self, ts_s, limit):
        self.admitted = [t for t in self.admitted if t > ts_s - self.window]
        if len(self.admitted) < limit:
            self.admitted.append(ts_s)
            return True, 0.0
        return False, self.admitted[0] + self.window - ts_s if self.admitted else 0.0


class TokenBucket:
    """Refill at ``rate`` per second up to ``capacity``; admit when the request fits, else seconds to wait."""

    inputs = ("ts_s", "tokens", "rate", "capacity")
    outputs = "admitted boolean, remaining double, wait double"

    def __init__(self):
        self.left, self.at = None, None

    def step(self, ts_s, tokens, rate, capacity):
        if self.left is None:
            self.left, self.at = float(capacity), ts_s
        self.left = min(float(capacity), self.left + max(0.0, ts_s - self.at) * rate)
        self.at = ts_s
        if self.left >= tokens:
            self.left -= tokens
            return True, self.left, 0.0
        return False, self.left, (tokens - self.left) / rate


class FixedWindows:
    """Quotas per aligned window, checked in order; a call consumes only when every check passes.

    Windows: tokens and requests per minute, requests per second, tokens per day, cost per 30 days.
    """

    inputs = ("ts_s", "tokens", "cost")
    outputs = "admitted boolean, reason string"

    def __init__(self, tpm=100000, rpm=600, qps=20, daily=500000, budget=500.0):
        self.limits = [("tpm", 60, tpm), ("rpm", 60, rpm), ("qps", 1, qps), ("daily", 86400, daily), ("budget", 2592000, budget)]
        self.used, self.window = {}, {}

    def step(self, ts_s, tokens, cost):
        want = {"tpm": tokens, "rpm": 1, "qps": 1, "daily": tokens, "budget": cost}
        for name, width, _ in self.limits:
            w = int(ts_s // width)
            if self.window.get(name) != w:
                self.window[name], self.used[name] = w, 0
        for name, _, limit in self.limits:
            if self.used[name] + want[name] > limit:
                return False, name
        for name, amount in want.items():
            self.used[name] += amount
        return True, "ok"


class Breaker:
    """Closed, open and half-open by failures in a window, a cool-down and consecutive successes.

    A probe slot is returned on each outcome. ``keep_slot=True`` replays the other behaviour, in which it never is.
    """

    inputs = ("ts_s", "success")
    outputs = "allowed boolean, state string"

    def __init__(self, threshold=5, successes=3, window=60.0, cooldown=30.0, probes=1, keep_slot=False):
        self.threshold, self.successes, self.window, self.cooldown = threshold, successes, window, cooldown
        self.probes, self.keep_slot = probes, keep_slot
        self.state, self.last_failure, self.streak, self.in_flight, self.failures = "closed", 0.0, 0, 0, []

    def step(self, ts_s, success):
        if self.state == "open" and ts_s - self.last_failure >= self.cooldown:
            self.state, self.in_flight, self.streak = "half_open", 0, 0
        if self.state == "open" or (self.state == "half_open" and self.in_flight >= self.probes):
            return False, self.state
        if self.state == "half_open":
            self.in_flight += 1
        self.failures = [t for t in self.failures if t > ts_s - self.window]
        if success:
            self.streak += 1
            if self.state == "half_open" and self.streak >= self.successes:
                self.state, self.streak = "closed", 0
        else:
            self.failures.append(ts_s)
            self.last_failure, self.streak = ts_s, 0
            if self.state == "half_open" or len(self.failures) >= self.threshold:
                self.state = "open"
        if self.state == "half_open" and not self.keep_slot:
            self.in_flight -= 1
        return True, self.state


class ExpiringEntry:
    """A cache entry that lives ``ttl`` seconds from the miss that stored it."""

    inputs = ("ts_s",)
    outputs = "hit boolean"

    def __init__(self, ttl: float = 3600.0):
        self.ttl, self.stored = ttl, None

    def step(self, ts_s):
        if self.stored is not None and ts_s - self.stored < self.ttl:
            return (True,)
        self.stored = ts_s
        return (False,)


class QuotaWatch:
    """Running monthly tokens against a quota; names the shares of the quota that the event crosses."""

    inputs = ("ts_s", "period", "tokens", "quota")
    outputs = "used double, crossed string"

    def __init__(self, shares=(0.7, 0.85, 0.95, 1.0)):
        self.shares, self.period, self.used = list(shares), None, 0.0

    def step(self, ts_s, period, tokens, quota):
        if period != self.period:
            self.period, self.used = period, 0.0
        before, self.used = self.used, self.used + tokens
        return self.used, ",".join(str(s) for s in self.shares if before < s * quota <= self.used)


def save(fold) -> str:
    return json.dumps(fold.__dict__)


def load(fold, text: str):
    fold.__dict__.update(json.loads(text))
    return fold
