"""Registered queries: every module below adds to the registry when it is imported."""

from __future__ import annotations

import importlib

MODULES = ("metering", "monitoring", "text", "fields", "regions", "expiry", "services", "streams", "sources")


def _load():
    from tallyleaf.plans import registry

    for name in MODULES:
        importlib.import_module(f"tallyleaf.plans.{name}")
    return registry


def all_queries():
    return dict(_load().QUERIES)


def all_oracle_sql():
    return dict(_load().ORACLE)
