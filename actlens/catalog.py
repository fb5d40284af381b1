"""All queries outside the training-data subpackage, by name."""

from __future__ import annotations

import importlib

from actlens.plans.registry import ORACLE, QUERIES, Query

MODULES = ("audit", "texts", "relations", "extraction", "search", "records", "documents", "sinks")


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"actlens.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)
