"""Imports every module that registers queries."""

from __future__ import annotations

import importlib

MODULES = tuple(f"tidemill.plans.{m}" for m in ("flagship", "relational", "subqueries", "tpch", "scalars", "extras", "more"))


def load() -> None:
    for name in MODULES:
        importlib.import_module(name)
