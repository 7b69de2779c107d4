"""Queries of the training-data operators and their oracles."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = (
    "simhash_dedup", "warc_derive", "suffix_dedup", "decontaminate", "quality_rules", "token_files",
    "language_id", "toxicity", "bin_packing", "chat_format",
)


def _modules():
    return [importlib.import_module(f"tidemill.llm.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.NAME: m.query for m in _modules()}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.SQL for m in _modules() if m.SQL is not None}
