"""Queries of the numbered operators. Each module adds its own."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODULES = ("sharding", "mixing", "toxicity", "quality", "packing", "topk", "ann", "substrings", "jaccard", "lm", "negatives", "chats", "repair")

for _name in MODULES:
    _module = importlib.import_module(f"gridsignal.llm.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(getattr(_module, "ORACLES", {}))
