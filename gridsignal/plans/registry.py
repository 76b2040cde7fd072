"""Queries on the driver tables and the SQL that gives the same rows."""

from __future__ import annotations

from gridsignal.plans import array_queries, axis_queries, event_queries, graph_queries, model_queries, paradigm_queries, shape_queries, study_queries, volume_queries  # noqa: F401
from gridsignal.plans.register import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
