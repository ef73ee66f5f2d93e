"""All registered queries. Importing this module registers every plan module."""

from __future__ import annotations

from loadscope.plans import q_eval, q_features, q_io_stream, q_models, q_quality, q_resample, q_scoring, q_text, q_workload  # noqa: F401
from loadscope.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
