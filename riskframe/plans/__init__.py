"""Registered queries (one per operator key) and their DuckDB oracles."""

from .registry import ORACLES, QUERIES
from . import q_core, q_eval, q_features, q_model, q_monitor, q_stats  # noqa: F401,E402  (registers)

__all__ = ["ORACLES", "QUERIES"]
