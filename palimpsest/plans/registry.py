"""Queries of the engine's own operators and the DuckDB SQL of each."""

from __future__ import annotations

from . import q_retrieval, q_stats, q_text, q_workflow  # noqa: F401  register their queries
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
