"""Queries of the operators for training text."""

from __future__ import annotations

import importlib
import importlib.util

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _m in ("q_markup", "q_visual", "q_scans", "q_neighbours", "q_leakage", "q_mixing", "q_splitting"):
    if importlib.util.find_spec(f"quire.llm.{_m}") is not None:
        _mod = importlib.import_module(f"quire.llm.{_m}")
        QUERIES |= _mod.QUERIES
        SQL |= _mod.SQL
