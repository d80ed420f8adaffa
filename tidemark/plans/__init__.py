"""Registered queries; importing the modules registers them."""

from __future__ import annotations

import importlib

_MODULES = ("window_queries", "factor_queries", "pit_queries", "portfolio_queries", "evidence_queries", "model_queries")
for _m in _MODULES:
    importlib.import_module(f"{__name__}.{_m}")

from .registry import ORACLES, QUERIES  # noqa: E402

__all__ = ["ORACLES", "QUERIES"]
