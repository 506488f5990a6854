"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("p01_percentiles", "p02_pieces", "p03_sentences", "p04_defects", "p05_neardup", "p06_truncated", "p07_consensus", "p08_containers", "p09_mixture", "p10_quality")

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _m = importlib.import_module(f"{__package__}.{_name}")
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
