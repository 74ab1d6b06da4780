"""Queries of the corpus operators and their DuckDB twins."""

from __future__ import annotations

import importlib

_MODULES = ("toxicity", "simhash", "decontaminate", "secrets", "bpe", "substrings", "pivots", "hilbert", "chat", "quality")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in _MODULES:
    _module = importlib.import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
