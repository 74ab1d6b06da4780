"""Every query of the engine and, where SQL can express it, its DuckDB twin."""

from __future__ import annotations

from confab.queries import flows, language, store, timeline

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (store, timeline, language, flows):
    QUERIES |= _module.Q
    ORACLES |= _module.SQL
