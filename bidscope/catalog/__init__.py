"""Named queries over the test tables with their DuckDB oracles."""

from __future__ import annotations

from .registry import REGISTRY, Entry

_MODULES = ("q_market", "q_history", "q_expr", "q_query", "q_resolve", "q_rebuild", "q_dedup", "q_harvest", "q_sources", "q_enrich", "q_arrays", "q_stream", "q_replay")


def all_entries() -> dict[str, Entry]:
    import importlib

    for m in _MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return dict(REGISTRY)
