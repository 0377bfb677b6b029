"""All registered queries."""

from __future__ import annotations

from barloom.plans import cleaning_queries, feature_queries, model_queries, module_queries, signal_queries, source_queries, wide_queries
from barloom.plans.entries import Entry

MODULES = (source_queries, feature_queries, cleaning_queries, signal_queries, model_queries, module_queries, wide_queries)


def catalogue() -> dict[str, Entry]:
    found: dict[str, Entry] = {}
    for module in MODULES:
        for name, item in module.ENTRIES.items():
            if name in found:
                raise ValueError(f"query {name} registered twice")
            found[name] = item
    return found
