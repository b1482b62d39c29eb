"""Every registered query, merged from the catalog modules."""

from __future__ import annotations

from packlens.catalog import capture, casework, compliance, fills, reading
from packlens.catalog.registry import Query

MODULES = (compliance, casework, capture, reading, fills)


def all_queries() -> dict[str, Query]:
    merged: dict[str, Query] = {}
    for module in MODULES:
        for name, query in module.R.items.items():
            if name in merged:
                raise ValueError(f"query {name} is registered twice")
            merged[name] = query
    return merged
