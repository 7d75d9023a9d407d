"""Named queries over the given tables, each beside the SQL that checks it."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> tuple[dict, dict]:
    """Import every catalog module and return (queries, SQL twins)."""
    from lumentrace.catalog import registry

    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if module not in ("registry", "tables"):
            importlib.import_module(f"{__name__}.{module}")
    return registry.QUERIES, registry.ORACLES
