"""Graph view over the driver tables and the registered queries."""

from __future__ import annotations

import importlib
import pkgutil

from ripplegraph.plans.registry import REGISTRY, Query


def catalog() -> dict[str, Query]:
    """All registered queries; importing a ``queries_*`` module registers what it defines."""
    for m in pkgutil.iter_modules(__path__):
        if m.name.startswith("queries_"):
            importlib.import_module(f"{__name__}.{m.name}")
    return REGISTRY
