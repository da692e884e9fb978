"""Registry of runnable queries and, where SQL can say the same, their oracle."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = (fn, sql)
        return fn

    return register


def load_all() -> dict[str, tuple[Callable, str | None]]:
    """Import every ``q_*`` module of this package and return the registry."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{module.name}")
    return REGISTRY
