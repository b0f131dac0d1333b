"""Registered queries over the driver's tables, one per operator, with their SQL twins."""

from __future__ import annotations

import importlib
import pkgutil

from hazardframe.catalog import registry


def _load() -> None:
    for mod in pkgutil.iter_modules(__path__):
        if mod.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{mod.name}")


def all_queries() -> dict:
    _load()
    return registry.QUERIES


def all_oracles() -> dict:
    _load()
    return registry.ORACLES
