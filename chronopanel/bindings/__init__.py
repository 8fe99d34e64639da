"""Queries over the supplied tables."""

from __future__ import annotations

from importlib import import_module

MODULES = ("price", "ingest", "relations", "evaluation", "selecting", "texts", "streams", "learning")


def load_all():
    from .base import REGISTRY

    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return dict(REGISTRY)
