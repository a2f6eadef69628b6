"""All registered queries and their check SQL."""

from __future__ import annotations

import importlib

_MODULES = ("sources", "shaping", "overlap", "profiles", "plans", "stats", "learn", "streams", "workload")


def load():
    from querytide.registry.base import CHECK, SPARK

    for module in _MODULES:
        importlib.import_module(f"querytide.registry.{module}")
    return SPARK, CHECK
