"""All registered queries and the DuckDB SQL each one is compared with."""

from __future__ import annotations

import importlib

FAMILIES = ("history", "space", "signals", "validation", "documents", "filed")


def _load() -> None:
    for family in FAMILIES:
        importlib.import_module(f"skyhive.registry.{family}")


def all_queries():
    from skyhive.registry.book import QUERIES

    _load()
    return dict(QUERIES)


def all_oracles():
    from skyhive.registry.book import ORACLES

    _load()
    return dict(ORACLES)
