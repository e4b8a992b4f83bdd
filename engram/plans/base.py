"""Registration of queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from ..sources.entries import ENTRIES_SQL

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, entries: bool = True):
    """Register a function (spark, sf_dir) -> DataFrame. ``oracle`` is DuckDB SQL; with ``entries`` it may use the relation e,
    and a leading comma continues the WITH list."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if oracle is not None:
            text = oracle.strip()
            ORACLES[name] = (f"with recursive {ENTRIES_SQL}" + ("" if text.startswith(",") else " ") + text) if entries else text
        return f

    return add
