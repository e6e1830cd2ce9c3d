"""Column names that an input table does not use yet."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted``, each with underscores added until no column of ``df`` has the name in any case."""
    used, found = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        found.append(name)
    return found


def others(df: DataFrame, made: Iterable[str]) -> list[str]:
    """The columns of ``df`` that no column of ``made`` replaces."""
    gone = {m.lower() for m in made}
    return [c for c in df.columns if c.lower() not in gone]
