"""Registered queries: name → Spark query, DuckDB text when there is one, and the inventory ids it covers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Run
    covers: tuple[str, ...]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")
        REGISTRY[name] = Entry(run, tuple(covers.split()), sql)
        return run

    return add
