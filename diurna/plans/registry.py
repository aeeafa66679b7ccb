"""Registry of named queries over the driver tables.

Each entry pairs a Spark builder ``(spark, base_dir) -> DataFrame`` with an
optional DuckDB SQL text computing the same rows (the correctness oracle).
Entries without SQL are checked on rows only (models, forests, searches).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Entry:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: tuple = ()


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None, covers=()):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql, tuple(covers))
        return fn
    return deco
