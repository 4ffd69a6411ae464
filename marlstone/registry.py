"""Named queries: a builder over the test tables and, where SQL can express it, the equal DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a builder under ``name``."""

    def add(build: Build) -> Build:
        if name in REGISTRY:
            raise ValueError(f"two queries are named {name}")
        REGISTRY[name] = Query(name, build, sql)
        return build

    return add
