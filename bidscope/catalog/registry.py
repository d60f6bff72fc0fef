"""Registry of named queries over the test tables, each with an optional DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .sqlviews import with_views


@dataclass
class Entry:
    name: str
    ids: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def register(name: str, ids: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` for operator ids ``ids``;
    ``sql`` is the DuckDB oracle body, prefixed with the listed views."""

    def deco(fn):
        REGISTRY[name] = Entry(name, ids, fn, with_views(sql, *views) if sql is not None else None)
        return fn

    return deco
