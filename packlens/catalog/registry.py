"""Registered queries and their comparison statements."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: QueryFn
    sql: str | None


class Registry:
    def __init__(self) -> None:
        self.items: dict[str, Query] = {}

    def add(self, name: str, sql: str | None = None):
        def wrap(fn: QueryFn) -> QueryFn:
            if name in self.items:
                raise ValueError(f"query {name} is registered twice")
            self.items[name] = Query(name, fn, sql)
            return fn

        return wrap
