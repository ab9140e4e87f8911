"""The register of queries that the modules of this package fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphweft.sources import testgraph as tg

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, graph: bool = True):
    """Register a query under its function's name; the SQL may use nodes, edges and trade."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"with recursive {tg.SQL} {sql}" if graph else sql
        return f

    return add


def in_list(names: list[str]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"
