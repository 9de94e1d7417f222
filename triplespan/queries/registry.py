"""Registers queries over the tables of a folder, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from triplespan.sources.mapping import MappedGraph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def on_graph(sql: str | None = None):
    """A query that takes the graph view of the tables."""

    def register(f: Callable[[MappedGraph], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, folder: f(MappedGraph(spark, folder))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def register(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def on_tables(sql: str | None = None):
    """A query that takes a function from a table's name to its DataFrame."""

    def register(f: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, folder: f(lambda name: spark.read.parquet(f"{folder}/{name}.parquet"))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register
