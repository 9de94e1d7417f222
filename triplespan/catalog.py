"""All queries by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from triplespan.queries import changes, graph, records, steps, syntheses, tables  # noqa: F401 - registers the queries
from triplespan.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["bgp_chain"](spark, sf_dir)
