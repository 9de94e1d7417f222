"""Expressions over small files are spread over tasks."""

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from triplespan.catalog import QUERIES
from triplespan.operators import named
from triplespan.plans.tables import spread


def test_spread(spark):
    """As many parts as the count asks for, one a core at least, and equal keys in one of them."""
    parts = spread(spark.range(100).select((F.col("id") % 10).alias("k")), "k", rows=3)
    assert parts.rdd.getNumPartitions() == max(34, spark.sparkContext.defaultParallelism) and parts.count() == 100
    assert parts.select("k", F.spark_partition_id().alias("p")).distinct().count() == 10


@pytest.mark.parametrize("query", ["formula_score", "formula_weight", "normalize_values"])
def test_small_files_are_spread(spark, query):
    assert QUERIES[query](spark, SMALL).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_distinct_counts_are_spread(spark, monkeypatch):
    """Values are shuffled before they are made distinct, by a bounded number a task."""
    parts = []
    monkeypatch.setattr(named, "spread", lambda df, *by: parts.append(spread(df, *by, rows=10)) or parts[-1])
    got = named.distinct_counts({"a": spark.range(300).select(F.col("id") % 50), "b": spark.range(0)}).first()
    assert (got["a"], got["b"]) == (50, 0) and parts[0].rdd.getNumPartitions() == 30
