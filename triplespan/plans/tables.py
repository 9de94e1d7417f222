"""Intermediate tables of loops, and tables spread over tasks by their count."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, name: str = "round") -> DataFrame:
    """`df` as a table in the folder that executors share, which cuts the lineage; below the warehouse only where no folder is
    named and all run on this machine."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    folder = folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that one task holds of a spread table.
TASK_ROWS = 1 << 20


def spread(df: DataFrame, *by: str, rows: int = TASK_ROWS) -> DataFrame:
    """`df` in as many parts as make about `rows` a task, one a core at least, by `by` or in turn. A small file is one task of a scan
    whatever is computed of its rows, and parts of packed rows are large tables once they are read, so neither bounds a task."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(parts, *by)
