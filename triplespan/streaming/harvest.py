"""Harvests that go on where they stopped.

The distinct rows are written once as pages in order of their keys, from one scan; a stream over the pages then calls for one
page after the other. The stream's checkpoint is the cursor: a run that stops on the way goes on with the page it had not
finished, whose rows replace what it had left behind, so no page is missed or repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplespan.plans.tables import written


def _planned(spark: SparkSession, target: str) -> int | None:
    try:
        return spark.read.parquet(f"{target}/plan").first()["n"]
    except AnalysisException:
        return None


def _pages(rows: DataFrame, key: list[str], target: str, page_rows: int) -> None:
    """Pages of at most `page_rows` rows, as sorted files of disjoint ranges of the key; the plan is written last, so pages
    without a plan are those of a run that failed, and are written again."""
    found = written(rows.distinct(), "harvest")
    n = found.count()
    placed = found.repartitionByRange(max(-(-n // page_rows), 1), *key).sortWithinPartitions(*key)
    placed.write.mode("overwrite").option("maxRecordsPerFile", page_rows).parquet(f"{target}/pages")
    rows.sparkSession.range(1).select(F.lit(n).cast("long").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{target}/plan")


def harvest(rows: DataFrame, key: list[str], target: str, each: Callable[[DataFrame], DataFrame] = lambda page: page, page_rows: int = 100_000) -> DataFrame:
    """What `each` makes of the pages of the distinct rows; the results stay below `target`, and a second call after a stop, with
    the same `target`, reads only what is left. `rows` are read by the first call alone."""
    spark = rows.sparkSession
    if _planned(spark, target) is None:
        _pages(rows, key, target, page_rows)
    schema = spark.read.parquet(f"{target}/pages").schema

    def write(page: DataFrame, number: int) -> None:
        each(page).write.mode("overwrite").parquet(f"{target}/rows/page={number}")
        page.agg(F.count("*").alias("n"), *(F.max(F.struct(*key))[k].alias(f"last_{k}") for k in key)).coalesce(1).write.mode("overwrite").parquet(f"{target}/log/page={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{target}/pages")
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{target}/cursor").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{target}/rows").drop("page")


def progress(spark: SparkSession, target: str) -> tuple[int, int]:
    """How many distinct rows there are, and how many of them are harvested; (0, 0) before the first run."""
    planned = _planned(spark, target)
    if planned is None:
        return 0, 0
    try:
        done = spark.read.parquet(f"{target}/log").agg(F.sum("n")).first()[0]
    except AnalysisException:
        done = 0
    return planned, done or 0
