"""Plain tables in and out: JSON lists, CSV, tab-separated results, score reports."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplespan.operators.scoring import micro, with_prf


def json_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file with one list of flat objects; missing fields are NULL."""
    return spark.read.schema(schema).json(path, multiLine=True)


def unit_database(spark: SparkSession, path: str) -> DataFrame:
    """(formula, category, smiles): rows with a formula; canonical SMILES before others."""
    rows = spark.read.csv(path, header=True)
    text = lambda c: F.nullif(F.trim(c), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
    return rows.select(text("formula").alias("formula"), text("category").alias("category"), F.coalesce(text("canonical_smiles"), text("smiles")).alias("smiles")).where("formula is not null")


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    return df.limit(rows)


def inserted(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of `new` whose key the table lacks, one a key (the smallest row): what an insert-or-ignore appends."""
    other = [c for c in new.columns if c != key]
    once = new.groupBy(key).agg(F.min(F.struct(*other)).alias("_row")).select(key, *(F.col(f"_row.{c}").alias(c) for c in other))
    return once.join(table.select(key).distinct(), key, "left_anti").select(*new.columns)


def report(counts: DataFrame, name: str) -> DataFrame:
    """Score rows and an overall row, with precision, recall and F1 to three digits."""
    columns = [F.round(c, 3).alias(c) for c in ("precision", "recall", "f1")]
    each = with_prf(counts).select(F.col(name).cast("string").alias(name), "tp", "fp", "fn", *columns)
    return each.unionByName(micro(counts).select(F.lit("Overall").alias(name), "tp", "fp", "fn", *columns))


def newest(files: DataFrame, key: str = "doc", path: str = "path", time: str = "modified") -> DataFrame:
    """The newest file of each key; ties by the larger path."""
    return files.groupBy(key).agg(F.max_by(path, F.struct(time, path)).alias(path))


def kept_current(make: Callable[[], DataFrame], path: str, changed: datetime | None, force: bool = False) -> DataFrame:
    """A table that is made once and read from `path` from then on; made again if `force`, if it is not there, or if its source
    changed after it was written. Readers see the old one until the new one is whole: it is written beside it first."""
    spark = SparkSession.getActiveSession()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    mark = hadoop(f"{path}/_SUCCESS")
    fs = mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stale = force or not fs.exists(mark) or (changed is not None and fs.getFileStatus(mark).getModificationTime() < changed.timestamp() * 1000)
    if stale:
        beside = f"{path}.new"
        make().write.mode("overwrite").parquet(beside)
        fs.delete(hadoop(path), True)
        fs.rename(hadoop(beside), hadoop(path))
    return spark.read.parquet(path)
