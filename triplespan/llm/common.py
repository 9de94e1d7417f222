"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


#: Bytes of an Arrow batch, fewer than Spark's own 64 MB, as batches are held in both processes of two tasks at a time, and in
#: the JVM come from chunks of 16 MB that it keeps.
BATCH_BYTES = 1 << 20


def _then_trimmed(run):
    """`run`, after which the worker, which stays for other tasks, gives its free memory back where it can."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim is not None:
            trim(0)

    return trimmed


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """`df.mapInArrow` with batches of about BATCH_BYTES. Spark reads that bound when a job runs, so it stays set in the session;
    a session that names one keeps its own."""
    conf, size = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(size, None) is None:
        conf.set(size, str(BATCH_BYTES))
    return df.mapInArrow(_then_trimmed(run), schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a folder under the warehouse only where none is named and all run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that `written` made, through Hadoop's file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


#: A side of at most this many bytes, as counted, is broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def if_small(table: DataFrame, row_bytes: int | None = None) -> DataFrame:
    """A table of numbers, or of `row_bytes` a row, marked for broadcast only if its count proves it small."""
    return F.broadcast(table) if (row_bytes or 16 * len(table.columns)) * table.count() <= BROADCAST_BYTES else table


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """`docs` but those whose key is in `ids`."""
    return docs.join(if_small(ids.select(key).where(F.col(key).isNotNull())), key, "left_anti").select(*docs.columns)


def only(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """`docs` whose key is in `ids`."""
    return docs.join(if_small(ids.select(key)), key, "left_semi").select(*docs.columns)


def giving_way(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """`df` without the columns that have one of `names`, which an operator is about to add."""
    new = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in new))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Each name with as many underscores before it as make it one that `df` does not have."""
    old = {c.lower() for c in df.columns}
    mark = "_"
    while any((mark + n).lower() in old for n in names):
        mark += "_"
    return [mark + n for n in names]


def words(text: Column) -> Column:
    """Array of the text's words; empty for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
