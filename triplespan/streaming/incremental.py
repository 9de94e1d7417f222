"""Incremental loads with Structured Streaming: an extension beyond fixed graphs.

A run reads the files that came since the last one (`availableNow`) and replaces the documents that they hold, so a rerun after a
failure gives the same table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplespan.plans.tables import written


def upsert_documents(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame] = lambda df: df, buckets: int = 64) -> None:
    """Parquet rows with a column doc, parsed and written below `target` in `buckets` folders by a hash of doc; new rows of a
    document replace all of its old ones. Only buckets with new documents are written again, from a table of what they held,
    so a failed write loses nothing."""

    def write(batch: DataFrame, _: int) -> None:
        bucket = F.pmod(F.xxhash64("doc"), F.lit(buckets)).cast("int")
        new = written(parse(batch).withColumn("bucket", bucket), "arrived")
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most `buckets` numbers
        if not touched:
            return
        try:
            old = spark.read.schema(new.schema).parquet(target).where(F.col("bucket").isin(touched))  # reads these folders only
        except AnalysisException:  # the first batch
            old = None
        kept = new if old is None else new.unionByName(old.join(new.select("doc").distinct(), "doc", "left_anti"))
        kept = written(kept, "merged")
        kept.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, time: str, by: str, value: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Count and sum by time window and column; works on a stream, where rows later than `late` are left out, and on a table."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        events = events.withWatermark(time, late)
    grouped = events.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), by, "n", "total")


def collected(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and reads its result back from `folder`."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
