"""Digests of documents, and tables of parsed documents that follow a folder by reading anew only what has changed.

Below `target`, `rows/` holds the parsed rows by bucket of the document's name and by run, and `manifest/` one digest a document
for each run, with the run that wrote its bucket last. A run counts only once its manifest is there, so a run that fails on the
way leaves the old table as it was. Old runs stay until someone deletes them; readers of an old table are not disturbed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplespan.plans.tables import written

MANIFEST = "doc string, digest string, bucket int, written int, run int"


def digests(parts: DataFrame, doc: str, name: Column, content: Column) -> DataFrame:
    """(doc, digest): SHA-256 over the names and contents of a document's parts, whatever their order; a null content counts as
    an empty one. Only short digests of parts are gathered by document."""
    part = F.sha2(F.concat_ws(":", F.sha2(name.cast("string").cast("binary"), 256), F.sha2(F.coalesce(content.cast("binary"), F.lit(b"")), 256)), 256)
    each = parts.select(F.col(doc).alias("doc"), part.alias("part"))
    return each.groupBy("doc").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("part")), ",").cast("binary"), 256).alias("digest"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc, kind): documents that are `new`, `changed` or `gone`, of two tables of digests."""
    both = old.select("doc", F.col("digest").alias("before")).join(new.select("doc", F.col("digest").alias("now")), "doc", "full")
    kind = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("before") != F.col("now"), "changed")
    return both.select("doc", kind.alias("kind")).where("kind is not null")


def documents(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(doc, path, content) of the files below <folder>/<doc>/, or of <folder>/<doc> itself; path is relative."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    root = folder.rstrip("/").rsplit("/", 1)[-1]
    below = F.regexp_extract("path", rf".*?/\Q{root}\E/(.*)$", 1)
    return files.select(F.substring_index(below, "/", 1).alias("doc"), below.alias("path"), "content")


def _manifest(spark: SparkSession, target: str) -> DataFrame | None:
    """The newest manifest, or None before the first run."""
    try:
        found = spark.read.schema(MANIFEST).parquet(f"{target}/manifest")
    except AnalysisException:
        return None
    last = found.agg(F.max("run")).first()[0]
    return None if last is None else found.where(F.col("run") == last)


def refresh(spark: SparkSession, folder: str, target: str, parse: Callable[[DataFrame], DataFrame], pattern: str = "*", buckets: int = 64) -> dict[str, int]:
    """Brings the table at `target` up to the files below `folder` and returns how many documents were new, changed or gone.

    `parse` makes rows with a column doc from (doc, path, content) of the documents that are new or changed; no others reach
    it. Only their buckets, and those of documents that are gone, are written. All files are read for their digests."""
    files = documents(spark, folder, pattern)
    bucket = F.pmod(F.xxhash64("doc"), F.lit(buckets)).cast("int")
    now = written(digests(files, "doc", F.col("path"), F.col("content")), "digests")
    old = _manifest(spark, target)
    before = spark.createDataFrame([], MANIFEST) if old is None else old
    moved = written(changes(before, now).withColumn("bucket", bucket), "changes")
    counts = {r["kind"]: r["n"] for r in moved.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # three rows
    counts = {k: counts.get(k, 0) for k in ("new", "changed", "gone")}
    if not any(counts.values()) and old is not None:
        return counts
    run = 1 if old is None else old.select("run").first()[0] + 1
    touched = [r["bucket"] for r in moved.select("bucket").distinct().collect()]  # at most `buckets` numbers
    rows = parse(files.join(moved.where("kind <> 'gone'"), "doc", "left_semi")).withColumn("bucket", bucket).withColumn("run", F.lit(run))
    kept = None if old is None else _rows(spark, target, old.where(F.col("bucket").isin(touched)))
    if kept is not None:
        rows = rows.unionByName(kept.join(moved, "doc", "left_anti").withColumn("run", F.lit(run)), allowMissingColumns=True)
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "run").parquet(f"{target}/rows")
    past = F.lit(0) if old is None else F.col("past")
    placed = now.withColumn("bucket", bucket)
    if old is not None:
        placed = placed.join(old.groupBy("bucket").agg(F.max("written").alias("past")), "bucket", "left")
    manifest = placed.select("doc", "digest", "bucket", F.when(F.col("bucket").isin(touched), run).otherwise(past).alias("written"), F.lit(run).alias("run"))
    manifest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{target}/manifest")
    return counts


def _rows(spark: SparkSession, target: str, manifest: DataFrame) -> DataFrame | None:
    """Rows of the manifest's buckets, each as its last run wrote it; only their folders are read. None if there are none."""
    places = manifest.select("bucket", "written").distinct().collect()  # at most one a bucket
    try:
        rows = spark.read.parquet(f"{target}/rows")
    except AnalysisException:  # no document has given a row yet
        return None
    wanted = F.lit(False)
    for p in places:
        wanted = wanted | ((F.col("bucket") == p["bucket"]) & (F.col("run") == p["written"]))
    return rows.where(wanted)


def current(spark: SparkSession, target: str) -> DataFrame | None:
    """The rows of all documents as of the last finished run; None before the first row."""
    manifest = _manifest(spark, target)
    rows = None if manifest is None else _rows(spark, target, manifest)
    return None if rows is None else rows.drop("bucket", "run")
