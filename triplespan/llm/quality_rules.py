"""Operator 5: base quality counts and a hashed n-gram log-likelihood ratio.

Every word and every pair of neighbouring words falls into one of `BUCKETS` hash buckets. Two multinomials
with add-one smoothing are counted: the trusted target (all documents that labels.quality marks 1) and the raw corpus (all documents, all words). A
document's score is the mean over its n-grams of log p_target - log p_raw; documents below `THRESHOLD`, or
that fail the base rules, are not kept. Everything is deterministic.

Null and empty texts have no words: counts 0, score 0, base_failed. Documents without labels only lack
influence on the target. Repeated rows give repeated results. Extra columns are ignored. An empty table gives
an empty result; without trusted documents the target is uniform. Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplespan.llm import common

BUCKETS = 1 << 14
THRESHOLD = -0.1
REPEAT_WINDOW = 8


def bucket(h: Column, buckets: int = BUCKETS) -> Column:
    """Bucket of a hash; `buckets` is a power of two."""
    return h.bitwiseAND(F.lit(buckets - 1)).cast("int")


def let(value: Column, body) -> Column:
    """body(value) with `value` computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hashed(docs: DataFrame, *more: Column) -> DataFrame:
    """Adds h1, the hash of every word, and h2, that of every word with the one before it (none at the start)."""
    h1 = F.transform(common.words(F.col("text")), lambda w: F.xxhash64(w))
    pair = F.transform("h1", lambda x, i: F.xxhash64(F.get(F.col("h1"), i - 1), x))
    return docs.select("doc_id", *more, h1.alias("h1")).withColumn("h2", pair)


def repeated_words(h2: Column) -> Column:
    """Number of words inside 8-word windows that occur twice or more in a text, the first included.

    Hashes of pairs combine to those of four and eight words. Where some are equal, (hash, end) is sorted by
    native order and equal neighbours are repeats; their ends in order cover min(8, gap to the next) words each.
    """
    n = REPEAT_WINDOW
    fours = lambda h: F.transform(h, lambda x, i: F.xxhash64(F.get(h, i - 2), x))
    eights = lambda h: F.transform(h, lambda x, i: F.xxhash64(F.get(h, i - 4), x))

    def covered(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        size = F.size(windows)

        def ends(pairs: Column) -> Column:
            hash_at = lambda k: F.get(pairs, k)["h"]
            marked = F.filter(pairs, lambda p, k: ((k > 0) & (hash_at(k - 1) == p["h"])) | ((k < size - 1) & (hash_at(k + 1) == p["h"])))
            return F.sort_array(F.transform(marked, lambda p: p["i"]))

        def length(s: Column) -> Column:
            gaps = F.transform(s, lambda x, k: F.least(F.lit(n), F.coalesce(F.get(s, k + 1) - x, F.lit(n))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

        return let(let(pairs, ends), length)

    none = F.lit(0).cast("long")
    windows = let(let(h2, fours), lambda f: F.slice(eights(f), n, F.size(f) - n + 1))
    counted = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(none))
    return F.when(F.size(h2) > n, counted).otherwise(none)


def bucket_weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: weights, an array of `buckets` values log p_target - log p_raw.

    All trusted documents are counted; their ids are broadcast only if their count proves them small. Counts merge map-side to
    `buckets` rows.
    """
    trusted = labels.where("quality = 1").select("doc_id").distinct().withColumn("trusted", F.lit(1))
    marked = docs.select("doc_id", "text").join(common.if_small(trusted), "doc_id", "left")
    grams = hashed(marked, F.col("trusted")).select("trusted", F.explode(F.concat("h1", "h2")).alias("h"))
    counts = grams.groupBy(bucket(F.col("h"), buckets).alias("bucket")).agg(F.count("*").alias("raw"), F.count("trusted").alias("target"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    gathered = every.groupBy().agg(
        F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("target", F.lit(0)).alias("t"), F.coalesce("raw", F.lit(0)).alias("r")))).alias("g"),
        F.coalesce(F.sum("target"), F.lit(0)).alias("all_t"),
        F.coalesce(F.sum("raw"), F.lit(0)).alias("all_r"),
    )
    log = lambda n, total: F.log((n + 1) / (F.col(total) + buckets))
    return gathered.select(F.transform("g", lambda x: log(x["t"], "all_t") - log(x["r"], "all_r")).alias("weights"))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base counts, base_failed, llr (the length-normalised log-likelihood ratio) and kept."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(common.WORD))
    counts = (
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )
    weigh = lambda h: F.aggregate(h, F.lit(0.0), lambda a, x: a + F.get(F.col("weights"), bucket(x)))
    llr = (weigh("h1") + weigh("h2")) / (2 * F.size("h1"))
    n_words = F.size("h1").cast("long")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        hashed(docs, *counts)
        .withColumn("weights", bucket_weights(docs, labels).scalar())
        .select("doc_id", n_words.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", repeated_words(F.col("h2")).alias("n_repeat_words"), F.when(F.size("h1") > 0, llr).otherwise(0.0).alias("llr"))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(common.documents(spark, sf_dir).select("doc_id", "text"), common.labels(spark, sf_dir))
