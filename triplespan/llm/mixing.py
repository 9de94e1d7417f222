"""Operator 6: mixing sources to target weights with whole copies and one hash-seeded Bernoulli copy.

A document's size is its number of words. Targets share the total size by weight; where a target would pass
`MOST` times its source's size it stops there and the excess is shared again by weight. With
rate = target / source size, a document is taken floor(rate) times and once more with probability
rate - floor(rate), decided by a hash of its id, so reruns and any partitioning agree.

Null and empty texts have size 0 and are taken 0 words. A null source is a source of its own, after all others.
Sources of size 0 have target 0. Repeated ids get the same draw. Extra columns pass through `mixed`; an input
column with the name of an output gives way to it. An empty table gives an empty result. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triplespan.llm import common

WEIGHTS = (1, 2, 3)
MOST = 3


def _sums_before(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """`rows`, a few bytes each, with the sums over all rows before each in `order`: within ranges of rows as windows, and
    over the ranges, one row each. No task holds more than a range."""
    placed = common.written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    of_range = placed.groupBy("_range").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    earlier = W.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = of_range.select("_range", *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}") for n in sums))
    inside = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    here = placed.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    return here.join(F.broadcast(starts), "_range").select(*rows.columns, *((F.col(n) + F.col(f"_{n}")).alias(n) for n in sums))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target from rows (source, size).

    Capped sharing in closed form: in order of most * size / weight, a source is capped while its own cap per
    weight is at most the level that the rest would get; the others get the level that the first of them finds.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = F.col("source").asc_nulls_last()
    numbered = _sums_before(by_source, [by_name], {"place": F.lit(1)})
    ranked = numbered.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    ranked = ranked.select("source", "source_size", "w", (F.lit(most) * F.col("source_size")).cast("double").alias("cap"))
    found = _sums_before(ranked, [F.col("cap") / F.col("w"), by_name], {"cap_before": F.col("cap"), "w_before": F.col("w")})
    found = common.written(found, "ranked")
    total, w_total = found.agg(F.sum("source_size"), F.sum("w")).first()
    # the level per weight if all before this source are capped and no other is
    level = (F.lit(float(total or 0)) - F.col("cap_before")) / (F.lit(w_total or 0) - F.col("w_before"))
    found = found.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("level") * F.col("w"))
    share = found.agg(F.max(F.when(~F.col("capped"), F.col("level")))).first()[0]  # that of the first one that is not capped
    return found.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.lit(share).cast("double") * F.col("w")).alias("target"))


def draw(doc_id: Column) -> Column:
    """Uniform in [0, 1) from the id: the first 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, names: tuple[str, ...] = ("size", "source_size", "target", "copies")) -> DataFrame:
    """`docs` with size, source_size, target and copies, the number of times that the mix takes a document.

    The table of sources is written and measured, and broadcast only if it is small; else Spark splits a hot source as a
    skewed join.
    """
    docs = common.giving_way(docs, names)
    size, source_size, target, copies = names
    sizes = docs.select("source", common.n_words(F.col("text")).alias("size"))
    source = common.unused(docs.withColumns({n: F.lit(0) for n in names}), "source")[0]
    by_source = common.written(targets(sizes, weights, most).toDF(source, source_size, target), "sources")
    rate = F.when(F.col(source_size) > 0, F.least(F.col(target) / F.col(source_size), F.lit(float(most)))).otherwise(0.0)
    drawn = F.floor(rate) + F.when(draw(F.col("doc_id")) < rate - F.floor(rate), 1).otherwise(0)
    longest = by_source.agg(F.max(F.octet_length(source))).first()[0] or 0
    found = docs.withColumn(size, common.n_words(F.col("text"))).join(common.if_small(by_source, 64 + longest), F.col("source").eqNullSafe(F.col(source)))
    return found.drop(source).withColumn(copies, drawn.cast("long"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "source", "text")
    return mixed(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP6_SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
     by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
     ranked AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, 3.0::DOUBLE * source_size AS cap FROM by_source),
     levels AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER up, 0)) / ((sum(w) OVER ())::DOUBLE - coalesce(sum(w) OVER up, 0)::DOUBLE) AS level
                FROM ranked WINDOW up AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     targets AS (SELECT source, source_size, CASE WHEN cap <= level * w THEN cap
                   ELSE (max(CASE WHEN cap > level * w THEN level END) OVER ()) * w END AS target FROM levels),
     rated AS (SELECT doc_id, size, source_size, target,
                 CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
                 (('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS u
               FROM sized JOIN targets t ON sized.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM rated
"""
