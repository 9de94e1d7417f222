"""Operator 13: how five filters of documents interact, in every order.

A relational word pipeline: the words of every text are exploded, counted by (doc_id, word), and those counts summed by
document to totals and distinct words; the other flags are outer-joined. A document's failures are five bits, so each part
is aggregated to 32 conditional counts, and three times 32 with the labels. All that the 120 orders say is a sum of those.

Filters, by failure: A under 100 words; B fewer than 80 distinct words a hundred; C more than 10 of A-Z a hundred code
points; D any of `#$%&*|`; E the text of a smaller doc_id. Null and blank texts have no words: they fail A, not B; a null
text equals an empty one. A null or empty lang is the part ''. Rows with a null doc_id are judged like others, but have no
smaller id and are none; they have no labels. Repeated rows each count, and are no copies of each other. A document with
several labels has a mark if one of them has. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplespan.llm import common

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 100, 80, 10, "[#$%&*|]"


def word_statistics(texts: DataFrame) -> DataFrame:
    """doc_id, text_key, n_words and n_distinct of every text of (doc_id, text_key, text) that has words.

    Repeated rows become one before anything is dealt, by the key that the two groupings below share: only texts are moved."""
    once = texts.select("doc_id", "text_key", "text").dropDuplicates(["doc_id", "text_key"])
    exploded = once.select("doc_id", "text_key", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
    by_word = exploded.groupBy("doc_id", "text_key", "word").agg(F.count("*").alias("n"))
    return by_word.groupBy("doc_id", "text_key").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part and booleans A to E, true for a failure, of every row of (doc_id, text, lang)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    flags = texts.select(
        "doc_id", "part", "text_key", F.xxhash64(F.lit(1), "text").alias("second"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")) > MOST_CAPITALS * F.length("text")).alias("C"), F.col("text").rlike(SYMBOLS).alias("D"),
    )
    flags = common.written(flags, "flags")
    firsts = flags.groupBy("text_key", "second").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    firsts = common.written(firsts.select("text_key", "second", "first"), "firsts")  # so that Spark can split a text of very many copies
    counts = word_statistics(texts).withColumnsRenamed({"doc_id": "_doc", "text_key": "_key"})
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key"))
    found = flags.join(counts, same, "left").join(common.if_small(firsts), ["text_key", "second"], "left")
    n, distinct = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    return found.select(
        "doc_id", "part", (n < LEAST_WORDS).alias("A"), (100 * distinct < LEAST_DISTINCT * n).alias("B"), "C", "D",
        F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)).alias("E"),
    )


def audited(rows: DataFrame, filters: Sequence[str] = FILTERS, part: str = "part", marks: Sequence[str] = ("good", "toxic")) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, <mark>_lost and shapley of rows with a boolean
    column for each of `filters`, named by one character, and for each of `marks`."""
    kinds, sets = ["n", *marks], range(1 << len(filters))
    mask = sum(F.when(F.col(f), 1 << k).otherwise(0) for k, f in enumerate(filters))
    of = {"n": F.lit(True)} | {m: F.col(m) for m in marks}
    rows = rows.select(part, mask.alias("_mask"), *(of[k].alias(k) for k in kinds))
    counts = rows.groupBy(part).agg(*(F.count_if((F.col("_mask") == s) & F.col(k)).alias(f"{k}_{s}") for k in kinds for s in sets))
    counts = counts.select(part, *(F.array(*(f"{k}_{s}" for s in sets)).alias(k) for k in kinds))

    orders = F.split(F.lit(" ".join(sorted(map("".join, permutations(filters))))), " ")
    steps = counts.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    bit = "shiftleft(1, instr('{}', substr(filter_order, {}, 1)) - 1)".format
    names = "".join(filters)
    steps = steps.withColumn("_bit", F.expr(bit(names, "step"))).withColumn("_through", F.expr(f"aggregate(sequence(1, step), 0, (x, i) -> x | {bit(names, 'i')})"))
    total = f"aggregate(sequence(0, {sets[-1]}), 0L, (x, m) -> x + if({{}}, {{}}, 0L))".format
    here, before = "(m & _bit) <> 0", "(m & (_through ^ _bit))"
    return steps.select(
        part, "filter_order", "step",
        F.expr(total("(m & _through) = 0", "n[m]")).alias("kept"),
        F.expr(total(f"{here} and {before} = 0", "n[m]")).alias("removed"),
        F.expr(total(f"{here} and {before} <> 0", "n[m]")).alias("redundant"),
        F.expr("n[_bit]").alias("unique_fails"),
        *(F.expr(total(f"{here} and {before} = 0", f"{m}[m]")).alias(f"{m}_lost") for m in marks),
        F.expr(total(here, f"n[m] * ({factorial(len(filters))} div bit_count(m))")).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = common.labels(spark, sf_dir).where("doc_id is not null").groupBy("doc_id")
    marked = marked.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = failures(common.documents(spark, sf_dir)).join(marked, "doc_id", "left")
    return audited(rows.withColumns({m: F.coalesce(m, F.lit(False)) for m in ("good", "toxic")}))


OP13_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
     firsts AS (SELECT text, min(doc_id) AS first FROM texts GROUP BY text),
     marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
     flags AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                 (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
                 + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT
                 + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(first < texts.doc_id, false)::INT AS mask
               FROM texts JOIN firsts USING (text) LEFT JOIN marks ON marks.doc_id = texts.doc_id),
     counts AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM flags GROUP BY part, mask),
     letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
     orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
                WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
     steps AS (SELECT filter_order, step::INT AS step, (1 << (ascii(filter_order[step]) - 65))::INT AS bit,
                 list_sum(list_transform(range(1, step + 1), lambda i: 1 << (ascii(filter_order[i]) - 65)))::INT AS through
               FROM orders, range(1, 6) r(step))
SELECT part, filter_order, step,
       coalesce(sum(n) FILTER (mask & through = 0), 0)::BIGINT AS kept,
       coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & (through - bit) = 0), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & (through - bit) <> 0), 0)::BIGINT AS redundant,
       coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
       coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & (through - bit) = 0), 0)::BIGINT AS good_lost,
       coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & (through - bit) = 0), 0)::BIGINT AS toxic_lost,
       coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) FILTER (mask & bit <> 0), 0)::BIGINT AS shapley
FROM counts, steps GROUP BY part, filter_order, step
"""
