"""Operator 2: quality classifier by a sparse rule ensemble.

Statistics of the whole text (`STATISTICS`) are Spark columns. A random forest is grown on a bounded sample of
labelled rows (at most `SAMPLE`, those with the smallest hash of doc_id, never held out); each path from a root to
a node is a conjunctive rule. Lasso logistic regression weighs the rules, and those with a weight other than zero
become one Spark column expression: score = sigmoid(bias + sum of the weights of the rules that hold).

Rows with crc32(doc_id as text) mod 5 = 0 are held out: labels of theirs are never read. Null and empty texts have
all statistics 0 and a score like others. Without rows of both labels the score is the sample's mean label (0.5
without rows). Repeated rows give repeated results. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplespan.llm import common

SAMPLE, TREES, DEPTH, LASSO, CUT, SEED = 10_000, 24, 3, 0.0005, 0.3, 7

Rule = tuple[tuple[int, str, float], ...]  # conditions (statistic, "<=" or ">", value), all of which hold


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """`keep` columns and one double column for each of STATISTICS; 0 where a text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    count = lambda p: F.regexp_count(F.col("t"), F.lit(p)).cast("double")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    base = docs.select(*keep, text.alias("t"), common.words(F.col("text")).alias("w")).withColumn("n", F.size("w").cast("double"))
    repeats = F.size(F.filter("w", lambda x, i: x == F.get(F.col("w"), i - 1))).cast("double")
    chars, lines = F.length("t").cast("double"), F.filter(F.split("t", "\n"), lambda x: x != "")
    counted = base.select(
        *keep, "n", chars.alias("chars"), F.size(F.array_distinct("w")).cast("double").alias("kinds"), repeats.alias("repeats"),
        count(r"[#*$%&|<>]").alias("symbols"), count(r"!").alias("bangs"), count(r"\p{Lu}").alias("upper"), count(r"[0-9]").alias("digits"), count(r"[.,;:?]").alias("stops"),
        lines.alias("lines"),
    )
    n, chars = F.col("n"), F.col("chars")
    n_lines = F.size("lines").cast("double")
    return counted.select(
        *keep,
        F.log1p(n).alias("log_words"),
        share(chars - n, n).alias("word_length"),
        share(F.col("kinds"), n).alias("distinct_words"),
        share(F.col("repeats"), n).alias("repeated_neighbours"),
        share(F.col("symbols"), n).alias("symbols_per_word"),
        share(F.col("bangs"), n).alias("bangs_per_word"),
        share(F.col("upper"), chars).alias("upper_share"),
        share(F.col("digits"), chars).alias("digit_share"),
        share(F.col("stops"), n).alias("stops_per_word"),
        share(n, n_lines).alias("words_per_line"),
        share(n_lines - F.size(F.array_distinct("lines")), n_lines).alias("repeated_lines"),
    )


STATISTICS = ("log_words", "word_length", "distinct_words", "repeated_neighbours", "symbols_per_word", "bangs_per_word", "upper_share", "digit_share", "stops_per_word", "words_per_line", "repeated_lines")


def held_out(doc_id: Column) -> Column:
    """Never null: a row without an id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def paths(tree: str) -> list[Rule]:
    """Every path from the root to an inner or leaf node of one tree's debug string."""
    rules, above = [], []
    for line in tree.splitlines():
        if m := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
            depth = len(m[1])
            while above and above[-1][0] >= depth:
                above.pop()
            above.append((depth, (int(m[2]), m[3], float(m[4]))))
            rules.append(tightest(x for _, x in above))
    return rules


def tightest(conditions: Iterable[tuple[int, str, float]]) -> Rule:
    """One condition for each statistic and sign, in order, so that equal conjunctions are equal rules."""
    found: dict[tuple[int, str], float] = {}
    for feature, sign, value in conditions:
        key = feature, sign
        found[key] = value if key not in found else (min if sign == "<=" else max)(found[key], value)
    return tuple((f, s, v) for (f, s), v in sorted(found.items()))


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for feature, sign, value in rule:
        c = F.col(STATISTICS[feature])
        out = out & (c <= value if sign == "<=" else c > value)
    return out


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[float, list[tuple[Rule, float]]]:
    """The bias and the rules with their weights. The sample is one bounded partition in a fixed order."""
    known = labels.where("quality is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("double").alias("label"))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), "doc_id", "label")
    table = common.written(rows, "quality-sample").coalesce(1).sortWithinPartitions("doc_id")
    n, good = table.agg(F.count("*"), F.sum("label")).first()
    if not n or good in (0, n):
        mean = good / n if n else 0.5
        return math.log((mean + 1e-3) / (1 - mean + 1e-3)), []
    vectors = table.select("label", array_to_vector(F.array(*STATISTICS)).alias("features")).cache()
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="sqrt", subsamplingRate=0.7, seed=SEED).fit(vectors)
    vectors.unpersist()
    rules = sorted({r for t in forest.trees for r in paths(t.toDebugString)})
    held = table.select("label", array_to_vector(F.array(*(holds(r).cast("double") for r in rules))).alias("features")).cache()
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False).fit(held)
    held.unpersist()
    return lasso.intercept, [(r, w) for r, w in zip(rules, lasso.coefficients.toArray().tolist(), strict=True) if w]


def score(bias: float, rules: list[tuple[Rule, float]]) -> Column:
    """The rules as one expression over the columns of `statistics`."""
    total = F.lit(bias)
    for rule, weight in rules:
        total = total + F.when(holds(rule), F.lit(weight)).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    bias, rules = fitted(docs, common.labels(spark, sf_dir))
    scored = statistics(docs, "doc_id").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(bias, rules).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
