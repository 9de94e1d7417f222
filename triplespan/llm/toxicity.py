"""Operator 10: severity of toxicity by cumulative-link ordinal regression on sparse text features.

Features are the terms (runs of letters, lower-cased) whose presence the labels tie to toxicity: of the labelled
sample (at most `SAMPLE` rows, those with the smallest hash of doc_id) all those in `LEAST_ROWS` rows or more whose
likelihood ratio pays for its term as an information criterion asks, `G2_PER_LOG_ROW` times the logarithm of the sample's
size. A text's feature is log(1 + count). The model is P(grade <= k) = sigmoid(theta_k - w x): one weight vector for all
thresholds. Every document gets its expected severity sum_k P(grade > k), and is toxic if P(grade >= 1) reaches the cutoff
that parts the sample best.

Grades are the labels themselves where these tell more than two apart (toxic 0, 1, 2, ...). Labels of 0 and 1 hold no
severity, so toxic rows are then graded 1 to 3 by cross-fitting: the sample is dealt into `FOLDS` by a hash of doc_id, each
fold is scored by a model of two grades that the other folds' labels fit, and the scores of toxic rows are cut at their
thirds. No row's grade comes from its own label's weight, and no row is relabelled: toxic rows stay 1 or more, others 0.

Null and empty texts have no features and get the severity of a text without tied terms. Documents without labels are
scored like others; labels that are null or refer to no document are left out. Without toxic rows in the sample all
severities are 0. Extra columns pass through `marked`; an input column with the name of an output gives way to it. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triplespan.llm import common

SAMPLE, G2_PER_LOG_ROW, LEAST_ROWS, GRADES, FOLDS = 10_000, 3.2, 3, 4, 5
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    """weights by term, the thresholds in ascending order, and the P(grade >= 1) from which a text is toxic."""

    weights: dict[str, float]
    thresholds: list[float]
    cutoff: float = 0.5

    def above(self, text: str | None) -> list[float]:
        """P(grade > k) for each threshold k."""
        x = 0.0
        if self.weights and text:
            for t, n in sorted(Counter(filter(self.weights.__contains__, terms(text))).items()):
                x += self.weights[t] * math.log1p(n)
        return [1 / (1 + math.exp(min(700.0, t - x))) if t < math.inf else 0.0 for t in self.thresholds]


def terms(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def with_terms(docs: DataFrame) -> DataFrame:
    """doc_id, toxic and the terms of `docs`, as scoring reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([terms(t.as_py()) for t in b.column("text")], pa.list_(pa.string()))
            yield b.select(["doc_id", "toxic"]).append_column("terms", found)

    return docs.select("doc_id", "toxic", "text").transform(common.in_arrow, run, "doc_id long, toxic long, terms array<string>")


@dataclass
class Features:
    """A sparse matrix: row, column and value of each entry."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    shape: tuple[int, int]

    @classmethod
    def of(cls, x: np.ndarray) -> Features:
        return cls(*np.nonzero(x), x[np.nonzero(x)], x.shape)

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weights[self.column], self.shape[0])

    def transposed_times(self, by_row: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * by_row[self.row], self.shape[1])

    def only(self, rows: np.ndarray) -> Features:
        """The rows that are marked, numbered anew."""
        keep, new = rows[self.row], np.cumsum(rows) - 1
        return Features(new[self.row[keep]], self.column[keep], self.value[keep], (int(rows.sum()), self.shape[1]))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Counts run in Spark over the sample; the tied terms and at most `sample` sparse rows reach the driver."""
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    table = common.written(with_terms(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")), "toxic-sample")
    n = {r["toxic"]: r["n"] for r in table.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0 = n.get(0, 0)
    n1 = sum(n.values()) - n0
    if not n1 or not n0:
        return Model({}, [math.inf] * (GRADES - 1))
    a, b = F.col("a"), F.col("b")
    cell = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    both = (a + b) / (n1 + n0)
    g2 = 2 * (cell(a, both * n1) + cell(b, both * n0) + cell(n1 - a, (1 - both) * n1) + cell(n0 - b, (1 - both) * n0))
    is_toxic = (F.col("toxic") > 0).cast("int")
    counted = table.select(is_toxic.alias("t"), F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.sum("t").alias("a"), F.sum(1 - F.col("t")).alias("b"))
    tied = counted.where((a + b >= LEAST_ROWS) & (a * n0 > b * n1)).where(g2 >= G2_PER_LOG_ROW * math.log(n1 + n0))
    names = sorted(r["term"] for r in tied.select("term").collect())
    found = F.filter("terms", lambda t: t.isin(names)) if names else F.array().cast("array<string>")
    kept = table.select("toxic", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).alias("fold"), "doc_id", found.alias("terms")).orderBy("doc_id").collect()

    at = {t: i for i, t in enumerate(names)}
    cells = [(i, at[t], math.log1p(c)) for i, r in enumerate(kept) for t, c in sorted(Counter(r["terms"]).items())]
    row, column, value = zip(*cells, strict=True) if cells else ((), (), ())
    x = Features(np.array(row, np.int64), np.array(column, np.int64), np.array(value), (len(kept), len(names)))
    grade = np.array([r["toxic"] for r in kept])
    toxic = grade > 0
    if grade.max() == 1:
        grade = cross_graded(x, toxic, np.array([r["fold"] for r in kept]))
    weights, thresholds = ordinal(x, grade, int(grade.max()) + 1)
    return Model(dict(zip(names, weights.tolist(), strict=True)), thresholds.tolist(), cutoff(x.times(weights) - thresholds[0], toxic))


def cross_graded(x: Features, toxic: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """0 for rows that are not toxic, 1 to GRADES - 1 for others by thirds of the scores that other folds' models give them."""
    score = np.zeros(len(toxic))
    for f in np.unique(fold):
        weights, thresholds = ordinal(x.only(fold != f), toxic[fold != f].astype(int), 2) if (fold != f).any() else (np.zeros(x.shape[1]), np.zeros(1))
        score[fold == f] = x.only(fold == f).times(weights) - thresholds[0]
    cuts = np.quantile(score[toxic], np.arange(1, GRADES - 1) / (GRADES - 1))
    return np.where(toxic, 1 + np.searchsorted(cuts, score), 0)


def cutoff(logit: np.ndarray, toxic: np.ndarray) -> float:
    """The probability that parts toxic rows from others best (hits less false alarms), amid its gap in logits."""
    order = np.argsort(logit, kind="stable")
    logit, toxic = logit[order], toxic[order]
    gain = np.cumsum(~toxic) / max(1, (~toxic).sum()) - np.cumsum(toxic) / max(1, toxic.sum())
    gain[:-1][logit[1:] <= logit[:-1]] = -np.inf  # equal scores stay together
    i = int(np.argmax(gain))
    return float(1 / (1 + np.exp(-(logit[i] + logit[min(i + 1, len(logit) - 1)]) / 2)))


def ordinal(x: Features, grade: np.ndarray, grades: int, ridge: float = 0.02, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds of the cumulative-link model, by Adam on the ridge-penalised likelihood.

    Thresholds are the first plus positive steps exp(d), so they stay in order."""
    k = grades - 1
    p = np.concatenate([np.zeros(x.shape[1]), [1.0], np.zeros(k - 1)])
    m, v = np.zeros_like(p), np.zeros_like(p)
    lower, upper = grade > 0, grade < k
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, steps + 1):
        w, gaps = p[: x.shape[1]], np.exp(p[x.shape[1] + 1 :])
        theta = p[x.shape[1]] + np.concatenate([[0.0], np.cumsum(gaps)])
        eta = x.times(w)
        hi = np.where(upper, sig(theta[np.minimum(grade, k - 1)] - eta), 1.0)
        lo = np.where(lower, sig(theta[np.maximum(grade - 1, 0)] - eta), 0.0)
        prob = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / prob, lo * (1 - lo) / prob  # of log prob by the upper and lower threshold
        dtheta = np.bincount(np.minimum(grade, k - 1), dhi * upper, k) - np.bincount(np.maximum(grade - 1, 0), dlo * lower, k)
        dw = x.transposed_times(dlo - dhi) - ridge * x.shape[0] / 100 * w
        dgap = np.cumsum(dtheta[::-1])[::-1][1:] * gaps
        g = np.concatenate([dw, [dtheta.sum()], dgap]) / max(1, x.shape[0])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return p[: x.shape[1]], p[x.shape[1]] + np.concatenate([[0.0], np.cumsum(np.exp(p[x.shape[1] + 1 :]))])


def marked(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str, str] = ("severity", "p_toxic", "toxic")) -> DataFrame:
    """`docs` with severity (expected grade), p_toxic and toxic."""
    docs = common.giving_way(docs, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            above = [model.above(t.as_py()) for t in b.column(text)]
            new = (pa.array(map(sum, above), pa.float64()), pa.array([a[0] for a in above], pa.float64()), pa.array([a[0] >= model.cutoff for a in above], pa.bool_()))
            for name, values in zip(names, new, strict=True):
                b = b.append_column(name, values)
            yield b

    new = zip(names, (T.DoubleType(), T.DoubleType(), T.BooleanType()), strict=True)
    return docs.transform(common.in_arrow, run, T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in new)]))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return marked(docs, fitted(docs, common.labels(spark, sf_dir))).drop("text")
