"""Candidates for text comparisons from equi-joins, with bounds that are exact: nothing that could match is left out.

A text is the set of its characters, each numbered by its occurrence (`a1`, `a2`, `n1`, ...), so that what two texts have in
common is an intersection, and no ratio of matching blocks exceeds it. Sets are ordered rarest first. Two sets that must
share o tokens share one within the first n - o + 1 of each, so texts meet on those only.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplespan.plans.tables import written

#: For bounds in floating point.
SLACK = 1e-9
#: Tokens whose order is counted; all others come before them. Any order is exact.
ORDERED = 256
#: Longest part of a query that a containment join looks up.
GRAM = 5
#: A side of at most this many rows, as counted, is broadcast.
ROWS = 100_000
#: Queries and labels, and characters of either, that a task compares at a time.
BLOCK_QUERIES, CHUNK_LABELS, BLOCK_CHARS, CHUNK_CHARS = 256, 4096, 1 << 18, 1 << 20


def if_few(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast only if its count proves it small."""
    return F.broadcast(table) if table.count() <= ROWS else table


def tokens(text: Column) -> Column:
    """The distinct numbered characters of a text; none for a null one."""
    chars = F.sort_array(F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda x: x != ""))
    return F.transform(chars, lambda c, i: F.concat(c, (i - F.array_position(chars, c) + 2).cast("string")))


def ranked(texts: DataFrame, column: str, common: list[str]) -> DataFrame:
    """`texts` with `tokens`, those not in `common` first, then those in it from its end."""
    order = F.from_json(F.lit(json.dumps(common)), "array<string>")
    key = lambda t: F.struct(F.when(F.array_position(order, t) == 0, 0).otherwise(len(common) + 1 - F.array_position(order, t)), t.alias("t"))
    return texts.withColumn("tokens", F.transform(F.sort_array(F.transform(tokens(F.col(column)), key)), lambda x: x["t"]))


def most_common(texts: DataFrame, column: str) -> list[str]:
    """The ORDERED most frequent tokens, most frequent first."""
    counts = texts.select(F.explode(tokens(F.col(column))).alias("t")).groupBy("t").count()
    return [r["t"] for r in counts.orderBy(F.desc("count"), "t").limit(ORDERED).collect()]


def _prefix(all_tokens: Column, least: Column) -> Column:
    return F.slice(all_tokens, F.lit(1), F.greatest(F.size(all_tokens) - F.ceil(least - SLACK).cast("int") + 1, F.lit(0)))


def near_pairs(queries: DataFrame, labels: DataFrame, cutoff: float, part: bool = False) -> DataFrame:
    """Pairs (q, l) of distinct texts of `queries` (q) and `labels` (l) whose characters allow a ratio of `cutoff`: that of
    the whole texts, or, with `part`, that of the shorter text and a part of the longer one of its length.

    Whole: 2 o >= cutoff (n + m). As m is at least cutoff / (2 - cutoff) n, a prefix needs no partner's length. Part: o is at
    least cutoff times the shorter length, and the shorter one's prefix meets all tokens of the longer one."""
    if not 0 < cutoff <= 1:
        raise ValueError("a cutoff must be over 0, as texts without a common character are never compared")
    queries, labels = queries.select("q").where("q <> ''").distinct(), labels.select("l").where("l <> ''").distinct()
    order = most_common(labels, "l")
    q = ranked(queries, "q", order).withColumnRenamed("tokens", "qt")
    known = ranked(labels, "l", order).withColumnRenamed("tokens", "lt")
    n, m = F.size("qt"), F.size("lt")
    both = F.size(F.array_intersect("qt", "lt"))
    if part:
        of = lambda df, t, name: df.select("*", F.explode(t).alias("t"), F.lit(name).alias("side"))
        q = of(q, _prefix(F.col("qt"), cutoff * n), "q").union(of(q, F.col("qt"), "l"))
        known = of(known, F.col("lt"), "q").union(of(known, _prefix(F.col("lt"), cutoff * m), "l"))
        on, shorter = ["t", "side"], F.when(F.col("side") == "q", n <= m).otherwise(m < n)
        condition = shorter & (both >= cutoff * F.least(n, m) - SLACK)
    else:
        share = cutoff / (2 - cutoff)
        q = q.select("q", "qt", F.posexplode(_prefix(F.col("qt"), share * n)).alias("p", "t"))
        known = known.select("l", "lt", F.posexplode(_prefix(F.col("lt"), share * m)).alias("r", "t"))
        needed = cutoff * (n + m) / 2 - SLACK
        on, condition = ["t"], (F.least(n, m) >= needed) & (1 + F.least(n - F.col("p") - 1, m - F.col("r") - 1) + F.least("p", "r") >= needed) & (both >= needed)
    return q.join(known, on).where(condition).select("q", "l").distinct()


def most_in_order(query: str, codes: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """For each text the most characters that it and `query` have in the same order, or more: no ratio of matching blocks exceeds it.

    `codes` has a column a text: the places of its characters in the sorted `alphabet`, then len(alphabet). The bits of a word are
    64 places of the query, and what several words count is added."""
    points = np.frombuffer(query.encode("utf-32-le"), np.uint32)
    total = np.zeros(codes.shape[1], np.int64)
    for start in range(0, len(points), 64):
        part, masks = points[start : start + 64], np.zeros(len(alphabet) + 1, np.uint64)
        at = np.minimum(np.searchsorted(alphabet, part), len(alphabet) - 1)
        known = alphabet[at] == part
        np.bitwise_or.at(masks, at[known], np.uint64(1) << np.arange(len(part), dtype=np.uint64)[known])
        free = np.full(codes.shape[1], (1 << 64) - 1, np.uint64)
        for row in codes:
            met = free & masks[row]
            free = (free + met) | (free - met)
        total += np.bitwise_count(~free & np.uint64((1 << len(part)) - 1))
    return total


def best_in(queries: list[str], labels: list[str], cutoff: float, limit: int, ratio: Callable[[str, str], float]) -> Iterator[tuple[str, str, float]]:
    """(query, label, ratio) of the best `limit` labels of each query with a ratio of `cutoff`, and all as good as the last of them.

    Labels are compared in order of the bound by `most_in_order`, until none left can be as good as the last one."""
    labels = sorted(labels, key=len)
    size, groups, start = np.array([len(x) for x in labels]), [], 0
    while start < len(labels):  # texts of like length, so that the padded characters are bounded
        end = start + 1
        while end < len(labels) and (end + 1 - start) * size[end] <= 4 * CHUNK_CHARS:
            end += 1
        points = np.frombuffer("".join(labels[start:end]).encode("utf-32-le"), np.uint32)
        alphabet, code = np.unique(points, return_inverse=True)
        codes = np.full((end - start, size[end - 1]), len(alphabet))
        codes[np.arange(size[end - 1]) < size[start:end, None]] = code
        groups.append((np.ascontiguousarray(codes.T), alphabet))
        start = end
    for q in queries:
        bound = 2 * np.minimum(np.concatenate([most_in_order(q, *g) for g in groups]), size) / (len(q) + size)
        at = np.flatnonzero(bound >= cutoff - SLACK)
        found: list[tuple[float, str]] = []
        last = cutoff
        for k in at[np.argsort(-bound[at], kind="stable")]:
            if bound[k] < last - SLACK:
                break
            if (score := ratio(q, labels[k])) >= last:
                found.append((score, labels[k]))
                last = sorted((s for s, _ in found), reverse=True)[limit - 1] if len(found) >= limit else cutoff
        yield from ((q, x, s) for s, x in found if s >= last)


def best_pairs(queries: DataFrame, labels: DataFrame, cutoff: float, limit: int, ratio: Callable[[str, str], float]) -> DataFrame:
    """(q, l, score) of each distinct text of `queries` (q) and its best `limit` distinct texts of `labels` (l), as `best_in`.

    Every block of queries meets every chunk of labels, as tasks of bounded size; blocks are broadcast if they are few."""
    spread = labels.sparkSession.sparkContext.defaultParallelism
    queries, labels = (written(df.select(c).where(F.col(c) != "").distinct(), c) for df, c in ((queries, "q"), (labels, "l")))
    (n, chars), (m, label_chars) = (df.agg(F.count("*"), F.coalesce(F.sum(F.length(c)), F.lit(0))).first() for df, c in ((queries, "q"), (labels, "l")))
    blocks = max(1, -(-n // BLOCK_QUERIES), -(-chars // BLOCK_CHARS))
    chunks = max(min(2 * spread, m), -(-m // CHUNK_LABELS), -(-label_chars // CHUNK_CHARS), 1)
    asked = queries.groupBy(F.pmod(F.xxhash64("q"), F.lit(blocks)).alias("block")).agg(F.collect_list("q").alias("queries"))
    known = labels.withColumn("chunk", F.pmod(F.xxhash64("l"), F.lit(chunks))).repartition(chunks, "chunk").groupBy("chunk").agg(F.collect_list("l").alias("labels"))
    cells = known.select("labels", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    cells = cells.join(F.broadcast(asked) if n <= ROWS else asked, "block").select("queries", "labels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qs, ls in zip(b.column("queries"), b.column("labels"), strict=True):
                rows = list(best_in(qs.as_py(), ls.as_py(), cutoff, limit, ratio))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))], ["q", "l", "score"])

    return cells.mapInArrow(run, "q string, l string, score double")


def containing(queries: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs (key, name) of distinct `queries` (key) and `names` (name) where the name holds the key; an empty key is in none.

    A name that holds a key holds all its parts of GRAM characters (of a shorter key, the key). Of those each key is looked up
    by the one that fewest names hold, so that keys made of common parts only meet many names, and those mostly match."""
    size = lambda key: F.least(F.length(key), F.lit(GRAM))
    parts = lambda text, g: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - g + 1), lambda i: F.substring(text, i, g)))
    keys = queries.select("key").where("key <> ''").distinct()
    asked = written(keys.select("key", F.explode(parts(F.col("key"), size("key"))).alias("gram")), "grams")
    sizes = [r[0] for r in asked.select(F.length("gram")).distinct().collect()]  # of 1 to GRAM
    known = names.select("name").where("name is not null").distinct()
    of_size = [F.when(F.length("name") >= g, parts(F.col("name"), F.lit(g))).otherwise(F.array().cast("array<string>")) for g in sizes]
    known = known.select("name", F.explode(F.concat(*of_size) if sizes else F.array().cast("array<string>")).alias("gram"))
    held = known.join(if_few(written(asked.select("gram").distinct(), "asked")), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rated = asked.join(held, "gram", "left").groupBy("key").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    rarest = if_few(written(rated, "rarest"))
    return known.join(rarest, "gram").where(F.col("name").contains(F.col("key"))).select("key", "name")
