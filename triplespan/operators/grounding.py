"""Entity lookup, fuzzy matching, grounding of one graph on another, and merging of equal entities."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triplespan.functions.text import normal_label
from triplespan.operators.candidates import best_pairs, containing, near_pairs
from triplespan.plans.patterns import COLUMNS, LABEL
from triplespan.plans.tables import written

ALTERNATIVE = "http://www.w3.org/2004/02/skos/core#altLabel"
SAME = "http://www.w3.org/2002/07/owl#sameAs"


def _ratios(pairs, autojunk: bool) -> list[float]:
    return [0.0 if a is None or b is None else SequenceMatcher(None, a, b, autojunk=autojunk).ratio() for a, b in pairs]


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks, 2 * matched / (len a + len b); popular characters of long texts are skipped."""
    return pd.Series(_ratios(zip(a, b, strict=True), True))


@F.pandas_udf(T.DoubleType())
def whole_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The same with popular characters, so equal texts have 1: for canonical structure strings."""
    return pd.Series(_ratios(zip(a, b, strict=True), False))


def best_part(x: str | None, y: str | None) -> float:
    """The best ratio of the shorter text with any equally long part of the longer one.

    A part shares at most so many characters with the shorter text, counted as the window moves: parts are tried in order of
    that bound, and none is tried that cannot beat the best one."""
    if not x or not y:
        return 0.0
    short, long = sorted((x, y), key=len)
    n, want, have, both, bounds = len(short), Counter(short), Counter(), 0, []
    for end, c in enumerate(long):
        both, have[c] = both + (have[c] < want[c]), have[c] + 1
        if end >= n:
            old = long[end - n]
            have[old] -= 1
            both -= have[old] < want[old]
        if end >= n - 1:
            bounds.append((-both, end - n + 1))
    best, matcher = 0.0, SequenceMatcher(None, autojunk=False)
    matcher.set_seq2(short)
    for bound, start in sorted(bounds):
        if -bound / n <= best:
            break
        matcher.set_seq1(long[start : start + n])
        best = max(best, matcher.ratio())
    return best


@F.pandas_udf(T.DoubleType())
def best_part_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """`best_part` of each pair."""
    return pd.Series([best_part(x, y) for x, y in zip(a, b, strict=True)])


def sorted_words(c: Column) -> Column:
    return F.array_join(F.sort_array(F.split(F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), " ")), " ")




#: The text that a scorer compares, and whether it takes parts.
FORMS = {"ratio": (F.lower, False), "structure": (lambda c: c, False), "partial": (F.lower, True), "words": (sorted_words, False)}


def compared(queries: DataFrame, candidates: DataFrame, cutoff: float = 0.6, scorer: str = "ratio") -> DataFrame:
    """Pairs of distinct queries (query) and candidates (label, ...) with a score of `cutoff`, over 0, or more. Pairs come
    from an index of rare characters (`near_pairs`), so that Python only sees those whose characters allow the cutoff."""
    form, part = FORMS[scorer]
    asked = queries.select("query", form(F.col("query")).alias("q")).distinct()
    known = candidates.withColumn("l", form(F.col("label")))
    pairs = near_pairs(asked, known, cutoff, part)
    score = {"ratio": ratio, "structure": whole_ratio, "partial": best_part_ratio, "words": ratio}[scorer]
    scored = pairs.withColumn("score", score(F.col("q"), F.col("l"))).where(F.col("score") >= cutoff)
    return scored.join(asked, "q").join(known, "l").select("query", *candidates.columns, "score")


#: Cutoffs that are tried before the one that is asked for, where parts of texts are compared.
STEPS = (0.95, 0.85, 0.7)


def nearest(queries: DataFrame, candidates: DataFrame, cutoff: float = 0.6, limit: int = 1, scorer: str = "ratio") -> DataFrame:
    """As `compared`, but for each query at least its best `limit` candidates and all as good as the last of them.

    Whole texts are compared in order of a bound on their ratio (`best_pairs`), so that few pairs of a query reach the exact one.
    For parts of texts cutoffs fall step by step, as a high one has short prefixes, and a query leaves when it has found enough."""
    if not 0 < cutoff <= 1:
        raise ValueError("a cutoff must be over 0, as texts without a common character are never compared")
    form, part = FORMS[scorer]
    if not part:
        asked = queries.select("query", form(F.col("query")).alias("q")).where("query is not null").distinct()
        known = candidates.withColumn("l", form(F.col("label")))
        junk = scorer != "structure"
        scored = best_pairs(asked, known, cutoff, limit, lambda a, b: SequenceMatcher(None, a, b, autojunk=junk).ratio())
        place = F.rank().over(W.partitionBy("q").orderBy(F.desc("score")))  # Spark cuts to the limit before it shuffles
        best = scored.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")
        return best.join(asked, "q").join(known, "l").select("query", *candidates.columns, "score")
    left, found = written(queries.select("query").where("query is not null").distinct(), "queries"), []
    for step in (*(s for s in STEPS if s > cutoff), cutoff):
        got = written(compared(left, candidates, step, scorer), "scored")
        done = got.groupBy("query").agg(F.count_distinct("label").alias("n")).where(F.col("n") >= limit) if step > cutoff else got.select("query").distinct()
        found.append(got.join(done.select("query"), "query", "left_semi"))
        if step > cutoff:
            left = written(left.join(done, "query", "left_anti"), "queries")
            if left.isEmpty():
                break
    return reduce(DataFrame.union, found)


def fuzzy(queries: DataFrame, candidates: DataFrame, cutoff: float = 0.6, limit: int = 10, scorer: str = "ratio") -> DataFrame:
    """For each row of `queries` (query) the best `limit` labels of `candidates` (label) with a score of `cutoff` or more,
    rounded to four digits, ties by label."""
    scored = nearest(queries, candidates.select("label").distinct(), cutoff, limit, scorer)
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "label"))  # Spark cuts to the limit before it shuffles
    return scored.withColumn("_place", place).where(F.col("_place") <= limit).select("query", "label", F.round("score", 4).alias("score"))


def best_of(scored: DataFrame, key: str = "subject", limit: int = 10) -> DataFrame:
    """Keeps each subject's best score, then the best subjects; ties by subject."""
    return scored.groupBy(key).agg(F.max("score").alias("score")).orderBy(F.desc("score"), key).limit(limit)


def by_label(queries: DataFrame, labels: DataFrame) -> DataFrame:
    """(query, iri, score): 100 for the same normalised label; only where there is none, 50 for labels that contain it.
    A blank query is in no label."""
    q = queries.select("query", normal_label(F.col("query")).alias("key")).distinct()
    known = labels.select("iri", normal_label(F.col("label")).alias("name"))
    exact = known.join(q, F.col("name") == F.col("key")).select("query", "iri", F.lit(100).alias("score"))
    rest = q.join(exact.select("query").distinct(), "query", "left_anti")
    inside = containing(rest, known).join(rest, "key").join(known, "name").select("query", "iri", F.lit(50).alias("score"))
    return exact.union(inside).distinct()


def candidates(triples: DataFrame) -> DataFrame:
    """(s, labels): IRI subjects with their label first, then their other names in order."""
    named = triples.where(F.col("p").isin(LABEL, ALTERNATIVE))
    named = named.where("s_kind = 'iri'") if "s_kind" in triples.columns else named
    placed = named.groupBy("s").agg(F.sort_array(F.collect_set(F.struct(F.when(F.col("p") == LABEL, 0).otherwise(1).alias("rank"), F.col("o").alias("label")))).alias("l"))
    return placed.select("s", F.array_distinct(F.transform("l", lambda x: x["label"])).alias("labels"))


def grounded(named: DataFrame, reference: DataFrame, cutoff: float = 0.6) -> DataFrame:
    """(s, iri): each candidate's match among `reference` (class, iri, label).

    Its labels are tried in order, and the first with a match decides: best score, then smallest IRI."""
    asked = named.select("s", F.posexplode("labels").alias("place", "query"))
    scores = nearest(asked, reference.select(F.col("label"), "iri"), cutoff)
    pairs = asked.join(scores.select("query", "iri", "score"), "query")
    return pairs.groupBy("s").agg(F.min_by("iri", F.struct("place", (-F.col("score")).alias("x"), "iri")).alias("iri"))


#: Distinct predicates that are broadcast with what they become.
PREDICATES = 100_000


def renamed(triples: DataFrame, known: DataFrame, columns: str) -> DataFrame:
    """Columns s, p and IRI o of `triples`, those named, by (_from, _to). There are few predicates, so `known` is cut to
    them and broadcast, as counted: a shuffle by predicate would send most triples to a few tasks."""
    for c in columns:
        table = known
        if c == "p":
            used = triples.select(F.col("p").alias("_from")).distinct()
            table = written(known.join(used, "_from", "left_semi"), "predicates")
            n = table.count()
            if n == 0:
                continue
            table = F.broadcast(table) if n <= PREDICATES else table
        same = F.col(c) == F.col("_from")
        same = same & (F.col("o_kind") != "lit") if c == "o" else same
        triples = triples.join(table, same, "left").withColumn(c, F.coalesce("_to", c)).drop("_from", "_to")
    return triples


def replaced(triples: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rewrites subjects, predicates and IRI objects by (s, iri); what is not mapped stays. Equal triples become one."""
    known = mapping.where("iri is not null").select(F.col("s").alias("_from"), F.col("iri").alias("_to"))
    return renamed(triples, known, "spo").select(*COLUMNS).distinct()


def with_same_as(triples: DataFrame, mapping: DataFrame) -> DataFrame:
    """Adds (s, sameAs, iri) for mapped entities."""
    added = mapping.where("iri is not null and iri <> s").select("s", F.lit(SAME).alias("p"), F.col("iri").alias("o"), F.lit("iri").alias("o_kind"))
    return triples.select(*COLUMNS).union(added).distinct()


def canonical(triples: DataFrame, rounds: int = 10) -> DataFrame:
    """(s, iri): entities with the same facts, and the smallest IRI among them, repeated until nothing changes.

    Each round takes the facts of current representatives with their predicates and objects replaced by representatives,
    and groups subjects by a 256-bit digest of the sorted facts, which merges map-side to one short row a subject."""
    facts = triples.select("s", "p", "o", "o_kind")
    mapping = None
    for _ in range(rounds):
        current = facts
        if mapping is not None:
            old = mapping.where("s <> iri").select(F.col("s").alias("_from"), F.col("iri").alias("_to"))
            current = renamed(current.join(old.select(F.col("_from").alias("s")), "s", "left_anti"), old, "po")
        signed = current.groupBy("s").agg(F.sha2(F.to_json(F.sort_array(F.collect_set(F.struct("p", "o", "o_kind")))), 256).alias("digest"))
        least = signed.groupBy("digest").agg(F.min("s").alias("iri"), F.count("*").alias("n")).where("n > 1").select("digest", "iri")
        new = written(signed.join(least, "digest").where("s <> iri").select("s", "iri"))
        if new.isEmpty():
            break
        if mapping is None:
            mapping = new
        else:
            moved = mapping.join(new.select(F.col("s").alias("iri"), F.col("iri").alias("_to")), "iri", "left").select("s", F.coalesce("_to", "iri").alias("iri"))
            mapping = written(moved.union(new))
    if mapping is None:
        return triples.sparkSession.createDataFrame([], "s string, iri string")
    return mapping


def first_seen(rows: DataFrame, key: list[str], place: str) -> DataFrame:
    """Each key's first row by `place`; merges map-side, so a frequent key is no hot task."""
    other = [c for c in rows.columns if c not in key]
    kept = rows.groupBy(*key).agg(F.min_by(F.struct(*other), place).alias("_row"))
    return kept.select(*key, *(F.col(f"_row.{c}").alias(c) for c in other))


def best_per_key(rows: DataFrame, key: list[str], score: str, tie: str) -> DataFrame:
    """Each key's row of highest score, ties by the smallest `tie`."""
    other = [c for c in rows.columns if c not in key]
    kept = rows.groupBy(*key).agg(F.min_by(F.struct(*other), F.struct(-F.col(score), F.col(tie))).alias("_row"))
    return kept.select(*key, *(F.col(f"_row.{c}").alias(c) for c in other))


def first_available(rows: DataFrame, key: list[str], fields: list[str], place: str, missing: str = "N/A") -> DataFrame:
    """Each field's first value, by `place`, that is not missing."""
    value = lambda f: F.when(F.col(f) != missing, F.col(f))
    return rows.groupBy(*key).agg(*(F.coalesce(F.min_by(value(f), F.when(value(f).isNotNull(), F.col(place))), F.lit(missing)).alias(f) for f in fields))


def valid_or_all(rows: DataFrame, key: list[str], valid: Column) -> DataFrame:
    """Rows that are valid, or all rows of keys that have no valid one."""
    marked = rows.withColumn("_valid", F.coalesce(valid, F.lit(False)))
    keys = marked.where("_valid").select(*key).distinct().withColumn("_any", F.lit(True))
    return marked.join(keys, key, "left").where("_valid or _any is null").drop("_valid", "_any")


def context(sentences: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """Sentences (doc, i, sentence, hit) that hit, with their neighbours joined."""
    near = W.partitionBy("doc").orderBy("i").rowsBetween(-before, after)
    return sentences.withColumn("context", F.array_join(F.collect_list("sentence").over(near), " ")).where("hit").drop("hit")
