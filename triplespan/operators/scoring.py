"""Scores of predictions against truth: counts of true and false positives and false negatives, and tests on them."""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from triplespan.plans.tables import spread, written

COUNTS = ("tp", "fp", "fn")


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; 0 where a denominator is 0."""
    zero = F.lit(0.0)
    precision, recall = F.coalesce(F.try_divide(tp, tp + fp), zero), F.coalesce(F.try_divide(tp, tp + fn), zero)
    return precision, recall, F.coalesce(F.try_divide(2 * precision * recall, precision + recall), zero)


def with_prf(counts: DataFrame) -> DataFrame:
    precision, recall, f1 = prf(*map(F.col, COUNTS))
    return counts.withColumns({"precision": precision, "recall": recall, "f1": f1})


def _sums(df: DataFrame, by: list[str], **columns: Column) -> DataFrame:
    return df.groupBy(*by).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for n, c in columns.items()))


def multisets(truth: DataFrame, found: DataFrame, by: list[str], value: str) -> DataFrame:
    """Counts per `by`: what both have, as often as the rarer one has it; surplus is a false positive or negative.

    Rows of both sides meet in one shuffle by key and value, spread by their count, so that a task's tables stay small."""
    return _compared(truth, found, by, value, F.sum)


def _compared(truth: DataFrame, found: DataFrame, by: list[str], value: str, times) -> DataFrame:
    """Counts per `by` of rows of two sides, `times` telling how often a side has a value. A missing value or key equals none."""
    missing = reduce(Column.__or__, [F.col(c).isNull() for c in (*by, value)])
    side = lambda df, t, f: df.select(*by, value, F.lit(t).alias("t"), F.lit(f).alias("f"), F.when(missing, F.lit(t)).alias("_apart"))
    rows = spread(side(truth, 1, 0).union(side(found, 0, 1)), *by, value)
    both = rows.groupBy(*by, value, "_apart").agg(times("t").alias("t"), times("f").alias("f"))
    return _sums(both, by, tp=F.least("t", "f"), fp=F.greatest(F.col("f") - F.col("t"), F.lit(0)), fn=F.greatest(F.col("t") - F.col("f"), F.lit(0)))


def lenient(counts: DataFrame) -> DataFrame:
    """Extra values only count against a row without any hit."""
    return counts.withColumn("fp", F.when(F.col("tp") > 0, F.lit(0)).otherwise(F.col("fp")).cast("long"))


def fair_sets(truth: DataFrame, found: DataFrame, by: list[str], value: str) -> DataFrame:
    """Sets, where extra values only count against a key without any hit."""
    return lenient(sets(truth, found, by, value))


def sets(truth: DataFrame, found: DataFrame, by: list[str], value: str) -> DataFrame:
    """Counts per `by` on distinct values."""
    return _compared(truth, found, by, value, F.max)


def anchored(truth: DataFrame, found: DataFrame, key: str, value: str, same=lambda a, b: a == b) -> DataFrame:
    """One row: n_truth, n_found, n_matched (keys of both) and n_equal (with values that `same` accepts)."""
    t, f = truth.select(key, F.col(value).alias("t")), found.select(key, F.col(value).alias("f"))
    both = t.withColumn("in_t", F.lit(1)).join(f.withColumn("in_f", F.lit(1)), key, "full")
    n = lambda c: F.count(F.when(c, 1)).alias
    in_t, in_f = F.col("in_t").isNotNull(), F.col("in_f").isNotNull()
    return both.agg(n(in_t)("n_truth"), n(in_f)("n_found"), n(in_t & in_f)("n_matched"), n(in_t & in_f & same(F.col("t"), F.col("f")))("n_equal"))


def fields(truth: DataFrame, found: DataFrame, key: list[str], names: Iterable[str], missing: tuple[str, ...] = ("", "N/A")) -> DataFrame:
    """Counts by field over records with equal keys: a value that differs is a false positive and a false negative."""
    names = list(names)
    long = lambda df, v: df.select(*key, F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias(v)) for n in names))).alias("x")).select(*key, "x.*")
    both = long(truth, "t").join(long(found, "f"), [*key, "field"], "full")
    t, f = (F.when(~F.col(c).isin(*missing), F.col(c)) for c in ("t", "f"))
    equal = t.eqNullSafe(f) & t.isNotNull()
    return _sums(both, ["field"], tp=equal.cast("int"), fp=(f.isNotNull() & ~equal).cast("int"), fn=(t.isNotNull() & ~equal).cast("int"))


def differences(truth: DataFrame, found: DataFrame, key: list[str], names: Iterable[str]) -> DataFrame:
    """(key, field, truth, found) where records differ."""
    long = lambda df, v: df.select(*key, F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias(v)) for n in names))).alias("x")).select(*key, "x.*")
    names = list(names)
    return long(truth, "truth").join(long(found, "found"), [*key, "field"], "full").where(~F.col("truth").eqNullSafe(F.col("found")))


def micro(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    return with_prf(_sums(counts, by or [], **{c: F.col(c) for c in COUNTS}))


def macro(counts: DataFrame, by: str) -> DataFrame:
    """Mean F1 of each `by` over the rows that it has."""
    return with_prf(counts).groupBy(by).agg(F.avg("f1").alias("f1"))


def presence(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """One row: how many rows have each column, with something in it."""
    return df.agg(*(F.count(F.when(F.length(F.col(n).cast("string")) > 0, 1)).alias(n) for n in names))


def coverage(expected: DataFrame, got: DataFrame, by: str, value: str) -> DataFrame:
    """Counts per `by` of distinct values: expected, got, and those of both, missing and extra."""
    counts = sets(expected, got, [by], value)
    return counts.select(by, (F.col("tp") + F.col("fn")).alias("n_expected"), (F.col("tp") + F.col("fp")).alias("n_got"), F.col("tp").alias("n_both"), F.col("fn").alias("n_missing"), F.col("fp").alias("n_extra"))


def positional(truth: Column, found: Column) -> Column:
    """(tp, fp, fn) of two arrays compared place by place. The contract is inferred from its uses."""
    n, m = F.coalesce(F.size(truth), F.lit(0)), F.coalesce(F.size(found), F.lit(0))
    pairs = F.filter(F.arrays_zip(truth.alias("t"), found.alias("f")), lambda x: x["t"] == x["f"])
    tp = F.coalesce(F.size(pairs), F.lit(0))
    return F.struct(tp.alias("tp"), (m - tp).alias("fp"), (n - tp).alias("fn"))


def step_names(steps: Column) -> Column:
    """Type names of an array of steps (type, chemicals): an Add counts once for each of its chemicals."""
    return F.flatten(F.transform(steps, lambda s: F.when(s["type"] == "Add", F.array_repeat(s["type"], F.greatest(F.size(s["chemicals"]), F.lit(1)))).otherwise(F.array(s["type"]))))


def scoreboard(parts: dict[str, DataFrame], by: str, only: Iterable[str] | None = None) -> DataFrame:
    """(category, by, tp, fp, fn, precision, recall, f1): the counts of each category by document, of the documents in `only` if
    given, and an Overall row for each category and for all of them (category NULL)."""
    rows = None
    for category, counts in parts.items():
        part = counts.groupBy(F.col(by).cast("string").alias(by)).agg(*(F.sum(c).cast("long").alias(c) for c in COUNTS)).select(F.lit(category).alias("category"), by, *COUNTS)
        rows = part if rows is None else rows.union(part)
    rows = rows if only is None else rows.where(F.col(by).isin(*map(str, only)))
    each = micro(rows, ["category"]).select("category", F.lit("Overall").alias(by), *COUNTS)
    every = micro(rows).select(F.lit(None).cast("string").alias("category"), F.lit("Overall").alias(by), *COUNTS)
    return with_prf(rows.union(each).union(every))


# records of characterisation


def _counts(tp: Column, fp: Column, fn: Column) -> Column:
    return F.struct(*(F.coalesce(c.cast("int"), F.lit(0)).alias(n) for n, c in zip(COUNTS, (tp, fp, fn), strict=True)))


def array_counts(truth: Column, found: Column) -> Column:
    """Counts of distinct values of two arrays."""
    t, f = (F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))) for c in (truth, found))
    both = F.size(F.array_intersect(t, f))
    return _counts(both, F.size(f) - both, F.size(t) - both)


def text_counts(truth: Column, found: Column, missing_both: Column) -> Column:
    """One value against another, empty for none: a hit if equal, or where both are missing."""
    t, f = F.coalesce(truth, F.lit("")), F.coalesce(found, F.lit(""))
    equal = (t == f) & (f != "")
    return F.when(missing_both, _counts(F.lit(1), F.lit(0), F.lit(0))).otherwise(_counts(equal, (f != "") & ~equal, (t != "") & ~equal))


def percent_counts(truth: Column, found: Column, missing_both: Column | None = None) -> Column:
    """Maps of numbers, equal to two decimals; a wrong number is only missed, an element that the truth lacks is extra."""
    t, f = (F.coalesce(c, F.create_map().cast("map<string,double>")) for c in (truth, found))
    hits = F.size(F.filter(F.map_entries(t), lambda e: F.coalesce(F.bround(F.element_at(f, e["key"]), 2) == F.bround(e["value"], 2), F.lit(False))))
    extra = F.size(F.array_except(F.map_keys(f), F.map_keys(t)))
    counts = _counts(hits, extra, F.size(t) - hits)
    return counts if missing_both is None else F.when(missing_both, _counts(F.lit(1), F.lit(0), F.lit(0))).otherwise(counts)


def record_fields(both: DataFrame, key: list[str], names: str, texts: Iterable[str], percents: Iterable[str], missing: tuple[str, ...] = ("", "n/a", "na", "-")) -> DataFrame:
    """(key, field, tp, fp, fn) of records with columns t_<field> and f_<field>: names as sets, texts as single values, percents
    as maps beside their text <field>_raw. A value that is missing on both sides is a hit."""
    absent = lambda n: F.lower(F.trim(F.coalesce(f"t_{n}", F.lit("")))).isin(*missing) & F.lower(F.trim(F.coalesce(f"f_{n}", F.lit("")))).isin(*missing)
    parts = {names: array_counts(F.col(f"t_{names}"), F.col(f"f_{names}"))}
    parts |= {n: text_counts(F.col(f"t_{n}"), F.col(f"f_{n}"), absent(n)) for n in texts}
    parts |= {n: percent_counts(F.col(f"t_{n}"), F.col(f"f_{n}"), absent(f"{n}_raw")) for n in percents}
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("field"), c.alias("c")) for n, c in parts.items())))
    return both.select(*key, rows.alias("r")).select(*key, "r.field", *(F.col(f"r.c.{c}").alias(c) for c in COUNTS))


def record_scores(truth: DataFrame, found: DataFrame, key: str, names: str, texts: Iterable[str]) -> DataFrame:
    """Counts a key of records (key, names, texts): the key itself, names without false positives (none on both sides is a
    hit), and each text, where none on both sides is a hit too and a wrong one counts twice."""
    texts = list(texts)
    side = lambda df, m: df.select(key, F.lit(1).alias(f"in_{m}"), F.col(names).alias(f"{m}_{names}"), *(F.nullif(F.col(c).cast("string"), F.lit("")).alias(f"{m}_{c}") for c in texts))
    both = side(truth, "t").join(side(found, "f"), key, "full")
    in_t, in_f = F.col("in_t").isNotNull(), F.col("in_f").isNotNull()
    of_names = array_counts(F.col(f"t_{names}"), F.col(f"f_{names}"))
    nothing = (F.coalesce(F.size(f"t_{names}"), F.lit(0)) <= 0) & (F.coalesce(F.size(f"f_{names}"), F.lit(0)) <= 0)
    parts = [_counts(in_t & in_f, ~in_t, ~in_f), F.when(nothing, _counts(F.lit(1), F.lit(0), F.lit(0))).otherwise(_counts(of_names["tp"], F.lit(0), of_names["fn"]))]
    for c in texts:
        t, f = F.col(f"t_{c}"), F.col(f"f_{c}")
        same = t.eqNullSafe(f)
        parts.append(_counts(same, ~same & f.isNotNull(), ~same & t.isNotNull()))
    total = lambda c: F.aggregate(F.array(*parts), F.lit(0), lambda a, p: a + p[c]).cast("long").alias(c)
    return both.select(key, *map(total, COUNTS))


# greedy one-to-one matching


def greedy(pairs: DataFrame, by: list[str], score: str, left: str, right: str) -> DataFrame:
    """Matches of highest score first, each left and right once within `by`; ties prefer larger right, then larger left.

    One fold over a document's sorted pairs. Matching one document is sequential, so `by` should name documents, whose pairs are
    few. A missing or undefined score comes last, and a missing side is never used up."""
    number = dict(pairs.dtypes)[score] in ("double", "float")
    place = F.when(F.isnan(score), None).otherwise(F.col(score)) if number else F.col(score)
    rest = [c for c in pairs.columns if c not in (*by, score, left, right)]
    row = F.struct(place.alias("_place"), F.col(right).alias("_right"), F.col(left).alias("_left"), F.struct(F.col(score), *rest).alias("_rest"))
    used = lambda c, x: F.coalesce(F.array_contains(c, x), F.lit(False))

    def step(state: Column, x: Column) -> Column:
        free = ~used(state["lefts"], x["_left"]) & ~used(state["rights"], x["_right"])
        taken = F.struct(F.array_append(state["lefts"], x["_left"]).alias("lefts"), F.array_append(state["rights"], x["_right"]).alias("rights"), F.array_append(state["kept"], x).alias("kept"))
        return F.when(free, taken).otherwise(state)

    rows = pairs.groupBy(*by).agg(F.sort_array(F.collect_list(row), asc=False).alias("_rows"))
    of = rows.schema["_rows"].dataType
    start = F.struct(*(F.array().cast(t).alias(n) for n, t in (("lefts", ArrayType(of.elementType["_left"].dataType)), ("rights", ArrayType(of.elementType["_right"].dataType)), ("kept", of))))
    kept = rows.select(*by, F.explode(F.aggregate("_rows", start, step, lambda state: state["kept"])).alias("_row"))
    value = {left: "_row._left", right: "_row._right"}
    return kept.select(*(F.col(c if c in by else value.get(c, f"_row._rest.{c}")).alias(c) for c in pairs.columns))


def unit_pairs(truth: DataFrame, found: DataFrame, by: str) -> DataFrame:
    """(by, t, f, score, overlap) of procedures (i, ccdc, names, formulas) of one document: 30 for the same deposit number, 12 a
    shared name, 8 a shared formula, 4 for equal non-empty sets of names, 4 for equal sets of formulas, 10 for both."""
    t = truth.select(by, F.col("i").alias("t"), *(F.col(c).alias(f"t_{c}") for c in ("ccdc", "names", "formulas")))
    f = found.select(by, F.col("i").alias("f"), *(F.col(c).alias(f"f_{c}") for c in ("ccdc", "names", "formulas")))
    both = t.join(f, by)
    shared = {c: F.size(F.array_intersect(f"t_{c}", f"f_{c}")) for c in ("names", "formulas")}
    equal = {c: (F.size(f"t_{c}") > 0) & (F.array_sort(F.array_distinct(f"t_{c}")) == F.array_sort(F.array_distinct(f"f_{c}"))) for c in shared}
    one = lambda c, n: F.when(c, n).otherwise(0)
    same = F.col("t_ccdc") == F.col("f_ccdc")
    score = one(same & (F.col("t_ccdc") != ""), 30) + 12 * shared["names"] + 8 * shared["formulas"] + one(equal["names"], 4) + one(equal["formulas"], 4) + one(equal["names"] & equal["formulas"], 10)
    return both.select(by, "t", "f", score.alias("score"), (shared["names"] + shared["formulas"]).alias("overlap"))


def formula_pairs(truth: DataFrame, found: DataFrame, by: str) -> DataFrame:
    """(by, t, f, score, overlap) of procedures (i, ccdc, formula1, formula2) of one document that share a formula: 20 for the
    same deposit number, 10 a shared formula, 5 for each formula that is equal in its own place."""
    side = lambda df, m: df.select(by, F.col("i").alias(m), *(F.coalesce(c, F.lit("")).alias(f"{m}_{c}") for c in ("ccdc", "formula1", "formula2")), formulas_of("formula1", "formula2").alias(f"{m}_set"))
    both = side(truth, "t").join(side(found, "f"), by)
    equal = lambda c, n: F.when((F.col(f"t_{c}") == F.col(f"f_{c}")) & (F.col(f"t_{c}") != ""), n).otherwise(0)
    overlap = F.size(F.array_intersect("t_set", "f_set"))
    score = equal("ccdc", 20) + 10 * overlap + equal("formula1", 5) + equal("formula2", 5)
    return both.where(overlap > 0).select(by, "t", "f", score.alias("score"), overlap.alias("overlap"))


def formulas_of(*columns: str) -> Column:
    return F.array_distinct(F.filter(F.array(*map(F.col, columns)), lambda x: F.length(x) > 0))


def matched_counts(truth: DataFrame, found: DataFrame, matches: DataFrame, by: str, values: Column) -> DataFrame:
    """Counts per `by` of the sets of matched procedures, and of all values of those without a match."""
    t = truth.select(by, F.col("i").alias("t"), values.alias("t_set"))
    f = found.select(by, F.col("i").alias("f"), values.alias("f_set"))
    both = t.join(matches.select(by, "t", "f"), [by, "t"], "left").join(f, [by, "f"], "full")
    counts = array_counts(F.col("t_set"), F.col("f_set"))
    return _sums(both, [by], **{c: counts[c] for c in COUNTS})


# steps of syntheses


def field_counts(t: dict, f: dict) -> tuple[int, int, int]:
    """Fields (name to text, or to a list of names) of two steps: a field that differs counts twice, one that a side lacks
    once; extra names in a list are no error."""
    tp = fp = fn = 0
    for name in t.keys() | f.keys():
        a, b = t.get(name), f.get(name)
        if isinstance(a, list) or isinstance(b, list):
            x, y = set(a or ()), set(b or ())
            tp += len(x & y) if x or y else 1
            fn += len(x - y)
        elif a == b:
            tp += 1
        else:
            fp += b is not None
            fn += a is not None
    return tp, fp, fn


def _same_product(a: list[str], b: list[str], shortest: int = 5) -> bool:
    return any(x == y or (min(len(x), len(y)) >= shortest and (x in y or y in x)) for x in a for y in b)


def _partner(synthesis: dict, others: dict[int, dict]) -> int | None:
    """The first synthesis left with a name in common, else the first with the same deposit number."""
    by_name = [i for i, o in others.items() if _same_product(synthesis["names"], o["names"])]
    by_number = [i for i, o in others.items() if synthesis["ccdc"] and synthesis["ccdc"] == o["ccdc"]]
    return next(iter(by_name + by_number), None)


def step_counts(truth: list[dict], found: list[dict], chemicals: str = "chemicals", in_order: bool = True) -> tuple[int, int, int]:
    """Counts of one document's syntheses (names, ccdc, steps of (type, fields)). Each true synthesis takes its partner among
    those left. An Add step takes the Add step left that shares most chemicals; others take the first step left from
    the place on that the number of steps taken so far names, or, without `in_order`, the step of their type with most equal fields. What is left on either side counts whole."""
    total = [0, 0, 0]

    def add(counts: tuple[int, int, int], use=(True, True, True)) -> None:
        for k in range(3):
            total[k] += counts[k] if use[k] else 0

    missed, extra = (False, False, True), (False, True, False)
    left = dict(enumerate(found))
    for synthesis in truth:
        partner = _partner(synthesis, left)
        steps = dict(enumerate(left.pop(partner)["steps"])) if partner is not None else {}
        n_steps = len(steps)
        for kind, fields in synthesis["steps"]:
            same_kind = [i for i, (k, _) in steps.items() if k.lower() == kind.lower()]
            if kind == "Add":
                mine = set(fields.get(chemicals) or ())
                shared = {i: len(mine & set(steps[i][1].get(chemicals) or ())) for i in same_kind}
                pick = max((i for i in shared if shared[i]), key=lambda i: (shared[i], -i), default=None)
            elif in_order:
                pick = min((i for i in steps if i >= n_steps - len(steps)), default=None)
            else:
                pick = max(same_kind, key=lambda i: (field_counts(fields, steps[i][1])[0], -i), default=None)
            if pick is None:
                add(field_counts(fields, {}), missed)
                continue
            other_kind, other = steps.pop(pick)
            if other_kind.lower() == kind.lower():
                add(field_counts(fields, other))
            else:
                add(field_counts(fields, {}), missed)
                add(field_counts({}, other), extra)
        for _, other in steps.values():
            add(field_counts({}, other), extra)
    for synthesis in left.values():
        for _, other in synthesis["steps"]:
            add(field_counts({}, other), extra)
    return tuple(total)


def step_scores(truth: DataFrame, found: DataFrame, by: str, in_order: bool = True) -> DataFrame:
    """(by, tp, fp, fn) of syntheses (by, i, names, ccdc, steps), steps being arrays of (type, chemicals, fields as a map).

    Matching one document is sequential, so `by` should name documents; their syntheses meet in one row of arrays."""

    def gathered(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("i", "names", F.coalesce("ccdc", F.lit("")).alias("ccdc"), "steps"))).alias(name))

    def syntheses(rows) -> list[dict]:
        step = lambda s: (s["type"], {e["key"]: e["value"] for e in s["fields"]} | ({"chemicals": list(s["chemicals"])} if s["chemicals"] is not None else {}))
        rows = rows if rows is not None else []
        return [{"names": list(r["names"] if r["names"] is not None else []), "ccdc": r["ccdc"], "steps": [step(s) for s in (r["steps"] if r["steps"] is not None else [])]} for r in rows]

    def run(batches):
        for batch in batches:
            counts = [step_counts(syntheses(t), syntheses(f), in_order=in_order) for t, f in zip(batch["t"], batch["f"], strict=True)]
            yield pd.DataFrame({by: batch[by], **{n: [c[k] for c in counts] for k, n in enumerate(COUNTS)}})

    # maps cannot be sorted in arrays; entries can
    plain = lambda df: df.withColumn("steps", F.transform("steps", lambda s: F.struct(s["type"].alias("type"), s["chemicals"].alias("chemicals"), F.map_entries(s["fields"]).alias("fields"))))
    both = gathered(plain(truth), "t").join(gathered(plain(found), "f"), by, "full")
    key = next(f for f in both.schema.fields if f.name == by)
    return both.mapInPandas(run, f"{by} {key.dataType.simpleString()}, tp long, fp long, fn long")


def near_numbers(truth: DataFrame, found: DataFrame, by: str, value: str, tolerance: float = 3) -> DataFrame:
    """Pairs of numbers at most `tolerance` apart: an equi-join on cells of that width and their neighbours, then the test."""
    cell = F.floor(F.col(value) / tolerance)
    t = truth.select(by, F.col(value).alias("t"), cell.alias("cell"))
    f = found.select(by, F.col(value).alias("f"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    return t.join(f, [by, "cell"]).where(F.abs(F.col("t") - F.col("f")) <= tolerance).drop("cell")


def near_matches(truth: DataFrame, found: DataFrame, by: str, value: str, tolerance: float = 3) -> DataFrame:
    """(by, n_truth, n_found, pairs): distinct numbers of a key matched one to one, pairs being an array of (t, f).

    True numbers choose in ascending order, each the nearest one found that is still free and at most `tolerance` away, the
    smaller of two that are as near. One fold over a key's sorted numbers: those too small for the next one are left behind.
    A key's distinct numbers are one row, so `by` should name records. Nulls match nothing."""
    sets = lambda df, name: df.where(F.col(value).isNotNull()).groupBy(by).agg(F.sort_array(F.collect_set(F.col(value).cast("double"))).alias(name))
    none = F.array().cast("array<double>")
    both = sets(truth, "_t").join(sets(found, "_f"), by, "full").select(by, F.coalesce("_t", none).alias("_t"), F.coalesce("_f", none).alias("_f"))

    def step(state: Column, t: Column) -> Column:
        free = F.filter(state["free"], lambda f: f >= t - tolerance)
        near = F.transform(F.filter(free, lambda f: f <= t + tolerance), lambda f: F.struct(F.abs(f - t).alias("far"), f.alias("f")))
        pick = F.array_min(near)["f"]
        pairs = F.when(pick.isNotNull(), F.array_append(state["pairs"], F.struct(t.alias("t"), pick.alias("f")))).otherwise(state["pairs"])
        return F.struct(F.when(pick.isNotNull(), F.array_remove(free, pick)).otherwise(free).alias("free"), pairs.alias("pairs"))

    start = F.struct(F.col("_f").alias("free"), F.array().cast("array<struct<t:double,f:double>>").alias("pairs"))
    pairs = F.aggregate("_t", start, step, lambda state: state["pairs"])
    return both.select(by, F.size("_t").alias("n_truth"), F.size("_f").alias("n_found"), pairs.alias("pairs"))


def near_scores(truth: DataFrame, found: DataFrame, by: str, value: str, tolerance: float = 3) -> DataFrame:
    """Counts per `by` of numbers matched one to one within `tolerance`."""
    matched = near_matches(truth, found, by, value, tolerance).withColumn("n", F.size("pairs"))
    return matched.select(by, F.col("n").alias("tp"), (F.col("n_found") - F.col("n")).alias("fp"), (F.col("n_truth") - F.col("n")).alias("fn"))


# tests


def normal_tail(z: float) -> float:
    """Two-sided p of a standard normal value."""
    return math.erfc(abs(z) / math.sqrt(2))


def mcnemar(pairs: DataFrame, a: str, b: str, cut: float = 0.5) -> DataFrame:
    """One row: n01, n10, chi2 with continuity correction, and p, for two systems that pass from `cut` on."""
    x, y = F.col(a) >= cut, F.col(b) >= cut
    counts = pairs.agg(F.count(F.when(x & ~y, 1)).alias("n01"), F.count(F.when(~x & y, 1)).alias("n10"))
    n, d = F.col("n01") + F.col("n10"), F.abs(F.col("n01") - F.col("n10"))
    chi2 = F.when(n > 0, F.pow(F.greatest(d - 1, F.lit(0)), 2) / n).otherwise(0.0)
    return counts.withColumn("chi2", chi2).withColumn("p", erfc(F.sqrt("chi2") / math.sqrt(2)))


def paired_t(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, t and p by the normal distribution; 0 and 1 without variance."""
    d = F.col(a) - F.col(b)
    stats = pairs.agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.var_samp(d).alias("var"))
    t = F.when(F.col("var") > 1e-30, F.col("mean") / F.sqrt(F.col("var") / F.col("n"))).otherwise(0.0)
    return stats.withColumn("t", t).select("n", "t", erfc(F.abs("t") / math.sqrt(2)).alias("p"))


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0 for summaries of few rows: Spark has none."""
    return F.pandas_udf(lambda s: s.map(math.erfc), "double")(x.cast("double"))


#: Distinct differences that one task of a bootstrap holds, and its draws.
DIFFERENCES, DRAWS = 50_000, 500


def bootstrap(pairs: DataFrame, a: str, b: str, draws: int = 10_000, seed: int = 42, centred: bool = False) -> DataFrame:
    """One row: the mean difference and the share of resampled means that are at least as far from 0.

    Resamples are drawn as counts of the distinct differences, which is the same as drawing documents. The differences are
    dealt into blocks of about DIFFERENCES: a draw first says how many documents fall in each block, and then, apart in each
    block, how often each of its differences is drawn; the parts add up, so any number of differences is exact. Without
    `centred`, resamples vary about the observed difference itself, so p is near a half."""
    import numpy as np

    spark, d = pairs.sparkSession, F.round(F.col(a) - F.col(b), 6)
    table = pairs.where(d.isNotNull()).groupBy(d.alias("d")).agg(F.count("*").alias("n"))
    distinct, n, total = table.agg(F.count("*"), F.sum("n"), F.sum((F.col("d") * F.col("n")).cast("decimal(38,6)"))).first()
    if not n:
        return spark.createDataFrame([(0.0, 1.0)], "mean double, p double")
    mean, n_blocks = float(total) / n, 1 + distinct // DIFFERENCES
    block = F.pmod(F.xxhash64("d"), F.lit(n_blocks)).cast("int").alias("block")
    blocks = written(table.groupBy(block).agg(F.sum("n").alias("size"), F.sort_array(F.collect_list(F.struct("d", "n"))).alias("rows")), "differences")
    share = np.zeros(n_blocks)
    for r in blocks.select("block", "size").collect():  # one number a block
        share[r["block"]] = r["size"] / n

    def run(batches):
        for batch in batches:
            for at, size, rows, start in zip(batch["block"], batch["size"], batch["rows"], batch["start"], strict=True):
                values, counts = (np.array([r[c] for r in rows], float) for c in ("d", "n"))
                parts = []
                for i in range(start, min(start + DRAWS, draws)):
                    here = np.random.default_rng([seed, i]).multinomial(n, share)[at]
                    parts.append(float(np.random.default_rng([seed, i, int(at) + 1]).multinomial(here, counts / size) @ values))
                yield pd.DataFrame({"draw": np.arange(start, start + len(parts)), "part": parts})

    starts = F.explode(F.sequence(F.lit(0), F.lit(max(0, draws - 1)), F.lit(DRAWS))).alias("start")
    drawn = blocks.select("block", "size", "rows", starts).repartition("block", "start").mapInPandas(run, "draw long, part double")
    m = drawn.groupBy("draw").agg((F.sum("part") / n).alias("m"))
    far = F.abs(F.col("m") - (mean if centred else 0.0)) >= abs(mean)
    return m.agg(F.lit(mean).alias("mean"), F.avg(far.cast("double")).alias("p"))
