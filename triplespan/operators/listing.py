"""Lists and lookups over label tables, resolution of identifiers, and clean-up of texts that hold records."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triplespan.functions.text import trimmed
from triplespan.plans.patterns import first_hit


def listed(labels: DataFrame, column: str = "label", kind: str | None = None, contains: str | None = None, limit: int | None = None) -> DataFrame:
    """Distinct trimmed labels in order; of one kind, or with a part in any case."""
    rows = labels if kind is None else labels.where(F.col("kind") == F.lit(kind))
    found = rows.select(trimmed(F.col(column)).alias(column)).where(F.col(column) != "").distinct()
    found = found if contains is None else found.where(F.lower(column).contains(contains.lower()))
    found = found.orderBy(column)
    return found if limit is None else found.limit(limit)


def with_elements(labels: DataFrame, elements: list[str], column: str = "label") -> DataFrame:
    """Labels that hold every element's symbol as a part, whatever the case; C is also found in Cl."""
    for e in elements:
        labels = labels.where(F.upper(column).contains(e.upper()))
    return labels


def label_statistics(labels: DataFrame, column: str = "label") -> DataFrame:
    """By kind: labels, distinct ones, and their shortest, longest and mean length."""
    n = F.length(column)
    return labels.groupBy("kind").agg(F.count(column).alias("n"), F.count_distinct(column).alias("n_distinct"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.avg(n).alias("mean_length"))


def resolved(wanted: DataFrame, compounds: DataFrame, substances: DataFrame) -> DataFrame:
    """(cas, smiles): from the smallest compound that has the number among its synonyms, or else the smallest substance.

    `compounds` and `substances` have id, smiles and synonyms; membership is a join on exploded synonyms."""
    by_synonym = lambda df: df.select(F.explode("synonyms").alias("cas"), "id", "smiles").join(wanted.select("cas").distinct(), "cas").groupBy("cas").agg(F.min_by("smiles", "id").alias("smiles"))
    return first_hit(["cas"], by_synonym(compounds), by_synonym(substances))


def chosen_entry(entries: DataFrame) -> DataFrame:
    """(number, refcode): of entries (number, refcode, has_3d) with a structure the smallest code."""
    return entries.where("has_3d").groupBy("number").agg(F.min("refcode").alias("refcode"))


def without_prefixes(text: Column) -> Column:
    """Turtle text without prefix declarations and blank lines."""
    return F.regexp_replace(F.regexp_replace(text, r"(?mi)^[ \t]*@?(?:prefix|base)\b[^\n]*\n?", ""), r"(?m)^[ \t]*\n|\s+\z", "")


def fenced_json(text: Column) -> Column:
    """The first fenced block of JSON, or the whole text."""
    block = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return trimmed(F.when(block != "", block).otherwise(text))


def json_records(text: Column, schema: str) -> Column:
    """Records of loosely joined JSON objects; malformed ones are left out."""
    parts = F.split(F.regexp_replace(F.regexp_replace(text, r"^\s*\[|\]\s*$", ""), r"\}\s*,?\s*\n\s*\{", "}\u0001{"), "\u0001")
    whole = F.filter(parts, lambda p: F.try_parse_json(p).isNotNull())
    return F.transform(whole, lambda p: F.from_json(p, schema))


BRACES = re.compile(r'"(?:[^"\\\n]|\\[^\n])*"|[{}]')


def whole_objects(text: str | None) -> list[str]:
    """The outermost balanced `{...}` of a text, in order, in one pass. Braces in strings do not count; a string ends with its
    line; a brace that is never closed hides nothing after it."""
    opened: list[int] = []
    spans: list[tuple[int, int]] = []
    for m in BRACES.finditer(text or ""):
        if m[0] == "{":
            opened.append(m.start())
        elif m[0] == "}" and opened:
            start = opened.pop()
            while spans and spans[-1][0] > start:
                spans.pop()
            spans.append((start, m.end()))
    return [text[a:b] for a, b in spans]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _whole_objects(texts: pd.Series) -> pd.Series:
    return texts.map(whole_objects)


def recovered_records(text: Column, fields: tuple[str, ...] = ("name", "role")) -> Column:
    """Structs of text fields from the first fenced block of JSON, or the whole text: of all whole objects with the first field;
    if there are none, values of the fields wherever they stand, zipped by place. Absent values but the first are empty. A null
    text has no records."""
    block = fenced_json(text)
    schema = ", ".join(f"`{f}` string" for f in fields)
    valid = F.filter(_whole_objects(block), lambda o: F.try_parse_json(o).isNotNull())
    tidy = lambda r: F.struct(*(F.coalesce(trimmed(r[f]), F.lit("")).alias(f) for f in fields))
    read = F.filter(F.transform(valid, lambda o: tidy(F.from_json(o, schema))), lambda r: r[fields[0]] != "")
    values = lambda f: F.regexp_extract_all(block, F.lit(rf'"{f}"\s*:\s*"([^"]+)"'), F.lit(1))
    names, *others = (values(f) for f in fields)
    pick = lambda v, i: F.coalesce(F.get(v, i), F.lit(""))
    loose = F.transform(names, lambda n, i: F.struct(n.alias(fields[0]), *(pick(v, i).alias(f) for v, f in zip(others, fields[1:], strict=True))))
    return F.when(F.size(read) > 0, read).otherwise(loose)


def derived_in_truth(derived: DataFrame, truth: DataFrame) -> DataFrame:
    """Counts per category: formulas derived for a document, and those among the formulas that `truth` (category, dois,
    formula; DOIs joined by semicolons) has for it."""
    known = truth.select("category", "formula", F.explode(F.split("dois", ";")).alias("doi")).select("category", "formula", F.trim("doi").alias("doi")).distinct()
    hits = derived.join(known.withColumn("hit", F.lit(1)), ["category", "doi", "formula"], "left")
    return hits.groupBy("category").agg(F.count("*").alias("n"), F.count("hit").alias("n_hit"))


def exact_rates(truth: DataFrame, found: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row: the share of keys in both whose fields are equal, arrays as bags, by field and for all of them."""

    def equal(f: str) -> Column:
        t, g = F.col(f"t.{f}"), F.col(f"f.{f}")
        return F.sort_array(t).eqNullSafe(F.sort_array(g)) if dict(truth.dtypes)[f].startswith("array") else t.eqNullSafe(g)

    both = truth.alias("t").join(found.alias("f"), F.col(f"t.{key}") == F.col(f"f.{key}"))
    every = F.lit(True)
    for f in fields:
        every = every & equal(f)
    return both.agg(*(F.avg(equal(f).cast("double")).alias(f) for f in fields), F.avg(every.cast("double")).alias("all_fields"))


def entity_rows(solutions: DataFrame, names: tuple[str, ...] = ("entity", "synthesis"), label: str = "label") -> DataFrame:
    """(entity, label) of solutions: the first of `names` that they have, or else the first column; without a label the last
    part of the IRI."""
    column = next((n for n in names if n in solutions.columns), solutions.columns[0])
    given = F.col(label) if label in solutions.columns else F.lit(None).cast("string")
    return solutions.select(F.col(column).alias("entity"), F.coalesce(F.nullif(trimmed(given), F.lit("")), F.regexp_extract(column, r"([^/#]*)$", 1)).alias("label")).distinct()


def top_entities(solutions: DataFrame) -> DataFrame:
    """`entity_rows`, which must not be empty: no top-level entity raises ValueError."""
    rows = entity_rows(solutions)
    if rows.isEmpty():
        raise ValueError("no top-level entity")
    return rows


def report_rows(reports: DataFrame) -> DataFrame:
    """(doc, name, tp, fp, fn) of the table rows of Markdown score reports (doc, text): a name and three whole numbers first."""
    row = r"(?m)^\|\s*([^|\n]*?)\s*\|\s*(\d+)\s*\|\s*(\d+)\s*\|\s*(\d+)\s*\|"
    cells = F.explode(F.arrays_zip(*(F.regexp_extract_all("text", F.lit(row), F.lit(i)).alias(n) for i, n in enumerate(("name", "tp", "fp", "fn"), 1))))
    return reports.select("doc", cells.alias("c")).select("doc", F.regexp_replace("c.name", r"\*", "").alias("name"), *(F.col(f"c.{n}").cast("long").alias(n) for n in ("tp", "fp", "fn")))
