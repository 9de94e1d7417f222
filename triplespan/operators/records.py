"""Nested records: keys with fallbacks, win rules, pooled sets, canonical text, and walks over a schema.

Walks are driven by the column's type, so they become one Spark expression for any nesting of structs, arrays and maps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triplespan.functions import text

MISSING = ("", "n/a", "na")


def filled(*candidates: Column) -> Column:
    """The first of the candidates that is not blank, trimmed; else an empty text."""
    return F.coalesce(*(F.nullif(F.trim(c.cast("string")), F.lit("")) for c in candidates), F.lit(""))


def record_key(ccdc: Column, names: Column) -> Column:
    """The deposit number; where it is missing, NAME: and the first name; else NULL."""
    number = filled(ccdc)
    first = F.trim(F.get(names, 0))
    return F.when(~F.lower(number).isin(*MISSING), number).when(F.length(first) > 0, F.concat(F.lit("NAME:"), first))


def keyed(rows: DataFrame, key: list[str], place: str, wins: str = "last") -> DataFrame:
    """One row a key: the first or the last by `place`. Rows with a null key are left out. Merges map-side."""
    if wins not in ("first", "last"):
        raise ValueError(f"wins must be first or last, not {wins!r}")
    other = [c for c in rows.columns if c not in key]
    pick = F.min_by if wins == "first" else F.max_by
    kept = rows.dropna(subset=key).groupBy(*key).agg(pick(F.struct(*other), F.col(place)).alias("_row"))
    return kept.select(*key, *(F.col(f"_row.{c}").alias(c) for c in other))


def grouped(rows: DataFrame, key: list[str], place: str, name: str = "records") -> DataFrame:
    """The records of each key as an array in order of `place`; rows with a null key are left out."""
    fields = [place, *(c for c in rows.columns if c not in (*key, place))]
    return rows.dropna(subset=key).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))


def pooled(rows: DataFrame, key: list[str], **sets: Column) -> DataFrame:
    """Sorted distinct values of each array column in `sets` over all rows of a key; blank and missing ones are left out."""
    parts = []
    for name, values in sets.items():
        value = rows.select(*key, F.explode(values).alias("v")).where(~F.lower(F.trim("v")).isin(*MISSING)).distinct()
        parts.append(value.groupBy(*key).agg(F.sort_array(F.collect_set("v")).alias(name)))
    found = reduce(lambda a, b: a.join(b, key, "left"), parts, rows.select(*key).dropna().distinct())
    return found.select(*key, *(F.coalesce(n, F.array().cast("array<string>")).alias(n) for n in sets))


def preferred(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """All rows of `first`, and those of `second` whose key has none there."""
    return first.unionByName(second.join(first.select(*key).distinct(), key, "left_anti"))


def units_of(units: Column, metal: Column, organic: Column) -> Column:
    """The listed units; where there are none, the metal and the organic one. Blank ones are left out."""
    kept = lambda c: F.filter(c, lambda x: F.length(F.trim(x)) > 0)
    listed = kept(F.coalesce(units, F.array().cast("array<string>")))
    return F.when(F.size(listed) > 0, listed).otherwise(kept(F.array(metal, organic)))


def plain_title(c: Column) -> Column:
    """Lower case, runs of what is no letter or digit as one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def at_index(values: Column, index: Column) -> Column:
    """The element at an index that counts from 0 or 1: both mean the first one; NULL outside."""
    return F.get(values, F.greatest(index - 1, F.when(index >= 0, F.lit(0)).otherwise(F.lit(-1))))


# walks


def walked(c: Column, kind: T.DataType, change: Callable[[str, Column], Column], name: str = "") -> Column:
    """The value with every string in it replaced by change(name of the nearest field, string)."""
    if isinstance(kind, T.StructType):
        inner = F.struct(*(walked(c[f.name], f.dataType, change, f.name).alias(f.name) for f in kind.fields))
        return F.when(c.isNotNull(), inner)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: walked(x, kind.elementType, change, name))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: walked(v, kind.valueType, change, name))
    return change(name, c) if isinstance(kind, T.StringType) else c


def normal_record(c: Column, kind: T.DataType) -> Column:
    """The record with its strings in normal form: amounts and chemical names by their field, others as plain values. Empty
    strings stay."""

    def change(name: str, x: Column) -> Column:
        form = text.normal_amount if name in ("chemicalAmount", "amount") else text.substance if name == "chemicalName" else text.normal_value
        return F.when(x == "", x).when(x.isNotNull(), form(x))

    return walked(c, kind, change)


def blanked(c: Column, kind: T.DataType, names: Iterable[str]) -> Column:
    """The record with the strings of the named fields empty, for display."""
    gone = set(names)
    return walked(c, kind, lambda name, x: F.when(x.isNotNull(), F.lit("")) if name in gone else x)


def gathered(c: Column, kind: T.DataType, names: Iterable[str]) -> Column:
    """All strings in fields of the given names, at any depth, as one array in order of the schema."""
    wanted = set(names)
    nothing = F.array().cast("array<string>")

    def values(c: Column, kind: T.DataType, inside: bool) -> Column | None:
        if isinstance(kind, T.StructType):
            parts = [p for f in kind.fields if (p := values(c[f.name], f.dataType, f.name in wanted)) is not None]
            return F.concat(*(F.coalesce(p, nothing) for p in parts)) if parts else None
        if isinstance(kind, T.ArrayType | T.MapType):
            element = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType
            if values(F.lit(None), element, inside) is None:
                return None
            return F.flatten(F.transform(c if isinstance(kind, T.ArrayType) else F.map_values(c), lambda x: F.coalesce(values(x, element, inside), nothing)))
        return F.when(c.isNotNull(), F.array(c.cast("string"))).otherwise(nothing) if inside else None

    found = values(c, kind, False)
    return nothing if found is None else F.coalesce(found, nothing)


def canonical_json(c: Column, kind: T.DataType) -> Column:
    """JSON text that does not depend on the order of fields, entries or items."""
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f'"{f.name}":'), canonical_json(c[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        out = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.sort_array(F.transform(c, lambda x: canonical_json(x, kind.elementType))), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entry = lambda e: F.concat(canonical_json(e["key"].cast("string"), T.StringType()), F.lit(":"), canonical_json(e["value"], kind.valueType))
        out = F.concat(F.lit("{"), F.array_join(F.sort_array(F.transform(F.map_entries(c), entry)), ","), F.lit("}"))
    else:
        one = F.to_json(F.array(c))
        out = F.substring(one, F.lit(2), F.length(one) - 2)
    return F.when(c.isNull(), "null").otherwise(out)
