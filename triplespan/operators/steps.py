"""Rewriting of steps: rules on arrays of structs, applied in the given order, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A step (a struct with a field `type`) becomes an array of steps with the same fields.
Rule = Callable[[Column], Column]


def rewritten(steps: Column, *rules: Rule) -> Column:
    """The steps after each rule in turn; steps keep their order, and those that a rule makes of one step stay together. NULL
    stays NULL."""
    for rule in rules:
        steps = F.flatten(F.transform(steps, rule))
    return steps


def split(kind: str = "Add", field: str = "addedChemical", comment: str = "comment") -> Rule:
    """A step of this kind with several values becomes one step for each, in order, and its comment tells which."""

    def rule(s: Column) -> Column:
        n = F.size(s[field])
        part = lambda v, i: s.withField(field, F.array(v)).withField(comment, F.concat(F.lit("split "), (i + 1).cast("string"), F.lit("/"), n.cast("string"), F.lit(": "), F.coalesce(s[comment], F.lit(""))))
        return F.when((s["type"] == kind) & (n > 1), F.transform(s[field], part)).otherwise(F.array(s))

    return rule


def converted(kind: str = "Dissolve", to: str = "Add", source: str = "solvent", target: str = "addedChemical", comment: str = "comment", values: dict[str, Column] | None = None) -> Rule:
    """Steps of one kind become steps of another: the values of `source` move to `target` (none: an empty array), `values` are
    set, and the comment names the former kind."""

    def rule(s: Column) -> Column:
        made = s.withField("type", F.lit(to)).withField(target, F.coalesce(s[source], F.array().cast("array<string>"))).withField(source, F.lit(None))
        made = made.withField(comment, F.concat(F.lit(f"converted from {kind.lower()}: "), F.coalesce(s[comment], F.lit("n/a"))))
        for name, value in (values or {}).items():
            made = made.withField(name, value)
        return F.array(F.when(s["type"] == kind, made).otherwise(s))

    return rule


def replaced(field: str, value: str, by: str) -> Rule:
    """A text in any case becomes another one."""
    return lambda s: F.array(s.withField(field, F.when(F.lower(s[field]) == value.lower(), by).otherwise(s[field])))


def dropped(condition: Rule) -> Rule:
    """Steps that meet a condition go; where it is NULL they stay."""
    return lambda s: F.when(condition(s), F.filter(F.array(s), lambda _: F.lit(False))).otherwise(F.array(s))


def without_product(syntheses: DataFrame, product: str, names: str = "productNames") -> DataFrame:
    """Syntheses but those with the product as a part of one of their names, whatever the case."""
    found = F.exists(names, lambda n: F.lower(n).contains(product.lower()))
    return syntheses.where(~F.coalesce(found, F.lit(False)))
