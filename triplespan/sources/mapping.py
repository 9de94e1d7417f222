"""Tables as graphs: declarative rules turn rows into triples.

A pattern reads only the tables and columns of the rules that can answer it: those with its predicate, whose IRI template agrees
with the other patterns on the same variable and with the solutions that it is joined with. All rules of one table are one
scan, whose rows become arrays of triples. The triples of a whole graph read each table once for types and once for all else, and
say which predicates a scan can give, so that Catalyst drops it where others are asked for.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplespan.plans.patterns import LABEL, PREFIXES, TYPE, Ends, Graph, Pattern, Row, Term, both_ends, ends_of, fused, is_variable, lit, noted, optional, parts_of
from triplespan.plans.tables import written

BASE = PREFIXES["ex"]
#: Hashes of repeated keys that are broadcast, as counted.
REPEATED = 200_000


class Given(tuple):
    """A key of the rows that meet a condition; `base` is the key, which may be that of an entity of the same row."""

    base: tuple[str, ...]


def given(condition: str, *key: str) -> Given:
    out = Given((f"CASE WHEN {condition} THEN {key[0]} END", *key[1:]))
    out.base = key
    return out


@dataclass(frozen=True)
class Entity:
    """How one table maps: its class, key, literals by predicate, references by predicate, and more classes of the rows that
    meet a condition. Keys, literals and conditions are SQL expressions over the table's columns. Rows of an entity that is
    not `unique` share keys, so its triples are made distinct; `unique` is a promise, by which facts of one row are read together."""

    table: str
    name: str
    key: tuple[str, ...]
    literals: dict[str, str] = field(default_factory=dict)
    references: dict[str, tuple[str, tuple[str, ...]]] = field(default_factory=dict)
    typed: bool = True
    classes: dict[str, str] = field(default_factory=dict)
    unique: bool = True


@dataclass(frozen=True)
class Kind:
    """A class of the rows that meet a condition."""

    name: str
    condition: str


STAR = (
    Entity("region", "Region", ("r_regionkey",), {"label": "r_name"}),
    Entity("nation", "Nation", ("n_nationkey",), {"label": "n_name"}, {"inRegion": ("Region", ("n_regionkey",))}),
    Entity("customer", "Customer", ("c_custkey",), {"label": "c_name", "balance": "c_acctbal", "segment": "c_mktsegment"}, {"inNation": ("Nation", ("c_nationkey",))}),
    Entity("supplier", "Supplier", ("s_suppkey",), {"label": "s_name", "balance": "s_acctbal"}, {"inNation": ("Nation", ("s_nationkey",))}),
    Entity("part", "Part", ("p_partkey",), {"label": "p_name", "brand": "p_brand", "kind": "p_type", "size": "p_size", "price": "p_retailprice"}),
    Entity("orders", "Order", ("o_orderkey",), {"status": "o_orderstatus", "total": "o_totalprice", "priority": "o_orderpriority"}, {"placedBy": ("Customer", ("o_custkey",))}),
    Entity(
        "lineitem", "LineItem", ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), {"quantity": "l_quantity", "discount": "l_discount", "flag": "l_returnflag"},
        {"ofOrder": ("Order", ("l_orderkey",)), "ofPart": ("Part", ("l_partkey",)), "bySupplier": ("Supplier", ("l_suppkey",))},
    ),
    Entity("documents", "Document", ("doc_id",), {"language": "lang", "origin": "source", "length": "n_chars"}),
    Entity("labels", "Document", ("doc_id",), {"quality": "quality", "toxic": "toxic"}, typed=False),
)


def predicate(name: str) -> str:
    return LABEL if name == "label" else BASE + name


def iri(name: str, key: Sequence[str | Column]) -> Column:
    """The IRI of an entity; NULL if a key column is."""
    parts = []
    for k in key:
        parts += [F.lit("-"), (F.expr(k) if isinstance(k, str) else k).cast("string")]
    return F.concat(F.lit(f"{BASE}{name}/"), *parts[1:])


def has(key: Sequence[str]) -> Column:
    """Whether no part of a key is NULL."""
    return reduce(Column.__and__, [F.expr(k).isNotNull() for k in key])


class MappedGraph(Graph):
    """The graph view of tables `<folder>/<table>.parquet` by `entities`."""

    def __init__(self, spark: SparkSession, folder: str, entities: Sequence[Entity] = STAR, prefixes: dict[str, str] | None = None):
        self.spark, self.folder, self.entities, self.prefixes = spark, folder, entities, PREFIXES | (prefixes or {})
        self._tables: dict[str, DataFrame] = {}  # opened once: listing files and reading schemas is work of the driver
        self._rules: list[tuple[Entity, str, object]] = []

    @property
    def triples(self) -> DataFrame:
        return self._union(self.rules(None))

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    def rules(self, predicates: Sequence[str] | None) -> list[tuple[Entity, str, object]]:
        """(entity, predicate, what) of the branches with these predicates; what: None or a Kind, an expression or (class, key)."""
        if not self._rules:
            for e in self.entities:
                self._rules += [(e, TYPE, None)] if e.typed else []
                self._rules += [(e, TYPE, Kind(name, condition)) for name, condition in e.classes.items()]
                self._rules += [(e, predicate(n), c) for n, c in e.literals.items()] + [(e, predicate(n), r) for n, r in e.references.items()]
        return [x for x in self._rules if predicates is None or x[1] in predicates]

    def _branch(self, e: Entity, p: str, what: object, wide: bool = False):
        """The triples of a rule; or, wide, its object column and kind."""
        if what is None:
            o, kind = F.lit(BASE + e.name), "iri"
        elif isinstance(what, Kind):
            o, kind = F.when(F.expr(what.condition), F.lit(BASE + what.name)), "iri"
        elif isinstance(what, str):
            o, kind = F.expr(what).cast("string"), "lit"
        else:
            o, kind = iri(*what), "iri"
        if wide:
            return o, kind
        rows = self.table(e.table)
        if isinstance(what, Kind):  # as a filter of rows, the object stays a constant
            rows, o = rows.where(F.expr(what.condition)), F.lit(BASE + what.name)
        rows = rows.select(iri(e.name, e.key).alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind")).where("s is not null and o is not null")
        return rows if e.unique else rows.distinct()

    def _scan(self, rules: list) -> DataFrame:
        """The triples of rules of one table by one read of it."""
        if len(rules) == 1:
            return self._branch(*rules[0])
        parts, kinds = [], set()
        for e, p, what in rules:
            o, kind = self._branch(e, p, what, wide=True)
            parts.append(F.struct(iri(e.name, e.key).alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind")))
            kinds.add(kind)
        rows = self.table(rules[0][0].table).select(F.inline(F.array(*parts))).where("s is not null and o is not null")
        # true of every row: comparisons that Catalyst folds to false beside `p = ...` of another predicate, or another kind
        rows = rows.where(reduce(Column.__or__, [F.col("p") == F.lit(p) for p in sorted({p for _, p, _ in rules})]))
        rows = rows.where(F.col("o_kind") != F.lit("iri" if kinds == {"lit"} else "lit")) if len(kinds) == 1 else rows
        return rows if rules[0][0].unique else rows.distinct()

    def _union(self, rules: list) -> DataFrame:
        if not rules:
            return self.spark.range(1).select(*(F.lit("").alias(c) for c in ("s", "p", "o", "o_kind"))).limit(0)
        scans: dict[tuple, list] = {}
        for e, p, what in rules:
            scans.setdefault((e.table, e.unique, p == TYPE), []).append((e, p, what))
        return reduce(DataFrame.union, map(self._scan, scans.values()))

    def subjects(self) -> tuple[DataFrame | None, DataFrame]:
        """(kind, s, facts) of the subjects that one row of a table tells all about, if there are any, facts being an array of distinct
        (p, o, o_kind, end) and kind and end kinds of IRIs; and the distinct triples of all others.

        That keys are unique is not taken on trust: rows whose hash of the key is there again are among the others. Only
        hashes are shuffled for it."""
        kinds: dict[str, list] = {}
        for rule in self.rules(None):
            kinds.setdefault(rule[0].name, []).append(rule)
        whole, rest, hashes = [], [], []
        for name, rules in kinds.items():
            if not self._one_entity(rules):
                rest += rules
                continue
            facts, key, table = [], rules[0][0].key, self.table(rules[0][0].table)
            for rule in rules:
                o, kind = self._branch(*rule, wide=True)
                facts.append(F.struct(F.lit(rule[1]).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(self._end(rule, 2)).alias("end")))
            facts = F.filter(F.array(*facts), lambda x: x["o"].isNotNull())
            facts = F.array_distinct(facts) if len({p for _, p, _ in rules}) < len(rules) else facts
            of = F.lit(name).alias("kind"), F.xxhash64(*map(F.expr, key)).alias("_key")
            hashes.append(table.where(has(key)).select(*of))
            whole.append(table.select(*of, iri(name, key).alias("s"), facts.alias("facts")).where("s is not null and size(facts) > 0"))
        others = self._union(rest)
        if not whole:
            return None, others.distinct()
        rows, again = reduce(DataFrame.union, whole), written(reduce(DataFrame.union, hashes).groupBy("kind", "_key").count().where("count > 1").select("kind", "_key"), "repeated")
        if n := again.count():
            again = F.broadcast(again) if n <= REPEATED else again
            facts = rows.join(again, ["kind", "_key"], "left_semi").select("s", F.explode("facts").alias("x"))
            others = others.union(facts.select("s", "x.p", "x.o", "x.o_kind"))
            rows = rows.join(again, ["kind", "_key"], "left_anti")
        return rows.select("kind", "s", "facts"), others.distinct()

    def rows(self, predicates: Sequence[str] | None, patterns: Sequence[Pattern], at: int, ends: Ends | None = None) -> DataFrame:
        return self._union(self._possible(patterns, ends)[0][at])

    def _possible(self, patterns: Sequence[Pattern], ends: Ends | None = None) -> tuple[list[list], Ends]:
        """The rules of each pattern, and the ends of variables; an entity stays possible for a variable only while every
        pattern on it, and `ends`, allow it."""
        may = [self._rules_of(p) for p in patterns]
        changed = True
        while changed:
            changed, found = False, dict(ends or {})
            for pattern, rules in zip(patterns, may, strict=True):
                for place, term in ((0, pattern[0]), (2, pattern[2])):
                    if is_variable(term):
                        found = both_ends(found, {term[1:]: frozenset(self._end(r, place) for r in rules)})
            for k, pattern in enumerate(patterns):
                kept = [r for r in may[k] if all(not is_variable(t) or self._end(r, i) in found[t[1:]] for i, t in ((0, pattern[0]), (2, pattern[2])))]
                changed |= len(kept) < len(may[k])
                may[k] = kept
        own = {t[1:] for p in patterns for t in (p[0], p[2]) if is_variable(t)}
        return may, {v: e for v, e in found.items() if v in own}

    def _noted(self, found: DataFrame, patterns: Sequence[Pattern], ends: Ends | None, again, parts: tuple[Row, ...] = ()) -> DataFrame:
        may, known = self._possible(patterns, ends)
        return noted(found, known, lambda fewer: again(both_ends(ends or {}, fewer)), parts, not all(may))

    def _row(self, pattern: Pattern, rules: list) -> Row | None:
        """The solutions of a pattern as one row of a table each, if one rule answers it and its triples need not be made distinct."""
        s, p, o = pattern
        if len(rules) != 1 or not is_variable(s) or isinstance(p, list) or is_variable(p) or s == o:
            return None
        (e, _, what), (target, kind) = rules[0], self._branch(*rules[0], wide=True)
        held = {s[1:]: (e.name, e.key)} | ({o[1:]: what} if isinstance(what, tuple) and is_variable(o) else {})
        keys, subject = self._row_keys(e, held), iri(e.name, e.key)
        if not e.unique and not keys:
            return None
        present = {s[1:]: has(e.key)} | ({o[1:]: has(what[1])} if isinstance(what, tuple) and is_variable(o) else {})
        whole = (has(e.key), has(what[1]) if isinstance(what, tuple) else target.isNotNull())
        if is_variable(o):
            return Row(self.table(e.table), {s[1:]: subject, o[1:]: target}, whole, keys, frozenset({s[1:], o[1:]}), self.table(e.table), present, self._held(held))
        is_it = target == F.lit(o.value if isinstance(o, lit) else self.iri(o))
        if (kind == "lit") != isinstance(o, lit):
            is_it = F.lit(False)
        return Row(self.table(e.table), {s[1:]: subject}, (*whole, is_it), keys, frozenset({s[1:]}), self.table(e.table), present, self._held(held))

    @staticmethod
    def _held(held: dict[str, tuple]) -> dict[str, tuple]:
        """Class and key of what variables hold, if it is there."""
        return {v: (name, tuple(key.base if isinstance(key, Given) else key)) for v, (name, key) in held.items()}

    def _row_keys(self, e: Entity, held: dict[str, tuple]) -> dict[str, tuple]:
        """Of variables that hold IRIs (class, key) of a row of e's table those that tell the row."""
        unique = {other.key for other in self.entities if other.table == e.table and other.unique}
        return {v: k for v, k in self._held(held).items() if k[1] in unique}

    def match(self, s: Term, p: Term | Sequence[str], o: Term, context: Sequence[Pattern] = (), at: int = 0, ends: Ends | None = None) -> DataFrame:
        rules = self._possible(context or [(s, p, o)], ends)[0][at]
        row = self._row((s, p, o), rules)
        row = row or self._many((s, p, o), rules)
        found, parts = (row.solutions(), (row,)) if row else (super().match(s, p, o, context, at, ends), ())
        if context:
            return noted(found, {}, parts=parts)
        return self._noted(found, [(s, p, o)], ends, lambda e: self.match(s, p, o, ends=e), parts)

    def bgp(self, *patterns: Pattern, ends: Ends | None = None) -> DataFrame:
        found = super().bgp(*patterns, ends=ends)
        return self._noted(found, patterns, ends, lambda e: self.bgp(*patterns, ends=e), parts_of(found))

    def named(self, s: str, names: dict[str, str], o: str, column: str, ends: Ends | None = None) -> DataFrame:
        pattern = (s, list(names), o)
        row = self._many(pattern, self._possible([pattern], ends)[0][0], {self.iri(p): name for p, name in names.items()}, column)
        found, parts = (row.solutions(), (row,)) if row else (super().named(s, names, o, column, ends), ())
        return self._noted(found, [pattern], ends, lambda e: self.named(s, names, o, column, e), parts)

    @staticmethod
    def _one_entity(rules: list) -> bool:
        """Whether all rules are of rows that are told by one key."""
        return len({(r[0].table, r[0].name, r[0].key) for r in rules}) == 1 and all(r[0].unique for r in rules)

    def _many(self, pattern: Pattern, rules: list, names: dict[str, str] | None = None, column: str = "") -> Row | None:
        """The solutions of a pattern with several facts of a row of one entity, as facts in rows of their own; with `names` the
        names of their predicates and their kinds."""
        s, p, o = pattern
        if not self._one_entity(rules) or not (is_variable(s) and is_variable(o)) or s == o or not isinstance(p, list) and is_variable(p):
            return None
        e, table, facts = rules[0][0], self.table(rules[0][0].table), []
        for rule in rules:
            target, kind = self._branch(*rule, wide=True)
            facts.append(F.struct(F.lit((names or {}).get(rule[1], "")).alias("name"), target.alias("o"), F.lit(kind).alias("kind")))
        frame = table.select("*", F.explode(F.filter(F.array(*facts), lambda x: x["o"].isNotNull())).alias("_fact"))
        targets = [self._row_keys(e, {o[1:]: r[2]} if isinstance(r[2], tuple) else {}) for r in rules]
        keys = self._row_keys(e, {s[1:]: (e.name, e.key)}) | (targets[0] if all(k == targets[0] for k in targets) else {})
        subject = iri(e.name, e.key)
        values = {s[1:]: subject, o[1:]: F.col("_fact")["o"]} | ({column: F.col("_fact")["name"], "o_kind": F.col("_fact")["kind"]} if names else {})
        return Row(table, values, (has(e.key),), keys, frozenset(values), frame, {s[1:]: has(e.key)})

    def star(self, variable: str, predicates: Sequence[str] | None, ends: Ends | None = None) -> tuple[DataFrame, list[tuple[str, str, bool]]] | None:
        rules = [r for r in self._possible([(f"?{variable}", "?p" if predicates is None else list(predicates), "?o")], ends)[0][0] if predicates is not None or r[1] != TYPE]
        if not self._one_entity(rules):
            return None
        e, columns = rules[0][0], [f"_{variable}{i}" for i in range(len(rules))]
        objects = dict(zip(columns, rules, strict=True))
        held = {variable: (e.name, e.key)} | {c: r[2] for c, r in objects.items() if isinstance(r[2], tuple)}
        subject = iri(e.name, e.key)
        row = Row(self.table(e.table), {variable: subject} | {c: self._branch(*r, wide=True)[0] for c, r in objects.items()}, (has(e.key),), self._row_keys(e, held), frozenset({variable}), self.table(e.table), {v: has(k) for v, (_, k) in held.items()}, self._held(held))
        known = {variable: frozenset({e.name})} | {c: frozenset({self._end(r, 2)}) for c, r in objects.items()}
        return noted(row.solutions(), known, parts=(row,)), [(r[1], c, isinstance(r[2], str)) for c, r in objects.items()]

    def described(self, solutions: DataFrame, variable: str, properties: dict[str, str]) -> DataFrame:
        """Properties that one table has for all that the variable can hold are one projection of it, joined once."""
        ends = {variable: ends_of(solutions)[variable]} if variable in ends_of(solutions) else None
        stars: dict[tuple, list] = {}
        for p, v in properties.items():
            rules = self._possible([(f"?{variable}", p, f"?{v}")], ends)[0][0]
            if len(rules) == 1 and rules[0][0].unique and v not in solutions.columns:
                stars.setdefault((rules[0][0].table, rules[0][0].name, rules[0][0].key), []).append((rules[0], v))
            else:
                solutions = super().described(solutions, variable, {p: v})
        for (table, name, key), members in stars.items():
            e = members[0][0][0]
            held = {variable: (name, key)} | {v: r[2] for r, v in members if isinstance(r[2], tuple)}
            subject = iri(name, key)
            facts = Row(self.table(table), {variable: subject} | {v: self._branch(*r, wide=True)[0] for r, v in members}, (has(key),), self._row_keys(e, held), frozenset({variable}), self.table(table), {v: has(k) for v, (_, k) in held.items()})
            solutions = optional(solutions, noted(facts.solutions(), {variable: frozenset({name})} | {v: frozenset({self._end(r, 2)}) for r, v in members}, parts=(facts,)))
        return solutions

    def pieces(self, patterns: Sequence[Pattern], ends: Ends | None = None) -> list[DataFrame]:
        """Patterns that one row of a table answers become one projection of it instead of self-joins."""
        every = super().pieces(patterns, ends)
        rows = fused([part for df in every for part in parts_of(df)])
        return [*(df for df in every if not parts_of(df)), *(noted(row.solutions(), {}, parts=(row,)) for row in rows)]

    def _rules_of(self, pattern: Pattern) -> list:
        s, p, o = pattern
        wanted = list(map(self.iri, p)) if isinstance(p, list) else None if is_variable(p) else [self.iri(p)]
        rules = self.rules(wanted)
        if isinstance(o, str) and not is_variable(o):  # an IRI: its class or the entity's template
            rules = [r for r in rules if (r[2] is None and BASE + r[0].name == self.iri(o)) or (isinstance(r[2], Kind) and BASE + r[2].name == self.iri(o)) or (isinstance(r[2], tuple) and self.iri(o).startswith(f"{BASE}{r[2][0]}/"))]
        if isinstance(s, str) and not is_variable(s):
            rules = [r for r in rules if self.iri(s).startswith(f"{BASE}{r[0].name}/")]
        return rules

    @staticmethod
    def _end(rule: tuple, place: int) -> str:
        """The IRI template at subject (0) or object (2); literals and classes count as one each."""
        e, _, what = rule
        return e.name if place == 0 else "class" if what is None or isinstance(what, Kind) else "literal" if isinstance(what, str) else what[0]
