"""Graph patterns as DataFrame operations.

A graph is a DataFrame of distinct triples (s, p, o, o_kind), o_kind being iri, bnode or lit. Solutions are DataFrames
with one string column per variable; an unbound variable is NULL. Terms are written `?name` for a variable,
`prefix:local` for an IRI, `a` for rdf:type, and `lit("...")` for a literal. Values are bound as Spark literals and never
spliced into query text.

Joins carry no hints: Catalyst and AQE pick broadcast, sort-merge or skewed joins from measured sizes.

Solutions of a mapped graph remember from which patterns they came and what kinds of IRIs their variables can hold. When they
are joined with others, the patterns are asked again within the kinds that both sides allow, so that a label is read from
the tables of the entities in question and not from all. They also remember which of them are read from one row of a table, so
that facts of one row are read together and not joined. Any other DataFrame operation forgets this and stays right.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import count
from typing import NamedTuple
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPE, LABEL = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://www.w3.org/2000/01/rdf-schema#label"
PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "ex": "http://example.org/",
}
COLUMNS = ("s", "p", "o", "o_kind")


class lit(NamedTuple):  # noqa: N801 - reads as a function in patterns
    """A literal term."""

    value: str


Term = str | lit
Pattern = tuple[Term, Term, Term]
#: Kinds of IRIs that a variable can hold, by variable.
Ends = dict[str, frozenset[str]]


class Facts(NamedTuple):
    """At most one row for each entity of a class: `of` is the column with its IRI, `keys` are those with its key; `few` says that they
    may be broadcast."""

    rows: DataFrame
    of: str
    kind: str
    keys: tuple[str, ...]
    few: bool


@dataclass(frozen=True)
class Way:
    """What a row leads to by the key `on` (SQL): the row of `side` with it in its first columns, where `used`."""

    on: tuple[str, ...]
    side: DataFrame
    used: Column
    few: bool

    def joined(self, rows: DataFrame) -> DataFrame:
        same = reduce(Column.__and__, [F.expr(k) == F.col(c) for k, c in zip(self.on, self.side.columns)], self.used)
        return rows.join(F.broadcast(self.side) if self.few else self.side, same, "left")


@dataclass(frozen=True)
class Row:
    """Solutions that are each read from one row of `table`: `values` by variable over its columns, of the rows that meet the
    `conditions`. `keys` are the variables that tell the row, by what they hold; `bound` are never NULL. `frame` is the table as
    it is read: itself, or with several facts of a row in rows of their own. `present` says of keys whether they are there, without
    making their IRIs. `held` are class and key (SQL) of the entities that variables hold where they are bound. Values may be columns
    of what the row leads to by its `ways`, one row at most."""

    table: DataFrame
    values: dict[str, Column]
    conditions: tuple[Column, ...]
    keys: dict[str, tuple]
    bound: frozenset[str]
    frame: DataFrame
    present: dict[str, Column]
    held: dict[str, tuple[str, tuple[str, ...]]] = field(default_factory=dict)
    ways: tuple[Way, ...] = ()

    def solutions(self, by: str | None = None) -> DataFrame:
        """The solutions; those of one value of `by` in one part, dealt as columns of tables after what is large is joined."""
        rows = reduce(lambda df, way: way.joined(df), [w for w in self.ways if not w.few], self.frame)
        if by:
            parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-counted(self.table) // DEALT_ROWS))
            rows = rows.withColumn("_by", self.values[by]).repartition(parts, "_by")
        rows = reduce(lambda df, way: way.joined(df), [w for w in self.ways if w.few], rows)
        rows = rows.where(reduce(Column.__and__, self.conditions)) if self.conditions else rows
        return rows.select(*((F.col("_by") if v == by else c).alias(v) for v, c in self.values.items()))

    def only(self, columns: Sequence[str]) -> Row:
        mine = lambda of: {v: x for v, x in of.items() if v in columns}
        return replace(self, values={v: self.values[v] for v in columns}, keys=mine(self.keys), bound=self.bound & set(columns), held=mine(self.held))

    def tells(self, *variables: str) -> bool:
        """Whether one of the variables, all if none is given, is another in each solution."""
        return self.frame is self.table and any(v in self.bound for v in self.keys if v in (variables or self.values))

    def _same(self, other: Row) -> tuple[Column, ...] | None:
        """When a solution of another pattern on the same row meets this one; None if it may be on another row."""
        on = [v for v in self.values if v in other.values]
        if self.table is not other.table or not any(v in self.keys and self.keys[v] == other.keys.get(v) for v in on):
            return None
        told = [v for v in on if v in self.keys and self.keys[v] == other.keys.get(v)]
        whole = tuple(r.present.get(v, r.values[v].isNotNull()) for v in told for r in (self, other) if v not in r.bound)
        return whole + tuple(self.values[v] == other.values[v] for v in on if v not in told)

    def joined(self, other: Row) -> Row | None:
        same = self._same(other)
        if same is None or self.frame is not self.table and other.frame is not other.table:
            return None
        frame = other.frame if self.frame is self.table else self.frame
        bound = self.bound | other.bound | (self.values.keys() & other.values.keys())
        return Row(self.table, other.values | self.values, self.conditions + other.conditions + same, other.keys | self.keys, bound, frame, other.present | self.present, other.held | self.held, self._ways(other))

    def optional(self, other: Row) -> Row | None:
        same = self._same(other)
        if same is None or other.frame is not other.table:
            return None
        met = reduce(Column.__and__, other.conditions + same) if other.conditions + same else F.lit(True)
        more = {v: F.when(met, c) for v, c in other.values.items() if v not in self.values}
        there = {v: met & c for v, c in other.present.items() if v in more}
        added = lambda of: {v: x for v, x in of.items() if v in more}
        return replace(self, values=self.values | more, keys=added(other.keys) | self.keys, present=there | self.present, held=added(other.held) | self.held, ways=self._ways(other))

    def _ways(self, other: Row) -> tuple[Way, ...]:
        return self.ways + tuple(w for w in other.ways if all(w is not mine for mine in self.ways))

    def led(self, variable: str, facts: Facts) -> Row | None:
        """With the other columns of facts of what a variable holds; None if these are not found by a key of whole numbers."""
        kind, on = self.held.get(variable, ("", ()))
        if kind != facts.kind or any(not isinstance(t.dataType, WHOLE) for t in (*self.table.select(*map(F.expr, on)).schema, *facts.rows.select(*facts.keys).schema)):
            return None
        used, names = self.present.get(variable, self.values[variable].isNotNull()), [c for c in facts.rows.columns if c not in (*facts.keys, facts.of)]
        side = facts.rows.select(*facts.keys, *names)
        k = next((k for k, w in enumerate(self.ways) if w.on == on and w.side.sameSemantics(side)), len(self.ways))
        if k < len(self.ways):
            way = replace(self.ways[k], used=self.ways[k].used | used)
        else:
            n = next(_NUMBERS)
            way = Way(on, side.toDF(*(f"_way{n}_{i}" for i in range(len(side.columns)))), used, facts.few)
        more = {name: F.when(used, F.col(c)) for name, c in zip(names, way.side.columns[len(on) :], strict=True)}
        return replace(self, values=more | self.values, ways=(*self.ways[:k], way, *self.ways[k + 1 :]))


class Known(NamedTuple):
    """What is known of solutions: the ends of variables, how to ask for them again within fewer ends, the rows whose natural
    join they are, and whether there are none."""

    ends: Ends
    again: Callable[[Ends], DataFrame] | None = None
    parts: tuple[Row, ...] = ()
    nothing: bool = False


_KNOWN: WeakKeyDictionary[DataFrame, Known] = WeakKeyDictionary()
_COUNTS: WeakKeyDictionary[DataFrame, int] = WeakKeyDictionary()
_NUMBERS = count()
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Rows of facts, short texts, that are broadcast, as their table counts; rows of a task that makes texts of a KB of each.
FEW, DEALT_ROWS = 1 << 19, 1 << 18


def counted(table: DataFrame) -> int:
    if table not in _COUNTS:
        _COUNTS[table] = table.count()
    return _COUNTS[table]


def noted(solutions: DataFrame, ends: Ends, again: Callable[[Ends], DataFrame] | None = None, parts: tuple[Row, ...] = (), nothing: bool = False) -> DataFrame:
    if ends or parts or nothing:
        _KNOWN[solutions] = Known(ends, again, parts, nothing)
    return solutions


def parts_of(solutions: DataFrame) -> tuple[Row, ...]:
    known = _KNOWN.get(solutions)
    return known.parts if known else ()


def fused(parts: Sequence[Row]) -> list[Row]:
    """Rows that are of the same row of a table, as one."""
    out: list[Row] = []
    for part in parts:
        k = next((k for k, other in enumerate(out) if other.joined(part)), None)
        if k is None:
            out.append(part)
        else:
            out = fused([*out[:k], out[k].joined(part), *out[k + 1 :]])
    return out


def natural(parts: Sequence[Row]) -> DataFrame:
    left = [p.solutions() for p in parts]
    out = left.pop(0)
    while left:
        k = next(k for k, df in enumerate(left) if set(df.columns) & set(out.columns))
        out = out.join(left[k], shared(out, left.pop(k)))
    return out


def ends_of(solutions: DataFrame) -> Ends:
    known = _KNOWN.get(solutions)
    return known.ends if known else {}


def both_ends(a: Ends, b: Ends) -> Ends:
    return {v: a[v] & b[v] if v in a and v in b else a.get(v, b.get(v)) for v in a | b}


def within(solutions: DataFrame, other: DataFrame, but: Iterable[str] = ()) -> DataFrame:
    """The solutions, asked again if `other` rules out ends of shared variables."""
    known = _KNOWN.get(solutions)
    if known is None or known.again is None:
        return solutions
    fewer = {v: e for v, e in ends_of(other).items() if v in known.ends and v not in but and not known.ends[v] <= e}
    return known.again(fewer) if fewer else solutions


def derived(solutions: DataFrame, build: Callable[[DataFrame], DataFrame], by: Sequence[str] | None = None, of_row: Callable[[Row], Row | None] | None = None) -> DataFrame:
    """`build` of solutions, still narrowed by later joins on the variables that it keeps. It must work row by row, or group by
    variables: those are `by` then, and only joins on them narrow it. `of_row` does the same to solutions of one row."""
    known = _KNOWN.get(solutions)
    if known is None:
        return build(solutions)
    row = of_row(known.parts[0]) if of_row and len(known.parts) == 1 else None
    out = row.solutions() if row else build(solutions)
    ends = {v: e for v, e in known.ends.items() if v in (out.columns if by is None else by)}
    return noted(out, ends, known.again and (lambda fewer: derived(known.again(fewer), build, by, of_row)), (row,) if row else (), known.nothing)


def having(solutions: DataFrame, condition: Column | str) -> DataFrame:
    return derived(solutions, lambda df: df.where(condition))


def picked(solutions: DataFrame, *columns: str) -> DataFrame:
    return derived(solutions, lambda df: df.select(*columns), of_row=lambda row: row.only(columns))


def distinct(solutions: DataFrame) -> DataFrame:
    return derived(solutions, DataFrame.distinct, of_row=lambda row: row if row.tells() else None)


def least(solutions: DataFrame, by: str, *values: str) -> DataFrame:
    """The smallest of each of `values` by `by`."""
    return derived(solutions, lambda df: df.groupBy(by).agg(*(F.min(v).alias(v) for v in values)), [by], lambda row: row.only([by, *values]) if row.tells(by) else None)


def reduced(solutions: DataFrame, by: Sequence[str], **values: tuple[str, Callable[[Column], Column]]) -> DataFrame:
    """By `by`, of which a variable that tells the row makes groups of one, the smallest of each of `values` (variable, function)."""
    of = lambda c: {name: f(c(v)) for name, (v, f) in values.items()}
    one = lambda row: replace(row.only(by), values=row.only(by).values | of(row.values.__getitem__)) if row.tells(*by) else None
    return derived(solutions, lambda df: df.groupBy(*by).agg(*(F.min(c).alias(name) for name, c in of(F.col).items())), by, one)


def made(solutions: DataFrame, **columns: str | Callable[[Callable[[str], Column]], Column]) -> DataFrame:
    """Columns of a solution each: a variable of that name, or what a function makes of variables."""
    kept = [v for v in columns.values() if isinstance(v, str)]
    of = lambda c: {name: c(f) if isinstance(f, str) else f(c) for name, f in columns.items()}
    one = lambda row: replace(row.only(kept), values=of(row.values.__getitem__))
    return derived(solutions, lambda df: df.select(*(c.alias(name) for name, c in of(F.col).items())), of_row=one)


def keyed(solutions: DataFrame, variable: str) -> Facts | None:
    """Solutions of one row each that a variable tells, with its key."""
    parts = parts_of(solutions)
    if len(parts) != 1 or variable not in parts[0].held or not parts[0].tells(variable):
        return None
    kind, key = parts[0].held[variable]
    row = replace(parts[0], values={f"_{variable}_key{k}": F.expr(x) for k, x in enumerate(key)} | parts[0].values)
    return Facts(noted(row.solutions(), ends_of(solutions), parts=(row,)), variable, kind, tuple(list(row.values)[: len(key)]), counted(row.table) <= FEW)


def led(solutions: DataFrame, variable: str, facts: Facts | None) -> DataFrame | None:
    """Solutions of one row each with facts of what a variable holds, joined by its key and not by its IRI, once for all variables with
    that key and the same facts; None if that cannot be."""
    parts = parts_of(solutions)
    row = parts[0].led(variable, facts) if facts and len(parts) == 1 else None
    return noted(row.solutions(), ends_of(solutions), parts=(row,)) if row else None


def dealt(solutions: DataFrame, by: str) -> DataFrame:
    """Solutions, those of one row each with all of one value of a variable in one part."""
    parts = parts_of(solutions)
    return parts[0].solutions(by) if len(parts) == 1 else solutions


def optional_fact(a: DataFrame, b: DataFrame, variable: str) -> DataFrame:
    """`optional` of at most one solution of b for each value of a variable."""
    mine, others = parts_of(a), parts_of(within(b, a))
    here = len(mine) == 1 and len(others) == 1 and mine[0].table is others[0].table
    return (None if here else led(a, variable, keyed(within(b, a), variable))) or optional(a, b)


class Graph:
    """Triples with a prefix map. Subclasses may answer `rows` from mapped tables instead of stored triples."""

    def __init__(self, triples: DataFrame, prefixes: dict[str, str] | None = None):
        self.triples, self.prefixes = triples, PREFIXES | (prefixes or {})

    def iri(self, term: str) -> str:
        """The full IRI of `prefix:local`, `a` or `<iri>`."""
        if term == "a":
            return TYPE
        if term.startswith("<"):
            return term[1:-1]
        prefix, _, local = term.partition(":")
        return self.prefixes[prefix] + local

    def rows(self, predicates: Sequence[str] | None, patterns: Sequence[Pattern], at: int, ends: Ends | None = None) -> DataFrame:
        """Triples for pattern `at` of `patterns`; `predicates` are full IRIs, None for any. `ends` may be used to read less."""
        return self.triples if predicates is None else self.triples.where(F.col("p").isin(*predicates))

    def match(self, s: Term, p: Term | Sequence[str], o: Term, context: Sequence[Pattern] = (), at: int = 0, ends: Ends | None = None) -> DataFrame:
        """Solutions of one pattern. `p` may be a list of predicates, which match alternatively."""
        alternatives = list(map(self.iri, p)) if isinstance(p, list) else None if is_variable(p) else [self.iri(p)]
        found = self.rows(alternatives, context or [(s, p, o)], at, ends)
        columns: dict[str, list[str]] = {}
        for name, term in (("s", s), ("p", p), ("o", o)):
            if isinstance(term, list) or name == "p" and not is_variable(term):
                continue
            if isinstance(term, lit):
                found = found.where((F.col(name) == F.lit(term.value)) & (F.col(f"{name}_kind") == "lit"))
            elif is_variable(term):
                columns.setdefault(term[1:], []).append(name)
            else:
                found = found.where(F.col(name) == F.lit(self.iri(term)))
                found = found.where("o_kind = 'iri'") if name == "o" else found
        for names in columns.values():  # a variable that occurs twice in the pattern
            found = reduce(lambda df, n, first=names[0]: df.where(F.col(n) == F.col(first)), names[1:], found)
        return found.select(*(F.col(names[0]).alias(v) for v, names in columns.items()))

    def named(self, s: str, names: dict[str, str], o: str, column: str, ends: Ends | None = None) -> DataFrame:
        """Solutions of patterns that differ in their predicate, in `column` the name that `names` gives it, and o_kind."""
        rows = self.rows([self.iri(p) for p in names], [(s, list(names), o)], 0, ends)
        of = F.create_map(*(F.lit(x) for p, name in names.items() for x in (self.iri(p), name)))
        return rows.select(F.col("s").alias(s[1:]), F.col("o").alias(o[1:]), F.element_at(of, F.col("p")).alias(column), "o_kind")

    def described(self, solutions: DataFrame, variable: str, properties: dict[str, str]) -> DataFrame:
        """Adds what each of `properties` (predicate to column) says of a variable, where known."""
        for p, v in properties.items():
            solutions = optional(solutions, self.match(f"?{variable}", p, f"?{v}"))
        return solutions

    def star(self, variable: str, predicates: Sequence[str] | None, ends: Ends | None = None) -> tuple[DataFrame, list[tuple[str, str, bool]]] | None:
        """One row for each value of a variable with all objects of these predicates, None for all but types, in columns of their own,
        which are named by (predicate, column, whether it is a literal); or None, if a value may have several rows."""
        return None

    def pieces(self, patterns: Sequence[Pattern], ends: Ends | None = None) -> list[DataFrame]:
        """Solutions of the patterns, one DataFrame or fewer a pattern, whose natural join answers them all."""
        return [self.match(*p, context=patterns, at=k, ends=ends) for k, p in enumerate(patterns)]

    def bgp(self, *patterns: Pattern, ends: Ends | None = None) -> DataFrame:
        """Natural inner join of the patterns, each next one sharing a variable with those before."""
        left = self.pieces(patterns, ends)
        out = left.pop(0)
        while left:
            k = next((k for k, df in enumerate(left) if set(df.columns) & set(out.columns)), None)
            if k is None:
                raise ValueError("patterns without a shared variable would need a cross join")
            out = joined(out, left.pop(k))
        return out


def is_variable(term: Term) -> bool:
    return isinstance(term, str) and term.startswith("?")


def variables(pattern: Pattern) -> list[str]:
    return [t[1:] for t in pattern if not isinstance(t, list) and is_variable(t)]


def shared(a: DataFrame, b: DataFrame) -> list[str]:
    if not (on := [c for c in a.columns if c in b.columns]):
        raise ValueError("no shared variable")
    return on


def joined(a: DataFrame, b: DataFrame) -> DataFrame:
    b = within(b, a)
    a = within(a, b)
    on, mine, others = shared(a, b), parts_of(a), parts_of(b)
    parts = fused([*mine, *others]) if mine and others else []
    out = natural(parts) if parts and len(parts) < len(mine) + len(others) else a.join(b, on)
    return noted(out, both_ends(ends_of(a), ends_of(b)), parts=tuple(parts))


def _with_optional(parts: tuple[Row, ...], others: tuple[Row, ...], on: Sequence[str]) -> tuple[Row, ...]:
    """`parts` with an optional group of one row read from the row of one of them, which must have all shared variables."""
    for k, part in enumerate(parts):
        both = part.optional(others[0]) if len(others) == 1 and all(v in part.values for v in on) else None
        if both:
            return (*parts[:k], both, *parts[k + 1 :])
    return ()


def optional(a: DataFrame, b: DataFrame, rebind: Iterable[str] = ()) -> DataFrame:
    """Left join on the shared variables. Those in `rebind` may be unbound in `a`: b then binds them, and elsewhere
    matches only if it agrees. Conditions inside the optional group belong on `b`."""
    again = [v for v in rebind if v in shared(a, b)]
    on = [v for v in shared(a, b) if v not in again]
    if not on:
        raise ValueError("an optional group needs a shared variable that is always bound")
    b = within(b, a, again)
    if (known := _KNOWN.get(b)) and known.nothing and not again:
        more = {v: F.lit(None).cast(b.schema[v].dataType) for v in b.columns if v not in a.columns}
        mine = parts_of(a) and (replace(parts_of(a)[0], values=parts_of(a)[0].values | more), *parts_of(a)[1:])
        return noted(natural(mine) if mine else a.withColumns(more), ends_of(b) | ends_of(a), parts=mine)
    if not again:
        parts = _with_optional(parts_of(a), parts_of(b), on)
        return noted(natural(parts) if parts else a.join(b, on, "left"), ends_of(b) | ends_of(a), parts=parts)
    b = b.select(*(F.col(c).alias(f"_{c}") if c in a.columns else F.col(c) for c in b.columns))
    same = reduce(Column.__and__, [F.col(v) == F.col(f"_{v}") for v in on] + [F.col(v).isNull() | (F.col(v) == F.col(f"_{v}")) for v in again])
    both = a.join(b, same, "left")
    mine = [F.coalesce(c, f"_{c}").alias(c) if c in again else F.col(c) for c in a.columns]
    out = both.select(*mine, *(c for c in b.columns if not c.startswith("_")))
    return noted(out, {v: e for v, e in (ends_of(b) | ends_of(a)).items() if v in out.columns and v not in again})


def either(*branches: DataFrame) -> DataFrame:
    """Bag union; variables that a branch lacks are unbound there."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches)
    every = [(df.columns, ends_of(df)) for df in branches]
    known = [v for v in out.columns if all(v in ends or v not in columns for columns, ends in every)]
    return noted(out, {v: frozenset().union(*(ends[v] for _, ends in every if v in ends)) for v in known})


def exists(a: DataFrame, b: DataFrame) -> DataFrame:
    return noted(a.join(within(b, a), shared(a, b), "left_semi"), ends_of(a))


def not_exists(a: DataFrame, b: DataFrame) -> DataFrame:
    return noted(a.join(within(b, a), shared(a, b), "left_anti"), ends_of(a))


ORDERS = {"asc": lambda c: c.asc_nulls_first(), "desc": lambda c: c.desc_nulls_last()}


def ordered(solutions: DataFrame, keys: Sequence[str], order: str = "asc", limit: int | None = None, numeric: bool = False) -> DataFrame:
    """Rows in order asc, desc or none; numeric orders the first key by value. All columns break ties, so a limit is stable."""
    if order not in (*ORDERS, "none"):
        raise ValueError(f"order must be asc, desc or none, not {order!r}")
    if order != "none":
        first = [F.expr(f"try_cast(`{keys[0]}` AS double)"), *map(F.col, keys)] if numeric else list(map(F.col, keys))
        ties = [F.col(c).asc_nulls_first() for c in solutions.columns if c not in keys]
        solutions = solutions.orderBy(*map(ORDERS[order], first), *ties)
    elif limit is not None:
        solutions = solutions.orderBy(*(F.col(c).asc_nulls_first() for c in solutions.columns))
    return solutions if limit is None else solutions.limit(limit)


def ask(solutions: DataFrame, name: str = "answer") -> DataFrame:
    """One row: whether there is a solution. Reads only until the first one."""
    return solutions.limit(1).agg((F.count("*") > 0).alias(name))


def construct(solutions: DataFrame, *templates: tuple[str | Column, str | Column, str | Column, str]) -> DataFrame:
    """Distinct triples from templates (s, p, o, o_kind) of columns; those with an unbound part are left out."""
    parts = [solutions.select(*(F.col(x[1:]).alias(n) if isinstance(x, str) and x.startswith("?") else (x if isinstance(x, Column) else F.lit(x)).alias(n) for n, x in zip(COLUMNS, t, strict=True))) for t in templates]
    return reduce(DataFrame.union, parts).dropna(subset=["s", "p", "o"]).distinct()


def page(solutions: DataFrame, key: str, last: str | None, size: int) -> DataFrame:
    """Keyset page: the next `size` rows after key `last`."""
    rows = solutions if last is None else solutions.where(F.col(key) > F.lit(last))
    return rows.orderBy(key).limit(size)


def with_parameters(solutions: DataFrame, parameters: DataFrame) -> DataFrame:
    """Restricts solutions by a table of parameter rows: one job answers a query for many names at once."""
    return joined(solutions, parameters)


def first_hit(key: Sequence[str], *attempts: DataFrame) -> DataFrame:
    """A fallback chain: for each key the rows of the first attempt that has any."""
    ranked = either(*(df.withColumn("_rank", F.lit(i)) for i, df in enumerate(attempts)))
    best = ranked.groupBy(*key).agg(F.min("_rank").alias("_rank"))
    return noted(ranked.join(best, [*key, "_rank"]).drop("_rank"), ends_of(either(*attempts)))


def local_name(iri: Column | str) -> Column:
    """What follows the last / or # of an IRI."""
    return F.substring_index(F.substring_index(iri, "/", -1), "#", -1)


def rendered(solutions: DataFrame) -> DataFrame:
    """One tab-separated line per row; unbound values print None."""
    return solutions.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in solutions.columns)).alias("line"))
