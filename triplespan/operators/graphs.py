"""Transforms of triple tables: merging, linking, pruning, updates, profiles and samples.

All take and return DataFrames with the columns s, p, o, o_kind (others are kept where rows are only filtered). Results are
sets: a merge or a rewrite that makes equal triples gives one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplespan.plans.patterns import COLUMNS, LABEL, TYPE, Ends, local_name
from triplespan.plans.tables import written

KEY = list(COLUMNS)
#: What is reached from centres is broadcast if it has at most this many bytes, as counted.
REACHED_BYTES = 64 << 20
#: Namespaces whose classes are the language's own.
OWN_NAMESPACES = ("http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#")


def merged(*graphs: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, (g.select(*KEY) for g in graphs)).distinct()


def without_orphans(triples: DataFrame, type_predicate: str = TYPE) -> DataFrame:
    """Drops triples of subjects that no edge other than a type leads from or to. One pass: what becomes an orphan stays."""
    edges = triples.where((F.col("p") != type_predicate) & F.col("o_kind").isin("iri", "bnode"))
    tied = edges.select("s").union(edges.select(F.col("o").alias("s"))).distinct()
    return triples.join(tied, "s", "left_semi")


def linked(triples: DataFrame, classes: list[str], through: dict[str, str] | None = None, whole: DataFrame | None = None, kinds: Ends | None = None) -> DataFrame:
    """The part of a graph between instances of `classes`: their types, labels and the edges among them; and for each
    (p, q) of `through` a bridge node between s and o of s -p-> x -q-> o, named by a hash of both. Nodes are distinct and joined,
    as Spark would copy a semi-join's right side into every branch of a union.

    `whole` (kind, s, facts) has subjects that are not in `triples`, each with all its distinct facts, as `MappedGraph.subjects`
    gives them: a row then tells whether it is a node, and only edges are joined, with nodes of the `kinds` (of s and o) that they can have."""
    nodes = triples.where((F.col("p") == TYPE) & F.col("o").isin(*classes)).select("s").distinct()
    own = triples.where(F.col("p") == TYPE).union(triples.where(F.col("p") == LABEL)).join(nodes, "s")
    edges = triples.where("o_kind = 'iri'").where(F.col("p") != TYPE).join(nodes, "s")
    others, rows = nodes, None
    if whole is not None:
        rows = whole.where(F.exists("facts", lambda x: (x["p"] == TYPE) & x["o"].isin(*classes)))
        rows = rows if kinds is None else rows.where(F.col("kind").isin(*kinds["s"]))
        others = others.union((rows if kinds is None else rows.where(F.col("kind").isin(*kinds["o"]))).select("s"))
    others = others.select(F.col("s").alias("o"))
    parts = [own.select(*KEY), edges.join(others, "o").select(*KEY)]
    for p, q in (through or {}).items():
        every = together(whole, triples)
        first = every.where(F.col("p") == p).select("s", F.col("o").alias("x"))
        second = every.where(F.col("p") == q).select(F.col("s").alias("x"), F.col("o").alias("end"))
        pairs = first.join(second, "x").select("s", "end").distinct().withColumn("node", F.concat(F.lit("http://example.org/bridge/"), F.sha1(F.concat_ws("|", "s", "end").cast("binary"))))
        parts += [
            pairs.select("s", F.lit(p).alias("p"), F.col("node").alias("o"), F.lit("iri").alias("o_kind")),
            pairs.select(F.col("node").alias("s"), F.lit(q).alias("p"), F.col("end").alias("o"), F.lit("iri").alias("o_kind")),
        ]
    found = merged(*parts)
    if rows is None:
        return found
    among = lambda x: (x["o_kind"] == "iri") & (x["p"] != TYPE) & (F.lit(True) if kinds is None else x["end"].isin(*kinds["o"]))
    return found.union(of_subjects(rows, lambda x: x["p"].isin(TYPE, LABEL))).union(of_subjects(rows, lambda x: among(x) & (x["p"] != LABEL)).join(others, "o").select(*KEY))


def together(whole: DataFrame | None, others: DataFrame) -> DataFrame:
    """All triples of a graph in these two parts."""
    return others.select(*KEY) if whole is None else of_subjects(whole).union(others.select(*KEY))


def of_subjects(whole: DataFrame, wanted: Callable[[Column], Column] | None = None) -> DataFrame:
    """The triples of (s, facts), those that are `wanted`."""
    facts = F.filter("facts", wanted) if wanted else F.col("facts")
    return whole.select("s", F.explode(facts).alias("x")).select("s", "x.p", "x.o", "x.o_kind")


# updates


def with_value(triples: DataFrame, new: DataFrame) -> DataFrame:
    """Sets single-valued properties: all values of the (s, p) in `new` go, those in `new` come."""
    return merged(triples.join(new.select("s", "p").distinct(), ["s", "p"], "left_anti"), new)


def with_edges(triples: DataFrame, new: DataFrame) -> DataFrame:
    return merged(triples, new)


def without_triples(triples: DataFrame, gone: DataFrame, by_value: bool = False) -> DataFrame:
    """Removes triples; `by_value` ignores the kind of the object."""
    keys = KEY[:3] if by_value else KEY
    return triples.join(gone.select(*keys).distinct(), keys, "left_anti")


def without_entities(triples: DataFrame, gone: DataFrame) -> DataFrame:
    """Removes entities (column s) with the edges from and to them; predicates are left alone."""
    kept = triples.join(gone.select("s").distinct(), "s", "left_anti")
    ends = gone.select(F.col("s").alias("_o")).distinct()
    return kept.join(ends, (F.col("o") == F.col("_o")) & (F.col("o_kind") != "lit"), "left_anti").select(*triples.columns)


def children(parents: DataFrame, predicate: str, name: str, literals: dict[str, str]) -> DataFrame:
    """Rows that mint a child node for each parent (column s), type it, link it, and give it the columns of `literals`
    (predicate to column). Its IRI is the parent's and the class, so a rerun makes the same node."""
    node = F.concat("s", F.lit("/"), F.lit(name))
    rows = [
        parents.select("s", F.lit(predicate).alias("p"), node.alias("o"), F.lit("iri").alias("o_kind")),
        parents.select(node.alias("s"), F.lit(TYPE).alias("p"), F.lit(f"http://example.org/{name}").alias("o"), F.lit("iri").alias("o_kind")),
    ]
    rows += [parents.select(node.alias("s"), F.lit(p).alias("p"), F.col(c).cast("string").alias("o"), F.lit("lit").alias("o_kind")).where("o is not null") for p, c in literals.items()]
    return merged(*rows)


# profiles


def class_histogram(triples: DataFrame) -> DataFrame:
    """Instances of each class outside the language's own namespaces."""
    typed = triples.where(F.col("p") == TYPE)
    for namespace in OWN_NAMESPACES:
        typed = typed.where(~F.col("o").startswith(namespace))
    return typed.groupBy(F.col("o").alias("class")).agg(F.count("*").alias("n"))


def predicate_usage(triples: DataFrame) -> DataFrame:
    """Uses of each predicate on instances of each class."""
    classes = triples.where(F.col("p") == TYPE).select("s", F.col("o").alias("class"))
    return triples.where(F.col("p") != TYPE).join(classes, "s").groupBy("class", "p").agg(F.count("*").alias("n"))


def class_samples(triples: DataFrame) -> DataFrame:
    """The smallest instance of each class."""
    return triples.where(F.col("p") == TYPE).groupBy(F.col("o").alias("class")).agg(F.min("s").alias("s"))


def neighbourhood(triples: DataFrame, centres: DataFrame, hops: int = 2) -> DataFrame:
    """(centre, s, p, o, o_kind): triples within `hops` edges of each centre, in both directions, of distinct triples. Centres are
    meant to be few, such as one sample a class. A hop reads the graph once: a triple takes the centres that reach its subject or
    its object, so it is found once a centre, and those of the last hop are all. What a hop starts from is written, and broadcast if its
    counted bytes are few: then neither the graph nor what is found is shuffled."""
    reached, none = centres.select(F.col("s").alias("centre"), F.col("s").alias("node")), F.array().cast("array<string>")
    for _ in range(hops):
        near = written(reached.where("node is not null").groupBy("node").agg(F.collect_set("centre").alias("centres")), "reached")
        size = near.agg(F.sum(64 + F.octet_length("node") + F.aggregate("centres", F.lit(0), lambda n, c: n + 16 + F.octet_length(c)))).first()[0] or 0
        near = F.broadcast(near) if size <= REACHED_BYTES else near
        by_s, by_o = near.select(F.col("node").alias("s"), F.col("centres").alias("_by_s")), near.select(F.col("node").alias("_o"), F.col("centres").alias("_by_o"))
        met = triples.select(*KEY).join(by_s, "s", "left").join(by_o, (F.col("o") == F.col("_o")) & (F.col("o_kind") != "lit"), "left")
        met = met.where("_by_s is not null or _by_o is not null")
        found = met.select(F.explode(F.array_union(F.coalesce("_by_s", none), F.coalesce("_by_o", none))).alias("centre"), *KEY)
        reached = found.select("centre", F.explode(F.array("s", F.when(F.col("o_kind") != "lit", F.col("o")))).alias("node"))
    return found


def subject_dump(triples: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """One row per subject with its sorted (p, o) pairs. `whole` (s, facts) has subjects that are not in `triples`, each with all its
    facts, which are sorted in their row."""
    found = triples.groupBy("s").agg(F.sort_array(F.collect_set(F.struct("p", "o"))).alias("facts"))
    if whole is None:
        return found
    pairs = F.transform("facts", lambda x: F.struct(x["p"].alias("p"), x["o"].alias("o")))
    return whole.select("s", F.sort_array(F.array_distinct(pairs)).alias("facts")).union(found)


def labels_or_names(triples: DataFrame, kind: str) -> DataFrame:
    """(s, label) of instances of a class; the local name where there is no label."""
    typed = triples.where((F.col("p") == TYPE) & (F.col("o") == kind)).select("s").distinct()
    labels = triples.where(F.col("p") == LABEL).select("s", F.col("o").alias("label"))
    return typed.join(labels, "s", "left").select("s", F.coalesce("label", local_name("s")).alias("label")).distinct()


def schema(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class, parent) and (property, domain, range, kind) of an ontology's own triples."""
    owl, rdfs = OWN_NAMESPACES[2], OWN_NAMESPACES[1]
    typed = lambda kind: triples.where((F.col("p") == TYPE) & (F.col("o") == kind)).select("s").distinct()
    of = lambda p, name: triples.where(F.col("p") == p).select("s", F.col("o").alias(name))
    classes = typed(f"{owl}Class").join(of(f"{rdfs}subClassOf", "parent"), "s", "left").withColumnRenamed("s", "class")
    properties = typed(f"{owl}ObjectProperty").withColumn("kind", F.lit("object")).union(typed(f"{owl}DatatypeProperty").withColumn("kind", F.lit("datatype")))
    properties = properties.join(of(f"{rdfs}domain", "domain"), "s", "left").join(of(f"{rdfs}range", "range"), "s", "left").withColumnRenamed("s", "property")
    return classes, properties


def ancestors(classes: DataFrame, levels: int | None = None) -> DataFrame:
    """(class, ancestor, level) by following parents; all the way, or `levels` steps. Level: the fewest steps. On a cycle a
    class is an ancestor of its own."""
    edges = classes.where("parent is not null").select("class", "parent").distinct()
    last = found = edges.select("class", F.col("parent").alias("ancestor"), F.lit(1).alias("level"))
    level = 1
    while level != levels:
        level += 1
        step = last.select("class", F.col("ancestor").alias("via")).join(edges.select(F.col("class").alias("via"), F.col("parent").alias("ancestor")), "via")
        last = written(step.select("class", "ancestor", F.lit(level).alias("level")).distinct().join(found, ["class", "ancestor"], "left_anti").select("class", "ancestor", "level"), "ancestors")
        if last.isEmpty():
            break
        found = found.union(last)
    return found


def inherited_properties(classes: DataFrame, properties: DataFrame, levels: int | None = 1) -> DataFrame:
    """(class, property): own ones, and those of parents up to `levels` steps (None: all)."""
    own = properties.select(F.col("domain").alias("class"), "property").where("class is not null")
    above = ancestors(classes, levels).join(own.withColumnRenamed("class", "ancestor"), "ancestor").select("class", "property")
    return own.union(above).distinct()


def iri_for(prefix: str, *parts: Column) -> Column:
    """A deterministic IRI: the first 32 hex digits of a SHA-256 of the parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32))


def ontology(rows: DataFrame) -> DataFrame:
    """Triples of an ontology from (class, parent, property, kind, range, least, most, exactly): classes, properties with
    domain and range, and cardinalities as restrictions, which are named by a hash of what they say. A row with an exact
    number and a bound fails the job."""
    owl, rdfs = OWN_NAMESPACES[2], OWN_NAMESPACES[1]
    checked = rows.withColumn("exactly", F.when(F.col("exactly").isNotNull() & (F.col("least").isNotNull() | F.col("most").isNotNull()), F.raise_error(F.concat(F.lit("an exact number and a bound: "), "class", F.lit(" "), "property")).cast("int")).otherwise(F.col("exactly")))
    number = {"minCardinality": "least", "maxCardinality": "most", "cardinality": "exactly"}
    node = F.concat(F.lit("r"), F.substring(F.sha2(F.concat_ws("|", "class", "property", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in number.values())), 256), 1, 32))
    kind = F.when(F.col("kind") == "object", F.lit(f"{owl}ObjectProperty")).otherwise(F.lit(f"{owl}DatatypeProperty"))
    bound = F.col("least").isNotNull() | F.col("most").isNotNull() | F.col("exactly").isNotNull()
    # (subject, predicate, object, kind of object, condition)
    templates = [
        (F.col("class"), TYPE, F.lit(f"{owl}Class"), "iri", F.lit(True)), (F.col("class"), f"{rdfs}subClassOf", F.col("parent"), "iri", F.lit(True)), (F.col("property"), TYPE, kind, "iri", F.lit(True)),
        (F.col("property"), f"{rdfs}domain", F.col("class"), "iri", F.lit(True)), (F.col("property"), f"{rdfs}range", F.col("range"), "iri", F.lit(True)),
        (F.col("class"), f"{rdfs}subClassOf", node, "bnode", bound), (node, TYPE, F.lit(f"{owl}Restriction"), "iri", bound), (node, f"{owl}onProperty", F.col("property"), "iri", bound),
        *((node, f"{owl}{p}", F.col(c).cast("string"), "lit", bound) for p, c in number.items()),
    ]
    rows = F.explode(F.array(*(F.when(c & s.isNotNull() & o.isNotNull(), F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(k).alias("o_kind"))) for s, p, o, k, c in templates)))
    return checked.select(rows.alias("t")).where("t is not null").select("t.*").distinct()
