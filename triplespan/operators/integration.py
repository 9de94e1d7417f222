"""Building units of many documents in one job: candidates, integrated graphs, grounding, and summaries.

Triples carry their document in a column doc, so a choice "for each document" is a grouping, and documents never mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplespan.operators import graphs, grounding, named
from triplespan.plans.patterns import LABEL, TYPE, Graph, first_hit, joined, least, optional

PARTS = ["doc", "s", "p", "o", "o_kind"]


class Terms:
    """Full IRIs of the vocabulary, from a graph's prefixes."""

    def __init__(self, g: Graph):
        self.mop, self.unit, self.ccdc, self.formula = map(g.iri, ("mop:MetalOrganicPolyhedron", "mop:hasChemicalBuildingUnit", "mop:hasCCDCNumber", "mop:hasMOPFormula"))
        self.output, self.synthesis, self.input = map(g.iri, ("syn:hasChemicalOutput", "syn:ChemicalSynthesis", "syn:ChemicalInput"))
        self.lists = {"labels": LABEL, "names": g.iri("skos:altLabel"), "formulas": g.iri("syn:hasChemicalFormula"), "amounts": g.iri("syn:hasAmount")}


def _having(triples: DataFrame, p: str, name: str = "o") -> DataFrame:
    return triples.where(F.col("p") == p).select("doc", "s", F.col("o").alias(name))


def first_polyhedra(triples: DataFrame, terms: Terms) -> DataFrame:
    """(doc, s, ccdc): each document's smallest subject that is typed as a polyhedron; where none is, that has a deposit number;
    where none has, that has a formula."""
    typed = triples.where((F.col("p") == TYPE) & (F.col("o") == terms.mop)).select("doc", "s")
    found = first_hit(["doc"], typed, _having(triples, terms.ccdc).select("doc", "s"), _having(triples, terms.formula).select("doc", "s"))
    found = found.groupBy("doc").agg(F.min("s").alias("s"))
    return found.join(_having(triples, terms.ccdc, "ccdc").groupBy("doc", "s").agg(F.min("ccdc").alias("ccdc")), ["doc", "s"], "left")


def unit_candidates(extension: DataFrame, root: DataFrame, terms: Terms) -> DataFrame:
    """(doc, iri, labels, names, formulas, amounts, is_input): the units of each document's polyhedron, with the trimmed distinct
    values that the root graph, and then the extension, have for them."""
    units = first_polyhedra(extension, terms).select("doc", "s").join(_having(extension, terms.unit, "iri"), ["doc", "s"]).select("doc", "iri").distinct()
    kind = F.create_map(*(F.lit(x) for name, p in terms.lists.items() for x in (p, name)))
    both = root.select(*PARTS, F.lit(0).alias("rank")).union(extension.select(*PARTS, F.lit(1).alias("rank")))
    values = both.where(F.col("p").isin(*terms.lists.values())).select("doc", F.col("s").alias("iri"), F.element_at(kind, F.col("p")).alias("kind"), F.trim("o").alias("v"), "rank").where("v <> ''")
    values = values.join(units, ["doc", "iri"]).groupBy("doc", "iri", "kind", "v").agg(F.min("rank").alias("rank"))
    listed = values.groupBy("doc", "iri").pivot("kind", list(terms.lists)).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "v"))), lambda x: x["v"]))
    inputs = both.where((F.col("p") == TYPE) & (F.col("o") == terms.input)).select("doc", F.col("s").alias("iri"), F.lit(True).alias("is_input")).distinct()
    found = units.join(listed, ["doc", "iri"], "left").join(inputs, ["doc", "iri"], "left")
    nothing = F.array().cast("array<string>")
    return found.select("doc", "iri", *(F.coalesce(c, nothing).alias(c) for c in terms.lists), F.coalesce("is_input", F.lit(False)).alias("is_input"))


def main_polyhedra(triples: DataFrame, terms: Terms) -> DataFrame:
    """(doc, s): each document's typed polyhedron with most units; without a typed one, the subject with most units. Ties prefer
    the larger IRI."""
    n_units = _having(triples, terms.unit).groupBy("doc", "s").agg(F.count("*").alias("n"))
    typed = triples.where((F.col("p") == TYPE) & (F.col("o") == terms.mop)).select("doc", "s").distinct().join(n_units, ["doc", "s"], "left").select("doc", "s", F.coalesce("n", F.lit(0)).alias("n"))
    return first_hit(["doc"], typed, n_units).groupBy("doc").agg(F.max_by("s", F.struct("n", "s")).alias("s"))


def integrated(extension: DataFrame, root: DataFrame, chosen: DataFrame, terms: Terms) -> DataFrame:
    """The graph of each document's main polyhedron: its type, labels and deposit numbers; the formula of `chosen` (doc, formula,
    units), or else its own; the first synthesis that makes it; and of its units only those chosen, with their types and
    labels from both graphs."""
    mops = main_polyhedra(extension, terms)
    facts = extension.select(*PARTS).join(mops, ["doc", "s"])
    formula = mops.join(chosen.where("trim(formula) <> ''").select("doc", F.trim("formula").alias("o")), "doc")
    own = facts.where(F.col("p") == terms.formula).join(formula.select("doc").distinct(), "doc", "left_anti")
    makers = _having(extension, terms.output).join(mops.select("doc", F.col("s").alias("o")), ["doc", "o"]).groupBy("doc", "o").agg(F.min("s").alias("s"))
    wanted = chosen.select("doc", F.explode("units").alias("unit")).distinct()
    units = facts.where(F.col("p") == terms.unit).join(wanted.withColumnRenamed("unit", "o"), ["doc", "o"]).select(*PARTS)
    about = root.select(*PARTS).union(extension.select(*PARTS)).where(F.col("p").isin(TYPE, LABEL)).join(units.select("doc", F.col("o").alias("s")).distinct(), ["doc", "s"])

    def made(rows: DataFrame, p: str, o: Column | str, kind: str) -> DataFrame:
        return rows.select("doc", "s", F.lit(p).alias("p"), o if isinstance(o, str) else o.alias("o"), F.lit(kind).alias("o_kind"))

    parts = [
        made(mops, TYPE, F.lit(terms.mop), "iri"), facts.where(F.col("p").isin(LABEL, terms.ccdc)), made(formula, terms.formula, "o", "lit"), own,
        made(makers, TYPE, F.lit(terms.synthesis), "iri"), made(makers, terms.output, "o", "iri"), units, about,
    ]
    out = parts[0].select(*PARTS)
    for part in parts[1:]:
        out = out.union(part.select(*PARTS))
    return out.distinct()


def final_records(derived: DataFrame, records: DataFrame) -> DataFrame:
    """Records (name, entity, ...) with the formula that was derived for their name, or else for their entity; those without a
    formula are left out."""
    known = derived.where("trim(formula) <> ''").groupBy("name").agg(F.min(F.trim("formula")).alias("formula"))
    by_name = records.join(known, "name")
    by_entity = records.join(known.withColumnRenamed("name", "entity"), "entity")
    return by_name.unionByName(by_entity.join(by_name.select("name", "entity").distinct(), ["name", "entity"], "left_anti")).select(*records.columns, "formula")


def grounded_documents(triples: DataFrame, reference: DataFrame, cutoff: float = 0.6, rounds: int = 10) -> DataFrame:
    """Triples (doc, s, p, o, o_kind) of all documents with equal entities merged across documents, and then each entity
    replaced by its match among `reference` (class, iri, label). Every triple stays in its document."""
    merged = grounding.canonical(triples.select("s", "p", "o", "o_kind").distinct(), rounds)
    rewritten = _in_documents(triples, merged)
    found = grounding.grounded(grounding.candidates(rewritten), reference, cutoff)
    return _in_documents(rewritten, found)


def _in_documents(triples: DataFrame, mapping: DataFrame) -> DataFrame:
    known = mapping.where("iri is not null").select(F.col("s").alias("_from"), F.col("iri").alias("_to"))
    return grounding.renamed(triples.select(*PARTS), known, "spo").select(*PARTS).distinct()


# summaries


def devices(g: Graph) -> DataFrame:
    """(kind, device, frequency): the device of each kind of the last species, by IRI, that has one; N/A without a label."""
    made = g.match("?_s", "syn:hasChemicalOutput", "?species").select("species").distinct()
    path = joined(joined(made, g.match("?species", "spe:hasCharacterizationSession", "?session")), named.by_role(g, named.DEVICES, "session", "node", "kind"))
    label = least(named.labelled(g, "node", "device"), "node", "device")
    hertz = least(g.match("?node", "spe:hasFrequency", "?frequency"), "node", "frequency").withColumn("kind", F.lit("HNMR"))
    found = optional(optional(path, label), hertz).select("species", "node", "kind", F.coalesce("device", F.lit("N/A")).alias("device"), "frequency")
    last = found.groupBy("kind").agg(F.max_by(F.struct("device", "frequency"), F.struct("species", "node")).alias("d"))
    return last.select("kind", "d.device", "d.frequency")


def class_report(triples: DataFrame, hops: int = 2, distinct: DataFrame | None = None) -> DataFrame:
    """(class, n, sample, n_triples): each class, its instances, its smallest one, and the triples around that. `distinct` has the
    triples without repeats, where they may have some."""
    samples = graphs.class_samples(triples)
    around = graphs.neighbourhood(triples if distinct is None else distinct, samples.select("s").distinct(), hops).groupBy(F.col("centre").alias("s")).agg(F.count("*").alias("n_triples"))
    return graphs.class_histogram(triples).join(samples, "class").join(around, "s", "left").select("class", "n", F.col("s").alias("sample"), F.coalesce("n_triples", F.lit(0)).alias("n_triples"))


def unit_labels(triples: DataFrame, terms: Terms, across: bool = True) -> DataFrame:
    """(iri, label) of building units: the first label over the documents in order; or (doc, iri, label) within each."""
    units = _having(triples, terms.unit, "iri").select("doc", "iri").distinct()
    named_ = units.join(_having(triples, LABEL, "label").withColumnRenamed("s", "iri"), ["doc", "iri"])
    keys = ["iri"] if across else ["doc", "iri"]
    return named_.groupBy(*keys).agg(F.min_by("label", F.struct("doc", "label")).alias("label"))


def species_summary(g: Graph, limit: int = 20) -> DataFrame:
    """(species, label, formula) of the first species by label: the smallest label and formula value of each."""
    typed = g.match("?species", "a", "spe:Species").select("species").distinct()
    label = least(named.labelled(g, "species", "label"), "species", "label")
    formula = joined(g.match("?species", "spe:hasMolecularFormula", "?f"), g.match("?f", "spe:hasMolecularFormulaValue", "?formula")).groupBy("species").agg(F.min("formula").alias("formula"))
    return optional(optional(typed, label), formula).orderBy(F.col("label").asc_nulls_last(), "species").limit(limit)


def paired_results(a: DataFrame, b: DataFrame, mapping: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """(key, a, b) of two result sets, either of which may be keyed by identifier or by hash: `mapping` (id, hash) turns
    identifiers into hashes, and other keys stay."""
    to_hash = mapping.select(F.col("id").alias(key), "hash")

    def hashed(df: DataFrame, name: str) -> DataFrame:
        return df.join(to_hash, key, "left").select(F.coalesce("hash", key).alias(key), F.col(value).alias(name))

    return hashed(a, "a").join(hashed(b, "b"), key)


def corpus_counts(g: Graph) -> DataFrame:
    """One row of eight counts: syntheses, steps, chemicals, polyhedra, those with a deposit number, units, species and
    documents."""
    of = {
        "n_syntheses": g.match("?x", "a", "syn:ChemicalSynthesis"), "n_steps": g.match("?_s", "syn:hasSynthesisStep", "?x"), "n_chemicals": g.match("?_s", "syn:hasChemicalInput", "?x"),
        "n_polyhedra": g.match("?x", "a", "mop:MetalOrganicPolyhedron"), "n_deposited": joined(g.match("?x", "a", "mop:MetalOrganicPolyhedron"), g.match("?x", "mop:hasCCDCNumber", "?_c")),
        "n_units": g.match("?_m", "mop:hasChemicalBuildingUnit", "?x"), "n_species": g.match("?x", "a", "spe:Species"), "n_documents": g.match("?_s", "syn:retrievedFrom", "?x"),
    }
    return named.distinct_counts({name: df.select("x") for name, df in of.items()})
