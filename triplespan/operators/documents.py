"""Nested documents from triples, and sections of texts.

One wide plan per document kind: the parts are aggregated by key before they are joined, so that many-valued parts do not
multiply rows, and no query runs once per node.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triplespan.functions.text import deposit_number, yield_text
from triplespan.operators import named
from triplespan.plans.patterns import Ends, Graph, dealt, derived, distinct, either, ends_of, first_hit, having, joined, keyed, least, led, local_name, made, optional, optional_fact, parts_of, picked, reduced

MISSING = "N/A"


def or_missing(c: str | Column) -> Column:
    return F.coalesce(c, F.lit(MISSING))


def gathered(rows: DataFrame, by: list[str], **values: str | Column) -> DataFrame:
    """Sorted distinct values of each column by key."""
    return rows.groupBy(*by).agg(*(F.sort_array(F.collect_set(c)).alias(n) for n, c in values.items()))


# chemicals


def chemical_names(g: Graph, skip: DataFrame | None = None) -> DataFrame:
    """(chemical, names): label first, then other names; not those in `skip` (name); Unknown if none is left."""

    def listed(every: DataFrame) -> DataFrame:
        every = every if skip is None else every.join(skip.select("name").distinct(), "name", "left_anti")
        names = every.groupBy("chemical").agg(F.sort_array(F.collect_set(F.struct("rank", "name"))).alias("n"))
        return names.select("chemical", F.array_distinct(F.transform("n", lambda x: x["name"])).alias("names"))

    return derived(g.named("?chemical", {"rdfs:label": "0", "skos:altLabel": "1"}, "?name", "rank"), listed, ["chemical"])


def chemical_star(g: Graph, ends: Ends) -> DataFrame | None:
    """(chemical), if one row tells all about each."""
    star = g.star("chemical", ("syn:hasAmount", "syn:hasChemicalFormula", "syn:hasPurity", "syn:isSuppliedBy", "rdfs:label", "skos:altLabel"), ends)
    return picked(star[0], "chemical") if star else None


def chemical_described(g: Graph, found: DataFrame) -> DataFrame:
    """Adds amount, formula, purity, names and supplier of chemicals, the smallest of each."""
    for p, v in (("syn:hasAmount", "amount"), ("syn:hasChemicalFormula", "formula"), ("syn:hasPurity", "purity")):
        found = optional(found, least(g.match("?chemical", p, f"?{v}"), "chemical", v))
    found = optional(found, chemical_names(g, g.match("?_c", "mop:hasCBUFormula", "?name").select("name")))
    return optional(found, least(g.bgp(("?chemical", "syn:isSuppliedBy", "?_s"), ("?_s", "rdfs:label", "?supplier")), "chemical", "supplier"))


def chemical_record(of: Callable[[str], Column] = F.col) -> Column:
    names = of("names")
    return F.struct(
        F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("Unknown"))).alias("chemicalName"),
        or_missing(of("amount")).alias("chemicalAmount"),
        or_missing(of("formula")).alias("chemicalFormula"),
        or_missing(of("purity")).alias("purity"),
        or_missing(of("supplier")).alias("supplierName"),
    )


def chemical_records(g: Graph, links: DataFrame, key: list[str]) -> DataFrame:
    """Per `key` an array of chemical records for `links` (key, chemical)."""
    star = chemical_star(g, ends_of(links))  # facts of a chemical are gathered before they meet its many links
    found = optional(links, chemical_described(g, star)) if star else chemical_described(g, links)
    return found.groupBy(*key).agg(F.sort_array(F.collect_set(chemical_record())).alias("chemicals"))


def procedures(g: Graph) -> DataFrame:
    """Labelled syntheses but sessions, or where there is none anything that has a step."""
    session = g.bgp(("?synthesis", "a", "owl:NamedIndividual"), ("?synthesis", "rdfs:label", "?_l")).where(F.col("_l").contains("Session"))
    listed = named.syntheses(g).join(session.select("synthesis").distinct(), "synthesis", "left_anti")
    if not listed.isEmpty():
        return listed.select("synthesis", "synthesisLabel")
    stepped = optional(distinct(picked(g.match("?synthesis", "syn:hasSynthesisStep", "?_s"), "synthesis")), named.labelled(g, "synthesis", "synthesisLabel"))
    return stepped.select("synthesis", F.coalesce("synthesisLabel", local_name("synthesis")).alias("synthesisLabel"))


def outputs(g: Graph) -> DataFrame:
    """(synthesis, name, formula, yield, ccdc) of outputs: a species' deposit number before a polyhedron's; where a synthesis
    has outputs with a real deposit number only those."""
    kinds = ends_of(g.match("?synthesis", "syn:hasChemicalOutput", "?output")).get("output")
    found = either(*(_outputs(g, {"output": frozenset({kind})}) for kind in sorted(kinds))) if kinds else _outputs(g)
    best = found.repartition("synthesis").groupBy("synthesis", "name").agg(*(F.min_by(c, F.when(F.col(c) == MISSING, 1).otherwise(0)).alias(c) for c in ("formula", "yield", "ccdc")))
    real = F.coalesce(F.col("ccdc") != MISSING, F.lit(False))
    return best.select("*", real.alias("_real"), F.max(real).over(W.partitionBy("synthesis")).alias("_any")).where("_real or not _any").drop("_real", "_any")


def _outputs(g: Graph, ends: Ends | None = None) -> DataFrame:
    """Names and values of outputs of one kind, whose row tells what they are where it can."""
    out = joined(picked(named.syntheses(g), "synthesis"), g.match("?synthesis", "syn:hasChemicalOutput", "?output", ends=ends))
    by_species = least(g.bgp(("?output", "spe:hasCCDCNumber", "?_n"), ("?_n", "spe:hasCCDCNumberValue", "?species_ccdc")), "output", "species_ccdc")
    mop = g.match("?output", "syn:isRepresentedBy", "?mop", ends=ends)
    for p, v in (("mop:hasCCDCNumber", "mop_ccdc"), ("mop:hasMOPFormula", "formula"), ("rdfs:label", "mopLabel")):
        mop = optional_fact(mop, g.match("?mop", p, f"?{v}"), "mop")
    mop = least(mop, "output", "mop_ccdc", "formula", "mopLabel")
    value = g.bgp(("?output", "syn:hasYield", "?_y"), ("?_y", "om:hasNumericalValue", "?yield"), ends=ends).groupBy("output").agg(F.max(F.expr("try_cast(`yield` AS double)")).alias("yield"))
    found = optional_fact(out, named.labelled(g, "output", "outputLabel"), "output")
    found = optional(optional_fact(optional_fact(found, by_species, "output"), mop, "output"), value)
    return found.select("synthesis", F.coalesce("outputLabel", "mopLabel", local_name("output")).alias("name"), or_missing("formula").alias("formula"), or_missing(yield_text(F.col("yield"))).alias("yield"), or_missing(F.coalesce("species_ccdc", "mop_ccdc")).alias("ccdc"))


def chemicals_document(g: Graph) -> DataFrame:
    """(synthesis, procedureName, inputChemicals, outputChemical), one row a procedure."""
    inputs = chemical_records(g, g.match("?synthesis", "syn:hasChemicalInput", "?chemical"), ["synthesis"]).withColumnRenamed("chemicals", "inputChemicals")
    out = outputs(g).groupBy("synthesis").agg(F.sort_array(F.collect_set(F.struct(F.array("name").alias("names"), F.col("formula").alias("chemicalFormula"), "yield", F.col("ccdc").alias("CCDCNumber")))).alias("outputChemical"))
    return optional(optional(procedures(g), inputs), out).withColumnRenamed("synthesisLabel", "procedureName")


# steps


STEP_FIELDS = {
    "syn:hasTargetTemperature": "targetTemperature", "syn:hasCrystallizationTargetTemperature": "crystallizationTemperature", "syn:hasStepDuration": "duration",
    "syn:hasTemperatureRate": "heatingCoolingRate", "syn:hasTransferredAmount": "transferedAmount", "syn:hasVessel": "usedVesselName", "syn:hasVesselEnvironment": "atmosphere",
    "syn:hasTargetPh": "targetPH", "syn:isStirred": "stir", "syn:isLayered": "isLayered", "syn:isVacuum": "underVacuum", "syn:isSealed": "sealedVessel",
    "syn:isVacuumFiltration": "vacuumFiltration", "syn:isRepeated": "repeated", "syn:isWait": "wait", "rdfs:comment": "comment",
    "syn:hasVacuum": "underVacuum", "syn:hasTransferedAmount": "transferedAmount", "syn:hasHeatChillDevice": "usedDevice", "syn:isLayeredTransfer": "isLayeredTransfer", "syn:isTransferedTo": "targetVesselName",
}
FLAGS = ("stir", "isLayered", "underVacuum", "sealedVessel", "vacuumFiltration", "wait", "isLayeredTransfer")
#: Fields that name the type of a vessel, by the predicate that leads to it.
VESSEL_TYPES = {"syn:hasVessel": "usedVesselType", "syn:isTransferedTo": "targetVesselType"}


def node_texts(g: Graph, rows: DataFrame, node: str, quantities: bool) -> DataFrame:
    """Adds label, and with `quantities` value and unit, of what a column holds: of a node the smallest of each."""
    known = ends_of(rows)
    ends = {node: known[node]} if node in known else None
    of = lambda p, v: least(g.match(f"?{node}", p, f"?{v}", ends=ends), node, v)
    rows = optional_fact(rows, of("rdfs:label", f"{node}_label"), node)
    if quantities:
        rows = optional_fact(rows, of("om:hasNumericalValue", f"{node}_value"), node)
        rows = optional_fact(rows, reduced(g.match(f"?{node}", "om:hasUnit", f"?{node}_u", ends=ends), [node], **{f"{node}_unit": (f"{node}_u", local_name)}), node)
    return rows


def node_text(node: str, quantities: bool, of: Callable[[str], Column] = F.col) -> Column:
    """The label of a node, or else its value and unit and its local name; or its IRI."""
    if not quantities:
        return F.coalesce(of(f"{node}_label"), of(node))
    return F.coalesce(of(f"{node}_label"), F.when(of(f"{node}_value").isNotNull(), F.concat_ws(" ", of(f"{node}_value"), of(f"{node}_unit"))), local_name(of(node)))


def star_texts(g: Graph, rows: DataFrame, objects: list[tuple[str, str, bool]], quantities: bool) -> tuple[DataFrame, list[tuple[str, Callable]]]:
    """Adds to a star (`Graph.star`) what its nodes are called, those of its own rows first; and the text of each object by
    its predicate, as a function of columns."""
    nodes, own = [c for _, c, literal in objects if not literal], {c for part in parts_of(rows) for c in part.keys}
    for c in sorted(nodes, key=lambda c: c not in own):
        rows = node_texts(g, rows, c, quantities)
    return rows, [(p, (lambda of, c=c: of(c)) if literal else (lambda of, c=c: node_text(c, quantities, of))) for p, c, literal in objects]


def vessel_type(g: Graph, vessel: str, name: str) -> DataFrame:
    """(vessel, name): the smallest label of a type of a vessel."""
    found = optional_fact(g.match(f"?{vessel}", "syn:hasVesselType", "?_t"), least(g.match("?_t", "rdfs:label", f"?{name}"), "_t", name), "_t")
    return least(found, vessel, name)


def step_fields(g: Graph, every: bool = False) -> DataFrame:
    """One row a step with a column for each field: one scan, and one pivot unless a row tells a step. An object that is a node
    counts by its label, or else by its value and unit. With `every` there may be steps without a field."""
    names, fields = {g.iri(p): f for p, f in STEP_FIELDS.items()}, list(dict.fromkeys(STEP_FIELDS.values()))
    star = g.star("step", list(STEP_FIELDS))
    if star:
        rows, texts = star_texts(g, *star, quantities=True)
        types = {v: next((c for p, c, _ in star[1] if p == g.iri(via)), None) for via, v in VESSEL_TYPES.items()}
        for v, c in types.items():
            rows = rows if c is None else optional_fact(rows, vessel_type(g, c, v), c)
        rows = rows if every else rows.where(F.coalesce(*(F.col(c) for _, c, _ in star[1])).isNotNull())
        none = lambda of: F.lit(None).cast("string")
        smallest = lambda found: found[0] if len(found) == 1 else (lambda of: F.array_min(F.array(*(text(of) for text in found)))) if found else none
        return made(rows, step="step", **{f: smallest([text for p, text in texts if names[p] == f]) for f in fields}, **{v: v if c else none for v, c in types.items()})
    kinds = picked(g.bgp(("?vessel", "syn:hasVesselType", "?_t"), ("?_t", "rdfs:label", "?label")), "vessel", "label")
    rows = node_texts(g, g.named("?step", STEP_FIELDS, "?node", "field"), "node", True)
    text = F.when(F.col("o_kind") == "lit", F.col("node")).otherwise(node_text("node", True))
    found = rows.select("step", "field", text.alias("text")).groupBy("step").pivot("field", fields).agg(F.min("text"))
    for p, v in VESSEL_TYPES.items():
        found = optional(found, joined(g.match("?step", p, "?vessel"), kinds).groupBy("step").agg(F.min("label").alias(v)))
    return found


def step_order(g: Graph) -> DataFrame:
    """(synthesis, step, stepNumber, stepLabel): smallest number, 0 if missing or no number, and smallest lower-cased label."""
    found = g.match("?synthesis", "syn:hasSynthesisStep", "?step")
    found = optional(optional(found, g.match("?step", "syn:hasOrder", "?_n")), named.labelled(g, "step", "_l"))
    found = reduced(found, ["synthesis", "step"], stepNumber=("_n", lambda c: c.try_cast("int")), stepLabel=("_l", F.lower))
    return made(found, synthesis="synthesis", step="step", stepNumber=lambda of: F.coalesce(of("stepNumber"), F.lit(0)), stepLabel="stepLabel")


def step_type(g: Graph, every: bool = False) -> DataFrame:
    """(step, type): a specific type before the general one. With `every` there may be steps without a type."""
    steps = distinct(picked(g.match("?_s", "syn:hasSynthesisStep", "?step"), "step"))
    star = g.star("step", ["a"], ends_of(steps))
    if star:
        ranked = lambda t: F.when(t.startswith(g.prefixes["syn"]), F.struct((local_name(t) == "SynthesisStep").alias("general"), local_name(t).alias("type")))
        found = made(joined(steps, star[0]), step="step", type=lambda of: F.array_min(F.array(*(ranked(of(c)) for _, c, _ in star[1])))["type"])
        return found if every else found.where("type is not null")
    types = joined(steps, g.match("?step", "a", "?t")).where(F.col("t").startswith(g.prefixes["syn"]))
    name = local_name("t")
    return types.select("step", name.alias("type")).groupBy("step").agg(F.min_by("type", F.struct((F.col("type") == "SynthesisStep").cast("int"), F.col("type"))).alias("type"))


TYPE_FIELDS = {
    "Add": ("addedChemical", "stir", "isLayered"),
    "Dissolve": ("solvent",),
    "HeatChill": ("usedDevice", "targetTemperature", "heatingCoolingRate", "underVacuum", "sealedVessel", "stir"),
    "Filter": ("washingSolvent", "vacuumFiltration", "numberOfFiltrations"),
    "Stir": ("temperature", "wait"),
    "Transfer": ("targetVesselName", "targetVesselType", "transferedAmount", "isLayered", "isLayeredTransfer"),
    "Crystallize": ("targetTemperature",),
    "Sonicate": (),
}


STEP_CHEMICALS = {"addedChemical": ["syn:hasAddedChemicalInput"], "solvent": ["syn:hasSolventDissolve"], "washingSolvent": ["syn:hasWashingSolvent", "syn:hasWashingChemical"]}


def with_chemicals(g: Graph, steps: DataFrame) -> DataFrame:
    """Steps with an array of records for each of STEP_CHEMICALS, of the first predicate that a step has; joined by the key in its row
    where a row tells a step and its chemicals."""
    links = {f"{v}{k}": g.match("?step", p, f"?{v}{k}") for v, predicates in STEP_CHEMICALS.items() for k, p in enumerate(predicates)}
    star = chemical_star(g, {"chemical": frozenset().union(*(ends_of(df).get(v, ()) for v, df in links.items()))})
    facts = keyed(star, "chemical") if star else None
    found = steps
    if facts:
        facts = facts._replace(rows=chemical_described(g, facts.rows))
        for v, df in links.items():
            found = optional(found, df) if found and len(parts_of(df)) == 1 and parts_of(df)[0].tells("step") else None
            own = {c: f"{v}_{c}" for c in facts.rows.columns if c not in (facts.of, *facts.keys)}
            found = led(found, v, facts._replace(rows=facts.rows.withColumnsRenamed(own))) if found else None
    if facts and found:
        record = lambda of, v: F.when(of(v).isNotNull(), F.array(chemical_record(lambda c: of(f"{v}_{c}"))))
        first = lambda v, n: lambda of: F.coalesce(*(record(of, f"{v}{k}") for k in range(n)))
        return made(found, **{c: c for c in steps.columns}, **{v: first(v, len(predicates)) for v, predicates in STEP_CHEMICALS.items()})
    for v, predicates in STEP_CHEMICALS.items():
        chemicals = first_hit(["step"], *(g.match("?step", p, "?chemical") for p in predicates))
        steps = optional(steps, chemical_records(g, chemicals, ["step"]).withColumnRenamed("chemicals", v))
    return steps


def steps_document(g: Graph) -> DataFrame:
    """(synthesis, productNames, productCCDCNumber, steps): steps in order, each as its type and a JSON object of its fields."""
    base = optional(optional(step_order(g), step_type(g, every=True)), step_fields(g, every=True))
    base = with_chemicals(g, base)
    flag = lambda c: F.coalesce(F.lower(c) == "true", F.lit(False))
    values = {f: flag(f) for f in FLAGS}
    values |= {f: or_missing(f) for f in ("targetTemperature", "heatingCoolingRate", "transferedAmount", "duration", "usedVesselName", "usedVesselType", "targetVesselName", "targetVesselType", "usedDevice", "comment")}
    values |= {f: F.coalesce(f, F.array().cast(base.schema[f].dataType)) for f in ("addedChemical", "solvent", "washingSolvent")}
    values["temperature"], values["numberOfFiltrations"] = or_missing("targetTemperature"), F.coalesce(F.expr("try_cast(repeated AS int)"), F.lit(1))
    values["targetTemperature"] = or_missing(F.coalesce("targetTemperature", "crystallizationTemperature"))
    values["atmosphere"] = F.when(F.lower("atmosphere") == "ambient air", "Air").otherwise(or_missing("atmosphere"))
    values["targetPH"] = F.coalesce(F.expr("try_cast(try_cast(targetPH AS double) AS int)"), F.lit(-1))
    shared = ("usedVesselName", "usedVesselType", "stepNumber", "atmosphere", "targetPH", "comment")
    struct = lambda names: F.to_json(F.struct(*(values.get(n, F.col(n)).alias(n) for n in names)))
    payload = F.lit(None).cast("string")
    for kind, names in TYPE_FIELDS.items():
        more = () if kind == "Filter" else ("duration",)
        payload = F.when(F.col("type") == kind, struct((*shared, *more, *names))).otherwise(payload)
    payload = F.coalesce(payload, struct((*shared, "duration")))
    step = F.struct("stepNumber", F.col("step").alias("iri"), F.col("type").alias("type"), payload.alias("fields"))
    listed = dealt(base, "synthesis").select("synthesis", step.alias("step")).groupBy("synthesis").agg(F.sort_array(F.collect_list("step")).alias("steps"))
    products = outputs(g).groupBy("synthesis").agg(F.sort_array(F.collect_set("name")).alias("productNames"), F.min(F.when(F.col("ccdc") != MISSING, deposit_number(F.col("ccdc")))).alias("c"))
    products = products.select("synthesis", "productNames", or_missing("c").alias("productCCDCNumber"))
    return optional(optional(procedures(g), products), listed)


def step_dump(g: Graph) -> DataFrame:
    """(step, fields): every property of every step by its name with a lower-cased initial, as sorted distinct texts."""
    steps = distinct(picked(g.match("?_s", "syn:hasSynthesisStep", "?step"), "step"))
    star = g.star("step", None, ends_of(steps))
    if star:
        rows, texts = star_texts(g, joined(steps, star[0]), star[1], quantities=False)
        by_name: dict[str, list[Column]] = {}
        for p, text in texts:
            name = re.split("[/#]", p)[-1]
            by_name.setdefault(name[:1].lower() + name[1:], []).append(text(F.col))
        listed = lambda found: F.when(found[0].isNotNull(), F.array(found[0])) if len(found) == 1 else F.sort_array(F.array_distinct(F.array_compact(F.array(*found))))
        every = F.array(*(F.struct(F.lit(key).alias("key"), listed(found).alias("texts")) for key, found in sorted(by_name.items())))
        rows = rows.where(F.coalesce(*(F.col(c) for _, c, _ in star[1])).isNotNull())  # not of the map, which would be made twice
        return rows.select("step", F.map_from_entries(F.filter(every, lambda x: F.size(x["texts"]) > 0)).alias("fields"))
    facts = having(joined(steps, g.match("?step", "?p", "?node")), F.col("p") != g.iri("a"))
    facts = optional(facts, least(named.labelled(g, "node", "label"), "node", "label"))
    name = local_name("p")
    key = F.concat(F.lower(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 30))
    by_key = facts.select("step", key.alias("key"), F.coalesce("label", "node").alias("text")).groupBy("step", "key").agg(F.sort_array(F.collect_set("text")).alias("texts"))
    return by_key.groupBy("step").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "texts")))).alias("fields"))


# characterisation and building units


def characterisation_document(g: Graph) -> DataFrame:
    """One record for each synthesis and species."""
    path = g.bgp(("?synthesis", "syn:hasChemicalOutput", "?species"), ("?species", "spe:hasCharacterizationSession", "?_x")).select("synthesis", "species").distinct()
    number = g.match("?species", "spe:hasCCDCNumber", "?_n")
    number = optional(optional(number, g.match("?_n", "spe:hasCCDCNumberValue", "?v")), named.labelled(g, "_n", "l"))
    ccdc = number.groupBy("species").agg(F.coalesce(F.min("v"), F.min("l")).alias("ccdc"))  # older graphs only label the number
    ir = g.match("?species", "spe:hasInfraredSpectroscopyData", "?ir")
    bands = joined(ir, g.match("?ir", "spe:hasBands", "?b")).groupBy("species").agg(F.array_join(F.sort_array(F.collect_set("b")), " ; ").alias("bands"))
    materials = joined(joined(ir, g.match("?ir", "spe:usesMaterial", "?m")), named.labelled(g, "m", "l")).groupBy("species").agg(F.array_join(F.sort_array(F.collect_set("l")), " ; ").alias("material"))
    ea = g.match("?species", "spe:hasElementalAnalysisData", "?ea")
    weights = ea.select("species").distinct()
    for p, v in (("spe:hasWeightPercentageCalculated", "calculated"), ("spe:hasWeightPercentageExperimental", "experimental")):
        weights = optional(weights, joined(ea, g.match("?ea", p, "?v")).groupBy("species").agg(F.min("v").alias(v)))
    names = gathered(named.labelled(g, "species", "l"), ["species"], productNames="l")
    found = path
    for part in (names, ccdc, bands, materials, weights):
        found = optional(found, part)
    return found.select(
        "synthesis", "species", F.coalesce("productNames", F.array().cast("array<string>")).alias("productNames"), or_missing("ccdc").alias("productCCDCNumber"),
        F.struct(*(or_missing(c).alias(c) for c in ("bands", "material"))).alias("InfraredSpectroscopy"),
        F.struct(or_missing("calculated").alias("weightPercentageCalculated"), or_missing("experimental").alias("weightPercentageExperimental")).alias("ElementalAnalysis"),
    )


def merged_records(records: DataFrame, key: str, names: str, bands: str, fields: list[str]) -> DataFrame:
    """Records with the same key in one: all names, all bands, and each field's smallest value that is not missing."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    parts = F.filter(F.transform(F.split(bands, ";"), lambda b: F.trim(b)), lambda b: (b != "") & (b != MISSING))
    return records.groupBy(key).agg(union(F.col(names)).alias(names), or_missing(F.nullif(F.array_join(union(parts), " ; "), F.lit(""))).alias(bands), *(or_missing(F.min(F.when(F.col(f) != MISSING, F.col(f)))).alias(f) for f in fields))


def labelled_units(g: Graph) -> DataFrame:
    """(mopCCDCNumber, cbuFormula1, cbuSpeciesNames1, cbuFormula2, cbuSpeciesNames2) of labelled polyhedra with a deposit number and
    two labelled units or more: the first two by label. Names are the label and the other names, which are parted at commas
    unless they start with a locant."""
    mops = g.bgp(("?mop", "a", "mop:MetalOrganicPolyhedron"), ("?mop", "rdfs:label", "?_m"), ("?mop", "mop:hasCCDCNumber", "?ccdc"), ("?mop", "mop:hasChemicalBuildingUnit", "?cbu")).select("mop", "ccdc", "cbu").distinct()
    label = least(named.labelled(g, "cbu", "label"), "cbu", "label")
    other = g.match("?cbu", ["syn:hasAlternativeNames", "skos:altLabel"], "?o")
    parts = F.when(F.trim("o").rlike("^(4,4|1,3|1,4)"), F.array(F.trim("o"))).otherwise(F.transform(F.split("o", ","), lambda x: F.trim(x)))
    others = other.select("cbu", F.explode(parts).alias("name")).where("name <> ''").groupBy("cbu").agg(F.sort_array(F.collect_set("name")).alias("others"))
    formula = g.match("?cbu", "syn:hasChemicalFormula", "?f").groupBy("cbu").agg(F.min("f").alias("formula"))
    units = optional(optional(joined(mops, label), others), formula)
    names = F.array_distinct(F.concat(F.array("label"), F.coalesce("others", F.array().cast("array<string>"))))
    listed = units.groupBy("mop", "ccdc").agg(F.sort_array(F.collect_set(F.struct("label", or_missing("formula").alias("formula"), names.alias("names")))).alias("u")).where(F.size("u") >= 2)
    at = lambda i, c: F.get("u", F.lit(i))[c]
    return listed.select(F.col("ccdc").alias("mopCCDCNumber"), at(0, "formula").alias("cbuFormula1"), at(0, "names").alias("cbuSpeciesNames1"), at(1, "formula").alias("cbuFormula2"), at(1, "names").alias("cbuSpeciesNames2"))


def units_document(g: Graph) -> DataFrame:
    """(mopCCDCNumber, cbuFormula1, cbuSpeciesNames1, cbuFormula2, cbuSpeciesNames2): the first two formulas in order. A unit's
    names are its labels, other names and those of entities that are the same."""
    mops = g.bgp(("?mop", "a", "mop:MetalOrganicPolyhedron"), ("?mop", "mop:hasCCDCNumber", "?ccdc"), ("?mop", "mop:hasChemicalBuildingUnit", "?cbu"))
    same = g.match("?cbu", "owl:sameAs", "?twin")
    turned = same.select(F.col("twin").alias("cbu"), F.col("cbu").alias("twin"))
    names = g.match("?twin", ["rdfs:label", "skos:altLabel"], "?name")
    own = names.withColumnRenamed("twin", "cbu")
    every = own.unionByName(joined(same.union(turned).distinct(), names).select("cbu", "name")).groupBy("cbu").agg(F.sort_array(F.collect_set("name")).alias("names"))
    units = optional(optional(mops, g.match("?cbu", "mop:hasCBUFormula", "?formula")), every)
    unit = F.struct(F.coalesce("formula", F.get("names", F.lit(0))).alias("formula"), F.coalesce("names", F.array().cast("array<string>")).alias("names"))
    listed = units.groupBy("ccdc").agg(F.sort_array(F.collect_set(unit)).alias("u"))
    at = lambda i, c: F.get("u", F.lit(i))[c]
    none = F.array().cast("array<string>")
    return listed.select(
        F.col("ccdc").alias("mopCCDCNumber"), F.coalesce(at(0, "formula"), F.lit("")).alias("cbuFormula1"), F.coalesce(at(0, "names"), none).alias("cbuSpeciesNames1"),
        F.coalesce(at(1, "formula"), F.lit("")).alias("cbuFormula2"), F.coalesce(at(1, "names"), none).alias("cbuSpeciesNames2"),
    )


# sections


def sections(docs: DataFrame, text: str = "text", source: str = "main", offset: int = 0) -> DataFrame:
    """(doc, idx, title, content, source): parts after each `## `, also inside `### `; what stands before the first is left out."""
    parts = docs.select("doc", F.posexplode(F.split(text, "## ")).alias("pos", "part")).where("pos > 0")
    title = F.trim(F.substring_index("part", "\n", 1))
    content = F.trim(F.when(F.locate("\n", F.col("part")) > 0, F.substring(F.col("part"), F.locate("\n", F.col("part")) + 1, F.length("part"))).otherwise(""))
    return parts.select("doc", (F.col("pos") + offset).alias("idx"), title.alias("title"), content.alias("content"), F.lit(source).alias("source"))


def classified(rows: DataFrame, choices: DataFrame) -> DataFrame:
    """Sections with keep_or_discard from `choices` (doc, idx, choice); other words raise when they are read."""
    bad = F.raise_error(F.concat(F.lit("not keep or discard: "), F.col("choice")))
    checked = choices.select("doc", "idx", F.when(F.col("choice").isin("keep", "discard"), F.col("choice")).otherwise(bad).alias("keep_or_discard"))
    return rows.join(checked, ["doc", "idx"], "left")


def section_status(rows: DataFrame) -> DataFrame:
    """(doc, total, classified, keep, discard, percent)."""
    n = lambda c: F.count(F.when(c, 1))
    choice = F.col("keep_or_discard")
    counted = rows.groupBy("doc").agg(F.count("*").alias("total"), n(choice.isNotNull()).alias("classified"), n(choice == "keep").alias("keep"), n(choice == "discard").alias("discard"))
    return counted.withColumn("percent", F.round(F.coalesce(F.try_divide(100.0 * F.col("classified"), "total"), F.lit(0.0)), 1))


def stitched(rows: DataFrame) -> DataFrame:
    """(doc, text): sections that are not discarded, in numeric order."""
    kept = rows.where("coalesce(keep_or_discard, 'keep') = 'keep'")
    part = F.struct("idx", F.concat(F.lit("## "), "title", F.lit("\n\n"), "content").alias("t"))
    return kept.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["t"]), "\n\n").alias("text"))
