"""The named queries over a synthesis graph: each takes a Graph and parameters and gives solutions.

Vocabulary terms are written `syn:`, `mop:`, `spe:` and `om:`; a Graph maps these prefixes to the namespaces of its data.
A name of None leaves a query unrestricted, so that one job answers it for all syntheses at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplespan.plans.patterns import Graph, derived, either, exists, having, joined, lit, local_name, optional, ordered, picked
from triplespan.plans.tables import spread

LABEL = "rdfs:label"
#: Role of a chemical by the predicate that leads to it, for the synthesis and for its steps.
CHEMICAL_ROLES = {"syn:hasChemicalInput": "synthesis_input"}
STEP_CHEMICAL_ROLES = {"syn:hasAddedChemicalInput": "added", "syn:hasSolventDissolve": "solvent", "syn:hasWashingSolvent": "washing_solvent", "syn:hasWashingChemical": "washing_chemical"}
TEMPERATURES = {"syn:hasTargetTemperature": "target", "syn:hasCrystallizationTargetTemperature": "crystallization"}
PLACEHOLDER = "MetalOrganicPolyhedron for"


def syntheses(g: Graph, name: str | None = None) -> DataFrame:
    """synthesis, synthesisLabel; of one name if given."""
    found = g.bgp(("?synthesis", "a", "syn:ChemicalSynthesis"), ("?synthesis", LABEL, "?synthesisLabel"))
    return found if name is None else having(found, F.col("synthesisLabel") == F.lit(name))


def steps(g: Graph, name: str | None = None) -> DataFrame:
    return joined(syntheses(g, name), g.match("?synthesis", "syn:hasSynthesisStep", "?step"))


def labelled(g: Graph, variable: str, label: str) -> DataFrame:
    return g.match(f"?{variable}", LABEL, f"?{label}")


def quantity(g: Graph, solutions: DataFrame, predicate: str | list[str], value_required: bool = True) -> DataFrame:
    """Adds value and unit of the quantity that `predicate` leads to from step."""
    node = joined(solutions, g.match("?step", predicate, "?quantity"))
    value = g.match("?quantity", "om:hasNumericalValue", "?value")
    if value_required:
        node = optional(joined(node, value), g.match("?quantity", "om:hasUnit", "?unitIri"))
    else:
        node = g.described(node, "quantity", {"om:hasNumericalValue": "value", "om:hasUnit": "unitIri"})
    return derived(node, lambda df: df.withColumn("unit", local_name("unitIri")).drop("unitIri", "quantity"))


def by_role(g: Graph, roles: dict[str, str], subject: str, target: str, column: str = "role") -> DataFrame:
    """(subject, target, role): one scan with a constant map instead of one branch a role."""
    return picked(g.named(f"?{subject}", roles, f"?{target}", column), subject, target, column)


# exact lookup


def synthesis_iri(g: Graph, name: str) -> DataFrame:
    return ordered(syntheses(g, name).select("synthesis"), ["synthesis"], limit=5)


def polyhedra(g: Graph, exclude_placeholders: bool = False) -> DataFrame:
    """mop, mopLabel, and its deposit number and formula where known."""
    found = g.bgp(("?mop", "a", "mop:MetalOrganicPolyhedron"), ("?mop", LABEL, "?mopLabel"))
    found = g.described(found, "mop", {"mop:hasCCDCNumber": "ccdc", "mop:hasMOPFormula": "formula"})
    return having(found, ~F.col("mopLabel").startswith(PLACEHOLDER)) if exclude_placeholders else found


def polyhedron_iri(g: Graph, name: str) -> DataFrame:
    return ordered(polyhedra(g).where(F.col("mopLabel") == F.lit(name)).select("mop", "ccdc").distinct(), ["mop"], limit=5)


def polyhedron_by_deposit(g: Graph, ccdc: str) -> DataFrame:
    return polyhedra(g).where(F.col("ccdc") == F.lit(ccdc)).select("mop", "mopLabel", "formula").distinct()


def all_polyhedra(g: Graph, limit: int | None = 100, exclude_placeholders: bool = False) -> DataFrame:
    return ordered(polyhedra(g, exclude_placeholders).select("mopLabel", "ccdc", "formula").distinct(), ["mopLabel"], limit=limit)


def polyhedra_by_unit_formula(g: Graph, part: str, limit: int | None = 100, order: str = "asc") -> DataFrame:
    if not part:
        raise ValueError("the part of the formula must not be empty")
    units = g.bgp(("?mop", "mop:hasChemicalBuildingUnit", "?cbu"), ("?cbu", "mop:hasCBUFormula", "?cbuFormula")).where(F.lower("cbuFormula").contains(part.lower()))
    return ordered(joined(polyhedra(g), units).select("mopLabel", "ccdc", "cbuFormula").distinct(), ["mopLabel", "cbuFormula"], order, limit)


def building_units(g: Graph, name: str | None = None) -> DataFrame:
    mops = polyhedra(g) if name is None else polyhedra(g).where(F.col("mopLabel") == F.lit(name))
    units = joined(mops.select("mop", "mopLabel", "ccdc").distinct(), g.match("?mop", "mop:hasChemicalBuildingUnit", "?cbu"))
    return ordered(g.described(units, "cbu", {LABEL: "cbuLabel", "mop:hasCBUFormula": "cbuFormula"}), ["mopLabel", "ccdc", "cbuLabel"])


# corpus statistics


def distinct_counts(of: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of distinct rows of each one-column table, by name. Each is made distinct before it is counted,
    so no row is expanded for another count; values are shuffled first and spread by their count, so that a task's table of them
    stays small however large its part of a scan is."""
    parts = [df.select(F.lit(name).alias("name"), F.col(df.columns[0]).alias("x")) for name, df in of.items()]
    counted = spread(either(*parts), "name", "x").distinct().groupBy("name").agg(F.count("*").alias("n"))
    return counted.agg(*(F.coalesce(F.sum(F.when(F.col("name") == name, F.col("n"))), F.lit(0)).alias(name) for name in of))


def statistics(g: Graph) -> DataFrame:
    """Counts of labelled polyhedra, syntheses, steps and distinct chemicals."""
    return distinct_counts({
        "n_mop": g.bgp(("?mop", "a", "mop:MetalOrganicPolyhedron"), ("?mop", LABEL, "?_l")).select("mop"),
        "n_synthesis": g.match("?synthesis", "a", "syn:ChemicalSynthesis"),
        "n_step": g.match("?_s", "syn:hasSynthesisStep", "?step").select("step"),
        "n_chemical": g.match("?_s", "syn:hasChemicalInput", "?chemical").select("chemical"),
    })


def usage(g: Graph, *patterns: tuple, by: str, of: str, distinct: bool = False, limit: int | None = 20, order: str = "desc") -> DataFrame:
    """How many solutions, or distinct `of`, each `by` has; most used first, ties by name."""
    found = g.bgp(*patterns).where(F.length(by) > 0)
    counted = found.groupBy(by).agg((F.count_distinct(of) if distinct else F.count(of)).alias("n"))
    return ordered(counted.withColumn("n", F.col("n").cast("long")), ["n", by] if order == "asc" else ["n"], order, limit)


def common_chemicals(g: Graph, limit: int | None = 20) -> DataFrame:
    return usage(g, ("?synthesis", "syn:hasChemicalInput", "?chemical"), ("?chemical", LABEL, "?label"), by="label", of="synthesis", limit=limit)


def common_materials(g: Graph, limit: int | None = 20, order: str = "desc") -> DataFrame:
    return usage(g, ("?species", "spe:hasInfraredSpectroscopyData", "?ir"), ("?ir", "spe:usesMaterial", "?m"), ("?m", LABEL, "?material"), by="material", of="species", distinct=True, limit=limit, order=order)


def common_nmr_solvents(g: Graph, limit: int | None = 20, order: str = "desc") -> DataFrame:
    return usage(g, ("?species", "spe:hasHNMRData", "?nmr"), ("?nmr", "spe:usesSolvent", "?s"), ("?s", LABEL, "?solvent"), by="solvent", of="species", distinct=True, limit=limit, order=order)


def suppliers(g: Graph, limit: int | None = None) -> DataFrame:
    return usage(g, ("?chemical", "syn:isSuppliedBy", "?s"), ("?s", LABEL, "?supplier"), by="supplier", of="chemical", limit=limit)


def step_types(g: Graph) -> DataFrame:
    """Steps by type, those of the general type included."""
    found = g.bgp(("?synthesis", "syn:hasSynthesisStep", "?step"), ("?step", "a", "?type"))
    return found.groupBy(local_name("type").alias("type")).agg(F.count("step").alias("n")).orderBy(F.desc("n"), "type")


# one synthesis, or all


def recipe(g: Graph, name: str | None = None) -> DataFrame:
    """Chemicals with their role, and label, amount, formula, supplier and purity where known."""
    whole = joined(syntheses(g, name), by_role(g, CHEMICAL_ROLES, "synthesis", "chemical"))
    in_steps = optional(joined(steps(g, name), by_role(g, STEP_CHEMICAL_ROLES, "step", "chemical")), labelled(g, "step", "stepLabel"))  # of the same row, before the union
    found = picked(either(whole, in_steps), "synthesisLabel", "role", "chemical", "stepLabel")
    found = g.described(found, "chemical", {LABEL: "chemicalLabel", "syn:hasAmount": "amount", "syn:hasChemicalFormula": "formula", "syn:hasPurity": "purity"})
    found = optional(found, g.bgp(("?chemical", "syn:isSuppliedBy", "?_s"), ("?_s", LABEL, "?supplier")).drop("_s"))
    found = found.select("synthesisLabel", "role", "chemicalLabel", "amount", "formula", "purity", "supplier", "stepLabel")
    return ordered(found.distinct(), ["synthesisLabel", "role", "stepLabel", "chemicalLabel"])


def producing(g: Graph, mop: str) -> DataFrame:
    """Syntheses whose output is the polyhedron, or is represented by it."""
    named = g.bgp(("?mop", "a", "mop:MetalOrganicPolyhedron"), ("?mop", LABEL, lit(mop)))
    direct = joined(g.match("?synthesis", "syn:hasChemicalOutput", "?mop"), named)
    through = joined(g.bgp(("?synthesis", "syn:hasChemicalOutput", "?output"), ("?output", "syn:isRepresentedBy", "?mop")), named).drop("output")
    return ordered(joined(direct.unionByName(through), syntheses(g)).select("synthesis", "synthesisLabel").distinct(), ["synthesisLabel"])


def step_list(g: Graph, name: str | None = None) -> DataFrame:
    """Labels and type names of steps, by label."""
    typed = optional(joined(steps(g, name), labelled(g, "step", "stepLabel")), having(g.match("?step", "a", "?type"), F.col("type").startswith(g.prefixes["syn"])))
    return ordered(typed.select("synthesisLabel", "stepLabel", local_name("type").alias("type")).distinct(), ["synthesisLabel", "stepLabel"])


def step_index(g: Graph, name: str | None = None) -> DataFrame:
    found = g.described(steps(g, name), "step", {LABEL: "stepLabel", "syn:hasOrder": "position"})
    types = having(g.match("?step", "a", "?type"), F.col("type").startswith(g.prefixes["syn"]))
    found = optional(found, types).withColumn("type", local_name("type"))
    return ordered(found.withColumn("_n", F.expr("try_cast(position AS int)")), ["synthesisLabel", "_n", "step"]).drop("_n")


def temperatures(g: Graph, name: str | None = None, kind: str = "any", order: str = "asc") -> DataFrame:
    """Steps' temperatures of kind target, crystallization or any, by value."""
    if kind not in (*TEMPERATURES.values(), "any"):
        raise ValueError(f"unknown kind of temperature {kind!r}")
    roles = {p: k for p, k in TEMPERATURES.items() if kind in (k, "any")}
    found = joined(steps(g, name), by_role(g, roles, "step", "quantity", "temperatureKind"))
    found = joined(found, g.match("?quantity", "om:hasNumericalValue", "?value"))
    found = optional(optional(found, g.match("?quantity", "om:hasUnit", "?unitIri")), labelled(g, "step", "stepLabel")).withColumn("unit", local_name("unitIri"))
    return ordered(found.select("synthesisLabel", "stepLabel", "temperatureKind", "value", "unit"), ["value"], order, numeric=True)


def durations(g: Graph, name: str | None = None, order: str = "asc") -> DataFrame:
    found = quantity(g, optional(steps(g, name), labelled(g, "step", "stepLabel")), "syn:hasStepDuration")
    return ordered(found.select("synthesisLabel", "stepLabel", "value", "unit"), ["value"], order, numeric=True)


def temperature_rates(g: Graph, name: str | None = None) -> DataFrame:
    return quantity(g, steps(g, name), "syn:hasTemperatureRate").select("synthesisLabel", "step", "value", "unit")


def transferred_amounts(g: Graph, name: str | None = None) -> DataFrame:
    return quantity(g, steps(g, name), "syn:hasTransferredAmount", value_required=False).select("synthesisLabel", "step", "value", "unit")


def vessels(g: Graph, name: str | None = None) -> DataFrame:
    """Vessels of steps, with label, type and environment where known; the type's label only with the type."""
    kinds = optional(g.match("?vessel", "syn:hasVesselType", "?vesselType"), labelled(g, "vesselType", "vesselTypeLabel"))
    found = optional(joined(steps(g, name), g.match("?step", "syn:hasVessel", "?vessel")), labelled(g, "vessel", "vesselLabel"))
    return optional(optional(found, kinds), environments(g).select("step", "environment")).drop("synthesis")


def environments(g: Graph) -> DataFrame:
    return joined(g.match("?step", "syn:hasVesselEnvironment", "?env"), labelled(g, "env", "environment"))


def step_details(g: Graph, name: str | None, kind: str, optionals: dict[str, str]) -> DataFrame:
    """Steps of one type with labels of what each of `optionals` (predicate to column) leads to, where known."""
    found = joined(steps(g, name), g.match("?step", "a", kind))
    for p, v in optionals.items():
        found = optional(found, joined(g.match("?step", p, f"?_{v}"), labelled(g, f"_{v}", v)).drop(f"_{v}"))
    return found.drop("synthesis")


def drying(g: Graph, name: str | None = None) -> DataFrame:
    return step_details(g, name, "syn:Dry", {"syn:hasDryingTemperature": "temperature", "syn:hasDryingPressure": "pressure", "syn:hasDryingAgent": "agent"})


def evaporation(g: Graph, name: str | None = None) -> DataFrame:
    optionals = {"syn:hasEvaporationTemperature": "temperature", "syn:hasEvaporationPressure": "pressure", "syn:hasTargetVolume": "volume", "syn:removesSpecies": "removed"}
    return step_details(g, name, "syn:Evaporate", optionals)


def separation_solvents(g: Graph, name: str | None = None) -> DataFrame:
    return step_details(g, name, "syn:Separate", {"syn:hasSeparationSolvent": "solvent"}).where("solvent is not null")


def step_parameters(g: Graph, name: str | None = None) -> DataFrame:
    return joined(steps(g, name), g.match("?step", "syn:hasParameter", "?parameter")).select("synthesisLabel", "step", "parameter")


def equipment(g: Graph, name: str | None = None) -> DataFrame:
    whole = joined(syntheses(g, name), g.match("?synthesis", "syn:hasEquipment", "?equipment"))
    in_steps = joined(steps(g, name), g.match("?step", "syn:hasEquipment", "?equipment"))
    in_scope = lambda df, scope: derived(df, lambda rows: rows.withColumn("scope", F.lit(scope)))
    return joined(either(in_scope(whole, "synthesis"), in_scope(in_steps, "step")), labelled(g, "equipment", "equipmentLabel")).select("synthesisLabel", "scope", "step", "equipmentLabel").distinct()


def documents(g: Graph, name: str | None = None) -> DataFrame:
    return optional(joined(syntheses(g, name), g.match("?synthesis", "syn:retrievedFrom", "?document")), labelled(g, "document", "documentLabel"))


def inheritance(g: Graph, name: str | None = None) -> DataFrame:
    """Procedures that a synthesis inherits from, and those that inherit from it, one step away."""
    way = lambda df, direction: derived(df, lambda rows: rows.withColumn("direction", F.lit(direction)))
    onward, back = g.match("?synthesis", "syn:inheritsFromProcedure", "?other"), g.match("?other", "syn:inheritsFromProcedure", "?synthesis")
    both = either(way(onward, "inherits_from"), way(back, "inherited_by"))
    return optional(joined(syntheses(g, name), both), labelled(g, "other", "otherLabel"))


def yields(g: Graph, name: str | None = None) -> DataFrame:
    """Yield nodes of syntheses and of their outputs; the first of two value vocabularies counts where they differ. Rows
    without a value and a real label are left out."""
    direct = joined(syntheses(g, name), g.match("?synthesis", "syn:hasYield", "?yield"))
    output = joined(syntheses(g, name), g.bgp(("?synthesis", "syn:hasChemicalOutput", "?_o"), ("?_o", "syn:hasYield", "?yield")))
    found = optional(either(direct, picked(output, *direct.columns)), g.match("?yield", "om:hasNumericalValue", "?value"))
    found = optional(found, g.match("?yield", "qudt:numericValue", "?value"), rebind=["value"])
    found = optional(found, labelled(g, "yield", "yieldLabel"))
    return found.where("value is not null or coalesce(upper(trim(yieldLabel)), '') not in ('', 'N/A', 'NA')").drop("synthesis").distinct()


def products(g: Graph, name: str | None = None) -> DataFrame:
    path = g.bgp(("?synthesis", "syn:hasChemicalOutput", "?output"), ("?output", "syn:isRepresentedBy", "?mop"))
    return joined(joined(syntheses(g, name), path), polyhedra(g)).select("synthesisLabel", "mopLabel", "ccdc", "formula").distinct()


# characterisation


def species(g: Graph, limit: int | None = 100, order: str = "asc") -> DataFrame:
    """Labelled species that have a characterisation session."""
    found = g.bgp(("?species", "a", "spe:Species"), ("?species", LABEL, "?speciesLabel"))
    return ordered(exists(found, g.match("?species", "spe:hasCharacterizationSession", "?_x").select("species")), ["speciesLabel"], order, limit)


def characterised(g: Graph, limit: int | None = 100, order: str = "asc") -> DataFrame:
    path = g.bgp(("?synthesis", "syn:hasChemicalOutput", "?species"), ("?species", "spe:hasCharacterizationSession", "?_x"))
    return ordered(joined(syntheses(g), path).select("synthesisLabel").distinct(), ["synthesisLabel"], order, limit)


DEVICES = {"spe:hasHNMRDevice": "HNMR", "spe:hasElementalAnalysisDevice": "ElementalAnalysis", "spe:hasInfraredSpectroscopyDevice": "InfraredSpectroscopy"}


def devices(g: Graph, limit: int | None = 100) -> DataFrame:
    """Devices with their kind; a frequency only for NMR."""
    found = joined(by_role(g, DEVICES, "session", "device", "deviceType"), labelled(g, "device", "deviceLabel"))
    nmr = g.match("?device", "spe:hasFrequency", "?frequency").withColumn("deviceType", F.lit("HNMR"))
    return ordered(optional(found.drop("session").distinct(), nmr).drop("device").distinct(), ["deviceType", "deviceLabel"], limit=limit)


def characterisation(g: Graph, subjects: DataFrame, order_by: str = "speciesLabel", order: str = "asc") -> DataFrame:
    """Everything known of `subjects` (species, ...): independent many-valued parts multiply rows, as in the graph."""
    found = optional(subjects, labelled(g, "species", "speciesLabel"))
    found = optional(found, g.match("?species", "spe:hasCCDCNumber", "?ccdcNode").join(g.match("?ccdcNode", "spe:hasCCDCNumberValue", "?ccdc"), "ccdcNode").drop("ccdcNode"))
    node = optional(optional(g.match("?species", "spe:hasMolecularFormula", "?f"), g.match("?f", "spe:hasMolecularFormulaValue", "?fv")), labelled(g, "f", "fl"))
    found = optional(found, node.select("species", F.coalesce("fv", "fl").alias("formula")))
    ir = optional(g.match("?species", "spe:hasInfraredSpectroscopyData", "?ir"), g.match("?ir", "spe:hasBands", "?bands"))
    ir = optional(ir, joined(g.match("?ir", "spe:usesMaterial", "?m"), labelled(g, "m", "material")).drop("m"))
    found = optional(found, ir.drop("ir"))
    ea = g.match("?species", "spe:hasElementalAnalysisData", "?ea")
    for p, v in (("spe:hasWeightPercentageCalculated", "calculated"), ("spe:hasWeightPercentageExperimental", "experimental")):
        ea = optional(ea, g.match("?ea", p, f"?{v}"))
    found = optional(found, ea.drop("ea")).distinct()
    if order_by not in ("speciesLabel", "ccdc", "formula", "material"):
        raise ValueError(f"cannot order by {order_by!r}")
    return ordered(found, [order_by], order)


def characterisation_of_synthesis(g: Graph, name: str | None = None, order_by: str = "speciesLabel", order: str = "asc") -> DataFrame:
    path = g.match("?synthesis", "syn:hasChemicalOutput", "?species").join(g.match("?species", "a", "spe:Species"), "species")
    return characterisation(g, joined(syntheses(g, name), path).select("synthesisLabel", "species"), order_by, order)


def characterisation_by_deposit(g: Graph, ccdc: str, order: str = "asc") -> DataFrame:
    return characterisation(g, g.match("?species", "a", "spe:Species"), order=order).where(F.col("ccdc") == F.lit(ccdc))


def nmr(g: Graph, name: str | None = None) -> DataFrame:
    found = joined(syntheses(g, name), g.bgp(("?synthesis", "syn:hasChemicalOutput", "?species"), ("?species", "spe:hasHNMRData", "?nmr")))
    found = optional(optional(found, g.match("?nmr", "spe:hasShifts", "?shifts")), g.match("?nmr", "spe:hasTemperature", "?temperature"))
    return optional(found, joined(g.match("?nmr", "spe:usesSolvent", "?s"), labelled(g, "s", "solvent")).drop("s")).drop("synthesis", "nmr")


# steps of the corpus


def washing(g: Graph) -> DataFrame:
    roles = {p: r for p, r in STEP_CHEMICAL_ROLES.items() if r.startswith("washing")}
    return joined(joined(steps(g), by_role(g, roles, "step", "chemical")), labelled(g, "chemical", "chemicalLabel")).select("synthesisLabel", "step", "role", "chemicalLabel")


def flagged(g: Graph, *predicates: str, kind: str | None = None) -> DataFrame:
    """Steps with one of the predicates true; true is the lexical form, whatever the datatype."""
    found = joined(steps(g), g.match("?step", list(predicates), "?flag").where("lower(flag) = 'true'"))
    return (joined(found, g.match("?step", "a", kind)) if kind else found).select("synthesisLabel", "step").distinct()


def filtrations(g: Graph) -> DataFrame:
    return optional(joined(steps(g), g.match("?step", "a", "syn:Filter")), g.match("?step", "syn:isVacuumFiltration", "?vacuum")).select("synthesisLabel", "step", "vacuum")


def acidity(g: Graph) -> DataFrame:
    return ordered(joined(steps(g), g.match("?step", "syn:hasTargetPh", "?ph")).select("ph", "synthesisLabel", "step"), ["ph"], numeric=True)


def repeated(g: Graph) -> DataFrame:
    """Repeated steps by both readings of the property: a flag, and a number of times."""
    found = joined(steps(g), g.match("?step", "syn:isRepeated", "?repeated"))
    return found.select("synthesisLabel", "step", (F.lower("repeated") == "true").alias("flag"), F.expr("try_cast(repeated AS int)").alias("times"))


def waiting(g: Graph) -> DataFrame:
    found = joined(steps(g), g.match("?step", "syn:isWait", "?wait").where("lower(wait) = 'true'"))
    spans = g.bgp(("?step", "syn:hasStepDuration", "?d"), ("?d", "om:hasNumericalValue", "?value"), ("?d", "om:hasUnit", "?unitIri"))
    return optional(found, spans.select("step", "value", local_name("unitIri").alias("unit"))).select("synthesisLabel", "step", "value", "unit")


def added_chemicals(g: Graph) -> DataFrame:
    return joined(joined(steps(g), g.match("?step", "syn:hasAddedChemicalInput", "?chemical")), labelled(g, "chemical", "chemicalLabel")).select("synthesisLabel", "step", "chemicalLabel")


def typical(g: Graph, predicate: str | list[str]) -> DataFrame:
    """How often each value and unit of a quantity occurs."""
    return quantity(g, steps(g), predicate).groupBy("value", "unit").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.expr("try_cast(value AS double)"), "unit")


def methods(g: Graph) -> DataFrame:
    """Names of characterisation methods in use."""
    roles = {"spe:hasHNMRData": "1H NMR", "spe:hasElementalAnalysisData": "Elemental analysis", "spe:hasInfraredSpectroscopyData": "IR spectroscopy"}
    return by_role(g, roles, "species", "data", "method").select("method").distinct().orderBy("method")


def product_formulas(g: Graph) -> DataFrame:
    """Outputs with formula and deposit number from the polyhedron that represents them or that they are."""
    outputs = g.match("?synthesis", "syn:hasChemicalOutput", "?output")
    mop = g.match("?output", "syn:isRepresentedBy", "?mop").unionByName(g.match("?mop", "a", "mop:MetalOrganicPolyhedron").select(F.col("mop").alias("output"), "mop"))
    known = optional(optional(mop, g.match("?mop", "mop:hasMOPFormula", "?formula")), g.match("?mop", "mop:hasCCDCNumber", "?ccdc"))
    return joined(syntheses(g), optional(outputs, known)).select("synthesisLabel", "formula", "ccdc").distinct()


def bridge(g: Graph) -> DataFrame:
    """Syntheses with the labelled polyhedron of their output where there is one that is no placeholder."""
    path = g.bgp(("?synthesis", "syn:hasChemicalOutput", "?_o"), ("?_o", "syn:isRepresentedBy", "?mop")).drop("_o")
    return optional(syntheses(g), joined(path, polyhedra(g, exclude_placeholders=True))).select("synthesisLabel", "mopLabel", "ccdc", "formula").distinct()


# labels


LABEL_KINDS = {
    "syntheses": lambda g: syntheses(g).select(F.col("synthesisLabel").alias("label")),
    "mops": lambda g: polyhedra(g).select(F.col("mopLabel").alias("label")),
    "chemicals": lambda g: g.bgp(("?_s", "syn:hasChemicalInput", "?_c"), ("?_c", LABEL, "?label")).select("label"),
    "ir_materials": lambda g: g.bgp(("?_i", "spe:usesMaterial", "?_m"), ("?_m", LABEL, "?label")).select("label"),
}


def label_index(g: Graph) -> DataFrame:
    """(kind, label): distinct trimmed labels for fuzzy lookup."""
    return either(*(f(g).select(F.lit(kind).alias("kind"), F.trim("label").alias("label")) for kind, f in LABEL_KINDS.items())).where("label <> ''").distinct()


#: Every query by name, as (graph, parameters) -> solutions.
NAMED: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f
    for f in (
        synthesis_iri, polyhedron_iri, polyhedron_by_deposit, all_polyhedra, polyhedra_by_unit_formula, building_units, statistics, common_chemicals, common_materials,
        common_nmr_solvents, suppliers, step_types, recipe, producing, step_list, step_index, temperatures, durations, temperature_rates, transferred_amounts, vessels, drying,
        evaporation, separation_solvents, step_parameters, equipment, documents, inheritance, yields, products, species, characterised, devices, characterisation_of_synthesis,
        characterisation_by_deposit, nmr, washing, flagged, filtrations, acidity, repeated, waiting, added_chemicals, typical, methods, product_formulas, bridge, label_index,
    )
}
