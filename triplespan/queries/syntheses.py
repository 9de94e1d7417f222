"""The catalog of named queries over a synthesis-shaped view of the tables: orders are syntheses, line items their steps,
parts chemicals, customers polyhedra and species. Conditions leave facts out, so that optional parts stay unbound in some
rows. The SQL asks relations that are written out from the tables, not triples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplespan.operators import documents, integration, named
from triplespan.queries.registry import register
from triplespan.sources.mapping import BASE, Entity, Given, MappedGraph, given

PREFIXES = {p: f"{BASE}{p}/" for p in ("syn", "mop", "spe", "om", "qudt")}
STEP_KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
STEP_KINDS = ("Add", "HeatChill", "Filter", "Dry", "Evaporate", "Separate", "Stir")


def some(condition: str, value: str) -> str:
    return f"CASE WHEN {condition} THEN {value} END"


def of_step(condition: str) -> Given:
    return given(condition, *STEP_KEY)


SYNTHESES = (
    Entity("orders", "syn/ChemicalSynthesis", ("o_orderkey",), {"label": "concat('Synthesis ', o_orderkey)"}, {
        "syn/hasChemicalOutput": ("syn/ChemicalOutput", ("o_orderkey",)),
        "syn/retrievedFrom": ("syn/Document", ("o_custkey",)),
        "syn/inheritsFromProcedure": ("syn/ChemicalSynthesis", given("o_orderpriority = '1-URGENT'", "o_custkey")),
        "syn/hasEquipment": ("syn/Equipment", given("o_orderstatus = 'P'", "o_custkey % 10")),
        "syn/hasYield": ("syn/Yield", given("o_orderstatus = 'O'", "o_orderkey")),
    }),
    Entity("orders", "syn/ChemicalSynthesis", ("o_orderkey",), {}, {"syn/hasChemicalOutput": ("spe/Species", given("o_orderstatus = 'F'", "o_custkey"))}, typed=False),
    Entity("lineitem", "syn/ChemicalSynthesis", ("l_orderkey",), {}, {"syn/hasSynthesisStep": ("syn/SynthesisStep", STEP_KEY), "syn/hasChemicalInput": ("syn/Chemical", ("l_partkey",))}, typed=False, unique=False),
    Entity("orders", "syn/Yield", ("o_orderkey",), {
        "om/hasNumericalValue": some("o_orderpriority < '3'", "cast(floor(o_totalprice) as bigint) % 100"),
        "qudt/numericValue": some("o_orderpriority < '4'", "cast(floor(o_totalprice) as bigint) % 90"),
        "label": some("o_orderpriority <> '3-MEDIUM'", "CASE WHEN o_orderpriority = '5-LOW' THEN ' n/a' ELSE concat('yield of ', o_orderkey) END"),
    }),
    Entity("orders", "syn/ChemicalOutput", ("o_orderkey",), {"label": "concat('output ', o_orderkey)"}, {"syn/isRepresentedBy": ("mop/MetalOrganicPolyhedron", given("o_orderpriority <> '2-HIGH'", "o_custkey"))}),
    Entity("customer", "mop/MetalOrganicPolyhedron", ("c_custkey",), {
        "label": "CASE WHEN c_acctbal < 0 THEN concat('MetalOrganicPolyhedron for ', c_name) ELSE c_name END",
        "mop/hasCCDCNumber": some("c_mktsegment <> 'BUILDING'", "c_custkey + 100000"),
        "mop/hasMOPFormula": some("c_nationkey < 20", "concat('[', c_mktsegment, ']', c_nationkey)"),
    }, {"mop/hasChemicalBuildingUnit": ("mop/ChemicalBuildingUnit", ("c_nationkey",))}),
    Entity("customer", "mop/MetalOrganicPolyhedron", ("c_custkey",), {}, {"mop/hasChemicalBuildingUnit": ("mop/ChemicalBuildingUnit", ("(c_nationkey + 7) % 25",))}, typed=False),
    Entity("nation", "mop/ChemicalBuildingUnit", ("n_nationkey",), {"label": some("n_nationkey <> 3", "n_name"), "mop/hasCBUFormula": some("n_nationkey <> 4", "concat('[C', n_nationkey, 'H', n_regionkey, ']')")}),
    Entity("customer", "spe/Species", ("c_custkey",), {"label": some("c_mktsegment <> 'MACHINERY'", "concat('species ', c_custkey)")}, {
        "spe/hasCharacterizationSession": ("spe/Session", given("c_acctbal > 2000", "c_custkey")),
        "spe/hasCCDCNumber": ("spe/CCDCNumber", given("c_acctbal > 0", "c_custkey")),
        "spe/hasMolecularFormula": ("spe/Formula", given("c_nationkey <> 6", "c_custkey")),
        "spe/hasInfraredSpectroscopyData": ("spe/IR", given("c_nationkey % 2 = 0", "c_custkey")),
        "spe/hasElementalAnalysisData": ("spe/EA", given("c_nationkey % 3 = 0", "c_custkey")),
        "spe/hasHNMRData": ("spe/NMR", given("c_nationkey % 5 = 0", "c_custkey")),
    }),
    Entity("customer", "spe/CCDCNumber", ("c_custkey",), {"spe/hasCCDCNumberValue": "c_custkey + 200000"}),
    Entity("customer", "spe/Formula", ("c_custkey",), {"spe/hasMolecularFormulaValue": some("c_acctbal > 3000", "concat('C', c_nationkey)"), "label": "concat('formula ', c_custkey)"}),
    Entity("customer", "spe/IR", ("c_custkey",), {"spe/hasBands": some("c_acctbal < 8000", "concat(1000 + c_nationkey, ', ', 2000 + c_nationkey)")}, {"spe/usesMaterial": ("spe/Material", ("c_nationkey % 4",))}),
    Entity("customer", "spe/IR", ("c_custkey",), {}, {"spe/usesMaterial": ("spe/Material", given("c_acctbal > 5000", "4 + c_nationkey % 3"))}, typed=False),
    Entity("nation", "spe/Material", ("n_nationkey",), {"label": "n_name"}),
    Entity("customer", "spe/EA", ("c_custkey",), {"spe/hasWeightPercentageCalculated": "concat('C ', c_nationkey)", "spe/hasWeightPercentageExperimental": some("c_acctbal > 0", "concat('C ', c_nationkey, '.1')")}),
    Entity("customer", "spe/NMR", ("c_custkey",), {"spe/hasShifts": "concat(c_nationkey, '.5')", "spe/hasTemperature": some("c_acctbal > 0", "'298 K'")}, {"spe/usesSolvent": ("spe/Material", given("c_acctbal < 6000", "c_nationkey"))}),
    Entity("customer", "spe/Session", ("c_custkey",), {}, {
        "spe/hasHNMRDevice": ("spe/Device", ("c_nationkey % 10",)),
        "spe/hasElementalAnalysisDevice": ("spe/Device", given("c_mktsegment = 'BUILDING'", "c_nationkey % 7")),
        "spe/hasInfraredSpectroscopyDevice": ("spe/Device", given("c_mktsegment = 'FURNITURE'", "c_nationkey % 8")),
    }),
    Entity("supplier", "spe/Device", ("s_suppkey",), {"label": "s_name", "spe/hasFrequency": some("s_nationkey < 12", "concat(s_nationkey * 100, ' MHz')")}),
    Entity("lineitem", "syn/SynthesisStep", STEP_KEY, {
        "label": some("l_tax < 0.08", "concat(l_returnflag, l_linestatus, ' ', l_linenumber)"),
        "syn/hasOrder": some("l_tax > 0", "l_linenumber"),
        "syn/isLayered": "CASE WHEN l_discount > 0.05 THEN 'True' ELSE 'false' END",
        "syn/isStirred": some("l_returnflag = 'A'", "'true'"),
        "syn/isSealed": some("l_returnflag = 'R'", "'true'"),
        "syn/isWait": "CASE WHEN l_discount < 0.03 THEN 'true' ELSE 'false' END",
        "syn/isRepeated": "CASE WHEN l_linestatus = 'F' THEN 'true' ELSE cast(l_linenumber as string) END",
        "syn/isVacuumFiltration": some("l_linestatus = 'O'", "'true'"),
        "syn/hasTargetPh": some("l_discount = 0.07", "l_quantity"),
        "syn/hasParameter": some("l_discount = 0.02", "concat('p', l_linenumber)"),
    }, {
        "syn/hasTargetTemperature": ("syn/Temperature", of_step("l_returnflag = 'A'")),
        "syn/hasCrystallizationTargetTemperature": ("syn/Temperature", of_step("l_returnflag = 'R'")),
        "syn/hasStepDuration": ("syn/Duration", of_step("l_linestatus = 'F'")),
        "syn/hasTemperatureRate": ("syn/Temperature", of_step("l_discount = 0.01")),
        "syn/hasTransferredAmount": ("syn/Duration", of_step("l_discount = 0.04")),
        "syn/hasVessel": ("syn/Vessel", given("l_linenumber <> 7", "l_suppkey")),
        "syn/hasVesselEnvironment": ("syn/Environment", given("l_linestatus = 'O'", "l_linenumber")),
        "syn/hasEquipment": ("syn/Equipment", given("l_discount = 0.06", "l_linenumber")),
        "syn/hasDryingTemperature": ("syn/Label", given("l_tax < 0.05", "l_linenumber")),
        "syn/hasDryingPressure": ("syn/Label", given("l_tax > 0.02", "l_linenumber + 1")),
        "syn/hasDryingAgent": ("syn/Label", given("l_discount > 0.05", "l_linenumber + 2")),
        "syn/hasEvaporationTemperature": ("syn/Label", given("l_tax < 0.06", "l_linenumber")),
        "syn/hasEvaporationPressure": ("syn/Label", given("l_discount < 0.05", "l_linenumber + 1")),
        "syn/hasTargetVolume": ("syn/Label", given("l_tax > 0.04", "l_linenumber + 3")),
        "syn/removesSpecies": ("syn/Label", given("l_discount > 0.02", "l_linenumber + 4")),
        "syn/hasSeparationSolvent": ("syn/Label", given("l_tax < 0.07", "l_linenumber")),
        "syn/hasAddedChemicalInput": ("syn/Chemical", given("l_linenumber = 1", "l_partkey")),
        "syn/hasSolventDissolve": ("syn/Chemical", given("l_linenumber = 2", "l_partkey")),
        "syn/hasWashingSolvent": ("syn/Chemical", given("l_linenumber = 3", "l_partkey")),
        "syn/hasWashingChemical": ("syn/Chemical", given("l_linenumber = 4 and l_tax > 0.03", "l_partkey")),
    }, classes={f"syn/{kind}": f"l_linenumber = {k + 1}" for k, kind in enumerate(STEP_KINDS)}),
    Entity("lineitem", "syn/Temperature", STEP_KEY, {"om/hasNumericalValue": some("l_tax <> 0.01", "l_quantity")}, {"om/hasUnit": ("om", given("l_linestatus = 'O'", "'degreeCelsius'"))}),
    Entity("lineitem", "syn/Duration", STEP_KEY, {"om/hasNumericalValue": some("l_tax <> 0.02", "l_linenumber")}, {"om/hasUnit": ("om", given("l_tax <> 0.03", "'hour'"))}),
    Entity("supplier", "syn/Vessel", ("s_suppkey",), {"label": some("s_acctbal > 1000", "s_name")}, {"syn/hasVesselType": ("syn/VesselType", given("s_acctbal > 3000", "s_nationkey % 6"))}),
    Entity("region", "syn/VesselType", ("r_regionkey",), {"label": "r_name"}),
    Entity("nation", "syn/Environment", ("n_nationkey",), {"label": "concat('env ', n_name)"}),
    Entity("nation", "syn/Equipment", ("n_nationkey",), {"label": some("n_nationkey <> 5", "concat('equipment ', n_name)")}),
    Entity("nation", "syn/Label", ("n_nationkey",), {"label": some("n_nationkey <> 4", "concat('label ', n_nationkey)")}),
    Entity("customer", "syn/Document", ("c_custkey",), {"label": some("c_acctbal > 0", "concat('doc ', c_custkey)")}),
    Entity("part", "syn/Chemical", ("p_partkey",), {
        "label": some("p_size <> 7", "p_name"), "syn/hasAmount": some("p_size > 10", "concat(p_size, ' g')"), "syn/hasChemicalFormula": some("p_size < 40", "p_type"), "syn/hasPurity": some("p_size % 2 = 0", "'99%'"),
    }, {"syn/isSuppliedBy": ("syn/Supplier", given("p_size % 3 = 0", "p_partkey % 50"))}),
    Entity("supplier", "syn/Supplier", ("s_suppkey",), {"label": "s_name"}),
)

#: The same facts as relations.
FACTS = f"""WITH syn AS (SELECT *, '{BASE}syn/ChemicalSynthesis/' || o_orderkey AS iri, 'Synthesis ' || o_orderkey AS label FROM orders),
step AS (SELECT *, '{BASE}syn/SynthesisStep/' || l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS step, 'Synthesis ' || l_orderkey AS synthesis,
    CASE WHEN l_tax < 0.08 THEN l_returnflag || l_linestatus || ' ' || l_linenumber END AS label, ['Add', 'HeatChill', 'Filter', 'Dry', 'Evaporate', 'Separate', 'Stir'][l_linenumber] AS kind,
    CASE WHEN l_tax <> 0.01 THEN CAST(l_quantity AS VARCHAR) END AS t_value, CASE WHEN l_linestatus = 'O' THEN 'degreeCelsius' END AS t_unit,
    CASE WHEN l_tax <> 0.02 THEN CAST(l_linenumber AS VARCHAR) END AS d_value, CASE WHEN l_tax <> 0.03 THEN 'hour' END AS d_unit
    FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
mop AS (SELECT c_custkey AS id, '{BASE}mop/MetalOrganicPolyhedron/' || c_custkey AS mop, CASE WHEN c_acctbal < 0 THEN 'MetalOrganicPolyhedron for ' || c_name ELSE c_name END AS label,
    CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(c_custkey + 100000 AS VARCHAR) END AS ccdc, CASE WHEN c_nationkey < 20 THEN '[' || c_mktsegment || ']' || c_nationkey END AS formula, c_nationkey FROM customer),
cbu AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey <> 3 THEN n_name END AS label, CASE WHEN n_nationkey <> 4 THEN '[C' || n_nationkey || 'H' || n_regionkey || ']' END AS formula FROM nation),
unit AS (SELECT mop.*, c_nationkey AS u FROM mop UNION ALL SELECT mop.*, (c_nationkey + 7) % 25 FROM mop),
species AS (SELECT c.*, CASE WHEN c_mktsegment <> 'MACHINERY' THEN 'species ' || c_custkey END AS label, CASE WHEN c_acctbal > 0 THEN CAST(c_custkey + 200000 AS VARCHAR) END AS ccdc,
    CASE WHEN c_nationkey <> 6 THEN CASE WHEN c_acctbal > 3000 THEN 'C' || c_nationkey ELSE 'formula ' || c_custkey END END AS formula FROM customer c),
material AS (SELECT c_custkey, c_nationkey % 4 AS m FROM customer UNION ALL SELECT c_custkey, 4 + c_nationkey % 3 FROM customer WHERE c_acctbal > 5000),
chemical AS (SELECT *, '{BASE}syn/Chemical/' || p_partkey AS chemical, CASE WHEN p_size <> 7 THEN p_name END AS label, CASE WHEN p_size > 10 THEN p_size || ' g' END AS amount,
    CASE WHEN p_size < 40 THEN p_type END AS formula, CASE WHEN p_size % 2 = 0 THEN '99%' END AS purity, CASE WHEN p_size % 3 = 0 THEN s_name END AS supplier FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 50),
input AS (SELECT DISTINCT l_orderkey, 'Synthesis ' || l_orderkey AS synthesis, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
role AS (SELECT step, synthesis, label AS step_label, l_partkey, unnest(CASE WHEN l_linenumber = 1 THEN ['added'] WHEN l_linenumber = 2 THEN ['solvent'] WHEN l_linenumber = 3 THEN ['washing_solvent']
    WHEN l_linenumber = 4 AND l_tax > 0.03 THEN ['washing_chemical'] ELSE [] END) AS role FROM step),
named AS (SELECT n_nationkey AS id, n_name AS label FROM nation),
short AS (SELECT n_nationkey AS id, 'label ' || n_nationkey AS label FROM nation WHERE n_nationkey <> 4)
"""  # noqa: S608


def view(spark, folder: str) -> MappedGraph:
    return MappedGraph(spark, folder, SYNTHESES, PREFIXES)


def _register(name: str, query: Callable[[MappedGraph], DataFrame], sql: str) -> None:
    register(f"named_{name}", lambda spark, folder: query(view(spark, folder)), FACTS + sql)


TEMPERATURE = """SELECT synthesis AS "synthesisLabel", label AS "stepLabel", k AS "temperatureKind", t_value AS value, t_unit AS unit
FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'target' WHEN 'R' THEN 'crystallization' END AS k FROM step) WHERE t_value IS NOT NULL AND k """
OUTPUT = "CASE WHEN o_orderpriority <> '2-HIGH' THEN o_custkey END"
CHARACTERISED = """sp.label AS "speciesLabel", sp.ccdc, sp.formula, CASE WHEN c_nationkey % 2 = 0 AND c_acctbal < 8000 THEN (1000 + c_nationkey) || ', ' || (2000 + c_nationkey) END AS bands, m.label AS material,
CASE WHEN c_nationkey % 3 = 0 THEN 'C ' || c_nationkey END AS calculated, CASE WHEN c_nationkey % 3 = 0 AND c_acctbal > 0 THEN 'C ' || c_nationkey || '.1' END AS experimental,
'{0}spe/Species/' || sp.c_custkey AS species FROM species sp LEFT JOIN material x ON x.c_custkey = sp.c_custkey AND c_nationkey % 2 = 0 LEFT JOIN named m ON m.id = x.m""".format(BASE)

for _name, _query, _sql in (
    ("synthesis_iri", lambda g: named.synthesis_iri(g, "Synthesis 77"), "SELECT iri AS synthesis FROM syn WHERE label = 'Synthesis 77'"),
    ("polyhedron_iri", lambda g: named.polyhedron_iri(g, "Customer#000000007"), "SELECT mop, ccdc FROM mop WHERE label = 'Customer#000000007'"),
    ("polyhedron_by_deposit", lambda g: named.polyhedron_by_deposit(g, "100007"), 'SELECT mop, label AS "mopLabel", formula FROM mop WHERE ccdc = \'100007\''),
    ("all_polyhedra", lambda g: named.all_polyhedra(g, None), 'SELECT DISTINCT label AS "mopLabel", ccdc, formula FROM mop'),
    ("polyhedra_limit", named.all_polyhedra, 'SELECT DISTINCT label AS "mopLabel", ccdc, formula FROM mop ORDER BY 1, 2 NULLS FIRST, 3 NULLS FIRST LIMIT 100'),
    ("polyhedra_without_placeholders", lambda g: named.all_polyhedra(g, None, True), 'SELECT DISTINCT label AS "mopLabel", ccdc, formula FROM mop WHERE NOT starts_with(label, \'MetalOrganicPolyhedron for\')'),
    ("count_polyhedra", lambda g: named.polyhedra(g, True).agg(F.count_distinct("mop").alias("n")), "SELECT count(DISTINCT mop) AS n FROM mop WHERE NOT starts_with(label, 'MetalOrganicPolyhedron for')"),
    ("polyhedra_by_unit_formula", lambda g: named.polyhedra_by_unit_formula(g, "c1", None), 'SELECT DISTINCT unit.label AS "mopLabel", ccdc, cbu.formula AS "cbuFormula" FROM unit JOIN cbu ON u = cbu.id WHERE contains(lower(cbu.formula), \'c1\')'),
    ("building_units", named.building_units, f"""SELECT mop, unit.label AS "mopLabel", ccdc, '{BASE}mop/ChemicalBuildingUnit/' || u AS cbu, cbu.label AS "cbuLabel", cbu.formula AS "cbuFormula" FROM unit LEFT JOIN cbu ON u = cbu.id"""),
    ("statistics", named.statistics, 'SELECT (SELECT count(*) FROM mop) AS n_mop, (SELECT count(*) FROM syn) AS n_synthesis, (SELECT count(DISTINCT (l_orderkey, l_partkey, l_suppkey, l_linenumber)) FROM lineitem) AS n_step, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS n_chemical'),
    ("common_chemicals", lambda g: named.common_chemicals(g, None), "SELECT label, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN chemical ON p_partkey = l_partkey WHERE label IS NOT NULL GROUP BY label"),
    ("common_chemicals_top", named.common_chemicals, "SELECT label, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN chemical ON p_partkey = l_partkey WHERE label IS NOT NULL GROUP BY label ORDER BY n DESC, label LIMIT 20"),
    ("common_materials", lambda g: named.common_materials(g, None), "SELECT m.label AS material, count(DISTINCT s.c_custkey) AS n FROM species s JOIN material x USING (c_custkey) JOIN named m ON m.id = x.m WHERE c_nationkey % 2 = 0 GROUP BY m.label"),
    ("common_nmr_solvents", lambda g: named.common_nmr_solvents(g, None), "SELECT m.label AS solvent, count(DISTINCT c_custkey) AS n FROM species JOIN named m ON m.id = c_nationkey WHERE c_nationkey % 5 = 0 AND c_acctbal < 6000 GROUP BY m.label"),
    ("suppliers", named.suppliers, "SELECT supplier, count(*) AS n FROM chemical WHERE supplier IS NOT NULL GROUP BY supplier"),
    ("step_types", named.step_types, "SELECT kind AS type, count(*) AS n FROM (SELECT ['Add', 'HeatChill', 'Filter', 'Dry', 'Evaporate', 'Separate', 'Stir'][l_linenumber] AS kind FROM lineitem UNION ALL SELECT 'SynthesisStep' FROM lineitem) GROUP BY kind"),
    ("recipe", named.recipe, """SELECT DISTINCT synthesis AS "synthesisLabel", role, c.label AS "chemicalLabel", amount, formula, purity, supplier, step_label AS "stepLabel"
FROM (SELECT synthesis, role, step_label, l_partkey FROM role UNION ALL SELECT synthesis, 'synthesis_input', NULL, l_partkey FROM input) LEFT JOIN chemical c ON p_partkey = l_partkey"""),
    ("producing", lambda g: named.producing(g, "Customer#000000007"), f"SELECT iri AS synthesis, syn.label AS \"synthesisLabel\" FROM syn JOIN mop ON mop.id = {OUTPUT} WHERE mop.label = 'Customer#000000007'"),
    ("step_list", named.step_list, """SELECT DISTINCT synthesis AS "synthesisLabel", label AS "stepLabel", unnest([kind, 'SynthesisStep']) AS type FROM step WHERE label IS NOT NULL"""),
    ("step_index", named.step_index, f"""SELECT '{BASE}syn/ChemicalSynthesis/' || l_orderkey AS synthesis, synthesis AS "synthesisLabel", step, label AS "stepLabel", CASE WHEN l_tax > 0 THEN CAST(l_linenumber AS VARCHAR) END AS position, unnest([kind, 'SynthesisStep']) AS type FROM step"""),
    ("temperatures", named.temperatures, TEMPERATURE + "IS NOT NULL"),
    ("target_temperatures", lambda g: named.temperatures(g, None, "target", "desc"), TEMPERATURE + "= 'target'"),
    ("crystallization_temperatures", lambda g: named.temperatures(g, None, "crystallization", "none"), TEMPERATURE + "= 'crystallization'"),
    ("durations", named.durations, 'SELECT synthesis AS "synthesisLabel", label AS "stepLabel", d_value AS value, d_unit AS unit FROM step WHERE l_linestatus = \'F\' AND d_value IS NOT NULL'),
    ("temperature_rates", named.temperature_rates, 'SELECT synthesis AS "synthesisLabel", step, t_value AS value, t_unit AS unit FROM step WHERE l_discount = 0.01 AND t_value IS NOT NULL'),
    ("transferred_amounts", named.transferred_amounts, 'SELECT synthesis AS "synthesisLabel", step, d_value AS value, d_unit AS unit FROM step WHERE l_discount = 0.04'),
    ("vessels", named.vessels, f"""SELECT synthesis AS "synthesisLabel", step, '{BASE}syn/Vessel/' || l_suppkey AS vessel, CASE WHEN s_acctbal > 1000 THEN s_name END AS "vesselLabel",
CASE WHEN s_acctbal > 3000 THEN '{BASE}syn/VesselType/' || (s_nationkey % 6) END AS "vesselType", r_name AS "vesselTypeLabel", CASE WHEN l_linestatus = 'O' THEN 'env ' || e.label END AS environment
FROM step LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN region ON r_regionkey = s_nationkey % 6 AND s_acctbal > 3000 LEFT JOIN named e ON e.id = l_linenumber WHERE l_linenumber <> 7"""),
    ("vessel_environments", lambda g: named.joined(named.steps(g), named.environments(g)).select("synthesisLabel", "step", "environment"), """SELECT synthesis AS "synthesisLabel", step, 'env ' || e.label AS environment FROM step JOIN named e ON e.id = l_linenumber WHERE l_linestatus = 'O'"""),
    ("environment_usage", lambda g: named.joined(named.steps(g), named.environments(g)).groupBy("environment").agg(F.count("*").alias("n")), "SELECT 'env ' || e.label AS environment, count(*) AS n FROM step JOIN named e ON e.id = l_linenumber WHERE l_linestatus = 'O' GROUP BY ALL"),
    ("drying", named.drying, """SELECT synthesis AS "synthesisLabel", step, t.label AS temperature, p.label AS pressure, a.label AS agent FROM step LEFT JOIN short t ON t.id = l_linenumber AND l_tax < 0.05
LEFT JOIN short p ON p.id = l_linenumber + 1 AND l_tax > 0.02 LEFT JOIN short a ON a.id = l_linenumber + 2 AND l_discount > 0.05 WHERE kind = 'Dry'"""),
    ("evaporation", named.evaporation, """SELECT synthesis AS "synthesisLabel", step, t.label AS temperature, p.label AS pressure, v.label AS volume, r.label AS removed FROM step LEFT JOIN short t ON t.id = l_linenumber AND l_tax < 0.06
LEFT JOIN short p ON p.id = l_linenumber + 1 AND l_discount < 0.05 LEFT JOIN short v ON v.id = l_linenumber + 3 AND l_tax > 0.04 LEFT JOIN short r ON r.id = l_linenumber + 4 AND l_discount > 0.02 WHERE kind = 'Evaporate'"""),
    ("separation_solvents", named.separation_solvents, 'SELECT synthesis AS "synthesisLabel", step, s.label AS solvent FROM step JOIN short s ON s.id = l_linenumber WHERE kind = \'Separate\' AND l_tax < 0.07'),
    ("step_parameters", named.step_parameters, 'SELECT synthesis AS "synthesisLabel", step, \'p\' || l_linenumber AS parameter FROM step WHERE l_discount = 0.02'),
    ("equipment", named.equipment, """SELECT DISTINCT label_ AS "synthesisLabel", scope, step, 'equipment ' || n.label AS "equipmentLabel" FROM (SELECT label AS label_, 'synthesis' AS scope, NULL AS step, o_custkey % 10 AS e FROM syn WHERE o_orderstatus = 'P'
UNION ALL SELECT synthesis, 'step', step, l_linenumber FROM step WHERE l_discount = 0.06) JOIN named n ON n.id = e WHERE e <> 5"""),
    ("documents", named.documents, f"""SELECT iri AS synthesis, label AS "synthesisLabel", '{BASE}syn/Document/' || o_custkey AS document, CASE WHEN c_acctbal > 0 THEN 'doc ' || c_custkey END AS "documentLabel" FROM syn LEFT JOIN customer ON c_custkey = o_custkey"""),
    ("inheritance", named.inheritance, f"""SELECT s.iri AS synthesis, s.label AS "synthesisLabel", direction, '{BASE}syn/ChemicalSynthesis/' || other AS other, o.label AS "otherLabel"
FROM (SELECT o_orderkey AS id, o_custkey AS other, 'inherits_from' AS direction FROM syn WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_custkey, o_orderkey, 'inherited_by' FROM syn WHERE o_orderpriority = '1-URGENT')
JOIN syn s ON s.o_orderkey = id LEFT JOIN syn o ON o.o_orderkey = other"""),
    ("yields", named.yields, f"""SELECT label AS "synthesisLabel", '{BASE}syn/Yield/' || o_orderkey AS yield, CAST(CASE WHEN o_orderpriority < '3' THEN CAST(floor(o_totalprice) AS BIGINT) % 100 ELSE CAST(floor(o_totalprice) AS BIGINT) % 90 END AS VARCHAR) AS value,
CASE WHEN o_orderpriority <> '3-MEDIUM' THEN 'yield of ' || o_orderkey END AS "yieldLabel" FROM syn WHERE o_orderstatus = 'O' AND o_orderpriority < '4'
UNION ALL SELECT label, '{BASE}syn/Yield/' || o_orderkey, NULL, 'yield of ' || o_orderkey FROM syn WHERE o_orderstatus = 'O' AND o_orderpriority = '4-NOT SPECIFIED'"""),
    ("products", named.products, f'SELECT syn.label AS "synthesisLabel", mop.label AS "mopLabel", ccdc, formula FROM syn JOIN mop ON mop.id = {OUTPUT}'),
    ("species", lambda g: named.species(g, None), f"""SELECT '{BASE}spe/Species/' || c_custkey AS species, label AS "speciesLabel" FROM species WHERE label IS NOT NULL AND c_acctbal > 2000"""),
    ("species_top", lambda g: named.species(g, 10, "desc"), f"""SELECT '{BASE}spe/Species/' || c_custkey AS species, label AS "speciesLabel" FROM species WHERE label IS NOT NULL AND c_acctbal > 2000 ORDER BY label DESC LIMIT 10"""),
    ("characterised", lambda g: named.characterised(g, None), 'SELECT DISTINCT syn.label AS "synthesisLabel" FROM syn JOIN species ON c_custkey = o_custkey WHERE o_orderstatus = \'F\' AND c_acctbal > 2000'),
    ("devices", lambda g: named.devices(g, None), """SELECT DISTINCT k AS "deviceType", s_name AS "deviceLabel", CASE WHEN k = 'HNMR' AND s_nationkey < 12 THEN (s_nationkey * 100) || ' MHz' END AS frequency FROM (SELECT 'HNMR' AS k, c_nationkey % 10 AS d FROM customer
UNION ALL SELECT 'ElementalAnalysis', c_nationkey % 7 FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'InfraredSpectroscopy', c_nationkey % 8 FROM customer WHERE c_mktsegment = 'FURNITURE') JOIN supplier ON s_suppkey = d"""),
    ("characterisation", named.characterisation_of_synthesis, 'SELECT DISTINCT syn.label AS "synthesisLabel", x.* EXCLUDE (id) FROM syn JOIN (SELECT sp.c_custkey AS id, ' + CHARACTERISED + ") x ON x.id = o_custkey WHERE o_orderstatus = 'F'"),
    ("characterisation_by_deposit", lambda g: named.characterisation_by_deposit(g, "200007"), "SELECT DISTINCT " + CHARACTERISED + " WHERE sp.ccdc = '200007'"),
    ("nmr", named.nmr, f"""SELECT syn.label AS "synthesisLabel", '{BASE}spe/Species/' || c_custkey AS species, c_nationkey || '.5' AS shifts, CASE WHEN c_acctbal > 0 THEN '298 K' END AS temperature, m.label AS solvent
FROM syn JOIN species ON c_custkey = o_custkey LEFT JOIN named m ON m.id = c_nationkey AND c_acctbal < 6000 WHERE o_orderstatus = 'F' AND c_nationkey % 5 = 0"""),
    ("washing", named.washing, 'SELECT synthesis AS "synthesisLabel", step, role, c.label AS "chemicalLabel" FROM role JOIN chemical c ON p_partkey = l_partkey WHERE starts_with(role, \'washing\') AND c.label IS NOT NULL'),
    ("layered", lambda g: named.flagged(g, "syn:isLayered"), 'SELECT synthesis AS "synthesisLabel", step FROM step WHERE l_discount > 0.05'),
    ("stirred_sealed", lambda g: named.flagged(g, "syn:isStirred", "syn:isSealed", kind="syn:Add"), 'SELECT synthesis AS "synthesisLabel", step FROM step WHERE l_returnflag IN (\'A\', \'R\') AND kind = \'Add\''),
    ("filtrations", named.filtrations, "SELECT synthesis AS \"synthesisLabel\", step, CASE WHEN l_linestatus = 'O' THEN 'true' END AS vacuum FROM step WHERE kind = 'Filter'"),
    ("acidity", named.acidity, 'SELECT CAST(l_quantity AS VARCHAR) AS ph, synthesis AS "synthesisLabel", step FROM step WHERE l_discount = 0.07'),
    ("repeated", named.repeated, 'SELECT synthesis AS "synthesisLabel", step, l_linestatus = \'F\' AS flag, CASE WHEN l_linestatus <> \'F\' THEN l_linenumber END AS times FROM step'),
    ("waiting", named.waiting, """SELECT synthesis AS "synthesisLabel", step, CASE WHEN ok THEN d_value END AS value, CASE WHEN ok THEN d_unit END AS unit FROM (SELECT *, l_linestatus = 'F' AND d_value IS NOT NULL AND d_unit IS NOT NULL AS ok FROM step) WHERE l_discount < 0.03"""),
    ("added_chemicals", named.added_chemicals, 'SELECT synthesis AS "synthesisLabel", step, c.label AS "chemicalLabel" FROM role JOIN chemical c ON p_partkey = l_partkey WHERE role = \'added\' AND c.label IS NOT NULL'),
    ("typical_durations", lambda g: named.typical(g, "syn:hasStepDuration"), "SELECT d_value AS value, d_unit AS unit, count(*) AS n FROM step WHERE l_linestatus = 'F' AND d_value IS NOT NULL GROUP BY ALL"),
    ("typical_temperatures", lambda g: named.typical(g, list(named.TEMPERATURES)), "SELECT t_value AS value, t_unit AS unit, count(*) AS n FROM step WHERE l_returnflag IN ('A', 'R') AND t_value IS NOT NULL GROUP BY ALL"),
    ("methods", named.methods, "SELECT unnest(['1H NMR', 'Elemental analysis', 'IR spectroscopy']) AS method"),
    ("product_formulas", named.product_formulas, f'SELECT DISTINCT syn.label AS "synthesisLabel", formula, ccdc FROM syn LEFT JOIN mop ON mop.id = {OUTPUT} UNION SELECT label, NULL, NULL FROM syn WHERE o_orderstatus = \'F\''),
    ("bridge", named.bridge, f"""SELECT DISTINCT syn.label AS "synthesisLabel", m.label AS "mopLabel", ccdc, formula FROM syn LEFT JOIN (SELECT * FROM mop WHERE NOT starts_with(label, 'MetalOrganicPolyhedron for')) m ON m.id = {OUTPUT}"""),
    ("label_index", named.label_index, "SELECT 'syntheses' AS kind, label FROM syn UNION SELECT 'mops', label FROM mop UNION SELECT 'chemicals', c.label FROM input JOIN chemical c ON p_partkey = l_partkey WHERE c.label IS NOT NULL UNION SELECT 'ir_materials', m.label FROM material x JOIN named m ON m.id = x.m"),
):
    _register(_name, _query, _sql)


# nested documents, their arrays written as texts


def _listed(df: DataFrame, *arrays: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, "|") for c in arrays})


NODE = "CAST(l_orderkey AS VARCHAR) || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber"
HOT = f"CASE WHEN t_value IS NULL THEN {NODE} ELSE concat_ws(' ', t_value, t_unit) END"
LONG = f"CASE WHEN d_value IS NULL THEN {NODE} ELSE concat_ws(' ', d_value, d_unit) END"
MADE = f"""o AS (SELECT iri AS synthesis, 'output ' || o_orderkey AS name, coalesce(m.formula, 'N/A') AS formula, 'N/A' AS yield, coalesce(m.ccdc, 'N/A') AS ccdc FROM syn LEFT JOIN mop m ON m.id = {OUTPUT}
UNION ALL SELECT iri, coalesce(sp.label, CAST(c_custkey AS VARCHAR)), 'N/A', 'N/A', coalesce(sp.ccdc, 'N/A') FROM syn JOIN species sp ON c_custkey = o_custkey WHERE o_orderstatus = 'F'),
made AS (SELECT * FROM o WHERE ccdc <> 'N/A' OR synthesis NOT IN (SELECT synthesis FROM o WHERE ccdc <> 'N/A'))"""

#: Every property of a step: its name and its text, which is the label of a node that has one.
DUMP = f""", x AS (SELECT s.*, {NODE} AS node, coalesce(CASE WHEN u.s_acctbal > 1000 THEN u.s_name END, '{BASE}syn/Vessel/' || l_suppkey) AS vessel, 'env ' || n.label AS environment, CASE WHEN l_linenumber = 5 THEN '{BASE}syn/Equipment/5' ELSE 'equipment ' || n.label END AS equipment,
    coalesce(c.label, '{BASE}syn/Chemical/' || l_partkey) AS made FROM step s LEFT JOIN supplier u ON u.s_suppkey = l_suppkey LEFT JOIN named n ON n.id = l_linenumber LEFT JOIN chemical c ON p_partkey = l_partkey)
SELECT step, string_agg(field || '=' || texts, ';' ORDER BY field) AS fields FROM x, LATERAL (VALUES ('label', label), ('hasOrder', CASE WHEN l_tax > 0 THEN CAST(l_linenumber AS VARCHAR) END), ('isLayered', CASE WHEN l_discount > 0.05 THEN 'True' ELSE 'false' END), ('isStirred', CASE WHEN l_returnflag = 'A' THEN 'true' END),
('isSealed', CASE WHEN l_returnflag = 'R' THEN 'true' END), ('isWait', CASE WHEN l_discount < 0.03 THEN 'true' ELSE 'false' END), ('isRepeated', CASE WHEN l_linestatus = 'F' THEN 'true' ELSE CAST(l_linenumber AS VARCHAR) END), ('isVacuumFiltration', CASE WHEN l_linestatus = 'O' THEN 'true' END),
('hasTargetPh', CASE WHEN l_discount = 0.07 THEN CAST(l_quantity AS VARCHAR) END), ('hasParameter', CASE WHEN l_discount = 0.02 THEN 'p' || l_linenumber END), ('hasTargetTemperature', CASE WHEN l_returnflag = 'A' THEN '{BASE}syn/Temperature/' || node END),
('hasCrystallizationTargetTemperature', CASE WHEN l_returnflag = 'R' THEN '{BASE}syn/Temperature/' || node END), ('hasStepDuration', CASE WHEN l_linestatus = 'F' THEN '{BASE}syn/Duration/' || node END), ('hasTemperatureRate', CASE WHEN l_discount = 0.01 THEN '{BASE}syn/Temperature/' || node END),
('hasTransferredAmount', CASE WHEN l_discount = 0.04 THEN '{BASE}syn/Duration/' || node END), ('hasVessel', CASE WHEN l_linenumber <> 7 THEN vessel END), ('hasVesselEnvironment', CASE WHEN l_linestatus = 'O' THEN environment END), ('hasEquipment', CASE WHEN l_discount = 0.06 THEN equipment END),
{", ".join(f"('{p}', CASE WHEN {c} THEN CASE WHEN l_linenumber + {k} = 4 THEN '{BASE}syn/Label/4' ELSE 'label ' || (l_linenumber + {k}) END END)" for p, c, k in (("hasDryingTemperature", "l_tax < 0.05", 0), ("hasDryingPressure", "l_tax > 0.02", 1), ("hasDryingAgent", "l_discount > 0.05", 2), ("hasEvaporationTemperature", "l_tax < 0.06", 0), ("hasEvaporationPressure", "l_discount < 0.05", 1), ("hasTargetVolume", "l_tax > 0.04", 3), ("removesSpecies", "l_discount > 0.02", 4), ("hasSeparationSolvent", "l_tax < 0.07", 0)))},
{", ".join(f"('{p}', CASE WHEN {c} THEN made END)" for p, c in (("hasAddedChemicalInput", "l_linenumber = 1"), ("hasSolventDissolve", "l_linenumber = 2"), ("hasWashingSolvent", "l_linenumber = 3"), ("hasWashingChemical", "l_linenumber = 4 AND l_tax > 0.03")))}) v(field, texts) WHERE texts IS NOT NULL GROUP BY step"""
STEPS = f"""f AS (SELECT '{BASE}syn/ChemicalSynthesis/' || l_orderkey AS synthesis, step, kind, CASE WHEN l_tax > 0 THEN l_linenumber ELSE 0 END AS nr, CASE WHEN l_linenumber <> 7 THEN CASE WHEN u.s_acctbal > 1000 THEN u.s_name ELSE CAST(l_suppkey AS VARCHAR) END ELSE 'N/A' END AS vessel,
    coalesce(CASE WHEN l_linenumber <> 7 THEN r_name END, 'N/A') AS vessel_type, coalesce(CASE WHEN l_linestatus = 'O' THEN 'env ' || e.label END, 'N/A') AS air, CASE WHEN l_discount = 0.07 THEN CAST(trunc(l_quantity) AS INT) ELSE -1 END AS ph, CASE WHEN l_linestatus = 'F' THEN {LONG} ELSE 'N/A' END AS lasts,
    CASE WHEN l_returnflag IN ('A', 'R') THEN {HOT} ELSE 'N/A' END AS hot, CASE WHEN l_returnflag = 'A' THEN {HOT} ELSE 'N/A' END AS target, CASE WHEN l_discount = 0.01 THEN {HOT} ELSE 'N/A' END AS rate, l_returnflag = 'A' AS stir, l_returnflag = 'R' AS sealed, l_discount > 0.05 AS layered,
    l_linestatus = 'O' AS vacuum, l_discount < 0.03 AS waits, CASE WHEN l_linestatus = 'F' THEN 1 ELSE l_linenumber END AS times, [{{'chemicalName': [coalesce(c.label, 'Unknown')], 'chemicalAmount': coalesce(amount, 'N/A'), 'chemicalFormula': coalesce(c.formula, 'N/A'), 'purity': coalesce(purity, 'N/A'), 'supplierName': coalesce(c.supplier, 'N/A')}}] AS chemical
    FROM step LEFT JOIN supplier u ON u.s_suppkey = l_suppkey LEFT JOIN region ON r_regionkey = u.s_nationkey % 6 AND u.s_acctbal > 3000 LEFT JOIN named e ON e.id = l_linenumber LEFT JOIN chemical c ON p_partkey = l_partkey),
j AS (SELECT f.*, {{'usedVesselName': vessel, 'usedVesselType': vessel_type, 'stepNumber': nr, 'atmosphere': air, 'targetPH': ph, 'comment': 'N/A'}} AS shared FROM f),
p AS (SELECT synthesis, string_agg(name, '|' ORDER BY name) AS names, coalesce(min(CASE WHEN ccdc <> 'N/A' THEN left(ccdc, -1) || ' ' || right(ccdc, 1) END), 'N/A') AS ccdc FROM (SELECT DISTINCT synthesis, name, ccdc FROM made) GROUP BY 1)
SELECT j.synthesis, 'Synthesis ' || split_part(j.synthesis, '/', 6) AS "procedureName", names AS "productNames", ccdc AS "productCCDCNumber", nr AS "stepNumber", step, kind AS type, CAST(CASE kind WHEN 'Add' THEN to_json(struct_insert(shared, duration := lasts, "addedChemical" := chemical, stir := stir, "isLayered" := layered))
WHEN 'HeatChill' THEN to_json(struct_insert(shared, duration := lasts, "usedDevice" := 'N/A', "targetTemperature" := hot, "heatingCoolingRate" := rate, "underVacuum" := false, "sealedVessel" := sealed, stir := stir)) WHEN 'Filter' THEN to_json(struct_insert(shared, "washingSolvent" := chemical, "vacuumFiltration" := vacuum, "numberOfFiltrations" := times))
WHEN 'Stir' THEN to_json(struct_insert(shared, duration := lasts, temperature := target, wait := waits)) ELSE to_json(struct_insert(shared, duration := lasts)) END AS VARCHAR) AS fields FROM j JOIN p USING (synthesis)"""


def _steps(g: MappedGraph) -> DataFrame:
    found = _listed(documents.steps_document(g), "productNames").withColumnRenamed("synthesisLabel", "procedureName")
    return found.select("synthesis", "procedureName", "productNames", "productCCDCNumber", F.explode("steps").alias("s")).select("synthesis", "procedureName", "productNames", "productCCDCNumber", "s.stepNumber", F.col("s.iri").alias("step"), "s.type", "s.fields")


for _name, _query, _sql in (
    ("document_step_order", documents.step_order, f"""SELECT '{BASE}syn/ChemicalSynthesis/' || l_orderkey AS synthesis, step, CASE WHEN l_tax > 0 THEN l_linenumber ELSE 0 END AS "stepNumber", lower(label) AS "stepLabel" FROM step"""),
    ("document_step_type", documents.step_type, "SELECT step, kind AS type FROM step"),
    ("document_step_fields", documents.step_fields, f"""SELECT step, CASE WHEN l_returnflag = 'A' THEN {HOT} END AS "targetTemperature", CASE WHEN l_returnflag = 'R' THEN {HOT} END AS "crystallizationTemperature",
CASE WHEN l_linestatus = 'F' THEN {LONG} END AS duration, CASE WHEN l_discount = 0.01 THEN {HOT} END AS "heatingCoolingRate", CASE WHEN l_discount = 0.04 THEN {LONG} END AS "transferedAmount",
CASE WHEN l_linenumber <> 7 THEN CASE WHEN s_acctbal > 1000 THEN s_name ELSE CAST(l_suppkey AS VARCHAR) END END AS "usedVesselName", CASE WHEN l_linestatus = 'O' THEN 'env ' || e.label END AS atmosphere,
CASE WHEN l_discount = 0.07 THEN CAST(l_quantity AS VARCHAR) END AS "targetPH", CASE WHEN l_returnflag = 'A' THEN 'true' END AS stir, CASE WHEN l_discount > 0.05 THEN 'True' ELSE 'false' END AS "isLayered",
CAST(NULL AS VARCHAR) AS "underVacuum", CASE WHEN l_returnflag = 'R' THEN 'true' END AS "sealedVessel", CASE WHEN l_linestatus = 'O' THEN 'true' END AS "vacuumFiltration",
CASE WHEN l_linestatus = 'F' THEN 'true' ELSE CAST(l_linenumber AS VARCHAR) END AS repeated, CASE WHEN l_discount < 0.03 THEN 'true' ELSE 'false' END AS wait, CAST(NULL AS VARCHAR) AS comment,
CAST(NULL AS VARCHAR) AS "usedDevice", CAST(NULL AS VARCHAR) AS "isLayeredTransfer", CAST(NULL AS VARCHAR) AS "targetVesselName", CAST(NULL AS VARCHAR) AS "targetVesselType", CASE WHEN l_linenumber <> 7 THEN r_name END AS "usedVesselType"
FROM step LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN region ON r_regionkey = s_nationkey % 6 AND s_acctbal > 3000 LEFT JOIN named e ON e.id = l_linenumber"""),
    ("document_outputs", documents.outputs, f", {MADE} SELECT * FROM made"),
    ("document_chemicals", lambda g: documents.chemicals_document(g).select("procedureName", F.coalesce(F.size("inputChemicals"), F.lit(-1)).alias("n_in"), F.array_join(F.transform("outputChemical", lambda o: F.concat(o["names"][0], F.lit(":"), o["CCDCNumber"])), "|").alias("made")),
     f""", {MADE}, i AS (SELECT synthesis AS label, count(DISTINCT (coalesce(c.label, 'Unknown'), amount, formula, purity, supplier)) AS n_in FROM input JOIN chemical c ON p_partkey = l_partkey GROUP BY 1),
m AS (SELECT synthesis, string_agg(name || ':' || ccdc, '|' ORDER BY name, formula) AS made FROM made GROUP BY 1) SELECT syn.label AS "procedureName", coalesce(n_in, -1) AS n_in, made FROM syn LEFT JOIN i USING (label) LEFT JOIN m ON m.synthesis = iri"""),
    ("document_characterisation", lambda g: _listed(documents.characterisation_document(g), "productNames").select("synthesis", "species", "productNames", "productCCDCNumber", "InfraredSpectroscopy.*", "ElementalAnalysis.*"),
     f"""SELECT iri AS synthesis, '{BASE}spe/Species/' || c_custkey AS species, coalesce(sp.label, '') AS "productNames", coalesce(sp.ccdc, 'N/A') AS "productCCDCNumber", CASE WHEN c_nationkey % 2 = 0 AND c_acctbal < 8000 THEN (1000 + c_nationkey) || ', ' || (2000 + c_nationkey) ELSE 'N/A' END AS bands,
coalesce((SELECT string_agg(label, ' ; ' ORDER BY label) FROM (SELECT DISTINCT n.label FROM material x JOIN named n ON n.id = x.m WHERE x.c_custkey = sp.c_custkey AND sp.c_nationkey % 2 = 0)), 'N/A') AS material,
CASE WHEN c_nationkey % 3 = 0 THEN 'C ' || c_nationkey ELSE 'N/A' END AS "weightPercentageCalculated", CASE WHEN c_nationkey % 3 = 0 AND c_acctbal > 0 THEN 'C ' || c_nationkey || '.1' ELSE 'N/A' END AS "weightPercentageExperimental"
FROM syn JOIN species sp ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND c_acctbal > 2000"""),
    ("document_step_dump", lambda g: documents.step_dump(g).select("step", F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|"))), ";").alias("fields")), DUMP),
    ("document_steps", _steps, f", {MADE}, {STEPS}"),
    ("document_labelled_units", lambda g: _listed(documents.labelled_units(g), "cbuSpeciesNames1", "cbuSpeciesNames2"),
     """, u AS (SELECT ccdc, cbu.label AS n, row_number() OVER (PARTITION BY ccdc ORDER BY cbu.label) AS i, count(*) OVER (PARTITION BY ccdc) AS many FROM unit JOIN cbu ON u = cbu.id WHERE ccdc IS NOT NULL AND cbu.label IS NOT NULL)
SELECT ccdc AS "mopCCDCNumber", 'N/A' AS "cbuFormula1", max(n) FILTER (i = 1) AS "cbuSpeciesNames1", 'N/A' AS "cbuFormula2", max(n) FILTER (i = 2) AS "cbuSpeciesNames2" FROM u WHERE many >= 2 GROUP BY ccdc"""),
    ("document_units", lambda g: _listed(documents.units_document(g), "cbuSpeciesNames1", "cbuSpeciesNames2"),
     """, u AS (SELECT ccdc, coalesce(cbu.formula, cbu.label, '') AS f, coalesce(cbu.label, '') AS n, row_number() OVER (PARTITION BY ccdc ORDER BY coalesce(cbu.formula, cbu.label), cbu.label) AS i FROM unit JOIN cbu ON u = cbu.id WHERE ccdc IS NOT NULL)
SELECT ccdc AS "mopCCDCNumber", max(f) FILTER (i = 1) AS "cbuFormula1", max(n) FILTER (i = 1) AS "cbuSpeciesNames1", max(f) FILTER (i = 2) AS "cbuFormula2", max(n) FILTER (i = 2) AS "cbuSpeciesNames2" FROM u GROUP BY ccdc"""),
):
    _register(_name, _query, _sql)


# summaries


for _name, _query, _sql in (
    ("device_summary", lambda g: integration.devices(g).select("kind", "device", F.coalesce("frequency", F.lit("")).alias("f")), f"""SELECT kind, arg_max(device, (species, node)) AS device, arg_max(CASE WHEN frequency IS NULL THEN '' ELSE frequency END, (species, node)) AS f FROM (
SELECT DISTINCT '{BASE}spe/Species/' || c_custkey AS species, '{BASE}spe/Device/' || d AS node, kind, coalesce(s_name, 'N/A') AS device, CASE WHEN kind = 'HNMR' AND s_nationkey < 12 THEN (s_nationkey * 100) || ' MHz' END AS frequency
FROM (SELECT c_custkey, c_acctbal, 'HNMR' AS kind, c_nationkey % 10 AS d FROM customer UNION ALL SELECT c_custkey, c_acctbal, 'ElementalAnalysis', c_nationkey % 7 FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT c_custkey, c_acctbal, 'InfraredSpectroscopy', c_nationkey % 8 FROM customer WHERE c_mktsegment = 'FURNITURE') JOIN (SELECT DISTINCT o_custkey FROM syn WHERE o_orderstatus = 'F') ON o_custkey = c_custkey LEFT JOIN supplier ON s_suppkey = d WHERE c_acctbal > 2000) GROUP BY kind"""),
    ("species_summary", integration.species_summary, f"""SELECT '{BASE}spe/Species/' || c_custkey AS species, label, CASE WHEN c_nationkey <> 6 AND c_acctbal > 3000 THEN 'C' || c_nationkey END AS formula FROM species ORDER BY label NULLS LAST, 1 LIMIT 20"""),
    ("corpus_counts", integration.corpus_counts, f"""SELECT (SELECT count(*) FROM orders) AS n_syntheses, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem)) AS n_steps, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS n_chemicals,
(SELECT count(*) FROM customer) AS n_polyhedra, (SELECT count(*) FROM mop WHERE ccdc IS NOT NULL) AS n_deposited, (SELECT count(DISTINCT u) FROM unit) AS n_units, (SELECT count(*) FROM customer) AS n_species, (SELECT count(DISTINCT o_custkey) FROM orders) AS n_documents"""),
):
    _register(_name, _query, _sql)
