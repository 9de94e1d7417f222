"""The named queries, documents and graph transforms over a small graph read from Turtle."""

import json

import pytest
from pyspark.sql import functions as F

from triplespan.operators import documents, graphs, grounding, named
from triplespan.plans.patterns import Graph, lit
from triplespan.sources import rdf

PREFIXES = {p: f"http://example.org/{p}/" for p in ("syn", "mop", "spe", "om", "qudt", "d")}
HEAD = "".join(f"@prefix {p}: <{i}> .\n" for p, i in PREFIXES.items()) + "@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n@prefix skos: <http://www.w3.org/2004/02/skos/core#> .\n@prefix owl: <http://www.w3.org/2002/07/owl#> .\n"
FIRST = HEAD + """
d:S1 a syn:ChemicalSynthesis ; rdfs:label "UMC-1" ; syn:hasSynthesisStep d:A, d:H, d:F ; syn:hasChemicalInput d:C1, d:C2 ; syn:hasChemicalOutput d:P, d:O ; syn:retrievedFrom d:Doc ; syn:hasEquipment d:E .
d:A a syn:Add, syn:SynthesisStep ; rdfs:label "add" ; syn:hasOrder 2 ; syn:hasAddedChemicalInput d:C1 ; syn:isLayered "true" .
d:H a syn:HeatChill ; rdfs:label "heat" ; syn:hasOrder 10 ; syn:hasTargetTemperature d:T9 ; syn:hasCrystallizationTargetTemperature d:T10 ; syn:hasStepDuration d:D3 .
d:F a syn:Filter ; rdfs:label "filter" ; syn:hasWashingChemical d:C2 ; syn:isVacuumFiltration true .
d:T9 om:hasNumericalValue 9.0 ; om:hasUnit om:degreeCelsius .
d:T10 om:hasNumericalValue 10 . d:D3 om:hasNumericalValue 3 ; om:hasUnit om:hour .
d:C1 rdfs:label "water" ; skos:altLabel "H2O", "aqua" ; syn:hasAmount "5 ml" ; syn:isSuppliedBy [ rdfs:label "Acme" ] .
d:P a spe:Species ; rdfs:label "product" ; spe:hasCCDCNumber d:N ; spe:hasCharacterizationSession d:X ; spe:hasInfraredSpectroscopyData d:IR . d:N spe:hasCCDCNumberValue "123456" .
d:IR spe:hasBands "2922, 1604", "700" ; spe:usesMaterial d:K1, d:K2 . d:K1 rdfs:label "KBr" . d:K2 rdfs:label "film" .
d:O a syn:ChemicalOutput ; rdfs:label "out" ; syn:isRepresentedBy d:M1 ; syn:hasYield d:Y . d:Y om:hasNumericalValue 42.0 .
d:M1 a mop:MetalOrganicPolyhedron ; rdfs:label "MOP-1" ; mop:hasCCDCNumber "654321" ; mop:hasMOPFormula "[A]12[B]24" ; mop:hasChemicalBuildingUnit d:U1, d:U2 .
d:U1 mop:hasCBUFormula "[CuCl2(C5H3N)2(CO2)2]" ; rdfs:label "u1" ; owl:sameAs d:C1 . d:U2 rdfs:label "u2" .
d:Doc rdfs:label "paper" . d:E rdfs:label "oven" . d:Lone rdfs:label "alone" .
_:b0 rdfs:label "one" .
d:Twice rdfs:comment \"\"\"a "quoted"
text\"\"\"@en ; rdfs:label 'a\\tb' .
"""
SECOND = HEAD + """
d:S2 a syn:ChemicalSynthesis ; rdfs:label "VMOP-17" ; syn:inheritsFromProcedure d:S1 ; syn:hasYield d:Y2 . d:Y2 om:hasNumericalValue 50 ; qudt:numericValue 60 .
d:S3 a syn:ChemicalSynthesis, owl:NamedIndividual ; rdfs:label "Session 1" .
d:M2 a mop:MetalOrganicPolyhedron ; rdfs:label "MetalOrganicPolyhedron for X" .
d:S4 a syn:ChemicalSynthesis ; rdfs:label "old" ; syn:hasChemicalOutput d:P4 . d:P4 a spe:Species ; spe:hasCharacterizationSession d:X4 ; spe:hasCCDCNumber d:N4 . d:N4 rdfs:label "777777" .
d:C9 rdfs:label "water" ; skos:altLabel "H2O", "aqua" ; syn:hasAmount "5 ml" . d:C8 rdfs:label "water" ; skos:altLabel "aqua", "H2O" ; syn:hasAmount "5 ml" .
d:Q1 syn:uses d:C9 . d:Q2 syn:uses d:C8 .
_:b0 rdfs:label "two" .
"""


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("graphs")
    for name, text in (("one", FIRST), ("two", SECOND), ("bad", "d:S a ["), ("one_link", SECOND)):
        (folder / name).mkdir()
        (folder / name / f"{name}.ttl").write_text(text)
    (folder / "two" / "two_grounded.ttl").write_text(SECOND)
    found = rdf.turtle_files(spark, str(folder)).cache()
    assert rdf.corpus_files(spark, str(folder)).where("error is null").select("doc").distinct().count() == 3
    return found


@pytest.fixture(scope="module")
def g(spark, rows):
    return Graph(rdf.graph(rows).cache(), PREFIXES)


def table(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_reading(rows, g):
    assert [r["doc"] for r in rows.where("error is not null").collect()] == ["bad"]
    assert {r["doc"] for r in rows.collect()} == {"one", "two", "bad"}
    assert {r["s"] for r in rows.where("s_kind = 'bnode' and o in ('one', 'two')").collect()} == {"one:b0", "two:b0"}
    twice = {r["o"]: r["o_lang"] for r in rows.where("s like '%/Twice'").collect()}
    assert twice == {'a "quoted"\ntext': "en", "a\tb": None}
    back = rdf.graph(rdf.ntriples(rdf.ntriples_lines(rows.where("error is null and s_kind = 'iri' and o_kind <> 'bnode'"))))
    assert back.exceptAll(g.triples).count() == 0 and back.count() > 60


def test_lookup(g):
    assert named.synthesis_iri(g, "UMC-1").first()[0].endswith("d/S1")
    assert named.synthesis_iri(g, 'UMC-1" } #').count() == 0
    assert table(named.all_polyhedra(g), "mopLabel", "ccdc") == [("MOP-1", "654321"), ("MetalOrganicPolyhedron for X", None)]
    assert named.all_polyhedra(g, exclude_placeholders=True).count() == 1
    assert named.polyhedron_by_deposit(g, "654321").first()["formula"] == "[A]12[B]24"
    assert named.polyhedron_iri(g, "MOP-1").first()["ccdc"] == "654321"
    assert named.polyhedra_by_unit_formula(g, "cucl2").count() == 1
    with pytest.raises(ValueError):
        named.polyhedra_by_unit_formula(g, "")
    with pytest.raises(ValueError):
        named.all_polyhedra(g).sparkSession and named.polyhedra_by_unit_formula(g, "a", order="up")


def test_statistics(g):
    assert named.statistics(g).first().asDict() == {"n_mop": 2, "n_synthesis": 4, "n_step": 3, "n_chemical": 2}
    assert table(named.step_types(g), "type", "n") == [("Add", 1), ("Filter", 1), ("HeatChill", 1), ("SynthesisStep", 1)]
    assert table(named.common_chemicals(g), "label", "n") == [("water", 1)]
    assert table(named.common_materials(g), "material", "n") == [("KBr", 1), ("film", 1)]
    assert table(named.suppliers(g), "supplier", "n") == [("Acme", 1)]


def test_synthesis(g):
    assert table(named.recipe(g, "UMC-1"), "role", "chemicalLabel", "amount", "supplier") == [
        ("added", "water", "5 ml", "Acme"), ("synthesis_input", "water", "5 ml", "Acme"), ("synthesis_input", None, None, None), ("washing_chemical", None, None, None),
    ]
    assert table(named.producing(g, "MOP-1"), "synthesisLabel") == [("UMC-1",)]
    assert [tuple(r) for r in named.temperatures(g, "UMC-1").select("value", "unit", "temperatureKind").collect()] == [("9.0", "degreeCelsius", "target"), ("10", None, "crystallization")]
    assert named.temperatures(g, None, "target").count() == 1
    assert table(named.durations(g), "value", "unit") == [("3", "hour")]
    assert [r["type"] for r in named.step_index(g, "UMC-1").collect()] == ["Filter", "Add", "SynthesisStep", "HeatChill"]
    assert table(named.inheritance(g), "synthesisLabel", "direction", "otherLabel") == [("UMC-1", "inherited_by", "VMOP-17"), ("VMOP-17", "inherits_from", "UMC-1")]
    assert table(named.yields(g), "synthesisLabel", "value") == [("UMC-1", "42.0"), ("VMOP-17", "50")]
    assert table(named.equipment(g), "scope", "equipmentLabel") == [("synthesis", "oven")]
    assert named.documents(g).first()["documentLabel"] == "paper"
    assert table(named.products(g), "mopLabel", "ccdc") == [("MOP-1", "654321")]
    assert table(named.washing(g), "role", "chemicalLabel") == []
    assert named.filtrations(g).first()["vacuum"] == "true" and named.flagged(g, "syn:isLayered", kind="syn:Add").count() == 1
    assert named.bridge(g).where("mopLabel is null").count() == 3


def test_characterisation(g):
    assert named.characterisation_of_synthesis(g, "UMC-1").count() == 4  # two lists of bands times two materials
    assert named.characterisation_by_deposit(g, "123456").count() == 4
    assert table(named.species(g), "speciesLabel") == [("product",)] and named.characterised(g).count() == 2
    assert table(named.methods(g), "method") == [("IR spectroscopy",)]
    assert ("chemicals", "water") in table(named.label_index(g), "kind", "label")


def test_every_named_query_runs(g):
    given = {"producing": ["MOP-1"], "synthesis_iri": ["UMC-1"], "polyhedron_iri": ["MOP-1"], "polyhedron_by_deposit": ["1"], "polyhedra_by_unit_formula": ["a"], "characterisation_by_deposit": ["1"], "flagged": ["syn:isStirred"], "typical": ["syn:hasStepDuration"]}
    for name, query in named.NAMED.items():
        query(g, *given.get(name, [])).count()


def test_documents(g):
    chemicals = {r["procedureName"]: r for r in documents.chemicals_document(g).collect()}
    assert set(chemicals) == {"UMC-1", "VMOP-17", "old"}  # the session is left out
    names = [c["chemicalName"] for c in chemicals["UMC-1"]["inputChemicals"]]
    assert sorted(names) == [["Unknown"], ["water", "H2O", "aqua"]]
    out = {o["names"][0]: o for o in chemicals["UMC-1"]["outputChemical"]}
    assert out["out"]["yield"] == "42%" and out["out"]["CCDCNumber"] == "654321" and out["product"]["CCDCNumber"] == "123456"
    steps = documents.steps_document(g).where("synthesisLabel = 'UMC-1'").first()
    assert [s["type"] for s in steps["steps"]] == ["Filter", "Add", "HeatChill"]
    fields = {s["type"]: json.loads(s["fields"]) for s in steps["steps"]}
    assert fields["Add"]["isLayered"] and fields["Add"]["addedChemical"][0]["chemicalName"] == ["water", "H2O", "aqua"] and fields["Add"]["targetPH"] == -1
    assert fields["HeatChill"]["targetTemperature"] == "9.0 degreeCelsius" and fields["HeatChill"]["duration"] == "3 hour"
    assert fields["Filter"]["washingSolvent"][0]["chemicalName"] == ["Unknown"] and fields["Filter"]["vacuumFiltration"] and "duration" not in fields["Filter"]
    record = documents.characterisation_document(g).where("productCCDCNumber = '123456'").first()
    assert record["InfraredSpectroscopy"]["bands"] == "2922, 1604 ; 700" and record["productCCDCNumber"] == "123456"
    assert {r["productCCDCNumber"] for r in documents.characterisation_document(g).collect()} == {"123456", "777777"}
    units = documents.units_document(g).first()
    assert units["cbuFormula1"] == "[CuCl2(C5H3N)2(CO2)2]" and units["cbuSpeciesNames1"] == ["H2O", "aqua", "u1", "water"] and units["cbuFormula2"] == "u2"
    assert documents.step_dump(g).count() == 3


def test_merging(spark, g):
    found = {r["s"].rsplit("/", 1)[1]: r["iri"].rsplit("/", 1)[1] for r in grounding.canonical(g.triples.where("s like '%/C8' or s like '%/C9' or s like '%/Q_'")).collect()}
    assert found == {"C9": "C8", "Q2": "Q1"}  # the second pair is equal only once the first one is merged
    mapping = spark.createDataFrame([("http://example.org/d/C9", "http://example.org/d/C8")], "s string, iri string")
    merged = grounding.replaced(g.triples, mapping)
    assert merged.count() == g.triples.count() - 4 and merged.where("o like '%/C9'").isEmpty()
    assert grounding.with_same_as(g.triples, mapping).count() == g.triples.count() + 1
    assert graphs.without_orphans(g.triples).where("s like '%/Lone'").isEmpty()
    assert graphs.merged(g.triples, g.triples).count() == g.triples.count()
    linked = graphs.linked(g.triples, [PREFIXES["syn"] + "ChemicalSynthesis"], {PREFIXES["syn"] + "hasChemicalOutput": PREFIXES["syn"] + "isRepresentedBy"})
    assert linked.where("p like '%inherits%'").count() == 1 and linked.where("o like '%/bridge/%'").count() == 1


def test_patterns(g):
    with pytest.raises(ValueError):
        g.bgp(("?a", "rdfs:label", "?b"), ("?c", "syn:hasAmount", "?d"))
    assert g.match("?s", "rdfs:label", lit("water")).count() == 3
    assert g.match("?s", "owl:sameAs", "?s").count() == 0


def test_schema(spark):
    own = HEAD + """@prefix c: <http://example.org/c/> .
    c:A a owl:Class . c:B a owl:Class ; rdfs:subClassOf c:A . c:C a owl:Class ; rdfs:subClassOf c:B .
    c:p a owl:DatatypeProperty ; rdfs:domain c:A . c:q a owl:ObjectProperty ; rdfs:domain c:B ; rdfs:range c:A ."""
    triples = rdf.graph(rdf.parsed(spark.createDataFrame([("x", own)], "doc string, text string")))
    classes, properties = graphs.schema(triples)
    name = F.element_at(F.split("class", "/"), -1)
    near = graphs.inherited_properties(classes, properties, 1).groupBy(name.alias("c")).count()
    far = graphs.inherited_properties(classes, properties, None).groupBy(name.alias("c")).count()
    assert table(near, "c", "count") == [("A", 1), ("B", 2), ("C", 1)] and table(far, "c", "count") == [("A", 1), ("B", 2), ("C", 2)]
