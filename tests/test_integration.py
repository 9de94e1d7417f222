"""Units over documents, grounding of a corpus, and files of document folders."""

import pytest
from pyspark.sql import functions as F
from test_named import HEAD, PREFIXES

from triplespan.operators import integration
from triplespan.plans.patterns import Graph
from triplespan.sources import files, rdf

EXTENSION = {
    "one": "d:M1 a mop:MetalOrganicPolyhedron ; rdfs:label 'm1' ; mop:hasChemicalBuildingUnit d:U1 . d:M2 a mop:MetalOrganicPolyhedron ; mop:hasCCDCNumber '7' ; mop:hasMOPFormula 'old' ; mop:hasChemicalBuildingUnit d:U1, d:U2 . d:S1 syn:hasChemicalOutput d:M2 . d:S2 syn:hasChemicalOutput d:M2 . d:U2 rdfs:label 'unit two', ' unit 2 ' .",
    "two": "d:X mop:hasChemicalBuildingUnit d:U3 ; mop:hasCCDCNumber '8' . d:Y mop:hasChemicalBuildingUnit d:U4 . d:U3 rdfs:label 'water' .",
}
ROOT = {"one": "d:U2 rdfs:label 'root label' ; skos:altLabel 'alt' ; syn:hasAmount '1 g' ; a syn:ChemicalInput . d:U1 rdfs:label 'unit one' .", "two": "d:U3 rdfs:label 'Water' . d:U4 rdfs:label 'kept' ."}


@pytest.fixture(scope="module")
def sides(spark):
    def triples(texts):
        rows = rdf.parsed(spark.createDataFrame([(d, HEAD + t) for d, t in texts.items()], "doc string, text string"))
        return rows.select("doc", "s", "p", "o", "o_kind").cache()

    return triples(EXTENSION), triples(ROOT), integration.Terms(Graph(triples(ROOT), PREFIXES))


def short(df, *columns):
    return sorted((tuple(str(v).rsplit("/", 1)[-1] if isinstance(v, str) else v for v in r) for r in df.select(*columns).collect()), key=repr)


def test_units(spark, sides):
    extension, root, terms = sides
    assert short(integration.first_polyhedra(extension, terms), "doc", "s", "ccdc") == [("one", "M1", None), ("two", "X", "8")]
    assert short(integration.main_polyhedra(extension, terms), "doc", "s") == [("one", "M2"), ("two", "Y")]  # a tie in the second
    found = {r["iri"].rsplit("/", 1)[1]: r for r in integration.unit_candidates(extension, root, terms).collect()}
    assert set(found) == {"U1", "U3"} and found["U3"]["labels"] == ["Water", "water"] and found["U1"]["labels"] == ["unit one"] and not found["U1"]["is_input"]
    chosen = spark.createDataFrame([("one", " new ", [PREFIXES["d"] + "U2", PREFIXES["d"] + "U9"]), ("two", "", [PREFIXES["d"] + "U4"])], "doc string, formula string, units array<string>")
    got = integration.integrated(extension, root, chosen, terms)
    assert short(got.where("doc = 'one'"), "s", "p", "o") == sorted(
        [("M2", "22-rdf-syntax-ns#type", "MetalOrganicPolyhedron"), ("M2", "hasCCDCNumber", "7"), ("M2", "hasMOPFormula", "new"), ("M2", "hasChemicalBuildingUnit", "U2"), ("S1", "22-rdf-syntax-ns#type", "ChemicalSynthesis"),
         ("S1", "hasChemicalOutput", "M2"), ("U2", "22-rdf-syntax-ns#type", "ChemicalInput"), ("U2", "rdf-schema#label", " unit 2 "), ("U2", "rdf-schema#label", "root label"), ("U2", "rdf-schema#label", "unit two")], key=repr)
    assert short(integration.unit_labels(extension.union(root), terms), "iri", "label") == [("U1", "unit one"), ("U2", " unit 2 "), ("U3", "Water"), ("U4", "kept")]
    assert integration.unit_labels(extension, terms, across=False).count() == 2


def test_grounded_documents(spark, sides):
    _, root, _ = sides
    more = root.union(root.select(F.lit("three").alias("doc"), F.concat("s", F.lit("b")).alias("s"), "p", "o", "o_kind"))
    reference = spark.createDataFrame([("c", "http://ref/water", "water"), ("c", "http://ref/other", "zzzz")], "class string, iri string, label string")
    got = integration.grounded_documents(more, reference, 0.9)
    assert got.where("s = 'http://ref/water'").select("doc").distinct().count() == 2  # U3 and U3b are one entity in two documents
    assert got.where("s like '%b'").isEmpty() and got.count() == more.count()


def test_final_and_pairs(spark):
    derived = spark.createDataFrame([("a", " F "), ("b", ""), ("e", "G")], "name string, formula string")
    records = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "e"), ("a", "e")], "name string, entity string")
    assert short(integration.final_records(derived, records), "name", "entity", "formula") == [("a", "e", " F ".strip()), ("a", "x", "F"), ("c", "e", "G")]
    a, b = (spark.createDataFrame(r, "key string, value double") for r in ([("10.1/x", 1.0), ("h2", 2.0)], [("h1", 3.0), ("h2", 4.0), ("h3", 5.0)]))
    got = integration.paired_results(a, b, spark.createDataFrame([("10.1/x", "h1")], "id string, hash string"))
    assert short(got, "key", "a", "b") == [("h1", 1.0, 3.0), ("h2", 2.0, 4.0)]


def test_files(spark, tmp_path):
    root = tmp_path / "corpus"
    for name, text in {
        "d1/output_a.ttl": "d:A rdfs:label 'a' .", "d1/output_top.ttl": "d:T rdfs:label 't' .", "d1/ontospecies_output/s.ttl": "d:S rdfs:label 's' .",
        "d1/cbu_derivation/integrated/i.ttl": "d:I rdfs:label 'i' .", "d2/output_b.ttl": "_:x rdfs:label 'b' .", "d2/other.ttl": "d:O rdfs:label 'o' .",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(HEAD + text)
    rows = files.document_graphs(spark, str(root))
    assert sorted((r["doc"], r["part"], r["o"]) for r in rows.collect()) == [("d1", "integrated", "i"), ("d1", "main", "a"), ("d1", "species", "s"), ("d2", "main", "b")]
    texts = spark.createDataFrame([("good", "d:A rdfs:label 'a' ."), ("quote", 'd:A rdfs:label "a "b" c" .'), ("dot", "d:A rdfs:label 'x'"), ("lost", "[[ .")], "doc string, text string")
    got = files.lenient(texts.withColumn("text", F.concat(F.lit(HEAD), "text")))
    assert {(r["doc"], r["o"], r["error"] is None) for r in got.collect()} == {("good", "a", True), ("quote", 'a "b" c', True), ("dot", "x", True), ("lost", None, False)}
    for name in ("B.pdf", "a.PDF", "a_SI.pdf", "notes.txt"):
        (root / name).write_bytes(b"\xff\xfe" if name == "B.pdf" else b"text")
    assert [r["doi"] for r in files.papers(spark, str(root)).collect()] == ["a", "B"]
    seen = {r["path"].rsplit("/", 1)[1]: (r["length"], r["head"], r["text"]) for r in files.previews(spark, str(root), "*.{pdf,txt}").collect()}
    assert seen["B.pdf"] == (2, "FFFE", None) and seen["notes.txt"] == (4, "74657874", "text")
    before = files.signature(spark, str(root))
    assert before == files.signature(spark, str(root))
    (root / "notes.txt").write_text("texts")
    assert before != files.signature(spark, str(root))
    assert short(files.resources(spark, str(root), r"/cbu_derivation/").where("task = 'd1'"), "name") == [("output_a.ttl",), ("output_top.ttl",), ("s.ttl",)]
    names = spark.createDataFrame([("Output_A",), ("x_y",), ("none",)], "name string")
    there = spark.createDataFrame([("output_a.ttl", "p1"), ("x-y.ttl", "p2"), ("output-a.ttl", "p3")], "name string, path string")
    assert short(files.chosen_variants(names, there), "name", "path") == [("Output_A", "p1"), ("x_y", "p2")]
    records = spark.createDataFrame([("a", "1"), ("a", " N/A "), ("b", "2"), ("c", None)], "doc string, ccdc string")
    assert short(files.missing_deposits(records), "doc", "n", "n_missing") == [("a", 2, 1), ("c", 1, 1)]
    files.write_documents(records, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 4
