"""Normalisers, formulas, scores, sections, streams and sources against values worked out by hand."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from triplespan.functions import chemistry, text
from triplespan.operators import documents, graphs, grounding, listing, scoring
from triplespan.sources import rdf, tables
from triplespan.streaming import incremental


def values(spark, f, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.select("i", f(F.col("t")).alias("x")).orderBy("i").select("x").collect()]


CASES = [
    (text.normal_label, {" A  b\tC ": "a b c", None: ""}),
    (text.match_label, {"Cu_OET·2": "cu oet.2"}),
    (text.fingerprint, {" N/A": "", "-1.0": "", "H₂O · α": "h2o . alpha", "2′": "2'", "a  B": "a b", "₋": "₋", None: ""}),
    (text.normal_value, {"24.0": "24", "160.0 degrees Celsius": "160 degree celsius", "rt": "25 degree celsius", "5 -obut": "5-obut", "1 hour , 2.50 mins": "1 h, 2.50 min", "n/a": "n/a", "": "n/a", "Foo": "foo", "two drops": "2 drops"}),
    (text.normal_amount, {"0.045 g (0.276 mmol)": "0.28 mmol, 0.04 g", "3 milliliters": "3 ml", "1.0 g; 2 ml": "1 g, 2 ml", "excess": "excess"}),
    (text.substance, {"N,N-dimethylformamide": "dmf", "Methanol": "meoh", "unobtainium": "unobtainium"}),
    (text.slug, {"Ａ b/ß!": "a-b-ss", "": "entity", "--": "entity"}),
    (text.clean_label, {"VMOP-b": "VMOP-β", "a​b  c": "ab c", "x-bc": "x-bc", None: "entity"}),
    (text.deposit_number, {"974183": "97418 3", "97418 3": "97418 3", "12345": "12345", "N/A": ""}),
    (text.unit_name, {"[Cu (a-b)_c]": "cuabc"}),
    (text.unit_formula, {"(C6H3)2PhPO3": "(c12h6)c6h5po3", "xPhPO3": "xphpo3", "[PhPO3]": "[c6h5po3]"}),
    (text.percent_text, {"C: 37.50; H: 4.26": "c37.50,h4.26", "C 37.50%, H 4.26": "c37.50,h4.26", "none": ""}),
    (text.first_bands, {"KBr pellet, 2922, 1604 cm^-1 ; 2922": "2922, 1604 cm-1", "": ""}),
    (text.band_numbers, {"2922, 1604.5 cm-1": [2922, 1604], None: []}),
    (text.percents, {"C 37.5; H 4.2": {"C": 37.5, "H": 4.2}}),
    (text.bracket_formulas, {"a [x] b [y]2": ["[x]", "[y]"]}),
    (text.model_label, {"(4-planar)x12(2-bent)x24": "(2-bent)x24(4-planar)x12"}),
    (text.doi, {"https://doi.org/10.1021/AB": "10.1021/ab", "10.1021_ab": "10.1021/ab"}),
    (text.unwrapped, {"foo-\n bar  b": "foobar b"}),
    (text.sentences, {"A b. C 0.5? d": ["A b.", "C 0.", "5?", "d"]}),
    (text.camel, {"HasThing": "hasThing"}),
    (chemistry.point_group, {"o_h": "Oh", "c2v": "C2v", None: ""}),
]


@pytest.mark.parametrize("f, cases", CASES, ids=[f.__name__ for f, _ in CASES])
def test_texts(spark, f, cases):
    assert dict(zip(cases, values(spark, f, *cases), strict=True)) == cases


def test_formulas(spark):
    hill = lambda c: chemistry.formula(chemistry.atoms(c))
    weigh = lambda c: chemistry.weight(chemistry.atoms(c))
    assert values(spark, hill, "[CuCl2(C5H3N)2(CO2)2]", "C16H10O4", "((C6H4)(CO2)2)3", "", None, "Zz2A") == ["C12H6N2O4Cl2Cu", "C16H10O4", "C8H4O4", "", "", "AZz2"]
    assert values(spark, weigh, "[CuCl2(C5H3N)2(CO2)2]", "C16H10O4", "Me") == [376.639, 266.2482, 0.0]
    found = chemistry.formula_search(spark.createDataFrame([("C16H10O4",), ("C16H10O5",), ("H",)], "label string"), "C16H10O4")
    assert [tuple(r) for r in found.select("label", "score").collect()] == [("C16H10O4", 10), ("C16H10O5", 0), ("H", 0)]
    rows = spark.createDataFrame([("[A]", "[B]", "(2-bent)x24(4-planar)x12"), ("[A]", "", "(2-bent)x24(4-planar)x12"), ("[A]", "[B]", "x")], "a string, b string, l string")
    assert [r[0] for r in rows.select(chemistry.assembly_formula(F.col("a"), F.col("b"), F.col("l"))).collect()] == ["[A]12[B]24", "", ""]
    pairs = spark.createDataFrame([("TET ", ""), ("", "d_3h"), ("", "Oh"), ("xx", "oh")], "s string, g string")
    assert [tuple(r[0]) for r in pairs.select(chemistry.bound_symbol(F.col("s"), F.col("g"))).collect()] == [("tet", "Td"), ("twc", "D3h"), ("", "Oh"), ("xx", "Oh")]
    one = spark.createDataFrame([(1, "[A]", "[B]", 2, -1, 4, 2, "planar", "linear")], "id int, formula_a string, formula_b string, charge_a int, charge_b int, modularity_a int, modularity_b int, planarity_a string, planarity_b string")
    assert chemistry.assembled(one).count() == 0 and [r["n_b"] for r in chemistry.suggestions(one).collect()] == [24]


def test_scores(spark):
    frame = lambda rows: spark.createDataFrame([(1, v) for v in rows], "k int, v string")
    counts = lambda t, f: tuple(scoring.multisets(frame(t), frame(f), ["k"], "v").select("tp", "fp", "fn").first())
    assert counts("aab", "ac") == (1, 1, 2)
    scored = scoring.with_prf(scoring.multisets(frame("aab"), frame("ac"), ["k"], "v")).first()
    assert (scored["precision"], round(scored["recall"], 4), round(scored["f1"], 4)) == (0.5, 0.3333, 0.4)
    lenient = lambda t, f: tuple(scoring.lenient(scoring.multisets(frame(t), frame(f), ["k"], "v")).select("tp", "fp", "fn").first())
    assert lenient("ab", "axy") == (1, 0, 1) and lenient("ab", "xy") == (0, 2, 2)
    steps = spark.createDataFrame([(["Add", "Stir"], ["Add", "Filter", "Stir"])], "a array<string>, b array<string>")
    assert tuple(steps.select(scoring.positional(F.col("a"), F.col("b"))).first()[0]) == (1, 2, 1)
    pairs = spark.createDataFrame([(i, i < 8, 8 <= i) for i in range(10)], "i int, a boolean, b boolean").select(F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))
    found = scoring.mcnemar(pairs, "a", "b").first()
    assert (found["n01"], found["n10"], found["chi2"], round(found["p"], 4)) == (8, 2, 2.5, 0.1138)
    t = scoring.paired_t(spark.createDataFrame([(0.9, 0.8), (0.8, 0.8), (0.7, 0.5)], "a double, b double"), "a", "b").first()
    assert (round(t["t"], 4), round(t["p"], 4)) == (1.7321, 0.0833)
    drawn = scoring.bootstrap(spark.createDataFrame([(0.9, 0.8), (0.8, 0.8), (0.7, 0.5)] * 20, "a double, b double"), "a", "b", 400)
    assert 0.3 < drawn.first()["p"] < 0.7
    greedy = spark.createDataFrame([(1, 1, 1, 5.0), (1, 1, 2, 5.0), (1, 2, 2, 4.0), (1, 2, 1, 1.0)], "k int, t int, f int, s double")
    assert sorted((r["t"], r["f"]) for r in scoring.greedy(greedy, ["k"], "s", "t", "f").collect()) == [(1, 2), (2, 1)]
    units = spark.createDataFrame([("x", 0, "1", ["a"], ["F"])], "doc string, i int, ccdc string, names array<string>, formulas array<string>")
    assert scoring.unit_pairs(units, units, "doc").first()["score"] == 30 + 12 + 8 + 4 + 4 + 10


def test_fuzzy(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("abc-17") for _ in range(rng.randint(1, 12))) for _ in range(60)]
    labels = spark.createDataFrame([(n,) for n in names], "label string")
    queries = spark.createDataFrame([(n,) for n in names[:7] + ["VMOP-17"]], "query string")
    got = {(r["query"], r["label"]): r["score"] for r in grounding.fuzzy(queries, labels.union(spark.createDataFrame([("VMOP-71",)], "l string")), limit=100).collect()}
    want = {(q, n): round(s, 4) for q in {*names[:7], "VMOP-17"} for n in {*names, "VMOP-71"} if (s := SequenceMatcher(None, q.lower(), n.lower()).ratio()) >= 0.6}
    assert got == want and got["VMOP-17", "VMOP-71"] == 0.8571
    words = grounding.fuzzy(spark.createDataFrame([("b a",)], "query string"), spark.createDataFrame([("A, b",)], "label string"), scorer="words").first()
    part = grounding.fuzzy(spark.createDataFrame([("cage",)], "query string"), spark.createDataFrame([("a cage here",)], "label string"), scorer="partial").first()
    assert words["score"] == part["score"] == 1.0
    named = spark.createDataFrame([("s", ["zzz", "alpha"])], "s string, labels array<string>")
    known = spark.createDataFrame([("i2", "alpha"), ("i1", "alpha"), ("i0", "alphb")], "iri string, label string")
    assert grounding.grounded(named, known).first()["iri"] == "i1"


def test_sections(spark):
    docs = spark.createDataFrame([("d", "x\n## One\na\n### Two\nb"), ("e", None), ("f", "")], "doc string, text string")
    found = documents.sections(docs)
    assert [tuple(r) for r in found.orderBy("idx").select("doc", "idx", "title", "content").collect()] == [("d", 1, "One", "a\n#"), ("d", 2, "Two", "b")]
    choices = spark.createDataFrame([("d", 1, "discard")], "doc string, idx int, choice string")
    kept = documents.classified(found, choices)
    assert documents.stitched(kept).first()["text"] == "## Two\n\nb"
    assert documents.section_status(kept).first()["percent"] == 50.0
    with pytest.raises(Exception, match="not keep or discard"):
        documents.classified(found, spark.createDataFrame([("d", 1, "perhaps")], "doc string, idx int, choice string")).collect()


def test_streams(spark, tmp_path):
    schema = "doc string, s string"
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", "1"), ("b", "2")], schema).write.parquet(source)
    incremental.upsert_documents(spark, source, schema, target, str(tmp_path / "check"))
    spark.createDataFrame([("a", "3")], schema).write.mode("append").parquet(source)
    incremental.upsert_documents(spark, source, schema, target, str(tmp_path / "check"))
    assert sorted((r["doc"], r["s"]) for r in spark.read.parquet(target).collect()) == [("a", "3"), ("b", "2")]
    events = "/root/testdata/sf0.001/events.parquet"
    still = spark.read.parquet(events)
    stream = spark.readStream.schema(still.schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001/")
    got = incremental.collected(incremental.windowed_counts(stream, "ts", "event_type", "value", late="0 seconds"), str(tmp_path / "stream"))
    want = incremental.windowed_counts(still, "ts", "event_type", "value")
    assert 0 < got.count() <= want.count() and got.select("window_start", "event_type", "n").exceptAll(want.select("window_start", "event_type", "n")).isEmpty()


def test_sources(spark, tmp_path):
    lines = spark.createDataFrame([('<http://a> <http://p> "x\\"y"@en .',), ("# no",), ("_:b <http://p> <http://c> .",), ("nonsense",)], "value string")
    rows = rdf.ntriples(lines).collect()
    assert [(r["s"], r["o"], r["o_kind"], r["error"] is None) for r in rows] == [("http://a", 'x"y', "lit", True), (":b", "http://c", "iri", True), (None, None, None, False)]
    (tmp_path / "u.csv").write_text("formula,smiles,canonical_smiles\nA,x,y\n,z,\nB,w,\n")
    assert sorted((r["formula"], r["smiles"]) for r in tables.unit_database(spark, str(tmp_path / "u.csv")).collect()) == [("A", "y"), ("B", "w")]
    (tmp_path / "l.json").write_text('[{"label": "a"}, {"subject": "s"}]')
    assert tables.json_list(spark, str(tmp_path / "l.json"), "label string, subject string").count() == 2


def test_escapes(spark):
    """Literals of any characters, and blank nodes of any names, survive a round trip."""
    odd = ["C:\\new \\table", "a\\\\n", '"', "\\", "\\\\", "\t\r\n\b\f", "\\u0041", "é😀\u2028", "x\\", ""]
    rows = [(f"http://s/{k}", "iri", "http://p", v, "lit") for k, v in enumerate(odd)] + [("d:x.1", "bnode", "http://p", "d:x-1", "bnode"), ("d:x-1", "bnode", "http://p", "http://o", "iri")]
    df = spark.createDataFrame(rows, "s string, s_kind string, p string, o string, o_kind string")
    back = rdf.ntriples(rdf.ntriples_lines(df)).collect()
    assert all(r["error"] is None for r in back)
    assert {r["s"]: r["o"] for r in back if r["o_kind"] == "lit"} == {f"http://s/{k}": v for k, v in enumerate(odd)}
    nodes = [r for r in back if r["s_kind"] == "bnode"]
    assert len({r["s"] for r in nodes}) == 2 and nodes[0]["o"] == nodes[1]["s"]
    coded = spark.createDataFrame([('<a:a> <a:p> "\\\\u0041 \\u00e9\\U0001F600\\\\\\n" .',)], "value string")
    assert rdf.ntriples(coded).first()["o"] == "\\u0041 é😀\\\n" == rdf.unescaped("\\\\u0041 \\u00e9\\U0001F600\\\\\\n")


def test_ancestors_on_cycles(spark):
    classes = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", None)], "class string, parent string")
    found = {(r["class"], r["ancestor"]): r["level"] for r in graphs.ancestors(classes).collect()}
    assert found == {(x, y): ("abc".index(y) - "abc".index(x)) % 3 or 3 for x in "abc" for y in "abc"} | {("d", "a"): 1, ("d", "b"): 2, ("d", "c"): 3}
    assert graphs.ancestors(classes, 1).count() == 4 and graphs.ancestors(classes, 2).count() == 8


def test_listing(spark):
    assert values(spark, listing.without_prefixes, "@prefix a: <b> .\n\na:x a:y a:z .\nPREFIX c: <d>\n") == ["a:x a:y a:z ."]
    assert values(spark, listing.fenced_json, 'x\n```json\n{"a": 1}\n```\ny', ' {"a": 2} ') == ['{"a": 1}', '{"a": 2}']
    assert values(spark, lambda c: listing.json_records(c, "a int"), '{"a": 1}\n{"a": 2}\n{bad}', '[{"a": 3},\n{"a": 4}]') == [[(1,), (2,)], [(3,), (4,)]]
    rows = lambda *r: spark.createDataFrame(list(r), "id int, smiles string, synonyms array<string>")
    wanted = spark.createDataFrame([("1-1",), ("2-2",), ("3-3",)], "cas string")
    found = listing.resolved(wanted, rows((2, "b", ["1-1"]), (1, "a", ["x", "1-1"])), rows((7, "z", ["1-1", "2-2"])))
    assert sorted(map(tuple, found.select("cas", "smiles").collect())) == [("1-1", "a"), ("2-2", "z")]
    entries = spark.createDataFrame([("9", "B", True), ("9", "A", False), ("9", "C", True)], "number string, refcode string, has_3d boolean")
    assert listing.chosen_entry(entries).first()["refcode"] == "B"
    solutions = spark.createDataFrame([("http://x/a#b", None), ("http://x/c", " l ")], "synthesis string, label string")
    assert sorted(map(tuple, listing.entity_rows(solutions).collect())) == [("http://x/a#b", "b"), ("http://x/c", "l")]
