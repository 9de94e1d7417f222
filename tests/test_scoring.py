"""Scores of records, units and steps on small cases worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from triplespan.functions import text
from triplespan.operators import graphs, grounding, listing, records, scoring
from triplespan.sources import tables


def counts(df, *key):
    return {tuple(r[k] for k in key): (r["tp"], r["fp"], r["fn"]) for r in df.collect()}


def test_units(spark):
    """The pair with the highest score goes first; ties prefer larger places; what stays alone counts whole."""
    schema = "doc string, i int, ccdc string, formula1 string, formula2 string"
    truth = spark.createDataFrame([("d", 0, "1", "A", "B"), ("d", 1, "", "A", "C"), ("d", 2, "9", "X", ""), ("e", 0, "1", "A", "")], schema)
    found = spark.createDataFrame([("d", 0, "", "A", "B"), ("d", 1, "1", "B", "A"), ("d", 2, None, "Z", None), ("f", 0, "1", "Q", "")], schema)
    pairs = scoring.formula_pairs(truth, found, "doc")
    assert {(r["t"], r["f"]): (r["score"], r["overlap"]) for r in pairs.collect()} == {(0, 0): (30, 2), (0, 1): (40, 2), (1, 0): (15, 1), (1, 1): (10, 1)}
    matches = scoring.greedy(pairs, ["doc"], "score", "t", "f")
    assert {(r["t"], r["f"]) for r in matches.collect()} == {(0, 1), (1, 0)}
    got = counts(scoring.matched_counts(truth, found, matches, "doc", scoring.formulas_of("formula1", "formula2")), "doc")
    assert got == {("d",): (3, 2, 2), ("e",): (0, 0, 1), ("f",): (0, 1, 0)}


def test_steps_of_one_document():
    step = lambda kind, **fields: (kind, fields)
    one = {"names": ["product one"], "ccdc": "1", "steps": [step("Add", chemicals=["a", "b"], amount="1"), step("Heat", t="5"), step("Stir", d="2")]}
    same = scoring.step_counts([one], [one])
    assert same == (5, 0, 0)  # two names, an amount, and two fields
    other = {"names": ["the product one x"], "ccdc": "", "steps": [step("Stir", d="2"), step("Add", chemicals=["b", "c"], amount="1"), step("Heat", t="6"), step("Dry", p="1")]}
    # Add takes the Add; one step is taken, so Heat takes place 2 or later: Heat (wrong value); Stir then takes Dry
    assert scoring.step_counts([one], [other]) == (1 + 1, 1 + 1 + 1, 1 + 1 + 1)
    assert scoring.step_counts([one], [other], in_order=False) == (1 + 1 + 1, 1 + 1, 1 + 1)
    by_number = {"names": ["z"], "ccdc": "1", "steps": [step("Heat", t="5")]}
    assert scoring.step_counts([{**one, "names": ["i"]}], [{**other, "names": ["xi"]}, by_number], in_order=False) == (1, 2 + 1 + 1 + 1 - 1, 2 + 1 + 1)
    assert scoring.step_counts([], [by_number]) == (0, 1, 0) and scoring.step_counts([by_number], []) == (0, 0, 1)


def test_steps(spark):
    schema = "doc string, i int, names array<string>, ccdc string, steps array<struct<type:string,chemicals:array<string>,fields:map<string,string>>>"
    rows = [("d", 0, ["product"], "1", [("Add", ["a"], {"x": "1"}), ("Heat", None, {"t": "5"})]), ("e", 0, None, None, None)]
    truth = spark.createDataFrame(rows, schema)
    found = spark.createDataFrame([("d", 0, ["product"], "2", [("Add", ["a"], {"x": "2"}), ("Heat", None, {"t": "5"})]), ("f", 0, ["q"], "", [("Stir", [], {"d": "1"})])], schema)
    assert counts(scoring.step_scores(truth, found, "doc"), "doc") == {("d",): (2, 1, 1), ("e",): (0, 0, 0), ("f",): (0, 1, 0)}


def test_differences_and_names(spark):
    schema = "k int, a string, b string"
    found = scoring.differences(spark.createDataFrame([(1, "x", "y"), (2, "p", None)], schema), spark.createDataFrame([(1, "x", "z"), (3, "q", None)], schema), ["k"], ["a", "b"])
    assert {(r["k"], r["field"]): (r["truth"], r["found"]) for r in found.collect()} == {(1, "b"): ("y", "z"), (2, "a"): ("p", None), (3, "a"): (None, "q")}
    steps = spark.createDataFrame([([("Add", ["a", "b"]), ("Heat", []), ("Add", [])],)], "s array<struct<type:string,chemicals:array<string>>>")
    assert steps.select(scoring.step_names(F.col("s"))).first()[0] == ["Add", "Add", "Heat", "Add"]


def test_small_rules(spark):
    one = spark.createDataFrame([(["u", " "], "m", "o", " A-b,  C "), (None, "m", "", None), ([""], "", "o", "x")], "units array<string>, metal string, organic string, title string")
    assert [r[0] for r in one.select(records.units_of(F.col("units"), F.col("metal"), F.col("organic"))).collect()] == [["u"], ["m"], ["o"]]
    assert [r[0] for r in one.select(records.plain_title(F.col("title"))).collect()] == ["a b c", "", "x"]
    index = spark.createDataFrame([(i,) for i in (-1, 0, 1, 2, 3)], "i int")
    assert [r[0] for r in index.select(records.at_index(F.array(F.lit("a"), F.lit("b")), F.col("i"))).collect()] == [None, "a", "a", "b", None]
    with pytest.raises(ValueError):
        records.keyed(one, ["metal"], "title", "middle")


def test_scoreboard(spark):
    part = lambda *r: spark.createDataFrame(list(r), "doc string, tp int, fp int, fn int")
    found = scoring.scoreboard({"a": part(("x", 1, 0, 1), ("y", 1, 1, 0), ("x", 1, 0, 0)), "b": part(("x", 0, 0, 0), ("z", 9, 9, 9))}, "doc", only=["x", "y"])
    rows = {(r["category"], r["doc"]): (r["tp"], r["fp"], r["fn"], r["f1"]) for r in found.collect()}
    assert rows == {("a", "x"): (2, 0, 1, 0.8), ("a", "y"): (1, 1, 0, pytest.approx(2 / 3)), ("b", "x"): (0, 0, 0, 0.0), ("a", "Overall"): (3, 1, 1, 0.75), ("b", "Overall"): (0, 0, 0, 0.0), (None, "Overall"): (3, 1, 1, 0.75)}
    text = "| Document | TP | FP | FN | P |\n|---|---|---|---|---|\n| d1 | 3 | 1 | 0 | 0.7 |\n| **Overall** | 3 | 1 | 0 | 0.7 |\n"
    got = listing.report_rows(spark.createDataFrame([("r", text)], "doc string, text string"))
    assert sorted(map(tuple, got.collect())) == [("r", "Overall", 3, 1, 0), ("r", "d1", 3, 1, 0)]


def test_normal_records(spark):
    one = spark.createDataFrame([(([("Water", "5 Milliliters")], "Room Temperature", ""),)], "r struct<chemicals:array<struct<chemicalName:string,chemicalAmount:string>>,temperature:string,comment:string>")
    r = one.select(records.normal_record(F.col("r"), one.schema["r"].dataType).alias("r")).first()["r"]
    plain = spark.createDataFrame([("Water", "5 Milliliters", "Room Temperature")], "n string, a string, t string").select(text.substance(F.col("n")), text.normal_amount(F.col("a")), text.normal_value(F.col("t"))).first()
    assert (r["chemicals"][0]["chemicalName"], r["chemicals"][0]["chemicalAmount"], r["temperature"], r["comment"]) == (*plain, "")
    assert plain[0] == "h2o"


def test_ontology(spark):
    schema = "class string, parent string, property string, kind string, range string, least int, most int, exactly int"
    rows = spark.createDataFrame([("c:A", None, "c:p", "datatype", "x:int", 1, 2, None), ("c:B", "c:A", "c:q", "object", "c:A", None, None, None)], schema)
    found = {(r["s"].split(":")[-1][:1], r["p"].split("#")[-1], r["o"].split("#")[-1][:9]) for r in graphs.ontology(rows).collect()}
    assert {("A", "type", "Class"), ("B", "subClassOf", "c:A"), ("p", "type", "DatatypeP"), ("q", "range", "c:A"), ("r", "minCardinality", "1"), ("r", "maxCardinality", "2"), ("r", "onProperty", "c:p")} <= found
    assert graphs.ontology(rows).where("p like '%subClassOf' and o_kind = 'bnode'").count() == 1
    with pytest.raises(Exception, match="an exact number and a bound"):
        graphs.ontology(spark.createDataFrame([("c:A", None, "c:p", "object", None, 1, None, 1)], schema)).collect()


def test_kept_tables(spark, tmp_path):
    path, made = str(tmp_path / "index"), []
    make = lambda: made.append(1) or spark.range(len(made))
    long_ago, soon = datetime.datetime(2000, 1, 1), datetime.datetime.now() + datetime.timedelta(hours=1)
    sizes = [tables.kept_current(make, path, when, force).count() for when, force in ((None, False), (None, False), (long_ago, False), (soon, False), (None, True))]
    assert sizes == [1, 1, 1, 2, 3] and len(made) == 3
    with pytest.raises(ValueError):
        listing.top_entities(spark.createDataFrame([], "entity string, label string"))
    assert listing.top_entities(spark.createDataFrame([("http://x/a", None)], "entity string, label string")).first()["label"] == "a"
    scores = grounding.compared(spark.createDataFrame([("CCO",)], "query string"), spark.createDataFrame([("CCO",), ("CCN",), ("cco",)], "label string"), 0.6, "structure")
    assert {r["label"]: round(r["score"], 3) for r in scores.collect()} == {"CCO": 1.0, "CCN": 0.667}


def test_greedy_folds(spark):
    """Ties by larger right, then larger left; missing and undefined scores last; columns and their order stay."""
    rows = [(1, 1, 1, 0.5, "a"), (1, 1, 2, 0.5, "b"), (1, 2, 2, 0.5, "c"), (1, 2, 1, None, "d"), (1, 3, 3, float("nan"), "e"), (1, 3, 1, 0.1, "f"), (2, 1, 1, 9.0, "g")]
    pairs = spark.createDataFrame(rows, "k long, t int, f int, score double, note string")
    found = scoring.greedy(pairs, ["k"], "score", "t", "f")
    assert found.columns == pairs.columns and found.dtypes == pairs.dtypes
    assert sorted(r["note"] for r in found.collect()) == ["a", "c", "e", "g"]
    assert "Pandas" not in found._jdf.queryExecution().toString()  # no Python worker for each document


def test_missing_values_equal_none(spark):
    t = spark.createDataFrame([(1, 1), (1, 1), (1, None), (None, 5)], "k int, v int")
    f = spark.createDataFrame([(1, 1), (1, None), (None, 5), (2, 7)], "k int, v int")
    counts = {r["k"]: (r["tp"], r["fp"], r["fn"]) for r in scoring.multisets(t, f, ["k"], "v").collect()}
    assert counts == {1: (1, 1, 2), 2: (0, 1, 0), None: (0, 1, 1)}
    counts = {r["k"]: (r["tp"], r["fp"], r["fn"]) for r in scoring.sets(t, f, ["k"], "v").collect()}
    assert counts == {1: (1, 1, 1), 2: (0, 1, 0), None: (0, 1, 1)}


def test_compared_rows_are_spread(spark, monkeypatch):
    """A task compares a bounded number of rows, so its tables do not grow with the input."""
    from triplespan.plans import tables

    seen = []
    monkeypatch.setattr(scoring, "spread", lambda df, *by: seen.append(tables.spread(df, *by, rows=10).rdd.getNumPartitions()) or tables.spread(df, *by))
    rows = spark.range(500).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    assert scoring.sets(rows, rows, ["k"], "v").agg(F.sum("tp")).first()[0] == 500 and seen == [100]
