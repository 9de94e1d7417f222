"""What rows of a table lead to is joined by the keys in the row: same rows, and no texts of steps are shuffled."""

import re

import pytest

from triplespan.operators import documents
from triplespan.plans import patterns
from triplespan.plans.patterns import Graph, keyed, led, optional, optional_fact, parts_of
from triplespan.queries.syntheses import STEP_KEY, view
from triplespan.sources.mapping import Entity, MappedGraph, given

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def mapped(spark, tmp_path_factory):
    """A view whose line items have keys of their own, as entities that are said to be unique must."""
    folder = tmp_path_factory.mktemp("tables")
    for name in ("region", "nation", "customer", "supplier", "part", "orders"):
        (folder / f"{name}.parquet").symlink_to(f"{SMALL}/{name}.parquet")
    spark.read.parquet(f"{SMALL}/lineitem.parquet").dropDuplicates(list(STEP_KEY)).write.parquet(str(folder / "lineitem.parquet"))
    return view(spark, str(folder))


@pytest.fixture(scope="module")
def stored(spark, mapped, tmp_path_factory):
    """The same graph as one table of triples, which goes the general way."""
    path = str(tmp_path_factory.mktemp("stored") / "triples")
    mapped.triples.distinct().write.parquet(path)
    return Graph(spark.read.parquet(path), mapped.prefixes)


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect())


@pytest.fixture(params=["few", "many"])
def few(request, spark, monkeypatch):
    """Tables beside steps are broadcast, or none is."""
    if request.param == "many":
        monkeypatch.setattr(patterns, "FEW", 0)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield request.param
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("query", [documents.step_dump, documents.step_fields, documents.step_type, documents.steps_document])
def test_rows_of_stored_triples(mapped, stored, few, query):
    found = rows(query(mapped))
    assert found and found == rows(query(stored))


def test_a_dump_is_dealt_once(spark, mapped, monkeypatch):
    """Chemicals are joined once by the key in the row for all four predicates, before any text of a step is made."""
    monkeypatch.setattr(patterns, "FEW", 0)
    found = plan(documents.step_dump(mapped))
    keys = re.findall(r"Join LeftOuter, .*?\((\w+)#\d+L? = _way", found)
    assert keys.count("l_partkey") == 1 == found.count("Relation [p_partkey") and "http" not in "".join(x for x in found.split("\n") if "Join" in x)


def test_facts_by_key(spark, tmp_path):
    """Of a variable that is not bound, or leads to no row, or whose keys are no whole numbers, nothing or all is joined as before."""
    spark.createDataFrame([(1, 2, 7, "a"), (2, 2, None, "b"), (3, 9, 8, "c")], "k int, far long, odd int, word string").write.parquet(str(tmp_path / "t.parquet"))
    spark.createDataFrame([(2, "two"), (7, "seven"), (8, None)], "k long, v string").write.parquet(str(tmp_path / "u.parquet"))
    spark.createDataFrame([("a", "of a"), ("c", "of c")], "w string, v string").write.parquet(str(tmp_path / "w.parquet"))
    entities = [
        Entity("t", "A", ("k",), {}, {"far": ("B", ("far",)), "some": ("B", given("k <> 1", "far")), "odd": ("B", ("odd",)), "word": ("W", ("word",))}),
        Entity("u", "B", ("k",), {"v": "v"}), Entity("w", "W", ("w",), {"v": "v"}),
    ]
    g = MappedGraph(spark, str(tmp_path), entities)
    for p, ways in (("ex:far", 1), ("ex:some", 1), ("ex:odd", 1), ("ex:word", 0)):
        a, b = g.match("?a", p, "?b"), g.match("?b", "ex:v", "?v")
        found = optional_fact(a, b, "b")
        assert rows(found) == rows(optional(a, b)) and (len(parts_of(found)) == 1 and len(parts_of(found)[0].ways) == 1) == bool(ways)
    both = g.match("?a", "ex:far", "?b")
    facts = keyed(g.match("?x", "ex:v", "?v", ends={"x": frozenset({"B"})}), "x")
    for name in ("v1", "v2"):
        both = led(both, "b", facts._replace(rows=facts.rows.withColumnRenamed("v", name)))
    assert len(parts_of(both)[0].ways) == 1 and {tuple(r) for r in both.select("v1", "v2").collect()} == {("two", "two"), (None, None)}


def test_steps_of_a_synthesis_are_dealt_as_columns(spark, mapped, monkeypatch):
    """What is dealt by synthesis are columns of line items, not the fields of a step."""
    monkeypatch.setattr(patterns, "FEW", 0)
    found = plan(documents.steps_document(mapped))
    above, below = found.split("RepartitionByExpression [_by")
    assert "usedVesselName" in above and "usedVesselName" not in below


def test_outputs_are_shuffled_once(spark, mapped, monkeypatch):
    """Rows of orders are dealt once by customer for each kind of output, and once by synthesis; procedures not at all."""
    monkeypatch.setattr(patterns, "FEW", 0)
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges(documents.procedures(mapped)) == 0
        found = documents.outputs(mapped)._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning\(o_custkey", found)) == 2 and len(re.findall(r"Exchange hashpartitioning\(synthesis", found)) == 1
        assert "Exchange hashpartitioning(output" not in found and "Exchange hashpartitioning(mop" not in found
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
