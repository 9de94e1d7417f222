"""Patterns are asked again within what their partners allow, and give the rows that stored triples give."""

import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from triplespan.operators import documents, graphs, named
from triplespan.plans.patterns import TYPE, Graph, derived, either, ends_of, exists, first_hit, having, joined, least, not_exists, optional, picked
from triplespan.queries.syntheses import STEP_KEY, view
from triplespan.sources.mapping import Entity, MappedGraph, given

L = "rdfs:label"


@pytest.fixture(scope="module")
def mapped(spark, tmp_path_factory):
    """A few line items share all parts of their key; an entity that is said to be unique must be."""
    folder = tmp_path_factory.mktemp("tables")
    for name in ("region", "nation", "customer", "supplier", "part", "orders"):
        (folder / f"{name}.parquet").symlink_to(f"{SMALL}/{name}.parquet")
    items = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    items.dropDuplicates(list(STEP_KEY)).write.parquet(str(folder / "lineitem.parquet"))
    return view(spark, str(folder))


@pytest.fixture(scope="module")
def stored(spark, mapped, tmp_path_factory):
    """The same graph as one table of triples, of which nothing is known."""
    path = str(tmp_path_factory.mktemp("stored") / "triples")
    mapped.triples.distinct().write.parquet(path)
    return Graph(spark.read.parquet(path), mapped.prefixes)


def scans(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("FileScan")


def rows(df):
    columns = sorted(df.columns)
    return sorted((tuple(map(str, r)) for r in df.select(*columns).collect()))


@pytest.mark.parametrize("query", [named.recipe, named.step_index, named.vessels, named.temperatures, named.building_units, named.inheritance, named.transferred_amounts, documents.step_dump, documents.outputs, documents.step_fields, documents.procedures, documents.units_document])
def test_rows_of_stored_triples(mapped, stored, query):
    found = rows(query(mapped))
    assert found and found == rows(query(stored))


@pytest.mark.parametrize(("query", "most"), [(named.recipe, 9), (named.step_index, 4), (named.vessels, 8), (named.temperatures, 6), (documents.step_fields, 8), (documents.step_type, 2)])
def test_few_scans(mapped, query, most):
    assert scans(query(mapped)) <= most


def test_graph_wide_queries_read_a_table_twice(mapped):
    tables = len({(e.table, e.unique) for e in mapped.entities})
    assert scans(graphs.subject_dump(mapped.triples)) <= 2 * tables
    only_types = scans(mapped.triples.where(F.col("p") == TYPE))
    assert only_types <= len({e.table for e in mapped.entities if e.typed or e.classes})
    nothing = mapped.triples.where(F.col("p") == "http://example.org/none")
    assert scans(nothing) == 0 and nothing.count() == 0


def test_labels_come_from_the_tables_of_their_subjects(mapped):
    everywhere = mapped.match("?chemical", L, "?label")
    here = optional(mapped.match("?synthesis", "syn:hasChemicalInput", "?chemical"), everywhere)
    assert scans(everywhere) == 7 and scans(here) == 2  # seven tables have labels
    assert ends_of(here)["chemical"] == {"syn/Chemical"} and ends_of(here)["label"] == {"literal"}


def test_other_operations_forget(mapped):
    """A union by hand of solutions with different ends is not narrowed by the first one's."""
    chemicals = mapped.match("?_s", "syn:hasChemicalInput", "?x").select("x")
    mops = mapped.match("?x", "a", "mop:MetalOrganicPolyhedron").select("x")
    both = optional(chemicals.union(mops).distinct(), mapped.match("?x", L, "?label"))
    assert ends_of(chemicals.union(mops)) == {}
    assert both.where("x like '%Polyhedron%' and label is not null").count() == mops.distinct().count()


def test_unions_allow_what_any_branch_does(mapped):
    chemicals = picked(mapped.match("?_s", "syn:hasChemicalInput", "?x"), "x")
    mops = picked(mapped.match("?x", "a", "mop:MetalOrganicPolyhedron"), "x")
    both = either(chemicals, mops)
    assert ends_of(both)["x"] == {"syn/Chemical", "mop/MetalOrganicPolyhedron"}
    assert ends_of(either(chemicals, mops.where("x is not null"))) == {}
    found = optional(both, mapped.match("?x", L, "?label")).where("label is not null").select("x").distinct()
    assert found.where("x like '%Polyhedron%'").count() == mops.count() and found.where("x like '%Chemical/%'").count() > 0
    assert ends_of(first_hit(["x"], chemicals, mops))["x"] == ends_of(both)["x"]


def test_an_unbound_variable_does_not_narrow(mapped):
    """A branch that lacks a variable leaves it unbound; an optional that binds it again may be of any kind."""
    known = picked(mapped.match("?step", "syn:hasAddedChemicalInput", "?x"), "step", "x")
    unknown = picked(mapped.match("?step", "syn:hasVessel", "?_v"), "step")
    vessel = mapped.match("?step", "syn:hasVessel", "?x")
    found = optional(either(known, unknown), vessel, rebind=["x"])
    assert found.where("x like '%Vessel%'").count() == unknown.count()


def test_smallest_values_are_narrowed_by_their_key_only(spark, tmp_path):
    spark.range(3).selectExpr("id as k", "concat('v', id) as v").write.parquet(str(tmp_path / "t.parquet"))
    g = MappedGraph(spark, str(tmp_path), [Entity("t", "A", ("k",), {"p": "v"}, {"p": ("B", ("k",))}), Entity("t", "B", ("k",), {}, {"q": ("B", ("k",))})])
    smallest = least(g.match("?s", "ex:p", "?o"), "s", "o")
    assert set(ends_of(smallest)) == {"s"}
    assert joined(smallest, g.match("?o", "ex:q", "?_x")).count() == 3  # IRIs are smaller than v0, v1, v2
    values = derived(g.match("?s", "ex:p", "?o"), lambda df: df.groupBy("s").agg(F.max("o").alias("o")), ["s"])
    assert joined(values, g.match("?o", "ex:q", "?_x")).count() == 0


def test_semi_and_anti_joins(mapped, stored):
    for g in (mapped, stored):
        labelled, steps = g.match("?step", L, "?_l"), picked(g.match("?_s", "syn:hasSynthesisStep", "?step"), "step")
        assert exists(steps, labelled).count() + not_exists(steps, labelled).count() == steps.count()
    assert scans(exists(steps_of(mapped), mapped.match("?step", L, "?_l"))) == 2


def steps_of(g):
    return picked(g.match("?_s", "syn:hasSynthesisStep", "?step"), "step")


def test_conditions_stay_when_asked_again(mapped):
    types = having(mapped.match("?step", "a", "?type"), F.col("type").endswith("Add"))
    found = joined(steps_of(mapped), types)
    assert {r["type"] for r in found.select("type").distinct().collect()} == {mapped.prefixes["syn"] + "Add"}
    assert not re.search("customer", found._jdf.queryExecution().sparkPlan().toString())


def test_nothing_can_meet(mapped):
    """Solutions that cannot meet are an empty plan with all columns."""
    none = joined(mapped.match("?x", "syn:hasVessel", "?v"), mapped.match("?v", "om:hasNumericalValue", "?n"))
    assert none.columns == ["v", "x", "n"] and none.count() == 0 and scans(none) <= 1
    kept = optional(mapped.match("?x", "syn:hasVessel", "?v"), mapped.match("?v", "om:hasNumericalValue", "?n"))
    assert scans(kept) == 1 and kept.where("n is not null").count() == 0 < kept.count()


@pytest.mark.parametrize(("query", "most"), [(named.durations, 2), (named.temperatures, 2), (documents.step_order, 1), (documents.step_dump, 20)])
def test_facts_of_one_row_are_read_together(mapped, query, most):
    """Steps, what they lead to in their own row, and the values and units of that are one scan of line items."""
    found = query(mapped)
    assert scans(found) <= most
    assert found._jdf.queryExecution().sparkPlan().toString().count("lineitem") <= 3


def test_a_row_is_told_by_its_own_keys_only(spark, tmp_path):
    """A reference to another row of the same table is joined; one to the same row is read with it, where its condition holds."""
    spark.createDataFrame([(1, 2, "a"), (2, 1, "b"), (3, 3, None)], "k int, other int, v string").write.parquet(str(tmp_path / "t.parquet"))
    entities = [Entity("t", "A", ("k",), {}, {"own": ("B", given("k < 3", "k")), "far": ("B", ("other",))}), Entity("t", "B", ("k",), {"v": "v"})]
    g = MappedGraph(spark, str(tmp_path), entities)
    kept = Graph(g.triples, g.prefixes)
    for p in ("ex:own", "ex:far"):
        for join in (joined, optional):
            assert rows(join(g.match("?a", p, "?b"), g.match("?b", "ex:v", "?v"))) == rows(join(kept.match("?a", p, "?b"), kept.match("?b", "ex:v", "?v")))
    assert scans(joined(g.match("?a", "ex:own", "?b"), g.match("?b", "ex:v", "?v"))) == 1 and scans(joined(g.match("?a", "ex:far", "?b"), g.match("?b", "ex:v", "?v"))) == 2
