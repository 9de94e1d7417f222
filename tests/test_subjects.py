"""Neighbourhoods, dumps and links of graphs whose subjects are read from one row each: same rows, and no shuffle of the graph."""

import random

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from triplespan.catalog import QUERIES
from triplespan.operators import graphs
from triplespan.sources.mapping import BASE, MappedGraph

MEDIUM = "/root/testdata/sf0.01"


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


@pytest.mark.parametrize("most", [graphs.REACHED_BYTES, -1])
@pytest.mark.parametrize("hops", [1, 2, 3])
def test_neighbourhood(spark, monkeypatch, hops, most):
    """Against a loop, broadcast and not, with loops, literals that read like nodes, and centres without triples."""
    monkeypatch.setattr(graphs, "REACHED_BYTES", most)
    rng = random.Random(hops)
    nodes = [f"n{k}" for k in range(40)]
    triples = {(rng.choice(nodes), rng.choice("pq"), rng.choice(nodes), rng.choice(["iri", "iri", "lit", "bnode"])) for _ in range(60)} | {("n1", "p", "n1", "iri")}
    centres, want = ["n1", "n2", "n2", "absent"], set()
    for c in set(centres):
        reached, near = {c}, set()
        for _ in range(hops):
            near = {t for t in triples if t[0] in reached or t[3] != "lit" and t[2] in reached}
            reached = {t[0] for t in near} | {t[2] for t in near if t[3] != "lit"}
        want |= {(c, *t) for t in near}
    found = graphs.neighbourhood(spark.createDataFrame(list(triples), "s string, p string, o string, o_kind string"), spark.createDataFrame([(c,) for c in centres], "s string"), hops)
    assert rows(found) == sorted(want)


def shuffled(df):
    """The part of the plan below its last shuffles."""
    return "".join(df._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning")[1:])


def test_no_graph_is_shuffled(spark):
    """Where keys are unique, only documents, which two tables tell about, are shuffled."""
    for query in ("sample_neighbourhood", "subject_dump"):
        plan = shuffled(QUERIES[query](spark, MEDIUM))
        assert "documents.parquet" in plan and "lineitem.parquet" not in plan and "orders.parquet" not in plan


def test_rows_of_repeated_keys(spark):
    """A key of sf0.001 is there twice; its rows are told from the others."""
    g = MappedGraph(spark, SMALL)
    whole, others = g.subjects()
    n = g.table("lineitem").groupBy("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").count().where("count > 1").count()
    assert n and others.where(F.col("s").startswith(f"{BASE}LineItem/")).select("s").distinct().count() == n
    assert whole.count() == whole.select("s").distinct().count()
    assert rows(graphs.subject_dump(others, whole)) == rows(graphs.subject_dump(g.triples))
    assert rows(graphs.together(whole, others)) == rows(g.triples.distinct())


def test_links_of_rows(spark):
    g = MappedGraph(spark, SMALL)
    whole, others = g.subjects()
    for classes, through in ((["Nation", "Order"], None), (["Document", "LineItem", "Order"], {f"{BASE}ofOrder": f"{BASE}placedBy"})):
        classes = [BASE + c for c in classes]
        assert rows(graphs.linked(others, classes, through, whole)) == rows(graphs.linked(g.triples, classes, through))
    found = QUERIES["link_subgraph"](spark, SMALL)
    assert rows(found) == rows(graphs.linked(g.triples, [BASE + c for c in ("Nation", "Customer", "Order", "LineItem")]).select("s", "p", "o"))
    plan = QUERIES["link_subgraph"](spark, MEDIUM)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1  # the edges of all rows, with the nodes that they can lead to
