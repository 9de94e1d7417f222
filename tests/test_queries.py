"""Every registered query outside of the corpus operators gives the rows of its SQL, and there are some."""

import pytest
from oracle import connection, compare
from triplespan.catalog import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.01"
#: Labels of nations are no part of part names in these tables.
MAY_BE_EMPTY = set()


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_of_sql(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), ORACLE_SQL[name], con) > 0 or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_greedy_matches_all_lines(spark):
    """Every line of every order is matched, once on each side."""
    folder = "/root/testdata/sf0.001"
    found = QUERIES["greedy_matches"](spark, folder).select("k", "t", "f").collect()
    want = {tuple(r) for r in spark.read.parquet(f"{folder}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct().collect()}
    assert max(n for _, n in want) > 3 and len(found) == len(want)
    assert {(r["k"], r["t"]) for r in found} == {(r["k"], r["f"]) for r in found} == want
