"""Changed documents, on the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplespan.queries.registry import on_tables
from triplespan.sources import changes


@on_tables("""WITH p AS (SELECT l_orderkey AS k, l_linenumber || ':' || l_partkey || ':' || l_suppkey AS name, CAST(l_quantity AS VARCHAR) AS v, CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN l_linestatus || '!' ELSE CAST(l_quantity AS VARCHAR) END AS w FROM lineitem),
a AS (SELECT k, string_agg(name || '=' || v, ',' ORDER BY name, v) AS d FROM p WHERE k % 10 <> 1 GROUP BY k), b AS (SELECT k, string_agg(name || '=' || w, ',' ORDER BY name, w) AS d FROM p WHERE k % 10 <> 2 GROUP BY k)
SELECT coalesce(a.k, b.k) AS doc, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'gone' ELSE 'changed' END AS kind FROM a FULL JOIN b ON a.k = b.k WHERE a.d IS DISTINCT FROM b.d""")
def changed_documents(table) -> DataFrame:
    """Orders as documents of their lines, before and after: some lines edited, some orders new, some gone."""
    lines = table("lineitem")
    name = F.concat_ws(":", "l_linenumber", "l_partkey", "l_suppkey")
    quantity = F.col("l_quantity").cast("string")
    edited = F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45), F.concat("l_linestatus", F.lit("!"))).otherwise(quantity)
    side = lambda rest, content: changes.digests(lines.where(F.col("l_orderkey") % 10 != rest), "l_orderkey", name, content)
    return changes.changes(side(1, quantity), side(2, edited))
