"""Rewritten steps and recovered records, on the tables; the SQL spells each out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplespan.operators import listing, steps
from triplespan.queries.registry import on_tables

MODE = "CASE l_suppkey % 4 WHEN 0 THEN 'AIR' WHEN 1 THEN 'REG AIR' WHEN 2 THEN 'TRUCK' ELSE 'SHIP' END"


@on_tables(f"""WITH s AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_tax) AS i, l_returnflag AS r, l_linestatus AS ls, {MODE} AS m,
CAST(l_partkey AS VARCHAR) AS a, CAST(l_suppkey AS VARCHAR) AS b, CAST(l_linenumber AS VARCHAR) AS c, l_tax FROM lineitem JOIN (SELECT DISTINCT o_orderkey FROM orders WHERE lower(o_orderpriority) NOT LIKE '%urgent%') o ON l_orderkey = o_orderkey WHERE l_returnflag = 'A' OR l_returnflag = 'R' OR {MODE} <> 'TRUCK'),
d AS (SELECT l_orderkey, i, CASE WHEN r = 'N' THEN 'Stir' ELSE 'Add' END AS type, CASE WHEN m IN ('AIR', 'REG AIR') THEN 'n/a' ELSE m END AS atmosphere,
CASE r WHEN 'R' THEN CASE WHEN l_tax > 0.04 THEN [a, b, c] ELSE [] END WHEN 'A' THEN CASE WHEN ls = 'F' THEN [a, b] ELSE [a] END END AS chem, CASE WHEN r = 'R' THEN 'converted from dissolve: ' || CASE WHEN ls = 'F' THEN 'n/a' ELSE m END WHEN ls <> 'F' THEN m END AS note FROM s),
x AS (SELECT *, coalesce(len(chem), 0) AS n, unnest(range(1, greatest(coalesce(len(chem), 0), 1) + 1)) AS j FROM d)
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY i, j) AS place, type, atmosphere, CASE WHEN n > 1 THEN chem[j] ELSE array_to_string(chem, ' ') END AS chemicals, CASE WHEN n > 1 THEN 'split ' || j || '/' || n || ': ' || coalesce(note, '') ELSE note END AS comment FROM x""")
def rewritten_steps(table) -> DataFrame:
    """Orders as syntheses, line items as steps: without urgent ones and stirring on trucks, dissolving becomes adding, and
    each chemical is added by itself."""
    kind = F.when(F.col("l_returnflag") == "R", "Dissolve").when(F.col("l_returnflag") == "A", "Add").otherwise("Stir")
    part, supplier, line = (F.col(c).cast("string") for c in ("l_partkey", "l_suppkey", "l_linenumber"))
    final = F.col("l_linestatus") == "F"
    carrier = F.expr(MODE)
    mode = F.when(carrier == "REG AIR", "air").otherwise(carrier)
    step = F.struct(
        kind.alias("type"), mode.alias("atmosphere"), F.when(kind == "Add", F.when(final, F.array(part, supplier)).otherwise(F.array(part))).alias("addedChemical"),
        F.when((kind == "Dissolve") & (F.col("l_tax") > 0.04), F.array(part, supplier, line)).alias("solvent"), F.when(~final, carrier).alias("comment"),
    )
    placed = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_tax", step.alias("step"))
    listed = table("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(placed)).alias("steps"))
    kept = steps.without_product(table("orders").select("o_orderkey", F.array("o_orderpriority", "o_orderstatus").alias("productNames")), "Urgent")
    rules = steps.dropped(lambda s: (s["type"] == "Stir") & (s["atmosphere"] == "TRUCK")), steps.replaced("atmosphere", "Air", "n/a"), steps.converted(), steps.split()
    made = listed.join(kept, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", F.transform("steps", lambda s: s["step"]).alias("steps"))
    each = made.select("l_orderkey", F.posexplode(steps.rewritten(F.col("steps"), *rules)).alias("at", "s"))
    return each.select("l_orderkey", (F.col("at") + 1).alias("place"), "s.type", "s.atmosphere", F.array_join("s.addedChemical", " ").alias("chemicals"), "s.comment")


@on_tables("""SELECT o_orderkey AS i, o_orderpriority || ' {' || o_orderstatus AS name, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE CAST(o_orderdate AS DATE)::VARCHAR END AS role FROM orders WHERE o_custkey % 5 <> 0
UNION ALL SELECT o_orderkey, 'second', 'r"}' FROM orders WHERE o_custkey % 5 <> 0 OR o_custkey % 2 = 0
UNION ALL SELECT o_orderkey, o_orderstatus, 'lost' FROM orders WHERE o_custkey % 5 = 0 AND o_custkey % 2 = 1""")
def recovered_records(table) -> DataFrame:
    """Two objects joined without a comma, braces and quotes in their strings; in some texts the first one is cut, in others
    neither is whole."""
    key = F.col("o_custkey")
    cut, lost = key % 5 == 0, (key % 5 == 0) & (key % 2 == 1)
    role = F.when(key % 3 == 0, "").otherwise(F.concat(F.lit(', "role": "'), F.to_date("o_orderdate").cast("string"), F.lit('"')))
    first = F.concat(F.lit('{"name": "'), "o_orderpriority", F.lit(" {"), "o_orderstatus", F.lit('"'), role, F.lit("}"))
    first = F.when(cut, F.lit('{"name": "fir')).otherwise(first)
    pair = F.concat(first, F.lit("\n"), F.lit('{"more": [{"n": 1}], "name": "second", "role": "r\\"}"}'))
    text = F.when(lost, F.concat(F.lit('{"name": "'), "o_orderstatus", F.lit('", "role": "lost" '))).otherwise(pair)
    text = F.when(key % 7 == 0, F.concat(F.lit("Answer {\n```json\n"), text, F.lit("\n```\n}"))).otherwise(text)
    found = table("orders").select("o_orderkey", F.explode(listing.recovered_records(text)).alias("r"))
    return found.select(F.col("o_orderkey").alias("i"), "r.name", "r.role")
