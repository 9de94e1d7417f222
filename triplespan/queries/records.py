"""Record keys, win rules, walks over nested values, and record scores, on the tables; the SQL spells each out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplespan.operators import records, scoring
from triplespan.queries.registry import on_tables
from triplespan.queries.tables import SETS, _pairs

KEY = "CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'NAME:' || o_orderpriority END ELSE CAST(o_custkey AS VARCHAR) END"


def _keyed_orders(table) -> DataFrame:
    status = F.col("o_orderstatus")
    names = F.when(F.col("o_orderpriority") != "5-LOW", F.array(F.concat(F.lit(" "), "o_orderpriority")))
    ccdc = F.when(status == "P", " N/A ").otherwise(F.col("o_custkey").cast("string"))
    return table("orders").select(records.record_key(ccdc, names).alias("key"), F.col("o_orderkey").alias("i"), status.alias("status"))


@on_tables(f"WITH {SETS} SELECT k, tp, CASE WHEN tp > 0 THEN 0 ELSE fp END AS fp, fn FROM c")
def fair_set_scores(table) -> DataFrame:
    return scoring.fair_sets(*_pairs(table), ["k"], "v")


@on_tables(f"SELECT {KEY} AS key, min(o_orderkey) AS i, arg_min(o_orderstatus, o_orderkey) AS status FROM orders WHERE {KEY} IS NOT NULL GROUP BY 1")
def keyed_first(table) -> DataFrame:
    return records.keyed(_keyed_orders(table), ["key"], "i", "first")


@on_tables(f"SELECT {KEY} AS key, max(o_orderkey) AS i, arg_max(o_orderstatus, o_orderkey) AS status FROM orders WHERE {KEY} IS NOT NULL GROUP BY 1")
def keyed_last(table) -> DataFrame:
    return records.keyed(_keyed_orders(table), ["key"], "i", "last")


@on_tables(f"SELECT {KEY} AS key, string_agg(o_orderkey || o_orderstatus, ' ' ORDER BY o_orderkey) AS listed FROM orders WHERE {KEY} IS NOT NULL GROUP BY 1")
def grouped_records(table) -> DataFrame:
    found = records.grouped(_keyed_orders(table), ["key"], "i")
    return found.select("key", F.array_join(F.transform("records", lambda r: F.concat(r["i"].cast("string"), r["status"])), " ").alias("listed"))


@on_tables("""WITH a AS (SELECT o_custkey AS key, unnest([o_orderstatus, 'n/a', o_orderpriority]) AS v FROM orders), b AS (SELECT o_custkey AS key, unnest([' ', CASE WHEN o_totalprice > 300000 THEN 'big' ELSE 'NA' END]) AS v FROM orders)
SELECT key, coalesce((SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT v FROM a WHERE a.key = k.key AND v <> 'n/a')), '') AS names, coalesce((SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT v FROM b WHERE b.key = k.key AND v = 'big')), '') AS formulas FROM (SELECT DISTINCT o_custkey AS key FROM orders) k""")
def pooled_sets(table) -> DataFrame:
    size = F.when(F.col("o_totalprice") > 300000, "big").otherwise("NA")
    found = records.pooled(table("orders").withColumnRenamed("o_custkey", "key"), ["key"], names=F.array("o_orderstatus", F.lit("n/a"), "o_orderpriority"), formulas=F.array(F.lit(" "), size))
    return found.select("key", F.array_join("names", "|").alias("names"), F.array_join("formulas", "|").alias("formulas"))


@on_tables("""SELECT o_orderkey AS i, o_orderstatus AS v FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus <> 'F'""")
def preferred_rows(table) -> DataFrame:
    orders = table("orders")
    first = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("i"), F.col("o_orderstatus").alias("v"))
    return records.preferred(first, orders.select(F.col("o_orderkey").alias("i"), F.col("o_orderpriority").alias("v")), ["i"])


def _nested(table) -> DataFrame:
    """A record for each line item: a number, a list of two structs, and a map."""
    parts = F.array(F.struct(F.col("l_returnflag").alias("name"), F.col("l_linenumber").alias("n")), F.struct(F.col("l_linestatus").alias("name"), F.lit(0).alias("n")))
    record = F.struct(F.col("l_suppkey").alias("z"), parts.alias("parts"), F.create_map(F.lit("kind"), F.concat(F.lit('a"'), "l_returnflag")).alias("more"), F.col("l_linestatus").alias("a"))
    return table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", record.alias("r"))


ITEM = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


@on_tables(f"""SELECT {ITEM}, '{{"a":"' || l_linestatus || '","more":{{"kind":"a\\"' || l_returnflag || '"}},"parts":[' || least(x, y) || ',' || greatest(x, y) || '],"z":' || l_suppkey || '}}' AS text
FROM (SELECT *, '{{"n":' || l_linenumber || ',"name":"' || l_returnflag || '"}}' AS x, '{{"n":0,"name":"' || l_linestatus || '"}}' AS y FROM lineitem)""")
def canonical_text(table) -> DataFrame:
    rows = _nested(table)
    return rows.select(*rows.columns[:4], records.canonical_json(F.col("r"), rows.schema["r"].dataType).alias("text"))


@on_tables(f"SELECT {ITEM}, l_returnflag || ' ' || l_linestatus || ' ' || l_linestatus AS found FROM lineitem")
def gathered_fields(table) -> DataFrame:
    rows = _nested(table)
    return rows.select(*rows.columns[:4], F.array_join(records.gathered(F.col("r"), rows.schema["r"].dataType, ["name", "a", "absent"]), " ").alias("found"))


@on_tables(f"SELECT {ITEM}, lower(l_returnflag) || lower(l_linestatus) || ' a\"' || l_returnflag || ' ' AS changed FROM lineitem")
def walked_fields(table) -> DataFrame:
    """Names in lower case, field a blank, other strings as they are."""
    rows = _nested(table)
    kind = rows.schema["r"].dataType
    lower = records.walked(F.col("r"), kind, lambda name, x: F.lower(x) if name == "name" else x)
    r = records.blanked(F.col("w"), kind, ["a"])
    rows = rows.withColumn("w", lower).withColumn("w", r)
    return rows.select(*rows.columns[:4], F.concat(F.col("w.parts")[0]["name"], F.col("w.parts")[1]["name"], F.lit(" "), F.col("w.more")["kind"], F.lit(" "), F.col("w.a")).alias("changed"))


@on_tables("""SELECT p_partkey, 1 + (round(p_retailprice, 1) = p_retailprice)::INT + (p_size > 10)::INT - 1 AS tp, 1 AS fp, 2 - (round(p_retailprice, 1) = p_retailprice)::INT - (p_size > 10)::INT AS fn FROM part""")
def percent_scores(table) -> DataFrame:
    price, size = F.col("p_retailprice"), F.col("p_size").cast("double")
    t = F.create_map(F.lit("C"), price, F.lit("H"), size)
    f = F.create_map(F.lit("C"), F.round(price, 1), F.lit("N"), F.lit(1.0), F.lit("H"), F.when(F.col("p_size") > 10, size).otherwise(size + 1))
    counts = scoring.percent_counts(t, f)
    return table("part").select("p_partkey", *(counts[c].alias(c) for c in scoring.COUNTS))


RECORDS = """WITH t AS (SELECT c_custkey AS k, [c_mktsegment, 'X' || (c_nationkey % 3)] AS n, c_mktsegment AS a, CASE WHEN c_acctbal > 0 THEN CAST(c_nationkey AS VARCHAR) END AS b FROM customer),
f AS (SELECT CASE WHEN c_nationkey = 3 THEN c_custkey + 1000000 ELSE c_custkey END AS k, ['X' || (c_nationkey % 2), 'Y'] AS n, CASE WHEN c_nationkey < 10 THEN c_mktsegment END AS a, CAST(c_nationkey % 4 AS VARCHAR) AS b FROM customer WHERE c_nationkey <> 7),
j AS (SELECT coalesce(t.k, f.k) AS k, t.k IS NOT NULL AS it, f.k IS NOT NULL AS jf, t.n AS tn, f.n AS fn, t.a AS ta, f.a AS fa, t.b AS tb, f.b AS fb FROM t FULL JOIN f ON t.k = f.k),
h AS (SELECT *, CASE WHEN it AND jf AND list_contains(tn, fn[1]) THEN 1 ELSE 0 END AS hit FROM j)
"""


def _records(table) -> tuple[DataFrame, DataFrame]:
    c = table("customer")
    nation = F.col("c_nationkey")
    t = c.select(F.col("c_custkey").alias("k"), F.array("c_mktsegment", F.concat(F.lit("X"), nation % 3)).alias("n"), F.col("c_mktsegment").alias("a"), F.when(F.col("c_acctbal") > 0, nation.cast("string")).otherwise("").alias("b"))
    key = F.when(nation == 3, F.col("c_custkey") + 1000000).otherwise(F.col("c_custkey"))
    f = c.where(nation != 7).select(key.alias("k"), F.array(F.concat(F.lit("X"), nation % 2), F.lit("Y")).alias("n"), F.when(nation < 10, F.col("c_mktsegment")).alias("a"), (nation % 4).cast("string").alias("b"))
    return t, f


@on_tables(RECORDS + """SELECT k, (it AND jf)::BIGINT + hit + (ta IS NOT DISTINCT FROM fa)::INT + (tb IS NOT DISTINCT FROM fb)::INT AS tp, (NOT it)::BIGINT + (fa IS NOT NULL AND ta IS DISTINCT FROM fa)::INT + (fb IS NOT NULL AND tb IS DISTINCT FROM fb)::INT AS fp,
(NOT jf)::BIGINT + CASE WHEN it THEN 2 - hit ELSE 0 END + (ta IS NOT NULL AND ta IS DISTINCT FROM fa)::INT + (tb IS NOT NULL AND tb IS DISTINCT FROM fb)::INT AS fn FROM h""")
def record_scores(table) -> DataFrame:
    return scoring.record_scores(*_records(table), "k", "n", ["a", "b"])


@on_tables(RECORDS + """SELECT k, 'n' AS field, hit AS tp, CASE WHEN jf THEN 2 ELSE 0 END - hit AS fp, CASE WHEN it THEN 2 ELSE 0 END - hit AS fn FROM h
UNION ALL SELECT k, 'a', (ta IS NOT DISTINCT FROM fa)::INT, (fa IS NOT NULL AND ta IS DISTINCT FROM fa)::INT, (ta IS NOT NULL AND ta IS DISTINCT FROM fa)::INT FROM h
UNION ALL SELECT k, 'p', CASE WHEN coalesce(tb, fb) IS NULL THEN 1 ELSE coalesce(tb = fb, FALSE)::INT END, 0, CASE WHEN tb IS NULL THEN 0 ELSE (tb IS DISTINCT FROM fb)::INT END FROM h WHERE tb IS NOT NULL OR fb IS NULL
UNION ALL SELECT k, 'p', 0, 1, 0 FROM h WHERE tb IS NULL AND fb IS NOT NULL""")
def record_fields(table) -> DataFrame:
    t, f = _records(table)
    side = lambda df, m: df.select("k", F.col("n").alias(f"{m}_n"), F.col("a").alias(f"{m}_a"), F.nullif(F.col("b"), F.lit("")).alias(f"{m}_p_raw"), F.when(F.col("b") != "", F.create_map(F.lit("C"), F.col("b").cast("double"))).alias(f"{m}_p"))
    return scoring.record_fields(side(t, "t").join(side(f, "f"), "k", "full"), ["k"], "n", ["a"], ["p"])
