"""Graph patterns over the star schema's graph view; the SQL asks the tables directly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplespan.operators import graphs, grounding, integration, named
from triplespan.plans.patterns import LABEL, TYPE, ask, construct, either, ends_of, exists, first_hit, joined, lit, local_name, not_exists, optional, ordered, page, rendered, with_parameters
from triplespan.queries.registry import on_graph, on_tables
from triplespan.sources.mapping import BASE, MappedGraph

L = "rdfs:label"


@on_graph("""SELECT c_name AS customer, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def bgp_chain(g: MappedGraph) -> DataFrame:
    return g.bgp(("?c", "a", "ex:Customer"), ("?c", "ex:inNation", "?n"), ("?n", "ex:inRegion", "?r"), ("?c", L, "?customer"), ("?n", L, "?nation"), ("?r", L, "?region")).select("customer", "nation", "region")


@on_graph("""SELECT 'http://example.org/Part/' || p_partkey AS part, p_name AS label, p_brand AS brand FROM part WHERE p_size = 15""")
def bgp_star(g: MappedGraph) -> DataFrame:
    return g.bgp(("?part", L, "?label"), ("?part", "ex:brand", "?brand"), ("?part", "ex:size", lit("15")))


@on_graph("""SELECT 'http://example.org/Document/' || d.doc_id AS doc, lang AS language, CAST(quality AS VARCHAR) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def optional_labels(g: MappedGraph) -> DataFrame:
    return optional(g.match("?doc", "ex:language", "?language"), g.match("?doc", "ex:quality", "?quality"))


@on_graph("""SELECT 'http://example.org/Order/' || o_orderkey AS "order", 'http://example.org/LineItem/' || x.l_orderkey || '-' || x.l_partkey || '-' || x.l_suppkey || '-' || x.l_linenumber AS item, x.p AS part
FROM orders LEFT JOIN (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'http://example.org/Part/' || l_partkey END AS p FROM lineitem WHERE l_quantity > 45) x ON o_orderkey = l_orderkey""")
def optional_nested(g: MappedGraph) -> DataFrame:
    returned = g.bgp(("?item", "ex:flag", lit("R")), ("?item", "ex:ofPart", "?part")).select("item", "part")
    items = g.bgp(("?item", "ex:ofOrder", "?order"), ("?item", "ex:quantity", "?q")).where("cast(q AS double) > 45").drop("q")
    return optional(g.match("?order", "ex:status", "?_s").drop("_s"), optional(items, returned))


@on_graph("""WITH a AS (SELECT d.doc_id, CAST(quality AS VARCHAR) AS v FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
b AS (SELECT doc_id, CAST(toxic AS VARCHAR) AS w FROM labels UNION ALL SELECT doc_id, '7' FROM documents WHERE doc_id % 3 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels))
SELECT 'http://example.org/Document/' || a.doc_id AS doc, coalesce(v, w) AS value FROM a LEFT JOIN b ON a.doc_id = b.doc_id AND (v IS NULL OR v = w)""")
def optional_rebind(g: MappedGraph) -> DataFrame:
    first = optional(g.match("?doc", "ex:language", "?_l").drop("_l"), g.match("?doc", "ex:quality", "?value"))
    unlabelled = g.match("?doc", "ex:language", "?_l").drop("_l").where(F.element_at(F.split("doc", "/"), -1).cast("long") % 3 == 0)
    other = not_exists(unlabelled, g.match("?doc", "ex:quality", "?_q").select("doc")).withColumn("value", F.lit("7"))
    return optional(first, g.match("?doc", "ex:toxic", "?value").unionByName(other), rebind=["value"])


@on_graph("""SELECT 'customer' AS role, c_name AS label, CAST(NULL AS VARCHAR) AS region FROM customer UNION ALL SELECT 'supplier', s_name, NULL FROM supplier
UNION ALL SELECT 'nation', n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey""")
def union_roles(g: MappedGraph) -> DataFrame:
    of = lambda kind, role: g.bgp(("?x", "a", kind), ("?x", L, "?label")).select(F.lit(role).alias("role"), "label")
    nations = g.bgp(("?n", L, "?label"), ("?n", "ex:inRegion", "?r"), ("?r", L, "?region")).select(F.lit("nation").alias("role"), "label", "region")
    return either(of("ex:Customer", "customer"), of("ex:Supplier", "supplier"), nations).select("role", "label", "region")


@on_graph("""SELECT 'http://example.org/LineItem/' || l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS item, x AS target FROM lineitem, LATERAL (SELECT 'http://example.org/Part/' || l_partkey AS x UNION ALL SELECT 'http://example.org/Supplier/' || l_suppkey)""")
def alternative_predicates(g: MappedGraph) -> DataFrame:
    return g.match("?item", ["ex:ofPart", "ex:bySupplier"], "?target")


@on_graph("""SELECT c_name AS customer, CAST(o_orderkey AS VARCHAR) AS urgent FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT'""")
def optional_filter(g: MappedGraph) -> DataFrame:
    urgent = g.bgp(("?o", "ex:placedBy", "?c"), ("?o", "ex:priority", "?p")).where("p = '1-URGENT'").select("c", local_name("o").alias("urgent"))
    return optional(g.bgp(("?c", "a", "ex:Customer"), ("?c", L, "?customer")), urgent).select("customer", "urgent")


@on_graph("""SELECT 'http://example.org/Order/' || o_orderkey AS "order" FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def exists_semi(g: MappedGraph) -> DataFrame:
    return exists(g.match("?order", "ex:status", "?_s").drop("_s"), g.match("?_i", "ex:ofOrder", "?order").select("order"))


@on_graph("""SELECT 'http://example.org/Order/' || o_orderkey AS "order" FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def not_exists_anti(g: MappedGraph) -> DataFrame:
    return not_exists(g.match("?order", "ex:status", "?_s").drop("_s"), g.match("?_i", "ex:ofOrder", "?order").select("order"))


@on_graph("""SELECT c_name AS customer FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def not_exists_filtered(g: MappedGraph) -> DataFrame:
    urgent = g.bgp(("?o", "ex:placedBy", "?c"), ("?o", "ex:priority", lit("1-URGENT"))).select("c")
    return not_exists(g.bgp(("?c", "a", "ex:Customer"), ("?c", L, "?customer")), urgent).select("customer")


@on_graph("""SELECT p_name AS label, p_brand AS brand FROM part WHERE contains(lower(p_name), 'red')""")
def filter_contains(g: MappedGraph) -> DataFrame:
    return g.bgp(("?p", L, "?label"), ("?p", "ex:brand", "?brand")).where(F.lower("label").contains("red")).select("label", "brand")


@on_graph("""SELECT DISTINCT p_name AS label FROM part WHERE NOT starts_with(p_name, 'a') AND length(p_name) > 0""")
def filter_strstarts(g: MappedGraph) -> DataFrame:
    return g.bgp(("?p", "a", "ex:Part"), ("?p", L, "?label")).where(~F.col("label").startswith("a") & (F.length("label") > 0)).select("label").distinct()


@on_graph("""SELECT 'http://example.org/Document/' || d.doc_id AS doc, coalesce('q' || quality, source) AS best, 'document' AS kind FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def bind_coalesce(g: MappedGraph) -> DataFrame:
    found = optional(g.match("?doc", "ex:origin", "?origin"), g.match("?doc", "ex:quality", "?q"))
    return found.select("doc", F.coalesce(F.concat(F.lit("q"), "q"), "origin").alias("best"), F.lit("document").alias("kind"))


@on_graph("""SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS priority FROM orders""")
def select_distinct(g: MappedGraph) -> DataFrame:
    return g.bgp(("?o", "ex:status", "?status"), ("?o", "ex:priority", "?priority")).select("status", "priority").distinct()


@on_graph("""SELECT s_name AS supplier, count(DISTINCT l_partkey) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name""")
def count_distinct_group(g: MappedGraph) -> DataFrame:
    return g.bgp(("?i", "ex:bySupplier", "?s"), ("?i", "ex:ofPart", "?p"), ("?s", L, "?supplier")).groupBy("supplier").agg(F.count_distinct("p").alias("n"))


@on_graph("""SELECT p_name AS label, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name""")
def count_solutions_group(g: MappedGraph) -> DataFrame:
    return g.bgp(("?i", "ex:ofPart", "?p"), ("?p", L, "?label")).groupBy("label").agg(F.count("i").alias("n"))


@on_graph("""SELECT count(DISTINCT o_custkey) AS n_customers, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'no such flag') AS n_none FROM orders""")
def count_distinct_global(g: MappedGraph) -> DataFrame:
    n = g.match("?_o", "ex:placedBy", "?c").agg(F.count_distinct("c").alias("n_customers"))
    none = g.match("?i", "ex:flag", lit("no such flag")).agg(F.count("*").alias("n_none"))
    return n.withColumn("k", F.lit(1)).join(none.withColumn("k", F.lit(1)), "k").drop("k")


@on_graph("""SELECT 'http://example.org/Order/' || l_orderkey AS "order", min(l_quantity) AS least, min(lower(l_returnflag)) AS flag FROM lineitem GROUP BY l_orderkey""")
def min_group(g: MappedGraph) -> DataFrame:
    found = g.bgp(("?i", "ex:ofOrder", "?order"), ("?i", "ex:quantity", "?q"), ("?i", "ex:flag", "?f"))
    return found.groupBy("order").agg(F.min(F.expr("try_cast(q AS double)")).alias("least"), F.min(F.lower("f")).alias("flag"))


@on_graph("""SELECT 'http://example.org/Part/' || p_partkey AS part, p_retailprice AS price FROM part ORDER BY p_retailprice DESC, part LIMIT 25""")
def order_numeric(g: MappedGraph) -> DataFrame:
    return ordered(g.match("?part", "ex:price", "?p").select("part", F.expr("try_cast(p AS double)").alias("price")), ["price"], "desc", 25)


@on_graph("""SELECT 'http://example.org/Document/' || d.doc_id AS doc, CAST(quality AS VARCHAR) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY quality ASC NULLS FIRST, doc LIMIT 40""")
def order_unbound_first(g: MappedGraph) -> DataFrame:
    return ordered(optional(g.match("?doc", "ex:language", "?_l").drop("_l"), g.match("?doc", "ex:quality", "?quality")), ["quality"], "asc", 40)


@on_graph("""SELECT p_name AS label, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name ORDER BY n DESC, label LIMIT 20""")
def topk_usage(g: MappedGraph) -> DataFrame:
    counted = g.bgp(("?i", "ex:ofPart", "?p"), ("?p", L, "?label")).groupBy("label").agg(F.count("i").alias("n"))
    return ordered(counted, ["n"], "desc", 20)


@on_graph("""SELECT s_name AS supplier, n_regionkey AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def path_two_hop(g: MappedGraph) -> DataFrame:
    return g.bgp(("?s", L, "?supplier"), ("?s", "ex:inNation", "?n"), ("?n", "ex:inRegion", "?r"), ("?s", "a", "ex:Supplier")).select("supplier", local_name("r").cast("int").alias("region"))


@on_graph("""SELECT count(*) > 0 AS answer FROM orders WHERE o_orderpriority = '1-URGENT'""")
def ask_pattern(g: MappedGraph) -> DataFrame:
    return ask(g.match("?o", "ex:priority", lit("1-URGENT")))


@on_graph("""SELECT 'http://example.org/Nation/' || n_nationkey AS s, 'http://example.org/within' AS p, 'http://example.org/Region/' || n_regionkey AS o, 'iri' AS o_kind FROM nation
UNION SELECT 'http://example.org/Customer/' || c_custkey, 'http://example.org/within', 'http://example.org/Region/' || n_regionkey, 'iri' FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION SELECT 'http://example.org/Region/' || r_regionkey, 'http://www.w3.org/2000/01/rdf-schema#label', r_name, 'lit' FROM region""")
def construct_two_hop(g: MappedGraph) -> DataFrame:
    found = g.bgp(("?c", "ex:inNation", "?n"), ("?c", "a", "ex:Customer"), ("?n", "ex:inRegion", "?r"), ("?r", L, "?name"))
    every = either(found, g.bgp(("?n", "ex:inRegion", "?r"), ("?r", L, "?name")))
    return construct(every, ("?n", BASE + "within", "?r", "iri"), ("?c", BASE + "within", "?r", "iri"), ("?r", LABEL, "?name", "lit"))


@on_graph("""SELECT s, p, o FROM (SELECT 'http://example.org/Nation/' || n_nationkey AS s, unnest([['http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://example.org/Nation'],
['http://www.w3.org/2000/01/rdf-schema#label', n_name], ['http://example.org/inRegion', 'http://example.org/Region/' || n_regionkey]]) AS x, x[1] AS p, x[2] AS o FROM nation)""")
def variable_predicate(g: MappedGraph) -> DataFrame:
    return g.bgp(("?s", "a", "ex:Nation"), ("?s", "?p", "?o"))


@on_graph("""SELECT c_name AS customer, o_orderkey AS "order", segment FROM (VALUES ('BUILDING'), ('MACHINERY')) v(segment) JOIN customer ON c_mktsegment = segment JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F'""")
def parameter_join(g: MappedGraph) -> DataFrame:
    found = g.bgp(("?c", "ex:segment", "?segment"), ("?c", L, "?customer"), ("?o", "ex:placedBy", "?c"), ("?o", "ex:status", lit("F")))
    return with_parameters(found, g.spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "segment string")).select("customer", local_name("o").cast("long").alias("order"), "segment")


@on_graph("""SELECT 'http://example.org/Supplier/' || s_suppkey AS s, s_name AS label FROM supplier WHERE s > 'http://example.org/Supplier/3' ORDER BY s LIMIT 7""")
def keyset_page(g: MappedGraph) -> DataFrame:
    return page(g.bgp(("?s", "a", "ex:Supplier"), ("?s", L, "?label")), "s", BASE + "Supplier/3", 7)


@on_graph("""SELECT (SELECT count(*) FROM customer) AS n_customer, (SELECT count(*) FROM supplier) AS n_supplier, (SELECT count(*) FROM part) AS n_part, (SELECT count(*) FROM orders) AS n_order, (SELECT count(*) FROM lineitem) AS n_item""")
def kg_statistics(g: MappedGraph) -> DataFrame:
    kinds = {"Customer": "n_customer", "Supplier": "n_supplier", "Part": "n_part", "Order": "n_order", "LineItem": "n_item"}
    return named.distinct_counts({n: g.match("?x", "a", f"ex:{k}") for k, n in kinds.items()})


@on_graph("""SELECT 'http://example.org/' || k AS class, n FROM (SELECT 'Region' AS k, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer
UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'LineItem', count(*) FROM lineitem UNION ALL SELECT 'Document', count(*) FROM documents)""")
def class_histogram(g: MappedGraph) -> DataFrame:
    return graphs.class_histogram(g.rows([TYPE], [("?s", "a", "?o")], 0))


#: All triples of the star schema as one relation x (s, p, o, k).
TRIPLES = f"""WITH x AS (SELECT * FROM (
SELECT '{BASE}Region/' || r_regionkey AS s, v.* FROM region, LATERAL (VALUES ('{TYPE}', '{BASE}Region', 'iri'), ('{LABEL}', CAST(r_name AS VARCHAR), 'lit')) v(p, o, k)
UNION ALL SELECT '{BASE}Nation/' || n_nationkey AS s, v.* FROM nation, LATERAL (VALUES ('{TYPE}', '{BASE}Nation', 'iri'), ('{LABEL}', CAST(n_name AS VARCHAR), 'lit'), ('{BASE}inRegion', '{BASE}Region/' || n_regionkey, 'iri')) v(p, o, k)
UNION ALL SELECT '{BASE}Customer/' || c_custkey AS s, v.* FROM customer, LATERAL (VALUES ('{TYPE}', '{BASE}Customer', 'iri'), ('{LABEL}', CAST(c_name AS VARCHAR), 'lit'), ('{BASE}balance', CAST(c_acctbal AS VARCHAR), 'lit'), ('{BASE}segment', CAST(c_mktsegment AS VARCHAR), 'lit'), ('{BASE}inNation', '{BASE}Nation/' || c_nationkey, 'iri')) v(p, o, k)
UNION ALL SELECT '{BASE}Supplier/' || s_suppkey AS s, v.* FROM supplier, LATERAL (VALUES ('{TYPE}', '{BASE}Supplier', 'iri'), ('{LABEL}', CAST(s_name AS VARCHAR), 'lit'), ('{BASE}balance', CAST(s_acctbal AS VARCHAR), 'lit'), ('{BASE}inNation', '{BASE}Nation/' || s_nationkey, 'iri')) v(p, o, k)
UNION ALL SELECT '{BASE}Part/' || p_partkey AS s, v.* FROM part, LATERAL (VALUES ('{TYPE}', '{BASE}Part', 'iri'), ('{LABEL}', CAST(p_name AS VARCHAR), 'lit'), ('{BASE}brand', CAST(p_brand AS VARCHAR), 'lit'), ('{BASE}kind', CAST(p_type AS VARCHAR), 'lit'), ('{BASE}size', CAST(p_size AS VARCHAR), 'lit'), ('{BASE}price', CAST(p_retailprice AS VARCHAR), 'lit')) v(p, o, k)
UNION ALL SELECT '{BASE}Order/' || o_orderkey AS s, v.* FROM orders, LATERAL (VALUES ('{TYPE}', '{BASE}Order', 'iri'), ('{BASE}status', CAST(o_orderstatus AS VARCHAR), 'lit'), ('{BASE}total', CAST(o_totalprice AS VARCHAR), 'lit'), ('{BASE}priority', CAST(o_orderpriority AS VARCHAR), 'lit'), ('{BASE}placedBy', '{BASE}Customer/' || o_custkey, 'iri')) v(p, o, k)
UNION ALL SELECT '{BASE}LineItem/' || l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS s, v.* FROM lineitem, LATERAL (VALUES ('{TYPE}', '{BASE}LineItem', 'iri'), ('{BASE}quantity', CAST(l_quantity AS VARCHAR), 'lit'), ('{BASE}discount', CAST(l_discount AS VARCHAR), 'lit'), ('{BASE}flag', CAST(l_returnflag AS VARCHAR), 'lit'), ('{BASE}ofOrder', '{BASE}Order/' || l_orderkey, 'iri'), ('{BASE}ofPart', '{BASE}Part/' || l_partkey, 'iri'), ('{BASE}bySupplier', '{BASE}Supplier/' || l_suppkey, 'iri')) v(p, o, k)
UNION ALL SELECT '{BASE}Document/' || doc_id AS s, v.* FROM documents, LATERAL (VALUES ('{TYPE}', '{BASE}Document', 'iri'), ('{BASE}language', CAST(lang AS VARCHAR), 'lit'), ('{BASE}origin', CAST(source AS VARCHAR), 'lit'), ('{BASE}length', CAST(n_chars AS VARCHAR), 'lit')) v(p, o, k)
UNION ALL SELECT '{BASE}Document/' || doc_id AS s, v.* FROM labels, LATERAL (VALUES ('{BASE}quality', CAST(quality AS VARCHAR), 'lit'), ('{BASE}toxic', CAST(toxic AS VARCHAR), 'lit')) v(p, o, k)
) WHERE s IS NOT NULL AND o IS NOT NULL)
"""  # noqa: S608


@on_graph(TRIPLES + f"SELECT c.o AS class, x.p, count(*) AS n FROM x JOIN x c ON c.s = x.s AND c.p = '{TYPE}' WHERE x.p <> '{TYPE}' GROUP BY 1, 2")
def predicate_usage(g: MappedGraph) -> DataFrame:
    return graphs.predicate_usage(g.triples)


@on_graph(TRIPLES + f"SELECT o AS class, min(s) AS s FROM x WHERE p = '{TYPE}' GROUP BY o")
def sample_per_class(g: MappedGraph) -> DataFrame:
    return graphs.class_samples(g.triples)


@on_graph(TRIPLES + f""", c AS (SELECT min(s) AS centre FROM x WHERE p = '{TYPE}' GROUP BY o),
h AS (SELECT centre, x.* FROM c JOIN x ON s = centre UNION SELECT centre, x.* FROM c JOIN x ON o = centre AND k = 'iri'), n AS (SELECT centre, s AS node FROM h UNION SELECT centre, o FROM h WHERE k = 'iri')
SELECT centre, s, p, o FROM h UNION SELECT centre, s, p, o FROM n JOIN x ON s = node UNION SELECT centre, s, p, o FROM n JOIN x ON o = node AND k = 'iri'""")
def sample_neighbourhood(g: MappedGraph) -> DataFrame:
    return graphs.neighbourhood(graphs.together(*g.subjects()), graphs.class_samples(g.triples)).select("centre", "s", "p", "o")


@on_graph(TRIPLES + f""", c AS (SELECT o AS class, min(s) AS centre, count(*) AS n FROM x WHERE p = '{TYPE}' GROUP BY o),
h AS (SELECT centre, x.* FROM c JOIN x ON s = centre UNION SELECT centre, x.* FROM c JOIN x ON o = centre AND k = 'iri'), m AS (SELECT centre, s AS node FROM h UNION SELECT centre, o FROM h WHERE k = 'iri'),
near AS (SELECT centre, s, p, o, k FROM h UNION SELECT centre, s, p, o, k FROM m JOIN x ON s = node UNION SELECT centre, s, p, o, k FROM m JOIN x ON o = node AND k = 'iri'), sizes AS (SELECT centre, count(*) AS n_triples FROM near GROUP BY centre)
SELECT class, n, c.centre AS sample, n_triples FROM c JOIN sizes USING (centre)""")
def class_report(g: MappedGraph) -> DataFrame:
    return integration.class_report(g.triples, distinct=graphs.together(*g.subjects()))


@on_graph(TRIPLES + "SELECT s, count(*) AS n_facts, arg_min(p, (p, o)) AS first_p FROM (SELECT DISTINCT s, p, o FROM x) GROUP BY s")
def subject_dump(g: MappedGraph) -> DataFrame:
    whole, others = g.subjects()
    return graphs.subject_dump(others, whole).select("s", F.size("facts").alias("n_facts"), F.get("facts", F.lit(0))["p"].alias("first_p"))


@on_graph("""SELECT 'http://example.org/Order/' || o_orderkey AS s, 'http://example.org/status' AS p, o_orderstatus AS o FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'http://example.org/LineItem/' || l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber, 'http://example.org/ofOrder', 'http://example.org/Order/' || l_orderkey FROM lineitem""")
def orphan_prune(g: MappedGraph) -> DataFrame:
    triples = g.rows([BASE + "status", BASE + "ofOrder"], [("?s", ["ex:status", "ex:ofOrder"], "?o")], 0)
    return graphs.without_orphans(triples).select("s", "p", "o")


LINKED = ("Nation", "Customer", "Order", "LineItem")


@on_graph(TRIPLES + f""", n AS (SELECT DISTINCT s FROM x WHERE p = '{TYPE}' AND o IN ({', '.join(f"'{BASE}{c}'" for c in LINKED)}))
SELECT DISTINCT s, p, o FROM x WHERE s IN (SELECT s FROM n) AND (p IN ('{TYPE}', '{LABEL}') OR k = 'iri' AND o IN (SELECT s FROM n))""")
def link_subgraph(g: MappedGraph) -> DataFrame:
    whole, others = g.subjects()
    nodes = frozenset().union(*(ends_of(g.match("?s", "a", f"ex:{c}"))["s"] for c in LINKED))
    edges = ends_of(g.match("?s", "?p", "?o", ends={"s": nodes, "o": nodes}))
    return graphs.linked(others, [BASE + c for c in LINKED], whole=whole, kinds={"s": nodes, "o": edges["o"]}).select("s", "p", "o")


REGIONAL = """WITH m AS (SELECT n_nationkey AS k, 'http://example.org/Nation/' || min(n_nationkey) OVER (PARTITION BY n_regionkey) AS iri FROM nation)"""


def _by_region(g: MappedGraph) -> DataFrame:
    """Maps each nation to the first one of its region."""
    edges = g.match("?s", "ex:inRegion", "?r").withColumn("n", local_name("s").cast("int"))
    first = edges.groupBy("r").agg(F.min_by("s", "n").alias("iri"))
    return edges.join(first, "r").select("s", "iri")


@on_graph(REGIONAL + """ SELECT DISTINCT 'http://example.org/Supplier/' || s_suppkey AS s, 'http://example.org/inNation' AS p, iri AS o FROM supplier JOIN m ON s_nationkey = k""")
def replace_grounding(g: MappedGraph) -> DataFrame:
    edges = g.rows([BASE + "inNation"], [("?s", "ex:inNation", "?o"), ("?s", "a", "ex:Supplier")], 0)
    return grounding.replaced(edges, _by_region(g)).select("s", "p", "o")


@on_graph(REGIONAL + """ SELECT 'http://example.org/Nation/' || k AS s, 'http://www.w3.org/2002/07/owl#sameAs' AS p, iri AS o FROM m WHERE iri <> 'http://example.org/Nation/' || k
UNION ALL SELECT 'http://example.org/Nation/' || n_nationkey, 'http://www.w3.org/2000/01/rdf-schema#label', n_name FROM nation""")
def sameas_grounding(g: MappedGraph) -> DataFrame:
    labels = g.rows([LABEL], [("?s", L, "?o"), ("?s", "a", "ex:Nation")], 0)
    return grounding.with_same_as(labels, _by_region(g)).select("s", "p", "o")


@on_tables("""SELECT 'd' || doc_id AS s, 'd' || first AS iri FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents) WHERE doc_id <> first""")
def canonical_merge(table) -> DataFrame:
    name = lambda c: F.lpad(c.cast("string"), 20, "0")  # noqa: E731 - so that the smallest name is that of the smallest id
    digest = F.coalesce(F.sha2("text", 256), F.lit("no text"))
    facts = table("documents").select(name(F.col("doc_id")).alias("s"), F.lit("text").alias("p"), digest.alias("o"), F.lit("lit").alias("o_kind"))
    short = lambda c: F.concat(F.lit("d"), F.col(c).cast("long").cast("string"))
    return grounding.canonical(facts).select(short("s").alias("s"), short("iri").alias("iri"))


@on_graph("""SELECT DISTINCT 'http://example.org/Nation/' || n_nationkey AS s, CASE WHEN n_regionkey = 1 THEN 'changed' ELSE n_name END AS o FROM nation""")
def set_single_value(g: MappedGraph) -> DataFrame:
    labels = g.rows([LABEL], [("?s", L, "?o"), ("?s", "a", "ex:Nation")], 0)
    new = g.match("?s", "ex:inRegion", "ex:Region/1").select("s", F.lit(LABEL).alias("p"), F.lit("changed").alias("o"), F.lit("lit").alias("o_kind"))
    return graphs.with_value(labels, new).select("s", "o")


@on_graph("""SELECT 'http://example.org/Customer/' || c_custkey AS s, 'http://example.org/Nation/' || c_nationkey AS o FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 2""")
def entity_delete(g: MappedGraph) -> DataFrame:
    edges = g.rows([BASE + "inNation"], [("?s", "ex:inNation", "?o"), ("?s", "a", "ex:Customer")], 0)
    return graphs.without_entities(edges, g.match("?s", "ex:inRegion", "ex:Region/2").select("s")).select("s", "o")


@on_graph("""SELECT 'http://example.org/Customer/' || c_custkey AS s, c_mktsegment AS o FROM customer WHERE c_mktsegment <> 'BUILDING'""")
def triple_delete(g: MappedGraph) -> DataFrame:
    rows = g.rows([BASE + "segment"], [("?s", "ex:segment", "?o")], 0)
    return graphs.without_triples(rows, rows.where("o = 'BUILDING'"), by_value=True).select("s", "o")


@on_graph("""SELECT 'http://example.org/Supplier/' || s_suppkey || '/Session' AS s, s_name AS o FROM supplier""")
def add_children(g: MappedGraph) -> DataFrame:
    parents = g.bgp(("?s", "a", "ex:Supplier"), ("?s", L, "?name"))
    return graphs.children(parents, BASE + "hasSession", "Session", {BASE + "note": "name"}).where(F.col("p") == BASE + "note").select("s", "o")


@on_graph("""SELECT 'http://example.org/Order/' || o_orderkey AS s, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 'item' ELSE o_orderstatus END AS value FROM orders""")
def fallback_chain(g: MappedGraph) -> DataFrame:
    items = g.match("?_i", "ex:ofOrder", "?s").select("s").distinct().withColumn("value", F.lit("item"))
    return first_hit(["s"], items, g.match("?s", "ex:status", "?value")).select("s", "value")


@on_graph("""SELECT 'Supplier#' || s_suppkey AS label, '\t' AS sep, s_name || chr(9) || coalesce(CAST(NULL AS VARCHAR), 'None') AS line FROM supplier""")
def rendered_rows(g: MappedGraph) -> DataFrame:
    found = optional(g.bgp(("?s", "a", "ex:Supplier"), ("?s", L, "?name")), g.match("?s", "ex:segment", "?segment"))
    lines = rendered(found.select("name", "segment"))
    key = joined(found.select("s", "name"), lines.select(F.substring_index("line", "\t", 1).alias("name"), "line"))
    return key.select(F.concat(F.lit("Supplier#"), local_name("s")).alias("label"), F.lit("\t").alias("sep"), "line")


@on_graph("""SELECT 'http://example.org/Customer/' || c_custkey AS s, c_name AS label FROM customer UNION ALL SELECT 'http://example.org/Order/' || o_orderkey, CAST(o_orderkey AS VARCHAR) FROM orders""")
def labels_or_names(g: MappedGraph) -> DataFrame:
    """Customers have labels, orders have none."""
    return graphs.labels_or_names(g.triples, BASE + "Customer").union(graphs.labels_or_names(g.triples, BASE + "Order"))
