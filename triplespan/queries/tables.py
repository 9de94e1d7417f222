"""Text, formula, document, window and score operators over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplespan.functions import chemistry, text
from triplespan.operators import documents, grounding, listing, scoring
from triplespan.plans.patterns import local_name
from triplespan.plans.tables import spread
from triplespan.queries.registry import on_graph, on_tables
from triplespan.sources import rdf, tables
from triplespan.sources.mapping import BASE, MappedGraph
from triplespan.streaming import incremental

# texts


@on_tables("""SELECT p_partkey, trim(regexp_replace(lower('  ' || p_type || '  x '), '\\s+', ' ', 'g')) AS label, replace(lower(p_name), '_', ' ') AS match, trim(regexp_replace(regexp_replace(lower(p_name || ' & ' || p_type), '[^a-z0-9_-]+', '-', 'g'), '-+', '-', 'g'), '-') AS slug,
lower(p_brand) AS print FROM part""")
def normalize_labels(table) -> DataFrame:
    return table("part").select(
        "p_partkey",
        text.normal_label(F.concat(F.lit("  "), "p_type", F.lit("  x "))).alias("label"),
        text.match_label(F.col("p_name")).alias("match"),
        text.slug(F.col("p_name"), folded=F.lower(F.concat("p_name", F.lit(" & "), "p_type"))).alias("slug"),
        text.fingerprint(F.concat("p_brand", F.lit(" "))).alias("print"),
    )


@on_tables("""SELECT p_partkey, substr(sha256(p_name), 1, 8) AS key, lower(p_name[1]) || p_name[2:] AS camel, CASE WHEN p_size % 2 = 0 THEN (p_size // 2) || '%' ELSE (p_size // 2) || '.5%' END AS yield_text,
CASE WHEN p_partkey + 99990 > 99999 THEN ((p_partkey + 99990) // 10) || ' ' || ((p_partkey + 99990) % 10) ELSE CAST(p_partkey + 99990 AS VARCHAR) END AS deposit, '10.1021/' || p_partkey AS doi, 'http://example.org/a#' || p_partkey AS iri, true AS absolute FROM part""")
def normalize_identifiers(table) -> DataFrame:
    iri = F.concat(F.lit("http://example.org/a#"), F.col("p_partkey").cast("string"))
    return table("part").select(
        "p_partkey",
        text.document_key(F.col("p_name")).alias("key"),
        text.camel(F.col("p_name")).alias("camel"),
        text.yield_text(F.col("p_size") / 2).alias("yield_text"),
        text.deposit_number((F.col("p_partkey") + 99990).cast("string")).alias("deposit"),
        text.doi(F.concat(F.when(F.col("p_size") > 20, "10.1021_").otherwise("https://doi.org/10.1021/"), F.col("p_partkey").cast("string"))).alias("doi"),
        F.concat(F.lit("http://example.org/a#"), local_name(iri)).alias("iri"),
        text.is_absolute_iri(iri).alias("absolute"),
    )


@on_tables("""SELECT p_partkey, p_size || ' h' AS duration, (2 * p_size) || ' mmol, ' || p_size || ' g' AS amount, CASE p_partkey % 3 WHEN 0 THEN 'meoh' WHEN 1 THEN 'h2o' ELSE 'thf' END AS substance, '25 degree celsius' AS temperature, 'c' || p_size || '.5,h' || p_size AS percents,
'kbr' AS material, [1000 + p_size, 2000 + p_size] AS bands FROM part""")
def normalize_values(table) -> DataFrame:
    size = F.col("p_size").cast("string")
    return spread(table("part").select("p_partkey", "p_size")).select(
        "p_partkey",
        text.normal_value(F.concat(size, F.lit(".0  hours"))).alias("duration"),
        text.normal_amount(F.concat(size, F.lit(" g ("), (2 * F.col("p_size")).cast("string"), F.lit(" millimoles)"))).alias("amount"),
        text.substance(F.get(F.array(*map(F.lit, ("Methanol", " Water", "tetrahydrofuran"))), (F.col("p_partkey") % 3).cast("int"))).alias("substance"),
        text.normal_value(F.lit("Room temperature")).alias("temperature"),
        text.percent_text(F.concat(F.lit("C: "), size, F.lit(".5%; H "), size)).alias("percents"),
        text.material(F.lit("KBr pellets")).alias("material"),
        text.band_numbers(F.concat((1000 + F.col("p_size")).cast("string"), F.lit(", "), (2000 + F.col("p_size")).cast("string"), F.lit(".3 cm-1"))).alias("bands"),
    )


@on_tables("""WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda x: trim(x)), lambda x: x <> '')) AS s, generate_subscripts(list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda x: trim(x)), lambda x: x <> ''), 1) - 1 AS i FROM documents),
w AS (SELECT doc_id, i, s, string_agg(s, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS context FROM s) SELECT doc_id, CAST(i AS INT) AS i, md5(context) AS context FROM w WHERE contains(s, 'na')""")
def sentence_window(table) -> DataFrame:
    sentences = table("documents").select(F.col("doc_id").alias("doc"), F.posexplode(text.sentences(F.col("text"))).alias("i", "sentence")).withColumn("hit", F.col("sentence").contains("na"))
    return grounding.context(sentences).select(F.col("doc").alias("doc_id"), "i", F.md5(F.col("context").cast("binary")).alias("context"))


SECTIONS = """s AS (SELECT doc_id, unnest(string_split(text, '## ')[2:]) AS part, generate_subscripts(string_split(text, '## ')[2:], 1) AS idx FROM documents),
x AS (SELECT doc_id, idx, trim(split_part(part, chr(10), 1)) AS title, trim(CASE WHEN contains(part, chr(10)) THEN substr(part, strpos(part, chr(10)) + 1) ELSE '' END) AS content FROM s)"""


@on_tables(f"WITH {SECTIONS} SELECT doc_id, CAST(idx AS INT) AS idx, title, md5(content) AS content FROM x")
def section_split(table) -> DataFrame:
    found = documents.sections(table("documents").withColumnRenamed("doc_id", "doc"))
    return found.select(F.col("doc").alias("doc_id"), "idx", "title", F.md5(F.col("content").cast("binary")).alias("content"))


def _choices(table) -> tuple[DataFrame, DataFrame]:
    found = documents.sections(table("documents").withColumnRenamed("doc_id", "doc"))
    return found, found.where("idx % 3 > 0").select("doc", "idx", F.when(F.col("idx") % 3 == 1, "keep").otherwise("discard").alias("choice"))


@on_tables(f"""WITH {SECTIONS} SELECT doc_id, count(*) AS total, count(*) FILTER (idx % 3 > 0) AS classified, count(*) FILTER (idx % 3 = 1) AS keep, count(*) FILTER (idx % 3 = 2) AS discard,
round(100.0::DOUBLE * count(*) FILTER (idx % 3 > 0) / count(*), 1) AS percent FROM x GROUP BY doc_id""")
def section_status(table) -> DataFrame:
    return documents.section_status(documents.classified(*_choices(table))).withColumnRenamed("doc", "doc_id")


@on_tables(f"WITH {SECTIONS} SELECT doc_id, md5(string_agg('## ' || title || chr(10) || chr(10) || content, chr(10) || chr(10) ORDER BY idx)) AS text FROM x WHERE idx % 3 <> 2 GROUP BY doc_id")
def stitch_sections(table) -> DataFrame:
    return documents.stitched(documents.classified(*_choices(table))).select(F.col("doc").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("text"))


# formulas


@on_tables("""SELECT p_partkey, CASE WHEN p_size = 0 THEN '' ELSE 'C' || (p_size + 3) || 'H' || CASE WHEN 2 * p_size > 1 THEN CAST(2 * p_size AS VARCHAR) ELSE '' END || 'O6Cu' END AS formula,
round((p_size + 3) * 12.0107::DOUBLE + 2 * p_size * 1.00794::DOUBLE + 6 * 15.9994::DOUBLE + 63.546::DOUBLE, 4) AS weight FROM part""")
def formula_weight(table) -> DataFrame:
    size = F.col("p_size").cast("string")
    counts = chemistry.atoms(F.concat(F.lit("[CuC"), size, F.lit("H"), (2 * F.col("p_size")).cast("string"), F.lit("(CO2)3]")))
    return spread(table("part").select("p_partkey", "p_size")).select("p_partkey", chemistry.formula_and_weight(counts).alias("f")).select("p_partkey", "f.formula", "f.weight")


@on_tables("""SELECT p_partkey, CASE WHEN p_size = 10 THEN 10 ELSE CASE WHEN abs(p_size - 10) * 14.02658::DOUBLE / 140.2658 <= 0.003 THEN 4 WHEN abs(p_size - 10) * 14.02658::DOUBLE / 140.2658 <= 0.03 THEN 1 ELSE 0 END END AS score FROM part""")
def formula_score(table) -> DataFrame:
    of = lambda n: chemistry.atoms(F.concat(F.lit("(CH2)"), n.cast("string")))
    parts = spread(table("part").select("p_partkey", "p_size"))
    target = parts.sparkSession.range(1).select(chemistry.formula_and_weight(of(F.lit(10)))).scalar()  # once, and not once a row
    found = parts.select("p_partkey", chemistry.formula_and_weight(of(F.col("p_size"))).alias("f"), target.alias("t"))
    return found.select("p_partkey", chemistry.candidate_score(F.col("f.formula"), F.col("f.weight"), F.col("t.formula"), F.col("t.weight")).alias("score"))


@on_tables("""WITH u AS (SELECT p_partkey AS id, 2 + p_partkey % 4 AS a, 2 + p_size % 4 AS b, p_partkey % 3 = 0 AS flat_a, p_size % 3 <> 1 AS flat_b, p_size % 5 - 2 AS qa, p_partkey % 3 - 1 AS qb FROM part),
kinds AS (SELECT *, a || CASE WHEN a = 2 THEN '-linear' WHEN a IN (3, 4) AND flat_a THEN '-planar' ELSE '-pyramidal' END AS kind_a,
b || CASE WHEN b = 2 AND flat_b THEN '-linear' WHEN b = 2 THEN '-bent' WHEN b IN (3, 4) AND flat_b THEN '-planar' ELSE '-pyramidal' END AS kind_b FROM u),
m(model, kind_a, kind_b, n_a, n_b) AS (VALUES (0, '5-pyramidal', '2-linear', 12, 30), (1, '2-linear', '5-pyramidal', 30, 12), (2, '4-planar', '2-bent', 12, 24), (3, '2-bent', '4-planar', 24, 12), (4, '4-pyramidal', '3-planar', 6, 8), (5, '3-planar', '4-pyramidal', 8, 6), (6, '3-pyramidal', '4-planar', 6, 8), (7, '4-planar', '3-pyramidal', 8, 6))
SELECT id, model, n_a, n_b, n_a * a = n_b * b AS closes, '[A]' || n_a || '[B]' || n_b || CASE WHEN n_a * qa + n_b * qb = 0 THEN '' ELSE '^{' || abs(n_a * qa + n_b * qb) || CASE WHEN n_a * qa + n_b * qb > 0 THEN '+}' ELSE '-}' END END AS formula
FROM kinds JOIN m USING (kind_a, kind_b)""")
def assembly_closure(table) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    pairs = table("part").select(
        key.alias("id"), F.lit("[A]").alias("formula_a"), F.lit("[B]").alias("formula_b"), (size % 5 - 2).alias("charge_a"), (key % 3 - 1).alias("charge_b"), (2 + key % 4).alias("modularity_a"), (2 + size % 4).alias("modularity_b"),
        F.when(key % 4 == 0, "linear").when(key % 3 == 0, "planar").otherwise("pyramidal").alias("planarity_a"), F.when((size % 4 == 0) & (size % 3 != 1), "linear").when(size % 3 != 1, "Planar ").otherwise("pyramidal").alias("planarity_b"),
    )
    return chemistry.assembled(pairs).where("best").select("id", "model", "n_a", "n_b", "closes", "formula")


# labels


def part_labels(table) -> DataFrame:
    label = F.concat_ws(" ", "p_name", F.lower("p_type"), "p_brand")
    return table("part").select("p_partkey", F.concat(F.lit("i"), F.col("p_partkey").cast("string")).alias("iri"), label.alias("label"))


@on_tables()
def fuzzy_topk(table) -> DataFrame:
    """The five labels most like that of each part whose id is divisible by 100, of all parts but equal ones."""
    labels = part_labels(table)
    asked = labels.where("p_partkey % 100 = 0").select(F.reverse("label").alias("query")).unionByName(labels.where("p_partkey % 100 = 0").select(F.regexp_replace("label", "[aeiou]", "").alias("query")))
    return grounding.fuzzy(asked, labels.select("label"), cutoff=0.3, limit=5)


ASKED = """l AS (SELECT p_partkey, 'i' || p_partkey AS iri, p_name || ' ' || lower(p_type) || ' ' || p_brand AS label, lower(p_name || ' ' || p_type || ' ' || p_brand) AS name FROM part),
q AS (SELECT DISTINCT upper(label) AS query, name AS key FROM l WHERE p_partkey % 200 = 0 UNION SELECT DISTINCT substr(label, 3, 9), trim(substr(name, 3, 9)) FROM l WHERE p_partkey % 100 = 0 UNION SELECT DISTINCT substr(label, 1, 3), substr(name, 1, 3) FROM l WHERE p_partkey % 100 = 0)"""


@on_tables(f"""WITH {ASKED} SELECT query, iri, 100 AS score FROM q JOIN l ON name = key UNION ALL SELECT query, iri, 50 FROM q JOIN l ON contains(name, key) WHERE NOT EXISTS (SELECT 1 FROM l x WHERE x.name = key)""")
def label_lookup(table) -> DataFrame:
    """Whole labels, and parts of them, of parts whose id is divisible by 100, looked up among all parts."""
    labels = part_labels(table)
    hundredth = labels.where("p_partkey % 100 = 0")
    asked = labels.where("p_partkey % 200 = 0").select(F.upper("label").alias("query")).union(hundredth.select(F.substring("label", 3, 9))).union(hundredth.select(F.substring("label", 1, 3)))
    return grounding.by_label(asked, labels.select("iri", "label"))


@on_tables("""SELECT 'p' || min(p_partkey) AS iri, p_name AS s FROM part GROUP BY p_name""")
def ground_labels(table) -> DataFrame:
    named = table("part").select(F.col("p_name").alias("s"), F.array("p_name").alias("labels")).distinct()
    reference = table("part").groupBy("p_name").agg(F.min("p_partkey").alias("k")).select(F.concat(F.lit("p"), F.col("k").cast("string")).alias("iri"), F.col("p_name").alias("label"))
    return grounding.grounded(named, reference, cutoff=0.95).select("iri", "s")


# keys and windows


@on_tables("""SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""")
def first_seen(table) -> DataFrame:
    events = table("events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("place"))
    return grounding.first_seen(events, ["user_id"], "place").select("user_id", "event_id", "event_type")


@on_tables("""SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1""")
def best_per_key(table) -> DataFrame:
    return grounding.best_per_key(table("events").select("user_id", "event_id", "value"), ["user_id"], "value", "event_id")


@on_tables("""SELECT l_orderkey, coalesce(arg_min(CASE WHEN l_returnflag <> 'N' THEN l_returnflag END, CASE WHEN l_returnflag <> 'N' THEN l_partkey * 100000 + l_suppkey END), 'N') AS l_returnflag FROM lineitem GROUP BY l_orderkey""")
def first_available(table) -> DataFrame:
    return grounding.first_available(table("lineitem").withColumn("place", F.col("l_partkey") * 100000 + F.col("l_suppkey")), ["l_orderkey"], ["l_returnflag"], "place", missing="N")


@on_tables("""SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_returnflag = 'R' OR NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_orderkey = l.l_orderkey AND r.l_returnflag = 'R')""")
def valid_or_all(table) -> DataFrame:
    return grounding.valid_or_all(table("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), ["l_orderkey"], F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber")


@on_tables("""SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def windowed_counts(table) -> DataFrame:
    return incremental.windowed_counts(table("events"), "ts", "event_type", "value").withColumn("total", F.round("total", 4))


@on_tables("""SELECT o_orderkey, o_orderstatus, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS items FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def nested_orders(table) -> DataFrame:
    items = table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("items"))
    line = lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))
    return table("orders").join(items, "o_orderkey", "left").select("o_orderkey", "o_orderstatus", F.array_join(F.transform("items", line), ",").alias("items"))


@on_tables("""SELECT l_suppkey AS k, list_sort(list(DISTINCT l_returnflag))[1] AS first, list_sort(list(DISTINCT l_returnflag))[2] AS second FROM lineitem GROUP BY l_suppkey""")
def first_two(table) -> DataFrame:
    found = documents.gathered(table("lineitem").withColumnRenamed("l_suppkey", "k"), ["k"], f="l_returnflag")
    return found.select("k", F.get("f", F.lit(0)).alias("first"), F.get("f", F.lit(1)).alias("second"))


@on_tables("""SELECT c_nationkey AS k, list_sort(list(DISTINCT c_mktsegment)) AS names, coalesce(min(CASE WHEN c_acctbal > 0 THEN c_name END), 'N/A') AS first_rich FROM customer GROUP BY c_nationkey""")
def merged_records(table) -> DataFrame:
    rows = table("customer").select(F.col("c_nationkey").alias("k"), F.array("c_mktsegment").alias("names"), F.lit("N/A").alias("bands"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).otherwise("N/A").alias("first_rich"))
    return documents.merged_records(rows, "k", "names", "bands", ["first_rich"]).drop("bands")


@on_graph("""SELECT p_partkey, p_brand AS brand, p_type AS kind, CAST(p_size AS VARCHAR) AS size FROM part""")
def pivot_properties(g: MappedGraph) -> DataFrame:
    rows = g.rows([BASE + p for p in ("brand", "kind", "size")], [("?s", ["ex:brand", "ex:kind", "ex:size"], "?o")], 0)
    return rows.groupBy("s").pivot("p", [BASE + p for p in ("brand", "kind", "size")]).agg(F.min("o")).toDF("s", "brand", "kind", "size").select(local_name("s").cast("long").alias("p_partkey"), "brand", "kind", "size")


@on_tables("""SELECT u AS uri, n AS n FROM (SELECT c_mktsegment AS u, min(c_custkey) AS n FROM customer GROUP BY 1) WHERE u <> 'BUILDING'""")
def insert_or_ignore(table) -> DataFrame:
    new = table("customer").select(F.col("c_mktsegment").alias("uri"), F.col("c_custkey").alias("n"))
    known = table("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_mktsegment").alias("uri"))
    return tables.inserted(known, new, "uri")


@on_graph("""SELECT 'http://example.org/Customer/' || c_custkey AS s, 'http://www.w3.org/2000/01/rdf-schema#label' AS p, c_name AS o, 'lit' AS o_kind FROM customer""")
def ntriples_round_trip(g: MappedGraph) -> DataFrame:
    rows = g.rows(["http://www.w3.org/2000/01/rdf-schema#label"], [("?s", "rdfs:label", "?o"), ("?s", "a", "ex:Customer")], 0)
    return rdf.graph(rdf.ntriples(rdf.ntriples_lines(rows)))


# scores


def _pairs(table) -> tuple[DataFrame, DataFrame]:
    items = table("lineitem")
    return items.select(F.col("l_orderkey").alias("k"), (F.col("l_quantity") % 5).cast("int").alias("v")), items.select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") % 5).alias("v"))


MULTISET = """t AS (SELECT l_orderkey AS k, CAST(l_quantity AS INT) % 5 AS v, count(*) AS n FROM lineitem GROUP BY 1, 2), f AS (SELECT l_orderkey AS k, l_linenumber % 5 AS v, count(*) AS m FROM lineitem GROUP BY 1, 2),
b AS (SELECT k, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM t FULL JOIN f USING (k, v)), c AS (SELECT k, sum(least(n, m))::BIGINT AS tp, sum(greatest(m - n, 0))::BIGINT AS fp, sum(greatest(n - m, 0))::BIGINT AS fn FROM b GROUP BY k)"""
PRF = """CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fn) END AS recall"""


@on_tables(f"WITH {MULTISET} SELECT k, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall FROM (SELECT *, {PRF} FROM c)")
def multiset_prf(table) -> DataFrame:
    scored = scoring.with_prf(scoring.multisets(*_pairs(table), ["k"], "v"))
    return scored.select("k", "tp", "fp", "fn", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@on_tables(f"WITH {MULTISET} SELECT k, tp, CASE WHEN tp > 0 THEN 0 ELSE fp END AS fp, fn FROM c")
def conditional_fp(table) -> DataFrame:
    return scoring.lenient(scoring.multisets(*_pairs(table), ["k"], "v"))


SETS = """t AS (SELECT DISTINCT l_orderkey AS k, CAST(l_quantity AS INT) % 5 AS v FROM lineitem), f AS (SELECT DISTINCT l_orderkey AS k, l_linenumber % 5 AS v FROM lineitem),
c AS (SELECT coalesce(t.k, f.k) AS k, count(*) FILTER (t.k IS NOT NULL AND f.k IS NOT NULL) AS tp, count(*) FILTER (t.k IS NULL) AS fp, count(*) FILTER (f.k IS NULL) AS fn FROM t FULL JOIN f ON t.k = f.k AND t.v = f.v GROUP BY 1)"""


@on_tables(f"WITH {SETS} SELECT k, tp, fp, fn FROM c")
def set_prf_by_key(table) -> DataFrame:
    return scoring.sets(*_pairs(table), ["k"], "v")


@on_tables(f"WITH {SETS}, m AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c) SELECT tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(2 * precision * recall / (precision + recall), 9) AS f1 FROM (SELECT *, {PRF} FROM m)")
def micro_f1(table) -> DataFrame:
    found = scoring.micro(scoring.sets(*_pairs(table), ["k"], "v"))
    return found.select("tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@on_tables(f"WITH {SETS}, p AS (SELECT *, {PRF} FROM c) SELECT k % 7 AS part, round(avg(CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END), 9) AS f1 FROM p GROUP BY 1")
def macro_f1(table) -> DataFrame:
    counts = scoring.sets(*_pairs(table), ["k"], "v").withColumn("part", F.col("k") % 7)
    return scoring.macro(counts, "part").select("part", F.round("f1", 9).alias("f1"))


@on_tables("""SELECT (SELECT count(*) FROM documents) AS n_truth, (SELECT count(*) FROM labels) AS n_found, (SELECT count(*) FROM documents JOIN labels USING (doc_id)) AS n_matched, (SELECT count(*) FROM documents JOIN labels USING (doc_id) WHERE doc_id % 2 = quality) AS n_equal""")
def anchor_score(table) -> DataFrame:
    truth = table("documents").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("v"))
    return scoring.anchored(truth, table("labels").select("doc_id", F.col("quality").alias("v")), "doc_id", "v")


@on_tables("""SELECT field, count(*) FILTER (t = f) AS tp, count(*) FILTER (f IS NOT NULL AND t IS DISTINCT FROM f) AS fp, count(*) FILTER (t IS NOT NULL AND t IS DISTINCT FROM f) AS fn FROM (
SELECT 'a' AS field, o_orderstatus AS t, CASE WHEN o_orderkey % 4 > 0 THEN 'F' END AS f FROM orders UNION ALL SELECT 'b', o_orderpriority, '1-URGENT' FROM orders) GROUP BY field""")
def field_scores(table) -> DataFrame:
    orders = table("orders")
    truth = orders.select("o_orderkey", F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b"))
    found = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 4 > 0, "F").otherwise("N/A").alias("a"), F.lit("1-URGENT").alias("b"))
    return scoring.fields(truth, found, ["o_orderkey"], ["a", "b"])


@on_tables("""SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS n01, count(*) FILTER (quality = 0 AND toxic = 1) AS n10,
round(power(greatest(abs(count(*) FILTER (quality = 1 AND toxic = 0) - count(*) FILTER (quality = 0 AND toxic = 1)) - 1, 0), 2) / (count(*) FILTER (quality <> toxic)), 6) AS chi2 FROM labels""")
def mcnemar_test(table) -> DataFrame:
    return scoring.mcnemar(table("labels"), "quality", "toxic").select("n01", "n10", F.round("chi2", 6).alias("chi2"))


@on_tables("""SELECT count(*) AS n, round(avg(d) / sqrt(var_samp(d) / count(*)), 6) AS t FROM (SELECT (quality - toxic)::DOUBLE AS d FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)""")
def paired_t_test(table) -> DataFrame:
    return scoring.paired_t(table("labels"), "quality", "toxic").select("n", F.round("t", 6).alias("t"))


@on_tables()
def bootstrap_test(table) -> DataFrame:
    return scoring.bootstrap(table("labels"), "quality", "toxic", draws=1000, centred=True)


@on_tables("""SELECT DISTINCT l_partkey AS part, l_quantity AS t, p_size::DOUBLE AS f FROM lineitem JOIN part ON l_partkey = p_partkey WHERE abs(l_quantity - p_size) <= 3""")
def tolerance_match(table) -> DataFrame:
    truth = table("lineitem").select(F.col("l_partkey").alias("part"), F.col("l_quantity").alias("v")).distinct()
    found = table("part").select(F.col("p_partkey").alias("part"), F.col("p_size").cast("double").alias("v")).distinct()
    return scoring.near_numbers(truth, found, "part", "v")


@on_tables("""WITH RECURSIVE s AS (SELECT l_partkey AS k, coalesce(list_sort(list(DISTINCT l_quantity::DOUBLE) FILTER (l_linenumber % 2 = 1)), []) AS ts, coalesce(list_sort(list(DISTINCT l_quantity::DOUBLE) FILTER (l_linenumber % 2 = 0)), []) AS fs FROM lineitem GROUP BY 1),
g AS (SELECT k, ts, fs AS free, 0 AS n, NULL::DOUBLE AS t, NULL::DOUBLE AS f FROM s
UNION ALL SELECT k, ts, CASE WHEN pick IS NULL THEN free ELSE list_filter(free, lambda x: x <> pick) END, n + 1, ts[n + 1], pick
FROM (SELECT *, list_sort(list_transform(list_filter(free, lambda x: abs(x - ts[n + 1]) <= 3), lambda x: {'d': abs(x - ts[n + 1]), 'x': x}))[1].x AS pick FROM g WHERE n < len(ts)))
SELECT k AS part, t, f FROM g WHERE f IS NOT NULL""")
def nearest_matches(table) -> DataFrame:
    lines = table("lineitem").select(F.col("l_partkey").alias("part"), F.col("l_quantity").alias("v"), "l_linenumber")
    found = scoring.near_matches(lines.where("l_linenumber % 2 = 1"), lines.where("l_linenumber % 2 = 0"), "part", "v")
    return found.select("part", F.explode("pairs").alias("m")).select("part", "m.t", "m.f")


@on_tables("""SELECT source, count(*) AS n_expected, count(l.doc_id) AS n_got, count(l.doc_id) AS n_both, count(*) - count(l.doc_id) AS n_missing, 0 AS n_extra FROM (SELECT DISTINCT source, doc_id FROM documents) d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source""")
def label_coverage(table) -> DataFrame:
    expected = table("documents").select("source", "doc_id")
    return scoring.coverage(expected, expected.join(table("labels").select("doc_id"), "doc_id"), "source", "doc_id")


@on_tables("""SELECT count(*) AS o_orderstatus, count(*) FILTER (o_totalprice IS NOT NULL) AS o_totalprice FROM orders""")
def presence_counts(table) -> DataFrame:
    return scoring.presence(table("orders"), ["o_orderstatus", "o_totalprice"])


@on_tables("""WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, f DESC, t DESC) AS n
FROM (SELECT a.l_orderkey AS k, a.l_linenumber AS t, b.l_linenumber AS f, round(a.l_quantity * b.l_discount, 4) AS score FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey)),
g AS (SELECT DISTINCT k, 0::BIGINT AS n, []::INT[] AS ts, []::INT[] AS fs, NULL::INT AS t, NULL::INT AS f, NULL::DOUBLE AS score FROM p
UNION ALL SELECT k, n, CASE WHEN free THEN list_append(ts, t) ELSE ts END, CASE WHEN free THEN list_append(fs, f) ELSE fs END, CASE WHEN free THEN t END, CASE WHEN free THEN f END, score
FROM (SELECT p.k, p.n, ts, fs, p.t, p.f, p.score, NOT list_contains(ts, p.t) AND NOT list_contains(fs, p.f) AS free FROM g JOIN p ON p.k = g.k AND p.n = g.n + 1))
SELECT k, t, f, score FROM g WHERE t IS NOT NULL""")
def greedy_matches(table) -> DataFrame:
    items = table("lineitem")
    t = items.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("t"), F.col("l_quantity").alias("a"))
    f = items.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("f"), F.col("l_discount").alias("b"))
    pairs = t.join(f, "k").select("k", "t", "f", F.round(F.col("a") * F.col("b"), 4).alias("score"))
    return scoring.greedy(pairs, ["k"], "score", "t", "f")


@on_tables(f"""WITH {MULTISET}, s AS (SELECT k % 3 AS part, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c GROUP BY 1), r AS (SELECT CAST(part AS VARCHAR) AS part, tp, fp, fn FROM s UNION ALL SELECT 'Overall', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT FROM s)
SELECT part, tp, fp, fn, round(precision, 3) AS precision, round(recall, 3) AS recall FROM (SELECT *, {PRF} FROM r)""")
def score_report(table) -> DataFrame:
    counts = scoring.micro(scoring.multisets(*_pairs(table), ["k"], "v").withColumn("part", F.col("k") % 3), ["part"]).select("part", "tp", "fp", "fn")
    return tables.report(counts, "part").drop("f1")


# lists


def _kinds(table) -> DataFrame:
    parts = table("part").select(F.lit("part").alias("kind"), F.col("p_name").alias("label"))
    return parts.unionByName(table("nation").select(F.lit("nation").alias("kind"), F.col("n_name").alias("label")))


@on_tables("""SELECT DISTINCT p_name AS label FROM part WHERE contains(lower(p_name), 'ring')""")
def label_list(table) -> DataFrame:
    return listing.listed(_kinds(table), kind="part", contains="RING")


@on_tables("""SELECT 'part' AS kind, count(*) AS n, count(DISTINCT p_name) AS n_distinct, min(length(p_name)) AS shortest, max(length(p_name)) AS longest, round(avg(length(p_name)), 6) AS mean_length FROM part
UNION ALL SELECT 'nation', count(*), count(DISTINCT n_name), min(length(n_name)), max(length(n_name)), round(avg(length(n_name)), 6) FROM nation""")
def label_statistics(table) -> DataFrame:
    return listing.label_statistics(_kinds(table)).withColumn("mean_length", F.round("mean_length", 6))


@on_tables("""SELECT DISTINCT p_name AS label FROM part WHERE contains(upper(p_name), 'B') AND contains(upper(p_name), 'LT')""")
def label_elements(table) -> DataFrame:
    return listing.with_elements(table("part").select(F.col("p_name").alias("label")).distinct(), ["b", "Lt"])


@on_tables("""SELECT o_orderpriority AS category, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_hit FROM orders GROUP BY 1""")
def derived_in_truth(table) -> DataFrame:
    derived = table("orders").select(F.col("o_orderpriority").alias("category"), F.col("o_orderkey").cast("string").alias("doi"), F.col("o_orderstatus").alias("formula"))
    truth = table("orders").groupBy(F.col("o_orderpriority").alias("category"), F.pmod("o_orderkey", F.lit(97))).agg(F.array_join(F.collect_list(F.col("o_orderkey").cast("string")), "; ").alias("dois"))
    return listing.derived_in_truth(derived, truth.select("category", "dois", F.lit("F").alias("formula")))


@on_tables("""SELECT round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS status, 1.0::DOUBLE AS bag, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS all_fields FROM (SELECT o_orderstatus AS a, CASE WHEN o_orderkey % 3 = 0 THEN 'F' ELSE o_orderstatus END AS b FROM orders)""")
def exact_rates(table) -> DataFrame:
    bag = lambda *names: F.array(*(F.col(n).cast("string") for n in names)).alias("bag")
    truth = table("orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), bag("o_custkey", "o_orderpriority"))
    found = table("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "F").otherwise(F.col("o_orderstatus")).alias("status"), bag("o_orderpriority", "o_custkey"))
    rates = listing.exact_rates(truth, found, "o_orderkey", ["status", "bag"])
    return rates.select(*(F.round(c, 6).alias(c) for c in rates.columns))
