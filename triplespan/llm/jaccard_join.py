"""Operator 8: exact n-gram Jaccard join by a grouped prefix join, and its connected components.

A document is the set of its distinct 5-word shingles (64-bit hashes). Equal sets are collapsed to one class. Sets are
ordered rarest shingle first by counts in `BINS` bins over all documents; any order is exact, a rare one keeps common
passages out of the prefixes. Two sets with Jaccard >= t share a shingle within their first n - ceil(t n) + 1, and then
overlap, by place, by at least ceil(t / (1 + t) (n + m)).

Classes of equal size and prefix form one group, whose head carries the prefix for all members that link with it, as
verified; the others carry it themselves. Carriers meet on prefix shingles. A row of shingle, size n and place p only links
with sizes from t n to (1 + t) / t (n - p) - n, so rows that no row of another component on their shingle admits are left out.
Size and place are those of all members, so pairs that these filters drop are dropped for every member.

First each carrier is paired with one hub a shingle, the carrier that meets most others, so that pairs are linear in rows;
the original of many edited copies is such a hub. More rounds with hubs in hash order follow while a shingle has many
more pairs than rows and rounds still link. At last, on each shingle, the components that still meet there are paired,
and then their carriers, all that pass the filters. Every pair is verified on the whole texts, which gives its Jaccard
distance. That is a metric, so members x and y of groups with heads a and b can only link if d(x, a) + d(b, y) + 1 - t
reaches d(a, b). Pairs of groups in different components for which some member can are expanded: first each such member with
the other head, then the members that those distances still allow. No pair of one component is expanded.

Null, empty and blank texts have the empty set and link with nothing, not even each other. Documents of fewer than
five words are one shingle of all their words. Repeated texts share a component. Rows with a null doc_id link like others
but never name a component; a component of such rows alone has a null id. Rows with the same doc_id count as one document
per text. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplespan.llm import common
from triplespan.llm.shingles import U64, mixed, parts, shingle_sets

PERCENT = 80
#: Bins of the count of shingles, and the ranges in which tasks hand them on.
BINS, RANGES = 1 << 20, 256
#: Edges for each task of the component search.
EDGES = 50_000
#: Hub rounds go on while pairs are more than so many times the rows, and one in LINKING of the last pairs linked.
CROWDED, LINKING = 16, 10
#: For bounds in floating point.
SLACK = 1e-9


def _bin(hashes: np.ndarray) -> np.ndarray:
    return (hashes // U64((1 << 64) // BINS)).astype(np.int64)


def bin_ranks(docs: DataFrame) -> np.ndarray:
    """The rank of each bin by the number of shingles of all documents in it: BINS numbers, whatever the size of the input."""
    width = BINS // RANGES
    schema = "range int, packed binary"

    def batch(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=1).compress
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([pack(c.tobytes()) for c in total.values()], pa.binary())], ["range", "packed"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for b in batches:
            for i, j in parts(b):
                at, n = np.unique(_bin(np.concatenate([np.zeros(0, U64), *shingle_sets(b.column("text")[i:j])])), return_counts=True)
                total[at] += n
        yield batch({k: c for k, c in enumerate(total.reshape(RANGES, width)) if c.any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, total = zstandard.ZstdDecompressor().decompress, {}
        for b in batches:
            for k, packed in zip(b.column("range").to_pylist(), b.column("packed").to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(unpack(packed), np.int64)
        yield batch(total)

    summed = docs.select("text").transform(common.in_arrow, count, schema).repartition("range").mapInArrow(add, schema)
    out, unpack = np.zeros((RANGES, width), np.int64), zstandard.ZstdDecompressor().decompress
    for row in summed.toLocalIterator():
        out[row["range"]] = np.frombuffer(unpack(bytes(row["packed"])), np.int64)
    return np.unique(out.ravel(), return_inverse=True)[1].astype(np.uint32)


def _signature(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes."""
    return int(mixed(hashes).sum(dtype=U64).astype(np.int64)), int(mixed(hashes ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64).astype(np.int64))


def prefixes(docs: DataFrame, ranks: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key, n, 128-bit signatures of the set (s1, s2) and of its prefix (k1, k2), and the prefix, rarest shingle
    first, of (doc_id, text_key, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    names = ["n", "s1", "s2", "k1", "k2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in parts(b):
                rows, first = [], []
                for h in shingle_sets(b.column("text")[i:j]):
                    order = np.argsort(shared.value[_bin(h)], kind="stable")
                    head = h[order[: len(h) - -(-percent * len(h) // 100) + 1 if len(h) else 0]]
                    rows.append((len(h), *_signature(h), *_signature(head)))
                    first.append(head.astype(np.int64))
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[i:j], b.column("text_key")[i:j], *columns, pa.array(first, pa.list_(pa.int64()))], ["doc_id", "text_key", *names, "prefix"])

    return docs.select("doc_id", "text_key", "text").transform(common.in_arrow, run, f"doc_id long, text_key long, {', '.join(f'{n} long' for n in names)}, prefix array<long>")


def _least_overlap(n: Column, m: Column, percent: int) -> Column:
    return F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent))


def _largest_partner(n: Column, p: Column, percent: int) -> Column:
    """The largest size m for which the overlap that is still possible from place p on reaches the least one."""
    return F.floor((n - p) * F.lit(100 + percent) / F.lit(percent)) - n


def _may_link(a: str, b: str, percent: int) -> Column:
    """Size filter, and overlap still possible when the shared shingle is at places p (from 0) of both prefixes."""
    n, m, p, q = (F.col(f"{x}.{c}") for c in ("n", "p") for x in (a, b))
    sizes = (100 * F.least(n, m)) >= percent * F.greatest(n, m)
    return sizes & (F.least(n - p, m - q) >= _least_overlap(n, m, percent))


def components(edges: DataFrame, per_task: int = EDGES) -> DataFrame:
    """node, component (its smallest node) from rows (a, b): rounds of large-star and small-star until stable.

    A task is meant to hold `per_task` edges, so that rounds over a small table are no rounds of shuffles."""
    edges = common.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    tasks = 1 + edges.count() // per_task
    together = lambda df: df.coalesce(tasks)
    state = None
    while True:
        edges = together(edges)
        both = together(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.where("m < a").select("a", F.col("m").alias("b")))
        large = together(common.written(together(large).distinct(), "large-star"))
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest.select("a", F.col("m").alias("b")))
        edges = common.written(together(small).distinct(), "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    edges = together(edges)
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return common.written(ends.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), "components")


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b, far and linked of the rows (a, b) of `pairs`, a written table of class rows: the Jaccard distance of their sets,
    and whether they reach the threshold. Texts travel compressed, which is smaller than their sets, and sets are made again
    from them."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct().join(classes.select("row", "doc_id", "text_key"), "row")
    ids = common.written(ids.toDF("id", "id_doc", "id_key"), "ids")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([compress((t.as_py() or "").encode()) for t in b.column("text")], pa.binary())], ["id", "packed"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            far, linked = [], []
            for i in range(0, len(b), 64):
                part = b.slice(i, 64)
                packed = part.column("x").to_pylist() + part.column("y").to_pylist()
                texts = dict.fromkeys(packed)
                sets = dict(zip(texts, shingle_sets(pa.array([unpack(t).decode() for t in texts], pa.string())), strict=True))
                for x, y in zip(packed[: len(part)], packed[len(part) :], strict=True):
                    both = np.concatenate([sets[x], sets[y]])
                    both.sort(kind="stable")
                    common_ = int(np.count_nonzero(both[1:] == both[:-1]))
                    far.append(1 - common_ / (len(both) - common_))
                    linked.append(100 * common_ >= percent * (len(both) - common_))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(far, pa.float64()), pa.array(linked, pa.bool_())], ["a", "b", "far", "linked"])

    found = docs.join(common.if_small(ids), F.col("doc_id").eqNullSafe(F.col("id_doc")) & (F.col("text_key") == F.col("id_key"))).select("id", "text")
    texts = found.transform(common.in_arrow, pack, "id long, packed binary").groupBy("id").agg(F.first("packed").alias("packed"))  # one of repeated rows
    texts = common.written(texts, "texts")
    left, right = texts.select(F.col("id").alias("a"), F.col("packed").alias("x")), texts.select(F.col("id").alias("b"), F.col("packed").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").transform(common.in_arrow, compare, "a long, b long, far double, linked boolean")


def _ordered_pairs(a: str, b: str, pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()


class _Links:
    """Verified links so far, the pairs that were tried with their distances, and the components."""

    def __init__(self, docs: DataFrame, classes: DataFrame, percent: int):
        self.docs, self.classes, self.percent = docs, classes, percent
        self.tried = docs.sparkSession.createDataFrame([], "a long, b long, far double, linked boolean")
        self.comps = docs.sparkSession.createDataFrame([], "node long, component long")

    @property
    def links(self) -> DataFrame:
        return self.tried.where("linked").select("a", "b")

    def try_(self, pairs: DataFrame) -> tuple[int, int]:
        """Verifies the pairs (a, b) that are new; their number, and how many link."""
        new = common.written(pairs.join(self.tried, ["a", "b"], "left_anti"), "pairs")
        if new.isEmpty():
            return 0, 0
        more = common.written(verified(self.docs, self.classes, new, self.percent), "tried")
        n, linked = more.agg(F.count("*"), F.count_if("linked")).first()
        self.tried = self.tried.union(more)
        if linked:
            self.comps = components(self.links)
        return n, linked

    def of_two(self, pairs: DataFrame) -> DataFrame:
        """Rows of `pairs` (a, b, ...) whose ends are in different components."""
        for end in ("a", "b"):
            of_end = self.comps.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))
            pairs = pairs.join(common.if_small(of_end), end, "left").withColumn(f"_{end}", F.coalesce(f"_{end}", end))
        return pairs.where("_a <> _b").drop("_a", "_b")

    def distance(self, a: str, b: str, pairs: DataFrame, name: str) -> DataFrame:
        """`pairs` with the distance of columns a and b as `name`, null where it was not tried."""
        known = self.tried.select(F.col("a").alias("_x"), F.col("b").alias("_y"), F.col("far").alias(name))
        return pairs.join(known, (F.greatest(a, b) == F.col("_x")) & (F.least(a, b) == F.col("_y")), "left").drop("_x", "_y")

    def expand(self, members: DataFrame) -> None:
        """Tries members (head, x, d) of groups whose heads were tried and do not share a component, as far as distances
        allow a link; a head is no member of its own. Rounding is met by `SLACK`."""
        near = F.lit(1 - self.percent / 100 + SLACK)
        reach = common.written(members.groupBy("head").agg(F.max("d").alias("reach")), "reach")
        wide = common.written(self.tried.where(~F.col("linked")).transform(self.of_two).select("a", "b", "far"), "apart")
        for end in ("a", "b"):
            wide = wide.join(common.if_small(reach.toDF(end, f"reach_{end}")), end, "left")
        wide = wide.where(F.col("far") <= near + F.coalesce("reach_a", F.lit(0.0)) + F.coalesce("reach_b", F.lit(0.0))).where("reach_a is not null or reach_b is not null")
        wide = common.written(wide.select("a", "b", "far"), "wide")
        if wide.isEmpty():
            return
        of = lambda end, x, d: members.select(F.col("head").alias(end), F.col("x").alias(x), F.col("d").alias(d))
        left, right = wide.join(of("a", "x", "dx"), "a"), wide.join(of("b", "y", "dy"), "b")
        with_heads = left.where(F.col("dx") + near >= F.col("far")).select("x", F.col("b").alias("y")).union(right.where(F.col("dy") + near >= F.col("far")).select(F.col("a").alias("x"), "y"))
        self.try_(_ordered_pairs("x", "y", with_heads))

        # distances to the other head, or a lower bound of it, on both sides
        left = self.distance("x", "b", self.of_two(wide).join(of("a", "x", "dx"), "a"), "dxb").withColumn("dxb", F.coalesce("dxb", F.col("far") - F.col("dx")))
        right = self.distance("y", "a", self.of_two(wide).join(of("b", "y", "dy"), "b"), "dya").withColumn("dya", F.coalesce("dya", F.col("far") - F.col("dy")))
        left, right = common.written(left, "left"), common.written(right.drop("far"), "right")
        close = (F.col("dx") + F.col("dy") + near >= F.col("far")) & (F.col("dxb") <= F.col("dy") + near) & (F.col("dya") <= F.col("dx") + near)
        self.try_(_ordered_pairs("x", "y", left.join(right, ["a", "b"]).where(close)))


def _still_open(rows: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Rows (shingle, g, n, p) with their component c, on shingles where components meet, that a row there may admit.

    What is counted of a shingle is written before rows are joined with it, so that Spark can split a shingle of very many rows."""
    n, p = F.col("n"), F.col("p")
    at = rows.select("shingle", "g", "n", "p").join(common.if_small(comps), F.col("g") == F.col("node"), "left")
    at = at.select("shingle", "g", "n", "p", F.coalesce("component", "g").alias("c"), _largest_partner(n, p, percent).alias("top"))
    sums = (F.min("c"), F.max("c"), F.min("n"), F.max("n"), F.max("top"))
    met = at.groupBy("shingle").agg(*(s.alias(k) for s, k in zip(sums, ("c0", "c1", "n0", "n1", "top1"), strict=True))).where("c0 < c1")
    met = common.written(met, "met")
    admitted = (F.col("top") >= F.greatest("n0", F.ceil(n * percent / 100))) & (100 * F.col("n1") >= percent * n) & (F.col("top1") >= n)
    at = common.written(at.join(met, "shingle").where(admitted).select("shingle", "g", "n", "p", "c"), "admitted")
    left = at.groupBy("shingle").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("many")).where("c0 < c1").drop("c0", "c1")
    return common.written(at.join(common.written(left, "counts"), "shingle"), "open")


def joined(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document of (doc_id, text)."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    table = common.written(prefixes(docs, bin_ranks(docs), percent).withColumn("row", F.monotonically_increasing_id()), "prefixes")
    sets = table.where("n > 0").select("s1", "s2", "n", "row", "doc_id", "text_key", "k1", "k2")
    classes = sets.groupBy("s1", "s2", "n").agg(F.min(F.struct("row", "doc_id", "text_key", "k1", "k2")).alias("m"), F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    classes = common.written(classes.select("s1", "s2", "n", "m.*", "least", "copies"), "classes")
    heads = classes.groupBy("k1", "k2", "n").agg(F.min("row").alias("b"), F.count("*").alias("size")).where("size > 1")
    found = _Links(docs, classes, percent)
    found.try_(classes.join(heads, ["k1", "k2", "n"]).select(F.col("row").alias("a"), "b").where("a > b"))

    # members that their group's head stands for, with their distance from it
    members = found.tried.where("linked").select(F.col("b").alias("head"), F.col("a").alias("x"), F.col("far").alias("d"))
    carriers = classes.select("row").join(members.select(F.col("x").alias("row")), "row", "left_anti")
    idle = common.written(sets.select("row").join(carriers, "row", "left_anti"), "idle")
    rows = common.without(table.select("row", "n", "prefix"), idle, "row").select(F.posexplode("prefix").alias("p", "shingle"), F.col("row").alias("g"), F.col("n").cast("int").alias("n"))
    shared = rows.groupBy("shingle").agg(F.count("*").alias("many")).where("many > 1").select("shingle")
    rows = common.written(rows.join(shared, "shingle").select("shingle", "g", "n", "p"), "shared")

    # hubs: the carrier that meets most others, then others in hash order
    row, linking, turn = F.struct("g", "n", "p", "c"), True, 0
    while linking:
        left = _still_open(rows, found.comps, percent)
        pairs, many = left.agg(F.coalesce(F.sum("many"), F.lit(0)), F.count("*")).first()
        if turn and pairs <= CROWDED * many:
            break
        weight = left.groupBy("g").agg(F.sum("many").alias("weight")) if turn == 0 else left.select("g", F.xxhash64("g", F.lit(turn)).alias("weight")).distinct()
        hubs = left.join(common.if_small(weight), "g").groupBy("shingle").agg(F.max(F.struct("weight", (-F.col("g")).alias("_g"), row.alias("y")))["y"].alias("y"))
        met = left.select("shingle", row.alias("x")).join(common.written(hubs, "hubs"), "shingle").where(F.col("x.c") != F.col("y.c")).where(_may_link("x", "y", percent))
        tried, linked = found.try_(_ordered_pairs("x.g", "y.g", met))
        linking, turn = linked * LINKING > tried, turn + 1
    left = _still_open(rows, found.comps, percent) if not linking else left

    # on each shingle components meet one another, and only then their carriers, so those of one component do not
    top = _largest_partner(F.col("n"), F.col("p"), percent)
    blocks = left.groupBy("shingle", "c").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.max(top).alias("top"))
    others = blocks.select("shingle", *(F.col(k).alias(f"_{k}") for k in ("c", "n0", "n1", "top")))
    sizes = "100 * n1 >= {0} * _n0 and 100 * _n1 >= {0} * n0 and top >= _n0 and _top >= n0".format(percent)
    both = blocks.join(others, "shingle").where("c < _c").where(sizes).select("shingle", "c", F.col("_c").alias("other"))
    x = left.select("shingle", "c", row.alias("x")).join(both, ["shingle", "c"]).drop("c")
    y = left.select("shingle", F.col("c").alias("other"), row.alias("y"))
    found.try_(_ordered_pairs("x.g", "y.g", x.join(y, ["shingle", "other"]).where(_may_link("x", "y", percent))))
    found.expand(members)

    # the name of a component is its smallest doc_id; only classes of several rows or with links need one
    named = classes.select("s1", "s2", "n", "row", "least", "copies").join(common.if_small(found.comps), F.col("row") == F.col("node"), "left")
    named = named.where("copies > 1 or component is not null").withColumn("component", F.coalesce("component", "row"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(names, "component").select("s1", "s2", F.col("n").alias("n_"), "component_id", F.lit(True).alias("named"))
    same = (table.s1 == named.s1) & (table.s2 == named.s2) & (table.n == named.n_)
    out = table.select("doc_id", "n", "s1", "s2").join(named, same, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("named"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(common.documents(spark, sf_dir))
