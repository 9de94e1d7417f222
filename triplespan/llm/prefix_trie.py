"""Operator 12: the trie of all prefixes of conversations, by a global sort of turn arrays and adjacent prefixes.

A turn is 128 bits of its role and text, so that a conversation is a short byte string whose order is that of its turns.
Conversations are range-sorted, and each partition is swept once: the turns that a row shares with the one before say which
nodes of the stack of open nodes end. A node that ends is final, unless it is on the path of the partition's first or last
row, where it may go on in another partition. Those paths, one row a partition, are stitched in order by the same stack.
Ids of the conversations that end at a node are hashed as they come, or, where they may go on in another partition, as
compressed pieces in order: the digest of one node is sequential by its definition, its pieces are a few bytes an id.

Turns are ordered by turn, null first, then role and text. A null role or text is empty. Rows without a conv_id are no
conversation. Repeated rows are repeated turns. Conversations without turns, as rebuilt, end at the root. Very long
conversations are one row of 20 bytes a turn. Extra columns are ignored. An empty table has no root: an empty result.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triplespan.llm import common

#: Conversations of a block share the first 0 to MOST - 1 turns of the block's first one.
BLOCK, MOST = 100, 6
#: Ids of a piece, and ended nodes that wait for their parent, at most.
PIECE, WAITING = 50_000, 4096
WIDTH = 16
NOTHING = hashlib.sha256(b"").hexdigest()
SWEPT = "kind string, id binary, conv_id long, depth long, parent binary, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, part int, seq int, packed binary"
COLUMNS = [c.split()[0] for c in SWEPT.split(", ")]
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def turn_arrays(rows: DataFrame) -> DataFrame:
    """conv_id and turns (place, print, size) of rows (conv_id, turn, role, text)."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turns = rows.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    turns = turns.withColumn("print", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).withColumn("size", F.length("text"))
    turns = turns.withColumn("place", F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "print", "size"))).alias("turns"))


def rebuilt(own: DataFrame, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """`own` with the first h turns of the block's first conversation in place of its own, h from a hash of its id."""
    n = F.col("conv_id")
    first = own.where(n % block == 0).select(n.alias("_host"), F.slice("turns", 1, most - 1).alias("_first"))
    h = (F.crc32(n.cast("string").cast("binary")) % most).cast("int")
    both = own.withColumn("_host", n - n % block).join(first, "_host", "left")
    mine = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return both.select("conv_id", F.concat(F.when(F.col("_first").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("_first", F.lit(1), h)), mine).alias("turns"))


class Node:
    """An open node; what its ended children brought is already in the sums."""

    __slots__ = ("id", "size", "n", "least", "children", "leaves", "saved", "ends", "waiting", "hub", "first")

    def __init__(self, id: bytes, size: int, n: int = 0, least: int | None = None, children: int = 0, leaves: int = 0, saved: int = 0, ends: str | None = None, first: bool = False):
        self.id, self.size, self.n, self.least, self.children, self.leaves, self.saved, self.ends = id, size, n, least, children, leaves, saved, ends
        self.waiting, self.hub, self.first = [], False, first

    def add(self, n: int, least: int | None) -> None:
        self.n += n
        if least is not None:
            self.least = least if self.least is None else min(self.least, least)

    def written(self) -> list:
        return [self.id.hex(), self.size, self.n, self.least, self.children, self.leaves, self.saved, self.ends]


def _read(x: list) -> Node:
    return Node(bytes.fromhex(x[0]), *x[1:])


class Sweep:
    """The stack of open nodes, and rows of those that ended."""

    def __init__(self):
        self.stack: list[Node] = []
        self.rows: list[dict] = []

    def out(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            types = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "string": pa.string()}
            kinds = [types[c.split()[1]] for c in SWEPT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in self.rows], t) for c, t in zip(COLUMNS, kinds, strict=True)], COLUMNS)
            self.rows = []

    def released(self, node: Node, parent_conv_id: int | None) -> None:
        """Children that waited for the node; without its id they are joined with it later."""
        for row in node.waiting:
            row["parent_conv_id"], row["parent"] = parent_conv_id, None if parent_conv_id is not None else node.id
        self.rows += node.waiting
        node.waiting = []

    def end(self) -> None:
        """The innermost node ends."""
        node, depth = self.stack.pop(), len(self.stack)
        leaves, saved = node.leaves if node.children else 1, node.saved + (node.n - 1) * node.size
        row = {"kind": "hub" if node.hub else "node", "id": node.id, "conv_id": node.least, "depth": depth, "n_convs": node.n, "n_children": node.children}
        row |= {"n_leaves": leaves, "saved_tokens": saved, "ends_sha256": NOTHING if node.ends is None else node.ends}
        self.released(node, node.least)
        if not depth:
            self.rows.append(row)
            return
        under = self.stack[-1]
        under.add(node.n, node.least)
        under.children, under.leaves, under.saved = under.children + 1, under.leaves + leaves, under.saved + saved
        under.waiting.append(row)
        if len(under.waiting) >= WAITING:
            under.hub = True
            self.released(under, None)


class Partition(Sweep):
    """The sweep of one sorted partition of (key, sizes, conv_id)."""

    def __init__(self, part: int):
        super().__init__()
        self.part, self.key, self.ids, self.seq, self.pieces = part, None, [], 0, True
        self.firsts: list[Node] = []  # nodes on the first row's path that ended here

    def add(self, key: bytes, sizes: list[int], conv_id: int) -> None:
        if key != self.key:
            same = -1
            if self.key is not None:
                self.run_ends(False)
                most, same = min(len(key), len(self.key)) // WIDTH, 0
                while same < most and key[WIDTH * same : WIDTH * same + WIDTH] == self.key[WIDTH * same : WIDTH * same + WIDTH]:
                    same += 1
            first = self.key is None
            self.to(same)
            for d in range(same, len(key) // WIDTH):
                if d < 0:
                    self.stack.append(Node(hashlib.md5(b"").digest(), 0, first=first))
                else:
                    self.stack.append(Node(hashlib.md5(self.stack[-1].id + key[WIDTH * d : WIDTH * d + WIDTH]).digest(), sizes[d], first=first))
            self.key, self.pieces = key, first
        self.ids.append(conv_id)
        if len(self.ids) >= PIECE:
            self.piece()

    def to(self, same: int) -> None:
        """Ends nodes deeper than `same`; those of the first path are kept for the stitch."""
        while len(self.stack) > same + 1:
            if self.stack[-1].first:
                node = self.stack.pop()
                self.released(node, None)
                self.firsts.append(node)
            else:
                self.end()

    def piece(self) -> None:
        node, text = self.stack[-1], ",".join(map(str, self.ids))
        node.add(len(self.ids), self.ids[0])
        self.rows.append({"kind": "ids", "id": node.id, "part": self.part, "seq": self.seq, "packed": zstandard.compress(text.encode())})
        self.seq, self.pieces, self.ids, node.ends = self.seq + 1, True, [], ""

    def run_ends(self, last: bool) -> None:
        if not self.ids:
            return
        if self.pieces or last:
            self.piece()
            return
        node = self.stack[-1]
        node.add(len(self.ids), self.ids[0])
        node.ends, self.ids = hashlib.sha256(",".join(map(str, self.ids)).encode()).hexdigest(), []

    def close(self) -> None:
        """The paths of the first and the last row, as far as they part."""
        self.run_ends(True)
        for node in self.stack:
            self.released(node, None)
        shared = [x for x in self.stack if x.first]
        path = {"first": [x.written() for x in shared + self.firsts[::-1]], "shared": len(shared), "last": [x.written() for x in self.stack[len(shared) :]]}
        self.rows.append({"kind": "path", "part": self.part, "packed": zstandard.compress(json.dumps(path).encode())})


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sweep = None
    for b in batches:
        for key, sizes, conv_id, part in zip(*(b.column(c).to_pylist() for c in ("key", "sizes", "conv_id", "part")), strict=True):
            sweep = sweep or Partition(part)
            sweep.add(key, sizes, conv_id)
            yield from sweep.out(8192)
    if sweep:
        sweep.close()
        yield from sweep.out()


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths of partitions in order: the open stack of all before meets the first path, and the last path goes on."""
    sweep = Sweep()

    def to(n: int) -> None:
        while len(sweep.stack) > n:
            sweep.end()

    for b in batches:
        for packed in b.column("packed").to_pylist():
            path = json.loads(zstandard.decompress(packed))
            first, last, same = list(map(_read, path["first"])), list(map(_read, path["last"])), 0
            while same < min(len(first), len(sweep.stack)) and first[same].id == sweep.stack[same].id:
                same += 1
            to(same)
            for node, more in zip(sweep.stack, first, strict=False):
                node.add(more.n, more.least)
                node.children, node.leaves, node.saved = node.children + more.children, node.leaves + more.leaves, node.saved + more.saved
                node.ends = "" if "" in (node.ends, more.ends) else node.ends or more.ends
            sweep.stack += first[same:]
            to(path["shared"])
            sweep.stack += last
            yield from sweep.out(8192)
    to(0)
    yield from sweep.out()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each id's pieces, which come in order."""
    now, digest = None, None
    for b in batches:
        ids, found = [], []
        for i, packed in zip(b.column("id").to_pylist(), b.column("packed").to_pylist(), strict=True):
            if i != now:
                if now is not None:
                    ids.append(now)
                    found.append(digest.hexdigest())
                now, digest = i, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(zstandard.decompress(packed))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(found, pa.string())], ["id", "digest"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()], pa.string())], ["id", "digest"])


def trie(arrays: DataFrame) -> DataFrame:
    """The nodes (RESULT) of conversations (conv_id, turns)."""
    spark = arrays.sparkSession
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["print"]), ""))
    rows = common.written(arrays.select(key.alias("key"), F.col("turns.size").alias("sizes"), "conv_id"), "conversations")  # sampled and then sorted
    placed = rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").withColumn("part", F.spark_partition_id())
    path = f"{common.shared_dir(spark).rstrip('/')}/swept-{uuid.uuid4().hex}"
    placed.transform(common.in_arrow, _swept, SWEPT).write.partitionBy("kind").parquet(path)
    swept = spark.read.schema(SWEPT).parquet(path)

    paths = swept.where("kind = 'path'").select("part", "packed").repartition(1).sortWithinPartitions("part")
    stitched = common.written(paths.transform(common.in_arrow, _stitched, SWEPT), "stitched")
    nodes = swept.where("kind in ('node', 'hub')").select(stitched.columns).union(stitched)

    known = swept.where("kind = 'hub'").select("id", "conv_id").union(stitched.select("id", "conv_id"))
    known = common.written(known.toDF("parent", "_conv_id"), "parents")
    joined = nodes.where("parent is not null").join(common.if_small(known, 48), "parent").withColumn("parent_conv_id", F.col("_conv_id"))
    nodes = nodes.where("parent is null").select("id", *RESULT).union(joined.select("id", *RESULT))

    pieces = swept.where("kind = 'ids'").select("id", "part", "seq", "packed").repartition("id").sortWithinPartitions("id", "part", "seq")
    digests = common.written(pieces.transform(common.in_arrow, _digests, "id binary, digest string"), "digests")
    some = nodes.where("ends_sha256 = ''").join(common.if_small(digests, 128), "id").withColumn("ends_sha256", F.col("digest"))
    return nodes.where("ends_sha256 <> ''").select(*RESULT).union(some.select(*RESULT))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(turn_arrays(conversations(spark, sf_dir))))


OP12_SQL = """
WITH turns AS (SELECT conv_id, md5(length(role) || ':' || role || text) AS print, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
               FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
     ids AS (SELECT conv_id, xor(4294967295, list_reduce([4294967295] || flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
               lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END)) % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
     parts AS (SELECT ids.conv_id, 0 AS own, place, print, size FROM ids JOIN turns t ON t.conv_id = ids.conv_id - ids.conv_id % 100 AND place <= h
               UNION ALL SELECT ids.conv_id, 1, place, print, size FROM ids JOIN turns t ON t.conv_id = ids.conv_id AND place > h),
     seqs AS (SELECT ids.conv_id, coalesce(list(print ORDER BY own, place) FILTER (print IS NOT NULL), []) AS seq, coalesce(list(size ORDER BY own, place) FILTER (print IS NOT NULL), []) AS sizes
              FROM ids LEFT JOIN parts USING (conv_id) GROUP BY ids.conv_id),
     members AS (SELECT conv_id, seq, d::BIGINT AS depth, seq[1:d] AS key, CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS size FROM seqs, LATERAL (SELECT unnest(range(0, len(seq) + 1)) AS d)),
     nodes AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(size) AS saved,
                 sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(seq) = depth), '')) AS ends_sha256 FROM members GROUP BY key, depth),
     kids AS (SELECT key[1:depth - 1] AS key, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
     full_nodes AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN kids USING (key, depth)),
     sums AS (SELECT key[1:a] AS key, a AS depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
              FROM full_nodes, LATERAL (SELECT unnest(range(0, depth + 1)) AS a) GROUP BY ALL)
SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens, x.ends_sha256
FROM full_nodes x JOIN sums USING (key, depth) LEFT JOIN nodes p ON p.depth = x.depth - 1 AND p.key = x.key[1:x.depth - 1]
"""
