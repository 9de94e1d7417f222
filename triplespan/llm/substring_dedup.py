"""Operator 4: substring deduplication over a log-structured fingerprint index.

A window is 13 consecutive words of one document; words are taken unchanged. Its fingerprint in the index is its
anchor: the least hash of its 6-word shingles. Equal windows have equal anchors, and neighbouring windows mostly share
one, so the index holds about a fifth as many rows as there are words. `FingerprintIndex` keeps sorted immutable runs
(anchor, first, last document) below a path; each new batch is merge-joined with the runs and becomes a run itself; more
than `MOST_RUNS` runs are compacted to one before the next batch reads them. A later session can open the path and add the
next batch, in any order of ids. What comes out are hits: documents and the anchors that they share with another one.

Hits are then verified. Only windows on shared anchors are compared, by 128 bits of two independent hashes of their
words; the smallest doc_id owns a window, and every later document loses the words under it. Whole copies of an
earlier text lose every word if they have 13 or more, and take no part in the rest.

Null and blank texts have no words. Repeated rows (same doc_id and text) get the same result and do not remove each
other. Rows with a null doc_id keep all words and own nothing. Extra columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplespan.llm import common
from triplespan.llm.shingles import SECOND, U64, Words, mixed, parts

WINDOW, ANCHOR, MOST_RUNS, BATCHES = 13, 6, 1, 3
#: A side of at most this many bytes, as counted, is broadcast; larger ones are shuffled.
BROADCAST_BYTES = 32 << 20


def anchor_hashes(words: Words) -> np.ndarray:
    """For the window from each word on, the least hash of its shingles."""
    s = words.windows(ANCHOR)
    s[~words.whole(ANCHOR)] = U64((1 << 64) - 1)
    least = s.copy()
    for i in range(1, WINDOW - ANCHOR + 1):
        least[:-i] = np.minimum(least[:-i], s[i:])
    return least


def anchors(docs: DataFrame) -> DataFrame:
    """(anchor, doc_id) of every window of (doc_id, text), without neighbouring repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for i, j in parts(b):
                w = Words(b.column("text")[i:j])
                at = np.flatnonzero(w.whole(WINDOW))
                found, doc = anchor_hashes(w)[at].astype(np.int64), np.repeat(ids[i:j], np.diff(w.first))[at]
                new = np.concatenate([[True], (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])])[: len(at)]
                yield pa.RecordBatch.from_arrays([pa.array(found[new], pa.int64()), pa.array(doc[new], pa.int64())], ["anchor", "doc_id"])

    return docs.where("doc_id is not null").select("doc_id", "text").transform(common.in_arrow, run, "anchor long, doc_id long")


class FingerprintIndex:
    """Sorted immutable runs of (anchor, first, last) below a path, which another session can open again.

    first and last are the smallest and largest document with an anchor; they tell whether it is shared, and compaction
    loses nothing that a later batch needs. A run is a Parquet table in buckets by anchor, each sorted, so that a batch
    is merge-joined with history without moving it. All runs of an index have as many buckets as the session that made it
    has shuffle partitions: the grouping of a batch then leaves each bucket in one task. A run counts once it is whole; one
    that a lost compaction leaves beside its sources does no harm. Batches may come in any order of doc_id: where one brings
    a smaller owner of an anchor, the owner until then comes out again, as a later document. Names in the catalog last only
    while a table is opened.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, most_runs: int = MOST_RUNS):
        self.spark, self.most_runs = spark, most_runs
        self.path = path or f"{common.shared_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
        found = self.runs()
        self.buckets = int(found[0].rsplit("-", 2)[1]) if found else int(spark.conf.get("spark.sql.shuffle.partitions"))

    def runs(self) -> list[str]:
        """Paths of the whole runs, run-<buckets>-<name>."""
        jvm = self.spark.sparkContext._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.path}/run-*/_SUCCESS")
        marks = pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
        return sorted(m.getPath().getParent().toString() for m in marks or [])

    def run(self, path: str) -> DataFrame:
        """A run as a table that Spark knows to be bucketed."""
        name, place = f"run_{uuid.uuid4().hex}", path.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE {name} (anchor BIGINT, first BIGINT, last BIGINT) USING parquet CLUSTERED BY (anchor) SORTED BY (anchor) INTO {self.buckets} BUCKETS LOCATION '{place}'")
        rows = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # its files stay, and the plan knows them
        return rows

    def _store(self, rows: DataFrame) -> DataFrame:
        path, name = f"{self.path}/run-{self.buckets}-{uuid.uuid4().hex}", f"run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "anchor").sortBy("anchor").format("parquet").option("path", path).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")
        return self.run(path)

    def add(self, docs: DataFrame) -> DataFrame:
        """Hits (doc_id, anchor, is_first) that the batch brings, of its own documents and of earlier ones whose anchors
        become shared."""
        if len(self.runs()) > self.most_runs:
            self.compact()
        found, old = anchors(docs), self.runs()
        run = self._store(found.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")))
        met, past, past_last = run, F.lit(None).cast("long"), F.lit(None).cast("long")
        for k, path in enumerate(old):  # merge-joins of sorted buckets
            met = met.join(self.run(path).select("anchor", F.col("first").alias(f"first{k}"), F.col("last").alias(f"last{k}")), "anchor", "left")
            past, past_last = F.least(past, F.col(f"first{k}")), F.greatest(past_last, F.col(f"last{k}"))
        met = met.select("anchor", "first", "last", past.alias("past"), past_last.alias("past_last")).where("past is not null or first < last")
        # an earlier owner comes out if it had the anchor alone until now, or is no owner any more
        again = F.when((F.col("past") == F.col("past_last")) | (F.col("first") < F.col("past")), F.col("past"))
        met = common.written(met.select("anchor", F.least("past", "first").alias("first"), again.alias("again")), "met")
        mine = found.join(met, "anchor").select("doc_id", "anchor", (F.col("doc_id") == F.col("first")).alias("is_first"))
        theirs = met.where("again is not null").select(F.col("again").alias("doc_id"), "anchor", (F.col("again") == F.col("first")).alias("is_first"))
        return common.written(mine.union(theirs), "hits")

    def compact(self) -> None:
        """Merges all runs to one, bucket by bucket, and deletes them."""
        old = self.runs()
        if len(old) < 2:
            return
        rows = self.run(old[0])
        for path in old[1:]:
            other = self.run(path).toDF("anchor", "first_", "last_")
            rows = rows.join(other, "anchor", "full").select("anchor", F.least("first", "first_").alias("first"), F.greatest("last", "last_").alias("last"))
        self._store(rows)
        common.removed(self.spark, *old)


def of_document(anchor: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys of anchors within documents. Two that met by chance would only add windows to those that are verified."""
    return anchor + mixed(doc.astype(U64))


def listed(lists: pa.ListArray) -> np.ndarray:
    """`of_document` of a column of anchors, by place of the row."""
    doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return of_document(lists.flatten().to_numpy(zero_copy_only=False).astype(U64), doc)


def windows_on(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """(window, verify, doc_id, text_key, start, later) of the windows whose anchors are hits of their document;
    later: another document has the anchor first."""
    wanted = hits.groupBy("doc_id").agg(F.collect_list(F.when(F.col("is_first"), F.col("anchor"))).alias("firsts"), F.collect_list(F.when(~F.col("is_first"), F.col("anchor"))).alias("laters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in parts(b):
                part = b.slice(i, j - i)
                w = Words(part.column("text"))
                start = np.flatnonzero(w.whole(WINDOW))
                doc = np.repeat(np.arange(len(part)), np.diff(w.first))[start]
                key = of_document(anchor_hashes(w)[start], doc)
                head = np.ones(len(key), bool)  # neighbours mostly share an anchor
                head[1:] = key[1:] != key[:-1]
                run_of = np.cumsum(head) - 1
                late, known = (np.isin(key[head], listed(part.column(c)))[run_of] for c in ("laters", "firsts"))
                at = np.flatnonzero(late | known)
                start, doc, late = start[at], doc[at], late[at]
                two = [w.windows_at(WINDOW, start, words).astype(np.int64) for words in (w.hash, w.hashed(SECOND))]
                ids, keys = (part.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("doc_id", "text_key"))
                yield pa.RecordBatch.from_arrays([*map(pa.array, two), pa.array(ids), pa.array(keys), pa.array((start - w.first[doc]).astype(np.int32)), pa.array(late)], ["window", "verify", "doc_id", "text_key", "start", "later"])

    schema = "window long, verify long, doc_id long, text_key long, start int, later boolean"
    return docs.select("doc_id", "text", "text_key").join(wanted, "doc_id").transform(common.in_arrow, run, schema)


def lost_windows(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """(doc_id, text_key, start) of the windows that a smaller document owns."""
    found = windows_on(docs, hits)
    # counted and written first, so that the join below can split a window of very many documents over tasks
    owners = found.groupBy("window", "verify").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").select("window", "verify", "owner")
    owners = common.written(owners, "owners")
    return found.where("later").join(owners, ["window", "verify"]).where("owner < doc_id").select("doc_id", "text_key", "start")


def removals(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(doc_id, text_key, whole, ranges): the words that go, as starts and ends in turn; whole: a copy of an earlier text."""
    known = docs.where("doc_id is not null and text is not null")
    texts = known.select("doc_id", "text_key", F.xxhash64(F.lit(1), "text").alias("second"))
    firsts = texts.groupBy("text_key", "second").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    firsts = common.written(firsts, "firsts")  # before the join, so that it can split a text of very many copies
    copies = common.written(texts.join(firsts, ["text_key", "second"]).where("doc_id > first").select("doc_id", "text_key").distinct(), "copies")
    small = 16 * copies.count() <= BROADCAST_BYTES
    rest = known.join(F.broadcast(copies) if small else copies, ["doc_id", "text_key"], "left_anti")
    index, hits = FingerprintIndex(docs.sparkSession), None
    lo, hi = known.agg(F.min("doc_id"), F.max("doc_id")).first()
    lo, hi = (0, -1) if lo is None else (lo, hi)
    step = max(1, -(-(hi - lo + 1) // batches))
    for start in range(lo, hi + 1, step):
        got = index.add(rest.where((F.col("doc_id") >= start) & (F.col("doc_id") < start + step)))
        hits = got if hits is None else hits.union(got)
    whole = copies.select("doc_id", "text_key", F.lit(True).alias("whole"), F.array().cast("array<int>").alias("ranges"))
    if hits is None:
        return whole
    lost = lost_windows(rest, hits).groupBy("doc_id", "text_key").agg(F.collect_set("start").alias("starts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ranges = []
            for s in b.column("starts"):
                at = np.sort(s.values.to_numpy())
                gap = np.flatnonzero(at[1:] > at[:-1] + WINDOW)
                ends = np.concatenate([at[gap], at[-1:]]) + WINDOW
                ranges.append(np.stack([np.concatenate([at[:1], at[gap + 1]]), ends], 1).ravel().astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array([False] * len(b)), pa.array(ranges, pa.list_(pa.int32()))], ["doc_id", "text_key", "whole", "ranges"])

    return lost.transform(common.in_arrow, run, "doc_id long, text_key long, whole boolean, ranges array<int>").union(whole)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))


def deduplicated(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, words before and after, and the kept words of (doc_id, text) joined by one space."""
    return _kept(docs, batches, "doc_id long, n_words long, n_removed long, kept string", lambda kept: kept.decode())


def _kept(docs: DataFrame, batches: int, schema: str, of) -> DataFrame:
    """The last pass: removals are broadcast if they are small, as counted, and else joined by a shuffle."""
    docs = keyed(docs)
    gone = common.written(removals(docs, batches), "removals")
    rows, bounds = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("ranges")), F.lit(0))).first()
    gone = F.broadcast(gone) if 48 * rows + 4 * bounds <= BROADCAST_BYTES else gone
    name = schema.split()[-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, lost, out = [], [], []
            for text, whole, ranges in zip(*(b.column(c) for c in ("text", "whole", "ranges")), strict=True):
                words = (text.as_py() or "").encode().split()
                counts.append(len(words))
                if whole.as_py() and len(words) >= WINDOW:
                    kept = []
                elif cut := ranges.as_py():
                    edges = [0, *cut, len(words)]
                    kept = [w for a, e in zip(edges[::2], edges[1::2], strict=True) for w in words[a:e]]
                else:
                    kept = words
                lost.append(len(words) - len(kept))
                out.append(of(b" ".join(kept)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(lost, pa.int64()), pa.array(out, pa.string())], ["doc_id", "n_words", "n_removed", name])

    return docs.join(gone, ["doc_id", "text_key"], "left").select("doc_id", "text", "whole", "ranges").transform(common.in_arrow, run, schema)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return _kept(common.documents(spark, sf_dir), BATCHES, schema, lambda kept: hashlib.sha256(kept).hexdigest())
