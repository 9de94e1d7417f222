"""Operator 11: SimHash near duplicates by a generalised pigeonhole principle, and their connected components.

A fingerprint has a bit set if over half of the 64-bit hashes of a text's 3-word shingles, repeats included, have it.
Equal fingerprints are collapsed to one. If the bits are cut into m parts with thresholds t_i of sum DISTANCE - m + 1, -1
leaving a part out, then fingerprints within DISTANCE bits are within t_i on some part i. So each fingerprint probes the
index of all for the part values within its thresholds, and every pair that comes up is verified.

Correlated bits share a part, by co-occurrence over all fingerprints: what is skewed then is skewed in few parts. Each
fingerprint gets thresholds of its own by dynamic programming over parts: an allocation costs its probes and the candidates
they meet, estimated from counts of all fingerprints' part values in `BINS` bins, whatever the size of the input. Cuts in
two and three parts compete, and one part, which probes all values within DISTANCE, bounds the work of a fingerprint where
every bucket is crowded. Probes of empty bins are left out; bins only ever count too many, so nothing is lost, and any
allocation finds every pair: estimates change the work and not the result.

Texts of fewer than three words are one shingle of all their words. Null, empty and blank texts have the fingerprint zero,
which links like any other. Rows with a null doc_id link like others but never name a component; a component of such rows
alone has a null id. Rows that share a doc_id are documents of their own with that id. Extra columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplespan.llm import common
from triplespan.llm.jaccard_join import components
from triplespan.llm.shingles import U64, mixed

BITS, SHINGLE, SEED, DISTANCE = 64, 3, 42, 2
#: Into how many parts the bits are cut, in each of the ways that compete.
CUTS = (2, 3)
#: Bins of the counts of a part's values, and the ranges in which tasks hand them on.
BINS, RANGES = 1 << 20, 256
#: Shingles hashed, and fingerprints allocated, at a time.
HASHES, QUERIES = 1 << 16, 512
#: Thresholds over 1 are estimated only for fingerprints that others would cost more than this.
CHEAP = 64


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()  # bytes: only A-Z, and only the six space characters
    if not words:
        return 0
    joined, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size, ends[SHINGLE - 1 :]) if len(words) >= SHINGLE else (np.zeros(1, np.int64), ends[-1:])
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(ends), HASHES):
        hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[k : k + HASHES].tolist(), ends[k : k + HASHES].tolist(), strict=False)]
        counts += _bits(np.array(hashes, "<u8")).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(ends), bitorder="little").view("<u8")[0])


def _bits(values: np.ndarray) -> np.ndarray:
    """A row of BITS zeros and ones, lowest bit first, of each value."""
    return np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column("text")], U64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").transform(common.in_arrow, run, "doc_id long, fp long")


def correlation(fps: DataFrame) -> np.ndarray:
    """BITS x BITS absolute correlations of the bits of all rows (fp)."""
    names = [f"c{k}" for k in range(BITS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for b in batches:
            for k in range(0, len(b), HASHES):
                x = _bits(b.column("fp")[k : k + HASHES].to_numpy()).astype(np.float32)  # sums to 2^16 are exact
                total += (x.T @ x).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS), pa.int32()), *map(pa.array, total)], ["bit", *names])

    sums = fps.select("fp").transform(common.in_arrow, run, f"bit int, {', '.join(f'{c} long' for c in names)}").groupBy("bit").agg(*(F.sum(c).alias(c) for c in names))
    both = np.zeros((BITS, BITS))
    for row in sums.collect():  # BITS rows
        both[row["bit"]] = row[1:]
    n = max(1, fps.count())
    mean = both.diagonal() / n
    spread = np.sqrt(mean * (1 - mean))
    scale = np.outer(spread, spread)
    return np.divide(np.abs(both / n - np.outer(mean, mean)), scale, out=np.zeros_like(scale), where=scale > 0)


def grouped_bits(related: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m parts of about equal size; each starts with the most related pair left and takes the bit most related to it."""
    left, parts = set(range(len(related))), []
    for k in range(m):
        size = -(-len(left) // (m - k))
        pairs = [(related[a, b], -a, -b) for a, b in combinations(sorted(left), 2)]
        part = [-x for x in max(pairs)[1:]][:size] if pairs else sorted(left)
        while len(part) < size:
            part.append(max(left - set(part), key=lambda b: (related[b, part].sum(), -b)))
        left -= set(part)
        parts.append(sorted(part))
    return parts


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


@cache
def _flips(mask: int, most: int) -> tuple[np.ndarray, list[int]]:
    """What to xor a value of the part with, by distance up to `most`, and how many are within each distance."""
    bits = [b for b in range(BITS) if mask >> b & 1]
    rings = [[_mask(list(c)) for c in combinations(bits, d)] for d in range(most + 1)]
    return np.array(sum(rings, []), U64), np.cumsum(list(map(len, rings))).tolist()


def _bin(values: np.ndarray, mask: int) -> np.ndarray:
    return (mixed(values ^ mixed(np.array([mask ^ 0x9E3779B97F4A7C15], U64))) // U64((1 << 64) // BINS)).astype(np.int64)


def counts_in_bins(fps: DataFrame, masks: list[int]) -> np.ndarray:
    """How many of the distinct fps have each part's values in each bin: len(masks) x BINS numbers, whatever the input."""
    schema, width = "range int, packed binary", BINS // RANGES

    def batch(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=1).compress
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([pack(c.tobytes()) for c in total.values()], pa.binary())], ["range", "packed"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(masks), BINS), np.int32)
        for b in batches:
            x = b.column("fp").to_numpy().view(U64)
            for k, m in enumerate(masks):
                at, n = np.unique(_bin(x & U64(m), m), return_counts=True)
                total[k, at] += n.astype(np.int32)
        yield batch({k: c for k, c in enumerate(total.reshape(-1, width)) if c.any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, total = zstandard.ZstdDecompressor().decompress, {}
        for b in batches:
            for k, packed in zip(b.column("range").to_pylist(), b.column("packed").to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(unpack(packed), np.int32)
        yield batch(total)

    summed = fps.select("fp").transform(common.in_arrow, count, schema).repartition("range").mapInArrow(add, schema)
    out, unpack = np.zeros((len(masks) * RANGES, width), np.int32), zstandard.ZstdDecompressor().decompress
    for row in summed.toLocalIterator():
        out[row["range"]] = np.frombuffer(unpack(bytes(row["packed"])), np.int32)
    return out.reshape(len(masks), BINS)


def allocated(costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least cost of each row of costs[row, part, t + 1], and its thresholds: the sum of all t + 1 is the largest t + 1."""
    rows, m, states = costs.shape
    best = np.full((rows, states), np.inf)
    best[:, 0] = 0
    choice = np.zeros((rows, m, states), np.int8)
    for i in range(m):
        after = np.full_like(best, np.inf)
        for u in range(states):
            cost = best[:, : states - u] + costs[:, i, u, None]
            better = cost < after[:, u:]
            after[:, u:][better] = cost[better]
            choice[:, i, u:][better] = u
        best = after
    left, out, at = np.full(rows, states - 1), np.zeros((rows, m), np.int8), np.arange(rows)
    for i in range(m - 1, -1, -1):
        out[:, i] = choice[at, i, left]
        left = left - out[:, i]
    return best[:, -1], out - 1


class Allocator:
    """Probes of fingerprints; made once a task."""

    def __init__(self, counts: np.ndarray, cuts: list[list[int]], total: int, distance: int = DISTANCE):
        self.counts, self.cuts, self.total, self.distance = counts, cuts, total, distance
        self.masks = [m for cut in cuts for m in cut]

    def found(self, k: int, x: np.ndarray, most: int) -> np.ndarray:
        """The count of the bin of each value of part k within `most` bits: a row for each of x."""
        mask = self.masks[k]
        return self.counts[k][_bin((x & U64(mask))[:, None] ^ _flips(mask, most)[0], mask)]

    def costs(self, first: int, m: int, x: np.ndarray, most: int) -> np.ndarray:
        """costs[row, part, t + 1]; a bin's count less what other values are expected to bring."""
        out = np.full((len(x), m, self.distance + 2), np.inf)
        out[:, :, 0] = 0
        for i in range(m):
            mask = self.masks[first + i]
            n, sizes = self.found(first + i, x, most), _flips(mask, most)[1]
            cost = (n > 0) * (1 + np.maximum(n - self.total / BINS, 0) + self.total / 2.0 ** mask.bit_count())
            for t, size in enumerate(sizes):
                out[:, i, t + 1] = cost[:, :size].sum(1)
        return out

    def probes(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(part, value, fingerprint) arrays of what the fingerprints x have to look up."""
        whole = _flips((1 << BITS) - 1, self.distance)[1][-1]
        best, way = np.full(len(x), float(whole)), np.zeros(len(x), np.int64)
        thresholds = {0: np.full((len(x), 1), self.distance, np.int8)}
        first = 0
        for c, cut in enumerate(self.cuts):
            if c:  # cut 0 is the whole, whose cost is bounded by its probes
                cost, t = allocated(self.costs(first, len(cut), x, min(1, self.distance)))
                dear = np.flatnonzero(cost > CHEAP) if self.distance > 1 else []
                if len(dear):
                    cost[dear], t[dear] = allocated(self.costs(first, len(cut), x[dear], self.distance))
                thresholds[c], better = t, cost < best
                best[better], way[better] = cost[better], c
            first += len(cut)
        first = 0
        for c, cut in enumerate(self.cuts):
            for i, mask in enumerate(cut):
                for t in range(self.distance + 1):
                    at = np.flatnonzero((way == c) & (thresholds[c][:, i] == t))
                    for k in range(0, len(at), QUERIES // 8):
                        q = x[at[k : k + QUERIES // 8]]
                        n = self.found(first + i, q, t)
                        n[:, 0] -= 1  # its own
                        row, flip = np.nonzero(n > 0)
                        yield np.full(len(row), first + i, np.int32), (q[row] & U64(mask)) ^ _flips(mask, t)[0][flip], q[row]
            first += len(cut)


def links(fps: DataFrame, distance: int = DISTANCE, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """Pairs (a, b), a > b, of the distinct fingerprints `fps` (fp) that differ in at most `distance` bits."""
    related, total = correlation(fps), fps.count()
    parts = [[(1 << BITS) - 1], *([_mask(bits) for bits in grouped_bits(related, m)] for m in cuts)]
    masks = [m for cut in parts for m in cut]
    shared = fps.sparkSession.sparkContext.broadcast(counts_in_bins(fps, masks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allocator = Allocator(shared.value, parts, total, distance)
        for b in batches:
            x = b.column("fp").to_numpy().view(U64)
            for k in range(0, len(x), QUERIES):
                for part, value, query in allocator.probes(x[k : k + QUERIES]):
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(value.view(np.int64)), pa.array(query.view(np.int64))], ["part", "value", "a"])

    probes = common.written(fps.select("fp").transform(common.in_arrow, run, "part int, value long, a long"), "probes")
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    values = F.array(*(F.struct(F.lit(k).cast("int").alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for k, m in enumerate(signed)))
    index = fps.select(F.col("fp").alias("b"), F.explode(values).alias("v")).select("v.part", "v.value", "b")
    near = (F.col("b") < F.col("a")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return probes.join(index, ["part", "value"]).where(near).select("a", "b").distinct()


def joined(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp and component_id of every row of (doc_id, text)."""
    return linked(common.written(fingerprints(docs), "fingerprints"), distance)


def linked(table: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp and component_id of every row of `table` (doc_id, fp), which is read several times."""
    classes = table.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    classes = common.written(classes, "classes")
    comps = components(common.written(links(classes, distance), "links"))
    named = classes.join(common.if_small(comps), F.col("fp") == F.col("node"), "left").where("copies > 1 or component is not null")
    named = named.select("fp", "least", F.coalesce("component", "fp").alias("component"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    names = common.written(named.join(names, "component").select("fp", "component_id", F.lit(True).alias("named")), "names")
    out = table.join(common.if_small(names), "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("named"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = joined(common.documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
