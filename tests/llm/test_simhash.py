"""Fingerprints against plain Python, and links against all pairs."""

import random

import numpy as np
import pytest
import xxhash
from helpers import frame, prose, texts, words
from pyspark.sql import functions as F

from triplespan.llm import simhash_join
from triplespan.llm.shingles import U64

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    w = words((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, distance=2):
    """[(doc_id, fp)] -> smallest doc_id reachable of each fp."""
    least = {}
    for i, f in fps:
        least[f] = min(i, least.get(f, i))
    root = {f: f for f in least}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    keys = list(root)
    for k, a in enumerate(keys):
        for b in keys[:k]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    out = {}
    for f, i in least.items():
        out[find(f)] = min(i, out.get(find(f), i))
    return {f: out[find(f)] for f in root}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def families(seed):
    """Chains and clusters about some fingerprints, copies, skewed bits, and zero."""
    rng, out = random.Random(seed), [0, 0, (1 << 64) - 1, 1 << 63]
    common_ = rng.getrandbits(64)
    for k in range(60):
        f = rng.getrandbits(64) if k % 3 else common_ ^ (rng.getrandbits(64) & 0xFFFF)  # a third share 48 bits
        for _ in range(rng.randrange(1, 9)):
            out.append(f)
            for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
                f ^= 1 << rng.randrange(64)
    center = rng.getrandbits(64)
    out += [center ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    rows = families(seed)
    want = plain_components(rows)
    df = spark.createDataFrame([(i, signed(f)) for i, f in rows], "doc_id long, fp long")
    got = simhash_join.linked(df).collect()
    assert len(got) == len(rows) and all(r["component_id"] == want[r["fp"] % (1 << 64)] for r in got)
    assert len(set(want.values())) < len(want) - 30
    fps = df.select("fp").distinct()
    for distance, cuts in ((1, (2,)), (3, (2, 4)), (2, ())):  # other distances, and all values of one part
        pairs = {(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash_join.links(fps, distance, cuts).collect()}
        keys = sorted({f for _, f in rows})
        assert {frozenset(p) for p in pairs} == {frozenset((a, b)) for k, a in enumerate(keys) for b in keys[:k] if (a ^ b).bit_count() <= distance}


def test_allocation():
    """The least cost of all thresholds with the sum that the principle asks for."""
    from itertools import product

    rng = np.random.default_rng(4)
    for m, most in ((2, 2), (3, 2), (4, 3), (1, 2)):
        costs = np.concatenate([np.zeros((50, m, 1)), rng.integers(0, 20, (50, m, most + 1)).cumsum(2).astype(float)], 2)
        cost, t = simhash_join.allocated(costs)
        assert (t.sum(1) == most - m + 1).all()
        for row in range(50):
            least = min(sum(costs[row, i, u] for i, u in enumerate(us)) for us in product(range(most + 2), repeat=m) if sum(us) == most + 1)
            assert cost[row] == least == sum(costs[row, i, x + 1] for i, x in enumerate(t[row]))


def test_crowded_buckets():
    """Where every bucket is crowded, a fingerprint looks up all values near it, and never more probes than those."""
    counts = np.full((6, simhash_join.BINS), 10**6, np.int32)
    full = (1 << 64) - 1
    parts = [[full], [0xFFFFFFFF, full ^ 0xFFFFFFFF], [0x1FFFFF, 0x1FFFFF << 21, full >> 42 << 42]]
    x = np.array([5, 1 << 60], U64)
    rows = [p for out in simhash_join.Allocator(counts, parts, 10**9).probes(x) for p in zip(*out, strict=True)]
    assert len(rows) == 2 * 2081 and {int(p[0]) for p in rows} == {0}


def test_grouped_bits():
    """Bits that go together share a part."""
    related = np.eye(64)
    for a in range(64):
        for b in range(64):
            related[a, b] = 1.0 if a % 2 == b % 2 else 0.0
    assert sorted(simhash_join.grouped_bits(related, 2)) == [list(range(0, 64, 2)), list(range(1, 64, 2))]
    assert sorted(map(len, simhash_join.grouped_bits(related, 3))) == [21, 21, 22]


def test_fingerprints(spark):
    got = {(r["doc_id"], r["fp"] % (1 << 64)) for r in simhash_join.fingerprints(frame(spark)).collect()}
    assert got == {(r["doc_id"], plain_fingerprint(r["text"])) for r in frame(spark).collect()}
    long = prose(3, 70_000)  # more than one step
    assert simhash_join.fingerprint(long) == plain_fingerprint(long)
    assert simhash_join.fingerprint("one two") == xxhash.xxh64_intdigest(b"one two", 42) and simhash_join.fingerprint(" \n") == 0
    one = spark.sql("SELECT xxhash64('one two three') AS h").first()["h"]
    assert simhash_join.fingerprint("One  two\nTHREE") == one % (1 << 64)


def test_documents(spark):
    base = prose(5, 400).split()
    rows = [" ".join(base), " ".join(base[:399]), None, "", " \t", " ".join(base), prose(6, 50)]
    fps = [(i, plain_fingerprint(t)) for i, t in enumerate(rows)]
    want = plain_components(fps)
    got = simhash_join.joined(texts(spark, *rows).withColumns({n: F.lit("x") for n in ("fp", "a", "component_id")})).collect()
    assert {(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got} == {(i, f, want[f]) for i, f in fps}
    assert want[fps[5][1]] == 0 and want[0] == 2  # texts without words have the fingerprint zero


def test_null_ids(spark):
    rows = [(None, prose(1, 30)), (None, prose(1, 30)), (None, prose(2, 30)), (4, prose(2, 30)), (3, prose(2, 30)), (None, prose(3, 30))]
    got = simhash_join.joined(frame(spark, [(i, t, None, None, None) for i, t in rows])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 0), (0, 0), (0, 3), (3, 3), (4, 3)]
