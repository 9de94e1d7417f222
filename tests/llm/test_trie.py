"""The prefix trie against one of dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from triplespan.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def remainder(n, m):
    """As SQL has it: of the sign of n."""
    return n - m * int(n / m)


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    out = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - remainder(c, 100), [])[:h] + t[h:]
    return out


def expected(seqs):
    """RESULT rows of the nodes of {conv_id: turns}, a turn being (role, text)."""
    members = defaultdict(list)
    for c, t in seqs.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = defaultdict(list)
    for key in members:
        if key:
            kids[key[:-1]].append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        leaves[key] = sum(leaves[k] for k in kids[key]) or 1
        saved[key] = sum(saved[k] for k in kids[key]) + (len(members[key]) - 1) * (len(key[-1][1]) if key else 0)
    out = []
    for key, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(key))))
        out.append((min(m), len(key), min(members[key[:-1]]) if key else None, len(m), len(kids[key]), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select(*prefix_trie.RESULT).collect()), key=repr)


def messy():
    rng, rows = random.Random(5), []
    first = [("user", f"hello {k}") for k in range(3)]
    for c in [*range(-120, 260), *range(1100, 1130), 10**12, 10**12 + 7]:
        turns = [rng.choice(first)] + [(rng.choice(["user", "assistant", None]), rng.choice(["", None, "é😀", "yes", "no", f"word {rng.randrange(9)}"])) for _ in range(rng.randrange(7))]
        rows += [(c, None if k == 1 and c % 7 == 0 else k // 2 if c % 5 == 0 else k, r, t) for k, (r, t) in enumerate(turns)]
    rows += [(None, 1, "user", "lost"), (5, 1, "user", "twice"), (5, 1, "user", "twice"), *((c, k, "user", "the same") for c in range(3000, 3400) for k in range(3))]
    rows += [(9000, k, "user", f"long {k % 40}") for k in range(300)] + [(9002, k, "user", f"long {k % 40}") for k in range(299)]
    rng.shuffle(rows)
    return rows


def test_whole_trie(spark):
    rows = messy()
    want = expected(rebuilt(rows))
    df = spark.createDataFrame(rows, SCHEMA)
    trie = lambda df: found(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turn_arrays(df))))
    assert trie(df) == want
    extra = df.withColumns({n: F.lit("x") for n in ("turns", "place", "print", "size", "kind", "id", "parent", "part", "key", "depth", "_host")})
    assert trie(extra.orderBy(F.desc("text"))) == want
    assert trie(df.limit(0)) == []


def test_without_turns(spark):
    """Conversations that lose all their turns end at the root."""
    few = [c for c in range(100) if zlib.crc32(str(700 + c).encode()) % 6 >= 2][1:4]
    rows = [(700 + c, 0, "user", "gone") for c in few]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turn_arrays(df)))) == expected(rebuilt(rows)) and not any(rebuilt(rows).values())


@pytest.mark.parametrize("seed", range(12))
def test_any_partition(monkeypatch, seed):
    """Rows cut at any places, also within copies, with small pieces and few nodes waiting, give the same nodes."""
    monkeypatch.setattr(prefix_trie, "PIECE", 1 + seed % 4)
    monkeypatch.setattr(prefix_trie, "WAITING", 1 + seed % 3)
    rng = random.Random(seed)
    seqs = {c: [("r", "x" * rng.choice([1, 1, 1, 2, 3])) for _ in range(rng.choice([0, 1, 2, 3, 3, 5]))] for c in rng.sample(range(1000), 80)}
    prints = lambda t: b"".join(hashlib.md5(x[1].encode()).digest() for x in t)
    rows = sorted((prints(t), [len(x[1]) for x in t], c) for c, t in seqs.items())
    rows.sort(key=lambda r: (r[0], r[2]))
    cuts = sorted({0, len(rows), *(rng.randrange(len(rows)) for _ in range(rng.randrange(1, 30)))})
    swept = []
    for part, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        key, sizes, ids = zip(*rows[a:b], strict=True)
        batch = pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(sizes, pa.list_(pa.int64())), pa.array(ids), pa.array([part] * len(ids))], ["key", "sizes", "conv_id", "part"])
        swept += [r for out in prefix_trie._swept(iter([batch.slice(0, 3), batch.slice(3)])) for r in out.to_pylist()]
    paths = pa.array([r["packed"] for r in swept if r["kind"] == "path"], pa.binary())
    stitched = [r for out in prefix_trie._stitched(iter([pa.RecordBatch.from_arrays([paths], ["packed"])])) for r in out.to_pylist()]
    pieces = sorted((r["id"], r["part"], r["seq"], r["packed"]) for r in swept if r["kind"] == "ids")
    columns = [pa.array([p[k] for p in pieces], pa.binary()) for k in (0, 3)]
    digests = {r["id"]: r["digest"] for out in prefix_trie._digests(iter([pa.RecordBatch.from_arrays(columns, ["id", "packed"])])) for r in out.to_pylist()}
    known = {r["id"]: r["conv_id"] for r in swept if r["kind"] == "hub"} | {r["id"]: r["conv_id"] for r in stitched}
    got = []
    for r in [r for r in swept if r["kind"] in ("node", "hub")] + stitched:
        r["parent_conv_id"] = r["parent_conv_id"] if r["parent"] is None else known[r["parent"]]
        r["ends_sha256"] = r["ends_sha256"] or digests[r["id"]]
        got.append(tuple(r[c] for c in prefix_trie.RESULT))
    assert sorted(got, key=repr) == expected(seqs)
