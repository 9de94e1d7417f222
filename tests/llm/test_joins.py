"""Near duplicates and repeated passages against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import frame, prose, texts, words
from pyspark.sql import functions as F

from triplespan.llm import jaccard_join, shingles, substring_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(rows):
    """(size of set, smallest id) by all pairs, of rows with distinct ids."""
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if b < a and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed):
    """Chains of ever more edited texts, shared passages, and texts about the threshold."""
    rng = random.Random(seed)
    passage, out = prose(seed + 900, 60), []
    for family in range(6):
        text = prose(seed * 100 + family, rng.choice([12, 40, 90, 150]))
        for _ in range(12):
            out.append(text)
            text = edited(rng, text, rng.randint(0, 3))
    out += [f"{passage} {prose(seed + 5000 + k, k)}" for k in range(0, 60, 3)]
    out += [prose(seed + 7000 + k, 5) for k in range(3)] + ["a b c", "A b C", "", None]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rows = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.joined(texts(spark, *(t for _, t in rows))).collect()}
    want = components(rows)
    assert got == want and len({c for _, c in want.values()}) < len(want) - 20


def test_cases(spark):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.joined(frame(spark)).collect()}
    assert got[1] == (196, 1) and got[2][1] == 1 and got[3][1] == 1 and got[11][1] == 11
    assert got[4] == (0, 4) and got[5] == (0, 5) and got[6] == (0, 6)  # linked with nothing
    assert got[7] == got[8] == (1, 7) and got[9][1] == 9 and jaccard_join.joined(frame(spark)).count() == 17
    assert jaccard_join.joined(frame(spark, [])).count() == 0


def test_null_ids(spark):
    """Rows without an id link like others, and never name a component."""
    base = prose(3, 60)
    rows = [(1, base), (2, base), (3, base + " tail"), (None, base), (None, prose(4, 40)), (None, prose(4, 40)), (7, prose(5, 40)), (None, prose(5, 40) + " end")]
    got = jaccard_join.joined(frame(spark, [(i, t, None, None, None) for i, t in rows])).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in got if r["component_id"] is not None) == [(0, 37, 7), (0, 56, 1), (1, 56, 1), (2, 56, 1), (3, 57, 1), (7, 36, 7)]
    assert sum(r["component_id"] is None for r in got) == 2


def test_same_id_with_other_texts(spark):
    rows = [(5, prose(1, 30)), (5, prose(2, 30)), (5, prose(2, 30)), (6, prose(2, 30) + " x"), (7, prose(1, 30) + " y")]
    got = jaccard_join.joined(frame(spark, [(i, t, None, None, None) for i, t in rows]).withColumn("row", F.lit(1)).withColumn("n", F.lit(2)).withColumn("component_id", F.lit("c"))).collect()
    assert sorted(map(tuple, got)) == [(5, 26, 5), (5, 26, 5), (5, 26, 5), (6, 27, 5), (7, 27, 5)]


def changed(words, *places, mark="x"):
    return [f"{mark}{k}" if k in places else w for k, w in enumerate(words)]


def test_member_behind_a_head(spark):
    """A document that links with a group's member and not with the group's head: passages that other texts repeat keep the
    member's and the head's own words out of their prefixes, which are equal."""
    m = prose(41, 104).split()
    h, d = changed(m, 20, 40), changed(m, 60, 80)
    passages = [" ".join(t[p - 4 : p + 5]) for t in (h, m) for p in (20, 40) for _ in range(12)]
    for order in ((h, m, d), (d, m, h)):
        rows = list(enumerate([*(" ".join(t) for t in order), *passages]))
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.joined(texts(spark, *(t for _, t in rows))).collect()}
        assert got == components(rows) and [got[k][1] for k in range(3)] == [0, 0, 0]


def grouped(seed):
    """Families of texts whose edits other texts repeat, so that many have equal prefixes, in all distances from their heads."""
    rng, out = random.Random(seed), []
    for family in range(4):
        base = prose(seed * 50 + family, rng.randint(90, 130)).split()
        places = rng.sample(range(6, len(base) - 6), 9)
        for p in places:
            for t in (base, changed(base, p)):
                out += [" ".join(t[p - 5 : p + 6])] * 15
        for _ in range(14):
            t = changed(base, *rng.sample(places, rng.randrange(0, 6)))
            out.append(" ".join(changed(t, *(rng.randrange(len(t)) for _ in range(rng.choice([0, 0, 1, 3]))), mark="y")))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [3, 4])
def test_groups_are_expanded(spark, monkeypatch, seed):
    rows, expand, sizes = grouped(seed), jaccard_join._Links.expand, []
    monkeypatch.setattr(jaccard_join._Links, "expand", lambda self, members: sizes.append(members.count()) or expand(self, members))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.joined(texts(spark, *(t for _, t in rows))).collect()}
    assert got == components(rows) and sizes[0] > 2


@pytest.mark.parametrize("crowded", [0, 16])
def test_edited_copies_of_an_absent_text(spark, monkeypatch, crowded):
    """Many edited copies of a text that is not there itself, so that no hub links with all of them."""
    monkeypatch.setattr(jaccard_join, "CROWDED", crowded)
    rng = random.Random(7)
    text = prose(77, 120)
    rows = list(enumerate([edited(rng, text, rng.randint(1, 5)) for _ in range(150)]))
    met, join = [], jaccard_join.verified
    monkeypatch.setattr(jaccard_join, "verified", lambda docs, classes, pairs, percent: met.append(pairs.count()) or join(docs, classes, pairs, percent))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.joined(texts(spark, *(t for _, t in rows))).collect()}
    assert got == components(rows) and sum(met) < 2000  # of 11175 pairs


def without_repeats(rows):
    """doc_id -> kept words, by all windows of all documents."""
    owner = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            owner[key] = min(owner.get(key, i), i)
    out = {}
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - 12):
            if owner[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        out[i] = [x for k, x in enumerate(w) if k not in gone], len(w)
    return out


@pytest.mark.parametrize("batches", [1, 4])
def test_passages(spark, batches):
    rng = random.Random(batches)
    passages = [prose(k, rng.choice([12, 13, 30, 80])) for k in range(12)]
    rows = []
    for i in range(90):
        parts = [prose(500 + i, rng.randint(0, 30))] + rng.sample(passages, rng.randint(0, 3)) + [prose(900 + i, rng.randint(0, 9))]
        rng.shuffle(parts)
        rows.append((i, " ".join(parts)))
    rows += [(90, rows[3][1]), (91, rows[3][1]), (92, "x y " * 60), (93, "x y " * 40), (94, None), (95, ""), (96, passages[2][:-1])]
    got = {r["doc_id"]: (r["kept"], r["n_words"], r["n_removed"]) for r in substring_dedup.deduplicated(texts(spark, *(t for _, t in rows)), batches).collect()}
    want = {i: (" ".join(kept), n, n - len(kept)) for i, (kept, n) in without_repeats(rows).items()}
    assert got == want and sum(x[2] for x in want.values()) > 1000


def test_copies_beyond_broadcast(spark, monkeypatch):
    """Whole copies leave one row each, also where they are too many to be broadcast."""
    passage = prose(1, 60)
    rows = [(i, f"{prose(100 + i, 20)} {passage} {prose(200 + i, 9)}") for i in range(6)]
    rows += [(i, rows[i % 3][1]) for i in range(6, 12)] + [(12, "few words"), (13, "few words"), (14, prose(7, 30))]
    df = texts(spark, *(t for _, t in rows))
    small = sorted(map(tuple, substring_dedup.deduplicated(df).collect()))
    monkeypatch.setattr(substring_dedup, "BROADCAST_BYTES", 0)
    found = sorted(map(tuple, substring_dedup.deduplicated(df).collect()))
    assert found == small == [(i, n, n - len(kept), " ".join(kept)) for i, (kept, n) in sorted(without_repeats(rows).items())]


def test_index_across_sessions(spark, tmp_path):
    """Batches that sessions add one after another bring the hits that one index over all of them brings; compaction and
    opening again change nothing, and history is not shuffled."""
    shared = [prose(k, 40) for k in range(5)]
    rows = [(i, f"{prose(50 + i, 15)} {shared[i % 5] if i % 3 else ''} {prose(90 + i, 8)}") for i in range(40)]
    batch = lambda a, b: frame(spark, [(i, t, None, None, None) for i, t in rows[a:b]])
    hits = lambda df: {(r["doc_id"], r["anchor"]) for r in df.collect()}
    path, got = str(tmp_path / "index"), set()
    for k, (a, b) in enumerate([(0, 10), (10, 20), (20, 30), (30, 40)]):
        session = spark.newSession() if k % 2 else spark
        session.conf.set("spark.sql.shuffle.partitions", "8" if k % 2 == 0 else "5")
        index = substring_dedup.FingerprintIndex(session, path, most_runs=2)
        assert index.buckets == 8
        got |= hits(index.add(session.createDataFrame(batch(a, b).collect(), "doc_id long, text string, lang string, source string, n_chars long")))
        assert len(index.runs()) == (k + 1 if k < 3 else 2)  # three are compacted before the fourth batch reads them
    index = substring_dedup.FingerprintIndex(spark, path)
    index.compact()
    assert len(index.runs()) == 1 and got == hits(substring_dedup.FingerprintIndex(spark).add(batch(0, 40)))
    one, two = index.run(index.runs()[0]), index._store(index.run(index.runs()[0]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = one.join(two.withColumnRenamed("first", "f"), "anchor")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_index_in_any_order(spark, tmp_path):
    """Batches out of order lose the same windows, a path may hold any characters, and no names stay in the catalog."""
    shared = [prose(k, 40) for k in range(5)]
    rows = [(i, f"{prose(50 + i, 15)} {shared[i % 5] if i % 3 else ''} {shared[i * i % 5] if i % 4 else ''} {prose(90 + i, 8)}") for i in range(40)]
    docs = substring_dedup.keyed(texts(spark, *(t for _, t in rows)))
    cuts = sorted({0, len(rows) // 4, len(rows) // 2, 3 * len(rows) // 4, len(rows)})
    batches = [docs.where(F.col("doc_id").between(a, b - 1)) for a, b in zip(cuts, cuts[1:], strict=False)]
    lost = []
    for k, order in enumerate([(0, 1, 2, 3), (3, 1, 0, 2)]):
        index = substring_dedup.FingerprintIndex(spark, f"{tmp_path}/it's {k}")
        hits = [index.add(batches[i]) for i in order]
        hits = hits[0].union(hits[1]).union(hits[2]).union(hits[3])
        lost.append({tuple(r) for r in substring_dedup.lost_windows(docs, hits).collect()})
    assert lost[0] == lost[1] and len(lost[0]) > 50
    one = [spark.createDataFrame([(i, prose(12, 13), None, None, None)], "doc_id long, text string, lang string, source string, n_chars long") for i in (5, 1)]
    index = substring_dedup.FingerprintIndex(spark)
    hits = index.add(one[0]).union(index.add(one[1]))
    assert sorted((r["doc_id"], r["is_first"]) for r in hits.select("doc_id", "is_first").distinct().collect()) == [(1, True), (5, False)]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("run_")]


def test_passage_cases(spark):
    found = substring_dedup.deduplicated(frame(spark)).collect()
    by_id = {r["doc_id"]: r for r in found}
    assert len(found) == 17 and by_id[1]["n_removed"] == 0 and by_id[2]["kept"] == "" and by_id[11]["n_removed"] == 200
    assert by_id[9]["n_removed"] == 0 and by_id[None]["n_removed"] == 0 and by_id[4]["n_words"] == 0
    assert substring_dedup.deduplicated(frame(spark, [])).count() == 0


def test_query(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup.common, "documents", lambda spark, _: frame(spark))
    rows = {r["doc_id"]: r for r in substring_dedup.op4_substring_dedup(spark, "").collect()}
    assert rows[2]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert rows[12]["kept_sha256"] == hashlib.sha256(b"a b c d e").hexdigest()


def test_powers_are_made_once_and_hashes_of_some_windows_are_those_of_all():
    for n in (0, 1, 1023, 1025, 5000, shingles.CHUNK, shingles.CHUNK + 1, 3 * shingles.CHUNK + 7):
        got = shingles.powers(shingles.BASE, n)
        assert len(got) == n and all(int(got[k]) == pow(shingles.BASE, k, 1 << 64) for k in {*range(0, n, 997), *range(max(0, n - 3), n)})
    assert np.shares_memory(shingles.powers(shingles.BASE, 10), shingles.powers(shingles.BASE, shingles.CHUNK))
    words = shingles.Words(pa.array([prose(1, 50), None, "few words", prose(2, 13)]))
    second = shingles.Words(pa.array([prose(1, 50), None, "few words", prose(2, 13)]), table=shingles.SECOND)
    at = np.flatnonzero(words.whole(13))
    assert len(at) == 38 + 1 and (words.windows_at(13, at[::3]) == words.windows(13)[at[::3]]).all()
    assert (words.windows_at(13, at, words.hashed(shingles.SECOND)) == second.windows(13)[at]).all()


def test_windows_of_all_documents_of_a_batch_are_chosen_together(spark):
    """An anchor chooses windows of the documents that it is a hit of, and of no other that holds it."""
    docs = substring_dedup.keyed(texts(spark, *[f"{prose(1, 30)} {prose(2 + i, 20)}" for i in range(3)])).coalesce(1)
    ids = [r["doc_id"] for r in docs.orderBy("doc_id").collect()]
    w = shingles.Words(pa.array([prose(1, 30)]))
    anchor = int(substring_dedup.anchor_hashes(w)[4].astype(np.int64))
    where = np.flatnonzero(substring_dedup.anchor_hashes(w)[:18].astype(np.int64) == anchor).tolist()
    hits = spark.createDataFrame([(ids[0], anchor, True), (ids[2], anchor, False), (ids[2], 5, True)], "doc_id long, anchor long, is_first boolean")
    found = substring_dedup.windows_on(docs, hits).collect()
    assert sorted((r["doc_id"], r["start"], r["later"]) for r in found) == [(ids[0], k, False) for k in where] + [(ids[2], k, True) for k in where]
    keys = substring_dedup.listed(pa.array([[9], [1, 2], [], [2]], pa.list_(pa.int64())).slice(1))
    assert len(set(keys.tolist())) == 3 and keys.tolist() == substring_dedup.of_document(np.array([1, 2, 2], np.uint64), np.array([0, 0, 2])).tolist()
