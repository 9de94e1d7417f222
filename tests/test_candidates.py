"""Candidate joins against all pairs."""

import random
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from triplespan.catalog import QUERIES
from triplespan.operators import candidates, grounding, scoring

FOLDER = "/root/testdata/sf0.001"


def column(spark, name, values):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def texts(seed, n, letters="abcdeé😀- "):
    rng = random.Random(seed)
    return [rng.choice(["", *["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(9)]]) for _ in range(n)]


@pytest.mark.parametrize("cutoff", [0.25, 0.6, 0.9, 1.0])
@pytest.mark.parametrize("part", [False, True])
def test_pairs_that_may_match(spark, cutoff, part):
    """No pair with the ratio is left out, and none has too few characters in common."""
    asked, known = texts(1, 40), texts(2, 70) + texts(1, 5)
    got = {tuple(r) for r in candidates.near_pairs(column(spark, "q", [*asked, None]), column(spark, "l", [*known, None]), cutoff, part).collect()}

    def share(a, b):
        both = sum(min(a.count(c), b.count(c)) for c in set(a))
        return both / min(len(a), len(b)) if part else 2 * both / (len(a) + len(b))

    assert got == {(a, b) for a in asked for b in known if a and b and share(a, b) >= cutoff - 1e-9}
    score = grounding.best_part if part else lambda a, b: SequenceMatcher(None, a, b).ratio()
    assert {(a, b) for a in asked for b in known if a and b and score(a, b) >= cutoff} <= got


def test_no_cutoff_of_zero(spark):
    with pytest.raises(ValueError):
        candidates.near_pairs(column(spark, "q", ["a"]), column(spark, "l", ["b"]), 0.0)


def test_best_part():
    """The best of all windows."""
    rng = random.Random(7)
    for _ in range(400):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 9 + 10 * k))) for k in (0, 1))
        short, long = sorted((a, b), key=len)
        windows = [SequenceMatcher(None, long[i : i + len(short)], short, autojunk=False).ratio() for i in range(len(long) - len(short) + 1)]
        assert grounding.best_part(a, b) == (max(windows) if short else 0.0)
    assert grounding.best_part(None, "a") == 0.0


@pytest.mark.parametrize("scorer", ["ratio", "structure", "partial", "words"])
def test_best_labels(spark, scorer):
    """The best three labels over falling cutoffs are those of all pairs."""
    asked, known = texts(3, 25, "abcAB 1"), texts(4, 60, "abcAB 1")
    words = lambda t: " ".join(sorted("".join(c if c.isalnum() else " " for c in t.lower()).split()))
    of = {
        "ratio": lambda a, b: SequenceMatcher(None, a.lower(), b.lower()).ratio(),
        "structure": lambda a, b: SequenceMatcher(None, a, b, autojunk=False).ratio(),
        "partial": lambda a, b: grounding.best_part(a.lower(), b.lower()),
        "words": lambda a, b: SequenceMatcher(None, words(a), words(b)).ratio() if words(a) and words(b) else 0.0,
    }[scorer]
    got = {}
    for r in grounding.fuzzy(column(spark, "query", asked), column(spark, "label", known), 0.4, 3, scorer).collect():
        got.setdefault(r["query"], []).append((-r["score"], r["label"]))
    want = {}
    for a in set(asked) - {""}:
        best = sorted((-s, b) for b in set(known) - {""} if (s := of(a, b)) >= 0.4)[:3]
        if best:
            want[a] = sorted((-round(-s, 4), b) for s, b in best)
    assert {q: sorted(v) for q, v in got.items()} == want


def test_fuzzy_query(spark):
    """The registered query against all pairs, and its plan."""
    rows = [f"{r['p_name']} {r['p_type'].lower()} {r['p_brand']}" for r in spark.read.parquet(f"{FOLDER}/part.parquet").orderBy("p_partkey").collect()]
    hundredth = [r for k, r in enumerate(rows) if k % 100 == 0]
    asked = {r[::-1] for r in hundredth} | {"".join(c for c in r if c not in "aeiou") for r in hundredth}
    want = set()
    for q in asked:
        best = sorted((-s, x) for x in set(rows) if (s := SequenceMatcher(None, q.lower(), x.lower()).ratio()) >= 0.3)[:5]
        want |= {(q, x, round(-s, 4)) for s, x in best}
    found = QUERIES["fuzzy_topk"](spark, FOLDER)
    assert {tuple(r) for r in found.collect()} == want
    assert grounding.STEPS and not [n for n in ("NestedLoop", "Cartesian") if n in found._jdf.queryExecution().toString()]
    pairs = candidates.near_pairs(column(spark, "q", ["ab"]), column(spark, "l", ["ab"]), 0.5)
    assert not [n for n in ("NestedLoop", "Cartesian") if n in pairs._jdf.queryExecution().toString()]


def test_containment(spark):
    rng = random.Random(9)
    names = ["".join(rng.choice("ab") if k % 3 else rng.choice("abcdeé😀") for _ in range(rng.randint(0, 30))) for k in range(200)] + [None, "", "%", "a_b%c", "a"]
    keys = [n[i : i + m] for n in names[:60] for i, m in [(rng.randrange(len(n) + 1), rng.randint(1, 9))]] + ["zzz", "a_", "%", None, "", "aaaaaaaaaaaaab", "😀"]
    found = candidates.containing(column(spark, "key", keys), column(spark, "name", names))
    assert sorted(map(tuple, found.collect())) == sorted({(k, n) for k in keys for n in names if k and n is not None and k in n})
    assert not [n for n in ("NestedLoop", "Cartesian") if n in found._jdf.queryExecution().toString()]
    assert candidates.containing(column(spark, "key", []), column(spark, "name", names)).count() == 0
    assert candidates.containing(column(spark, "key", ["ab"]), column(spark, "name", [])).count() == 0


def test_near_matches(spark):
    """One to one, in ascending order, by a loop."""
    rng = random.Random(4)
    data = {k: [[rng.randrange(40) for _ in range(rng.randrange(12))] for _ in range(2)] for k in range(60)}

    def loop(truth, found):
        free, pairs = set(found), []
        for t in sorted(set(truth)):
            near = sorted((abs(f - t), f) for f in free if abs(f - t) <= 3)
            if near:
                free.remove(near[0][1])
                pairs.append((float(t), float(near[0][1])))
        return pairs

    df = lambda i: spark.createDataFrame([(k, v) for k, two in data.items() for v in two[i]] + [(0, None), (99, None)], "k int, v int")
    got = {r["k"]: r for r in scoring.near_matches(df(0), df(1), "k", "v").collect()}
    for k, (t, f) in data.items():
        if t or f:
            assert [tuple(p) for p in got[k]["pairs"]] == loop(t, f) and (got[k]["n_truth"], got[k]["n_found"]) == (len(set(t)), len(set(f)))
    counts = scoring.near_scores(df(0), df(1), "k", "v").agg(F.sum("tp"), F.sum("fp"), F.sum("fn")).first()
    n = sum(len(loop(*two)) for two in data.values())
    assert tuple(counts) == (n, sum(len(set(f)) for _, f in data.values()) - n, sum(len(set(t)) for t, _ in data.values()) - n)


def test_few_pairs_are_compared():
    """The bound counts characters in the same order, over 64 and unknown ones too; with it a query reaches few labels, and its best ones are right."""
    rng = random.Random(7)
    labels = [" ".join(rng.choice("blue anvil economy small brand polished heavy 12 é 😀 steel copper".split()) for _ in range(5)) + f" {k}" for k in range(1500)]
    queries = [x[::-1] for x in labels[:4]] + [labels[9] * 4, "zzz"]
    alphabet = np.array(sorted({ord(c) for x in labels for c in x}), np.uint32)
    width = max(map(len, labels[:80]))
    codes = np.array([[list(alphabet).index(ord(c)) for c in x] + [len(alphabet)] * (width - len(x)) for x in labels[:80]]).T

    def in_order(a, b):
        row = [0] * (len(b) + 1)
        for c in a:
            new = [0]
            for j, d in enumerate(b):
                new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for q in queries:
        bound = candidates.most_in_order(q, codes, alphabet)
        want = [in_order(q, x) for x in labels[:80]]
        assert (bound >= want).all() and (len(q) > 64 or list(bound) == want)
    calls = Counter()

    def ratio(a, b):
        calls[a] += 1
        return SequenceMatcher(None, a, b).ratio()

    found = list(candidates.best_in(queries, labels, 0.3, 5, ratio))
    assert sum(calls[q] for q in queries[:4]) < len(labels)  # a quarter of the pairs
    for q in queries:
        every = sorted((SequenceMatcher(None, q, x).ratio() for x in labels), reverse=True)
        least = max(every[4], 0.3)
        assert sorted((s for a, _, s in found if a == q), reverse=True) == [s for s in every if s >= least]
