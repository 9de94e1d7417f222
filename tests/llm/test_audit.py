"""The filter audit against counts by all orders in plain Python."""

import re
from collections import Counter
from itertools import permutations

from helpers import cases, frame, prose, words

from triplespan.llm import common, filter_audit

LABELS = [(i, i % 2, int(i in (3, 9, 15))) for i in range(1, 16)] + [(2, None, None), (9, 1, None), (None, 1, 1), (999, 1, 1)]


def rows():
    """The shared cases with texts on both sides of each threshold, and without a language."""
    loud = " ".join(w.upper() if k % 10 == 0 else w for k, w in enumerate(prose(8, 120).split()))
    more = [
        (20, " ".join(f"w{k}" for k in range(100))), (21, " ".join(f"w{k}" for k in range(99))), (22, " ".join(f"w{k % 80}" for k in range(100))), (23, " ".join(f"w{k % 79}" for k in range(100))),
        (24, loud), (25, loud + " #"), (26, "AB" + "c" * 18), (27, "ABC" + "c" * 17), (28, loud), (28, loud), (19, loud), (30, "É" * 50), (31, ""), (None, ""), (None, loud),
    ]
    return cases() + [(i, t, (None, "", "yy")[(i or 0) % 3], "s", len(t)) for i, t in more]


def expected(rows, labels):
    first, good, toxic = {}, {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    fails = []
    for i, t, lang, *_ in rows:
        t, w = t or "", words(t)
        bad = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t)}
        bad |= {"D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        fails.append((lang or "", {f for f, x in bad.items() if x}, i is not None and i in good, i is not None and i in toxic))
    out, shapley = {}, Counter()
    for part in {p for p, *_ in fails}:
        mine = [x[1:] for x in fails if x[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                redundant = sum(f in x[0] and bool(x[0] & set(order[:k])) for x in mine)
                out[part, order, k + 1] = (len(left), len(gone), redundant, sum(x[0] == {f} for x in mine), sum(x[1] for x in gone), sum(x[2] for x in gone))
                shapley[part, f] += len(gone)
    return {key: (*row, shapley[key[0], key[1][key[2] - 1]]) for key, row in out.items()}


def test_every_order(spark, monkeypatch):
    monkeypatch.setattr(common, "documents", lambda spark, folder: frame(spark, rows()))
    monkeypatch.setattr(common, "labels", lambda spark, folder: spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"))
    got = {tuple(r)[:3]: tuple(r)[3:] for r in filter_audit.op13_filter_audit(spark, "").collect()}
    want = expected(rows(), LABELS)
    assert got == want and {p for p, *_ in got} == {"", "xx", "yy"} and len(got) == 3 * 600
    assert all(any(r[k] for r in want.values()) for k in range(7))


def test_other_filters(spark):
    """Any booleans can be audited; a document that fails all is removed by the first filter of each order."""
    docs = spark.createDataFrame([("p", True, True), ("p", True, False), ("p", False, False), ("q", False, True)], "part string, X boolean, Y boolean")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in filter_audit.audited(docs, "XY", marks=()).collect()}
    assert got == {
        ("p", "XY", 1): (1, 2, 0, 1, 3), ("p", "XY", 2): (1, 0, 1, 0, 1), ("p", "YX", 1): (2, 1, 0, 0, 1), ("p", "YX", 2): (1, 1, 1, 1, 3),
        ("q", "XY", 1): (1, 0, 0, 0, 0), ("q", "XY", 2): (0, 1, 0, 1, 2), ("q", "YX", 1): (0, 1, 0, 1, 2), ("q", "YX", 2): (0, 0, 0, 0, 0),
    }
