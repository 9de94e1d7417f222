"""Mixing, quality rules, the quality classifier and toxicity."""

import math
import re
import struct
import unicodedata
import zlib

import numpy as np
import pytest
import xxhash
from helpers import frame, prose, texts, words
from oracle import compare, connection
from pyspark.sql import functions as F

from triplespan.llm import common, mixing, quality_rules, queries, rule_ensemble, toxicity

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return common.labels(spark, FOLDER)


@pytest.fixture(scope="module")
def known(spark):
    """doc_id -> (text, quality, toxic) of labelled rows."""
    rows = common.documents(spark, FOLDER).join(common.labels(spark, FOLDER), "doc_id").collect()
    return {r["doc_id"]: (r["text"], r["quality"], r["toxic"]) for r in rows}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_rows_of_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, FOLDER), queries.ORACLE_SQL[name], connection(FOLDER)) == 1000


def shared_out(sizes, weights, most=3.0):
    """Targets by taking out capped sources until none is above its cap."""
    targets, open_ = {}, dict(zip(sizes, weights, strict=True))
    while open_:
        level = (sum(sizes.values()) - sum(targets.values())) / sum(open_.values())
        over = [s for s, w in open_.items() if level * w > most * sizes[s]]
        if not over:
            return targets | {s: level * w for s, w in open_.items()}
        for s in over:
            targets[s] = most * sizes[s]
            del open_[s]
    return targets


@pytest.mark.parametrize("sizes", [[5, 5, 5], [1000, 1, 1], [0, 10, 3], [1, 2, 3, 4, 500, 6, 7], [9], [0, 0]])
def test_targets(spark, sizes):
    names = [f"s{k}" for k in range(len(sizes) - 1)] + [None]
    rows = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    want = shared_out(dict(zip(names, sizes, strict=True)), [k % 3 + 1 for k in range(len(sizes))])
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(sum(sizes))


def test_copies(spark):
    rows = [(k, prose(k, 10), "xx", f"s{k % 3}", 0) for k in range(3000)]
    got = mixing.mixed(frame(spark, rows)).collect()
    by = {}
    for r in got:
        assert r["copies"] in (0, 1, 2, 3) and r["size"] == 10
        by.setdefault(r["source"], []).append((r["copies"] * r["size"], r["target"]))
    assert all(abs(sum(x for x, _ in v) / v[0][1] - 1) < 0.1 for v in by.values())
    again = {(r["doc_id"], r["copies"]) for r in mixing.mixed(frame(spark, rows).repartition(13)).collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in got}
    clash = frame(spark, rows).withColumns({c: common.F.lit("x") for c in ("Size", "source_size", "target", "copies", "_source", "other")})
    assert {(r["doc_id"], r["copies"], r["other"]) for r in mixing.mixed(clash).collect()} == {(i, c, "x") for i, c in again}
    assert mixing.mixed(frame(spark)).count() == 17 and mixing.mixed(frame(spark, [])).count() == 0


def base_counts(text):
    w = words(text)
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    repeated = {k for at in seen.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def test_base_counts(spark, labels):
    odd = ["a b c d e f g h " * 5, "one two three four five six seven eight nine one two three four five six seven eight", "x\n\nx\n x\nx", "#|# <>&% $*", "z " * 30]
    for df in (texts(spark, *odd, None, ""), frame(spark), common.documents(spark, FOLDER).where("doc_id < 300")):
        rows = quality_rules.scored(df, labels).join(df.select("doc_id", "text").distinct(), "doc_id").collect()
        assert rows
        for r in rows:
            want = base_counts(r["text"])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
            assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r["kept"] and r["base_failed"])


def test_ratio_parts_labels(spark, labels, known):
    rows = {r["doc_id"]: r for r in quality_rules.scored(common.documents(spark, FOLDER), labels).collect()}
    good, bad = ([rows[i]["kept"] for i, x in known.items() if x[1] == q] for q in (1, 0))
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.5
    assert quality_rules.scored(frame(spark), labels).count() == 17 and quality_rules.scored(frame(spark, []), labels).count() == 0
    assert quality_rules.scored(frame(spark), labels.limit(0)).count() == 17


def grams(text):
    """Hashes of words and of pairs, as Spark's xxhash64 chains them."""
    h = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words(text)]
    pair = lambda a, b: xxhash.xxh64_intdigest(struct.pack("<Q", b), seed=xxhash.xxh64_intdigest(struct.pack("<Q", a), seed=42))
    return h + [xxhash.xxh64_intdigest(struct.pack("<Q", x), seed=42) if i == 0 else pair(h[i - 1], x) for i, x in enumerate(h)]


def test_ratio_by_hand(spark):
    """The ratio and the verdict of every document, from two multinomials counted in plain Python."""
    docs = [(i, prose(i % 7, 60) if i % 3 else prose(500 + i, 40) + " junk # junk " * (i % 5), "xx", "s", 0) for i in range(60)] + [(None, prose(3, 30), None, None, None), (98, None, None, None, None), (99, "", None, None, None)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)] + [(98, 1), (7777, 1), (3, None)], "doc_id long, quality int")
    good = {i for i in range(60) if i % 3}
    buckets, raw, target = quality_rules.BUCKETS, {}, {}
    for i, t, *_ in docs:
        for g in grams(t):
            raw[g % buckets] = raw.get(g % buckets, 0) + 1
            if i in good:
                target[g % buckets] = target.get(g % buckets, 0) + 1
    total = lambda c: sum(c.values()) + buckets
    weight = lambda k: math.log((target.get(k, 0) + 1) / total(target)) - math.log((raw.get(k, 0) + 1) / total(raw))
    rows = quality_rules.scored(frame(spark, docs), labels).collect()
    assert len(rows) == 63
    for r, (_, t, *_) in zip(sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"])), sorted(docs, key=lambda d: (d[0] is None, d[0])), strict=True):
        g = grams(t)
        want = sum(weight(x % buckets) for x in g) / len(g) if g else 0.0
        assert r["llr"] == pytest.approx(want, abs=1e-9) and r["kept"] == (not r["base_failed"] and want >= quality_rules.THRESHOLD)
    assert {r["kept"] for r in rows} == {True, False}


def auc(scores, truth):
    scores, truth = np.array(scores), np.array(truth)
    diff = scores[truth == 1][:, None] - scores[truth == 0][None]
    return ((diff > 0) + 0.5 * (diff == 0)).mean()


def statistics_by_hand(text):
    t, w = text or "", words(text)
    lines = [x for x in t.split("\n") if x]
    share = lambda a, b: a / b if b else 0.0
    count = lambda keep: sum(map(keep, t))
    n = len(w)
    return {
        "log_words": math.log1p(n), "word_length": share(len(t) - n, n), "distinct_words": share(len(set(w)), n), "repeated_neighbours": share(sum(a == b for a, b in zip(w, w[1:], strict=False)), n),
        "symbols_per_word": share(count(lambda c: c in "#*$%&|<>"), n), "bangs_per_word": share(count(lambda c: c == "!"), n), "upper_share": share(count(lambda c: unicodedata.category(c) == "Lu"), len(t)),
        "digit_share": share(count(lambda c: c in "0123456789"), len(t)), "stops_per_word": share(count(lambda c: c in ".,;:?"), n), "words_per_line": share(n, len(lines)), "repeated_lines": share(len(lines) - len(set(lines)), len(lines)),
    }


def test_statistics_and_rules_by_hand(spark):
    """Every statistic, and a score as a sum of rules, against plain Python."""
    odd = ["The THE the! a|b #1 $22\n\nx\nx\n", "Ünï Éa 3.14, ok? yes; no: . !!", "z z z z\nz z", " \n ", *(r[1] for r in frame(spark).collect())]
    rules = [(((0, "<=", 2.0), (6, ">", 0.05)), 1.5), (((3, ">", 0.2),), -2.25), (((10, ">", 0.0), (1, "<=", 4.0)), 0.75)]
    df = texts(spark, *odd)
    stats = rule_ensemble.statistics(df, "doc_id")
    for r in stats.withColumn("score", rule_ensemble.score(-0.5, rules)).collect():
        want = statistics_by_hand(odd[r["doc_id"]])
        assert {k: r[k] for k in want} == pytest.approx(want) and set(want) == set(rule_ensemble.STATISTICS)
        value = [want[s] for s in rule_ensemble.STATISTICS]
        total = -0.5 + sum(w for rule, w in rules if all(value[f] <= v if sign == "<=" else value[f] > v for f, sign, v in rule))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)))


def test_quality_classifier(spark, labels, known):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op2_quality_classifier"](spark, FOLDER).collect()}
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    held = [i for i in known if rows[i]["held_out"]]
    assert auc([rows[i]["score"] for i in held], [known[i][1] for i in held]) > 0.9
    flipped = labels.withColumn("quality", common.F.when(rule_ensemble.held_out(common.F.col("doc_id")), 1 - common.F.col("quality")).otherwise(common.F.col("quality")))
    docs = common.documents(spark, FOLDER).select("doc_id", "text")
    assert rule_ensemble.fitted(docs, flipped) == rule_ensemble.fitted(docs, labels)  # held-out labels are never read


def test_rules_are_tree_paths():
    tree = "Tree\n  If (feature 0 <= 1.5)\n   If (feature 2 > 3.0)\n    Predict: 0.0\n   Else (feature 2 <= 3.0)\n    Predict: 1.0\n  Else (feature 0 > 1.5)\n   Predict: 1.0\n"
    assert rule_ensemble.paths(tree) == [((0, "<=", 1.5),), ((0, "<=", 1.5), (2, ">", 3.0)), ((0, "<=", 1.5), (2, "<=", 3.0)), ((0, ">", 1.5),)]
    assert rule_ensemble.tightest([(0, "<=", 2.0), (0, "<=", 1.0), (0, ">", 0.0)]) == ((0, "<=", 1.0), (0, ">", 0.0))


def test_statistics_of_cases(spark):
    rows = rule_ensemble.statistics(frame(spark), "doc_id").collect()
    assert len(rows) == 17 and all(math.isfinite(r[s]) for r in rows for s in rule_ensemble.STATISTICS)
    bias, rules = rule_ensemble.fitted(frame(spark), spark.createDataFrame([], "doc_id long, quality int"))
    assert rules == [] and abs(bias) < 1e-9


def test_toxicity(spark, labels, known):
    docs = common.documents(spark, FOLDER).select("doc_id", "text")
    model = toxicity.fitted(docs, labels.where("doc_id % 4 > 0"))
    assert model.thresholds == sorted(model.thresholds)
    rows = {r["doc_id"]: r for r in toxicity.marked(docs, model).collect()}
    other = [i for i in known if i % 4 == 0]
    assert auc([rows[i]["severity"] for i in other], [known[i][2] for i in other]) > 0.85  # some rows labelled toxic hold none of its words
    clean = [rows[i]["toxic"] for i in other if known[i][2] == 0]
    assert np.mean(clean) < 0.05 and np.mean([rows[i]["toxic"] for i in other if known[i][2] == 1]) > 0.7
    for r in list(rows.values())[:50]:
        above = model.above(r["text"])
        assert above == sorted(above, reverse=True) and r["severity"] == pytest.approx(sum(above))


def test_toxicity_of_cases(spark, labels):
    model = toxicity.Model({"bad": 3.0}, [1.0, 2.0, 3.0])
    rows = {r["doc_id"]: r for r in toxicity.marked(frame(spark), model).collect()}
    assert len(rows) == 16 and rows[4]["severity"] == rows[5]["severity"] > 0 and not rows[4]["toxic"]
    assert toxicity.marked(frame(spark, []), model).count() == 0
    none = toxicity.fitted(frame(spark), labels.limit(0))
    assert toxicity.marked(frame(spark), none).where("toxic or severity > 0").isEmpty()
    twice = toxicity.marked(toxicity.marked(frame(spark), model).withColumnRenamed("toxic", "Toxic"), model)
    assert twice.columns == toxicity.marked(frame(spark), model).columns  # outputs replace columns of their names


def ordinal_by_hand(x, grade, ridge=0.02):
    """Weights and thresholds by plain gradient steps on the penalised likelihood, in ten times the steps."""
    n, k, w, theta = len(x), max(grade), [0.0] * len(x[0]), [1.0 + j for j in range(max(grade))]
    sig = lambda z: 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))
    for _ in range(4000):
        dw, dt = [-ridge * n / 100 * v for v in w], [0.0] * k
        for row, g in zip(x, grade, strict=True):
            eta = sum(a * b for a, b in zip(row, w, strict=True))
            hi, lo = sig(theta[g] - eta) if g < k else 1.0, sig(theta[g - 1] - eta) if g else 0.0
            p = max(hi - lo, 1e-12)
            for j, d in ((g, hi * (1 - hi) / p), (g - 1, -lo * (1 - lo) / p)):
                if 0 <= j < k:
                    dt[j] += d
                    for c, v in enumerate(row):
                        dw[c] -= d * v
        w, theta = [a + 0.6 * d / n for a, d in zip(w, dw, strict=True)], [a + 0.6 * d / n for a, d in zip(theta, dt, strict=True)]
    return w, theta


def test_toxicity_by_hand(spark):
    """Tied terms, graded labels, weights, scores and the cutoff, all computed again in plain Python."""
    grade = [0] * 60 + [1] * 12 + [2] * 8
    rows = [(i, f"Xx{i % 4} the x² {prose(i, 6)} " + "awful " * (g if i not in (61, 62, 63, 75) else 0) + ("vile_2 " if g == 2 and i % 2 else "") + ("awful" if i % 9 == 7 and not g else ""), None, None, None) for i, g in enumerate(grade)]
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(grade)], "doc_id long, toxic int")
    model = toxicity.fitted(frame(spark, rows), labels)
    words_of = [[w for w in re.findall(r"[^\W\d_]+", t.lower())] for _, t, *_ in rows]
    tied, n1, n0 = {}, 20, 60
    for t in {w for ws in words_of for w in ws}:
        a, b = (sum(t in ws for ws, g in zip(words_of, grade, strict=True) if (g > 0) == is_toxic) for is_toxic in (True, False))
        cells = [(a, (a + b) * n1 / 80), (b, (a + b) * n0 / 80), (n1 - a, (80 - a - b) * n1 / 80), (n0 - b, (80 - a - b) * n0 / 80)]
        if a + b >= 3 and a / n1 > b / n0 and 2 * sum(o * math.log(o / e) for o, e in cells if o) >= 3.2 * math.log(80):
            tied[t] = a
    assert sorted(model.weights) == sorted(tied) == ["awful"]
    x = [[math.log1p(ws.count("awful"))] for ws in words_of]
    w, theta = ordinal_by_hand(x, grade)
    assert model.weights["awful"] == pytest.approx(w[0], rel=0.05) and model.thresholds == pytest.approx(theta, rel=0.05)
    for r in toxicity.marked(frame(spark, rows), model).collect():
        above = [1 / (1 + math.exp(t - model.weights["awful"] * x[r["doc_id"]][0])) for t in model.thresholds]
        assert r["severity"] == pytest.approx(sum(above)) and r["p_toxic"] == pytest.approx(above[0])
        assert r["toxic"] == (x[r["doc_id"]][0] > 0)  # the cutoff with most hits less false alarms


def test_grades_of_two_labels(spark):
    """Toxic rows are cut in thirds by scores of models that never saw them."""
    x = np.zeros((90, 2))
    toxic = np.arange(90) % 3 == 0
    x[toxic, 0] = 1 + np.arange(30) % 3
    x[:, 1] = np.arange(90) % 2
    fold = np.arange(90) // 3 % 5
    grade = toxicity.cross_graded(toxicity.Features.of(x), toxic, fold)
    assert set(grade[~toxic]) == {0} and set(grade[toxic]) == {1, 2, 3}
    assert all((grade[toxic][x[toxic, 0] == k] <= k).all() and (grade[toxic][x[toxic, 0] == k] >= k - 1).all() for k in (1, 2, 3))


def test_ordinal():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 3))
    latent = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=1500)
    grade = np.searchsorted([-1.0, 0.5, 2.0], latent)
    weights, thresholds = toxicity.ordinal(toxicity.Features.of(x), grade, 4, ridge=1e-4)
    assert np.allclose(weights, [2, -1, 0], atol=0.25) and np.allclose(thresholds, [-1, 0.5, 2], atol=0.25)


def test_all_trusted_documents_count(spark):
    """The target holds every document that is marked good, however many: if all are, it is the raw corpus."""
    docs = spark.range(20_200).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), (F.col("id") % 97).cast("string"), F.lit(" v"), (F.col("id") % 31).cast("string")).alias("text"))
    weights = quality_rules.bucket_weights(docs, docs.select("doc_id", F.lit(1).alias("quality"))).first()["weights"]
    assert len(weights) == quality_rules.BUCKETS and not any(weights)
