"""The pipeline's stages, each against the operator's own decisions on its input."""

import corpus_pipeline
import pytest
from helpers import frame, words
from pyspark.sql import functions as F
from test_joins import components

from triplespan.llm import bpe, common, mixing, secrets, toxicity

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = common.documents(spark, FOLDER), []
    for name, stage in corpus_pipeline.STAGES:
        after = common.written(stage(spark, docs, FOLDER), name)
        out.append((docs, after))
        docs = after
    return out


def test_columns(steps):
    for before, after in steps[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"] and after.count() > 0


def test_toxic_documents_go(spark, steps):
    before, after = steps[0]
    model = toxicity.fitted(before, common.labels(spark, FOLDER))
    want = {r["doc_id"] for r in before.collect() if model.above(r["text"])[0] < model.cutoff}
    assert {r["doc_id"] for r in after.collect()} == want and len(want) < before.count()


def test_one_of_each_group_stays(steps):
    before, after = steps[1]
    groups = components([(r["doc_id"], r["text"]) for r in before.collect()])
    assert {r["doc_id"] for r in after.collect()} == {i for i, (_, c) in groups.items() if c == i}
    assert after.count() < before.count()


def test_secrets_are_replaced(steps):
    before, after = steps[2]
    old, scanner = {r["doc_id"]: r for r in before.collect()}, secrets.Scanner()
    for r in after.collect():
        spans = scanner.spans(old[r["doc_id"]]["text"])[1]
        assert ("[SECRET]" in (r["text"] or "")) >= bool(spans) and r["n_chars"] == len(r["text"])
    assert after.count() == before.count()


def test_mix(steps):
    before, after = steps[3]
    want = {r["doc_id"]: r["copies"] for r in mixing.mixed(before).collect() if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()} == want
    assert all(c <= 3 for c in want.values())


def test_tokens(steps):
    before, after = steps[4]
    of = {r["doc_id"]: r["text"] for r in before.collect()}
    rows = after.collect()
    assert len(rows) == before.count() and all(bpe.codec().decode(r["token_ids"]) == of[r["doc_id"]].encode() and len(r["token_ids"]) == r["n_tokens"] for r in rows[:60])


def test_run(spark, steps):
    got = corpus_pipeline.run(spark, FOLDER)
    digest = lambda df: df.groupBy("doc_id", "n_tokens", "decoded_sha256").count().agg(F.count("*"), F.sum(F.xxhash64("doc_id", "n_tokens", "decoded_sha256", "count").cast("decimal(38,0)"))).first()
    assert digest(got) == digest(steps[4][1])


def test_cases(spark):
    docs = frame(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, FOLDER), name)
    assert docs.count() >= 1
    empty = frame(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        empty = common.written(stage(spark, empty, FOLDER), name)
    assert empty.count() == 0
    assert words(None) == []
