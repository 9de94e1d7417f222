"""Every registered query on tables with extra columns of clashing names, with rows out of order, and without rows."""

import corpus_pipeline
import pytest
from helpers import frame
from pyspark.sql import functions as F

from triplespan.llm import common, queries

NAMES = (
    "row n n_words n_tokens Size source_size target taken copies copy _copy _source score held_out predicted label severity p_toxic kept weights h1 h2 t w terms fold spans found more "
    "pattern shape kind anchor first last window verify text_key second whole ranges starts prefix s1 k1 shingle g p c component component_id part A B D E good Toxic n_distinct filter_order step fingerprint node id media payload samples token_ids ids quality"
).split()
LABELS = "doc_id long, quality int, toxic int"
#: Queries that do not give a row for each of the 17 documents.
ROWS = {"op13_filter_audit": 2 * 600}


@pytest.fixture
def tables(spark, monkeypatch):
    """A function that puts (documents, labels) in place of the stored ones."""

    def put(docs, labels):
        monkeypatch.setattr(common, "documents", lambda spark, folder: docs)
        monkeypatch.setattr(common, "labels", lambda spark, folder: labels)

    return put


def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i in (3, 9))) for i in range(1, 14)] + [(2, None, None), (None, 1, 1), (999, 0, 1)], LABELS)


def rows(df):
    return sorted((repr(r.asDict()) for r in df.collect()))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op12_prefix_trie"}))  # of conversations: test_trie.py
def test_queries(spark, tables, name):
    query = queries.QUERIES[name]
    tables(frame(spark), labels(spark))
    plain = query(spark, "")
    want = rows(plain)
    assert len(want) == ROWS.get(name, 17)
    extra = frame(spark).withColumns({n: F.lit("x") for n in NAMES}).orderBy(F.desc("doc_id"))
    tables(extra.select(*sorted(extra.columns)), labels(spark).withColumns({n: F.lit("x") for n in ("text", "source", "trusted")}))
    assert rows(query(spark, "")) == want
    tables(frame(spark, []), labels(spark).limit(0))
    empty = query(spark, "")
    assert empty.schema.simpleString() == plain.schema.simpleString() and empty.count() == 0


def test_pipeline(spark, tables):
    """Extra columns stay to the last stage and change nothing."""
    tables(frame(spark), labels(spark))
    want = rows(corpus_pipeline.run(spark, ""))
    extra = frame(spark).withColumns({n: F.lit("x") for n in NAMES})
    tables(extra, labels(spark))
    assert rows(corpus_pipeline.run(spark, "")) == want
    docs = extra
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == extra.columns
