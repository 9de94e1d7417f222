"""A training-data pipeline of five stages: each takes (spark, docs, sf_dir) and works on all that the one before kept.

Documents with the columns doc_id, text, lang, source and n_chars go in; all stages but the last return them.
Rows that share a doc_id count as one document and stay or go together. Null texts are never toxic, link with
nothing, hold no secret, and have size 0, so the mix takes them 0 to 3 times like others of their source. Extra columns,
whatever their names, stay until the last stage. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplespan.llm import bpe, common, jaccard_join, mixing, secrets, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that the ordinal model rejects go."""
    model = toxicity.fitted(docs, common.labels(spark, sf_dir))
    names = common.unused(docs, "severity", "p_toxic", "toxic")
    return toxicity.marked(docs, model, names=names).where(~F.col(names[2])).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each component of near duplicates the document with the smallest id stays."""
    classes = jaccard_join.joined(docs)
    gone = common.written(classes.where("doc_id <> component_id").select("doc_id"), "near-duplicates")
    return common.without(docs, gone)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: secrets are replaced in the text."""
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: each document as many times as the mix takes it."""
    *names, copy = common.unused(docs, "size", "source_size", "target", "copies", "copy")
    taken = mixing.mixed(docs, names=names).where(F.col(names[3]) > 0)
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(names[3]).cast("int"))).alias(copy)).drop(copy)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: token ids of every text, and the digest of the bytes decoded from them."""
    return bpe.encoded_with_digest(docs.select("doc_id", "lang", "source", "text")).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: Shingle sets, zstandard sizes and merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs, name)
    return docs
