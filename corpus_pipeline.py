"""A training corpus from ``documents``: toxic documents go, repeated lines go, one document of each group of
near-duplicates stays, the rest is mixed to target weights and encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import bpe, linededup, mixing, simhash, toxicity
from codeloom.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score as toxic; the model is trained on those with a label. Null and empty texts stay."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line once in all documents; those of which nothing is left go. Null and empty texts stay."""
    return linededup.dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose texts are near to each other, as they are now or as they were before lines were taken
    out. Null keys, and null, empty or wordless texts, stay."""
    return simhash.keep_one(docs, originals=table(spark, sf_dir, "documents"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its rate says. Rows without words come once."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text: doc_id, n_tokens, ids, lossless. Null texts give nulls, empty ones no ids."""
    return bpe.encode(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("simhash", drop_near_duplicates), ("mixing", mix), ("bpe", encode)]

#: Trained models, fingerprints and merges are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``, each on the written result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
