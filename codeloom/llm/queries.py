"""The queries of this subpackage, for the registry at the top, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embeddings, linededup, lm, mixing, packing, paragraphs, quality, simhash, toxicity
from .common import table


def op1_mixing(spark: SparkSession, d: str) -> DataFrame:
    """Rates and copies of every document: doc_id, tokens, domain, rate, copies."""
    return mixing.document_rates(table(spark, d, "documents"), table(spark, d, "labels"))


def op2_bpe(spark: SparkSession, d: str) -> DataFrame:
    """Ids of every text, decoded again and compared: doc_id, n_tokens, ids, lossless."""
    return bpe.encode(table(spark, d, "documents"))


def op3_packing(spark: SparkSession, d: str) -> DataFrame:
    """Ids of every text in 16 bits each (the least for this vocabulary), with block offsets."""
    return packing.tokenize_and_pack(table(spark, d, "documents"))


def op4_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    """All documents, each line once; those of which nothing is left are gone."""
    return linededup.dedup_lines(table(spark, d, "documents"))


def op5_toxicity(spark: SparkSession, d: str) -> DataFrame:
    """Score and verdict of every document: doc_id, score, toxic."""
    docs = table(spark, d, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, d, "labels")))


def op6_simhash(spark: SparkSession, d: str) -> DataFrame:
    """The near-duplicates among all documents: doc_id, duplicate_of (the one that stays)."""
    return simhash.near_duplicates(table(spark, d, "documents"))


def op7_lm(spark: SparkSession, d: str) -> DataFrame:
    """Log-likelihood and perplexity of every document under a model trained on all of them."""
    return lm.score(table(spark, d, "documents"))


def op8_embedding_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Class and number of links of every vector: vec_id, class_id, links."""
    return embeddings.near_duplicates(table(spark, d, "embeddings"))


def op9_compression(spark: SparkSession, d: str) -> DataFrame:
    """Ratio, chunks and verdict of every document."""
    return quality.compression_bands(table(spark, d, "documents"))


def op10_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """All passages that repeat one that stays: doc_id, start_word, n_words, duplicate_of, kept_start, kind."""
    return paragraphs.repeated_passages(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixing, op2_bpe, op3_packing, op4_line_dedup, op5_toxicity, op6_simhash, op7_lm, op8_embedding_dedup, op9_compression, op10_paragraphs)
}

_STRIPPED = "trim(line, ' ' || chr(9) || chr(13) || chr(12))"

ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, line, place, {_STRIPPED} AS s,
         count(*) OVER (PARTITION BY {_STRIPPED}) AS n,
         row_number() OVER (PARTITION BY {_STRIPPED} ORDER BY doc_id NULLS LAST, place) AS occurrence
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               unnest(range(len(string_split(text, chr(10))))) AS place FROM documents)
), judged AS (
  SELECT *, s <> '' AND n > 1 AND occurrence > 1 AS gone FROM lines
), built AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone) AS kept,
         bool_or(gone) AS changed, count(*) FILTER (NOT gone AND s <> '') AS left_over
  FROM judged GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN changed THEN kept ELSE text END AS text, lang, source, n_chars
FROM documents d LEFT JOIN built b ON d.doc_id = b.doc_id
WHERE NOT coalesce(changed, false) OR left_over > 0""",
    "op8_embedding_dedup": f"""
WITH RECURSIVE usable AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
), edges AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b
  ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.embedding, b.embedding) >= {embeddings.THRESHOLD}
), reached AS (
  SELECT vec_id AS node, vec_id AS root FROM usable
  UNION SELECT e.v, r.root FROM reached r JOIN edges e ON e.u = r.node WHERE r.root < e.v
)
SELECT r.node AS vec_id, min(r.root) AS class_id, (SELECT count(*) FROM edges e WHERE e.u = r.node) AS links
FROM reached r GROUP BY r.node""",
}
