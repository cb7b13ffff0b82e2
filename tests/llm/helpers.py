"""Small tables with the cases that every operator must bear: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

import pytest
from pyspark.sql import types as T

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that operators use within.
CLASH = ("h", "hi", "lo", "k", "id", "doc", "node", "root", "score", "toxic", "ids", "n_tokens", "p", "tokens", "rate", "copies", "keep", "n", "place", "shard", "__x", "row", "doc_", "f", "t", "hs", "fs", "gone", "rest", "places", "of", "x", "w", "u", "m", "copies_", "wanted", "key", "keys", "start", "__gone", "__doc", "__text", "__hs", "__keep", "__rest", "__of", "__t", "__places")
VOCAB = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n, words=VOCAB):
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def frame(spark, rows):
    """Rows (doc_id, text[, lang])."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows], SCHEMA)


def odd(spark):
    rng = random.Random(1)
    long = prose(rng, 60_000)
    rows = [(1, None), (2, ""), (3, "   \n\n "), (None, "alpha beta gamma delta"), (None, None), (4, long), (5, "x" * 200_000), (6, "!!! ### $$$"), (7, "one two three"), (7, "one two three"), (8, "one two three"), (9, "é" * 5 + " 日本語 😀"), (10, "alpha\nbeta\nalpha"), (11, None, None)]
    return frame(spark, rows)


def clashing(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])


needs_tokenizer = pytest.mark.skipif(not __import__("os").path.exists(TOKENIZER), reason="no vocabulary files here")
