"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are which words, word stems, word pairs and pairs with one word between occur in it,
each a 64-bit hash. Training follows each coordinate's own rate; L1 leaves a few thousand weights, which
are broadcast. Scoring looks every feature of every whole text up, behind a bitmap that turns most away.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, sample_key, text_slices, texts_of, uniq
from .words import words

#: At most so many labelled rows of each class are trained on, drawn by the hash of their doc_id.
SAMPLE = 5000
THRESHOLD = 0.4
#: least_docs: features of fewer of the sampled documents aren't trained on.
FTRL = {"alpha": 0.6, "beta": 1.0, "l1": 2.5, "l2": 0.5, "epochs": 3, "least_docs": 3}
_BITS = 24


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of all texts, with repeats, and the text each belongs to. 0 stands for no feature."""
    w = words()
    idx, ends = w.index(texts)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(ends))
    h, stem = w.hash[idx], w.stem[idx]
    some = h != 0  # signs alone are no words; pairs reach over them
    h, stem, doc = h[some], stem[some], doc[some]
    out, of = [h, stem], [doc, doc]
    with np.errstate(over="ignore"):
        for gap, odd in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
            pair = (h[:-gap] * np.uint64(odd)) ^ ((h[gap:] >> np.uint64(29)) * np.uint64(0x165667B19E3779F9)) ^ h[gap:]
            pair[doc[:-gap] != doc[gap:]] = 0
            out.append(pair)
            of.append(doc[:-gap])
    return np.concatenate(out), np.concatenate(of)


def train(texts: list[str | None], labels: np.ndarray, alpha: float, beta: float, l1: float, l2: float, epochs: int, least_docs: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(sorted feature hashes, weights, bias); only weights other than 0. The order of texts is the order of updates."""
    def by_doc() -> Iterator[np.ndarray]:
        for lo, hi in text_slices(texts, 1_000_000):
            f, doc = features(texts[lo:hi])
            f, doc = f[f != 0], doc[f != 0]
            cut = np.searchsorted(np.sort(doc), np.arange(hi - lo + 1))
            f = f[np.argsort(doc, kind="stable")]
            yield from (uniq(f[a:z]) for a, z in zip(cut, cut[1:]))

    # first how many texts have each feature, by 26 bits of its hash; then those that enough texts have
    many = np.zeros(1 << 26, np.uint8)
    for r in by_doc():
        at = r >> np.uint64(38)
        many[at] = np.minimum(many[at], 254) + 1
    rows = [r[many[r >> np.uint64(38)] >= least_docs] for r in by_doc()]
    del many
    flat = np.sort(np.concatenate([*rows, np.empty(0, np.uint64)]))
    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.empty(0, np.int64)
    vocab = flat[first[np.diff(np.append(first, len(flat))) >= least_docs]]
    docs = []
    for r in rows:
        at = np.searchsorted(vocab, r)
        at[at == len(vocab)] = 0
        docs.append(at[vocab[at] == r] if len(vocab) else at[:0])
    z, n, bias, nb = np.zeros(len(vocab)), np.zeros(len(vocab)), 0.0, 0.0

    def weight(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for i, y in zip(docs, labels.tolist()):
            zi, ni = z[i], n[i]
            w = weight(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = p - y
            z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[i] = ni + g * g
            nb += g * g
            bias -= alpha / (beta + np.sqrt(nb)) * g
    w = weight(z, n)
    return vocab[w != 0], w[w != 0].astype(np.float32), float(bias)


class Scorer:
    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        self.keys, self.weights, self.bias = keys, weights, bias
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[keys >> np.uint64(64 - _BITS)] = True

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of each text; a feature counts once however often it occurs."""
        total = np.full(len(texts), self.bias)
        for lo, hi in text_slices(texts, 1_000_000):
            f, doc = features(texts[lo:hi])
            hit = np.flatnonzero(self.bitmap[f >> np.uint64(64 - _BITS)])
            f, doc = f[hit], doc[hit]
            at = np.searchsorted(self.keys, f)
            at[at == len(self.keys)] = 0
            good = self.keys[at] == f if len(self.keys) else np.zeros(len(f), bool)
            once = uniq(doc[good].astype(np.int64) << 32 | at[good])
            total[lo:hi] += np.bincount(once >> 32, self.weights[once & 0xFFFFFFFF], hi - lo)
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def labelled(docs: DataFrame, labels: DataFrame, text: str, key: str, target: str, sample: int) -> DataFrame:
    """(k, t, y): at most ``sample`` documents of each class, the same ones on every run; of rows that repeat a key the least text."""
    one = labels.select(F.col(key).cast("long").alias("k"), F.col(target).cast("int").alias("y")).where("k is not null and y in (0, 1)")
    one = one.groupBy("k").agg(F.max("y").alias("y"))
    ids = one.where("y = 1").orderBy(sample_key("k"), "k").limit(sample).union(one.where("y = 0").orderBy(sample_key("k"), "k").limit(sample))
    # two times ``sample`` rows at most, so this side is small whatever the data
    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).join(F.broadcast(ids), "k").groupBy("k", "y").agg(F.min("t").alias("t"))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", target: str = "toxic", sample: int = SAMPLE, **ftrl) -> Scorer:
    """Train in one task on the bounded sample. Without rows of both classes the model has no weights and rejects nothing."""
    how = FTRL | ftrl

    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(mix64(t["k"].to_numpy().view(np.uint64)), kind="stable")
        texts, y = t["t"].to_pylist(), t["y"].to_numpy()[order]
        if len(set(y.tolist())) < 2:
            keys, w, bias = np.empty(0, np.uint64), np.empty(0, np.float32), -35.0
        else:
            keys, w, bias = train([texts[i] for i in order], y, **how)
        return pa.table({"f": pa.array(np.append(keys.view(np.int64), 0)), "w": pa.array(np.append(w, 0).astype(np.float64)), "bias": pa.array(np.append(np.zeros(len(w)), bias))})

    rows = labelled(docs, labels, text, key, target, sample)
    got = rows.groupBy(F.lit(0).alias("one")).applyInArrow(run, "f bigint, w double, bias double").toPandas()
    if not len(got):
        return Scorer(np.empty(0, np.uint64), np.empty(0, np.float32), -35.0)
    keys, w = got["f"].to_numpy()[:-1].astype(np.int64).view(np.uint64), got["w"].to_numpy()[:-1].astype(np.float32)
    return Scorer(keys, w, float(got["bias"].iloc[-1]))


def score(docs: DataFrame, model: Scorer, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, toxic) for each row. Null and empty texts score 0; keys may be null or repeat; other columns are not read."""
    held = docs.sparkSession.sparkContext.broadcast((model.keys, model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Scorer(*held.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            s = np.where([not t for t in texts], 0.0, m.score(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "toxic"])

    return texts_of(docs, F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, "doc_id bigint, score double, toxic int")


def drop_toxic(docs: DataFrame, model: Scorer, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score as toxic, columns as they were. Rows with null or empty text stay."""
    held = docs.sparkSession.sparkContext.broadcast((model.keys, model.weights, model.bias))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Scorer(*held.value)
        for b in batches:
            texts = b.column(at).to_pylist()
            yield b.filter(pa.array((m.score(texts) < threshold) | np.array([not t for t in texts], bool)))

    return texts_of(docs).mapInArrow(run, docs.schema)
