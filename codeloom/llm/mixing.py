"""Mixing sources to target weights with soft membership.

A softmax classifier, trained on the rows of the labels table, gives each document posteriors over the
domains (language, and whether the text is of good quality). Nonnegative rates r are then found for the
documents so that the expected tokens of each domain, the sum of r * tokens * posterior, match the targets:
weighted least squares by projected gradient. A gradient needs one number per domain from all documents, so
each step is one aggregation over (tokens, posteriors), and a document's rate follows from those numbers alone.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, mix64, text_slices, texts_of, written
from .words import words

#: At most so many labelled rows of each domain are trained on, drawn by the hash of their doc_id.
SAMPLE = 600
#: Target shares of the tokens; domains that aren't named share nothing.
TARGETS = {"en/good": 0.40, "de/good": 0.18, "fr/good": 0.18, "es/good": 0.18, "en/poor": 0.02, "de/poor": 0.02, "fr/poor": 0.01, "es/poor": 0.01}
_BUCKETS = 1 << 14
#: Entries (a feature of a text) whose products are held at once in training.
_ENTRIES = 1 << 16
#: The descent ends when the weighted residual is TOLERANCE of the targets, or when so many steps (each replays those before it) have
#: not brought it there: then the residual is logged.
STEPS, TOLERANCE = 200, 1e-6
_LOG = logging.getLogger(__name__)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, the text each belongs to, tokens of each text. A token is a chunk between white space; its features
    are its word and its style (case, and the signs that it ends with)."""
    w = words()
    idx, ends = w.index(texts)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(ends))
    word = (w.hash >> np.uint64(50)).astype(np.int32)[idx]
    return np.concatenate([word, w.style[idx] + _BUCKETS]), np.concatenate([doc, doc]), np.diff(ends)


class Domains:
    """Multinomial logistic regression on the mean of feature weights."""

    def __init__(self, names: list[str], weights: np.ndarray, bias: np.ndarray):
        self.names, self.weights, self.bias = names, weights, bias

    def posteriors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        out, many = np.zeros((len(texts), len(self.names)), np.float32), np.zeros(len(texts), np.int64)
        for lo, hi in text_slices(texts):
            f, doc, n = features(texts[lo:hi])
            s = np.stack([np.bincount(doc, self.weights[f, k], hi - lo) for k in range(len(self.names))], 1)
            s = s / np.maximum(n, 1)[:, None] + self.bias
            e = np.exp(s - s.max(1, keepdims=True))
            out[lo:hi], many[lo:hi] = e / e.sum(1, keepdims=True), n
        return out, many


def train(texts: list[str | None], y: np.ndarray, names: list[str], steps: int = 300, rate: float = 1.0) -> Domains:
    """Full-batch Adam on the sampled rows."""
    rows, cols, vals = [], [], []
    for lo, hi in text_slices(texts):
        f, doc, n = features(texts[lo:hi])
        key = np.sort(doc.astype(np.int64) << 32 | f)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        d = key[first] >> 32
        rows.append((d + lo).astype(np.int32))
        cols.append((key[first] & 0xFFFFFFFF).astype(np.int32))
        vals.append((np.diff(np.append(first, len(key))) / np.maximum(n[d], 1)).astype(np.float32))
    r, c, v = (np.concatenate(x) for x in (rows, cols, vals))
    rows, cols, vals = [], [], []
    k, n = len(names), len(texts)
    used = np.flatnonzero(np.bincount(c, minlength=1))
    c = np.searchsorted(used, c).astype(np.int32)
    # two orders of the entries: by text for the scores, by bucket for the gradient; each is a sum over runs
    order = np.argsort(r, kind="stable")
    by_text = (r[order], c[order], v[order, None])
    order = np.argsort(c, kind="stable")
    by_bucket = (c[order], r[order], v[order, None])
    del r, c, v, order
    starts = lambda x: np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, np.int64)
    t0, b0 = starts(by_text[0]), starts(by_bucket[0])
    some = by_text[0][t0]

    def summed(runs: np.ndarray, at: np.ndarray, by: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Sums over the runs of x[at] * by, some _ENTRIES of them at a time."""
        out, a = np.empty((len(runs), k), np.float32), 0
        while a < len(runs):
            z = max(a + 1, int(np.searchsorted(runs, runs[a] + _ENTRIES)))
            lo, hi = runs[a], runs[z] if z < len(runs) else len(at)
            out[a:z] = np.add.reduceat(x[at[lo:hi]] * by[lo:hi], runs[a:z] - lo, axis=0)
            a = z
        return out

    w, b = np.zeros((len(used), k), np.float32), np.zeros(k, np.float32)
    hot = np.eye(k, dtype=np.float32)[y]
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for t in range(1, steps + 1):
        s = np.zeros((n, k), np.float32)
        if len(t0):
            s[some] = summed(t0, by_text[1], by_text[2], w)
        s += b
        e = np.exp(s - s.max(1, keepdims=True))
        g = (e / e.sum(1, keepdims=True) - hot) / n
        gw = summed(b0, by_bucket[1], by_bucket[2], g.astype(np.float32)) if len(b0) else w
        for x, gx, i in ((w, gw, 0), (b, g.sum(0), 2)):
            moments[i] = 0.9 * moments[i] + 0.1 * gx
            moments[i + 1] = 0.99 * moments[i + 1] + 0.01 * gx * gx
            x -= rate * (moments[i] / (1 - 0.9**t)) / (np.sqrt(moments[i + 1] / (1 - 0.99**t)) + 1e-8)
    full = np.zeros((_BUCKETS + 240, k), np.float32)
    full[used] = w
    return Domains(names, full, b)


def labelled(docs: DataFrame, labels: DataFrame, text: str, key: str, sample: int) -> DataFrame:
    """(k, t, domain): at most ``sample`` documents of each domain, those of the least hashes of their keys, hence the same ones on every run.
    Rows without a language, key or quality of 0 or 1 are left out; of labels for the same key the greatest quality holds, of
    documents the least text with its least language."""
    one = labels.select(F.col("doc_id").cast("long").alias("k"), F.col("quality").cast("int").alias("q")).where("k is not null and q in (0, 1)").groupBy("k").agg(F.max("q").alias("q"))
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col("lang").cast("string").alias("lang"), F.col(text).cast("string").alias("t")).where("lang is not null")
    # the sample is drawn from keys and languages alone; texts are read for what it holds
    drawn = rows.select("k", "lang").join(one, "k").withColumn("domain", F.concat("lang", F.when(F.col("q") == 1, "/good").otherwise("/poor"))).groupBy("k", "domain").agg(F.first("q").alias("q"))
    drawn = drawn.withColumn("r", F.expr("row_number() over (partition by domain order by xxhash64(k), k)")).where(F.col("r") <= sample)
    drawn = written(drawn.select("k").distinct().join(one, "k"), "sample")
    if drawn.count() <= BROADCAST_IDS:  # sample times domains
        drawn = F.broadcast(drawn)
    least = rows.join(drawn, "k").groupBy("k", "q").agg(F.min(F.struct("t", "lang")).alias("at")).select("k", F.col("at.t").alias("t"), F.concat("at.lang", F.when(F.col("q") == 1, "/good").otherwise("/poor")).alias("domain"))
    return least.withColumn("r", F.expr("row_number() over (partition by domain order by xxhash64(k), k)")).where(F.col("r") <= sample).select("k", "t", "domain")


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> Domains:
    """Trained in one task on the bounded sample. Without labelled rows there is one domain, "all"."""

    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(mix64(t["k"].to_numpy().view(np.uint64)), kind="stable")
        texts, domain = t["t"].to_pylist(), t["domain"].to_pylist()
        names = sorted(set(domain))
        m = train([texts[i] for i in order], np.array([names.index(domain[i]) for i in order]), names)
        return pa.table({"names": pa.array([names]), "w": [m.weights.tobytes()], "b": [m.bias.tobytes()]})

    rows = labelled(docs, labels, text, key, sample)
    got = rows.groupBy(F.lit(0).alias("one")).applyInArrow(run, "names array<string>, w binary, b binary").collect()
    if not got:
        return Domains(["all"], np.zeros((_BUCKETS + 240, 1), np.float32), np.zeros(1, np.float32))
    names = list(got[0][0])
    return Domains(names, np.frombuffer(got[0][1], np.float32).reshape(-1, len(names)), np.frombuffer(got[0][2], np.float32))


def memberships(docs: DataFrame, model: Domains, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, tokens, p, u) for each row; tokens: chunks between white space, 0 for null or empty text; u: hash of key and text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, n = held.value.posteriors(b.column(1).to_pylist())
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), rows, b.column(2)], ["doc_id", "tokens", "p", "u"])

    body, k = F.col(text).cast("string"), F.col(key).cast("long")
    return texts_of(docs, k, body, F.xxhash64(k, body)).mapInArrow(run, "doc_id bigint, tokens bigint, p array<float>, u bigint")


def rates(p: np.ndarray, steps: list[np.ndarray], ahead: bool = False) -> np.ndarray:
    """Rates of documents with these posteriors after the given gradients (one number per domain each): accelerated
    projected descent from rate 1, in the metric of tokens, in which the step is 1. ahead: the point at which the
    next gradient is to be taken."""
    r = y = np.ones(len(p))
    for i, g in enumerate(steps):
        new = np.maximum(0.0, y - p @ g)
        y = new + i / (i + 3) * (new - r)
        r = new
    return y if ahead else r


def _totals(table: DataFrame, k: int, steps: list[np.ndarray]) -> np.ndarray:
    """Sum of rate * tokens * posterior for each domain, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for b in batches:
            p = b.column(1).flatten().to_numpy().reshape(-1, k).astype(np.float64)
            total += (rates(p, steps, ahead=True) * b.column(0).to_numpy()) @ p
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(total)], ["k", "s"])

    got = table.select("tokens", "p").mapInArrow(run, "k bigint, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(k)
    for r in got:
        out[r[0]] = r[1]
    return out


def solve(table: DataFrame, names: list[str], targets: dict[str, float] | None = None, budget: float = 1.0) -> list[np.ndarray]:
    """The gradients of the descent. Targets are shares of ``budget`` times all tokens; shares of domains without any
    expected token go to the others in proportion; with no share left, or None, the domains share alike."""
    k = len(names)
    have = _totals(table, k, [])
    want = np.array([1.0 if targets is None else max(0.0, targets.get(x, 0.0)) for x in names]) * (have > 0)
    if want.sum() <= 0:
        want = (have > 0).astype(float)
    if want.sum() <= 0:
        return []
    want = want / want.sum() * have.sum() * budget
    scale = np.maximum(have, 1e-12)
    steps: list[np.ndarray] = []
    total = have
    while True:
        g = np.where(have > 0, (total - want) / scale, 0.0)
        residual, whole = float((g * g * scale).sum()), float((want * want / scale).sum())
        if residual <= TOLERANCE * whole:
            return steps
        if len(steps) >= STEPS:
            _LOG.warning("mixing: a residual of %.3g against targets of %.3g after %d steps: no rates meet them more closely, or they converge slowly", residual, whole, len(steps))
            return steps
        steps.append(g)
        total = _totals(table, k, steps)


def copies(u: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Whole numbers of copies with the rate as their mean: a row's hash decides on the fraction."""
    x = (mix64(u.view(np.uint64) ^ np.uint64(0x1F83D9ABFB41BD6B)) >> np.uint64(11)) / float(1 << 53)
    return (np.floor(rate) + (x < rate - np.floor(rate))).astype(np.int32)


def _decided(u: np.ndarray, p: np.ndarray, tokens: np.ndarray, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    rate = np.where(tokens > 0, rates(p.astype(np.float64), steps), 1.0)
    return rate, copies(u, rate)


RATED = "doc_id bigint, tokens bigint, domain string, rate double, copies int"


def document_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = TARGETS, text: str = "text", key: str = "doc_id", budget: float = 1.0) -> DataFrame:
    """(doc_id, tokens, domain, rate, copies) for each row; domain is the likeliest one.

    Null and empty texts have no tokens, rate 1 and one copy. Rows with the same key (or none) and the same text are rounded
    alike. An empty table gives no rows. Columns beyond the key, text and lang aren't read.
    """
    model = fit(docs, labels, text, key)
    table = written(memberships(docs, model, text, key), "memberships")
    steps, names = solve(table, model.names, targets, budget), model.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.column(2).flatten().to_numpy().reshape(-1, len(names))
            rate, n = _decided(b.column(3).to_numpy(), p, b.column(1).to_numpy(), steps)
            domain = pa.array(names).take(pa.array(p.argmax(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), domain, pa.array(rate), pa.array(n)], ["doc_id", "tokens", "domain", "rate", "copies"])

    return table.mapInArrow(run, RATED)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = TARGETS, text: str = "text", key: str = "doc_id", budget: float = 1.0) -> DataFrame:
    """``docs`` with each row as often as its rate says (not at all, once, or more), columns as they were; rows as in ``document_rates``.

    The rows are written with their posteriors, so that a text is scored once, and never shuffled.
    """
    model = fit(docs, labels, text, key)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scored(texts: pa.Array) -> pa.Array:
        p, n = held.value.posteriors(texts.to_pylist())
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
        return pa.StructArray.from_arrays([pa.array(n), rows], ["tokens", "p"])

    k, body = F.col(f"`{key}`").cast("long"), F.col(f"`{text}`").cast("string")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    table = texts_of(docs).select(whole, F.xxhash64(k, body).alias("u"), F.arrow_udf(scored, "tokens bigint, p array<float>")(body).alias("m"))
    table = written(table, "memberships").select("row", "u", "m.tokens", "m.p")
    steps, width = solve(table, model.names, targets, budget), len(model.names)

    def counted(u: pa.Array, tokens: pa.Array, p: pa.Array) -> pa.Array:
        return pa.array(_decided(u.to_numpy(), p.flatten().to_numpy().reshape(-1, width), tokens.to_numpy(), steps)[1])

    once = F.arrow_udf(counted, "int").asNondeterministic()  # else the filter would evaluate it again, in another worker
    out = table.select("row", once("u", "tokens", "p").alias("copies")).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(f"row.`{c}`") for c in docs.columns])
