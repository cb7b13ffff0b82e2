"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint has 128 bits over the distinct words of a text, a word weighing its length. The embedding of a
fingerprint is the number of ones in each of 64 segments of two bits; the Manhattan distance of two
embeddings never exceeds the Hamming distance of the fingerprints, on all segments or on any of them. The
segments are dealt out to so many tables that a pair within the distance lies within 1 in one of them, by its bits
and hence by its embedding: every point is put into its own cell and its cells one step up, where each such pair
meets, so none is left out. Hamming distance over all 128 bits then decides, and beyond CLOSE the words of both texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, components, list_array, mix64, text_slices, texts_of, union, uniq, without_ids, written
from .words import words

#: Largest Hamming distance of near-duplicates, of 128; beyond CLOSE they must also share their words: copies with a tenth
#: of their words changed lie at 17 and more, where short texts that are no copies lie as well.
DISTANCE, CLOSE = 20, 16
#: Least Jaccard similarity of the distinct words of a pair beyond CLOSE.
JACCARD = 0.8
#: So many fingerprints are compared each with each; of more, a table is split into groups of about GROUP.
FEW, GROUP = 2000, 8000
_SEGMENTS = 64
#: Fingerprints side by side in a comparison; pairs that a group collects before it joins them.
_TILE, _HELD_PAIRS = 2048, 1_000_000


def fingerprints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2) 64-bit halves and a mask of the texts that have any word. Each word counts once."""
    out = np.zeros((len(texts), 16), np.uint8)
    some = np.zeros(len(texts), bool)
    w = words()
    for lo, hi in text_slices(texts):
        idx, ends = w.index(texts[lo:hi])
        doc = np.repeat(np.arange(hi - lo, dtype=np.uint64), np.diff(ends))
        # text (up to 2**20 in a slice), 40 bits of the word's hash, its length up to 12: sorted, each once
        word = w.hash >> np.uint64(24) << np.uint64(4) | np.clip(w.length, 2, 12).astype(np.uint64)
        word[w.hash == 0] = 0
        both = uniq(doc << np.uint64(44) | word[idx])
        both = both[both & np.uint64((1 << 44) - 1) != 0]
        doc = (both >> np.uint64(44)).astype(np.int64)
        h = both >> np.uint64(4) & np.uint64((1 << 40) - 1)
        weight = (both & np.uint64(15)).astype(np.float32) - 1
        cut = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc)) if len(doc) else np.zeros(1, np.int64)
        halves = np.stack([mix64(h), mix64(h ^ np.uint64(0x5BD1E995C2B2AE35))], 1).view(np.uint8)
        for a, z in zip(cut.tolist(), cut[1:].tolist()):
            ones = weight[a:z] @ np.unpackbits(halves[a:z], axis=1).astype(np.float32)
            out[lo + doc[a]] = np.packbits(2 * ones > weight[a:z].sum())
            some[lo + doc[a]] = True
    return out.view(np.int64).reshape(-1, 2), some


def plan(n: int, distance: int = DISTANCE) -> list[np.ndarray]:
    """The segments of each table for n fingerprints: all of them, dealt out to so many tables that a pair within the distance lies
    within 1 in one of them at least. Few fingerprints are in one cell of one table, without segments."""
    if n <= FEW:
        return [np.empty(0, np.int64)]
    tables = min(distance // 2 + 1, _SEGMENTS)
    return [np.sort(x) for x in np.array_split(np.random.default_rng(20240607).permutation(_SEGMENTS), tables)]


def embed(halves: np.ndarray) -> np.ndarray:
    """(n, 64) numbers of ones in the two-bit segments."""
    bits = np.unpackbits(np.ascontiguousarray(halves).view(np.uint8).reshape(len(halves), 16), axis=1)
    return bits[:, ::2] + bits[:, 1::2]


def _unary(x: str) -> str:
    """SQL of a half's embedding, each segment's number in unary (00, 01, 11): two such differ in as many bits as their Manhattan distance."""
    low, high = "6148914691236517205L", "-6148914691236517206L"  # 0x5555.., 0xAAAA..
    return f"((({x} | shiftrightunsigned({x}, 1)) & {low}) | ({x} & shiftleft({x}, 1) & {high}))"


def with_fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(k, hi, lo) of the rows that have a key and a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, some = fingerprints(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp[:, 0]), pa.array(fp[:, 1])], ["k", "hi", "lo"]).filter(pa.array(some))

    return texts_of(docs, F.col(key).cast("long"), F.col(text).cast("string")).where(F.col(key).isNotNull()).mapInArrow(run, "k bigint, hi bigint, lo bigint")


def _within(a: np.ndarray, b: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of a, row of b, Hamming distance) of the pairs of these fingerprints within the distance, in tiles."""
    for lo in range(0, len(b), _TILE):
        part = b[lo : lo + _TILE]
        step = max(1, _TILE * 64 // len(part))
        for top in range(0, len(a), step):
            # the distance of one half decides on nearly all
            half = np.bitwise_count(a[top : top + step, 0, None] ^ part[None, :, 0])
            i, j = np.divmod(np.flatnonzero(half <= distance), len(part))
            d = half[i, j] + np.bitwise_count(a[top + i, 1] ^ part[j, 1])
            ok = d <= distance
            yield top + i[ok], lo + j[ok], d[ok]


def _compared(own: np.ndarray, cell: np.ndarray, fp: np.ndarray, bits: int, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of one group. own: whether the group is the row's, or one step up from it; cell: the rest of its table's bits."""
    mine, guests = (x[np.argsort(cell[x], kind="stable")] for x in (np.flatnonzero(own), np.flatnonzero(~own)))
    edges = np.arange((1 << bits) + 1)
    at, guest_at = np.searchsorted(cell[mine], edges), np.searchsorted(cell[guests], edges)
    for c in np.flatnonzero(np.diff(at)).tolist():
        x = mine[at[c] : at[c + 1]]
        others = [guests[guest_at[c] : guest_at[c + 1]], *(mine[at[c | 1 << k] : at[(c | 1 << k) + 1]] for k in range(bits) if not c >> k & 1)]
        for y, same in ((x, True), (np.concatenate(others), False)):
            for i, j, d in _within(fp[x], fp[y], distance):
                if same:
                    i, j, d = i[i < j], j[i < j], d[i < j]
                yield x[i], y[j], d


def near_pairs(unique: DataFrame, n: int, distance: int = DISTANCE, joined: int = -1) -> DataFrame:
    """(a, b, hamming) of all pairs of distinct fingerprints (node, hi, lo) within the distance, each once, a < b.

    joined: of pairs at this distance or less only so many are returned that the same fingerprints hang together, as (node, least
    node of its group, 0), and of pairs beyond none that hang together by those of a group; so a dense group of m isn't m * m rows.
    """
    tables = plan(n, distance)
    # a table's groups, by so many of its bits, hold some GROUP rows each; within a group the cells are met without a shuffle
    top = [min(2 * len(t), max(0, math.ceil(math.log2(max(n, 1) / GROUP)))) for t in tables]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4000):
                b = batch.slice(lo, 4000)
                m = b.num_rows
                fp = np.stack([b.column(1).to_numpy(), b.column(2).to_numpy()], 1)
                bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(m, 16), axis=1).astype(np.int64)
                for t, seg in enumerate(tables):
                    value = bits[:, np.concatenate([2 * seg, 2 * seg + 1])] @ (1 << np.arange(2 * len(seg), dtype=np.int64))
                    group, cell = value & (1 << top[t]) - 1, value >> top[t]
                    row, k = np.nonzero(group[:, None] >> np.arange(top[t]) & 1 ^ 1)
                    at = np.append(np.arange(m), row)
                    cols = [np.append(group, group[row] | 1 << k) * len(tables) + t, np.arange(len(at)) < m, cell[at].astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols), *(c.take(pa.array(at)) for c in b.columns)], ["g", "own", "cell", "node", "hi", "lo"])

    def compare(t: pa.Table) -> pa.Table:
        own, cell, node, g = t["own"].to_numpy(), t["cell"].to_numpy(), t["node"].to_numpy(), t["g"][0].as_py()
        fp = np.stack([t["hi"].to_numpy(), t["lo"].to_numpy()], 1).view(np.uint64)
        of = g % len(tables)
        label, held, size, out = np.arange(len(node)), [], 0, []

        def settle() -> None:
            i, j, d = (np.concatenate(x) for x in zip(*held))
            union(label, i[d <= joined], j[d <= joined])
            keep = (d > joined) & (label[i] != label[j])
            out.append((i[keep], j[keep], d[keep]))
            held.clear()

        for found in _compared(own, cell, fp, 2 * len(tables[of]) - top[of], distance):
            if len(found[0]):
                held.append(found)
                size += len(found[0])
                if size > _HELD_PAIRS:
                    settle()
                    size = 0
        if held:
            settle()
        i, j, d = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint8))
        keep, led = label[i] != label[j], np.flatnonzero(label != np.arange(len(label)))
        a, b = (np.append(node[x[keep]], node[y]) for x, y in ((i, led), (j, label[led])))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "hamming": np.append(d[keep], np.zeros(len(led))).astype(np.int32)})

    rows = unique.select("node", "hi", "lo").mapInArrow(spread, "g bigint, own boolean, cell int, node bigint, hi bigint, lo bigint")
    return rows.groupBy("g").applyInArrow(compare, "a bigint, b bigint, hamming int").distinct()


def _same_words(docs: DataFrame, pairs: DataFrame, text: str, key: str, least: float) -> DataFrame:
    """(a, b) of the pairs of keys whose texts' distinct words have a Jaccard similarity of ``least`` or more."""
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    rows = docs.select(F.col(key).cast("long").alias("node"), F.col(text).cast("string").alias("t")).join(wanted, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in text_slices(texts):
                idx, ends = words().index(texts[lo:hi])
                h = words().hash[idx]
                sets = [uniq(h[a:z][h[a:z] != 0].view(np.int64)) for a, z in zip(ends.tolist(), ends[1:].tolist())]
                offsets = np.append(0, np.cumsum([len(x) for x in sets]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), list_array(np.concatenate(sets), offsets, pa.int64())], ["node", "x"])

    content = written(texts_of(rows, "node", "t").mapInArrow(run, "node bigint, x array<bigint>"), "contents")
    both = pairs.join(content.select(F.col("node").alias("a"), F.col("x").alias("xa")), "a").join(content.select(F.col("node").alias("b"), F.col("x").alias("xb")), "b")
    both = both.withColumn("common", F.size(F.array_intersect("xa", "xb")))
    return both.where(F.col("common") >= least * (F.size("xa") + F.size("xb") - F.col("common"))).where("common > 0").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", distance: int = DISTANCE, among: DataFrame | None = None) -> DataFrame:
    """(doc_id, duplicate_of) for each document that near-duplicates another; ``duplicate_of`` is the least doc_id of
    its group, which stays. Groups are the connected components of pairs within the distance (beyond CLOSE, of those with
    the same words but for a few). among: (k) the keys of the documents that count; None: all.

    Texts with the same words are at distance 0. Rows with a null key, and null, empty or wordless texts, are in no
    group. Rows that share a key are one document. An empty table gives no rows; other columns are not read.
    """
    fp = with_fingerprints(docs, text, key)
    fp = written(fp if among is None else fp.join(among, "k", "left_semi"), "fingerprints")
    unique = written(fp.groupBy("hi", "lo").agg(F.min("k").alias("node")), "unique")
    pairs = near_pairs(unique, unique.count(), distance, min(distance, CLOSE))
    if distance > CLOSE:
        pairs = written(pairs, "pairs")
        pairs = pairs.where(F.col("hamming") <= CLOSE).select("a", "b").union(_same_words(docs, pairs.where(F.col("hamming") > CLOSE).select("a", "b"), text, key, JACCARD))
    # texts of rows that share a key are in one group
    of = fp.join(unique, ["hi", "lo"]).select("k", "node")
    several = of.groupBy("k").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("k", "a")
    roots = components(pairs.select("a", "b").union(of.join(several, "k").select("a", F.col("node").alias("b"))))
    grouped = of.join(roots, "node", "left")
    return grouped.select(F.col("k").alias("doc_id"), F.coalesce("root", "node").alias("duplicate_of")).where("doc_id <> duplicate_of").groupBy("doc_id").agg(F.min("duplicate_of").alias("duplicate_of"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", distance: int = DISTANCE, originals: DataFrame | None = None) -> DataFrame:
    """``docs`` without the near-duplicates of a document that stays, columns as they were.

    originals: the documents as they were before lines were taken out of them. A copy that has lost the lines it shares with the document
    it was made from is no longer near to it; two of ``docs`` are therefore near if their texts are, or if those that they had are.
    """
    near = near_duplicates(docs, text, key, distance)
    if originals is not None:
        ids = written(docs.select(F.col(key).cast("long").alias("k")).where("k is not null").distinct(), "ids")
        both = near.union(near_duplicates(originals, text, key, distance, ids))
        near = components(both, "doc_id", "duplicate_of").where("node <> root").select(F.col("node").alias("doc_id"))
    return without_ids(docs, near, key)
