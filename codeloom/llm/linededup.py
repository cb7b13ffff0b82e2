"""Line dedup through a sharded minimal perfect hash.

Lines are counted by two hashes, of 64 and 32 bits. The first ones of lines that occur more than once are the keys of minimal
perfect hash functions, one for each shard of the hash space, which index plain arrays: the second one as a fingerprint that
tells a key from any other line, the count, and the first place. A line that occurs once needs no entry: its
fingerprint doesn't match. Documents probe the arrays; no line is joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, written

#: Keys of a shard, about.
SHARD_KEYS = 200_000
#: All arrays up to this size are sent to every executor; larger ones stay where they were built, and the
#: hashes of the documents' lines are sent to them.
RESIDENT = 64 << 20
GAMMA = 2.0
_LAST = np.iinfo(np.int64).max


class Mphf:
    """Levels of bit arrays: a key sits at the first level where no other key wants its bit; its index is its rank."""

    def __init__(self, levels: list[np.ndarray], sizes: list[int]):
        self.levels, self.sizes = levels, sizes
        ones = [np.bitwise_count(x).astype(np.int64) for x in levels]
        before, self.rank = 0, []
        for x in ones:
            self.rank.append(before + np.cumsum(x) - x)
            before += int(x.sum())
        self.n = before

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> "Mphf":
        """keys: distinct uint64."""
        levels, sizes = [], []
        while len(keys):
            size = max(64, int(len(keys) * GAMMA))
            at = cls._at(keys, len(levels), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros((size + 63) // 64 * 64, np.uint8)
            bits[at[alone]] = 1
            levels.append(np.packbits(bits, bitorder="little").view(np.uint64))
            sizes.append(size)
            keys = keys[~alone]
        return cls(levels, sizes)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """0..n-1 for each key; for any other value -1 or the index of some key."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k, (bits, size) in enumerate(zip(self.levels, self.sizes)):
            at = self._at(keys[left], k, size)
            word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[left[hit]] = self.rank[k][at[hit] >> 6] + below
            left = left[~hit]
            if not len(left):
                break
        return out

    def to_bytes(self) -> bytes:
        return np.array([len(self.sizes), *self.sizes], np.int64).tobytes() + b"".join(x.tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> "Mphf":
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        sizes = np.frombuffer(raw, np.int64, n, 8).tolist()
        at, levels = 8 + 8 * n, []
        for s in sizes:
            words = (s + 63) // 64
            levels.append(np.frombuffer(raw, np.uint64, words, at))
            at += 8 * words
        return cls(levels, sizes)


class Shard:
    """One shard's function and arrays. The fingerprint is a second, independent hash of the line: a line is taken for
    another one only if 96 bits agree; one that occurs once is taken for a repeated one with a chance of 2**-32. Keys that share the
    first hash come after the function's own, found by it and the fingerprint."""

    def __init__(self, mphf: Mphf, prints: np.ndarray, counts: np.ndarray, docs: np.ndarray, places: np.ndarray, twins: np.ndarray):
        self.mphf, self.prints, self.counts, self.docs, self.places = mphf, prints, counts, docs, places
        #: First hashes of the keys from mphf.n on, sorted.
        self.twins = twins

    @classmethod
    def build(cls, h: np.ndarray, prints: np.ndarray, counts: np.ndarray, docs: np.ndarray, places: np.ndarray) -> "Shard":
        by = np.lexsort((prints, h))
        first = np.append(True, h[by][1:] != h[by][:-1]) if len(h) else np.empty(0, bool)
        own, more = by[first], by[~first]
        f = Mphf.build(h[own])
        order = np.empty(len(own), np.int64)
        order[f.index(h[own])] = own
        order = np.append(order, more)
        return cls(f, prints[order].astype(np.int32), np.minimum(counts[order], 0xFFFFFFFF).astype(np.uint32), docs[order], places[order].astype(np.int32), h[more])

    def probe(self, h: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Index of each line by its two hashes, -1 for one that isn't a key."""
        at = self.mphf.index(h)
        if not self.mphf.n:
            return at
        at = np.where((at >= 0) & (self.prints[at] == prints), at, -1)
        if len(self.twins):
            for i in np.flatnonzero((at < 0) & np.isin(h, self.twins)).tolist():
                for k in np.flatnonzero(self.twins == h[i]).tolist():
                    if self.prints[self.mphf.n + k] == prints[i]:
                        at[i] = self.mphf.n + k
        return at


def _shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


def _shard_sql(shards: int) -> str:
    return f"cast(shiftrightunsigned(h, 40) % {shards} as int)"


#: White space around a line doesn't count; the line's hashes are of the rest.
_TRIMMED = "transform(split({text}, '\\n', -1), x -> trim(BOTH ' \\t\\r\\u000C' FROM x))"
_HASHES, _PRINTS = "transform({lines}, x -> xxhash64(x))", "transform({lines}, x -> hash(x))"
_BLANK = "xxhash64('')"


def repeated(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(h, f, n, doc, place) of the lines that occur more than once, by both hashes: their number and first place. Blank lines aren't counted."""
    keyed = docs.select(F.expr(f"coalesce(cast(`{key}` as bigint), {_LAST})").alias("doc"), F.expr(_TRIMMED.format(text=f"cast(`{text}` as string)")).alias("lines"))
    lines = keyed.selectExpr("doc", "posexplode(lines) as (place, line)").where("line <> ''").selectExpr("xxhash64(line) as h", "hash(line) as f", "doc", "place")
    lines = lines.groupBy("h", "f").agg(F.count("*").alias("n"), F.min(F.struct("doc", "place")).alias("first")).where("n > 1")
    return lines.selectExpr("h", "f", "n", "first.doc as doc", "first.place as place")


_ARRAYS = ("mphf", "prints", "counts", "docs", "places", "twins")


def build_index(keys: DataFrame, shards: int) -> DataFrame:
    """(shard, mphf, prints, counts, docs, places, twins): one row for each shard that has keys."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        s = Shard.build(t["h"].to_numpy().view(np.uint64), t["f"].to_numpy(), t["n"].to_numpy(), t["doc"].to_numpy(), t["place"].to_numpy())
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "mphf": [s.mphf.to_bytes()], "prints": [s.prints.tobytes()], "counts": [s.counts.tobytes()], "docs": [s.docs.tobytes()], "places": [s.places.tobytes()], "twins": [s.twins.tobytes()]})

    return keys.withColumn("shard", F.expr(_shard_sql(shards))).groupBy("shard").applyInArrow(run, "shard int, " + ", ".join(f"{c} binary" for c in _ARRAYS))


def _load(mphf: bytes, prints: bytes, counts: bytes, docs: bytes, places: bytes, twins: bytes) -> Shard:
    return Shard(Mphf.from_bytes(mphf), np.frombuffer(prints, np.int32), np.frombuffer(counts, np.uint32), np.frombuffer(docs, np.int64), np.frombuffer(places, np.int32), np.frombuffer(twins, np.uint64))


def _drops(s: Shard, h: np.ndarray, prints: np.ndarray, doc: np.ndarray, place: np.ndarray, least: int) -> np.ndarray:
    """Which occurrences go."""
    out = np.zeros(len(h), bool)
    at = s.probe(h, prints)
    hit = np.flatnonzero(at >= 0)
    at = at[hit]
    out[hit] = (s.counts[at] >= least) & ~((s.docs[at] == doc[hit]) & (s.places[at] == place[hit]))
    return out


_RESIDENT: dict = {}


def _resident(held) -> dict[int, Shard]:
    """The shards of a broadcast, read once in each Python worker."""
    if id(held.value) not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[id(held.value)] = {k: _load(*v) for k, v in held.value.items()}
    return _RESIDENT[id(held.value)]


def _keep_udf(held, shards: int, least: int):
    def keep(hs: pa.Array, fs: pa.Array, doc: pa.Array) -> pa.Array:
        n = pc.fill_null(pc.list_value_length(hs), 0).to_numpy(zero_copy_only=False)
        ends = np.append(0, np.cumsum(n))
        flat, prints = hs.flatten().to_numpy(zero_copy_only=False).view(np.uint64), fs.flatten().to_numpy(zero_copy_only=False)
        own = np.repeat(doc.to_numpy(zero_copy_only=False), n)
        place = np.arange(len(flat)) - np.repeat(ends[:-1], n)
        out = np.ones(len(flat), bool)
        of = _shard_of(flat, shards)
        for s, shard in _resident(held).items():
            at = np.flatnonzero(of == s)
            out[at] = ~_drops(shard, flat[at], prints[at], own[at], place[at], least)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out))

    # not to be evaluated once for the filter and once for the rest, in another worker
    return F.arrow_udf(keep, "array<boolean>").asNondeterministic()


_SALTS = 8


def _routed(d: DataFrame, index: DataFrame, shards: int, least: int) -> DataFrame:
    """(doc, t: hash of the text, gone: places) of the documents (row, doc, text, hs, fs) that lose a line. Each shard's arrays go ahead of the
    hashes that are sent to it, in the same sorted partition, so a task holds one shard's arrays and a batch of hashes at a time; a
    shard with a hot line is met in several partitions."""
    lines = d.selectExpr("doc", "xxhash64(text) as t", "posexplode(arrays_zip(hs, fs)) as (place, x)").selectExpr("doc", "t", "place", "x.hs as h", "x.fs as f").where(f"h <> {_BLANK}")
    none = [F.lit(None).cast("binary").alias(c) for c in _ARRAYS]
    probes = lines.select(F.expr(_shard_sql(shards)).alias("shard"), F.expr(f"cast(pmod(xxhash64(doc, place), {_SALTS}) as int)").alias("salt"), F.lit(1).alias("kind"), "h", "f", "doc", "place", "t", *none)
    zero = [F.lit(0).cast(kind).alias(c) for c, kind in (("h", "bigint"), ("f", "int"), ("doc", "bigint"), ("place", "int"), ("t", "bigint"))]
    arrays = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"), F.lit(0).alias("kind"), *zero, *_ARRAYS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, of = None, -1
        for b in batches:
            kind = b["kind"].to_numpy()
            cut = np.append(np.flatnonzero(kind == 0), len(kind))
            for lo, hi in zip(np.append(0, cut[:-1]), cut):
                x = b.slice(lo, hi - lo)
                if not len(x):
                    continue
                if kind[lo] == 0:
                    shard, of = _load(*(x[c][0].as_py() for c in _ARRAYS)), x["shard"][0].as_py()
                    x = x.slice(1)
                if shard is None:
                    continue
                gone = _drops(shard, x["h"].to_numpy().view(np.uint64), x["f"].to_numpy(), x["doc"].to_numpy(), x["place"].to_numpy(), least) & (x["shard"].to_numpy() == of)
                yield pa.RecordBatch.from_arrays([x["doc"], x["t"], x["place"]], ["doc", "t", "place"]).filter(pa.array(gone))

    sent = arrays.unionByName(probes).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    return sent.mapInArrow(run, "doc bigint, t bigint, place int").groupBy("doc", "t").agg(F.collect_set("place").alias("places"))


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = 2, resident: int = RESIDENT, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """``docs`` with every line that occurs ``least`` times or more, in all documents together, taken out but for its
    first occurrence (least doc_id, then least place); the other columns stay. Documents of which nothing but blank lines
    is left go, if a line was taken out of them; any that had nothing but blank lines before stay as they are.

    Lines end at a newline; white space around a line doesn't count; blank lines are never taken out. Null text stays
    null. A null key comes after all others; rows that share a key are one document: the same line at the same
    place in each is their common first occurrence. An empty table gives no rows. Columns may have any names.
    """
    keys = written(repeated(docs, text, key), "lines")
    shards = max(1, -(-keys.count() // shard_keys))
    index = written(build_index(keys, shards), "mphf")
    size = index.select(F.sum(sum(F.length(c) for c in _ARRAYS))).first()[0] or 0
    # the user's columns in one, so that no name of theirs can be taken for one of these
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"), F.expr(f"coalesce(cast(`{key}` as bigint), {_LAST})").alias("doc"))
    trimmed = _TRIMMED.format(text="text")
    d = d.select("*", F.expr(_HASHES.format(lines=trimmed)).alias("hs"), F.expr(_PRINTS.format(lines=trimmed)).alias("fs"))
    if size <= resident:
        held = docs.sparkSession.sparkContext.broadcast({r[0]: tuple(bytes(x) for x in r[1:]) for r in index.collect()})
        d = d.withColumn("keep", _keep_udf(held, shards, least)("hs", "fs", "doc"))
        d = d.withColumn("gone", F.expr("coalesce(exists(keep, x -> not x), false)"))
        rest = F.expr("filter(split(text, '\\n', -1), (x, i) -> keep[i])")
    else:
        gone = _routed(d, index, shards, least).select(F.col("doc").alias("of"), "t", "places")
        d = d.join(gone, (F.col("doc") == F.col("of")) & (F.xxhash64("text") == F.col("t")), "left").withColumn("gone", F.col("places").isNotNull())
        rest = F.expr("filter(split(text, '\\n', -1), (x, i) -> not array_contains(places, i))")
    d = d.withColumn("rest", F.when(F.col("gone"), rest))
    d = d.where("not gone or exists(rest, x -> trim(BOTH ' \\t\\r\\u000C' FROM x) <> '')")
    new = F.when(F.col("gone"), F.array_join("rest", "\n")).otherwise(F.col("text"))
    return d.select(*[new.alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])
