"""Near-duplicate embeddings by NN-descent.

Lists of nearest neighbours start from groups that random hyperplanes make, and are refined: the neighbours of a
vector (of either direction) are compared with each other, and each keeps the better ones. Where a list
is saturated (its worst entry still passes the threshold), it is enlarged to all of the vector's component,
compared exactly. Equal vectors are one until the end. A sample of vectors is compared with all others to audit
the recall; as long as it is below the target, more groups are made, lists grow, and the descent goes on; after
the last attempt, or if the sample can't tell, all vectors are compared with all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, sample_key, trim, written

THRESHOLD = 0.9
#: Entries of a neighbour list to begin with; hyperplane tables of a round; vectors of a group and of a block.
NEIGHBOURS, TABLES, GROUP, BLOCK = 10, 4, 256, 512
#: Blocks of a component at most: each of its vectors is sent to so many places; more than BLOCK vectors are then a block.
BLOCKS = 64
#: The descent ends when fewer than this share of the entries that pass the threshold are new, or after so many rounds.
STILL, ROUNDS = 0.002, 6
#: Vectors compared with all others, at least and as a share; the recall among them that ends the search, and the attempts.
AUDIT, AUDIT_SHARE, RECALL, ATTEMPTS = 512, 1 / 1024, 0.95, 4
#: True edges that an audit must meet; its vectors are made more until it does, up to AUDIT_MOST (or the share).
ENOUGH, AUDIT_MOST = 100, 16384


def vectors(table: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, v): float32 bytes of unit length. Left out: null keys; null, empty or zero vectors; such with a null, NaN or infinite
    entry; lengths other than the commonest one. Of rows that repeat a key the greatest vector stands for all."""
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<float>").alias("e")).where("id is not null and size(e) > 0")
    size = rows.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), "n").first()
    wide = size[0] if size else 1
    rows = rows.where(F.size("e") == wide).groupBy("id").agg(F.max("e").alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, wide)
            norm = np.sqrt((x * x).sum(1))
            ok = np.isfinite(norm) & (norm > 0)
            unit = (x[ok] / norm[ok, None]).astype("<f4") + np.float32(0)  # -0.0 equals 0.0
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), pa.array([r.tobytes() for r in unit], pa.binary())], ["id", "v"])

    return rows.mapInArrow(run, "id bigint, v binary")


def _stack(column) -> np.ndarray:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), "<f4").reshape(len(parts), -1)


def _best(ids: np.ndarray, m: np.ndarray, k: int, floor: np.ndarray | None = None) -> pa.Table:
    """The k best others of each, as (u, v, s); floor: similarity that an entry must exceed."""
    trim()
    s = m @ m.T
    s[ids[:, None] == ids[None, :]] = -2
    k = min(k, len(ids) - 1)
    if k <= 0:
        return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "s": pa.array([], pa.float32())})
    at = np.argpartition(-s, k - 1, axis=1)[:, :k]
    val = np.take_along_axis(s, at, 1)
    good = val > (-1.5 if floor is None else np.maximum(floor, -1.5)[:, None])
    row, col = np.nonzero(good)
    return pa.table({"u": ids[row], "v": ids[at[row, col]], "s": val[row, col]})


EDGES = "u bigint, v bigint, s float"


def _grouped(vecs: DataFrame, n: int, seed: int, k: int) -> DataFrame:
    """Candidate neighbours from TABLES tables of hyperplane groups. A group far above GROUP is divided by hash, and each two parts are compared."""
    bits = max(0, math.ceil(math.log2(max(1, n / GROUP))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _stack(b.column(1)) if b.num_rows else np.empty((0, 1), np.float32)
            rng = np.random.default_rng(seed)
            for t in range(TABLES):
                planes = rng.standard_normal((m.shape[1], bits)).astype(np.float32)
                code = (m @ planes > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(m), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64) * TABLES + t), b.column(0), b.column(1)], ["g", "id", "v"])

    rows = vecs.mapInArrow(run, "g bigint, id bigint, v binary")
    parts = rows.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > 8 * GROUP).select("g", F.ceil(F.col("n") / (4 * GROUP)).cast("int").alias("parts"))
    rows = rows.join(parts, "g", "left").withColumn("part", F.expr(f"cast(pmod(xxhash64(id, {seed}), coalesce(parts, 1)) as int)"))
    other = F.explode(F.expr("case when parts is null then array(0) else filter(sequence(0, parts - 1), x -> x <> part) end")).alias("other")
    rows = rows.select("g", "part", "id", "v", other).select("g", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "id", "v")

    def near(t: pa.Table) -> pa.Table:
        return _best(t["id"].to_numpy(), _stack(t["v"]), k)

    return rows.groupBy("g", "i", "j").applyInArrow(near, EDGES)


def _top(edges: DataFrame, k: int) -> DataFrame:
    """The k best of each list; an edge that was there before stays old."""
    one = edges.groupBy("u", "v").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
    return one.withColumn("r", F.expr("row_number() over (partition by u order by s desc, v)")).where(F.col("r") <= k)


def _compared(pivot: np.ndarray, ids: np.ndarray, m: np.ndarray, floor: np.ndarray, fresh: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The members of each pivot (rows in a run) against each other, but for two old ones: what exceeds a member's floor, k for each at most."""
    starts = np.flatnonzero(np.append(True, pivot[1:] != pivot[:-1]))
    size = np.diff(np.append(starts, len(pivot)))
    wide = int(size.max())
    step = max(1, 1_000_000 // (wide * wide))
    for lo in range(0, len(starts), step):
        n = size[lo : lo + step]
        at = starts[lo : lo + step, None] + np.arange(wide)
        there = np.arange(wide) < n[:, None]
        at = np.where(there, at, 0)
        x = m[at]
        s = x @ x.transpose(0, 2, 1)
        new = fresh[at]
        s[~(there[:, :, None] & there[:, None, :] & (new[:, :, None] | new[:, None, :]))] = -2
        s[:, np.arange(wide), np.arange(wide)] = -2
        s[s <= floor[at][:, :, None]] = -2
        if wide > k:
            best = np.argpartition(-s, k - 1, axis=2)[:, :, :k]
            val = np.take_along_axis(s, best, 2)
        else:
            best, val = np.broadcast_to(np.arange(wide), s.shape), s
        g, row, col = np.nonzero(val > -1.5)
        yield pa.RecordBatch.from_arrays([pa.array(ids[at[g, row]]), pa.array(ids[at[g, best[g, row, col]]]), pa.array(val[g, row, col])], ["u", "v", "s"])


def _descend(graph: DataFrame, vecs: DataFrame, k: int) -> DataFrame:
    """One round: neighbours of neighbours, through each vector that both are neighbours of; it is one of them itself. Only pairs with an
    edge that is new since the last round are compared, and pivots without such an edge send nothing."""
    floor = graph.groupBy("u").agg(F.when(F.count("*") >= k, F.min("s")).otherwise(F.lit(-1.5)).cast("float").alias("floor"))
    back = graph.selectExpr("v as pivot", "u as id", "s", "fresh").withColumn("r", F.expr("row_number() over (partition by pivot order by s desc, id)")).where(F.col("r") <= k)
    both = graph.selectExpr("u as pivot", "v as id", "fresh").union(back.select("pivot", "id", "fresh"))
    live = both.where("fresh").select("pivot").distinct()
    itself = live.select("pivot", F.col("pivot").alias("id"), F.lit(False).alias("fresh"))
    members = both.join(live, "pivot", "left_semi").union(itself).groupBy("pivot", "id").agg(F.max("fresh").alias("fresh"))
    known = vecs.join(floor, F.col("id") == F.col("u"), "left").select("id", "v", F.coalesce("floor", F.lit(-1.5).cast("float")).alias("floor"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the rows of the last pivot of a batch: 2k + 1 at most in all
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            pivot = t["pivot"].to_numpy()
            cut = int(np.searchsorted(pivot, pivot[-1])) if len(pivot) else 0
            held, t = t.slice(cut), t.slice(0, cut)
            if cut:
                yield from _compared(pivot[:cut], t["id"].to_numpy(), _stack(t["v"]), t["floor"].to_numpy(), t["fresh"].to_numpy(), k)
        if held is not None and held.num_rows:
            yield from _compared(held["pivot"].to_numpy(), held["id"].to_numpy(), _stack(held["v"]), held["floor"].to_numpy(), held["fresh"].to_numpy(), k)

    rows = members.join(known, "id").select("pivot", "id", "v", "floor", "fresh")
    return rows.repartition("pivot").sortWithinPartitions("pivot").mapInArrow(near, EDGES)


def _within(nodes: DataFrame, vecs: DataFrame, threshold: float) -> DataFrame:
    """All pairs (a < b) above the threshold among the nodes of one root, exactly, block against block."""
    size = nodes.groupBy("root").agg(F.least(F.ceil(F.count("*") / BLOCK), F.lit(BLOCKS)).cast("int").alias("blocks"))
    rows = nodes.join(size, "root").join(vecs, F.col("node") == F.col("id")).withColumn("block", F.expr("cast(pmod(xxhash64(id), blocks) as int)"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("root", "block", "id", "v", other).select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "v")

    def pairs(key: tuple, t: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        block, ids, m = t["block"].to_numpy(), t["id"].to_numpy(), _stack(t["v"])
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found, right_t = [], m[right].T
        for lo in range(0, max(1, len(left)), BLOCK):
            mine = left[lo : lo + BLOCK]
            s = m[mine] @ right_t
            a, b = np.nonzero(s >= threshold)
            s, a, b = s[a, b], ids[mine[a]], ids[right[b]]
            ok = a < b if i == j else a != b
            found.append(pa.table({"u": np.minimum(a, b)[ok], "v": np.maximum(a, b)[ok], "s": s[ok]}))
        return pa.concat_tables(found)

    return rows.groupBy("root", "i", "j").applyInArrow(pairs, EDGES)


def _true(vecs: DataFrame, some: list, threshold: float) -> DataFrame:
    """(u, v, pairs): the true edges of some vectors, and the pairs of rows that each stands for."""
    held = vecs.sparkSession.sparkContext.broadcast((np.array([r["id"] for r in some]), np.array([r["copies"] for r in some]), b"".join(bytes(r["v"]) for r in some)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, copies, raw = held.value
        m = np.frombuffer(raw, "<f4").reshape(len(ids), -1)
        step = max(1, 4_000_000 // len(ids))
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                b = whole.slice(lo, step)
                mine, theirs = b.column(0).to_numpy(), b.column(2).to_numpy()
                a, c = np.nonzero(m @ _stack(b.column(1)).T >= threshold)
                ok = ids[a] != mine[c]
                a, c = a[ok], c[ok]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[a], mine[c])), pa.array(np.maximum(ids[a], mine[c])), pa.array(copies[a] * theirs[c])], ["u", "v", "pairs"])

    return vecs.select("id", "v", "copies").mapInArrow(run, "u bigint, v bigint, pairs bigint").dropDuplicates(["u", "v"])


def _audit(vecs: DataFrame, edges: DataFrame, threshold: float) -> float | None:
    """The least share of the true edges of a sample that are among the edges, by edges and by pairs of rows. Two samples, drawn by
    hash: of all vectors, and of those that have an edge. None: too few true edges among all the vectors that it may hold."""
    n = vecs.count()
    most = max(AUDIT_MOST, math.ceil(n * AUDIT_SHARE))
    hit = edges.select("u", "v", F.lit(1).alias("hit"))

    def recall(some: list) -> tuple[int, float]:
        row = _true(vecs, some, threshold).join(hit, ["u", "v"], "left").agg(F.count("*"), F.count("hit"), F.sum("pairs"), F.sum(F.expr("pairs * hit"))).first()
        return row[0], min(row[1] / row[0], (row[3] or 0) / row[2]) if row[0] else 1.0

    size = max(AUDIT, math.ceil(n * AUDIT_SHARE))
    while True:
        some = vecs.orderBy(sample_key("id"), "id").limit(size).collect()
        if not some:
            return 1.0
        true, share = recall(some)
        if share < RECALL or len(some) == n:
            return share
        if true >= ENOUGH:
            break
        if size >= most:
            return None
        size = min(4 * size, most)
    ends = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    some = vecs.join(ends, "id", "left_semi").orderBy(sample_key("id"), "id").limit(size).collect()
    return min(share, recall(some)[1]) if some else share


def near_edges(rows: DataFrame, threshold: float = THRESHOLD, neighbours: int = NEIGHBOURS) -> tuple[DataFrame, DataFrame]:
    """From usable vectors (id, v): the distinct ones (id: the least of its rows, v, copies), and the edges (u < v, s) between those
    with a cosine of ``threshold`` or more."""
    vecs = written(rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", "v", "copies"), "distinct")
    n = vecs.count()
    k, graph, attempt = neighbours, None, 0
    old, new = F.lit(False).alias("fresh"), F.lit(True).alias("fresh")
    while True:
        start = _grouped(vecs, n, 11 + attempt, k).select("u", "v", "s", new)
        graph = written(_top(start if graph is None else graph.select("u", "v", "s", old).union(start), k), "graph")
        for _ in range(ROUNDS):
            graph = written(_top(graph.select("u", "v", "s", old).union(_descend(graph, vecs, k).select("u", "v", "s", new)), k), "graph")
            passing, came = graph.where(F.col("s") >= threshold).agg(F.count("*"), F.count_if("fresh")).first()
            if came <= STILL * passing:
                break
        over = graph.where(F.col("s") >= threshold)
        edges = over.selectExpr("least(u, v) as u", "greatest(u, v) as v", "s")
        full = over.groupBy("u").count().where(F.col("count") >= k).select("u")
        roots = components(edges, "u", "v")
        saturated = roots.join(full, F.col("node") == F.col("u"), "left_semi").select("root").distinct()
        extra = _within(roots.join(saturated, "root"), vecs, threshold)
        found = written(edges.union(extra).groupBy("u", "v").agg(F.max("s").alias("s")), "edges")
        attempt += 1
        share = _audit(vecs, found, threshold)
        if share is None or attempt >= ATTEMPTS and share < RECALL:
            every = vecs.select(F.lit(0).cast("long").alias("root"), F.col("id").alias("node"))
            return vecs, written(_within(every, vecs.select("id", "v"), threshold), "edges")
        if share >= RECALL:
            return vecs, found
        k *= 2


def near_duplicates(table: DataFrame, key: str = "vec_id", column: str = "embedding", threshold: float = THRESHOLD, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(vec_id, class_id, links) for each row with a usable vector (see ``vectors``): the least key of its class, the connected component of
    pairs with a cosine of ``threshold`` or more, and with how many other rows it is such a pair.

    Equal vectors are pairs like any other, counted without being expanded. Of rows that repeat a key the greatest vector stands for all.
    Without a partner the class is the row itself, with 0 links. An empty table gives no rows. Other columns aren't read.
    """
    rows = written(vectors(table, key, column), "vectors")
    vecs, edges = near_edges(rows, threshold, neighbours)
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("other")), F.struct(F.col("v").alias("id"), F.col("u").alias("other")))).alias("e")).select("e.*")
    links = ends.join(vecs.select(F.col("id").alias("other"), "copies"), "other").groupBy("id").agg(F.sum("copies").alias("apart"))
    roots = components(edges, "u", "v").select(F.col("node").alias("id"), "root")
    judged = vecs.join(links, "id", "left").join(roots, "id", "left")
    equal = F.col("copies") - 1 if threshold <= 1 else F.lit(0)
    judged = judged.select("v", F.coalesce("root", "id").alias("class_id"), (equal + F.coalesce("apart", F.lit(0))).alias("links"))
    return rows.join(judged, "v").select(F.col("id").alias("vec_id"), "class_id", "links")
