"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import glob
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_U = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach, from ``spark.checkpoint.dir``.

    Where the setting is absent (tests, a laptop) a temporary folder is made, which is right for a
    local master only; on a cluster without the setting an error is raised.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="codeloom-")
    spark.conf.set("spark.checkpoint.dir", found)
    spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    The files survive the loss of any executor. They are deleted when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codeloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch at most. Its bytes are bounded by the session's spark.sql.execution.arrow.maxBytesPerBatch (64 MB by default), but
#: for a single text that is longer.
ARROW_ROWS = 1500

_HELD: dict = {}


def one_thread() -> None:
    """Keep numpy's matrix library to the one core that a task has: its threads wait for each other by spinning, which doubles the CPU
    time of small products and hardly shortens them. Another library than the one that numpy ships keeps its ways."""
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__) + ".libs", "*openblas*")):
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            try:
                getattr(ctypes.CDLL(path), name)(1)
                break
            except (OSError, AttributeError):
                continue


def trim() -> None:
    """Give freed memory back to the system: a Python worker shares its executor's memory with the JVM. Also ``one_thread``, once."""
    if "libc" not in _LEAN:
        one_thread()
        _LEAN["libc"] = None
        try:
            libc = ctypes.CDLL("libc.so.6")
            libc.mallopt(-3, 1 << 18)  # arrays from 256 KB on are mapped, hence gone when freed
            libc.mallopt(-1, 1 << 20)
            _LEAN["libc"] = libc
        except (OSError, AttributeError):  # another C library: it keeps its ways
            pass
        pa.set_memory_pool(pa.system_memory_pool())
    if _LEAN["libc"] is not None:
        _LEAN["libc"].malloc_trim(0)


_LEAN: dict = {}


def worker_cache(name: str, make):
    """What a Python worker keeps between tasks. One such thing at a time: workers are shared by all stages."""
    if name not in _HELD:
        _HELD.clear()
        trim()
        _HELD[name] = make()
    return _HELD[name]


def texts_of(df: DataFrame, *columns) -> DataFrame:
    """A projection that goes to Python in small Arrow batches. The setting is the session's, read when the plan runs: it is lowered to
    ARROW_ROWS, and stays as it is if it is lower."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= ARROW_ROWS:
        df.sparkSession.conf.set(name, str(ARROW_ROWS))
    return df.select(*columns) if columns else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(texts: list, limit: int = 1_500_000):
    """(start, stop) runs of a batch with at most about ``limit`` characters each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= limit:
            yield start, i + 1
            trim()
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
        trim()


def column_slices(column: pa.Array, limit: int):
    """(start, stop) runs of a string column with at most about ``limit`` bytes each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(size):
        stop = int(np.searchsorted(size, (size[start - 1] if start else 0) + limit)) + 1
        yield start, min(stop, len(size))
        start = stop
        trim()


def uniq(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; for integers several times as fast as ``np.unique``."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, the same on every machine. Block by block, so that what lies between the steps stays in the cache."""
    out = np.array(x, _U, order="C")
    flat = out.reshape(-1)
    room = np.empty(min(len(flat), 8192), _U)
    with np.errstate(over="ignore"):
        for lo in range(0, len(flat), 8192):
            v = flat[lo : lo + 8192]
            t = room[: len(v)]
            v ^= np.right_shift(v, _U(33), out=t)
            v *= _U(0xFF51AFD7ED558CCD)
            v ^= np.right_shift(v, _U(33), out=t)
            v *= _U(0xC4CEB9FE1A85EC53)
            v ^= np.right_shift(v, _U(33), out=t)
    return out


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType, mask: np.ndarray | None = None) -> pa.Array:
    """An Arrow list column from flat values and n + 1 offsets; mask: True where the list is null."""
    out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
    if mask is None or not mask.any():
        return out
    keep = pa.array(np.arange(len(mask)), mask=mask)
    return out.take(keep)


def sample_key(column: str):
    """Order by this to draw the same bounded sample on every run and from any partitioning."""
    return F.xxhash64(F.col(column))


def union(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the groups of the rows i and j, pair by pair, in place; ``label``: each row's least companion."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != (up := label[label])).any():
            label[:] = up


#: Edges up to this number are joined in one task (some 200 MB of a worker); more by rounds over all executors.
EDGES_IN_TASK = 2_000_000


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    e = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
    if e:
        e = np.concatenate(e, 1)
        nodes = uniq(e.ravel())
        label = np.arange(len(nodes))
        union(label, *np.searchsorted(nodes, e))
        for lo in range(0, len(nodes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[lo : lo + 100_000]), pa.array(nodes[label[lo : lo + 100_000]])], ["node", "root"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list of longs -> (node, root); root is the least node.

    Up to EDGES_IN_TASK are joined in one task; more by alternating large-star and small-star rounds (logarithmic in practice), each
    written to the shared folder so that neither lineage nor executor loss can undo it. No edges give no rows; repeated
    edges, self loops and null ends are ignored.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    e = e.where("u is not null and v is not null and u <> v").selectExpr("greatest(u, v) as u", "least(u, v) as v").distinct()
    e = written(e, "edges")
    if e.count() <= EDGES_IN_TASK:
        return written(e.coalesce(1).mapInArrow(_roots, "node bigint, root bigint"), "roots")
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) as m")
        large = both.join(m, "u").where("v > u").selectExpr("v as u", "m as v").distinct()
        m2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m2, "u").where("v <> m").selectExpr("v as u", "m as v").union(m2.selectExpr("u", "m as v"))
        new = written(small.where("u <> v").selectExpr("greatest(u, v) as u", "least(u, v) as v").distinct(), "edges")
        was, now = (x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (e, new))
        e = new
        if tuple(was) == tuple(now):
            break
    return e.selectExpr("u as node", "v as root").union(e.selectExpr("v as node", "v as root").distinct())


#: Ids up to this number are sent to every executor (about 30 MB there); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def without_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id", id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose key is among ``ids``; rows with a null key stay. Columns as they were."""
    gone = ids.select(F.col(id_col).cast("long").alias("__gone")).where("__gone is not null").distinct()
    gone = written(gone, "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[key].cast("long") == gone["__gone"], "left_anti")
