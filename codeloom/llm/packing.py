"""Token ids as fixed-width bit-packed bytes with block offsets.

Every id takes ``width(vocabulary)`` bits, the least that hold the largest id. A text's ids lie in
blocks of ``BLOCK`` ids, each starting on a byte; ``block_offsets`` has where. A range of ids is read by
unpacking only the blocks it touches, all at once in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import TOKENIZER, Held, loaded
from .common import list_array, texts_of

#: Ids in a block; a multiple of 8, so that a full block ends on a byte whatever the width.
BLOCK = 1024
PACKED = "doc_id bigint, n_tokens int, bits int, block_ids int, block_offsets array<int>, payload binary"


def width(vocabulary: int) -> int:
    """Least bits for ids 0..vocabulary-1, 1 at least."""
    return max(1, (int(vocabulary) - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Big-endian bit packing; the last byte is filled with zeros. Ids beyond the width are an error."""
    ids = np.asarray(ids)
    if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >> bits):
        raise ValueError(f"an id does not fit into {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    wide = ids.astype(">u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(wide, axis=1)[:, 32 - bits :]).tobytes()


def unpack(payload: bytes, bits: int, n: int) -> np.ndarray:
    """The first n ids of a block's or a whole payload's bytes."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f">u{bits // 8}", n).astype(np.int32)
    flat = np.unpackbits(np.frombuffer(payload, np.uint8), count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - bits :] = flat
    return np.packbits(wide, axis=1).view(">u4").ravel().astype(np.int32)


def offsets_of(n: int, bits: int, block: int = BLOCK) -> np.ndarray:
    """Byte offset of each block, and of the end."""
    starts = np.arange(0, n, block) * bits // 8
    return np.append(starts, (n * bits + 7) // 8).astype(np.int32)


def read_range(payload: bytes, block_offsets, n_tokens: int, bits: int, start: int, stop: int, block: int = BLOCK) -> np.ndarray:
    """Ids start..stop-1 of one text, from the blocks that hold them only."""
    start, stop = max(0, start), min(n_tokens, stop)
    if start >= stop:
        return np.empty(0, np.int32)
    a, z = start // block, (stop - 1) // block
    raw = payload[block_offsets[a] : block_offsets[z + 1]]
    return unpack(raw, bits, min(n_tokens, (z + 1) * block) - a * block)[start - a * block : stop - a * block]


def _rows(key: pa.Array, ids: np.ndarray, offsets: np.ndarray, null: np.ndarray, bits: int, block: int) -> pa.RecordBatch:
    n = np.diff(offsets)
    if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >> bits):
        raise ValueError(f"an id does not fit into {bits} bits")
    if bits in (8, 16, 32):
        at = (offsets * (bits // 8)).astype(np.int32)
        payload = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at), pa.py_buffer(pack(ids, bits))])
    else:
        payload = pa.array([pack(ids[a:z], bits) for a, z in zip(offsets, offsets[1:])], pa.binary())
    blocks = (n + block - 1) // block + 1
    ends = np.append(0, np.cumsum(blocks))
    k = np.arange(ends[-1]) - np.repeat(ends[:-1], blocks)
    byte = (np.minimum(k * block, np.repeat(n, blocks)) * bits + 7) // 8
    if null.any():
        payload = payload.take(pa.array(np.arange(len(n)), mask=null))
    fixed = [pa.array(np.full(len(n), x, np.int32)) for x in (bits, block)]
    return pa.RecordBatch.from_arrays([key, pa.array(n.astype(np.int32), mask=null), *fixed, list_array(byte.astype(np.int32), ends, pa.int32(), null), payload], PACKED.replace(",", "").split()[::2])


def pack_ids(encoded: DataFrame, vocabulary: int, ids: str = "ids", key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens, bits, block_ids, block_offsets, payload) for each row with an array of ids.

    Null ids: n_tokens, block_offsets and payload are null. No ids: 0, [0] and no bytes (a list of offsets ends
    with the end). A null or negative id, or one beyond the vocabulary's width, is an error. Keys may be null or
    repeat; other columns are not read.
    """
    if block % 8 or block <= 0:
        raise ValueError("block must be a positive multiple of 8")
    bits = width(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(1)
            n = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
            flat = col.flatten()
            if flat.null_count:
                raise ValueError("a null id")
            yield _rows(b.column(0), flat.to_numpy(), np.append(0, np.cumsum(n)).astype(np.int64), np.array(col.is_null().to_pylist(), bool), bits, block)

    return texts_of(encoded, F.col(key).cast("long"), F.col(ids).cast("array<int>")).mapInArrow(run, PACKED)


def unpack_ids(packed: DataFrame) -> DataFrame:
    """(doc_id, ids) again, from the columns that ``pack_ids`` gives; a null payload gives null ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, n, bits, payload = (b.column(i) for i in range(4))
            out = [None if p is None else unpack(p, w, k) for k, w, p in zip(n.to_pylist(), bits.to_pylist(), payload.to_pylist())]
            yield pa.RecordBatch.from_arrays([key, pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return texts_of(packed, "doc_id", "n_tokens", "bits", "payload").mapInArrow(run, "doc_id bigint, ids array<int>")


def tokenize_and_pack(docs: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str = TOKENIZER, block: int = BLOCK) -> DataFrame:
    """Encode each text and pack its ids in one pass, so that no array of ids is ever a row.

    Null text: null n_tokens, block_offsets and payload; empty text: 0, [0], no bytes.
    """
    held = Held(docs.sparkSession, tokenizer)
    bits = width(held.size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(held)
        for b in batches:
            for lo, hi, ids, offsets in bpe.slices(b.column(1)):
                null = b.column(1).slice(lo, hi - lo).is_null().to_numpy(zero_copy_only=False)
                yield _rows(b.column(0).slice(lo, hi - lo), ids, offsets, null, bits, block)

    return texts_of(docs, F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, PACKED)


def write_packed(packed: DataFrame, path: str) -> None:
    """Store as Parquet without a second compression: packed ids hardly shrink."""
    packed.write.mode("overwrite").option("compression", "none").parquet(path)
