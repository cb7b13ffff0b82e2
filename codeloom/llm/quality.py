"""Quality by compression bands: zstandard ratios of whole documents and of fixed chunks.

Text that repeats itself compresses far better than prose of its length, noise far worse. A document is kept
if its ratio (bytes over compressed bytes) lies in the band for its length, and nearly all of its chunks lie in theirs: all of a short
one, four fifths of a longer one, and never more than BAD_BYTES of bad text, however long the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

#: (bytes up to, least ratio, greatest ratio). Prose gains with its length: about 1.6 at 400 bytes, 2 at 2 KB, 2.5 at
#: 32 KB; random letters stay under 1.4, repeats pass 4 soon.
BANDS = ((64, 0.0, 3.0), (128, 0.6, 2.4), (256, 0.9, 2.6), (512, 1.1, 2.8), (2048, 1.25, 3.0), (8192, 1.4, 3.4), (32768, 1.5, 4.0), (1 << 62, 1.5, 4.6))
CHUNK = 2048
CHUNK_BAND = (1.2, 3.2)
#: Share of a document's chunks that may lie outside their band, and bytes in such chunks at most.
CHUNK_SHARE, BAD_BYTES = 0.2, 16384
LEVEL = 3

JUDGED = "doc_id bigint, n_bytes bigint, ratio double, chunks int, bad_chunks int, keep int, reason string"


def judge(texts: list[str | None], bands=BANDS, chunk: int = CHUNK, chunk_band=CHUNK_BAND, share: float = CHUNK_SHARE, bad_bytes: int = BAD_BYTES, level: int = LEVEL) -> list[tuple]:
    """(bytes, ratio, chunks, those outside the band, keep, reason) for each text. The last chunk is judged by the band of its own length."""
    squeeze = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False, write_dict_id=False).compress
    out = []
    for t in texts:
        if not t:
            out.append((None if t is None else 0, None, 0, 0, 0, "empty"))
            continue
        raw = t.encode("utf-8", "surrogatepass")
        n = len(raw)
        ratio = n / len(squeeze(raw))
        low, high = next((a, z) for most, a, z in bands if n <= most)
        chunks = bad = lost = 0
        if n > chunk:
            for i in range(0, n, chunk):
                size = min(chunk, n - i)
                a, z = chunk_band if size == chunk else next((a, z) for most, a, z in bands if size <= most)
                chunks += 1
                if not a <= size / len(squeeze(raw[i : i + size])) <= z:
                    bad, lost = bad + 1, lost + size
        why = "incompressible" if ratio < low else "repetitive" if ratio > high else "chunks" if bad > share * chunks or lost > bad_bytes else None
        out.append((n, ratio, chunks, bad, int(why is None), why))
    return out


def compression_bands(docs: DataFrame, text: str = "text", key: str = "doc_id", **limits) -> DataFrame:
    """(doc_id, n_bytes, ratio, chunks, bad_chunks, keep, reason) for each row; keep is 1 or 0, reason null where kept.

    Null and empty texts are rejected as "empty", with a null ratio. Texts are compressed whole, and in chunks if they are longer than one. Null and repeated keys stay as they are; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in JUDGED.split(",")][1:]
        kinds = [pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        for b in batches:
            rows = judge(b.column(1).to_pylist(), **limits)
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", *names])

    return texts_of(docs, F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, JUDGED)


def keep_good(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """``docs`` without the rejected rows, columns as they were."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(np.array([r[4] for r in judge(b.column(at).to_pylist(), **limits)], bool)))

    return texts_of(docs).mapInArrow(run, docs.schema)
