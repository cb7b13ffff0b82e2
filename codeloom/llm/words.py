"""Texts as arrays of word hashes, the common first step of the hashing operators."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import worker_cache

_WORD = re.compile(r"\w+")
_SIGNS = ".,;:!?%&$#*|-'\")]}"
#: Words of the memo of a Python worker; beyond them it is emptied, which costs time only.
MEMO = 300_000


def split(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What stands between white space in all texts of a string column, in a row, and n + 1 ends. Null: nothing."""
    lists = pc.utf8_split_whitespace(column)
    flat = lists.flatten()
    ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))).astype(np.int64)
    some = pc.greater(pc.binary_length(flat), 0)  # white space at either end of a text leaves an empty chunk
    if pc.all(some).as_py() is False:
        ends = np.append(0, np.cumsum(some.to_numpy(zero_copy_only=False)))[ends]
        flat = flat.filter(some)
    return flat, ends


class Words:
    """Splits at white space; a word is its letters and digits in lower case. Hash 0: no word at all."""

    def __init__(self):
        self._forget()

    def _forget(self) -> None:
        self.memo: defaultdict[str, int] = defaultdict(count().__next__)
        self.hash, self.stem = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.length, self.style = np.empty(0, np.int32), np.empty(0, np.int32)
        self.uses = np.empty(0, np.int64)

    def _trim(self) -> None:
        """Keep the chunks that came more than once; all go if these are more than half."""
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > MEMO // 2:
            return self._forget()
        names = list(self.memo)
        self.memo = defaultdict(count(len(keep)).__next__, zip([names[i] for i in keep.tolist()], range(len(keep))))
        self.hash, self.stem, self.length, self.style = self.hash[keep], self.stem[keep], self.length[keep], self.style[keep]
        self.uses = self.uses[keep] // 2

    def _learn(self, known: int) -> None:
        h, s, n, style = [], [], [], []
        for c in islice(self.memo, known, None):
            w = c.lower()
            if not w.isalnum():
                w = "".join(_WORD.findall(w))
            h.append(xxhash.xxh64_intdigest(w) or 1 if w else 0)
            s.append(xxhash.xxh64_intdigest("^" + w[:4]) or 1 if len(w) > 4 else 0)
            n.append(len(w))
            tail = c[len(c.rstrip(_SIGNS)) :]
            case = 0 if c == w else 1 if c.isupper() and len(w) > 1 else 2
            style.append(3 * (zlib.crc32(tail.encode()) % 80) + case)
        self.hash = np.append(self.hash, np.array(h, np.uint64))
        self.stem = np.append(self.stem, np.array(s, np.uint64))
        self.length = np.append(self.length, np.array(n, np.int32))
        #: Case, and the signs that the chunk ends with: one of 240.
        self.style = np.append(self.style, np.array(style, np.int32))

    def index(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts (into hash, stem, length) and n + 1 offsets. None: no words. Arrow splits, and numbers what differs;
        only that is met in Python."""
        if len(self.memo) > MEMO:
            self._trim()
        known = len(self.memo)
        flat, ends = split(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        coded = flat.dictionary_encode()
        number = np.fromiter(map(self.memo.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)), np.int32, len(coded.dictionary))
        self._learn(known)
        idx = number[coded.indices.to_numpy(zero_copy_only=False)]
        self.uses = np.append(self.uses, np.zeros(len(self.memo) - known, np.int64)) + np.bincount(idx, minlength=len(self.memo))
        return idx, ends


def words() -> Words:
    """One for each Python worker."""
    return worker_cache("words", Words)


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: What a byte becomes: small letters, digits, "_" and the first byte of U+00C0 to U+00FF stay; other ASCII goes (0).
_SMALL = np.array([ord(chr(b).lower()) if b < 128 and (chr(b).isalnum() or b == 95) else b if b >= 128 else 0 for b in range(256)], np.uint8)
#: And the byte after that first one; 0: no letter.
_SECOND = np.array([0 if not 0x80 <= b <= 0xBF or b in (0x97, 0xB7) else b + 0x20 if b < 0x9F else b for b in range(256)], np.uint8)


def _left(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint64(n) | x >> np.uint64(64 - n)


def _xxh64(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XXH64 of words of fewer than 32 bytes, which stand in a row in ``data``."""
    n = len(size)
    pad = np.zeros((n, 32), np.uint8)
    pad.ravel()[np.repeat(np.arange(n) * 32 - np.cumsum(size) + size, size) + np.arange(len(data))] = data
    eight, four = pad.view("<u8"), pad.view("<u4")
    with np.errstate(over="ignore"):
        h = size.astype(np.uint64) + _P5
        for k in range(3):
            at = np.flatnonzero(size >= 8 * k + 8)
            h[at] = _left(h[at] ^ _left(eight[at, k] * _P2, 31) * _P1, 27) * _P1 + _P4
        at = np.flatnonzero(size & 4)
        h[at] = _left(h[at] ^ four[at, size[at] >> 3 << 1].astype(np.uint64) * _P1, 23) * _P2 + _P3
        for k in range(3):
            at = np.flatnonzero(size & 3 > k)
            h[at] = _left(h[at] ^ pad[at, (size[at] & ~3) + k].astype(np.uint64) * _P5, 11) * _P1
        h = (h ^ h >> np.uint64(33)) * _P2
        h = (h ^ h >> np.uint64(29)) * _P3
        return h ^ h >> np.uint64(32)


def hashes(column: pa.Array) -> np.ndarray:
    """``Words.hash`` of each chunk of a string column without white space, all chunks of a batch at once. Those with letters beyond
    U+00FF, and long ones, go through the memo."""
    coded = column.dictionary_encode()
    names = coded.dictionary
    n = len(names)
    if not n:
        return np.empty(0, np.uint64)
    ends = np.frombuffer(names.buffers()[1], np.int32)[names.offset : names.offset + n + 1].astype(np.int64)
    data = np.frombuffer(names.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    out = _SMALL[data]
    first = np.flatnonzero(data == 0xC3)
    bad = data >= 0x80
    if len(first):
        out[first + 1] = _SECOND[data[first + 1]]
        bad[first], bad[first + 1] = False, out[first + 1] == 0
    kept = out != 0
    size = np.diff(np.append(0, np.cumsum(kept))[ends])
    rest = np.diff(np.append(0, np.cumsum(bad))[ends]) > 0
    rest |= size > 31
    fast = ~rest
    h = np.empty(n, np.uint64)
    h[fast] = _xxh64(out[kept & np.repeat(fast, np.diff(ends))], size[fast])
    h[h == 0] = 1
    h[fast & (size == 0)] = 0
    if rest.any():
        memo = words()
        number = memo.index(names.filter(pa.array(rest)))[0]
        h[rest] = memo.hash[number]
    return h[coded.indices.to_numpy(zero_copy_only=False)]
