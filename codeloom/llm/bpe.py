"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The merges of a batch run over ONE linked list that holds the bytes of all its distinct pre-tokens.
Each merge rank has a bucket of list positions; a three-level bitmap of 64-bit words says which
buckets hold something, so the next rank is three find-first-set steps away. A bucket is taken as a
whole: stale positions (whose pair has changed since) are skipped, overlapping ones are taken from
the left, and the rest merge in one vectorised step. The cost of a pre-token is therefore linear in
its length but for the sorting of buckets, which is what very long pre-tokens need.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_slices, list_array, mix64, texts_of, uniq, worker_cache

#: Rank file (base64 of the token, space, rank). A parameter of every function here.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How this vocabulary splits text before the merges.
SPLIT = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int32(1 << 30)
NONE_ = int(NONE)
#: Buckets of at most so many positions are merged one by one.
FEW = 256
#: Entries of the chunk memo of a Python worker, and of its memo of pieces; beyond them it is emptied, which costs time only.
MEMO = 800_000
#: Bytes of a string that is numbered in numpy, at most: they and the length, as the last byte, fill four words.
SHORT = 31
#: Bytes of text whose chunks are numbered at once, and bytes of new chunks that are merged at once.
SLICE = 1_500_000


def read_ranks(path: str = TOKENIZER) -> list[bytes]:
    """Tokens in the order of their ids; ids must be 0..n-1."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out: list[bytes | None] = [None] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    if any(t is None for t in out):
        raise ValueError(f"{path}: ranks aren't 0..{len(pairs) - 1}")
    return out  # type: ignore[return-value]


class RankQueue:
    """Buckets by rank under a bitmap of 64-bit words in as many levels as the ranks need."""

    def __init__(self, n: int):
        #: Positions of a rank: arrays of them, and single ones as integers.
        self.buckets: dict[int, list] = {}
        self.levels = [[0] * (n // 64 + 1)]
        while len(self.levels[-1]) > 1:
            self.levels.append([0] * ((len(self.levels[-1]) - 1) // 64 + 1))

    def push(self, rank: int, positions: np.ndarray | int) -> None:
        held = self.buckets.get(rank)
        if held is not None:
            held.append(positions)
            return
        self.buckets[rank] = [positions]
        for level in self.levels:
            level[rank >> 6] |= 1 << (rank & 63)
            rank >>= 6

    def pop(self) -> tuple[int, list] | None:
        """The bucket of the least rank, by find-first-set from the top level down."""
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            if not word:
                return None
            at = (at << 6) | ((word & -word).bit_length() - 1)
        up = at
        for level in self.levels:
            level[up >> 6] &= ~(1 << (up & 63))
            if level[up >> 6]:
                break
            up >>= 6
        return at, self.buckets.pop(at)


class Grown:
    """An array that grows at its end; ``a`` has room for more than the ``n`` values that count."""

    def __init__(self, kind, width: tuple = ()):
        self.a, self.n = np.empty((1024, *width), kind), 0

    def add(self, x: np.ndarray) -> None:
        need = self.n + len(x)
        if need > len(self.a):
            a = np.empty((max(need, len(self.a) * 3 // 2), *self.a.shape[1:]), self.a.dtype)
            a[: self.n] = self.a[: self.n]
            self.a = a
        self.a[self.n : need] = x
        self.n = need


def _ends(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, from its first string on, and n + 1 ends."""
    _, at, data = strings.buffers()
    ends = np.frombuffer(at, np.int32)[strings.offset :][: len(strings) + 1] if len(strings) else np.zeros(1, np.int32)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, ends - ends[0]


class Numbers:
    """Numbers different strings in the order in which they come, many at a time.

    A string of up to SHORT bytes makes four words, filled up with zeros, the length in the last byte: the same words are
    the same string. They stand in an open-addressing table by their hash, and are compared. Longer strings, which are
    few, stand in a dict.
    """

    _FILL = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    _MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)
    _LONG = np.uint64(255 << 56)

    def __init__(self):
        self.words, self.long = Grown(np.uint64, (4,)), {}
        self.table = np.full(1 << 12, -1, np.int32)

    def __len__(self) -> int:
        return self.words.n

    def _at(self, w: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = w[:, 0] * self._MIX[0]
            for k in (1, 2, 3):
                h += w[:, k] * self._MIX[k]
        return (mix64(h) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _place(self, number: np.ndarray, at: np.ndarray) -> None:
        """Into the next free slot from ``at`` on; of several for a slot the last one gets it."""
        while len(number):
            free = self.table[at] < 0
            self.table[at[free]] = number[free]
            left = self.table[at] != number
            number, at = number[left], at[left] + 1 & len(self.table) - 1

    def _rebuild(self) -> None:
        words = self.words.a[: len(self)]
        number = np.flatnonzero(words[:, 3] != self._LONG).astype(np.int32)
        self.table = np.full(len(self.table), -1, np.int32)
        self._place(number, self._at(words[number]))

    def of(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of each string, and where those stand that are new, in the order of their numbers. No string may come twice."""
        raw, ends = _ends(strings)
        size = np.diff(ends)
        out = np.full(len(size), -1, np.int32)
        short = np.flatnonzero(size <= SHORT)
        raw = np.append(raw, np.zeros(32, np.uint8))
        eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))  # the eight bytes from each byte on
        start, n = ends[:-1][short], size[short]
        w = np.empty((len(short), 4), np.uint64)
        for k in range(4):
            w[:, k] = eight[start + 8 * k] & self._FILL[np.clip(n - 8 * k, 0, 8)]
        w[:, 3] |= n.astype(np.uint64) << np.uint64(56)
        at = self._at(w)
        left = np.arange(len(short))
        while len(left):
            found = self.table[at[left]]
            left, found = left[found >= 0], found[found >= 0]
            there, want = self.words.a[found], w[left]
            same = (there[:, 0] == want[:, 0]) & (there[:, 1] == want[:, 1]) & (there[:, 2] == want[:, 2]) & (there[:, 3] == want[:, 3])
            out[short[left[same]]] = found[same]
            left = left[~same]
            at[left] = at[left] + 1 & len(self.table) - 1
        new = np.flatnonzero(out[short] < 0)
        number = np.arange(len(self), len(self) + len(new), dtype=np.int32)
        out[short[new]] = number
        self.words.add(w[new])
        if 3 * len(self) > len(self.table):
            self.table = np.empty(1 << (4 * len(self)).bit_length(), np.int32)
            self._rebuild()
        else:
            self._place(number, at[new])
        fresh = [short[new]]
        for i in np.flatnonzero(size > SHORT).tolist():
            name = raw[ends[i] : ends[i + 1]].tobytes()
            if name not in self.long:
                self.long[name] = len(self)
                self.words.add(np.array([[0, 0, 0, self._LONG]], np.uint64))
                fresh.append([i])
            out[i] = self.long[name]
        return out, np.concatenate(fresh).astype(np.int64)

    def keep(self, numbers: np.ndarray) -> None:
        """Only these, which are sorted, numbered anew in their order."""
        now = dict(zip(numbers.tolist(), range(len(numbers)))) if self.long else {}
        self.long = {s: now[i] for s, i in self.long.items() if i in now}
        self.words.a, self.words.n = self.words.a[numbers], len(numbers)
        self._rebuild()


class Bpe:
    """A vocabulary with its merge table; ``encode`` and ``decode`` work on whole batches."""

    def __init__(self, tokens: list[bytes], split: str = SPLIT):
        self.tokens = tokens
        ids = {t: i for i, t in enumerate(tokens)}
        self.byte_id = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        keys, vals = [], []
        for t, r in ids.items():
            for k in range(1, len(t)):
                a, b = ids.get(t[:k]), ids.get(t[k:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    vals.append(r)
        k, v = np.array(keys, np.int64), np.array(vals, np.int32)
        # merges by pair in an open-addressing table of 8 slots for each; a row of empty slots follows the last
        self.bits = max(8, (8 * len(k)).bit_length())
        self.table = np.full((1 << self.bits) + 64, -1, np.int64)
        self.merged = np.full(len(self.table), NONE, np.int32)
        at, left = self._slot(k), np.arange(len(k))
        while len(left):
            free = self.table[at[left]] == -1
            self.table[at[left[free]]] = k[left[free]]  # of several keys for a slot the last one stays
            there = self.table[at[left]] == k[left]
            self.merged[at[left[there]]] = v[left[there]]
            left = left[~there]
            at[left] += 1
        self.pairs = dict(zip(keys, vals))
        part = np.stack([k >> 20, k & (1 << 20) - 1])
        # ranks of tokens that stand in a pair of no greater rank: such a pair may appear when they are merged
        self.risky = np.zeros(len(tokens), bool)
        self.risky[part[part >= v]] = True
        pair = np.arange(1 << 16)
        self.bytes = self._rank(self.byte_id[pair >> 8], self.byte_id[pair & 255])
        self.split = regex.compile(split)
        self._forget()
        self._forget_pieces()
        self.binary = pa.array(tokens, pa.binary())

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE if they don't merge."""
        key = a.astype(np.int64) << 20 | b
        at = self._slot(key)
        found = self.table[at]
        out = self.merged[at]
        other = np.flatnonzero(found != key)
        out[other] = NONE
        other = other[found[other] >= 0]
        while len(other):
            at[other] += 1
            found = self.table[at[other]]
            hit = found == key[other]
            out[other[hit]] = self.merged[at[other[hit]]]
            other = other[~hit & (found >= 0)]
        return out

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and how many each has; no merge crosses a piece's end."""
        return self.merge_raw(np.frombuffer(b"".join(pieces), np.uint8), np.fromiter(map(len, pieces), np.int64, len(pieces)))

    def merge_raw(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of the bytes of all pieces in a row and the length of each."""
        n = int(size.sum())
        if not n:
            return np.empty(0, np.int32), np.zeros(len(size), np.int64)
        # tok[n] stands for the end; nxt and prv of a piece's ends point there
        tok = np.append(self.byte_id[raw], -1).astype(np.int32)
        owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
        nxt, prv = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        ends = np.cumsum(size)[size > 0] - 1
        starts = ends - size[size > 0] + 1
        nxt[ends], prv[starts] = n, n
        alive = np.ones(n + 1, bool)
        alive[n] = False
        rank = np.full(n + 1, NONE, np.int32)
        inner = np.flatnonzero(nxt[:n] != n).astype(np.int32)
        rank[inner] = self.bytes[raw[inner].astype(np.int32) << 8 | raw[inner + 1]]
        queue = RankQueue(len(self.tokens))

        def push(at: np.ndarray) -> None:
            r = rank[at]
            good = r < NONE
            at, r = at[good], r[good]
            if not len(at):
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cut = np.flatnonzero(r[1:] != r[:-1]) + 1
            lo = 0
            for hi, x in zip([*cut.tolist(), len(r)], r[np.append(0, cut)].tolist()):
                queue.push(x, at[lo:hi])
                lo = hi

        tokv, nxtv, prvv, rankv, alivev = (memoryview(x) for x in (tok, nxt, prv, rank, alive))
        pairs, push1 = self.pairs.get, queue.push

        def merge_few(r: int, at: list[int]) -> None:
            """A small bucket, from the left, without the fixed cost of array operations."""
            at.sort()
            for j, i in enumerate(at):
                if rankv[i] != r:  # stale
                    continue
                gone = nxtv[i]
                right = nxtv[gone]
                tokv[i], nxtv[i], alivev[gone], rankv[gone] = r, right, False, NONE_
                left, lower = prvv[i], False
                if left != n:
                    rankv[left] = x = pairs(tokv[left] << 20 | r, NONE_)
                    if x < NONE_:
                        push1(x, left)
                        lower = x < r
                if right != n:
                    prvv[right] = i
                    rankv[i] = x = pairs(r << 20 | tokv[right], NONE_)
                    if x < NONE_:
                        push1(x, i)
                        lower |= x < r
                else:
                    rankv[i] = NONE_
                if lower:  # those come before the rest of this bucket
                    for i in at[j + 1 :]:
                        push1(r, i)
                    return

        push(inner)
        while (got := queue.pop()) is not None:
            r, parts = got
            if len(parts) <= FEW and (few := _few(parts)) is not None:
                merge_few(r, few)
                continue
            at = _joined(parts)
            at = at[rank[at] == r]  # stale entries are skipped
            if not len(at):
                continue
            if len(at) > 1:
                if not (at[1:] > at[:-1]).all():
                    at = uniq(at)
                linked = np.append(False, nxt[at[:-1]] == at[1:])
                if linked.any():  # of a run of overlapping pairs every other one, from the left
                    i = np.arange(len(at))
                    at = at[(i - np.maximum.accumulate(np.where(linked, 0, i))) % 2 == 0]
            again = None
            gone = nxt[at]
            right = nxt[gone]
            while self.risky[r] and len(at) > 1:
                left = prv[at]
                new = np.full(len(at), r)
                # the left neighbour may itself be merged in this step: then its own token is new
                lt = tok[left]
                lt = np.where(_member(left, at, nxt, alive), r, lt)
                la = np.where(left == n, NONE, self._rank(np.where(left == n, 0, lt), new))
                rt = np.where(_starts(right, at), r, tok[right])
                ra = np.where(right == n, NONE, self._rank(new, np.where(right == n, 0, rt)))
                lower = (la <= r) | (ra <= r)
                if lower.any():  # only the leftmost merge of each piece is certain
                    once = np.append(True, owner[at[1:]] != owner[at[:-1]])
                    again, at = at[~once], at[once]
                    gone = nxt[at]
                    right = nxt[gone]
                break
            tok[at] = r
            alive[gone] = False
            rank[gone] = NONE
            nxt[at] = right
            prv[right] = np.where(right == n, prv[right], at)
            left = prv[at]
            inner_l = left[left != n]
            rank[inner_l] = self._rank(tok[inner_l], tok[nxt[inner_l]])
            has = at[nxt[at] != n]
            rank[at] = NONE
            rank[has] = self._rank(tok[has], tok[nxt[has]])
            if again is not None and len(again):
                queue.push(r, again)
            push(np.concatenate([inner_l, has]) if len(inner_l) else has)
        live = np.flatnonzero(alive[:n])
        return tok[live], np.bincount(owner[live], minlength=len(size))

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces in a row, with repeats, and n + 1 ends. Only pieces that the memo has not are merged, each once; long ones,
        which hardly come again, don't stay there."""
        if len(self.pieces) > MEMO:
            self._forget_pieces()
        coded = pa.array(pieces, pa.string()).dictionary_encode()
        short = np.diff(_ends(coded.dictionary)[1]) <= SHORT
        known, fresh = self.pieces.of(coded.dictionary.filter(pa.array(short)))
        number = np.empty(len(short), np.int32)
        number[short] = known
        number[~short] = np.arange(len(self.pieces), len(self.pieces) + len(short) - len(known))
        new = np.append(np.flatnonzero(short)[fresh], np.flatnonzero(~short))
        raw, ends = _ends(coded.dictionary.take(pa.array(new)))
        ids, many = self.merge_raw(raw, np.diff(ends).astype(np.int64))
        self.piece_start.add(np.cumsum(many) - many + self.piece_ids.n)
        self.piece_size.add(many)
        self.piece_ids.add(ids)
        at = number[coded.indices.to_numpy(zero_copy_only=False)]
        size, start = self.piece_size.a[at], self.piece_start.a[at]
        ends = np.append(0, np.cumsum(size, dtype=np.int64))
        out = self.piece_ids.a[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
        self.piece_start.n = self.piece_size.n = len(self.pieces)
        self.piece_ids.n -= int(many[len(fresh) :].sum())
        return out, ends

    def _forget_pieces(self) -> None:
        self.pieces = Numbers()
        self.piece_size, self.piece_start, self.piece_ids = (Grown(np.int32) for _ in range(3))

    def _learn(self) -> None:
        """Ids of the chunks that the memo has numbered since it last learned.

        A chunk is what stands between two single spaces (the first one, which no space precedes, is kept
        under a leading space). Where it neither starts nor ends with white space, the split pattern treats
        it, with the space before it, apart from its surroundings, so its ids never depend on the text
        around it. Any other chunk is marked: its text takes the slow way.
        """
        new, self.new = pa.chunked_array(self.new, pa.string()).to_pylist(), []
        head = [c[:1] == " " for c in new]
        slow = [c != " " and c[-1].isspace() if h else not c or c.strip() != c for c, h in zip(new, head)]
        body = [i for i, (h, bad) in enumerate(zip(head, slow)) if not h and not bad]
        heads = [i for i, (h, bad) in enumerate(zip(head, slow)) if h and not bad]
        # all chunks are split at once: where one ends, so does a piece
        pieces = self.split.findall("".join([" " + new[i] for i in body]))
        stop = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        last = np.cumsum(np.fromiter((len(new[i]) + 1 for i in body), np.int64, len(body)))
        cut = np.searchsorted(stop, last) + 1
        if len(body) and not (cut <= len(stop)).all() or (stop[cut - 1] != last).any():
            raise ValueError("the split pattern looks beyond single spaces")
        cut = cut.tolist()
        for i in heads:
            pieces += self.split.findall(new[i][1:])
            cut.append(len(pieces))
        ids, ends = self._ids(pieces)
        stop = ends[np.array([0, *cut], np.int64)]
        size, start = np.zeros(len(new), np.int32), np.zeros(len(new), np.int32)
        at = np.array(body + heads, np.int64)
        size[at], start[at] = np.diff(stop), stop[:-1] + self.flat.n
        self.size.add(size)
        self.start.add(start)
        self.flat.add(ids)
        self.slow.add(np.array(slow, bool))

    def _forget(self) -> None:
        #: Numbers the chunks in the order in which they come; ``new`` has those without ids as yet.
        self.memo = Numbers()
        self.new: list[pa.Array] = []
        self.size, self.start, self.uses, self.flat = (Grown(np.int32) for _ in range(4))
        self.slow = Grown(bool)

    def _trim(self) -> None:
        """Keep the chunks that came more than once; all go if these are more than half."""
        keep = np.flatnonzero(self.uses.a[: self.uses.n] > 1)
        if len(keep) > MEMO // 2:
            return self._forget()
        size, start, uses, flat, slow = (x.a for x in (self.size, self.start, self.uses, self.flat, self.slow))
        memo = self.memo
        memo.keep(keep)
        self._forget()
        self.memo = memo
        size = size[keep]
        ends = np.cumsum(size, dtype=np.int32)
        self.flat.add(flat[np.repeat(start[keep] - ends + size, size) + np.arange(size.sum())])
        self.size.add(size)
        self.start.add(ends - size)
        self.slow.add(slow[keep])
        self.uses.add(uses[keep] // 2)

    def _numbered(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The memo's numbers of all chunks of all texts, and n + 1 ends. Arrow splits, and numbers what differs; the memo is asked for that
        only, and Python meets what is new."""
        lists = pc.split_pattern(column, " ")
        ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False)
        first = ends[:-1][np.diff(ends) > 0]  # no space stands before these
        heads = pc.binary_join_element_wise("", coded.take(pa.array(first)).dictionary_decode().cast(pa.string()), " ").dictionary_encode()
        rest = np.ones(len(at), bool)
        rest[first] = False
        uses = np.bincount(at[rest], minlength=len(coded.dictionary))
        used = uses > 0
        strings = pa.concat_arrays([x.cast(pa.string()) for x in (coded.dictionary.filter(pa.array(used)), heads.dictionary)])
        got, fresh = self.memo.of(strings)
        self.new.append(strings.take(pa.array(fresh)))
        number = np.zeros(len(used), np.int32)
        body, head = got[: len(got) - len(heads.dictionary)], got[len(got) - len(heads.dictionary) :]
        number[used] = body
        idx = number[at]
        of_heads = heads.indices.to_numpy(zero_copy_only=False)
        idx[first] = head[of_heads]
        self.uses.add(np.zeros(len(fresh), np.int32))
        self.uses.a[body] += uses[used].astype(np.int32)
        self.uses.a[head] += np.bincount(of_heads, minlength=len(head)).astype(np.int32)
        return idx, ends

    def slices(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, stop, flat ids, offsets) of runs of texts with at most about SLICE bytes each. New chunks wait until they have SLICE bytes,
        or the texts SLICE chunks, or until the column ends: then they are merged at once."""
        held, chunks = [], 0
        for lo, hi in column_slices(column, SLICE):
            if not held and len(self.memo) > MEMO:
                self._trim()
            held.append((lo, hi, *self._numbered(column.slice(lo, hi - lo))))
            chunks += len(held[-1][2])
            if hi < len(column) and chunks < SLICE and sum(x.nbytes for x in self.new) < SLICE:
                continue
            self._learn()
            for lo, hi, idx, ends in held:
                yield lo, hi, *self._encoded(column, lo, idx, ends)
            held, chunks = [], 0

    def _encoded(self, column: pa.Array, lo: int, idx: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size.a[idx]
        total = np.cumsum(size, dtype=np.int32)  # a slice has fewer bytes than 2**31, hence fewer ids
        # a chunk's ids lie in a row: from its start on, each is one step beyond the one before
        ids = self.flat.a[np.repeat(self.start.a[idx] - total + size, size) + np.arange(total[-1], dtype=np.int32)] if len(idx) else np.empty(0, np.int32)
        n = np.diff(np.append(np.int32(0), total)[ends])
        slow = np.unique(np.searchsorted(ends, np.flatnonzero(self.slow.a[idx]), "right") - 1)
        if len(slow):
            ids, n = self._slow(column, lo, slow, ids, n)
        offsets = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=offsets[1:])
        return ids, offsets

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and n + 1 offsets; a null text has no ids."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        out, offsets = [np.empty(0, np.int32)], np.zeros(len(column) + 1, np.int64)
        for lo, hi, ids, at in self.slices(column):
            out.append(ids)
            offsets[lo + 1 : hi + 1] = offsets[lo] + at[1:]
        return np.concatenate(out), offsets

    def _slow(self, column: pa.Array, lo: int, slow: np.ndarray, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts with a chunk that its surroundings split otherwise, split as wholes."""
        pieces: list[str] = []
        cut = [0]
        for i in slow.tolist():
            pieces += self.split.findall(column[lo + i].as_py())
            cut.append(len(pieces))
        new, ends = self._ids(pieces)
        stop = ends[cut]
        old = np.append(0, np.cumsum(n))
        parts, at = [], 0
        for k, i in enumerate(slow.tolist()):
            parts += [ids[at : old[i]], new[stop[k] : stop[k + 1]]]
            at = old[i + 1]
        n = n.copy()
        n[slow] = np.diff(stop)
        return np.concatenate([*parts, ids[at:]]), n

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The bytes of each list of ids, as an Arrow binary column."""
        flat = self.binary.take(pa.array(ids, pa.int32()))
        at = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset :][: len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(at[offsets].astype(np.int32)), flat.buffers()[2]])


def _few(parts: list) -> list[int] | None:
    """The positions of a bucket, None if they are more than FEW."""
    out: list[int] = []
    for x in parts:
        if isinstance(x, int):
            out.append(x)
        elif len(x) + len(out) > FEW:
            return None
        else:
            out += x.tolist()
    return out


def _joined(parts: list) -> np.ndarray:
    if len(parts) == 1 and not isinstance(parts[0], int):
        return parts[0]
    ones = np.array([x for x in parts if isinstance(x, int)], np.int32)
    return np.concatenate([*(x for x in parts if not isinstance(x, int)), ones])


def _member(left: np.ndarray, at: np.ndarray, nxt: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Where ``left`` is the second half of another pair that merges in this step."""
    gone = nxt[at]
    i = np.minimum(np.searchsorted(gone, left), len(gone) - 1)
    return gone[i] == left


def _starts(right: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where ``right`` is the first half of another pair that merges in this step."""
    i = np.minimum(np.searchsorted(at, right), len(at) - 1)
    return at[i] == right


def loaded(held) -> Bpe:
    """The vocabulary of a broadcast, built once in each Python worker."""
    return worker_cache(held.id, lambda: Bpe(held.value))


class Held:
    """Tokens for the executors: a broadcast (under 1 MB for the usual vocabularies, whatever the data)."""

    def __init__(self, spark, path: str):
        tokens = read_ranks(path)
        self.size = len(tokens)
        self.id = f"{path}:{self.size}"
        self._b = spark.sparkContext.broadcast(tokens)

    @property
    def value(self) -> list[bytes]:
        return self._b.value


ENCODED = "doc_id bigint, n_tokens int, ids array<int>, lossless boolean"


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens, ids, lossless) for each row of ``docs``; the ids are decoded again and compared.

    Null text: n_tokens, ids and lossless are null. Empty text: 0, an empty array, true. A null or repeated
    key stays as it is, one row out for each row in; other columns are not read. Texts of any length are
    encoded whole. An empty table gives no rows.
    """
    held = Held(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(held)
        for b in batches:
            column = b.column(1)
            for lo, hi, ids, offsets in bpe.slices(column):
                part = column.slice(lo, hi - lo)
                null = part.is_null().to_numpy(zero_copy_only=False)
                same = pc.equal(bpe.decode(ids, offsets), part.cast(pa.binary()))
                n = pa.array(np.diff(offsets).astype(np.int32), mask=null)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), n, list_array(ids, offsets, pa.int32(), null), same], ["doc_id", "n_tokens", "ids", "lossless"])

    return texts_of(docs, F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, ids: str = "ids", key: str = "doc_id", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, text) of each row's ids. Null ids give null text, none give an empty one; an id outside the
    vocabulary is an error; bytes that aren't UTF-8 (a cut sequence) become U+FFFD. A null id in a list is left out."""
    held = Held(encoded.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(held)
        for b in batches:
            col = b.column(1)
            flat = col.flatten().to_numpy(zero_copy_only=False)
            n = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
            raw = bpe.decode(flat.astype(np.int32), np.append(0, np.cumsum(n)).astype(np.int64)).to_pylist()
            null = col.is_null().to_pylist()
            text = pa.array([None if z else r.decode("utf-8", "replace") for r, z in zip(raw, null)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), text], ["doc_id", "text"])

    clean = F.filter(F.col(ids).cast("array<int>"), lambda x: x.isNotNull())
    return texts_of(encoded, F.col(key).cast("long"), clean.alias("ids")).mapInArrow(run, T.StructType.fromDDL("doc_id bigint, text string"))
