"""Language-model scoring with a causal self-attention model trained in numpy on subword ids.

The next id is predicted in two steps: its class by attention over the ids before it, itself within its class by how
often it occurs. Class and id counts, and counts of class after class, are taken over all documents; the attention
is trained by rounds of local descent: each partition trains on windows spread over all of its texts, and the
parameters are averaged by the number of targets, so training data grow with the input. For scoring a text is
covered by windows that overlap: each has CONTEXT - STRIDE ids of context, and scores the STRIDE ids after
them once. Windows are batched; a mask hides what comes later and what lies before the text.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import TOKENIZER, read_ranks
from .common import mix64, one_thread, written
from .packing import tokenize_and_pack, unpack

#: Ids that a window sees, and scores; numbers of the model; classes.
CONTEXT, STRIDE, WIDE, CLASSES = 40, 24, 16, 64
#: Each round trains on another share of all texts' windows (by a hash of text and place), a batch of windows at a
#: time; the rounds together on each window once.
SHARE, ROUNDS, BATCH, RATE = 1 / 2, 2, 192, 0.08
#: Bound of attention and class logits, and what sums of their exponentials have at least.
LIMIT, TINY = np.float32(60), np.float32(1e-30)
_F, _U = np.float32, np.uint64
_NAMES = ("E", "P", "Q", "K", "V", "O", "U", "b")


class Model:
    """Parameters, and the tables that follow from the corpus counts. Id n stands for the start of a text."""

    def __init__(self, counts: np.ndarray, after: np.ndarray | None = None, seed: int = 5):
        self.vocab = n = len(counts)
        # classes: the commonest ids alone, the others in runs of like frequency and equal mass
        order = np.argsort(-counts, kind="stable")
        mass = counts[order] + 0.5
        self.cls = np.empty(n + 1, np.int64)
        alone = min(CLASSES // 2, n)
        self.cls[order[:alone]] = np.arange(alone)
        rest = np.cumsum(mass[alone:])
        if len(rest):
            self.cls[order[alone:]] = alone + np.minimum((rest - mass[alone:]) / rest[-1] * (CLASSES - alone), CLASSES - alone - 1).astype(np.int64)
        self.cls[n] = CLASSES
        smooth = counts + 0.5
        total = np.bincount(self.cls[:n], smooth, CLASSES)
        self.inside = np.log(smooth / total[self.cls[:n]]).astype(_F)
        prior = (total + 1e-9) / (total.sum() + 1e-9 * CLASSES)
        self.pair = None if after is None else np.log((after + 8 * prior) / (after.sum(1, keepdims=True) + 8)).astype(_F)
        rng = np.random.default_rng(seed)
        d = WIDE
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(d)).astype(_F)
        self.p = {"E": 0.3 * draw(n + 1, d), "P": 0.3 * draw(CONTEXT, d), "Q": draw(d, d), "K": draw(d, d), "V": draw(d, d), "O": 0.3 * draw(d, d), "U": 0.3 * draw(d, CLASSES), "b": np.zeros(CLASSES, _F)}

    def _room(self, n: int) -> dict[str, np.ndarray]:
        """Arrays for n windows, kept from batch to batch: fresh ones would be mapped, and their pages zeroed, again and again."""
        kind, d = self.p["E"].dtype, WIDE
        held = _ROOM.get(kind)
        if held is None or len(held["h"]) < n:
            shapes = {k: (CONTEXT, d) for k in ("h", "dh", "more")} | {k: (STRIDE, d) for k in ("late", "q", "r", "z", "dz", "dr", "dq", "t")}
            shapes |= {k: (STRIDE, CONTEXT) for k in ("a", "da")} | {k: (STRIDE, CLASSES) for k in ("y", "u")}
            held = _ROOM[kind] = {k: np.empty((n, *v), kind) for k, v in shapes.items()}
        return {k: v[:n] for k, v in held.items()}

    def forward(self, x: np.ndarray, real: np.ndarray) -> dict[str, np.ndarray]:
        """x: (windows, CONTEXT) ids; real: which slots hold one. y: class logits for the last STRIDE slots. Logits are held under
        LIMIT, so that no maximum need be taken off before exp. a: attention before its division by w, its sums.

        Keys and values are not made: Q K' and V O are matrices of WIDE x WIDE, through which the inputs h meet each other. What is
        returned stays until the next call."""
        p, f = self.p, self._room(len(x))
        s, h, late, q, a, r, z, t, y, u = CONTEXT - STRIDE, *(f[k] for k in ("h", "late", "q", "a", "r", "z", "t", "y", "u"))
        np.take(p["E"], x, 0, out=h, mode="clip")
        h += p["P"]
        late[...] = h[:, s:]
        np.matmul(_flat(late), p["Q"] @ p["K"].T * _F(1 / np.sqrt(WIDE)), out=_flat(q))
        np.matmul(q, h.transpose(0, 2, 1), out=a)
        if a.size and not a.max() <= LIMIT:
            np.minimum(a, LIMIT, out=a)
        a += _CAUSAL
        part = np.flatnonzero(~real.all(1))
        if len(part):
            a[part] += np.where(real[part], _F(0), _F(-1e9))[:, None, :]
        np.exp(a, out=a)
        w = _flat(a) @ np.ones(CONTEXT, a.dtype)
        w += TINY
        np.matmul(a, h, out=r)
        r /= w.reshape(len(x), STRIDE, 1)
        np.matmul(_flat(r), p["V"] @ p["O"], out=_flat(z))
        z += late
        np.matmul(_flat(z), p["U"], out=_flat(y))
        np.take((self.pair + p["b"]).astype(y.dtype, copy=False), self.cls.take(x[:, s:]), 0, out=u, mode="clip")
        y += u
        if y.size and not y.max() <= LIMIT:
            np.minimum(y, LIMIT, out=y)
        return f | {"w": w, "part": part}

    def log_probs(self, x: np.ndarray, real: np.ndarray, target: np.ndarray) -> np.ndarray:
        y = _flat(self.forward(x, real)["y"])
        c = y.ravel().take(np.arange(0, y.size, CLASSES) + self.cls.take(target.ravel()))
        np.exp(y, out=y)
        return (c - np.log(y @ np.ones(CLASSES, y.dtype) + TINY)).reshape(target.shape) + self.inside.take(target)

    def gradients(self, x: np.ndarray, real: np.ndarray, target: np.ndarray, on: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean loss of the targets that are ``on``."""
        p, f = self.p, self.forward(x, real)
        h, late, q, a, r, z, w = (f[k] for k in ("h", "late", "q", "a", "r", "z", "w"))
        da, dh, more, dz, dr, dq, t = (f[k] for k in ("da", "dh", "more", "dz", "dr", "dq", "t"))
        y, scale = _flat(f["y"]), _F(1 / np.sqrt(WIDE))
        np.exp(y, out=y)
        share = on.ravel() / max(1, np.count_nonzero(on))
        y *= (share / (y @ np.ones(CLASSES, y.dtype) + TINY)).astype(y.dtype)[:, None]
        y.ravel()[np.arange(0, y.size, CLASSES) + self.cls.take(target.ravel())] -= share.astype(y.dtype)
        g = {"U": (y.T @ _flat(z)).T, "b": np.ones(len(y), y.dtype) @ y}
        np.matmul(y, p["U"].T, out=_flat(dz))
        # of V O and Q K', whose gradients are those of their factors times the other one
        vo, qk = p["V"] @ p["O"], p["Q"] @ p["K"].T * scale
        np.matmul(_flat(dz), vo.T, out=_flat(dr))
        dvo = _flat(r).T @ _flat(dz)
        g["V"], g["O"] = dvo @ p["O"].T, p["V"].T @ dvo
        # a stands for a / w: dr is divided instead
        dr /= w.reshape(len(x), STRIDE, 1)
        np.matmul(dr, h.transpose(0, 2, 1), out=da)
        da -= np.einsum("ijk,ijk->ij", dr, r)[..., None]  # the same as the sum of da * a
        da *= a
        np.matmul(da, h, out=dq)
        dqk = _flat(late).T @ _flat(dq) * scale
        g["Q"], g["K"] = dqk @ p["K"], dqk.T @ p["Q"]
        np.matmul(a.transpose(0, 2, 1), dr, out=dh)
        np.matmul(da.transpose(0, 2, 1), q, out=more)
        dh += more
        np.matmul(_flat(dq), qk.T, out=_flat(t))
        dz += t
        dh[:, CONTEXT - STRIDE :] += dz
        if len(f["part"]):
            dh[f["part"]] *= real[f["part"]][..., None]
        g["P"] = (np.ones(len(dh), dh.dtype) @ dh.reshape(len(dh), CONTEXT * WIDE)).reshape(dh.shape[1:])
        ids = x.ravel()
        # sixteen bits are sorted by radix
        order = np.argsort(ids.astype(np.uint16) if self.vocab < 1 << 16 else ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        size = np.diff(np.append(first, len(ids)))
        g["ids"], g["E"] = ids[first], _flat(dh).take(order[first], 0)
        # only ids that come again are summed
        again = np.flatnonzero(size > 1)
        if len(again):
            held = order[np.repeat(size > 1, size)]
            part, size = _flat(more)[: len(held)], size[again]
            np.take(_flat(dh), held, 0, out=part, mode="clip")
            g["E"][again] = np.add.reduceat(part, np.cumsum(size) - size, axis=0)
        return g


#: Working arrays by type of number, of the largest batch so far.
_ROOM: dict = {}


def _flat(t: np.ndarray) -> np.ndarray:
    return t.reshape(-1, t.shape[-1])


_CAUSAL = np.where(np.arange(CONTEXT)[None, :] <= np.arange(STRIDE)[:, None] + CONTEXT - STRIDE, 0, -1e9).astype(_F)


def places(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(list, place) of all windows of these id lists."""
    many = (np.fromiter(map(len, lists), np.int64, len(lists)) + STRIDE - 1) // STRIDE
    of = np.repeat(np.arange(len(lists)), many)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)


def laid(lists: list[np.ndarray], vocab: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All lists in a row, for ``cut``: each list's start in front of it, and room around both for windows that reach beyond; where each
    list's first window begins; their lengths."""
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    room = CONTEXT + STRIDE
    base = np.cumsum(n + room) - (n + room)
    flat = np.full(int((n + room).sum()), vocab, np.int64)
    if n.sum():
        flat[np.repeat(base + CONTEXT - STRIDE + 1 - (np.cumsum(n) - n), n) + np.arange(n.sum())] = np.concatenate(lists)
    return flat, base, n


def cut(row: tuple[np.ndarray, np.ndarray, np.ndarray], of: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(x, real, target, on) of the windows at these places."""
    flat, base, n = row
    if not len(of):
        return np.empty((0, CONTEXT), np.int64), np.empty((0, CONTEXT), bool), np.empty((0, STRIDE), np.int64), np.empty((0, STRIDE), bool)
    # a window's last slots are the ids before its targets
    both = np.lib.stride_tricks.sliding_window_view(flat, CONTEXT + 1)[base[of] + w * STRIDE]
    x, target = both[:, :CONTEXT], both[:, CONTEXT - STRIDE + 1 :].copy()
    real, on = np.ones(x.shape, bool), np.ones(target.shape, bool)
    real[w == 0, : CONTEXT - STRIDE] = False
    last = np.flatnonzero(n[of] < (w + 1) * STRIDE)
    left = (n[of[last]] - w[last] * STRIDE)[:, None]
    real[last, CONTEXT - STRIDE :] = np.arange(STRIDE) <= left
    on[last] = np.arange(STRIDE) < left
    target[last] *= on[last]
    return x, real, target, on


def windows(lists: list[np.ndarray], vocab: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(x, real, target, on, list, place) of all windows of these id lists; each id is a target, ``on``, exactly once."""
    of, w = places(lists)
    return *cut(laid(lists, vocab), of, w), of, w


def score_ids(model: Model, lists: list[np.ndarray], batch: int = 128) -> np.ndarray:
    """Log-likelihood of each list of ids; 0 for an empty one."""
    out = np.zeros(len(lists))
    lo = 0
    while lo < len(lists):
        hi, size = lo, 0
        while hi < len(lists) and size < 400_000:
            size += len(lists[hi])
            hi += 1
        (of, w), row = places(lists[lo:hi]), laid(lists[lo:hi], model.vocab)
        lp = np.empty(len(of))
        for a in range(0, len(of), batch):
            x, real, target, on = cut(row, of[a : a + batch], w[a : a + batch])
            lp[a : a + batch] = (model.log_probs(x, real, target) * on).sum(1, dtype=np.float64)
        out[lo:hi] = np.bincount(of, lp, hi - lo)
        lo = hi
    return out


def descend(model: Model, x, real, target, on, rate: float, seen: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """Adagrad over the windows in their order; returns the sums of squares."""
    seen = seen or {k: np.full_like(v, 1e-6) for k, v in model.p.items()}
    for a in range(0, len(x), BATCH):
        z = a + BATCH
        g = model.gradients(x[a:z], real[a:z], target[a:z], on[a:z])
        ids = g.pop("ids")
        for k, v in g.items():
            if k == "E":
                n = seen[k].take(ids, 0)
                n += v * v
                seen[k][ids] = n
                v *= _F(rate)
                v /= np.sqrt(n, out=n)
                model.p[k][ids] -= v
            else:
                seen[k] += v * v
                model.p[k] -= _F(rate) * v / np.sqrt(seen[k])
    return seen


def _lists(b: pa.RecordBatch) -> list[np.ndarray]:
    """Ids of the rows (.., n_tokens, bits, payload), from the second column on; null: none."""
    n, bits, payload = (b.column(i) for i in (1, 2, 3))
    wide = pc.unique(bits.drop_null()).to_pylist()
    if payload.type == pa.binary() and wide in ([8], [16], [32]):  # whole bytes: all rows at once
        at = np.frombuffer(payload.buffers()[1], np.int32)[payload.offset : payload.offset + len(b) + 1]
        if (np.diff(at) == pc.if_else(payload.is_null(), 0, n).to_numpy(zero_copy_only=False) * (wide[0] // 8)).all():
            flat = np.frombuffer(payload.buffers()[2] or b"", f">u{wide[0] // 8}", (at[-1] - at[0]) // (wide[0] // 8), at[0]).astype(np.int64)
            at = ((at - at[0]) // (wide[0] // 8)).tolist()
            return [flat[a:z] for a, z in zip(at, at[1:])]
    n, bits, payload = (x.to_pylist() for x in (n, bits, payload))
    return [np.empty(0, np.int64) if p is None else unpack(p, w, k).astype(np.int64) for k, w, p in zip(n, bits, payload)]


def _counts(packed: DataFrame, vocab: int) -> np.ndarray:
    """How often each id occurs in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocab, np.int64)
        for b in batches:
            total += np.bincount(np.concatenate([np.empty(0, np.int64), *_lists(b)]), minlength=vocab)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    out = np.zeros(vocab, np.int64)
    got = packed.mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # the vocabulary at most
    out[got["id"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def _after(packed: DataFrame, cls: np.ndarray) -> np.ndarray:
    """How often each class comes after each (the last row: after a text's start), in all documents."""
    held = packed.sparkSession.sparkContext.broadcast(cls)
    k = CLASSES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1) * k, np.int64)
        for b in batches:
            lists = [a for a in _lists(b) if len(a)]
            if lists:
                c = held.value[np.concatenate(lists)]
                before = np.append(k, c[:-1])
                before[np.append(0, np.cumsum([len(a) for a in lists])[:-1])] = k
                total += np.bincount(before * k + c, minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["id", "n"])

    out = np.zeros((k + 1) * k)
    for r in packed.mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r[0]] = r[1]
    return out.reshape(k + 1, k)


def _chosen(u: np.ndarray, number: int, share: float) -> np.ndarray:
    """Which of the windows with these 32-bit hashes are of a round: rounds take one share after another, and begin again after all."""
    return (u - _U(int(number * share * (1 << 32)) & 0xFFFFFFFF) & _U(0xFFFFFFFF)) < _U(int(share * (1 << 32)))


def _round(packed: DataFrame, model: Model, number: int, share: float) -> None:
    """Local descent in each partition from the same parameters, then their mean by targets. An id's row is averaged
    over the partitions that have met it, so what is gathered follows the input."""
    spark = packed.sparkSession
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        # a worker that is used again still holds the broadcast's object: it must stay as it was sent
        m = copy.copy(held.value)
        m.p = {k: v.copy() for k, v in m.p.items()}
        seen, targets, met = None, 0, np.zeros(m.vocab + 1, np.int64)
        for b in batches:
            lists, key = _lists(b), np.array([hash(k) & 0xFFFFFFFF for k in b.column(0).to_pylist()], np.int64)
            lo = 0
            while lo < len(lists):
                hi, size = lo, 0
                while hi < len(lists) and size < 300_000:
                    size += len(lists[hi])
                    hi += 1
                of, w = places(lists[lo:hi])
                u = mix64((key[lo:hi][of] * 1_000_003 + w * 31).astype(np.uint64)) >> np.uint64(32)
                at = np.flatnonzero(_chosen(u, number, share))
                at = at[np.argsort(mix64(u[at]), kind="stable")]
                if len(at):
                    row, ids = laid(lists[lo:hi], m.vocab), []
                    for a in range(0, len(at), BATCH):
                        x, real, target, on = cut(row, of[at[a : a + BATCH]], w[at[a : a + BATCH]])
                        seen = descend(m, x, real, target, on, RATE, seen)
                        targets += np.count_nonzero(on)
                        ids.append(x[real].astype(np.int32))
                    met += np.bincount(np.concatenate(ids), minlength=m.vocab + 1)
                lo = hi
        if targets:
            ids = np.flatnonzero(met)
            rows = [("E", int(i), float(met[i]), m.p["E"][i]) for i in ids]
            rows += [(k, 0, float(targets), m.p[k].ravel()) for k in _NAMES[1:]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows]), pa.array([r[3].astype("<f4").tobytes() for r in rows], pa.binary())], ["name", "id", "w", "v"])

    def mean(t: pa.Table) -> pa.Table:
        sums: dict[tuple, list] = {}
        for k, i, w, v in zip(t["name"].to_pylist(), t["id"].to_pylist(), t["w"].to_pylist(), t["v"].to_pylist()):
            s = sums.setdefault((k, i), [0.0, 0.0])
            s[0] += w
            s[1] = s[1] + w * np.frombuffer(v, "<f4").astype(np.float64)
        keys = list(sums)
        return pa.table({"name": pa.array([k for k, _ in keys], pa.string()), "id": pa.array([i for _, i in keys], pa.int64()), "v": pa.array([(sums[k][1] / sums[k][0]).astype("<f4").tobytes() for k in keys], pa.binary())})

    local = packed.mapInArrow(run, "name string, id bigint, w double, v binary")
    for r in local.groupBy(F.expr("pmod(xxhash64(name, id), 64)").alias("part")).applyInArrow(mean, "name string, id bigint, v binary").collect():
        v = np.frombuffer(bytes(r[2]), "<f4")
        if r[0] == "E":
            model.p["E"][r[1]] = v
        else:
            model.p[r[0]] = v.reshape(model.p[r[0]].shape).copy()


def fit(packed: DataFrame, vocab: int, share: float = SHARE, rounds: int = ROUNDS) -> Model:
    """``packed``: (doc_id, n_tokens, bits, payload) of all documents."""
    counts = _counts(packed, vocab)
    model = Model(counts)
    model.pair = Model(counts, _after(packed, model.cls)).pair
    for k in range(rounds):
        _round(packed, model, k, share)
    return model


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str = TOKENIZER, share: float = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, perplexity) for each row, by a model trained on ``docs``.

    log_likelihood is the sum of natural logarithms over all ids of the whole text. Null text: all null but the key;
    empty text: 0 ids, 0.0, and a null perplexity. Null and repeated keys stay as they are; other columns aren't read.
    An empty table gives no rows.
    """
    packed = written(tokenize_and_pack(docs, text, key, tokenizer).select("doc_id", "n_tokens", "bits", "payload"), "packed")
    model = fit(packed, len(read_ranks(tokenizer)), share, rounds)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for b in batches:
            n = b.column(1).to_numpy(zero_copy_only=False)
            s = score_ids(held.value, _lists(b))
            null = np.array(b.column(3).is_null().to_pylist(), bool)
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                per = np.exp(-s / n.astype(float))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, mask=null), pa.array(per, mask=null | (n.astype(float) == 0))], ["doc_id", "n_tokens", "log_likelihood", "perplexity"])

    return packed.mapInArrow(run, "doc_id bigint, n_tokens int, log_likelihood double, perplexity double")
