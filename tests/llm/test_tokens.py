"""Operators 2, 3 and 7: encoding, packing and language-model scoring."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import bpe, lm, packing

from .helpers import SCHEMA, TOKENIZER, clashing, frame, needs_tokenizer, odd, prose


@pytest.fixture(scope="module")
def vocab():
    return bpe.Bpe(bpe.read_ranks(TOKENIZER))


def naive(tokens: dict, piece: bytes) -> list[int]:
    """The definition: merge the leftmost pair of the least rank until none merges."""
    parts = [bytes([b]) for b in piece]
    while True:
        best = min(((tokens[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in tokens), default=None)
        if best is None:
            return [tokens[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


@needs_tokenizer
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abe nt'sé\n\t 1!,日😀", max_size=60), max_size=6))
def test_encoding_is_the_definition(vocab, texts):
    ids, at = vocab.encode(texts)
    ranks = {t: i for i, t in enumerate(vocab.tokens)}
    want = [[x for p in vocab.split.findall(t) for x in naive(ranks, p.encode())] for t in texts]
    assert [ids[a:z].tolist() for a, z in zip(at, at[1:])] == want
    assert vocab.decode(ids, at).to_pylist() == [t.encode() for t in texts]


@needs_tokenizer
def test_encoding_like_the_library(vocab):
    tiktoken = pytest.importorskip("tiktoken")
    lib = tiktoken.Encoding("own", pat_str=bpe.SPLIT, mergeable_ranks={t: i for i, t in enumerate(vocab.tokens)}, special_tokens={})
    rng = random.Random(4)
    texts = [prose(rng, 300), "a" * 3000, "ab" * 2000 + " " * 50, "we'll  it's\r\n\r\nx", "".join(chr(rng.randrange(32, 3000)) for _ in range(2000))]
    ids, at = vocab.encode(texts + texts)
    assert [ids[a:z].tolist() for a, z in zip(at, at[1:])] == [lib.encode_ordinary(t) for t in texts] * 2


def test_a_vocabulary_whose_later_merges_come_first():
    """'bc' ranks after 'abc', which a and bc make."""
    toks = [bytes([b]) for b in range(256)] + [b"abc", b"bc", b"bcbc", b"ca"]
    b = bpe.Bpe(toks)
    ranks = {t: i for i, t in enumerate(toks)}
    rng = random.Random(2)
    pieces = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 30))).encode() for _ in range(300)]
    ids, many = b.merge(pieces)
    ends = np.cumsum(many)
    assert [ids[z - n : z].tolist() for z, n in zip(ends, many)] == [naive(ranks, p) for p in pieces]


def test_queue_pops_in_order():
    q, rng = bpe.RankQueue(70_000), random.Random(0)
    ranks = sorted(rng.sample(range(70_000), 500))
    for r in sorted(ranks, key=lambda _: rng.random()):
        q.push(r, np.array([r]))
    assert [q.pop()[0] for _ in ranks] == ranks and q.pop() is None


@needs_tokenizer
def test_memo_is_trimmed(vocab, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 20)
    rng = random.Random(9)
    texts = [prose(rng, 50) for _ in range(30)]
    b = bpe.Bpe(vocab.tokens)
    for t in texts:
        ids, at = b.encode([t])
        assert b.decode(ids, at).to_pylist() == [t.encode()] and ids.tolist() == vocab.encode([t])[0].tolist()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="ab\0é😀", max_size=4).map(lambda t: t * 4) | st.text(alphabet="ab\0", max_size=40), unique=True, max_size=30), max_size=6), st.data())
def test_numbers_are_those_of_a_dict(rounds, data):
    numbers, want = bpe.Numbers(), {}
    for strings in rounds:
        got, fresh = numbers.of(pa.array(["before", *strings], pa.string()).slice(1))
        new = [strings[i] for i in fresh.tolist()]
        assert sorted(new) == sorted(s for s in strings if s not in want)
        for s in new:
            want[s] = len(want)
        assert got.tolist() == [want[s] for s in strings] and len(numbers) == len(want)
        if data.draw(st.booleans()):
            kept = [s for s in want if data.draw(st.booleans())]
            numbers.keep(np.array([want[s] for s in kept], np.int64))
            want = {s: i for i, s in enumerate(kept)}


@needs_tokenizer
def test_a_piece_is_merged_once(vocab, monkeypatch):
    """Neither in another chunk nor in another slice again; the new chunks of several slices are merged at once."""

    class Counting(bpe.RankQueue):
        made = pushed = 0

        def __init__(self, n):
            Counting.made += 1
            super().__init__(n)

        def push(self, rank, positions):
            Counting.pushed += 1
            super().push(rank, positions)

    rng = random.Random(3)
    texts = ["alpha beta " * 15 + "".join(rng.choice("etaoin") for _ in range(9)) for _ in range(30)]
    want = [vocab.encode([t])[0].tolist() for t in texts]
    b = bpe.Bpe(vocab.tokens)
    monkeypatch.setattr(bpe, "RankQueue", Counting)
    monkeypatch.setattr(bpe, "SLICE", 200)
    ids, at = b.encode(texts)
    assert [ids[a:z].tolist() for a, z in zip(at, at[1:])] == want
    assert 1 <= Counting.made <= 10
    Counting.pushed = 0
    assert b.encode(["x alpha, beta; alpha."])[0].tolist() == vocab.encode(["x alpha, beta; alpha."])[0].tolist()
    assert Counting.pushed == 0


@needs_tokenizer
def test_memos_are_trimmed_with_long_and_odd_chunks(vocab, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 30)
    monkeypatch.setattr(bpe, "SLICE", 300)
    ranks = {t: i for i, t in enumerate(vocab.tokens)}
    rng = random.Random(5)
    words = ["".join(rng.choice("abeé\0\n1!") for _ in range(rng.choice((0, 1, 5, 30, 31, 32, 33, 70)))) for _ in range(60)]
    texts = [None if rng.random() < 0.1 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(120)]
    b = bpe.Bpe(vocab.tokens)
    for column in (pa.array(texts, pa.string()), pa.array(texts, pa.large_string()).slice(7)):
        ids, at = b.encode(column)
        want = [[x for p in vocab.split.findall(t or "") for x in naive(ranks, p.encode())] for t in column.to_pylist()]
        assert [ids[a:z].tolist() for a, z in zip(at, at[1:])] == want


@needs_tokenizer
def test_encode_odd_rows(spark):
    rows = bpe.encode(clashing(odd(spark))).collect()
    src = odd(spark).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"] is None) for r in rows) == sorted((r["doc_id"] or 0, r["text"] is None) for r in src)
    assert all(r["lossless"] in (True, None) and (r["ids"] is None) == (r["lossless"] is None) for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] == 2} == {0}
    back = {(r["doc_id"], r["text"]) for r in bpe.decode(bpe.encode(odd(spark))).collect()}
    assert back == {(r["doc_id"], r["text"]) for r in src}
    assert bpe.encode(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 20), st.data())
def test_packing_round_trip(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, (1 << bits) - 1), max_size=70)), np.int64)
    at = packing.offsets_of(len(ids), bits, 16)
    raw = packing.pack(ids, bits)
    assert len(raw) == (len(ids) * bits + 7) // 8 == at[-1]
    assert packing.unpack(raw, bits, len(ids)).tolist() == ids.tolist()
    a, z = sorted((data.draw(st.integers(-3, 75)), data.draw(st.integers(-3, 75))))
    assert packing.read_range(raw, at, len(ids), bits, a, z, 16).tolist() == ids[max(a, 0) : max(z, 0)].tolist()


def test_packing_limits(spark):
    assert [packing.width(v) for v in (1, 2, 3, 256, 257, 50256, 32000)] == [1, 1, 2, 8, 9, 16, 15]
    with pytest.raises(ValueError):
        packing.pack(np.array([4]), 2)
    rows = spark.createDataFrame([(1, [1, 2, 3]), (2, []), (3, None), (None, list(range(1000)) * 3)], "doc_id bigint, ids array<int>")
    packed = packing.pack_ids(rows, 1000)
    assert {(r["doc_id"], tuple(r["ids"]) if r["ids"] is not None else None) for r in packing.unpack_ids(packed).collect()} == {(1, (1, 2, 3)), (2, ()), (3, None), (None, tuple(list(range(1000)) * 3))}
    for r in packed.collect():
        assert r["bits"] == 10 and (r["payload"] is None) == (r["block_offsets"] is None)
        if r["payload"] is not None:
            assert r["block_offsets"] == packing.offsets_of(r["n_tokens"], 10).tolist()


@needs_tokenizer
def test_tokenize_and_pack(spark, tmp_path):
    packed = packing.tokenize_and_pack(clashing(odd(spark)))
    packing.write_packed(packed, str(tmp_path / "p"))
    got = {(r["doc_id"], None if r["ids"] is None else tuple(r["ids"])) for r in packing.unpack_ids(spark.read.parquet(str(tmp_path / "p"))).collect()}
    assert got == {(r["doc_id"], None if r["ids"] is None else tuple(r["ids"])) for r in bpe.encode(odd(spark)).collect()}
    assert packing.tokenize_and_pack(spark.createDataFrame([], SCHEMA)).count() == 0


def small_model(lists, vocab=50):
    counts = np.bincount(np.concatenate(lists), minlength=vocab)
    m = lm.Model(counts)
    after = np.ones((lm.CLASSES + 1, lm.CLASSES))
    return lm.Model(counts, after + np.arange(lm.CLASSES) % 3)


def test_scoring_is_the_definition():
    """Each id once, from the ids that its window sees before it: against a loop over single ids."""
    rng = np.random.default_rng(0)
    lists = [rng.integers(0, 50, n) for n in (0, 1, 5, 24, 25, 39, 40, 41, 130)]
    m = small_model(lists)
    got = lm.score_ids(m, lists, batch=3)
    p, s = m.p, lm.CONTEXT - lm.STRIDE
    for a, total in zip(lists, got):
        seq, want = np.append(50, a), 0.0
        for j, t in enumerate(a):
            lo = j // lm.STRIDE * lm.STRIDE - s
            slots = np.arange(max(lo, 0), j + 1)
            h = p["E"][seq[slots]] + p["P"][slots - lo]
            w = (h[-1] @ p["Q"]) @ (h @ p["K"]).T / np.sqrt(lm.WIDE)
            w = np.exp(w - w.max())
            z = (w / w.sum()) @ (h @ p["V"]) @ p["O"] + h[-1]
            y = z @ p["U"] + p["b"] + m.pair[m.cls[seq[j]]]
            want += y[m.cls[t]] - np.log(np.exp(y).sum()) + m.inside[t]
        assert total == pytest.approx(want, rel=1e-4, abs=1e-3)
    seen = np.concatenate([t[o] for t, o in [lm.windows(lists, 50)[2:4]]])
    assert sorted(seen.tolist()) == sorted(np.concatenate(lists).tolist())


def test_gradients():
    rng = np.random.default_rng(1)
    m = small_model([rng.integers(0, 50, 400)])
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, real, t, on, _, _ = lm.windows([rng.integers(0, 50, 70)], 50)
    g = m.gradients(x, real, t, on)
    loss = lambda: -((m.log_probs(x, real, t) - m.inside[t]) * on).sum() / on.sum()
    for k, i, j in (("P", (20, 1), (20, 1)), ("Q", (1, 2), (1, 2)), ("K", (0, 3), (0, 3)), ("V", (2, 2), (2, 2)), ("O", (1, 1), (1, 1)), ("U", (3, 4), (3, 4)), ("b", (5,), (5,)), ("E", (g["ids"][4], 2), (4, 2))):
        e, was = 1e-4, m.p[k][i]
        m.p[k][i] = was + e
        up = loss()
        m.p[k][i] = was - e
        down = loss()
        m.p[k][i] = was
        assert g[k][j] == pytest.approx((up - down) / 2 / e, rel=2e-3, abs=1e-8)


@needs_tokenizer
def test_lm_learns_and_bears_odd_rows(spark):
    rng = random.Random(2)
    plain = [(i, " ".join(VOC[(j + i) % len(VOC)] for j in range(300))) for i in range(40)]
    mixed = [(1000, " ".join(rng.sample(VOC * 20, 300)))]
    docs = frame(spark, plain + mixed)
    per = {r["doc_id"]: r["perplexity"] for r in lm.score(clashing(docs), share=1.0, rounds=3).collect()}
    assert per[1000] > 1.3 * max(v for k, v in per.items() if k < 1000)
    rows = {r["doc_id"]: r for r in lm.score(odd(spark), share=0.5, rounds=1).where("doc_id is not null").collect()}
    assert rows[1]["log_likelihood"] is None and rows[2]["log_likelihood"] == 0.0 and rows[2]["perplexity"] is None and rows[4]["log_likelihood"] < 0
    assert lm.score(spark.createDataFrame([], SCHEMA), rounds=1).count() == 0


VOC = "the cat sat on a mat and then it ran off to find some more fish near the old stone bridge".split()


def test_lm_batches_reuse_their_arrays():
    """What a batch of windows needs is kept for the next one: fresh large arrays cost more time than what is done with them."""
    rng = np.random.default_rng(8)
    lists = [rng.integers(0, 50, 24 * lm.BATCH - 5)]
    m = small_model(lists)
    x, real, target, on, of, w = lm.windows(lists, 50)
    m.gradients(x, real, target, on)  # makes them
    for f, most in ((lambda: m.gradients(x, real, target, on), 1.0), (lambda: m.log_probs(x, real, target), 0.5)):
        tracemalloc.start()
        f()
        peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert peak < most, peak


def test_windows_are_cut_where_they_are_chosen():
    rng = np.random.default_rng(7)
    lists = [rng.integers(0, 50, n) for n in (0, 1, 23, 24, 25, 0, 47, 48, 49, 130)]
    x, real, target, on, of, w = lm.windows(lists, 50)
    at = rng.permutation(len(of))[:7]
    for got, want in zip(lm.cut(lm.laid(lists, 50), of[at], w[at]), (x, real, target, on)):
        assert (got == want[at]).all()
    for i in range(len(of)):  # against the list itself
        seq = np.append(50, lists[of[i]])
        slots = w[i] * lm.STRIDE - (lm.CONTEXT - lm.STRIDE) + np.arange(lm.CONTEXT)
        inside = (slots >= 0) & (slots < len(seq))
        assert (real[i] == inside).all() and (x[i] == np.where(inside, seq[np.clip(slots, 0, len(seq) - 1)], 50)).all()
