"""Operators 1, 5 and 9, and the pipeline: held-out accuracy, brute force, odd rows."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from codeloom.llm import bpe, linededup, lm, mixing, packing, quality, simhash, toxicity

from .helpers import SCHEMA, clashing, frame, needs_tokenizer, odd, prose

LABELS = "doc_id bigint, quality int, toxic int, score double"
BAD = ["blorgu", "snarfi", "wuxxle"]
WORDS = {x: ["".join(random.Random(f"{x}{i}").choices("abcdefghijklmnoprstu", k=6)) for i in range(300)] for x in ("en", "de")}


def corpus(n, seed=0):
    """(docs, labels): two languages, some toxic, some poor (shouted)."""
    rng, docs, labels = random.Random(seed), [], []
    for i in range(n):
        lang, toxic, poor = rng.choice(["en", "en", "de"]), rng.random() < 0.2, rng.random() < 0.2
        w = [rng.choice(WORDS[lang]) for _ in range(rng.randint(20, 120))]
        if toxic:
            for k in rng.sample(range(len(w)), 3):
                w[k] = rng.choice(BAD)
        if poor:
            w = [x.upper() + "!!" for x in w]
        docs.append((i, " ".join(w), lang))
        labels.append((i, 0 if poor else 1, int(toxic), 0.5))
    return docs, labels


@pytest.fixture(scope="module")
def data(spark):
    docs, labels = corpus(900)
    held = [(x if x[0] % 2 else (x[0], None, None, None)) for x in labels] + [(None, 1, 1, 0.0), (5, 1, 0, 0.0), (10_000, 1, 1, 0.0)]
    return docs, labels, frame(spark, docs), spark.createDataFrame(held, LABELS)


def test_toxicity_on_held_out_rows(data):
    docs, labels, df, table = data
    model = toxicity.fit(clashing(df), table)
    got = {r["doc_id"]: r["toxic"] for r in toxicity.score(clashing(df), model).collect()}
    rest = [x for x in labels if x[0] % 2 == 0]
    hit = [got[x[0]] for x in rest if x[2]]
    false = [got[x[0]] for x in rest if not x[2]]
    assert np.mean(hit) >= 0.9 and np.mean(false) <= 0.02
    again = toxicity.fit(df, table)
    assert (again.keys == model.keys).all() and (again.weights == model.weights).all()
    kept = {r["doc_id"] for r in toxicity.drop_toxic(df, model).collect()}
    assert kept == {k for k, v in got.items() if not v}


def test_toxicity_scoring_is_the_definition():
    keys = np.sort(np.unique(toxicity.features(["one two three"])[0]))
    keys = keys[keys != 0]
    m = toxicity.Scorer(keys, np.linspace(-1, 1, len(keys)).astype(np.float32), 0.25)
    texts = ["one two three", "one two three one two three", "two", None, "", "!!", "unseen words only"]
    for t, s in zip(texts, m.score(texts)):
        f = set(toxicity.features([t])[0].tolist()) - {0}
        want = 0.25 + sum(float(w) for k, w in zip(m.keys.tolist(), m.weights) if k in f)
        assert s == pytest.approx(1 / (1 + np.exp(-want)), rel=1e-5)


def test_ftrl_is_the_definition():
    """Against the update rule, a coordinate at a time."""
    texts = ["a b c d", "a x c", "b c d", "a b x", "d c x b", "x a b c"] * 3
    y = np.array([1, 0, 1, 0, 1, 0] * 3)
    how = {"alpha": 0.5, "beta": 1.0, "l1": 0.2, "l2": 0.3, "epochs": 2, "least_docs": 2}
    keys, w, bias = toxicity.train(texts, y, **how)
    rows = [set(toxicity.features([t])[0].tolist()) - {0} for t in texts]
    seen = {k for r in rows for k in r if sum(k in q for q in rows) >= 2}
    z, n, b, nb = dict.fromkeys(seen, 0.0), dict.fromkeys(seen, 0.0), 0.0, 0.0

    def weight(k):
        return 0.0 if abs(z[k]) <= how["l1"] else -(z[k] - np.sign(z[k]) * how["l1"]) / ((how["beta"] + n[k] ** 0.5) / how["alpha"] + how["l2"])

    for _ in range(how["epochs"]):
        for r, t in zip(rows, y.tolist()):
            mine = {k: weight(k) for k in r & seen}
            g = 1 / (1 + np.exp(-(sum(mine.values()) + b))) - t
            for k, wk in mine.items():
                z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / how["alpha"] * wk
                n[k] += g * g
            nb += g * g
            b -= how["alpha"] / (how["beta"] + nb**0.5) * g
    want = {k: weight(k) for k in seen if weight(k) != 0}
    assert len(want) > 5 and set(keys.tolist()) == set(want) and bias == pytest.approx(b)
    assert all(x == pytest.approx(want[k], rel=1e-5) for k, x in zip(keys.tolist(), w.tolist()))


def test_toxicity_of_repeated_keys(spark, data):
    """Whatever the order of rows, the least text of a key is trained on."""
    docs, labels, df, table = data
    more = [(i, "zz " + t, lang) for i, t, lang in docs[:200]]
    a, b = (toxicity.fit(frame(spark, x).repartition(5), table) for x in (docs + more, more[::-1] + docs[::-1]))
    assert (a.keys == b.keys).all() and (a.weights == b.weights).all() and a.bias == b.bias


def test_toxicity_odd_rows(spark, data):
    model = toxicity.fit(data[2], data[3])
    rows = toxicity.score(odd(spark), model).collect()
    assert len(rows) == odd(spark).count() and all(r["score"] == 0 for r in rows if r["doc_id"] in (1, 2, 11))
    none = toxicity.fit(data[2], data[3].limit(0))
    assert toxicity.drop_toxic(clashing(odd(spark)), none).count() == odd(spark).count()
    assert toxicity.score(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_domains_and_rates(spark, data):
    docs, labels, df, table = data
    targets = {"en/good": 0.3, "de/good": 0.5, "en/poor": 0.1, "de/poor": 0.1, "xx/good": 0.7}
    rows = mixing.document_rates(clashing(df), table, targets).collect()
    truth = {d[0]: f"{d[2]}/{'good' if x[1] else 'poor'}" for d, x in zip(docs, labels)}
    assert np.mean([r["domain"] == truth[r["doc_id"]] for r in rows if r["doc_id"] % 2 == 0]) >= 0.95
    assert all(r["rate"] >= 0 and r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) for r in rows)
    total = sum(r["tokens"] for r in rows)
    assert sum(r["rate"] * r["tokens"] for r in rows) == pytest.approx(total, rel=0.02)
    for k, w in targets.items():
        if k != "xx/good":
            assert sum(r["rate"] * r["tokens"] for r in rows if truth[r["doc_id"]] == k) / total == pytest.approx(w, abs=0.03)
    mixed = mixing.mix(clashing(df), table, targets)
    assert mixed.columns == clashing(df).columns
    count = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert count == {r["doc_id"]: r["copies"] for r in rows if r["copies"]}


def test_rates_solve_the_least_squares(spark):
    """Against a plain projected gradient on the full matrix."""
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3] * 4, 300).astype(np.float32)
    t = rng.integers(0, 500, 300)
    df = spark.createDataFrame([(i, int(t[i]), [float(v) for v in p[i]]) for i in range(300)], "doc_id bigint, tokens bigint, p array<float>")
    names = list("abcd")
    steps = mixing.solve(df, names, {"a": 0.6, "b": 0.1, "c": 0.3})
    r = mixing.rates(p.astype(float), steps)
    have = t @ p.astype(float)
    want = np.array([0.6, 0.1, 0.3, 0.0]) * have.sum()
    plain = np.ones(300)
    for _ in range(4000):
        plain = np.maximum(0, plain - p.astype(float) @ ((plain * t @ p - want) / have))
    cost = lambda x: (((x * t @ p.astype(float)) - want) ** 2 / have).sum() / (want**2 / have).sum()
    assert (r >= 0).all() and cost(r) <= cost(plain) + 2e-3
    assert mixing.solve(df.limit(0), names) == []


def test_mixing_odd_rows(spark, data):
    rows = mixing.document_rates(odd(spark), data[3]).collect()
    assert len(rows) == odd(spark).count()
    assert all(r["rate"] == 1 and r["copies"] == 1 and r["tokens"] == 0 for r in rows if r["doc_id"] in (1, 2, 3, 11))
    assert mixing.mix(odd(spark), data[3].limit(0)).count() == odd(spark).count()
    assert mixing.document_rates(spark.createDataFrame([], SCHEMA), data[3]).count() == 0


def test_compression_bands(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    good = [(i, prose(rng, n, words)) for i, n in enumerate([1, 5, 20, 60, 150, 400, 1500, 6000])]
    noise = "".join(chr(rng.randrange(33, 127)) for _ in range(5000))
    bad = [(100, "spam and eggs " * 300), (101, noise), (102, prose(rng, 3000, words) + " buy now" * 2000), (103, "")]
    rows = {r["doc_id"]: r for r in quality.compression_bands(clashing(frame(spark, good + bad))).collect()}
    assert {k for k, r in rows.items() if r["keep"]} == {k for k, _ in good}
    assert rows[100]["reason"] == "repetitive" and rows[101]["reason"] == "incompressible" and rows[103]["reason"] == "empty"
    assert quality.keep_good(frame(spark, good + bad)).count() == len(good)
    got = quality.compression_bands(odd(spark)).collect()
    assert len(got) == odd(spark).count() and all(r["ratio"] is None for r in got if r["doc_id"] in (1, 2, 11))
    assert quality.compression_bands(spark.createDataFrame([], SCHEMA)).count() == 0


def test_compression_against_brute_force():
    """Ratios and chunks from the command as another interface offers it."""
    import zstandard

    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    noise = lambda n: "".join(chr(rng.randrange(33, 127)) for _ in range(n))
    prose_of = lambda n: prose(rng, n, words)
    texts = [prose_of(k) for k in (3, 40, 300, 340, 700, 2000)] + [noise(k) for k in (40, 600, 3000)]
    texts += [prose_of(400)[:2048], prose_of(400)[:2049], prose_of(3000)[:10_000] + noise(3000), prose_of(60_000) + noise(30_000) + prose_of(60_000), prose_of(200)[:1200] + noise(2000), "ab" * 5000, "é" * 3000]

    def packed(raw):
        c = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, write_dict_id=False).compressobj(size=len(raw))
        return len(c.compress(raw) + c.flush())

    for t, (n, ratio, chunks, bad, keep, why) in zip(texts, quality.judge(texts)):
        raw = t.encode()
        parts = [raw[i : i + 2048] for i in range(0, len(raw), 2048)] if len(raw) > 2048 else []
        band = lambda size: next((a, z) for most, a, z in quality.BANDS if size <= most)
        out = [p for p in parts if not (lambda r, b: b[0] <= r <= b[1])(len(p) / packed(p), quality.CHUNK_BAND if len(p) == 2048 else band(len(p)))]
        low, high = band(len(raw))
        assert (n, chunks, bad) == (len(raw), len(parts), len(out)) and ratio == pytest.approx(len(raw) / packed(raw), rel=0.02)
        fine = low <= ratio <= high and len(out) <= 0.2 * len(parts) and sum(map(len, out)) <= quality.BAD_BYTES
        assert keep == fine and (why is None) == fine
    kept = [r[4] for r in quality.judge(texts)]
    assert kept[:6] == [1] * 6 and kept[7:9] == [0, 0] and kept[-4:] == [0, 0, 0, 0] and kept[-5] == 0


@needs_tokenizer
def test_pipeline(spark, tmp_path):
    docs, labels = corpus(300, seed=4)
    docs = [(i, t + "\nfooter line here", lang) for i, t, lang in docs] + [(400 + i, docs[i][1] + " extra", docs[i][2]) for i in range(20)]
    docs += [(500, None, None), (501, "", "en"), (None, "alpha beta", "en")]
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "mixing", "bpe"]
    df, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, str(tmp_path))
        if k < 4:
            assert out.columns == df.columns
        out.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        seen.append(df.count())
    tox = {x[0] for x in labels if x[2]}
    first = {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "toxicity")).collect()}
    assert len(first & tox) <= 0.05 * len(tox) and len({x[0] for x in labels if not x[2]} - first) <= 3
    lines = spark.read.parquet(str(tmp_path / "line_dedup"))
    assert sum("footer line here" in (r["text"] or "").split("\n") for r in lines.collect()) == 1
    stay = {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "simhash")).collect()}
    gone = {r["doc_id"] for r in simhash.near_duplicates(lines).collect()} | {400 + i for i in range(20)}
    assert stay == {r["doc_id"] for r in lines.collect()} - gone and len(gone) >= 10  # the copies, whatever line dedup left of them
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(rows) == seen[-1] and all(r["lossless"] in (True, None) for r in rows)
    assert bpe and linededup


def test_the_sample_is_each_domains_own(spark):
    """A domain of few rows among many gets all of them, whatever hashes the others have; repeated keys give their least text."""
    rows = [(i, f"t {i}", "en") for i in range(3000)] + [(3000 + i, f"t {i}", "de") for i in range(12)] + [(3000, "a first", "de"), (3001, None, None)]
    labels = spark.createDataFrame([(i, 1, 0, 0.0) for i in range(3012)], LABELS)
    got = mixing.labelled(frame(spark, rows), labels, "text", "doc_id", 20).collect()
    assert sorted((r["domain"], r["k"]) for r in got if r["domain"] == "de/good") == [("de/good", 3000 + i) for i in range(12)]
    assert sum(r["domain"] == "en/good" for r in got) == 20 and {r["t"] for r in got if r["k"] == 3000} == {"a first"}


@needs_tokenizer
@pytest.mark.parametrize("case", ["empty", "no labels", "odd"])
def test_pipeline_of_odd_tables(spark, tmp_path, case):
    """No rows, no labels; nulls, long texts, repeated rows and columns whose names clash, through all stages."""
    docs, labels = corpus(60, seed=6)
    df = {"empty": frame(spark, []), "no labels": frame(spark, docs), "odd": clashing(odd(spark).union(frame(spark, docs)))}[case]
    df.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([] if case == "no labels" else labels, LABELS).coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    df, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns
        out.write.parquet(str(tmp_path / name.replace(" ", "")))
        df = spark.read.parquet(str(tmp_path / name.replace(" ", "")))
        kept[name] = df.collect()
    rows = corpus_pipeline.STAGES[4][1](spark, df, str(tmp_path)).collect()
    assert len(rows) == len(kept["mixing"]) and all(r["lossless"] in (True, None) for r in rows)
    if case == "empty":
        assert rows == []
    if case == "odd":
        assert [r["__gone"] for r in kept["mixing"]][:1] == [r["__gone"] for r in kept["toxicity"]][:1]  # the user's own, as it was
        assert {1, 4, 5} <= {r["doc_id"] for r in kept["simhash"]} and sum(r["doc_id"] is None for r in kept["simhash"]) >= 1


def test_each_window_is_trained_on():
    from codeloom.llm import lm

    u = np.append(np.random.default_rng(4).integers(0, 1 << 32, 1000), [0, (1 << 31) - 1, 1 << 31, (1 << 32) - 1]).astype(np.uint64)
    rounds = [lm._chosen(u, k, lm.SHARE) for k in range(lm.ROUNDS)]
    assert (np.sum(rounds, axis=0) == 1).all()


def test_a_round_is_the_mean_of_the_partitions(spark):
    """Each partition starts from the parameters as they were sent, also where a Python worker is used again."""
    import copy

    from codeloom.llm import common, lm, packing

    rng, vocab = np.random.default_rng(9), 200
    lists = [rng.zipf(1.4, n).clip(1, vocab) - 1 for n in rng.integers(0, 150, 120)]
    rows = [(i, len(a), 8, packing.pack(a, 8)) for i, a in enumerate(lists)]
    df = common.written(spark.createDataFrame(rows, "doc_id bigint, n_tokens int, bits int, payload binary").repartition(12), "packed")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        parts = {}
        for r in df.selectExpr("spark_partition_id() as p", "doc_id").collect():
            parts.setdefault(r["p"], []).append(r["doc_id"])
        counts = np.bincount(np.concatenate(lists), minlength=vocab)
        model = lm.Model(counts)
        model.pair = lm.Model(counts, np.ones((lm.CLASSES + 1, lm.CLASSES))).pair
        sums = {k: np.zeros(v.shape) for k, v in model.p.items()}
        total, met_by = 0, np.zeros(vocab + 1)
        for ids in parts.values():
            m = copy.copy(model)
            m.p = {k: v.copy() for k, v in model.p.items()}
            x, real, target, on, of, w = lm.windows([lists[i].astype(np.int64) for i in ids], vocab)
            u = common.mix64((np.array(ids)[of] * 1_000_003 + w * 31).astype(np.uint64)) >> np.uint64(32)
            at = np.flatnonzero(lm._chosen(u, 0, 0.5))
            at = at[np.argsort(common.mix64(u[at]), kind="stable")]
            lm.descend(m, x[at], real[at], target[at], on[at], lm.RATE)
            n, met = int(on[at].sum()), np.bincount(x[at][real[at]], minlength=vocab + 1)
            total, met_by = total + n, met_by + met
            for k in sums:
                sums[k] += m.p[k] * (met[:, None] if k == "E" else n)
        lm._round(df, model, 0, 0.5)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(parts) > 4
    for k in sums:
        want = np.where(met_by[:, None] > 0, sums[k] / np.maximum(met_by, 1)[:, None], model.p[k]) if k == "E" else sums[k] / total
        assert np.allclose(model.p[k], want, atol=1e-4), k


def test_mixing_training_holds_few_products():
    """Products of entries and domains are made some at a time: what training holds at once doesn't grow with entries times domains."""
    rng = random.Random(41)
    texts = [" ".join(f"w{rng.randrange(30_000)}" for _ in range(600)) for _ in range(400)]
    mixing.train(texts[:4], np.arange(4) % 2, ["a", "b"], steps=1)  # what a worker keeps anyway
    tracemalloc.start()
    model = mixing.train(texts, np.arange(400) % 60, [f"d{i:02}" for i in range(60)], steps=2)
    peak = tracemalloc.get_traced_memory()[1] >> 20
    tracemalloc.stop()
    assert np.isfinite(model.weights).all() and peak < 95, peak


def test_rows_of_whole_bytes_are_unpacked_at_once(monkeypatch):
    """All rows of a batch in one go, also of a part of it, with nulls and empty rows; other widths row by row."""
    rng = np.random.default_rng(13)
    ids = [None if k in (3, 7) else rng.integers(0, 200, 0 if k == 5 else k * 9) for k in range(12)]

    def batch(bits):
        n = [None if x is None else len(x) for x in ids]
        width = pa.array([None if x is None else bits for x in ids], pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array(n, pa.int32()), width, pa.array([None if x is None else packing.pack(x, bits) for x in ids], pa.binary())], ["doc_id", "n_tokens", "bits", "payload"])

    same = lambda got, lo, hi: len(got) == hi - lo and all(np.array_equal(g, [] if x is None else x) for g, x in zip(got, ids[lo:hi]))
    assert same(lm._lists(batch(9)), 0, 12)
    monkeypatch.setattr(lm, "unpack", None)
    for bits in (8, 16, 32):
        for lo, hi in ((0, 12), (2, 9), (3, 4), (4, 4)):
            assert same(lm._lists(batch(bits).slice(lo, hi - lo)), lo, hi)
