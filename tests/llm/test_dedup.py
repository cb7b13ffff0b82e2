"""Operators 4, 6, 8 and 10: repeated lines, near-duplicates, embeddings, passages; against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from codeloom.llm import common, embeddings, linededup, paragraphs, simhash, words

from .helpers import SCHEMA, VOCAB, clashing, frame, odd, prose


def test_minimal_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000, 20_000):
        keys = common.uniq(rng.integers(0, 1 << 63, n).astype(np.uint64))
        f = linededup.Mphf.from_bytes(linededup.Mphf.build(keys).to_bytes())
        assert sorted(f.index(keys).tolist()) == list(range(len(keys)))
        prints = rng.integers(-(1 << 31), 1 << 31, len(keys))
        s = linededup.Shard.build(keys, prints, np.full(len(keys), 2), np.arange(len(keys)), np.zeros(len(keys), int))
        assert (s.docs[s.probe(keys, prints)] == np.arange(len(keys))).all() if len(keys) else True
        assert (s.probe(rng.integers(0, 1 << 63, 5000).astype(np.uint64), np.zeros(5000, int)) < 0).all()


def test_lines_that_share_the_first_hash():
    h, f = np.array([5, 9, 5, 7, 5], np.uint64), np.array([1, 2, 3, 4, -8])
    s = linededup.Shard.build(h, f, np.arange(5) + 2, np.arange(5) * 10, np.arange(5))
    assert s.docs[s.probe(h, f)].tolist() == [0, 10, 20, 30, 40]
    assert s.probe(h, f + 100).tolist() == [-1] * 5


def lines_brute(rows, least=2):
    strip = lambda x: x.strip(" \t\r\f")
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    first, count, out = {}, {}, []
    for i in order:
        for k, x in enumerate((rows[i][1] or "").split("\n")):
            s = strip(x)
            count[s] = count.get(s, 0) + 1
            place = (rows[i][0] is None, rows[i][0] or 0, k)
            first[s] = min(first.get(s, place), place)
    for d, t in rows:
        if t is None:
            out.append((d, t))
            continue
        lines = t.split("\n")
        gone = [strip(x) != "" and count[strip(x)] >= least and first[strip(x)] != (d is None, d or 0, k) for k, x in enumerate(lines)]
        kept = [x for x, g in zip(lines, gone) if not g]
        if not any(gone):
            out.append((d, t))
        elif any(strip(x) for x in kept):
            out.append((d, "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("resident", [linededup.RESIDENT, 0])
def test_lines_against_brute_force(spark, resident):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice(["a", "b ", " b", "", "c d", f"own {i}", "e\t", "f"]) for _ in range(rng.randint(1, 6)))) for i in range(80)]
    rows += [(None, "a\nnobody else"), (None, None), (5, "x"), (90, ""), (91, "\n\n"), (92, "hot\n" * 3000)] + [(100 + i, "hot") for i in range(50)]
    for least in (2, 4):
        got = linededup.dedup_lines(clashing(frame(spark, rows)), least=least, resident=resident, shard_keys=3)
        assert got.columns == clashing(frame(spark, [])).columns
        assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == lines_brute(rows, least)


def test_lines_odd_rows(spark):
    rows = [(r["doc_id"], r["text"]) for r in odd(spark).collect()]
    assert sorted(((r["doc_id"], r["text"]) for r in linededup.dedup_lines(odd(spark)).collect()), key=repr) == lines_brute(rows)
    assert linededup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_embedding_bounds_hamming():
    rng = np.random.default_rng(1)
    a = rng.integers(-(1 << 62), 1 << 62, (200, 2))
    b = a ^ (rng.integers(0, 1 << 62, (200, 2)) & rng.integers(0, 1 << 62, (200, 2)) & rng.integers(0, 1 << 62, (200, 2)))
    ham = np.bitwise_count((a ^ b).view(np.uint64)).sum(1)
    assert (np.abs(simhash.embed(a).astype(int) - simhash.embed(b)).sum(1) <= ham).all()


def test_fingerprints_ignore_signs_case_and_order():
    fp, some = simhash.fingerprints(["Alpha, beta gamma.", "gamma ALPHA beta!", None, "", "!!! ?", "alpha beta gamma delta"])
    assert (fp[0] == fp[1]).all() and some.tolist() == [True, True, False, False, False, True]
    long = " ".join(f"w{i}" for i in range(300_000))
    assert simhash.fingerprints([long])[1].all()


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = "z" + "".join(rng.choice("abcdefgh") for _ in range(6))
    return out


def test_near_pairs_recall(spark):
    """At least 0.9 of all pairs within the distance, and no other pair."""
    rng = random.Random(7)
    texts = []
    for _ in range(60):
        base = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(120)]
        texts += [" ".join(edited(rng, base, rng.randint(0, 9))) for _ in range(6)]
    fp, _ = simhash.fingerprints(texts)
    u, at = np.unique(fp, axis=0, return_index=True)
    ham = np.bitwise_count((u[:, None] ^ u[None]).view(np.uint64)).sum(2)
    want = {tuple(sorted((int(at[a]), int(at[b])))): int(ham[a, b]) for a, b in zip(*np.nonzero(ham <= simhash.DISTANCE)) if a < b}
    df = spark.createDataFrame([(int(i), int(x[0]), int(x[1])) for i, x in zip(at, u)], "node bigint, hi bigint, lo bigint")
    got = {(r["a"], r["b"]): r["hamming"] for r in simhash.near_pairs(df, len(u)).collect()}
    assert set(got) <= set(want) and all(want[k] == v for k, v in got.items())
    assert len(want) > 300 and len(got) >= 0.9 * len(want)


def test_one_of_each_group_stays(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(7)) for _ in range(2000)]
    clean = [(i, " ".join(rng.sample(words, 150))) for i in range(30)]
    copies = [(100 + 10 * i + j, " ".join(edited(rng, clean[i][1].split(), 2 * j))) for i in range(5) for j in range(3)]
    docs = frame(spark, clean + copies + [(None, clean[0][1]), (500, None), (501, ""), (502, ""), (503, "?!")])
    got = {r["doc_id"]: r["duplicate_of"] for r in simhash.near_duplicates(clashing(docs)).collect()}
    assert got == {k: (k - 100) // 10 for k, _ in copies}
    kept = simhash.keep_one(clashing(docs))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in kept.collect()) == sorted([-1, *range(30), 500, 501, 502, 503])
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {r["doc_id"] for r in simhash.near_duplicates(odd(spark)).collect()} == {8}


def test_unary_embedding_is_the_manhattan_distance(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(-(1 << 63), 1 << 63, (300, 2), dtype=np.int64)
    b = rng.integers(-(1 << 63), 1 << 63, (300, 2), dtype=np.int64)
    df = spark.createDataFrame([(*map(int, x), *map(int, y)) for x, y in zip(a, b)], "a bigint, b bigint, c bigint, d bigint")
    got = df.selectExpr(f"bit_count({simhash._unary('a')} ^ {simhash._unary('c')}) + bit_count({simhash._unary('b')} ^ {simhash._unary('d')}) as m").collect()
    assert [r["m"] for r in got] == np.abs(simhash.embed(a).astype(int) - simhash.embed(b)).sum(1).tolist()


def test_copies_that_lost_their_shared_lines(spark):
    """After line dedup a near copy has only the lines that were changed; by the originals it goes all the same."""
    rng = random.Random(9)
    docs = [(i, "\n".join(" ".join(words_of(rng, 12)) for _ in range(8))) for i in range(40)]
    for i in range(10):
        lines = docs[i][1].split("\n")
        for j in rng.sample(range(8), 3):
            lines[j] = " ".join(edited(rng, lines[j].split(), 1))
        docs.append((100 + i, "\n".join(lines)))
    df = frame(spark, [*docs, (None, docs[0][1]), (200, None)])
    left = common.written(linededup.dedup_lines(df), "left")
    assert {r["doc_id"] for r in left.collect()} >= set(range(100, 110))
    kept = [r["doc_id"] for r in simhash.keep_one(left, originals=df).collect()]
    assert sorted(x for x in kept if x is not None) == [*range(40), 200]


def test_plan_holds_its_recall():
    for n in (10, 10**5, 10**7, 10**10):
        tables = simhash.plan(n)
        assert all(len(set(t.tolist())) == len(t) <= 30 for t in tables) and len(tables) < 200


def test_copies_beyond_the_close_distance(spark):
    """Copies at 17 to 20 bits go; other texts at that distance stay."""
    rng = random.Random(21)
    base = [words_of(rng, 120) for _ in range(400)]
    texts = [" ".join(w) for w in base] + [" ".join(edited(rng, w, 10)) for w in base]
    fp, _ = simhash.fingerprints(texts)
    ham = np.bitwise_count((fp[:400] ^ fp[400:]).view(np.uint64)).sum(1)
    want = {400 + i for i in np.flatnonzero((ham > simhash.CLOSE) & (ham <= simhash.DISTANCE)).tolist()}
    got = {r["doc_id"]: r["duplicate_of"] for r in simhash.near_duplicates(frame(spark, list(enumerate(texts)))).collect()}
    assert len(want) > 20 and all(k - v == 400 for k, v in got.items()) and len(want & set(got)) >= 0.9 * len(want)
    pairs = spark.createDataFrame([(0, 400), (0, 1)], "a bigint, b bigint")
    assert [tuple(r) for r in simhash._same_words(frame(spark, list(enumerate(texts))), pairs, "text", "doc_id", 0.8).collect()] == [(0, 400)]


def test_no_pair_within_the_distance_is_left_out(spark, monkeypatch):
    """All pairs, also at the distance itself, by the tables for many fingerprints; and their groups, if they are joined at once."""
    rng = np.random.default_rng(31)
    base = rng.integers(0, 2, (300, 128), dtype=np.uint8)
    bits = np.repeat(base, 6, axis=0)
    for row in range(len(bits)):
        bits[row, rng.permutation(128)[: row % 6 * 2]] ^= 1  # two of a base differ in up to 18 bits
    bits[1::6] = base
    for row in range(1, len(bits), 6):
        bits[row, rng.permutation(128)[:20]] ^= 1
    u = np.unique(np.packbits(bits, axis=1).view(np.int64), axis=0)
    ham = np.bitwise_count((u[:, None] ^ u[None]).view(np.uint64)).sum(2)
    want = {(int(a), int(b)): int(ham[a, b]) for a, b in zip(*np.nonzero(ham <= 20)) if a < b}
    df = spark.createDataFrame([(i, int(x[0]), int(x[1])) for i, x in enumerate(u)], "node bigint, hi bigint, lo bigint")
    assert sum(d == 20 for d in want.values()) > 300
    monkeypatch.setattr(simhash, "FEW", 0)
    for group in (8, 500, 8000):
        monkeypatch.setattr(simhash, "GROUP", group)
        assert {(r["a"], r["b"]): r["hamming"] for r in simhash.near_pairs(df, len(u)).collect()} == want
    monkeypatch.setattr(simhash, "_HELD_PAIRS", 10)
    joined = simhash.near_pairs(df, len(u), joined=16).collect()
    close = spark.createDataFrame([p for p, d in want.items() if d <= 16], "a bigint, b bigint")
    roots = lambda x: {r["node"]: r["root"] for r in common.components(x).collect()}
    assert roots(spark.createDataFrame([r[:2] for r in joined if r["hamming"] == 0], "a bigint, b bigint")) == roots(close)
    whole = spark.createDataFrame(list(want), "a bigint, b bigint")
    assert roots(spark.createDataFrame([r[:2] for r in joined], "a bigint, b bigint")) == roots(whole)


def test_plan_deals_out_all_segments():
    for n in (10**5, 10**10):
        tables = simhash.plan(n)
        assert sorted(np.concatenate(tables).tolist()) == list(range(64)) and 2 * len(tables) > simhash.DISTANCE


def test_plan_at_the_distance_itself():
    for n in (10, 10**5, 10**7):
        tables = simhash.plan(n)
        share = 2 * len(tables[0]) / 128
        d = simhash.DISTANCE
        chance = (1 - share) ** d + d * share * (1 - share) ** (d - 1)
        assert 1 - (1 - chance) ** len(tables) >= 0.9


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {x: find(x) for a, b in pairs if a != b for x in (a, b)}
    df = spark.createDataFrame([*pairs, (None, 3)], "a bigint, b bigint")
    assert {r["node"]: r["root"] for r in common.components(df).collect()} == want
    assert common.components(df.limit(0)).count() == 0


def test_components_by_few_jobs_and_by_rounds(spark, monkeypatch):
    """A long chain, whose rounds are many jobs, takes two where edges are few; the rounds give the same."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (500, 500), (None, 7)], "a bigint, b bigint")
    want = {**dict.fromkeys(range(201), 0), 400: 400, 500: 400}
    spark.sparkContext.setJobGroup("few", "")
    assert {r["node"]: r["root"] for r in common.components(edges).collect()} == want
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few")) <= 8
    spark.sparkContext.setJobGroup("rounds", "")
    monkeypatch.setattr(common, "EDGES_IN_TASK", 0)
    assert {r["node"]: r["root"] for r in common.components(edges).collect()} == want
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds")) > 8
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_without_ids_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    ids = spark.createDataFrame([(1,), (1,), (None,)], "doc_id bigint")
    assert sorted(str(r["doc_id"]) for r in common.without_ids(odd(spark), ids).collect()) == sorted(str(r["doc_id"]) for r in odd(spark).collect() if r["doc_id"] != 1)


def classes_brute(x, ids, threshold=0.9):
    """{id: (class, links)} of vectors in the order of their ids."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    root = list(range(len(x)))
    for a, b in zip(*np.nonzero(np.triu(near, 1))):
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    for i in range(len(root)):
        root[i] = root[root[i]]
    return {ids[i]: (ids[root[i]], int(near[i].sum()) - 1) for i in range(len(x))}


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 24))
    for k in range(40):
        x[20 * k : 20 * k + 6] = x[20 * k] + 0.06 * rng.standard_normal((6, 24))
    x[1400:1480] = x[1400] + 0.03 * rng.standard_normal((80, 24))  # saturates the lists
    x[1490] = x[1491]
    rows = [(i, [float(v) for v in x[i]], i % 3) for i in range(1500)]
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 24, 0), (2003, [1.0] * 5, 0), (2004, [float("nan")] * 24, 0), (2005, [None] * 24, 0), (None, [1.0] * 24, 0), (0, [float(v) for v in x[0]], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, id int")
    got = {r["vec_id"]: (r["class_id"], r["links"]) for r in embeddings.near_duplicates(df).collect()}
    want = classes_brute(x, list(range(1500)))
    assert set(got) == set(want) and got[1490] == (1490, 1) == got[1491]
    assert sum(n for _, n in got.values()) >= 0.95 * sum(n for _, n in want.values())
    assert np.mean([got[i] == want[i] for i in want]) >= 0.98 and all(got[i][1] <= want[i][1] for i in want)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def vector_frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<float>")


def test_equal_vectors_far_above_a_group(spark, monkeypatch):
    """All pairs of equal vectors, also where the audit meets none of them."""
    monkeypatch.setattr(embeddings, "GROUP", 8)
    monkeypatch.setattr(embeddings, "AUDIT", 1)
    x = np.random.default_rng(5).standard_normal((700, 24))
    x[400:] = x[400]
    got = {r["vec_id"]: (r["class_id"], r["links"]) for r in embeddings.near_duplicates(vector_frame(spark, x)).collect()}
    assert all(got[i] == (400, 299) for i in range(400, 700)) and all(got[i] == (i, 0) for i in range(400))


def test_parts_of_a_group_meet(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "GROUP", 8)
    rng = np.random.default_rng(6)
    x = rng.standard_normal(24) + 1e-5 * rng.standard_normal((300, 24))
    vecs = common.written(embeddings.vectors(vector_frame(spark, x)), "v")
    assert embeddings._grouped(vecs, 300, 11, 300).select("u", "v").distinct().count() >= 0.95 * 300 * 299


def test_audit_needs_true_edges(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "AUDIT", 1)
    x = np.random.default_rng(7).standard_normal((500, 24))
    x[480:] = x[480] + 1e-3 * np.arange(20)[:, None]
    vecs = common.written(embeddings.vectors(vector_frame(spark, x)).selectExpr("id", "v", "1L as copies"), "v")
    edges = spark.createDataFrame([], "u bigint, v bigint, s float")
    assert embeddings._audit(vecs, edges, 0.9) == 0


def test_last_attempt_is_audited(spark, monkeypatch):
    """Where the descent doesn't converge, the vectors are compared exactly."""
    for name, value in (("ATTEMPTS", 1), ("ROUNDS", 0), ("TABLES", 1), ("GROUP", 4)):
        monkeypatch.setattr(embeddings, name, value)
    rng = np.random.default_rng(8)
    x = np.repeat(rng.standard_normal((150, 24)), 4, axis=0) + 0.15 * rng.standard_normal((600, 24))
    got = {r["vec_id"]: (r["class_id"], r["links"]) for r in embeddings.near_duplicates(vector_frame(spark, x)).collect()}
    want = classes_brute(x, list(range(600)))
    assert sum(n for _, n in want.values()) > 1000 and got == want


def test_bands_are_tuned():
    bands, rows = paragraphs.tune(0.5, 0.9, 3)
    assert 1 - (1 - 0.5**rows) ** bands >= 0.9 > 1 - (1 - 0.5**rows) ** (bands - 1)


def words_of(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n)]


def test_passages(spark):
    rng = random.Random(6)
    base = [words_of(rng, 150) for _ in range(60)]
    passage, line = words_of(rng, 60), words_of(rng, 60)
    docs = []
    for i, w in enumerate(base):
        w = [" ".join(w[:70]), " ".join(w[70:])]
        if i in (3, 17, 40):  # within a line
            w[0] = w[0] + " " + " ".join(passage) + " " + w[1]
        if i in (5, 25):  # a line, edited
            w.append(" ".join(line if i == 5 else [x if k not in (20, 41) else "zz" for k, x in enumerate(line)]))
        if i in (8, 30):  # over two lines
            w[1] = w[1] + " " + " ".join(passage[:20]) + "\n" + " ".join(passage[20:])
        docs.append((i, "\n".join(w)))
    docs += [(70, docs[11][1]), (71, None), (72, ""), (None, docs[0][1]), (73, "short line\nshort line")]
    rows = paragraphs.repeated_passages(clashing(frame(spark, docs))).collect()
    assert {r["doc_id"] for r in rows} == {17, 40, 25, 8, 30, 70}
    assert all(r["duplicate_of"] < r["doc_id"] for r in rows)
    assert {(r["doc_id"], r["duplicate_of"], r["kind"]) for r in rows if r["doc_id"] == 25} >= {(25, 5, "paragraph")}
    assert all(r["duplicate_of"] == 3 for r in rows if r["doc_id"] in (8, 17, 30, 40) and r["kind"] == "segment")
    assert paragraphs.repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {r["doc_id"] for r in paragraphs.repeated_passages(odd(spark)).collect()} <= {4, 5}


def test_runs_over_several_sources(spark):
    """A verbatim repeat is one run although parts of it were first in an edited copy; there, no run is long enough."""
    rng = random.Random(14)
    passage = words_of(rng, 300)
    copy = [words_of(rng, 1)[0] if k % 15 == 7 else x for k, x in enumerate(passage)]
    docs = [(i, " ".join(words_of(rng, 40) + x + words_of(rng, 40))) for i, x in enumerate((copy, passage, passage))]
    rows = paragraphs.repeated_passages(frame(spark, docs)).where("kind = 'segment'").collect()
    assert [r["doc_id"] for r in rows] == [2] and rows[0]["duplicate_of"] in (0, 1)
    assert rows[0]["start_word"] >= 40 and 270 <= rows[0]["n_words"] <= 340 - rows[0]["start_word"]


def test_rows_that_repeat_a_key_keep_their_own_paragraphs(spark):
    rng = random.Random(15)
    other, line = words_of(rng, 60), words_of(rng, 60)
    copy = " ".join(edited(rng, line, 3))
    for first in ([(1, " ".join(other)), (1, " ".join(line))], [(1, " ".join(line)), (1, " ".join(other))]):
        rows = paragraphs.repeated_passages(frame(spark, [*first, (2, copy)])).where("kind = 'paragraph'").collect()
        assert [(r["doc_id"], r["duplicate_of"], r["n_words"]) for r in rows] == [(2, 1, 60)]


def segments_brute(docs):
    """Runs of 20 words or more in which every segment stands in an earlier document, by the definition."""
    places, out = {}, []
    cut = {}
    for d, t in docs:
        h = np.array([paragraphs.words().hash[i] for i in paragraphs.words().index([t])[0]], np.uint64)
        at = paragraphs._cuts(h, np.zeros(len(h), int)).tolist() if len(h) else []
        cut.setdefault(d, []).extend((a, z - a, tuple(h[a:z].tolist())) for a, z in zip(at, [*at[1:], len(h)]))
        for a, _, x in cut[d]:
            places[x] = min(places.get(x, (d, a)), (d, a))
    for d, parts in cut.items():
        run = None
        for a, n, x in sorted(parts):
            if places[x][0] == d:
                continue
            if run and a <= run[1]:
                run[1] = max(run[1], a + n)
            else:
                run = [a, a + n]
                out.append((d, run))
    return sorted((d, a, z - a) for d, (a, z) in out if z - a >= paragraphs.RUN_WORDS)


def test_segments_against_brute_force(spark):
    rng = random.Random(16)
    blocks = [words_of(rng, rng.randint(5, 40)) for _ in range(30)]
    docs = [(i, " ".join(x for b in rng.choices(blocks, k=6) for x in b + words_of(rng, 3))) for i in range(40)]
    docs += [(7, docs[3][1]), (None, docs[0][1]), (50, None), (51, "")]
    got = sorted((r["doc_id"], r["start_word"], r["n_words"]) for r in paragraphs.repeated_passages(frame(spark, docs)).where("kind = 'segment'").collect())
    assert len(got) > 20 and got == segments_brute([d for d in docs if d[0] is not None and d[1]])


def test_near_paragraphs_against_brute_force(spark):
    rng = random.Random(12)
    lines = []
    for _ in range(25):
        w = words_of(rng, 40)
        lines += [" ".join(edited(rng, w, rng.randint(0, 7))) for _ in range(6)]
    lines = list(dict.fromkeys(lines))  # equal ones are one content
    docs = frame(spark, list(enumerate(lines)))
    sets = [{tuple(x.split()[k : k + 3]) for k in range(38)} for x in lines]
    want = {(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines)) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    bands, rows = paragraphs.tune()
    units = common.written(paragraphs.units(docs, bands, rows).where("kind = 0"), "t")
    of = {r["h"]: r["doc"] for r in units.collect()}
    got, led = ({tuple(sorted((of[r["a"]], of[r["b"]]))) for r in paragraphs.near_paragraphs(docs, units, "text", "doc_id", 0.5, paired).collect()} for paired in (paragraphs.PAIRED, 1))
    assert len(want) > 30 and got <= want and len(got) >= 0.9 * len(want)
    # through leaders: fewer links, but everyone that has one keeps one
    assert led <= got and {x for p in led for x in p} == {x for p in got for x in p}
    assert VOCAB and prose(rng, 1)


def test_no_similar_paragraphs_stay_apart(spark):
    """Every pair at the threshold or above by keys of few lines; by larger ones, the same components, also where two groups share a key."""
    rng = random.Random(51)
    lines = []
    for _ in range(40):
        w = words_of(rng, rng.randint(20, 60))
        lines += [" ".join(edited(rng, w, rng.randint(0, len(w) // 8))) for _ in range(5)]
    lines = list(dict.fromkeys(lines))
    sets = [{tuple(x.split()[k : k + 3]) for k in range(len(x.split()) - 2)} for x in lines]
    want = {(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines)) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    docs = frame(spark, list(enumerate(lines)))
    units = common.written(paragraphs.units(docs, 0, 0).where("kind = 0"), "t")
    of = {r["h"]: r["doc"] for r in units.collect()}
    near = lambda paired: {tuple(sorted((of[r["a"]], of[r["b"]]))) for r in paragraphs.near_paragraphs(docs, units, "text", "doc_id", 0.5, paired).collect()}
    assert len(want) > 100 and near(paragraphs.PAIRED) == want
    roots = lambda x: {r["node"]: r["root"] for r in common.components(spark.createDataFrame(sorted(x), "a bigint, b bigint")).collect()}
    for paired in (1, 2, 3):
        led = near(paired)
        assert led <= want and roots(led) == roots(want)


def test_words_are_hashed_without_the_memo():
    """What the memo's hashes are, for all scripts, lengths and signs; paragraphs of ordinary words leave the memo as it is."""
    rng = random.Random(61)
    kinds = ["abcXYZ019_", "aé.È,ßÿ×÷À", "жШaä", "ªµº¹²a", "日本ｘİaσΣς", ".,;-'", "\x00a\x7f_"]
    odd = pa.array(["".join(rng.choices(rng.choice(kinds), k=rng.randint(1, 45))) for _ in range(20_000)])
    memo = words.Words()
    number, _ = memo.index(odd)
    assert (words.hashes(odd) == memo.hash[number]).all() and (words.hashes(odd.slice(777, 50)) == memo.hash[number[777:827]]).all()
    assert len(words.hashes(pa.array([], pa.string()))) == 0
    text = "\n".join(" ".join(words_of(rng, 30)) + " Éléphant, d'été." for _ in range(50))
    known = len(words.words().memo)
    of, flat, line = paragraphs._lines(pa.array([text, None, "", text]))
    assert len(of) == 50 and len(flat) == len(line) and len(words.words().memo) == known
