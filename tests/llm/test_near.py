"""Components, MinHash, embeddings and the pipeline against brute force."""

import random
from collections import Counter

import numpy as np

from gridloom.llm import common, embeddings, minhash
from gridloom.llm.words import Hashes, shingles


def classes_of(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)] + [(5, 5), (None, 3)]
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [x for x in links if None not in x and x[0] != x[1]]
    assert got == classes_of({n for x in real for n in x}, real)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    x = rng.integers(1, 2**63, 300).astype(np.uint64)
    wa, wb = rng.integers(0, 4, 300), rng.uniform(0, 4, 300)
    sign = minhash.dart_signatures([(x[wa > 0], wa[wa > 0]), (x, wb), (x[:1], np.array([1]))], 2048)
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((sign[0] == sign[1]).mean() - true) < 0.05
    alone = minhash.dart_signatures([(x, wb)], 2048)
    assert (alone[0] == sign[1]).all()


def jaccard(x, y):
    x, y = Counter(x.tolist()), Counter(y.tolist())
    return (x & y).total() / max((x | y).total(), 1)


def brute(rows, threshold=0.8):
    h = Hashes()
    own = {}
    for i, t in rows:
        if i is not None:
            own.setdefault(i, []).append(shingles(h.of(t or "")))
    links = [(a, b) for a in own for b in own if a < b and any(jaccard(x, y) >= threshold for x in own[a] for y in own[b])]
    return classes_of(own, links)


def copies(rng):
    rows = []
    for g in range(40):
        w = [f"{rng.choice('abcdefgh')}{rng.randrange(500)}" for _ in range(rng.choice([3, 8, 60, 300]))]
        for _ in range(rng.choice([1, 2, 5, 30])):
            v = list(w)
            for _ in range(rng.choice([0, 0, 1, 1, 4])):
                v[rng.randrange(len(v))] = "edit" + str(rng.randrange(9))
            rows.append((len(rows) * 7 % 1009, " ".join(v) + rng.choice([".", "", " !"])))
    return rows


def test_similarity_is_weighted_jaccard():
    rng = np.random.default_rng(5)
    for _ in range(50):
        x, y = (rng.integers(1, 9, rng.integers(0, 40)).astype(np.uint64) for _ in range(2))
        assert minhash.similarity(minhash.numbered(x), minhash.numbered(y)) == jaccard(x, y)


def test_large_buckets_lose_no_link(spark):
    """A chain of edits of which no leader reaches the ends, and outliers that link only with each other, all in large buckets."""
    rng = random.Random(3)
    w = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for k in range(150):
        w[k] = f"x{k}"
        if k % 2:
            rows.append((k, " ".join(w)))
    base = [f"v{rng.randrange(10**6)}" for _ in range(300)]
    for k in range(60):
        v = list(base)
        for at in rng.sample(range(300), 7) if k % 3 else range(0, 300, 40 + k % 7):
            v[at] = f"y{k}-{at}"
        rows.append((1000 + k, " ".join(v)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for most in (4, 256):  # long lists are dealt with in several levels
        assert {r["doc_id"]: r["class_id"] for r in minhash.classes(df, small=2, most=most).collect()} == want


def family(n, rng):
    """Copies of one text of which about half link with it and the rest with nothing, or now and then with another copy."""
    base = [f"b{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for k in range(n):
        v = list(base) if k % 10 or not rows else rows[rng.randrange(len(rows))][1].split()
        for at in rng.sample(range(200), rng.randrange(1, 7)):
            v[at] = f"e{k}-{at}"
        rows.append((k, " ".join(v)))
    return rows


def test_work_grows_in_proportion_to_a_group(spark, monkeypatch):
    """What each step writes for a group of near copies grows with the group, not with its square; no link is lost."""
    made = []
    for n in (200, 400):
        rows = family(n, random.Random(n))
        written = []
        original = common.checkpoint

        def counting(df, original=original, written=written):
            out = original(df)
            written.append(out.count())
            return out

        monkeypatch.setattr(minhash, "checkpoint", counting)
        got = {r["doc_id"]: r["class_id"] for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        monkeypatch.setattr(minhash, "checkpoint", original)
        want = brute(rows)
        assert sum(got[k] != want[k] for k in want) <= 0.01 * n
        made.append(max(written))
    assert made[1] <= 2.6 * made[0]


def test_checkpoints_are_deleted(spark):
    t = common.checkpoint(spark.range(5))
    path = t._written
    import os

    assert os.path.exists(path)
    common.forget(t, None)
    assert not os.path.exists(path)


def test_minhash_against_brute_force(spark):
    rows = copies(random.Random(6))
    rows += [(2000, None), (2001, ""), (2002, "?!"), (2003, "one"), (2004, "One"), (None, "x"), (2005, "same line here again\n" * 2000)] + rows[:3]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, bands string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(df).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    assert sum(got[k] != want[k] for k in want) <= 0.01 * len(want)
    assert got[2001] == 2001 and got[2004] == 2003
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in minhash.classes(df.limit(50)).collect())
    assert minhash.classes(df.limit(0)).count() == 0


def test_minhash_query(spark, tiny):
    docs = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    assert {r["doc_id"]: r["class_id"] for r in minhash.op7_minhash_dedup(spark, tiny).collect()} == brute(docs)


def vectors(rng):
    rows, n = [], 0
    for _ in range(30):
        c = rng.standard_normal(16)
        for _ in range(rng.choice([1, 2, 6, 60])):
            rows.append((n * 13 % 2003, (c + rng.standard_normal(16) * rng.choice([0.01, 0.05, 0.12])).tolist()))
            n += 1
    same = rng.standard_normal(16).tolist()
    rows += [(3000 + k, same) for k in range(40)] + [(3100, [2 * x for x in same])]
    rows += [(4000, None), (4001, [0.0] * 16), (4002, [float("nan")] + [1.0] * 15), (4003, [None] + [1.0] * 15), (4004, []), (4005, [1.0, 2.0]), (4006, [2.0, 4.0]), (4007, [float("inf")] + [1.0] * 15)]
    return rows


def test_embeddings_against_brute_force(spark):
    rows = vectors(np.random.default_rng(8))
    df = spark.createDataFrame([(i, v, 1) for i, v in [*rows, (None, [1.0] * 16), rows[0]]], "vec_id long, embedding array<double>, x int")
    got = {r["vec_id"]: r for r in embeddings.near_dups(df).collect()}
    good = {}
    for i, v in rows:
        x = np.array([np.nan if y is None else y for y in v or [0.0]], float)
        if np.isfinite(x).all() and np.abs(x).sum() > 0:
            good[i] = x / np.linalg.norm(x)
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.95]
    want = classes_of({i for i, _ in rows}, links)
    n = {i: 0 for i, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    assert set(got) == set(want)
    assert sum(got[i]["component_id"] != want[i] or got[i]["n_links"] != n[i] for i in want) <= 0.02 * len(want)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert embeddings.near_dups(df.limit(0)).count() == 0


def linked_exactly(rows):
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    ids = [i for i, _ in rows]
    return classes_of(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(near)), strict=True)]), dict(zip(ids, near.sum(1).tolist(), strict=True))


def test_embeddings_link_groups_beyond_full_lists(spark):
    """Two groups whose members all have more partners in their own than a list holds, and links to the other."""
    rng = np.random.default_rng(11)
    a, b = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
    centres = a, 0.97 * a + np.sqrt(1 - 0.97**2) * b
    rows = [(2 * k + g, (centres[g] + rng.standard_normal(64) * 0.0125).tolist()) for g in (0, 1) for k in range(200)]
    rows += [(1000 + k, rng.standard_normal(64).tolist()) for k in range(100)]
    want, n = linked_exactly(rows)
    assert len(set(want.values())) == 101
    got = {r["vec_id"]: r for r in embeddings.near_dups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want and {i: r["n_links"] for i, r in got.items()} == n


def test_embeddings_lose_no_isolated_pair(spark):
    """Pairs just above the threshold among random vectors, of which two rounds from six trees miss some."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((8000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(0, 1000, 2):
        side = x[k + 1] - (x[k + 1] @ x[k]) * x[k]
        x[k + 1] = 0.952 * x[k] + np.sqrt(1 - 0.952**2) * side / np.linalg.norm(side)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    want, n = linked_exactly(rows)
    assert sum(n.values()) == 1000
    got = {r["vec_id"]: r for r in embeddings.near_dups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want and {i: r["n_links"] for i, r in got.items()} == n


def test_components_meet_in_small_leaves(spark):
    """Leaves that are split, dealt out by hash and hold several vector lengths; one round against brute force, without lists and audit."""
    rng = np.random.default_rng(13)
    x = rng.standard_normal((1200, 24))
    x[600:] = x[:600] + rng.standard_normal((600, 24)) * 0.18
    x[:80] = x[0] + rng.standard_normal((80, 24)) * 1e-9
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(k, 24, v.tobytes(), k) for k, v in enumerate(x)] + [(2000 + k, 2, np.array([1.0, k / 1e6]).tobytes(), 2000 + k) for k in range(40)]
    named = spark.createDataFrame(rows, "id long, dim int, x binary, component long")
    trees = embeddings.trees_for(0.95, 10, 1e-3)
    found = [tuple(r) for r in embeddings.bridges(named, 0.95, 4, trees, 1, 16).collect()]
    near = x @ x.T >= 0.95
    true = {(a, b) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)}
    assert 300 < len(true) and all((min(p), max(p)) in true or min(p) >= 2000 for p in found)
    got, want = classes_of([r[0] for r in rows], found), classes_of([r[0] for r in rows], [*true, *((2000, 2000 + k) for k in range(1, 40))])
    assert sum(got[k] != want[k] for k in got) <= 0.01 * len(got)
    audited = embeddings.merged(spark.createDataFrame([], "id long, component long"), named.drop("component"), 0.95, 16, 0.5, 5000)
    several = {k for k in want if list(want.values()).count(want[k]) > 1}
    assert {r["id"]: r["component"] for r in audited.collect()} == {k: want[k] for k in several}


def test_pipeline(spark, tiny):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    extra = spark.createDataFrame([(None, None, None, None, None), (900001, "", "en", "s", 0), (900002, "token=abcdefgh12", "en", "s", 16)], docs.schema)
    docs = docs.unionByName(extra)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tiny)
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert out.where("doc_id is null").count() == 1 and out.where("doc_id = 900001").count() == 1
            if name == "secrets":
                assert out.where("doc_id = 900002").first()["text"] == "[SECRET]" and out.where("doc_id = 900002").first()["n_chars"] == 8
            else:
                assert out.join(docs, "doc_id", "left_anti").where("doc_id is not null").count() == 0
                assert out.subtract(docs).count() == 0
            docs = spark.createDataFrame(out.collect(), out.schema)
        else:
            assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}
    assert corpus_pipeline.run(spark, tiny).count() > 0
