"""Periodic runs, vantage-point trees and whitening against plain versions, and on odd input."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tallyridge.llm import queries, runs, vantage, whitening
from tallyridge.llm.common import Scratch

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, id string, start string, length string"
VECTORS = "vec_id long, embedding array<float>, id string, score string, component string, row string"


def frame(spark, texts, ids=None):
    """Documents with columns whose names clash with those of results."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in zip(ids, texts)], DOCS)


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "a", "b", "c", "d") for i, v in rows], VECTORS)


def plain_runs(words, least=12):
    """All maximal stretches of every period, of one stretch the smallest."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def random_documents(rng, many):
    for _ in range(many):
        n, v = rng.randrange(0, 130), rng.choice([1, 2, 2, 3, 5, 60])
        words = [b"w%d" % rng.randrange(v) for _ in range(n)]
        if n > 3 and rng.random() < 0.5:
            a = rng.randrange(n)
            p = rng.randrange(1, max(2, (n - a) // 2 + 1))
            words = words[:a] + (words[a : a + p] * n)[: n - a]
        if rng.random() < 0.3:
            words = words + words[: rng.randrange(n + 1)] + [b"x"] + words
        yield words


@pytest.mark.parametrize("least", [12, 2, 5, 21])
def test_runs_are_those_of_a_plain_search(least):
    rng = random.Random(least)
    for _ in range(60):
        documents = list(random_documents(rng, rng.randrange(1, 6)))
        assert runs.find(documents, least) == [plain_runs(d, least) for d in documents]


def test_runs_of_nested_and_touching_periods():
    inner = ([b"a", b"b"] * 8 + [b"c"]) * 3
    for words in (inner, inner[5:] + inner, [b"a"] * 40, [b"x"] * 11, ([b"p", b"q", b"r"] * 5 + [b"p", b"p"] * 7) * 2, [b"u%d" % (k % 37) for k in range(500)]):
        assert runs.find([words, inner], 12) == [plain_runs(words), plain_runs(inner)]


def test_runs_of_long_texts_take_seconds():
    import time

    began = time.time()
    words = [b"w%d" % (k * k % 7919) for k in range(55_433)]
    assert runs.find([words * 4])[0] == [(0, 221_732, 7919)] and runs.find([[b"a"] * 300_000])[0] == [(0, 300_000, 1)]
    assert time.time() - began < 30


def plain_digest(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    drop = {k for a, length, q in found for k in range(a + q, a + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    digest = lambda s: hashlib.sha256(s).hexdigest()
    return (
        doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
        digest("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()), digest(b" ".join(w for k, w in enumerate(words) if k not in drop)),
    )


def test_run_digests_and_odd_texts(spark):
    texts = [None, "", " \n\t ", "a", "é  ü x y", "go on " * 30, "a b c d e f g h i j k l\n" * 2, "x " * 11, "tie", "tie"] + [" ".join(f"w{k * j % 23}" for k in range(140)) for j in range(1, 60)]
    ids = [*range(len(texts) - 3), None, 7, -20]
    got = sorted(map(tuple, runs.digests(frame(spark, texts, ids)).collect()), key=repr)
    assert got == sorted((plain_digest(i, t) for i, t in zip(ids, texts)), key=repr)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in ids if i is not None) > 2
    assert runs.digests(frame(spark, [])).count() == 0


def test_runs_and_collapsed_texts(spark):
    docs = frame(spark, ["so " + "ha hi " * 8 + "end", None, "plain text"], [1, 2, None])
    assert [tuple(r) for r in runs.periodic_runs(docs).collect()] == [(1, 1, 16, 2)]
    assert sorted((r["text"], r["doc_id"]) for r in runs.collapsed(docs).collect()) == [("", 2), ("plain text", None), ("so ha hi end", 1)]


def test_run_query_over_the_given_documents(spark):
    got = {r["doc_id"]: tuple(r) for r in queries.op11_periodic_runs(spark, SF).collect()}
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    some = [d for d in docs if len((d[1] or "").split()) < 700]
    assert len(got) == len(docs) and len(some) > 100 and all(got[i] == plain_digest(i, t) for i, t in some)


def plain_nearest(rows, k, every):
    """By sums in the order of the operator's own, so that ties are ties."""
    fine = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v))]
    out = []
    for i, q in fine:
        if i % every == 0:
            near = sorted((-float((x * q).sum()), j) for j, x in fine if j != i and len(x) == len(q))
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(near[:k])]
    return sorted(out)


def result(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("shard, block, leaf", [(16_384, 16_384, 64), (70, 9, 4), (200, 50, 1)])
def test_factor_one_is_exact(spark, shard, block, leaf):
    rng = np.random.default_rng(0)
    rows = [(k, rng.normal(size=8) * rng.uniform(0.2, 3) + (k % 3)) for k in range(260)]
    rows += [(300 + k, np.round(rng.normal(size=8))) for k in range(60)] + [(400 + k, np.eye(8)[k % 2]) for k in range(90)]
    rows += [(None, [1.0] * 8), (900, None), (901, []), (902, [0.0] * 8), (903, [1.0] * 7 + [None]), (904, [float("nan")] * 8), (905, [float("inf")] + [1.0] * 7), (1000, [1.0, 2.0]), (1010, [1.0, -2.0])]
    rows = [(i, None if v is None else list(v)) for i, v in rows]
    got = result(vantage.nearest(spark, vectors(spark, rows), k=7, every=10, factor=1.0, shard=shard, block=block, leaf=leaf))
    assert got == plain_nearest([(i, v) for i, v in rows], 7, 10)


def test_ties_and_copies_go_to_smaller_ids(spark):
    rows = [(k, [1.0, 0.0] if k % 3 else [0.0, 1.0]) for k in range(400)]
    got = result(vantage.nearest(spark, vectors(spark, rows), shard=90, leaf=2, factor=1.0))
    assert got == plain_nearest(rows, 20, 20)
    assert result(vantage.nearest(spark, vectors(spark, [(20, [1.0]), (20, [2.0]), (3, [5.0])]), factor=1.0)) == [(20, 1, 3, 5.0), (20, 1, 3, 10.0)]
    assert vantage.nearest(spark, vectors(spark, [])).count() == 0


@pytest.mark.parametrize("kind", ["even", "tight", "loose"])
def test_recall_of_the_tuned_factor_and_pruning(spark, kind):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6_000, 64))
    if kind == "even":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    else:
        x = rng.normal(size=(20, 64))[rng.integers(0, 20, 6_000)] + {"tight": 0.02, "loose": 0.3}[kind] * x
    x = x.astype(np.float32)
    got = result(vantage.nearest(spark, vectors(spark, list(enumerate(x.tolist()))), shard=2_500))
    scores = x[::20].astype(float) @ x.T.astype(float)
    scores[np.arange(300), np.arange(0, 6_000, 20)] = -np.inf
    brute = {(20 * a, int(i)) for a in range(300) for i in np.argsort(-scores[a])[:20]}
    assert len(got) == len(brute) and len({r[::2] for r in got} & brute) >= 0.95 * len(brute)
    tree = vantage.build(np.arange(6_000), x, 20)
    exact, relaxed = (vantage.Search(tree, np.arange(0, 6_000, 20), x[::20], 20, f) for f in (1.0, 8.0))
    assert {(20 * a, i) for a, i, _ in exact.run()} == brute and list(relaxed.run())
    assert relaxed.visited < exact.visited <= 300 * 6_000


def test_many_ties_are_cut_as_they_come():
    old, vantage.HELD = vantage.HELD, 500
    try:
        x = np.concatenate((np.eye(40), np.zeros((300, 40)) + np.arange(1, 301)[:, None] * (np.arange(40) == 39))).astype(np.float32)
        ids = np.arange(len(x))[::-1].copy()
        got = list(vantage.Search(vantage.build(ids, x, 5, 2), ids[:30], x[:30], 5, 1.0).run())
    finally:
        vantage.HELD = old
    for a in range(30):
        assert [i for q, i, s in got if q == a] == [0, 1, 2, 3, 4] and all(s == 0 for q, i, s in got if q == a)


def plain_whitening(rows, most=16):
    x = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(np.int64) + 1_000_000) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    fit = np.unique(np.stack([v for _, v in x]), axis=0)
    n, total = len(fit), [int(s) for s in fit.sum(axis=0)]
    centred = fit - fit.mean(axis=0)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    deviation = [sum((n * int(a) - s) ** 2 for a, s in zip(v, total)) for _, v in x]
    return x, n, deviation, (np.stack([v for _, v in x]) - fit.mean(axis=0)) @ u / np.sqrt(e), e / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("size, many", [(5, 400), (24, 1_000), (40, 90)])
def test_whitening_is_that_of_the_covariance(spark, size, many):
    rng = np.random.default_rng(size)
    rows = [(k, list(rng.normal(size=size) * np.linspace(1, 9, size) + 3)) for k in range(many)]
    rows += rows[:50] + [(None, rows[3][1]), (7_000, None), (7_001, rows[0][1][:-1] + [None]), (7_002, [float("nan")] * size)]
    x, n, deviation, want, explained = plain_whitening(rows)
    df = whitening.whiten(spark, vectors(spark, rows).repartition(11))
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = df.collect()
    assert len(got) == len(x) * min(16, size) and {r["n"] for r in got} == {n} and all(r["identity_error"] < 1e-9 for r in got)
    assert len({r["identity_error"] for r in got}) == 1 and sum(r["vec_id"] is None for r in got) == min(16, size)
    for c in range(min(16, size)):
        own = {(r["vec_id"]): r for r in got if r["component"] == c + 1 and r["vec_id"] is not None}
        sign = np.sign(own[0]["whitened"] * want[0, c])
        for at, (i, _) in enumerate(x):
            if i is not None:
                assert abs(own[i]["whitened"] - sign * want[at, c]) < 1e-8 and own[i]["deviation"] == deviation[at]
                assert abs(own[i]["explained"] - explained[c]) < 1e-9


def test_whitening_of_odd_vectors(spark):
    assert whitening.whiten(spark, vectors(spark, [])).count() == 0 and whitening.whiten(spark, vectors(spark, [(1, None), (2, [])])).count() == 0
    got = whitening.whiten(spark, vectors(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got] == [(1, 0, None, None, 0.0)] * 4
    got = whitening.whiten(spark, vectors(spark, [(1, [1.0, 3.0]), (2, [2.0, 3.0]), (3, [4.0, 3.0]), (4, [1.0] * 3)])).collect()
    flat = [r for r in got if r["vec_id"] < 4]
    assert {r["component"]: r["explained"] for r in flat} == {1: 1.0, 2: 0.0} and all((r["whitened"] is None) == (r["component"] == 2) for r in flat)
    assert {r["n"] for r in flat} == {3} and len([r for r in got if r["vec_id"] == 4]) == 3


def test_factors_merge_in_a_tree(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1_000, 6))
    parts = [whitening.factor_row(6, k, whitening.reduced([x[k::100]])).to_pydict() for k in range(100)]
    table = spark.createDataFrame([(6, k, bytearray(p["r"][0])) for k, p in enumerate(parts)], "size int, slot long, r binary")
    scratch = Scratch(spark)
    r = whitening.tree_merged(scratch, scratch.table(table, "factors-0"))[6]
    assert r.shape == (6, 6) and np.allclose(r.T @ r, x.T @ x)


def test_sums_and_deviations_are_exact_for_large_entries(spark):
    rows = [(k, [2.0**33 + 64 * k, -1.5]) for k in range(4)]
    got = {r["vec_id"]: (r["n"], r["deviation"]) for r in whitening.whiten(spark, vectors(spark, rows)).collect()}
    x = [int(np.floor(64 * np.float64(np.float32(v[0])))) for _, v in rows]
    n, total = len(set(x)), sum(set(x))
    assert {k: v for k, v in got.items()} == {k: (n, (n * x[k] - total) ** 2) for k in range(4)}


def test_queries_over_the_given_embeddings(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got, want = result(queries.op12_vantage_point_trees(spark, SF)), plain_nearest(rows, 20, 20)
    assert len(got) == len(want) and len({r[::2] for r in got} & {r[::2] for r in want}) >= 0.95 * len(want)
    assert queries.op13_tsqr_whitening(spark, SF).count() == 16 * len([v for _, v in rows if v])
