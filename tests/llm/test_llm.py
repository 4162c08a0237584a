"""Each operator against a plain version, and on odd input."""

import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallyridge.llm import blocks, bpe, common, itq, langid, line_templates, minhash, packing, pieces, pii, quality_model, quality_rules, queries, records
from tallyridge.llm.common import Scratch
from tallyridge.llm.graph import components

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "a", "it's  a\n\ntest .. x", "é ü 中文 ١٢٣  x", "x" * 3000, "word " * 700, "a\tb\r\nc\0d", "'s 'll <|endoftext|>", "  lead", "trail \n "]
SCHEMA = "doc_id long, text string, lang string, n_tokens string, kept string, score string"


def frame(spark, texts, ids=None):
    """Documents with columns whose names clash with those of results."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "x", "y", "z") for i, t in zip(ids, texts)], SCHEMA)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("chunk, overlap, spread", [(2_048, 256, 65_536), (16, 6, 65_536), (7, 3, 65_536), (16, 6, 40), (512, 4, 64)])
def test_bpe_is_that_of_the_library_for_any_chunks(spark, chunk, overlap, spread):
    import public_tokenizers

    encoding = bpe.load_encoding(public_tokenizers.path(bpe.DEFAULT_VOCAB), public_tokenizers.PATTERN)
    texts = ODD + ["He said: 'don't'   stop\n\n\n now 123,456 " * 9, "y" * 300 + " then words " * 20 + " " * 200 + "end. " * 30]
    back = bpe.decode(bpe.encode(frame(spark, texts), chunk_chars=chunk, overlap=overlap, spread_chars=spread)).collect()
    assert len(back) == len(texts)
    for r in back:
        text = texts[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == encoding.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()


def test_pieces_between_stitches_are_small_but_for_long_tokens():
    import public_tokenizers

    found = bpe.compiled(public_tokenizers.PATTERN)
    text = "some words, here 12 " * 2000
    parts = list(bpe.stitched(text, found, 512, 64))
    assert "".join(parts) == text and len(parts) > 70 and max(map(len, parts)) <= 512 + 64
    text = "a b " * 500 + "z" * 5000 + " c d" * 500
    parts = list(bpe.stitched(text, found, 512, 64))
    assert "".join(parts) == text and sum(len(p) > 576 for p in parts) == 1 and len(parts) >= 4


def test_bpe_keeps_null_and_repeated_ids_and_takes_empty_tables(spark):
    assert bpe.digests(frame(spark, ["a", "a", "b"], [1, 1, None])).count() == 3
    assert bpe.digests(frame(spark, [])).count() == 0


def test_bpe_gives_long_texts_their_own_ids_whatever_the_order_of_a_second_scan(spark):
    import os

    import public_tokenizers
    import pyarrow as pa

    def shuffled(batches):
        for b in batches:
            order = np.random.default_rng(int.from_bytes(os.urandom(8), "little")).permutation(len(b))
            yield b.take(pa.array(order))

    encoding = bpe.load_encoding(public_tokenizers.path(bpe.DEFAULT_VOCAB), public_tokenizers.PATTERN)
    texts = [f"text {k} of some words, " * (20 + k) for k in range(40)]
    docs = frame(spark, texts).select("doc_id", "text").coalesce(1).mapInArrow(shuffled, "doc_id long, text string")
    got = bpe.encode(docs, spread_chars=100).collect()
    assert len(got) == len(texts)
    assert all(np.frombuffer(r["ids"], "<u4").tolist() == encoding.encode_ordinary(texts[r["doc_id"]]) for r in got)


def test_pieces_are_the_ids_of_whole_texts():
    plain = Tokenizer.from_file(pieces.default_path())
    texts = [t or "" for t in ODD] + ["x.\ny, z. 'tis a. ،. .", "ªº. ʰ, 中文."]
    encoder = pieces.PieceEncoder(pieces.default_path(), most=5)
    for _ in range(2):
        assert [a.tolist() for a in encoder.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_are_held_apart_from_the_symbols_after_them():
    plain = Tokenizer.from_file(pieces.default_path())
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.choice('aeöñ')}rd{rng.choice(['', '%', ',###', '...', '&&', ')', chr(39) + 's', '1'])}" for _ in range(300)) for _ in range(20)]
    texts += ["a <|endoftext|> b", "a<|endoftext|>b%%%", "a<|endoftext", "x|>", "e\u0301a", "a\u00a0b", "a'sb"]
    encoder = pieces.PieceEncoder(pieces.default_path())
    assert [a.tolist() for a in encoder.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert len([p for p in encoder.known if p.startswith(" w")]) == 4


def test_records_round_trip_in_order_and_shuffled(spark):
    texts, ids = ODD + ["tie", "tie"], [*range(len(ODD) - 1, -1, -1), 50, 50]
    root = Scratch(spark).path("r")
    docs = frame(spark, texts, [None if i == 3 else i for i in ids])
    shards = records.write(docs, root)
    got = sorted(records.read(spark, root, shards).collect(), key=lambda r: r["start"])
    assert [r["id"] for r in got] == [None, *sorted(i for i in ids if i != 3)]
    at = 0
    plain = Tokenizer.from_file(pieces.default_path())
    by_id = dict(zip([None if i == 3 else i for i in ids], texts))
    for r in got:
        want = plain.encode(by_id[r["id"]] or "", add_special_tokens=False).ids + [0]
        assert r["start"] == at and np.frombuffer(r["ids"], "<u4").tolist() == want
        at += len(want)
    again = records.read(spark, root, shards, seed=5).collect()
    assert sorted((r["start"], bytes(r["ids"])) for r in again) == sorted((r["start"], bytes(r["ids"])) for r in got)
    assert records.digests(spark, frame(spark, []), Scratch(spark).path("e")).count() == 0


def test_records_of_one_id_are_split(spark, tmp_path):
    texts = ["same text"] * 400 + [f"license {k}" for k in range(400)]
    setting = "spark.sql.adaptive.coalescePartitions.enabled"  # would join what is small here
    spark.conf.set(setting, "false")
    try:
        shards = records.write(frame(spark, texts, [None] * 800), f"file://{tmp_path}/one_id")
    finally:
        spark.conf.unset(setting)
    assert max(s["records"] for s in shards) < 500 and sum(s["records"] for s in shards) == 800


def test_a_damaged_record_is_noticed():
    import io

    data = bytearray(records.frame(b"payload"))
    assert records.read_frame(io.BytesIO(data)) == b"payload"
    data[14] ^= 1
    with pytest.raises(records.BadRecord):
        records.read_frame(io.BytesIO(data))


def brute_cuts(points, costs, size):
    best = [0.0] + [np.inf] * (len(points) - 1)
    for j in range(1, len(points)):
        for i in range(j):
            if 0 < (n := points[j] - points[i]) <= size:
                pad = 0 if n == size // 2 else size - n
                best[j] = min(best[j], best[i] + pad + costs[j])
    return best[-1]


def test_cuts_are_the_best(spark):
    rng = random.Random(3)
    for _ in range(60):
        points = [0]
        while len(points) < 30:
            points.append(points[-1] + rng.randrange(1, 9))
        costs = [0.0] + [rng.choice([0.0, 2.0, 6.0]) for _ in points[1:]]
        cuts = packing.best_cuts(points, costs, 16)
        total, at = 0.0, 0
        for j in cuts:
            n = points[j] - points[at]
            assert 0 < n <= 16
            total, at = total + (0 if n == 8 else 16 - n) + costs[j], j
        assert at == len(points) - 1 and abs(total - brute_cuts(points, costs, 16)) < 1e-9


@pytest.mark.parametrize("block", [1 << 18, 4096])
def test_packing_holds_every_id_once(spark, corpus, block):
    texts = ODD + [r["text"] for r in corpus.limit(120).collect()] + ["many words here. " * 4000]
    rows = packing.pack(frame(spark, texts), block=block).toPandas()
    plain = Tokenizer.from_file(pieces.default_path())
    for doc_id, g in rows.sort_values("start").groupby("doc_id"):
        ids = np.array(plain.encode(texts[doc_id] or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for p in g.itertuples():
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    lengths = rows.groupby("sequence_id").length.sum()
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.r_[0, g.length.cumsum()[:-1]]).all()
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in lengths)
    assert lengths.max() <= 1024 and rows.doc_id.nunique() == len(texts) and padding < 0.03 * lengths.sum() + 4 * 1024
    assert packing.pack(frame(spark, [])).count() == 0


def test_line_dedup_keeps_the_first_and_generalises(spark):
    mit = "Released under the MIT License."
    form = "Dear reader number {} please find our {} offer below today"
    texts = [f"one {k} own words here alone\n{mit}\n{form.format(k, w)}\n" for k, w in enumerate(["red", "blue", "green", "grey"])]
    got = {r["doc_id"]: r["text"] for r in line_templates.dedup(spark, frame(spark, texts + [None, ""])).collect()}
    assert got[0] == texts[0] and got[4] is None and got[5] == ""
    assert all(mit not in got[k] and "offer" not in got[k] for k in (1, 2, 3))
    out = line_templates.dedup(spark, frame(spark, texts))
    assert out.columns == frame(spark, texts).columns
    assert line_templates.digests(spark, frame(spark, [])).count() == 0
    rows = line_templates.digests(spark, frame(spark, [mit, mit, mit, mit], [1, 1, None, 2])).collect()
    assert sorted((r["doc_id"] or -1, r["n_dropped"]) for r in rows) == [(-1, 1), (1, 0), (1, 0), (2, 1)]


def test_lines_recur_over_documents_not_within_one(spark):
    own = "this line stands twice in one document"
    table = [f"item {k} of the list costs {k * 3} coins" for k in range(9)]
    shared = "a line that just two documents share"
    texts = [f"{own}\n{own}\n{own}", "\n".join(table), f"first {shared}\n{shared}", f"{shared}\nother words stand here"]
    got = {r["doc_id"]: r["text"] for r in line_templates.dedup(spark, frame(spark, texts)).collect()}
    assert got == {0: texts[0], 1: texts[1], 2: texts[2], 3: "other words stand here"}
    # a template of variable fields needs three documents
    many = ["\n".join(table[:4]), "\n".join(table[4:7]), "\n".join(table[7:])]
    got = {r["doc_id"]: r["text"] for r in line_templates.dedup(spark, frame(spark, many)).collect()}
    assert got == {0: many[0], 1: "", 2: ""}
    got = {r["doc_id"]: r["text"] for r in line_templates.dedup(spark, frame(spark, many[:2])).collect()}
    assert got == {0: many[0], 1: many[1]}


def test_line_dedup_matches_sql_on_odd_rows(spark):
    import duckdb

    rng = random.Random(12)
    form = ["dear {} we sell {} and {} today", "{} {} {} stays the same here", "log {} user {} came from {}"]
    line = lambda: rng.choice(form).format(*(rng.choice(["a", "b", "c", rng.randrange(9)]) for _ in range(3)))
    texts = ["\n".join(line() for _ in range(rng.randrange(0, 6))) for _ in range(60)] + [None, "", "\n\n", "x " * 5000 + "\n" + line()]
    docs = frame(spark, texts, [None if k % 11 == 0 else k % 50 for k in range(len(texts))])
    con = duckdb.connect()
    documents = docs.select("doc_id", "text").toPandas()
    con.register("frame_", documents)
    con.sql("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM frame_")
    got = line_templates.digests(spark, docs)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({line_templates.oracle_sql()})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    out = line_templates.dedup(spark, docs)
    assert out.columns == docs.columns and out.count() == len(texts)


def test_rules_by_hand(spark):
    text = "a b c a b c d\nx\nx\n \n \nA*"
    r = quality_rules.with_metrics(frame(spark, [text, None, " "]).select("doc_id", "text")).orderBy("doc_id").collect()
    assert [r[0][c] for c in ("n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words")] == [10, 11, 1, 1, 4, 1, 6]
    assert r[1]["n_words"] == r[2]["n_words"] == 0 and quality_rules.judge(spark, frame(spark, []), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_repeats_match_a_plain_count(spark):
    rng = random.Random(1)
    texts = [" ".join(words(rng, rng.randrange(0, 60), 4)) for _ in range(60)]
    for r in quality_rules.with_metrics(frame(spark, texts).select("doc_id", "text")).collect():
        w = texts[r["doc_id"]].split()
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        assert r["n_repeat_words"] == len({j for k, g in enumerate(grams) if grams.count(g) > 1 for j in (k, k + 1, k + 2)})


def test_repeats_of_long_texts_take_linear_time(spark):
    text = " ".join(f"w{k}" for k in range(100_000))
    r = quality_rules.with_metrics(frame(spark, [f"{text} {text}", "a " * 200_000]).select("doc_id", "text")).orderBy("doc_id").collect()
    assert [(x["n_words"], x["n_repeat_words"]) for x in r] == [(200_000, 200_000), (200_000, 200_000)]


def good_rows(spark, n, symbols=lambda k: 0, words=lambda k: 100):
    rows = [Row(doc_id=k, n_words=words(k), word_chars=500, n_symbols=symbols(k), n_capitals=1, n_lines=4, n_dup_lines=0, n_repeat_words=0) for k in range(n)]
    return spark.createDataFrame(rows), spark.createDataFrame([(k, 1) for k in range(n)], "doc_id long, quality int")


def test_thresholds_are_only_chosen_with_enough_evidence(spark):
    good, labels = good_rows(spark, 400)
    found = lambda n, **more: quality_rules.thresholds(good, labels.where(f"doc_id < {n}"), **more).first()["level"]
    # .95 ** 85 > .05 / 4 >= .95 ** 86
    assert found(85) is None and found(86) == quality_rules.LEVELS - 1
    assert quality_rules.thresholds(good, labels.limit(0)).count() == 0
    # rows that repeat an id are no further trials
    assert quality_rules.thresholds(good.unionByName(good), labels.where("doc_id < 85")).select("level", "n").first() == (None, 85)


def test_thresholds_reject_no_more_than_the_risk(spark):
    from math import comb

    # a sixteenth of the good ones has 4 per cent of symbols, which the last steps would reject
    good, labels = good_rows(spark, 800, lambda k: 20 if k % 16 == 0 else 0)
    level = quality_rules.thresholds(good, labels).first()["level"]
    cutoffs = quality_rules.ladder(60, 1)
    assert cutoffs[level] >= 4 > cutoffs[level + 1]
    # as many as the exact tail allows
    tail = lambda k: sum(comb(800, i) * 0.05**i * 0.95 ** (800 - i) for i in range(k + 1))
    most = max(k for k in range(40) if tail(k) <= 0.05 / 4)
    for k, step in ((most, quality_rules.LEVELS - 1), (most + 1, level)):
        some, _ = good_rows(spark, 800, lambda i, k=k: 20 if i < k else 0)
        assert quality_rules.thresholds(some, labels).first()["level"] == step


def test_a_stratum_that_is_done_leaves_its_part_to_others(spark):
    # .95 ** 80 lies between a quarter and a third of .05
    words = lambda k: 100 if k < 100 else 300
    good, labels = good_rows(spark, 180, words=words)
    assert {r["stratum"]: r["level"] for r in quality_rules.thresholds(good, labels).collect()} == {0: 9, 1: 9}
    good, labels = good_rows(spark, 80, words=lambda k: 300)
    assert {r["stratum"]: r["level"] for r in quality_rules.thresholds(good, labels).collect()} == {1: None}


def test_rules_act_on_labelled_documents(spark):
    """Rejected by the method, beyond the base rules: bad documents, and hardly a good one."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.judge(spark, docs, labels).join(labels, "doc_id").where("NOT base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in rows}
    assert n[0, False] > 20 and n.get((1, False), 0) < 0.02 * n[1, True]


def test_rules_keep_odd_rows_and_columns(spark):
    texts = [None, "", "word " * 60, " ".join(f"w{k}" for k in range(60)), " ".join(f"w{k}" for k in range(60))]
    docs = frame(spark, texts, [1, 2, None, 3, 3]).withColumn("n_words", F.lit("own")).withColumn("stratum", F.lit(1))
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1)], "doc_id long, quality int")
    kept = quality_rules.keep(spark, docs, labels)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [3, 3]
    assert quality_rules.keep(spark, docs.limit(0), labels).count() == 0 and quality_rules.judge(spark, docs, labels).count() == 5


def test_binomial_tail(spark):
    from math import comb, log

    rows = spark.createDataFrame([(k, n) for n in (1, 5, 40) for k in range(n + 1)], "k long, n long")
    for r in rows.withColumn("t", quality_rules.log_binomial_tail(F.col("k"), F.col("n"), 0.07)).collect():
        assert abs(r["t"] - log(sum(comb(r["n"], i) * 0.07**i * 0.93 ** (r["n"] - i) for i in range(r["k"] + 1)))) < 1e-9


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    a, b = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    key = lambda d: sorted(map(repr, d[sorted(d.columns)].astype(object).itertuples(index=False, name=None)))
    assert key(a) == key(b)


def brute_components(sets, percent):
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, j in combinations(sorted(sets), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = find(i), find(j)
            top[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("shingle, block", [(2, None), (5, None), (2, 4), (5, 3)])
def test_near_duplicates_are_those_of_all_pairs(spark, shingle, block, monkeypatch):
    rng = random.Random(7)
    if block:  # groups are then split into blocks that meet in pairs
        monkeypatch.setattr(minhash, "SIGN_BLOCK", block)
        monkeypatch.setattr(minhash, "SET_BLOCK", block)
    texts = []
    for _ in range(25):
        base = words(rng, rng.randrange(20, 90))
        for _ in range(rng.randrange(1, 9)):
            copy = [w if rng.random() > 0.03 else f"m{rng.randrange(10**6)}" for w in base]
            texts.append(" ".join(copy[: len(copy) - rng.randrange(0, 6)]))
    texts += [None, "", " \t", "One", "one", "a b", "A  B", texts[0], texts[0].upper()]
    sets = {}
    for k, t in enumerate(texts):
        w = (t or "").lower().split()
        sets[k] = {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else ({tuple(w)} if w else set())
    want = brute_components(sets, 80)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(spark, frame(spark, texts), shingle=shingle).collect()}
    assert len(got) == len(texts)
    for k, r in got.items():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[k]), want[k], want[k] == k)


def test_pairs_of_blocks_meet_all_members_once(spark):
    rows = spark.range(60).select((F.col("id") % 4 == 0).cast("int").alias("g"), F.col("id").alias("m"))
    dealt = blocks.block_pairs(rows, "g", "m", 7, Scratch(spark), "b")
    met: dict = {}
    for (g, i, j), left, right in blocks.met(iter(dealt.select("g", "i", "j", "left", "m").coalesce(1).sortWithinPartitions("g", "i", "j").toArrow().to_batches()), "g", ("m",)):
        for a in left:
            for b in right:
                if i != j or a[0] < b[0]:
                    key = g, min(a[0], b[0]), max(a[0], b[0])
                    met[key] = met.get(key, 0) + 1
    want = {(g, a, b) for g in (0, 1) for a in range(60) for b in range(a + 1, 60) if (a % 4 == 0) == (b % 4 == 0) == bool(g)}
    assert set(met) == want and set(met.values()) == {1} and dealt.where("i <> j").count() > 60


def test_near_duplicates_of_odd_rows(spark):
    assert minhash.near_duplicates(spark, frame(spark, [])).count() == 0
    got = minhash.near_duplicates(spark, frame(spark, ["a b c", "a b c", "a b c", "x y"], [4, 4, None, 9]), shingle=2).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in got) == [(-1, None, True), (4, 4, True), (4, 4, True), (9, 9, True)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [tuple(rng.sample(range(200, 300), 2)) for _ in range(60)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark), "t").collect()}
    sets = {}
    for u, v in edges:
        if u != v:
            merged = sets.get(u, {u}) | sets.get(v, {v})
            for n in merged:
                sets[n] = merged
    assert got == {n: min(s) for n, s in sets.items()}


def test_pii_patterns_match_plain_regular_expressions():
    import re

    rng = random.Random(4)
    plain = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]
    for _ in range(4000):
        text = "".join(rng.choice("a1@.+- (2é9)") for _ in range(rng.randrange(1, 40)))
        want = [("email", *m.span()) for m in plain[0].finditer(text)]
        want += [("ip", *m.span()) for m in plain[1].finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
        digits = lambda m: re.sub("[^0-9]", "", m.group())
        want += [("card", *m.span()) for m in plain[2].finditer(text) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        want += [("phone", *m.span()) for m in plain[3].finditer(text) if 8 <= len(digits(m)) <= 15]
        assert pii.base_spans(text) == want


def test_pii_carries_evidence_to_similar_tokens(spark, corpus):
    texts = [f"Call +1 (386) 555-{k:04d} or, later on, just 386 555 {k:04d} please" for k in range(40)] + ["Nothing in 2024, 15 items", None, "", "9" * 5000 + "@" * 50]
    got = {r["doc_id"]: r for r in pii.find(spark, frame(spark, texts)).collect()}
    for k in range(40):
        assert [s["kind"] for s in got[k]["base"]] == ["phone"] and [s["kind"] for s in got[k]["spans"]] == ["phone"] * 2
    assert all(not got[k]["spans"] for k in (40, 41, 42)) and pii.digests(spark, frame(spark, [])).count() == 0
    clean = pii.redact(spark, frame(spark, texts))
    assert clean.columns == frame(spark, texts).columns and clean.where("doc_id = 3").first()["text"] == "Call <phone> or, later on, just <phone> please"


@pytest.mark.parametrize("repeats", [19, 50])
@pytest.mark.parametrize("lean", [0.0, 2.0])
def test_pii_carries_evidence_to_all_repeats(repeats, lean):
    field = pii.learn([])
    field.unary[0, 0] = lean  # towards nothing
    for text in ("call +1 212 555 0147 now, " + "or take 212-555-0147 again, " * repeats, "or take 212-555-0147 again, " * repeats + "call +1 212 555 0147 now"):
        base, spans = pii.all_spans(text, field, 0.9)
        assert len(base) == 1 and len(spans) == repeats + 1 and {s[0] for s in spans} == {"phone"}
    # links stay linear, and messages settle
    found = pii.nodes(text, base)
    assert len(pii.similar_pairs(found)) <= 2 * len(found)
    assert np.allclose(field.posteriors(found), field.posteriors(found, 200), atol=1e-3)


def test_pii_takes_all_findings_of_a_chunk():
    numbers = [f"212 555 {k:04d}" for k in range(40)]
    text = "call +1 " + ", +1 ".join(numbers) + " at noon. " + " ".join(f"or then {n} it is." for n in numbers)
    base, spans = pii.all_spans(text, pii.learn([]), 0.9)
    assert len(base) == 40 and len(spans) == 80
    found = pii.nodes(text, base)
    assert [n.label for n in found] == [pii.LABELS.index("phone")] * 40 + [0] * 40


def test_long_runs_take_linear_time():
    from time import monotonic

    began = monotonic()
    base, spans = pii.all_spans("write to a@b.example " + "x" * 1_000_000, pii.learn([]), 0.9)
    assert len(base) == len(spans) == 1
    packer = packing.Packer(1024, np.zeros(9, bool), 1 << 18, 16)
    pieces_seen = sum(1 for k in range(500_000) for _ in packer.add(k, np.array([0], np.uint16)))
    while packer.held:
        pieces_seen += sum(1 for _ in packer.flush())
    model = langid.build({"x": "abab" * 50})
    model.predict(["a" * 1_000_000, "ab c " * 200_000])
    assert pieces_seen == 500_000 and monotonic() - began < 60


def test_chunks_are_runs_of_tokens_with_marks():
    import re

    plain = re.compile(r"[^\s]*[0-9@][^\s]*(?:\x20[^\s]*[0-9@][^\s]*)*")
    rng = random.Random(9)
    for _ in range(3000):
        text = "".join(rng.choice("a1@ \n  b") for _ in range(rng.randrange(0, 40)))
        assert [m.span() for m in plain.finditer(text)] == list(pii.chunks(text))


def all_labellings(field, found):
    """Marginals of each chunk, by enumeration."""
    from itertools import product

    k = len(pii.LABELS)
    unary = np.stack([field.unary[n.features].sum(axis=0) for n in found])
    total = np.zeros((len(found), k))
    pairs = pii.similar_pairs(found)
    for y in product(range(k), repeat=len(found)):
        if any(n.label and n.label != v for n, v in zip(found, y)):
            continue
        score = sum(unary[i, v] for i, v in enumerate(y)) + sum(field.chain[a, b] for a, b in zip(y, y[1:])) + sum(field.skip[y[i], y[j]] for i, j in pairs)
        for i, v in enumerate(y):
            total[i, v] += np.exp(score)
    return total / total.sum(axis=1, keepdims=True)


def test_beliefs_are_near_those_of_all_labellings():
    rng = np.random.default_rng(3)
    texts = ["call +1 212 555 0147 now, or take 212-555-0147 or room 12 today", "a@b.example then 44 then a@b then 44 then 212 555 0147", "7 of 9 of 7"]
    for text in texts:
        field = pii.learn([])
        field.unary += rng.normal(0, 0.1, field.unary.shape)
        field.chain += rng.normal(0, 0.1, field.chain.shape)
        found = pii.nodes(text, pii.base_spans(text))
        assert 2 < len(found) < 7 and np.abs(field.posteriors(found) - all_labellings(field, found)).max() < 0.1


def test_pii_learns_from_the_whole_text(spark):
    text = "see 12 of them " * 2000 + "and write to a@b.example now " * 500
    chain, skip, examples = pii.counted(pii.nodes(text, pii.base_spans(text)))
    assert chain.sum() == 2499 and skip.trace() == 2 * (1999 + 499)
    assert len(examples) == pii.MOST_EXAMPLES and 40 < sum(y == 1 for _, y in examples) < 120
    assert pii.fit(frame(spark, [text, text])).chain[1, 1] > 0


def test_samples_are_bounded_for_any_ids(spark):
    rows = spark.range(6000).selectExpr("cast(null as string) as id", "case when id % 3 = 0 then 'one 1' else concat('text ', id) end as text")
    order = common.row_order("id", "text").alias("order")
    assert 60 < common.bounded_sample(rows.select(order, "text"), 100).count() < 150
    assert common.bounded_sample(rows.limit(50).select(order, "text"), 100).count() == rows.limit(50).distinct().count()
    repeated = rows.selectExpr("'a' as id", "'one 1' as text")
    assert common.bounded_sample(repeated.select(order, "text"), 100).count() == 1


def plain_phrases(text, reference):
    """A phrase ends at the first byte with which it is no longer in the reference, and begins anew there if that byte is."""
    ended, phrase = 1, b""
    for c in (bytes([c]) for c in bytes(text)):
        if phrase + c in reference:
            phrase += c
        else:
            ended, phrase = ended + 1, c if c in reference else b""
    return ended


@pytest.mark.parametrize("block", [7, 64, 1024])
def test_cross_parsing_counts_the_phrases_of_a_plain_parse(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    rng = random.Random(6)
    references = {k: " ".join("".join(rng.choice(a) for _ in range(rng.randrange(1, 6))) for _ in range(300)) for k, a in {"x": "abcde", "y": "cdefgh", "z": "aé中b"}.items()}
    model = langid.build(references)
    texts = ["".join(rng.choice("aabcdef é中gh") for _ in range(rng.randrange(1, 300))) for _ in range(60)] + ["a" * 400, "ab" * 300, "q", "a"]
    held = [bytes(model.symbols(references[k])) for k in model.languages]
    rows = [model.symbols(t) for t in texts]
    assert model.phrases(rows).tolist() == [[plain_phrases(row, r) for r in held] for row in rows]
    assert model.phrases([]).shape == (0, 3)


def test_cross_parsing_predicts():
    model = langid.build({"x": "abab" * 50, "y": "cdcd" * 50})
    assert model.predict(["abab", "dcd", None, "", "12 !"])[0] == ["x", "y", "und", "und", "und"]
    # a tie goes to the first of both
    assert langid.build({"b": "abc", "a": "abc"}).predict(["abc"])[0] == ["a"]


def test_languages_of_many_scripts_differ():
    latin = "".join(map(chr, [*range(97, 123), *range(0xE0, 0xF7), *range(0x101, 0x180, 2)]))
    ranges = {"zh": (0x4E00, 400), "ja": (0x5200, 400), "am": (0x1200, 60), "gothic": (0x10330, 20), "osage": (0x104D8, 30), "ru": (0x430, 32)}
    rng = random.Random(8)
    alphabets = {"la": latin, **{k: "".join(map(chr, range(lo, lo + n))) for k, (lo, n) in ranges.items()}}
    lexicon = {k: ["".join(rng.choice(a) for _ in range(rng.randrange(2, 6))) for _ in range(150)] for k, a in alphabets.items()}
    # two languages of one rare script
    lexicon["gothic2"] = ["".join(rng.choice(alphabets["gothic"]) for _ in range(4)) for _ in range(150)]
    text = lambda k, n: " ".join(rng.choice(lexicon[k]) for _ in range(n))
    model = langid.build({k: text(k, 3000 if k == "la" else 400) for k in lexicon})
    names = [k for k in lexicon for _ in range(5)]
    assert model.predict([text(k, 30) for k in names])[0] == names


def test_references_take_pieces_of_many_texts():
    assert langid.pieces(["a" * 1000, "b" * 10, "c" * 1000], 110) == "a" * 50 + "\n" + "b" * 10 + "\n" + "c" * 50
    assert langid.pieces(["a" * 5, "b" * 7], 110) == "aaaaa\nbbbbbbb" and langid.pieces([], 9) == ""


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.held_out_predictions(spark, docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (rows.lang == rows.lang_pred).mean() > 0.97 and rows.score.between(0, 1).all()
    assert langid.held_out_predictions(spark, docs.limit(0)).count() == 0
    nulls = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r[0] for r in langid.held_out_predictions(spark, nulls).select("lang_pred").distinct().collect()} == {"und"}


def test_languages_are_learned_from_anywhere_in_texts(spark):
    """Every text begins in one language, whatever its own; references from the heads of texts would all be in that one."""
    rng = random.Random(3)
    lexicon = {k: ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 8))) for _ in range(300)] for k, letters in (("aa", "abcdeo"), ("bb", "bdfgiu"), ("cc", "hklmai"))}
    text = lambda k, n: " ".join(rng.choice(lexicon[k]) for _ in range(n))
    rows = [(i, text("aa", 60) + "\n" + text(k, 900), k) for i, k in enumerate(["aa", "bb", "cc"] * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    tests = [(k, text(k, 40)) for k in lexicon for _ in range(20)]
    assert [k for k, _ in tests] == model.predict([t for _, t in tests])[0]
    cut = docs.select(langid.cut_piece(F.col("text"), F.col("doc_id"), F.lit(100)).alias("piece"), "text").collect()
    starts = [r["text"].index(r["piece"]) / len(r["text"]) for r in cut]
    assert all(len(r["piece"]) == 100 for r in cut) and min(starts) < 0.1 and max(starts) > 0.8 and 0.35 < sum(starts) / len(starts) < 0.65
    assert spark.range(1).select(langid.cut_piece(F.lit("short"), F.lit(5), F.lit(100)), langid.cut_piece(F.lit(""), F.lit(5), F.lit(9))).first()[:] == ("short", "")


def test_line_dedup_is_linear_in_a_document(spark):
    import time

    shared = "\n".join(f"shared line number k{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}{chr(97 + k // 17576)} here" for k in range(200_000))
    long = " ".join(["word"] * 3 + [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}" for k in range(200_000)])
    texts = [shared, "own first line of it\n" + shared + "\nown last line of it", *(long + f" end{c}" for c in "abcd")]
    began = time.time()
    got = {r["doc_id"]: r for r in line_templates.dedup(spark, frame(spark, texts), counts=True).collect()}
    assert time.time() - began < 90
    assert got[0]["text"] == shared and got[1]["text"] == "own first line of it\nown last line of it" and got[1]["n_dropped"] == 200_000
    assert [got[k]["n_dropped"] for k in range(2, 6)] == [0, 1, 1, 1]


def test_lines_between_lost_ones(spark):
    cases = [("a\nb\nc", [1]), ("a\nb\nc", [0, 1, 2]), ("a", [0]), ("a\n\nb\n", [1]), ("a\nb", [0]), ("\n\n", [0, 2]), ("x\ny\nz\nw", [1, 2])]
    rows = spark.createDataFrame(cases, "text string, lost array<int>").select("text", "lost", line_templates.without(F.col("text"), F.col("lost")).alias("left")).collect()
    assert [r["left"] for r in rows] == ["\n".join(w for k, w in enumerate(t.split("\n")) if k not in lost) for t, lost in cases]


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_model.held_out_scores(spark, docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (rows.quality == rows.predicted).mean() > 0.95 and rows.score.between(0, 1).all()
    none = quality_model.held_out_scores(spark, frame(spark, [None, "", "a"]).select("doc_id", "text", "score"), labels.limit(0)).collect()
    assert [r["score"] for r in none] == [0.5] * 3


def test_quality_of_odd_rows(spark):
    good, bad = "plain words of a calm text stand here", "### %%% zq zq !!! &&&"
    texts = [None, "", "  ", *[good, bad] * 40, f"{good} " * 20_000, good, good]
    ids = [*range(len(texts) - 3), None, 5, 5]
    docs = frame(spark, texts, ids).withColumn("quality", F.lit("own")).withColumn("label", F.lit(3))
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(3, 83)] + [(4, 1, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality_model.held_out_scores(spark, docs, labels).collect()
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    one = [r["score"] for r in rows if r["doc_id"] in (5, None)]
    assert max(one) - min(one) < 1e-9  # equal texts, and their repetition, have one score
    assert quality_model.held_out_scores(spark, docs.limit(0), labels).count() == 0


def test_random_indexing_adds_up_the_neighbours_of_all_documents(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "b", "cat", "Dog", "e9", "zz"]) for _ in range(rng.randrange(0, 30))) for _ in range(50)] + [None, "", "rare"]
    docs = frame(spark, texts).repartition(7)
    names = quality_model.vocabulary(docs, "text", 4, 3)
    count = lambda u: sum((t or "").split().count(u) for t in texts)
    words_only = [u for u in names if not u.startswith("~")]
    assert words_only == sorted(words_only, key=lambda u: (-count(u), u)) and len(words_only) == 4 and {"~x"} <= set(names)
    units, size, buckets = quality_model.Units(names, buckets=5), 12, 5
    index = np.append(quality_model.index_vectors(tuple(names), size, 4), np.zeros((1, size)), axis=0)
    want = np.zeros((len(names) + 1 + buckets, size))
    for t in texts:
        named, shared = units.of(t or "")
        for i in range(len(named)):
            around = sum((index[named[j]] for j in range(max(0, i - 2), min(len(named), i + 3)) if i != j), np.zeros(size))
            want[named[i]] += around
            if shared[i] >= 0:
                want[len(names) + 1 + shared[i]] += around
    got = quality_model.context_vectors(docs, "text", names, size, 4, 2, buckets)
    assert np.array_equal(got, np.delete(want, len(names), axis=0))
    assert all((b < 0) == (w in names) for w in ("a", "b", "cat", "Dog", "e9", "zz", "rare") for b in units.of(w)[1])
    # a document is the sum of its units' vectors over its words
    vectors = np.random.default_rng(0).normal(size=(len(names) + 1 + buckets, size))
    named, shared = units.of("a b cat rare e9")
    total = vectors[named].sum(axis=0) + vectors[len(names) + 1 + shared[shared >= 0]].sum(axis=0)
    assert np.allclose(quality_model.Model(names, vectors).pooled(units, ["a b cat rare e9", None]), [total / 5, np.zeros(size)])


def test_shapes_are_those_of_all_characters():
    rng = random.Random(5)
    letters = "abzABZéÉßǅ中١9.,!-ªﬁⅣ"
    found = [w for w in ("".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(20_000))] + ["Word", "word.", "WORD", "x", "X", ".", "élan,", "Élan", "ab" * 40]
    assert all(quality_model.shape(w) == quality_model.kinds_of(w) for w in found)


def test_quality_that_only_rare_words_tell(spark):
    """All frequent words are the same in both classes, and all words have one shape; each rare word occurs in few documents."""
    rng = random.Random(8)
    common = [f"com{a}{b}" for a in "abcdefgh" for b in "ijklm"]
    rare = {q: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(150)] for q in (0, 1)}
    text = lambda q: " ".join(rng.choice(rare[q]) if rng.random() < 0.3 else rng.choice(common) for _ in range(60))
    rows = [(i, text(i % 2), i % 2) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = quality_model.fit(spark, docs, docs.where("doc_id < 700"), most_words=40, most_shapes=5)
    assert set(model.names) <= {*common, "~x"}
    scored = quality_model.score(spark, model, docs.where("doc_id >= 700")).toPandas()
    assert ((scored.score >= 0.5) == (scored.label == 1)).mean() > 0.9


def test_gradients_are_those_of_differences():
    rng = np.random.default_rng(2)
    z, y, decay = rng.normal(size=(30, 5)), rng.integers(0, 2, 30).astype(float), 0.01
    weights = [rng.normal(size=(5, 4)), rng.normal(size=4), rng.normal(size=4), np.array(0.3)]

    def loss(w):
        logits = np.tanh(z @ w[0] + w[1]) @ w[2] + w[3]
        return np.mean(np.logaddexp(0, np.where(y == 1, -1, 1) * logits)) + decay / 2 * ((w[0] ** 2).sum() + (w[2] ** 2).sum())

    for k, g in enumerate(quality_model.gradients(weights, z, y, decay)):
        for at in np.ndindex(weights[k].shape):
            up, down = [w.copy() for w in weights], [w.copy() for w in weights]
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            assert abs((loss(up) - loss(down)) / 2e-6 - np.asarray(g)[at]) < 1e-7


def test_the_temperature_is_that_of_least_loss():
    rng = np.random.default_rng(4)
    logits = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-logits))).astype(float)
    assert 2.4 < quality_model.best_temperature(3 * logits, y) < 3.7


def brute_links(units):
    linked = units @ units.T >= 0.95
    np.fill_diagonal(linked, False)
    return linked


def test_embeddings_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 16))
    rows = np.concatenate([base, np.repeat(base[:20], 12, axis=0) + rng.normal(size=(240, 16)) * 0.12, base[:3], base[:2] * 3]).astype(np.float32)
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [1.0] * 5, [float("inf")] * 16]
    values = [r.tolist() for r in rows] + odd
    table = spark.createDataFrame([(k, v, "x", 0.5) for k, v in enumerate(values)], "vec_id long, embedding array<float>, kept string, n_links double")
    units = rows.astype(float)
    linked = brute_links(units / np.linalg.norm(units, axis=1, keepdims=True))
    for block in (1 << 14, 8):  # the second deals buckets in pairs of blocks
        monkeypatch.setattr(itq, "BLOCK", block)
        got = {r["vec_id"]: r for r in itq.near_duplicates(spark, table).collect()}
        assert len(got) == len(values)
        found = sum(got[k]["n_links"] for k in range(len(rows)))
        assert found >= 0.98 * linked.sum() and all(got[k]["n_links"] <= linked[k].sum() for k in range(len(rows)))
        assert all((got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True) for k in range(len(rows), len(values)))
    assert itq.near_duplicates(spark, table.limit(0)).count() == 0


def test_embeddings_of_few_coordinates_and_repeated_ids(spark):
    rng = np.random.default_rng(6)
    for size in (1, 2, 3):
        x = rng.normal(size=(120, size))
        table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
        want = brute_links(x / np.linalg.norm(x, axis=1, keepdims=True)).sum(axis=1)
        got = {r["vec_id"]: r["n_links"] for r in itq.near_duplicates(spark, table).collect()}
        assert sum(got.values()) >= 0.98 * want.sum() and all(got[k] <= want[k] for k in got)
    x = [[1.0, 2.0, 3.0]] * 2
    table = spark.createDataFrame([(7, x[0]), (7, x[1]), (None, x[0]), (9, [2.0, 4.0, 6.1]), (9, [0.0, -1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in itq.near_duplicates(spark, table).collect())
    assert got == [(0, 0, None, True), (7, 1, 7, True), (7, 1, 7, True), (9, 0, 7, False), (9, 1, 7, False)] or got == [(0, 0, None, True), (7, 1, 7, True), (7, 1, 7, True), (9, 1, 7, False), (9, 1, 7, False)]


def around_a_mean(n, size, mean_cosine, seed):
    """Unit vectors with a common mean, and for each one at cosine 0.9505 that has the same mean."""
    rng = np.random.default_rng(seed)
    axis = np.linalg.qr(rng.normal(size=(size, 1)))[0][:, 0]
    off = lambda x: (x - (x @ axis)[:, None] * axis)
    scaled = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    z = scaled(off(rng.normal(size=(n, size))))
    other = off(rng.normal(size=(n, size)))
    other = scaled(other - (other * z).sum(axis=1, keepdims=True) * z)
    rho = (0.9505 - mean_cosine) / (1 - mean_cosine)
    place = lambda x: np.sqrt(mean_cosine) * axis + np.sqrt(1 - mean_cosine) * x
    return place(z), place(rho * z + np.sqrt(1 - rho * rho) * other)


@pytest.mark.parametrize("mean_cosine", [0.0, 0.5, 0.8])
def test_tables_suffice_with_a_common_mean(mean_cosine):
    x, y = around_a_mean(6000, 64, mean_cosine, 3)
    codes = itq.learned(x, 60_000, cosine=0.95, bucket=2048, miss=0.005)
    (own, h), (other, g) = codes.of(x), codes.of(y)
    apart = np.bitwise_count((h ^ g).view(np.uint64)).sum(axis=1)
    assert codes.bits >= itq.LEAST_BITS and ((own == other).any(axis=1) & (apart <= codes.radius)).mean() >= 0.98
    if mean_cosine == 0:
        assert codes.radius < 40  # far fewer than the half that vectors without relation differ in


def test_embeddings_with_a_common_mean_find_their_pairs(spark):
    x, y = around_a_mean(1000, 64, 0.9, 5)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(np.concatenate((x, y)))], "vec_id long, embedding array<double>")
    both = np.concatenate((x, y))
    want = ((both @ both.T) >= 0.95).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in itq.near_duplicates(spark, table).collect()}
    found = np.array([got[k] for k in range(len(both))])
    assert want.min() >= 1 and (found <= want).all() and found.sum() >= 0.98 * want.sum()


def test_pipeline_decides_as_plain_versions_do(spark, corpus):
    docs, sf = corpus, "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas().set_index("doc_id")
        docs = Scratch(spark).table(stage(spark, docs, sf), name)
        after = docs.toPandas()
        if name == "windows":
            assert set(after.doc_id) == set(before.index) and after.groupby("doc_id").length.sum().eq(after.groupby("doc_id").doc_tokens.first()).all()
            continue
        assert docs.columns == corpus.columns
        after = after.set_index("doc_id")
        if name == "quality":
            counted = {k: t.split() for k, t in before.text.items()}
            assert all(counted[k] for k in after.index) and len(after) < len(before)
        elif name == "near_duplicates":
            sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for k, w in ((k, t.lower().split()) for k, t in before.text.items())}
            want = brute_components(sets, 80)
            assert set(after.index) == {k for k in sets if want[k] == k}
        elif name == "personal_data":
            assert not any(pii.base_spans(t) for t in after.text) and set(after.index) == set(before.index)



@pytest.fixture(scope="module")
def odd_corpus(spark, tmp_path_factory):
    """Documents with nulls in every column, empty and long texts, repeated rows, ties, and columns of clashing names."""
    good = lambda k: " ".join(f"w{k}x{i}" for i in range(70))
    texts = [None, "", " \n ", "word", good(1), good(1), good(1), good(2), good(2) + " more", "long " * 100 + good(3) * 300, good(4) + "\nwrite to a@b.example or 10.0.0.1", "y" * 200_000, good(5), good(5)]
    ids = [1, 2, 3, 4, 5, 6, 6, 7, 8, 9, 10, 11, None, None]
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k}", None if k % 5 == 0 else len(t or ""), "x", 1, "y") for k, (i, t) in enumerate(zip(ids, texts))]
    path = tmp_path_factory.mktemp("odd")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string, row int, kept string")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(5, 1, 0), (None, None, None), (5, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    docs.limit(0).write.parquet(f"{path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/none/labels.parquet")
    return str(path)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, odd_corpus, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{odd_corpus}/documents.parquet")
    out = stage(spark, docs, odd_corpus)
    rows = out.collect()
    if name != "windows":
        assert out.columns == docs.columns
    texts = [r["text"] for r in rows] if name != "windows" else []
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    if name == "quality":  # no words: rejected
        assert not {1, 2, 3} & set(by_id) and {4, 5, 6, 7, 8, 11, None} <= set(by_id) and len(by_id[6]) == 2
    elif name == "lines":  # without a word: gone; repeated ids are one document, as are null ones
        assert not {1, 2, 3, 6} & set(by_id) and len(by_id[5]) == 1 and len(by_id[None]) == 2
    elif name == "near_duplicates":
        assert {1, 2, 3, 4, 5, 7, 9, 10, 11, None} == set(by_id) and len(by_id[None]) == 2
    elif name == "personal_data":
        assert len(rows) == 14 and by_id[10][0]["text"].endswith("write to <email> or <ip>") and by_id[1][0]["text"] is None
    else:
        assert len({(r["doc_id"], r["doc_tokens"], r["ids_crc32"]) for r in rows}) >= 10 and {r["start"] for r in by_id[1]} == {0}
    none = stage(spark, spark.read.parquet(f"{odd_corpus}/none/documents.parquet"), f"{odd_corpus}/none")
    assert none.count() == 0 and (name == "windows" or none.columns == docs.columns)
