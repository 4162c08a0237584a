"""Near-duplicates by an inverted join over signature coordinates.

A document is its set of word shingles. Documents of equal sets form a class, and one of each class
goes on. Its MinHash signature is posted under each coordinate-value pair. Pairs of documents that agree
in at least ``least`` of the ``coords`` coordinates share a posting among the ``coords - least + 1``
rarest of each (prefix merging), so the common postings are never paired; sizes that cannot
reach the threshold are skipped. Collisions are then counted over whole signatures, pairs above the
match threshold are confirmed on full sets, and components are taken of confirmed links.

So that a large group of near copies makes no row per pair, work goes in two rounds. Each posting has a
centre, the document on it that shares most of its coordinates. First each document is confirmed
against its best centre, and components are taken of these links. Then, exactly, the members of a centre's postings
that lie in different components are compared block by block: signatures tell which members have a
candidate in another component at all, and the full sets of those alone meet, again in blocks, of which spanning forests come out.
What is of one component is never compared, so that copies fall away before their texts are fetched.

A pair at a similarity of just 0.8 is missed with a probability of about 1e-5 by the match threshold, any
closer pair with less. Null and empty texts have no shingles and link with nothing. Rows
without an id link with nothing and are kept. Rows that repeat an id count as one document that holds the links of all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyridge.llm.blocks import block_pairs, met
from tallyridge.llm.common import Scratch, sized_batches
from tallyridge.llm.graph import components
from tallyridge.llm.itq import forest

COORDS, LEAST = 48, 26
#: Into so many parts the pairs of one centre are dealt for confirmation.
SALTS = 256
#: Members of a group in a block, by signatures and by full sets; shingles of a block of full sets; members compared at a time.
SIGN_BLOCK, SET_BLOCK, SET_SHINGLES, STEP = 8_192, 2_048, 1 << 21, 1_024


class WordHashes(dict):
    """64-bit hashes of words, held up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, shingle: int, known: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; A-Z are folded, and fewer words than a shingle has are one."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(shingle, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(words) - size + 1 + k]
    return np.unique(mixed(total))


def hash_parameters(coords: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_601)
    return rng.integers(0, 2**63, coords, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, coords, np.uint64)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The upper half of the least hash of each coordinate."""
    least = np.full(len(a), 2**64 - 1, np.uint64)
    for lo in range(0, len(shingles), 1024):
        block = shingles[lo : lo + 1024]
        np.minimum(least, (block[None, :] * a[:, None] + b[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def sketches(docs: DataFrame, shingle: int, coords: int) -> DataFrame:
    """``(id, n, key, sig)``: key is a 128-bit hash of the set; null without shingles."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("sig", pa.list_(pa.int32()))])

    def run(batches):
        known, (a, b) = WordHashes(), hash_parameters(coords)

        def each():
            for batch in batches:
                for doc_id, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                    found = shingle_set(text, shingle, known)
                    if len(found):
                        yield 6 * coords, (doc_id, len(found), xxhash.xxh3_128_digest(found.tobytes()), signature(found, a, b))
                    else:
                        yield 0, (doc_id, 0, None, None)

        return sized_batches(each(), schema)

    return docs.mapInArrow(run, "id long, n long, key binary, sig array<int>")


def confirmed(docs: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those ``(a, b)`` of ``pairs`` whose full sets are similar enough.

    The texts of a centre ``a`` and of its partners meet in a task, the centre's first; the partners of one
    centre are dealt into SALTS parts, and a task holds one centre at a time. Texts are shuffled whatever the number
    of pairs, so that cost and plan are alike at every size.
    """
    salt = F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt")
    partners = pairs.select("a", salt, F.lit(1).alias("role"), F.col("b").alias("id"))
    centres = pairs.select("a", salt).distinct().select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("id"))
    texts = docs.join(partners.unionByName(centres).hint("merge"), "id").select("a", "salt", "role", "id", "text")
    dealt = texts.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")

    def run(batches):
        known, at, centre = WordHashes(), None, []
        for batch in batches:
            out = []
            for a, salt, role, doc_id, text in zip(*(batch[c].to_pylist() for c in ("a", "salt", "role", "id", "text"))):
                if at != (a, salt):
                    at, centre = (a, salt), []
                found = shingle_set(text, shingle, known)
                if role == 0:
                    centre.append(found)
                elif any(similar(c, found, percent) for c in centre):
                    out.append((a, doc_id))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def matched(pairs: DataFrame, classes: DataFrame, percent: int, least: int) -> DataFrame:
    """``(a, b, matches)`` of pairs whose sizes and signatures allow the similarity."""
    one = classes.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    two = classes.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    both = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    matches = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return both.select("a", "b", matches.alias("matches")).where(F.col("matches") >= least)


def with_candidates(members: DataFrame, scratch: Scratch, percent: int, least: int) -> DataFrame:
    """``(a, b, comp, n)`` of members ``(a, b, comp, n, sig)`` that have a candidate of another component in their group."""
    dealt = block_pairs(members, "a", "b", SIGN_BLOCK, scratch, "sign-blocks")

    def run(batches):
        for (a, _, _), left, right in met(batches, "a", ("b", "comp", "n", "sig")):
            if not right:
                continue
            one, two = (tuple(np.array(c) for c in zip(*side)) for side in (left, right))
            flags = [np.zeros(len(left), bool), np.zeros(len(right), bool)]
            for lo in range(0, len(left), STEP):
                _, comp, n, sig = (c[lo : lo + STEP] for c in one)
                for at in range(lo if left is right else 0, len(right), STEP):
                    _, comp2, n2, sig2 = (c[at : at + STEP] for c in two)
                    allowed = (comp[:, None] != comp2) & (100 * np.minimum(n[:, None], n2) >= percent * np.maximum(n[:, None], n2))
                    u, v = np.nonzero(allowed)
                    for cut in range(0, len(u), 65_536):
                        x, y = u[cut : cut + 65_536], v[cut : cut + 65_536]
                        hit = (sig[x] == sig2[y]).sum(axis=1) >= least
                        flags[0][lo + x[hit]] = True
                        flags[1][at + y[hit]] = True
            rows = {(int(side[0][k]), int(side[1][k]), int(side[2][k])) for side, flag in zip((one, two), flags) for k in np.flatnonzero(flag)}
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([a] * len(rows), pa.int64()), *(pa.array([x[k] for x in rows], pa.int64()) for k in range(3))], names=["a", "b", "comp", "n"])

    return dealt.mapInArrow(run, "a long, b long, comp long, n long").distinct()


def linked_in_blocks(docs: DataFrame, members: DataFrame, scratch: Scratch, shingle: int, percent: int) -> DataFrame:
    """``(a, b)``: links that join what full sets link of members ``(a, b, comp, n)`` of different components."""
    dealt = block_pairs(members.hint("merge").join(docs.withColumnRenamed("id", "b"), "b"), "a", "b", SET_BLOCK, scratch, "text-blocks", "n", SET_SHINGLES)

    def run(batches):
        known = WordHashes()
        for _, left, right in met(batches, "a", ("b", "comp", "text")):
            if not right:
                continue
            sets2 = [shingle_set(x[2], shingle, known) for x in right]
            sets = sets2 if left is right else [shingle_set(x[2], shingle, known) for x in left]
            sizes2 = np.array([len(x) for x in sets2])
            values, places = np.unique(np.concatenate(sets2), return_inverse=True)
            starts = sizes2.cumsum() - sizes2
            comp, comp2 = np.array([x[1] for x in left]), np.array([x[1] for x in right])
            linked = np.zeros((len(left), len(right)), bool)
            for k, own in enumerate(sets):
                at = np.minimum(np.searchsorted(values, own), len(values) - 1)
                held = np.zeros(len(values), np.int64)
                held[at[values[at] == own]] = 1
                both = np.add.reduceat(held[places], starts)
                linked[k] = (100 * both >= percent * (len(own) + sizes2 - both)) & (comp2 != comp[k])
            edges = forest(linked, np.array([x[0] for x in left]), np.array([x[0] for x in right]))
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, *, shingle: int = 5, percent: int = 80, coords: int = COORDS, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: ``(id_col, n_shingles, component_id, kept)``."""
    scratch = Scratch(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = scratch.table(sketches(texts, shingle, coords), "sketch")
    texts = texts.where("id is not null")
    usable = sketch.where("key is not null and id is not null")
    classes = scratch.table(usable.groupBy("key").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")

    # coordinate-value pairs as one number; those that one class alone has need no posting
    tagged = F.transform("sig", lambda x, i: F.shiftleft(i.cast("long"), 32).bitwiseOR(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))
    postings = classes.select("rep", F.explode(tagged).alias("cv"))
    shared = scratch.table(postings.groupBy("cv").count().where("count > 1"), "shared")
    rare_first = Window.partitionBy("rep").orderBy("count", "cv")
    ranked = postings.join(shared.hint("merge"), "cv").select("rep", "cv", F.row_number().over(rare_first).alias("rank"), F.count("*").over(Window.partitionBy("rep")).alias("held"))
    prefix = scratch.table(ranked.where(F.lit(coords) - F.col("held") + F.col("rank") <= coords - least + 1).select("cv", "rep", "held"), "prefix")

    most_held = prefix.groupBy("cv").agg(F.max(F.struct("held", -F.col("rep"))).alias("x"))
    centres = scratch.table(most_held.select("cv", (-F.col("x.col2")).alias("a")), "centres")
    stars = scratch.table(prefix.join(centres.hint("merge"), "cv").select("a", F.col("rep").alias("b")).distinct(), "stars")
    best = matched(stars.where("a <> b"), classes, percent, least).groupBy("b").agg(F.max(F.struct("matches", -F.col("a"))).alias("x")).select((-F.col("x.col2")).alias("a"), "b")
    first = scratch.table(confirmed(texts, scratch.table(best, "best"), shingle, percent), "first")
    scratch.drop("shared", "prefix", "centres", "best")
    label = scratch.table(components(first.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch, "early"), "label").select(F.col("node").alias("b"), F.col("component").alias("label"))

    named = scratch.table(stars.join(label.hint("merge"), "b", "left").select("a", "b", F.coalesce("label", "b").alias("comp")), "members")
    still_open = scratch.table(named.groupBy("a").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("a"), "open")
    signed = named.join(still_open.hint("merge"), "a", "left_semi").join(classes.select(F.col("rep").alias("b"), "n", "sig").hint("merge"), "b")
    flagged = scratch.table(with_candidates(signed, scratch, percent, least), "flagged")
    second = scratch.table(linked_in_blocks(texts, flagged, scratch, shingle, percent), "second")

    links = first.unionByName(second).select(F.col("a").alias("u"), F.col("b").alias("v"))
    label = components(links, scratch, "all").withColumnRenamed("node", "rep")
    scratch.drop("stars", "label", "members", "open", "sign-blocks", "flagged", "text-blocks")
    # rows that repeat an id may belong to several classes, whose links they share
    named = scratch.table(classes.select("key", "rep").join(label.hint("merge"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component")), "named")
    scratch.drop("classes", "first", "second")
    result = sketch.join(named.hint("merge"), "key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return result.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
