"""Embedding near-duplicates by iterative quantisation.

A rotation is learned on a bounded sample so that the signs of rotated vectors lose little (iterative
quantisation); cutting at medians makes every bit balanced. The bits of one or more rotations are a vector's code.

Codes are indexed many times: a table for each substring. Vectors that share a substring in some table and whose
whole codes' first FILTER bits lie within a Hamming radius are candidates, and are ranked with their original vectors in double
precision. The number of bits of a substring follows from the number of vectors (at least LEAST_BITS, at any size); the number of tables from how many pairs
at the cutoff, made from the sample, share a substring under the learned codes, and the radius from their distances: vectors with a
common mean direction need more of both than hyperplanes' angles say.

Tables hold codes and numbers of vectors alone. First each bucket tells which of its members have a candidate, by codes; only
their vectors are then fetched and compared. Equal vectors form a class, and one of each goes on. A large bucket is dealt in pairs of
blocks, and a pair of vectors counts in the first table that it shares, so nothing is emitted per pair: a block gives each
vector's number of links and a spanning forest.

Vectors that are null, zero or empty, or hold null or non-finite components, link with nothing, nor do rows without an id or
vectors of different lengths; lengths have codes of their own. Rows that repeat an id are one vector to others: it holds the links of all of them, and they
are no links of one another where they are equal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyridge.llm.common import Scratch, sized_batches
from tallyridge.llm.graph import components

LEAST_BITS, MOST_BITS, MOST_TABLES = 8, 30, 512
TRAINED = 8
#: Bits of a code within whose Hamming radius candidates lie; two long integers.
FILTER = 128
#: Members of a bucket beyond which it is dealt as pairs of blocks, and of a block that are compared at a time.
BLOCK, STEP = 16_384, 1_024


def unit(x: np.ndarray) -> np.ndarray:
    """Rows in double precision, of length 1."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=-1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


@dataclass
class Codes:
    """Rotations with their medians, and the layout of tables, of vectors of one length."""

    rotations: list[tuple[np.ndarray, np.ndarray]]
    bits: int
    tables: int
    radius: int

    def signs(self, units: np.ndarray) -> np.ndarray:
        return np.concatenate([units @ turn > median for turn, median in self.rotations], axis=1)

    def of(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The substring of each vector in each table, and the first FILTER bits as integers."""
        signs = self.signs(units)
        subs = signs[:, : self.tables * self.bits].reshape(len(units), self.tables, self.bits) @ (1 << np.arange(self.bits))
        packed = np.packbits(signs[:, :FILTER], axis=1)
        return subs.astype(np.int32), np.ascontiguousarray(packed).view(np.int64).reshape(len(units), FILTER // 64)


def rotation(sample: np.ndarray, number: int, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """A rotation that brings centred vectors close to their signs, and the medians of rotated coordinates."""
    size = sample.shape[1]
    mean = sample.mean(axis=0)
    axes = np.linalg.svd(sample - mean, full_matrices=True)[2].T if len(sample) < size else np.linalg.eigh(np.cov(sample.T))[1]
    centred = (sample - mean) @ axes
    turn = np.linalg.qr(np.random.default_rng(number).normal(size=(size, size)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.sign(centred @ turn).T @ centred)
        turn = (u @ v).T
    whole = axes @ turn
    return whole, np.median(sample @ whole, axis=0)


def turn_of(sample: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """The rotation of a number with its medians: the first TRAINED are learned; more of them, and those of few coordinates, would repeat what there is."""
    size = sample.shape[1]
    if number < TRAINED and 16 <= size and len(sample) > 1:
        return rotation(sample, number)
    turn = np.linalg.qr(np.random.default_rng((size, number)).normal(size=(size, size)))[0]
    return turn, np.median(sample @ turn, axis=0)


def cutoff_pairs(sample: np.ndarray, cosine: float, pairs: int = 10_000) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unit vectors at the cutoff: the second turned from the first about the sample's mean towards another of its vectors, and turned any way."""
    rng = np.random.default_rng(11)
    mean = sample.mean(axis=0)
    left = sample[rng.integers(0, len(sample), pairs)]
    own, other = left - mean, sample[rng.integers(0, len(sample), pairs)] - mean
    length = np.linalg.norm(own, axis=1, keepdims=True)
    other -= (other * own).sum(axis=1, keepdims=True) / np.maximum(length, 1e-12) ** 2 * own
    other *= length / np.maximum(np.linalg.norm(other, axis=1, keepdims=True), 1e-12)
    low, high = np.zeros((pairs, 1)), np.full((pairs, 1), math.pi)
    for _ in range(40):
        angle = (low + high) / 2
        right = mean + np.cos(angle) * own + np.sin(angle) * other
        right /= np.maximum(np.linalg.norm(right, axis=1, keepdims=True), 1e-12)
        near = (left * right).sum(axis=1, keepdims=True) >= cosine
        low, high = np.where(near, angle, low), np.where(near, high, angle)
    noise = rng.normal(size=left.shape)
    noise -= (noise * left).sum(axis=1, keepdims=True) * left
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    turned = cosine * left + math.sqrt(max(0.0, 1 - cosine * cosine)) * noise
    return [(left, right), (left, turned / np.maximum(np.linalg.norm(turned, axis=1, keepdims=True), 1e-12))]


def learned(sample: np.ndarray, vectors: int, *, cosine: float, bucket: int, miss: float) -> Codes:
    """Rotations, and the cheapest layout that brings the misses measured on pairs at the cutoff to ``miss``.

    The cost of a layout is, for each table, a posting (as dear as a bucket's worth of Hamming distances) and the members of
    a vector's bucket.
    """
    size = sample.shape[1]
    kinds = cutoff_pairs(sample, cosine)
    rotations: list[tuple[np.ndarray, np.ndarray]] = []
    agree: list[np.ndarray] = [np.empty((len(left), 0), bool) for left, _ in kinds]

    def grow(bits: int) -> None:
        while len(rotations) * size < bits:
            turn, median = turn_of(sample, len(rotations))
            rotations.append((turn, median))
            for k, (left, right) in enumerate(kinds):
                agree[k] = np.concatenate((agree[k], (left @ turn > median) == (right @ turn > median)), axis=1)

    best: tuple[float, int, int] | None = None
    most = max(LEAST_BITS, min(MOST_BITS, math.ceil(math.log2(max(2, vectors)))))
    # fewer bits than LEAST_BITS only where nothing else will do; a pair at the cutoff agrees in most single bits, so that one bit always will
    for bits in [*range(LEAST_BITS, most + 1), *range(LEAST_BITS - 1, 0, -1)]:
        if best and bits < LEAST_BITS:
            break
        missed = [np.ones(len(left), bool) for left, _ in kinds]
        tables = 0
        while max(m.mean() for m in missed) > miss:
            if tables == MOST_TABLES:
                break
            cost = (tables + 1) * (bucket + vectors / 2**bits)
            if best and cost >= best[0]:
                break
            grow((tables + 1) * bits)
            for m, same in zip(missed, agree):
                m &= ~same[:, tables * bits : (tables + 1) * bits].all(axis=1)
            tables += 1
        else:
            cost = tables * (bucket + vectors / 2**bits)
            if best is None or cost < best[0]:
                best = cost, bits, tables
    if best is None:
        raise ValueError(f"no {MOST_TABLES} tables find all but {miss:.3%} of the pairs at a cosine of {cosine}")
    _, bits, tables = best
    grow(max(FILTER, bits * tables))
    apart = [(~same[:, :FILTER]).sum(axis=1) for same in agree]
    radius = int(max(np.quantile(a, 1 - miss / 10) for a in apart))
    return Codes(rotations[: -(-max(FILTER, bits * tables) // size)], bits, tables, radius)


def fit(classes: DataFrame, vectors: int, *, cosine: float, bucket: int, miss: float, most_sample: int = 20_000) -> dict[int, Codes]:
    """Codes by length, from at most about ``most_sample`` distinct vectors, chosen by a hash; ones of a length that the sample lacks get random rotations."""
    share = min(1.0, most_sample / max(1, vectors))
    picked = F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < share * (1 << 20)
    by_size: dict[int, list[bytes]] = {}
    for r in classes.where(picked).select("size", "vec").collect():
        by_size.setdefault(r["size"], []).append(bytes(r["vec"]))
    out = {}
    for size, held in by_size.items():
        sample = unit(np.stack([np.frombuffer(v, np.float64 if len(v) == 8 * size else np.float32) for v in sorted(held)]))
        out[size] = learned(sample, math.ceil(len(held) / share), cosine=cosine, bucket=bucket, miss=miss)
    return out


def codes_of(found: dict[int, Codes], size: int, cosine: float, bucket: int, miss: float) -> Codes:
    if size not in found:
        rng = np.random.default_rng(size)
        found[size] = learned(unit(rng.normal(size=(1_000, size))), 1, cosine=cosine, bucket=bucket, miss=miss)
    return found[size]


def forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what ``linked[i, j]`` joins of ids ``left[i]`` and ``right[j]``; at most one per vector."""
    u, v = np.nonzero(linked)
    v = v + len(left)
    label = np.arange(len(left) + len(right))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, least)
        np.minimum.at(new, v, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    ids = np.concatenate((left, right))
    moved = np.flatnonzero(label != np.arange(len(label)))
    return [(int(ids[k]), int(ids[label[k]])) for k in moved if ids[k] != ids[label[k]]]


def table_key(length: Column, table: Column, value: Column) -> Column:
    """A bucket as one number: the vectors' length, the table, and the substring."""
    return F.shiftleft(length.cast("long"), 41) + F.shiftleft(table.cast("long"), 32) + value.cast("long")


def table_of(bucket: int) -> tuple[int, int]:
    """Length and table of a bucket."""
    return bucket >> 41, (bucket >> 32) & (MOST_TABLES - 1)


def blocks_of(batches: Iterator, columns: tuple[str, ...]) -> Iterator[tuple[int, int, pa.Table]]:
    """(bucket, pair of blocks, rows) of rows that come ordered by ``bucket, side``; the last bit of ``side`` tells the left ones."""
    group, held = None, []
    for b in batches:
        keys = np.stack([b["bucket"].to_numpy(), b["side"].to_numpy() >> 1])
        if not len(b):
            continue
        starts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
        for lo, hi in zip(starts, np.append(starts[1:], len(b))):
            own = tuple(keys[:, lo].tolist())
            if own != group:
                if held:
                    yield *group, pa.Table.from_batches(held).combine_chunks()
                group, held = own, []
            held.append(b.slice(lo, hi - lo).select(["side", *columns]))
    if held:
        yield *group, pa.Table.from_batches(held).combine_chunks()


def sides(pair: int, rows: pa.Table) -> tuple[bool, np.ndarray, np.ndarray]:
    """Whether a block meets itself, and the places of left and right rows."""
    same, left = pair >> 30 == pair & ((1 << 30) - 1), (rows["side"].to_numpy() & 1) == 1
    one = np.arange(len(left)) if same else np.flatnonzero(left)
    return same, one, one if same else np.flatnonzero(~left)


def dealt_in_blocks(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows ``(bucket, cls, ...)`` for each pair of blocks of their bucket, with ``side``: the pair, then whether left; few buckets have more than one."""
    large = scratch.table(rows.groupBy("bucket").count().where(F.col("count") > BLOCK).select("bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "large")
    dealt = rows.join(large, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks").cast("long")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
    side = F.shiftleft(F.least("block", "other"), 31) + F.shiftleft(F.greatest("block", "other"), 1) + (F.col("block") <= F.col("other")).cast("long")
    return dealt.withColumn("side", side).drop("blocks", "block", "other")


def together(rows: DataFrame) -> DataFrame:
    return rows.repartition(F.col("bucket"), F.shiftright("side", 1)).sortWithinPartitions("bucket", "side")


def near_duplicates(spark: SparkSession, vectors: DataFrame, *, cosine: float = 0.95, bucket_size: int = 4096, miss: float = 0.005, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per row of ``vectors``: ``(id_col, n_links, component_id, kept)``."""
    scratch = Scratch(spark)
    element = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    width = np.dtype(np.float32 if element == "float" else np.float64)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{element}>").alias("values"))

    def prepare(batches):
        for b in batches:
            values = b["values"]
            data = values.flatten().to_numpy(zero_copy_only=False).astype(width) + width.type(0)  # one zero
            sizes = np.diff(values.offsets.to_numpy()) if len(values) else np.empty(0, np.int64)
            sizes = np.where(values.is_null().to_numpy(zero_copy_only=False), 0, sizes)
            ends = sizes.cumsum()
            owner = np.repeat(np.arange(len(sizes)), sizes)
            # null components come as not a number
            bad = np.bincount(owner, ~np.isfinite(data), len(sizes)) > 0
            usable = (sizes > 0) & ~bad & (np.bincount(owner, data != 0, len(sizes)) > 0) & ~b["id"].is_null().to_numpy(zero_copy_only=False)
            raw = [data[e - n : e].tobytes() if ok else None for ok, e, n in zip(usable, ends, sizes)]
            keys = [r and xxhash.xxh3_128_digest(r) for r in raw]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(raw, pa.binary())], names=["id", "key", "size", "vec"])

    prepared = rows.mapInArrow(prepare, "id long, key binary, size int, vec binary")
    keys = scratch.table(prepared.select("id", "key"), "keys")
    known = prepared.where("key is not null")
    more = keys.where("key is not null").groupBy("key").agg(F.count_distinct("id").alias("copies"))
    classes = known.groupBy("key").agg(F.min("id").alias("rep"), F.first("size").alias("size"), F.first("vec").alias("vec")).join(more.hint("merge"), "key")
    classes = scratch.table(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    fitted = spark.sparkContext.broadcast(fit(classes, classes.count(), cosine=cosine, bucket=bucket_size, miss=miss))

    def encode(batches):
        found = fitted.value
        for b in batches:
            raw, sizes = b["vec"].to_pylist(), b["size"].to_numpy()
            subs: list = [None] * len(raw)
            codes: list = [None] * len(raw)
            for size in set(sizes.tolist()):
                at = np.flatnonzero(sizes == size)
                own = codes_of(found, size, cosine, bucket_size, miss)
                for k, s, c in zip(at, *own.of(unit(np.stack([np.frombuffer(raw[k], width) for k in at])))):
                    subs[k], codes[k] = s, c
            columns = [pa.array(subs, pa.list_(pa.int32())), *(pa.array([c[k] for c in codes], pa.int64()) for k in range(FILTER // 64))]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("cls", "key", "rep", "copies", "size", "vec")), *columns], names=["cls", "key", "rep", "copies", "size", "vec", "subs", "h0", "h1"])

    coded = classes.select("cls", "key", "rep", "copies", "size", "vec").mapInArrow(encode, "cls long, key binary, rep long, copies long, size int, vec binary, subs array<int>, h0 long, h1 long")
    coded = scratch.table(coded, "coded")
    scratch.drop("classes")

    postings = coded.select("cls", "h0", "h1", "size", F.posexplode("subs").alias("k", "v"))
    postings = postings.select(table_key(F.col("size"), F.col("k"), F.col("v")).alias("bucket"), "cls", "h0", "h1")

    def near(bucket: int, pair: int, rows: pa.Table) -> Iterator[tuple]:
        """Members that have a candidate on the other side, by their codes."""
        same, one, two = sides(pair, rows)
        if len(one) < 1 + same or not len(two):
            return
        side, cls = rows["side"].to_numpy(), rows["cls"].to_numpy()
        h = np.stack([rows["h0"].to_numpy(), rows["h1"].to_numpy()]).view(np.uint64)
        radius = codes_of(fitted.value, table_of(bucket)[0], cosine, bucket_size, miss).radius
        hit = np.zeros(len(cls), bool)
        for lo in range(0, len(one), STEP):
            some = one[lo : lo + STEP]
            for at in range(lo if same else 0, len(two), STEP):
                other = two[at : at + STEP]
                apart = np.bitwise_count(h[0, some][:, None] ^ h[0, other]).astype(np.int16)
                apart += np.bitwise_count(h[1, some][:, None] ^ h[1, other])
                close = apart <= radius
                if same and at == lo:
                    np.fill_diagonal(close, False)
                hit[some] |= close.any(axis=1)
                hit[other] |= close.any(axis=0)
        for k in np.flatnonzero(hit):
            yield bucket, int(side[k]), int(cls[k])

    flags = pa.schema([("bucket", pa.int64()), ("side", pa.int64()), ("cls", pa.int64())])

    def flag(batches):
        return sized_batches(((32, row) for group in blocks_of(batches, ("cls", "h0", "h1")) for row in near(*group)), flags)

    dealt = together(dealt_in_blocks(postings, scratch))
    flagged = scratch.table(dealt.mapInArrow(flag, "bucket long, side long, cls long"), "flagged")
    fetched = together(flagged.join(coded.select("cls", "rep", "copies", "vec", "subs").hint("merge"), "cls"))

    def compare(bucket: int, pair: int, rows: pa.Table) -> Iterator[tuple]:
        """Links of members, and a spanning forest of them, by cosines; a pair counts in the first table that it shares."""
        same, one, two = sides(pair, rows)
        reps, copies = rows["rep"].to_numpy(), rows["copies"].to_numpy()
        x = unit(np.frombuffer(b"".join(rows["vec"].to_pylist()), width).reshape(len(reps), -1))
        subs = np.stack(rows["subs"].to_pylist()).astype(np.int32)[:, : table_of(bucket)[1]]
        links = np.zeros(len(reps), np.int64)
        for lo in range(0, len(one), STEP):
            some = one[lo : lo + STEP]
            for at in range(lo if same else 0, len(two), STEP):
                other = two[at : at + STEP]
                linked = x[some] @ x[other].T >= cosine
                if same and at == lo:
                    linked &= np.triu(np.ones(linked.shape, bool), 1)
                u, v = np.nonzero(linked)
                for cut in range(0, len(u), 1 << 16):
                    a, b = u[cut : cut + (1 << 16)], v[cut : cut + (1 << 16)]
                    earlier = (subs[some[a]] == subs[other[b]]).any(axis=1)
                    linked[a[earlier], b[earlier]] = False
                if linked.any():
                    links[some] += linked @ copies[other]
                    links[other] += copies[some] @ linked
                    for a, b in forest(linked, reps[some], reps[other]):
                        yield a, 0, b
        for k in np.flatnonzero(links):
            yield int(reps[k]), int(links[k]), None

    edges = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])

    def rank(batches):
        return sized_batches(((24, row) for group in blocks_of(batches, ("rep", "copies", "vec", "subs")) for row in compare(*group)), edges)

    found = scratch.table(fetched.select("bucket", "side", "rep", "copies", "vec", "subs").mapInArrow(rank, "rep long, links long, to long"), "found")
    scratch.drop("large", "flagged")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    label = components(found.where("to is not null").select(F.col("rep").alias("u"), F.col("to").alias("v")), scratch, "all").withColumnRenamed("node", "rep")
    own = coded.select("key", "rep", "copies").join(links.hint("merge"), "rep", "left").join(label.hint("merge"), "rep", "left")
    named = scratch.table(own.select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")), "named")
    scratch.drop("coded", "found")
    result = keys.join(named.hint("merge"), "key", "left")
    component = F.coalesce("component", "id")
    return result.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
