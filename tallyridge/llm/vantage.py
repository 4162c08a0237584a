"""Nearest neighbours by largest inner product: a vantage-point tree for each shard.

Inner products become distances by one more coordinate: a candidate x gets sqrt(M² - |x|²), with M the largest length of its shard, a query
0, so that the squared distance is M² + |q|² - 2 q·x. A node holds a vantage point, and for each half of the other vectors (by their distance to it) the least and
largest of these distances; a query at distance d from the vantage point is at least max(low - d, d - high) from all of a half.

A half is passed over if ``factor`` times this bound exceeds the query's k-th best distance so far. Factor 1 restores exact search (the bound is the triangle
inequality, and rounding is allowed for); larger ones pass over more, at the price of neighbours that lie near the bound. How much a factor
costs depends on the data, so that it is tuned: the largest of a ladder that keeps the recall, measured against exact search on a bounded sample. All vectors are indexed.

Vectors are dealt into shards of at most about ``shard`` ones by a number of their row, so that copies spread; each shard's tree is built by one task and stored as a row. Queries
meet trees in blocks of ``block``; a task searches one tree for one block, all its queries at a time: first they go down to the leaf nearest to them, for a first
k-th best, then through the tree in one order. Equal vectors of a shard form a class that keeps its k + 1 smallest ids, which is all that a result can need. Of the nearest of
all shards the best k stay. Scores are sums of products in double precision over the original entries, one row like the other, so that equal vectors tie.

Vectors that are null, zero or empty or hold null or non-finite components take no part, nor do rows without an id; vectors of different lengths do not meet. A query's own row
is any of its id; rows that repeat an id are candidates each, and queries each.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyridge.llm.common import Scratch, sized_batches

SHARD, BLOCK, LEAF = 16_384, 16_384, 64
#: Pairs of a query and a class that are held before they are cut to the best.
HELD = 1 << 20
#: Allowance for rounding, relative to the largest products.
ROUNDING = 1e-12


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products row by row; those of equal rows are equal."""
    return (x * q).sum(axis=-1)


@dataclass
class Tree:
    """Vectors in leaf order, their classes' ids, and nodes: ``(vantage point, low, high)`` of both halves, by number; node k has halves 2k + 1 and 2k + 2."""

    x: np.ndarray
    top: float  # the largest length
    sole: np.ndarray  # the id of classes that have but one, else the least integer
    ids: np.ndarray
    ends: np.ndarray
    depth: int
    vantage: np.ndarray
    rings: np.ndarray
    bounds: np.ndarray  # first vector of each leaf, and the end

    def ids_of(self, cls: int) -> np.ndarray:
        return self.ids[self.ends[cls - 1] if cls else 0 : self.ends[cls]]


NONE = np.iinfo(np.int64).min


def build(ids: np.ndarray, x: np.ndarray, k: int, leaf: int = LEAF, seed: int = 7) -> Tree:
    """A tree over rows of ``x``; every level halves each node, so that nodes follow from their numbers."""
    order = np.lexsort((ids, *x.T[::-1]))
    ids, x = ids[order], x[order]
    fresh = np.flatnonzero(np.append(True, (x[1:] != x[:-1]).any(axis=1)))
    sizes = np.diff(np.append(fresh, len(x)))
    rank = np.arange(len(x)) - np.repeat(fresh, sizes)
    classes, kept = x[fresh].astype(np.float64), rank <= k
    owner = np.repeat(np.arange(len(fresh)), sizes)
    n = len(classes)
    squares = (classes * classes).sum(axis=1)
    top = float(np.sqrt(squares.max()))
    lifted = np.sqrt(np.maximum(top * top - squares, 0))
    depth = max(0, int(np.ceil(np.log2(max(1, n / leaf)))))
    place, rng = np.arange(n), np.random.default_rng(seed)
    nodes = (1 << depth) - 1
    vantage, rings = np.full(nodes, -1), np.zeros((nodes, 2, 2))
    bounds = np.array([0, n])
    for level in range(depth):
        cuts = [0]
        for j in range(1 << level):
            lo, hi = bounds[j], bounds[j + 1]
            node, own = (1 << level) - 1 + j, place[lo:hi]
            middle = lo + (hi - lo) // 2
            if hi > lo:
                # of some vectors the one farthest from another is a good vantage point
                some = own[rng.integers(0, len(own), min(16, len(own)))]
                v = some[np.argmax(squared(classes, lifted, some, some[0]))]
                d = np.sqrt(squared(classes, lifted, own, v))
                by = np.argsort(d, kind="stable")
                place[lo:hi], d = own[by], d[by]
                vantage[node] = v
                for half, (a, b) in enumerate(((0, middle - lo), (middle - lo, hi - lo))):
                    rings[node, half] = (d[a], d[b - 1]) if b > a else (np.inf, -np.inf)
            cuts += [middle, hi]
        bounds = np.array(cuts)
    moved = np.empty(n, np.int64)
    moved[place] = np.arange(n)
    new_owner = moved[owner[kept]]
    by = np.lexsort((ids[kept], new_owner))
    held, new_owner = ids[kept][by], new_owner[by]
    counts = np.bincount(new_owner, minlength=n)
    ends = counts.cumsum()
    # with the id of a query alone, or of several rows all of it
    sole = np.where(held[ends - counts] == held[ends - 1], held[ends - counts], NONE)
    return Tree(x[fresh][place], top, sole, held, ends, depth, np.where(vantage >= 0, moved[vantage], -1), rings, bounds)


def squared(x: np.ndarray, lifted: np.ndarray, some: np.ndarray, v: int) -> np.ndarray:
    return ((x[some] - x[v]) ** 2).sum(axis=1) + (lifted[some] - lifted[v]) ** 2


class Search:
    """Of the queries of a block in one tree."""

    def __init__(self, tree: Tree, ids: np.ndarray, q: np.ndarray, k: int, factor: float):
        self.tree, self.ids, self.q, self.k, self.factor = tree, ids, q.astype(np.float64), k, factor
        self.x = tree.x.astype(np.float64)
        self.squares = (self.q * self.q).sum(axis=1) + tree.top * tree.top
        self.lifted = np.sqrt(np.maximum(tree.top * tree.top - (self.x * self.x).sum(axis=1), 0))
        self.slack = ROUNDING * self.squares
        self.best = np.full((len(q), k), -np.inf)  # scores, the k-th first
        self.pairs: list[np.ndarray] = []
        self.held, self.visited = 0, 0
        self.seen = np.full(len(q), -1)

    def run(self) -> Iterator[tuple[int, int, float]]:
        """(query, id, score) of the nearest ``k``."""
        everyone = np.arange(len(self.q))
        leaf = self.nearest_leaf()
        order = np.argsort(leaf, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
            self.scan(int(leaf[own[0]]), own)
        self.seen = leaf
        self.descend(0, 0, everyone)
        self.compact()
        for query, ids, scores in self.pairs:
            yield from zip(query.tolist(), ids.tolist(), scores.tolist())

    def to_vantage(self, node: int, queries: np.ndarray) -> np.ndarray:
        v = self.tree.vantage[node]
        return np.sqrt(np.maximum(self.squares[queries] - 2 * (self.q[queries] @ self.x[v]), 0))

    def nearest_leaf(self) -> np.ndarray:
        """By the half whose ring is nearer, at each node."""
        at = np.zeros(len(self.q), np.int64)
        for level in range(self.tree.depth):
            for j in np.unique(at).tolist():
                own = np.flatnonzero(at == j)
                node = (1 << level) - 1 + j
                d, rings = self.to_vantage(node, own), self.tree.rings[node]
                apart = [np.maximum(low - d, d - high) for low, high in rings]
                at[own] = 2 * j + (apart[1] < apart[0])
        return at

    def descend(self, level: int, j: int, queries: np.ndarray) -> None:
        if not len(queries):
            return
        if level == self.tree.depth:
            self.scan(j, queries[self.seen[queries] != j])
            return
        node = (1 << level) - 1 + j
        d = self.to_vantage(node, queries)
        for half, (low, high) in enumerate(self.tree.rings[node]):
            if low > high:
                continue
            bound = np.maximum(np.maximum(low - d, d - high), 0) * self.factor
            # distances to the k-th best, with what rounding may have taken
            reach = self.squares[queries] - 2 * self.best[queries, 0] + 4 * self.slack[queries]
            self.descend(level + 1, 2 * j + half, queries[bound * bound <= reach + 1e-9 * self.squares[queries] ** 0.5 * bound])

    def scan(self, leaf: int, queries: np.ndarray) -> None:
        lo, hi = self.tree.bounds[leaf], self.tree.bounds[leaf + 1]
        if hi == lo or not len(queries):
            return
        self.visited += len(queries) * int(hi - lo)
        scores = self.q[queries] @ self.x[lo:hi].T
        scores[self.tree.sole[lo:hi] == self.ids[queries][:, None]] = -np.inf
        hit = scores >= (self.best[queries, 0] - self.slack[queries])[:, None]
        hit &= scores > -np.inf
        some = np.flatnonzero(hit.any(axis=1))
        if not len(some):
            return
        row, column = np.nonzero(hit)
        self.pairs.append((queries[row], column + lo, None))
        self.held += len(row)
        both = np.concatenate((self.best[queries[some]], scores[some]), axis=1)
        self.best[queries[some]] = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
        if self.held > HELD:
            self.compact()

    def compact(self) -> None:
        """Cuts what is held to the best ``k`` of each query, by exact scores, then ids."""
        query, ids, scores = ([np.empty(0, t)] for t in (np.int64, np.int64, np.float64))
        for own, what, exact in self.pairs:
            if exact is None:
                # one step of pairs at a time
                for at in range(0, len(own), 1 << 16):
                    o, c = own[at : at + (1 << 16)], what[at : at + (1 << 16)]
                    s = products(self.x[c], self.q[o])
                    stay = s >= self.best[o, 0] - 2 * self.slack[o]
                    o, c, s = o[stay], c[stay], s[stay]
                    counts = self.tree.ends[c] - np.where(c > 0, self.tree.ends[c - 1], 0)
                    first = np.repeat(self.tree.ends[c] - counts, counts) + np.arange(counts.sum()) - np.repeat(counts.cumsum() - counts, counts)
                    o, s = np.repeat(o, counts), np.repeat(s, counts)
                    i = self.tree.ids[first]
                    other = i != self.ids[o]
                    query.append(o[other]), ids.append(i[other]), scores.append(s[other])
            else:
                query.append(own), ids.append(what), scores.append(exact)
        q, i, s = np.concatenate(query), np.concatenate(ids), np.concatenate(scores)
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        starts = np.flatnonzero(np.append(True, np.diff(q) != 0)) if len(q) else np.empty(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        top = rank < self.k
        self.pairs = [(q[top], i[top], s[top])]
        self.held = int(top.sum())


@dataclass
class Index:
    """A table with a row ``(size, shard, tree)`` for each shard, and the table of its vectors."""

    trees: DataFrame
    vectors: DataFrame
    element: str
    shards: int


def usable(vectors: DataFrame, id_col: str, vector_col: str, element: str) -> DataFrame:
    """``(id, size, vec)`` of vectors that take part."""
    width = np.dtype(np.float32 if element == "float" else np.float64)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{element}>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")

    def prepare(batches):
        for b in batches:
            v = b["v"]
            data = v.flatten().to_numpy(zero_copy_only=False).astype(width) + width.type(0)  # one zero; nulls come as not a number
            sizes = np.diff(v.offsets.to_numpy()) if len(v) else np.empty(0, np.int64)
            ends, owner = sizes.cumsum(), np.repeat(np.arange(len(sizes)), sizes)
            fine = (np.bincount(owner, ~np.isfinite(data), len(sizes)) == 0) & (np.bincount(owner, data != 0, len(sizes)) > 0)
            at = np.flatnonzero(fine)
            raw = [data[ends[k] - sizes[k] : ends[k]].tobytes() for k in at]
            yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(at)), pa.array(sizes[at], pa.int32()), pa.array(raw, pa.binary())], names=["id", "size", "vec"])

    return rows.mapInArrow(prepare, "id long, size int, vec binary")


def parts_of(rows: DataFrame, most: int) -> int:
    """How many parts of about ``most`` rows there are."""
    return max(1, -(-rows.count() // most))


def numbered(rows: DataFrame, parts: int, name: str) -> DataFrame:
    """``rows`` with the number of their part, by a hash of the number of the row."""
    return rows.withColumn(name, F.pmod(F.xxhash64("row"), F.lit(parts)))


def everywhere(rows: DataFrame, parts: int, name: str) -> DataFrame:
    """``rows`` once for each part."""
    return rows.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))


def index(spark: SparkSession, vectors: DataFrame, scratch: Scratch, *, k: int = 20, shard: int = SHARD, leaf: int = LEAF, id_col: str = "vec_id", vector_col: str = "embedding") -> Index:
    """Trees over all usable vectors, in tables of ``scratch``."""
    element = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    width = np.dtype(np.float32 if element == "float" else np.float64)
    rows = scratch.table(usable(vectors, id_col, vector_col, element).withColumn("row", F.monotonically_increasing_id()), "vectors")

    def grow(batches):
        def tree(group, held):
            ids = np.concatenate([h[0] for h in held])
            x = np.frombuffer(b"".join(h for _, raw in held for h in raw), width).reshape(len(ids), group[0])
            return pa.RecordBatch.from_arrays([pa.array([group[0]], pa.int32()), pa.array([group[1]], pa.int64()), pa.array([pickle.dumps(build(ids, x, k, leaf), 5)], pa.binary())], names=["size", "shard", "tree"])

        for group, held in groups(batches, "shard"):
            yield tree(group, held)

    shards = parts_of(rows, shard)
    together = numbered(rows, shards, "shard").repartition("size", "shard").sortWithinPartitions("size", "shard")
    return Index(scratch.table(together.select("size", "shard", "id", "vec").mapInArrow(grow, "size int, shard long, tree binary"), "trees"), rows, element, shards)


def groups(batches: Iterator, by: str) -> Iterator[tuple[tuple[int, int], list[tuple[np.ndarray, list[bytes]]]]]:
    """((size, part), [(ids, vectors), …]) of rows that come ordered."""
    group, held = None, []
    for b in batches:
        keys = np.stack([b["size"].to_numpy().astype(np.int64), b[by].to_numpy()])
        starts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))) if len(b) else []
        for lo, hi in zip(starts, np.append(starts[1:], len(b))):
            own = tuple(keys[:, lo].tolist())
            if own != group:
                if held:
                    yield group, held
                group, held = own, []
            part = b.slice(lo, hi - lo)
            held.append((part["id"].to_numpy(), part["vec"].to_pylist()))
    if held:
        yield group, held


def search(found: Index, queries: Column, scratch: Scratch, *, k: int = 20, factor: float | dict[int, float] = 1.0, block: int = BLOCK, id_col: str = "vec_id") -> DataFrame:
    """``(query_id, rank, id_col, score)``: for each vector of the index that ``queries`` (a condition on ``id``) picks the ``k`` nearest of all, its own row apart. ``factor`` may go by the vectors' length."""
    width = np.dtype(np.float32 if found.element == "float" else np.float64)
    asked = found.vectors.where(queries)
    blocks = parts_of(asked, block)
    # a task for each pair of a tree and a block of queries: trees go to it once a block, queries once a shard
    none = lambda kind: F.lit(None).cast(kind)
    trees = everywhere(found.trees, blocks, "block").select("size", "shard", "block", "tree", none("long").alias("row"), none("long").alias("id"), none("binary").alias("vec"))
    rows = everywhere(numbered(asked, blocks, "block"), found.shards, "shard").select("size", "shard", "block", none("binary").alias("tree"), "row", "id", "vec")
    met = trees.unionByName(rows).repartition("size", "shard", "block").sortWithinPartitions("size", "shard", "block")
    kinds = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def each(batches):
        group, tree, held = None, None, []

        def answers():
            if tree is None or not held:
                return
            numbers, ids = np.array([h[0] for h in held]), np.array([h[1] for h in held])
            q = np.frombuffer(b"".join(h[2] for h in held), width).reshape(len(held), group[0])
            for at, near, score in Search(pickle.loads(tree), ids, q, k, factor.get(group[0], 1.0) if isinstance(factor, dict) else factor).run():
                yield 32, (int(numbers[at]), int(ids[at]), near, score)

        for b in batches:
            for size, shard, part, t, row, i, vec in zip(*(b[c].to_pylist() for c in ("size", "shard", "block", "tree", "row", "id", "vec"))):
                if (size, shard, part) != group:
                    yield from answers()
                    group, tree, held = (size, shard, part), None, []
                if t is not None:
                    tree = t
                else:
                    held.append((row, i, vec))
        yield from answers()

    near = met.mapInArrow(lambda batches: sized_batches(each(batches), kinds), "row long, query_id long, id long, score double")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "id")
    ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


#: Factors that are tried, and the recall that the chosen one must have on the sample.
LADDER, LEAST_RECALL = (8.0, 6.0, 4.0, 3.0, 2.0, 1.5, 1.25, 1.1), 0.98


def tuned(found: Index, *, k: int = 20, leaf: int = LEAF, most_sample: int = 8_192, most_entries: int = 1 << 23, asked: int = 256) -> dict[int, float]:
    """By length of vectors, the largest factor that finds LEAST_RECALL of what exact search does, for ``asked`` vectors among a sample of at most about ``most_sample`` vectors and ``most_entries`` entries; 1 for lengths with few vectors."""
    total, entries = found.vectors.agg(F.count("*"), F.sum("size")).first()
    share = min(1.0, most_sample / max(1, total), most_entries / max(1, entries or 0))
    picked = found.vectors.where(F.pmod(F.xxhash64("row", F.lit("sample")), F.lit(1 << 20)) < share * (1 << 20))
    by_size: dict[int, list] = {}
    for r in sorted(picked.select("size", "row", "id", "vec").collect()):
        by_size.setdefault(r["size"], []).append((r["id"], bytes(r["vec"])))
    width = np.dtype(np.float32 if found.element == "float" else np.float64)
    factors = {}
    for size, held in by_size.items():
        if len(held) < 20 * k:
            continue
        ids, x = np.array([i for i, _ in held]), np.frombuffer(b"".join(v for _, v in held), width).reshape(len(held), size)
        tree, some = build(ids, x, k, leaf), np.random.default_rng(size).permutation(len(ids))[:asked]
        nearest_of = lambda factor: {(a, i) for a, i, _ in Search(tree, ids[some], x[some], k, factor).run()}
        exact = nearest_of(1.0)
        factors[size] = next((f for f in LADDER if len(nearest_of(f) & exact) >= LEAST_RECALL * len(exact)), 1.0)
    return factors


def nearest(spark: SparkSession, vectors: DataFrame, *, k: int = 20, every: int = 20, factor: float | None = None, shard: int = SHARD, block: int = BLOCK, leaf: int = LEAF, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest of each vector whose id is divisible by ``every``; the factor is ``tuned`` where none is given."""
    scratch = Scratch(spark)
    found = index(spark, vectors, scratch, k=k, shard=shard, leaf=leaf, id_col=id_col, vector_col=vector_col)
    by_size = tuned(found, k=k, leaf=leaf) if factor is None else factor
    return search(found, F.col("id") % every == 0, scratch, k=k, factor=by_size, block=block, id_col=id_col)
