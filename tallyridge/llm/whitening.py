"""Embedding whitening by TSQR, without forming a covariance.

Entries become whole numbers, so that counts and sums are exact; rows are centred by them. Every partition of the distinct vectors is
reduced to the R factor of its centred rows, batch by batch; R factors are stacked and reduced again, FAN at a time, until one is left. The
right singular vectors of this R are the components, its squared singular values over n the eigenvalues.

The vectors fitted are each distinct one once; the transform is of all rows. Vectors of different lengths are fitted apart; what is brought to the
driver is one R factor, sums and spreads of each length. Only the last check, of the whitened components' own covariance, adds up
products, of ``most`` components.

Rows whose vector is null or holds null or non-finite entries are dropped, empty vectors have no components, null and repeated ids are kept, one result per row. Entries are
at most 2^40 in size, beyond which the query fails; sums of squares of more than 63 bits (``deviation``) fail too. Where components have no variance (one distinct vector, constant
dimensions) their whitened values are null and they take no part in the check; without any variance ``explained`` is null, and the check's error is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyridge.llm.common import Scratch

SCALE, SHIFT = 64, 1_000_000
#: R factors that are reduced to one at a time, and components.
FAN, MOST = 8, 16
#: Halves of whole numbers are summed apart, so that sums stay exact.
HALF = 20
#: Share of the largest singular value below which one counts as none.
NONE = 1e-11


@dataclass
class Whitening:
    """Of vectors of one length: their number, sums, components (columns) and eigenvalues, the trace, and the covariance's largest error."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, rounded once."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Not a number for components without variance."""
        with np.errstate(divide="ignore"):
            scale = np.where(self.eigenvalues > 0, 1 / np.sqrt(self.eigenvalues), np.nan)
        return self.centred(x) @ self.components * scale

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums over dimensions of (n x - S)², exact."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        apart = x - whole
        most = int(np.abs(apart).max(initial=0)) + 1
        if x.shape[1] * (self.n * most) ** 2 < 1 << 62:
            d = self.n * apart - np.array([s % self.n for s in self.sums], np.int64)
            return (d * d).sum(axis=1).tolist()
        rest = [s % self.n for s in self.sums]
        return [sum((self.n * a - r) ** 2 for a, r in zip(row, rest)) for row in apart.tolist()]


def whole_numbers(spark: SparkSession, vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, size, x)`` of usable rows: entries as 64-bit integers, end to end."""
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    def prepare(batches):
        for b in batches:
            v = b["v"]
            data = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls come as not a number
            sizes = np.diff(v.offsets.to_numpy()) if len(v) else np.empty(0, np.int64)
            null = v.is_null().to_numpy(zero_copy_only=False)
            sizes = np.where(null, 0, sizes)
            ends = sizes.cumsum()
            usable = ~null & (sizes > 0) & (np.bincount(np.repeat(np.arange(len(sizes)), sizes), ~np.isfinite(data), len(sizes)) == 0)
            if np.abs(data[np.repeat(usable, sizes)]).max(initial=0) > 1 << 40:
                raise OverflowError("an entry is larger than 2^40")
            x = np.floor(SCALE * np.where(np.isfinite(data), data, 0)).astype(np.int64) + SHIFT
            at = np.flatnonzero(usable)
            raw = [x[ends[k] - sizes[k] : ends[k]].tobytes() for k in at]
            yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(at)), pa.array(sizes[at], pa.int32()), pa.array(raw, pa.binary())], names=["id", "size", "x"])

    return rows.mapInArrow(prepare, f"id {kind}, size int, x binary")


def by_length(batch: pa.RecordBatch):
    """(length, places, vectors) of a batch of ``size`` and ``x``."""
    sizes = batch["size"].to_numpy()
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield size, at, np.frombuffer(b"".join(batch["x"].take(pa.array(at)).to_pylist()), np.int64).reshape(len(at), size)


def exact_sums(fitted: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Number and sums of the vectors of each length, as many rows as their lengths together."""

    def partial(batches):
        sums: dict[int, list] = {}
        for b in batches:
            for size, _, x in by_length(b):
                own = sums.setdefault(size, [0, [0] * size])
                # halves of at most 2^28 and 2^20, of at most 2^31 rows
                high, low = (x >> HALF).sum(axis=0).tolist(), (x & ((1 << HALF) - 1)).sum(axis=0).tolist()
                own[0] += len(x)
                own[1] = [s + (h << HALF) + lo for s, h, lo in zip(own[1], high, low)]
        for size, (n, total) in sums.items():
            rows = {"size": [size] * size, "i": range(size), "n": [n] * size, "high": [s >> HALF for s in total], "low": [s & ((1 << HALF) - 1) for s in total]}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k in ("size", "i") else pa.int64()) for k, v in rows.items()})

    parts = fitted.select("size", "x").mapInArrow(partial, "size int, i int, n long, high long, low long")
    found: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(parts.groupBy("size", "i").agg(F.sum("n"), F.sum("high"), F.sum("low")).collect()):
        found.setdefault(r[0], (r[2], []))[1].append((r[3] << HALF) + r[4])
    return found


def reduced(parts: list[np.ndarray]) -> np.ndarray:
    """The R factor of stacked rows."""
    return np.linalg.qr(np.concatenate(parts), mode="r")


def tree_merged(scratch: Scratch, factors: DataFrame) -> dict[int, np.ndarray]:
    """The one R factor of each length of ``factors`` (size, slot, r), reduced FAN by FAN in rounds of tasks."""

    def merge(batches):
        group, held = None, []
        for b in batches:
            for size, slot, r in zip(b["size"].to_pylist(), b["slot"].to_pylist(), b["r"].to_pylist()):
                if (size, slot) != group and held:
                    yield factor_row(*group, reduced(held))
                    held = []
                group = size, slot
                held.append(np.frombuffer(r).reshape(-1, size))
        if held:
            yield factor_row(*group, reduced(held))

    most, k = factors.agg(F.max("slot")).first()[0], 0
    while most:
        most, k = most // FAN, k + 1
        near = factors.withColumn("slot", F.floor(F.col("slot") / FAN)).repartition("size", "slot").sortWithinPartitions("size", "slot")
        factors = scratch.table(near.mapInArrow(merge, "size int, slot long, r binary"), f"factors-{k}")
        scratch.drop(f"factors-{k - 1}")
    return {r["size"]: np.frombuffer(r["r"]).reshape(-1, r["size"]) for r in factors.collect()}


def factor_row(size: int, slot: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([slot], pa.int64()), pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())], names=["size", "slot", "r"])


def fit(spark: SparkSession, rows: DataFrame, scratch: Scratch, most: int = MOST) -> dict[int, Whitening]:
    """By length, of the distinct vectors of ``whole_numbers`` rows."""
    fitted = scratch.table(rows.select("size", "x").distinct(), "fitted")
    sums = exact_sums(fitted)
    models = {size: Whitening(n, s, np.eye(size), np.ones(size), 0.0) for size, (n, s) in sums.items()}

    def factors(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for size, _, x in by_length(b):
                step = max(4 * size, 4_096)
                for lo in range(0, len(x), step):
                    centred = models[size].centred(x[lo : lo + step])
                    held[size] = reduced([held[size], centred] if size in held else [centred])
        for size, r in held.items():
            yield factor_row(size, TaskContext.get().partitionId(), r)

    single = tree_merged(scratch, scratch.table(fitted.select("size", "x").mapInArrow(factors, "size int, slot long, r binary"), "factors-0"))
    for size, r in single.items():
        _, few, right = np.linalg.svd(r)
        spread = np.zeros(size)  # fewer vectors than dimensions leave some without variance
        spread[: len(few)] = np.where(few > NONE * few.max(initial=0), few, 0)
        n = models[size].n
        models[size] = Whitening(n, models[size].sums, right[:most].T, (spread[:most] ** 2) / n, float((spread**2).sum() / n))
    for size, error in identity_errors(fitted, models).items():
        models[size].error = error
    scratch.drop("fitted")
    return models


def identity_errors(fitted: DataFrame, models: dict[int, Whitening]) -> dict[int, float]:
    """The largest entry of the covariance of whitened vectors less the identity, by length; partitions centre their rows by their own means."""

    def partial(batches):
        held: dict[int, list] = {}
        for b in batches:
            for size, _, x in by_length(b):
                w = models[size].whitened(x)[:, models[size].eigenvalues > 0]
                mean, n = w.mean(axis=0), len(w)
                part = [n, mean, (w - mean).T @ (w - mean)]
                if size in held:
                    m, before, products = held[size]
                    apart = mean - before
                    part = [m + n, before + apart * n / (m + n), products + part[2] + np.outer(apart, apart) * (m * n / (m + n))]
                held[size] = part
        for size, (n, mean, products) in held.items():
            i, j = (x.ravel() for x in np.indices(products.shape))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), size), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(products.ravel() + n * mean[i] * mean[j]), pa.array(n * mean[i])], names=["size", "i", "j", "c", "m"])

    parts = fitted.select("size", "x").mapInArrow(partial, "size int, i int, j int, c double, m double").groupBy("size", "i", "j").agg(F.sum("c").alias("c"), F.sum("m").alias("m"))
    rows = parts.collect()
    means = {(r["size"], r["i"]): r["m"] / models[r["size"]].n for r in rows}
    errors: dict[int, float] = {}
    for r in rows:  # whitened rows have means of about 0, so that products of means are rounding errors alone
        covariance = r["c"] / models[r["size"]].n - means[r["size"], r["i"]] * means[r["size"], r["j"]]
        errors[r["size"]] = max(errors.get(r["size"], 0.0), abs(covariance - (r["i"] == r["j"])))
    return errors


def whiten(spark: SparkSession, vectors: DataFrame, *, most: int = MOST, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id_col, component, n, deviation, whitened, explained, identity_error)`` for each usable row and each of up to ``most`` components."""
    scratch = Scratch(spark)
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = scratch.table(whole_numbers(spark, vectors, id_col, vector_col), "rows")
    models = spark.sparkContext.broadcast(fit(spark, rows, scratch, most))  # a few numbers for each pair of dimension and component

    def transform(batches):
        for b in batches:
            for size, at, x in by_length(b):
                model = models.value[size]
                w, deviations = model.whitened(x), model.deviations(x)
                k, m = len(model.eigenvalues), len(at)
                explained = np.tile(model.eigenvalues / model.trace if model.trace else np.full(k, np.nan), m)
                each = np.repeat(np.arange(m), k)
                columns = [b["id"].take(pa.array(at[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), pa.array(deviations, pa.int64()).take(pa.array(each))]
                columns += [pa.array(w.ravel(), from_pandas=True), pa.array(explained, from_pandas=True), pa.array(np.full(m * k, model.error))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(transform, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double").withColumnRenamed("id", id_col)
