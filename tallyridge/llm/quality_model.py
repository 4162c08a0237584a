"""Document quality by random indexing and a small network.

Every unit has a sparse random index vector that follows from its spelling. A unit's context vector is the sum of the index vectors around its
occurrences in all documents; a document is the sum of its units' vectors over the number of its words. A network of two layers turns that into a
logit, and a temperature fitted on rows kept aside makes it a probability.

The commonest words are units of their own. Any other word, however rare, is two: its shape, if that is frequent, and one of ``BUCKETS`` units that words share by a
hash of their spelling. So no word is left out, and memory does not grow with the vocabulary; words of one bucket share a vector.

Counts of words, and the context sums, are taken over all documents: each task adds up its own, and partial sums are added in two steps.
The network and the temperature are learned from at most about ``most_rows`` labelled rows, chosen by a hash of id and text, repeated rows
once. Scoring covers whole texts of all rows. Null and empty texts have the zero vector and get a score like any other.
Without labelled rows of both classes the score is the share of class 1, or 0.5 with none.
Repeated rows, null ids and ties are kept, one result per row.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyridge.llm.common import Scratch, bounded_sample, row_order
from tallyridge.llm.langid import fold

RUN = re.compile(r"(.)\1+")
#: Distinct words that a task holds before it hands on its counts.
MOST_HELD = 400_000
#: Units that words share which have none of their own.
BUCKETS = 4_096
#: Words whose vectors are added up at a time.
TAKEN = 8_192
#: Units whose sums are one record, and parts into which tasks' records are dealt first.
UNIT_BLOCK, PARTS = 250, 256


class Shapes(dict):
    """Maps characters to their kinds, for str.translate."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        kind = "9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c
        self[point] = kind
        return kind


KINDS = Shapes()


def shape(word: str) -> str:
    """Its kinds of characters, runs as one: ``THE!!`` has ``X!``. The commonest are told without looking at each character."""
    if word.isalpha():
        if word.islower():
            return "~x"
        if word[0].isupper() and word[1:].islower():
            return "~Xx"
    elif word[-1] in ",." and (stem := word[:-1]).isalpha() and stem.islower():
        return "~x" + word[-1]
    return kinds_of(word)


def kinds_of(word: str) -> str:
    return "~" + RUN.sub(r"\1", word.translate(KINDS))[:12]


def index_vector(unit: str, size: int, filled: int) -> np.ndarray:
    rng = np.random.default_rng(zlib.crc32(unit.encode()))
    out = np.zeros(size, np.float32)
    out[rng.choice(size, filled, replace=False)] = rng.choice([-1.0, 1.0], filled)
    return out


class Units(dict):
    """Units of words as one number: the named one (a word or a shape), and above it the bucket plus 1 of words without one of their own; holds those seen, up to a bound."""

    def __init__(self, names: list[str], most: int = 300_000, buckets: int = BUCKETS):
        super().__init__()
        self.names, self.most, self.buckets = {u: k for k, u in enumerate(names)}, most, buckets
        self.width = len(names) + 1  # the last: neither a word nor a shape with a name

    def __missing__(self, word: str) -> int:
        k = self.names.get(word)
        if k is None:
            k = self.names.get(shape(word), self.width - 1) + (zlib.crc32(word.encode()) % self.buckets + 1) * self.width
        if len(self) >= self.most:
            self.clear()
        self[word] = k
        return k

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Of a text's words: named units, the last for none, and buckets, -1 for none."""
        words = text.split()
        bucket, named = np.divmod(np.fromiter(map(self.__getitem__, words), np.int32, len(words)), self.width)
        return named, bucket - 1


@dataclass
class Model:
    names: list[str]
    vectors: np.ndarray | None = None  # of named units, a row of zeros, and buckets
    layers: list[np.ndarray] = field(default_factory=list)
    temperature: float = 1.0
    constant: float = 0.5

    def pooled(self, units: Units, texts: list[str | None]) -> np.ndarray:
        """Sums of the vectors of texts' units, over their words."""
        out = np.zeros((len(texts), self.vectors.shape[1]), np.float64)
        for k, text in enumerate(texts):
            named, bucket = units.of(text or "")
            for ids in (named, units.width + bucket[bucket >= 0]):
                for lo in range(0, len(ids), TAKEN):
                    out[k] += self.vectors.take(ids[lo : lo + TAKEN], axis=0).sum(axis=0)
            out[k] /= max(1, len(named))
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2 = self.layers
        return np.tanh((x - mean) / scale @ w1 + b1) @ w2 + b2

    def scores(self, units: Units, texts: list[str | None]) -> np.ndarray:
        if not self.layers:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(self.pooled(units, texts)) / self.temperature, -40, 40)))


def gradients(weights: list[np.ndarray], z: np.ndarray, y: np.ndarray, decay: float) -> list[np.ndarray]:
    """Of the mean log loss, plus half of ``decay`` times the squares of both layers' weights."""
    h = np.tanh(z @ weights[0] + weights[1])
    delta = (1 / (1 + np.exp(-(h @ weights[2] + weights[3]))) - y) / len(y)
    back = delta[:, None] * weights[2] * (1 - h * h)
    return [z.T @ back + decay * weights[0], back.sum(axis=0), h.T @ delta + decay * weights[2], delta.sum()]


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, steps: int = 400, rate: float = 0.02, decay: float = 1e-3) -> list[np.ndarray]:
    """Weights by Adam on all rows at once, with a fixed start."""
    rng = np.random.default_rng(7)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - mean) / scale
    weights = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(())]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    for step in range(1, steps + 1):
        for k, g in enumerate(gradients(weights, z, y, decay)):
            m, v = moments[k]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            moments[k] = m, v
            weights[k] = weights[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return [mean, scale, *weights]


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, from a geometric grid."""
    grid = np.geomspace(0.25, 8, 61)
    loss = [np.mean(np.logaddexp(0, np.where(y == 1, -1, 1) * logits / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def vocabulary(docs: DataFrame, text_col: str, most_words: int, most_shapes: int) -> list[str]:
    """The commonest shapes and words of the corpus; ties go by spelling."""

    def spelled(batches):
        found: dict[str, int] = {}

        def batch():
            shapes: dict[str, int] = {}
            for w, n in found.items():
                s = shape(w)
                shapes[s] = shapes.get(s, 0) + n
            rows = [*((w, n, False) for w, n in found.items()), *((w, n, True) for w, n in shapes.items())]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.bool_()))], names=["unit", "n", "shape"])

        for b in batches:
            for text in b["text"].to_pylist():
                for w in text.split():
                    found[w] = found.get(w, 0) + 1
                if len(found) > MOST_HELD:
                    yield batch()
        yield batch()

    counts = docs.select(F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(spelled, "unit string, n long, shape boolean").groupBy("unit", "shape").agg(F.sum("n").alias("n"))
    frequent = lambda rows, most: [r["unit"] for r in rows.orderBy(F.desc("n"), "unit").limit(most).collect()]
    scratch = Scratch(docs.sparkSession)
    counts = scratch.table(counts.where("n > 1"), "counts")
    names = list(dict.fromkeys(frequent(counts.where("shape"), most_shapes) + frequent(counts.where("NOT shape"), most_words)))
    scratch.drop("counts")
    return names


class Neighbours:
    """How often named units stand within ``window`` places of named units and of buckets."""

    def __init__(self, units: Units, window: int):
        self.units, self.window, self.width = units, window, units.width
        self.counts = np.zeros(self.width * self.width, np.int32)
        self.shared = np.zeros(units.buckets * self.width, np.int32)

    def add(self, texts: list[str]) -> None:
        gap = np.full(self.window, self.width - 1, np.int32), np.full(self.window, -1, np.int32)  # what stands past an end counts for nothing
        parts = [gap, *(x for t in texts for x in (self.units.of(t), gap))]
        ids, buckets = (np.concatenate([x[k] for x in parts]).astype(np.int64) for k in (0, 1))
        at = np.flatnonzero(buckets >= 0)
        own = buckets[at] * self.width
        for k in range(1, self.window + 1):
            np.add.at(self.counts, ids[:-k] * self.width + ids[k:], 1)
            np.add.at(self.shared, own + ids[at - k], 1)
            np.add.at(self.shared, own + ids[at + k], 1)

    def context(self, index: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Sums of the index vectors around named units ``lo`` to ``hi``: whole numbers."""
        both = self.counts.reshape(self.width, self.width)
        around = both[lo:hi, :-1].astype(np.float64) + both[:-1, lo:hi].T
        return around @ index

    def shared_context(self, index: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """The same around buckets ``lo`` to ``hi``."""
        return self.shared.reshape(self.units.buckets, self.width)[lo:hi, :-1].astype(np.float64) @ index


@lru_cache(maxsize=2)
def index_vectors(names: tuple[str, ...], size: int, filled: int) -> np.ndarray:
    return np.stack([index_vector(u, size, filled) for u in names]).astype(np.float64) if names else np.zeros((0, size))


def bucket_names(buckets: int) -> list[str]:
    """Spellings that no word has."""
    return [f" {k}" for k in range(buckets)]


def context_vectors(docs: DataFrame, text_col: str, names: list[str], size: int, filled: int, window: int, buckets: int = BUCKETS) -> np.ndarray:
    """Sums over all documents of the index vectors around each named unit, then around each bucket; a fixed number of records reaches the driver."""

    def partial(batches):
        found = Neighbours(Units(names, buckets=buckets), window)
        for b in batches:
            texts = b["text"].to_pylist()
            for lo in range(0, len(texts), 512):
                found.add(texts[lo : lo + 512])
        index, part = index_vectors(tuple(names), size, filled), TaskContext.get().partitionId() % PARTS
        for lo in range(0, len(names), UNIT_BLOCK):
            sums = found.context(index, lo, min(lo + UNIT_BLOCK, len(names)))
            yield pa.RecordBatch.from_pylist([{"block": lo, "part": part, "sums": sums.tobytes()}], schema=records)
        for lo in range(0, buckets, UNIT_BLOCK):
            sums = found.shared_context(index, lo, min(lo + UNIT_BLOCK, buckets))
            yield pa.RecordBatch.from_pylist([{"block": len(names) + lo, "part": part, "sums": sums.tobytes()}], schema=records)

    records = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("sums", pa.binary())])

    def added(batches):
        """One record for each run of a block and a part."""
        at, total = None, None
        for b in batches:
            for block, part, sums in zip(*(b[c].to_pylist() for c in ("block", "part", "sums"))):
                if at != (block, part):
                    if at:
                        yield pa.RecordBatch.from_pylist([{"block": at[0], "part": at[1], "sums": total.tobytes()}], schema=records)
                    at, total = (block, part), np.zeros(len(sums) // 8)
                total += np.frombuffer(sums)
        if at:
            yield pa.RecordBatch.from_pylist([{"block": at[0], "part": at[1], "sums": total.tobytes()}], schema=records)

    schema = "block int, part int, sums binary"
    sums = docs.select(F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(partial, schema)
    once = sums.repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(added, schema)
    twice = once.withColumn("part", F.lit(0)).repartition("block").sortWithinPartitions("block").mapInArrow(added, schema)
    total = np.zeros((len(names) + buckets, size))
    for r in twice.collect():
        own = np.frombuffer(r["sums"]).reshape(-1, size)
        total[r["block"] : r["block"] + len(own)] = own
    return total


def fit(spark: SparkSession, docs: DataFrame, rows: DataFrame, *, text_col: str = "text", label_col: str = "label", id_col: str = "doc_id", order_col: str | None = None, most_rows: int = 4_000, most_words: int = 3_500, most_shapes: int = 500, size: int = 96, filled: int = 8, window: int = 2, buckets: int = BUCKETS) -> Model:
    """Word vectors of all ``docs``, and a network learned from labelled ``rows`` (only training rows); label 0 or 1.

    ``order_col`` may hold the ``row_order`` of rows already, so that counting needs no texts.
    """
    counts = {int(r[0]): r[1] for r in rows.where(F.col(label_col).isin(0, 1)).groupBy(label_col).count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        return Model([], constant=0.5 if not total else float(1 in counts))
    labelled = rows.where(F.col(label_col).isin(0, 1))
    order = F.col(order_col) if order_col else row_order(id_col, text_col)
    labelled = labelled.select(F.col(id_col).cast("string").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), F.col(label_col).cast("int").alias("label"), order.alias("order"))
    sample = bounded_sample(labelled, most_rows, "label").withColumn("aside", F.pmod("order", F.lit(5)) == 0)
    scratch = Scratch(spark)
    sample = scratch.table(sample, "sample")
    sample = sample.repartition(8)  # bounded by most_rows, whatever the table

    names = vocabulary(docs, text_col, most_words, most_shapes)
    own = np.concatenate((index_vectors(tuple(names), size, filled), index_vectors(tuple(bucket_names(buckets)), size, filled)))
    vectors = context_vectors(docs, text_col, names, size, filled, window, buckets) + own
    vectors = np.insert(vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9), len(names), 0, axis=0)
    model = Model(names, vectors)

    def pooled(batches):
        units = Units(names, buckets=buckets)
        for b in batches:
            x = model.pooled(units, b["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([b["id"], b["label"], b["aside"], pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "label", "aside", "x"])

    got = sorted(sample.mapInArrow(pooled, "id string, label int, aside boolean, x binary").collect(), key=lambda r: (r["id"] or "", r["x"]))
    x = np.stack([np.frombuffer(r["x"]) for r in got])
    y, aside = np.array([r["label"] for r in got], np.float64), np.array([r["aside"] for r in got])
    scratch.drop("sample")
    if len(set(y[~aside])) < 2:
        aside[:] = False
    model.layers = train(x[~aside], y[~aside])
    if len(set(y[aside])) == 2:
        model.temperature = best_temperature(model.logits(x[aside]), y[aside])
    return model


def score(spark: SparkSession, model: Model, docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (a column of that name is replaced)."""
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != "score"]
    schema = docs.select(*kept).schema.add("score", "double")

    def run(batches):
        found = shared.value
        units = Units(found.names, buckets=len(found.vectors) - len(found.names) - 1 if found.layers else BUCKETS)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found.scores(units, b[text_col].to_pylist()), pa.float64())], names=[*b.schema.names, "score"])

    return docs.select(*kept).mapInArrow(run, schema)


def held_out_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's row per document; only labels outside the held-out quarter are learned from."""
    held = fold("doc_id", 4) == 2
    known = labels.where(~held & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("label"))
    train_rows = docs.select("doc_id", "text", row_order("doc_id", "text").alias("order")).join(known, "doc_id")
    model = fit(spark, docs, train_rows, order_col="order")
    scored = score(spark, model, docs.select("doc_id", held.alias("held_out"), "text")).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
