"""Packing into token windows by order-preserving dynamic programming.

The ids of a partition's documents form one stream in the order of the table. A window is up to
``size`` ids; it is padded to ``size``, unless its length is a power of two. Cuts may fall at the ends
of documents (free), at the ends of sentences or lines (a small penalty), and inside sentences that
are long (a larger one). The best cuts minimise padding plus penalties:

    best[j] = penalty[j] + min over i in [j - size, j) of best[i] + padding(j - i)

With padding ``size - (j - i)`` the minimum is that of ``best[i] + i`` over a sliding range, which a
monotone queue gives in amortised constant time; one extra transition serves a window of half the
size, which needs no padding.

Partitions are packed apart, so that the only cost of parallelism is one last window each. Memory is
bounded: the programme is run and traced back every ``block`` ids, all but the last windows are put
out, and what they leave goes on with the next block. A null text counts as empty; with an ``end_id``
it still gives one id. Repeated ids are packed as they come. Rows are neither dropped nor split further.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyridge.llm.common import BATCH_BYTES
from tallyridge.llm.pieces import default_path, piece_encoder

DOC, SENTENCE, INSIDE = 0.0, 2.0, 6.0


def cut_points(ids: np.ndarray, ends: np.ndarray, stop_ids: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending positions in a stream where it may be cut, and their penalties.

    ``ends``: ends of documents; ``stop_ids[i]``: whether id i ends a sentence or line. A gap of more than
    ``stride`` gets cuts inside, every ``stride`` ids.
    """
    cost = np.full(len(ids) + 1, np.inf)
    cost[np.flatnonzero(stop_ids[ids]) + 1] = SENTENCE
    cost[ends] = DOC
    cost[0] = 0
    known = np.flatnonzero(np.isfinite(cost))
    gaps = np.diff(np.append(known, len(ids)))
    if (wide := gaps > stride).any():
        starts, counts = known[wide], (gaps[wide] - 1) // stride
        within = np.arange(counts.sum()) - np.repeat(counts.cumsum() - counts, counts)
        cost[np.repeat(starts, counts) + (within + 1) * stride] = INSIDE
    points = np.flatnonzero(np.isfinite(cost))
    return points, cost[points]


def best_cuts(points: list[int], costs: list[float], size: int, goes_on: bool = False) -> list[int]:
    """Indexes into ``points`` of the best windows' ends, from the first point (left out) to the last.

    If the stream ``goes_on``, the last window need not end at the last point, but within a window of it.
    """
    at, half, last = np.asarray(points), size // 2, len(points) - 1
    lows = at.searchsorted(at - size).tolist()  # the first point within a window, and the one at half of it (if none: -1)
    halves = at.searchsorted(at - half)
    halves = np.where(at[halves] == at - half, halves, -1).tolist()
    best, back, keys, queue, head, front = [0.0], [-1], [float(points[0])], [0], 0, 0
    for j, p, cost, low, h in zip(range(1, last + 1), points[1:], costs[1:], lows[1:], halves[1:]):
        while front < low:
            head += 1
            front = queue[head]
        value, i = keys[front] + size - p, front
        if h >= 0 and best[h] < value:
            value, i = best[h], h
        value += cost
        best.append(value)
        back.append(i)
        key = value + p
        keys.append(key)
        while keys[queue[-1]] >= key:
            queue.pop()
            if len(queue) == head:
                front = j
                break
        queue.append(j)
    cuts, j = [], last
    if goes_on:
        j = min((k for k in range(1, last + 1) if points[k] > points[-1] - size), key=best.__getitem__)
    while j > 0:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


class Packer:
    """Takes documents one after another and gives the pieces of finished windows."""

    def __init__(self, size: int, stop_ids: np.ndarray, block: int, stride: int):
        self.size, self.stop_ids, self.block, self.stride = size, stop_ids, block, stride
        self.docs: deque[list] = deque()  # id, ids, ids already put out
        self.held = 0
        self.windows = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append([doc_id, ids, 0])
        self.held += len(ids)
        while self.held >= self.block:
            yield from self.flush(False)

    def flush(self, final: bool = True) -> Iterator[tuple]:
        if not self.held:
            return
        ids, taken, n = [], 0, 0
        for d in self.docs:  # at most a block, so that a huge document is packed in parts
            part = d[1][d[2] : d[2] + self.block - taken]
            ids.append(part)
            taken, n = taken + len(part), n + 1
            if taken >= self.block:
                break
        lengths = np.array([len(x) for x in ids])
        left = np.array([len(d[1]) - d[2] for d in islice(self.docs, n)])
        points, costs = cut_points(np.concatenate(ids), lengths.cumsum()[lengths == left], self.stop_ids, self.stride)
        if points[-1] != taken:
            points, costs = np.append(points, taken), np.append(costs, 0.0)
        points = points.tolist()
        goes_on = not final or taken < self.held
        ends = [points[j] for j in best_cuts(points, costs.tolist(), self.size, goes_on)]
        if goes_on:  # the last windows are settled together with what follows
            ends = ends[:-8] or ends[:1]
        lo = 0
        for hi in ends:
            offset = 0
            while lo < hi:
                doc_id, doc, done = d = self.docs[0]
                length = min(hi - lo, len(doc) - done)
                part = doc[done : done + length].astype("<u4")
                yield doc_id, done, length, zlib.crc32(part.tobytes()), len(doc), self.windows, offset
                d[2] += length
                lo, offset, self.held = lo + length, offset + length, self.held - length
                if d[2] == len(doc):
                    self.docs.popleft()
            self.windows += 1


def pack(docs: DataFrame, *, size: int = 1024, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, end_id: int | None = 0, block: int = 1 << 18, stride: int = 16) -> DataFrame:
    """A row per piece: ``(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset)``.

    ``sequence_id`` holds the partition in its upper bits. An empty document without ``end_id`` gives no piece.
    """
    path = vocab or default_path()
    id_type = docs.schema[id_col].dataType
    schema = f"id {id_type.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def run(batches):
        encoder = piece_encoder(path)
        known = encoder.tokenizer.get_vocab(with_added_tokens=True)
        stop_ids = np.zeros(max(known.values()) + 1, bool)
        stop_ids[[i for t, i in known.items() if t[-1] in ".!?Ċ" or t[-2:] in ('."', ".)")]] = True
        packer = Packer(size, stop_ids, block, stride)
        end = np.array([] if end_id is None else [end_id], encoder.dtype)
        first, held, arrow = TaskContext.get().partitionId() << 33, [], None

        def batch():
            columns = list(zip(*held))
            columns[5] = [first + x for x in columns[5]]
            held.clear()
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], arrow), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)

        for b in batches:
            arrow = b.schema.field("id").type
            ids, texts = b["id"].to_pylist(), b["text"].to_pylist()
            for lo in range(0, len(ids), 512):
                for doc_id, got in zip(ids[lo : lo + 512], encoder.encode(texts[lo : lo + 512])):
                    held += packer.add(doc_id, np.concatenate((got, end)))
                if len(held) > BATCH_BYTES // 64:
                    yield batch()
        while packer.held:
            held += packer.flush()
        if held:
            yield batch()

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
