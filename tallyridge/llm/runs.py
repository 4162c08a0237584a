"""Periodic runs of words: maximal stretches that repeat with a smallest period, at least twice.

The method is that of linear tandem repeats. Lempel–Ziv blocks (each the longest prefix seen before, or one new word) give the
squares that cover the leftmost occurrence of every square: such a one touches a block's border, and its right half lies in two blocks at
most, so comparisons at borders find it. Suffix-link walks complete the vocabulary: from a square's place in the suffix tree the link
leads to that of its next rotation as long as the word behind it repeats. All occurrences of the vocabulary are located as the leaves below
their places, and those that stand side by side merge into runs.

The suffix tree is held as arrays: ranks of all stretches of 1, 2, 4, … words (equal stretches, equal ranks), whose last level is the
suffix order. A place in the tree is an interval of that order and a length, its suffix link is that of the next position, and the
longest common extension of two positions, forwards or backwards, takes one comparison a level. Comparisons are exact.

A run of at least ``least`` words holds each of its windows of half that many words twice. So only stretches that such recurring windows cover are
searched, each as a text of its own; all others have no run. Many documents are searched at once, none is cut. Memory grows with a
document's covered words (about 200 bytes a word).

Words are runs of characters other than ASCII white space. A null text has no words; null and repeated ids are kept, one result per row.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fewest words of a run.
LEAST = 12
#: Words of documents that are searched together, and comparisons made at a time.
GROUP, STEP = 400_000, 1 << 19
Run = tuple[int, int, int]
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


def recurring(keys: np.ndarray) -> np.ndarray:
    """Which of ``keys`` occur more than once."""
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def covered(keys: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """Which words lie in a window of ``width`` words that recurs in its owner; owners lie end to end. May also hold others, for equal hashes."""
    n = len(keys)
    if n < width:
        return np.zeros(n, bool)
    windows = mixed(owner[: n - width + 1].astype(np.uint64) + np.uint64(1))
    for k in range(width):
        windows = mixed(windows + keys[k : n - width + 1 + k])
    whole = np.flatnonzero(owner[: n - width + 1] == owner[width - 1 :])
    hit = whole[recurring(windows[whole])]
    edges = np.zeros(n + 1, np.int32)
    np.add.at(edges, hit, 1)
    np.add.at(edges, hit + width, -1)
    return edges.cumsum()[:n] > 0


def stretches(keys: np.ndarray, owner: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, stretch): words that a run can hold, and the number of the stretch of each, by which they lie end to end."""
    places = np.arange(len(keys))
    width = -(-least // 2)
    for _ in range(4):  # a stretch that is taken out can leave its copies without one
        keep = covered(keys, owner, width)
        before = len(places)
        places, keys, owner = places[keep], keys[keep], owner[keep]
        if not len(places):
            break
        fresh = np.append(True, (np.diff(places) != 1) | (np.diff(owner) != 0))
        stretch = fresh.cumsum() - 1
        long = np.bincount(stretch)[stretch] >= least
        places, keys, owner = places[long], keys[long], stretch[long]
        if len(places) == before:
            break
    return places, owner


class Ranks:
    """Ranks of all stretches of 2^k symbols, up to where all differ; the last are those of suffixes."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        levels = [np.unique(symbols, return_inverse=True)[1].astype(np.int64)]
        while levels[-1].max() < n - 1:
            width = 1 << (len(levels) - 1)
            ahead = np.zeros(n, np.int64)  # 0: beyond the end
            if width < n:
                ahead[: n - width] = levels[-1][width:] + 1
            levels.append(np.unique(levels[-1] * (n + 1) + ahead, return_inverse=True)[1])
        self.n = n
        self.levels = np.full((len(levels), n + 1), -1, np.int32)
        for k, level in enumerate(levels):
            self.levels[k, :n] = level
        self.rank = self.levels[-1, :n]
        self.order = np.empty(n, np.int32)
        self.order[self.rank] = np.arange(n, dtype=np.int32)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal symbols from positions ``i`` and ``j`` on, which differ."""
        at, by = i.copy(), j - i
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            at += (level[at] == level[at + by]).astype(at.dtype) << k
        return at - i

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal symbols up to positions ``i`` < ``j``, themselves included; none from -1."""
        at, by = i.copy(), j - i
        for k in range(len(self.levels) - 1, -1, -1):
            level, first = self.levels[k], at - (1 << k) + 1
            inside = first >= 0
            first = np.where(inside, first, 0)
            at -= (inside & (level[first] == level[first + by])).astype(at.dtype) << k
        return i - at


def nearest_smaller(x: np.ndarray) -> np.ndarray:
    """The nearest place before each whose value is smaller, -1 if there is none."""
    found = np.arange(len(x)) - 1
    open_ = np.flatnonzero(found >= 0)
    while len(open_):
        open_ = open_[x[found[open_]] > x[open_]]
        found[open_] = found[found[open_]]  # what lies between is larger still
        open_ = open_[found[open_] >= 0]
    return found


def blocks(ranks: Ranks) -> np.ndarray:
    """Starts of the Lempel–Ziv blocks, and the end."""
    longest = np.zeros(ranks.n, np.int64)
    for order in (ranks.order, ranks.order[::-1]):
        near = nearest_smaller(order)
        own = np.flatnonzero(near >= 0)
        i, j = order[own].astype(np.int64), order[near[own]].astype(np.int64)
        np.maximum.at(longest, i, ranks.ahead(i, j))
    lengths, starts, at = np.maximum(longest, 1).tolist(), [], 0
    while at < ranks.n:
        starts.append(at)
        at += lengths[at]
    return np.array([*starts, ranks.n])


def ranges(counts: np.ndarray) -> np.ndarray:
    """0, 1, … for each count, end to end."""
    ends = counts.cumsum()
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def covering_runs(ranks: Ranks, symbols: np.ndarray, least: int) -> np.ndarray:
    """``(start, end, period)`` of the runs that hold the leftmost occurrence of every square, from comparisons at the borders of blocks."""
    starts = blocks(ranks)
    at, after, beyond = starts[:-1], starts[1:], np.append(starts[2:], ranks.n)
    few = -(-least // 2) - 1
    kinds = [
        (after[after < ranks.n], (after - at)[after < ranks.n], -1),  # squares that run over a block's end: the border lies in the right half
        (at[at > 0], (beyond - at)[at > 0], 1),  # squares that start before a block and have their middle in it: the border lies in the left half
        (at[at > 0], np.full((at > 0).sum(), few), -1),  # short periods, whose runs must be longer than two of them
        (at[at > 0], np.full((at > 0).sum(), few), 1),
    ]
    found = [np.empty((0, 3), np.int64)]
    for borders, most, side in kinds:
        room = borders if side < 0 else ranks.n - borders
        most = np.minimum(most, room)
        bounds = np.searchsorted(most.cumsum(), np.arange(STEP, most.sum() + STEP, STEP))
        for lo, hi in zip(np.append(0, bounds[:-1] + 1), np.minimum(bounds + 1, len(most))):
            if lo >= hi:
                continue
            period = ranges(most[lo:hi]) + 1
            border = np.repeat(borders[lo:hi], most[lo:hi])
            left = border - period if side < 0 else border
            right = left + period
            likely = (symbols[left] == symbols[np.minimum(right, ranks.n - 1)]) & (right < ranks.n)
            likely |= (left > 0) & (symbols[left - 1] == symbols[right - 1])
            left, right, period = left[likely], right[likely], period[likely]
            start = left - ranks.behind(left - 1, right - 1)
            end = right + ranks.ahead(left, right)
            wide = end - start >= np.maximum(2 * period, least)
            found.append(np.stack([start[wide], end[wide], period[wide]], axis=1))
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # of one stretch the smallest period; the others are its multiples
    return runs[np.append(True, (np.diff(runs[:, :2], axis=0) != 0).any(axis=1))] if len(runs) else runs


def located(ranks: Ranks, runs: np.ndarray, least: int) -> np.ndarray:
    """``(start, end, period)`` of all runs whose squares the vocabulary of ``runs`` holds."""
    lengths = np.maximum(2 * runs[:, 2], least)
    counts = runs[:, 1] - runs[:, 0] - lengths + 1
    # each rotation is a place in the tree, the suffix link of the one before
    at = np.repeat(runs[:, 0], counts) + ranges(counts)
    period, length = np.repeat(runs[:, 2], counts), np.repeat(lengths, counts)
    level = np.minimum(np.floor(np.log2(length)).astype(np.int64), len(ranks.levels) - 1)
    offset = np.maximum(length - (1 << level), 0)
    head, tail = ranks.levels[level, at], ranks.levels[level, at + offset]
    order = np.lexsort((tail, head, period))
    same = (np.diff(period[order]) == 0) & (np.diff(head[order]) == 0) & (np.diff(tail[order]) == 0)
    one = order[np.append(True, ~same)]
    at, period, level, offset, head, tail = (x[one] for x in (at, period, level, offset, head, tail))

    def equal(item: np.ndarray, place: np.ndarray) -> np.ndarray:
        where = ranks.order[place].astype(np.int64)
        return (ranks.levels[level[item], where] == head[item]) & (ranks.levels[level[item], np.minimum(where + offset[item], ranks.n)] == tail[item])

    rank = ranks.rank[at].astype(np.int64)
    ends = []
    for step, last in ((-1, 0), (1, ranks.n - 1)):
        edge = rank.copy()
        item = np.flatnonzero(rank != last)
        item = item[equal(item, rank[item] + step)]
        inner, outer = rank[item] + step, np.full(len(item), last + step)  # inner is equal, outer is not
        while (open_ := np.abs(outer - inner) > 1).any():
            middle = (inner + outer) // 2
            hit = np.zeros(len(item), bool)
            hit[open_] = equal(item[open_], middle[open_])
            inner, outer = np.where(open_ & hit, middle, inner), np.where(open_ & ~hit, middle, outer)
        edge[item] = inner
        ends.append(edge)
    leaves = ends[1] - ends[0] + 1
    start = ranks.order[np.repeat(ends[0], leaves) + ranges(leaves)].astype(np.int64)
    keys = np.unique(np.repeat(period, leaves) * (ranks.n + 1) + start)
    fresh = np.append(True, np.diff(keys) != 1)
    first, last = keys[fresh], keys[np.append(np.flatnonzero(fresh)[1:] - 1, len(keys) - 1)]
    period, start = first // (ranks.n + 1), first % (ranks.n + 1)
    return np.stack([start, last % (ranks.n + 1) + np.maximum(2 * period, least), period], axis=1)


def find(documents: list[list[bytes]], least: int = LEAST) -> list[list[Run]]:
    """``(start, length, period)`` of the runs of each document, by start, then period."""
    out: list[list[Run]] = [[] for _ in documents]
    sizes = np.array([len(d) for d in documents], np.int64)
    if not sizes.sum():
        return out
    keys = np.concatenate([np.fromiter(map(hash, d), np.int64, len(d)) for d in documents]).view(np.uint64)
    owner = np.repeat(np.arange(len(documents)), sizes)
    firsts = sizes.cumsum() - sizes
    places, stretch = stretches(keys, owner, least)
    if not len(places):
        return out
    own = owner[places]
    number: dict = defaultdict(count().__next__)
    symbols = np.fromiter((number[documents[d][k]] for d, k in zip(own.tolist(), (places - firsts[own]).tolist())), np.int64, len(places))
    symbols += (np.append(True, np.diff(stretch) != 0).cumsum() - 1) * (len(number) + 1)  # stretches share no symbol
    breaks = np.append(np.flatnonzero(np.diff(stretch)) + 1, len(places))
    text = np.insert(symbols, breaks, symbols.max() + 1 + np.arange(len(breaks)))
    back = np.insert(places, breaks, -1)
    ranks = Ranks(text)
    runs = covering_runs(ranks, text, least)
    if len(runs):
        for start, end, period in located(ranks, runs, least).tolist():
            d = owner[back[start]]
            out[d].append((int(back[start] - firsts[d]), end - start, period))
    return [sorted(r, key=lambda run: (run[0], run[2])) for r in out]


def grouped(batches: Iterator, change: Callable[[int | None, list[bytes]], list[bytes]] | None, least: int) -> Iterator[tuple[list, list[list[bytes]], list[list[Run]]]]:
    """(ids, words, runs) of documents of about GROUP words together."""
    ids, held, total = [], [], 0
    for b in batches:
        texts = b["text"].cast(pa.binary())
        for k, i in enumerate(b["id"].to_pylist()):
            words = (texts[k].as_py() or b"").split()
            ids.append(i)
            held.append(change(i, words) if change else words)
            total += len(words)
            if total >= GROUP or len(ids) >= 10_000:
                yield ids, held, find(held, least)
                ids, held, total = [], [], 0
    if ids:
        yield ids, held, find(held, least)


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """Without words that a run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int32)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    gone = gone.cumsum()
    return [w for w, g in zip(words, gone.tolist()) if not g]


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``(id_col, start, length, period)`` of each run, in words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def each(batches):
        for ids, _, runs in grouped(batches, None, least):
            rows = [(i, *run) for i, own in zip(ids, runs) for run in own]
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(("id", "start", "length", "period"), r)) for r in rows])

    return named(docs, id_col, text_col).mapInArrow(each, f"id {kind}, start long, length long, period long").withColumnRenamed("id", id_col)


def collapsed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``(id_col, text_col)``: texts with one period of each run, their words joined by single blanks; null texts become empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def each(batches):
        for ids, words, runs in grouped(batches, None, least):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([b" ".join(kept_words(w, r)).decode() for w, r in zip(words, runs)], pa.string())], names=["id", "text"])

    return named(docs, id_col, text_col).mapInArrow(each, f"id {kind}, text string").withColumnsRenamed({"id": id_col, "text": text_col})


def with_planted_run(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of the documents end in a run, by the checksum of the id; without an id nothing is planted."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (1 + (n - a) // p))[: n - a]


RESULT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def digests(docs: DataFrame) -> DataFrame:
    """A row per document: its runs, the longest of them (ties: the first, then the shortest period), digests of all runs and of what stays of the text."""

    def row(doc_id, words, runs) -> tuple:
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        exponent = 1000 * best[1] // best[2] if runs else None
        all_runs = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        return doc_id, len(runs), *best, exponent, hashlib.sha256(all_runs.encode()).hexdigest(), hashlib.sha256(b" ".join(kept_words(words, runs))).hexdigest()

    def each(batches):
        for group in grouped(batches, with_planted_run, LEAST):
            columns = zip(*(row(*document) for document in zip(*group)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RESULT)], schema=RESULT)

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"))
    return rows.mapInArrow(each, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
