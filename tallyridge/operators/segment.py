"""Segments of even background along a contig, by penalised change points.

Every ``step``-th background value is an observation of a negative binomial whose odds are a multiple of
the contig's own. The multiples are the states of a chain; the likeliest path, less a penalty for each
boundary, gives the segments, and ones shorter than the least length join the neighbour that fits them better.

The path is found tile by tile. A tile of observations reduces to a matrix: the best score from each state before it to each state at its end. Over
the matrices of a contig, in order, best scores and then the best states at the tiles' edges follow; between them each tile traces its own
path. Runs of a state, a few for each tile, are then settled over the contig. So no task holds more of a contig than a tile's observations, a
matrix for each tile, and its runs.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyridge.functions.special import lgamma
from tallyridge.sources.scratch import folder

#: Observations of a tile.
TILE = 4_096
STATES = tuple([float(k) for k in range(10, 1, -1)] + [1.0] + [1 / k for k in range(2, 11)])


def log_likelihoods(values: np.ndarray, r: float, p: float) -> np.ndarray:
    """Of each observation (rows) in each state, up to a term of the observation alone."""
    odds = np.array(STATES) * p / (1 - p)
    prob = odds / (1 + odds)
    return lgamma(values + r)[:, None] - lgamma(values + 1)[:, None] + values[:, None] * np.log(prob) + r * np.log1p(-prob)


def best_path(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The state of each observation on the best path."""
    n, k = scores.shape
    back = np.zeros((n, k), np.int16)
    total = scores[0].copy()
    for t in range(1, n):
        top = int(total.argmax())
        moved = total[top] - penalty > total
        back[t] = np.where(moved, top, np.arange(k))
        total = np.where(moved, total[top] - penalty, total) + scores[t]
    path = np.empty(n, np.int64)
    path[-1] = total.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def tile_matrix(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best score from each state before the tile (rows) to each state of its last observation (columns)."""
    k = scores.shape[1]
    total = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)
    for row in scores:
        total = np.maximum(total, total.max(axis=1, keepdims=True) - penalty) + row
    return total


def edge_states(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """(state before, state at the end) of each tile on the best path; -1 before the first."""
    before = [np.zeros(matrices[0].shape[0])]  # before the first all states are as good
    for m in matrices:
        before.append((before[-1][:, None] + m).max(axis=0))
    out, state = [], int(before[-1].argmax())
    for k in range(len(matrices) - 1, -1, -1):
        came = int((before[k] + matrices[k][:, state]).argmax())
        out.append((came if k else -1, state))
        state = came
    return out[::-1]


def tile_path(scores: np.ndarray, penalty: float, before: int, last: int) -> np.ndarray:
    """The state of each observation of a tile on the best path between two states; any state may come before the first tile."""
    n, k = scores.shape
    back = np.zeros((n, k), np.int16)
    total = np.zeros(k) if before < 0 else np.where(np.arange(k) == before, 0.0, -np.inf)
    for t in range(n):
        top = int(total.argmax())
        moved = total[top] - penalty > total
        back[t] = np.where(moved, top, np.arange(k))
        total = np.where(moved, total[top] - penalty, total) + scores[t]
    path = np.empty(n, np.int64)
    path[-1] = last
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def runs_of(pos: np.ndarray, scores: np.ndarray, path: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first position, state, sums of scores by state) of each run of one state."""
    first = np.append(0, np.flatnonzero(np.diff(path)) + 1)
    return pos[first], path[first], np.add.reduceat(scores, first, axis=0)


def settled(starts: list[int], sums: list[np.ndarray], size: int, least: int) -> list[tuple[int, int, float]]:
    """(start, end, state) that cover the contig: short parts join a neighbour, the shortest first."""
    n, sums = len(starts), list(sums)
    starts, ends = [0, *starts[1:]], [*starts[1:], size]
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    there, left = [True] * n, n
    waiting = [(ends[k] - starts[k], starts[k], k) for k in range(n)]
    heapify(waiting)
    while left > 1:
        length, _, k = heappop(waiting)
        if not there[k] or length != ends[k] - starts[k]:
            continue  # has joined another, or is longer since
        if length >= least:
            break
        j = max((sums[k][sums[j].argmax()], j) for j in (before[k], after[k]) if j >= 0)[1]
        a, b = min(j, k), max(j, k)
        sums[a], ends[a], after[a], there[b] = sums[j] + sums[k], ends[b], after[b], False
        if after[b] >= 0:
            before[after[b]] = a
        left -= 1
        heappush(waiting, (ends[a] - starts[a], starts[a], a))
    out: list[tuple[int, int, float]] = []
    for start, end, total in ((starts[k], ends[k], sums[k]) for k in range(n) if there[k]):
        state = STATES[int(total.argmax())]
        if out and out[-1][2] == state:
            out[-1] = (out[-1][0], end, state)
        else:
            out.append((start, end, state))
    return out


def segments_of(pos: np.ndarray, values: np.ndarray, r: float, p: float, size: int, penalty: float, least: int) -> list[tuple[int, int, float]]:
    """(start, end, state) that cover the contig, from one path over all observations."""
    scores = log_likelihoods(values, r, p)
    starts, _, sums = runs_of(pos, scores, best_path(scores, penalty))
    return settled(starts.tolist(), list(sums), size, least)


def observations(vector: DataFrame, fits: DataFrame, thresholds: DataFrame, step: int, tile: int) -> DataFrame:
    """``(contig, tile, pos, x, size, r, p)`` of every ``step``-th value below its local threshold, of contigs with a fit."""
    points = vector.where(F.col("pos") % step == 0).where("x IS NOT NULL").join(thresholds.select("contig", "pos", "threshold"), ["contig", "pos"]).where("x < threshold")
    joined = points.join(fits.where("r IS NOT NULL").select("contig", "r", "p"), "contig")
    return joined.select("contig", F.floor(F.col("pos") / (step * tile)).alias("tile"), "pos", F.floor("x").cast("double").alias("x"), "size", "r", "p")


def segments(vector: DataFrame, fits: DataFrame, thresholds: DataFrame, *, step: int = 500, penalty: float = 20.0, least: int = 50_001, tile: int = TILE) -> DataFrame:
    """``(contig, segment, start, end, state)``; a contig without a fit, or with fewer than ``least // step`` observations (one at least), has none.

    ``fits`` has ``r`` and ``p`` of each contig, ``thresholds`` the local threshold of each position.
    """
    spark, path = vector.sparkSession, folder(vector.sparkSession, "observations")
    found = observations(vector, fits, thresholds, step, tile)
    found.write.parquet(path)
    points = spark.read.schema(found.schema).parquet(path)
    few = max(1, least // step)
    scores_of = lambda rows: log_likelihoods(rows["x"].to_numpy(), rows["r"].iloc[0], rows["p"].iloc[0])

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        matrix = tile_matrix(scores_of(rows.sort_values("pos")), penalty)
        return pd.DataFrame([(rows["contig"].iloc[0], rows["tile"].iloc[0], len(rows), matrix.ravel().tolist())], columns=["contig", "tile", "n", "matrix"])

    def along(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("tile")
        ends = edge_states([np.array(m).reshape(len(STATES), len(STATES)) for m in rows["matrix"]])
        found = pd.DataFrame({"contig": rows["contig"], "tile": rows["tile"], "before": [b for b, _ in ends], "last": [e for _, e in ends]})
        return found if rows["n"].sum() >= few else found.iloc[:0]

    def trace(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        scores = scores_of(rows)
        path = tile_path(scores, penalty, int(rows["before"].iloc[0]), int(rows["last"].iloc[0]))
        starts, states, sums = runs_of(rows["pos"].to_numpy(), scores, path)
        return pd.DataFrame({"contig": rows["contig"].iloc[0], "start": starts, "state": states, "sums": sums.tolist(), "size": rows["size"].iloc[0]})

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("start")
        fresh = np.append(True, np.diff(rows["state"]) != 0)  # a run may go on in the next tile
        sums = np.add.reduceat(np.stack(rows["sums"].to_list()), np.flatnonzero(fresh), axis=0)
        parts = settled(rows["start"].to_numpy()[fresh].tolist(), list(sums), int(rows["size"].iloc[0]), least)
        return pd.DataFrame([(rows["contig"].iloc[0], k, a, b, s) for k, (a, b, s) in enumerate(parts)], columns=["contig", "segment", "start", "end", "state"])

    matrices = points.groupBy("contig", "tile").applyInPandas(reduce, "contig string, tile long, n long, matrix array<double>")
    edges = matrices.groupBy("contig").applyInPandas(along, "contig string, tile long, before int, last int")
    runs = points.join(edges, ["contig", "tile"]).groupBy("contig", "tile").applyInPandas(trace, "contig string, start long, state int, sums array<double>, size long")
    return runs.groupBy("contig").applyInPandas(settle, "contig string, segment int, start long, end long, state double")


def segment_step(length: Column, mappable: Column, step: int = 1_500, floor: int = 20) -> Column:
    """How sparsely a segment is sampled for its fit: in proportion to its length, halves to the even number."""
    return F.greatest(F.lit(floor), F.bround(F.lit(step) / mappable * length).cast("int"))
