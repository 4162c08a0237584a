"""Centred windows over dense vectors.

Sums come from differences of running sums, whose cost does not depend on the window, and are taken
tile by tile: each tile also gets the positions that its windows reach in its neighbours. Vectors
shorter than the window (fewer rows than it) take their own length as the window, as one group.
Where a tile makes several passes, or its rows, they go over NumPy arrays of the tile.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyridge.operators.dense import TILE, interval_edges


def least_count(window: int, fraction: float = 0.05) -> int:
    """Defined values that a window needs."""
    return max(1, round(window * fraction))


def tiled(vector: DataFrame, left: int, right: int, tile: int = TILE) -> DataFrame:
    """Each row in its own ``tile`` (with ``own``) and in those whose windows reach it."""
    first = F.greatest(F.floor((F.col("pos") - right) / tile), F.lit(0))
    last = F.least(F.floor((F.col("pos") + left) / tile), F.floor((F.col("size") - 1) / tile))
    spread = vector.withColumn("tile", F.explode(F.sequence(first, last)))
    return spread.withColumn("own", F.col("tile") == F.floor(F.col("pos") / tile))


def own_rows(rows: DataFrame) -> DataFrame:
    """Each row of ``tiled`` once, without the columns of tiles."""
    return rows.where("own").drop("own", "tile")


def tile_sums(rows: DataFrame, left: int, right: int, values: dict[str, Column], keys: tuple[str, ...] = ("contig",)) -> DataFrame:
    """``tiled`` rows with the sum of each value over positions [pos - left, pos + right] of their tile."""
    by = Window.partitionBy(*keys, "tile").orderBy("pos")
    so_far, whole = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({f"__v_{k}": v for k, v in values.items()})
    rows = rows.withColumns({f"__s_{k}": F.coalesce(F.sum(f"__v_{k}").over(so_far), F.lit(0)) for k in values} | {f"__t_{k}": F.coalesce(F.sum(f"__v_{k}").over(whole), F.lit(0)) for k in values})
    sums = {k: F.coalesce(F.lead(f"__s_{k}", right).over(by), F.col(f"__t_{k}")) - F.coalesce(F.lag(f"__s_{k}", left + 1).over(by), F.lit(0)) for k in values}
    return rows.withColumns(sums).drop(*(f"__{p}_{k}" for k in values for p in "vst"))


def window_sums(vector: DataFrame, left: int, right: int, values: dict[str, Column], keys: tuple[str, ...] = ("contig",), tile: int = TILE) -> DataFrame:
    """``vector`` with the sum of each value over positions [pos - left, pos + right], cut at the ends."""
    return own_rows(tile_sums(tiled(vector, left, right, tile), left, right, values, keys))


def spread_out(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by ``keys`` over as many tasks as a shuffle has, however small they are: for what becomes many more rows, or long work, in its task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def sums_around(x: np.ndarray, left: int, right: int) -> np.ndarray:
    """The sum over [k - left, k + right] around each value, cut at the ends."""
    so_far, at = np.concatenate((np.zeros(1, x.dtype), x.cumsum())), np.arange(len(x))
    return so_far[np.minimum(at + right + 1, len(x))] - so_far[np.maximum(at - left, 0)]


def max_around(x: np.ndarray, flank: int) -> np.ndarray:
    """The largest value within ``flank`` places, NaN if there is none: of the rest of one block as long as a window, and the start of the next."""
    width = 2 * flank + 1
    blocks = np.full((-(-(len(x) + 2 * flank) // width), width), -np.inf)
    blocks.ravel()[flank : flank + len(x)] = np.where(np.isnan(x), -np.inf, x)
    rest = np.maximum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    start = np.maximum.accumulate(blocks, axis=1).ravel()
    top = np.maximum(rest[: len(x)], start[width - 1 : width - 1 + len(x)])
    return np.where(top == -np.inf, np.nan, top)


def in_order(rows: pa.Table) -> pa.Table:
    """Rows of a tile by position."""
    pos = rows["pos"].to_numpy()
    return rows if (pos[1:] >= pos[:-1]).all() else rows.take(pa.array(np.argsort(pos, kind="stable")))


def numbers(rows: pa.Table, name: str) -> np.ndarray:
    """A column as doubles, NaN for null."""
    return rows[name].to_numpy().astype(np.float64)


def count_sums(cuts: DataFrame, contigs: DataFrame, window: int, fraction: float = 0.05, mappable: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """``(contig, size, pos, agg)``, with ``mappable`` intervals also ``mappable``: what ``running`` sums of the vector that ``densify`` makes of counts.

    Counts go to the tiles that their windows reach before they are made dense, so that no position without a count is dealt.
    """
    half, masked = window // 2, mappable is not None
    known = cuts.join(F.broadcast(contigs.select("contig", "size")), "contig").where("pos >= 0 AND pos < size AND cnt > 0")
    dealt = tiled(known.select("contig", "size", "pos", F.col("cnt").cast("double").alias("cnt")), half, half, tile).drop("own").withColumn("edge", F.lit(0))
    tiles = contigs.where("size > 0").select("contig", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / tile))).alias("tile"))
    dealt = dealt.unionByName(tiles.withColumn("pos", F.col("tile") * tile).withColumns({"cnt": F.lit(0.0), "edge": F.lit(0)}))  # every tile is there
    if masked:
        dealt = dealt.unionByName(interval_edges(mappable, contigs, tile).withColumns({"cnt": F.lit(0.0), "tile": F.floor(F.col("pos") / tile)}))

    def run(rows: pa.Table) -> pa.Table:
        contig, size, start = rows["contig"][0], rows["size"][0].as_py(), rows["tile"][0].as_py() * tile
        end, width = min(start + tile, size), min(window, size)
        right, left = width // 2, width - 1 - width // 2
        low, high = max(start - left, 0), min(end + right, size)
        pos, x = rows["pos"].to_numpy(), np.zeros(high - low)
        near = (pos >= low) & (pos < high)
        np.maximum.at(x, pos[near] - low, rows["cnt"].to_numpy()[near])
        own = slice(start - low, end - low)
        thin = sums_around(np.ones(len(x), np.int64), left, right)[own] < (max(1, round(width * fraction)) if fraction else 1)
        n = end - start
        columns = {"contig": pa.repeat(contig, n), "size": pa.repeat(pa.scalar(size, pa.int64()), n), "pos": pa.array(np.arange(start, end)), "agg": pa.array(sums_around(x, left, right)[own], mask=thin)}
        if masked:
            edges, own_pos = rows["edge"].to_numpy(), (pos >= start) & (pos < end)
            inside = np.zeros(n, np.int64)
            np.add.at(inside, pos[own_pos] - start, edges[own_pos])
            columns["mappable"] = pa.array(inside.cumsum() > 0)
        return pa.table(columns)

    kinds = "contig string, size long, pos long, agg double" + (", mappable boolean" if masked else "")
    return spread_out(dealt, "contig", "tile").groupBy("contig", "tile").applyInArrow(run, kinds)


def running(vector: DataFrame, window: int, what: str, fraction: float | None = 0.05, keys: tuple[str, ...] = ("contig",), tile: int = TILE) -> DataFrame:
    """``vector`` with ``agg``: the centred ``sum``, ``mean`` or ``var`` (of n - 1) over an odd window.

    Null where fewer values than ``fraction`` of the window are defined.
    """
    assert window % 2, "the window must be odd"
    half = window // 2
    # whole numbers add up without rounding
    x = F.col("x")
    values = {"n": F.col("x").isNotNull().cast("long"), "s": x} | ({"q": x * x} if what == "var" else {})
    rows = window_sums(vector.where(F.col("size") >= window), half, half, values, keys, tile)
    n, s = F.col("n"), F.col("s")
    value = {"sum": s, "mean": F.try_divide(s, n)}.get(what)
    if what == "var":
        value = F.when(n > 1, (F.col("q") - s * s / n) / (n - 1))
    enough = least_count(window, fraction) if fraction else 1
    wide = rows.withColumn("agg", F.when(n >= enough, value).cast("double")).drop("n", "s", "q")
    return wide.unionByName(_short(vector.where(F.col("size") < window), what, fraction, keys))


def _short(vector: DataFrame, what: str, fraction: float | None, keys: tuple[str, ...]) -> DataFrame:
    """Vectors that are shorter than a window, each a group of fewer rows than it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        x = rows["x"].to_numpy(np.float64)
        w = len(x)
        right, left = w // 2, w - 1 - w // 2
        at = np.arange(w)
        lo, hi = np.maximum(at - left, 0), np.minimum(at + right, w - 1) + 1
        over = lambda v: (c := np.concatenate(([0.0], np.nancumsum(v))))[hi] - c[lo]
        n, s = over(np.isfinite(x).astype(float)), over(x)
        with np.errstate(divide="ignore", invalid="ignore"):
            agg = {"sum": lambda: s, "mean": lambda: s / n, "var": lambda: np.where(n > 1, (over(x * x) - s * s / n) / (n - 1), np.nan)}[what]()
        agg = np.where(n >= (max(1, round(w * fraction)) if fraction else 1), agg, np.nan)
        return rows.assign(agg=pd.Series(agg, rows.index).astype(object).where(np.isfinite(agg), None))

    return vector.groupBy(*keys).applyInPandas(run, vector.withColumn("agg", F.lit(0.0)).schema.simpleString().removeprefix("struct<").removesuffix(">"))


#: What sorts the rows of ``tile_max`` by position.
IN_BLOCKS = ("__block", "pos")


def tile_max(rows: DataFrame, flank: int, left: int, right: int, tile: int, keys: tuple[str, ...] = ("contig",)) -> DataFrame:
    """Rows of ``tiled(…, left, right, tile)`` with ``top``: the largest defined value within ``flank`` positions of their tile, null if there is none.

    Positions are cut into blocks as long as a window. A window lies in two of them at most, so its maximum is that of the rest of one block from
    its first position on, and that of the next one up to its last: two ordered passes, whatever the flank. Rows keep ``__block``.
    """
    pos, width = F.col("pos"), 2 * flank + 1
    first = F.greatest(F.col("tile") * tile - left, F.lit(0))
    last = F.least((F.col("tile") + 1) * tile - 1 + right, F.col("size") - 1)
    block = lambda at: F.floor((at - first) / width)
    within = Window.partitionBy(*keys, "tile", "__block")
    so_far = (Window.unboundedPreceding, 0)
    rows = rows.withColumn("__block", block(pos)).repartition(*keys, "tile")
    rows = rows.withColumn("__rest", F.max("x").over(within.orderBy(F.desc("pos")).rowsBetween(*so_far)))
    rows = rows.withColumn("__start", F.max("x").over(within.orderBy("pos").rowsBetween(*so_far)))
    by = Window.partitionBy(*keys, "tile").orderBy(*IN_BLOCKS)
    rest, start = F.lag("__rest", flank).over(by), F.lead("__start", flank).over(by)
    end = F.last("__start").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # of the last block
    before, behind = pos - flank < first, pos + flank > last
    top = F.when(before, F.when(behind, end).otherwise(start)).otherwise(F.greatest(rest, F.when(~behind, start).when(block(last) > block(pos - flank), end)))
    return rows.withColumn("top", top).drop("__rest", "__start")


def running_max(vector: DataFrame, flank: int, keys: tuple[str, ...] = ("contig",), tile: int = TILE) -> DataFrame:
    """``vector`` with ``top``: the largest defined value within ``flank`` positions, null if there is none."""
    return own_rows(tile_max(tiled(vector, flank, flank, tile), flank, flank, flank, tile, keys)).drop("__block")


def neighbours(rows: DataFrame, order: str, wanted: dict[str, tuple[str, int]], keys: tuple[str, ...] = ("contig",), tile: int = TILE) -> DataFrame:
    """``rows`` with columns of the row before (-1) or after (1) along their keys: ``wanted`` has ``{name: (column, side)}``; null where there is none.

    Rows find their neighbours within tiles of positions; only the first and last of each tile look over their keys.
    """
    side = lambda name, by: (F.lag if wanted[name][1] < 0 else F.lead)(F.struct(F.col(wanted[name][0]).alias("v"))).over(by)
    inner, outer = Window.partitionBy(*keys, "__tile").orderBy(order), Window.partitionBy(*keys).orderBy(order)
    dealt = rows.withColumn("__tile", F.floor(F.col(order) / tile)).repartition(*keys, "__tile")
    dealt = dealt.withColumns({f"__{n}": side(n, inner) for n in wanted} | {"__edge": F.lag(F.lit(True)).over(inner).isNull() | F.lead(F.lit(True)).over(inner).isNull()})
    edges = dealt.where("__edge").withColumns({f"__{n}": F.coalesce(F.col(f"__{n}"), side(n, outer)) for n in wanted})
    both = dealt.where("NOT __edge").unionByName(edges)
    return both.select(*rows.columns, *(F.col(f"__{n}.v").alias(n) for n in wanted))


def signal_mask(vector: DataFrame, threshold: Column, flank: int = 0, keys: tuple[str, ...] = ("contig",)) -> DataFrame:
    """``vector`` with ``signal``: whether a value within ``flank`` reaches the threshold; never for undefined ones."""
    rows = running_max(vector, flank, keys) if flank else vector.withColumn("top", F.col("x"))
    return rows.withColumn("signal", F.coalesce(F.col("top") >= threshold, F.lit(False))).drop("top")


def around_ends(vector: DataFrame, reach: int) -> DataFrame:
    """``vector`` with copies of each end's ``reach`` positions beyond the other one (``__turn`` is not 0); positions are moved up by ``reach``."""
    last = F.when(F.col("pos") < reach, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    turns = F.when(F.col("pos") >= F.col("size") - reach, F.array_append(last, F.lit(-1))).otherwise(last)
    around = vector.withColumn("__turn", F.explode(turns))
    return around.withColumns({"pos": F.col("pos") + F.col("__turn") * F.col("size") + reach, "size": F.col("size") + 2 * reach})


def triangle_smooth(vector: DataFrame, level: int = 7, keys: tuple[str, ...] = ("contig",), tile: int = TILE) -> DataFrame:
    """``vector`` with ``smoothed``: the Haar wavelet approximation of a level, wrapped around the contig's ends.

    Its kernel is a triangle of half-width P = 2^level: two running sums of P positions, divided by P².
    """
    width = 1 << level
    reach = width - 1
    placed = around_ends(vector.where(F.col("size") > reach), reach)
    once = tile_sums(tiled(placed, reach, reach, tile), 0, reach, {"__once": F.col("x")}, keys)
    twice = own_rows(tile_sums(once, reach, 0, {"__twice": F.col("__once")}, keys)).where("__turn = 0")
    wide = twice.withColumns({"pos": F.col("pos") - reach, "size": F.col("size") - 2 * reach, "smoothed": F.col("__twice") / (width * width)}).drop("__turn", "__once", "__twice")
    return wide.unionByName(_short_triangle(vector.where(F.col("size") <= reach), width, keys))


def _short_triangle(vector: DataFrame, width: int, keys: tuple[str, ...]) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        x = rows["x"].to_numpy(np.float64)
        out = np.zeros(len(x))
        for d in range(1 - width, width):
            out += (width - abs(d)) * np.roll(x, -d)
        return rows.assign(smoothed=out / (width * width))

    return vector.groupBy(*keys).applyInPandas(run, vector.withColumn("smoothed", F.lit(0.0)).schema.simpleString().removeprefix("struct<").removesuffix(">"))
