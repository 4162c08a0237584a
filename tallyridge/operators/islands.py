"""Runs of marked positions, and regions made of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyridge.operators.dense import TILE
from tallyridge.operators.windows import neighbours, window_sums


def dilate(vector: DataFrame, marked: Column, window: int = 151, least: int = 1, keys: tuple[str, ...] = ("contig",)) -> DataFrame:
    """``vector`` with ``inside``: whether the window around a position has at least ``least`` marked ones."""
    half = window // 2
    sums = window_sums(vector, half, half, {"__k": F.coalesce(marked, F.lit(False)).cast("long")}, keys)
    return sums.withColumn("inside", F.col("__k") >= least).drop("__k")


def islands(marked: DataFrame, keys: tuple[str, ...] = ("contig",), tile: int = TILE) -> DataFrame:
    """``(keys, start, end)``: maximal runs of the positions in ``marked``, half-open.

    Runs are found tile by tile; those that meet at a tile's edge are then joined, over the few runs alone.
    """
    by = Window.partitionBy(*keys, "tile").orderBy("pos")
    rows = marked.select(*keys, "pos", F.floor(F.col("pos") / tile).alias("tile")).withColumn("run", F.col("pos") - F.row_number().over(by))
    runs = rows.groupBy(*keys, "tile", "run").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))
    at_edge = (F.col("start") % tile == 0) | (F.col("end") % tile == 0)
    along = Window.partitionBy(*keys).orderBy("start")
    fresh = F.coalesce(F.lag("end").over(along) < F.col("start"), F.lit(True))
    numbered = runs.where(at_edge).withColumn("fresh", fresh.cast("int")).withColumn("k", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.groupBy(*keys, "k").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("k")
    return runs.where(~at_edge).select(*keys, "start", "end").unionByName(joined)


def spread(runs: DataFrame, sizes: DataFrame, reach: int, keys: tuple[str, ...] = ("contig",)) -> DataFrame:
    """``(keys, start, end)``: runs, apart from one another, made longer by ``reach`` on either side as far as their contig goes; those that then meet are one."""
    around = neighbours(runs, "start", {"before": ("end", -1), "after": ("start", 1)}, keys)
    apart = lambda gap: F.coalesce(gap > 2 * reach, F.lit(True))
    bounds = around.select(*keys, "start", "end", apart(F.col("start") - F.col("before")).alias("first"), apart(F.col("after") - F.col("end")).alias("last")).where("first OR last")
    # behind a first run that is not the last comes the last one
    whole = neighbours(bounds, "start", {"until": ("end", 1)}, keys).where("first").withColumn("end", F.when(F.col("last"), F.col("end")).otherwise(F.col("until")))
    start, end = F.greatest(F.col("start") - reach, F.lit(0).cast("long")), F.least(F.col("end") + reach, F.col("size"))
    # a row per contig
    return whole.join(F.broadcast(sizes), list(keys)).select(*keys, start.alias("start"), end.alias("end"))


def in_intervals(rows: DataFrame, intervals: DataFrame, keys: tuple[str, ...] = ("contig",), bin_size: int = 1 << 12, how: str = "inner") -> DataFrame:
    """Pairs of rows and the half-open ``intervals`` that hold their ``pos``, by way of equal bins of positions."""
    bins = intervals.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.greatest(F.col("end") - 1, F.col("start"))) / bin_size))))
    at = rows.withColumn("__bin", F.floor(F.col("pos") / bin_size))
    same = [at[k] == bins[k] for k in (*keys, "__bin")]
    joined = at.join(bins, [*same, at["pos"] >= bins["start"], at["pos"] < bins["end"]], how)
    for k in (*keys, "__bin"):
        joined = joined.drop(bins[k])
    return joined.drop("__bin")


def regions(vector: DataFrame, score: str, threshold: float, window: int = 151, keys: tuple[str, ...] = ("contig",)) -> DataFrame:
    """Islands of dilated significant positions: ``(keys, start, end, max_score, n_significant, stretches)``.

    ``stretches`` are the runs of significant positions, relative to the start, in order. Only significant positions are dealt.
    """
    hits = vector.where(F.col(score) >= threshold)
    spans = spread(islands(hits, keys), hits.groupBy(*keys).agg(F.max("size").alias("size")), window // 2, keys)
    stretches = islands(hits, keys).select(*keys, F.col("start").alias("pos"), F.col("end").alias("until"))
    owned = in_intervals(stretches, spans, keys).groupBy(*keys, "start", "end").agg(
        F.sort_array(F.collect_list(F.struct((F.col("pos") - F.col("start")).alias("start"), (F.col("until") - F.col("start")).alias("end")))).alias("stretches"), F.sum(F.col("until") - F.col("pos")).alias("n_significant")
    )
    best = in_intervals(hits.select(*keys, "pos", score), spans, keys).groupBy(*keys, "start", "end").agg(F.max(score).alias("max_score"))
    return best.join(owned, [*keys, "start", "end"]).select(*keys, "start", "end", "max_score", "n_significant", "stretches")


#: Levels of the pyramid within a tile, and all.
TILE_LEVELS, LEVELS = TILE.bit_length() - 1, 62


def block_maxima(scores: DataFrame, score: str) -> DataFrame:
    """``(contig, level, block, best)``: the largest score of positions [block * 2^level, (block + 1) * 2^level), where there is one.

    A tile makes its levels at once; levels above are of the tiles' maxima alone. There are about two rows per position with a score.
    """

    def levels(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        at, best, parts = rows["pos"].to_numpy(), rows["best"].to_numpy(), []
        for level in range(TILE_LEVELS + 1):
            at = at >> (1 if level else 0)
            first = np.flatnonzero(np.append(True, np.diff(at) != 0))
            at, best = at[first], np.maximum.reduceat(best, first)
            parts.append(pd.DataFrame({"level": np.int32(level), "block": at, "best": best}))
        return pd.concat(parts).assign(contig=rows["contig"].iloc[0])[["contig", "level", "block", "best"]]

    known = scores.select("contig", "pos", F.col(score).cast("double").alias("best")).where("best IS NOT NULL AND NOT isnan(best)")
    tiles = known.groupBy("contig", F.floor(F.col("pos") / TILE).alias("tile")).applyInPandas(levels, "contig string, level int, block long, best double")
    more = tiles.where(F.col("level") == TILE_LEVELS).select("contig", F.explode(F.sequence(F.lit(1), F.lit(LEVELS - TILE_LEVELS))).alias("up"), "block", "best")
    above = more.groupBy("contig", (F.col("up") + TILE_LEVELS).alias("level"), F.expr("shiftright(block, up)").alias("block")).agg(F.max("best").alias("best"))
    return tiles.unionByName(above)


def blocks_of(start: str, end: str) -> Column:
    """The blocks, ``(level, block)``, that make up positions [start, end): two of a level at most, so twice the logarithm of the length."""
    low, high = f"shiftright({start} + shiftleft(1L, l) - 1, l)", f"shiftright({end}, l)"
    levels = f"sequence(0, CAST(floor(log2(greatest({end} - {start}, 1))) AS INT) + 1)"
    left = f"IF({low} < {high} AND {low} % 2 = 1, named_struct('level', l, 'block', {low}), NULL)"
    right = f"IF({low} < {high} AND {high} % 2 = 1, named_struct('level', l, 'block', {high} - 1), NULL)"
    return F.expr(f"array_compact(flatten(transform({levels}, l -> array({left}, {right}))))")


def interval_max(intervals: DataFrame, scores: DataFrame, score: str = "neglog10_p", row: str | None = None) -> DataFrame:
    """``intervals`` with ``max_neglog_p``: the largest score in [start, end), at least 0; 0 where there is none, or a bound is null. Other columns pass through.

    Intervals meet a pyramid of block maxima, in as many rows as they have blocks, however long they are and however much they overlap. ``row`` names a column for
    the number of each row as it is read, by which the order of the input comes back.
    """
    number = row or "__row"
    numbered = intervals.withColumn(number, F.monotonically_increasing_id()).withColumns({"__lo": F.when(F.col("start") < 0, 0).otherwise(F.col("start")).cast("long"), "__hi": F.col("end").cast("long")})
    wanted = numbered.withColumn("__block", F.explode_outer(blocks_of("__lo", "__hi"))).withColumns({"__level": F.col("__block.level"), "__block": F.col("__block.block")})
    pyramid = block_maxima(scores, score).select(F.col("contig").alias("__contig"), "level", "block", "best")
    met = wanted.join(pyramid.hint("merge"), (F.col("contig") == F.col("__contig")) & (F.col("__level") == F.col("level")) & (F.col("__block") == F.col("block")), "left")
    own = [c for c in (*intervals.columns, *([row] if row else [])) if c != number]
    kept = F.first(F.struct(*(met[c] for c in own))).alias("__own")
    found = met.groupBy(number).agg(kept, F.max("best").alias("__best"))
    return found.select(*(F.col(f"__own.{c}").alias(c) for c in own), *([number] if row else []), F.greatest(F.coalesce("__best", F.lit(0.0)), F.lit(0.0)).alias("max_neglog_p"))
