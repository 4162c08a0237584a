"""Peaks of a smoothed vector: extrema, trimming, and rows of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyridge.operators.dense import TILE
from tallyridge.operators.islands import in_intervals
from tallyridge.operators.windows import neighbours

KEYS = ("contig",)


def level_runs(vector: DataFrame, keys: tuple[str, ...] = KEYS, tile: int = TILE) -> DataFrame:
    """``(keys, start, end, x)``: maximal runs of one value.

    Runs within a tile are found there; only those at a tile's edges meet over the whole contig.
    """
    by = Window.partitionBy(*keys, "tile").orderBy("pos")
    rows = vector.select(*keys, "pos", "x", F.floor(F.col("pos") / tile).alias("tile"))
    rows = rows.withColumn("fresh", F.coalesce(F.lag("x").over(by) != F.col("x"), F.lit(True)))
    starts = rows.where("fresh").withColumns({"next": F.lead("pos").over(by)})
    tops = rows.groupBy(*keys, "tile").agg((F.max("pos") + 1).alias("stop"), F.min("pos").alias("begin"))
    runs = starts.join(tops, [*keys, "tile"]).select(*keys, F.col("pos").alias("start"), F.coalesce("next", "stop").alias("end"), "x", ((F.col("pos") == F.col("begin")) | F.col("next").isNull()).alias("edge"))
    along = Window.partitionBy(*keys).orderBy("start")
    edges = runs.where("edge").withColumn("new", (~F.coalesce((F.lag("end").over(along) == F.col("start")) & (F.lag("x").over(along) == F.col("x")), F.lit(False))).cast("int"))
    edges = edges.withColumn("k", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    joined = edges.groupBy(*keys, "k").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("x").alias("x")).drop("k")
    return runs.where("NOT edge").select(*keys, "start", "end", "x").unionByName(joined)


def extrema(vector: DataFrame, keys: tuple[str, ...] = KEYS, tile: int = TILE) -> DataFrame:
    """``(keys, pos, kind)``: strict local maxima and minima; a level one counts at its middle, the ends never."""
    runs = level_runs(vector, keys, tile)
    before = runs.select(*keys, F.col("end").alias("start"), F.col("x").alias("left"))
    after = runs.select(*keys, F.col("start").alias("end"), F.col("x").alias("right"))
    inner = runs.join(before, [*keys, "start"]).join(after, [*keys, "end"])
    kind = F.when((F.col("x") > F.col("left")) & (F.col("x") > F.col("right")), "max").when((F.col("x") < F.col("left")) & (F.col("x") < F.col("right")), "min")
    return inner.select(*keys, F.floor((F.col("start") + F.col("end") - 1) / 2).alias("pos"), kind.alias("kind")).where("kind IS NOT NULL")


def summits(vector: DataFrame, contigs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``(keys, summit, left, right)``: each maximum with the minima around it; 0 and size - 1 stand for missing ones."""
    ordered = neighbours(extrema(vector, keys), "pos", {"left": ("pos", -1), "right": ("pos", 1)}, keys)
    tops = ordered.where("kind = 'max'").join(contigs.select(*keys, "size"), list(keys))
    return tops.select(*keys, F.col("pos").alias("summit"), F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("right", F.col("size") - 1).alias("right"))


def inside(tops: DataFrame, spans: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Those whose summit lies in one of ``spans``."""
    return in_intervals(tops.withColumn("pos", F.col("summit")), spans, keys).select(*tops.columns)


def trimmed(tops: DataFrame, vector: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``(keys, start, summit, end, height, cutoff)``: bounds drawn in to the cutoff, the end being inclusive.

    The cutoff is the largest of half the summit and the values at the outer bounds. The start is
    the last position before the summit that does not exceed it, the end the one before the first behind it.
    """
    spans = tops.select(*keys, F.col("left").alias("start"), (F.col("right") + 1).alias("end"), "summit")
    held = in_intervals(vector.select(*keys, "pos", "x"), spans, keys)
    peak = Window.partitionBy(*keys, "summit")
    at = lambda place: F.max(F.when(F.col("pos") == place, F.col("x"))).over(peak)
    held = held.withColumns({"height": at(F.col("summit")), "cutoff": F.greatest(at(F.col("start")), at(F.col("summit")) / 2, at(F.col("end") - 1))})
    low = held.where("x <= cutoff")
    return low.groupBy(*keys, "summit", "height", "cutoff").agg(F.max(F.when(F.col("pos") <= F.col("summit"), F.col("pos"))).alias("start"), (F.min(F.when(F.col("pos") >= F.col("summit"), F.col("pos"))) - 1).alias("end"))


def peaks(tops: DataFrame, vector: DataFrame, contigs: DataFrame, total: DataFrame, half_width: int = 10, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``(keys, start, end, summit, summit_density, max_density, smoothed_peak_height)`` of trimmed peaks, half-open.

    Each side is at least ``half_width`` wide; bounds beyond the contig's ends are drawn in. ``vector`` has ``pos``, ``x`` and ``density``.
    Bounds are those of ``trimmed``, but positions meet peaks once: whatever a peak may need comes with it, and all else is found within the peak.
    """
    wide = tops.join(contigs.select(*keys, "size"), list(keys))
    spans = wide.select(*keys, "summit", "left", "right", "size", F.least("left", F.col("summit") - half_width).alias("start"), (F.greatest("right", F.col("summit") + half_width) + 1).alias("end"))
    held = in_intervals(vector.select(*keys, "pos", "x", "density"), spans, keys)
    peak = Window.partitionBy(*keys, "summit")
    at = lambda place: F.max(F.when(F.col("pos") == F.col(place), F.col("x"))).over(peak)
    held = held.withColumn("height", at("summit")).withColumn("cutoff", F.greatest(at("left"), F.col("height") / 2, at("right")))
    low = F.when((F.col("x") <= F.col("cutoff")) & F.col("pos").between(F.col("left"), F.col("right")), F.col("pos"))
    first, last = F.max(F.when(low <= F.col("summit"), low)).over(peak), F.min(F.when(low >= F.col("summit"), low)).over(peak) - 1
    start = F.greatest(F.least(first, F.col("summit") - half_width), F.lit(0))
    end = F.least(F.greatest(last, F.col("summit") + half_width) + 1, F.col("size"))
    inside = held.withColumns({"start": start, "end": end}).where("pos >= start AND pos < end").groupBy(*keys, "summit", "start", "end", "height")
    found = inside.agg(F.max(F.when(F.col("pos") == F.col("summit"), F.col("density"))).alias("summit_density"), F.max("density").alias("max_density"))
    rows = found.crossJoin(F.broadcast(total)).withColumn("smoothed_peak_height", F.col("height") / F.col("total") * F.lit(1e6))
    return rows.select(*keys, "start", "end", "summit", "summit_density", "max_density", "smoothed_peak_height")
