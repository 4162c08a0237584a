"""Tracks with summaries of several widths, for reading any stretch at any resolution.

A stored track is a folder: ``values`` has the intervals, ``zoom`` a row for each stretch of each width in which some position has a value. Both are
partitioned by contig and sorted by position in files that tasks write apart, so that a reader prunes by contig and by Parquet's own ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyridge.sources.scratch import folder

#: Positions of the narrowest stretches, how many times wider those of the next level are, and the number of levels.
FIRST, FACTOR, LEVELS = 160, 4, 8
SUMS = ("n", "low", "high", "total", "squares")


def merged_sums() -> list:
    """Summaries of summaries."""
    return [F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"), F.sum("squares").alias("squares")]


def pieces(track: DataFrame, width: int) -> DataFrame:
    """``(contig, bin, …)``: what each interval adds to each stretch of ``width`` positions that it reaches."""
    known = track.where("end > start AND value IS NOT NULL AND NOT isnan(value)")
    spread = known.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    n = F.least("end", (F.col("bin") + 1) * width) - F.greatest("start", F.col("bin") * width)
    value = F.col("value").cast("double")
    return spread.select("contig", "bin", n.alias("n"), value.alias("low"), value.alias("high"), (value * n).alias("total"), (value * value * n).alias("squares"))


def zoomed(track: DataFrame, *, first: int = FIRST, factor: int = FACTOR, levels: int = LEVELS) -> DataFrame:
    """``(contig, level, start, end, n, low, high, total, squares)`` of ``track`` (contig, start, end, value; half-open, not overlapping).

    Level k has stretches of ``first * factor^k`` positions; n counts positions with a value. Wider stretches are made of the narrowest, of which each task adds up its own first.
    """
    spark, path = track.sparkSession, folder(track.sparkSession, "zoom")
    narrow = pieces(track, first).groupBy("contig", "bin").agg(*merged_sums())
    narrow.write.parquet(path)
    held = spark.read.schema(narrow.schema).parquet(path)
    every = held.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumn("times", F.pow(F.lit(factor), "level").cast("long"))
    found = every.groupBy("contig", "level", "times", F.floor(F.col("bin") / F.col("times")).alias("bin")).agg(*merged_sums())
    width = F.col("times") * first
    return found.select("contig", "level", (F.col("bin") * width).alias("start"), ((F.col("bin") + 1) * width).alias("end"), *SUMS)


def write_track(track: DataFrame, path: str, **widths: int) -> None:
    """``track`` and its summaries as a stored track; what stood at ``path`` is replaced."""
    for name, rows, order in (("values", track.select("contig", "start", "end", "value"), ("start",)), ("zoom", zoomed(track, **widths), ("level", "start"))):
        dealt = rows.repartitionByRange("contig", *order).sortWithinPartitions("contig", *order)
        dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("contig").parquet(f"{path}/{name}")


def read_summary(spark: SparkSession, path: str, contig: str, start: int, end: int, bins: int, *, first: int = FIRST, factor: int = FACTOR, levels: int = LEVELS) -> DataFrame:
    """``(bin, start, end, n, low, high, mean, deviation)`` of equal parts of [start, end) that hold a value.

    Parts are summed up from the widest stretches that are no wider than they, a stretch counting where its start lies; from the intervals themselves where even
    the narrowest are wider. The deviation is that of all positions with a value, divided by n.
    """
    width = (end - start) / bins
    level = max((k for k in range(levels) if first * factor**k <= width), default=None)
    if level is None:
        known = spark.read.parquet(f"{path}/values").where((F.col("contig") == contig) & (F.col("end") > start) & (F.col("start") < end))
        cut = known.select("contig", F.greatest("start", F.lit(start)).alias("start"), F.least("end", F.lit(end)).alias("end"), "value")
        rows = pieces(cut, 1).withColumn("start", F.col("bin"))
    else:
        rows = spark.read.parquet(f"{path}/zoom").where((F.col("contig") == contig) & (F.col("level") == level) & (F.col("start") >= start) & (F.col("start") < end))
    own = rows.withColumn("bin", F.floor((F.col("start") - start) / width)).groupBy("bin").agg(*merged_sums())
    mean = F.col("total") / F.col("n")
    return own.select("bin", (F.lit(start) + F.col("bin") * width).alias("start"), (F.lit(start) + (F.col("bin") + 1) * width).alias("end"), "n", "low", "high", mean.alias("mean"), F.sqrt(F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0))).alias("deviation"))
