"""From reads to counts to dense vectors.

A dense vector is ``(contig, size, pos, x)`` with a row for each position from 0 to size - 1; a null
``x`` is undefined. Work is dealt in tiles of positions, so that no task holds a whole contig.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyridge.sources.scratch import folder

TILE = 1 << 17


def reads_to_cuts(reads: DataFrame, contigs: DataFrame | None = None) -> DataFrame:
    """Counts of cut positions: a read's start on the + strand, else its (exclusive) end.

    With ``contigs``, reads of others and positions outside are left out.
    """
    at = reads.select("contig", F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end")).alias("pos"))
    if contigs is not None:
        at = at.join(contigs.select("contig", "size"), "contig").where("pos >= 0 AND pos < size")
    return at.groupBy("contig", "pos").agg(F.count("*").alias("cnt"))


def flagged_reads_to_cuts(reads: DataFrame) -> DataFrame:
    """``reads_to_cuts`` of reads with alignment ``flag`` bits, without unmapped, secondary and supplementary ones."""
    kept = reads.where(F.col("flag").bitwiseAND(0x4 | 0x100 | 0x800) == 0)
    return reads_to_cuts(kept.withColumn("strand", F.when(F.col("flag").bitwiseAND(0x10) == 0, "+").otherwise("-")))


class NoCuts(ValueError):
    """The sum of all counts is 0."""


def total_cuts(cuts: DataFrame) -> DataFrame:
    """One row: ``total``."""
    return cuts.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"))


def checked_total(cuts: DataFrame) -> int:
    total = total_cuts(cuts).first()[0]
    if not total:
        raise NoCuts("no cuts on any contig")
    return total


def positions(contigs: DataFrame, tile: int = TILE) -> DataFrame:
    """``(contig, size, pos)`` of every position; tiles first, so that one contig is made by many tasks."""
    tiles = contigs.where("size > 0").select("contig", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / tile))).alias("tile"))
    start = F.col("tile") * tile
    return tiles.repartition("contig", "tile").select("contig", "size", F.explode(F.sequence(start, F.least(start + tile, F.col("size")) - 1)).alias("pos"))


def densify(cuts: DataFrame, contigs: DataFrame, mappable: DataFrame | None = None) -> DataFrame:
    """Counts of all positions, 0 where there are none; of repeated positions the largest count. Cuts on no position are left out.

    With half-open ``mappable`` intervals also ``mappable``: whether one holds the position; a contig with an interval beyond its end has none.
    Positions and cuts, and the intervals' ends in each tile, are dealt by tiles and meet in an aggregate there: one shuffle, no join by position.
    """
    # the catalogue has a row per contig
    known = cuts.join(F.broadcast(contigs.select("contig", "size")), "contig").where("pos >= 0 AND pos < size").select("contig", "size", "pos", "cnt")
    both = positions(contigs).withColumn("cnt", F.lit(0).cast(cuts.schema["cnt"].dataType)).unionByName(known)
    counted = F.max("cnt").alias("x")
    tile = F.floor(F.col("pos") / TILE).alias("tile")
    if mappable is None:
        dealt = both.select("*", tile).repartition("contig", "tile")
        return dealt.groupBy("contig", "tile", "size", "pos").agg(counted).select("contig", "size", "pos", "x")
    both = both.withColumn("edge", F.lit(0)).unionByName(interval_edges(mappable, contigs), allowMissingColumns=True)
    summed = both.select("*", tile).repartition("contig", "tile").groupBy("contig", "tile", "size", "pos").agg(counted, F.sum("edge").alias("edge"))
    along = Window.partitionBy("contig", "tile").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return summed.select("contig", "size", "pos", "x", (F.sum("edge").over(along) > 0).alias("mappable"))


def interval_edges(intervals: DataFrame, contigs: DataFrame, tile: int | None = None) -> DataFrame:
    """``(contig, size, pos, edge)``: 1 where an interval begins in a tile, -1 behind its end there; nothing for contigs with an interval beyond their end."""
    tile = tile or TILE
    known = intervals.join(F.broadcast(contigs.select("contig", "size")), "contig").select("contig", "size", "start", "end")
    bad = known.where("end > size").select("contig").distinct()
    inside = known.join(bad, "contig", "left_anti").where("end > start AND end > 0").withColumn("start", F.greatest("start", F.lit(0)))
    first, last = F.floor(F.col("start") / tile), F.floor((F.col("end") - 1) / tile)
    pieces = inside.withColumn("t", F.explode(F.sequence(first, last)))
    begin, until = F.greatest("start", F.col("t") * tile), F.least("end", (F.col("t") + 1) * tile)
    edges = F.array(F.struct(begin.alias("pos"), F.lit(1).alias("edge")), F.struct(until.alias("pos"), F.lit(-1).alias("edge")))
    rows = pieces.select("contig", "size", "t", F.explode(edges).alias("e")).select("contig", "size", "e.pos", "e.edge", "t")
    # what ends with its tile needs no end
    return rows.where((F.col("edge") > 0) | (F.floor(F.col("pos") / tile) == F.col("t")) & (F.col("pos") < F.col("size"))).drop("t")


def mappable_positions(intervals: DataFrame, contigs: DataFrame) -> DataFrame:
    """Distinct ``(contig, pos)`` in half-open ``intervals``; a contig with an interval beyond its end has none."""
    known = intervals.join(contigs.select("contig", "size"), "contig")
    bad = known.where("end > size").select("contig").distinct()
    inside = known.join(bad, "contig", "left_anti").where("end > start")
    pieces = inside.withColumn("lo", F.explode(F.sequence("start", F.col("end") - 1, F.lit(TILE))))
    return pieces.select("contig", F.explode(F.sequence("lo", F.least(F.col("lo") + TILE, F.col("end")) - 1)).alias("pos")).distinct()


def masked(vector: DataFrame, mappable: DataFrame) -> DataFrame:
    """``vector`` with a null ``x`` where a position is not mappable."""
    marked = vector.join(mappable.withColumn("ok", F.lit(True)), ["contig", "pos"], "left")
    return marked.withColumn("x", F.when(F.col("ok"), F.col("x"))).drop("ok")


def normalized_density(vector: DataFrame, total: DataFrame) -> DataFrame:
    """``x`` per million of all cuts; ``total`` has one row."""
    return vector.crossJoin(F.broadcast(total)).withColumn("density", F.try_divide("x", "total") * F.lit(1e6)).drop("total")


def merged(rows: DataFrame, contigs: DataFrame, *order: str) -> DataFrame:
    """Rows in the order of the catalogue."""
    return rows.join(contigs.select("contig", "ord"), "contig").orderBy("ord", *order).drop("ord")


def placed(ordered: DataFrame, name: str = "place") -> DataFrame:
    """Rows that are in order with their number, from 0: counts of partitions first, then numbers within them."""
    spark, path = ordered.sparkSession, folder(ordered.sparkSession, "ordered")
    rows = ordered.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()})
    rows.write.parquet(path)
    held = spark.read.schema(rows.schema).parquet(path)
    # a row for each partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    number = F.col("__start") + F.col("__row").bitwiseAND((1 << 33) - 1)
    return held.join(starts, "__part").select(*ordered.columns, number.alias(name))
