"""Rows of results as browser tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tiers of false-discovery rates, and the colours of peaks and regions in each; grey beyond them.
TIERS = (0.001, 0.01, 0.05, 0.1)
PEAK_COLOURS = ("49,163,84", "116,196,118", "161,217,155", "199,233,192")
REGION_COLOURS = ("117,107,177", "158,154,200", "188,189,220", "218,218,235")
GREY = "192,192,192"

BED12 = ("chrom", "start", "end", "id", "score", "strand", "thickStart", "thickEnd", "itemRgb", "blockCount", "blockSizes", "blockStarts")


def colour(fdr: float, colours: tuple[str, ...]) -> str:
    return next((c for t, c in zip(TIERS, colours) if fdr <= t), GREY)


def score(value: Column, factor: float) -> Column:
    """A whole number from 0 to 1000."""
    return F.least(F.greatest(F.bround(value * factor), F.lit(0)), F.lit(1000)).cast("long")


def text(x: Column) -> Column:
    return x.cast("string")


def peaks_bed12(peaks: DataFrame, sample: str, fdr: float) -> DataFrame:
    """A block for each end and for the summit."""
    columns = {
        "chrom": F.col("contig"), "start": F.col("start"), "end": F.col("end"), "id": F.lit(sample), "score": score(F.col("max_density"), 100), "strand": F.lit("."),
        "thickStart": F.col("summit"), "thickEnd": F.col("summit") + 1, "itemRgb": F.lit(colour(fdr, PEAK_COLOURS)), "blockCount": F.lit(3), "blockSizes": F.lit("1,1,1"),
        "blockStarts": F.concat_ws(",", F.lit("0"), text(F.col("summit") - F.col("start")), text(F.col("end") - F.col("start") - 1)),
    }
    return peaks.select(*(c.alias(k) for k, c in columns.items()))


def regions_bed12(regions: DataFrame, sample: str, fdr: float) -> DataFrame:
    """A block of one position at each end, and one for each significant stretch between them."""
    sizes = F.transform("stretches", lambda s: text(s["end"] - s["start"]))
    starts = F.transform("stretches", lambda s: text(s["start"]))
    one = F.array(F.lit("1"))
    columns = {
        "chrom": F.col("contig"), "start": F.col("start"), "end": F.col("end"), "id": F.lit(sample), "score": score(F.col("max_score"), 10), "strand": F.lit("."),
        "thickStart": F.col("start"), "thickEnd": F.col("end"), "itemRgb": F.lit(colour(fdr, REGION_COLOURS)), "blockCount": F.size("stretches") + 2,
        "blockSizes": F.array_join(F.concat(one, sizes, one), ","),
        "blockStarts": F.array_join(F.concat(F.array(F.lit("0")), starts, F.array(text(F.col("end") - F.col("start") - 1))), ","),
    }
    return regions.select(*(c.alias(k) for k, c in columns.items()))


def track(vector: DataFrame, value: str, step: int, positive: bool = False) -> DataFrame:
    """``(contig, start, end, value)`` of every ``step``-th position with a value, or with one above 0."""
    rows = vector.where(F.col("pos") % step == 0).where(F.col(value) > 0 if positive else F.col(value).isNotNull())
    return rows.select("contig", F.col("pos").alias("start"), (F.col("pos") + step).alias("end"), F.col(value).alias("value"))
