"""Signal-to-noise of segments: scores, their weighted median, and a robust line over segment lengths.

Segments are few (thousands in a genome); the line is fitted on the driver from their rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OUTLIER = 5.0


def spot_score(background_tags: Column, tags: Column) -> Column:
    """The share of tags beyond the background, from 0 to 1; null without tags."""
    share = 1 - F.try_divide(background_tags, tags)
    return F.when(tags > 0, F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0)))


def weighted_median(rows: DataFrame, value: str, weight: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(keys, weighted_median)``: the first value, in ascending order, at which half of the weight is reached."""
    sums = rows.where(F.col(value).isNotNull() & F.col(weight).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    by = Window.partitionBy(*(keys or (F.lit(0),)))
    reached = sums.withColumns({"cum": F.sum("w").over(by.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("w").over(by)})
    return reached.where(F.col("cum") >= F.col("all") / 2).groupBy(*keys).agg(F.min(value).alias("weighted_median"))


def line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of least squares; level where all x are equal."""
    spread = ((x - x.mean()) ** 2).sum()
    slope = float(((x - x.mean()) * (y - y.mean())).sum() / spread) if spread > 0 else 0.0
    return slope, float(y.mean() - slope * x.mean())


def robust_line(x: np.ndarray, y: np.ndarray, *, share: float = 0.2, trials: int = 100, seed: int = 42) -> tuple[float, float, np.ndarray]:
    """A line by random sample consensus: most inliers within the median absolute deviation, then least error."""
    rng = np.random.default_rng(seed)
    limit = float(np.median(np.abs(y - np.median(y)))) or 1e-12
    count = min(len(x), max(2, math.ceil(share * len(x))))
    best: tuple = (-1, 0.0, np.ones(len(x), bool))
    for _ in range(trials):
        some = rng.choice(len(x), count, replace=False)
        slope, intercept = line(x[some], y[some])
        error = np.abs(y - slope * x - intercept)
        inliers = error <= limit
        score = (int(inliers.sum()), -float(error[inliers].sum()))
        if score > best[:2]:
            best = (*score, inliers)
    inliers = best[2]
    return *line(x[inliers], y[inliers]), inliers


@dataclass
class SignalToNoise:
    slope: float | None
    intercept: float | None
    score: float | None
    score_std: float | None


def fit_signal_to_noise(segments: DataFrame, outlier: float = OUTLIER) -> tuple[DataFrame, SignalToNoise]:
    """Segments with ``segment_SPOT``, ``outlier_distance``, ``is_inlier`` and ``min_bg_tag_proportion``, and the line.

    Needs ``contig, start, bg_tags, mappable_tags, mappable_bases``. Without a segment whose score lies between 0 and 1
    nothing is known, and the least proportion of background tags is 1.
    """
    scored = segments.withColumn("segment_SPOT", spot_score(F.col("bg_tags"), F.col("mappable_tags")))
    valid = scored.where("segment_SPOT > 0 AND segment_SPOT < 1 AND mappable_bases > 0")
    rows = sorted(tuple(r) for r in valid.select("contig", "start", "segment_SPOT", "mappable_bases").collect())
    none = F.lit(None).cast("double")
    if not rows:
        return scored.withColumns({"outlier_distance": none, "is_inlier": F.lit(False), "min_bg_tag_proportion": F.lit(1.0)}), SignalToNoise(None, None, None, None)
    s, bases = (np.array([r[k] for r in rows], np.float64) for k in (2, 3))
    x, y = np.log(bases), np.log(s / (1 - s))
    slope, intercept, inliers = robust_line(x, y)
    order = np.argsort(s, kind="stable")
    reached = bases[order].cumsum()
    score = float(s[order][np.searchsorted(reached, reached[-1] / 2)])
    level = 1 / (1 + np.exp(-(y - slope * x - intercept + math.log(score / (1 - score)))))
    std = float(np.sqrt((bases * (level - score) ** 2).sum() / bases.sum()))
    marked = segments.sparkSession.createDataFrame([(r[0], r[1], bool(i)) for r, i in zip(rows, inliers)], "contig string, start long, is_inlier boolean")
    predicted = F.lit(slope) * F.log("mappable_bases") + F.lit(intercept)
    logit = F.log(F.col("segment_SPOT") / (1 - F.col("segment_SPOT")))
    least = F.ceil(1 / (1 + F.exp(predicted + math.log(outlier))) * 1e5) / 1e5
    out = scored.join(marked, ["contig", "start"], "left").withColumns(
        {"is_inlier": F.coalesce("is_inlier", F.lit(False)), "outlier_distance": F.when((F.col("segment_SPOT") > 0) & (F.col("segment_SPOT") < 1), F.exp(logit - predicted)), "min_bg_tag_proportion": least}
    )
    return out, SignalToNoise(slope, intercept, score, std)
