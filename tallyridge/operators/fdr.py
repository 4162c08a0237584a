"""False-discovery rates over histograms of scores.

A score is -log10 of a p-value; nulls are no tests. Ranks come from counts of distinct scores, so positions
are never sorted. Sums over all distinct scores go in two levels: within bins of scores, and over the bins, whose
number is bounded by the largest score.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bins per unit of score.
BINS = 64


def adjusted(scores: DataFrame, max_fdr: float, method: str = "bh", score: str = "neglog10_p") -> DataFrame:
    """``(score, neglog10_q)`` of distinct scores whose p-value is at most ``max_fdr``.

    ``by`` adds the logarithm of the harmonic sum over the candidates.
    """
    tests = scores.where(F.col(score).isNotNull())
    m = tests.agg(F.count("*").alias("m"))
    hist = tests.where(F.col(score) >= -math.log10(max_fdr)).groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n")).withColumn("bin", F.floor(F.col("s") * BINS))
    down = Window.partitionBy("bin").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    bins = hist.groupBy("bin").agg(F.sum("n").alias("n"))
    before = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    above = bins.select("bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("above"), F.sum("n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("k"))
    ranked = hist.join(above, "bin").withColumn("rank", F.col("above") + F.sum("n").over(down))
    harmonic = F.log10(_harmonic(F.col("k"))) if method == "by" else F.lit(0.0)
    ranked = ranked.crossJoin(F.broadcast(m)).withColumn("q", F.col("s") - F.log10("m") + F.log10("rank") - harmonic)
    # the largest -log10 q of this score and all that are less significant
    up = Window.partitionBy("bin").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    tops = ranked.groupBy("bin").agg(F.max("q").alias("top")).select("bin", F.max("top").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)).alias("lower"))
    best = ranked.join(tops, "bin").withColumn("best", F.greatest(F.max("q").over(up), F.col("lower")))
    return best.select(F.col("s").alias(score), F.greatest("best", F.lit(0.0)).alias("neglog10_q"))


def _harmonic(k):
    """The harmonic number: summed up to 10,000 terms, by its expansion beyond."""
    exact = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(k, F.lit(10_000).cast("long"))), F.lit(0.0), lambda s, i: s + 1 / i)
    return F.when(k <= 10_000, exact).otherwise(F.log(k) + F.lit(0.5772156649015329) + 1 / (2 * k) - 1 / (12 * k * k))


def fdr(rows: DataFrame, max_fdr: float = 0.05, method: str = "bh", score: str = "neglog10_p") -> DataFrame:
    """``rows`` with ``neglog10_q``; null where the p-value is above ``max_fdr``, or there is none.

    Rows of several samples are pooled: they count as tests of one family.
    """
    candidate = F.coalesce(F.col(score) >= -math.log10(max_fdr), F.lit(False))
    # only candidates meet the rates; all other rows, most of them at one score, stay where they are
    found = rows.where(candidate).join(adjusted(rows, max_fdr, method, score), score)
    return found.select(*rows.columns, "neglog10_q").unionByName(rows.where(~candidate).withColumn("neglog10_q", F.lit(None).cast("double")))
