"""The background model: quantiles, bins, moments, goodness of fit, thresholds, and the sliding fit.

Groups (contigs or segments) are given by ``keys``. What needs a threshold scan works on histograms
of whole values, whose size follows the values' range and not the number of positions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from tallyridge.functions.special import log_beta_tail
from tallyridge.operators.dense import TILE
from tallyridge.operators.windows import in_order, max_around, neighbours, numbers, spread_out, sums_around, tiled

CONTIG = ("contig",)


def sampled(vector: DataFrame, step: int, start: Column | None = None) -> DataFrame:
    """Every ``step``-th position, from ``start`` (0 by default)."""
    return vector.where((F.col("pos") - (F.lit(0) if start is None else start)) % step == 0)


def quantile_linear(vector: DataFrame, q: float, keys: tuple[str, ...] = CONTIG) -> DataFrame:
    """``(keys, quantile)`` of defined values, by linear interpolation; null without any."""
    return vector.groupBy(*keys).agg(F.percentile("x", F.lit(q)).alias("quantile"))


def windowed_quantiles(vector: DataFrame, quantile: Column, windows: dict[str, int], step: int, stride: int, keys: tuple[str, ...] = CONTIG, tile: int = TILE) -> DataFrame:
    """``(keys, centre, …)``: for each window, by name, the higher quantile of samples around each centre; null without samples.

    Samples lie at multiples of ``step``, centres at multiples of ``stride``; a window has an odd number of samples. A sample goes to its tile and
    to those whose windows reach it, once for all windows, and not to each centre around it.
    """
    halves = {k: (w // step | 1) // 2 * step for k, w in windows.items()}
    far = max(halves.values())
    points = sampled(vector, step).where("x IS NOT NULL").select(*keys, "size", "pos", F.col("x").cast("double").alias("x"), quantile.cast("double").alias("q"))
    kinds = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        pos, x, first = rows["pos"].to_numpy(), rows["x"].to_numpy(), rows.iloc[0]
        q, start = first["q"], int(first["tile"]) * tile
        centres = np.arange(-(-start // stride) * stride, min(start + tile, int(first["size"])), stride)
        out = pd.DataFrame({**{k: [first[k]] * len(centres) for k in keys}, "centre": centres})
        for name, half in halves.items():
            bounds = zip(np.searchsorted(pos, centres - half), np.searchsorted(pos, centres + half, side="right"))
            places = [(lo, hi, math.ceil(round(q * (hi - lo - 1), 9))) if hi > lo and not math.isnan(q) else None for lo, hi in bounds]
            out[name] = np.array([np.nan if p is None else np.partition(x[p[0] : p[1]], p[2])[p[2]] for p in places], np.float64)
        return out

    found = tiled(points, far, far, tile).groupBy(*keys, "tile").applyInPandas(run, f"{kinds}, centre long, " + ", ".join(f"{k} double" for k in windows))
    return found.select(*keys, "centre", *(F.nanvl(F.col(k), F.lit(None)).alias(k) for k in windows))


def strided_quantiles(vector: DataFrame, quantile: Column, window: int, step: int, stride: int, keys: tuple[str, ...] = CONTIG, tile: int = TILE) -> DataFrame:
    """``(keys, centre, value)``: ``windowed_quantiles`` of one window, of centres with samples."""
    return windowed_quantiles(vector, quantile, {"value": window}, step, stride, keys, tile).where("value IS NOT NULL")


def interpolated(centres: DataFrame, contigs: DataFrame, stride: int, keys: tuple[str, ...] = CONTIG) -> DataFrame:
    """``(keys, pos, threshold)`` of every position: linear between defined centres, flat beyond the outer ones."""
    known = neighbours(centres.where("value IS NOT NULL"), "centre", {"before": ("centre", -1), "next": ("centre", 1), "then": ("value", 1)}, keys)
    known = known.join(contigs.select(*keys, "size"), list(keys))
    first = F.when(F.col("before").isNull(), F.lit(0)).otherwise(F.col("centre"))
    last = F.coalesce(F.col("next"), F.col("size")) - 1
    spans = known.where(first <= last).withColumn("lo", F.explode(F.sequence(first.cast("long"), last, F.lit(TILE)))).withColumn("hi", F.least(F.col("lo") + TILE - 1, last))
    rows = spread_out(spans, *keys, "lo").withColumn("pos", F.explode(F.sequence("lo", "hi")))
    slope = (F.col("pos") - F.col("centre")) / (F.col("next") - F.col("centre"))
    value = F.when(F.col("next").isNull() | (F.col("pos") <= F.col("centre")), F.col("value")).otherwise(F.col("value") + (F.col("then") - F.col("value")) * slope)
    return rows.select(*keys, "pos", value.alias("threshold"))


def local_thresholds(vector: DataFrame, quantile: Column, contigs: DataFrame, *, window: int = 50_001, small: int = 5_001, step: int = 75, stride: int = 1_500, keys: tuple[str, ...] = CONTIG) -> DataFrame:
    """``(keys, pos, threshold)``: the smaller of two strided quantiles, interpolated."""
    both = windowed_quantiles(vector, quantile, {"value": window, "near": small}, step, stride, keys).where("value IS NOT NULL AND near IS NOT NULL")
    return interpolated(both.select(*keys, "centre", F.least("value", "near").alias("value")), contigs, stride, keys)


def bin_edges(vector: DataFrame, *, background_bins: int = 20, signal_bins: int = 100, low: float = 0.6, high: float = 0.995, keys: tuple[str, ...] = CONTIG, fallback: Column | None = None) -> DataFrame:
    """``(keys, q_low, edges, n_signal)``: whole-number edges below the lower quantile, then edges up to the upper one.

    The first edge of the upper part is the quantile itself. ``n_signal`` counts the bins of that part.
    """
    quantiles = vector.groupBy(*keys).agg(F.percentile("x", F.lit(low)).alias("q_low"), F.percentile("x", F.lit(high)).alias("q_high")).where("q_low IS NOT NULL")
    top = F.greatest("q_high", fallback) if fallback is not None else F.col("q_high")
    top = F.when(top <= F.col("q_low"), F.col("q_low") + 1).otherwise(top)
    k = F.greatest(F.bround(F.least("q_low", F.lit(background_bins))), F.lit(0)).cast("int")
    m = F.greatest(F.bround(F.least(top - F.col("q_low"), F.lit(signal_bins))), F.lit(1)).cast("int")
    rows = quantiles.select(*keys, "q_low", top.alias("top"), k.alias("k"), m.alias("m"))
    below = F.when(F.col("k") > 0, F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.bround(F.col("q_low") * i / F.col("k")))).otherwise(F.array().cast("array<double>"))
    above = F.transform(F.sequence(F.lit(0), F.col("m")), lambda i: F.when(i == 0, F.col("q_low")).otherwise(F.bround(F.col("q_low") + (F.col("top") - F.col("q_low")) * i / F.col("m"))))
    return rows.select(*keys, "q_low", F.concat(below, above).alias("edges"), F.col("m").alias("n_signal"))


def histogram(vector: DataFrame, keys: tuple[str, ...] = CONTIG) -> DataFrame:
    """``(keys, value, n)`` of defined values."""
    return vector.where("x IS NOT NULL").groupBy(*keys, F.col("x").alias("value")).agg(F.count("*").alias("n"))


def bin_counts(vector: DataFrame, edges: DataFrame, keys: tuple[str, ...] = CONTIG) -> DataFrame:
    """``(keys, bin, lo, hi, n)``: values in [lo, hi) of each bin, empty ones too."""
    bins = edges.select(*keys, F.posexplode(F.arrays_zip(F.slice("edges", 1, F.size("edges") - 1).alias("lo"), F.slice("edges", 2, F.size("edges") - 1).alias("hi"))).alias("bin", "x"))
    bins = bins.select(*keys, "bin", "x.lo", "x.hi")
    counts = histogram(vector, keys).join(bins, list(keys)).where("value >= lo AND value < hi").groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    return bins.join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def merge_small_bins(edges: list[float], counts: list[int], n_signal: int, least: int = 5) -> tuple[list[float], list[int]]:
    """From the last bin of the upper part down: fewer than ``least`` go to the bin before, whose edge is taken over.

    A merged bin keeps its place with zero width and no count.
    """
    edges, counts = list(edges), list(counts)
    for i in range(len(counts) - 1, len(counts) - 1 - n_signal, -1):
        if counts[i] < least:
            counts[i - 1] += counts[i]
            counts[i] = 0
            edges[i] = edges[i + 1]
    return edges, counts


def moments(n: Column, mean: Column, variance: Column) -> dict[str, Column]:
    """The negative binomial of a mean and a variance: ``r``, ``p``, and whether it is one."""
    r = F.try_divide(mean * mean, variance - mean)
    p = F.try_divide(mean, mean + r)
    valid = F.coalesce((r > 0) & (p > 0) & (p < 1) & (n > 1), F.lit(False))
    return {"r": r, "p": p, "valid": valid}


def nb_moments(vector: DataFrame, keys: tuple[str, ...] = CONTIG) -> DataFrame:
    """``(keys, mean, variance, r, p, valid)`` of defined values; r and p null where no such distribution has the moments."""
    found = vector.groupBy(*keys).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("variance"))
    fit = moments(F.col("n"), F.col("mean"), F.when(F.col("variance") != F.col("mean"), F.col("variance")))
    return found.select(*keys, "mean", "variance", F.when(fit["valid"], fit["r"]).alias("r"), F.when(fit["valid"], fit["p"]).alias("p"), fit["valid"].alias("valid"))


def background_quantile(vector: DataFrame, thresholds: DataFrame, keys: tuple[str, ...] = CONTIG) -> DataFrame:
    """``(keys, fit_quantile)``: the share of defined values below a group's ``threshold``."""
    joined = vector.join(thresholds.select(*keys, "threshold"), list(keys))
    return joined.groupBy(*keys).agg(F.try_divide(F.sum((F.col("x") < F.col("threshold")).cast("long")), F.count("x")).alias("fit_quantile"))


def upper_tails(edges: np.ndarray, r: float, p: float) -> np.ndarray:
    """The share of a negative binomial at or above each edge, continued between whole numbers by the incomplete beta function."""
    out = np.ones(len(edges))
    out[edges > 0] = np.exp(log_beta_tail(np.full((edges > 0).sum(), p), edges[edges > 0], np.full((edges > 0).sum(), r)))
    return out


def rmsea(edges: np.ndarray, observed: np.ndarray, r: float, p: float, parameters: int = 2) -> float:
    """Root mean square error of approximation by the likelihood-ratio statistic over bins.

    Edges cover the whole range, and bins above a candidate threshold are there with no counts; infinite where it is not defined.
    """
    tails = upper_tails(edges, r, p)
    total, inside = observed.sum(), 1 - tails[-1]
    freedom = int((np.diff(edges) != 0).sum()) - parameters - 1
    if total < 2 or inside <= 0 or freedom < 1:
        return math.inf
    expected = -np.diff(tails) * total / inside
    use = (observed > 0) & (expected > 0)
    g = 2 * np.sum(observed[use] * np.log(observed[use] / expected[use]))
    return math.sqrt(max(g / freedom - 1, 0) / (total - 1))


def weighted_quantile(values: np.ndarray, so_far: np.ndarray, q: float) -> float:
    """By linear interpolation, of ascending values whose counts add up to ``so_far``."""
    at = q * (so_far[-1] - 1)
    lo, hi = (values[np.searchsorted(so_far, k, side="right")] for k in (math.floor(at), math.ceil(at)))
    return float(lo + (hi - lo) * (at - math.floor(at)))


def edges_of(values: np.ndarray, so_far: np.ndarray, low: float, high: float, top: float | None, background_bins: int, signal_bins: int) -> tuple[np.ndarray, float, int]:
    """``bin_edges`` of one histogram: edges, lower quantile, number of bins above it. ``top``: a least upper edge."""
    q_low = weighted_quantile(values, so_far, low)
    q_high = q_low + 1 if high <= low else weighted_quantile(values, so_far, high)
    q_high = max(q_high, top) if top is not None else q_high
    if not q_high > q_low:
        q_high = q_low + 1
    k, m = max(0, round(min(q_low, background_bins))), max(1, round(min(q_high - q_low, signal_bins)))
    below = np.round(q_low * np.arange(k) / max(k, 1))
    above = np.round(q_low + (q_high - q_low) * np.arange(m + 1) / m)
    above[0] = q_low
    return np.concatenate((below, above)), q_low, m


def scan(values: np.ndarray, counts: np.ndarray, *, low: float = 0.6, high: float = 0.995, top: float | None = None, background_bins: int = 20, signal_bins: int = 100, least: int = 5) -> dict:
    """The threshold, among edges above the lower quantile, whose fit to the values below it is best; the lowest of ties.

    Where no edge gives a fit with a finite error, all values are fitted and the threshold is infinite.
    """
    order = np.argsort(values)
    values, counts = values[order].astype(np.float64), counts[order].astype(np.float64)
    n, s, q = counts.cumsum(), (counts * values).cumsum(), (counts * values * values).cumsum()

    def fit(k: int) -> tuple[float, float] | None:
        """Of the first ``k`` values."""
        if k < 1 or n[k - 1] < 2:
            return None
        mean = s[k - 1] / n[k - 1]
        variance = (q[k - 1] - s[k - 1] * mean) / (n[k - 1] - 1)
        if variance <= mean or mean <= 0:
            return None
        r = mean * mean / (variance - mean)
        return (float(r), float(mean / (mean + r))) if r > 0 and 0 < mean / (mean + r) < 1 else None

    best: dict = {"threshold": math.inf, "rmsea": None, "r": None, "p": None, "fit_quantile_sampled": None}
    if top is None or math.isfinite(top):
        edges, q_low, m = edges_of(values, n, low, high, top, background_bins, signal_bins)
        total = np.diff(np.concatenate(([0.0], n))[np.searchsorted(values, edges)])
        merged, held = merge_small_bins(edges.tolist(), total.astype(int).tolist(), m, least)
        merged, held = np.array(merged), np.array(held, np.float64)
        for tr in np.unique(merged[len(merged) - m :]):
            k = int(np.searchsorted(values, tr))
            if tr <= q_low or (found := fit(k)) is None:
                continue
            error = rmsea(merged, np.where(merged[1:] <= tr, held, 0.0), *found)
            if math.isfinite(error) and (best["rmsea"] is None or error < best["rmsea"]):
                best |= {"threshold": float(tr), "rmsea": error, "r": found[0], "p": found[1], "fit_quantile_sampled": float(n[k - 1] / n[-1])}
    if best["r"] is None and (found := fit(len(values))):
        best |= {"r": found[0], "p": found[1], "fit_quantile_sampled": 1.0}
    return best


def fit_groups(vector: DataFrame, *, step: Column | int = 1, start: Column | None = None, background_bins: int = 20, signal_bins: int = 100, low: float = 0.6, high: float = 0.995, least: int = 5, keys: tuple[str, ...] = CONTIG, tops: DataFrame | None = None, lows: DataFrame | None = None) -> DataFrame:
    """The threshold scan of each group, on every ``step``-th position from ``start``.

    ``tops`` (keys or some of them, top) holds least upper edges of bins, ``lows`` (keys, low) lower quantiles of groups of their own.
    ``(keys, r, p, rmsea, threshold, fit_quantile, n_total, n_signal, signal_tags, total_tags, success)``; the counts are of all positions.
    The quantile, the share of values below the threshold, is of those that the scan has seen.
    """
    offset = F.col("pos") - (F.lit(0) if start is None else start)
    rows = vector.where(offset % step == 0)
    # a group's histogram has as many rows as there are distinct values
    joined = histogram(rows, keys)
    for name, table, default in (("top", tops, None), ("low", lows, low)):
        if table is None:
            joined = joined.withColumn(name, F.lit(default).cast("double"))
        else:
            shared = [k for k in keys if k in table.columns]
            joined = joined.join(table.select(*shared, F.col(name).cast("double").alias(name)), shared)
    kinds = ", ".join(f"{k} {joined.schema[k].dataType.simpleString()}" for k in keys)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        top = group["top"].iloc[0]
        found = scan(
            group["value"].to_numpy(), group["n"].to_numpy(), low=group["low"].iloc[0], high=high, top=None if pd.isna(top) else float(top), background_bins=background_bins, signal_bins=signal_bins, least=least
        )
        return pd.DataFrame([{**{k: group[k].iloc[0] for k in keys}, **found}])

    fitted = joined.groupBy(*keys).applyInPandas(run, f"{kinds}, r double, p double, rmsea double, threshold double, fit_quantile_sampled double").withColumnRenamed("fit_quantile_sampled", "fit_quantile")
    # a row per contig or segment
    whole = vector.join(F.broadcast(fitted.select(*keys, "threshold")), list(keys))
    above = F.col("x") >= F.col("threshold")
    tags = F.floor(F.coalesce("x", F.lit(0)))
    counts = whole.groupBy(*keys).agg(
        F.count("x").alias("n_total"), F.sum(F.coalesce(above, F.lit(False)).cast("long")).alias("n_signal"), F.sum(F.when(above, tags).otherwise(0)).alias("signal_tags"), F.sum(tags).alias("total_tags")
    )
    return fitted.join(counts, list(keys)).withColumn("success", F.col("r").isNotNull())


def tag_cdf_thresholds(vector: DataFrame, fractions: DataFrame, keys: tuple[str, ...] = CONTIG, most: float = 0.995, sampled: DataFrame | None = None) -> DataFrame:
    """``(keys, threshold, fit_quantile, max_bg_reached)`` that leave at least ``fraction`` of a group's tags to the background.

    Among values in ascending order whose share of tags up to and including them reaches the fraction, the
    second is the threshold; it is infinite where there are fewer. Shares of tags are over all of ``vector``, the quantile (the share of
    values below the threshold) over ``sampled`` where that is given.
    """
    by = Window.partitionBy(*keys).orderBy("value")
    hist = histogram(vector, keys).withColumn("tags", F.sum(F.col("value") * F.col("n")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    hist = hist.withColumn("all", F.sum(F.col("value") * F.col("n")).over(Window.partitionBy(*keys)))
    reached = hist.join(fractions.select(*keys, "fraction"), list(keys)).withColumn("ok", F.coalesce(F.try_divide("tags", "all") >= F.col("fraction"), F.lit(False)))
    second = reached.where("ok").withColumn("rank", F.row_number().over(by)).where("rank = 2").select(*keys, F.col("value").alias("threshold"))
    found = hist.select(*keys).distinct().join(second, list(keys), "left").withColumn("threshold", F.coalesce(F.col("threshold").cast("double"), F.lit(float("inf"))))
    of = hist if sampled is None else histogram(sampled, keys)
    quantile = of.join(found, list(keys)).groupBy(*keys, "threshold").agg((F.sum(F.when(F.col("value") < F.col("threshold"), F.col("n")).otherwise(0)) / F.sum("n")).alias("fit_quantile"))
    return quantile.withColumn("max_bg_reached", F.col("fit_quantile") > most)


def sliding_nb(vector: DataFrame, *, window: int = 50_001, flank: int = 500, fraction: float = 0.05, keys: tuple[str, ...] = CONTIG, tile: int = TILE) -> DataFrame:
    """``vector`` with ``sliding_r``, ``sliding_p`` and ``enough_bg``.

    Needs columns ``threshold`` and ``fallback_r`` (of the position's group). Values near one that
    reaches the threshold do not count; mean and variance are over the window; where they are of no
    negative binomial, r is the group's and p follows from the mean.
    """
    half, least = window // 2, max(1, round(window * fraction))
    # one deal of tiles serves both windows, maxima first
    far, kept = half + flank, vector.columns

    def run(rows: pa.Table) -> pa.Table:
        rows = in_order(rows)
        x = numbers(rows, "x")
        calm = ~np.isnan(x) & ~(max_around(x, flank) >= numbers(rows, "threshold"))
        b, place = np.where(calm, x, 0.0), rows["own"].to_numpy()
        own = slice(int(place.argmax()), int(place.argmax() + place.sum()))  # a tile's own rows lie together
        n, s, q = (sums_around(v, half, half)[own] for v in (calm.astype(np.int64), b, b * b))
        rows = rows.select(kept).slice(own.start, own.stop - own.start)
        enough, fallback = ~np.isnan(x[own]) & (n >= least), numbers(rows, "fallback_r")
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = s / n
            variance = (q - s * s / n) / (n - 1)
            r = mean * mean / (variance - mean)
            p = mean / (mean + r)
            valid = (n > 1) & (variance != mean) & (r > 0) & (p > 0) & (p < 1)
            r, p = np.where(valid, r, fallback), np.where(valid, p, mean / (mean + fallback))
        for name, value in (("enough_bg", pa.array(enough)), ("sliding_r", pa.array(r, mask=~enough | np.isnan(r))), ("sliding_p", pa.array(p, mask=~enough | np.isnan(p)))):
            rows = rows.append_column(name, value)
        return rows

    wider = StructType([*vector.schema.fields, StructField("enough_bg", BooleanType()), StructField("sliding_r", DoubleType()), StructField("sliding_p", DoubleType())])
    return spread_out(tiled(vector, far, far, tile), *keys, "tile").groupBy(*keys, "tile").applyInArrow(run, wider)
