"""Hand-computed values, and naive versions, for the operators over counts."""

import math
import random
import time

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyridge.functions import special
from tallyridge.operators import background, dense, export, fdr, islands, peaks, regression, segment, wavelets, windows


def vector(spark, values, contig="c"):
    rows = [(contig, len(values), k, None if v is None else float(v)) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "contig string, size long, pos long, x double")


def column(df, name, order="pos"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_cut_rule(spark):
    reads = spark.createDataFrame([("c", 10, 20, "+"), ("c", 10, 20, "-"), ("c", 12, 20, "-")], "contig string, start long, end long, strand string")
    assert sorted(map(tuple, dense.reads_to_cuts(reads).collect())) == [("c", 10, 1), ("c", 20, 2)]


def test_cuts_beyond_the_contig_are_left_out(spark):
    reads = spark.createDataFrame([("c", 10, 20, "-"), ("d", 1, 2, "+")], "contig string, start long, end long, strand string")
    contigs = spark.createDataFrame([("c", 20, 0)], "contig string, size long, ord int")
    assert dense.reads_to_cuts(reads, contigs).count() == 0


def test_no_cuts_is_an_error(spark):
    with pytest.raises(dense.NoCuts):
        dense.checked_total(spark.createDataFrame([], "contig string, pos long, cnt long"))


def test_window_sum_of_one(spark):
    values = [0] * 300
    values[100] = 1
    got = column(windows.running(vector(spark, values), 151, "sum"), "agg")
    assert [k for k, v in enumerate(got) if v] == list(range(25, 176))


@pytest.mark.parametrize("n, window, tile", [(40, 7, 16), (40, 7, 1 << 17), (5, 7, 8), (6, 7, 8), (7, 7, 4)])
@pytest.mark.parametrize("what", ["sum", "mean", "var"])
def test_windows_match_a_naive_version(spark, n, window, tile, what):
    rng = np.random.default_rng(n)
    values = [None if rng.random() < 0.3 else int(rng.integers(0, 9)) for _ in range(n)]
    got = column(windows.running(vector(spark, values), window, what, 0.3, tile=tile), "agg")
    w = min(window, n)
    right, left = w // 2, w - 1 - w // 2
    for k in range(n):
        inside = [v for v in values[max(0, k - left) : k + right + 1] if v is not None]
        want = None
        if len(inside) >= max(1, round(w * 0.3)):
            want = {"sum": sum(inside), "mean": np.mean(inside), "var": np.var(inside, ddof=1) if len(inside) > 1 else None}[what]
        assert (got[k] is None) == (want is None) and (want is None or math.isclose(got[k], want, abs_tol=1e-9)), k


@pytest.mark.parametrize("flank", [0, 1, 2, 3, 5, 8])
def test_running_max(spark, flank):
    values = [None, 3, 1, None, None, None, None, 2, 9, 1, 0, 0, 4]
    got = column(windows.running_max(vector(spark, values), flank, tile=16 if flank else 4), "top")
    for k in range(len(values)):
        inside = [v for v in values[max(0, k - flank) : k + flank + 1] if v is not None]
        assert got[k] == (max(inside) if inside else None)


@pytest.mark.parametrize("n", [100, 300])
def test_triangle_of_a_delta(spark, n):
    values = [0] * n
    values[5] = 16384
    got = column(windows.triangle_smooth(vector(spark, values)), "smoothed")
    want = np.zeros(n)
    for d in range(-127, 128):
        want[(5 + d) % n] += 128 - abs(d)
    assert np.allclose(got, want)


def test_islands_and_dilation(spark):
    hits = vector(spark, [0, 1, 1, 0, 1]).where("x = 1")
    for tile in (2, 100):
        assert sorted(tuple(r)[1:] for r in islands.islands(hits, tile=tile).collect()) == [(1, 3), (4, 5)]
    values = [0] * 300
    values[100] = 1
    found = islands.regions(vector(spark, values), "x", 1.0).collect()
    assert [(r["start"], r["end"], r["max_score"], r["n_significant"], [tuple(s) for s in r["stretches"]]) for r in found] == [(25, 176, 1.0, 1, [(75, 76)])]


def test_extrema_and_trimming(spark):
    rows = vector(spark, [0, 1, 3, 3, 1, 2, 5, 1])
    contigs = spark.createDataFrame([("c", 8, 0)], "contig string, size long, ord int")
    for tile in (3, 100):
        assert sorted((r["pos"], r["kind"]) for r in peaks.extrema(rows, tile=tile).collect()) == [(2, "max"), (4, "min"), (6, "max")]
    tops = peaks.summits(rows, contigs)
    assert sorted((r["summit"], r["left"], r["right"]) for r in tops.collect()) == [(2, 0, 4), (6, 4, 7)]
    cut = peaks.trimmed(tops.where("summit = 6"), rows).first()
    assert (cut["cutoff"], cut["start"], cut["end"]) == (2.5, 5, 6)


def test_peaks_in_one_pass_have_the_bounds_of_trimming(spark):
    rng = random.Random(8)
    values, half = [rng.choice([0, 1, 1, 2, 5, 9]) for _ in range(400)], 3
    rows = vector(spark, values).withColumn("density", F.col("x") * 10)
    contigs = spark.createDataFrame([("c", 400, 0)], "contig string, size long, ord int")
    tops = peaks.summits(rows, contigs)
    found = peaks.peaks(tops, rows, contigs, spark.createDataFrame([(1_000_000,)], "total long"), half)
    got = {r["summit"]: (r["start"], r["end"], r["summit_density"], r["max_density"], r["smoothed_peak_height"]) for r in found.collect()}
    want = {}
    for r in peaks.trimmed(tops, rows).collect():
        s = r["summit"]
        start, end = max(min(r["start"], s - half), 0), min(max(r["end"], s + half) + 1, 400)
        want[s] = (start, end, 10 * values[s], 10 * max(values[start:end]), r["height"])
    assert got == want and len(want) > 80
    # positions and intervals meet in one join
    plan = found._jdf.queryExecution().analyzed().toString()
    assert sum("Join Inner" in line and "__bin" in line for line in plan.splitlines()) == 1


def test_flat_signal_has_no_peaks(spark):
    assert peaks.extrema(vector(spark, [1, 1, 1, 1])).count() == 0


def test_moments(spark):
    assert background.scan(np.array([1.0]), np.array([4]))["r"] is None
    found = background.nb_moments(vector(spark, [0, 0, 8, 8, 4])).first()
    assert math.isclose(found["mean"], 4) and math.isclose(found["variance"], 16) and math.isclose(found["r"], 16 / 12) and math.isclose(found["p"], 0.75)
    assert not background.nb_moments(vector(spark, [1, 1, 1])).first()["valid"]


@given(st.floats(0.1, 60), st.floats(0.01, 0.99), st.integers(1, 300))
@settings(max_examples=60, deadline=None)
@example(28.0, 0.98828125, 1)
def test_tail_is_the_sum_of_the_distribution(r, p, x):
    log_pmf = lambda k: math.lgamma(k + r) - math.lgamma(k + 1) - math.lgamma(r) + k * math.log(p) + r * math.log1p(-p)
    below = math.fsum(math.exp(log_pmf(k)) for k in range(x))
    if below < 0.5:
        want = math.log1p(-below)
    else:  # far beyond the mean, until what follows is nothing beside the sum
        tail = [log_pmf(k) for k in range(x, x + 40_000)]
        top = max(tail)
        want = top + math.log(math.fsum(math.exp(v - top) for v in tail))
    assert math.isclose(special.nb_log_tail([x], [r], [p])[0], want, rel_tol=1e-8, abs_tol=1e-9)


def test_tail_at_zero_and_far_out():
    assert special.nb_log_tail([0], [2.0], [0.5])[0] == 0
    assert special.nb_log_tail([20000], [2.0], [0.01])[0] / math.log(10) < -30000


def test_isf():
    x = special.nb_isf(0.005, np.array([5.0]), np.array([0.5]))
    assert special.nb_log_tail(x + 1, [5.0], [0.5])[0] <= math.log(0.005) < special.nb_log_tail(x, [5.0], [0.5])[0]


def test_bh(spark):
    rows = spark.createDataFrame([(k, -math.log10(p)) for k, p in enumerate((0.01, 0.02, 0.02, 0.5))] + [(4, None)], "k int, neglog10_p double")
    got = {r["k"]: r["neglog10_q"] and 10 ** -r["neglog10_q"] for r in fdr.fdr(rows, 1.0).collect()}
    assert [round(got[k], 6) for k in range(4)] == [0.026667, 0.026667, 0.026667, 0.5] and got[4] is None
    got = {r["k"]: r["neglog10_q"] for r in fdr.fdr(rows, 0.05).collect()}
    assert got[3] is None and round(10 ** -got[0], 6) == 0.026667


def test_tag_thresholds(spark):
    rows = vector(spark, [1] * 5 + [2] * 5 + [10])
    for fraction, want in ((0.5, 10.0), (0.9, math.inf)):
        limits = spark.createDataFrame([("c", fraction)], "contig string, fraction double")
        assert background.tag_cdf_thresholds(rows, limits).first()["threshold"] == want


def test_weighted_median(spark):
    rows = spark.createDataFrame([(1.0, 1), (2.0, 1), (3.0, 2)], "v double, w int")
    assert regression.weighted_median(rows, "v", "w").first()[0] == 2.0


def test_interval_max_without_data(spark):
    spans = spark.createDataFrame([("x", 1, 5)], "contig string, start long, end long")
    scores = spark.createDataFrame([("c", 2, 3.0)], "contig string, pos long, neglog10_p double")
    assert islands.interval_max(spans, scores).first()["max_neglog_p"] == 0


def test_small_bins_merge():
    assert background.merge_small_bins([0, 1, 2, 3], [9, 2, 1], 2) == ([0, 3, 3, 3], [12, 0, 0])


def test_segments_split_where_the_odds_change():
    rng = np.random.default_rng(0)
    values = np.concatenate((rng.negative_binomial(5, 0.5, 400), rng.negative_binomial(5, 1 / 7, 400)))
    found = segment.segments_of(np.arange(800) * 10, values.astype(float), 5.0, 0.5, 8000, 20.0, 500)
    assert len(found) == 2 and abs(found[0][1] - 4000) < 150 and found[-1][1] == 8000


@pytest.mark.parametrize("tile", [1, 7, 64, 1_000])
def test_path_over_tiles_is_the_path_over_all(tile):
    rng = np.random.default_rng(tile)
    for penalty in (0.5, 4.0, 20.0):
        odds = np.repeat(rng.choice([0.2, 0.5, 1.0, 3.0], 6), rng.integers(1, 90, 6))
        values = rng.negative_binomial(5, 1 / (1 + odds)).astype(float)
        scores = segment.log_likelihoods(values, 5.0, 0.5)
        parts = [scores[k : k + tile] for k in range(0, len(scores), tile)]
        ends = segment.edge_states([segment.tile_matrix(s, penalty) for s in parts])
        path = np.concatenate([segment.tile_path(s, penalty, *e) for s, e in zip(parts, ends)])
        assert (path == segment.best_path(scores, penalty)).all()


def observed(spark, values, step, size, contig="c"):
    """A vector with a value at every ``step``-th position, and what segments need besides."""
    rows = spark.createDataFrame([(contig, size, k * step, None if v is None else float(v)) for k, v in enumerate(values)], "contig string, size long, pos long, x double")
    fits = spark.createDataFrame([(contig, 5.0, 0.5)], "contig string, r double, p double")
    return rows, fits, rows.select("contig", "pos", F.lit(1e9).alias("threshold"))


@pytest.mark.parametrize("tile", [13, 100, 4_096])
def test_segments_do_not_depend_on_tiles(spark, tile):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.negative_binomial(5, 1 / (1 + o), n) for o, n in ((1, 150), (4, 90), (0.3, 200), (1, 12), (6, 100))])
    rows, fits, limits = observed(spark, values, 10, 5_530)
    want = segment.segments_of(np.arange(len(values)) * 10, values.astype(float), 5.0, 0.5, 5_530, 10.0, 300)
    got = segment.segments(rows, fits, limits, step=10, penalty=10.0, least=300, tile=tile).orderBy("segment").collect()
    assert len(want) >= 4 and [tuple(r)[1:] for r in got] == [(k, *w) for k, w in enumerate(want)]


def test_contigs_with_few_observations_have_no_segments(spark):
    for n, least, some in ((30, 300, True), (29, 300, False), (0, 300, False), (1, 5, True)):
        rows, fits, limits = observed(spark, [3] * n, 10, 400)
        assert (segment.segments(rows, fits, limits, step=10, least=least).count() > 0) == some


def test_a_long_contig_is_segmented_over_several_tasks(spark):
    n = 1_000_000
    rows = spark.range(n).select(F.lit("c").alias("contig"), F.lit(n).cast("long").alias("size"), F.col("id").alias("pos"), (F.pmod(F.xxhash64("id"), F.lit(5)) + F.when(F.col("id") < n // 3, 3).otherwise(13)).cast("double").alias("x"))
    fits = spark.createDataFrame([("c", 5.0, 0.5)], "contig string, r double, p double")
    got = segment.segments(rows, fits, rows.select("contig", "pos", F.lit(1e9).alias("threshold")), step=1, penalty=20.0, least=5_000).orderBy("segment").collect()
    assert len(got) == 2 and abs(got[0]["end"] - n // 3) < 50 and got[1]["end"] == n
    tiles = segment.observations(rows, fits, rows.select("contig", "pos", F.lit(1e9).alias("threshold")), 1, segment.TILE).groupBy("contig", "tile").count()
    assert tiles.count() == -(-n // segment.TILE) and tiles.agg(F.max("count")).first()[0] == segment.TILE


def test_step_of_segments_rounds_halves_to_even(spark):
    got = spark.range(1).select(*(segment.segment_step(F.lit(n), F.lit(1_000), 50).alias(str(n)) for n in (10, 490, 510, 530))).first()
    assert list(got) == [20, 24, 26, 26]


def test_colours_and_scores():
    assert export.colour(0.001, export.PEAK_COLOURS) == "49,163,84" and export.colour(0.2, export.PEAK_COLOURS) == export.GREY


def plain_scan(x, low, high, top, background_bins, signal_bins):
    """The scan on the values themselves, bin by bin."""
    x = np.sort(np.asarray(x, float))
    q_low = np.quantile(x, low)
    q_high = q_low + 1 if high <= low else np.quantile(x, high)
    q_high = max(q_high, top) if top is not None else q_high
    k, m = round(min(q_low, background_bins)), round(min(q_high - q_low, signal_bins))
    edges = list(np.round(np.linspace(0, q_low, k + 1)))[:-1] + [q_low] + list(np.round(np.linspace(q_low, q_high, m + 1)))[1:]
    counts = [int(((x >= a) & (x < b)).sum()) for a, b in zip(edges, edges[1:])]
    edges, counts = background.merge_small_bins(edges, counts, m)
    best = None
    for tr in edges[len(edges) - m :]:
        below = x[x < tr]
        mean, var = below.mean(), below.var(ddof=1)
        if tr <= q_low or var <= mean:
            continue
        r = mean**2 / (var - mean)
        p = mean / (mean + r)
        tail = [1.0 if e == 0 else math.exp(special.log_beta_tail([p], [e], [r])[0]) for e in edges]
        seen = [((below >= a) & (below < b)).sum() for a, b in zip(edges, edges[1:])]
        total, df = sum(seen), sum(a != b for a, b in zip(edges, edges[1:])) - 3
        want = [(s - t) * total / (1 - tail[-1]) for s, t in zip(tail, tail[1:])]
        g = 2 * sum(o * math.log(o / e) for o, e in zip(seen, want) if o and e > 0)
        error = math.sqrt(max(g / df - 1, 0) / (total - 1)) if df >= 1 else math.inf
        if math.isfinite(error) and (best is None or error < best[1]):
            best = tr, error, r, p
    return best


@pytest.mark.parametrize("low, top", [(0.6, None), (0.6, 60.0), (0.9, None), (0.995, None)])
def test_scan_is_that_of_the_values(low, top):
    for seed in range(8):
        rng = np.random.default_rng(seed)
        x = np.concatenate((rng.negative_binomial(3, 0.2, 3000), rng.poisson(60, 60)))
        values, counts = np.unique(x, return_counts=True)
        got = background.scan(values, counts, low=low, top=top, signal_bins=30)
        want = plain_scan(x, low, 0.995, top, 20, 30)
        if want is None:
            assert got["threshold"] == math.inf and got["rmsea"] is None
        else:
            assert np.allclose([got["threshold"], got["rmsea"], got["r"], got["p"]], want)


def test_scan_without_a_valid_edge_fits_all_values():
    # over-dispersed only with its top part
    values, counts = np.array([3.0, 4.0, 90.0]), np.array([500, 500, 3])
    found = background.scan(values, counts)
    x = np.repeat(values, counts)
    assert found["threshold"] == math.inf and found["rmsea"] is None and found["fit_quantile_sampled"] == 1
    assert math.isclose(found["r"], x.mean() ** 2 / (x.var(ddof=1) - x.mean()))
    # an infinite error is no fit: too few bins for a degree of freedom
    found = background.scan(np.array([0.0, 1.0, 8.0, 9.0]), np.array([5, 5, 5, 5]), background_bins=1, signal_bins=1)
    assert found["threshold"] == math.inf and found["rmsea"] is None
    assert background.scan(values, counts, top=math.inf)["threshold"] == math.inf


def test_edges_are_those_of_the_operator(spark):
    rng = np.random.default_rng(4)
    x = rng.negative_binomial(2, 0.1, 500)
    values, counts = np.unique(x, return_counts=True)
    got, q_low, m = background.edges_of(values, counts.cumsum(), 0.6, 0.995, None, 20, 100)
    want = background.bin_edges(vector(spark, x)).first()
    assert np.allclose(got, want["edges"]) and math.isclose(q_low, want["q_low"]) and m == want["n_signal"]
    assert background.bin_edges(vector(spark, x), fallback=F.lit(500.0)).first()["edges"][-1] == 500


def test_groups_have_quantiles_and_tops_of_their_own(spark):
    rng = np.random.default_rng(5)
    both = {c: rng.negative_binomial(2, 0.1, 800) for c in "ab"}
    rows = vector(spark, both["a"], "a").unionByName(vector(spark, both["b"], "b"))
    lows = spark.createDataFrame([("a", 0.6), ("b", 0.9)], "contig string, low double")
    tops = spark.createDataFrame([("a", 90.0), ("b", 10.0)], "contig string, top double")
    got = {r["contig"]: r for r in background.fit_groups(rows, lows=lows, tops=tops).collect()}
    for c, low, top in (("a", 0.6, 90.0), ("b", 0.9, 10.0)):
        values, counts = np.unique(both[c], return_counts=True)
        want = background.scan(values, counts, low=low, top=top)
        assert (got[c]["threshold"], got[c]["rmsea"]) == (want["threshold"], want["rmsea"]) and got[c]["n_signal"] == (both[c] >= want["threshold"]).sum()


def test_logarithm_of_gamma():
    x = np.concatenate((np.geomspace(1e-6, 1e6, 500), np.arange(1.0, 60)))
    assert np.allclose(special.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-13, atol=1e-13)


def test_signal_to_noise(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(40):
        bases = int(10 ** rng.uniform(4, 6))
        share = 1 / (1 + math.exp(-(0.2 * math.log(bases) - 4)))
        if k == 7:
            share = 0.95  # an outlier
        rows.append(("c", k, k * 10, round(1_000_000 * (1 - share)), 1_000_000, bases))
    table = spark.createDataFrame(rows, "contig string, segment int, start long, bg_tags long, mappable_tags long, mappable_bases long")
    marked, line = regression.fit_signal_to_noise(table)
    assert math.isclose(line.slope, 0.2, abs_tol=1e-3) and math.isclose(line.intercept, -4, abs_tol=2e-2) and 0 < line.score < 1 and line.score_std < 0.5
    got = {r["segment"]: r for r in marked.collect()}
    assert [k for k, r in got.items() if r["outlier_distance"] >= regression.OUTLIER] == [7] and not got[7]["is_inlier"]
    want = 1 / (1 + math.exp(0.2 * math.log(rows[3][5]) - 4 + math.log(5)))
    assert math.isclose(got[3]["min_bg_tag_proportion"], math.ceil(want * 1e5) / 1e5, abs_tol=2e-4)
    none, line = regression.fit_signal_to_noise(table.limit(0))
    assert none.count() == 0 and line.slope is None


def test_fdr_joins_candidates_alone(spark):
    rows = spark.createDataFrame([(k, 0.0 if k % 5 else 3.0 + k / 100) for k in range(500)] + [(900, None)], "k int, neglog10_p double")
    got = {r["k"]: r["neglog10_q"] for r in fdr.fdr(rows, 0.05).collect()}
    assert len(got) == 501 and sum(v is not None for v in got.values()) == 100


def test_flagged_reads(spark):
    rows = [("c", 10, 20, 0), ("c", 10, 20, 16), ("c", 10, 20, 4), ("c", 10, 20, 256), ("c", 10, 20, 2048 | 16)]
    reads = spark.createDataFrame(rows, "contig string, start long, end long, flag long")
    assert sorted(map(tuple, dense.flagged_reads_to_cuts(reads).collect())) == [("c", 10, 1), ("c", 20, 1)]


def test_rows_in_the_order_of_the_catalogue(spark):
    contigs = spark.createDataFrame([("z", 9, 0), ("a", 9, 1)], "contig string, size long, ord int")
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("z", 5), ("x", 1)], "contig string, start long")
    assert [tuple(r) for r in dense.merged(rows, contigs, "start").collect()] == [("z", 5), ("a", 1), ("a", 2)]


def plain_cascade(x, taps, level):
    """Level by level, position by position."""
    n, v = len(x), list(map(float, x))
    for j in range(level):
        far = len(taps) * 2**j - 1
        v = [sum(g * v[(t + far - i * 2**j) % n] for i, g in enumerate(taps)) for t in range(n)]
    for j in range(level - 1, -1, -1):
        far = len(taps) * 2**j - 1
        v = [sum(g * v[(t - far + i * 2**j) % n] for i, g in enumerate(taps)) for t in range(n)]
    return np.array(v)


@pytest.mark.parametrize("name, level", [("db2", 3), ("la8", 2), ("haar", 3), ("sym5", 1), ("db4", 4)])
def test_wavelets_are_the_plain_cascade(spark, name, level):
    rng = np.random.default_rng(1)
    taps = wavelets.scaling(name)
    for n, tile in ((400, 64), (400, 1_000), (37, 16), (5, 16), (1, 8)):
        x = rng.integers(0, 50, n).tolist()
        got = {r["pos"]: r["smoothed"] for r in wavelets.wavelet_smooth(vector(spark, x), name, level, tile=tile).collect()}
        assert np.allclose([got[k] for k in range(n)], plain_cascade(x, taps, level), atol=1e-9) and len(got) == n


def test_filters():
    s3 = math.sqrt(3)
    assert np.allclose(sorted(wavelets.scaling("db2")), sorted([(1 + s3) / 8, (3 + s3) / 8, (3 - s3) / 8, (1 - s3) / 8])) and wavelets.scaling("haar") == (0.5, 0.5)
    for name in ("db2", "db5", "db10", "la8", "sym6", "la20"):
        g = np.array(wavelets.scaling(name))
        assert abs(g.sum() - 1) < 1e-9 and all(abs((g[2 * k :] * g[: len(g) - 2 * k]).sum() - 0.5 * (k == 0)) < 1e-5 for k in range(len(g) // 2))
        assert abs((g * (-1.0) ** np.arange(len(g))).sum()) < 1e-9
    la8 = np.array(wavelets.scaling("la8"))
    assert abs(la8).argmax() in (3, 4) and abs(np.array(wavelets.scaling("db4"))).argmax() not in (3, 4)
    for name in ("db11", "la7", "coif1", "sym0"):
        with pytest.raises(ValueError, match="no filter"):
            wavelets.scaling(name)


@pytest.mark.parametrize("flank", [0, 1, 3, 10, 60])
def test_maxima_for_any_tile_and_nulls(spark, flank):
    rng = np.random.default_rng(flank)
    x = [None if rng.random() < 0.4 else int(v) for v in rng.integers(0, 1_000, 90)]
    x[20:50] = [None] * 30
    want = [max((v for v in x[max(0, k - flank) : k + flank + 1] if v is not None), default=None) for k in range(len(x))]
    for tile in (1, 7, 20, 89, 1_000):
        got = {r["pos"]: r["top"] for r in windows.running_max(vector(spark, x), flank, tile=tile).collect()}
        assert [got[k] for k in range(len(x))] == want


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_maxima_take_as_many_passes_for_any_flank(spark):
    rows = vector(spark, range(50))
    passes = {flank: plan_of(windows.running_max(rows, flank)).count("Window [") for flank in (3, 50, 5_000)}
    assert len(set(passes.values())) == 1 and passes[3] <= 4
    assert plan_of(windows.running_max(rows, 500)).count("Exchange hashpartitioning") == 1
    summed = plan_of(windows.window_sums(rows, 5, 5, {"a": F.col("x"), "b": F.col("x") * 2}))
    assert summed.count("Exchange hashpartitioning") == 1 and summed.count("Window [") <= 3


def test_neighbours_across_tiles(spark):
    rng = np.random.default_rng(4)
    data = [(c, int(p), int(v) if rng.random() > 0.2 else None) for c in "ab" for p, v in zip(np.sort(rng.choice(500, 60, replace=False)), rng.integers(0, 9, 60))]
    rows = spark.createDataFrame(data, "contig string, pos long, v long")
    want = {}
    for c in "ab":
        own = [d for d in data if d[0] == c]
        for k, d in enumerate(own):
            want[d[:2]] = (own[k - 1][1] if k else None, own[k + 1][2] if k + 1 < len(own) else None)
    for tile in (1, 10, 37, 1_000):
        got = windows.neighbours(rows, "pos", {"before": ("pos", -1), "then": ("v", 1)}, tile=tile).collect()
        assert {(r["contig"], r["pos"]): (r["before"], r["then"]) for r in got} == want


def test_summits_and_centres_have_no_window_over_a_contig(spark):
    rows, contigs = vector(spark, [0, 1, 0, 2, 0]), spark.createDataFrame([("c", 5, 0)], "contig string, size long, ord int")
    centres = spark.createDataFrame([("c", 0, 1.0), ("c", 3, 2.0)], "contig string, centre long, value double")
    import re

    for df in (peaks.summits(rows, contigs), background.interpolated(centres, contigs, 3)):
        df.collect()
        lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        over = [k for k, line in enumerate(lines) if re.search(r"Window \[.*\], \[contig#\d+\], ", line)]
        # windows by contig alone look at the outermost rows of tiles, which a filter leaves
        assert over and all(any("Filter" in line for line in lines[k : k + 8]) for k in over)


def test_pyramid_for_long_and_overlapping_intervals(spark):
    rng = np.random.default_rng(6)
    old, islands.TILE, islands.TILE_LEVELS = islands.TILE, 64, 6
    try:
        x = rng.random(1_000) * 100
        x[rng.random(1_000) < 0.3] = np.nan
        scores = spark.createDataFrame([("c", k, None if np.isnan(v) else float(v)) for k, v in enumerate(x)] + [("c", 5, 3.0), ("d", 3, -2.0)], "contig string, pos long, neglog10_p double")
        spans = [("c", int(a), int(a + n), f"n{k}") for k, (a, n) in enumerate(zip(rng.integers(-20, 1_000, 150), rng.integers(-3, 1_100, 150)))] + [("d", 0, 9, "neg"), ("e", 1, 5, "none"), (None, 1, 5, "null"), ("c", None, 5, "null")] + [("c", 0, 1 << 40, "all")] * 3
        rows = spark.createDataFrame(spans, "contig string, start long, end long, name string").coalesce(1)
        got = sorted(islands.interval_max(rows, scores, row="row").collect(), key=lambda r: r["row"])
        pyramid = islands.block_maxima(scores, "neglog10_p").where("contig = 'c'").groupBy("level").count().collect()
    finally:
        islands.TILE, islands.TILE_LEVELS = old, old.bit_length() - 1
    x[5] = np.nanmax([x[5], 3.0])
    assert [tuple(r)[:4] for r in got] == spans and got[0].asDict().keys() == {"contig", "start", "end", "name", "row", "max_neglog_p"}
    for r in got:
        part = x[max(0, r["start"] or 0) : max(0, r["end"])] if r["contig"] == "c" and r["start"] is not None else np.array([])
        assert r["max_neglog_p"] == (np.nanmax(part) if np.isfinite(part).any() else 0.0), r
    assert sum(r["count"] for r in pyramid) < 2 * 1_000 + 200 and {r["level"] for r in pyramid} == set(range(63))
    blocks = spark.createDataFrame(spans[:150], "contig string, lo long, hi long, name string").selectExpr("hi - greatest(lo, 0) AS n", "greatest(lo, 0) AS lo", "hi").withColumn("b", islands.blocks_of("lo", "hi")).collect()
    for r in blocks:
        held = sorted(p for b in r["b"] for p in range(b["block"] << b["level"], (b["block"] + 1) << b["level"]))
        assert held == list(range(r["lo"], r["hi"])) and len(r["b"]) <= 2 * math.ceil(math.log2(max(2, r["n"])))


def test_quantiles_do_not_depend_on_tiles_and_move_samples_once(spark):
    rng = np.random.default_rng(8)
    x = [None if rng.random() < 0.1 else int(v) for v in rng.integers(0, 60, 900)]
    rows = vector(spark, x)
    seen = [(k, v) for k, v in enumerate(x) if k % 3 == 0 and v is not None]
    want = {}
    for c in range(0, 900, 30):
        for name, half in (("a", (301 // 3 | 1) // 2 * 3), ("b", (31 // 3 | 1) // 2 * 3)):
            own = sorted(v for k, v in seen if abs(k - c) <= half)
            want[c, name] = float(own[math.ceil(round(0.9 * (len(own) - 1), 9))])
    for tile in (50, 130, 5_000):
        got = background.windowed_quantiles(rows, F.lit(0.9), {"a": 301, "b": 31}, 3, 30, tile=tile)
        assert {(r["centre"], k): r[k] for r in got.collect() for k in "ab"} == want
    spread = windows.tiled(background.sampled(vector(spark, [1] * 9_000), 3), 150, 150, 3_000).count()
    assert spread < 1.2 * 3_000  # to each centre it would be ten times as many


def test_mask_in_the_aggregate_is_the_mask_by_positions(spark):
    contigs = spark.createDataFrame([("a", 300, 0), ("b", 50, 1), ("c", 80, 2)], "contig string, size long, ord int")
    cuts = spark.createDataFrame([("a", k, k % 5) for k in range(0, 300, 7)] + [("b", 3, 1)], "contig string, pos long, cnt long")
    spans = spark.createDataFrame([("a", 0, 20), ("a", 10, 70), ("a", 70, 71), ("a", 127, 129), ("a", 250, 300), ("a", 128, 256), ("a", 9, 9), ("b", 0, 51), ("b", 3, 9), ("x", 1, 2), ("c", 79, 80)], "contig string, start long, end long")
    old, dense.TILE = dense.TILE, 64
    try:
        got = dense.densify(cuts, contigs, spans).collect()
    finally:
        dense.TILE = old
    inside = {tuple(r) for r in dense.mappable_positions(spans, contigs).collect()}
    counts = {(r["contig"], r["pos"]): r["x"] for r in dense.densify(cuts, contigs).collect()}
    assert {(r["contig"], r["pos"]): r["x"] for r in got} == counts and {(r["contig"], r["pos"]) for r in got if r["mappable"]} == inside and len(got) == 430
    assert "BroadcastNestedLoopJoin" not in plan_of(dense.densify(cuts, contigs, spans))


def test_places_of_ordered_rows(spark):
    rows = spark.range(1_000).select((F.col("id") * 7919 % 1_000).alias("v")).repartition(7).orderBy("v")
    assert sorted(tuple(r) for r in dense.placed(rows).collect()) == [(k, k) for k in range(1_000)]


def test_signal_to_noise_line_distances_and_spread(spark):
    rng = np.random.default_rng(12)
    bases = rng.integers(50_000, 5_000_000, 60)
    logit = 0.3 * np.log(bases) - 5.5 + rng.normal(size=60) * 0.05
    logit[[3, 17, 40]] += 3.0  # outliers
    tags = bases * 2
    share = 1 / (1 + np.exp(-logit))
    kept = np.round(tags * (1 - share)).astype(int)
    rows = [(f"c{k % 3}", int(k * 10), int(b), int(t), int(n)) for k, (b, t, n) in enumerate(zip(kept, tags, bases))] + [("c0", 900, 5, 5, 60_000), ("c0", 910, 0, 5, 60_000), ("c0", 920, 0, 0, 10)]
    table = spark.createDataFrame(rows, "contig string, start long, bg_tags long, mappable_tags long, mappable_bases long")
    marked, line = regression.fit_signal_to_noise(table)
    got = {(r["contig"], r["start"]): r for r in marked.collect()}
    s = {(c, a): 1 - b / t for c, a, b, t, n in rows[:60]}
    known = {k: n for (c, a, b, t, n) in rows[:60] for k in [(c, a)]}
    inliers = [k for k in known if got[k]["is_inlier"]]
    assert 25 <= len(inliers) and not {("c0", 30), ("c2", 170), ("c1", 400)} & set(inliers)
    x, y = (np.array([f(k) for k in inliers]) for f in (lambda k: math.log(known[k]), lambda k: math.log(s[k] / (1 - s[k]))))
    slope, intercept = np.polyfit(x, y, 1)
    assert abs(line.slope - slope) < 1e-9 and abs(line.intercept - intercept) < 1e-9 and abs(slope - 0.3) < 0.05
    order = sorted(known, key=lambda k: s[k])
    score = next(s[k] for i, k in enumerate(order) if sum(known[j] for j in order[: i + 1]) >= sum(known.values()) / 2)
    spread = {k: math.log(s[k] / (1 - s[k])) - slope * math.log(known[k]) - intercept for k in known}
    level = {k: 1 / (1 + math.exp(-(spread[k] + math.log(score / (1 - score))))) for k in known}
    std = math.sqrt(sum(known[k] * (level[k] - score) ** 2 for k in known) / sum(known.values()))
    assert abs(line.score - score) < 1e-12 and abs(line.score_std - std) < 1e-9
    for k, n in known.items():
        assert abs(got[k]["segment_SPOT"] - s[k]) < 1e-12 and abs(got[k]["outlier_distance"] / math.exp(spread[k]) - 1) < 1e-6
        least = 1 / (1 + math.exp(slope * math.log(n) + intercept + math.log(5)))
        assert abs(got[k]["min_bg_tag_proportion"] - math.ceil(least * 1e5) / 1e5) < 2e-5
    assert {k for k, r in got.items() if (r["outlier_distance"] or 0) >= 5} == {("c0", 30), ("c2", 170), ("c1", 400)}
    # shares of 0 and 1, and none, are no points of the line
    assert [got["c0", a]["outlier_distance"] for a in (900, 910, 920)] == [None] * 3 and got["c0", 920]["segment_SPOT"] is None


def test_without_a_valid_segment_nothing_is_known(spark):
    table = spark.createDataFrame([("c", 0, 5, 5, 100)], "contig string, start long, bg_tags long, mappable_tags long, mappable_bases long")
    marked, line = regression.fit_signal_to_noise(table)
    assert line.slope is None and marked.first()["min_bg_tag_proportion"] == 1.0 and marked.first()["outlier_distance"] is None


@pytest.mark.parametrize("window, fraction", [(1, 0.05), (7, 0.05), (151, 0.8), (151, None), (301, 0.05)])
def test_sums_of_counts_are_those_of_the_dense_vector(spark, window, fraction):
    contigs = spark.createDataFrame([("a", 300, 0), ("b", 50, 1), ("c", 80, 2), ("none", 0, 3)], "contig string, size long, ord int")
    cuts = spark.createDataFrame([("a", k, k % 5) for k in range(0, 300, 7)] + [("a", 7, 9), ("a", 300, 4), ("a", -1, 4), ("b", 3, 1), ("b", 49, 2), ("x", 1, 1), ("c", 5, None)], "contig string, pos long, cnt long")
    spans = spark.createDataFrame([("a", 0, 20), ("a", 10, 70), ("a", 127, 129), ("a", 250, 300), ("a", 128, 256), ("b", 0, 51), ("c", 79, 80)], "contig string, start long, end long")
    want = windows.running(dense.densify(cuts, contigs, spans), window, "sum", fraction).drop("x").collect()
    for tile in (16, 64, 1 << 17):
        for mappable in (spans, None):
            found = windows.count_sums(cuts, contigs, window, fraction, mappable, tile=tile)
            columns = found.columns
            assert sorted(map(tuple, found.collect()), key=str) == sorted((tuple(r[c] for c in columns) for r in want), key=str) and ("mappable" in columns) == (mappable is not None)


def test_sliding_fit_goes_over_tiles_once_and_does_not_depend_on_them(spark):
    rng = np.random.default_rng(5)
    x = [None if rng.random() < 0.1 else int(v) for v in rng.negative_binomial(2, 0.4, 400)]
    rows = vector(spark, x).withColumns({"threshold": F.lit(9.0), "fallback_r": F.when(F.col("pos") % 3 > 0, 1.5)})
    window, flank, half = 41, 3, 20
    calm = [v if v is not None and not any(u is not None and u >= 9 for u in x[max(0, k - flank) : k + flank + 1]) else None for k, v in enumerate(x)]
    for tile in (30, 1_000):
        found = background.sliding_nb(rows, window=window, flank=flank, fraction=0.4, tile=tile)
        plan = plan_of(found)
        assert "Window [" not in plan and plan.count("Exchange hashpartitioning") == 1
        got = {r["pos"]: r for r in found.collect()}
        assert set(got) == set(range(400)) and found.columns == [*rows.columns, "enough_bg", "sliding_r", "sliding_p"]
        for k, v in enumerate(x):
            own = [u for u in calm[max(0, k - half) : k + half + 1] if u is not None]
            mean, variance = (np.mean(own), np.var(own, ddof=1)) if len(own) > 1 else (0, 0)
            fallback = 1.5 if k % 3 else None
            assert got[k]["enough_bg"] == (v is not None and len(own) >= 16)
            r = mean * mean / (variance - mean) if variance > mean + 1e-9 else fallback
            want = (r, mean / (mean + r) if r else None) if got[k]["enough_bg"] else (None, None)
            assert all((a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-6)) for a, b in zip((got[k]["sliding_r"], got[k]["sliding_p"]), want)), k


def test_regions_are_made_of_significant_positions_alone(spark):
    rng = np.random.default_rng(3)
    rows = vector(spark, [int(v) for v in rng.random(3_000) < 0.008]).withColumn("x", F.col("x") * (F.col("pos") % 7 + 1))
    dense_rows = islands.islands(islands.dilate(rows, F.col("x") >= 2, 101).where("inside")).collect()
    for given in (rows, rows.where("x >= 2")):
        found = islands.regions(given, "x", 2.0, 101).collect()
        assert sorted((r["start"], r["end"]) for r in found) == sorted((r["start"], r["end"]) for r in dense_rows) and 3 < len(found)
        assert sum(r["n_significant"] for r in found) == rows.where("x >= 2").count()


def test_short_parts_join_the_shortest_first_however_many(spark):
    def naive(starts, sums, size, least):
        starts, sums = [0, *starts[1:]], list(sums)
        while len(starts) > 1:
            lengths = np.diff([*starts, size])
            k = int(lengths.argmin())
            if lengths[k] >= least:
                break
            j = max((sums[k][sums[j].argmax()], j) for j in (k - 1, k + 1) if 0 <= j < len(starts))[1]
            sums[min(j, k)] = sums[j] + sums[k]
            del starts[max(j, k)], sums[max(j, k)]
        return [(a, int(s.argmax())) for a, s in zip(starts, sums)]

    rng = np.random.default_rng(1)
    for n, least in ((1, 50), (2, 50), (200, 50), (200, 300), (200, 10**6)):
        starts = np.sort(rng.choice(4_000, n, replace=False)).tolist()
        sums = list(rng.integers(-30, 0, (n, len(segment.STATES))).astype(float))
        want = naive(starts, sums, 4_000, least)
        kept = [x for k, x in enumerate(want) if not k or x[1] != want[k - 1][1]]
        assert [(a, segment.STATES.index(s)) for a, _, s in segment.settled(starts, sums, 4_000, least)] == kept
    began, n = time.time(), 40_000  # a scan of all parts for each that joins takes minutes
    parts = segment.settled(list(range(0, 10 * n, 10)), list(rng.normal(size=(n, len(segment.STATES)))), 10 * n, 1_000)
    assert time.time() - began < 15 and parts[0][0] == 0 and parts[-1][1] == 10 * n and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))


def test_thresholds_of_positions_are_made_by_many_tasks(spark):
    size = 1_500_000
    centres, contigs = spark.createDataFrame([("c", 0, 1.0), ("c", 900_000, 2.0)], "contig string, centre long, value double"), spark.createDataFrame([("c", size, 0)], "contig string, size long, ord int")
    made = background.interpolated(centres, contigs, 900_000).groupBy(F.spark_partition_id()).count().collect()
    assert len(made) > 1 and sum(r["count"] for r in made) == size
