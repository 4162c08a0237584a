"""Registered queries over the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyridge.functions import special
from tallyridge.operators import background, dense, export, fdr, islands, peaks, regression, segment, wavelets, windows
from tallyridge.plans.caller import Caller, Config, multi_sample_fdr
from tallyridge.plans.steps import CALLING
from tallyridge.sources import adapters, tracks
from tallyridge.sources.scratch import folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The driver's contigs are short: windows are narrower than a genome's.
WINDOW, BG, STEP, STRIDE = 151, 2001, 15, 300
LEVEL, FLANK = 3400, 50

BASE = f"""
cuts AS ({adapters.CUTS_SQL}),
sizes AS ({adapters.CONTIGS_SQL}),
dense AS MATERIALIZED (
  SELECT p.contig, p.size, p.pos, CAST(coalesce(cnt, 0) AS BIGINT) AS x
  FROM (SELECT contig, size, unnest(range(size)) AS pos FROM sizes) p LEFT JOIN cuts USING (contig, pos)
),
agg AS MATERIALIZED (
  SELECT contig, size, pos, CAST(sum(x) OVER (PARTITION BY contig ORDER BY pos ROWS BETWEEN {WINDOW // 2} PRECEDING AND {WINDOW // 2} FOLLOWING) AS DOUBLE) AS x FROM dense
)"""
SCORED = f"""{BASE},
scored AS (SELECT contig, size, pos, x / 500 AS s FROM agg),
significant AS (SELECT contig, pos FROM agg WHERE x >= {LEVEL})"""
INSIDE = """inside AS (
  SELECT contig, pos FROM (
    SELECT contig, pos, sum(CAST(x >= {level} AS INT)) OVER (PARTITION BY contig ORDER BY pos ROWS BETWEEN 75 PRECEDING AND 75 FOLLOWING) AS k FROM agg
  ) WHERE k >= {least}
)"""
RUNS = """{name} AS (
  SELECT contig, min(pos) AS start, max(pos) + 1 AS "end" FROM (
    SELECT contig, pos, pos - row_number() OVER (PARTITION BY contig ORDER BY pos) AS g FROM {source}
  ) GROUP BY contig, g
)"""
#: Smooths the positions of a source.
SMOOTH_OF = """around_ends AS (
  SELECT contig, size, pos + t * size AS p, x FROM {source} CROSS JOIN (SELECT unnest([-1, 0, 1]) AS t) WHERE pos + t * size >= -254 AND pos + t * size < size + 254
), boxes AS (
  SELECT contig, size, p, sum(x) OVER (PARTITION BY contig ORDER BY p ROWS BETWEEN CURRENT ROW AND 127 FOLLOWING) AS x FROM around_ends
), wave AS (
  SELECT contig, size, pos, x FROM (
    SELECT contig, size, p AS pos, sum(x) OVER (PARTITION BY contig ORDER BY p ROWS BETWEEN 127 PRECEDING AND CURRENT ROW) / 16384 AS x FROM boxes
  ) WHERE pos >= 0 AND pos < size
)"""
SMOOTH = SMOOTH_OF.format(source="dense")
EXTREMA = """runs AS (
  SELECT contig, g, min(pos) AS a, max(pos) AS b, any_value(x) AS x FROM (
    SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY contig ORDER BY pos) AS g FROM (
      SELECT *, coalesce(lag(x) OVER (PARTITION BY contig ORDER BY pos) <> x, true) AS new FROM wave
    )
  ) GROUP BY contig, g
), around AS (
  SELECT *, lag(x) OVER w AS l, lead(x) OVER w AS r FROM runs WINDOW w AS (PARTITION BY contig ORDER BY a)
), extrema AS (
  SELECT contig, (a + b) // 2 AS pos, CASE WHEN x > l AND x > r THEN 'max' WHEN x < l AND x < r THEN 'min' END AS kind FROM around
  WHERE (x > l AND x > r) OR (x < l AND x < r)
), tops AS (
  SELECT contig, pos AS summit, coalesce(l, 0) AS "left", coalesce(r, (SELECT max(size) - 1 FROM sizes)) AS "right" FROM (
    SELECT *, lag(pos) OVER w AS l, lead(pos) OVER w AS r FROM extrema WINDOW w AS (PARTITION BY contig ORDER BY pos)
  ) WHERE kind = 'max'
)"""
CALLED = f"""{EXTREMA},
called AS (
  SELECT t.*, greatest(l.x, s.x / 2, r.x) AS cutoff, s.x AS height FROM tops t
  JOIN spans ON spans.contig = t.contig AND t.summit >= spans.start AND t.summit < spans."end"
  JOIN wave l ON l.contig = t.contig AND l.pos = t."left" JOIN wave s ON s.contig = t.contig AND s.pos = t.summit JOIN wave r ON r.contig = t.contig AND r.pos = t."right"
), trimmed AS (
  SELECT c.contig, c.summit, height, cutoff, max(w.pos) FILTER (w.pos <= c.summit) AS start, min(w.pos) FILTER (w.pos >= c.summit) - 1 AS "end"
  FROM called c JOIN wave w ON w.contig = c.contig AND w.pos BETWEEN c."left" AND c."right" AND w.x <= cutoff GROUP BY ALL
), total AS (SELECT sum(cnt) AS total FROM cuts),
wide AS (
  SELECT contig, summit, height, greatest(least(start, summit - 10), 0) AS start, least(greatest("end", summit + 10) + 1, size) AS "end" FROM trimmed JOIN sizes USING (contig)
), peaks AS (
  SELECT p.contig, p.start, p."end", p.summit, max(w.x / total * 1e6) FILTER (w.pos = p.summit) AS summit_density, max(w.x / total * 1e6) AS max_density, height / total * 1e6 AS smoothed_peak_height
  FROM wide p JOIN wave w ON w.contig = p.contig AND w.pos >= p.start AND w.pos < p."end" CROSS JOIN total GROUP BY p.contig, p.start, p."end", p.summit, height, total
)"""
PEAKS = f"""{INSIDE.format(level=LEVEL, least=10)}, {RUNS.format(name="spans", source="inside")}, {SMOOTH}, {CALLED}"""
REGIONS = f"""{SCORED}, {INSIDE.format(level=LEVEL, least=1)}, {RUNS.format(name="spans", source="inside")}, {RUNS.format(name="hits", source="significant")},
regions AS (
  SELECT s.contig, s.start, s."end", (SELECT max(x) FROM agg a WHERE a.contig = s.contig AND a.pos >= s.start AND a.pos < s."end" AND a.x >= {LEVEL}) AS max_score,
         CAST(sum(h."end" - h.start) AS BIGINT) AS n_significant, list(h.start - s.start ORDER BY h.start) AS starts, list(h."end" - h.start ORDER BY h.start) AS lengths
  FROM spans s JOIN hits h ON h.contig = s.contig AND h.start >= s.start AND h.start < s."end" GROUP BY ALL
)"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.densify(adapters.cuts(spark, sf_dir), adapters.contigs(spark, sf_dir))


def sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window sums of all positions as ``x``."""
    return windows.running(counts(spark, sf_dir), WINDOW, "sum").select("contig", "size", "pos", F.col("agg").alias("x"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table, for what reads it several times."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.triangle_smooth(counts(spark, sf_dir)).select("contig", "size", "pos", F.col("smoothed").alias("x"))


def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.normalized_density(wave(spark, sf_dir), dense.total_cuts(adapters.cuts(spark, sf_dir)))


@query("SELECT l_returnflag AS contig, CASE WHEN l_linestatus = 'F' THEN l_orderkey ELSE l_orderkey + CAST(l_quantity AS BIGINT) END AS pos, count(*) AS cnt FROM lineitem GROUP BY 1, 2")
def reads_to_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.reads_to_cuts(adapters.reads(spark, sf_dir))


@query(
    """WITH r AS (SELECT *, l_partkey % 4096 AS flag FROM lineitem)
SELECT l_returnflag AS contig, CASE WHEN flag & 16 = 0 THEN l_orderkey ELSE l_orderkey + CAST(l_quantity AS BIGINT) END AS pos, count(*) AS cnt FROM r WHERE flag & (4 | 256 | 2048) = 0 GROUP BY 1, 2"""
)
def flagged_reads_to_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    end = F.col("l_orderkey") + F.col("l_quantity").cast("long")
    return dense.flagged_reads_to_cuts(lines.select(F.col("l_returnflag").alias("contig"), F.col("l_orderkey").alias("start"), end.alias("end"), (F.col("l_partkey") % 4096).alias("flag")))


@query(adapters.EVENT_CUTS_SQL)
def event_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.event_cuts(spark, sf_dir)


@query(f"WITH {BASE} SELECT CAST(sum(cnt) AS BIGINT) AS total FROM cuts")
def total_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.total_cuts(adapters.cuts(spark, sf_dir))


@query(f"WITH {BASE} SELECT contig, pos, x FROM dense")
def densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(spark, sf_dir).select("contig", "pos", "x")


@query(f"WITH {BASE} SELECT contig, pos, x FROM agg")
def window_sum_151(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sums(spark, sf_dir).select("contig", "pos", "x")


@query(f"WITH {BASE} SELECT contig, pos, CASE WHEN (pos // 1000) % 10 <> 9 THEN x END AS x FROM agg")
def masked_window_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    contigs = adapters.contigs(spark, sf_dir)
    rows = dense.densify(adapters.cuts(spark, sf_dir), contigs, adapters.unmappable_blocks(contigs))
    return windows.running(rows, WINDOW, "sum").select("contig", "pos", F.when(F.col("mappable"), F.col("agg")).alias("x"))


@query(
    f"WITH {BASE} SELECT contig, pos, round(avg(x) OVER w, 6) AS mean, round(var_samp(x) OVER w, 6) AS variance FROM dense WINDOW w AS (PARTITION BY contig ORDER BY pos ROWS BETWEEN 75 PRECEDING AND 75 FOLLOWING)"
)
def window_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = windows.running(counts(spark, sf_dir), WINDOW, "mean").select("contig", "pos", F.col("agg").alias("mean"))
    variance = windows.running(counts(spark, sf_dir), WINDOW, "var").select("contig", "pos", F.col("agg").alias("variance"))
    return rounded(mean.join(variance, ["contig", "pos"]), "mean", "variance")


@query(f"WITH {BASE} SELECT contig, pos, max(x) OVER (PARTITION BY contig ORDER BY pos ROWS BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS top FROM dense")
def flank_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.running_max(counts(spark, sf_dir), 500).select("contig", "pos", "top")


@query(f"WITH {BASE} SELECT contig, pos, coalesce(max(x) OVER (PARTITION BY contig ORDER BY pos ROWS BETWEEN {FLANK} PRECEDING AND {FLANK} FOLLOWING) >= {LEVEL}, false) AS signal FROM agg")
def signal_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.signal_mask(sums(spark, sf_dir), F.lit(LEVEL), FLANK).select("contig", "pos", "signal")


@query(f"WITH {BASE}, {SMOOTH} SELECT contig, pos, round(x, 6) AS smoothed FROM wave")
def triangle_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(wave(spark, sf_dir).select("contig", "pos", F.col("x").alias("smoothed")), "smoothed")


#: Taps of the Daubechies filter with two vanishing moments, of sum 1, in closed form.
DB2 = ("(1 + sqrt(3)) / 8", "(3 + sqrt(3)) / 8", "(3 - sqrt(3)) / 8", "(1 - sqrt(3)) / 8")
DB2_LEVEL, DB2_FAR = 3, 64


def _cascade() -> str:
    """Each level by leads, then each by lags, over positions that go around the ends."""
    steps, source = [f"d0 AS (SELECT contig, size, pos + t * size AS p, CAST(x AS DOUBLE) AS v FROM dense CROSS JOIN (SELECT unnest([-1, 0, 1]) AS t) WHERE pos + t * size >= -{DB2_FAR} AND pos + t * size < size + {DB2_FAR})"], 0
    for move, levels in (("lead", range(DB2_LEVEL)), ("lag", range(DB2_LEVEL - 1, -1, -1))):
        for j in levels:
            terms = " + ".join(f"{tap} * {move}(v, {4 * 2**j - 1 - i * 2**j}) OVER w" for i, tap in enumerate(DB2))
            steps.append(f"d{source + 1} AS (SELECT contig, size, p, {terms} AS v FROM d{source} WINDOW w AS (PARTITION BY contig ORDER BY p))")
            source += 1
    return ", ".join(steps) + f", cascaded AS (SELECT contig, p AS pos, v FROM d{source} WHERE p >= 0 AND p < size)"


@query(f"WITH {BASE}, {_cascade()} SELECT contig, pos, round(v + 1e-9, 6) + 0.0 AS smoothed FROM cascaded")  # values are multiples of a power of two: rounding must not meet ties
def wavelet_smooth_db2(spark: SparkSession, sf_dir: str) -> DataFrame:
    wave = wavelets.wavelet_smooth(counts(spark, sf_dir), "db2", DB2_LEVEL).select("contig", "pos", "smoothed")
    return wave.select("contig", "pos", (F.round(F.col("smoothed") + 1e-9, 6) + 0.0).alias("smoothed"))


@query(f"WITH {BASE}, {SMOOTH} SELECT contig, pos, round(x / (SELECT sum(cnt) FROM cuts) * 1e6, 6) AS density FROM wave")
def normalized_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density(spark, sf_dir).select("contig", "pos", "density"), "density")


@query(f"WITH {BASE}, {SMOOTH} SELECT contig, pos AS start, pos + 20 AS \"end\", round(x / (SELECT sum(cnt) FROM cuts) * 1e6, 6) AS value FROM wave WHERE pos % 20 = 0 AND x > 0")
def track_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(export.track(density(spark, sf_dir), "density", 20, positive=True), "value")


@query(
    f"""WITH {BASE}, t AS (SELECT contig, pos AS start, least(pos + 20, size) AS "end", x AS value FROM agg WHERE pos % 20 = 0),
l AS (SELECT unnest(range({tracks.LEVELS})) AS level), w AS (SELECT level, {tracks.FIRST} * CAST(power({tracks.FACTOR}, level) AS BIGINT) AS width FROM l),
b AS (SELECT contig, level, width, value, start, "end", unnest(range(start // width, ("end" - 1) // width + 1)) AS bin FROM t, w),
p AS (SELECT *, least("end", (bin + 1) * width) - greatest(start, bin * width) AS n FROM b)
SELECT contig, CAST(level AS INT) AS level, bin * width AS start, (bin + 1) * width AS "end", CAST(sum(n) AS BIGINT) AS n, min(value) AS low, max(value) AS high, sum(value * n) AS total, sum(value * value * n) AS squares FROM p GROUP BY contig, level, width, bin"""
)
def track_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of several widths of the track of window sums."""
    rows = sums(spark, sf_dir).where(F.col("pos") % 20 == 0)
    return tracks.zoomed(rows.select("contig", F.col("pos").alias("start"), F.least(F.col("pos") + 20, F.col("size")).alias("end"), F.col("x").alias("value")))


@query(f"WITH {BASE} SELECT contig, round(quantile_cont(x, 0.995), 6) AS quantile FROM agg GROUP BY contig")
def quantile_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(background.quantile_linear(sums(spark, sf_dir), 0.995), "quantile")


def _strided(window: int, name: str) -> str:
    """Samples go to the numbers of the centres around them, so that the join is by equality."""
    half = (window // STEP | 1) // 2 * STEP
    return f"""{name} AS (
  SELECT contig, centre, list_sort(list(x))[CAST(ceil(round(0.9 * (count(*) - 1), 9)) AS BIGINT) + 1] AS value
  FROM (SELECT contig, size, pos, x, unnest(range(greatest(CAST(ceil((pos - {half}) / {STRIDE}) AS BIGINT), 0), CAST(floor((pos + {half}) / {STRIDE}) AS BIGINT) + 1)) * {STRIDE} AS centre FROM agg WHERE pos % {STEP} = 0)
  WHERE centre < size GROUP BY contig, centre
)"""


@query(f"WITH {BASE}, {_strided(BG, 'q')} SELECT * FROM q")
def quantile_higher_strided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return background.strided_quantiles(sums(spark, sf_dir), F.lit(0.9), BG, STEP, STRIDE)


@query(
    f"""WITH {BASE}, {_strided(BG, 'q')}, {_strided(BG // 10, 'n')},
c AS (SELECT contig, centre, least(q.value, n.value) AS value FROM q JOIN n USING (contig, centre)),
s AS (SELECT *, lead(centre) OVER w AS next, lead(value) OVER w AS later FROM c WINDOW w AS (PARTITION BY contig ORDER BY centre))
SELECT d.contig, d.pos, round(CASE WHEN next IS NULL THEN value ELSE value + (later - value) * ((d.pos - centre) / (next - centre)) END, 6) AS threshold
FROM dense d JOIN s ON s.contig = d.contig AND s.centre = d.pos // {STRIDE} * {STRIDE}"""
)
def interp_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = background.local_thresholds(sums(spark, sf_dir), F.lit(0.9), adapters.contigs(spark, sf_dir), window=BG, small=BG // 10, step=STEP, stride=STRIDE)
    return rounded(found, "threshold")


@query(
    f"""WITH {BASE}, q AS (SELECT contig, quantile_cont(x, 0.6) AS lo, quantile_cont(x, 0.995) AS hi FROM agg GROUP BY contig),
k AS (SELECT *, CAST(round_even(least(lo, 20), 0) AS INT) AS k, CAST(round_even(least(hi - lo, 100), 0) AS INT) AS m FROM q),
e AS (
  SELECT contig, list_concat(list_transform(range(k), lambda i: round_even(lo * i / k, 0)), list_transform(range(m + 1), lambda i: CASE WHEN i = 0 THEN lo ELSE round_even(lo + (hi - lo) * i / m, 0) END)) AS edges FROM k
), b AS (SELECT contig, edges, unnest(range(len(edges) - 1)) AS bin FROM e)
SELECT b.contig, CAST(bin AS INT) AS bin, round(edges[bin + 1], 6) AS lo, round(edges[bin + 2], 6) AS hi, count(x) AS n
FROM b LEFT JOIN agg ON agg.contig = b.contig AND x >= edges[bin + 1] AND x < edges[bin + 2] GROUP BY ALL"""
)
def bin_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(sums(spark, sf_dir), "sums")
    return rounded(background.bin_counts(rows, background.bin_edges(rows)), "lo", "hi")


@query(
    f"""WITH {BASE}, m AS (SELECT contig, avg(x) AS mean, var_samp(x) AS variance FROM agg GROUP BY contig), f AS (SELECT *, mean * mean / (variance - mean) AS r FROM m)
SELECT contig, round(mean, 6) AS mean, round(variance, 6) AS variance, round(CASE WHEN r > 0 THEN r END, 6) AS r, round(CASE WHEN r > 0 THEN mean / (mean + r) END, 6) AS p, coalesce(r > 0, false) AS valid FROM f"""
)
def nb_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(background.nb_moments(sums(spark, sf_dir)), "mean", "variance", "r", "p")


@query(
    f"""WITH {BASE}, t AS (SELECT contig, quantile_cont(x, 0.9) AS threshold FROM agg GROUP BY contig)
SELECT contig, round(count(*) FILTER (x < threshold) / count(*), 6) AS fit_quantile FROM agg JOIN t USING (contig) GROUP BY contig"""
)
def bg_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(sums(spark, sf_dir), "sums")
    found = background.background_quantile(rows, background.quantile_linear(rows, 0.9).withColumnRenamed("quantile", "threshold"))
    return rounded(found, "fit_quantile")


@query(
    f"""WITH {BASE}, t AS (SELECT contig, quantile_cont(x, 0.995) AS threshold, avg(x) * avg(x) / (var_samp(x) - avg(x)) AS r FROM agg GROUP BY contig),
c AS (
  SELECT a.contig, pos, a.x, r, CASE WHEN max(a.x) OVER (PARTITION BY a.contig ORDER BY pos ROWS BETWEEN {FLANK} PRECEDING AND {FLANK} FOLLOWING) >= threshold THEN NULL ELSE a.x END AS b FROM agg a JOIN t USING (contig)
), w AS (
  SELECT contig, pos, r, count(b) OVER v AS n, avg(b) OVER v AS mean, var_samp(b) OVER v AS variance FROM c WINDOW v AS (PARTITION BY contig ORDER BY pos ROWS BETWEEN {BG // 2} PRECEDING AND {BG // 2} FOLLOWING)
), f AS (SELECT *, n >= 100 AS enough_bg, CASE WHEN variance > mean THEN mean * mean / (variance - mean) ELSE r END AS own FROM w)
SELECT contig, pos, enough_bg, round(CASE WHEN enough_bg THEN own END, 3) AS sliding_r, round(CASE WHEN enough_bg THEN mean / (mean + own) END, 6) AS sliding_p FROM f"""
)
def sliding_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(sums(spark, sf_dir), "sums")
    limits = background.quantile_linear(rows, 0.995).withColumnRenamed("quantile", "threshold")
    fits = background.nb_moments(rows).select("contig", F.col("r").alias("fallback_r"))
    found = background.sliding_nb(rows.join(limits, "contig").join(fits, "contig"), window=BG, flank=FLANK)
    return found.select("contig", "pos", "enough_bg", F.round("sliding_r", 3).alias("sliding_r"), F.round("sliding_p", 6).alias("sliding_p"))


@query(
    f"""WITH {BASE}, h AS (SELECT contig, x AS value, count(*) AS n FROM agg GROUP BY ALL),
c AS (SELECT *, sum(value * n) OVER (PARTITION BY contig ORDER BY value) / sum(value * n) OVER (PARTITION BY contig) AS cdf FROM h),
t AS (SELECT contig, value AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY value) AS k FROM c WHERE cdf >= 0.5) WHERE k = 2)
SELECT contig, threshold, round(sum(n) FILTER (value < threshold) / sum(n), 6) AS fit_quantile, sum(n) FILTER (value < threshold) / sum(n) > 0.995 AS max_bg_reached FROM h JOIN t USING (contig) GROUP BY contig, threshold"""
)
def tag_cdf_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(sums(spark, sf_dir), "sums")
    found = background.tag_cdf_thresholds(rows, adapters.contigs(spark, sf_dir).select("contig", F.lit(0.5).alias("fraction")))
    return rounded(found, "fit_quantile")


@query(
    """WITH s AS (SELECT o_orderpriority AS grp, o_totalprice AS v, o_custkey AS w FROM orders WHERE o_custkey > 0), c AS (SELECT grp, v, sum(w) OVER (PARTITION BY grp ORDER BY v) AS cum, sum(w) OVER (PARTITION BY grp) AS whole FROM s)
SELECT grp, min(v) AS weighted_median FROM c WHERE cum >= whole / 2 GROUP BY grp"""
)
def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_custkey > 0").withColumnRenamed("o_orderpriority", "grp")
    return regression.weighted_median(rows, "o_totalprice", "o_custkey", ("grp",))


@query(
    f"""WITH {BASE}, t AS (SELECT contig, quantile_cont(x, 0.9) AS tr FROM agg GROUP BY contig)
SELECT contig, round(1 - sum(CASE WHEN x < tr THEN x ELSE 0 END) / sum(x), 6) AS spot FROM agg JOIN t USING (contig) GROUP BY contig"""
)
def spot_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(sums(spark, sf_dir), "sums")
    joined = rows.join(background.quantile_linear(rows, 0.9), "contig")
    tags = joined.groupBy("contig").agg(F.sum(F.when(F.col("x") < F.col("quantile"), F.col("x")).otherwise(0)).alias("bg"), F.sum("x").alias("all"))
    return tags.select("contig", F.round(regression.spot_score(F.col("bg"), F.col("all")), 6).alias("spot"))


PMF = "exp(lgamma(k + 5.0) - lgamma(k + 1) - lgamma(5.0) + 5.0 * ln(0.5) + k * ln(0.5))"


@query(
    """WITH v AS (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS x, round(0.5 + 40 * l_discount, 1) AS r, round(0.05 + 10 * l_tax, 2) AS p FROM lineitem)
SELECT x, r, p, round(-log10((SELECT sum(exp(lgamma(k + r) - lgamma(k + 1) - lgamma(r) + r * ln(1 - p) + k * ln(p))) FROM (SELECT unnest(range(x, x + 800)) AS k))), 6) + 0.0 AS neglog10_p FROM v"""
)
def nb_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    values = lines.select(F.col("l_quantity").cast("long").alias("x"), F.round(0.5 + 40 * F.col("l_discount"), 1).alias("r"), F.round(0.05 + 10 * F.col("l_tax"), 2).alias("p")).distinct()
    return values.withColumn("neglog10_p", F.round(special.neglog10_tail(F.col("x"), F.col("r"), F.col("p")), 6))


@query(
    f"""WITH {BASE}, m AS (SELECT contig, avg(x) AS mean, var_samp(x) AS variance FROM dense GROUP BY contig), f AS (SELECT contig, mean * mean / (variance - mean) AS r, mean / (mean + mean * mean / (variance - mean)) AS p FROM m WHERE variance > mean),
k AS (SELECT contig, unnest(range(0, 3000)) AS k, r, p FROM f), c AS (SELECT contig, k, sum(exp(lgamma(k + r) - lgamma(k + 1) - lgamma(r) + r * ln(1 - p) + k * ln(p))) OVER (PARTITION BY contig ORDER BY k) AS cdf FROM k)
SELECT contig, CAST(q AS DOUBLE) AS q, CAST(min(k) AS DOUBLE) AS x FROM c, (SELECT unnest([0.005, 0.05, 0.2]) AS q) WHERE 1 - cdf <= q GROUP BY contig, q"""
)
def nb_isf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper quantiles of the distribution that each contig's counts have by their moments."""
    fits = background.nb_moments(counts(spark, sf_dir)).where("valid").select("contig", "r", "p")
    rows = [fits.select("contig", F.lit(q).alias("q"), special.isf(q, F.col("r"), F.col("p")).alias("x")) for q in (0.005, 0.05, 0.2)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(f"WITH {BASE}, {RUNS.format(name='runs', source='(SELECT contig, pos FROM agg WHERE x >= ' + str(LEVEL) + ')')} SELECT runs.contig, start, \"end\", row_number() OVER (ORDER BY ord DESC, start) - 1 AS place FROM runs JOIN sizes USING (contig)")
def merged_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all contigs one after another, as a catalogue from last to first has them; the place is that of the row in the result."""
    contigs = adapters.contigs(spark, sf_dir)
    runs = islands.islands(sums(spark, sf_dir).where(F.col("x") >= LEVEL))
    ordered = dense.merged(runs, contigs.withColumn("ord", -F.col("ord")), "start")
    return dense.placed(ordered)


def _bh(family: str, harmonic: str, cutoff: float) -> str:
    return f"""WITH {SCORED}, t AS (SELECT {family}, contig, pos, s FROM scored),
c AS (SELECT *, count(*) OVER (ORDER BY s DESC RANGE UNBOUNDED PRECEDING) AS k, (SELECT count(*) FROM t) AS m FROM t WHERE s >= {-math.log10(cutoff)!r}),
q AS (SELECT *, s - log10(m) + log10(k) - {harmonic} AS q FROM c)
SELECT contig, pos, round(s, 6) AS neglog10_p, round(greatest(max(q) OVER (ORDER BY s RANGE UNBOUNDED PRECEDING), 0), 6) AS neglog10_q FROM q"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sums(spark, sf_dir).select("contig", "pos", (F.col("x") / 500).alias("neglog10_p"))


@query(_bh("0 AS f", "0", 1e-5))
def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fdr.fdr(_scores(spark, sf_dir), 1e-5).where("neglog10_q IS NOT NULL"), "neglog10_p", "neglog10_q").select("contig", "pos", "neglog10_p", "neglog10_q")


@query(_bh("0 AS f", "log10((SELECT sum(1 / i) FROM (SELECT unnest(range(1, (SELECT count(*) FROM c) + 1)) AS i)))", 1e-5))
def by_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fdr.fdr(_scores(spark, sf_dir), 1e-5, "by").where("neglog10_q IS NOT NULL"), "neglog10_p", "neglog10_q").select("contig", "pos", "neglog10_p", "neglog10_q")


@query(
    f"""WITH {SCORED}, t AS (SELECT 'one' AS sample_id, contig, pos, s FROM scored UNION ALL SELECT 'two', contig, pos, s * 0.9 FROM scored),
c AS (SELECT *, count(*) OVER (ORDER BY s DESC RANGE UNBOUNDED PRECEDING) AS k, (SELECT count(*) FROM t) AS m FROM t WHERE s >= 5.0),
q AS (SELECT *, s - log10(m) + log10(k) AS q FROM c)
SELECT sample_id, contig, pos, round(greatest(max(q) OVER (ORDER BY s RANGE UNBOUNDED PRECEDING), 0), 6) AS neglog10_q FROM q"""
)
def bh_multi_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _scores(spark, sf_dir)
    both = one.withColumn("sample_id", F.lit("one")).unionByName(one.withColumns({"sample_id": F.lit("two"), "neglog10_p": F.col("neglog10_p") * 0.9}))
    return rounded(multi_sample_fdr(both, 1e-5).where("neglog10_q IS NOT NULL").select("sample_id", "contig", "pos", "neglog10_q"), "neglog10_q")


@query(f"WITH {BASE}, {INSIDE.format(level=LEVEL, least=10)} SELECT * FROM inside")
def dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.dilate(sums(spark, sf_dir), F.col("x") >= LEVEL, WINDOW, 10).where("inside").select("contig", "pos")


@query(f"WITH {SCORED}, {RUNS.format(name='runs', source='significant')} SELECT * FROM runs")
def find_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.islands(sums(spark, sf_dir).where(F.col("x") >= LEVEL))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.regions(stored(sums(spark, sf_dir), "sums"), "x", LEVEL, WINDOW)


@query(f"WITH {REGIONS} SELECT contig, start, \"end\", max_score, n_significant FROM regions")
def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regions(spark, sf_dir).drop("stretches")


@query(
    f"""WITH {REGIONS} SELECT contig AS chrom, start, "end", 's1' AS id, CAST(least(greatest(round_even(max_score * 10, 0), 0), 1000) AS BIGINT) AS score, '.' AS strand, start AS "thickStart", "end" AS "thickEnd",
'{export.colour(0.05, export.REGION_COLOURS)}' AS "itemRgb", CAST(len(starts) + 2 AS INT) AS "blockCount", '1,' || array_to_string(lengths, ',') || ',1' AS "blockSizes",
'0,' || array_to_string(starts, ',') || ',' || ("end" - start - 1) AS "blockStarts" FROM regions"""
)
def regions_bed12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.regions_bed12(_regions(spark, sf_dir), "s1", 0.05)


@query(f"WITH {BASE}, {SMOOTH}, {EXTREMA} SELECT contig, pos, kind FROM extrema")
def extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.extrema(stored(wave(spark, sf_dir), "wave"))


def _tops(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = stored(wave(spark, sf_dir), "wave")
    spans = islands.islands(islands.dilate(sums(spark, sf_dir), F.col("x") >= LEVEL, WINDOW, 10).where("inside"))
    return peaks.inside(peaks.summits(rows, adapters.contigs(spark, sf_dir)), spans), rows


@query(f"WITH {BASE}, {PEAKS} SELECT contig, start, \"end\", summit, round(height, 6) AS height, round(cutoff, 6) AS cutoff FROM trimmed")
def trimmed_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(peaks.trimmed(*_tops(spark, sf_dir)), "height", "cutoff")


def _peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tops, rows = _tops(spark, sf_dir)
    heights = dense.normalized_density(rows, dense.total_cuts(adapters.cuts(spark, sf_dir)))
    return peaks.peaks(tops, heights, adapters.contigs(spark, sf_dir), dense.total_cuts(adapters.cuts(spark, sf_dir)))


@query(f"WITH {BASE}, {PEAKS} SELECT contig, start, \"end\", summit, round(summit_density, 6) AS summit_density, round(max_density, 6) AS max_density, round(smoothed_peak_height, 6) AS smoothed_peak_height FROM peaks")
def peak_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_peaks(spark, sf_dir), "summit_density", "max_density", "smoothed_peak_height")


@query(
    f"""WITH {BASE}, {PEAKS} SELECT contig AS chrom, start, "end", 's1' AS id, CAST(least(greatest(round_even(max_density * 100, 0), 0), 1000) AS BIGINT) AS score, '.' AS strand, summit AS "thickStart", summit + 1 AS "thickEnd",
'{export.colour(0.01, export.PEAK_COLOURS)}' AS "itemRgb", 3 AS "blockCount", '1,1,1' AS "blockSizes", '0,' || (summit - start) || ',' || ("end" - start - 1) AS "blockStarts" FROM peaks"""
)
def peaks_bed12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.peaks_bed12(_peaks(spark, sf_dir), "s1", 0.01)


def _spans(line: str, spans: str) -> str:
    return f"""WITH {SCORED}, i AS (SELECT row_number() OVER () AS k, {line} FROM {spans})
SELECT i.contig, i.start, i."end", round(greatest(coalesce(max(s), 0), 0), 6) AS max_neglog_p FROM i LEFT JOIN scored ON scored.contig = i.contig AND pos >= i.start AND pos < i."end" GROUP BY i.k, i.contig, i.start, i."end\""""


@query(_spans('l_returnflag || l_linestatus AS contig, l_orderkey AS start, l_orderkey + CAST(l_quantity AS BIGINT) AS "end"', "lineitem"))
def interval_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of short intervals, one for each line."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    spans = lines.select(F.concat("l_returnflag", "l_linestatus").alias("contig"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + F.col("l_quantity").cast("long")).alias("end"))
    return rounded(islands.interval_max(spans, _scores(spark, sf_dir)), "max_neglog_p")


@query(_spans("""'A' || o_orderstatus AS contig, o_orderkey AS start, o_orderkey + o_custkey AS "end\"""", "orders"))
def interval_max_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of long intervals that overlap, some on a contig that is not there."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    spans = orders.select(F.concat(F.lit("A"), "o_orderstatus").alias("contig"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + F.col("o_custkey")).alias("end"))
    return rounded(islands.interval_max(spans, _scores(spark, sf_dir)), "max_neglog_p")


NARROW, FIT_STEP, FIT_BINS = 5, 5, (8, 12)
#: The incomplete beta function I_p(a, r), by a series of positive terms.
TAIL = "CASE WHEN {a} <= 0 THEN 1 ELSE (SELECT sum(exp({a} * ln(p) + r * ln(1 - p) + j * ln(p) + lgamma({a} + r + j) - lgamma(r) - lgamma({a} + 1 + j))) FROM (SELECT unnest(range(0, 4000)) AS j)) END"


@query(
    f"""WITH RECURSIVE {BASE},
narrow AS MATERIALIZED (SELECT contig, pos, CAST(sum(x) OVER (PARTITION BY contig ORDER BY pos ROWS BETWEEN {NARROW // 2} PRECEDING AND {NARROW // 2} FOLLOWING) AS DOUBLE) AS x FROM dense),
s AS MATERIALIZED (SELECT contig, x FROM narrow WHERE pos % {FIT_STEP} = 0),
q AS (SELECT contig, quantile_cont(x, 0.6) AS lo, quantile_cont(x, 0.995) AS hi FROM s GROUP BY contig),
k AS (SELECT *, CAST(round_even(least(lo, {FIT_BINS[0]}), 0) AS INT) AS k, greatest(1, CAST(round_even(least(hi - lo, {FIT_BINS[1]}), 0) AS INT)) AS m FROM q),
e AS (
  SELECT *, list_concat(list_transform(range(k), lambda i: round_even(lo * i / k, 0)), list_transform(range(m + 1), lambda i: CASE WHEN i = 0 THEN lo ELSE round_even(lo + (hi - lo) * i / m, 0) END)) AS edges FROM k
), b AS MATERIALIZED (
  SELECT e.contig, lo AS q_low, m, i, k + m AS last, edges[i] AS a, edges[i + 1] AS z, count(s.x) AS n
  FROM (SELECT *, unnest(range(1, k + m + 1)) AS i FROM e) e LEFT JOIN s ON s.contig = e.contig AND s.x >= edges[i] AND s.x < edges[i + 1] GROUP BY ALL
), merging(contig, i, a, n, carry) AS (
  SELECT contig, i, CASE WHEN n < 5 THEN z ELSE a END, CASE WHEN n < 5 THEN 0 ELSE n END, CASE WHEN n < 5 THEN n ELSE 0 END FROM b WHERE i = last
  UNION ALL
  SELECT b.contig, b.i, CASE WHEN b.n + g.carry < 5 THEN g.a ELSE b.a END, CASE WHEN b.n + g.carry < 5 THEN 0 ELSE b.n + g.carry END, CASE WHEN b.n + g.carry < 5 THEN b.n + g.carry ELSE 0 END
  FROM merging g JOIN b ON b.contig = g.contig AND b.i = g.i - 1 AND b.i > last - m
), bins AS MATERIALIZED (
  SELECT *, coalesce(lead(a) OVER (PARTITION BY contig ORDER BY i), final) AS z FROM (
    SELECT b.contig, b.i, b.q_low, b.m, b.last, coalesce(g.a, b.a) AS a, coalesce(g.n, b.n + coalesce(up.carry, 0)) AS n, max(b.z) OVER (PARTITION BY b.contig) AS final
    FROM b LEFT JOIN merging g ON g.contig = b.contig AND g.i = b.i LEFT JOIN merging up ON up.contig = b.contig AND up.i = b.i + 1 AND b.i = b.last - b.m
  )
), candidates AS (
  SELECT DISTINCT contig, tr FROM (SELECT contig, q_low, a AS tr FROM bins WHERE i > last - m + 1 UNION ALL SELECT contig, q_low, final FROM bins) WHERE tr > q_low
), moments AS (
  SELECT c.contig, tr, avg(x) AS mean, var_samp(x) AS variance, count(*) AS below FROM candidates c JOIN s ON s.contig = c.contig AND s.x < tr GROUP BY ALL
), fits AS MATERIALIZED (
  SELECT contig, tr, below, mean * mean / (variance - mean) AS r, mean / (mean + mean * mean / (variance - mean)) AS p FROM moments WHERE variance > mean
), tails AS MATERIALIZED (
  SELECT contig, tr, r, p, edge, {TAIL.format(a="edge")} AS tail FROM (SELECT DISTINCT f.contig, tr, r, p, edge FROM fits f JOIN (SELECT contig, a AS edge FROM bins UNION SELECT contig, final FROM bins) USING (contig))
), errors AS (
  SELECT f.contig, f.tr, f.r, f.p, f.below, sum(CASE WHEN z <= f.tr THEN n ELSE 0 END) AS total, count(*) FILTER (z <> a) - 3 AS freedom,
         2 * sum(CASE WHEN z <= f.tr AND n > 0 AND u.tail > v.tail THEN n * ln(n * (1 - w.tail) / (u.tail - v.tail)) ELSE 0 END) AS g0, sum(CASE WHEN z <= f.tr AND n > 0 AND u.tail > v.tail THEN n ELSE 0 END) AS used
  FROM fits f JOIN bins USING (contig) JOIN tails u ON u.contig = f.contig AND u.tr = f.tr AND u.edge = a JOIN tails v ON v.contig = f.contig AND v.tr = f.tr AND v.edge = z
  JOIN tails w ON w.contig = f.contig AND w.tr = f.tr AND w.edge = final GROUP BY ALL
), scored AS (
  SELECT *, sqrt(greatest((g0 - 2 * used * ln(total)) / freedom - 1, 0) / (total - 1)) AS rmsea FROM errors WHERE total >= 2 AND freedom >= 1
), best AS (
  SELECT contig, arg_min(struct_pack(tr, r, p, rmsea, below), struct_pack(rmsea, tr)) AS b FROM scored GROUP BY contig
)
SELECT contig, round(b.r, 4) AS r, round(b.p, 6) AS p, round(b.rmsea, 6) AS rmsea, b.tr AS threshold, round(b.below / (SELECT count(*) FROM s WHERE s.contig = best.contig), 6) AS fit_quantile,
       count(*) AS n_total, count(*) FILTER (x >= b.tr) AS n_signal, CAST(coalesce(sum(x) FILTER (x >= b.tr), 0) AS BIGINT) AS signal_tags, CAST(sum(x) AS BIGINT) AS total_tags, true AS success
FROM best JOIN narrow USING (contig) GROUP BY contig, b"""
)
def global_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold scan of each contig, over narrow windows."""
    rows = stored(windows.running(counts(spark, sf_dir), NARROW, "sum").select("contig", "pos", F.col("agg").alias("x")), "narrow")
    fits = background.fit_groups(rows, step=FIT_STEP, background_bins=FIT_BINS[0], signal_bins=FIT_BINS[1])
    return fits.withColumns({"r": F.round("r", 4), "p": F.round("p", 6), "rmsea": F.round("rmsea", 6), "fit_quantile": F.round("fit_quantile", 6)})


@query()
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(sums(spark, sf_dir), "sums")
    fits = background.fit_groups(rows, step=5)
    limits = rows.select("contig", "pos").join(background.quantile_linear(rows, 0.995).withColumnRenamed("quantile", "threshold"), "contig")
    return segment.segments(rows, fits, limits, step=25, penalty=20, least=BG)


#: For contigs as short as the driver's.
SMALL = Config(bg_window=BG, bg_window_small=BG // 10, fit_step=100, exclude_flank=FLANK, sample_step=STEP, interpolation_step=STRIDE, min_segment=BG, segment_step=25, max_fdr=0.5)


def caller(spark: SparkSession, sf_dir: str, reuse: dict[str, str] | None = None) -> Caller:
    return Caller(adapters.cuts(spark, sf_dir), adapters.contigs(spark, sf_dir), folder(spark, "caller"), config=SMALL, reuse=reuse)


def with_scores(spark: SparkSession, sf_dir: str) -> Caller:
    """A calculation that goes on from stored p-values, which SQL can make as well: scores of window sums."""
    path = folder(spark, "pvalues")
    sums(spark, sf_dir).select("contig", "pos", (F.greatest(F.col("x") - 3000, F.lit(0.0)) / 100).alias("neglog10_p")).write.partitionBy("contig").parquet(path)
    return caller(spark, sf_dir, {"pvalues": path})


RATE = 0.1
MARKS = f"""scored AS (SELECT contig, size, pos, greatest(x - 3000, 0) / 100 AS s FROM agg),
c AS (SELECT *, count(*) OVER (ORDER BY s DESC RANGE UNBOUNDED PRECEDING) AS k, (SELECT count(*) FROM scored) AS m FROM scored WHERE s >= {-math.log10(SMALL.max_fdr)!r}),
q AS (SELECT contig, pos, s, s - log10(m) + log10(k) AS q FROM c),
rates AS (SELECT contig, pos, greatest(max(q) OVER (ORDER BY s RANGE UNBOUNDED PRECEDING), 0) AS rate FROM q),
marks AS MATERIALIZED (SELECT contig, pos, rate, coalesce(rate >= {-math.log10(RATE)!r}, false) AS hit FROM agg LEFT JOIN rates USING (contig, pos))"""
INSIDE_MARKS = """inside AS (
  SELECT contig, pos FROM (SELECT contig, pos, sum(CAST(hit AS INT)) OVER (PARTITION BY contig ORDER BY pos ROWS BETWEEN 75 PRECEDING AND 75 FOLLOWING) AS k FROM marks) WHERE k >= {least}
)"""


@query(
    f"""WITH {BASE}, {MARKS}, {INSIDE_MARKS.format(least=1)}, {RUNS.format(name="spans", source="inside")}
SELECT s.contig, s.start, s."end", 'sample' AS id, round(max(rate), 6) AS max_neglog10_fdr, count(*) AS n_significant
FROM spans s JOIN marks ON marks.contig = s.contig AND pos >= s.start AND pos < s."end" AND hit GROUP BY ALL"""
)
def call_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of a calculation that goes on from stored p-values."""
    return rounded(with_scores(spark, sf_dir).regions(RATE).drop("stretches"), "max_neglog10_fdr")


@query(
    f"""WITH {BASE}, {MARKS}, {INSIDE_MARKS.format(least=10)}, {RUNS.format(name="spans", source="inside")}, {SMOOTH_OF.format(source="agg")}, {CALLED.replace("FROM wide p JOIN wave w", "FROM wide p JOIN agg w")}
SELECT contig, start, "end", summit, 'sample' AS id, round(summit_density, 6) AS summit_density, round(max_density, 6) AS max_density, round(smoothed_peak_height, 6) AS smoothed_peak_height FROM peaks"""
)
def call_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of a calculation that goes on from stored p-values."""
    return rounded(with_scores(spark, sf_dir).peaks(RATE), "summit_density", "max_density", "smoothed_peak_height")


#: The whole calculation from stored segments: narrow windows and few bins, so that SQL can follow; outliers stay, as the robust line draws at random.
CHAIN = Config(window=NARROW, bg_window=BG, fit_step=60, exclude_flank=FLANK, background_bins=FIT_BINS[0], signal_bins=FIT_BINS[1], max_outlier_rounds=0, max_fdr=0.5)
PARTS, CHAIN_RATE = 3, 0.05
#: Counts here are of no signal; every EVERY positions some are raised, so that there is one.
EVERY, RAISED, TIMES = 700, 30, 6


def from_segments(spark: SparkSession, sf_dir: str) -> Caller:
    """A calculation with each contig in ``PARTS`` stored segments of equal lengths."""
    contigs, path = adapters.contigs(spark, sf_dir), folder(spark, "segments")
    cut = lambda k: F.floor(k * F.col("size") / PARTS)
    parts = contigs.withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    parts.select("contig", "segment", cut(F.col("segment")).alias("start"), cut(F.col("segment") + 1).alias("end"), F.lit(1.0).alias("state")).write.partitionBy("contig").parquet(path)
    cuts = adapters.cuts(spark, sf_dir).withColumn("cnt", F.when(F.col("pos") % EVERY < RAISED, F.col("cnt") * TIMES).otherwise(F.col("cnt")))
    return Caller(cuts, contigs, folder(spark, "caller"), config=CHAIN, reuse={"segments": path})


def scan_sql(n: str, source: str) -> str:
    """Tables with prefix ``n`` for the threshold scan of the groups of ``source`` (g, x, top); ``{n}fit`` (g, r, p, rmsea, tr, quantile) has the fits."""
    return f"""{n}q AS (
  SELECT g, lo, CASE WHEN hi > lo THEN hi ELSE lo + 1 END AS hi
  FROM (SELECT g, quantile_cont(x, 0.6) AS lo, greatest(quantile_cont(x, 0.995), coalesce(any_value(top), 0)) AS hi FROM {source} WHERE coalesce(top, 0) < 'infinity'::DOUBLE GROUP BY g)
), {n}k AS (SELECT *, CAST(round_even(least(lo, {FIT_BINS[0]}), 0) AS INT) AS k, greatest(1, CAST(round_even(least(hi - lo, {FIT_BINS[1]}), 0) AS INT)) AS m FROM {n}q),
{n}e AS (
  SELECT *, list_concat(list_transform(range(k), lambda i: round_even(lo * i / k, 0)), list_transform(range(m + 1), lambda i: CASE WHEN i = 0 THEN lo ELSE round_even(lo + (hi - lo) * i / m, 0) END)) AS edges FROM {n}k
), {n}b AS MATERIALIZED (
  SELECT e.g, lo AS q_low, m, i, k + m AS last, edges[i] AS a, edges[i + 1] AS z, count(s.x) AS n
  FROM (SELECT *, unnest(range(1, k + m + 1)) AS i FROM {n}e) e LEFT JOIN {source} s ON s.g = e.g AND s.x >= edges[i] AND s.x < edges[i + 1] GROUP BY ALL
), {n}merging(g, i, a, n, carry) AS (
  SELECT g, i, CASE WHEN n < 5 THEN z ELSE a END, CASE WHEN n < 5 THEN 0 ELSE n END, CASE WHEN n < 5 THEN n ELSE 0 END FROM {n}b WHERE i = last
  UNION ALL
  SELECT b.g, b.i, CASE WHEN b.n + u.carry < 5 THEN u.a ELSE b.a END, CASE WHEN b.n + u.carry < 5 THEN 0 ELSE b.n + u.carry END, CASE WHEN b.n + u.carry < 5 THEN b.n + u.carry ELSE 0 END
  FROM {n}merging u JOIN {n}b b ON b.g = u.g AND b.i = u.i - 1 AND b.i > last - m
), {n}bins AS MATERIALIZED (
  SELECT *, coalesce(lead(a) OVER (PARTITION BY g ORDER BY i), final) AS z FROM (
    SELECT b.g, b.i, b.q_low, b.m, b.last, coalesce(u.a, b.a) AS a, coalesce(u.n, b.n + coalesce(up.carry, 0)) AS n, max(b.z) OVER (PARTITION BY b.g) AS final
    FROM {n}b b LEFT JOIN {n}merging u ON u.g = b.g AND u.i = b.i LEFT JOIN {n}merging up ON up.g = b.g AND up.i = b.i + 1 AND b.i = b.last - b.m
  )
), {n}candidates AS (
  SELECT DISTINCT g, tr FROM (SELECT g, q_low, a AS tr FROM {n}bins WHERE i > last - m + 1 UNION ALL SELECT g, q_low, final FROM {n}bins) WHERE tr > q_low
), {n}moments AS (
  SELECT c.g, tr, avg(x) AS mean, var_samp(x) AS variance, count(*) AS below FROM {n}candidates c JOIN {source} s ON s.g = c.g AND s.x < tr GROUP BY ALL
), {n}fits AS MATERIALIZED (
  SELECT g, tr, below, mean * mean / (variance - mean) AS r, mean / (mean + mean * mean / (variance - mean)) AS p FROM {n}moments WHERE variance > mean
), {n}tails AS MATERIALIZED (
  SELECT g, tr, r, p, edge, {TAIL.format(a="edge")} AS tail FROM (SELECT DISTINCT f.g, tr, r, p, edge FROM {n}fits f JOIN (SELECT g, a AS edge FROM {n}bins UNION SELECT g, final FROM {n}bins) USING (g))
), {n}errors AS (
  SELECT f.g, f.tr, f.r, f.p, f.below, sum(CASE WHEN z <= f.tr THEN n ELSE 0 END) AS total, count(*) FILTER (z <> a) - 3 AS freedom,
         2 * sum(CASE WHEN z <= f.tr AND n > 0 AND u.tail > v.tail THEN n * ln(n * (1 - w.tail) / (u.tail - v.tail)) ELSE 0 END) AS g0, sum(CASE WHEN z <= f.tr AND n > 0 AND u.tail > v.tail THEN n ELSE 0 END) AS used
  FROM {n}fits f JOIN {n}bins b USING (g) JOIN {n}tails u ON u.g = f.g AND u.tr = f.tr AND u.edge = a JOIN {n}tails v ON v.g = f.g AND v.tr = f.tr AND v.edge = z
  JOIN {n}tails w ON w.g = f.g AND w.tr = f.tr AND w.edge = final GROUP BY ALL
), {n}best AS (
  SELECT g, arg_min(struct_pack(tr, r, p, rmsea, below), struct_pack(rmsea, tr)) AS b
  FROM (SELECT *, sqrt(greatest((g0 - 2 * used * ln(total)) / freedom - 1, 0) / (total - 1)) AS rmsea FROM {n}errors WHERE total >= 2 AND freedom >= 1) GROUP BY g
), {n}fit AS MATERIALIZED (
  SELECT g, coalesce(b.r, r) AS r, coalesce(b.p, mean / (mean + r)) AS p, b.rmsea AS rmsea, coalesce(b.tr, 'infinity'::DOUBLE) AS tr, coalesce(b.below / n, 1.0) AS quantile
  FROM (SELECT *, CASE WHEN variance > mean AND mean > 0 THEN mean * mean / (variance - mean) END AS r FROM (SELECT g, avg(x) AS mean, var_samp(x) AS variance, count(*) AS n FROM {source} GROUP BY g)) LEFT JOIN {n}best USING (g)
  WHERE coalesce(b.r, r) IS NOT NULL
)"""


def _sums_of(fit: str, table: str, keys: str) -> str:
    """Counts of all positions of a group above and below its threshold."""
    return f"SELECT {keys}, count(*) AS bases, CAST(sum(x) AS BIGINT) AS tags, count(*) FILTER (x >= tr) AS n_signal, CAST(coalesce(sum(x) FILTER (x >= tr), 0) AS BIGINT) AS signal_tags FROM {table} LEFT JOIN {fit} USING (g) GROUP BY {keys}"


CHAINED = f"""{BASE.replace("coalesce(cnt, 0)", f"coalesce(CASE WHEN pos % {EVERY} < {RAISED} THEN cnt * {TIMES} ELSE cnt END, 0)")},
whole AS MATERIALIZED (SELECT contig AS g, contig, size, pos, CAST(sum(x) OVER (PARTITION BY contig ORDER BY pos ROWS BETWEEN {NARROW // 2} PRECEDING AND {NARROW // 2} FOLLOWING) AS DOUBLE) AS x FROM dense),
sample AS MATERIALIZED (SELECT g, x, CAST(NULL AS DOUBLE) AS top FROM whole WHERE pos % {CHAIN.fit_step} = 0),
{scan_sql("c_", "sample")},
parts AS (SELECT contig, size, CAST(k AS INT) AS segment, k * size // {PARTS} AS start, (k + 1) * size // {PARTS} AS "end", contig || ':' || k AS g FROM (SELECT *, unnest(range({PARTS})) AS k FROM sizes)),
held AS MATERIALIZED (SELECT p.g, p.contig, segment, start, "end", pos, x FROM whole w JOIN parts p ON p.contig = w.contig AND pos >= start AND pos < "end"),
steps AS (SELECT g, start, greatest(20, CAST(round_even({CHAIN.fit_step} / size * ("end" - start), 0) AS INT)) AS step FROM parts),
own AS MATERIALIZED (SELECT h.g, x, f.tr AS top FROM held h JOIN steps s ON s.g = h.g AND (pos - s.start) % step = 0 JOIN c_fit f ON f.g = h.contig),
{scan_sql("s_", "own")}"""
ISF = """(SELECT CAST(min(k) AS DOUBLE) FROM (
  SELECT k, sum(exp(lgamma(k + r) - lgamma(k + 1) - lgamma(r) + r * ln(1 - p) + k * ln(p))) OVER (ORDER BY k) AS cdf FROM (SELECT unnest(range(0, 6000)) AS k)) WHERE 1 - cdf <= 0.005)"""


@query(
    f"""WITH RECURSIVE {CHAINED}, c_sums AS ({_sums_of("c_fit", "whole", "g")}), s_sums AS ({_sums_of("s_fit", "held", "g")}),
rows AS (
  SELECT p.contig, segment, start, "end", 1.0 AS state, 'segment' AS fit_type, r, p, rmsea, tr, quantile, bases, tags, CASE WHEN r IS NOT NULL THEN n_signal END AS n_signal, CASE WHEN r IS NOT NULL THEN signal_tags END AS signal_tags,
         CASE WHEN r IS NOT NULL AND tags > 0 THEN greatest(least(1 - (tags - signal_tags) / tags, 1.0), 0.0) END AS spot
  FROM parts p JOIN s_sums USING (g) LEFT JOIN s_fit USING (g) WHERE p.contig IN (SELECT g FROM c_fit)
  UNION ALL SELECT g, -1, 0, size, 0.0, 'global', r, p, rmsea, tr, quantile, bases, tags, n_signal, signal_tags, NULL FROM c_fit JOIN c_sums USING (g) JOIN sizes ON sizes.contig = g
), reached AS (
  SELECT spot, sum(bases) OVER (ORDER BY spot) AS cum, sum(bases) OVER () AS everything FROM rows WHERE spot > 0 AND spot < 1
)
SELECT contig, CAST(segment AS INT) AS segment, start, "end", CAST(state AS DOUBLE) AS state, fit_type, round(r, 4) AS r, round(p, 6) AS p, round(rmsea, 6) AS rmsea, tr AS threshold, round(quantile, 6) AS fit_quantile,
       bases AS mappable_bases, tags AS mappable_tags, n_signal, signal_tags, tags - signal_tags AS bg_tags, bases - n_signal AS bg_bases, round((bases - n_signal) / bases, 6) AS bg_bases_prop, round(spot, 6) AS segment_spot,
       round((SELECT min(spot) FROM reached WHERE cum >= everything / 2), 6) AS spot, CASE WHEN r IS NOT NULL THEN {ISF} END AS background, r IS NOT NULL AS success_fit, r IS NOT NULL AND fit_type = 'segment' AS valid_segment
FROM rows"""
)
def fit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored segments and contigs with their fits, without what the robust line adds."""
    found = from_segments(spark, sf_dir).fit_stats
    named = found.select("contig", "segment", "start", "end", "state", "fit_type", F.round("r", 4).alias("r"), F.round("p", 6).alias("p"), F.round("rmsea", 6).alias("rmsea"), "threshold", F.round("fit_quantile", 6).alias("fit_quantile"), "mappable_bases", "mappable_tags", "n_signal", "signal_tags", "bg_tags", "bg_bases", F.col("segment_SPOT").alias("segment_spot"), F.col("SPOT").alias("spot"), "bg_bases_prop", "background", "success_fit", "valid_segment")
    return rounded(named, "bg_bases_prop", "segment_spot", "spot")


SLID = f"""tops AS (
  SELECT h.*, r AS own_r, CASE WHEN max(x) OVER (PARTITION BY h.g ORDER BY pos ROWS BETWEEN {FLANK} PRECEDING AND {FLANK} FOLLOWING) >= tr THEN NULL ELSE x END AS b FROM held h JOIN s_fit USING (g)
), wide AS (
  SELECT g, contig, pos, x, own_r, count(b) OVER v AS n, avg(b) OVER v AS mean, var_samp(b) OVER v AS variance FROM tops WINDOW v AS (PARTITION BY g ORDER BY pos ROWS BETWEEN {BG // 2} PRECEDING AND {BG // 2} FOLLOWING)
), slid AS MATERIALIZED (
  SELECT g, contig, pos, x, n >= {max(1, round(BG * CHAIN.min_mappable_proportion))} AS enough_bg, r, mean / (mean + r) AS p FROM (SELECT *, CASE WHEN variance > mean THEN mean * mean / (variance - mean) ELSE own_r END AS r FROM wide)
)"""
#: Terms until what follows is nothing beside the sum.
TESTED = f"""tested AS MATERIALIZED (SELECT contig, pos, -log10({TAIL.format(a="x").replace("4000", "CAST(200 + 20 / (1 - p) AS BIGINT)")}) AS s FROM slid WHERE enough_bg)"""


@query(
    f"""WITH RECURSIVE {CHAINED}, {SLID}, {TESTED},
c AS (SELECT *, count(*) OVER (ORDER BY s DESC RANGE UNBOUNDED PRECEDING) AS k, (SELECT count(*) FROM tested) AS m FROM tested WHERE s >= {-math.log10(CHAIN.max_fdr)!r}),
q AS (SELECT contig, pos, s, s - log10(m) + log10(k) AS q FROM c),
rates AS (SELECT contig, pos, greatest(max(q) OVER (ORDER BY s RANGE UNBOUNDED PRECEDING), 0) AS rate FROM q),
marks AS MATERIALIZED (SELECT w.contig, w.pos, rate, coalesce(rate >= {-math.log10(CHAIN_RATE)!r}, false) AS hit FROM whole w JOIN (SELECT DISTINCT contig FROM slid) USING (contig) LEFT JOIN rates USING (contig, pos)),
inside AS (
  SELECT contig, pos FROM (SELECT contig, pos, sum(CAST(hit AS INT)) OVER (PARTITION BY contig ORDER BY pos ROWS BETWEEN {NARROW // 2} PRECEDING AND {NARROW // 2} FOLLOWING) AS k FROM marks) WHERE k >= 1
), {RUNS.format(name="spans", source="inside")}
SELECT s.contig, s.start, s."end", 'sample' AS id, round(max(rate), 5) AS max_neglog10_fdr, count(*) AS n_significant
FROM spans s JOIN marks ON marks.contig = s.contig AND pos >= s.start AND pos < s."end" AND hit GROUP BY ALL"""
)
def call_all_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole calculation after segmentation: fits, sliding background, p-values, rates and regions."""
    return rounded(from_segments(spark, sf_dir).regions(CHAIN_RATE).drop("stretches"), "max_neglog10_fdr", digits=5)


#: What an event of each type stands for in a sample; a user's day is a sample.
GIVEN_BY = {"view": "cuts", "click": "smoothed", "purchase": "pvalues", "signup": "fdrs", "error": "total"}
OUTPUTS = ("calls", "density")
_values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in rows)


@query(
    f"""WITH RECURSIVE edges(step, needs) AS (VALUES {_values((s, x) for s in CALLING.made_of for x in CALLING.made_of[s])}), kinds(event_type, step) AS (VALUES {_values(GIVEN_BY.items())}),
ways(step, depth) AS (SELECT DISTINCT needs, 0 FROM edges WHERE needs NOT IN (SELECT step FROM edges) UNION SELECT e.step, depth + 1 FROM ways w JOIN edges e ON e.needs = w.step),
depths AS (SELECT step, max(depth) AS depth FROM ways GROUP BY step),
given AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, step FROM events JOIN kinds USING (event_type)),
wanted(user_id, day, step) AS (
  SELECT user_id, day, o.step FROM (SELECT DISTINCT user_id, day FROM given) s CROSS JOIN (VALUES {_values((o,) for o in OUTPUTS)}) o(step) WHERE (user_id, day, o.step) NOT IN (SELECT user_id, day, step FROM given)
  UNION SELECT w.user_id, w.day, e.needs FROM wanted w JOIN edges e ON e.step = w.step WHERE NOT EXISTS (SELECT 1 FROM given g WHERE g.user_id = w.user_id AND g.day = w.day AND g.step = e.needs)
)
SELECT user_id, CAST(day AS VARCHAR) AS day, step, CAST(row_number() OVER (PARTITION BY user_id, day ORDER BY depth, step) - 1 AS INT) AS place, count(*) FILTER (step = 'reads') OVER (PARTITION BY user_id, day) = 0 AS startable
FROM wanted JOIN depths USING (step)"""
)
def missing_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps that each sample still has to take, from what is there of it."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    name = F.element_at(F.create_map(*(F.lit(x) for pair in GIVEN_BY.items() for x in pair)), F.col("event_type"))
    samples = events.groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.collect_set(name).alias("given"))
    return CALLING.missing_of_each(samples, OUTPUTS).drop("given")


@query()
def fit_stats_from_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments and contigs with their fits, segments found and outliers refitted."""
    return caller(spark, sf_dir).fit_stats


@query()
def call_regions_from_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole calculation, from counts to regions."""
    return caller(spark, sf_dir).regions(0.5).drop("stretches")


@query(
    f"""WITH {BASE}, t AS (SELECT contig, quantile_cont(x, 0.995) AS tr FROM agg GROUP BY contig), significant AS (SELECT contig, pos FROM agg JOIN t USING (contig) WHERE x >= tr),
{RUNS.format(name='runs', source='significant')} SELECT r.contig, r.start, r."end", max(x) AS max_count FROM runs r JOIN agg a ON a.contig = r.contig AND a.pos >= r.start AND a.pos < r."end" GROUP BY ALL"""
)
def enriched_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: runs of positions whose window sums reach their contig's upper quantile."""
    rows = stored(sums(spark, sf_dir), "sums")
    hits = rows.join(background.quantile_linear(rows, 0.995), "contig").where("x >= quantile")
    spans = islands.islands(hits)
    best = islands.in_intervals(hits.select("contig", "pos", "x"), spans).groupBy("contig", "start", "end").agg(F.max("x").alias("max_count"))
    return best.select("contig", "start", "end", "max_count")
