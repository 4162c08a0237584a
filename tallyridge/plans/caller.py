"""The whole calculation, from counts to regions and peaks, as DataFrames that depend on one another."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyridge.functions.special import isf, neglog10_tail
from tallyridge.operators import background, dense, export, fdr, islands, peaks, regression, segment, wavelets, windows
from tallyridge.plans.steps import Steps
from tallyridge.sources import io
from tallyridge.sources.staged import Staged, check_settings


@dataclass(frozen=True)
class Config:
    """Parameters; the defaults suit genomes."""

    window: int = 151
    min_mappable_proportion: float = 0.05
    smooth_filter: str = "haar"
    smooth_level: int = 7
    bg_window: int = 50_001
    bg_window_small: int = 5_001
    min_background: float = 0.6
    max_background: float = 0.995
    fit_step: int = 1_500
    exclude_flank: int = 500
    sample_step: int = 75
    interpolation_step: int = 1_500
    background_bins: int = 20
    signal_bins: int = 100
    min_bin_count: int = 5
    min_segment: int = 50_001
    segment_step: int = 500
    boundary_penalty: float = 20.0
    outlier_threshold: float = 5.0
    max_outlier_rounds: int = 5
    fdr_method: str = "bh"
    max_fdr: float = 0.05
    min_significant_for_peak: int = 10
    min_peak_half_width: int = 10
    density_step: int = 20
    background_step: int = 100


#: Stages with what they are made of, and the settings that each adds to theirs.
STAGES = Steps(
    {
        "cuts": ("reads",), "total": ("cuts",), "vector": ("cuts",), "smoothed": ("vector", "total"), "global_fits": ("vector",), "thresholds": ("vector", "global_fits"),
        "segments": ("vector", "global_fits", "thresholds"), "segmented": ("vector", "segments"), "fit_stats": ("segmented", "segments", "global_fits"),
        "fit_params": ("segmented", "segments", "fit_stats"), "pvalues": ("fit_params",), "fdrs": ("pvalues",), "calls": ("fdrs", "smoothed", "total"),
    }
)
SETTINGS = {
    "vector": ("window", "min_mappable_proportion"), "smoothed": ("smooth_filter", "smooth_level"), "global_fits": ("min_background", "max_background", "fit_step", "background_bins", "signal_bins", "min_bin_count"),
    "thresholds": ("bg_window", "bg_window_small", "sample_step", "interpolation_step"), "segments": ("min_segment", "segment_step", "boundary_penalty"), "segmented": ("fit_step",),
    "fit_stats": ("outlier_threshold", "max_outlier_rounds"), "fit_params": ("bg_window", "exclude_flank", "min_mappable_proportion"), "fdrs": ("fdr_method", "max_fdr"),
}


class Caller:
    """Each property is a stage; intermediate tables go to ``root`` as Parquet, partitioned by contig.

    A stage that is given (``reuse``, by its path) is read, and what leads to it alone does not run; it must have been made with the same settings. Stages
    that an earlier run on ``root`` has finished, with the same settings, are read too, and what it has left of a stage is made contig by contig
    (``contigs_at_a_time`` a job; stages that pool contigs are one job). ``root`` belongs to one set of counts. Contigs without a fit or without observations are absent from what follows.
    """

    def __init__(
        self, cuts: DataFrame | None, contigs: DataFrame, root: str, *, config: Config = Config(), mappable: DataFrame | None = None, reuse: dict[str, str] | None = None, sample: str = "sample",
        reads: DataFrame | None = None, contigs_at_a_time: int | None = None,
    ):
        self.contigs, self.root, self.config, self.mappable, self.sample = contigs, root.rstrip("/"), config, mappable, sample
        self.given_cuts, self.reads, self.contigs_at_a_time = cuts, reads, contigs_at_a_time
        self.reuse = reuse or {}
        self.spark = contigs.sparkSession
        for name, path in self.reuse.items():
            check_settings(self.spark, path, self.settings(name))

    def plan(self, *outputs: str) -> list[str]:
        """The stages to run for ``outputs`` (what regions and peaks need, by default), in order."""
        given = {*self.reuse, *(["cuts"] if self.given_cuts is not None else []), *(["reads"] if self.reads is not None else [])}
        return STAGES.missing(outputs or ("calls",), given)

    def run(self, *outputs: str) -> list[str]:
        """Runs them, and returns their names."""
        steps = self.plan(*outputs)
        for step in steps:
            if step != "calls":
                getattr(self, step)
        return steps

    def settings(self, name: str) -> dict:
        """Those that a stage depends on, its own and those of what it is made of."""
        found = {k: v for x in STAGES.made_of.get(name, ()) for k, v in self.settings(x).items()}
        return found | {k: v for k, v in asdict(self.config).items() if k in SETTINGS.get(name, ())}

    @cached_property
    def names(self) -> list[str]:
        return [r["contig"] for r in self.contigs.select("contig", "ord").orderBy("ord").collect()]

    def kept(self, name: str, make, pooled: bool = False) -> DataFrame:
        if name in self.reuse:
            return self.spark.read.parquet(self.reuse[name])
        return Staged(self.spark, f"{self.root}/{name}", self.settings(name)).write(make, self.names, None if pooled else self.contigs_at_a_time)

    @cached_property
    def cuts(self) -> DataFrame:
        """Given, or counted from reads."""
        if self.given_cuts is None and self.reads is None:
            raise ValueError("give reads or cuts")
        return dense.reads_to_cuts(self.reads, self.contigs) if self.given_cuts is None else self.given_cuts

    @cached_property
    def total(self) -> DataFrame:
        dense.checked_total(self.cuts)
        return dense.total_cuts(self.cuts)

    @cached_property
    def vector(self) -> DataFrame:
        """Window sums of counts, null where not mappable; ``raw`` has them everywhere."""

        def make() -> DataFrame:
            c = self.config
            sums = windows.count_sums(self.cuts, self.contigs, c.window, c.min_mappable_proportion, self.mappable)
            inside = F.lit(True) if self.mappable is None else F.col("mappable")
            return sums.select("contig", "size", "pos", F.when(inside, F.col("agg")).alias("x"), F.col("agg").alias("raw"))

        return self.kept("vector", make)

    @cached_property
    def smoothed(self) -> DataFrame:
        """``(contig, size, pos, smoothed, density)``."""

        def make() -> DataFrame:
            rows = self.vector.select("contig", "size", "pos", F.coalesce("raw", F.lit(0.0)).alias("x"))
            wave = wavelets.wavelet_smooth(rows, self.config.smooth_filter, self.config.smooth_level)
            return dense.normalized_density(wave, self.total).select("contig", "size", "pos", "smoothed", "density")

        return self.kept("smoothed", make)

    def fits(self, vector: DataFrame, keys: tuple[str, ...], **more) -> DataFrame:
        c = self.config
        return background.fit_groups(vector, background_bins=c.background_bins, signal_bins=c.signal_bins, low=c.min_background, high=c.max_background, least=c.min_bin_count, keys=keys, **more)

    @cached_property
    def global_fits(self) -> DataFrame:
        return self.kept("global_fits", lambda: self.fits(self.vector, ("contig",), step=self.config.fit_step).where("success"))

    @cached_property
    def thresholds(self) -> DataFrame:
        """Local thresholds of each position of the contigs that have a fit; unmappable samples count."""

        def make() -> DataFrame:
            c = self.config
            rows = self.vector.select("contig", "size", "pos", F.col("raw").alias("x")).join(self.global_fits.select("contig", "fit_quantile"), "contig")
            return background.local_thresholds(rows, F.col("fit_quantile"), self.contigs, window=c.bg_window, small=c.bg_window_small, step=c.sample_step, stride=c.interpolation_step)

        return self.kept("thresholds", make)

    @cached_property
    def segments(self) -> DataFrame:
        c = self.config
        return self.kept("segments", lambda: segment.segments(self.vector, self.global_fits, self.thresholds, step=c.segment_step, penalty=c.boundary_penalty, least=c.min_segment))

    @cached_property
    def segmented(self) -> DataFrame:
        """The vector with the ``segment`` of each position, its ``start``, and its sampling step."""

        def make() -> DataFrame:
            # segments are few and long, and so are the bins that find them: the vector stays where it is
            placed = lambda segments: islands.in_intervals(self.vector, F.broadcast(segments), bin_size=1 << 16)
            known = self.segments.select("contig", "segment", "start", "end")
            mappable = placed(known.select("contig", "start", "end")).groupBy("contig").agg(F.count("x").alias("mappable"))
            step = segment.segment_step(F.col("end") - F.col("start"), F.col("mappable"), self.config.fit_step)
            return placed(known.join(mappable, "contig").withColumn("step", step).drop("mappable"))

        return self.kept("segmented", make)

    @cached_property
    def fit_stats(self) -> DataFrame:
        """A row per segment with its fit, after outliers were fitted anew with a least share of background tags, and one per contig.

        ``fit_type`` tells them apart: ``segment``, or ``global`` with segment -1 and state 0.
        """

        def make() -> DataFrame:
            c, keys = self.config, ("contig", "segment")
            sums = [F.count("x").alias("mappable_bases"), F.sum(F.floor(F.coalesce("x", F.lit(0.0)))).alias("mappable_tags")]
            bases = self.segmented.groupBy(*keys).agg(*sums)
            rows = self.with_fit(self.segments.join(bases, [*keys], "left"), self.segment_fits())
            columns = rows.columns
            rows = self.small(rows)
            for _ in range(c.max_outlier_rounds):
                marked, _line = regression.fit_signal_to_noise(rows.where("success_fit"), c.outlier_threshold)
                odd = self.small(marked.where(F.col("outlier_distance") >= c.outlier_threshold))
                if odd.isEmpty():
                    break
                again = self.refit(odd)
                rows = self.small(rows.join(odd.select(*keys), [*keys], "left_anti").unionByName(again.select(*columns)))
            marked, line = regression.fit_signal_to_noise(rows.where("success_fit"), c.outlier_threshold)
            extra = ["segment_SPOT", "outlier_distance", "is_inlier", "min_bg_tag_proportion"]
            number = lambda x: F.lit(x).cast("double")
            out = rows.join(marked.select(*keys, *extra), [*keys], "left").withColumn("fit_type", F.lit("segment"))
            contigs = self.global_fits.join(self.contigs.select("contig", "size"), "contig").select("contig", F.lit(-1).alias("segment"), F.lit(0).cast("long").alias("start"), F.col("size").alias("end"), F.lit(0.0).alias("state"), "r", "p", "rmsea", "threshold", "fit_quantile", "n_signal", "signal_tags", F.col("n_total").alias("mappable_bases"), F.col("total_tags").alias("mappable_tags"))
            contigs = contigs.withColumns({"bg_tags": F.col("mappable_tags") - F.col("signal_tags"), "bg_bases": F.col("mappable_bases") - F.col("n_signal"), "success_fit": F.lit(True), "max_bg_reached": F.lit(False), "refit_with_constraint": F.lit(False), "fit_type": F.lit("global")})
            out = out.unionByName(contigs, allowMissingColumns=True)
            out = out.withColumns({"slope": number(line.slope), "intercept": number(line.intercept), "SPOT": number(line.score), "SPOT_std": number(line.score_std), "bg_bases_prop": F.try_divide("bg_bases", "mappable_bases")})
            out = out.withColumn("background", isf(0.005, F.col("r"), F.col("p")))
            return out.withColumn("valid_segment", F.col("success_fit") & ~F.col("max_bg_reached") & (F.col("fit_type") == "segment"))

        return self.kept("fit_stats", make, pooled=True)

    def small(self, df: DataFrame) -> DataFrame:
        """A table of segments, cut from its lineage; a genome has thousands."""
        return self.spark.createDataFrame(df.collect(), df.schema)

    def segment_fits(self, rows: DataFrame | None = None, lows: DataFrame | None = None) -> DataFrame:
        """The scan of each segment; its contig's threshold is the least upper edge of its bins."""
        tops = self.global_fits.select("contig", F.col("threshold").alias("top"))
        return self.fits(self.segmented if rows is None else rows, ("contig", "segment"), step=F.col("step"), start=F.col("start"), tops=tops, lows=lows)

    def with_fit(self, segments: DataFrame, fits: DataFrame) -> DataFrame:
        """Segments with what their fits say."""
        joined = segments.join(fits.select("contig", "segment", "r", "p", "rmsea", "threshold", "fit_quantile", "n_signal", "signal_tags"), ["contig", "segment"], "left")
        return joined.withColumns({"bg_tags": F.col("mappable_tags") - F.col("signal_tags"), "bg_bases": F.col("mappable_bases") - F.col("n_signal"), "success_fit": F.col("r").isNotNull(), "max_bg_reached": F.lit(False), "refit_with_constraint": F.lit(False)})

    def refit(self, odd: DataFrame) -> DataFrame:
        """Segments scanned again, from the quantile on that leaves enough tags to the background."""
        keys, most = ("contig", "segment"), self.config.max_background
        rows = self.segmented.join(odd.select(*keys), [*keys], "left_semi")
        sampled = rows.where((F.col("pos") - F.col("start")) % F.col("step") == 0)
        limits = background.tag_cdf_thresholds(rows, odd.select(*keys, F.col("min_bg_tag_proportion").alias("fraction")), keys, most, sampled)
        limits = self.small(limits.select(*keys, F.least("fit_quantile", F.lit(most)).alias("low"), F.col("max_bg_reached").alias("reached")))
        fitted = self.with_fit(odd.select(*keys, "start", "end", "state", "mappable_bases", "mappable_tags"), self.segment_fits(rows, limits))
        return fitted.join(limits, [*keys], "left").withColumns({"max_bg_reached": F.coalesce("reached", F.lit(False)), "refit_with_constraint": F.lit(True)}).drop("low", "reached")

    @cached_property
    def fit_params(self) -> DataFrame:
        """``sliding_r``, ``sliding_p``, ``enough_bg`` and ``threshold`` of each position of a segment with a fit."""

        def make() -> DataFrame:
            c = self.config
            stats = self.fit_stats.where("success_fit AND fit_type = 'segment'").select("contig", "segment", "threshold", F.col("r").alias("fallback_r"))
            rows = self.segmented.select("contig", "segment", "pos", "x", "start", "end").join(F.broadcast(stats), ["contig", "segment"])
            # positions count from the segment's start, so that windows end with it
            local = rows.withColumns({"pos": F.col("pos") - F.col("start"), "size": F.col("end") - F.col("start")}).drop("end")
            out = background.sliding_nb(local, window=c.bg_window, flank=c.exclude_flank, fraction=c.min_mappable_proportion, keys=("contig", "segment"))
            return out.select("contig", (F.col("pos") + F.col("start")).alias("pos"), "x", "sliding_r", "sliding_p", "enough_bg", "threshold")

        return self.kept("fit_params", make)

    @cached_property
    def pvalues(self) -> DataFrame:
        """``neglog10_p`` of each position; null where the background is too thin to test."""

        def make() -> DataFrame:
            tail = neglog10_tail(F.col("x"), F.col("sliding_r"), F.col("sliding_p"))
            return self.fit_params.select("contig", "pos", F.when(F.col("enough_bg"), tail).alias("neglog10_p"))

        return self.kept("pvalues", make)

    @cached_property
    def fdrs(self) -> DataFrame:
        return self.kept("fdrs", lambda: fdr.fdr(self.pvalues, self.config.max_fdr, self.config.fdr_method).select("contig", "pos", "neglog10_p", "neglog10_q"), pooled=True)

    @cached_property
    def scores(self) -> DataFrame:
        return self.fdrs.join(self.contigs.select("contig", "size"), "contig")

    def regions(self, q: float) -> DataFrame:
        """``(contig, start, end, id, max_neglog10_fdr, …)`` at a rate of ``q``."""
        found = islands.regions(self.scores, "neglog10_q", -math.log10(q), self.config.window)
        return found.withColumnRenamed("max_score", "max_neglog10_fdr").withColumn("id", F.lit(self.sample))

    def peaks(self, q: float) -> DataFrame:
        c = self.config
        spread = islands.dilate(self.scores, F.col("neglog10_q") >= -math.log10(q), c.window, c.min_significant_for_peak)
        spans = islands.islands(spread.where("inside"))
        wave = self.smoothed.select("contig", "size", "pos", F.col("smoothed").alias("x"), "density")
        tops = peaks.inside(peaks.summits(wave, self.contigs), spans)
        return peaks.peaks(tops, wave, self.contigs, self.total, c.min_peak_half_width).withColumn("id", F.lit(self.sample))

    def regions_bed12(self, q: float) -> DataFrame:
        return export.regions_bed12(self.regions(q).withColumnRenamed("max_neglog10_fdr", "max_score"), self.sample, q)

    def peaks_bed12(self, q: float) -> DataFrame:
        return export.peaks_bed12(self.peaks(q), self.sample, q)

    def density_track(self) -> DataFrame:
        return export.track(self.smoothed, "density", self.config.density_step, positive=True)

    def threshold_track(self) -> DataFrame:
        return export.track(self.thresholds, "threshold", self.config.background_step)

    def background_track(self) -> DataFrame:
        """The upper quantile of the background of every ``background_step``-th position, per million cuts."""
        c = self.config
        points = self.fit_params.where(F.col("pos") % c.background_step == 0).where("enough_bg")
        values = points.withColumn("x", isf(0.005, F.col("sliding_r"), F.col("sliding_p")))
        return export.track(dense.normalized_density(values, self.total), "density", c.background_step)


def multi_sample_fdr(pvalues: DataFrame, max_fdr: float = 0.05, method: str = "bh") -> DataFrame:
    """``(sample_id, contig, pos, neglog10_p)`` with ``neglog10_q`` over the pooled tests of all samples."""
    return fdr.fdr(pvalues, max_fdr, method)


def multi_sample_run(spark: SparkSession, mapping: str, path: str, max_fdr: float = 0.05, method: str = "bh", contigs: DataFrame | None = None) -> DataFrame:
    """Rates over the pooled tests of all samples of a mapping file (``id``, ``pvals_parquet``), written to ``path`` by contig and sample; with ``contigs`` those alone count.

    Partitions that are written again replace those of the same contig and sample. The table as a whole is returned.
    """
    rows = io.read_samples(spark, mapping)
    if contigs is not None:
        rows = rows.join(F.broadcast(contigs.select("contig")), "contig", "left_semi")  # a row per contig
    io.write_partitioned(multi_sample_fdr(rows, max_fdr, method).select("contig", "sample_id", "pos", "neglog10_p", "neglog10_q"), path, "contig", "sample_id")
    return spark.read.parquet(path)
