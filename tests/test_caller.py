"""Files in and out, and the whole calculation on planted signals."""

import glob
import gzip
import math
import os
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyridge.operators import background
from tallyridge.plans.caller import STAGES, Caller, Config, multi_sample_fdr, multi_sample_run
from tallyridge.plans.steps import CALLING, NothingToStartFrom, Steps
from tallyridge.sources import io
from tallyridge.sources.staged import OtherSettings, Staged

SMALL = Config(bg_window=4001, bg_window_small=401, fit_step=200, sample_step=25, interpolation_step=500, min_segment=4001, segment_step=50, min_significant_for_peak=5)


def planted(spark, seed=0):
    """Cuts of two contigs with enriched stretches, one contig without cuts, one shorter than the window."""
    rng = np.random.default_rng(seed)
    rows, where = [], []
    for contig in ("one", "two"):
        x = rng.negative_binomial(0.4, 0.9, 40_000)
        for at in range(3_000, 38_000, 7_000):
            x[at : at + 200] += rng.negative_binomial(6, 0.5, 200)
            where.append((contig, at, at + 200))
        rows += [(contig, int(k), int(v)) for k, v in enumerate(x) if v]
    rows += [("short", k, 1) for k in range(0, 60, 3)]
    contigs = spark.createDataFrame([("two", 40_000, 0), ("one", 40_000, 1), ("empty", 5_000, 2), ("short", 60, 3)], "contig string, size long, ord int")
    return spark.createDataFrame(rows, "contig string, pos long, cnt long"), contigs, where


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    cuts, contigs, where = planted(spark)
    mappable = spark.createDataFrame([(c, k, k + 1_900) for c in ("one", "two") for k in range(0, 40_000, 2_000)], "contig string, start long, end long")
    return Caller(cuts, contigs, "file://" + str(tmp_path_factory.mktemp("caller")), config=SMALL, mappable=mappable), where


def test_planted_signals_are_found(run):
    caller, where = run
    regions = caller.regions(0.05).collect()
    hit = lambda r: any(c == r["contig"] and a - 300 < r["end"] and r["start"] < b + 300 for c, a, b in where)
    found = {(c, a) for c, a, b in where if any(r["contig"] == c and r["start"] < b and a < r["end"] for r in regions)}
    assert len(found) == len(where) and sum(map(hit, regions)) >= 0.8 * len(regions) and all(r["max_neglog10_fdr"] >= -math.log10(0.05) for r in regions)
    peaks = caller.peaks(0.05).collect()
    assert peaks and {r["contig"] for r in peaks} == {"one", "two"} and all(r["start"] <= r["summit"] < r["end"] for r in peaks)
    near = [any(c == p["contig"] and a - 200 <= p["summit"] < b + 200 for c, a, b in where) for p in peaks]
    assert sum(near) >= 0.8 * len(peaks)


def test_rows_of_fits(run):
    caller, _ = run
    rows = caller.fit_stats.collect()
    assert {r["fit_type"] for r in rows if r["contig"] == "one"} == {"segment", "global"}
    contigs = {r["contig"]: r for r in rows if r["fit_type"] == "global"}
    assert contigs["one"]["state"] == 0 and contigs["one"]["end"] == 40_000 and not contigs["one"]["valid_segment"] and "empty" not in {r["contig"] for r in rows if r["fit_type"] == "segment"}
    assert all(r["r"] > 0 and 0 < r["p"] < 1 and r["bg_tags"] <= r["mappable_tags"] for r in rows if r["success_fit"])


def test_outliers_are_scanned_again_from_their_quantile(run):
    caller, _ = run
    odd = caller.small(caller.fit_stats.where("fit_type = 'segment'").drop("min_bg_tag_proportion").selectExpr("*", "0.98D AS min_bg_tag_proportion"))
    again = {(r["contig"], r["segment"]): r for r in caller.refit(odd).collect()}
    tops = {r["contig"]: r["threshold"] for r in caller.global_fits.collect()}
    rows = caller.segmented.toPandas()
    for (contig, segment), g in rows.groupby(["contig", "segment"]):
        new, x, start = again[contig, segment], g.x.dropna().to_numpy(), g.start.iloc[0]
        seen = g[(g.pos - start) % g.step.iloc[0] == 0].x.dropna().to_numpy()
        values, counts = np.unique(x, return_counts=True)
        reached = values[np.cumsum(values * counts) / (values * counts).sum() >= 0.98]
        quantile = (seen < (reached[1] if len(reached) > 1 else math.inf)).mean()
        want = background.scan(*np.unique(seen, return_counts=True), low=min(0.995, quantile), top=tops[contig], background_bins=SMALL.background_bins, signal_bins=SMALL.signal_bins)
        assert new["refit_with_constraint"] and new["max_bg_reached"] == (quantile > 0.995) and new["state"] is not None
        assert (new["threshold"], new["rmsea"], new["r"]) == (want["threshold"], want["rmsea"], want["r"])
        assert new["signal_tags"] == np.floor(x[x >= want["threshold"]]).sum()


def test_stages_are_reused(spark, run, tmp_path):
    caller, _ = run
    caller.fdrs
    again = Caller(caller.cuts.limit(0), caller.contigs, f"file://{tmp_path}", config=SMALL, reuse={"fdrs": f"{caller.root}/fdrs"})
    assert sorted(map(tuple, again.regions(0.05).select("contig", "start", "end").collect())) == sorted(map(tuple, caller.regions(0.05).select("contig", "start", "end").collect()))
    assert not os.path.exists(tmp_path / "vector")  # nothing before it has run


def test_contigs_are_fitted_on_every_fit_step(run):
    caller, _ = run
    rows = caller.vector.toPandas()
    for r in caller.global_fits.collect():
        seen = rows[(rows.contig == r["contig"]) & (rows.pos % SMALL.fit_step == 0)].x.dropna().to_numpy()
        want = background.scan(*np.unique(seen, return_counts=True), background_bins=SMALL.background_bins, signal_bins=SMALL.signal_bins)
        assert (r["threshold"], r["rmsea"], r["r"]) == (want["threshold"], want["rmsea"], want["r"])


def test_the_plan_holds_what_is_missing_and_runs_it(spark, run, tmp_path):
    caller, _ = run
    assert caller.plan() == [s for s in STAGES.order if s not in ("reads", "cuts")]
    caller.fdrs, caller.smoothed
    given = {"fdrs": f"{caller.root}/fdrs", "smoothed": f"{caller.root}/smoothed"}
    again = Caller(caller.cuts, caller.contigs, f"file://{tmp_path}/a", config=SMALL, reuse=given)
    assert again.plan() == ["total", "calls"] and again.plan("fdrs") == [] and again.run("thresholds") == ["vector", "global_fits", "thresholds"]
    assert sorted(os.listdir(tmp_path / "a")) == ["global_fits", "thresholds", "vector"]
    reads = caller.cuts.selectExpr("contig", "pos AS start", "pos + 5 AS end", "'+' AS strand", "explode(sequence(1, cnt))").drop("col")
    from_reads = Caller(None, caller.contigs, f"file://{tmp_path}/b", config=SMALL, reads=reads)
    assert from_reads.plan("total") == ["cuts", "total"] and from_reads.total.first()[0] == caller.total.first()[0]
    with pytest.raises(NothingToStartFrom, match="reads"):
        Caller(None, caller.contigs, f"file://{tmp_path}/c", config=SMALL).plan()


def test_given_stages_must_have_the_same_settings(run, tmp_path):
    caller, _ = run
    caller.fdrs
    given = {"fdrs": f"{caller.root}/fdrs"}
    with pytest.raises(OtherSettings, match="window 151, not 75"):
        Caller(caller.cuts, caller.contigs, f"file://{tmp_path}", config=replace(SMALL, window=75), reuse=given)
    Caller(caller.cuts, caller.contigs, f"file://{tmp_path}", config=replace(SMALL, min_peak_half_width=3, smooth_level=2), reuse=given)  # these come later, or beside


def test_a_broken_run_goes_on_by_contig(spark, tmp_path):
    rows = spark.createDataFrame([(c, k) for c in ("a", "b", "d") for k in range(5)], "contig string, pos long")
    table = lambda settings: Staged(spark, f"file://{tmp_path}/t", settings)
    broken = rows.withColumn("pos", F.when(F.col("contig") == "b", F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("pos")))
    with pytest.raises(Exception, match="lost"):
        table({"w": 1}).write(lambda: broken, ["a", "b", "c", "d"], 1)
    assert table({"w": 1}).finished() == ["a"] and sorted(x.name for x in (tmp_path / "t").glob("contig=*")) == ["contig=a"]
    before = {x: x.stat().st_mtime_ns for x in (tmp_path / "t" / "contig=a").iterdir()}
    made = table({"w": 1}).write(lambda: rows, ["a", "b", "c", "d"], 1)
    assert sorted(map(tuple, made.select("contig", "pos").collect())) == [(c, k) for c in "abd" for k in range(5)]
    assert table({"w": 1}).finished() == ["a", "b", "c", "d"] and {x: x.stat().st_mtime_ns for x in (tmp_path / "t" / "contig=a").iterdir()} == before
    assert table({"w": 2}).finished() == [] and table({"w": 2}).write(lambda: rows.where("contig = 'd'"), ["d"]).count() == 5
    assert not list((tmp_path / "t").glob("_job-*")) and [x.name for x in (tmp_path / "t").glob("contig=*")] == ["contig=d"]


def test_a_second_run_on_a_folder_reads_what_is_there(spark, run):
    caller, _ = run
    caller.pvalues
    stamp = lambda: {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{caller.root.removeprefix('file://')}/*/contig=*/*.parquet")}
    before = stamp()
    again = Caller(caller.cuts, caller.contigs, caller.root, config=SMALL, mappable=caller.mappable)
    assert again.pvalues.count() == caller.pvalues.count() and stamp() == before


def test_tracks_and_several_samples(spark, run):
    caller, _ = run
    assert caller.density_track().where("value <= 0 OR start % 20 <> 0").count() == 0 and caller.threshold_track().count() > 100
    assert caller.background_track().where("start % 100 <> 0").count() == 0
    both = caller.pvalues.selectExpr("'a' AS sample_id", "*").unionByName(caller.pvalues.selectExpr("'b' AS sample_id", "contig", "pos", "neglog10_p / 2 AS neglog10_p"))
    assert multi_sample_fdr(both, 0.05).where("neglog10_q IS NOT NULL").count() > 0


def test_files(spark, tmp_path):
    (tmp_path / "sizes.tsv").write_text("b\t30\nc\t20\n")
    assert [tuple(r) for r in io.read_contigs(spark, str(tmp_path / "sizes.tsv")).orderBy("ord").collect()] == [("b", 30, 0), ("c", 20, 1)]
    with gzip.open(tmp_path / "cuts.bed.gz", "wt") as f:
        f.write("#chr\tstart\tend\tcount\nb\t4\t5\t2\nc\t7\t8\t1\n")
    cuts = io.read_cuts(spark, str(tmp_path / "cuts.bed.gz"))
    assert sorted(map(tuple, cuts.collect())) == [("b", 4, 2), ("c", 7, 1)]
    io.write_cuts(cuts, str(tmp_path / "again"))
    assert sorted(map(tuple, io.read_cuts(spark, str(tmp_path / "again")).collect())) == [("b", 4, 2), ("c", 7, 1)]
    (tmp_path / "wide.bed").write_text("b\t4\t9\t2\n")
    with pytest.raises(Exception, match="wider than one position"):
        io.read_cuts(spark, str(tmp_path / "wide.bed")).collect()
    track = spark.createDataFrame([("b", 20, 40, 0.5), ("b", 0, 20, 1.5)], "contig string, start long, end long, value double")
    io.write_bedgraph(track, str(tmp_path / "track"))
    lines = [line for part in sorted((tmp_path / "track").glob("part-*")) for line in gzip.open(part, "rt").read().splitlines()]
    assert lines == ["b\t0\t20\t1.5", "b\t20\t40\t0.5"]
    rows = spark.createDataFrame([("b", 1, 0.5), ("c", 2, 0.25)], "contig string, pos long, neglog10_p double")
    io.write_partitioned(rows, str(tmp_path / "p"))
    io.write_partitioned(rows.where("contig = 'b'").withColumn("pos", rows["pos"] + 8), str(tmp_path / "p"))
    assert [tuple(r) for r in io.read_partition(spark, str(tmp_path / "p"), "b", "pos").collect()] == [(9,)] and io.read_partition(spark, str(tmp_path / "p"), "c").count() == 1
    (tmp_path / "samples.tsv").write_text(f"id\tpvals_parquet\ns1\t{tmp_path}/p\ns2\t{tmp_path}/p\n")
    assert io.read_samples(spark, str(tmp_path / "samples.tsv")).groupBy("sample_id").count().count() == 2


def test_steps_in_order():
    assert CALLING.missing({"calls"}, {"cuts"}) == ["total", "fit_params", "smoothed", "pvalues", "fdrs", "calls"]
    assert CALLING.missing({"calls"}, {"cuts", "total", "smoothed", "fdrs"}) == ["calls"] and CALLING.missing({"calls", "density"}, {"smoothed", "fdrs", "total"}) == ["density", "calls"]
    assert CALLING.missing({"total"}, {"reads"}) == ["cuts", "total"] and CALLING.missing({"cuts"}, {"cuts"}) == []
    with pytest.raises(NothingToStartFrom, match="give reads"):
        CALLING.missing({"calls"}, {"fdrs", "smoothed"})
    with pytest.raises(ValueError, match="need one another"):
        Steps({"a": ("b",), "b": ("a",)})
    with pytest.raises(ValueError, match="no such steps: x"):
        CALLING.missing({"x"})


def test_steps_of_a_table_are_those_of_each_sample(spark):
    names = sorted(CALLING.made_of)
    rng = np.random.default_rng(0)
    samples = [(k, sorted(rng.choice(names, rng.integers(0, 6), replace=False).tolist())) for k in range(60)] + [(60, None), (61, ["elsewhere", None])]
    got = CALLING.missing_of_each(spark.createDataFrame(samples, "id int, given array<string>"), {"calls", "density"}).collect()
    for k, given in samples:
        own = sorted((r["place"], r["step"], r["startable"]) for r in got if r["id"] == k)
        try:
            want, startable = CALLING.missing({"calls", "density"}, {g for g in given or () if g in names}), True
        except NothingToStartFrom:
            want, startable = ["reads", *CALLING.missing({"calls", "density"}, {g for g in given or () if g in names} | {"reads"})], False
        assert own == [(p, s, startable) for p, s in enumerate(want)]


def test_several_samples_from_a_mapping_file(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(s, c, p, float(rng.exponential(1.0) if rng.random() > 0.1 else 0.0) if rng.random() > 0.05 else None) for s in ("s1", "s2") for c in ("a", "b", "z") for p in range(200)]
    table = spark.createDataFrame(rows, "sample_id string, contig string, pos long, neglog10_p double")
    for s in ("s1", "s2"):
        io.write_partitioned(table.where(f"sample_id = '{s}'").drop("sample_id"), f"{tmp_path}/{s}")
    (tmp_path / "samples.tsv").write_text(f"id\tpvals_parquet\ns1\t{tmp_path}/s1\ns2\t{tmp_path}/s2\n")
    contigs = spark.createDataFrame([("a", 200, 0), ("b", 200, 1)], "contig string, size long, ord int")
    got = multi_sample_run(spark, f"{tmp_path}/samples.tsv", f"{tmp_path}/out", 0.5, "by", contigs)
    want = multi_sample_fdr(table.where("contig <> 'z'"), 0.5, "by")
    columns = ("sample_id", "contig", "pos", "neglog10_p", "neglog10_q")
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(map(tuple, want.select(*columns).collect()), key=str)
    assert got.where("neglog10_q IS NOT NULL").count() > 0 and sorted(p.name for p in (tmp_path / "out" / "contig=a").iterdir()) == ["sample_id=s1", "sample_id=s2"]


def test_positions_find_their_segments_where_they_are(run):
    caller, _ = run
    rows, shuffled = caller.segmented, []
    again = Caller(caller.cuts, caller.contigs, f"{caller.root}-again", config=SMALL, mappable=caller.mappable, reuse={s: f"{caller.root}/{s}" for s in ("vector", "segments")})
    again.kept = lambda name, make, pooled=False: shuffled.append(make()) or rows if name == "segmented" else Caller.kept(again, name, make, pooled)
    again.segmented
    plan = shuffled[0]._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and sorted(map(tuple, shuffled[0].select(*rows.columns).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
