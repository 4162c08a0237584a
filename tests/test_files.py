"""Block-compressed tables and tracks with summaries."""

import gzip
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyridge.sources import blocks, tracks
from tallyridge.sources.scratch import batches_by_rows

SCHEMA = "contig string, start long, end long, cnt long, name string"


@pytest.fixture(scope="module")
def source(spark):
    blocks.register(spark)
    return spark


def text_of(rows):
    return "".join("\t".join(map(str, r)) + "\n" for r in rows)


def rows_of(n, contigs=("a", "b", "c")):
    rng = np.random.default_rng(n)
    return [(c, int(p), int(p) + 1, int(v), "x" * int(k)) for c in contigs for p, v, k in zip(range(0, 7 * n, 7), rng.integers(0, 99, n), rng.integers(0, 40, n))]


class Bytes(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


@pytest.mark.parametrize("width", [50, 700, 65_280])
def test_lines_are_read_once_for_any_ranges(width):
    text = ("#chr\tstart\n" + text_of(rows_of(60)) + "last without end").encode()
    data = b"".join(blocks.member(text[k : k + width]) for k in range(0, len(text), width)) + blocks.END
    assert gzip.decompress(data) == text
    for split in (1, 13, 100, 999, 10**6):
        parts = [blocks.Part("", at, min(at + split, len(data)), -1 if at else 0) for at in range(0, len(data), split)]
        got = [line for p in parts for line in blocks.lines(Bytes(data), p)]
        assert got == text.split(b"\n")


def test_one_file_is_read_by_several_tasks(source, tmp_path):
    rows = rows_of(30_000)
    text = ("#chr\tstart\tend\tcount\n" + text_of(rows)).encode()
    path = tmp_path / "cuts.bed.gz"
    path.write_bytes(b"".join(blocks.member(text[k : k + 20_000]) for k in range(0, len(text), 20_000)) + blocks.END)
    df = source.read.format("block_bed").schema(SCHEMA).option("split_bytes", 50_000).load(str(path))
    assert df.rdd.getNumPartitions() == -(-path.stat().st_size // 50_000) > 5
    assert df.groupBy(F.spark_partition_id()).count().count() > 5
    assert sorted(tuple(r) for r in df.fillna("").collect()) == sorted(rows)
    with pytest.raises(Exception, match="no member"):
        (tmp_path / "plain.bed.gz").write_bytes(gzip.compress(b"a\t1\t2\n"))
        source.read.format("block_bed").load(str(tmp_path / "plain.bed.gz")).collect()


def test_written_tables_have_an_index_by_which_contigs_are_chosen(source, tmp_path):
    rows = rows_of(9_000, [f"chr{k}" for k in range(6)]) + [("long", 0, 5, 1, "y" * 200_000), ("long", 9, 12, 2, "z")]
    table = source.createDataFrame(rows, SCHEMA)
    for _ in range(2):  # a second write replaces the first
        table.repartitionByRange(3, "contig", "start").sortWithinPartitions("contig", "start").write.format("block_bed").mode("overwrite").save(str(tmp_path / "t"))
    files = sorted(p.name for p in (tmp_path / "t").iterdir())
    assert len(files) == 6 and all(gzip.open(tmp_path / "t" / f).read() for f in files if f.endswith(".gz"))
    df = source.read.format("block_bed").schema(SCHEMA).option("split_bytes", 40_000).load(str(tmp_path / "t"))
    assert sorted(tuple(r) for r in df.fillna("").collect()) == sorted(rows)
    for wanted in (["chr3"], ["chr0", "chr5"], ["long"], ["none"]):
        some = df.where(F.col("contig").isin(wanted))
        assert sorted(tuple(r) for r in some.fillna("").collect()) == sorted(r for r in rows if r[0] in wanted)
        reader = blocks.Reader(df.schema, {"path": str(tmp_path / "t")})
        assert list(reader.pushFilters([blocks.In(("contig",), wanted)]))
        read = sum(p.end - p.start for p in reader.partitions())
        assert read < 0.5 * sum((tmp_path / "t" / f).stat().st_size for f in files if f.endswith(".gz"))


def test_bins_are_the_smallest_that_hold_an_interval():
    assert blocks.bin_of(0, 1) == 4681 and blocks.bin_of(16_383, 16_385) == 585 and blocks.bin_of(0, 1 << 29) == 0 and blocks.bin_of(1 << 17, (1 << 17) + 9) == 4681 + 8


def plain_summary(track, lo, hi):
    at = {p: v for a, z, v in track for p in range(a, z)}
    x = np.array([at[p] for p in range(lo, hi) if p in at])
    return (len(x), x.min(), x.max(), x.sum(), (x * x).sum()) if len(x) else None


def test_summaries_of_tracks(spark, tmp_path):
    rng = np.random.default_rng(3)
    starts = np.cumsum(rng.integers(1, 60, 120))
    track = [(int(a), int(a + n), float(v)) for a, n, v in zip(starts, np.minimum(rng.integers(1, 90, 120), np.append(np.diff(starts), 50)), rng.integers(-20, 90, 120))]
    rows = spark.createDataFrame([("c", *t) for t in track] + [("d", 5, 6, 2.5), ("d", 9, 9, 1.0), ("d", 20, 30, None)], "contig string, start long, end long, value double")
    got = tracks.zoomed(rows, first=16, factor=4, levels=4).collect()
    own = {(r["level"], r["start"]): (r["n"], r["low"], r["high"], r["total"], r["squares"]) for r in got if r["contig"] == "c"}
    for level in range(4):
        width = 16 * 4**level
        want = {(level, lo): s for lo in range(0, int(starts[-1]) + 200, width) if (s := plain_summary(track, lo, lo + width))}
        assert {k: v for k, v in own.items() if k[0] == level} == want
    assert [(r["level"], r["n"], r["total"]) for r in got if r["contig"] == "d"] == [(k, 1, 2.5) for k in range(4)] or len([r for r in got if r["contig"] == "d"]) == 4
    path = f"file://{tmp_path}/t"
    tracks.write_track(rows, path, first=16, factor=4, levels=4)
    for lo, hi, bins in ((0, 2_048, 8), (64, 1_088, 64), (100, 140, 40), (0, 4_096, 1)):
        width = (hi - lo) // bins
        read = {r["bin"]: r for r in tracks.read_summary(spark, path, "c", lo, hi, bins, first=16, factor=4, levels=4).collect()}
        want = {k: s for k in range(bins) if (s := plain_summary(track, lo + k * width, lo + (k + 1) * width))}
        assert set(read) == set(want)
        for k, (n, low, high, total, squares) in want.items():
            assert (read[k]["n"], read[k]["low"], read[k]["high"]) == (n, low, high) and abs(read[k]["mean"] - total / n) < 1e-9
            assert abs(read[k]["deviation"] - np.sqrt(max(squares / n - (total / n) ** 2, 0))) < 1e-6


def test_batches_by_rows_leave_the_setting_as_it_was(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    with pytest.raises(KeyError), batches_by_rows(spark):
        assert int(spark.conf.get(name)) == 2**31 - 1
        raise KeyError
    assert spark.conf.get(name) == before
