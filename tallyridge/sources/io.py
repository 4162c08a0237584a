"""Files in and out: catalogues, counts, intervals and tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """``(contig, size, ord)`` of a two-column table without header; the order of lines counts."""
    lines = [line.split("\t") for line in spark.read.text(path, wholetext=True).first()[0].splitlines() if line.strip()]
    return spark.createDataFrame([(c, int(n), k) for k, (c, n, *_) in enumerate(lines)], "contig string, size long, ord int")


def read_bed(spark: SparkSession, path: str, columns: str = "contig string, start long, end long") -> DataFrame:
    """The leading columns of a tab-separated table; lines that start with # are comments. Gzip is read as it is."""
    return spark.read.csv(path, sep="\t", comment="#", schema=columns, enforceSchema=True)


def read_cuts(spark: SparkSession, path: str) -> DataFrame:
    """``(contig, pos, cnt)`` of intervals that are one position wide; others are an error when they are read."""
    rows = read_bed(spark, path, "contig string, start long, end long, cnt long")
    checked = F.when(F.col("end") - F.col("start") == 1, F.col("start")).otherwise(F.raise_error(F.lit("a cut is wider than one position")).cast("long"))
    return rows.select("contig", checked.alias("pos"), "cnt")


def write_cuts(cuts: DataFrame, path: str) -> None:
    rows = cuts.select("contig", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "cnt")
    write_bed(rows.repartitionByRange("contig", "start").sortWithinPartitions("contig", "start"), path)


def write_bed(rows: DataFrame, path: str) -> None:
    """Tab-separated, compressed; the parts of the folder follow the order of ``rows``."""
    rows.write.mode("overwrite").csv(path, sep="\t", compression="gzip")


def write_interval_max(rows: DataFrame, path: str, row: str = "row", kind: str = "bed") -> None:
    """Intervals with their maxima (``bed``), or the maxima alone (``txt``), in the order of ``row``."""
    columns = {"bed": ("contig", "start", "end", "max_neglog_p"), "txt": ("max_neglog_p",)}[kind]
    rows.repartitionByRange(row).sortWithinPartitions(row).select(*columns).write.mode("overwrite").csv(path, sep="\t")


def write_bedgraph(track: DataFrame, path: str) -> None:
    write_bed(track.select("contig", "start", "end", "value").repartitionByRange("contig", "start").sortWithinPartitions("contig", "start"), path)


def write_partitioned(rows: DataFrame, path: str, *by: str) -> None:
    """Parquet by contig (and sample); a partition that is written again replaces the old one alone."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*(by or ("contig",))).parquet(path)


def read_partition(spark: SparkSession, path: str, contig: str, *columns: str) -> DataFrame:
    """A contig's rows; only its files and the named columns are read."""
    return spark.read.parquet(path).where(F.col("contig") == contig).select(*(columns or ("*",)))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """The p-values of several samples, from a table with header ``id`` and ``pvals_parquet``."""
    rows = spark.read.csv(path, sep="\t", header=True).select("id", "pvals_parquet").collect()
    tables = [spark.read.parquet(r["pvals_parquet"]).withColumn("sample_id", F.lit(r["id"])) for r in rows]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
