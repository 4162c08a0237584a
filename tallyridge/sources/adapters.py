"""Tables of the driver as coordinate-indexed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Contigs of ``lineitem``: flag and status; positions: order keys; counts: summed quantities.
CUTS_SQL = "SELECT l_returnflag || l_linestatus AS contig, l_orderkey AS pos, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS cnt FROM lineitem GROUP BY 1, 2"
CONTIGS_SQL = "SELECT contig, size, row_number() OVER (ORDER BY contig) - 1 AS ord FROM (SELECT DISTINCT l_returnflag || l_linestatus AS contig, (SELECT max(l_orderkey) + 1 FROM lineitem) AS size FROM lineitem)"
EVENT_CUTS_SQL = "SELECT event_type AS contig, CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 60) AS BIGINT) AS pos, count(*) AS cnt FROM events GROUP BY 1, 2"


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(contig, pos, cnt)`` of ``lineitem``."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = lines.select(F.concat("l_returnflag", "l_linestatus").alias("contig"), F.col("l_orderkey").alias("pos"), F.col("l_quantity").cast("long").alias("quantity"))
    # few lines share a position: adding them up before they are dealt would hold nearly all of them for nothing
    return rows.repartition("contig", "pos").groupBy("contig", "pos").agg(F.sum("quantity").alias("cnt"))


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(contig, size, ord)``: the catalogue, a handful of rows."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    sizes = lines.groupBy(F.concat("l_returnflag", "l_linestatus").alias("contig")).agg(F.max("l_orderkey").alias("top"))
    names = sorted((r["contig"], r["top"]) for r in sizes.collect() if r["contig"] is not None)
    size = max((t for _, t in names), default=-1) + 1
    return spark.createDataFrame([(c, size, k) for k, (c, _) in enumerate(names)], "contig string, size long, ord int")


def event_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(contig, pos, cnt)`` of ``events`` by the minute since 2024."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    minute = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))) / 60)
    return events.groupBy(F.col("event_type").alias("contig"), minute.alias("pos")).agg(F.count("*").alias("cnt"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(contig, start, end, strand)`` of ``lineitem``."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    end = F.col("l_orderkey") + F.col("l_quantity").cast("long")
    return lines.select(F.col("l_returnflag").alias("contig"), F.col("l_orderkey").alias("start"), end.alias("end"), F.when(F.col("l_linestatus") == "F", "+").otherwise("-").alias("strand"))


def unmappable_blocks(contigs: DataFrame, width: int = 1000, every: int = 10) -> DataFrame:
    """``(contig, start, end)`` of mappable intervals: all but the last block of each ``every``."""
    blocks = contigs.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / (width * every)))))
    start = F.col("k") * width * every
    return blocks.select("contig", start.alias("start"), F.least(start + width * (every - 1), F.col("size")).alias("end"))
