"""What several operators share: shared scratch tables, Arrow helpers, the word pattern."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
BLANKS = r"[\x20\x09-\x0D]+"
#: Bytes of payload after which a Python stage hands a batch back to Spark.
BATCH_BYTES = 8 << 20
#: A Spark master of one process, whose driver and executor share a disk.
LOCAL = re.compile(r"local(\[.*\])?")


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset and Spark runs in one process, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not LOCAL.fullmatch(spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tallyridge-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def row_order(id_col: str, text_col: str) -> Column:
    """A hash of a row's id and text, by which samples are chosen."""
    return F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))


#: Steps of the share of hashes that a sample takes.
STEPS = 1 << 40


def share(most: int, total: int, distinct: int) -> float:
    """The share of hashes that ``most`` of ``total`` rows have, of which about ``distinct`` differ."""
    return 1.0 if total <= most else min(1.0, most / max(1, distinct))


def bounded_sample(rows: DataFrame, most: int, *also: str) -> DataFrame:
    """About ``most`` of ``rows`` or fewer, by their column ``order``; rows of one hash (and of the same ``also``) count as one, so the bound holds for any ids."""
    total, distinct = rows.agg(F.count("*"), F.approx_count_distinct("order", 0.01)).first()
    picked = rows.where(F.pmod("order", F.lit(STEPS)) < share(most, total, distinct) * STEPS)
    return picked.dropDuplicates(["order", *also])


#: What is open in ``discarding``.
_open: list[list[Scratch]] = []


@contextmanager
def discarding() -> Iterator[None]:
    """Drops the scratch tables made inside, once their results have been written."""
    _open.append([])
    try:
        yield
    finally:
        for scratch in _open.pop():
            scratch.drop("")


class Scratch:
    """Tables written to the shared folder: they cut the lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        if _open:
            _open[-1].append(self)
        self.root = f"{shared_root(spark)}/tallyridge-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that only written ones have been made of."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name).rstrip("/"))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def sized_batches(rows: Iterator[tuple[int, tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Arrow batches from (bytes, row) pairs, each batch of about BATCH_BYTES."""
    held: list[tuple] = []
    total = 0
    for size, row in rows:
        held.append(row)
        total += size + 64
        if total >= BATCH_BYTES or len(held) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
