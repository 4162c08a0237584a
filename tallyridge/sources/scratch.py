"""Folders for intermediate tables, in the place that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir; where that is unset and Spark runs in one process, in a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tallyridge-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def batches_by_rows(spark: SparkSession) -> Iterator[None]:
    """For jobs on narrow tables: batches to Python are bounded by rows alone. Spark adds up a batch's bytes at each of its rows, which costs more than to send them."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, (1 << 31) - 1)
    try:
        yield
    finally:
        spark.conf.set(name, before)
