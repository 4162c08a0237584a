"""Tables by contig that a broken run can go on with.

A table is written in jobs of one or more contigs. Each job writes beside the table; its contigs are moved into place, one rename each, and then
named in the manifest, which is replaced as a whole. So what the manifest names is complete, and a later run makes the other contigs alone.
The manifest also holds the settings that the table was made with: a table made with others is made anew, or refused where it is given from outside.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyridge.sources.scratch import batches_by_rows

MANIFEST = "_manifest.json"


class OtherSettings(ValueError):
    """A given table was made with other settings."""


class Files:
    """What is needed of a file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def read(self, path: str) -> str | None:
        try:
            stream = self.fs.open(self.path(path))
        except Py4JJavaError as e:
            if "FileNotFound" in str(e.java_exception):
                return None
            raise
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, path: str, text: str) -> None:
        """Writes beside the file first, so that it is never half written."""
        beside = f"{path}.{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(beside), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.delete(path)
        self.fs.rename(self.path(beside), self.path(path))

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def move(self, old: str, new: str) -> None:
        self.delete(new)
        self.fs.mkdirs(self.path(new).getParent())
        if not self.fs.rename(self.path(old), self.path(new)):
            raise OSError(f"{old} could not be moved to {new}")

    def folders(self, path: str) -> list[str]:
        at = self.path(path)
        return [s.getPath().getName() for s in self.fs.listStatus(at) if s.isDirectory()] if self.fs.exists(at) else []


def settings_of(spark: SparkSession, path: str) -> dict | None:
    """What a table was made with; None where it says nothing of it."""
    text = Files(spark, path).read(f"{path}/{MANIFEST}")
    return json.loads(text)["settings"] if text else None


def check_settings(spark: SparkSession, path: str, settings: dict) -> None:
    """Refuses a table that was made with other settings; one without a manifest passes."""
    own = settings_of(spark, path)
    if own is not None and (apart := sorted(k for k in {*own, *settings} if own.get(k) != settings.get(k))):
        raise OtherSettings(f"{path} was made with other settings: " + ", ".join(f"{k} {own.get(k)!r}, not {settings.get(k)!r}" for k in apart))


class Staged:
    """The table at ``path``, made with ``settings``."""

    def __init__(self, spark: SparkSession, path: str, settings: dict):
        self.spark, self.path, self.settings, self.files = spark, path.rstrip("/"), json.loads(json.dumps(settings)), Files(spark, path)

    def finished(self) -> list[str]:
        """Contigs that are complete, those without rows included; none where the settings are others."""
        text = self.files.read(f"{self.path}/{MANIFEST}")
        found = json.loads(text) if text else {}
        return found["contigs"] if found.get("settings") == self.settings else []

    def write(self, make: Callable[[], DataFrame], contigs: Sequence[str], at_a_time: int | None = None) -> DataFrame:
        """``make()`` by contig: what is missing of it, ``at_a_time`` contigs a job (all by default)."""
        done = self.finished()
        if not done:
            self.files.delete(self.path)
        left = [c for c in contigs if c not in done]
        df = make()
        for k in range(0, len(left), at_a_time or max(1, len(left))):
            some = left[k : k + (at_a_time or len(left))]
            rows = df if len(some) == len(contigs) else df.where(F.col("contig").isin(some))
            beside = f"{self.path}/_job-{uuid.uuid4().hex}"
            with batches_by_rows(self.spark):
                rows.write.option("compression", "zstd").partitionBy("contig").parquet(beside)
            for name in self.files.folders(beside):
                self.files.move(f"{beside}/{name}", f"{self.path}/{name}")
            done = [*done, *some]
            self.files.replace(f"{self.path}/{MANIFEST}", json.dumps({"settings": self.settings, "contigs": done}))
            self.files.delete(beside)
        return self.spark.read.schema(df.schema).parquet(self.path)
