"""Comparing the members of large groups block by block, without a row per pair."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyridge.llm.common import Scratch


def block_pairs(rows: DataFrame, key: str, member: str, block: int, scratch: Scratch, name: str, weight: str | None = None, most_weight: int = 1 << 21) -> DataFrame:
    """``rows`` dealt so that each pair of blocks of a group meets in one task.

    A group of ``key`` is split by a hash of ``member`` into blocks of about ``block`` rows, or of ``most_weight`` by the column ``weight`` if that
    makes more of them. Columns ``i``, ``j`` and ``left`` are added: the pair of blocks, and whether the row stands for ``i``. A task gets
    its pairs of blocks one after another; the first and second of them may be the same.
    """
    share = F.count("*") / block
    if weight:
        share = F.greatest(share, F.sum(weight) / most_weight)
    sizes = scratch.table(rows.groupBy(key).agg(F.ceil(share).cast("int").alias("blocks")), name)
    dealt = rows.join(sizes.hint("merge"), key).withColumn("block", F.pmod(F.xxhash64(member), F.col("blocks").cast("long")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    dealt = dealt.withColumn("left", F.col("block") == F.col("i")).drop("blocks", "block", "other")
    return dealt.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def met(batches: Iterator, key: str, columns: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple], list[tuple]]]:
    """(group, left rows, right rows) of each pair of blocks; right is left where a block meets itself."""
    group, held = None, []

    def sides():
        left = [h[1:] for h in held if h[0]]
        return group, left, left if group[1] == group[2] else [h[1:] for h in held if not h[0]]

    for b in batches:
        for row in zip(*(b[c].to_pylist() for c in (key, "i", "j", "left", *columns))):
            if row[:3] != group:
                if group:
                    yield sides()
                group, held = row[:3], []
            held.append(row[3:])
    if group:
        yield sides()
