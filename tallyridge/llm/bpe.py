"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks of ``chunk_chars`` characters that run into their successors by ``overlap``. Every
chunk is pre-tokenised on its own, neighbouring chunks are stitched at the first boundary of their overlap
that both have found, and the pieces between stitches are encoded apart. Where two neighbours share no
boundary (a run of blanks or letters as long as the overlap), those two alone become one chunk.

Texts of up to ``spread_chars`` characters go through this in the task that reads them. Longer ones are first cut into
parts of that size, which are stitched in the same way over many tasks; each part is then encoded chunk by chunk.
A single pre-token is never split, however long.

A null text counts as empty and gives no ids; null and repeated ids are kept, one result per row.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyridge.llm.common import Scratch, sized_batches

DEFAULT_VOCAB = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def load_encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def ids_bytes(ids: list[int]) -> bytes:
    import numpy as np

    return np.asarray(ids, dtype="<u4").tobytes()


def overlapping_chunks(text: str, size: int, overlap: int) -> Iterator[tuple[int, int, bool, str]]:
    """(start, core, last, chunk): a chunk holds ``core`` characters and runs into its successor by ``overlap``."""
    for at in range(0, max(1, len(text)), size):
        yield at, min(size, len(text) - at), at + size >= len(text), text[at : at + size + overlap]


def boundaries(chunk: str, pattern: regex.Pattern) -> list[int]:
    """Starts of pre-tokens that follow a character other than white space.

    After such a character a text can be cut: what stands before is split the same way without what follows.
    """
    return [s for m in pattern.finditer(chunk) if (s := m.start()) == 0 or not chunk[s - 1].isspace()]


def stitched(text: str, pattern: regex.Pattern, size: int, overlap: int) -> Iterator[str]:
    """The pieces between stitches, end to end the text."""
    start, own, step, hi = 0, None, size, size
    while hi < len(text):
        if own is None:  # from a stitch on, or from the start
            own = [start + b for b in boundaries(text[start : hi + overlap], pattern)]
        ahead = [hi + b for b in boundaries(text[hi : hi + size + overlap], pattern)]
        until = min(hi + overlap, len(text))
        both = set(own[bisect_left(own, hi) :]).intersection(ahead[: bisect_left(ahead, until)])
        if both:
            at = min(both)
            yield text[start:at]
            # from a shared boundary on the next chunk is split as the whole text is
            start, own, step, hi = at, ahead, size, hi + size
        else:
            own, hi, step = None, hi + step, 2 * step
    yield text[start:]


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, pattern: str | None = None, chunk_chars: int = 2_048, overlap: int = 256, spread_chars: int = 65_536) -> DataFrame:
    """``(id_col, ids)`` for each row of ``docs``; ids are little-endian unsigned 32-bit integers, end to end."""
    path, pattern = vocab or public_tokenizers.path(DEFAULT_VOCAB), pattern or public_tokenizers.PATTERN
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    long = F.length("text") > spread_chars
    # numbered once and written: a second scan of ``docs`` could meet rows in another order
    long_rows = Scratch(docs.sparkSession).table(rows.where(long).withColumn("row", F.monotonically_increasing_id()), "long")

    def ids_of(text: str) -> bytes:
        encoding, found = load_encoding(path, pattern), compiled(pattern)
        return b"".join(ids_bytes(encoding.encode_ordinary(piece)) for piece in stitched(text, found, chunk_chars, overlap))

    def encode_whole(batches):
        for b in batches:
            # an id of any type passes through untouched
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(map(ids_of, b["text"].to_pylist()), pa.binary())], names=["id", "ids"])

    short = rows.where(~long).mapInArrow(encode_whole, f"id {id_type}, ids binary")

    def encode_parts(batches):
        def each():
            for b in batches:
                for row, at, text in zip(b["row"].to_pylist(), b["at"].to_pylist(), b["text"].to_pylist()):
                    ids = ids_of(text)
                    yield len(ids), (row, at, ids)

        return sized_batches(each(), pa.schema([("row", pa.int64()), ("at", pa.int64()), ("ids", pa.binary())]))

    def join_parts(batches):
        for b in batches:
            ids = [b"".join(p["ids"] for p in parts) for parts in b["parts"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["row"], pa.array(ids, pa.binary())], names=["row", "ids"])

    parts = spread(docs.sparkSession, long_rows.select("row", "text"), pattern, spread_chars, overlap)
    encoded = parts.mapInArrow(encode_parts, "row long, at long, ids binary")
    joined = encoded.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("parts")).mapInArrow(join_parts, "row long, ids binary")
    long_ids = long_rows.select("row", "id").join(joined, "row").select("id", "ids")
    return short.unionByName(long_ids).select(F.col("id").alias(id_col), "ids")


MARKED = pa.schema([("row", pa.int64()), ("at", pa.int64()), ("core", pa.int64()), ("last", pa.bool_()), ("text", pa.string()), ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64()))])


def spread(spark: SparkSession, texts: DataFrame, pattern: str, size: int, overlap: int) -> DataFrame:
    """``(row, at, text)``: parts of ``texts`` (row, text) of about ``size`` characters between stitches.

    Parts that share no boundary with their successor become one with it and are pre-tokenised again, until all are stitched.
    """
    scratch = Scratch(spark)
    schema = "row long, at long, core long, last boolean, text string, head array<bigint>, tail array<bigint>"

    def marked(row, at, core, last, text):
        found = boundaries(text, compiled(pattern))
        head = [at + b for b in found[: bisect_left(found, overlap)]] if at else []
        tail = [] if last else [at + b for b in found[bisect_left(found, core) :]]
        return 4 * len(text), (row, at, core, last, text, head, tail)

    def cut(batches):
        def each():
            for b in batches:
                for row, text in zip(b["row"].to_pylist(), b["text"].to_pylist()):
                    for at, core, last, chunk in overlapping_chunks(text, size, overlap):
                        yield 4 * len(chunk), (row, at, core, last, chunk)

        return sized_batches(each(), pa.schema(list(MARKED)[:5]))

    def mark(batches):
        return sized_batches((marked(*(x[c] for c in MARKED.names[:5])) for b in batches for x in b.to_pylist()), MARKED)

    def merge(batches):
        def each():
            for b in batches:
                for row, held in zip(b["row"].to_pylist(), b["held"].to_pylist()):
                    text = "".join(h["text"][: h["core"]] for h in held[:-1]) + held[-1]["text"]
                    yield marked(row, held[0]["at"], sum(h["core"] for h in held), held[-1]["last"], text)

        return sized_batches(each(), MARKED)

    chunks = texts.mapInArrow(cut, "row long, at long, core long, last boolean, text string").repartition("row", "at")
    state = scratch.table(chunks.mapInArrow(mark, schema), "parts-0")
    along = Window.partitionBy("row").orderBy("at")
    for k in count(1):
        # texts stay out of the windows
        stitch = F.when(F.col("at") == 0, F.lit(0).cast("long")).otherwise(F.array_min(F.array_intersect(F.lag("tail").over(along), "head")))
        starts = state.select("row", "at", "head", "tail").withColumn("start", stitch).select("row", "at", "start")
        starts = scratch.table(starts.withColumns({"end": F.lead("start").over(along), "group": F.sum(F.col("start").isNotNull().cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0))}), f"starts-{k}")
        if starts.where("start IS NULL").isEmpty():
            break
        grouped = state.join(starts.select("row", "at", "group"), ["row", "at"])
        sizes = starts.groupBy("row", "group").count()
        open_parts = grouped.join(sizes.where("count > 1").drop("count"), ["row", "group"])
        held = open_parts.groupBy("row", "group").agg(F.sort_array(F.collect_list(F.struct("at", "core", "last", "text"))).alias("held"))
        merged = held.select("row", "held").mapInArrow(merge, schema)
        settled = grouped.join(sizes.where("count = 1").drop("count"), ["row", "group"]).select(*state.columns)
        state = scratch.table(settled.unionByName(merged), f"parts-{k}")
        scratch.drop(f"parts-{k - 1}")
    placed = state.select("row", "at", "core", "last", "text").join(starts, ["row", "at"])
    first = (F.col("start") - F.col("at") + 1).cast("int")
    length = F.when(F.col("last"), F.lit(2**31 - 1)).otherwise((F.col("end") - F.col("start")).cast("int"))
    return placed.select("row", "at", F.substring("text", first, length).alias("text")).repartition("row", "at")


def decode(encoded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", vocab: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(id_col, ids, decoded)``: the raw bytes of the tokens, end to end; no character repair."""
    path, pattern = vocab or public_tokenizers.path(DEFAULT_VOCAB), pattern or public_tokenizers.PATTERN
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        import numpy as np

        encoding = load_encoding(path, pattern)
        for b in batches:
            raw = [encoding.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in b["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["id"], b["ids"], pa.array(raw, pa.binary())], names=["id", "ids", "decoded"])

    got = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {id_type}, ids binary, decoded binary")
    return got.select(F.col("id").alias(id_col), F.col("ids").alias(ids_col), "decoded")


def digests(docs: DataFrame) -> DataFrame:
    """The contract's row per document: number of ids, and SHA-256 of ids and of the decoded bytes."""
    back = decode(encode(docs))
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
