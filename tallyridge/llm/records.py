"""Token ids as length-delimited binary records with a separate offset index.

A shard is a run of frames. A frame is: payload length (unsigned 64 bits), masked CRC-32 of those
eight bytes, payload, masked CRC-32 of the payload; all little-endian. A payload is: whether the
document has an id (1 byte), its id (signed 64 bits), bytes per token (1 byte), then the tokens. The mask
rotates the checksum by 15 bits and adds a constant, so that a checksum of data that holds checksums stays useful.
The index of a shard has, per frame, its byte offset and its number of tokens (unsigned 64 bits
each), so that a reader can fetch frames in any order.

Shards hold ranges of ids in ascending order, rows without an id first; a null text counts as empty; repeated ids
are kept, ordered by the start of the text and a hash of it, and may lie in several shards. A shard is written under a name of its own and then moved, so that a task
that runs again, after the loss of an executor, replaces it with the same bytes.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyridge.llm.common import sized_batches
from tallyridge.llm.pieces import default_path, piece_encoder

MASK_DELTA = 0xA282EAD8
#: Leading characters of texts by which rows of one id are ordered first; a hash of the whole text comes next.
HEAD = 64
HEADER = struct.Struct("<?qB")
INDEX = struct.Struct("<QQ")


class BadRecord(ValueError):
    """A frame whose checksum does not fit."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def read_frame(source) -> bytes | None:
    """The payload that starts where ``source`` stands; None at its end."""
    head = source.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
        raise BadRecord("length")
    (size,) = struct.unpack("<Q", head[:8])
    payload, tail = source.read(size), source.read(4)
    if len(payload) < size or len(tail) < 4 or struct.unpack("<I", tail)[0] != masked(payload):
        raise BadRecord("payload")
    return payload


def pack_ids(doc_id: int | None, ids: np.ndarray) -> bytes:
    return HEADER.pack(doc_id is not None, doc_id or 0, ids.dtype.itemsize) + ids.tobytes()


def index_entry(offset: int, tokens: int) -> bytes:
    return INDEX.pack(offset, tokens)


def unpack_ids(payload: bytes) -> tuple[int | None, np.ndarray]:
    has, doc_id, width = HEADER.unpack_from(payload)
    return doc_id if has else None, np.frombuffer(payload, "<u2" if width == 2 else "<u4", offset=HEADER.size)


def write(docs: DataFrame, root: str, *, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, end_id: int | None = 0) -> list[dict]:
    """Encodes and writes every row; returns one entry per shard (few: one per partition)."""
    path = vocab or default_path()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))

    def put(batches):
        shard = TaskContext.get().partitionId()
        store, at = fs.FileSystem.from_uri(root)
        store.create_dir(at, recursive=True)
        name, own = f"{at}/shard-{shard:06d}", uuid.uuid4().hex
        encoder = piece_encoder(path)
        end = np.array([] if end_id is None else [end_id], encoder.dtype)
        count = tokens = offset = 0
        with store.open_output_stream(f"{name}.{own}.rec") as out, store.open_output_stream(f"{name}.{own}.idx") as index:
            for b in batches:
                ids, texts = b["id"].to_pylist(), b["text"].to_pylist()
                for lo in range(0, len(ids), 512):
                    for doc_id, got in zip(ids[lo : lo + 512], encoder.encode(texts[lo : lo + 512])):
                        data = frame(pack_ids(doc_id, got := np.concatenate((got, end))))
                        out.write(data)
                        index.write(index_entry(offset, len(got)))
                        offset, tokens, count = offset + len(data), tokens + len(got), count + 1
        if not count:
            for kind in ("rec", "idx"):
                store.delete_file(f"{name}.{own}.{kind}")
            return
        for kind in ("rec", "idx"):
            store.move(f"{name}.{own}.{kind}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pylist([{"shard": shard, "records": count, "tokens": tokens, "bytes": offset}])

    # one id may hold many rows, and one text too: ranges split them, by keys that stay short
    keyed = rows.withColumns({"head": F.substring("text", 1, HEAD), "hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange("id", "head", "hash", "row").sortWithinPartitions("id", "head", "hash", "text").select("id", "text")
    done = ordered.mapInArrow(put, "shard long, records long, tokens long, bytes long")
    return sorted((r.asDict() for r in done.collect()), key=lambda x: x["shard"])


def index_of(store: fs.FileSystem, name: str) -> np.ndarray:
    """A shard's byte offsets and numbers of tokens, a row per record."""
    with store.open_input_stream(f"{name}.idx") as f:
        return np.frombuffer(f.read(), "<u8").reshape(-1, 2).astype(np.int64)


def frames(root: str, shard: int, order: np.ndarray | None = None, index: np.ndarray | None = None) -> Iterator[tuple[int, int | None, np.ndarray]]:
    """(position in the shard, id, tokens): in the order of the file, or in the given order by way of the index, a read for each record."""
    store, at = fs.FileSystem.from_uri(root)
    name = f"{at}/shard-{shard:06d}"
    if order is None:
        with store.open_input_stream(f"{name}.rec", buffer_size=4 << 20) as source:
            k = 0
            while (payload := read_frame(source)) is not None:
                yield k, *unpack_ids(payload)
                k += 1
        return
    offsets = (index_of(store, name) if index is None else index)[:, 0]
    with store.open_input_file(f"{name}.rec") as source:
        ends = np.append(offsets[1:], source.size())
        for k in order:
            data = source.read_at(int(ends[k] - offsets[k]), int(offsets[k]))
            if (payload := read_frame(BytesIO(data))) is None:
                raise BadRecord("index")
            yield int(k), *unpack_ids(payload)


def read(spark: SparkSession, root: str, shards: list[dict], *, seed: int | None = None) -> DataFrame:
    """``(id, start, ids)`` of every record, one task per shard.

    ``start`` counts the tokens of all records before it. With ``seed`` the records of a shard are read through its index in a
    shuffled order, and the shards too; the rows are the same.
    """
    base, plan = 0, []
    for s in shards:
        plan.append((s["shard"], s["records"], base))
        base += s["tokens"]
    if seed is not None:
        np.random.default_rng(seed).shuffle(plan)
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def get(batches):
        def each():
            for b in batches:
                for x in b.to_pylist():
                    order = index = starts = None
                    if seed is not None:
                        store, at = fs.FileSystem.from_uri(root)
                        index = index_of(store, f"{at}/shard-{x['shard']:06d}")
                        starts = x["base"] + np.concatenate(([0], index[:-1, 1].cumsum()))
                        order = np.random.default_rng((seed, x["shard"])).permutation(len(index))
                    at = x["base"]
                    for k, doc_id, ids in frames(root, x["shard"], order, index):
                        wide = ids.astype("<u4").tobytes()
                        yield len(wide), (doc_id, at if starts is None else int(starts[k]), wide)
                        at += len(ids)

        return sized_batches(each(), schema)

    jobs = spark.createDataFrame(plan, "shard long, records long, base long")
    return jobs.repartition(max(1, len(plan))).mapInArrow(get, "id long, start long, ids binary")


def digests(spark: SparkSession, docs: DataFrame, root: str) -> DataFrame:
    """The contract's row per document, from the files, which are read in a shuffled order through their indexes."""
    back = read(spark, root, write(docs, root), seed=0)
    return back.select(F.col("id").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
