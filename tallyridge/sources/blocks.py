"""Text tables in block-compressed files: read by many tasks, pruned by contig.

Such a file is a row of gzip members of at most 64 KiB of text each, whose headers say how long they are, so that reading can begin at any of them. A reader takes ranges of
bytes: it begins at the first member that starts in its range and, as a line may run over members, with the first line that begins behind a line's end there; it ends with the line that
is open where its range ends. An index beside the file (``.tbi``) says which members hold a contig; a filter by contig then reads these alone.

    register(spark)
    spark.read.format("block_bed").schema("contig string, start long, end long, cnt long").load("cuts.bed.gz").where("contig = 'chr1'")

Paths go through Arrow's file systems. Columns are those of the schema, in order; missing and empty ones are null, lines that start with # are none.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

#: Text of a member, and the empty member that ends a file.
MEMBER, END = 0xFF00, bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
HEADER = b"\x1f\x8b\x08\x04"
#: Bytes of a member's header with its length, and of the longest member.
HEAD, MOST = 18, 1 << 16
#: Lines handed to Spark together.
LINES = 20_000


def member(text: bytes) -> bytes:
    """A gzip member that tells its own length."""
    press = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = press.compress(text) + press.flush()
    head = HEADER + b"\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + HEAD + 8 - 1)
    return head + body + struct.pack("<II", zlib.crc32(text), len(text))


def length_of(head: bytes) -> int | None:
    """Bytes of the member whose header this is; None if it is none."""
    if len(head) < HEAD or head[:4] != HEADER or head[12:16] != b"BC\x02\0" or head[10:12] != b"\x06\0":
        return None
    return struct.unpack_from("<H", head, 16)[0] + 1


def first_member(file, at: int, end: int) -> int | None:
    """Where the first member from ``at`` on starts, before ``end``; one is known by the header that follows it, or the file's end."""
    size = file.size()
    file.seek(at)
    held = file.read(min(MOST + HEAD, size - at))
    k = held.find(HEADER)
    while 0 <= k and at + k < end:
        length = length_of(held[k : k + HEAD])
        if length:
            file.seek(at + k + length)
            if at + k + length == size or length_of(file.read(HEAD)):
                return at + k
        k = held.find(HEADER, k + 1)
    return None


def members(file, at: int) -> Iterator[tuple[int, bytes]]:
    """(start, text) of members from one on."""
    size = file.size()
    file.seek(at)
    while at < size:
        head = file.read(HEAD)
        length = length_of(head)
        if length is None:
            raise ValueError(f"no member of a block-compressed file at byte {at}")
        rest = file.read(length - HEAD)
        yield at, zlib.decompress(rest[:-8], -15)
        at += length


@dataclass
class Part(InputPartition):
    """Members that start in [start, end). ``inside`` is where to begin in the first one, -1: behind the first line's end; ``last`` is where a contig's rows end, as
    (start of the member, characters of it), None: with the line that is open at the end."""

    path: str
    start: int
    end: int
    inside: int = 0
    last: tuple[int, int] | None = None


def lines(file, part: Part) -> Iterator[bytes]:
    """Lines of a part; of parts end to end, every line once."""
    at = part.start if part.inside >= 0 else first_member(file, part.start, part.end)
    if at is None or at >= part.end:
        return
    rest, skip, cut = b"", part.inside < 0, max(0, part.inside)
    for place, text in members(file, at):
        if place >= part.end:
            # the line that is open, or that begins just here
            head, mark, _ = text.partition(b"\n")
            rest += head
            if mark:
                break
            continue
        ends = part.last is not None and place == part.last[0]
        rest, cut = rest + (text[cut : part.last[1]] if ends else text[cut:]), 0
        whole, mark, rest = rest.rpartition(b"\n")
        if mark:
            found = whole.split(b"\n")
            yield from found[1:] if skip else found
            skip = False
        if ends:
            break
    if rest and not skip:
        yield rest


def contig_ranges(index: bytes) -> dict[str, tuple[int, int]]:
    """Where the rows of each contig begin and end, from an index of positions: a member's start, and above it 16 bits for a place in its text."""
    data = gzip.decompress(index)
    if data[:4] != b"TBI\x01":
        raise ValueError("no index of positions")
    count, *_, names_length = struct.unpack_from("<8i", data, 4)
    names, at, found = data[36 : 36 + names_length].split(b"\0"), 36 + names_length, {}
    for k in range(count):
        (bins,) = struct.unpack_from("<i", data, at)
        at += 4
        low, high = None, 0
        for _ in range(bins):
            number, chunks = struct.unpack_from("<Ii", data, at)
            at += 8
            for c in range(chunks):
                begin, stop = struct.unpack_from("<QQ", data, at + 16 * c)
                if number != 37450:  # that one holds counts
                    low, high = begin if low is None else min(low, begin), max(high, stop)
            at += 16 * chunks
        (intervals,) = struct.unpack_from("<i", data, at)
        at += 4 + 8 * intervals
        if low is not None:
            found[names[k].decode()] = (low, high)
    return found


def bin_of(start: int, end: int) -> int:
    """The smallest stretch, of 2^14 positions up to 2^29, that holds an interval."""
    end -= 1
    for shift, offset in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == end >> shift:
            return offset + (start >> shift)
    return 0


class Index:
    """Collects rows in order and writes the index."""

    def __init__(self):
        self.bins: dict[str, dict[int, list[list[int]]]] = {}
        self.linear: dict[str, list[int]] = {}

    def add(self, contig: str, start: int, end: int, begin: int, stop: int) -> None:
        chunks = self.bins.setdefault(contig, {}).setdefault(bin_of(start, max(end, start + 1)), [])
        if chunks and chunks[-1][1] == begin:
            chunks[-1][1] = stop
        else:
            chunks.append([begin, stop])
        windows = self.linear.setdefault(contig, [])
        windows += [begin] * ((max(end - 1, start) >> 14) + 1 - len(windows))

    def to_bytes(self) -> bytes:
        names = b"".join(c.encode() + b"\0" for c in self.bins)
        out = [b"TBI\x01", struct.pack("<8i", len(self.bins), 0x10000, 1, 2, 3, ord("#"), 0, len(names)), names]
        for contig, bins in self.bins.items():
            out.append(struct.pack("<i", len(bins)))
            for number, chunks in sorted(bins.items()):
                out.append(struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
            out.append(struct.pack("<i", len(self.linear[contig])) + struct.pack(f"<{len(self.linear[contig])}Q", *self.linear[contig]))
        data = b"".join(out)
        return b"".join(member(data[k : k + MEMBER]) for k in range(0, len(data), MEMBER)) + END


def opened(path: str):
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


class Reader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.path, self.split, self.contigs = schema, options["path"], int(options.get("split_bytes", 32 << 20)), None

    def pushFilters(self, filters):
        """Filters by contig choose members; Spark still applies them."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == (self.schema.names[0],):
                some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.contigs = some if self.contigs is None else self.contigs & some
            yield f

    def partitions(self):
        fs, root = opened(self.path)
        info = fs.get_file_info(root)
        if info.type == pa.fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else sorted((i for i in fs.get_file_info(pa.fs.FileSelector(root)) if i.is_file and i.path.endswith(".gz") and not i.base_name.startswith(("_", "."))), key=lambda i: i.path)
        prefix = self.path[: -len(root)] if self.path.endswith(root) else "file://" if self.path.startswith("file:") else ""
        parts = []
        for f in files:
            spans = [(0, f.size, 0, None)]
            if self.contigs is not None and fs.get_file_info(f.path + ".tbi").is_file:
                with fs.open_input_file(f.path + ".tbi") as index:
                    ranges = contig_ranges(index.read())
                spans = [(lo >> 16, min((hi >> 16) + 1, f.size), lo & 0xFFFF, (hi >> 16, hi & 0xFFFF)) for c, (lo, hi) in ranges.items() if c in self.contigs]
            for lo, hi, inside, last in spans:
                for at in range(lo, hi, self.split):
                    end = min(at + self.split, hi)
                    parts.append(Part(prefix + f.path, at, end, inside if at == lo else -1, last if end == hi else None))
        return parts or [Part("", 0, 0)]

    def read(self, part):
        if not part.path:
            return
        kinds = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32()}[f.dataType.simpleString()]) for f in self.schema])
        fs, path = opened(part.path)
        with fs.open_input_file(path) as file:
            held: list[list] = []
            for line in lines(file, part):
                if line and not line.startswith(b"#"):
                    cells = line.rstrip(b"\r").decode().split("\t")
                    held.append([c or None for c in cells[: len(kinds)]] + [None] * (len(kinds) - len(cells)))
                if len(held) == LINES:
                    yield batch(held, kinds)
                    held = []
            if held:
                yield batch(held, kinds)


def batch(rows: list[list], kinds: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, pa.string()).cast(f.type) for c, f in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns, schema=kinds)


@dataclass
class Written(WriterCommitMessage):
    name: str


class Writer(DataSourceWriter):
    """A file with its index for each task, of rows in the order they come; the first three columns are contig, start and end."""

    def __init__(self, options, overwrite):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite

    def write(self, rows):
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        # names of attempts differ, so that a repeated task cannot spoil the file of another
        name = f".part-{context.partitionId():05d}-{context.taskAttemptId()}"
        index, text, marks, at = Index(), bytearray(), [], 0
        with fs.open_output_stream(f"{root}/{name}.bed.gz", compression=None) as out:

            def flush() -> None:
                """A member of whole lines; marks are rows with their first and last byte in it."""
                nonlocal at, text, marks
                packed = member(bytes(text))
                for contig, start, end, first, last in marks:
                    index.add(contig, start, end, at << 16 | first, at << 16 | last)
                out.write(packed)
                at, text, marks = at + len(packed), bytearray(), []

            for row in rows:
                line = "\t".join("" if c is None else str(c) for c in row).encode() + b"\n"
                if text and len(text) + len(line) > MEMBER:
                    flush()
                if len(line) <= MEMBER:
                    marks.append((row[0], row[1], row[2], len(text), len(text) + len(line)))
                    text += line
                    continue
                begin = at << 16
                for k in range(0, len(line), MEMBER):  # one that runs over several members
                    packed, stop = member(line[k : k + MEMBER]), at << 16 | len(line[k : k + MEMBER])
                    out.write(packed)
                    at += len(packed)
                index.add(row[0], row[1], row[2], begin, stop)
            if text:
                flush()
            out.write(END)
        with fs.open_output_stream(f"{root}/{name}.bed.gz.tbi", compression=None) as out:
            out.write(index.to_bytes())
        return Written(name)

    def commit(self, messages):
        fs, root = opened(self.path)
        if self.overwrite:
            kept = {f"{m.name}{end}" for m in messages if m for end in (".bed.gz", ".bed.gz.tbi")}
            for f in fs.get_file_info(pa.fs.FileSelector(root)):
                if f.is_file and f.base_name not in kept:
                    fs.delete_file(f.path)
        for m in messages:
            for end in (".bed.gz.tbi", ".bed.gz"):
                fs.move(f"{root}/{m.name}{end}", f"{root}/{m.name.lstrip('.')}{end}")

    def abort(self, messages):
        fs, root = opened(self.path)
        for m in messages:
            for end in (".bed.gz", ".bed.gz.tbi"):
                if m and fs.get_file_info(f"{root}/{m.name}{end}").is_file:
                    fs.delete_file(f"{root}/{m.name}{end}")


class BlockBed(DataSource):
    """Options: ``path``, and ``split_bytes``, the compressed bytes of a partition."""

    @classmethod
    def name(cls):
        return "block_bed"

    def schema(self):
        return "contig string, start long, end long"

    def reader(self, schema):
        return Reader(schema, self.options)

    def writer(self, schema, overwrite):
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, whose filters then reach sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BlockBed)
