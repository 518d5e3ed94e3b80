"""BAM files as a data source: `spark.read.format("bam").load(path)` and `df.write.format("bam")`.

A file is a run of BGZF blocks, which are gzip members that say how long they are. Partitions are byte ranges; a task finds the
first block that begins in its range by its header and by what follows it, and the first record in it by records that follow one
another, and reads all records that begin in its blocks. No index is needed, and no task reads another's blocks but
for the end of a last record. Filters on chrom, pos, mapq and flag are tried on the fixed fields before a record is decoded.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from urllib.parse import urlparse

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "name string, flag int, chrom string, pos bigint, mapq int, cigar string, mate_chrom string, mate_pos bigint, tlen bigint, seq string, qual string"
# BGZF and BAM layout.
BLOCK_HEADER, END_BLOCK = b"\x1f\x8b\x08\x04", bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
FIXED = struct.Struct("<iiBBHHHiiii")  # ref, pos, name length, mapq, bin, cigar operations, flag, letters, mate's ref, mate's pos, tlen
LETTERS, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
MOST_IN_BLOCK, FOLLOWING = 0xFF00, 5
RANGE = 32 << 20  # bytes of a partition


# ------------------------------------------------------------------ blocks
def to_block(data: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    head = BLOCK_HEADER + struct.pack("<IBBHBBHH", 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def block_size(head: bytes) -> int | None:
    """Bytes of the block that begins here, from its first 18 ones; None where none does."""
    if len(head) < 18 or head[:4] != BLOCK_HEADER or head[10:16] != b"\x06\x00BC\x02\x00":
        return None
    return int.from_bytes(head[16:18], "little") + 1


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """Where a path or URI lies, and its name there."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), urlparse(path).path
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Blocks:
    """A file's blocks by their places, the last ones inflated kept."""

    def __init__(self, path: str):
        where, name = file_system(path)
        self.file, self.size = where.open_input_file(name), where.get_file_info(name).size

    def raw(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(min(n, max(0, self.size - at)))

    def first(self, at: int) -> int:
        """Where the first block at or behind `at` begins: a header whose length leads to another one, or to the end."""
        window = 1 << 17
        while at < self.size:
            data, k = self.raw(at, window), -1
            while (k := data.find(BLOCK_HEADER, k + 1)) >= 0:
                size = block_size(self.raw(at + k, 18))
                if size and (at + k + size == self.size or block_size(self.raw(at + k + size, 18))):
                    return at + k
            at += max(1, len(data) - 3)
        return self.size

    def block(self, at: int) -> tuple[bytes, int]:
        """(content, where the next block begins)."""
        size = block_size(self.raw(at, 18))
        if size is None:
            raise ValueError(f"no BGZF block at {at}")
        data = self.raw(at, size)
        return zlib.decompress(data[18:-8], -15), at + size


class Stream:
    """Content from a block on, with the block that each place lies in; more is read as it is needed."""

    def __init__(self, blocks: Blocks, at: int):
        self.blocks, self.next, self.data, self.offset = blocks, at, b"", 0
        self.starts: list[tuple[int, int]] = []  # (place in the stream, block)

    def have(self, n: int) -> bool:
        while len(self.data) - self.offset < n and self.next < self.blocks.size:
            content, behind = self.blocks.block(self.next)
            self.starts.append((self.place() + len(self.data) - self.offset, self.next))
            self.data = self.data[self.offset :] + content
            self.base = self.place()
            self.offset, self.next = 0, behind
        return len(self.data) - self.offset >= n

    base = 0

    def place(self) -> int:
        return self.base + self.offset

    def block_here(self) -> int:
        while len(self.starts) > 1 and self.starts[1][0] <= self.place():
            self.starts.pop(0)
        return self.starts[0][1]

    def peek(self, n: int, skip: int = 0) -> bytes:
        self.have(n + skip)
        return self.data[self.offset + skip : self.offset + skip + n]

    def take(self, n: int) -> bytes:
        if not self.have(n):
            raise ValueError("the file ends inside a record")
        self.offset += n
        return self.data[self.offset - n : self.offset]


# ------------------------------------------------------------------ records
def read_header(stream: Stream) -> list[tuple[str, int]]:
    if stream.take(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    stream.take(struct.unpack("<i", stream.take(4))[0])
    contigs = []
    for _ in range(struct.unpack("<i", stream.take(4))[0]):
        name = stream.take(struct.unpack("<i", stream.take(4))[0])[:-1].decode()
        contigs.append((name, struct.unpack("<i", stream.take(4))[0]))
    return contigs


def looks_like_record(stream: Stream, skip: int, contigs: list[tuple[str, int]]) -> int | None:
    """The size of a record that may begin `skip` bytes further, its length field included; None where none can."""
    head = stream.peek(36, skip)
    if len(head) < 36:
        return None
    size = int.from_bytes(head[:4], "little", signed=True)
    ref, pos, name, _, _, n_ops, _, letters, mate, mate_pos, _ = FIXED.unpack(head[4:])
    good = -1 <= ref < len(contigs) and -1 <= mate < len(contigs) and pos >= -1 and mate_pos >= -1 and name > 0 and letters >= 0
    good = good and (ref < 0 or pos < contigs[ref][1]) and size >= 32 + name + 4 * n_ops + (letters + 1) // 2 + letters
    if not good:
        return None
    text = stream.peek(name, skip + 36)
    return size + 4 if len(text) == name and text[-1] == 0 and all(33 <= c <= 126 for c in text[:-1]) else None


def find_record(stream: Stream, contigs: list[tuple[str, int]]) -> bool:
    """Moves to the first place from which records follow one another."""
    skip = 0
    while stream.have(skip + 36):
        at, n = skip, 0
        while n < FOLLOWING and (size := looks_like_record(stream, at, contigs)):
            at, n = at + size, n + 1
        if n == FOLLOWING or n and not stream.have(at + 1):
            stream.take(skip)
            return True
        skip += 1
    return False


def decoded(body: bytes, contigs: list[tuple[str, int]], fixed: tuple) -> tuple:
    ref, pos, name, mapq, _, n_ops, flag, letters, mate, mate_pos, tlen = fixed
    at = 32 + name
    ops = struct.unpack_from(f"<{n_ops}I", body, at)
    at += 4 * n_ops
    half = (letters + 1) // 2
    seq = "".join(LETTERS[b >> 4] + LETTERS[b & 15] for b in body[at : at + half])[:letters]
    qual = body[at + half : at + half + letters]
    named = lambda r: contigs[r][0] if r >= 0 else None
    return (
        body[32 : 31 + name].decode(), flag, named(ref), pos if pos >= 0 else None, mapq, "".join(f"{op >> 4}{OPERATIONS[op & 15]}" for op in ops) or None,
        named(mate), mate_pos if mate_pos >= 0 else None, tlen, seq or None, None if not letters or qual[0] == 255 else "".join(chr(q + 33) for q in qual),
    )


def encoded(row, index: dict[str, int]) -> bytes:
    name = (row["name"] or "*").encode() + b"\0"
    cigar, number = [], ""
    for c in row["cigar"] or "":
        if c.isdigit():
            number += c
        else:
            cigar.append(int(number) << 4 | OPERATIONS.index(c))
            number = ""
    seq = row["seq"] or ""
    codes = [max(0, LETTERS.find(c)) for c in seq] + [0] * (len(seq) % 2)
    qual = bytes(ord(c) - 33 for c in row["qual"]) if row["qual"] else b"\xff" * len(seq)
    here = lambda c: index[row[c]] if row[c] is not None else -1
    none = lambda v, d=-1: d if v is None else v
    fixed = FIXED.pack(here("chrom"), none(row["pos"]), len(name), none(row["mapq"], 255), 0, len(cigar), none(row["flag"], 0), len(seq), here("mate_chrom"), none(row["mate_pos"]), none(row["tlen"], 0))
    body = fixed + name + struct.pack(f"<{len(cigar)}I", *cigar) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2])) + qual
    return struct.pack("<i", len(body)) + body


def header_of(contigs: list[tuple[str, int]]) -> bytes:
    text = "".join(["@HD\tVN:1.6\n", *(f"@SQ\tSN:{n}\tLN:{k}\n" for n, k in contigs)]).encode()
    refs = b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k) for n, k in contigs)
    return b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(contigs)) + refs


# ------------------------------------------------------------------ the source
@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class BamReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.path, self.bytes = options["path"], int(options.get("rangeBytes", RANGE))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        names = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if type(f) in names and len(f.attribute) == 1 and f.attribute[0] in ("chrom", "pos", "mapq", "flag") and (f.attribute[0] != "chrom" or type(f) is EqualTo):
                self.tests.append((f.attribute[0], names[type(f)], f.value))
            else:
                yield f

    def partitions(self):
        where, name = file_system(self.path)
        info, scheme = where.get_file_info(name), self.path[: len(self.path) - len(name)] if self.path.endswith(name) else ""
        files = [info] if info.is_file else [f for f in where.get_file_info(fs.FileSelector(name)) if f.path.endswith(".bam")]
        return [Range(scheme + f.path, at, min(at + self.bytes, f.size)) for f in files for at in range(0, f.size, self.bytes)]

    def read(self, partition: Range) -> Iterator[tuple]:
        blocks = Blocks(partition.path)
        head = Stream(blocks, 0)
        contigs = read_header(head)
        if partition.start <= (head.block_here() if head.have(1) else blocks.size):
            stream = head  # the first records follow the header
        else:
            at = blocks.first(partition.start)
            if at >= partition.end:
                return
            stream = Stream(blocks, at)
            if not find_record(stream, contigs):
                return
        wanted = _wanted(self.tests, contigs)
        while stream.have(4) and (here := stream.block_here()) < partition.end:
            body = stream.take(struct.unpack("<i", stream.take(4))[0])
            fixed = FIXED.unpack_from(body)
            if here >= partition.start and wanted(fixed):
                yield decoded(body, contigs, fixed)


def _wanted(tests: list[tuple[str, str, object]], contigs: list[tuple[str, int]]):
    index = {name: i for i, (name, _) in enumerate(contigs)}
    compare = {"==": lambda a, b: a == b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}
    place = {"chrom": 0, "pos": 1, "mapq": 3, "flag": 6}
    made = [(place[c], compare[op], index.get(v, -2) if c == "chrom" else v, c == "pos") for c, op, v in tests]
    return lambda fixed: all(op(fixed[i], v) and (not is_pos or fixed[i] >= 0) for i, op, v, is_pos in made)


@dataclass
class Written(WriterCommitMessage):
    path: str


class BamWriter(DataSourceWriter):
    def __init__(self, options: Mapping[str, str]):
        self.path, self.contigs = options["path"], [(n, int(k)) for n, k in (x.rsplit(":", 1) for x in options["contigs"].split(","))]

    def write(self, iterator) -> Written:
        where, folder = file_system(self.path)
        where.create_dir(folder, recursive=True)
        name, index = f"{folder}/part-{uuid.uuid4().hex}.bam", {n: i for i, (n, _) in enumerate(self.contigs)}
        held = header_of(self.contigs)
        with where.open_output_stream(name + ".tmp") as out:
            for row in iterator:
                held += encoded(row, index)
                while len(held) >= MOST_IN_BLOCK:
                    out.write(to_block(held[:MOST_IN_BLOCK]))
                    held = held[MOST_IN_BLOCK:]
            out.write((to_block(held) if held else b"") + END_BLOCK)
        return Written(name)

    def commit(self, messages) -> None:
        """Files get their names when all are there, so a failed or repeated task leaves none behind."""
        where, _ = file_system(self.path)
        for m in messages:
            if m is not None:
                where.move(m.path + ".tmp", m.path)

    def abort(self, messages) -> None:
        pass


class BamSource(DataSource):
    """Options: path (a file or a folder of .bam files), rangeBytes; to write also contigs, `name:length,...`."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)

    def writer(self, schema, overwrite: bool) -> BamWriter:
        return BamWriter(self.options)


def register(spark: SparkSession) -> SparkSession:
    """Makes `bam` a format of the session, with filters handed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamSource)
    return spark
