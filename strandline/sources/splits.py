"""Byte ranges of read files: how a file is cut, and the records of any range, plain, block-compressed or gzip.

A record belongs to the range in which its first byte lies, the very first byte excepted, which goes to the range before; so ranges
need not know of each other.  Where a FASTQ record begins is certain: only a header begins with @ and has a + two lines below.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

GRAIN = 4 << 20  # bytes that are counted as one, and the most that is skipped to align two files
SPLIT = 128 << 20  # bytes of a task's range
PIECE = 1 << 20  # bytes that are read at once
BLOCK_START = bytes.fromhex("1f8b08040000000000ff060042430200")  # fixed by the format
SCHEMES = ("file", "hdfs", "viewfs", "s3", "gs", "gcs", "abfs", "abfss")


class Range(NamedTuple):
    """A part of a file; first and n: number of its first record, and how many it holds, -1 if not counted."""

    file: str
    kind: str
    start: int
    end: int
    first: int = -1
    n: int = -1


def opened(path: str) -> tuple[pafs.FileSystem, str] | None:
    """The file system of a path, as tasks open it; None if only Spark's readers can."""
    if any(c in path for c in "*?{["):
        return None
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    if not scheme:
        return pafs.LocalFileSystem(), path
    if scheme[1] not in SCHEMES:
        return None
    if scheme[1] == "file":
        return pafs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    try:
        return pafs.FileSystem.from_uri(path)
    except (OSError, pa.ArrowException):
        return None


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme: without one it lies where the cluster keeps its files, which need not be this machine's disk."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) or any(c in path for c in "*?{["):
        return path
    context = spark.sparkContext
    found = context._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(found).toString()


def direct(spark: SparkSession, *paths: str) -> bool:
    """Whether tasks can open all of these, so that rows come in the files' order without a shuffle."""
    return all(opened(qualified(spark, p)) for p in paths)


def files(path: str | list[str]) -> list[tuple[str, int]]:
    """Name and size of a file, or of all in a folder but hidden ones, by name; of a list of these, one after the other."""
    if not isinstance(path, str):
        return [f for p in path for f in files(p)]
    fs, name = opened(path)
    info = fs.get_file_info(name)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [(path, info.size)]
    found = [f for f in fs.get_file_info(pafs.FileSelector(name)) if f.is_file and f.base_name[0] not in "._"]
    return [(f"{path.rstrip('/')}/{f.base_name}", f.size) for f in sorted(found, key=lambda f: f.base_name)]


def kind_of(path: str) -> str:
    fs, name = opened(path)
    with fs.open_input_file(name) as f:
        head = f.read(16)
    return "blocks" if head == BLOCK_START else "gzip" if head[:2] == b"\x1f\x8b" else "plain"


def cut(path: str | list[str], size: int = GRAIN) -> list[Range]:
    """All files of a path in ranges of about size bytes; a gzip file without blocks is one."""
    out = []
    for file, bytes_ in files(path):
        kind = kind_of(file)
        step = max(bytes_, 1) if kind == "gzip" else size
        out += [Range(file, kind, at, min(at + step, bytes_)) for at in range(0, bytes_, step)]
    return out


def blocks(f: pa.NativeFile, start: int, end: int, size: int) -> Iterator[tuple[bytes, bool]]:
    """The inflated blocks from the first that begins at start or after, with whether they begin before end."""
    held, at = b"", start

    def fill(n: int) -> bool:
        nonlocal held
        while len(held) < n and (more := f.read_at(min(PIECE, size - at - len(held)), at + len(held)) if at + len(held) < size else b""):
            held += more
        return len(held) >= n

    while start and not held.startswith(BLOCK_START):
        fill(PIECE)
        skip = held.find(BLOCK_START)
        if skip < 0 and at + len(held) >= size:
            return
        skip = skip if skip >= 0 else len(held) - len(BLOCK_START) + 1
        held, at = held[skip:], at + skip
    while fill(18):
        if held[:16] != BLOCK_START:
            raise ValueError("not a block")
        n = struct.unpack_from("<H", held, 16)[0] + 1
        if not fill(n):
            raise ValueError("the last block is cut off")
        yield zlib.decompress(held[18 : n - 8], -15), at < end
        held, at = held[n:], at + n
    if held:
        raise ValueError("the last block is cut off")


def stream(r: Range) -> Iterator[tuple[bytes, bool]]:
    """The bytes from a range's start on, in pieces, with whether they lie within it; goes on to the end of the file."""
    fs, name = opened(r.file)
    with fs.open_input_file(name) as f:
        if r.kind == "gzip":
            inflated = zlib.decompressobj(31)
            while data := f.read(PIECE):
                while data:
                    yield inflated.decompress(data), True
                    data = inflated.unused_data
                    if data:  # another member
                        inflated = zlib.decompressobj(31)
        elif r.kind == "blocks":
            group, inside = [], True
            for data, within in blocks(f, r.start, r.end, f.size()):
                if within != inside or sum(map(len, group)) >= PIECE:
                    yield b"".join(group), inside
                    group, inside = [], within
                group.append(data)
            if group:
                yield b"".join(group), inside
        else:
            for at in (*range(r.start, r.end, PIECE), *range(r.end, f.size(), PIECE >> 4)):
                inside = at < r.end
                yield f.read_at(min(PIECE, r.end - at) if inside else PIECE >> 4, at), inside


class Buffer:
    """What is read of a range so far, and where it stands."""

    def __init__(self, r: Range):
        self.source, self.data, self.at, self.end, self.over = stream(r), b"", 0, None, False

    def more(self) -> bool:
        """Another piece; false at the end of the file."""
        piece, inside = next(self.source, (None, False))
        if self.end is None and not inside:
            self.end = self.at + len(self.data)
        if piece is None:
            self.over = True
            return False
        self.data += piece
        return True

    def drop(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n

    def whole(self) -> list[bytes]:
        """Lines that are all there; at the end of the file also one without a line feed."""
        lines = self.data.split(b"\n")
        last = lines.pop()
        return lines + [last] if self.over and last else lines


def synced(lines: Buffer) -> bool:
    """Goes to the first record behind the first line feed; false if there is none."""
    while (n := lines.data.find(b"\n")) < 0:
        if not lines.more():
            return False
    lines.drop(n + 1)
    while len(got := lines.whole()) < 6 and lines.more():
        pass
    for k in range(min(4, len(got) - 2)):
        if got[k][:1] == b"@" and got[k + 2][:1] == b"+":
            lines.drop(sum(len(x) + 1 for x in got[:k]))
            return True
    if len(got) >= 6:
        raise ValueError(f"not a FASTQ record: {got[0][:80]!r}")
    return False


def records(r: Range) -> Iterator[list[bytes]]:
    """The records that belong to a range, in lists of lines, four a record."""
    lines = Buffer(r)
    if r.start and not synced(lines):
        return
    while True:
        while lines.end is None and len(lines.data) < PIECE and lines.more():
            pass
        got = lines.whole()
        n = len(got) // 4 * 4
        if lines.end is not None:  # only records that begin here or at the very end
            at, own = lines.at, 0
            while own < n and at <= lines.end:
                at += sum(len(x) + 1 for x in got[own : own + 4])
                own += 4
            if own == n and at <= lines.end and not lines.over:  # the last record goes on behind the end
                if own == 0:
                    lines.more()
                    continue
            elif own == n and at <= lines.end and any(got[n:]):
                raise ValueError(f"not a FASTQ record: {got[n][:80]!r}")
            n = own
        if n:
            part = got[:n]
            lines.drop(sum(map(len, part)) + n)
            yield [x.rstrip(b"\r") for x in part] if part[0].endswith(b"\r") else part
        elif lines.end is None:
            lines.more()  # one record longer than a piece
        if lines.end is not None and (lines.at > lines.end or lines.over):
            return


def check(lines: list[bytes]) -> None:
    for k in range(0, len(lines), 4):
        if lines[k][:1] != b"@" or lines[k + 2][:1] != b"+":
            raise ValueError(f"not a FASTQ record: {lines[k][:80]!r}")


def size_of(r: Range) -> int:
    """Records that belong to a range."""
    return sum(len(x) // 4 for x in records(r))


def count(spark: SparkSession, ranges: list[Range], first: int | None = None, how: Callable[[Range], int] = size_of) -> list[Range]:
    """The ranges with the numbers of their records, as ``how`` tells; only as many from the start as hold the first records, if that is given.

    Each file begins with a record.  The driver gets a number for each range, never a record: at GRAIN bytes each, 25,000 for 100 GB.
    """
    out: list[Range] = []
    at, step = 0, len(ranges) if first is None else 1
    while len(out) < len(ranges) and (first is None or at < first):
        part = ranges[len(out) : len(out) + step]
        step *= 2
        counts = dict(counted(spark, part, how))
        for k, r in enumerate(part):
            out.append(r._replace(first=at, n=counts[k]))
            at += counts[k]
    return out if first is None else [r for r in out if r.first < first]


def counted(spark: SparkSession, ranges: list[Range], how: Callable[[Range], int]) -> list[tuple[int, int]]:
    rows = [(k, *r[:4]) for k, r in enumerate(ranges)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                r = Range(row["file"], row["kind"], row["start"], row["end"])
                yield pa.RecordBatch.from_pydict({"k": [row["k"]], "n": [how(r)]})

    tasks = max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism))
    df = spark.createDataFrame(rows, "k long, file string, kind string, start long, end long").repartitionByRange(tasks, F.col("k"))
    return [tuple(x) for x in df.mapInArrow(run, "k long, n long").collect()]


def joined(ranges: list[Range], size: int) -> list[list[Range]]:
    """Neighbours put together up to size bytes."""
    out: list[list[Range]] = []
    room = 0
    for r in ranges:
        if not out or room < r.end - r.start:
            out.append([])
            room = size
        out[-1].append(r)
        room -= r.end - r.start
    return out
