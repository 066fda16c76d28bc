"""BAM files as tables and back, with zlib and struct alone.

Files that tasks can open are read through the ``bam`` data source, in ranges of blocks, each inflated once; what only Spark's own
readers can open comes as text that the blocks' first bytes part.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from . import splits as ranges

SCHEMA = "rec_idx long, qname string, flag int, pos int, mapq int, mpos int, seq string, qual string, tags map<string,struct<type:string,value:string>>, ref int, cigar string, mref int, tlen int"
TAG = pa.struct([("type", pa.string()), ("value", pa.string())])
ARROW = pa.schema(
    [("rec_idx", pa.int64()), ("qname", pa.string()), *((n, pa.int32()) for n in ("flag", "pos", "mapq", "mpos")), ("seq", pa.string()), ("qual", pa.string()), ("tags", pa.map_(pa.string(), TAG)), ("ref", pa.int32()), ("cigar", pa.string()), ("mref", pa.int32()), ("tlen", pa.int32())]
)
MATES = "a struct<" + SCHEMA.replace("> ", ">").replace(", ", ",").replace(" ", ":") + ">"
MATES = f"{MATES}, b{MATES[1:]}"
MATES_ARROW = pa.schema([("a", pa.struct(list(ARROW))), ("b", pa.struct(list(ARROW)))])
BASES = "=ACMGRSVTWYHKDBN"  # fixed by the format
TWO_BASES = [a + b for a in BASES for b in BASES]
SHOWN = bytes((q + 33) & 255 for q in range(256))  # qualities as text
CIGAR = "MIDNSHP=X"  # fixed by the format
NUMBERS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}
EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")  # fixed by the format
MAGIC = EOF[:16]  # every block begins so
BLOCK = 60_000
ROWS = 2048
LEAST = 1 << 16  # bytes of a task at least
PART = 1 << 22  # bytes that a split is parsed in
CHAIN = 40  # records that must follow each other where a split is entered


def inflate(raw: bytes) -> bytes:
    """Blocks one after another, each by the size that its header tells."""
    out, at = [], 0
    while at < len(raw):
        if raw[at : at + 16] == MAGIC:
            size = struct.unpack_from("<H", raw, at + 16)[0] + 1
            out.append(zlib.decompress(raw[at + 18 : at + size - 8], -15))
        else:  # another header: as any gzip member
            d = zlib.decompressobj(31)
            out.append(d.decompress(raw[at:]))
            size = len(raw) - at - len(d.unused_data)
            if not size:
                break
        at += size
    return b"".join(out)


def deflate(data: bytes, level: int = 6) -> bytes:
    """Blocks of the blocked gzip format."""
    out = []
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK]
        c = zlib.compressobj(level, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        size = len(body) + 25
        out.append(MAGIC + struct.pack("<H", size) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def split_header(data: bytes) -> tuple[str, bytes, int]:
    """Text, the binary reference table, and where records begin."""
    if data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    n = struct.unpack_from("<i", data, 4)[0]
    text = data[8 : 8 + n].rstrip(b"\0").decode()
    at = start = 8 + n
    count = struct.unpack_from("<i", data, at)[0]
    at += 4
    for _ in range(count):
        at += 8 + struct.unpack_from("<i", data, at)[0]
    return text, data[start:at], at


def read_tags(data: bytes) -> dict[str, dict]:
    out, at = {}, 0
    while at < len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in NUMBERS:
            fmt = NUMBERS[kind]
            value = repr(struct.unpack_from(fmt, data, at)[0])
            at += struct.calcsize(fmt)
        elif kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind in "ZH":
            end = data.index(0, at)
            value, at = data[at:end].decode(), end + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            fmt = f"<{n}{NUMBERS[sub][1]}"
            value = ",".join([sub, *map(repr, struct.unpack_from(fmt, data, at + 5))])
            at += 5 + struct.calcsize(fmt)
        else:
            raise ValueError(f"tag {name} has the unknown type {kind}")
        out[name] = {"type": kind, "value": value}
    return out


def write_tags(tags: dict[str, dict]) -> bytes:
    out = []
    for name, t in tags.items():
        kind, value = t["type"], t["value"]
        out.append(name.encode() + kind.encode())
        if kind in NUMBERS:
            out.append(struct.pack(NUMBERS[kind], float(value) if kind == "f" else int(value)))
        elif kind == "A":
            out.append(value.encode())
        elif kind in "ZH":
            out.append(value.encode() + b"\0")
        else:
            sub, *items = value.split(",")
            numbers = [float(x) if sub == "f" else int(x) for x in items]
            out.append(sub.encode() + struct.pack("<i", len(items)) + struct.pack(f"<{len(items)}{NUMBERS[sub][1]}", *numbers))
    return b"".join(out)


def parse(data: bytes, at: int) -> Iterator[dict]:
    """Records of an inflated file; qualities as text at offset 33, * if they are missing."""
    while at < len(data):
        size = struct.unpack_from("<i", data, at)[0]
        ref, pos, name_len, mapq, _, cigars, flag, bases, mref, mpos, tlen = struct.unpack_from("<iiBBHHHiiii", data, at + 4)
        p = at + 36
        name = data[p : p + name_len - 1].decode()
        p += name_len
        cigar = "".join(f"{c >> 4}{CIGAR[c & 15]}" for c in struct.unpack_from(f"<{cigars}I", data, p))
        p += 4 * cigars
        half = (bases + 1) // 2
        seq = "".join(map(TWO_BASES.__getitem__, data[p : p + half]))[:bases]
        p += half
        q = data[p : p + bases]
        qual = "*" if bases and q[0] == 255 else q.translate(SHOWN).decode("latin-1")
        p += bases
        yield {"qname": name, "flag": flag, "pos": pos, "mapq": mapq, "mpos": mpos, "seq": seq, "qual": qual, "tags": read_tags(data[p : at + 4 + size]), "ref": ref, "cigar": cigar, "mref": mref, "tlen": tlen}
        at += 4 + size


def encode(r: dict) -> bytes:
    """A record with its alignment, if it has one."""
    seq, name = r["seq"], r["qname"].encode() + b"\0"
    codes = [BASES.index(b) for b in seq] + [0] * (len(seq) % 2)
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
    qual = b"\xff" * len(seq) if r["qual"] == "*" else bytes(ord(c) - 33 for c in r["qual"])
    steps = [(int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", r.get("cigar") or "")]
    pos = r["pos"]
    ref, mref, tlen = (r.get(k, d) for k, d in (("ref", -1), ("mref", -1), ("tlen", 0)))
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name), r["mapq"], index_bin(pos, sum(n for n, op in steps if op in "MDN=X")), len(steps), r["flag"], len(seq), mref, r["mpos"], tlen)
    body += name + struct.pack(f"<{len(steps)}I", *(n << 4 | CIGAR.index(op) for n, op in steps)) + packed + qual + write_tags(r["tags"] or {})
    return struct.pack("<i", len(body)) + body


def index_bin(pos: int, length: int) -> int:
    """The smallest bin of the format's index (16 kb, and five times eightfold) that holds an alignment."""
    begin, end = pos, pos + max(length, 1) - 1
    for bits, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> bits == end >> bits:
            return first + (begin >> bits)
    return 0


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """file, start, value, id: the blocks of BAM files without their first bytes, in the order of id within each split.

    Every block begins with the same 16 bytes; they part the lines of a text, so Spark's reader cuts files of any size into splits
    at block bounds.
    """
    text = spark.read.format("text").option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).load(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))


def opened(value: bytes) -> bytes:
    """The content of a block without its first bytes."""
    if len(value) < 10 or struct.unpack_from("<H", value)[0] + 1 != len(value) + len(MAGIC):
        raise ValueError("not a block of a BAM file")
    return zlib.decompress(value[2:-8], -15)


def plausible(data: bytes, at: int) -> int:
    """Where the next record begins, if there can be one here; len(data) or more if it is not all there, else -1."""
    if at + 36 > len(data):
        return len(data)
    size, ref, pos, name_len, _, _, cigars, _, bases, mref, mpos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if min(ref, pos, mref, mpos) < -1 or name_len < 1 or bases < 0 or size < 32 + name_len + 4 * cigars + (bases + 1) // 2 + bases or size > 1 << 28:
        return -1
    name = data[at + 36 : at + 36 + name_len]
    if len(name) == name_len and (name[-1] != 0 or any(c < 33 or c > 126 for c in name[:-1])):
        return -1
    return at + 4 + size


def first_record(data: bytes, last: bool) -> int:
    """Where the first record begins in a split that may begin inside one: the first place from which CHAIN records, or all that
    there are, follow each other; -1 if more data are wanted (if last, the file ends here: all must fit exactly)."""
    for at in range(len(data) - 35):
        p = at
        for _ in range(CHAIN):
            p = plausible(data, p) if not last or p + 36 <= len(data) else len(data) + 1
            if p < 0 or p >= len(data):
                break
        if p >= len(data) and not last:
            return -1
        if 0 <= p <= len(data):
            return at
    return len(data) if last else -1


def splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(number, head, records, rest) of the splits of a task, in parts: head is what stands before a split's first record, rest what is
    left after its last.  The lowest bit of an incoming number tells that the split begins a file, whose header is skipped."""
    number, held, synced = -1, b"", False

    def cut_up(last: bool) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        nonlocal held, synced
        head = b""
        if not synced:
            at = first_record(held, last) if number & 1 == 0 else header_end(held, last)
            if at < 0:
                return
            head, held, synced = (held[:at] if number & 1 == 0 else b""), held[at:], True
        end = 0
        while end + 4 <= len(held) and (n := end + 4 + struct.unpack_from("<i", held, end)[0]) <= len(held):
            end = n
        yield number >> 1, head, held[:end], held[end:] if last else b""
        held = held[end:]

    for batch in batches:
        for n, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if n != number:
                if number >= 0:
                    yield from cut_up(True)
                number, held, synced = n, b"", False
            held += opened(value)
            if len(held) >= PART:
                yield from cut_up(False)
    if number >= 0:
        yield from cut_up(True)


def header_end(data: bytes, last: bool) -> int:
    try:
        return split_header(data)[2]
    except (struct.error, IndexError):
        if last:
            raise ValueError("the header is longer than a split") from None
        return -1


def rows_of(number: int, at: int, data: bytes) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    for r in parse(data, 0):
        rows.append({"rec_idx": (number << 32) + at, **r, "tags": list(r["tags"].items())})
        at += 1
        if len(rows) == ROWS:
            yield pa.RecordBatch.from_pylist(rows, ARROW)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, ARROW)


def header_dropped(held: ranges.Buffer) -> tuple[str, bytes]:
    """Header text and reference table of a file, which goes on with its records."""
    while len(held.data) < 12 and held.more():
        pass
    while True:
        try:
            text, table, n = split_header(held.data)
            break
        except (struct.error, IndexError):
            if not held.more():
                raise ValueError("not a BAM file") from None
    held.drop(n)
    return text, table


def whole_records(r: ranges.Range) -> Iterator[bytes]:
    """The records that begin in a range, in parts.

    The range finds its first record by the form of records; the last one may go on behind its end, where what the next range will
    find must be what is left here, or it is an error.
    """
    held = ranges.Buffer(r)
    if r.start:
        while (at := first_record(held.data, held.over)) < 0:
            held.more()
        held.drop(at)
    else:
        header_dropped(held)
    behind = b""
    while True:
        while held.end is None and len(held.data) < PART and held.more():
            pass
        data, end = held.data, 0
        while end + 4 <= len(data) and (held.end is None or held.at + end < held.end) and (n := end + 4 + struct.unpack_from("<i", data, end)[0]) <= len(data):
            end = n
        if end:
            behind = data[max(0, held.end - held.at) : end] if held.end is not None else b""
            held.drop(end)
            yield data[:end]
        if held.end is not None and held.at >= held.end:
            break
        if not end and not held.more() and held.data:
            raise ValueError(f"{r.file} is cut off")
    if r.end < r.start or r.kind != "blocks":
        return
    behind = behind if held.at > held.end else b""
    if held.at - held.end == len(behind):
        while (at := first_record(behind + held.data, held.over)) < 0:
            held.more()
        if at != len(behind):
            raise ValueError(f"records of {r.file} can't be told apart")


def record_count(r: ranges.Range) -> int:
    n = 0
    for data in whole_records(r):
        at = 0
        while at < len(data):
            at += 4 + struct.unpack_from("<i", data, at)[0]
            n += 1
    return n


def before(r: ranges.Range) -> Iterator[tuple[str, bool]]:
    """Name of and whether paired: the records before a range, the last first; they are read in ever larger parts of the file."""
    told, back = 0, 1 << 17
    while r.start:
        start = max(0, r.start - back)
        # up to this range's own first block; a record that it cuts is the last one before
        found = [(x["qname"], x["flag"] & 1 == 1) for data in whole_records(r._replace(start=start, end=r.start)) for x in parse(data, 0)]
        yield from found[::-1][told:]
        told = max(told, len(found))
        if start == 0:
            return
        back *= 4


class Bam(DataSource):
    """Reading: the path that is loaded, or a ``plan`` of ranges with the numbers of their first records; with ``mates``, neighbours of
    one name come as one row."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return MATES if self.options.get("mates") == "true" else SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return BamReader(self.options)


@dataclass
class Part(InputPartition):
    part: list


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.mates = options.get("mates") == "true"
        self.plan = json.loads(options["plan"]) if "plan" in options else plan(options["path"], ranges.SPLIT)

    def partitions(self) -> list[Part]:
        return [Part(p) for p in self.plan] or [Part([0, 0, None])]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        first, most, where = part.part
        if where is None:
            return
        r = ranges.Range(*where)
        rows = numbered_records(r, first, most)
        if self.mates:
            yield from packed(paired_up(r, rows), MATES_ARROW)
        else:
            yield from packed(rows, ARROW)


def plan(path: str, size: int) -> list:
    """[number of the first record, most records, range] for each task; numbers begin anew with each range, in the files' order."""
    return [[k << 32, -1, r] for k, r in enumerate(ranges.cut(path, size))]


def numbered_records(r: ranges.Range, first: int, most: int) -> Iterator[dict]:
    for data in whole_records(r):
        for x in parse(data, 0):
            if most == 0:
                return
            most -= 1
            yield {"rec_idx": first, **x, "tags": list(x["tags"].items())}
            first += 1


def paired_up(r: ranges.Range, rows: Iterator[dict]) -> Iterator[dict]:
    """a, b: neighbours that are paired and of one name; b is null for other records.

    Mates that a range's end parts belong to the range of the first: it reads on for the second, and the range behind looks
    back whether its first record is taken.
    """
    held: dict | None = None
    paired = lambda x: x["flag"] & 1 == 1
    begun = False
    for row in rows:
        if not begun:
            begun = True
            if paired(row):
                run = 0
                for name, is_paired in before(r):
                    if not is_paired or name != row["qname"]:
                        break
                    run += 1
                if run % 2:  # its mate stands before it
                    continue
        if held is not None and paired(row) and row["qname"] == held["qname"]:
            yield {"a": held, "b": row}
            held = None
            continue
        if held is not None:
            yield {"a": held, "b": None}
            held = None
        if paired(row):
            held = row
        else:
            yield {"a": row, "b": None}
    if held is not None:
        mate = next(following(r), None)
        if mate is not None and paired(mate) and mate["qname"] == held["qname"]:
            yield {"a": held, "b": {"rec_idx": held["rec_idx"] + 1, **mate, "tags": list(mate["tags"].items())}}
        else:
            yield {"a": held, "b": None}


def following(r: ranges.Range) -> Iterator[dict]:
    """Records behind a range, in the same file."""
    fs, name = ranges.opened(r.file)
    size = fs.get_file_info(name).size
    if r.end < size:
        for data in whole_records(r._replace(start=r.end, end=size)):
            yield from parse(data, 0)


def packed(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while part := list(itertools.islice(rows, ROWS)):
        yield pa.RecordBatch.from_pylist(part, schema)


def loaded(spark: SparkSession, path: str, mates: bool, first: int | None = None) -> DataFrame:
    path = ranges.qualified(spark, path)
    most = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    share = sum(n for _, n in ranges.files(path)) // (2 * spark.sparkContext.defaultParallelism)
    size = min(most, max(share, LEAST))
    todo = plan(path, size)
    if first is not None:
        counted = ranges.count(spark, [r for *_, r in todo], first, record_count)
        todo = [[k << 32, first - r.first, r] for k, r in enumerate(counted)]
    spark.dataSource.register(Bam)
    return spark.read.format("bam").option("plan", json.dumps(todo)).option("mates", str(mates).lower()).load()


def read_mates(spark: SparkSession, path: str) -> DataFrame:
    """a, b: mates that are neighbours as one row, in the file's order, without a shuffle; b is null for other records."""
    return loaded(spark, path, True)


def read_bam(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """Records of one file or of all in a folder, by name; rec_idx is the range's number and the place in it.  ``first``: only so
    many records, for which no more ranges are read than hold them."""
    if ranges.direct(spark, path):
        return loaded(spark, path, False, first)
    records = read_text(spark, path)
    return records if first is None else records.orderBy("rec_idx").limit(first)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """The same through Spark's reader of texts, from any storage.

    Each split finds its first record by the form of records, parses what is whole, and hands on what its bounds cut; those few
    are put together by file, where it is an error if they do not fit exactly.
    """
    at = blocks(spark, path)
    found = at.select("file", "start").distinct()  # one row for each split
    order = F.row_number().over(Window.orderBy("file", "start")) - 1
    found = found.select("file", "start", (2 * order + (F.col("start") == 0).cast("int")).cast("long").alias("number"))
    data = at.filter("length(value) > 0").join(F.broadcast(found), ["file", "start"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, place = -1, 0
        for n, _, part, _ in splits(batches):
            if n != number:
                number, place = n, 0
            for batch in rows_of(n, place, part):
                place += batch.num_rows
                yield batch

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, head, any_ = -1, b"", False
        out: list[tuple[int, bytes, bytes, bool]] = []
        for n, start, part, rest in splits(batches):
            if n != number:
                number, head, any_ = n, start, False
            any_ |= bool(part)
            out = [x for x in out if x[0] != n] + [(n, head, rest, any_)]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.bool_()))], names=["number", "head", "tail", "some"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, open_, since = None, b"", 0
        for batch in batches:
            for f, n, head, tail, some in zip(*(c.to_pylist() for c in batch.columns)):
                if f != file:
                    if open_:
                        raise ValueError(f"{file} is cut off")
                    file, open_, since = f, b"", n
                else:
                    open_ += head
                if some or tail:
                    yield from rows_of(since, 1 << 31, complete(open_, file))
                    open_, since = tail, n
        if open_:
            yield from rows_of(since, 1 << 31, complete(open_, file))

    def complete(data: bytes, file: str) -> bytes:
        end = 0
        while end + 4 <= len(data):
            end += 4 + struct.unpack_from("<i", data, end)[0]
        if end != len(data):
            raise ValueError(f"records of {file} can't be told apart")
        return data

    parts = data.select("number", "value")
    cuts = parts.mapInArrow(ends, "number long, head binary, tail binary, some boolean")
    names = found.select("file", (F.col("number") / 2).cast("long").alias("number"))
    cuts = cuts.join(F.broadcast(names), "number").select("file", "number", "head", "tail", "some").repartition("file").sortWithinPartitions("file", "number")
    return parts.mapInArrow(whole, SCHEMA).unionByName(cuts.mapInArrow(joined, SCHEMA))


def read_header(spark: SparkSession, path: str) -> tuple[str, bytes]:
    """Header text and reference table of the first file; only its first blocks are read."""
    if ranges.direct(spark, path):
        file, size = ranges.files(ranges.qualified(spark, path))[0]
        return header_dropped(ranges.Buffer(ranges.Range(file, ranges.kind_of(file), 0, size)))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    first = hadoop.fs.Path(spark.read.format("binaryFile").load(path).agg(F.min("path")).first()[0])
    stream = first.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(first)
    data, held = b"", b""
    try:
        while True:
            more = bytes(stream.readNBytes(1 << 20))
            held += more
            while len(held) >= 18 and len(held) >= (size := struct.unpack_from("<H", held, 16)[0] + 1):
                data, held = data + inflate(held[:size]), held[size:]
            try:
                text, table, _ = split_header(data)
                return text, table
            except (struct.error, IndexError):
                if not more:
                    raise ValueError("not a BAM file") from None
    finally:
        stream.close()


def add_program(text: str, name: str = "strandline", command: str = "") -> str:
    """The header with a program line, which follows the last one."""
    last = [f.split("\t") for f in text.splitlines() if f.startswith("@PG")]
    before = next((f"\tPP:{x[3:]}" for x in last[-1] if x.startswith("ID:")), "") if last else ""
    ids = {x[3:] for f in last for x in f if x.startswith("ID:")}
    own = name if name not in ids else f"{name}.{sum(i.startswith(name) for i in ids)}"
    return text + ("" if not text or text.endswith("\n") else "\n") + f"@PG\tID:{own}\tPN:{name}{before}" + (f"\tCL:{command}" if command else "") + "\n"


def write_bam(records: DataFrame, path: str, header: str = "", references: bytes = struct.pack("<i", 0), uncompressed: bool = False, in_order: bool = False) -> None:
    """One file in the order of rec_idx and, if there, sub; ``in_order``: rows come so, partition after partition.

    Tasks write the blocks as parts, as the lines of a text that the blocks' first bytes part; the file system joins them behind the
    header, so no record passes through the driver's Python.
    """
    spark, level = records.sparkSession, 0 if uncompressed else 6
    by = [c for c in ("rec_idx", "sub") if c in records.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                blob = b"".join(encode({**r, "tags": dict(r["tags"] or ())}) for r in batch.to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([deflate(blob, level)[len(MAGIC) :]], pa.binary())], names=["block"])

    fields = [c for c in ("qname", "flag", "pos", "mapq", "mpos", "seq", "qual", "tags", "ref", "cigar", "mref", "tlen") if c in records.columns]
    ordered = records if in_order else records.select(*by, *fields).repartitionByRange(*by).sortWithinPartitions(*by)
    made = ordered.select(*by, *fields).mapInArrow(run, "block binary")
    parts = f"{path}.parts"
    made.select(F.col("block").cast("string")).write.mode("overwrite").option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(parts)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    target, folder = hadoop.fs.Path(path), hadoop.fs.Path(parts)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(target, True)
    try:
        text = header.encode()
        out.write(bytearray(deflate(b"BAM\1" + struct.pack("<i", len(text)) + text + references, level) + MAGIC))
        for name in sorted(s.getPath().getName() for s in fs.listStatus(folder)):
            if name.startswith("part-"):
                part = fs.open(hadoop.fs.Path(folder, name))
                hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
                part.close()
        out.write(bytearray(EOF[len(MAGIC) :]))
    finally:
        out.close()
    fs.delete(folder, True)
