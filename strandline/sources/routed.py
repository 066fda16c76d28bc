"""The ``fastq`` data source: ranges of files in, routes of block-compressed parts out."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from . import splits
from .bam import EOF, deflate

SINGLE = "rec_idx long, header string, seq string, qual string"
PAIRS = "rec_idx long, header string, s1 string, q1 string, header2 string, s2 string, q2 string"
ROWS = 8192


@dataclass
class Task(InputPartition):
    part: list


class Fastq(DataSource):
    """Reading: the path that is loaded, or a ``plan`` of ranges with their first records' numbers, with ``pairs`` of two files.
    Writing: columns route and value, and ``routes``, a map of routes to paths; ``single`` joins each route's parts to one file."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return PAIRS if self.options.get("pairs") == "true" else SINGLE

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return Sink(json.loads(self.options["routes"]), self.options.get("single") == "true")


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.pairs = options.get("pairs") == "true"
        self.plan = json.loads(options["plan"]) if "plan" in options else None
        self.path = options.get("path")

    def partitions(self) -> list[Task]:
        plan = self.plan
        if plan is None:
            plan = [[k << 33, -1, [r]] for k, r in enumerate(splits.cut(self.path, splits.SPLIT))]
        return [Task(p) for p in plan] or [Task([0, 0, [], 0, []] if self.pairs else [0, 0, []])]

    def read(self, task: Task) -> Iterator[pa.RecordBatch]:
        if self.pairs:
            yield from pairs(*task.part)
        else:
            yield from singles(*task.part)


def columns(lines: list[bytes]) -> list[pa.Array]:
    splits.check(lines)
    return [pa.array(lines[k::4], pa.binary()).cast(pa.string()) for k in (0, 1, 3)]


def lots(ranges: list, skip: int, most: int) -> Iterator[list[bytes]]:
    """Lines of the records of these ranges from one on, at most so many (all, if below zero), ROWS records at a time."""
    held: list[bytes] = []
    for r in ranges:
        for lines in splits.records(splits.Range(*r)):
            if skip:
                lines, skip = lines[4 * skip :], max(0, skip - len(lines) // 4)
            held += lines
            while len(held) >= 4 * ROWS or 0 <= 4 * most <= len(held):
                n = min(ROWS, most) if most >= 0 else ROWS
                if n:
                    yield held[: 4 * n]
                held, most = held[4 * n :], most - n if most >= 0 else most
                if most == 0:
                    return
    if held:
        yield held


def singles(first: int, most: int, ranges: list) -> Iterator[pa.RecordBatch]:
    for lines in lots(ranges, 0, most):
        n = len(lines) // 4
        yield pa.RecordBatch.from_arrays([pa.array(range(first, first + n), pa.int64()), *columns(lines)], names=["rec_idx", "header", "seq", "qual"])
        first += n


def pairs(first: int, most: int, one: list, skip: int, two: list) -> Iterator[pa.RecordBatch]:
    """Where the second file is at its end, the second mates are null."""
    others = lots(two, skip, most)
    for lines in lots(one, 0, most):
        n = len(lines) // 4
        mates = columns(next(others, []))
        mates = [pa.concat_arrays([m, pa.nulls(n - len(m), pa.string())]) for m in mates]
        yield pa.RecordBatch.from_arrays([pa.array(range(first, first + n), pa.int64()), *columns(lines), *mates], names=["rec_idx", "header", "s1", "q1", "header2", "s2", "q2"])
        first += n


@dataclass
class Written(WriterCommitMessage):
    partition: int
    files: dict[str, str]


class Sink(DataSourceArrowWriter):
    """All routes in one job.  Tasks write parts to a hidden folder beside each route's path; what a failed attempt left there is
    never looked at, and goes with the folder when the job ends, well or not."""

    def __init__(self, routes: dict[str, str], single: bool):
        self.routes, self.single, self.run = routes, single, uuid.uuid4().hex

    def staging(self, route: str) -> str:
        folder, _, name = self.routes[route].rstrip("/").rpartition("/")
        return f"{folder}/.{name}-{self.run}" if folder else f".{name}-{self.run}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        out: dict[str, pa.NativeFile] = {}
        files: dict[str, str] = {}
        held: dict[str, list[bytes]] = {}

        def flush(route: str) -> None:
            if route not in out:
                fs, folder = splits.opened(self.staging(route))
                fs.create_dir(folder)
                files[route] = f"{task.partitionId():05d}-{task.attemptNumber()}"
                out[route] = fs.open_output_stream(f"{folder}/{files[route]}", compression=None)
            out[route].write(deflate(b"".join(x + b"\n" for x in held.pop(route))))

        for batch in batches:
            route, value = batch.column("route"), batch.column("value").cast(pa.binary())
            for name in pc.unique(route).to_pylist():
                held.setdefault(name, []).extend(value.filter(pc.equal(route, name)).to_pylist())
                if len(held[name]) >= ROWS:
                    flush(name)
        for name in list(held):
            flush(name)
        for f in out.values():
            f.close()
        return Written(task.partitionId(), files)

    def commit(self, messages: list[Written | None]) -> None:
        told = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        for route, path in self.routes.items():
            parts = [m.files[route] for m in told if route in m.files]
            (self.join if self.single else self.gather)(route, path, parts)
        self.clear()

    def gather(self, route: str, path: str, parts: list[str]) -> None:
        """A folder of parts, whose names tell the order."""
        fs, target = splits.opened(path)
        if fs.get_file_info(target).type == pafs.FileType.Directory:
            fs.delete_dir_contents(target)
        elif fs.get_file_info(target).is_file:
            fs.delete_file(target)
        fs.create_dir(target)
        _, folder = splits.opened(self.staging(route))
        for k, name in enumerate(parts):
            fs.move(f"{folder}/{name}", f"{target}/part-{k:05d}.fq.gz")
        with fs.open_output_stream(f"{target}/part-{len(parts):05d}.fq.gz", compression=None) as f:
            f.write(EOF)

    def join(self, route: str, path: str, parts: list[str]) -> None:
        """One file, which takes the path's place when it is whole."""
        fs, target = splits.opened(path)
        _, folder = splits.opened(self.staging(route))
        fs.create_dir(folder)
        with fs.open_output_stream(f"{folder}/whole", compression=None) as f:
            for name in parts:
                with fs.open_input_stream(f"{folder}/{name}", compression=None) as part:
                    while data := part.read(1 << 23):
                        f.write(data)
            f.write(EOF)
        if fs.get_file_info(target).type == pafs.FileType.Directory:
            fs.delete_dir(target)
        fs.move(f"{folder}/whole", target)

    def abort(self, messages: list[Written | None]) -> None:
        self.clear()

    def clear(self) -> None:
        for route in self.routes:
            fs, folder = splits.opened(self.staging(route))
            if fs.get_file_info(folder).type == pafs.FileType.Directory:
                fs.delete_dir(folder)
