"""Runs over files as they arrive: each batch of new files to its own part of the routes, once, however often it is tried.

``out`` gets a folder for each route, with one folder for each batch, and ``_batches`` with a small file for each batch that is done:
what it read, the number of the record after its last, mates' files that wait for their partner, and its tally.  A batch starts
from the file of the one before and replaces its own output, so a batch that is tried again writes the same; one that is done
is passed over.
"""

from __future__ import annotations

import json
import re

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..config import OptionError, Options
from ..operators import tally as R
from ..plans.run import process, tallied
from ..sources import fastq, splits

MATE = re.compile(r"[._-]?R?([12])((?:\.f(?:ast)?q)?(?:\.gz)?)$")


def state(out: str, batch: int) -> dict | None:
    """What a batch that is done has told."""
    fs, path = splits.opened(f"{out}/_batches/{batch:09d}.json")
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(path, compression=None) as f:
        return json.loads(f.read())


def done(out: str, batch: int, told: dict) -> None:
    """Tells that a batch is done: its file appears whole or not at all."""
    fs, path = splits.opened(f"{out}/_batches/{batch:09d}.json")
    folder, _, name = path.rpartition("/")
    fs.create_dir(folder)
    with fs.open_output_stream(f"{folder}/.{name}", compression=None) as f:
        f.write(json.dumps(told).encode())
    fs.move(f"{folder}/.{name}", path)


def mates(names: list[str]) -> tuple[list[str], list[str], list[str]]:
    """First mates' files, the second ones' in the same order, and those whose partner is not there."""
    sides: dict[str, dict[str, str]] = {}
    for n in names:
        m = MATE.search(n)
        if not m:
            raise OptionError(f"neither first nor second mates: {n}")
        sides.setdefault(n[: m.start()] + m[2], {})[m[1]] = n
    both = [s for _, s in sorted(sides.items()) if len(s) == 2]
    alone = [n for _, s in sorted(sides.items()) if len(s) == 1 for n in s.values()]
    return [s["1"] for s in both], [s["2"] for s in both], alone


def run_batch(spark: SparkSession, o: Options, arrived: list[str], batch: int, out: str, paired: bool) -> dict:
    """One batch; returns what its file tells."""
    out = splits.qualified(spark, out)
    if (before := state(out, batch)) is not None:
        return before
    last = state(out, batch - 1) if batch else {"next": 0, "waiting": []}
    if last is None:
        raise ValueError(f"batch {batch - 1} is not done")
    names = sorted({*last["waiting"], *arrived})
    one, two, waiting = mates(names) if paired else (names, [], [])
    counts = dict.fromkeys(R.TALLY, 0)
    if one:
        reads = fastq.read_paired(spark, one, two) if paired else fastq.read_single(spark, one, numbered=True)
        reads = reads.withColumn("rec_idx", F.col("rec_idx") + last["next"])
        with tallied(process(reads, o, paired).withColumn("outcome", R.outcome(o, paired=paired)), True) as (rows, total):
            routes = R.ROUTES_PAIRED if paired else R.ROUTES_SINGLE
            fastq.write_routes(R.routed(rows, paired=paired), {r: f"{out}/{r}/batch={batch}" for r in routes}, paired, in_order=True)
            counts = dict(total())
    told = {"read": [*one, *two], "waiting": waiting, "next": last["next"] + counts["total"], "counts": counts}
    done(out, batch, told)
    return told


def watch(spark: SparkSession, o: Options, source: str, out: str, checkpoint: str, paired: bool = False, files_per_batch: int = 64, **trigger) -> StreamingQuery:
    """Starts the stream over a folder; ``trigger`` as for ``writeStream.trigger``.  Files of mates are told apart by the 1 or 2
    before their ending, as in ``a_1.fq.gz`` and ``a_R2.fastq``; the batch in which the second of two arrives does both."""
    if o.auto:
        raise OptionError("adapters are inferred over a table, not over a stream")
    if not splits.direct(spark, source, out):
        raise OptionError("a stream of files wants a folder that tasks can open")
    # names only: the files' contents are read by range, in the batch
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    names = found.option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.f*q*").load(source).select("path")

    def one(rows: DataFrame, batch: int) -> None:
        run_batch(spark, o, [r["path"] for r in rows.collect()], batch, out, paired)  # at most files_per_batch names

    return names.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def tally_of(out: str) -> str:
    """The report over all batches that are done."""
    total, batch = dict.fromkeys(R.TALLY, 0), 0
    while (told := state(out, batch)) is not None:
        total = {n: total[n] + told["counts"][n] for n in R.TALLY}
        batch += 1
    return R.report_of(total)
