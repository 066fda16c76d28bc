"""Whole runs: files in, routed files and a tally out."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import OptionError, Options
from ..operators import alignments as B
from ..operators import infer as I
from ..operators import tally as R
from ..operators import trim as T
from ..operators import umi as U
from ..sources import bam, fastq, splits


def process(reads: DataFrame, o: Options, paired: bool) -> DataFrame:
    """Reads with result, rx and qx; with ``auto``, under the adapters inferred from the first of them."""
    if o.auto:
        if not paired:
            raise OptionError("adapters are inferred from pairs only")
        o = I.infer_adapters(reads, o)
    out = T.merge_pairs(reads, o) if paired else T.trim_single(reads, o)
    out = U.extract(out, o, paired=paired)
    if o.trim_key or not o.keys:
        return out
    # reads that keep their key: what was not trimmed is written as it came
    kept = (F.length("result.seq") == 0) if not o.umi else F.lit(False)
    fields = {n: F.when(kept, F.col(n)).otherwise(F.col(f"result.{n}")) if n in reads.columns else F.col(f"result.{n}") for n in ("s1", "q1", "s2", "q2")}
    return out.withColumn("result", F.struct("result.code", "result.seq", "result.qual", "result.cut", *[c.alias(n) for n, c in fields.items()]))


@contextlib.contextmanager
def tallied(done: DataFrame, in_order: bool) -> Iterator[tuple[DataFrame, Callable[[], Mapping[str, int]]]]:
    """Rows with an outcome, and what tells their tally when they are written: observed by the job that writes them, or, where a
    sort looks at rows twice and would count so, from rows that are kept."""
    if in_order:
        told = Observation("tally")
        yield done.observe(told, *R.counts()), lambda: told.get
        return
    kept = done.persist()
    try:
        yield kept, lambda: R.tally(kept.select("outcome")).first().asDict()
    finally:
        kept.unpersist()


def run_fastq(
    spark: SparkSession,
    o: Options,
    fq1: str,
    fq2: str | None = None,
    out: str | dict[str, str] | None = None,
    interleaved: str | None = None,
    log: str | None = None,
    single: bool = False,
) -> str:
    """Reads one or two files, writes the routes (a prefix, or a path for each) or one interleaved stream; returns the report.

    One job reads, trims, writes all routes and counts the tally; files of which tasks can read ranges are neither shuffled nor
    sorted.  Before it, pairs' records are counted by range and, with ``auto``, the first pairs are read.  ``single``: one file for
    each output instead of a folder.
    """
    paired = fq2 is not None
    if bool(out) == bool(interleaved):
        raise OptionError("either routes or one interleaved output")
    in_order = splits.direct(spark, fq1, *([fq2] if paired else []))
    if o.auto and paired:
        o = I.infer_adapters(fastq.read_paired(spark, fq1, fq2, head=I.FIRST), o, first=None)
    reads = fastq.read_paired(spark, fq1, fq2) if paired else fastq.read_single(spark, fq1)
    with tallied(process(reads, o, paired).withColumn("outcome", R.outcome(o, paired=paired)), in_order) as (done, counts):
        rows = R.routed(done, paired=paired)
        if interleaved:
            fastq.write_interleaved(rows, interleaved, in_order, single)
        else:
            fastq.write_routes(rows, fastq.prefix_paths(out, paired) if isinstance(out, str) else out, paired, in_order, single)
        text = R.report_of(counts())
    if log:
        write_text(spark, log, text)
    return text


def run_bam(spark: SparkSession, o: Options, path: str, out: str, log: str | None = None) -> str:
    """Reads BAM, writes BAM; returns the report.  With ``auto``, under the adapters inferred from the mates among the first records.

    Mates that are neighbours are put together where they are read: one job, no shuffle, in the file's order.  A file that has
    others is done by name, with a shuffle for the mates and one for the order.
    """
    if o.auto:
        o = I.infer_adapters(I.first_pairs(bam.read_bam(spark, path, first=I.FIRST), first=None), o)
    header, references = bam.read_header(spark, path)
    header = bam.add_program(header)
    strays = 1
    if splits.direct(spark, path):
        told = Observation("tally")
        done = B.process_mates(bam.read_mates(spark, path), o).observe(told, F.count_if("stray").alias("strays"), *R.counts())
        bam.write_bam(done, out, header, references, o.uncompressed, in_order=True)
        counts = told.get
        strays = counts["strays"]
    if strays:
        with tallied(B.process(bam.read_bam(spark, path), o), False) as (done, by_name):
            bam.write_bam(done, out, header, references, o.uncompressed)
            counts = by_name()
    text = R.report_of(counts)
    if log:
        write_text(spark, log, text)
    return text


def write_text(spark: SparkSession, path: str, text: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
