"""FASTQ files as tables and back.

Files that tasks can open are read through the ``fastq`` data source, in byte ranges of plain or block-compressed files; what
only Spark's own readers can open comes as text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequence import read_name
from ..operators.tally import ROUTES_PAIRED, ROUTES_SINGLE
from . import splits
from .routed import Fastq

LEAST = 1 << 16  # bytes of a task at least
PIECES = "rec_idx long, whole boolean, place int, header string, seq string, plus string, qual string, line string"


def offsets(df: DataFrame, part: str) -> DataFrame:
    """part, before: rows in the partitions before each; a row for each partition."""
    sizes = df.groupBy(part).agg(F.count("*").alias("n"))
    order = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(part, F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))


def numbered(df: DataFrame, by: list[str], to: str) -> DataFrame:
    """df with its places in the order of the columns, from 1, by a range sort and the ranges' sizes."""
    part = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    # stored, so that sizes and rows come from one evaluation; where no folder is shared, at least kept
    part = part.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else part.persist()
    local = F.col("_id") - F.shiftleft(F.col("_part").cast("long"), 33)
    return part.join(F.broadcast(offsets(part, "_part")), "_part").withColumn(to, F.col("before") + local + 1).drop("_part", "_id", "before")


def loose(first: int, lines: list[str]) -> list[tuple]:
    """Lines of records that are not whole, numbered from first."""
    return [((first + k) // 4, False, (first + k) % 4, None, None, None, None, x) for k, x in enumerate(lines)]


def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(line, number) rows in order: whole records, and the lines of those cut by the partition's ends."""
    held: list[str] = []
    first = 0
    kinds = [pa.int64(), pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string()]
    names = [c.split()[0] for c in PIECES.split(", ")]

    def pack(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    for batch in batches:
        lines, numbers = (c.to_pylist() for c in batch.columns)
        rows = []
        for line, n in zip(lines, numbers):
            if held and n != first + len(held):  # another split of this task
                rows += loose(first, held)
                held = []
            if not held:
                first = n
            held.append(line)
            if n % 4 == 3:
                if first % 4 == 0:
                    rows.append((n // 4, True, None, *held, None))
                else:
                    rows += loose(first, held)
                held = []
        yield pack(rows)
    if held:
        yield pack(loose(first, held))


def listed(path: str | list[str]) -> list[str]:
    return [path] if isinstance(path, str) else path


def grain(spark: SparkSession, *paths: list[str]) -> tuple[int, int]:
    """Bytes of a range that is counted, and of a task: of small files enough for all cores, never above Spark's own limit."""
    most = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    share = max(sum(n for _, n in splits.files(p)) for p in paths) // (2 * spark.sparkContext.defaultParallelism)
    task = min(most, max(share, LEAST))
    return min(task, splits.GRAIN), task


def loaded(spark: SparkSession, plan: list, pairs: bool = False) -> DataFrame:
    spark.dataSource.register(Fastq)
    return spark.read.format("fastq").option("plan", json.dumps(plan)).option("pairs", str(pairs).lower()).load()


def read_fastq(spark: SparkSession, path: str | list[str], numbered: bool = True, first: int | None = None) -> DataFrame:
    """rec_idx, header, seq, qual of a FASTQ file, of all in a folder by name, or of a list of these: plain, gz or block-compressed, in any storage that
    Spark reads; only a gz file without blocks is one task.

    rec_idx rises in the files' order.  With ``numbered`` it is the record's number from 0, for which records are counted beforehand, by
    range; else the range's number and the place in it.  ``first``: only so many records, for which no more ranges are
    read than hold them.  A file that is cut off, or whose third lines lack the +, is an error.
    """
    paths = [splits.qualified(spark, p) for p in listed(path)]
    if not splits.direct(spark, *paths):
        lines = read_lines(spark, path)
        return lines if first is None else lines.orderBy("rec_idx").limit(first)
    fine, task = grain(spark, paths)
    ranges = splits.cut(paths, fine)
    if numbered or first is not None:
        ranges = splits.count(spark, ranges, first)
    plan = []
    for k, part in enumerate(splits.joined(ranges, task)):
        most = -1 if first is None else first - part[0].first
        plan.append([part[0].first if numbered else k << 33, most, part])
    return loaded(spark, plan)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same through Spark's reader of texts, from any storage.

    Lines are numbered within each file over its splits; of a folder, files follow each other by name, each from a new record.
    Records are put together where they are read, and only those that a split cuts are moved.  A file that is cut off, or whose
    third lines lack the +, is an error.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id")
    )
    splits = lines.groupBy("_file", "_start").agg(F.count("*").alias("n"), F.min("_id").alias("first"))  # one row for each split
    within = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = splits.groupBy("_file").agg((4 * F.ceil(F.sum("n") / 4)).alias("m")).select("_file", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("at"))
    at = splits.withColumn("lines", F.coalesce(F.sum("n").over(within), F.lit(0))).join(files, "_file")
    at = at.select("_file", "_start", (F.col("at") + F.col("lines") - F.col("first")).alias("_shift"))
    pieces = lines.join(F.broadcast(at), ["_file", "_start"]).select("value", (F.col("_id") + F.col("_shift")).alias("n")).mapInArrow(assemble, PIECES)
    whole = pieces.filter("whole").select("rec_idx", "header", "seq", "plus", "qual")
    at = lambda k: F.max(F.when(F.col("place") == k, F.col("line")))
    cut = pieces.filter("not whole and not (place = 0 and line = '')").groupBy("rec_idx").agg(at(0).alias("header"), at(1).alias("seq"), at(2).alias("plus"), at(3).alias("qual"))
    all_ = whole.unionByName(cut)
    good = F.col("header").startswith("@") & F.col("plus").startswith("+") & F.col("qual").isNotNull()
    return all_.select("rec_idx", F.when(good, F.col("header")).otherwise(F.raise_error(F.concat(F.lit("not a FASTQ record: "), F.coalesce("header", F.lit("-"))))).alias("header"), "seq", "qual")


def read_single(spark: SparkSession, path: str | list[str], numbered: bool = False) -> DataFrame:
    """rec_idx, name (with @ and mate number), s1, q1, paired."""
    df = read_fastq(spark, path, numbered)
    return df.select("rec_idx", F.split("header", " ")[0].alias("name"), F.col("seq").alias("s1"), F.col("qual").alias("q1"), F.lit(False).alias("paired"))


def zip_pairs(one: DataFrame, two: DataFrame) -> DataFrame:
    """rec_idx, name, s1, q1, s2, q2, paired; an error if names differ or the second file is short; a surplus in it is left."""
    a = one.select("rec_idx", "header", F.col("seq").alias("s1"), F.col("qual").alias("q1"))
    b = two.select("rec_idx", F.col("header").alias("header2"), F.col("seq").alias("s2"), F.col("qual").alias("q2"))
    return named_pairs(a.join(b, "rec_idx", "left"))


def named_pairs(joined: DataFrame) -> DataFrame:
    """Pairs with the name that both headers tell."""
    joined = joined.withColumns({"name": read_name("header"), "name2": read_name("header2")})
    wrong = F.raise_error(F.concat(F.lit("mates do not match: "), "name", F.lit(", "), F.coalesce("name2", F.lit("none"))))
    same = F.col("name").eqNullSafe(F.col("name2"))
    return joined.select("rec_idx", F.when(same, F.col("name")).otherwise(wrong).alias("name"), "s1", "q1", "s2", "q2", F.lit(True).alias("paired"))


def aligned(one: list[splits.Range], two: list[splits.Range], task: int, first: int | None = None) -> list:
    """[first record, records, ranges of one, records of two to skip, ranges of two] for each task, by the records' numbers.

    A task begins where a range of the first file does; what it must skip in the second is less than one range, but a gzip file is never
    skipped into, so each is read by one task.
    """
    starts = [r.first for r in two]
    plan: list = []
    j, size = 0, 0
    for r in one:
        if first is not None and r.first >= first:
            break
        while j + 1 < len(two) and starts[j + 1] <= r.first:
            j += 1
        skippable = not two or two[j].kind != "gzip" or starts[j] == r.first or r.first >= starts[j] + two[j].n
        if not plan or skippable and size + r.end - r.start > task:
            plan.append([r.first, 0, [], r.first - (starts[j] if two else 0), [], j])
            size = 0
        plan[-1][2].append(r)
        plan[-1][1] += r.n
        size += r.end - r.start
    for p in plan:
        if first is not None:
            p[1] = min(p[1], first - p[0])
        end, j = p[0] + p[1], p.pop()
        p[4] = [r for r in two[j:] if r.first < end]
    return plan


def read_paired(spark: SparkSession, first: str | list[str], second: str | list[str], head: int | None = None) -> DataFrame:
    """The mates of two files, or folders, by their place; ``head``: only so many pairs, for which only the first ranges are read.

    Records are counted by range, then each task reads the same records of both files, so nothing is shuffled.
    """
    mates = [[splits.qualified(spark, p) for p in listed(x)] for x in (first, second)]
    if not splits.direct(spark, *mates[0], *mates[1]):
        both = zip_pairs(read_fastq(spark, first), read_fastq(spark, second))
        return both if head is None else both.orderBy("rec_idx").limit(head)
    fine, task = grain(spark, *mates)
    one, two = (splits.count(spark, splits.cut(p, fine), head) for p in mates)
    return named_pairs(loaded(spark, aligned(one, two, task, head), pairs=True))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """One row: the sequence of a file with one record, lines joined."""
    lines = spark.read.text(path).withColumn("i", F.monotonically_increasing_id()).filter("not startswith(value, '>')")
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"]), "").alias("seq"))


def lines_of(routed: DataFrame) -> DataFrame:
    return routed.select("rec_idx", "mate", "route", F.concat_ws("\n", "header", "seq", F.lit("+"), "qual").alias("value"))


def saved(lines: DataFrame, paths: dict[str, str], in_order: bool, single: bool) -> None:
    """Routes to their paths in one job; rows that do not come in order are sorted first."""
    if not in_order:
        lines = lines.repartitionByRange("rec_idx").sortWithinPartitions("rec_idx", "mate")
    paths = {route: splits.qualified(lines.sparkSession, p) for route, p in paths.items()}
    if not splits.direct(lines.sparkSession, *paths.values()):
        if single:
            raise ValueError("single files are written where tasks can open files")
        lines = lines.persist()  # Spark's writer takes one route at a time
        try:
            for route, path in paths.items():
                lines.filter(F.col("route") == route).select("value").write.option("compression", "gzip").mode("overwrite").text(path)
        finally:
            lines.unpersist()
        return
    lines.sparkSession.dataSource.register(Fastq)
    out = lines.select("route", "value").write.format("fastq").mode("overwrite")
    out.option("routes", json.dumps(paths)).option("single", str(single).lower()).save()


def write_routes(routed: DataFrame, paths: dict[str, str], paired: bool = True, in_order: bool = False, single: bool = False) -> None:
    """Each route to its own folder of block-compressed parts, in input order, all in one job; the routes must be all of the mode's.

    ``in_order``: rows come in the order of their partitions, as from this module's readers.  ``single``: a file for each route instead, which
    the parts are joined to at the end.
    """
    wanted = ROUTES_PAIRED if paired else ROUTES_SINGLE
    if set(paths) != set(wanted):
        raise ValueError(f"paths are wanted for {', '.join(wanted)}")
    saved(lines_of(routed), paths, in_order, single)


def prefix_paths(prefix: str, paired: bool = True) -> dict[str, str]:
    names = {"merged": "", "r1": "_r1", "r2": "_r2", "fail": ".fail", "r1_fail": "_r1.fail", "r2_fail": "_r2.fail"}
    return {r: f"{prefix}{names[r]}.fq.gz" for r in (ROUTES_PAIRED if paired else ROUTES_SINGLE)}


def write_interleaved(routed: DataFrame, path: str, in_order: bool = False, single: bool = False) -> None:
    """All routes as one stream in input order."""
    saved(lines_of(routed).withColumn("route", F.lit("all")), {"all": path}, in_order, single)
