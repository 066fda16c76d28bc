"""Ranges of read files, the fastq data source and runs without shuffles."""

import gzip
import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from strandline.config import Options
from strandline.operators import infer as I
from strandline.operators import trim as T
from strandline.plans import run
from strandline.sources import bam, fastq, splits

from .test_files import FWD, INSERT, REV, lines, make_pairs, turned, write_fastq


def many(n, seed=1):
    rng = random.Random(seed)
    sizes = [rng.randrange(60) for _ in range(n)]
    return [(f"@r{k}/1 @+", "".join(rng.choices("ACGTN", k=m)), "".join(rng.choices("@+IABC#", k=m))) for k, m in enumerate(sizes)]


def as_bytes(rows):
    return "".join(f"{h}\n{s}\n+{h[1:]}\n{q}\n" for h, s, q in rows).encode()


def forms(folder, rows, monkeypatch, block=900):
    """The same records plain, without a last line feed, with carriage returns, gz, gz of several members, and in small blocks."""
    text = as_bytes(rows)
    half = len(text) // 3
    monkeypatch.setattr(bam, "BLOCK", block)
    out = {
        "plain.fq": text,
        "end.fq": text[:-1],
        "cr.fq": text.replace(b"\n", b"\r\n"),
        "one.fq.gz": gzip.compress(text),
        "two.fq.gz": gzip.compress(text[:half]) + gzip.compress(text[half:]),
        "blocks.fq.gz": bam.deflate(text) + bam.EOF,
        "parts.fq.gz": bam.deflate(text[:half]) + bam.EOF + bam.deflate(text[half:]) + bam.EOF,
    }
    for name, data in out.items():
        (folder / name).write_bytes(data)
    return [str(folder / name) for name in out]


def told(path, size):
    return [[tuple(x.decode() for x in (got[k], got[k + 1], got[k + 3])) for got in splits.records(r) for k in range(0, len(got), 4)] for r in splits.cut(path, size)]


@pytest.mark.parametrize("size", [29, 211, 1000, 4096, 10**7])
def test_ranges_of_every_form(tmp_path, monkeypatch, size):
    rows = many(500)
    for path in forms(tmp_path, rows, monkeypatch):
        parts = told(path, size)
        assert [r for p in parts for r in p] == rows, path
        if "one" not in path and "two" not in path and size == 1000:
            assert sum(map(bool, parts)) > 5


def test_small_pieces_and_long_records(tmp_path, monkeypatch):
    rows = many(60) + [("@long", "ACGT" * 30_000, "I" * 120_000)] + many(60, 2)
    paths = forms(tmp_path, rows, monkeypatch)
    monkeypatch.setattr(splits, "PIECE", 128)
    for path in paths:
        assert [r for p in told(path, 5000) for r in p] == rows, path


@pytest.mark.parametrize("bad", ["@a\nAC\n+\nII\n@b\nAC\n", "@a\nAC\nII\n@b\nAC\n+\nII\n", ">a\nAC\n+\nII\n"])
def test_broken_ranges(tmp_path, bad):
    (tmp_path / "b.fq").write_text(bad)
    with pytest.raises(ValueError, match="not a FASTQ record"):
        for r in splits.cut(str(tmp_path / "b.fq"), 1000):
            for got in splits.records(r):
                splits.check(got)


def test_cut_off_blocks(tmp_path):
    (tmp_path / "c.fq.gz").write_bytes(bam.deflate(as_bytes(many(50)))[:-30])
    with pytest.raises(ValueError, match="cut off"):
        list(splits.records(splits.cut(str(tmp_path / "c.fq.gz"))[0]))


@pytest.fixture
def small(spark):
    """Ranges of a few kilobytes."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_block_file_in_many_tasks(spark, tmp_path, monkeypatch, small):
    rows = many(2000)
    for path in forms(tmp_path, rows, monkeypatch):
        df = fastq.read_fastq(spark, path)
        assert [(r.rec_idx, r.header, r.seq, r.qual) for r in df.collect()] == [(k, *r) for k, r in enumerate(rows)], path
        assert (df.rdd.getNumPartitions() > 5) == ("one" not in path and "two" not in path)
        assert "Exchange" not in plan_of(df)
        loose = fastq.read_fastq(spark, path, numbered=False)
        assert [r.header for r in loose.collect()] == [r[0] for r in rows] and loose.select(F.count_distinct("rec_idx")).first()[0] == 2000
    spark.dataSource.register(fastq.Fastq)
    assert spark.read.format("fastq").load(str(tmp_path / "blocks.fq.gz")).count() == 2000


def test_folder_and_empty_file(spark, tmp_path, small):
    (tmp_path / "d").mkdir()
    rows = many(90)
    for k, part in enumerate((rows[:40], [], rows[40:41], rows[41:])):
        (tmp_path / "d" / f"{k}.fq").write_bytes(as_bytes(part))
    (tmp_path / "d" / "_SUCCESS").write_text("x")
    assert [(r.rec_idx, r.header) for r in fastq.read_fastq(spark, str(tmp_path / "d")).collect()] == [(k, r[0]) for k, r in enumerate(rows)]
    (tmp_path / "e.fq").write_text("")
    assert fastq.read_fastq(spark, str(tmp_path / "e.fq")).count() == 0 and fastq.read_paired(spark, str(tmp_path / "e.fq"), str(tmp_path / "e.fq")).count() == 0


def test_text_reader_agrees(spark, tmp_path, monkeypatch, small):
    """What only Spark can open, here a pattern, comes through its reader of texts."""
    rows = many(300)
    forms(tmp_path, rows, monkeypatch)
    assert not splits.direct(spark, str(tmp_path / "plai?.fq")) and not splits.direct(spark, "ofs://x/y.fq")
    assert splits.qualified(spark, "/a/b") == "file:/a/b" and splits.qualified(spark, "s3://a/b") == "s3://a/b"
    got = fastq.read_fastq(spark, str(tmp_path / "plai?.fq")).orderBy("rec_idx").collect()
    assert [(r.header, r.seq, r.qual) for r in got] == rows


def test_mates_by_ranges(spark, tmp_path, monkeypatch, small):
    """Any two forms, whose ranges end at other records, without a shuffle."""
    one = many(700)
    two = [(h.replace("/1", "/2"), s[::-1] + "ACGT" * (k % 9), q[::-1] + "IIII" * (k % 9)) for k, (h, s, q) in enumerate(one)]
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    want = [(k, a[0][1:].split("/")[0], a[1], a[2], b[1], b[2]) for k, (a, b) in enumerate(zip(one, two))]
    for p in forms(tmp_path / "a", one, monkeypatch)[::2]:
        for q in forms(tmp_path / "b", two, monkeypatch, 2000)[1::2]:
            df = fastq.read_paired(spark, p, q)
            assert "Exchange" not in plan_of(df), (p, q)
            assert [(r.rec_idx, r.name, r.s1, r.q1, r.s2, r.q2) for r in df.collect()] == want, (p, q)
            head = fastq.read_paired(spark, p, q, head=123)
            assert [r.name for r in head.collect()] == [w[1] for w in want[:123]]


def test_second_file_short_or_long(spark, tmp_path, small):
    rows = many(300)
    write_fastq(tmp_path / "1.fq", rows)
    write_fastq(tmp_path / "2.fq", rows[:200])
    with pytest.raises(Exception, match="mates do not match"):
        fastq.read_paired(spark, str(tmp_path / "1.fq"), str(tmp_path / "2.fq")).collect()
    assert fastq.read_paired(spark, str(tmp_path / "2.fq"), str(tmp_path / "1.fq")).count() == 200


def test_first_records_read_the_first_ranges(spark, tmp_path, monkeypatch, small):
    rows = many(3000)
    write_fastq(tmp_path / "a.fq", rows)
    seen = []
    real = splits.counted
    monkeypatch.setattr(splits, "counted", lambda s, r, how: seen.extend(r) or real(s, r, how))
    df = fastq.read_fastq(spark, str(tmp_path / "a.fq"), first=100)
    assert [r.header for r in df.collect()] == [r[0] for r in rows[:100]]
    assert len(seen) < 10 < len(splits.cut(str(tmp_path / "a.fq"), 3000)) and "TakeOrdered" not in plan_of(df)
    assert df.rdd.getNumPartitions() < 10
    assert fastq.read_fastq(spark, str(tmp_path / "a.fq"), first=9000).count() == 3000
    for n in (1, 777, 1500, 2900):  # ranges are counted in growing lots, of which the last may go beyond
        assert fastq.read_fastq(spark, str(tmp_path / "a.fq"), first=n).count() == n


# ---- runs


class Jobs:
    """How many jobs a block starts."""

    def __init__(self, spark):
        self.spark = spark

    def __enter__(self):
        self.group = f"g{random.random()}"
        self.spark.sparkContext.setJobGroup(self.group, "counted")
        return self

    def __exit__(self, *_):
        self.n = len(self.spark.sparkContext.statusTracker().getJobIdsForGroup(self.group))
        self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_no_job_before_an_action(spark):
    df = spark.range(1000).repartition(7).select(F.col("id").alias("rec_idx"), F.lit("ACGT" * 9).alias("s1"), F.lit("I" * 36).alias("q1"))
    pairs = df.join(df.select("rec_idx", F.col("s1").alias("s2"), F.col("q1").alias("q2")), "rec_idx")
    with Jobs(spark) as jobs:
        T.merge_pairs(pairs, Options()), T.trim_single(df, Options())
    assert jobs.n == 0


@pytest.mark.parametrize("single", [False, True])
def test_run_is_one_job_in_order(spark, tmp_path, small, single):
    one, two = make_pairs(tmp_path, 400)
    folder = tmp_path / "out"
    folder.mkdir()
    ready = fastq.read_paired(spark, one, two)
    with Jobs(spark) as jobs:
        fastq.write_routes(run.R.routed(run.process(ready, Options(), True)), fastq.prefix_paths(str(folder / "p")), in_order=True, single=single)
    assert jobs.n == 1
    report = run.run_fastq(spark, Options(), one, two, out=str(folder / "p"), single=single)
    assert "Total reads :\t400" in report and "merged overlap" in report
    read = (lambda p: gzip.open(p, "rt").read().splitlines()) if single else lines
    merged = read(folder / "p.fq.gz")
    assert [x for x in merged[::4]] == [f"@r{k}" for k in range(400) if k % 5 != 4] and merged[1] == INSERT[:20]
    assert [x for x in read(folder / "p_r2.fq.gz")[::4]] == [f"@r{k}/2" for k in range(4, 400, 5)] and read(folder / "p.fail.fq.gz") == []
    names = {"p.fq.gz", "p_r1.fq.gz", "p_r2.fq.gz", "p.fail.fq.gz", "p_r1.fail.fq.gz", "p_r2.fail.fq.gz"}
    assert set(os.listdir(folder)) == names and all((folder / n).is_file() == single for n in names)
    # what was written is block-compressed, so it is read in ranges again
    assert splits.kind_of(splits.files(str(folder / "p.fq.gz"))[0][0]) == "blocks"
    assert fastq.read_fastq(spark, str(folder / "p.fq.gz")).count() == 320


def test_failed_run_leaves_nothing(spark, tmp_path):
    one, two = make_pairs(tmp_path, 40)
    with open(one, "a") as f:
        f.write("@more/1\nAC\n+\nII\n")
    (tmp_path / "out").mkdir()
    with pytest.raises(Exception, match="mates do not match"):
        run.run_fastq(spark, Options(), one, two, out=str(tmp_path / "out" / "p"))
    assert os.listdir(tmp_path / "out") == []


def test_attempts_that_fail_are_not_read(tmp_path):
    """Only what committed tasks tell is moved, in the order of their partitions."""
    from strandline.sources.routed import Sink, Written

    sink = Sink({"a": str(tmp_path / "a"), "b": str(tmp_path / "b")}, False)
    os.makedirs(sink.staging("a"))
    for name, text in (("00000-0", b"lost"), ("00000-1", b"one"), ("00001-0", b"two")):
        (tmp_path / sink.staging("a") / name).write_bytes(bam.deflate(text))
    sink.commit([Written(1, {"a": "00001-0"}), None, Written(0, {"a": "00000-1"})])
    assert [gzip.open(tmp_path / "a" / n).read() for n in sorted(os.listdir(tmp_path / "a"))] == [b"one", b"two", b""]
    assert sorted(os.listdir(tmp_path)) == ["a", "b"]


def test_auto_from_files(spark, tmp_path, small):
    """Adapters come from the first pairs alone: later ones with others change nothing."""
    def pair(k, fwd, rev):
        ins = "".join(random.Random(k).choices("ACGT", k=75))
        return (ins + fwd + "ACGT")[:110], (turned(ins) + rev + "ACGT")[:110]

    rows = [pair(k, *((FWD, REV) if k < 300 else (REV, FWD))) for k in range(900)]
    for n in (0, 1):
        write_fastq(tmp_path / f"{n + 1}.fq", [(f"@r{k}/{n + 1}", r[n], "I" * 110) for k, r in enumerate(rows)])
    head = fastq.read_paired(spark, str(tmp_path / "1.fq"), str(tmp_path / "2.fq"), head=300)
    assert head.count() == 300 and I.infer_adapters(head, Options(auto=True), first=None).adapters == (FWD[:31], REV[:31])


def test_plan_is_json(tmp_path):
    write_fastq(tmp_path / "a.fq", many(30))
    plan = splits.cut(str(tmp_path / "a.fq"), 500)
    assert [splits.Range(*x) for x in json.loads(json.dumps(plan))] == plan and re.fullmatch("plain", plan[0].kind)
