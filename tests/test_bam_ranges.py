"""BAM in ranges, mates that are neighbours, and runs of one job in the file's order."""

import gzip
import io
import random
import sys

import pytest

from strandline.config import Options
from strandline.operators import alignments as B
from strandline.operators import infer as I
from strandline.plans import run
from strandline.sources import bam, splits

from .test_files import FWD, INSERT, REV, turned
from .test_splits import Jobs, plan_of

AWAY = (-1, "", -1, 0)


def mates(n, singles=False):
    """Pairs, now and then with the second mate first, or single records between them."""
    rng, out = random.Random(4), []
    for k in range(n):
        ins = INSERT[: 20 + k % 30]
        a, b = (ins + FWD)[:50], (turned(ins) + REV)[:50]
        if k % 7 == 6:
            a, b = "ACGTTGCA" * 6, "TTGACCAG" * 6
        two = [(f"p{k}", 77, a), (f"p{k}", 141, b)]
        out += two[::-1] if k % 5 == 4 else two
        if singles and rng.random() < 0.3:
            out.append((f"s{k}", 4, (INSERT[:30] + FWD)[: 40 + k % 9]))
    return [(k, name, flag, -1, 0, -1, s, "I" * len(s), {}, *AWAY) for k, (name, flag, s) in enumerate(out)]


def written(spark, path, rows, block, monkeypatch):
    """A file whose blocks cut records."""
    monkeypatch.setattr(bam, "BLOCK", block)
    names = [c.split()[0] for c in ("rec_idx", "qname", "flag", "pos", "mapq", "mpos", "seq", "qual", "tags", "ref", "cigar", "mref", "tlen")]
    data = b"BAM\1" + bytes(8) + b"".join(bam.encode(dict(zip(names, r))) for r in rows)
    with open(path, "wb") as f:
        f.write(bam.deflate(data) + bam.EOF)
    return str(path)


@pytest.mark.parametrize("size", [300, 1777, 9000, 10**7])
def test_ranges_hold_every_record_once(spark, tmp_path, monkeypatch, size):
    rows = mates(200, singles=True)
    path = written(spark, tmp_path / "a.bam", rows, 700, monkeypatch)
    got = [[x["qname"] for data in bam.whole_records(r) for x in bam.parse(data, 0)] for r in splits.cut(path, size)]
    assert [n for part in got for n in part] == [r[1] for r in rows] and (len(got) > 3) == (size < 9000)
    assert sum(map(bam.record_count, splits.cut(path, size))) == len(rows)
    pairs = [x for r in splits.cut(path, size) for x in bam.paired_up(r, bam.numbered_records(r, 0, -1))]
    names = [(x["a"]["qname"], x["b"]["qname"] if x["b"] else None) for x in pairs]
    want, at = [], 0
    while at < len(rows):
        two = rows[at][2] & 1
        want.append((rows[at][1], rows[at][1] if two else None))
        at += 2 if two else 1
    assert names == want


def test_many_of_one_name(spark, tmp_path, monkeypatch):
    """However many neighbours share a name, each is told once, whatever the ranges."""
    rows = [(k, "same" if 10 <= k < 31 else f"r{k}", 77, -1, 0, -1, "ACGT" * 12, "I" * 48, {}, *AWAY) for k in range(60)]
    path = written(spark, tmp_path / "a.bam", rows, 333, monkeypatch)
    for size in (200, 500, 2000, 10**6):
        pairs = [x for r in splits.cut(path, size) for x in bam.paired_up(r, bam.numbered_records(r, 0, -1))]
        told = [m["qname"] for x in pairs for m in (x["a"], x["b"]) if m]
        assert told == [r[1] for r in rows] and sum(x["b"] is not None for x in pairs) == 10


def test_cut_off_or_foreign(spark, tmp_path, monkeypatch):
    rows = mates(100)
    path = written(spark, tmp_path / "a.bam", rows, 700, monkeypatch)
    raw = gzip.open(path).read()
    for name, data in (("cut", raw[:-20]), ("foreign", b"text" * 900)):
        (tmp_path / name).write_bytes(bam.deflate(data) + bam.EOF)
        with pytest.raises(ValueError, match="cut off|not a BAM|told apart"):
            sum(map(bam.record_count, splits.cut(str(tmp_path / name), 900)))


def rows_of(df):
    return [tuple(r) for r in df.select("qname", "flag", "seq", "qual").collect()]


@pytest.mark.parametrize("stray", [False, True])
def test_run_in_one_job(spark, tmp_path, monkeypatch, stray):
    rows = mates(150, singles=True)
    if stray:  # mates apart: by name
        rows = sorted(rows, key=lambda r: (r[2] == 141, r[0]))
        rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    path = written(spark, tmp_path / "a.bam", rows, 900, monkeypatch)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert spark.dataSource.register(bam.Bam) is None and spark.read.format("bam").load(path).count() == len(rows)
        assert bam.read_bam(spark, path).rdd.getNumPartitions() > 3
        assert rows_of(bam.read_bam(spark, path)) == [(r[1], r[2], r[6], r[7]) for r in rows]
        for n in (1, 41, 99, 150):
            assert rows_of(bam.read_bam(spark, path, first=n)) == [(r[1], r[2], r[6], r[7]) for r in rows[:n]]
        narrow = B.process_mates(bam.read_mates(spark, path), Options(bam=True))
        assert "Exchange" not in plan_of(narrow)
        by_name = B.process(bam.read_bam(spark, path), Options(bam=True))
        want = rows_of(by_name.orderBy("rec_idx", "sub"))
        with Jobs(spark) as jobs:
            text = run.run_bam(spark, Options(bam=True), path, str(tmp_path / "out.bam"))
        assert "Total reads :\t" + str(len({r[1] for r in rows})) in text
        if not stray:
            assert rows_of(narrow) == want and jobs.n == 1
        assert rows_of(bam.read_bam(spark, str(tmp_path / "out.bam"))) == want
        for o in (Options(bam=True, keep_original=True), Options(bam=True, umi_f=3, umi_r=2), Options(bam=True, keys="ACG", trim_key=True)):
            run.run_bam(spark, o, path, str(tmp_path / "o.bam"))
            assert rows_of(bam.read_bam(spark, str(tmp_path / "o.bam"))) == rows_of(B.process(bam.read_bam(spark, path), o).orderBy("rec_idx", "sub"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_mates_guards(spark, tmp_path, monkeypatch):
    rows = mates(4)
    mapped = [(*r[:2], r[2] & ~4, *r[3:]) for r in rows]
    path = written(spark, tmp_path / "m.bam", mapped, 9000, monkeypatch)
    with pytest.raises(Exception, match="aligned record"):
        B.process_mates(bam.read_mates(spark, path), Options(bam=True)).collect()
    assert B.process_mates(bam.read_mates(spark, path), Options(bam=True, aligned=True)).count() == 4
    path = written(spark, tmp_path / "f.bam", [(*r[:2], 77, *r[3:]) for r in rows], 9000, monkeypatch)
    with pytest.raises(Exception, match="not one first and one second"):
        B.process_mates(bam.read_mates(spark, path), Options(bam=True)).collect()


def test_first_mates_for_inference(spark, tmp_path, monkeypatch):
    """Later mates with other adapters change nothing."""
    rows = []
    for k in range(600):
        ins = "".join(random.Random(k).choices("ACGT", k=75))
        f, r = (FWD, REV) if k < 300 else (REV, FWD)
        for flag, s in ((77, (ins + f + "ACGT")[:110]), (141, (turned(ins) + r + "ACGT")[:110])):
            rows.append((len(rows), f"p{k}", flag, -1, 0, -1, s, "I" * len(s), {}, *AWAY))
    path = written(spark, tmp_path / "a.bam", rows, 3000, monkeypatch)
    found = I.infer_adapters(I.first_pairs(bam.read_bam(spark, path, first=600), first=None), Options(auto=True, bam=True), first=None)
    assert found.adapters == (FWD[:31], REV[:31])


def test_standard_streams(spark, tmp_path, monkeypatch):
    from strandline.__main__ import main

    path = written(spark, tmp_path / "a.bam", mates(20), 3000, monkeypatch)
    out = io.BytesIO()
    monkeypatch.setattr(sys, "stdin", type("In", (), {"buffer": open(path, "rb")})())
    monkeypatch.setattr(sys, "stdout", type("Out", (), {"buffer": out, "write": lambda self, x: None, "flush": lambda self: None})())
    assert main(["-"]) == 0
    (tmp_path / "out.bam").write_bytes(out.getvalue())
    assert bam.read_bam(spark, str(tmp_path / "out.bam")).filter("flag = 4").count() == 18
