"""FASTQ and BAM in and out, whole runs, options and streams."""

import glob
import gzip
import random
import struct

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from strandline.config import OptionError, Options
from strandline.operators import alignments as B
from strandline.operators import infer as I
from strandline.plans import run
from strandline.sources import bam, fastq
from strandline.streaming.reads import tally_stream, trim_stream

INSERT = "GATTACAGGCATTCCGATAACGTTGCATCGATCCGTAAGCTTACGGATTACCAGG"
FWD, REV = Options().forward[:33], Options().reverse[:33]
RC = str.maketrans("ACGTN", "TGCAN")


def turned(s):
    return s.translate(RC)[::-1]


def write_fastq(path, rows, gz=False):
    text = "".join(f"{h}\n{s}\n+\n{q}\n" for h, s, q in rows)
    (gzip.open if gz else open)(path, "wt").write(text)


def make_pairs(tmp_path, n=40):
    one, two = [], []
    for k in range(n):
        ins = INSERT[: 20 + k % 30]
        a, b = (ins + FWD)[:50], (turned(ins) + REV)[:50]
        if k % 5 == 4:  # no overlap: kept
            a, b = "ACGTTGCA" * 6, "TTGACCAG" * 6
        one.append((f"@r{k}/1 x", a, "I" * len(a)))
        two.append((f"@r{k}/2 y", b, "I" * len(b)))
    write_fastq(tmp_path / "1.fq", one)
    write_fastq(tmp_path / "2.fq.gz", two, gz=True)
    return str(tmp_path / "1.fq"), str(tmp_path / "2.fq.gz")


def lines(path):
    return [x for f in sorted(glob.glob(f"{path}/part*")) for x in gzip.open(f, "rt").read().splitlines()]


def test_read_fastq_over_splits(spark, tmp_path):
    rows = [(f"@r{k}", INSERT[: k % 40], "@" * (k % 40)) for k in range(500)]
    write_fastq(tmp_path / "a.fq", rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = fastq.read_fastq(spark, str(tmp_path / "a.fq"))
        assert got.rdd.getNumPartitions() > 1
        assert [(r.header, r.seq, r.qual) for r in got.orderBy("rec_idx").collect()] == rows
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_fastq_folder_over_splits(spark, tmp_path):
    """Several files, each cut into splits that end within records, one without a last line feed and one with an empty last line."""
    folder = tmp_path / "many"
    folder.mkdir()
    rows = []
    for f, n in enumerate((120, 7, 260, 33)):
        own = [(f"@f{f}r{k}", INSERT[: (k * 7) % 50], "@" * ((k * 7) % 50)) for k in range(n)]
        write_fastq(folder / f"{f}.fq", own)
        rows += own
    text = (folder / "1.fq").read_text()
    (folder / "1.fq").write_text(text.rstrip("\n"))
    (folder / "2.fq").write_text((folder / "2.fq").read_text() + "\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("700", "2111", "4096", "20000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "10")
            got = fastq.read_fastq(spark, str(folder)).orderBy("rec_idx").collect()
            assert [(r.header, r.seq, r.qual) for r in got] == rows
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_broken_fastq(spark, tmp_path):
    (tmp_path / "b.fq").write_text("@a\nAC\n+\nII\n@b\nAC\n")
    with pytest.raises(Exception, match="not a FASTQ record"):
        fastq.read_fastq(spark, str(tmp_path / "b.fq")).collect()


def test_mates_must_match(spark, tmp_path):
    write_fastq(tmp_path / "1.fq", [("@a/1", "AC", "II"), ("@b/1", "AC", "II")])
    write_fastq(tmp_path / "2.fq", [("@a/2", "AC", "II")])
    with pytest.raises(Exception, match="mates do not match"):
        fastq.read_paired(spark, str(tmp_path / "1.fq"), str(tmp_path / "2.fq")).collect()


def test_paired_run(spark, tmp_path):
    one, two = make_pairs(tmp_path)
    report = run.run_fastq(spark, Options(), one, two, out=str(tmp_path / "out"), log=str(tmp_path / "log"))
    merged = lines(tmp_path / "out.fq.gz")
    assert len(merged) // 4 == 32 and merged[0] == "@r0" and merged[1] == INSERT[:20]
    names = [x for x in merged[::4]]
    assert names == sorted(names, key=lambda n: int(n[2:]))
    kept = lines(tmp_path / "out_r1.fq.gz")
    assert len(kept) // 4 == 8 and kept[0] == "@r4/1"
    assert lines(tmp_path / "out.fail.fq.gz") == []
    assert "Total reads :\t40" in report and (tmp_path / "log").read_text() == report


def test_interleaved_and_barcodes(spark, tmp_path):
    one, two = make_pairs(tmp_path)
    run.run_fastq(spark, Options(umi_f=4, umi_r=3), one, two, interleaved=str(tmp_path / "all"))
    got = lines(tmp_path / "all")
    assert got[0] == f"@r0\tRX:Z:{INSERT[:4]}-{INSERT[17:20]}\tQX:Z:" + got[0].split("QX:Z:")[1] and got[1] == INSERT[4:17]


def test_single_run(spark, tmp_path):
    one, _ = make_pairs(tmp_path)
    paths = {"merged": str(tmp_path / "m"), "fail": str(tmp_path / "f")}
    report = run.run_fastq(spark, Options(), one, out=paths)
    assert len(lines(paths["merged"])) // 4 == 40 and "trimmed\t" in report
    with pytest.raises(ValueError):
        run.run_fastq(spark, Options(), one, out={"merged": "x"})


def test_infer(spark, tmp_path):
    rows = []
    for k in range(300):
        ins = "".join(random.Random(k).choices("ACGT", k=75))
        a, b = (ins + FWD + "ACGT")[:110], (turned(ins) + REV + "ACGT")[:110]
        rows.append((k, a, "I" * len(a), b, "I" * len(b)))
    df = spark.createDataFrame(rows, "rec_idx long, s1 string, q1 string, s2 string, q2 string")
    found = I.infer_adapters(df, Options(auto=True))
    assert found.adapters == (FWD[:31], REV[:31]) and not found.auto
    with pytest.raises(OptionError):
        I.infer_adapters(df.limit(0), Options(auto=True))


@pytest.mark.parametrize(
    "wrong",
    [dict(auto=True, forward="ACGT"), dict(loc=1.0), dict(loc=1.0, scale=1.0, ancient=True), dict(umi_trim_f=1), dict(keep_original=True), dict(outfile="x"), dict(keys="A,C,G"), dict(scale=0.0, loc=1.0)],
)
def test_options(wrong):
    with pytest.raises(OptionError):
        Options(**wrong)


def records():
    tags = {"RG": {"type": "Z", "value": "g"}, "NH": {"type": "i", "value": "-7"}, "XA": {"type": "A", "value": "q"}, "XB": {"type": "B", "value": "s,1,-2"}}
    away = (-1, "", -1, 0)
    out = []
    for k in range(6):
        ins = INSERT[: 20 + k]
        for mate, s in ((77, (ins + FWD)[:50]), (141, (turned(ins) + REV)[:50])):
            out.append((len(out), f"p{k}", mate, -1, 0, -1, s, "*" if k == 5 else "I" * 50, tags, *away))
    out.append((len(out), "s", 4, -1, 0, -1, (INSERT[:30] + FWD)[:50], "I" * 50, {"FF": {"type": "i", "value": "4"}, "ZQ": {"type": "Z", "value": "B"}}, *away))
    out.append((len(out), "odd", 4, -1, 0, -1, "ACGTN", "IIIII", {}, *away))
    return out


def test_bam_round_trip(spark, tmp_path):
    df = spark.createDataFrame(records(), bam.SCHEMA)
    path = str(tmp_path / "a.bam")
    bam.write_bam(df, path, "@HD\tVN:1.6\n")
    back = bam.read_bam(spark, path).orderBy("rec_idx").collect()
    assert [tuple(r) for r in back] == [tuple(r) for r in df.orderBy("rec_idx").collect()]
    run.run_bam(spark, Options(bam=True, uncompressed=True), path, str(tmp_path / "b.bam"))
    out = bam.read_bam(spark, str(tmp_path / "b.bam")).orderBy("rec_idx").collect()
    assert [r.qname for r in out] == [f"p{k}" for k in range(6)] + ["s", "odd"]
    assert out[0].seq == INSERT[:20] and out[0].flag == 4 and out[0].tags["FF"].value == "3"
    assert out[6].seq == INSERT[:30] and out[6].tags["FF"].value == "5" and out[6].tags["ZQ"].value == "B"
    assert "@PG\tID:strandline" in bam.read_header(spark, str(tmp_path / "b.bam"))[0]


def aligned_records(n=900):
    rng, out = random.Random(5), []
    for k in range(n):
        s = "".join(rng.choices("ACGTN", k=rng.randrange(1, 200)))
        tags = {"NM": Row(type="C", value=str(k % 5)), "XT": Row(type="Z", value="x" * (k % 90))}
        out.append((k, f"r{k}", 0, 1000 * k, k % 60, 7 * k, s, "*" if k % 9 == 0 else "".join(rng.choices("#5AFI", k=len(s))), tags, k % 3, f"{len(s)}M" if k % 2 else f"1S{len(s)}M2D3N", k % 3, -k))
    return out


def test_bam_over_splits(spark, tmp_path):
    """Aligned records come back whole from files whose blocks cut records, read in splits of any size, also of a folder."""
    rows, folder = aligned_records(), tmp_path / "bams"
    folder.mkdir()
    table = struct.pack("<i", 3) + b"".join(struct.pack("<i", 3) + b"c%d\0" % k + struct.pack("<i", 10**7) for k in range(3))
    head = b"BAM\1" + struct.pack("<i", 4) + b"@CO\n" + table
    names = ("rec_idx", "qname", "flag", "pos", "mapq", "mpos", "seq", "qual", "tags", "ref", "cigar", "mref", "tlen")
    for name, part in (("a.bam", rows[:500]), ("b.bam", rows[500:])):
        data = head + b"".join(bam.encode({**dict(zip(names, r)), "tags": {k: t.asDict() for k, t in r[8].items()}}) for r in part)
        cut = [data[i : i + 1777] for i in range(0, len(data), 1777)]
        (folder / name).write_bytes(b"".join(bam.deflate(c) for c in cut) + bam.EOF)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("5000", "17001", "100000000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "10")
            back = bam.read_bam(spark, str(folder)).orderBy("rec_idx").collect()
            assert [tuple(r)[1:] for r in back] == [r[1:] for r in rows]
            assert len({r.rec_idx for r in back}) == len(rows)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert bam.read_header(spark, str(folder)) == ("@CO\n", table)
    bam.write_bam(bam.read_bam(spark, str(folder)), str(tmp_path / "c.bam"), "@CO\n", table)
    assert [tuple(r)[1:] for r in bam.read_bam(spark, str(tmp_path / "c.bam")).orderBy("rec_idx").collect()] == [r[1:] for r in rows]
    # carried through a run of aligned records
    run.run_bam(spark, Options(bam=True, aligned=True, trim_cutoff=1000), str(tmp_path / "c.bam"), str(tmp_path / "d.bam"))
    got = {r.qname: r for r in bam.read_bam(spark, str(tmp_path / "d.bam")).collect()}
    # reads are single here: not paired, nothing trimmed
    assert all((got[r[1]].pos, got[r[1]].ref, got[r[1]].cigar, got[r[1]].mref, got[r[1]].tlen) == (r[3], r[9], r[10], r[11], r[12]) for r in rows)


def test_index_bins():
    assert [bam.index_bin(p, n) for p, n in ((-1, 1), (0, 1), (16383, 1), (16383, 2), (1 << 26, 10), ((1 << 26) - 1, 2))] == [4680, 4681, 4681, 585, 4681 + (1 << 12), 0]


def test_inflating_takes_time_by_length():
    import time

    took = []
    for n in (1, 8):
        raw = bam.deflate(random.Random(1).randbytes(n << 20))
        began = time.perf_counter()
        assert len(bam.inflate(raw)) == n << 20
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0] + 0.5


def test_bam_command_infers_and_reports(spark, tmp_path, capsys):
    from strandline.__main__ import main

    rows = []
    for k in range(300):
        ins = "".join(random.Random(k).choices("ACGT", k=75))
        for mate, s in ((77, (ins + FWD + "ACGT")[:110]), (141, (turned(ins) + REV + "ACGT")[:110])):
            rows.append((len(rows), f"p{k}", mate, -1, 0, -1, s, "I" * len(s), {}, -1, "", -1, 0))
    bam.write_bam(spark.createDataFrame(rows, bam.SCHEMA), str(tmp_path / "in.bam"))
    found = I.infer_adapters(I.first_pairs(bam.read_bam(spark, str(tmp_path / "in.bam"))), Options(auto=True, bam=True))
    assert found.adapters == (FWD[:31], REV[:31])
    assert main(["--auto", "--log", str(tmp_path / "log"), "-o", str(tmp_path / "out.bam"), str(tmp_path / "in.bam")]) == 0
    text = (tmp_path / "log").read_text()
    assert "Total reads :\t300\n" in text and "merged trim\t300\t100.0000%" in text and text in capsys.readouterr().err
    assert bam.read_bam(spark, str(tmp_path / "out.bam")).count() == 300


def test_bam_tally_counts_each_pair_and_read_once(spark):
    from strandline.operators import tally as R

    df = spark.createDataFrame(records(), bam.SCHEMA)
    for o in (Options(bam=True), Options(bam=True, keep_original=True), Options(bam=True, umi_f=3, umi_r=2)):
        got = R.tally(B.process(df, o).filter("outcome is not null").select("outcome")).first()
        assert got["total"] == 8 and sum(got[n] for n in R.TALLY[1:]) == 8 and got["merged_trim"] == 6


def test_trim_key_keeps_or_drops_the_key(spark):
    reads = spark.createDataFrame([(0, "ACGTACGATTACAGATTACA", "I" * 20), (1, "TTTTTTGATTACAGATTACA", "I" * 20)], "rec_idx long, s1 string, q1 string")
    for trim, first in ((True, "GATTACAGATTACA"), (False, "ACGTACGATTACAGATTACA")):
        got = run.process(reads, Options(keys="ACGTAC", trim_key=trim, trim_cutoff=1000), paired=False).orderBy("rec_idx").collect()
        assert [(r.result.code, r.result.s1) for r in got] == [(" ", first), ("K", "TTTTTTGATTACAGATTACA")]


def test_bam_guards(spark):
    df = spark.createDataFrame(records(), bam.SCHEMA)
    with pytest.raises(Exception, match="aligned record"):
        B.process(df.withColumn("flag", F.lit(0)), Options(bam=True)).collect()
    with pytest.raises(Exception, match="not one first and one second"):
        B.process(df.filter("rec_idx <> 1"), Options(bam=True)).collect()
    other = df.withColumn("tags", F.when(F.col("rec_idx") == 1, F.create_map(F.lit("RG"), F.struct(F.lit("Z").alias("type"), F.lit("h").alias("value")))).otherwise(F.col("tags")))
    with pytest.raises(Exception, match="must share"):
        B.process(other, Options(bam=True)).collect()


def test_bam_barcodes(spark):
    df = spark.createDataFrame(records(), bam.SCHEMA)
    out = {(r.qname, r.sub): r for r in B.process(df, Options(bam=True, umi_f=3, umi_r=2)).collect()}
    assert out["p0", 0].tags["RX"].value == f"{INSERT[:3]}-{INSERT[18:20]}" and out["p0", 0].seq == INSERT[3:18]
    assert out["odd", 0].tags["RX"].value == "ACG-NN" and out["odd", 0].seq == "TN"


def test_stream(spark, tmp_path):
    one, _ = make_pairs(tmp_path)
    table = fastq.read_single(spark, one)
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    done = trim_stream(stream, Options(), paired=False)
    q = done.select("rec_idx", "result.seq").writeStream.format("memory").queryName("trimmed_reads").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = run.process(table, Options(), paired=False).select("rec_idx", "result.seq").collect()
    assert sorted(map(tuple, spark.table("trimmed_reads").collect())) == sorted(map(tuple, want))
    q = tally_stream(done, Options(), False).writeStream.format("memory").queryName("tallied").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("tallied").first()["total"] == 40


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x\nACGT\nGG\n")
    assert fastq.read_fasta(spark, str(tmp_path / "a.fa")).first()["seq"] == "ACGTGG"


def test_lengths(spark, tmp_path):
    import math

    from strandline.operators.prior import fit_lognormal
    from strandline.sources.lengths import read_lengths

    (tmp_path / "l.txt").write_text("100\n 50\n200\n")
    got = fit_lognormal(read_lengths(spark, str(tmp_path / "l.txt"))).first()
    logs = [math.log(x) for x in (100, 50, 200)]
    mean = sum(logs) / 3
    sd = math.sqrt(sum((x - mean) ** 2 for x in logs) / 3)
    assert got["n"] == 3 and abs(got["meanlog"] - mean) < 1e-12 and abs(got["sdlog"] - sd) < 1e-12
    assert abs(got["meanlog_se"] - sd / math.sqrt(3)) < 1e-12 and abs(got["sdlog_se"] - sd / math.sqrt(6)) < 1e-12
