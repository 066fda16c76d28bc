"""Files that arrive: batches, numbers across them, mates that wait, and batches that are tried again."""

import json
import os

import pytest

from strandline.config import OptionError, Options
from strandline.sources import fastq
from strandline.streaming import files

from .test_files import make_pairs


def everything(out):
    """All files below a folder, with what they hold and when they were written."""
    return {os.path.join(d, f): (open(os.path.join(d, f), "rb").read(), os.stat(os.path.join(d, f)).st_mtime_ns) for d, _, names in os.walk(out) for f in names}


def contents(out):
    return {k: v[0] for k, v in everything(out).items()}


def names(spark, path):
    return [r.header for r in fastq.read_fastq(spark, path).collect()]


def test_mates_wait_for_each_other(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    parts = []
    for k in range(3):
        (tmp_path / str(k)).mkdir()
        parts.append(make_pairs(tmp_path / str(k), 10 + k))

    def arrive(k, mate):
        os.rename(parts[k][mate - 1], source / f"lane{k}_R{mate}.fastq")

    # the second mates are gz, so endings differ; name both alike
    for k in range(3):
        for mate in (1, 2):
            if parts[k][mate - 1].endswith(".gz"):
                import gzip

                plain = parts[k][mate - 1][:-3] + "x"
                open(plain, "wb").write(gzip.open(parts[k][mate - 1]).read())
                parts[k] = (parts[k][0], plain)

    def go():
        q = files.watch(spark, Options(), f"file://{source}", str(out), str(tmp_path / "ck"), paired=True, availableNow=True)
        q.awaitTermination(180)
        assert q.exception() is None

    arrive(0, 1)
    arrive(0, 2)
    arrive(1, 2)
    go()
    first = files.state(str(out), 0)
    assert first["next"] == 10 and len(first["waiting"]) == 1 and len(first["read"]) == 2
    arrive(1, 1)
    arrive(2, 1)
    arrive(2, 2)
    go()
    second = files.state(str(out), 1)
    assert second["next"] == 33 and second["waiting"] == [] and "Total reads :\t33\n" in files.tally_of(str(out))
    assert names(spark, f"{out}/merged/batch=0") == [f"@r{k}" for k in range(10) if k % 5 != 4]
    assert names(spark, f"{out}/r1/batch=1") == [f"@r{k}/1" for n in (11, 12) for k in range(n) if k % 5 == 4]
    # tried again after it is done: nothing is touched; before: the same is written
    before = everything(out)
    files.run_batch(spark, Options(), second["read"], 1, str(out), True)
    assert everything(out) == before
    os.remove(out / "_batches" / "000000001.json")
    files.run_batch(spark, Options(), [n for n in second["read"] if "lane1_R2" not in n], 1, str(out), True)
    assert contents(out) == {k: v[0] for k, v in before.items()}


def test_single_files_and_order_of_batches(spark, tmp_path):
    one, _ = make_pairs(tmp_path, 8)
    out = str(tmp_path / "out")
    with pytest.raises(ValueError, match="not done"):
        files.run_batch(spark, Options(), [one], 1, out, False)
    told = files.run_batch(spark, Options(), [one], 0, out, False)
    assert told["next"] == 8 and told["counts"]["total"] == 8
    nothing = files.run_batch(spark, Options(), [], 1, out, False)
    assert nothing["next"] == 8 and nothing["counts"]["total"] == 0 and json.dumps(nothing)
    assert names(spark, f"{out}/merged/batch=0")[0] == "@r0/1"


def test_wrong_names_and_options(spark, tmp_path):
    with pytest.raises(OptionError):
        files.mates(["a/b.fq"])
    with pytest.raises(OptionError):
        files.watch(spark, Options(auto=True), str(tmp_path), str(tmp_path), str(tmp_path))
    assert files.mates(["d/x_1.fq.gz", "d/x_2.fq.gz", "d/y.R2.fastq", "d/1_2"]) == (["d/x_1.fq.gz"], ["d/x_2.fq.gz"], ["d/1_2", "d/y.R2.fastq"])
