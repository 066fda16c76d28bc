"""Command line: trims and merges FASTQ or BAM files."""

from __future__ import annotations

import argparse
import contextlib
import os
import shutil
import sys
import tempfile

from .config import CHIMERAS, FORWARD, REVERSE, OptionError, Options

VERSION = "0.1"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandline", description=__doc__, allow_abbrev=False)
    p.add_argument("input", nargs="?", help="BAM file; - for standard input")
    p.add_argument("--version", action="version", version=VERSION)
    p.add_argument("-v", "--verbose", action="store_true", help="has no effect")
    p.add_argument("-t", type=int, default=0, metavar="N", help="threads of a local session")
    p.add_argument("-z", type=int, default=0, metavar="N", help="rows in an Arrow batch")
    p.add_argument("-p", "--PIPE", action="store_true", help="no longer supported")
    for flag, text in (("-fq1", "reads, or first mates"), ("-fq2", "second mates"), ("-fqo", "prefix of the outputs"), ("-fqt", "one interleaved output")):
        p.add_argument(flag, metavar="FILE", help=text)
    for flag in ("-fqose", "-fqosef", "-fqope1", "-fqope1f", "-fqope2", "-fqope2f"):
        p.add_argument(flag, metavar="FILE", help="an output by name: new sequences (se) or mates (pe1, pe2), f: failed")
    p.add_argument("--log", metavar="FILE")
    p.add_argument("-o", "--outfile", default="", metavar="FILE", help="BAM output; standard output if there is none")
    p.add_argument("-u", action="store_true", dest="uncompressed", help="uncompressed BAM")
    p.add_argument("--aligned", action="store_true", help="aligned records are allowed")
    p.add_argument("--auto", action="store_true", help="infer the adapters")
    p.add_argument("--phred64", action="store_true")
    p.add_argument("--ancientdna", action="store_true", dest="ancient", help="allow partial overlaps")
    p.add_argument("--keepOrig", action="store_true", dest="keep_original")
    p.add_argument("--loc", type=float)
    p.add_argument("--scale", type=float)
    p.add_argument("-f", dest="forward", default=FORWARD, metavar="SEQ")
    p.add_argument("-s", dest="reverse", default=REVERSE, metavar="SEQ")
    p.add_argument("-c", dest="chimeras", default=CHIMERAS, metavar="SEQ,...")
    p.add_argument("-k", "--keys", default="", metavar="KEY[,KEY]")
    p.add_argument("--ikey", default="")
    p.add_argument("-i", "--allowMissing", action="store_true", dest="allow_missing")
    p.add_argument("--trimkey", action="store_true", dest="trim_key")
    p.add_argument("--seed", type=int, default=1)
    for flag, to in (("--umif", "umi_f"), ("--umir", "umi_r"), ("--umtf", "umi_trim_f"), ("--umtr", "umi_trim_r")):
        p.add_argument(flag, type=int, default=0, dest=to, metavar="N")
    p.add_argument("--trimCutoff", type=int, default=1, dest="trim_cutoff", metavar="N")
    return p


OPTION_NAMES = (
    "forward reverse chimeras keys ikey allow_missing trim_key ancient loc scale trim_cutoff phred64 auto keep_original aligned umi_f umi_r umi_trim_f umi_trim_r seed uncompressed outfile"
).split()
SINGLE_OUT = {"fqose": "merged", "fqosef": "fail"}
PAIRED_OUT = {**SINGLE_OUT, "fqope1": "r1", "fqope1f": "r1_fail", "fqope2": "r2", "fqope2f": "r2_fail"}


def understood(args: list[str]) -> tuple[argparse.Namespace, Options, str | dict[str, str] | None]:
    """Arguments, options and where routes go; an OptionError if they do not go together."""
    a = parser().parse_args(args)
    if a.PIPE:
        raise OptionError("pipes are not supported")
    bam = a.fq1 is None
    if bam == (a.input is None):
        raise OptionError("either a BAM file or -fq1")
    o = Options(bam=bam, **{n: getattr(a, n) for n in OPTION_NAMES})
    if bam:
        return a, o, None
    wanted = PAIRED_OUT if a.fq2 else SINGLE_OUT
    named = {route: getattr(a, n) for n, route in PAIRED_OUT.items() if getattr(a, n)}
    if sum(map(bool, (named, a.fqo, a.fqt))) != 1:
        raise OptionError("one of a prefix, an interleaved output and outputs by name")
    if named and set(named) != set(wanted.values()):
        raise OptionError(f"{len(wanted)} outputs are wanted by name")
    return a, o, named or a.fqo


def scratch(stack: contextlib.ExitStack) -> str:
    """A folder for what comes from or goes to a standard stream; on a cluster it must be shared."""
    return stack.enter_context(tempfile.TemporaryDirectory(prefix="strandline-", dir=os.environ.get("STRANDLINE_SHARED")))


def received(stack: contextlib.ExitStack, path: str) -> str:
    """The input's path; standard input is stored first, as it can be read once only."""
    if path != "-":
        return path
    stored = f"{scratch(stack)}/in.bam"
    with open(stored, "wb") as f:
        shutil.copyfileobj(sys.stdin.buffer, f)
    return stored


def sent(stack: contextlib.ExitStack) -> str:
    """A path whose content goes to standard output when it is written."""
    made = f"{scratch(stack)}/out.bam"

    def copy() -> None:
        if os.path.exists(made):
            with open(made, "rb") as f:
                shutil.copyfileobj(f, sys.stdout.buffer)
            sys.stdout.flush()

    stack.callback(copy)
    return made


def main(args: list[str]) -> int:
    if not args:
        parser().print_help()
        return 1
    try:
        a, o, out = understood(args)
    except OptionError as e:
        print(e, file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    from .plans.run import run_bam, run_fastq

    builder = SparkSession.builder.appName("strandline")
    spark = (builder.master(f"local[{a.t}]") if a.t else builder).getOrCreate()
    if a.z:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(a.z))
    if o.bam:
        with contextlib.ExitStack() as stack:
            text = run_bam(spark, o, received(stack, a.input), o.outfile or sent(stack), log=a.log)
    else:
        text = run_fastq(spark, o, a.fq1, a.fq2, out=out, interleaved=a.fqt, log=a.log, single=True)
    print(text, file=sys.stderr, end="")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
