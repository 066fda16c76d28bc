"""Routes of results and the tally of a run."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Options

ROUTES_PAIRED = ("merged", "r1", "r2", "fail", "r1_fail", "r2_fail")
ROUTES_SINGLE = ("merged", "fail")
TALLY = ("total", "merged_trim", "merged_overlap", "kept", "trimmed", "chimera", "failed_key", "umi_problem")


def outcome(o: Options, result: str = "result", paired: bool = True) -> Column:
    """What became of a pair or read, by the names of the tally."""
    code, seq = F.col(f"{result}.code"), F.col(f"{result}.seq")
    bad = F.when(code == "D", "chimera").when(code == "K", "failed_key").when(code == "U", "umi_problem")
    if not paired:
        return bad.when(F.length(seq) > 0, "trimmed").otherwise("kept")
    sum_ = o.umi_f + o.umi_r + o.umi_trim_f + o.umi_trim_r
    longest = F.greatest(F.length(f"{result}.s1"), F.length(f"{result}.s2"))
    return bad.when(F.length(seq) == 0, "kept").when(F.length(seq) + sum_ > longest, "merged_overlap").otherwise("merged_trim")


def counts(outcome: str = "outcome") -> list[Column]:
    """The tally's aggregates, of a table or observed in a job; rows without an outcome count for nothing."""
    return [F.count(outcome).alias("total"), *[F.count_if(F.col(outcome) == n).alias(n) for n in TALLY[1:]]]


def tally(outcomes: DataFrame, outcome: str = "outcome") -> DataFrame:
    """One row of counts."""
    return outcomes.agg(*counts(outcome))


def percentages(tallied: DataFrame) -> DataFrame:
    return tallied.select("total", *[F.when(F.col("total") > 0, 100.0 * F.col(n) / F.col("total")).alias(f"{n}_percent") for n in TALLY[1:]])


def report_of(row: Mapping[str, int]) -> str:
    """The run's log, a line for each count."""
    total = row["total"]
    share = lambda n: f"{100.0 * n / total:.4f}%" if total else "-"
    return f"Total reads :\t{total}\n" + "".join(f"{n.replace('_', ' ')}\t{row[n]}\t{share(row[n])}\n" for n in TALLY[1:])


def report(tallied: DataFrame) -> str:
    return report_of(tallied.first().asDict())


def routed(df: DataFrame, result: str = "result", paired: bool = True, name: str = "name", rec: str = "rec_idx") -> DataFrame:
    """rec_idx, mate, route, header, seq, qual: a row for each record to be written.

    Failed pairs go to the two mates' fail routes; the merged route holds new sequences; the rest is kept.
    """
    r = lambda n: F.col(f"{result}.{n}")
    rx = F.when(F.col("rx").isNotNull(), F.concat(F.lit("\tRX:Z:"), "rx", F.lit("\tQX:Z:"), "qx")).otherwise("") if "rx" in df.columns else F.lit("")
    failed, new = r("code") != " ", F.length(r("seq")) > 0

    def record(route: Column | str, mate: int, suffix: str, seq: Column, qual: Column) -> Column:
        route = F.lit(route) if isinstance(route, str) else route
        header = F.concat(F.lit("@"), F.regexp_replace(F.col(name), "^@", ""), F.lit(suffix), rx)
        return F.struct(F.lit(mate).alias("mate"), route.alias("route"), header.alias("header"), seq.alias("seq"), qual.alias("qual"))

    one = record("merged", 0, "", r("seq"), r("qual"))
    if paired:
        lost = F.array(record("r1_fail", 1, "/1", r("s1"), r("q1")), record("r2_fail", 2, "/2", r("s2"), r("q2")))
        kept = F.array(record("r1", 1, "/1", r("s1"), r("q1")), record("r2", 2, "/2", r("s2"), r("q2")))
    else:
        lost, kept = F.array(record("fail", 0, "", r("s1"), r("q1"))), F.array(record("merged", 0, "", r("s1"), r("q1")))
    rows = F.when(failed, lost).when(new, F.array(one)).otherwise(kept)
    return df.select(F.col(rec), F.explode(rows).alias("r")).select(rec, "r.*")
