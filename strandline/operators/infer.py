"""Adapters inferred from what hangs over overlapping pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import COMPARED, OptionError, Options
from ..functions.sequence import LAMBDA, fill_quality, log10_match, log10_mismatch
from . import alignments as B
from .trim import candidates_pairs

FIRST = 50_000
SURE = -40.0
ERROR_MASS = 0.01
AMBIGUOUS = 0.2


def candidates(pairs: DataFrame, o: Options) -> DataFrame:
    """pairs with ``c`` (the likeliest fragment lengths by overlap alone) and ``accepted``."""
    chance = (F.length("s1") + F.length("s2")) * LAMBDA
    found = pairs.withColumn("c", candidates_pairs(F.col("s1"), F.col("q1"), F.col("s2"), F.col("q2"), o, overhang=True))
    sure = (F.col("c.best") >= 0) & (F.col("c.second_ll") - F.col("c.best_ll") < SURE) & (chance - F.col("c.best_ll") < SURE)
    return found.withColumn("accepted", sure)


def overhangs(found: DataFrame) -> DataFrame:
    """side (F or S), seq, qual of the overhangs of accepted pairs."""
    x = F.col("c.best")
    rest = lambda c: F.substring(F.col(c), x + 1, F.length(c))
    side = lambda name, s, q: F.struct(F.lit(name).alias("side"), rest(s).alias("seq"), rest(q).alias("qual"))
    both = F.array(side("F", "s1", "q1"), side("S", "s2", "q2"))
    return found.filter("accepted").select(F.explode(both).alias("o")).select("o.*").filter("length(seq) > 0")


def consensus(observed: DataFrame, o: Options) -> DataFrame:
    """side, position (0 to 30), base: the likeliest base, I where the others hold 1 % or more, or nothing was seen."""
    q = F.ascii(F.substring("qual", F.col("position") + 1, F.lit(1))) - o.offset
    each = observed.select("side", "seq", "qual", F.explode(F.sequence(F.lit(0), F.least(F.length("seq") - 1, F.lit(COMPARED)))).alias("position"))
    each = each.select("side", "position", F.substring("seq", F.col("position") + 1, F.lit(1)).alias("b"), q.alias("q"))
    score = lambda k: F.sum(F.when(F.col("b") == "N", F.lit(LAMBDA)).when(F.col("b") == k, log10_match("q")).otherwise(log10_mismatch("q")))
    sums = each.groupBy("side", "position").agg(*[score(k).alias(k) for k in "ACGT"])
    top = F.greatest("A", "C", "G", "T")
    mass = sum(F.pow(F.lit(10.0), F.col(k) - top) for k in "ACGT")
    best = F.when(F.col("A") == top, "A").when(F.col("C") == top, "C").when(F.col("G") == top, "G").otherwise("T")
    return sums.select("side", "position", F.when((mass - 1) / mass < ERROR_MASS, best).otherwise("I").alias("base"))


def first_pairs(records: DataFrame, first: int | None = FIRST) -> DataFrame:
    """rec_idx, s1, q1, s2, q2 of the mates among the first records of a BAM file, or among all that are given if ``first`` is None;
    a mate whose other one comes later is left."""
    head = (records if first is None else records.orderBy("rec_idx").limit(first)).filter(B.has(B.PAIRED))
    mate = lambda bit: F.max_by(F.struct("seq", fill_quality("seq", "qual").alias("qual")), F.when(B.has(bit), F.col("rec_idx")))
    both = head.groupBy("qname").agg(F.min("rec_idx").alias("rec_idx"), mate(B.FIRST).alias("a"), mate(B.SECOND).alias("b"))
    both = both.filter("a is not null and b is not null")
    return both.select("rec_idx", F.col("a.seq").alias("s1"), F.col("a.qual").alias("q1"), F.col("b.seq").alias("s2"), F.col("b.qual").alias("q2"))


def infer_adapters(pairs: DataFrame, o: Options, first: int | None = FIRST, order: str = "rec_idx") -> Options:
    """Options with the adapters found in the first pairs; an error if a fifth or more of either is ambiguous.

    Readers of files give the first pairs by reading no more than holds them: ``first`` is None for such, as for all pairs that
    are given.  Of other tables the first come from a top-k, through one task, and are dealt again for the kernel.
    """
    head = pairs if first is None else pairs.orderBy(order).limit(first).repartition(pairs.sparkSession.sparkContext.defaultParallelism)
    rows = consensus(overhangs(candidates(head, o)), o).collect()  # at most 62 rows
    found = {(r["side"], r["position"]): r["base"] for r in rows}
    adapters = ["".join(found.get((side, k), "I") for k in range(COMPARED + 1)) for side in "FS"]
    for a in adapters:
        if a.count("I") / len(a) >= AMBIGUOUS:
            raise OptionError(f"no adapter could be inferred: {a}")
    return o.with_adapters(*adapters)
