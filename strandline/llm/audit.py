"""What each filter of a chain removes, in every order of the chain, by direct replay."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exact import with_group
from .util import UPPER, cut

SPACES = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 100, 80, 10  # words, percent of the words, percent of the code points
MARKS = "[#$%&*|]"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> dict[str, Column]:
    """Filters A to D by the text alone: few words, few distinct ones, many capitals, marks."""
    words = F.array_remove(F.split(text, SPACES), "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": n < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * n,
        "C": 100 * capitals > MAX_UPPER * F.length(text),
        "D": text.rlike(MARKS),
    }


def judged(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, fails (a bit for each filter, the first the lowest), good, toxic: a row for each document.

    E fails where a smaller doc_id has the identical text.  A null text is empty, a null part the empty string; a document without a
    doc_id, or of the smallest one of its text, passes E; rows that repeat a doc_id are documents of their own.  Labels that repeat a doc_id hold
    together, those without one count for nothing.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = functools.reduce(Column.__add__, [F.when(c, F.lit(1 << FILTERS.index(f))).otherwise(0) for f, c in text_failures(text).items()])
    flags = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), bits.alias("fails"))
    flags = with_group(cut(flags, "flags"), "digest", first_id=F.min("doc_id"))
    late = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    flags = flags.select("doc_id", "part", (F.col("fails") + F.when(late, 1 << FILTERS.index("E")).otherwise(0)).alias("fails"))
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = flags.filter("doc_id is not null").join(marks, "doc_id", "left")
    nowhere = flags.filter("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    no = F.lit(False)
    return known.unionByName(nowhere).select("part", "fails", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def orders(spark, filters: Sequence[str] = FILTERS) -> DataFrame:
    """filter_order and bit_1, bit_2, ...: the bits of its filters, first to last; a row for each permutation."""
    rows = [("".join(p), *[1 << filters.index(f) for f in p]) for p in itertools.permutations(filters)]
    return spark.createDataFrame(rows, "filter_order string, " + ", ".join(f"bit_{k + 1} int" for k in range(len(filters))))


def replay(flags: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """part, filter_order, step and counts of the flags (part, fails, good, toxic), for every order of the filters and every step.

    Each row meets the orders, which are broadcast (120 for five filters), learns where it first fails in each, and is exploded into
    the steps; counts are summed in every task before they are shuffled, at most parts x orders x steps rows a task.  ``shapley`` is the sum of
    what the step's filter removes over all orders.  Parts without rows give none, so an empty table gives none.
    """
    n = len(filters)
    steps = range(1, n + 1)
    failing = lambda k: F.col("fails").bitwiseAND(F.col(f"bit_{k}")) != 0
    first = functools.reduce(lambda w, k: w.when(failing(k), k), steps[1:], F.when(failing(1), 1)).otherwise(n + 1)
    # few bytes a row but much work: dealt to all tasks
    dealt = flags.repartition(int(flags.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = dealt.crossJoin(F.broadcast(orders(flags.sparkSession, filters))).withColumn("first_fail", first)
    each = met.select("part", "filter_order", "fails", "good", "toxic", "first_fail", *[f"bit_{k}" for k in steps], F.explode(F.array(*map(F.lit, steps))).alias("step"))
    bit = functools.reduce(lambda w, k: w.when(F.col("step") == k, F.col(f"bit_{k}")), steps[1:], F.when(F.col("step") == 1, F.col("bit_1")))
    each = each.withColumn("bit", bit)
    gone = F.col("first_fail") == F.col("step")
    when = {
        "kept": F.col("first_fail") > F.col("step"),
        "removed": gone,
        "redundant": (F.col("first_fail") < F.col("step")) & (F.col("fails").bitwiseAND(F.col("bit")) != 0),
        "unique_fails": F.col("fails") == F.col("bit"),
        "good_lost": gone & F.col("good"),
        "toxic_lost": gone & F.col("toxic"),
    }
    sums = each.groupBy("part", "filter_order", "step").agg(*[F.sum(F.when(c, F.lit(1)).otherwise(0)).cast("long").alias(k) for k, c in when.items()])
    of_filter = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return sums.withColumn("shapley", F.sum("removed").over(of_filter))


def interactions(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The audit of the five filters over docs (doc_id, text and the column of parts); see ``judged`` and ``replay``."""
    return replay(cut(judged(docs, labels, part), "judged"))
