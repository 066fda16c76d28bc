"""Column functions over base and quality strings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import COMPARED
from ..plans.tables import log10_survival as survival_at

LAMBDA = math.log10(0.25)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reverse_complement(seq) -> Column:
    """Anything but A, C, G, T, N is an error."""
    c = col(seq)
    turned = F.reverse(F.translate(c, "ACGTN", "TGCAN"))
    return F.when(c.rlike("^[ACGTN]*$"), turned).when(c.isNotNull(), F.raise_error(F.concat(F.lit("not a base sequence: "), c)))


def reverse_quality(qual) -> Column:
    return F.reverse(col(qual))


def edits(seq, key) -> Column:
    """Difference in length and mismatches over the shared prefix, but where the key is N."""
    a, b = F.split(col(seq), ""), F.split(col(key), "")
    n = F.least(F.length(col(seq)), F.length(col(key)))
    wrong = F.filter(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: (x != y) & (y != "N")), lambda z: z)
    return F.abs(F.length(col(seq)) - F.length(col(key))) + F.when(n > 0, F.size(wrong)).otherwise(0)


def pad_adapter(adapter) -> Column:
    c = col(adapter)
    return F.when(F.length(c) <= COMPARED, F.rpad(c, COMPARED + 1, "I")).otherwise(c)


def distinct_sorted(value) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.split(col(value), ""))), "")


def merge_flag(old, new) -> Column:
    """Bitwise or of an absent or integer flag and a new one."""
    return F.coalesce(col(old), F.lit(0)).bitwiseOR(col(new) if not isinstance(new, int) else F.lit(new))


def error_probability(q) -> Column:
    return F.pow(F.lit(10.0), -F.greatest(col(q), F.lit(2)) / F.lit(10.0))


def log10_match(q) -> Column:
    return F.log10(1 - error_probability(q))


def log10_mismatch(q) -> Column:
    return F.log10(error_probability(q) / 3)


def pair_score(q1, q2, same) -> Column:
    a, b = error_probability(q1), error_probability(q2)
    return F.when(same, F.log10((1 - a) * (1 - b) + 3 * (a / 3) * (b / 3))).otherwise(
        F.log10((1 - a) * (b / 3) + (a / 3) * (1 - b) + 2 * (a / 3) * (b / 3))
    )


def log10_density(x, loc: float, scale: float) -> Column:
    v = F.greatest(col(x), F.lit(1))
    return -F.pow(F.log(v) - loc, F.lit(2)) / (2 * scale * scale) / math.log(10) - F.log10(F.lit(scale * math.sqrt(2 * math.pi)) * v)


TERMS = 80  # of the series and the fraction below, enough for doubles


def erfc(z) -> Column:
    """The complementary error function of doubles, by built-in functions: a series below 2, a continued fraction above."""
    a = F.abs(col(z))
    step = lambda s, k: F.struct((s["sum"] + s["term"]).alias("sum"), (s["term"] * 2 * a * a / (2 * k + 3)).alias("term"))
    series = F.aggregate(F.sequence(F.lit(0), F.lit(TERMS)), F.struct(F.lit(0.0).alias("sum"), a.alias("term")), step)["sum"]
    low = 1 - series * F.exp(-a * a) * (2 / math.sqrt(math.pi))
    depth = F.aggregate(F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1)), F.lit(0.0), lambda s, k: k / 2 / (a + s))
    high = F.exp(-a * a) / math.sqrt(math.pi) / (a + depth)
    tail = F.when(a < 2, low).otherwise(high)
    return F.when(col(z) < 0, 2 - tail).otherwise(tail)


def log10_survival(x, loc: float, scale: float, known: int = 1000) -> Column:
    """Of the log-normal; 0 and less count as 1.  Lengths below ``known`` are looked up in a table that goes along with the plan; longer
    ones are calculated."""
    table = F.lit([survival_at(n, loc, scale) for n in range(known)])
    n = F.greatest(col(x), F.lit(0)).cast("int")
    tail = 0.5 * erfc((F.log(F.greatest(col(x), F.lit(1)).cast("double")) - loc) / (scale * math.sqrt(2)))
    exact = F.when(tail > 0, F.log10(tail)).otherwise(F.lit(-math.inf))
    return F.when(n < known, F.element_at(table, F.least(n + 1, F.lit(known)))).when(n.isNotNull(), exact)


def log10_sums(df: DataFrame, key: str, ll: str, to: str) -> DataFrame:
    """key, and log10 of the sum of probabilities given as log10.

    Sums are taken by power of ten first, combined before the shuffle, so a group's rows never meet; only its powers do.
    """
    power = F.floor(ll)
    parts = df.filter(F.col(ll).isNotNull()).groupBy(key, power.alias("_power")).agg(F.sum(F.pow(F.lit(10.0), F.col(ll) - power)).alias("_part"))
    tops = parts.groupBy(key).agg(F.max("_power").alias("_top"), F.collect_list(F.struct("_power", "_part")).alias("_parts"))
    total = F.aggregate("_parts", F.lit(0.0), lambda s, x: s + x["_part"] * F.pow(F.lit(10.0), (x["_power"] - F.col("_top")).cast("double")))
    return tops.select(key, (F.col("_top") + F.log10(total)).alias(to))


def read_name(header) -> Column:
    """First token, without the mate's /1 or /2, then without @."""
    first = F.regexp_replace(F.split(col(header), " ")[0], "/[12]$", "")
    return F.regexp_replace(first, "^@", "")


def fill_quality(seq, qual) -> Column:
    """A missing quality, *, becomes as many zeros as there are bases of the same mate."""
    return F.when(col(qual) == "*", F.repeat(F.lit("0"), F.length(col(seq)))).otherwise(col(qual))


def check_lengths(seq, qual) -> Column:
    """The sequence, or an error where its quality is longer or shorter."""
    return F.when(F.length(col(seq)) == F.length(col(qual)), col(seq)).otherwise(F.raise_error(F.lit("sequence and quality differ in length")))
