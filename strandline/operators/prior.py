"""The log-normal prior over fragment lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import log10_density, log10_survival


def fit_lognormal(lengths: DataFrame, length: str = "len") -> DataFrame:
    """One row: n, meanlog, sdlog and their standard errors, by maximum likelihood over positive lengths."""
    x = F.log(F.col(length))
    got = lengths.filter(F.col(length) > 0).agg(F.count("*").alias("n"), F.avg(x).alias("meanlog"), F.stddev_pop(x).alias("sdlog"))
    return got.withColumns({"meanlog_se": F.col("sdlog") / F.sqrt("n"), "sdlog_se": F.col("sdlog") / F.sqrt(F.col("n") * 2)})


def lengths_table(spark: SparkSession, loc: float, scale: float, most: int = 1000) -> DataFrame:
    """x, log10_density, log10_survival for lengths below most: the prior as a table that joins broadcast."""
    return spark.range(most).select(F.col("id").cast("int").alias("x"), log10_density("id", loc, scale).alias("log10_density"), log10_survival("id", loc, scale).alias("log10_survival"))


def with_prior(df: DataFrame, length: str, loc: float, scale: float, most: int = 1000) -> DataFrame:
    """df with log10_density and log10_survival of its lengths: joined with the broadcast table, and calculated beyond it."""
    table = lengths_table(df.sparkSession, loc, scale, most)
    joined = df.join(F.broadcast(table), F.greatest(F.col(length), F.lit(0)) == F.col("x"), "left").drop("x")
    return joined.withColumns({"log10_density": F.coalesce("log10_density", log10_density(length, loc, scale)), "log10_survival": F.coalesce("log10_survival", log10_survival(length, loc, scale, known=1))})


def insert_sizes(aligned: DataFrame) -> DataFrame:
    """Lengths from alignments (flag, seq, tlen): mapped single reads by length, proper pairs by a positive template length."""
    single = aligned.filter(F.col("flag").bitwiseAND(5) == 0).select(F.length("seq").alias("len"))
    pairs = aligned.filter((F.col("flag").bitwiseAND(2) == 2) & (F.col("tlen") > 0)).select(F.col("tlen").cast("int").alias("len"))
    return single.unionAll(pairs)
