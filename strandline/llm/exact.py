"""Exact duplicates: heavy hitters split off, the rest shuffled; DataFrame functions only.

Digests of the normalised texts are stored once.  A frequent-items sketch over them (the Misra-Gries counters of
``approx_top_k``, one a group of partitions, then combined) names the digests that may hold over ``1 / TRACKED`` of the rows.
A second pass counts those exactly and finds their winners, with partial sums in every task; they are at most TRACKED rows and
are broadcast, so the rows of large groups are settled where they lie.  All other rows are shuffled by digest, where no group
holds over ``1 / TRACKED`` of them, but for what the sketch missed, which costs time and no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import ascii_lower, cut, fresh

TRACKED = 8192  # counters of a sketch: the most rows that are broadcast
SKETCH_GROUPS = 64


def heavy_keys(rows: DataFrame, key: str) -> DataFrame:
    """At most TRACKED values of key, those held by over 1 / TRACKED of the rows among them, by sketches in two levels."""
    group = F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("part")
    sketches = rows.select(group, key).groupBy("part").agg(F.expr(f"approx_top_k_accumulate(`{key}`, {TRACKED})").alias("sketch"))
    # grouped by a constant, as the sketch of an empty partition cannot be combined
    whole = sketches.groupBy(F.lit("all")).agg(F.expr(f"approx_top_k_combine(sketch, {TRACKED})").alias("sketch"))
    found = whole.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {TRACKED})")).alias("t"))
    return found.select(F.col("t.item").alias(key)).filter(F.col(key).isNotNull())


def with_group(rows: DataFrame, key: str, **of_group: Column) -> DataFrame:
    """rows, a stored table, each with aggregates over the rows of its key, which is never null.

    Large groups are counted with partial sums, verified to be large and broadcast; the rest goes by a window over the key.
    """
    least = max(rows.count() / TRACKED, 1.0)
    (size,) = fresh(rows, "group_rows")
    counted = rows.join(F.broadcast(heavy_keys(rows, key)), key).groupBy(key).agg(F.count("*").alias(size), *[c.alias(n) for n, c in of_group.items()])
    large = cut(counted.filter(F.col(size) > least).drop(size), "large")
    settled = rows.join(F.broadcast(large), key)
    others = rows.join(F.broadcast(large.select(key)), key, "left_anti")
    others = others.select("*", *[c.over(Window.partitionBy(key)).alias(n) for n, c in of_group.items()])
    return settled.select(*others.columns).unionByName(others)


def mark(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry_text: bool = False) -> DataFrame:
    """docs without their text (with it, if ``carry_text``) and keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after lower-casing A-Z, null as empty; SHA-256 of the normalised text in UTF-8 stands for it, and
    a group whose texts differ in length is an error.  Of equal texts the row of the largest doc_id stays; rows without one come last,
    and of rows that repeat a doc_id one stays, the last read.  Every row comes back once; an empty table gives none.  Columns of docs that bear
    a result's name are replaced.  Texts are hashed where they are read, whatever their length.
    """
    results = ("keep_id", "group_size", "kept", "text_sha256")
    kept = [c for c in docs.columns if c not in results and (carry_text or c != text)]
    row, size, best = fresh(docs, "row_no", "text_bytes", "winner")
    normal = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    # the row number is stored with the digest, so that every later pass sees the same
    digests = docs.select(*kept, F.sha2(normal, 256).alias("text_sha256"), F.octet_length(normal).alias(size), F.monotonically_increasing_id().alias(row))
    digests = cut(digests, "digests")
    lo, hi = fresh(digests, "least_bytes", "most_bytes")
    found = with_group(
        digests,
        "text_sha256",
        **{best: F.max(F.struct(F.col(doc_id).alias("id"), F.col(row).alias("row"))), "group_size": F.count(F.lit(1)), lo: F.min(size), hi: F.max(size)},
    )
    collide = F.raise_error(F.concat(F.lit("texts of different length share the digest "), "text_sha256")).cast("string")
    return found.select(
        *kept,
        F.col(best)["id"].alias("keep_id"),
        "group_size",
        (F.col(row) == F.col(best)["row"]).alias("kept"),
        F.when(F.col(lo) == F.col(hi), F.col("text_sha256")).otherwise(collide).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one row of each group of equal texts, as ``mark`` tells; all columns stay."""
    clash = [c for c in docs.columns if c in ("keep_id", "group_size", "kept", "text_sha256")]
    held = docs.withColumnsRenamed({c: n for c, n in zip(clash, fresh(docs, *[f"own_{c}" for c in clash]))})
    out = mark(held, text, doc_id, carry_text=True).filter("kept").select(*held.columns)
    return out.toDF(*docs.columns)
