"""Connected components of a link table by alternating large-star and small-star steps, with joins and minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import cut, drop_cut

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> node, root: the least node that can be reached, for each node in a link.

    Each round, every node hands its larger neighbours, then its smaller ones, to the least of its neighbours and itself.
    Minima are combined before the shuffle and the joins may be split where a node has many links, so no node's
    neighbours ever meet in one task.  Rounds are cut in the shared folder, each deleted when the next is written; the loop
    ends when nothing moves.
    """
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # after the large star each link points to a smaller node; small star: all smaller neighbours to the least
        stars = cut(large.unionByName(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct())
        large = stars
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges, old = cut(small.filter("u <> v").distinct()), (edges, stars)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for df in old:
            drop_cut(df)
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    flat = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return flat.unionByName(flat.select(F.col("root").alias("node"), "root").distinct())
