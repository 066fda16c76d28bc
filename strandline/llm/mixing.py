"""Mixing sources to target weights by cube-method balanced sampling.

Targets: the sources, by code point and null last, take the weights in turn and share the words of all documents; a target
stops at ``cap`` times its source's words and the excess is shared again by weight, until none is above.  A document of a
source with target T and words S is due T / S copies: the whole part is certain, the fraction is its inclusion probability.

The cube method turns the fractions into zeros and ones.  Each step moves the probabilities of up to ``WINDOW`` units of a
source along a direction that changes neither the expected words nor the expected documents, in one of its two senses with the
chances that keep each expectation, until one of them is settled.  The direction is the longest document's own, projected on
the constraints' null-space, so long documents are settled while there are others to make up for them.  Blocks of at most
``BLOCK`` units each leave at most ``LANDING`` short ones unsettled; these go to the next round's blocks, and so on, so a hot
source is spread over many tasks and no task grows.  What a source's last block leaves is the landing problem.  It is solved by
linear programming: of all ways to draw subsets of these units that give each unit its probability, the one with the least
expected distance from the expected words and documents.  So every document's chance of the further copy is its fraction, exactly,
but where the draw would miss the source's target by over ``NEAR``: no draw can keep the chances of few documents and the target
too, and the target goes first, by the subset of these units that comes nearest to it and by single units of the block that mend the rest.

* The unit is a (doc_id, source) pair, and where doc_id is null a text of a source; rows that repeat one are taken alike.  Null,
  empty and blank texts have size 0 and are never short of their target; very long texts count whole; a null source is a source.
* Blocks run from the longest document to the shortest, ties by id.
* All draws come from ``seed``, source, round and block: reruns agree.
* An empty table gives an empty result.  ``mix`` reads three columns, whatever the others are named; ``sample`` passes all
  through, and a column named ``copy`` is replaced.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import cut, fresh, session

WEIGHTS, CAP, BLOCK, WINDOW, LANDING, SEED = (5, 2, 1), 3, 2048, 128, 12, 20240307
WORD = "[^\\x20\\x09-\\x0D]+"
EPS = 1e-9
LP_STEPS = 2000
LONG = 1 / 2  # of the words expected from a block
FEW_SOURCES = 100_000  # so many targets are broadcast
NEAR = 0.002  # of a source's target, by which a landing may miss
UNITS = "id long, text long, source string, size long, target double, p double, taken int, open boolean"


def word_count(text: str) -> Column:
    """Words of a text, none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, size -> source, source_size, target.  One row for each source; only these meet in one task."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(cap))
    per = per.withColumn("ratio", F.col("most") / F.col("w"))
    filled = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(filled), F.lit(0))
    weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(filled), F.lit(0))
    per = per.withColumn("level", left / weight)
    # full sources come first; the first that the level does not fill sets it for itself and all after
    per = per.withColumn("fill", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    return per.select("source", "source_size", F.least(F.col("most").cast("double"), F.col("w") * F.col("fill")).alias("target"))


def direction(size: np.ndarray, long: float) -> np.ndarray:
    """Of the first unit, or the next that can move, within the null-space of words and documents; zeros if none can.

    A unit of over ``long`` words moves against all others alike, which keeps the words alone: within both
    constraints, the next longest would be used up before it is settled."""
    if size[0] > long and size[1:].any():
        return np.append(1.0, np.full(len(size) - 1, -size[0] / size[1:].sum()))
    off = size - size.mean()
    spread = off @ off
    for k in range(len(size)):
        u = -off * (off[k] / spread) - 1 / len(size) if spread > 0 else np.full(len(size), -1 / len(size))
        u[k] += 1
        if (big := np.abs(u).max()) > 1e-6:
            return np.where(np.abs(u) < 1e-12 * big, 0, u / big)
    return np.zeros(len(size))


def settle(size: list[float], p: list[float], land: bool, rng: random.Random, near: float = np.inf) -> list[float]:
    """The flight over these units, longest first, until LANDING or fewer are open; with land, until all are zero or one, and if
    that misses the words expected by more than near, the open units become the subset that misses least."""
    size, p = np.array(size, float), np.array(p, float)
    live = np.flatnonzero((p > 0) & (p < 1))
    long = LONG * (size @ p)
    while len(live) > LANDING:
        w = live[:WINDOW]
        u, q = direction(size[w], long), p[w]
        if not u.any():
            break
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf)).min()
            down = np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf)).min()
        q = q + (up if rng.random() * (up + down) < down else -down) * u
        p[w] = np.where(q < EPS, 0.0, np.where(q > 1 - EPS, 1.0, q))
        live = live[(p[live] > 0) & (p[live] < 1)]
    if land and len(live):
        due = p[live] @ size[live]
        drawn = landed(size[live], p[live], rng.random())
        p[live] = drawn if abs(drawn @ size[live] - due) <= near else nearest(size[live], p[live])
        turned(size, p, float(p[live] @ size[live] - due), near)
    return p.tolist()


def turned(size: np.ndarray, p: np.ndarray, over: float, near: float) -> None:
    """While the words are over (or, below zero, under) by more than near, turn the unit, in or out, that mends most."""
    while abs(over) > near:
        off = np.abs(over + (1 - 2 * p) * size)
        k = int(off.argmin())
        if off[k] >= abs(over):
            break
        over += (1 - 2 * p[k]) * size[k]
        p[k] = 1 - p[k]


def subsets(n: int) -> np.ndarray:
    return ((np.arange(1 << n)[:, None] >> np.arange(n)) & 1).astype(np.float64)


def nearest(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The subset of a few units whose words, then documents, are nearest to what is expected."""
    bits = subsets(len(p))
    off = bits - p
    return bits[np.lexsort((np.abs(off.sum(axis=1)), np.round(np.abs(off @ size), 6)))[0]]


def landed(size: np.ndarray, p: np.ndarray, at: float) -> np.ndarray:
    """A subset of a few units, drawn so that each is in with its probability and the expected distance is least; at: the draw.

    The simplex method over all subsets, from the distribution that adds units in the order of their probabilities.  Every step
    keeps the probabilities, so it may stop at any.
    """
    n = len(p)
    bits = subsets(n)
    off = bits - p
    cost = np.abs(off @ size) / max(size.mean(), 1) + np.abs(off.sum(axis=1))
    rows = np.vstack([np.ones(1 << n), bits.T])
    order = np.argsort(-p, kind="stable")
    basis = np.concatenate([[0], np.cumsum(1 << order)])
    weight = np.append(1.0, p[order]) - np.append(p[order], 0.0)
    inverse = np.linalg.inv(rows[:, basis])
    for _ in range(LP_STEPS):
        reduced = cost - (cost[basis] @ inverse) @ rows
        new = int(reduced.argmin())
        if reduced[new] > -EPS:
            break
        move = inverse @ rows[:, new]
        up = np.flatnonzero(move > EPS)
        ratio = np.maximum(weight[up], 0) / move[up]
        out = up[ratio.argmin()]
        step = max(weight[out], 0) / move[out]
        weight = weight - step * move
        weight[out], basis[out] = step, new
        pivot = inverse[out] / move[out]
        inverse = inverse - np.outer(move, pivot)
        inverse[out] = pivot
    weight = np.maximum(weight, 0)
    return bits[basis[min(int(np.searchsorted(np.cumsum(weight), at * weight.sum(), side="right")), n)]]


def flight(seed: int, level: int):
    """The flight over one block, as a function of its rows."""

    def one(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["size", "id", "text"], ascending=[False, True, True], na_position="last", kind="stable")
        first = df.iloc[0]
        rng = random.Random(zlib.crc32(repr((seed, level, first["source"], int(first["block"]))).encode("utf-8", "replace")))
        p = settle(df["size"].astype(float).tolist(), df["p"].tolist(), first["blocks"] == 1, rng, NEAR * first["target"])
        return pd.DataFrame({"id": df["id"], "text": df["text"], "source": df["source"], "size": df["size"], "target": df["target"], "p": p, "taken": [int(x == 1) for x in p], "open": [0 < x < 1 for x in p]})

    return one


def fly(units: DataFrame, seed: int, block: int) -> DataFrame:
    """id, text, source, size, target, p -> id, text, source, drawn (0 or 1)."""
    done = None
    units = units.select("id", "text", "source", "size", "target", "p")
    for level in range(64):
        counts = units.groupBy("source").agg(F.ceil(F.count("*") / F.lit(block)).cast("long").alias("blocks"))
        blocked = units.join(counts.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        blocked = blocked.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + level), "id", "text", "size"), "blocks"))

        # in as many tasks as the session's setting says: blocks are small in bytes, but not in work
        dealt = blocked.repartition(int(session(units).conf.get("spark.sql.shuffle.partitions")), "source", "block")
        out = cut(dealt.groupBy("source", "block").applyInPandas(flight(seed, level), UNITS))
        settled = out.filter("not open").select("id", "text", "source", F.col("taken").alias("drawn"))
        done = settled if done is None else done.unionByName(settled)
        units = out.filter("open")
        if not units.limit(1).count():
            return done
    raise RuntimeError("units stayed open")


def same_unit(a: str, b: str) -> Column:
    """Whether the columns id, text and source with these prefixes tell of one unit."""
    return F.col(f"{a}id").eqNullSafe(F.col(f"{b}id")) & (F.col(f"{a}text") == F.col(f"{b}text")) & F.col(f"{a}source").eqNullSafe(F.col(f"{b}source"))


def unit_columns(doc: str, text: str, source: str) -> list[Column]:
    """id, text (the hash of a text without an id, else 0) and source."""
    marked = F.when(F.col(doc).isNull(), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))
    return [F.col(doc).cast("long").alias("id"), marked.alias("text"), F.col(source).cast("string").alias("source")]


def plan(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows, units): rows of docs as id, text, source, size; units with source_size, target and copies."""
    rows = cut(docs.select(*unit_columns(doc, text, source), word_count(text).alias("size")))
    due = cut(targets(rows).withColumnRenamed("source", "_s"), "targets")
    units = rows.groupBy("id", "text", "source").agg(F.sum("size").alias("size"))
    due = F.broadcast(due) if due.count() <= FEW_SOURCES else due
    units = units.join(due, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = units.withColumn("whole", F.floor(rate + EPS).cast("int")).withColumn("p", F.greatest(rate - F.col("whole"), F.lit(0.0)))
    units = cut(units)
    drawn = fly(units.filter(F.col("p") > EPS), seed, block).select(F.col("id").alias("_id"), F.col("text").alias("_text"), F.col("source").alias("_source"), "drawn")
    units = units.join(drawn, same_unit("", "_"), "left")
    return rows, units.select("id", "text", "source", "source_size", "target", (F.col("whole") + F.coalesce("drawn", F.lit(0))).alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (words), a row for each row of docs."""
    rows, units = plan(docs, **how)
    units = units.withColumnsRenamed({"id": "_id", "text": "_text", "source": "_source"})
    joined = rows.join(units, same_unit("", "_"))
    return joined.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def sample(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its columns and ``copy`` from 1."""
    _, units = plan(docs, doc=doc, text=text, source=source, **how)
    own, unit = fresh(docs, "own", "unit")
    keyed = docs.drop("copy").withColumn(own, F.struct(*unit_columns(doc, text, source)))
    units = units.filter("copies > 0").select(F.struct("id", "text", "source", "copies").alias(unit))
    joined = keyed.join(units, same_unit(f"{own}.", f"{unit}."))
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(f"{unit}.copies")))).drop(own, unit)
