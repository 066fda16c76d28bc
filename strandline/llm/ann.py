"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

A unit vector, padded with zeros to a power of two, is turned by three rounds of random signs and a fast Hadamard
transform; the nearest vertex of the cross-polytope, its largest coordinate in size with the sign, is its code.  ``TABLES``
such rotations give each row as many codes.  Each query probes, in every table, the ``PROBES`` vertices nearest to its own
rotation; rows filed under them are candidates, and every candidate is ranked by its exact cosine on the original vectors.

Rows and queries are hashed once, where they are read, and meet by table and code in a shuffle: a row is sent once for each
table, a query once for each probe.  A code of many rows or queries is dealt as cells of about ``ROW_BLOCK`` rows by
``QUERY_BLOCK`` queries, so no cell grows with the data; how many each code needs comes from its counts, of which there are at
most ``TABLES`` times twice the padded length.  Each cell gives the best ``k`` of each of its queries, by one matrix product
and exact cosines of what comes near the k-th.  Of equal vectors in a cell only the 2 k rows of least ids are looked at: no
more than k of them, beside those of the query's own id, can be among the nearest.

A query whose buckets hold fewer than ``k`` rows is answered exactly, by all rows in blocks of the same size; so small and
one-sided tables give whole results.  Nothing is collected to the driver but the counts of codes.

* Vectors that are null or zero, or hold a null or a value that is not finite, take no part; nor do those whose length is not
  that of most vectors.  Rows without an id take no part.
* Equal cosines go to the smaller id.  Rows that repeat an id each stand for themselves, as queries too; a query never meets its
  own id.  An empty table, or one without queries, gives an empty result.  There are no texts; other columns, whatever their
  names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import cut, session

TABLES, PROBES, SEED = 6, 16, 7
QUERY_BLOCK, ROW_BLOCK = 4096, 16384
SLACK = 1e-9  # what a matrix product may be off from the exact cosine
CELL = ["t", "code", "rows_at", "queries_at"]
HASHED = "id long, row long, asks boolean, v binary, codes array<int>, probes array<int>"
FOUND = "query long, query_id long, row long, vec_id long, score double"
RESULT = "query_id long, rank int, vec_id long, score double"


class Rotations:
    def __init__(self, dim: int, tables: int = TABLES, seed: int = SEED):
        self.dim, self.size = dim, 1 << max(0, dim - 1).bit_length()
        self.signs = np.random.default_rng(seed).integers(0, 2, (tables, 3, self.size)).astype(np.float32) * 2 - 1

    def turn(self, x: np.ndarray, table: int) -> np.ndarray:
        v = np.zeros((len(x), self.size), np.float32)
        v[:, : self.dim] = x
        for signs in self.signs[table]:
            v *= signs
            step = 1
            while step < self.size:
                v = v.reshape(len(x), -1, 2, step)
                v = np.stack([v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]], axis=2)
                step *= 2
            v = v.reshape(len(x), self.size) / np.float32(np.sqrt(self.size))
        return v

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(table, row): twice the axis, plus one if the sign is negative."""
        out = np.empty((len(self.signs), len(x)), np.int32)
        for t in range(len(self.signs)):
            v = self.turn(x, t)
            axis = np.abs(v).argmax(axis=1)
            out[t] = 2 * axis + (v[np.arange(len(x)), axis] < 0)
        return out

    def probes(self, x: np.ndarray, count: int) -> np.ndarray:
        """(table, row, probe): the vertices with the largest inner products."""
        out = []
        for t in range(len(self.signs)):
            v = self.turn(x, t)
            both = np.stack([v, -v], axis=2).reshape(len(x), -1)
            out.append(np.argsort(-both, axis=1, kind="stable")[:, :count])
        return np.stack(out)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of one vector with each row of the others, in double precision, the same for equal rows wherever they stand."""
    return (b * a).sum(axis=1) / (np.sqrt((b * b).sum(axis=1)) * np.sqrt((a * a).sum()))


def unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)
    y = x / big
    return (y / np.sqrt((y * y).sum(axis=1, keepdims=True))).astype(np.float32)


def usable(vectors: DataFrame, vector: str, dim: int) -> Column:
    """Whether a vector takes part; never null."""
    v = F.col(vector)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(v.isNotNull() & (F.size(v) == dim) & good, F.lit(False))


def hashed(base: DataFrame, dim: int, tables: int, probes: int, kind: str) -> DataFrame:
    """id, row, asks, v -> HASHED: the vector as bytes of its kind of numbers, its codes and, for queries, its probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotations = Rotations(dim, tables)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            asks = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            u = unit(x)
            probed: list = [None] * len(x)
            if asks.any():
                for i, row in zip(np.flatnonzero(asks), rotations.probes(u[asks], probes).transpose(1, 0, 2).reshape(asks.sum(), -1)):
                    probed[i] = row.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), batch.column(2), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()),
                    pa.array(rotations.codes(u).T.tolist(), pa.list_(pa.int32())), pa.array(probed, pa.list_(pa.int32())),
                ],
                names=[c.split()[0] for c in HASHED.split(", ")],
            )

    return cut(base.mapInArrow(run, HASHED), "hashed")


def matched(k: int, dim: int, kind: str):
    """The best k rows of a cell for each of its queries, as a function of the two tables."""

    def own(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = np.frombuffer(b"".join(table.column("v").to_pylist()), kind).reshape(-1, dim).astype(np.float64)
        return table.column("row").to_numpy(), table.column("id").to_numpy(), v

    def run(asked: pa.Table, filed: pa.Table) -> pa.Table:
        out: list[list] = [[np.zeros(0, np.int64)] for _ in range(4)] + [[np.zeros(0)]]
        if asked.num_rows and filed.num_rows:
            query, query_id, q = own(asked)
            row, vec_id, x = own(filed)
            # of equal vectors, at most k rows of an id and 2 k rows in all
            same = np.unique(x.view(f"V{8 * dim}").ravel(), return_inverse=True)[1]
            order = np.lexsort((row, vec_id, same))
            order = order[rank_in_run(same[order], vec_id[order]) < k]
            order = order[rank_in_run(same[order]) < 2 * k]
            row, vec_id, x = row[order], vec_id[order], x[order]
            near = (q / np.sqrt((q * q).sum(axis=1, keepdims=True))) @ (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).T
            near[query_id[:, None] == vec_id[None, :]] = -np.inf
            least = np.partition(near, len(row) - k, axis=1)[:, len(row) - k] - SLACK if len(row) > k else np.full(len(q), -2.0)
            for i in range(len(q)):
                at = np.flatnonzero((near[i] >= least[i]) & (near[i] > -np.inf))
                score = cosine(q[i], x[at])
                top = np.lexsort((row[at], vec_id[at], -score))[:k]
                for part, c in zip(out, (np.full(len(top), query[i]), np.full(len(top), query_id[i]), row[at[top]], vec_id[at[top]], score[top])):
                    part.append(c)
        return pa.table([pa.array(np.concatenate(c)) for c in out], names=[c.split()[0] for c in FOUND.split(", ")])

    return run


def rank_in_run(*keys: np.ndarray) -> np.ndarray:
    """Of each place in a run of equal keys, how many of the run stand before it."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    first = np.flatnonzero(new)
    return np.arange(len(new)) - np.repeat(first, np.diff(np.append(first, len(new))))


def meet(asked: DataFrame, filed: DataFrame, k: int, dim: int, kind: str) -> DataFrame:
    """Queries and rows (row, id, v) that share t and code -> FOUND, the best k of each cell.  There are few pairs of t and code."""
    size = lambda df, n, block: df.groupBy("t", "code").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias(n))
    cells = cut(size(asked, "query_cells", QUERY_BLOCK).join(size(filed, "row_cells", ROW_BLOCK), ["t", "code"]), "cells")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("row"), F.col(n).cast("long")).cast("int")
    left = asked.join(F.broadcast(cells), ["t", "code"]).withColumn("queries_at", own("query_cells")).withColumn("rows_at", spread("row_cells"))
    right = filed.join(F.broadcast(cells), ["t", "code"]).withColumn("rows_at", own("row_cells")).withColumn("queries_at", spread("query_cells"))
    fields = [F.col(c).alias(c) for c in (*CELL, "row", "id", "v")]  # named anew: both sides come from one table
    return left.select(*fields).groupBy(*CELL).cogroup(right.select(*fields).groupBy(*CELL)).applyInArrow(matched(k, dim, kind), FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, each row once."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return found.dropDuplicates(["query", "row"]).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = 5, doc: str = "vec_id", vector: str = "embedding", tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row for which the condition is_query holds."""
    spark = session(vectors)
    base = vectors.select(F.col(doc).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null")
    dims = base.filter("size(v) > 0").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return spark.createDataFrame([], RESULT)
    dim = dims["d"]
    base = base.filter(usable(base, "v", dim)).select("id", F.monotonically_increasing_id().alias("row"), "asks", "v")
    kind = "<f4" if vectors.select(vector).dtypes[0][1] == "array<float>" else "<f8"  # as exact as they came
    stored = hashed(base, dim, tables, probes, kind)
    asks, each = stored.filter("asks"), min(probes, 2 * Rotations(dim, 1).size)
    asked = asks.select("row", "id", "v", F.posexplode("probes").alias("at", "code")).withColumn("t", F.floor(F.col("at") / each).cast("int"))
    filed = stored.select("row", "id", "v", F.posexplode("codes").alias("t", "code"))
    found = cut(best(meet(asked, filed, k, dim, kind), k), "found")
    some = found.groupBy(F.col("query").alias("row")).agg(F.count("*").alias("n")).filter(F.col("n") >= k)
    short = cut(asks.join(some, "row", "left_anti").select("row", "id", "v"), "short")
    whole = found.select("query_id", "rank", "vec_id", "score")
    if not short.limit(1).count():
        return whole
    # too few in the probed buckets: all rows, in blocks
    n = -(-stored.count() // ROW_BLOCK)
    block = stored.select("row", "id", "v", F.lit(-1).alias("t"), F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias("code"))
    everywhere = short.select("row", "id", "v", F.lit(-1).alias("t"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("code"))
    rest = best(meet(everywhere, block, k, dim, kind), k).select("query_id", "rank", "vec_id", "score")
    enough = found.join(short.select(F.col("row").alias("query")), "query", "left_anti").select("query_id", "rank", "vec_id", "score")
    return enough.unionByName(rest)
