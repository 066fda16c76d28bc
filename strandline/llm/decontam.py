"""Benchmark decontamination: a broadcast set of the benchmark's normalised n-grams, scanned over every document.

Words are runs of ASCII letters and digits (lower-cased) and of characters beyond ASCII.  A window is ``n`` consecutive words
of an item; an item of fewer words, but not none, is one window of all of them.  A document word inside an occurrence of a
window is hit.  Each document is mapped to the ids of the benchmark's own words; runs of known words are hashed window by
window, looked up in the sorted hashes of the set, and each match is verified on the words themselves.

* What is broadcast is the benchmark's text in blocks of at most ``MAX_BLOCK_WORDS`` words (one item at least), counted
  before.  More blocks mean more scans whose hits are joined; no window is left out.
* Null and empty texts have no words and no hits; very long texts are scanned whole; empty tables of either kind are fine.  Items without words, and null items, have no windows.  Equal items each
  count; rows that repeat an item id count once; an item without an id marks words but is neither listed nor counted (n_items).
* Repeated rows are judged alike; there are no ties.  Extra columns pass through; columns named like outputs are replaced.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import ALNUM, fresh, session, small_batches, stored

N = 10
MAX_BLOCK_WORDS = 2_000_000
HITS = "n_words long, spans array<struct<start: long, stop: long>>, items array<string>"
BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(ALNUM).split()


class Windows:
    """The windows of some items, ready to be looked up."""

    def __init__(self, items: list[tuple[str | None, str]], n: int = N):
        self.vocabulary: dict[bytes, int] = {}
        self.owners: dict[bytes, set] = defaultdict(set)
        hashes: dict[int, list] = defaultdict(list)
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.uint64)
            size = min(n, len(words))
            hashes[size].append(self.rolled(ids, np.arange(len(words) - size + 1), size))
            for i in range(len(words) - size + 1):
                self.owners[b" ".join(words[i : i + size])].add(item)
        self.hashes = {size: np.unique(np.concatenate(h)) for size, h in hashes.items()}

    @staticmethod
    def rolled(ids: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        h = np.zeros(len(starts), np.uint64)
        for k in range(size):
            h = h * BASE + ids[starts + k]
        return h

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word spans covered by windows, merged, and the items that own them."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.uint64, len(words))
        strange = np.concatenate([[0], np.cumsum(ids == 0)])
        found, items = [], set()
        for size, hashes in self.hashes.items():
            if len(words) < size:
                continue
            starts = np.flatnonzero(strange[size:] == strange[:-size])
            if not len(starts):
                continue
            h = self.rolled(ids, starts, size)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for i in starts[hashes[at] == h].tolist():
                if owners := self.owners.get(b" ".join(words[i : i + size])):
                    items |= owners
                    found.append((i, i + size))
        merged: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged, items


BUILT: dict = {}


def built(key, items: list[tuple[str | None, str]], n: int) -> Windows:
    """One set for each Python worker and broadcast."""
    if key not in BUILT:
        BUILT.clear()
        BUILT[key] = Windows(items, n)
    return BUILT[key]


def scanner(spark: SparkSession, items: list[tuple[str | None, str]], n: int):
    """An Arrow function from texts to the struct HITS."""
    sent = spark.sparkContext.broadcast(items)
    key = hashlib.sha256(repr((n, items)).encode()).hexdigest()
    kind = pa.struct(
        [("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("items", pa.list_(pa.string()))]
    )

    @F.arrow_udf(HITS)
    def scan(texts: pa.Array) -> pa.Array:
        windows = built(key, sent.value, n)
        out = []
        for text in texts.to_pylist():
            words = words_of(text or "")
            spans, found = windows.scan(words)
            out.append(
                {"n_words": len(words), "spans": [{"start": a, "stop": b} for a, b in spans], "items": sorted(i for i in found if i is not None)}
            )
        return pa.array(out, kind)

    return scan


def blocks(benchmark: DataFrame, item: str, text: str, most: int = MAX_BLOCK_WORDS) -> list[DataFrame]:
    """The benchmark in blocks of about ``most`` words."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.regexp_count("text", F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")))).first()[0] or 0
    count = max(1, -(-total // most))
    if count == 1:
        return [items]
    return [items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == i) for i in range(count)]


def find_hits(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = N, most: int = MAX_BLOCK_WORDS
) -> DataFrame:
    """docs with ``hits``: a struct of n_words, merged word spans and the sorted ids of items found."""
    spark = session(docs)
    small_batches(spark)
    parts = blocks(benchmark, item, item_text, most)
    docs = docs.drop("hits")
    if len(parts) == 1:
        scan = scanner(spark, [tuple(r) for r in parts[0].collect()], n)
        return docs.withColumn("hits", scan(F.col(text)))
    # several blocks: the hits of each are stored, then joined by text; only texts with hits are moved
    (key,) = fresh(docs, "key")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(text, F.lit("")), F.length(text)))
    found = None
    for part in parts:
        scan = scanner(spark, [tuple(r) for r in part.collect()], n)
        hits = stored(keyed.select(key, scan(F.col(text)).alias("h")).filter("size(h.spans) > 0").dropDuplicates([key]), "hits")
        found = hits if found is None else found.unionByName(hits)
    merged = found.groupBy(key).agg(
        F.flatten(F.collect_list("h.spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("h.items")))).alias("items")
    )
    step = (
        "if(size(acc) > 0 and element_at(acc, -1).stop >= s.start, "
        "concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).start as start, greatest(element_at(acc, -1).stop, s.stop) as stop))), "
        "concat(acc, array(struct(s.start as start, s.stop as stop))))"
    )
    merged = merged.withColumn("spans", F.expr(f"aggregate(array_sort(spans), cast(array() as array<struct<start: bigint, stop: bigint>>), (acc, s) -> {step})"))
    count = scanner(spark, [], n)
    return (
        keyed.join(merged, key, "left")
        .withColumn(
            "hits",
            F.struct(
                count(F.col(text))["n_words"].alias("n_words"),
                F.coalesce("spans", F.expr("cast(array() as array<struct<start: bigint, stop: bigint>>)")).alias("spans"),
                F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
            ),
        )
        .select(*docs.columns, "hits")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, how: str = "documents", text: str = "text", **how_found) -> DataFrame:
    """docs without contamination, same columns: ``documents`` drops each document with a hit; ``spans`` cuts the hit words
    and what stands between them."""
    found = find_hits(docs, benchmark, text, **how_found)
    if how == "documents":
        return found.filter("size(hits.spans) = 0").select(*docs.columns)

    @F.arrow_udf("string")
    def cut_out(texts: pa.Array, hits: pa.Array) -> pa.Array:
        return pa.array([without(t, h["spans"]) if t is not None and h["spans"] else t for t, h in zip(texts.to_pylist(), hits.to_pylist())], pa.string())

    return found.withColumn(text, cut_out(F.col(text), F.col("hits"))).select(*docs.columns)


def without(text: str, spans: list[dict]) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    flat = np.frombuffer(raw.translate(ALNUM), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flat.astype(np.int8), [0]])))
    begins, ends = edge[::2], edge[1::2]
    out, last = [], 0
    for s in spans:
        out.append(raw[last : begins[s["start"]]])
        last = ends[s["stop"] - 1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")


def report(found: DataFrame) -> DataFrame:
    """The counts of each document that find_hits has seen."""
    n_hit = F.expr("aggregate(hits.spans, 0L, (n, s) -> n + s.stop - s.start)")
    return found.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
