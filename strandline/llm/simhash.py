"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits.  The perfect [23,12,7] Golay code has exactly one
codeword within three bits of any word, so a segment and all its one-bit neighbours decode to at most six codeword indices
of 12 bits, and two segments that differ in at most two bits always share one of these.  Two fingerprints with at most four
differing bits fall under one of two cases, and the keys serve both:

* one segment is equal: of the two others one has at most two errors.  Key: the equal segment and an index of the other one;
* no segment is equal, so the errors are two, one and one: each of the segments with one error has an equal half.  Key: these
  two halves and an index of the segment with two errors.

That is 18 kinds of key with one to six keys each.  Distinct fingerprints that share a key are candidates; each bucket is
verified in numpy and gives a spanning forest of its true links (at most one link a member), not its pairs.  A bucket of over
``MAX_BUCKET`` distinct fingerprints goes another, exact way: each member is filed under every word within two bits of it;
those under one word are all within four bits of each other, and words two apart have one half way, so linking each member to
the least one under each word gives the same components, with work in proportion to the members.

* Null texts and texts without words have fingerprint zero and are linked like any other.  Equal texts have one fingerprint;
  copies only meet as one row.  Repeated rows are kept, each with its component.
* A component's id is the least doc_id in it; documents without a doc_id take it from the others, or null.  Ties do not arise.
* Very long texts are hashed whole, in blocks of shingles; an empty table gives an empty result.  Extra columns pass through,
  whatever their names; those named like outputs are replaced.
* Rows are joined to fingerprints, and fingerprints to components, with hot keys apart (``join_hot``), so none meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .graph import components
from .util import cut, fresh, join_hot, session, small_batches

SHINGLE, SEED, REACH = 4, 42, 4
MAX_BUCKET = 4096
BLOCK = 1 << 15
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
GENERATOR = 0b101011100011  # x^11+x^9+x^7+x^6+x^5+x+1, fixed value
# the wide fingerprint of ``jaccard`` and the bits that its keys pick: 23 for a codeword, and some further ones
WIDE, KINDS, FURTHER = 1024, 640, 6
RNG = np.random.default_rng(20)
MIXERS = RNG.integers(0, 1 << 63, WIDE // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PICKED = np.stack([RNG.choice(WIDE, 23 + FURTHER, replace=False) for _ in range(KINDS)])


def shingle_hashes(text: str | None, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a text, in blocks."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    flat = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    begins = ends - lens
    n = max(1, len(words) - size + 1)
    last = ends[min(size, len(words)) - 1 :]
    digest, view = xxhash.xxh64_intdigest, memoryview(flat)
    for at in range(0, n, BLOCK):
        a, b = begins[at : min(at + BLOCK, n)].tolist(), last[at : min(at + BLOCK, n)].tolist()
        yield np.fromiter((digest(view[i:j], SEED) for i, j in zip(a, b)), np.uint64, len(a))


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """A bit is set if it is set in over half the hashes; without words, zero."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, size):
        n += len(h)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int("".join("1" if 2 * x > n else "0" for x in ones), 2) if n else 0


def add_fingerprint(docs: DataFrame, to: str, text: str = "text", size: int = SHINGLE) -> DataFrame:
    small_batches(session(docs))

    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        seen: dict = {}
        out = []
        for t in texts.to_pylist():
            if t not in seen:
                seen[t] = fingerprint(t, size)
            out.append(seen[t])
        return pa.array(np.array(out, np.uint64).view(np.int64))

    return docs.withColumn(to, prints(F.col(text)))


class Golay:
    """Indices of the codewords near 23-bit words."""

    def __init__(self):
        def rest(v: int) -> int:
            for i in range(22, 10, -1):
                if v >> i & 1:
                    v ^= GENERATOR << (i - 11)
            return v

        one = np.array([rest(1 << i) for i in range(23)], np.int64)
        self.bytes = np.zeros((3, 256), np.int64)
        for k in range(3):
            for b in range(256):
                for i in range(8):
                    if b >> i & 1 and 8 * k + i < 23:
                        self.bytes[k, b] ^= one[8 * k + i]
        self.error = np.zeros(2048, np.int64)
        for i in range(23):
            self.error[one[i]] = 1 << i
            for j in range(i):
                self.error[one[i] ^ one[j]] = 1 << i | 1 << j
                for k in range(j):
                    self.error[one[i] ^ one[j] ^ one[k]] = 1 << i | 1 << j | 1 << k

    def decode(self, v: np.ndarray) -> np.ndarray:
        s = self.bytes[0][v & 255] ^ self.bytes[1][v >> 8 & 255] ^ self.bytes[2][v >> 16]
        return (v ^ self.error[s]) >> 11

    def indices(self, v: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, index) of all codewords that a word or a one-bit neighbour of it decodes to, each once."""
        flips = np.concatenate([[0], 1 << np.arange(bits)])
        found = np.sort(self.decode(v[:, None] ^ flips[None, :]), axis=1)
        new = np.concatenate([np.ones((len(v), 1), bool), np.diff(found, axis=1) > 0], axis=1)
        row, col = np.nonzero(new)
        return row, found[row, col]


GOLAY: list[Golay] = []


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of these fingerprints (uint64)."""
    if not GOLAY:
        GOLAY.append(Golay())
    v = prints.view(np.int64)
    parts = [(v >> first) & ((1 << bits) - 1) for first, bits in SEGMENTS]
    half = [bits // 2 for _, bits in SEGMENTS]
    halves = [(p & ((1 << h) - 1), p >> h) for p, h in zip(parts, half)]
    rows, out, kind = [], [], 0
    for s in range(3):
        row, index = GOLAY[0].indices(parts[s], SEGMENTS[s][1])
        others = [k for k in range(3) if k != s]
        exact = [parts[k] for k in others]
        exact += [halves[others[0]][x] << 11 | halves[others[1]][y] for x in range(2) for y in range(2)]
        for e in exact:
            rows.append(row)
            out.append(kind << 40 | e[row] << 12 | index)
            kind += 1
    return np.concatenate(rows), np.concatenate(out)


def forest(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all of these distinct fingerprints that links of at most REACH bits join; one link a member at most."""
    left = np.arange(1, len(prints))
    a, b, queue = [], [], [0]
    while queue or len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        i = queue.pop()
        near = np.bitwise_count(prints[left] ^ prints[i]) <= REACH
        got = left[near]
        left = left[~near]
        a.append(np.full(len(got), i))
        b.append(got)
        queue += got.tolist()
    return np.concatenate(a or [left]), np.concatenate(b or [left])


def bucket_links(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within the runs of equal keys."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    head = np.repeat(first, size)
    close = np.bitwise_count(value ^ value[head]) <= REACH
    whole = np.minimum.reduceat(close, first) if len(first) else close
    star = np.repeat(whole, size) & (np.arange(len(key)) != head)
    a, b = [value[head[star]]], [value[star]]
    for k in np.flatnonzero(~whole):
        x, y = forest(own := value[first[k] : first[k] + size[k]])
        a.append(own[x])
        b.append(own[y])
    return np.concatenate(a), np.concatenate(b)


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("kind", pa.int32())])


def find_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows ordered by key: links (kind 0), each once a batch, and members of large buckets (kind 1, in a)."""
    held_k, held_v = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    large = None  # the key whose members no longer fit

    def pack(a, b, kind):
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), kind, np.int32))], schema=LINKS)

    def solve(k, v):
        size = np.diff(np.append(np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])), len(k)))
        big = np.repeat(size > MAX_BUCKET, size)
        a, b = bucket_links(k[~big], v[~big])
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
        yield pack(np.ascontiguousarray(pair[:, 0]), np.ascontiguousarray(pair[:, 1]), 0)
        if big.any():
            rest = np.unique(v[big])
            yield pack(rest, rest, 1)

    for batch in batches:
        k = np.asarray(batch.column(0)).astype(np.int64)
        v = np.asarray(batch.column(1)).astype(np.int64).view(np.uint64)
        if large is not None:
            own = k == large
            if own.any():
                rest = np.unique(v[own])
                yield pack(rest, rest, 1)
                k, v = k[~own], v[~own]
            if not len(k):
                continue
            large = None
        k, v = np.concatenate([held_k, k]), np.concatenate([held_v, v])
        if not len(k):
            continue
        last = np.searchsorted(k, k[-1])
        if last:
            yield from solve(k[:last], v[:last])
        held_k, held_v = k[last:], v[last:]
        if len(held_k) > MAX_BUCKET:
            rest = np.unique(held_v)
            yield pack(rest, rest, 1)
            large, held_k, held_v = int(held_k[0]), held_k[:0], held_v[:0]
    if len(held_k):
        yield from solve(held_k, held_v)


def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
        for at in range(0, len(v), 4096):
            part = v[at : at + 4096]
            row, key = keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row].view(np.int64))], names=["key", "print"])


def wide_print(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of a set of shingle hashes, in WIDE bits (uint64): those of the hashes, then those of mixtures of them."""
    ones, n = np.zeros(WIDE, np.int64), len(hashes)
    for at in range(0, n, 240):
        h = hashes[at : at + 240, None]
        mixed = h * MIXERS
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(29)
        mixed[:, :1] = h
        ones += np.unpackbits(mixed.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > n).view(np.uint64)


def wide_keys(prints: np.ndarray, kinds: int) -> np.ndarray:
    """(row, kind): the kind, the index of the codeword nearest to its 23 bits, and its further bits."""
    if not GOLAY:
        GOLAY.append(Golay())
    bits = np.unpackbits(prints.view(np.uint8), axis=1)
    word, rest = (np.zeros((len(prints), kinds), np.int64) for _ in range(2))
    for k in range(23):
        word |= bits[:, PICKED[:kinds, k]].astype(np.int64) << k
    for k in range(FURTHER):
        rest |= bits[:, PICKED[:kinds, 23 + k]].astype(np.int64) << k
    return (np.arange(kinds) << 12 | GOLAY[0].decode(word)) << FURTHER | rest


def near_words(prints: np.ndarray) -> np.ndarray:
    """Every word within two bits, a row for each fingerprint."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    return prints[:, None] ^ np.concatenate([np.zeros(1, np.uint64), one, one[i] | one[j]])[None, :]


def half_way(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
        for at in range(0, len(v), 64):
            part = v[at : at + 64]
            w = near_words(part)
            yield pa.RecordBatch.from_arrays([pa.array(w.ravel().view(np.int64)), pa.array(np.repeat(part, w.shape[1]).view(np.int64))], names=["word", "print"])


def links(prints: DataFrame) -> DataFrame:
    """prints: one long column of distinct fingerprints -> a, b: links that keep every component of them whole."""
    spark = session(prints)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = (
        prints.mapInArrow(key_rows, "key long, print long")
        .repartition(n, "key")
        .sortWithinPartitions("key")
        .mapInArrow(find_links, "a long, b long, kind int")
    )
    found = cut(found.distinct())
    members = found.filter("kind = 1").select("a").distinct()
    words = members.mapInArrow(half_way, "word long, print long")
    least = words.groupBy("word").agg(F.min("print").alias("b"))
    dense = words.join(least, "word").filter("print <> b").select(F.col("print").alias("a"), "b").distinct()
    plain = found.filter("kind = 0").select("a", "b").distinct()
    return plain.unionByName(dense) if found.filter("kind = 1").limit(1).count() else plain


def near_duplicates(docs: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """docs with ``fingerprint`` (16 hex digits) and ``component_id``; texts are not moved, so ask for few columns."""
    kept = [c for c in docs.columns if c.lower() not in ("fingerprint", "component_id")]
    (name,) = fresh(docs, "print")
    printed = cut(add_fingerprint(docs.select(*kept), name, text).drop(text))
    kept = [c for c in kept if c != text]
    ids = cut(printed.groupBy(name).agg(F.min(doc).alias("least")))
    linked = links(ids.select(name))
    found = components(linked.select("a", "b"))
    # the least id over the fingerprints of a component
    grouped = cut(ids.join(found.withColumnRenamed("node", name), name, "left").withColumn("root", F.coalesce("root", name)), "rooted")
    tops = cut(grouped.groupBy("root").agg(F.min("least").alias("component_id")), "tops")
    resolved = cut(join_hot(grouped, tops, "root").select(name, "component_id"), "resolved")
    joined = join_hot(printed, resolved, name)
    return joined.select(*kept, F.lower(F.lpad(F.hex(name), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """One row of each group of near-duplicates, here by the similarity of ``jaccard``: that of the least doc_id (of rows that
    share it, that of the least text hash, and of those the one of the least hash over all columns but maps); same columns."""
    from .jaccard import groups

    key, no, row, pick = fresh(docs, "text_key", "no_doc", "row", "pick")
    light = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"), F.coalesce(F.xxhash64(text), F.lit(0)).alias(key))
    best = groups(light, "text", key).groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("no"), F.col("doc").alias("id"), F.col(key).alias("h"))).alias(pick))
    # plain keys that are never null, so that the rows that repeat one are dropped where the join has put them
    keys = lambda doc, h: [doc.isNull().alias(no), F.coalesce(doc.cast("string"), F.lit("")).alias(row), h.alias(key)]
    best = best.select(*keys(F.col(f"{pick}.id"), F.col(f"{pick}.h")))
    keyed = docs.select("*", *keys(F.col(doc), F.coalesce(F.xxhash64(text), F.lit(0))))
    # of rows that differ in other columns only, the one of the least hash over these, so that reruns agree
    told = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, MapType)])
    one = keyed.join(best, [no, row, key], "left_semi").groupBy(no, row, key).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), told).alias(pick))
    return one.select(f"{pick}.*")
