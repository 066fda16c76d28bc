"""Scoring by a deleted-interpolation bigram model.

P(w | h) mixes three maximum-likelihood estimates, c(h,w)/c(h), c(w)/N and 1/(V+1), with weights that depend on the bucket of
the context's frequency c(h) (powers of two; contexts never seen have one of their own).  The weights come from
expectation-maximisation on held-out counts: every training document is deleted in turn, so its own counts are taken from
the corpus's before its tokens are predicted.  The mixture is normalised over the V training tokens and one unknown token.

No table of words or pairs is ever broadcast or joined row by row.  Documents are turned once into chunks of at most
``CHUNK`` tokens (or one document): sorted 64-bit word hashes and local codes, packed by byte planes, in a bucketed table.

1. Each chunk sends its words, dealt by hash, with training counts; a bucket adds up equal words and answers each chunk in
   its own order.  N and V are sums over the buckets.
2. Each chunk sends its pairs in the same way, but only those of which other chunks hold both words; for the others the
   chunk's own count is the corpus's.
3. Each chunk, with both answers, adds its tokens to a histogram of (context bucket, estimates), which is of bounded size
   however large the corpus and is where EM runs; then it scores its documents.

Counts are exact, over all whole training texts.  A word is known by its 64-bit hash, a pair by 56 bits of one; of a billion words
0.03 pairs are expected to coincide.  A frequent word is one entry in a chunk, so no word is hot; buckets hold words, not tokens.

Buckets and tasks are as many as a quarter of the chunks, at least the session's shuffle partitions, so what one of them holds
stays the same as the corpus grows: about four chunks' words, pairs or answers.  Beyond ``DIRECT`` buckets chunks reach them in two
steps (``Ways``), so the packets do not grow with the square of the corpus.

* Null and empty texts are one end token; very long ones are one chunk's and scored whole.  Documents without an id train and are
  not held out.  Rows that repeat each count.  Ties do not arise.  An empty table gives an empty result; other columns, whatever
  their names, are not looked at.
* Without training tokens all counts are zero and every token has the unknown token's probability, 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import cut, encode_words, session, small_batches

CHUNK = 1_000_000
SHARE = 4  # chunks to a bucket or task
DIRECT = 256  # buckets that every chunk sends to itself
END = np.uint64(xxhash.xxh64_intdigest(b"\x00end", 0))  # no word holds a space or is led by a zero byte alone
CONTEXTS = 40  # buckets of c(h): 0, 1, 2-3, 4-7, ...
STEPS = 8  # histogram bins for a factor of two
ROUNDS = 40
PAIR_BITS = np.uint64(8)


# ---- packing


def pack(x: np.ndarray) -> bytes:
    """Non-negative integers below 2^64, byte plane by byte plane, compressed."""
    x = np.ascontiguousarray(x, np.uint64)
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = x.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + len(x).to_bytes(8, "little") + zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(b: bytes) -> np.ndarray:
    width, n = b[0], int.from_bytes(b[1:9], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[9:], max_output_size=max(1, n * width)), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(np.uint64).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=np.uint64)


# ---- chunks

CHUNKS = "chunk long, docs array<long>, held array<boolean>, sizes binary, words binary, codes binary"


def hashed(words: pa.Array) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, 0) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, held, text) rows to chunks."""
    serial = TaskContext.get().partitionId() << 24
    ids, held, sizes, parts = [], [], [], []
    n = 0

    def emit() -> pa.RecordBatch:
        nonlocal serial
        words, back = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
        starts = np.cumsum([0] + [len(w) for w, _ in parts])
        codes = np.concatenate([back[s + c] for (_, c), s in zip(parts, starts)])
        row = {"chunk": [serial], "docs": [list(ids)], "held": [list(held)], "sizes": [pack(np.array(sizes))], "words": [pack_sorted(words)], "codes": [pack(codes)]}
        serial += 1
        return pa.RecordBatch.from_pydict(row, pa.schema([("chunk", pa.int64()), ("docs", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.binary()), ("words", pa.binary()), ("codes", pa.binary())]))

    for batch in batches:
        offsets, codes, words = encode_words(pc.ascii_lower(pc.fill_null(batch.column(2), "")))
        lens = np.diff(offsets)
        # an end after each document's words
        ends = offsets[1:] + np.arange(len(lens))
        full = np.empty(len(codes) + len(lens), np.int64)
        mask = np.ones(len(full), bool)
        mask[ends] = False
        full[mask] = codes
        full[ends] = len(words)
        parts.append((np.append(hashed(words), END), full))
        ids += batch.column(0).to_pylist()
        held += batch.column(1).to_pylist()
        sizes += (lens + 1).tolist()
        n += len(full)
        if n >= CHUNK:
            yield emit()
            ids, held, sizes, parts, n = [], [], [], [], 0
    if n:
        yield emit()


class Chunk:
    def __init__(self, docs, held, sizes: bytes, words: bytes, codes: bytes):
        self.docs, self.held = docs, np.array(held, bool)
        self.sizes, self.words, self.codes = unpack(sizes).astype(np.int64), unpack_sorted(words), unpack(codes).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.train = ~self.held[self.doc]
        end = int(np.searchsorted(self.words, END))
        self.before = np.concatenate([[end], self.codes[:-1]])  # every document begins after an end
        self.counts = np.bincount(self.codes[self.train], minlength=len(self.words))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs (before * words + word) ascending, each token's place among them, training counts."""
        pair, back = np.unique(self.before * len(self.words) + self.codes, return_inverse=True)
        return pair, back, np.bincount(back[self.train], minlength=len(pair))

    def asked(self, pair: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs the chunk can't count alone, and their keys; shared: words that other chunks hold too."""
        h, w = pair // len(self.words), pair % len(self.words)
        which = np.flatnonzero(shared[h] & shared[w])
        a, b = self.words[h[which]], self.words[w[which]]
        key = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0xD1B54A32D192ED03) + (a << np.uint64(23)))
        key ^= key >> np.uint64(32)
        key *= np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(29)
        return which, key >> PAIR_BITS


def chunk_of(row) -> Chunk:
    return Chunk(row.docs, row.held, row.sizes, row.words, row.codes)


# ---- sums over all chunks, answered in each chunk's order

ASKED = "part int, chunk long, keys binary, counts binary"
ANSWER = "chunk long, part int, totals binary, n long, v long"


class Ways:
    """How chunks reach the buckets: in one step while these are at most ``direct``, else in two.

    In two steps a chunk sends to ``first`` wide buckets only.  A cell has what ``per_group`` chunks sent to one wide bucket; it adds
    that up and sends the sums on to the ``fine`` buckets of its own, whose answers it hands back to its chunks.  With as many wide
    buckets as the root of all buckets a chunk sends that many packets, and a cell as many again, so packets grow with the chunks'
    power of 1.5, not with their square; cells and buckets still hold about ``SHARE`` chunks' worth.
    """

    def __init__(self, chunks: int, least: int, direct: int):
        self.buckets = max(least, -(-chunks // SHARE))
        self.two = self.buckets > direct
        self.first = max(1, round(self.buckets**0.5)) if self.two else self.buckets
        self.fine = -(-self.buckets // self.first)
        self.buckets = self.first * self.fine
        self.groups = max(1, -(-chunks // (SHARE * self.first)))

    def cell(self) -> Column:
        return F.col("part").cast("long") * self.groups + F.pmod(F.xxhash64("chunk"), F.lit(self.groups))


def deal(chunk: int, keys: np.ndarray, told: np.ndarray, parts: int, bits: int) -> tuple[list, np.ndarray]:
    """Rows for the buckets, by the keys' leading bits, and the order in which answers come back."""
    order = np.argsort(keys, kind="stable")
    k, c = keys[order], told[order]
    part = ((k >> np.uint64(bits - 24)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)
    held, at = np.unique(part, return_index=True)
    return [(int(p), chunk, pack_sorted(k[a:b]), pack(c[a:b])) for p, a, b in zip(held, at, np.append(at[1:], len(k)))], order


def added(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct keys of some packets, what is told of each, and where each packet's keys stand among them.

    Told is twice the training count, and one more if several chunks hold the key, if only in held-out documents.
    """
    keys = [unpack_sorted(b) for b in group["keys"]]
    told = np.concatenate([unpack(b) for b in group["counts"]])
    distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(back, (told >> np.uint64(1)).astype(np.float64), len(distinct)).astype(np.uint64)
    several = (np.bincount(back, minlength=len(distinct)) > 1) | (np.bincount(back, (told & np.uint64(1)).astype(np.float64), len(distinct)) > 0)
    return distinct, total * np.uint64(2) + several.astype(np.uint64), np.split(back, np.cumsum([len(k) for k in keys])[:-1])


def answers(group: pd.DataFrame, told: np.ndarray, places: list[np.ndarray], n: int, v: int) -> pd.DataFrame:
    out = pd.DataFrame({"chunk": group["chunk"], "part": group["part"], "totals": [pack(told[at]) for at in places]})
    out["n"], out["v"] = 0, 0
    out.loc[out.index[0], ["n", "v"]] = [n, v]
    return out


def add_up(group: pd.DataFrame) -> pd.DataFrame:
    """One bucket: what is told of each asked key, by packet."""
    _, told, places = added(group)
    total = told >> np.uint64(1)
    return answers(group, told, places, int(total.sum()), int((total > 0).sum()))


def hand_back(asked: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
    """One cell: the buckets' answers, in the order of their keys, to its chunks."""
    _, _, places = added(asked)
    told = np.concatenate([unpack(b) for b in got.sort_values("part")["totals"]])
    return answers(asked, told, places, int(got["n"].sum()), int(got["v"].sum()))


def answered(asked: DataFrame, ways: Ways, bits: int) -> DataFrame:
    """A row (chunk, part, totals) for each packet asked; n and v are sums over all rows."""
    if not ways.two:
        return asked.repartition(ways.buckets, "part").groupBy("part").applyInPandas(add_up, ANSWER)

    def pass_on(group: pd.DataFrame) -> pd.DataFrame:
        distinct, told, _ = added(group)
        return pd.DataFrame(deal(int(group["cell"].iloc[0]), distinct, told, ways.buckets, bits)[0], columns=["part", "chunk", "keys", "counts"])

    cells = cut(asked.withColumn("cell", ways.cell()), "cells").repartition(ways.buckets, "cell")
    sums = cells.groupBy("cell").applyInPandas(pass_on, ASKED)
    got = sums.repartition(ways.buckets, "part").groupBy("part").applyInPandas(add_up, ANSWER).withColumnRenamed("chunk", "cell")
    return cells.groupBy("cell").cogroup(got.repartition(ways.buckets, "cell").groupBy("cell")).applyInPandas(hand_back, ANSWER)


def gathered(answers: DataFrame, name: str, parts: int) -> DataFrame:
    return answers.repartition(parts, "chunk").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("part", "totals"))).alias(name))


def joined(answer, order: np.ndarray) -> np.ndarray:
    """Totals in the order in which the chunk holds its keys."""
    out = np.zeros(len(order), np.int64)
    if answer is not None and len(order):
        out[order] = np.concatenate([unpack(a["totals"]) for a in answer]).astype(np.int64)
    return out


def known(chunk: Chunk, row) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the chunk's words, and which of them other chunks hold too."""
    told = joined(row.words_total, np.arange(len(chunk.words)))
    return told >> 1, (told & 1).astype(bool)


def resolved(row) -> tuple[Chunk, np.ndarray, np.ndarray, np.ndarray]:
    """The chunk, its words' counts, its pairs' counts, and each token's pair."""
    chunk = chunk_of(row)
    total, shared = known(chunk, row)
    pair, back, counts = chunk.pairs()
    which, keys = chunk.asked(pair, shared)
    counts = counts.astype(np.int64)
    counts[which] = joined(row.pairs_total, np.argsort(keys, kind="stable")) >> 1
    return chunk, total, counts, back


def context_bucket(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(c.astype(np.float64))[1], CONTEXTS - 1)


# ---- weights


def histogram(row, n: int, v: int) -> dict[tuple[int, int, int], int]:
    """Training tokens by context bucket and binned estimates, each without its own document's counts."""
    chunk, total, counts, back = resolved(row)
    t = np.flatnonzero(chunk.train)
    width = len(counts) + 1
    doc_pair = chunk.doc[t] * width + back[t]
    _, inv, own_pair = np.unique(doc_pair, return_inverse=True, return_counts=True)
    _, inv_w, own_word = np.unique(chunk.doc[t] * (len(total) + 1) + chunk.codes[t], return_inverse=True, return_counts=True)
    _, inv_h, own_ctx = np.unique(chunk.doc[t] * (len(total) + 1) + chunk.before[t], return_inverse=True, return_counts=True)
    c2 = counts[back[t]] - own_pair[inv]
    cw = total[chunk.codes[t]] - own_word[inv_w]
    ch = total[chunk.before[t]] - own_ctx[inv_h]
    rest = np.maximum(n - chunk.sizes[chunk.doc[t]], 1)
    p2 = np.where(ch > 0, c2 / np.maximum(ch, 1), 0.0)
    p1 = cw / rest
    code = (context_bucket(np.maximum(ch, 0)) * 1024 + binned(p2)) * 1024 + binned(p1)
    codes, sizes = np.unique(code, return_counts=True)
    return dict(zip(codes.tolist(), sizes.tolist()))


def binned(p: np.ndarray) -> np.ndarray:
    """0 for none, else the place of log2 p in steps."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(1 + np.round(-np.log2(p) * STEPS), 1, 1023), 0).astype(np.int64)


def unbinned(b: np.ndarray) -> np.ndarray:
    return np.where(b > 0, 2.0 ** (-(b - 1) / STEPS), 0.0)


def learn(codes: np.ndarray, sizes: np.ndarray, v: int) -> np.ndarray:
    """Weights (context bucket; pair, word, uniform) by EM over the histogram.  Buckets without counts take the overall weights;
    where the context was not seen the pair estimate has none."""
    b, x2, x1 = codes >> 20, unbinned(codes >> 10 & 1023), unbinned(codes & 1023)
    x0 = np.full(len(codes), 1 / (v + 1))
    out = np.tile([0.4, 0.5, 0.1], (CONTEXTS, 1))
    p = np.stack([x2, x1, x0], 1)
    # overall first: the prior of small buckets
    weights = np.array([0.4, 0.5, 0.1])
    for _ in range(ROUNDS):
        if not len(codes):
            break
        post = p * weights
        post *= (sizes / post.sum(axis=1))[:, None]
        weights = post.sum(axis=0) / sizes.sum()
    out[:] = weights
    for _ in range(ROUNDS):
        if not len(codes):
            break
        post = p * out[b]
        post *= (sizes / post.sum(axis=1))[:, None]
        for k in range(3):
            out[:, k] = np.bincount(b, post[:, k], CONTEXTS) + 2 * weights[k]
        out /= out.sum(axis=1, keepdims=True)
    out = np.maximum(out, 1e-6)
    out[0, 0] = 0.0
    return out / out.sum(axis=1, keepdims=True)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(row, n: int, v: int, weights: np.ndarray) -> pa.RecordBatch:
    chunk, total, counts, back = resolved(row)
    c2, cw, ch = counts[back], total[chunk.codes], total[chunk.before]
    bucket = context_bucket(ch)
    lam = weights[bucket]
    if n:
        p = lam[:, 0] * (c2 / np.maximum(ch, 1)) + lam[:, 1] * (cw / n) + lam[:, 2] / (v + 1)
    else:
        p = np.ones(len(cw))
    docs = len(chunk.sizes)
    per = lambda x: np.bincount(chunk.doc, x, docs)
    base = per(np.log10((cw + 1) / (n + 1 * (v + 1))))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(chunk.docs, pa.int64()), pa.array(chunk.held), pa.array(chunk.sizes), pa.array(per((cw > 0).astype(float)).astype(np.int64)),
            pa.array(np.full(docs, n, np.int64)), pa.array(base), pa.array(per(np.log10(p))),
        ],
        names=[c.split()[0] for c in SCORES.split(", ")],
    )


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def each_row(run: Callable) -> Callable:
    """A mapInArrow function from one that takes a row with the columns as attributes and yields batches."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from run(type("Row", (), {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}))

    return go


def score_all(docs: DataFrame, held: Callable[[Column], Column] = held_out, doc: str = "doc_id", text: str = "text", direct: int = DIRECT) -> DataFrame:
    """A row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Above ``direct`` buckets chunks reach them in two steps, with the same result.
    """
    spark = session(docs)
    small_batches(spark)
    plain = docs.select(F.col(doc).cast("long").alias("id"), held(F.col(doc)).alias("held"), F.col(text).alias("text"))
    chunks = cut(plain.mapInArrow(chunked, CHUNKS), "chunks")
    count_of = chunks.count()
    if not count_of:
        return spark.createDataFrame([], SCORES)
    ways = Ways(count_of, int(spark.conf.get("spark.sql.shuffle.partitions")), direct)
    parts, first = ways.buckets, ways.first
    twice = np.uint64(2)

    def send(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["part", "chunk", "keys", "counts"])

    def ask_words(row) -> Iterator[pa.RecordBatch]:
        c = chunk_of(row)
        yield send(deal(row.chunk, c.words, c.counts.astype(np.uint64) * twice, first, 64)[0])

    def ask_pairs(row) -> Iterator[pa.RecordBatch]:
        c = chunk_of(row)
        pair, _, counts = c.pairs()
        which, keys = c.asked(pair, known(c, row)[1])
        if len(which):
            yield send(deal(row.chunk, keys, counts[which].astype(np.uint64) * twice, first, 56)[0])

    words = cut(answered(chunks.mapInArrow(each_row(ask_words), ASKED), ways, 64), "words")
    n, v = words.agg(F.sum("n"), F.sum("v")).first()
    with_words = chunks.repartition(parts, "chunk").join(gathered(words, "words_total", parts), "chunk")
    pairs = cut(answered(with_words.mapInArrow(each_row(ask_pairs), ASKED), ways, 56), "pairs")
    whole = with_words.join(gathered(pairs, "pairs_total", parts), "chunk", "left")

    def count(row) -> Iterator[pa.RecordBatch]:
        h = histogram(row, n, v)
        yield pa.RecordBatch.from_arrays([pa.array(list(h), pa.int64()), pa.array(list(h.values()), pa.int64())], names=["code", "size"])

    seen = whole.mapInArrow(each_row(count), "code long, size long").groupBy("code").agg(F.sum("size").alias("size")).toPandas() if n else pd.DataFrame({"code": [], "size": []})
    seen = seen.sort_values("code")
    weights = learn(seen["code"].to_numpy(np.int64), seen["size"].to_numpy(np.float64), v)

    def score(row) -> Iterator[pa.RecordBatch]:
        yield scored(row, n, v, weights)

    return whole.mapInArrow(each_row(score), SCORES)
