"""Toxicity by subword-bag embeddings averaged into a linear softmax, both trained together in numpy.

A word is a run of ASCII letters and digits (after Unicode lower-casing) and of characters beyond ASCII.  Its subwords are
itself and its UTF-8 byte n-grams, a space marking either end; each hashes to a row of an embedding table, and the word's
vector is their mean.  So a misspelling that was never seen shares most of its rows with those that were.  A window of
``WINDOW`` words averages its words' vectors into a two-class softmax; a document's probability is that of its most toxic
window (half-overlapping windows over the whole text), which keeps a few bad words in a long text from being averaged away.  A word
that stands among the seven before it is not counted again.

Training takes at most ``MAX_TOXIC`` + ``MAX_CLEAN`` labelled documents, those with the least hash of doc_id; a
documented bound.  The first passes count all windows of a toxic document as toxic; the later ones take the most toxic
window of each document, toxic or clean, and a share of the other clean windows, drawn anew each time.
At the end the bias moves so that the threshold lies midway between the
two kinds of training documents.  Only texts and labels are inputs.  All documents are scored, whole.

* Null or empty texts, and texts without words, get the score of the bias alone; very long texts are scored whole.  Labels that
  are null are no labels.  A document that is labelled more than once is toxic if any of its labels is.
* Rows of documents that repeat a doc_id train as one, with the least of their texts, so the bound holds; each is scored.  Ties
  of the hash go to the smaller doc_id; reruns agree.  Rows without a doc_id are scored and never train.
* Extra columns pass through, and a column named like the score is replaced; an empty table gives an empty result.
* Without labels of both kinds the model is flat: every score is the share of toxic labels (0 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import ALNUM, encode_words, session, small_batches

BUCKETS, DIM, WINDOW, GRAMS = 1 << 17, 8, 8, (3, 4, 5, 6)
MAX_TOXIC, MAX_CLEAN = 3000, 5000
EPOCHS, NOISY, SHARE, BATCH, RATE = 10, 2, 20, 1024, 2.0
THRESHOLD = 0.3
SEED = 20240229


def normal(texts: list[str | None]) -> pa.Array:
    return pa.array([(t or "").lower().encode("utf-8", "replace").translate(ALNUM) for t in texts], pa.large_binary()).cast(pa.large_string())


def subwords(words: pa.Array, block: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of each word's subwords, one after another, and the offsets of the words."""
    parts = [some_subwords(words.slice(at, block)) for at in range(0, max(len(words), 1), block)]
    return np.concatenate([r for r, _ in parts]), np.cumsum(np.concatenate([[0], *(n for _, n in parts)]))


def some_subwords(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same, with the number of each word's subwords."""
    lens = np.asarray(pa.compute.binary_length(words), dtype=np.int64)
    text = b" " + b" ".join(words.cast(pa.large_binary()).to_pylist()) + b" " if len(words) else b" "
    raw = np.frombuffer(text, np.uint8).astype(np.uint64)
    begin = np.concatenate([[0], np.cumsum(lens + 1)])  # of the space before each word
    word_of = np.repeat(np.arange(len(words)), lens + 1)  # of each place but the last
    gap = np.concatenate([[0], np.cumsum(raw == 32)])
    rows, owner = [], []
    for n in GRAMS:
        if len(raw) < n:
            continue
        h = np.full(len(raw) - n + 1, 1469598103934665603 + n, np.uint64)
        for k in range(n):
            h = (h ^ raw[k : k + len(h)]) * np.uint64(1099511628211)
        inside = gap[n - 1 : n - 1 + len(h)] == gap[1 : 1 + len(h)]  # a space at either end only
        at = np.flatnonzero(inside)
        rows.append(((h[at] ^ (h[at] >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int32))
        owner.append(word_of[at])
    # the whole word: a polynomial over its bytes, by differences of running sums
    power = np.cumprod(np.full(len(raw) + 1, np.uint64(0x9E3779B97F4A7C15)))
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw + np.uint64(1)) * power[: len(raw)])])
    whole = np.zeros(len(words), np.uint64)
    if len(words):
        a, b = begin[:-1] + 1, begin[:-1] + 1 + lens
        inverse = np.cumprod(np.full(len(raw) + 1, np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))))
        whole = (run[b] - run[a]) * inverse[a]
        whole = (whole ^ (whole >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    rows.append(((whole ^ (whole >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int32))
    owner.append(np.arange(len(words)))
    rows, owner = np.concatenate(rows), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return rows[order], np.bincount(owner, minlength=len(words))


def counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """encode_words, without words that stand among the seven before them: a window is not filled by one word."""
    offsets, codes, words = encode_words(texts)
    keep = np.ones(len(codes), bool)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for k in range(1, min(WINDOW, len(codes))):
        keep[k:] &= (codes[k:] != codes[:-k]) | (doc[k:] != doc[:-k])
    return np.concatenate([[0], np.cumsum(keep)])[offsets], codes[keep], words


def starts(n: int) -> np.ndarray:
    """First words of the windows of n words."""
    return np.unique(np.append(np.arange(0, max(n - WINDOW, 0) + 1, WINDOW // 2), max(n - WINDOW, 0)))


class Model:
    """values: what a subword adds to the log-odds, the table's rows along the softmax's axis."""

    def __init__(self, values: np.ndarray, bias: float):
        self.values, self.bias = values.astype(np.float64), float(bias)

    def score(self, texts: pa.Array) -> np.ndarray:
        offsets, codes, words = counted(normal(texts.to_pylist()))
        rows, bounds = subwords(words)
        each = np.add.reduceat(self.values[rows], bounds[:-1]) / np.diff(bounds) if len(words) else np.zeros(0)
        total = np.concatenate([[0.0], np.cumsum(each[codes])])
        out = np.full(len(offsets) - 1, self.bias)
        for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
            if b > a:
                s = a + starts(b - a)
                e = np.minimum(s + WINDOW, b)
                out[i] = self.bias + ((total[e] - total[s]) / (e - s)).max()
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def train(texts: list[str], toxic: list[int], seed: int = SEED) -> Model:
    """Fit on these documents."""
    y = np.array([int(bool(t)) for t in toxic])
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(BUCKETS), 50.0 if share else -50.0)
    rng = np.random.default_rng(seed)
    offsets, codes, words = counted(normal(texts))
    rows, bounds = subwords(words)
    count = np.diff(bounds)
    begin, end, doc = [], [], []
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        if b > a:
            s = a + starts(b - a)
            begin.append(s)
            end.append(np.minimum(s + WINDOW, b))
            doc.append(np.full(len(s), i))
    begin, end, doc = np.concatenate(begin), np.concatenate(end), np.concatenate(doc)
    table = rng.normal(0, 0.1, (BUCKETS, DIM))
    axis, bias = rng.normal(0, 0.5, DIM), float(np.log(0.1))
    sq_table, sq_axis, sq_bias = np.full(BUCKETS, 1e-6), np.full(DIM, 1e-6), 1e-6
    clean, bad = np.flatnonzero(y[doc] == 0), np.flatnonzero(y[doc] == 1)
    for epoch in range(EPOCHS):
        some = rng.permutation(clean)[: len(clean) // SHARE + 1]
        if epoch < NOISY:
            pos, neg = rng.permutation(bad)[: len(bad) // 2 + 1], some
        else:  # the most toxic window of each document
            value = table @ axis
            each = np.add.reduceat(value[rows], bounds[:-1]) / count
            total = np.concatenate([[0.0], np.cumsum(each[codes])])
            order = np.lexsort((-(total[end] - total[begin]) / (end - begin), doc))
            top = order[np.concatenate([[True], np.diff(doc[order]) > 0])]
            pos, neg = np.repeat(top[y[doc[top]] == 1], 3), np.concatenate([np.repeat(top[y[doc[top]] == 0], 2), some])
        pick = rng.permutation(np.concatenate([pos, neg]))
        for at in range(0, len(pick), BATCH):
            w = pick[at : at + BATCH]
            size = end[w] - begin[w]
            owner = np.repeat(np.arange(len(w)), size)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin[w], size)
            used, back = np.unique(codes[place], return_inverse=True)
            n = count[used]
            first = np.cumsum(n) - n
            subs = rows[np.arange(n.sum()) + np.repeat(bounds[used] - first, n)]
            vectors = np.add.reduceat(table[subs], first, axis=0) / n[:, None]
            share = 1 / size[owner]
            hidden = np.stack([np.bincount(owner, vectors[back, d] * share, len(w)) for d in range(DIM)], 1)
            p = 1 / (1 + np.exp(-np.clip(hidden @ axis + bias, -30, 30)))
            error = p - y[doc[w]]
            # each word's part in the error, then each subword's
            blame = np.bincount(back, error[owner] * share, len(used)) / n
            pull = np.bincount(subs, np.repeat(blame, n), BUCKETS)
            ids = np.flatnonzero(pull)
            pull = pull[ids]
            grad_axis, grad_bias = hidden.T @ error / len(w), error.mean()
            sq_table[ids] += pull**2
            sq_axis += grad_axis**2
            sq_bias += grad_bias**2
            table[ids] -= (RATE * pull / np.sqrt(sq_table[ids]))[:, None] * axis[None, :]
            axis -= 0.1 * RATE * grad_axis / np.sqrt(sq_axis)
            bias -= 0.1 * RATE * grad_bias / np.sqrt(sq_bias)
    value = table @ axis
    each = np.add.reduceat(value[rows], bounds[:-1]) / count
    total = np.concatenate([[0.0], np.cumsum(each[codes])])
    top = np.full(len(y), -np.inf)
    np.maximum.at(top, doc, (total[end] - total[begin]) / (end - begin))
    return Model(value, np.log(THRESHOLD / (1 - THRESHOLD)) - best_cut(top[top > -np.inf], y[top > -np.inf], -bias))


def best_cut(z: np.ndarray, y: np.ndarray, usual: float) -> float:
    """Where the threshold lies best between the two kinds of training documents, at most one from the usual place: the middle
    of the widest gap with the least share of errors."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    wrong = np.cumsum(np.append(0, y)) / max(y.sum(), 1) + np.append(np.cumsum((1 - y)[::-1])[::-1], 0) / max((1 - y).sum(), 1)
    low, high = np.append(usual - 1, z), np.append(z, usual + 1)
    gap = np.where(wrong <= wrong.min() + 1e-12, high - low, -1)
    k = int(gap.argmax())
    return float(np.clip((low[k] + high[k]) / 2, usual - 1, usual + 1))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most_toxic: int = MAX_TOXIC, most_clean: int = MAX_CLEAN) -> DataFrame:
    """doc_id, text, y of the labelled documents that are not held out, each doc_id once and at most most_toxic + most_clean."""
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    marks = marks.filter(~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64(F.lit(SEED), "doc_id"))
    have = docs.filter("doc_id is not null and text is not null").select("doc_id", "text")
    ids = marks.join(have.select("doc_id"), "doc_id", "left_semi")  # each doc_id once
    chosen = ids.filter("y > 0").orderBy("h", "doc_id").limit(most_toxic).unionByName(ids.filter("y = 0").orderBy("h", "doc_id").limit(most_clean))
    # at most most_toxic + most_clean ids are broadcast; rows that repeat one become one before they move
    return have.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, **most: int) -> Model:
    """Learn from the training rows, in one task; only the model, of fixed size, comes to the driver."""
    rows = training_rows(docs, labels, **most)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        texts, marks = [r[1] for r in got], [r[2] for r in got]
        del got
        model = train(texts, marks)
        yield pa.RecordBatch.from_arrays([pa.array([model.values.astype(np.float32).tobytes()], pa.binary()), pa.array([model.bias])], names=["model", "bias"])

    small_batches(session(docs))
    found = rows.repartition(1).mapInArrow(learn, "model binary, bias double").first()
    return Model(np.frombuffer(found["model"], np.float32), found["bias"]) if found else train([], [])


def add_score(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    spark = session(docs)
    small_batches(spark)
    sent = spark.sparkContext.broadcast((model.values.astype(np.float32), model.bias))  # BUCKETS values, whatever the data

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(Model(*sent.value).score(texts), pa.float64())

    return docs.withColumn(to, score(F.col(text)))


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score at the threshold or above; same columns."""
    from .util import fresh

    (name,) = fresh(docs, "score")
    return add_score(docs, model, to=name).filter(F.col(name) < threshold).select(*docs.columns)
