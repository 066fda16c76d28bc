"""Queries get their rows by the methods that their operators are named for."""

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import jaccard, simhash


def pair_of_sets(rng, n, m, common):
    x, a, b = (rng.integers(0, 1 << 64, k, dtype=np.uint64) for k in (common, n - common, m - common))
    return simhash.wide_print(np.concatenate([x, a])), simhash.wide_print(np.concatenate([x, b]))


@pytest.mark.parametrize("n, m, common, kinds", [(4, 5, 4, 640), (9, 9, 8, 640), (20, 25, 20, 288), (90, 90, 80, 288), (900, 900, 800, 288)])
def test_golay_keys_reach_similarity_of_four_fifths(n, m, common, kinds):
    """Sets of similarity 0.8 share a key, far beyond four bits of 64, and pass the bounds on bits; sets without a common shingle don't."""
    rng = np.random.default_rng(n)
    a, b = (np.array(x) for x in zip(*(pair_of_sets(rng, n, m, common) for _ in range(200))))
    shared = (simhash.wide_keys(a, kinds) == simhash.wide_keys(b, kinds)).sum(axis=1)
    apart = np.bitwise_count(a ^ b)
    assert shared.min() > 0 and apart.sum(axis=1).max() <= (jaccard.APART_FEW if n < 32 else jaccard.APART)
    assert all(jaccard.close(a[:, 0], jaccard.rough(np.full(200, n), a), b[:, 0], jaccard.rough(np.full(200, m), b)))
    assert (apart[:, 0] > simhash.REACH).mean() > 0.9
    far = np.bitwise_count(a[:100] ^ b[100:]).sum(axis=1)
    assert far.min() > jaccard.APART_FEW


def test_a_key_is_a_codeword_and_further_bits():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 64, (20, simhash.WIDE // 64), dtype=np.uint64)
    bits = np.unpackbits(prints.view(np.uint8), axis=1)
    for row, keys in zip(bits, simhash.wide_keys(prints, 50)):
        for kind, key in enumerate(keys.tolist()):
            picked = row[simhash.PICKED[kind]].tolist()
            word = sum(x << k for k, x in enumerate(picked[:23]))
            rest = sum(x << k for k, x in enumerate(picked[23:]))
            assert key == (kind << 12 | int(simhash.GOLAY[0].decode(np.array([word]))[0])) << simhash.FURTHER | rest


def test_company_in_a_bucket():
    """Rows with another one near by, in small and large buckets and over the ends of batches, against all pairs."""
    rng = np.random.default_rng(5)
    key = np.sort(np.concatenate([rng.integers(0, 60, 200), np.full(150, 60), np.full(90, 61)])).astype(np.int32)
    seeds = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    v = seeds[rng.integers(0, 40, len(key))]
    for _ in range(18):
        v = v ^ np.uint64(1) << rng.integers(0, 64, len(key), dtype=np.uint64)
    v[key == 61] = rng.integers(0, 1 << 64, 90, dtype=np.uint64)
    power, more = rng.integers(28, 36, len(key)), rng.integers(0, 4, len(key))
    m = (power << 24 | more).astype(np.int32)
    apart = np.bitwise_count(v[:, None] ^ v[None, :]) + np.bitwise_count(more[:, None] ^ more[None, :])
    near = (key[:, None] == key[None, :]) & (np.abs(power[:, None] - power[None, :]) <= 3) & (apart <= np.where(np.minimum.outer(power, power) <= 31, 34, 29))
    np.fill_diagonal(near, False)
    want = sorted((int(key[k]), int(v[k])) for k in np.flatnonzero(near.any(axis=1)))
    for step in (7, 64, 1000):
        batches = (pa.RecordBatch.from_arrays([pa.array(key[k : k + step]), pa.array(v[k : k + step].view(np.int64)), pa.array(m[k : k + step])], names=["band", "print", "more"]) for k in range(0, len(key), step))
        got = [(k, p) for b in jaccard.company(batches) for k, p in zip(b.column(0).to_pylist(), b.column(1).to_numpy().view(np.uint64).tolist())]
        assert sorted(got) == want and 0 < len(want) < len(key)


def test_pairs_of_the_stage_meet_under_golay_keys(spark, monkeypatch):
    """Without keys, near-duplicates do not meet; with them, they do."""
    words = [f"w{k}" for k in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:50] + ["x"] + words[51:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in simhash.keep_one(df).collect()] == [1]
    real = jaccard.key_rows

    def none(batches):
        return (b.slice(0, 0) for b in real(batches))

    monkeypatch.setattr(jaccard, "key_rows", none)
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [1, 2]
