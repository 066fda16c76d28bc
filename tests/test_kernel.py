"""The numpy kernel against literal loops, and anchor values."""

import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.config import Options, padded
from strandline.operators import kernel as K
from strandline.operators import trim
from strandline.plans import tables as T

LAM = math.log10(0.25)
seqs = st.text("ACGTN", max_size=40)


def quality(s, rnd):
    return "".join(chr(33 + rnd.randrange(2, 41)) for _ in s)


def slow_adapter(s, q, a, x):
    m = min(len(s) - x, len(a), 30)
    total = hits = 0
    for i in range(m):
        same = s[x + i] == a[i] or a[i] == "I"
        v = max(ord(q[x + i]) - 33, 2)
        e = 10 ** (-v / 10)
        total += math.log10(1 - e) if same else math.log10(e / 3)
        hits += same
        if i == 9 and total - 10 * LAM < -8:
            mean = max(sum(ord(c) - 33 for c in q[x : x + 10]) // 10, 2)
            e = 10 ** (-mean / 10)
            total += (m - 10) * (0.75 * math.log10(e / 3) + 0.25 * math.log10(1 - e))
            break
    return total + LAM * max(0, len(s) - x - m), hits


def slow_overlap(s1, q1, r2, rq2, x):
    total, hits = x * LAM, 0
    for i in range(min(len(s1), x)):
        j = i + len(r2) - x
        if 0 <= j < len(r2):
            a, b = (10 ** (-max(ord(c) - 33, 2) / 10) for c in (q1[i], rq2[j]))
            same = s1[i] == r2[j]
            hits += same
            total += math.log10((1 - a) * (1 - b) + a * b / 3) if same else math.log10((1 - a) * b / 3 + a / 3 * (1 - b) + 2 * a * b / 9)
    return total, hits


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(seqs, seqs), min_size=1, max_size=5), st.randoms(use_true_random=False))
def test_likelihoods(pairs, rnd):
    s1, s2 = [p[0] for p in pairs], [p[1] for p in pairs]
    q1, q2 = [quality(s, rnd) for s in s1], [quality(s, rnd) for s in s2]
    one, two = K.Reads(s1, q1, 33), K.Reads(s2, q2, 33)
    turned = two.turned()
    rc = str.maketrans("ACGTN", "TGCAN")
    places, hits = K.adapter_places(one, Options().adapters[0], 45)
    laid = K.Overlap(one, turned)
    for x in range(45):
        a, ha = places[:, x], hits[:, x]
        o, ho = laid.score(x, slice(None))
        o = o + x * LAM
        for k in range(len(pairs)):
            if x < len(s1[k]):
                want = slow_adapter(s1[k], q1[k], Options().adapters[0], x)
                assert abs(a[k] - want[0]) < 1e-9 and ha[k] == want[1]
            want = slow_overlap(s1[k], q1[k], s2[k].translate(rc)[::-1], q2[k][::-1], x)
            assert abs(o[k] - want[0]) < 1e-9 and ho[k] == want[1]


def slow_two(start, scores, hits):
    """The best two by offering candidates in turn."""
    best, second = (start, -1, 0), (-math.inf, -1)
    for x, (ll, h) in enumerate(zip(scores, hits)):
        if ll > best[0]:
            second, best = best[:2], (ll, x, h)
        elif ll > second[0]:
            second = (ll, x)
    return best[1], second[1], best[0], second[0], best[2]


def same_two(got, k, start, scores, hits):
    """Candidates whose sums differ by rounding alone may change places."""
    want = slow_two(start, scores, hits)
    every = {-1: start, **dict(enumerate(scores))}
    near = lambda a, b: a == b or abs(a - b) < 1e-9
    assert near(got.ll[k], want[2]) and near(got.second[k], want[3])
    assert near(every[int(got.x[k])], want[2]) and got.matches[k] == (0 if got.x[k] < 0 else hits[int(got.x[k])])
    assert got.second_x[k] == want[1] or near(every[int(got.second_x[k])], want[3])
    assert got.x[k] == want[0] or near(want[2], want[3])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(seqs, seqs, st.integers(0, 30)), min_size=1, max_size=6), st.randoms(use_true_random=False), st.sampled_from([{}, {"ancient": True}, {"loc": 3.0, "scale": 0.5}, {"trim_cutoff": 7}, {"forward": "ACNGT"}]))
def test_scans(pairs, rnd, how):
    """The pruned scans against all candidates one by one; reads of fragments with their adapters among random ones."""
    o = Options(**how)
    rc = str.maketrans("ACGTN", "TGCAN")
    s1, s2 = [], []
    for k, (a, b, x) in enumerate(pairs):
        fragment = a[:x]
        s1.append((fragment + o.adapters[0].replace("I", "C"))[:40] if k % 2 else a)
        s2.append((fragment.translate(rc)[::-1] + o.adapters[1].replace("I", "G"))[: 40 - k] if k % 2 else b)
    q1, q2 = [quality(s, rnd) for s in s1], [quality(s, rnd) for s in s2]
    one, two = K.Reads(s1, q1, 33), K.Reads(s2, q2, 33)
    single, both, over = K.scan_single(one, o), K.scan_pairs(one, two, o), K.scan_overhang(one, two, o)
    density = lambda x: T.log10_density(x, o.loc, o.scale) if o.prior else 0.0
    survival = lambda n: T.log10_survival(max(n, 0), o.loc, o.scale) if o.prior else 0.0
    for k, (a, b) in enumerate(zip(s1, s2)):
        n, m, longest = len(a), len(b), max(len(a), len(b))
        part = lambda s, q, side, x: slow_adapter(s, q, o.adapters[side], x) if x < len(s) else (0.0, 0)
        rows = [(part(a, q1[k], 0, x), x) for x in range(max(0, n - o.cutoff))]
        same_two(single, k, n * LAM + survival(n - o.cutoff), [r[0] + x * LAM + density(x) for r, x in rows], [r[1] for r, _ in rows])
        end = 2 * longest - o.min_overlap
        able = min(end if o.partial else min(end, longest + 1), n + m + 1)
        lap = [slow_overlap(a, q1[k], b.translate(rc)[::-1], q2[k][::-1], x) for x in range(max(0, end) + 1)]
        rows = [(part(a, q1[k], 0, x), part(b, q2[k], 1, x), lap[x], x) for x in range(max(0, able))]
        same_two(both, k, (n + m) * LAM + survival(end), [p[0] + r[0] + v[0] + density(x) for p, r, v, x in rows], [p[1] + r[1] + v[1] for p, r, v, _ in rows])
        hang = lambda x: max(0, n - x - 1) + max(0, m - x - 1)
        rows = [(LAM * hang(x) + lap[x][0], lap[x][1]) if hang(x) else (-math.inf, 0) for x in range(max(0, min(end, longest - 1)))]
        same_two(over, k, (n + m) * LAM, [r[0] for r in rows], [r[1] for r in rows])


def test_few_overlaps_are_looked_up(monkeypatch):
    """Most candidates are ruled out by their bounds."""
    rnd = random.Random(1)
    seen, real = [], K.Overlap.score
    monkeypatch.setattr(K.Overlap, "score", lambda self, x, rows: seen.append(len(self.base1[rows])) or real(self, x, rows))
    ins = ["".join(rnd.choices("ACGT", k=30 + k % 60)) for k in range(400)]
    s1 = [(s + Options().forward[:33].ljust(100, "A"))[:90] for s in ins]
    s2 = [(s.translate(str.maketrans("ACGT", "TGCA"))[::-1] + Options().reverse[:33].ljust(100, "A"))[:90] for s in ins]
    reads = [K.Reads(s, [quality(x, rnd) for x in s], 33) for s in (s1, s2)]
    got = K.scan_pairs(*reads, Options())
    assert got.x.tolist() == [len(s) for s in ins] and sum(seen) < 400 * 91 / 4


def test_anchors():
    assert round(LAM, 10) == -0.6020599913
    assert [round(float(v), 10) for v in (T.match()[30], T.mismatch()[30], T.match()[2])] == [-0.0004345118, -3.4771212547, -0.4329234333]
    assert [round(float(v), 10) for v in (T.pair_match()[30, 30], T.pair_mismatch()[30, 30])] == [-0.0008688785, -3.1763808853]
    c = T.consensus_quality()
    assert [int(c[0, 0, q, q]) for q in (30, 20, 10, 2, 63)] == [60, 45, 24, 3, 60]
    assert [int(c[0, 1, 30, 20]), int(c[0, 1, 30, 30]), int(c[0, 1, 40, 2])] == [10, 3, 39]
    assert [int(c[4, 0, 2, 30]), int(c[4, 0, 30, 30]), int(c[4, 4, 30, 30])] == [30, 30, 0]
    fit = (5.1444983185, 0.2885764766)
    assert [round(T.log10_density(x, *fit), 5) for x in (1, 100, 300)] == [-68.87038, -2.61782, -3.15211]
    assert [round(T.log10_survival(x, *fit), 5) for x in (100, 171, 300)] == [-0.01359, -0.29764, -1.57993]


def test_wrong_input():
    import pytest

    with pytest.raises(ValueError):
        K.Reads(["ACG"], ["II"], 33)
    with pytest.raises(ValueError):
        K.Reads(["AXG"], ["III"], 33).turned()


def singles(spark, rows, o=Options()):
    df = spark.createDataFrame(rows, "s string, q string").coalesce(1)
    return [r.r for r in df.select(trim.trimmed("s", "q", o).alias("r")).collect()]


def pairs(spark, rows, o=Options()):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, a string, b string, c string, d string").coalesce(1)
    return [r.r for r in df.select(trim.merged("k", "a", "b", "c", "d", o).alias("r")).collect()]


def test_edge_reads(spark):
    o = Options(trim_cutoff=5)
    got = singles(spark, [("", ""), ("ACG", "III"), (padded("A" * 3)[:3], "III"), (None, None)], o)
    assert [g.code for g in got] == [" "] * 4 and all(g.seq == "" and g.cut == -1 for g in got) and got[3].s1 == ""
    assert singles(spark, [("", "")], Options(keys="AC"))[0].code == "K"
    pair = pairs(spark, [("", "", "ACGT", "IIII"), ("ACGT", "IIII", None, None)], Options(keys="AC"))
    assert [p.code for p in pair] == [" ", "K"] and pair[0].seq == "" and pair[0].s2 == "ACGT"


def test_adapter_dimer_is_short(spark):
    assert singles(spark, [("ACG" + Options().forward[:33], "I" * 36)])[0].code == "D"


def slow_edits(s, key):
    return abs(len(s) - len(key)) + sum(a != b and b != "N" for a, b in zip(s, key))


def slow_pair_key(s1, s2, keys, missing):
    """Bases that the keys of a pair take; None if they are not there."""
    (k1, k2), n1, n2 = keys, len(keys[0]), len(keys[1])
    e = slow_edits(s1[:n1], k1) + slow_edits(s2[:n2], k2)
    if not s1:
        return 0, 0
    if e == 0 or missing and e == 1:
        return n1, n2
    if missing and s1[: n1 - 1] == k1[1:] and s2[:n2] == k2:
        return n1 - 1, n2
    if missing and s1[:n1] == k1 and s2[: n2 - 1] == k2[1:]:
        return n1, n2 - 1
    return None


def test_keys(spark):
    rnd = random.Random(2)
    starts = ["ACG", "AAG", "CG", "ANG", "A", "", "GCG", "TTN", "TTC", "TC", "NCC"]
    rows = [(a + "GATTACAGATT"[: rnd.randrange(12)], b + "CATTAG"[: rnd.randrange(7)]) for a in starts for b in starts]
    quality = lambda s: "".join(chr(60 + k) for k in range(len(s)))
    for missing in (False, True):
        for keys in ("ACG", "ACG,TTN", "NCC,ACG"):
            o = Options(keys=keys, allow_missing=missing, trim_cutoff=1000)
            for (a, b), r in zip(rows, pairs(spark, [(a, quality(a), b, quality(b)) for a, b in rows], o)):
                skip = slow_pair_key(a, b, o.key_pair, missing)
                i, j = skip or (0, 0)
                assert (r.code == "K") == (skip is None) and (r.s1, r.q1, r.s2, r.q2) == (a[i:], quality(a)[i:], b[j:], quality(b)[j:])
        o = Options(keys="ACG", allow_missing=missing, trim_cutoff=1000)
        for (a, _), r in zip(rows, singles(spark, [(a, quality(a)) for a, _ in rows], o)):
            whole = a[:3] == "ACG" or missing and slow_edits(a[:3], "ACG") == 1
            n = 3 if whole else 2 if missing and a[:2] == "CG" else None
            assert (r.code == "K") == (n is None) and (r.s1, r.q1) == (a[n or 0 :], quality(a)[n or 0 :])


def test_inner_keys(spark):
    """Of new sequences: found, with one difference, not there, and sequences no longer than the key."""
    adapter = Options().forward[:30]
    rows = [(s + adapter, "I" * (len(s) + 30)) for s in ("ACGATTACAGG", "AGGATTACAGG", "TTGATTACAGG", "GATTA", "ACGATTAC")]
    told = lambda o: [(r.code, r.seq, r.cut) for r in singles(spark, rows, o)]
    assert told(Options(ikey="ACG")) == [(" ", "ATTACAGG", 11), ("K", "AGGATTACAGG", 11), ("K", "TTGATTACAGG", 11), ("K", "GATTA", 5), (" ", "ATTAC", 8)]
    assert told(Options(ikey="ACG", allow_missing=True))[1] == (" ", "ATTACAGG", 11)
    assert told(Options(ikey="ACGATTAC"))[4] == (" ", "ACGATTAC", 8) and told(Options(ikey="ACGA"))[4] == ("D", "", 8)


def test_phred64(spark):
    s, q = "GATTACAGATTACA" + Options().forward[:30], "I" * 44
    a = singles(spark, [(s, q)])[0]
    b = singles(spark, [(s, "".join(chr(ord(c) + 31) for c in q))], Options(phred64=True))[0]
    assert a.seq == b.seq == "GATTACAGATTACA"


def test_coin_is_fair():
    k = np.arange(20000)
    assert 0.45 < T.coin(1, k, 3).mean() < 0.55


def test_long_reads_do_not_widen_the_rest(monkeypatch):
    """Rows dealt by length give what they give together."""
    from strandline.operators import trim as T

    rng = random.Random(3)
    seqs = ["".join(rng.choices("ACGT", k=n)) for n in (30, 200, 5, 80, 31, 1, 0, 64)]
    quals = ["I" * len(x) for x in seqs]
    scan = lambda a, b: T.unpacked(K.scan_single(K.Reads(a, b, 33), Options()))
    whole = scan(seqs, quals)
    monkeypatch.setattr(T, "CELLS", 100)
    assert T.by_length(scan, seqs, quals) == whole
