"""Trimming of single reads and merging of pairs: likelihoods in one Arrow function each, keys, cuts and codes by column functions;
what the kernel does not need never leaves the JVM."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MIN_LENGTH, Options
from ..functions.sequence import col, edits
from . import kernel as K

CELLS = 1 << 22  # bases of a batch's matrices
CANDIDATES = "best int, second int, best_ll double, second_ll double, matches int"
CANDIDATES_TYPE = pa.struct([("best", pa.int32()), ("second", pa.int32()), ("best_ll", pa.float64()), ("second_ll", pa.float64()), ("matches", pa.int32())])


def starts(seq: Column, key: str, missing: bool) -> Column:
    """Whether a sequence begins with a key, with one difference if that is allowed."""
    head = F.substring(seq, 1, len(key))
    return (head == key) | (edits(head, F.lit(key)) == 1) if missing else head == key


def key_single(seq: Column, o: Options) -> Column | None:
    """How many bases the key of a single read takes, null if it is not there; None without a key."""
    key, missing = o.key_pair[0], o.allow_missing
    if not key:
        return None
    n = F.when(starts(seq, key, missing), len(key))
    return n.when(F.substring(seq, 1, len(key) - 1) == key[1:], len(key) - 1) if missing else n


def key_pair(one: Column, two: Column, o: Options) -> tuple[Column, Column] | None:
    """The same of both mates: both keys as they are, or one of them with one difference or without its first base."""
    (k1, k2), missing = o.key_pair, o.allow_missing
    if not k1:
        return None
    e1, e2 = edits(F.substring(one, 1, len(k1)), F.lit(k1)), edits(F.substring(two, 1, len(k2)), F.lit(k2))
    whole = (e1 == 0) & (e2 == 0)
    first, second = F.when(one == "", 0), F.when(one == "", 0)  # a pair without bases has no key to miss
    if missing:
        whole = whole | (e1 + e2 == 1)
    first, second = first.when(whole, len(k1)), second.when(whole, len(k2))
    if missing:
        short1 = (F.substring(one, 1, len(k1) - 1) == k1[1:]) & (F.substring(two, 1, len(k2)) == k2)
        short2 = (F.substring(one, 1, len(k1)) == k1) & (F.substring(two, 1, len(k2) - 1) == k2[1:])
        first = first.when(short1, len(k1) - 1).when(short2, len(k1))
        second = second.when(short1, len(k2)).when(short2, len(k2) - 1)
    return first, second


def behind(c: Column, skip: Column | None) -> Column:
    return c if skip is None else F.substring(c, skip + 1, F.length(c))


def result(raw: Column, seq: Column, qual: Column, reads: dict[str, tuple[Column, Column]], lost: Column | None, o: Options, single: bool) -> Column:
    """code, seq, qual, cut and the reads after their keys.

    raw: what the kernel tells (chimera, cut); seq, qual: the new sequence where there is a cut; reads: each with and without its key;
    lost: whether a key is not there.  An inner key is looked for in new sequences that are longer than it.
    """
    lost = F.lit(False) if lost is None else lost
    new = ~lost & (raw["cut"] >= 0)
    seq, qual = F.when(new, seq).otherwise(""), F.when(new, qual).otherwise("")
    code = F.when(lost, "K").when(raw["chimera"], "D")
    if n := len(o.ikey):
        long, there = new & (F.length(seq) > n), starts(seq, o.ikey, o.allow_missing)
        code = code.when(long & ~there, "K")
        seq, qual = (F.when(long & there, F.substring(c, n + 1, F.length(c))).otherwise(c) for c in (seq, qual))
    if single:
        short = new & code.isNull() & (F.length(seq) < MIN_LENGTH)
        code, seq, qual = code.when(short, "D"), F.when(short, "").otherwise(seq), F.when(short, "").otherwise(qual)
    fields = {n: F.when(lost, whole).otherwise(kept) for n, (whole, kept) in reads.items()}
    none = F.lit(None).cast("string")
    both = [fields.get(n, none).alias(n) for n in ("s1", "q1", "s2", "q2")]
    return F.struct(F.coalesce(code, F.lit(" ")).alias("code"), seq.alias("seq"), qual.alias("qual"), F.when(new, raw["cut"]).otherwise(-1).alias("cut"), *both)


def by_length(f, *cols: list) -> list:
    """f over rows of similar length at a time, so that one long read does not widen the matrices of all; f takes the columns and
    gives as many results, the first column's strings tell the lengths."""
    size = np.array([len(x) for x in cols[0]], np.int64)
    if not len(size) or len(size) * int(size.max()) <= CELLS:
        return f(*cols)
    order = np.argsort(size, kind="stable")
    out: list = [None] * len(size)
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * int(size[order[end]]) <= CELLS:
            end += 1
        part = order[at:end].tolist()
        for k, r in zip(part, f(*[[c[k] for k in part] for c in cols])):
            out[k] = r
        at = end
    return out


def texts(a: pa.Array) -> list[str]:
    return [x or "" for x in a.to_pylist()]


def struct_of(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(kinds), kinds.values())], list(kinds))


def trimmed(seq: Column | str, qual: Column | str, o: Options) -> Column:
    """The result of single reads: keys and cuts by column functions, only likelihoods in numpy."""

    @F.arrow_udf("chimera boolean, cut int")
    def score(s: pa.Array, q: pa.Array) -> pa.Array:
        def run(a: list[str], b: list[str]) -> list[tuple]:
            reads = K.Reads(a, b, o.offset)
            best, bad = K.scan_single(reads, o), K.chimeric(reads, o)
            return list(zip(bad.tolist(), np.where(best.sure() & ~bad, best.x, -1).tolist()))

        return struct_of(by_length(run, texts(s), texts(q)), {"chimera": pa.bool_(), "cut": pa.int32()})

    s, q = (F.coalesce(col(c), F.lit("")) for c in (seq, qual))
    skip = key_single(s, o)
    ks, kq = behind(s, skip), behind(q, skip)
    raw = score(ks, kq)
    head = lambda c: F.substring(c, F.lit(1), raw["cut"])
    return result(raw, head(ks), head(kq), {"s1": (s, ks), "q1": (q, kq)}, None if skip is None else skip.isNull(), o, True)


def merged(record, s1, q1, s2, q2, o: Options) -> Column:
    """The result of read pairs; record only settles ties of bases."""

    @F.arrow_udf("chimera boolean, cut int, seq string, qual string")
    def score(r: pa.Array, a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        def run(_: list[str], record: list[int], *four: list[str]) -> list[tuple]:
            one, two = K.Reads(*four[:2], o.offset), K.Reads(*four[2:], o.offset)
            bad, best = K.chimeric(one, o), K.scan_pairs(one, two, o)
            cut = np.where(best.sure(o.min_overlap) & ~bad, best.x, -1)
            made = K.consensus(one, two.turned(), np.maximum(cut, 0), np.array(record, np.int64), o)
            return [(x, y, *z) for x, y, z in zip(bad.tolist(), cut.tolist(), made)]

        four = [texts(x) for x in (a, b, c, d)]
        longest = [x if len(x) > len(y) else y for x, y in zip(four[0], four[2])]
        kinds = {"chimera": pa.bool_(), "cut": pa.int32(), "seq": pa.string(), "qual": pa.string()}
        return struct_of(by_length(run, longest, r.to_pylist(), *four), kinds)

    whole = [F.coalesce(col(c), F.lit("")) for c in (s1, q1, s2, q2)]
    skips = key_pair(whole[0], whole[2], o)
    kept = [behind(c, skips[k // 2] if skips else None) for k, c in enumerate(whole)]
    raw = score(col(record), *kept)
    reads = dict(zip(("s1", "q1", "s2", "q2"), zip(whole, kept)))
    return result(raw, raw["seq"], raw["qual"], reads, skips[0].isNull() if skips else None, o, False)


def unpacked(best: K.Best) -> list[tuple]:
    return list(zip(*(c.tolist() for c in (best.x, best.second_x, best.ll, best.second, best.matches))))


def pack(rows: list[tuple]) -> pa.Array:
    """Candidates of a batch."""
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 5, CANDIDATES_TYPE)], [f.name for f in CANDIDATES_TYPE])


def candidates_single(seq, qual, o: Options) -> Column:
    """The two likeliest cuts of single reads."""

    @F.arrow_udf(CANDIDATES)
    def run(s: pa.Array, q: pa.Array) -> pa.Array:
        return pack(by_length(lambda a, b: unpacked(K.scan_single(K.Reads(a, b, o.offset), o)), texts(s), texts(q)))

    return run(seq, qual)


def candidates_pairs(s1, q1, s2, q2, o: Options, overhang: bool = False) -> Column:
    """The two likeliest fragment lengths of pairs; overhang: without adapters."""

    @F.arrow_udf(CANDIDATES)
    def run(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        scan = K.scan_overhang if overhang else K.scan_pairs
        one, q1, two, q2 = map(texts, (a, b, c, d))
        longest = [x if len(x) > len(y) else y for x, y in zip(one, two)]
        return pack(by_length(lambda _, *four: unpacked(scan(K.Reads(*four[:2], o.offset), K.Reads(*four[2:], o.offset), o)), longest, one, q1, two, q2))

    return run(s1, q1, s2, q2)


def adapter_places(seq, qual, o: Options) -> Column:
    """Of all places of the adapter in single reads: the last, the best likelihood (0 without places) and the most matches."""

    @F.arrow_udf("last_x int, best double, matches int")
    def run(s: pa.Array, q: pa.Array) -> pa.Array:
        def best(a: list[str], b: list[str]) -> list[tuple]:
            reads = K.Reads(a, b, o.offset)
            last = reads.len - 1 - o.cutoff
            ll, hits = K.adapter_places(reads, o.adapters[0], reads.width)
            able = np.arange(reads.width) <= last[:, None]
            top = np.where(able, ll, -np.inf).max(axis=1, initial=-np.inf)
            return list(zip(np.maximum(last, -1).tolist(), np.where(last < 0, 0.0, top).tolist(), np.where(able, hits, 0).max(axis=1, initial=0).tolist()))

        rows = by_length(best, texts(s), texts(q))
        kinds = (pa.int32(), pa.float64(), pa.int32())
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["last_x", "best", "matches"])

    return run(seq, qual)


def is_chimera(seq, qual, o: Options) -> Column:
    @F.arrow_udf("boolean")
    def run(s: pa.Array, q: pa.Array) -> pa.Array:
        return pa.array(by_length(lambda a, b: K.chimeric(K.Reads(a, b, o.offset), o).tolist(), texts(s), texts(q)), pa.bool_())

    return run(seq, qual)


def trim_single(reads: DataFrame, o: Options, seq: str = "s1", qual: str = "q1", to: str = "result") -> DataFrame:
    return reads.withColumn(to, trimmed(F.col(seq), F.col(qual), o))


def merge_pairs(pairs: DataFrame, o: Options, to: str = "result", record: str = "rec_idx") -> DataFrame:
    return pairs.withColumn(to, merged(F.col(record), F.col("s1"), F.col("q1"), F.col("s2"), F.col("q2"), o))
