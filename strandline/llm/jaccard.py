"""Near-duplicates by the Jaccard similarity of their sets of five-word shingles, 0.8 or more, found by Golay keys on fingerprints.

A text's set has a SimHash fingerprint of 1,024 bits (``simhash.wide_print``).  Sets of similarity 0.8 differ in 15 % of the bits, so
four bits of 64 do not reach them.  A key is the index of the Golay codeword nearest to 23 of the bits, with six further bits; two
such sets share one key in 22, and have 288 kinds of key to share.  Sets of up to ``FEW`` shingles, whose fingerprints differ in up to
19 %, have 640.  By calculation about 3 in 100,000 pairs of similarity 0.80 are missed, fewer of more similar ones.

In the bucket of a key 88 bits and the rough sizes are compared, and only what has another near by goes on.  What then has
sizes within 0.8 and whole fingerprints that near is a candidate, and each candidate is verified on the sets themselves.

Shingles that only one of these texts has can't be shared.  If a set of n has u of them, at most n - u are common to it and
another of m, and a similarity of 0.8 wants 4/9 of n + m; so m is at most 9/4 (n - u) - n, and the same the other way round.  That
rules out, exactly, the bulk of a large group in which texts differ from each other by edits of their own.

Pairs are made in two rounds, so that a large group costs in proportion to its members where it hangs together: first, under a
third of the kinds of key, each member of a key meets the one with the least share of shingles of its own, the nearest to the group's middle (ties by key, so
that they differ).  Then each key has a hub, a set in the middle of the group that most of its members belong to, and a member is known by its
deviations: what it has and the hub has not, or the other way round.  Members of one key that are still apart have the hub in common,
so how many shingles they differ in follows from how many deviations they share; those that are not alike with the hub need to
share many.  They meet under shared deviations, rarest first, where the bounds leave them able (``able_pairs``, exact), and edits
of their own, however many members have them, meet no one.

* Equal sets are one node, so exact copies never meet.  Null texts and texts without words are one empty set.
* A text of under five words is one shingle; very long texts are taken whole.  Ties go to the smaller hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .simhash import FURTHER, KINDS, WIDE, shingle_hashes, wide_keys, wide_print
from .util import HOT, cut, fresh, join_hot, session, small_batches

WORDS, LEAST = 5, 0.8
TIMES = 9  # (1 + LEAST) / (1 - LEAST)
SALTS = 64  # tasks that share the pairs of a hot node
FEW, USUAL = 20, 288  # sets of up to so many shingles have all KINDS of key, others so many
NEAR, NEAR_FEW = 29, 34  # of 88 bits
STEP, STEPS = 1.1, 3  # sizes as powers; those within 0.8 are so many apart at most
MIDDLES = 8  # that a node meets in the first round, those nearest to the middle of their groups
FIRST = 96  # kinds of key of the first round; the second has all
APART, APART_FEW = 215, 260  # of all bits; where the smaller set has under 32 shingles
BITS = [f"b{k}" for k in range(WIDE // 64)]
SKETCH = f"struct<{', '.join(f'{b}: long' for b in BITS)}>"


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct hashes of the shingles, ascending."""
    parts = [np.unique(h) for h in shingle_hashes(text, WORDS)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def add_sketches(docs: DataFrame, text: str) -> DataFrame:
    """docs with node, n and sketch instead of the text; node is 0 for an empty set."""
    small_batches(session(docs))
    (got,) = fresh(docs, "got")
    kind = pa.struct([("node", pa.int64()), ("n", pa.int32()), ("sketch", pa.struct([(b, pa.int64()) for b in BITS]))])
    none = {"node": 0, "n": 0, "sketch": dict.fromkeys(BITS, 0)}

    @F.arrow_udf(f"node long, n int, sketch {SKETCH}")
    def sketched(texts: pa.Array) -> pa.Array:
        seen: dict = {}
        out = []
        for t in texts.to_pylist():
            if t not in seen:
                s = shingle_set(t)
                if len(s):
                    bits = wide_print(s).view(np.int64)
                    node = int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), 3)).view(np.int64))
                    seen[t] = {"node": node, "n": len(s), "sketch": dict(zip(BITS, bits.tolist()))}
                else:
                    seen[t] = none
            out.append(seen[t])
        return pa.array(out, kind)

    return docs.withColumn(got, sketched(F.col(text))).select(*(c for c in docs.columns if c != text), f"{got}.*")


def likely(x: str, y: str) -> Column:
    """Whether two fingerprints (aliases) can be of sets that are alike."""
    apart = F.expr(" + ".join(f"bit_count({x}.sketch.{b} ^ {y}.sketch.{b})" for b in BITS))
    small, large = F.least(f"{x}.n", f"{y}.n"), F.greatest(f"{x}.n", f"{y}.n")
    able = (F.col(f"{y}.n") <= F.col(f"{x}.most")) & (F.col(f"{x}.n") <= F.col(f"{y}.most"))
    return able & (small >= large * F.lit(LEAST) - F.lit(1e-6)) & (apart <= F.when(small < 32, APART_FEW).otherwise(APART))


FEW_POWER = int(np.log(FEW) / np.log(STEP))


def rough(size: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Sizes as powers of STEP, and 24 bits of the second word (int32)."""
    power = np.floor(np.log(size) / np.log(STEP)).astype(np.uint32)
    return (power << np.uint32(24) | (words[:, 1] & np.uint64(0xFFFFFF)).astype(np.uint32)).view(np.int32)


def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From n and the words of the fingerprint: a row for each key, with the first word, the power of the size and 24 bits more."""
    for batch in batches:
        size = np.asarray(batch.column(0))
        words = np.stack([np.asarray(batch.column(k)).view(np.uint64) for k in range(1, batch.num_columns)], axis=1)
        more = rough(size, words)
        for few, kinds in ((True, KINDS), (False, USUAL)):
            those = np.flatnonzero((size <= FEW) == few)
            for at in range(0, len(those), 512):
                own = those[at : at + 512]
                key = wide_keys(np.ascontiguousarray(words[own]), kinds).ravel().astype(np.int32)
                print_, rest = (np.repeat(x[own], kinds) for x in (words[:, 0].view(np.int64), more))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(print_), pa.array(rest)], names=["band", "print", "more"])


def close(v: np.ndarray, m: np.ndarray, w: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Whether rows (first word, and what ``rough`` tells) can be of sets that are alike."""
    p, q = m >> 24 & 255, o >> 24 & 255
    apart = np.bitwise_count(v ^ w) + np.bitwise_count((m ^ o) & 0xFFFFFF)
    return (np.abs(p - q) <= STEPS) & (apart <= np.where(np.minimum(p, q) <= FEW_POWER, NEAR_FEW, NEAR))


def with_company(key: np.ndarray, v: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Which rows, ordered by key, have another one near by under their key."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    mark = np.zeros(len(key), bool)
    small = np.repeat(size <= 64, size)
    for step in range(1, int(size[size <= 64].max(initial=1))):
        i = np.flatnonzero(small[:-step] & (key[step:] == key[:-step]))
        i = i[close(v[i], m[i], v[i + step], m[i + step])]
        mark[i] = mark[i + step] = True
    for k in np.flatnonzero(size > 64):
        own = np.arange(first[k], first[k] + size[k])
        left = own
        while len(left):
            near = own[close(v[own], m[own], v[left[0]], m[left[0]])]
            if len(near) > 1:
                mark[near] = True
            left = left[1:]
            left = left[~mark[left]]
    return mark


def company(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (band, print, more) ordered by band, those with another one near by."""
    held = [np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.int32)]

    def kept(key, v, m):
        mark = with_company(key, v, m)
        return pa.RecordBatch.from_arrays([pa.array(key[mark]), pa.array(v[mark].view(np.int64))], names=["band", "print"])

    for batch in batches:
        new = [np.asarray(batch.column(k)) for k in range(3)]
        held = [np.concatenate([a, b.view(a.dtype)]) for a, b in zip(held, new)]
        if len(held[0]) and (last := np.searchsorted(held[0], held[0][-1])):
            yield kept(*(x[:last] for x in held))
            held = [x[last:] for x in held]
    if len(held[0]):
        yield kept(*held)


def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t).view(np.int64) for t in batch.column(1).to_pylist()]
        offsets = np.cumsum([0] + [len(s) for s in sets])
        values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))], names=["node", "shingles"])


def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, set of a, set of b), the pairs that are alike."""
    for batch in batches:
        good = []
        left, right = batch.column(2), batch.column(3)
        x, y = left.values.to_numpy(), right.values.to_numpy()
        i, j = left.offsets.to_numpy(), right.offsets.to_numpy()
        for k in range(batch.num_rows):
            if similarity(x[i[k] : i[k + 1]], y[j[k] : j[k + 1]]) >= LEAST:
                good.append(k)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good, pa.int64())), batch.column(1).take(pa.array(good, pa.int64()))], names=["a", "b"])


def hot_nodes(pairs: DataFrame, side: str) -> DataFrame:
    """Nodes of over a thousandth of the pairs, such as the middle of a large group; at most HOT."""
    counts = pairs.groupBy(F.col(side).alias("node")).agg(F.count("*").alias("n")).filter(F.col("n") > F.lit(max(pairs.count() / HOT, SALTS)))
    return F.broadcast(cut(counts.select("node", F.lit(True).alias("hot")), "hot"))


def with_set(pairs: DataFrame, sets: DataFrame, side: str, to: str, hot: DataFrame) -> DataFrame:
    """pairs with the set of one side; the pairs of a hot node are dealt to SALTS tasks, each with its set."""
    other = "b" if side == "a" else "a"
    dealt = pairs.join(hot.withColumnRenamed("node", side), side, "left")
    dealt = dealt.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
    copies = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    held = sets.join(hot, "node", "left").select(F.col("node").alias(side), F.col("shingles").alias(to), F.explode(copies).alias("salt"))
    return dealt.join(held, [side, "salt"]).drop("salt")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b), a stored table, those whose sets are alike; sets: node, shingles."""
    pairs = pairs.select("a", "b")
    hot = {side: hot_nodes(pairs, side) for side in "ab"}
    whole = with_set(with_set(pairs, sets, "b", "t", hot["b"]), sets, "a", "s", hot["a"]).select("a", "b", "s", "t")
    return cut(whole.mapInArrow(alike, "a long, b long"), "alike")


def around(members: DataFrame, rooted: DataFrame, star: DataFrame, links: DataFrame) -> DataFrame:
    """Node, root, n and own of the nodes that may have further links, with a hub; two nodes under one key have one hub in common.

    A node's hub is the one with most links within two pairs of the first round; a key's is the first of its nodes' hubs by that
    count.  Hubs whose nodes have one root are left out.
    """
    near = star.select(F.col("a").alias("node"), F.col("b").alias("other"))
    near = near.unionByName(near.select(F.col("other").alias("node"), F.col("node").alias("other")))
    near = cut(near.unionByName(near.select("node", F.col("node").alias("other")).distinct()), "near")
    degrees = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    hubs = near.select("node").distinct().join(degrees, "node", "left")
    hubs = hubs.select("node", F.struct(F.coalesce("degree", F.lit(0)).cast("long").alias("degree"), "node").alias("hub"))
    for _ in range(2):
        hubs = near.join(hubs.select(F.col("node").alias("other"), "hub"), "other").groupBy("node").agg(F.max("hub").alias("hub"))
    alone = F.struct(F.lit(0).cast("long").alias("degree"), "node")
    able = rooted.filter(F.col("most") >= F.col("n") * F.lit(LEAST) - F.lit(1e-6)).join(hubs, "node", "left")
    able = cut(able.select("node", "root", F.coalesce("hub", alone).alias("hub")), "able")
    tagged = cut(members.join(able, "node"), "tagged")
    keys = tagged.groupBy("band").agg(F.min("n").alias("shortest"), F.max("hub").alias("top"))
    met = tagged.join(keys, "band").filter("most >= shortest")
    met = cut(met.select("node", "root", "n", "own", F.col("top.node").alias("hub")).distinct(), "met")
    apart = met.groupBy("hub").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("hub")
    return met.join(apart, "hub")


def deviations(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (node and hub, a stored table) with the size of the hub's set, ``apart`` (what one of the two sets has and the other does
    not) and ``weight``: TIMES the size of that, less the size of the node's set."""
    pairs = pairs.withColumnsRenamed({"node": "a", "hub": "b"})
    hot = {side: hot_nodes(pairs, side) for side in "ab"}
    whole = with_set(with_set(pairs, sets, "b", "t", hot["b"]), sets, "a", "s", hot["a"])
    apart = F.concat(F.array_except("s", "t"), F.array_except("t", "s"))
    held = whole.select(F.col("a").alias("node"), F.col("b").alias("hub"), "root", "n", "own", F.size("t").alias("hub_n"), apart.alias("apart"))
    return cut(held.withColumn("weight", F.size("apart") * TIMES - F.col("n")), "deviations")


def able_pairs(held: DataFrame) -> DataFrame:
    """Pairs (a, b) of different roots around one hub that can be alike.

    Two sets are alike if TIMES the number of shingles in one of them only is at most the sum of their sizes; so if their weights
    are at most 2 TIMES the number of deviations that they share.  Nodes whose weight is at most the hub's size are alike with the
    hub, so one of a pair is another, ``far``.  From that follows for each node how many it must share with whichever partner
    (``need``).  Those that no one else has can't be shared; of the others, rarest first, two such nodes have one in common among
    all but the last need - 1.
    """
    two = F.lit(2 * TIMES)
    held = held.withColumn("far", F.col("weight") > F.col("hub_n"))
    most = two * (F.size("apart") - F.col("own"))
    live = held.filter(F.col("far") | (most > F.col("weight") + F.col("hub_n")))
    bounds = live.groupBy("hub").agg(F.min("weight").alias("lightest"), F.max("far").alias("some")).filter("some").drop("some")
    live = live.join(bounds, "hub").withColumn("other", F.when(F.col("far"), F.col("lightest")).otherwise(F.col("hub_n") + 1))
    live = cut(live.filter(most >= F.col("weight") + F.col("other")), "live")
    items = live.select("hub", "node", F.explode("apart").alias("item"))
    common = items.groupBy("hub", "item").agg(F.count("*").alias("times")).filter("times > 1")
    rare = F.sort_array(F.collect_list(F.struct("times", "item"))).alias("items")
    ready = live.drop("apart").join(items.join(common, ["hub", "item"]).groupBy("hub", "node").agg(rare), ["hub", "node"])
    ready = ready.withColumn("need", F.greatest(F.lit(1), F.ceil((F.col("weight") + F.col("other")) / two)).cast("int"))
    ready = ready.filter(F.size("items") >= F.col("need")).withColumn("reach", two * F.size("items") - F.col("weight"))
    kept = F.slice("items", F.lit(1), F.size("items") - F.col("need") + 1)
    index = cut(ready.select("hub", "node", "root", "weight", "reach", "far", F.explode(kept).alias("i")).withColumn("item", F.col("i.item")).drop("i"), "index")
    x, y = index.alias("x"), index.alias("y")
    met = (F.col("x.hub") == F.col("y.hub")) & (F.col("x.item") == F.col("y.item")) & (F.col("x.node") < F.col("y.node"))
    met &= (F.col("x.root") != F.col("y.root")) & (F.col("x.far") | F.col("y.far"))
    met &= (F.col("x.reach") >= F.col("y.weight")) & (F.col("y.reach") >= F.col("x.weight"))
    return x.join(y, met).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def groups(docs: DataFrame, text: str, key: str) -> DataFrame:
    """docs (doc, text, and key, the hash of the text) without the text and with ``root``: equal for rows joined by links of
    near-duplicates."""
    printed = cut(add_sketches(docs, text), "sketches")
    rep = F.min(F.struct(F.col("doc").isNull().alias("no"), F.col("doc").alias("doc"), F.col(key).alias("h"))).alias("rep")
    nodes = cut(printed.groupBy("node").agg(F.min("n").alias("n"), F.first("sketch").alias("sketch"), rep), "nodes")
    # sets of under four shingles are alike only where they are equal
    keyed = nodes.filter("n > 3").select("n", "sketch.*").mapInArrow(key_rows, "band int, print long, more int")
    tasks = int(session(docs).conf.get("spark.sql.shuffle.partitions"))
    met = cut(keyed.repartition(tasks, "band").sortWithinPartitions("band").mapInArrow(company, "band int, print long"), "met")
    shared = cut(met.distinct().join(nodes.filter("n > 3").select("node", F.col("sketch.b0").alias("print")), "print").select("node", "band"), "bands")

    # one text for each node that shares a key, as its set; by doc and hash, so that copies do not meet
    wanted = nodes.join(shared.select("node").distinct(), "node")
    same = F.col("t.doc").eqNullSafe(F.col("w.rep.doc")) & (F.col(f"t.{key}") == F.col("w.rep.h"))
    texts = docs.alias("t").join(wanted.select("node", "rep").alias("w"), same).groupBy("w.node").agg(F.first(f"t.{text}").alias("text"))
    sets = cut(texts.mapInArrow(as_sets, "node long, shingles array<long>"), "sets")
    own = sets.select("node", F.explode("shingles").alias("h")).groupBy("h").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    own = own.filter("n = 1").groupBy("node").agg(F.count("*").alias("own"))
    light = wanted.select("node", "n", "sketch").join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    light = cut(light.withColumn("most", F.floor((F.col("n") - F.col("own")) * (1 + 1 / LEAST) - F.col("n") + F.lit(1e-6))), "light")
    members = cut(shared.join(light.drop("sketch"), "node"), "members")

    def candidates(pairs: DataFrame) -> DataFrame:
        x = pairs.alias("p").join(light.alias("x"), F.col("p.a") == F.col("x.node")).join(light.alias("y"), (F.col("p.b") == F.col("y.node")) & likely("x", "y"))
        return cut(x.select("p.a", "p.b"), "candidates")

    mix = F.xxhash64("band")
    middle = F.min(F.struct((F.col("own") / F.col("n")).alias("share"), F.col("node").bitwiseXOR(mix).alias("node"))).alias("m")
    first = cut(members.groupBy("band").agg(middle).select("band", "m.share", F.col("m.node").bitwiseXOR(mix).alias("first")), "first")
    star = members.filter(F.shiftright("band", 12 + FURTHER) < FIRST).select("band", "node").join(first, "band").filter("node <> first").select("node", "share", "first").distinct()
    best = F.slice(F.sort_array(F.collect_list(F.struct("share", "first"))), 1, MIDDLES)
    star = star.groupBy("node").agg(best.alias("m")).select("node", F.explode("m").alias("m")).select("node", "m.first")
    star = candidates(star.select(F.least("node", "first").alias("a"), F.greatest("node", "first").alias("b")).distinct())
    links = verified(star, sets)

    rooted = light.drop("sketch").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    held = deviations(cut(around(members, rooted, star, links), "around"), sets)
    sure = held.filter("node <> hub and weight <= hub_n").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    rest = cut(able_pairs(held).join(star, ["a", "b"], "left_anti"), "candidates")
    found = components(links.unionByName(sure).unionByName(verified(rest, sets)))
    roots = cut(nodes.select("node").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "roots")
    kept = [c for c in docs.columns if c != text]
    return join_hot(printed.select(*kept, "node"), roots, "node").select(*kept, "root")
