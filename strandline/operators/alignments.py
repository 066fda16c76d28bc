"""BAM records: guards, mates, and the effects of trimming on flags and tags.

A record is rec_idx, qname, flag, pos, mapq, mpos, seq, qual and tags, a map from a tag's name to (type, value) as text, and for
aligned records ref, cigar, mref and tlen, which are carried through and may be missing.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MIN_LENGTH, Options
from .tally import outcome as tally_name
from ..functions.sequence import distinct_sorted, fill_quality, reverse_complement
from .trim import merged, trimmed
from .umi import head, tags, tail, unknown, without

PAIRED, UNMAPPED, FIRST, SECOND, FAIL, DUPLICATE = 1, 4, 64, 128, 512, 1024
EQUAL_TAGS = ("RG", "XI", "YI", "XJ", "YJ")
FIELDS = ("qname", "flag", "pos", "mapq", "mpos", "seq", "qual", "tags", "ref", "cigar", "mref", "tlen")
NOWHERE = {"ref": -1, "cigar": "", "mref": -1, "tlen": 0}  # of a record that is not aligned


def has(bit: int, flag="flag") -> Column:
    return F.col(flag).bitwiseAND(bit) != 0


def guard_aligned(records: DataFrame) -> DataFrame:
    """An error for a mapped record, or one with NM or MD."""
    bad = ~has(UNMAPPED) | F.map_contains_key("tags", "NM") | F.map_contains_key("tags", "MD")
    return records.withColumn("flag", F.when(bad, F.raise_error(F.concat(F.lit("aligned record: "), "qname")).cast("int")).otherwise(F.col("flag")))


def complete(records: DataFrame) -> DataFrame:
    """records with all FIELDS."""
    return records.withColumns({n: F.lit(v) for n, v in NOWHERE.items() if n not in records.columns})


def pair_mates(records: DataFrame) -> DataFrame:
    """a, b: first and second mates of a name as structs, in either order in the file; a name without both is an error.

    One shuffle by name brings both together.
    """
    fields = [c for c in ("rec_idx", *FIELDS) if c in records.columns]
    mate = lambda bit: F.max_by(F.struct(*fields), F.when(has(bit), F.col("rec_idx")))
    both = records.filter(has(PAIRED)).groupBy("qname").agg(mate(FIRST).alias("a"), mate(SECOND).alias("b"), F.count("*").alias("n"))
    ok = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("n") == 2)
    wrong = F.raise_error(F.concat(F.lit("not one first and one second mate: "), "qname"))
    return both.withColumn("n", F.when(ok, F.col("n")).otherwise(wrong.cast("long"))).filter("n = 2").select("a", "b")


def next_in_name(records: DataFrame) -> DataFrame:
    """Each record with the rec_idx of the next one of its name, in file order."""
    return records.withColumn("next_idx", F.lead("rec_idx").over(Window.partitionBy("qname").orderBy("rec_idx")))


def tag(m: Column, name: str) -> Column:
    return F.try_element_at(m, F.lit(name))["value"]


def put(m: Column, name: str, kind: str, value: Column) -> Column:
    rest = F.map_filter(m, lambda k, _: k != name)
    return F.when(value.isNull(), m).otherwise(F.map_concat(rest, F.create_map(F.lit(name), F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value")))))


def add_zq(m: Column, letters: Column) -> Column:
    return put(m, "ZQ", "Z", F.when(letters != "", distinct_sorted(F.concat(F.coalesce(tag(m, "ZQ"), F.lit("")), letters))))


def or_ff(m: Column, bits: Column) -> Column:
    old = F.try_element_at(m, F.lit("FF"))
    value = F.when(old.isNull(), bits).when(old["type"].isin("c", "C", "s", "S", "i", "I"), old["value"].cast("int").bitwiseOR(bits))
    return put(m, "FF", "i", value.otherwise(F.raise_error(F.lit("FF is not an integer")).cast("int")))


def same_tags(a: Column, b: Column) -> Column:
    """Tags of a that mates must share are equal in b."""
    ok = F.lit(True)
    for name in EQUAL_TAGS:
        ok = ok & (tag(a, name).isNull() | tag(a, name).eqNullSafe(tag(b, name)))
    return ok


def record(rec: Column, sub: int, outcome: Column | None = None, **fields: Column) -> Column:
    """outcome: what became of the pair or read, told with one of its records."""
    told = F.lit(None).cast("string") if outcome is None else outcome
    return F.struct(rec.alias("rec_idx"), F.lit(sub).alias("sub"), *[fields[n].alias(n) for n in FIELDS], told.alias("outcome"))


def told(o: Options, paired: bool, problem: Column) -> Column:
    """The tally's name for a result that still has its barcodes."""
    whole = replace(o, umi_f=0, umi_r=0, umi_trim_f=0, umi_trim_r=0)
    return F.when((F.col("r.code") == " ") & problem, "umi_problem").otherwise(tally_name(whole, "r", paired))


def with_barcode(m: Column, rx: Column, qx: Column) -> Column:
    return put(put(m, "RX", "Z", rx), "QX", "Z", qx)


def same(m: Column, **changed: Column) -> dict[str, Column]:
    return {n: changed.get(n, m[n]) for n in FIELDS}


def on(cond, then, other):
    return F.when(cond, then).otherwise(other)


def scored_pairs(df: DataFrame, o: Options) -> DataFrame:
    """Mates a and b with their qualities qa and qb and the result r, of which rows without b have an empty one."""
    a, b = F.col("a"), F.col("b")
    df = df.withColumn("qa", fill_quality(a["seq"], a["qual"])).withColumn("qb", fill_quality(b["seq"], b["qual"]))
    two = F.col("b").isNotNull()
    of = lambda c: F.when(two, c)
    return df.withColumn("r", merged(a["rec_idx"], of(a["seq"]), of(F.col("qa")), b["seq"], F.col("qb"), o))


def process_pairs(records: DataFrame, o: Options) -> DataFrame:
    """rec_idx, sub and the fields of what becomes of each pair: one merged record, or both, changed or not."""
    df = scored_pairs(pair_mates(complete(records)), o)
    return df.select(F.explode(pair_rows(o)).alias("x")).select("x.*")


def pair_rows(o: Options, turned: Column | None = None) -> Column:
    """What becomes of a scored pair; turned: where the second mate stands first, it does so in what is made of both too."""
    a, b = F.col("a"), F.col("b")
    code, seq, qual = F.col("r.code"), F.col("r.seq"), F.col("r.qual")
    new = F.length(seq) > 0
    longest = F.greatest(F.length(a["seq"]), F.length(b["seq"]))
    zq = F.concat(F.coalesce(tag(a["tags"], "ZQ"), F.lit("")), F.coalesce(tag(b["tags"], "ZQ"), F.lit("")))
    too_short = F.length(seq) < MIN_LENGTH
    letters = F.concat(zq, on(code != " ", code, F.lit("")), on(too_short, F.lit("L"), F.lit("")))
    m = add_zq(or_ff(a["tags"], on(F.length(seq) > longest, F.lit(2), F.lit(3))), letters)
    bad = (code != " ") | too_short | (has(FAIL, "a.flag") & has(FAIL, "b.flag"))
    flag = F.lit(UNMAPPED).bitwiseOR(on(bad, F.lit(FAIL), F.lit(0)))
    f, r_, cf, cr = o.umi_f, o.umi_r, o.umi_f + o.umi_trim_f, o.umi_r + o.umi_trim_r
    if o.umi:
        enough = F.length(seq) > cf + cr
        rx, qx = tags(head(seq, f), head(qual, f), tail(seq, r_), tail(qual, r_), o)
        m, flag = on(enough, with_barcode(m, rx, qx), m), on(enough, flag, flag.bitwiseOR(F.lit(DUPLICATE)))
        seq, qual = on(enough, without(seq, cf, cr), seq), on(enough, without(qual, cf, cr), qual)
    ok_tags = on(same_tags(a["tags"], b["tags"]), m, F.raise_error(F.lit("mates differ in a tag they must share")).cast("map<string,struct<type:string,value:string>>"))
    minus, zero = F.lit(-1), F.lit(0)
    problem = new & ~(F.length("r.seq") > cf + cr) if o.umi else F.lit(False)
    tallied = told(o, True, problem)
    name = F.concat(a["qname"], F.lit("_M")) if o.keep_original else a["qname"]
    one = record(F.least(a["rec_idx"], b["rec_idx"]), 0, tallied, qname=name, flag=flag, pos=minus, mapq=zero, mpos=minus, seq=seq, qual=qual, tags=ok_tags, **{n: F.lit(v) for n, v in NOWHERE.items()})
    failed = code != " "

    def kept(x: Column, q: Column, s_new: str, q_new: str, mate: int, sub: int) -> Column:
        s, ql = (F.col(f"r.{s_new}"), F.col(f"r.{q_new}")) if o.trim_key and o.keys else (x["seq"], q)
        tg = add_zq(x["tags"], on(failed, code, F.lit("")))
        fl = on(failed, x["flag"].bitwiseOR(F.lit(FAIL)), x["flag"])
        if o.umi:
            able = (F.length(a["seq"]) >= cf) & (F.length(b["seq"]) >= cr)
            rx, qx = tags(head(a["seq"], f), head(F.col("qa"), f), reverse_complement(head(b["seq"], r_)), F.reverse(head(F.col("qb"), r_)), o)
            n = cf if mate == 1 else cr
            fl = on(able, fl, F.raise_error(F.lit("a read is shorter than its barcode")).cast("int"))
            tg, s, ql = with_barcode(tg, rx, qx), without(s, n, 0), without(ql, n, 0)
        return record(x["rec_idx"], sub, tallied if mate == 1 else None, **same(x, seq=s, qual=ql, tags=tg, flag=fl))

    pair = [kept(a, F.col("qa"), "s1", "q1", 1, 1), kept(b, F.col("qb"), "s2", "q2", 2, 2)]
    originals = [record(x["rec_idx"], k, **same(x, flag=x["flag"].bitwiseOR(F.lit(DUPLICATE)))) for k, x in ((1, a), (2, b))] if o.keep_original else []
    both = lambda rows: F.array(*rows) if turned is None else F.when(turned, F.reverse(F.array(*rows))).otherwise(F.array(*rows))
    return F.when(new, F.concat(F.array(one), both(originals)) if originals else F.array(one)).otherwise(both(pair))


def process_singles(records: DataFrame, o: Options) -> DataFrame:
    """The same for records without a mate."""
    df = complete(records).filter(~has(PAIRED)).select(F.struct("rec_idx", *FIELDS).alias("a"))
    df = df.withColumn("qa", fill_quality("a.seq", "a.qual"))
    df = df.withColumn("r", trimmed(F.col("a.seq"), F.col("qa"), o))
    return df.select(F.explode(single_rows(o)).alias("x")).select("x.*")


def single_rows(o: Options) -> Column:
    """What becomes of a scored single record."""
    a, code = F.col("a"), F.col("r.code")
    new, failed = F.length("r.seq") > 0, code != " "
    base_seq, base_q = (F.col("r.s1"), F.col("r.q1")) if o.trim_key and o.keys else (a["seq"], F.col("qa"))
    seq, qual = on(new, F.col("r.seq"), base_seq), on(new, F.col("r.qual"), base_q)
    m = add_zq(on(new, or_ff(a["tags"], F.lit(1)), a["tags"]), on(failed, code, F.lit("")))
    flag = on(failed, a["flag"].bitwiseOR(F.lit(FAIL)), a["flag"])
    if o.umi:
        f, r_, cf, cr = o.umi_f, o.umi_r, o.umi_f + o.umi_trim_f, o.umi_r + o.umi_trim_r
        able = F.length(seq) > on(new, F.lit(cf + cr), F.lit(cf))
        rx, qx = tags(head(seq, f), head(qual, f), on(new, tail(seq, r_), unknown(r_, "N")), on(new, tail(qual, r_), unknown(r_, "!")), o)
        m, flag = on(able, with_barcode(m, rx, qx), m), on(able, flag, flag.bitwiseOR(F.lit(DUPLICATE)))
        last = on(new, F.lit(cr), F.lit(0))
        cut = lambda c: F.substring(c, F.lit(cf + 1), F.greatest(F.length(c) - cf - last, F.lit(0)))
        seq, qual = on(able, cut(seq), seq), on(able, cut(qual), qual)
    name = on(new, F.concat(a["qname"], F.lit("_M")), a["qname"]) if o.keep_original else a["qname"]
    one = record(a["rec_idx"], 0, told(o, False, ~able if o.umi else F.lit(False)), **same(a, qname=name, flag=flag, seq=seq, qual=qual, tags=m))
    old = record(a["rec_idx"], 1, **same(a, flag=a["flag"].bitwiseOR(F.lit(DUPLICATE))))
    return F.when(new, F.array(one, old)).otherwise(F.array(one)) if o.keep_original else F.array(one)


def process_mates(mates: DataFrame, o: Options) -> DataFrame:
    """The same of mates that are rows already (a, b; b is null for single records), in their order and in one pass; ``stray`` tells
    a paired record without its mate, which has no other fields."""
    if not o.aligned:
        of = lambda c: F.when(F.col(c).isNotNull(), guarded(c))
        mates = mates.withColumns({"a": of("a"), "b": of("b")})
    two, stray = F.col("b").isNotNull(), F.col("b").isNull() & has(PAIRED, "a.flag")
    # mates in either order in the file
    turned = two & has(SECOND, "a.flag") & has(FIRST, "b.flag")
    bad = two & ~(turned | (has(FIRST, "a.flag") & has(SECOND, "b.flag")))
    wrong = F.raise_error(F.concat(F.lit("not one first and one second mate: "), "a.qname")).cast("boolean")
    df = mates.withColumn("turned", F.when(bad, wrong).otherwise(turned)).withColumn("one", F.when(F.col("turned"), F.col("b")).otherwise(F.col("a")))
    df = df.select(F.col("one").alias("a"), F.when(F.col("turned"), F.col("a")).otherwise(F.col("b")).alias("b"), stray.alias("stray"), "turned")
    df = scored_pairs(df, o).withColumnRenamed("r", "r2")
    alone = F.when(~two, F.col("a.seq"))
    df = df.withColumn("r1", trimmed(alone, F.when(~two, F.col("qa")), o)).withColumn("r", F.when(two, F.col("r2")).otherwise(F.col("r1"))).drop("r1", "r2")
    rows = F.when(F.col("stray"), F.array(record(F.col("a.rec_idx"), 0, **same(F.col("a"))))).when(two, pair_rows(o, F.col("turned"))).otherwise(single_rows(o))
    return df.select("stray", F.explode(rows).alias("x")).select("stray", "x.*")


def guarded(c: str) -> Column:
    """A record, or an error if it is aligned."""
    bad = ~has(UNMAPPED, f"{c}.flag") | F.map_contains_key(f"{c}.tags", "NM") | F.map_contains_key(f"{c}.tags", "MD")
    return F.col(c).withField("flag", F.when(bad, F.raise_error(F.concat(F.lit("aligned record: "), f"{c}.qname")).cast("int")).otherwise(F.col(f"{c}.flag")))


def process(records: DataFrame, o: Options) -> DataFrame:
    """All records of a BAM file, in its order by rec_idx and sub; outcome, where it is not null, is for the tally."""
    if not o.aligned:
        records = guard_aligned(records)
    return process_pairs(records, o).unionByName(process_singles(records, o))
