"""Queries that exercise every operator over reads made from the given tables, each with its SQL."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CHIMERAS, FORWARD, Options
from ..functions import sequence as S
from ..operators import alignments as B
from ..operators import infer as I
from ..operators import prior as P
from ..operators import tally as R
from ..operators import trim as T
from ..operators import umi as U
from ..sources import bam, fastq
from ..sources.fastq import numbered, zip_pairs
from ..sources.lengths import read_lengths
from . import oracles as O
from .run import process as run_reads
from .run import run_fastq
from .synthetic import CLEAR_PAIRS, PAIRS, SINGLE

LOC, SCALE = 4.0, 0.6
KEY, KEY2, IKEY = "ACGTAC", "TTGNCA", "GATTAC"
QUERIES: dict[str, tuple[Callable, str | None]] = {}


def query(oracle: str | None = None):
    def put(f):
        QUERIES[f.__name__] = (f, oracle)
        return f

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dealt(scan: DataFrame) -> DataFrame:
    """A table that Spark would read in fewer tasks than there are cores, dealt to all of them: its rows are few, but reads made from
    them are work."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    size = sum(os.path.getsize(f.removeprefix("file://")) for f in scan.inputFiles()) if all(f.startswith("file:") for f in scan.inputFiles()) else None
    return scan.repartition(cores) if size is not None and size < cores << 22 else scan


def made(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    """SQL over the one table that it names."""
    name, key = ("orders", "o_orderkey") if " orders)" in sql else ("customer", "c_custkey")
    return spark.sql(sql.replace(f"FROM {name}", "FROM {t}"), t=dealt(table(spark, sf, name).select(key)))


def singles(spark, sf) -> DataFrame:
    return made(spark, sf, SINGLE)


def pairs(spark, sf) -> DataFrame:
    return made(spark, sf, PAIRS)


def over(sql: str, source: str = SINGLE, name: str = "reads") -> str:
    return f"WITH {name} AS ({source}) {sql}"


# ---- projections


@query(over("SELECT read_id, reverse(translate(seq, 'ACGTN', 'TGCAN')) AS rc FROM reads"))
def revcomp_reads(spark, sf):
    return singles(spark, sf).select("read_id", S.reverse_complement("seq").alias("rc"))


@query(over("SELECT read_id, reverse(qual) AS rq FROM reads"))
def reverse_quality(spark, sf):
    return singles(spark, sf).select("read_id", S.reverse_quality("qual").alias("rq"))


@query(over(f"SELECT read_id, CAST({O.edits('substr(seq, 1, 6)', repr(KEY2))} AS INT) AS edits FROM reads"))
def key_edit_distance(spark, sf):
    return singles(spark, sf).select("read_id", S.edits(F.substring("seq", 1, 6), F.lit(KEY2)).alias("edits"))


@query(over("SELECT read_id, coalesce(list_aggregate(list_sort(list_distinct(string_split(qual, ''))), 'string_agg', ''), '') AS flags FROM reads"))
def distinct_sorted_flags(spark, sf):
    return singles(spark, sf).select("read_id", S.distinct_sorted("qual").alias("flags"))


@query("SELECT o_orderkey, CAST(coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 8 END, 0) | (o_orderkey % 4) AS INT) AS ff FROM orders")
def flag_bitor(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", S.merge_flag(F.when(k % 3 != 0, (k % 8).cast("int")), (k % 4).cast("int")).alias("ff"))


@query(over("SELECT read_id, CASE WHEN length(a) <= 30 THEN rpad(a, 31, 'I') ELSE a END AS adapter FROM (SELECT read_id, substr(seq, 1, CAST(read_id % 40 AS INT)) AS a FROM reads)"))
def adapter_padding(spark, sf):
    return singles(spark, sf).select("read_id", S.pad_adapter(F.expr("substr(seq, 1, CAST(read_id % 40 AS INT))")).alias("adapter"))


@query(f"SELECT o_orderkey, round({O.e('o_orderkey % 64')}, 9) AS error, round({O.match('o_orderkey % 64')}, 9) AS match, round({O.mismatch('o_orderkey % 64')}, 9) AS mismatch FROM orders")
def phred_probability(spark, sf):
    q = F.col("o_orderkey") % 64
    return table(spark, sf, "orders").select(
        "o_orderkey", F.round(S.error_probability(q), 9).alias("error"), F.round(S.log10_match(q), 9).alias("match"), F.round(S.log10_mismatch(q), 9).alias("mismatch")
    )


@query(f"SELECT o_orderkey, round({O.density('o_orderkey % 1000', LOC, SCALE)}, 6) AS density FROM orders")
def prior_density(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.round(S.log10_density(F.col("o_orderkey") % 1000, LOC, SCALE), 6).alias("density"))


@query(f"WITH {O.survival_table(LOC, SCALE, 1200)} SELECT o_orderkey, round(sv, 6) AS survival FROM orders JOIN surv ON sx = o_orderkey % 1200")
def prior_survival(spark, sf):
    """Lengths in the table and beyond it."""
    return table(spark, sf, "orders").select("o_orderkey", F.round(S.log10_survival(F.col("o_orderkey") % 1200, LOC, SCALE), 6).alias("survival"))


@query(over(f"SELECT read_id, round({O.density('length(seq)', LOC, SCALE)}, 6) AS density, round(sv, 6) AS survival FROM reads JOIN surv ON sx = length(seq)").replace("WITH ", f"WITH {O.survival_table(LOC, SCALE)}, "))
def prior_joined(spark, sf):
    """The prior as a table of lengths below 40, joined with reads, and calculated for longer ones."""
    df = P.with_prior(singles(spark, sf).select("read_id", F.length("seq").alias("n")), "n", LOC, SCALE, most=40)
    return df.select("read_id", F.round("log10_density", 6).alias("density"), F.round("log10_survival", 6).alias("survival"))


@query("SELECT pmod AS bucket, round(max(ll) + log10(sum(pow(10.0, ll - top))), 6) AS total FROM (SELECT *, max(ll) OVER (PARTITION BY pmod) AS top FROM (SELECT o_orderkey % 50 AS pmod, -((o_orderkey * 31) % 997) / 100.0 AS ll FROM orders)) GROUP BY pmod")
def log_sum(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select((k % 50).alias("bucket"), (-((k * 31) % 997) / 100.0).alias("ll"))
    return S.log10_sums(rows, "bucket", "ll", "total").select("bucket", F.round("total", 6).alias("total"))


@query("SELECT o_orderkey, regexp_replace(regexp_replace(split_part('@r' || CAST(o_orderkey AS STRING) || '/' || CAST(1 + o_orderkey % 2 AS STRING) || ' x', ' ', 1), '/[12]$', ''), '^@', '') AS name FROM orders")
def read_names(spark, sf):
    k = F.col("o_orderkey")
    header = F.concat(F.lit("@r"), k.cast("string"), F.lit("/"), (1 + k % 2).cast("string"), F.lit(" x"))
    return table(spark, sf, "orders").select("o_orderkey", S.read_name(header).alias("name"))


@query(over("SELECT read_id, CASE WHEN read_id % 5 = 0 THEN repeat('0', CAST(length(seq) AS INT)) ELSE qual END AS qual FROM reads"))
def missing_quality(spark, sf):
    q = F.when(F.col("read_id") % 5 == 0, "*").otherwise(F.col("qual"))
    return singles(spark, sf).select("read_id", S.fill_quality("seq", q).alias("qual"))


# ---- prior


@query("SELECT count(*) AS n, round(avg(ln(x)), 9) AS meanlog, round(stddev_pop(ln(x)), 9) AS sdlog, round(stddev_pop(ln(x)) / sqrt(count(*)), 9) AS meanlog_se, round(stddev_pop(ln(x)) / sqrt(2 * count(*)), 9) AS sdlog_se FROM (SELECT 30 + o_orderkey % 271 AS x FROM orders)")
def fit_lognormal(spark, sf):
    got = P.fit_lognormal(table(spark, sf, "orders").select((30 + F.col("o_orderkey") % 271).alias("len")))
    return got.select("n", *[F.round(c, 9).alias(c) for c in ("meanlog", "sdlog", "meanlog_se", "sdlog_se")])


ALIGNED = f"SELECT CAST(read_id % 8 AS INT) AS flag, seq, CAST(read_id % 301 - 150 AS INT) AS tlen FROM ({SINGLE}) z"


@query(over("SELECT count(*) AS n, round(avg(ln(length(seq))), 9) AS meanlog, round(stddev_pop(ln(length(seq))), 9) AS sdlog FROM reads WHERE length(seq) > 0"))
def length_file_fit(spark, sf):
    """A file of lengths, one a line, read and fitted."""
    path = scratch(spark)
    singles(spark, sf).select(F.length("seq").cast("string")).write.text(path)
    return P.fit_lognormal(read_lengths(spark, path)).select("n", F.round("meanlog", 9).alias("meanlog"), F.round("sdlog", 9).alias("sdlog"))


@query("SELECT string_agg(translate(md5(s_name), '0123456789abcdef', 'ACGTACGTACGTACGT'), '' ORDER BY s_suppkey) AS seq FROM supplier")
def fasta_sequence(spark, sf):
    """A FASTA record of a line for each supplier."""
    path = scratch(spark)
    lines = table(spark, sf, "supplier").select("s_suppkey", F.translate(F.md5("s_name"), "0123456789abcdef", "ACGTACGTACGTACGT").alias("line"))
    lines = lines.unionByName(spark.sql("SELECT CAST(-1 AS BIGINT) AS s_suppkey, '>adapter' AS line")).coalesce(1).sortWithinPartitions("s_suppkey")
    lines.select("line").write.text(path)
    return fastq.read_fasta(spark, path)


@query(over("SELECT read_id, seq FROM reads"))
def length_check(spark, sf):
    return singles(spark, sf).select("read_id", S.check_lengths("seq", "qual").alias("seq"))


@query(f"WITH a AS ({ALIGNED}), u AS (SELECT CAST(length(seq) AS INT) AS len FROM a WHERE flag & 5 = 0 UNION ALL SELECT tlen FROM a WHERE flag & 2 = 2 AND tlen > 0) SELECT len, count(*) AS n FROM u GROUP BY len")
def insert_size_union(spark, sf):
    return P.insert_sizes(made(spark, sf, ALIGNED)).groupBy("len").agg(F.count("*").alias("n"))


# ---- single reads


@query(f"{O.single()} SELECT id AS read_id, CAST(best AS INT) AS best, round(best_ll, 6) AS best_ll, round(second_ll, 6) AS second_ll FROM top")
def top2_candidates(spark, sf):
    df = singles(spark, sf).withColumn("c", T.candidates_single(F.col("seq"), F.col("qual"), Options()))
    second = F.when(F.col("c.second_ll") > float("-inf"), F.col("c.second_ll"))
    return df.select("read_id", F.col("c.best").alias("best"), F.round("c.best_ll", 6).alias("best_ll"), F.round(second, 6).alias("second_ll"))


@query(f"{O.single()} SELECT read_id, CAST(coalesce(max(x), -1) AS INT) AS last_x, round(coalesce(max(ll), 0), 6) AS best_adapter, CAST(coalesce(max(hits), 0) AS INT) AS most_hits FROM reads LEFT JOIN ad ON ad.id = read_id GROUP BY read_id")
def adapter_likelihood(spark, sf):
    """Of every place of the adapter in every read: the best likelihood and the most matches."""
    df = singles(spark, sf).withColumn("a", T.adapter_places(F.col("seq"), F.col("qual"), Options()))
    return df.select("read_id", "a.last_x", F.round("a.best", 6).alias("best_adapter"), F.col("a.matches").alias("most_hits"))


@query(f"WITH reads AS ({SINGLE}), {O.bases('reads', 'bs', 'read_id', 'seq', 'qual')}, {O.chimeras('reads', 'read_id', 'bs', 'seq')} SELECT read_id, bad.id IS NOT NULL AS chimera FROM reads LEFT JOIN bad ON bad.id = read_id")
def chimera_filter(spark, sf):
    return singles(spark, sf).select("read_id", T.is_chimera(F.col("seq"), F.col("qual"), Options()).alias("chimera"))


@query(O.trim_sql())
def trim_single(spark, sf):
    df = T.trim_single(singles(spark, sf), Options(), "seq", "qual")
    return df.select("read_id", "result.code", "result.cut", "result.seq", "result.qual")


@query(O.trim_sql())
def trim_lower_case(spark, sf):
    """Adapters and chimeras in lower case are taken as upper case."""
    df = T.trim_single(singles(spark, sf), Options(forward=FORWARD.lower(), chimeras=CHIMERAS.lower()), "seq", "qual")
    return df.select("read_id", "result.code", "result.cut", "result.seq", "result.qual")


@query(O.trim_sql((LOC, SCALE)))
def trim_single_prior(spark, sf):
    df = T.trim_single(singles(spark, sf), Options(loc=LOC, scale=SCALE), "seq", "qual")
    return df.select("read_id", "result.code", "result.cut", "result.seq", "result.qual")


KEYED = f"""SELECT read_id, CASE WHEN read_id % 4 = 0 THEN '{KEY}' || seq WHEN read_id % 4 = 1 THEN '{KEY[:2]}A{KEY[3:]}' || seq WHEN read_id % 4 = 2 THEN '{KEY[1:]}' || seq ELSE 'CCCCCC' || seq END AS seq,
  substr('IIIIII', 1, CAST(CASE WHEN read_id % 4 = 2 THEN 5 ELSE 6 END AS INT)) || qual AS qual FROM ({SINGLE}) z"""


@query(over(f"SELECT read_id, NOT (substr(seq, 1, 6) = '{KEY}' OR {O.edits('substr(seq, 1, 6)', repr(KEY))} = 1 OR substr(seq, 1, 5) = '{KEY[1:]}') AS failed, CASE WHEN substr(seq, 1, 6) = '{KEY}' OR {O.edits('substr(seq, 1, 6)', repr(KEY))} = 1 THEN substr(seq, 7) WHEN substr(seq, 1, 5) = '{KEY[1:]}' THEN substr(seq, 6) ELSE seq END AS rest FROM reads", KEYED))
def key_filter_single(spark, sf):
    df = T.trim_single(made(spark, sf, KEYED), Options(keys=KEY, allow_missing=True), "seq", "qual")
    return df.select("read_id", (F.col("result.code") == "K").alias("failed"), F.col("result.s1").alias("rest"))


KEYED_PAIRS = f"""SELECT pair_id, CASE WHEN pair_id % 5 = 0 THEN '{KEY}' WHEN pair_id % 5 = 1 THEN '{KEY[:2]}A{KEY[3:]}' WHEN pair_id % 5 = 2 THEN '{KEY[1:]}' WHEN pair_id % 5 = 3 THEN '{KEY}' ELSE 'GGGGGG' END || s1 AS s1,
  CASE WHEN pair_id % 5 = 3 THEN 'TGGCA' ELSE 'TTGGCA' END || s2 AS s2, pair_id % 5 AS kind FROM ({PAIRS}) z"""


def e1(k: str = KEY) -> str:
    return O.edits("substr(s1, 1, 6)", repr(k))


@query(
    over(
        f"""SELECT pair_id, ok IS NULL AS failed, coalesce(substr(s1, CAST(split_part(ok, ',', 1) AS INT)), s1) AS rest1, coalesce(substr(s2, CAST(split_part(ok, ',', 2) AS INT)), s2) AS rest2 FROM (
          SELECT *, CASE WHEN {e1()} = 0 AND {O.edits("substr(s2, 1, 6)", repr(KEY2))} = 0 OR {e1()} + {O.edits("substr(s2, 1, 6)", repr(KEY2))} = 1 THEN '7,7'
            WHEN substr(s1, 1, 5) = '{KEY[1:]}' AND substr(s2, 1, 6) = '{KEY2}' THEN '6,7' WHEN substr(s1, 1, 6) = '{KEY}' AND substr(s2, 1, 5) = '{KEY2[1:]}' THEN '7,6' END AS ok FROM kp)""",
        KEYED_PAIRS,
        "kp",
    )
)
def key_filter_paired(spark, sf):
    df = made(spark, sf, KEYED_PAIRS).withColumns({"q1": F.repeat(F.lit("I"), F.length("s1")), "q2": F.repeat(F.lit("I"), F.length("s2"))})
    df = T.merge_pairs(df, Options(keys=f"{KEY},{KEY2}", allow_missing=True), record="pair_id")
    return df.select("pair_id", (F.col("result.code") == "K").alias("failed"), F.col("result.s1").alias("rest1"), F.col("result.s2").alias("rest2"))


INNER = f"SELECT o_orderkey AS read_id, substr('{IKEY}' || translate(md5('i' || CAST(o_orderkey AS STRING)), '0123456789abcdef', 'ACGTACGTACGTACGT'), CAST(1 + o_orderkey % 3 AS INT), 24) || '{FORWARD[:26]}' AS seq FROM orders"


@query(
    over(
        f"SELECT read_id, CASE WHEN substr(seq, 1, 6) = '{IKEY}' OR {O.edits('substr(seq, 1, 6)', repr(IKEY))} = 1 THEN ' ' ELSE 'K' END AS code, substr(seq, CAST(CASE WHEN substr(seq, 1, 6) = '{IKEY}' OR {O.edits('substr(seq, 1, 6)', repr(IKEY))} = 1 THEN 7 ELSE 1 END AS INT), CAST(CASE WHEN substr(seq, 1, 6) = '{IKEY}' OR {O.edits('substr(seq, 1, 6)', repr(IKEY))} = 1 THEN 18 ELSE 24 END AS INT)) AS seq FROM reads",
        INNER,
    )
)
def inner_key(spark, sf):
    df = spark.sql(INNER.replace("FROM orders", "FROM {t}"), t=table(spark, sf, "orders")).withColumn("qual", F.repeat(F.lit("I"), F.length("seq")))
    df = T.trim_single(df, Options(ikey=IKEY, allow_missing=True), "seq", "qual")
    return df.select("read_id", "result.code", "result.seq")


# ---- pairs


def decided(spark, sf, o: Options) -> DataFrame:
    df = T.merge_pairs(pairs(spark, sf), o, record="pair_id")
    return df.select("pair_id", "result.cut", (F.col("result.code") == "D").alias("chimera"))


@query(f"{O.paired()} {O.DECISION}")
def merge_decision(spark, sf):
    return decided(spark, sf, Options())


@query(f"{O.paired(partial=True)} {O.DECISION}")
def merge_partial_overlap(spark, sf):
    return decided(spark, sf, Options(ancient=True))


@query(f"{O.paired(prior=(LOC, SCALE))} {O.DECISION}")
def merge_prior(spark, sf):
    return decided(spark, sf, Options(loc=LOC, scale=SCALE))


@query(O.consensus_sql())
def merge_consensus(spark, sf):
    df = T.merge_pairs(pairs(spark, sf), Options(), record="pair_id").filter("result.seq <> ''")
    return df.select("pair_id", "result.seq", "result.qual")


@query(f"{O.paired()} SELECT pair_id, CAST(best AS INT) AS best, round(best_ll, 6) AS best_ll, CAST(hits AS INT) AS matches FROM pairs JOIN top ON id = pair_id")
def overlap_likelihood(spark, sf):
    df = pairs(spark, sf).withColumn("c", T.candidates_pairs(F.col("s1"), F.col("q1"), F.col("s2"), F.col("q2"), Options()))
    return df.select("pair_id", "c.best", F.round("c.best_ll", 6).alias("best_ll"), "c.matches")


@query(O.tally_sql())
def run_tally(spark, sf):
    df = T.merge_pairs(pairs(spark, sf), Options(), record="pair_id")
    return R.tally(df.select(R.outcome(Options()).alias("outcome")))


@query(f"SELECT total, {', '.join(f'100.0 * {n} / total AS {n}_percent' for n in R.TALLY[1:])} FROM ({O.tally_sql()})")
def run_tally_percent(spark, sf):
    return R.percentages(run_tally(spark, sf))


# ---- barcodes, over given results

RESULTS = f"""SELECT pair_id, CASE WHEN pair_id % 23 = 0 THEN 'K' ELSE ' ' END AS code, CASE WHEN pair_id % 3 = 0 THEN '' ELSE substr(ins, 1, CAST(pair_id % 40 AS INT)) END AS seq,
  CASE WHEN pair_id % 3 = 0 THEN '' ELSE substr(q1 || q2, 1, CAST(pair_id % 40 AS INT)) END AS qual, s1, q1, s2, q2 FROM ({PAIRS}) z"""


def results(spark, sf) -> DataFrame:
    df = made(spark, sf, RESULTS)
    return df.select("pair_id", F.struct("code", "seq", "qual", F.lit(-1).alias("cut"), "s1", "q1", "s2", "q2").alias("result"))


#: Results with every outcome; barcodes of six and four bases with one and two more to cut.
EVERY = RESULTS.replace("THEN 'K' ELSE", "THEN 'K' WHEN pair_id % 29 = 0 THEN 'D' ELSE")
EVERY_TALLY = "SELECT {paired} AS paired, count(*) AS total, " + ", ".join(f"count(*) FILTER (o = '{n}') AS {n}" for n in R.TALLY[1:]) + """ FROM (SELECT CASE
    WHEN code = 'K' THEN 'failed_key' WHEN code = 'D' THEN 'chimera' WHEN seq <> '' AND length(seq) < {cut} OR seq = '' AND (length(s1) < {f} OR {other}) THEN 'umi_problem'
    WHEN length(seq) IN (0, {cut}) THEN 'kept' WHEN NOT {paired} THEN 'trimmed' WHEN length(seq) > greatest(length(s1), length(s2)) THEN 'merged_overlap' ELSE 'merged_trim' END AS o FROM ({every}) e) t"""


@query(
    EVERY_TALLY.format(paired="true", cut=13, f=7, other="length(s2) < 6", every=EVERY) + " UNION ALL " + EVERY_TALLY.format(paired="false", cut=13, f=7, other="false", every=EVERY)
)
def tally_every_outcome(spark, sf):
    """Of pairs and of single reads, with barcodes and keys that fail."""
    o = Options(umi_f=6, umi_trim_f=1, umi_r=4, umi_trim_r=2)
    df = made(spark, sf, EVERY).select("pair_id", F.struct("code", "seq", "qual", F.lit(-1).alias("cut"), "s1", "q1", "s2", "q2").alias("result"))
    rows = [R.tally(U.extract(df, o, paired=p).select(R.outcome(o, paired=p).alias("outcome"))).withColumn("paired", F.lit(p)) for p in (True, False)]
    return rows[0].unionByName(rows[1])


def umi_sql(f: int, r: int, cf: int, cr: int, paired: bool) -> str:
    tag = (lambda a, b, sep: f"({a}) || '{sep}' || ({b})") if f and r else (lambda a, b, sep: a if f else b)
    kr, kq = ("reverse(translate(substr(s2, 1, {r}), 'ACGTN', 'TGCAN'))", "reverse(substr(q2, 1, {r}))") if paired else ("repeat('N', {r})", "repeat('!', {r})")
    kr, kq = kr.format(r=r), kq.format(r=r)
    new = "length(seq) > 0"
    short = f"(length(seq) > 0 AND length(seq) < {cf + cr})"
    cut = lambda c, a, b: f"substr({c}, {a + 1}, CAST(greatest(length({c}) - {a + b}, 0) AS INT))"
    rx = f"CASE WHEN {short} THEN {tag(f'repeat({chr(39)}N{chr(39)}, {f})', f'repeat({chr(39)}N{chr(39)}, {r})', '-')} WHEN {new} THEN {tag(f'substr(seq, 1, {f})', f'substr(seq, CAST(length(seq) - {r} + 1 AS INT), {r})', '-')} ELSE {tag(f'substr(s1, 1, {f})', kr, '-')} END"
    qx = f"CASE WHEN {short} THEN {tag(f'repeat({chr(39)}!{chr(39)}, {f})', f'repeat({chr(39)}!{chr(39)}, {r})', ' ')} WHEN {new} THEN {tag(f'substr(qual, 1, {f})', f'substr(qual, CAST(length(qual) - {r} + 1 AS INT), {r})', ' ')} ELSE {tag(f'substr(q1, 1, {f})', kq, ' ')} END"
    s2 = f"CASE WHEN {new} THEN s2 ELSE {cut('s2', 0, cr)} END" if paired else "s2"
    return f"""WITH res AS ({RESULTS}) SELECT pair_id, CASE WHEN {short} AND code = ' ' THEN 'U' ELSE code END AS code, {rx} AS rx, {qx} AS qx,
      CASE WHEN {new} AND NOT {short} THEN {cut("seq", cf, cr)} ELSE seq END AS seq, CASE WHEN {new} THEN s1 ELSE {cut("s1", cf, 0)} END AS s1, {s2} AS s2 FROM res"""


def barcodes(spark, sf, o: Options, paired: bool) -> DataFrame:
    df = U.extract(results(spark, sf), o, paired=paired)
    return df.select("pair_id", "result.code", "rx", "qx", "result.seq", "result.s1", "result.s2")


@query(umi_sql(6, 0, 8, 0, True))
def umi_forward(spark, sf):
    return barcodes(spark, sf, Options(umi_f=6, umi_trim_f=2), True)


@query(umi_sql(5, 4, 6, 5, True))
def umi_dual(spark, sf):
    return barcodes(spark, sf, Options(umi_f=5, umi_trim_f=1, umi_r=4, umi_trim_r=1), True)


@query(umi_sql(0, 7, 0, 7, True))
def umi_kept_pair(spark, sf):
    return barcodes(spark, sf, Options(umi_r=7), True)


@query(umi_sql(4, 3, 4, 3, False))
def umi_single(spark, sf):
    return barcodes(spark, sf, Options(umi_f=4, umi_r=3), False)


ROUTED = f"""WITH res AS ({RESULTS}) SELECT pair_id, mate, route, header, seq, qual FROM (
  SELECT pair_id, CAST(0 AS INT) AS mate, 'merged' AS route, '@p' || CAST(pair_id AS STRING) AS header, seq, qual FROM res WHERE code = ' ' AND seq <> ''
  UNION ALL SELECT pair_id, 1, CASE WHEN code <> ' ' THEN 'r1_fail' ELSE 'r1' END, '@p' || CAST(pair_id AS STRING) || '/1', s1, q1 FROM res WHERE code <> ' ' OR seq = ''
  UNION ALL SELECT pair_id, 2, CASE WHEN code <> ' ' THEN 'r2_fail' ELSE 'r2' END, '@p' || CAST(pair_id AS STRING) || '/2', s2, q2 FROM res WHERE code <> ' ' OR seq = '')"""


@query(f"SELECT route, count(*) AS n, CAST(sum(length(seq)) AS BIGINT) AS bases FROM ({ROUTED}) GROUP BY route")
def fail_routes(spark, sf):
    df = results(spark, sf).withColumn("name", F.concat(F.lit("p"), F.col("pair_id").cast("string")))
    return R.routed(df, rec="pair_id").groupBy("route").agg(F.count("*").alias("n"), F.sum(F.length("seq").cast("long")).alias("bases"))


@query(f"SELECT CAST(row_number() OVER (ORDER BY pair_id, mate) AS INT) AS place, pair_id, mate, header, seq, qual FROM ({ROUTED})")
def ordered_interleave(spark, sf):
    """All routes as one stream in input order: places within ranges, from the ranges' sizes."""
    df = results(spark, sf).withColumn("name", F.concat(F.lit("p"), F.col("pair_id").cast("string")))
    return numbered(R.routed(df, rec="pair_id"), ["pair_id", "mate"], "place").select(F.col("place").cast("int").alias("place"), "pair_id", "mate", "header", "seq", "qual")


# ---- joins of reads and of alignments


@query(over("SELECT pair_id, s1, s2 FROM p", PAIRS, "p"))
def zip_fastq(spark, sf):
    """Two scans zipped by record number, names asserted equal."""
    df = pairs(spark, sf)
    one = df.select(F.col("pair_id").alias("rec_idx"), F.concat(F.lit("@r"), F.col("pair_id").cast("string"), F.lit("/1")).alias("header"), F.col("s1").alias("seq"), F.col("q1").alias("qual"))
    two = df.select(F.col("pair_id").alias("rec_idx"), F.concat(F.lit("@r"), F.col("pair_id").cast("string"), F.lit("/2 y")).alias("header"), F.col("s2").alias("seq"), F.col("q2").alias("qual"))
    return zip_pairs(one, two).select(F.col("rec_idx").alias("pair_id"), "s1", "s2")


RECORDS = f"""SELECT 2 * pair_id + mate - 1 AS rec_idx, 'p' || CAST(pair_id AS STRING) AS qname, CAST(CASE WHEN mate = 1 THEN 77 ELSE 141 END AS INT) AS flag, CAST(-1 AS INT) AS pos, CAST(0 AS INT) AS mapq, CAST(-1 AS INT) AS mpos, seq, qual, pair_id
  FROM (SELECT pair_id, 1 AS mate, s1 AS seq, q1 AS qual FROM ({PAIRS}) a UNION ALL SELECT pair_id, 2, s2, q2 FROM ({PAIRS}) b) z"""


def records(spark, sf) -> DataFrame:
    df = made(spark, sf, RECORDS)
    group = F.struct(F.lit("Z").alias("type"), F.concat(F.lit("g"), (F.col("pair_id") % 3).cast("string")).alias("value"))
    flag = F.struct(F.lit("i").alias("type"), (F.col("pair_id") % 8).cast("string").alias("value"))
    return df.withColumn("tags", F.when(F.col("pair_id") % 2 == 0, F.create_map(F.lit("RG"), group, F.lit("FF"), flag)).otherwise(F.create_map(F.lit("RG"), group)))


@query(over("SELECT rec_idx, lead(rec_idx) OVER (PARTITION BY qname ORDER BY rec_idx) AS next_idx FROM r", RECORDS, "r"))
def mate_pairing_lead(spark, sf):
    return B.next_in_name(records(spark, sf)).select("rec_idx", "next_idx")


@query(over("SELECT count(*) AS unaligned FROM r WHERE flag & 4 = 4", RECORDS, "r"))
def aligned_guard(spark, sf):
    return B.guard_aligned(records(spark, sf)).agg(F.count(F.when(F.col("flag") >= 0, 1)).alias("unaligned"))


@query(over("SELECT pair_id, length(s1) AS n1, length(s2) AS n2, true AS same_tags FROM p", PAIRS, "p").replace("length(s1) AS n1, length(s2) AS n2", "CAST(length(s1) AS INT) AS n1, CAST(length(s2) AS INT) AS n2"))
def mate_tag_check(spark, sf):
    df = B.pair_mates(records(spark, sf))
    return df.select((F.col("a.rec_idx") / 2).cast("long").alias("pair_id"), F.length("a.seq").alias("n1"), F.length("b.seq").alias("n2"), B.same_tags(F.col("a.tags"), F.col("b.tags")).alias("same_tags"))


BAM_OUT = f"""{O.paired()}, res AS (SELECT pair_id, s1, s2, chimera, sure AND best > 0 AS new, best, CASE WHEN pair_id % 2 = 0 THEN pair_id % 8 ELSE 0 END AS ff FROM pairs JOIN dec ON id = pair_id)"""


@query(
    f"""{BAM_OUT} SELECT 'p' || CAST(pair_id AS STRING) || CASE WHEN new AND sub = 0 THEN '_M' ELSE '' END AS qname, CAST(sub AS INT) AS sub,
      CAST(CASE WHEN sub = 0 THEN 4 + CASE WHEN best < 5 THEN 512 ELSE 0 END ELSE (CASE WHEN sub = 1 THEN 77 ELSE 141 END) + CASE WHEN new THEN 1024 WHEN chimera THEN 512 ELSE 0 END END AS INT) AS flag,
      CAST(CASE WHEN sub = 0 THEN best WHEN sub = 1 THEN length(s1) ELSE length(s2) END AS INT) AS bases,
      CASE WHEN sub = 0 THEN CAST(ff | CASE WHEN best > greatest(length(s1), length(s2)) THEN 2 ELSE 3 END AS STRING) WHEN pair_id % 2 = 0 THEN CAST(ff AS STRING) END AS ff,
      CASE WHEN sub = 0 AND best < 5 THEN 'L' WHEN sub > 0 AND chimera AND NOT new THEN 'D' END AS zq
    FROM res, range(0, 3) t(sub) WHERE new OR sub > 0"""
)
def keep_original(spark, sf):
    out = B.process(records(spark, sf), Options(bam=True, keep_original=True))
    return out.select("qname", "sub", "flag", F.length("seq").alias("bases"), B.tag(F.col("tags"), "FF").alias("ff"), B.tag(F.col("tags"), "ZQ").alias("zq"))


@query(QUERIES["keep_original"][1])
def bam_neighbours(spark, sf):
    """The same from a file, whose mates are put together where they are read."""
    path = f"{scratch(spark)}.bam"
    bam.write_bam(records(spark, sf), path)
    out = B.process_mates(bam.read_mates(spark, path), Options(bam=True, keep_original=True))
    return out.select("qname", "sub", "flag", F.length("seq").alias("bases"), B.tag(F.col("tags"), "FF").alias("ff"), B.tag(F.col("tags"), "ZQ").alias("zq"))


@query(O.tally_sql())
def bam_tally(spark, sf):
    """The tally of a BAM run, whose outcomes come with the records."""
    return R.tally(B.process(records(spark, sf), Options(bam=True)).filter("outcome is not null").select("outcome"))


def single_records(spark, sf) -> DataFrame:
    df = singles(spark, sf).select(F.col("read_id").alias("rec_idx"), F.concat(F.lit("s"), F.col("read_id").cast("string")).alias("qname"), "seq", "qual")
    tags = F.lit(None).cast("map<string,struct<type:string,value:string>>")
    empty = F.coalesce(tags, F.from_json(F.lit("{}"), "map<string,struct<type:string,value:string>>"))
    return df.select("rec_idx", "qname", F.lit(4).alias("flag"), F.lit(-1).alias("pos"), F.lit(0).alias("mapq"), F.lit(-1).alias("mpos"), "seq", "qual", empty.alias("tags"))


BAM_SINGLE = f"WITH t AS ({O.trim_sql()}), r AS ({SINGLE}), x AS (SELECT r.read_id, code, t.seq <> '' AS new, CASE WHEN t.seq <> '' THEN t.seq ELSE r.seq END AS seq FROM t JOIN r ON r.read_id = t.read_id)"


@query(f"{BAM_SINGLE} SELECT 's' || CAST(read_id AS STRING) AS qname, CAST(CASE WHEN code <> ' ' THEN 516 ELSE 4 END AS INT) AS flag, seq, CASE WHEN new THEN '1' END AS ff, CASE WHEN code <> ' ' THEN code END AS zq FROM x")
def bam_single(spark, sf):
    out = B.process(single_records(spark, sf), Options(bam=True))
    return out.select("qname", "flag", "seq", B.tag(F.col("tags"), "FF").alias("ff"), B.tag(F.col("tags"), "ZQ").alias("zq"))


@query(
    f"""{BAM_SINGLE}, y AS (SELECT *, length(seq) > CASE WHEN new THEN 7 ELSE 4 END AS able FROM x)
      SELECT 's' || CAST(read_id AS STRING) AS qname, CAST(4 + CASE WHEN code <> ' ' THEN 512 ELSE 0 END + CASE WHEN able THEN 0 ELSE 1024 END AS INT) AS flag,
        CASE WHEN able THEN substr(seq, 1, 4) || '-' || CASE WHEN new THEN substr(seq, CAST(length(seq) - 2 AS INT), 3) ELSE 'NNN' END END AS rx,
        CASE WHEN able THEN substr(seq, 5, CAST(length(seq) - CASE WHEN new THEN 7 ELSE 4 END AS INT)) ELSE seq END AS seq FROM y"""
)
def bam_barcodes_single(spark, sf):
    out = B.process(single_records(spark, sf), Options(bam=True, umi_f=4, umi_r=3))
    return out.select("qname", "flag", B.tag(F.col("tags"), "RX").alias("rx"), "seq")


#: Ties of bases are settled by the first mate's place in the file.
OF_RECORDS = O.consensus_sql().replace("(id * 7919", "(2 * id * 7919")
BAM_CODED = f"WITH c AS ({OF_RECORDS}), p AS ({PAIRS}), m AS (SELECT p.pair_id, 'p' || CAST(p.pair_id AS STRING) AS qname, c.seq, s1, s2, substr(s1, 1, 4) || '-' || reverse(translate(substr(s2, 1, 3), 'ACGTN', 'TGCAN')) AS rx FROM p LEFT JOIN c ON c.pair_id = p.pair_id)"


@query(
    f"""{BAM_CODED} SELECT qname, CAST(0 AS INT) AS sub, length(seq) <= 7 AS duplicate, CASE WHEN length(seq) > 7 THEN substr(seq, 1, 4) || '-' || substr(seq, CAST(length(seq) - 2 AS INT), 3) END AS rx,
      CASE WHEN length(seq) > 7 THEN substr(seq, 5, CAST(length(seq) - 7 AS INT)) ELSE seq END AS seq FROM m WHERE seq IS NOT NULL
    UNION ALL SELECT qname, 1, false, rx, substr(s1, 5) FROM m WHERE seq IS NULL UNION ALL SELECT qname, 2, false, rx, substr(s2, 4) FROM m WHERE seq IS NULL"""
)
def bam_barcodes_pair(spark, sf):
    out = B.process(records(spark, sf), Options(bam=True, umi_f=4, umi_r=3))
    return out.select("qname", "sub", B.has(B.DUPLICATE).alias("duplicate"), B.tag(F.col("tags"), "RX").alias("rx"), "seq")


# ---- files


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share; a temporary one will do where they are threads of a local session."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        local = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master)
        found = f"file://{tempfile.mkdtemp(prefix='strandline-')}" if local else spark.conf.get("spark.sql.warehouse.dir")
    return f"{found.rstrip('/')}/strandline-{uuid.uuid4().hex}"


@query(over("SELECT qname, flag, seq, qual FROM r", RECORDS, "r"))
def bam_round_trip(spark, sf):
    """Written as one BAM file and read in splits."""
    path = f"{scratch(spark)}.bam"
    bam.write_bam(records(spark, sf), path)
    return bam.read_bam(spark, path).select("qname", "flag", "seq", "qual")


def written(df: DataFrame, path: str, mate: int) -> str:
    text = F.concat(F.lit("@p"), F.col("pair_id").cast("string"), F.lit(f"/{mate} x"), *[x for c in (f"s{mate}", f"q{mate}") for x in (F.lit("\n" if c[0] == "s" else "\n+\n"), F.col(c))])
    df.repartitionByRange("pair_id").sortWithinPartitions("pair_id").select(text).write.option("compression", "gzip").text(path)
    return path


@query(over("SELECT '@p' || CAST(pair_id AS STRING) AS name, s1, q1, s2, q2 FROM p", PAIRS, "p"))
def fastq_round_trip(spark, sf):
    """Pairs written as two folders of compressed FASTQ and read together."""
    df, path = pairs(spark, sf), scratch(spark)
    both = fastq.read_paired(spark, written(df, f"{path}-1", 1), written(df, f"{path}-2", 2))
    return both.select(F.concat(F.lit("@"), F.regexp_replace("name", "^@", "")).alias("name"), "s1", "q1", "s2", "q2")


#: Ties of bases are settled by the pair's number in the file.
OF_FILE = O.consensus_sql().replace("(id * 7919", "((id - (SELECT min(pair_id) FROM pairs)) * 7919").rpartition("SELECT id AS pair_id")
ROUTES = f"""{OF_FILE[0]}, merged AS (SELECT id AS pair_id{OF_FILE[2]}), d AS (SELECT id, chimera, sure AND best > 0 AS new FROM dec)
  SELECT 'merged' AS route, '@p' || CAST(pair_id AS STRING) AS header, seq, qual FROM merged
  UNION ALL SELECT CASE WHEN chimera THEN 'r1_fail' ELSE 'r1' END, '@p' || CAST(pair_id AS STRING) || '/1', s1, q1 FROM d JOIN pairs ON pair_id = id WHERE NOT new
  UNION ALL SELECT CASE WHEN chimera THEN 'r2_fail' ELSE 'r2' END, '@p' || CAST(pair_id AS STRING) || '/2', s2, q2 FROM d JOIN pairs ON pair_id = id WHERE NOT new"""


def routes_back(spark, paths: dict[str, str]) -> DataFrame:
    out = None
    for route, file in paths.items():
        part = fastq.read_fastq(spark, file, numbered=False).select(F.lit(route).alias("route"), "header", "seq", "qual")
        out = part if out is None else out.unionByName(part)
    return out


@query(ROUTES)
def fastq_run(spark, sf):
    """A whole run from files to the six routes, which are read again."""
    df, path = pairs(spark, sf), scratch(spark)
    run_fastq(spark, Options(), written(df, f"{path}-1", 1), written(df, f"{path}-2", 2), out=f"{path}-out")
    return routes_back(spark, fastq.prefix_paths(f"{path}-out"))


def block_file(df: DataFrame, path: str, key: str, seq: str, qual: str) -> str:
    """One block-compressed FASTQ file of the rows by key."""
    rows = df.select(F.col(key).alias("rec_idx"), F.lit(0).alias("mate"), F.lit("all").alias("route"), F.concat(F.lit("@s"), F.col(key).cast("string")).alias("header"), F.col(seq).alias("seq"), F.col(qual).alias("qual"))
    fastq.write_interleaved(rows, path, single=True)
    return path


@query(over("SELECT CAST(row_number() OVER (ORDER BY read_id) - 1 AS BIGINT) AS rec_idx, '@s' || CAST(read_id AS STRING) AS header, seq, qual FROM reads"))
def block_fastq(spark, sf):
    """Reads written as one block-compressed file, which is read in ranges and numbered."""
    return fastq.read_fastq(spark, block_file(singles(spark, sf), f"{scratch(spark)}.fq.gz", "read_id", "seq", "qual"))


SINGLE_RUN = f"""WITH t AS ({O.trim_sql()}), r AS ({SINGLE})
  SELECT CASE WHEN code = ' ' THEN 'merged' ELSE 'fail' END AS route, '@s' || CAST(r.read_id AS STRING) AS header,
         CASE WHEN code = ' ' AND t.seq <> '' THEN t.seq ELSE r.seq END AS seq, CASE WHEN code = ' ' AND t.seq <> '' THEN t.qual ELSE r.qual END AS qual
  FROM t JOIN r ON r.read_id = t.read_id"""


@query(SINGLE_RUN)
def fastq_single_run(spark, sf):
    """Single reads from one file to outputs by name, as one file each."""
    path = scratch(spark)
    out = {r: f"{path}-{r}.fq.gz" for r in R.ROUTES_SINGLE}
    run_fastq(spark, Options(), block_file(singles(spark, sf), f"{path}.fq.gz", "read_id", "seq", "qual"), out=out, single=True)
    return routes_back(spark, out)


@query(f"SELECT unnest(['Total reads :', 'kept', 'trimmed', 'chimera']) AS name, unnest([count(*), count(*) FILTER (code = ' ' AND seq = ''), count(*) FILTER (code = ' ' AND seq <> ''), count(*) FILTER (code = 'D')]) AS n FROM ({O.trim_sql()})")
def run_log(spark, sf):
    """The log of a run, as it was written."""
    path = scratch(spark)
    run_fastq(spark, Options(), block_file(singles(spark, sf), f"{path}.fq.gz", "read_id", "seq", "qual"), interleaved=f"{path}-all", log=f"{path}.log")
    fields = F.split("value", "\t")
    lines = spark.read.text(f"{path}.log").select(fields[0].alias("name"), fields[1].cast("long").alias("n"))
    return lines.filter(F.col("name").isin("Total reads :", "kept", "trimmed", "chimera"))


#: Four pairs for each order: more than the first records that inference looks at.
FOURFOLD = "SELECT o_orderkey * 4 + copy AS pair_id, translate(md5('h' || CAST(o_orderkey * 4 + copy AS STRING)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS s1 FROM (SELECT o_orderkey, unnest([0, 1, 2, 3]) AS copy FROM orders) o"


@query(f"SELECT '@s' || CAST(pair_id AS STRING) AS header, s1 AS seq FROM ({FOURFOLD}) h ORDER BY pair_id LIMIT {I.FIRST}")
def fastq_head(spark, sf):
    """The first records of a file, of which only the ranges are read that hold them."""
    df = dealt(table(spark, sf, "orders").select("o_orderkey")).select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("copy")).select((F.col("o_orderkey") * 4 + F.col("copy")).alias("pair_id"))
    df = df.withColumn("s1", F.translate(F.md5(F.concat(F.lit("h"), F.col("pair_id").cast("string"))), "0123456789abcdef", "ACGTACGTACGTACGT")).withColumn("q1", F.repeat(F.lit("I"), F.lit(32)))
    path = block_file(df, f"{scratch(spark)}.fq.gz", "pair_id", "s1", "q1")
    return fastq.read_fastq(spark, path, first=I.FIRST).select("header", "seq")


@query(over(f"SELECT read_id, failed, CASE WHEN failed THEN seq WHEN e <= 1 THEN substr(seq, 7) ELSE substr(seq, 6) END AS keyless, seq AS keyed FROM (SELECT *, NOT (e <= 1 OR substr(seq, 1, 5) = '{KEY[1:]}') AS failed FROM (SELECT *, {O.edits('substr(seq, 1, 6)', repr(KEY))} AS e FROM reads))", KEYED))
def trim_key_reads(spark, sf):
    """Reads with keys that nothing else happens to: written without their key, or with it."""
    df = made(spark, sf, KEYED).select("read_id", F.col("seq").alias("s1"), F.col("qual").alias("q1"))
    of = lambda trim: Options(keys=KEY, allow_missing=True, trim_key=trim, trim_cutoff=1000, chimeras="A" * 31)
    one = run_reads(df, of(True), False).select("read_id", (F.col("result.code") == "K").alias("failed"), F.col("result.s1").alias("keyless"))
    two = run_reads(df, of(False), False).select("read_id", F.col("result.s1").alias("keyed"))
    return one.join(two, "read_id")


# ---- inference


@query(f"{O.INFER} SELECT pair_id, CAST(best AS INT) AS best, accepted FROM acc")
def infer_candidates(spark, sf):
    return I.candidates(made(spark, sf, CLEAR_PAIRS), Options()).select("pair_id", "c.best", "accepted")


@query(O.INFER_CONSENSUS)
def infer_consensus(spark, sf):
    return I.consensus(I.overhangs(I.candidates(made(spark, sf, CLEAR_PAIRS), Options())), Options())


@query(
    f"""WITH b AS ({O.INFER_CONSENSUS}), s AS (SELECT side, i AS position FROM (VALUES ('F'), ('S')) t(side), range(0, 31) r(i)),
      a AS (SELECT s.side, string_agg(coalesce(base, 'I'), '' ORDER BY s.position) AS adapter FROM s LEFT JOIN b ON b.side = s.side AND b.position = s.position GROUP BY s.side)
      SELECT max(adapter) FILTER (side = 'F') AS forward, max(adapter) FILTER (side = 'S') AS reverse FROM a"""
)
def infer_adapters(spark, sf):
    """From the mates among the first records of a BAM file."""
    df = made(spark, sf, CLEAR_PAIRS)
    mate = lambda n, flag: F.struct((2 * F.col("pair_id") + n - 1).alias("rec_idx"), F.lit(flag).alias("flag"), F.col(f"s{n}").alias("seq"), F.col(f"q{n}").alias("qual"))
    rows = df.select(F.col("pair_id").cast("string").alias("qname"), F.explode(F.array(mate(1, 77), mate(2, 141))).alias("m")).select("qname", "m.*")
    found = I.infer_adapters(I.first_pairs(rows), Options(auto=True, bam=True))
    return spark.createDataFrame([found.adapters], "forward string, reverse string")


def queries() -> dict[str, Callable]:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
