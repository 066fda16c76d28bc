"""The registered queries of this subpackage: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audit, decontam, dialogue, exact, lm, mixing, pages, rollups, simhash, surrogates, toxicity, url_rules
from .util import cut, shared_dir

URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def surrogate_key(spark: SparkSession) -> bytes:
    """The secret from the session's settings; the synthetic tables make do with one that is none, and say so."""
    found = spark.conf.get("spark.strandline.surrogateKey", None)
    if found is None:
        warnings.warn("spark.strandline.surrogateKey is not set: surrogates follow from a public key, fit for synthetic tables only", stacklevel=2)
    return (found or "synthetic tables only").encode()


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.report(decontam.find_hits(docs, table(spark, sf_dir, "benchmark")))


def roll_up(spark: SparkSession, sf_dir: str, versions: tuple[str, ...]) -> DataFrame:
    """Totals after three batches a tokenizer version, each committed twice: all documents inserted; those that a label calls toxic
    revised, into the language "toxic" and to twice their tokens; those that a label calls poor deleted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    labels = table(spark, sf_dir, "labels")
    rollup = rollups.Rollup(spark, f"{shared_dir(spark)}/strandline/rollup-{uuid.uuid4().hex}")
    for version in versions:
        counted = cut(rollups.count_tokens(docs, version).drop("text").withColumn("tokenizer_version", F.lit(version)), "counted")
        toxic = counted.join(labels.filter("toxic = 1"), "doc_id", "left_semi")
        poor = counted.join(labels.filter("quality = 0"), "doc_id", "left_semi")
        for op, batch in (
            ("insert", counted),
            ("revise", toxic.withColumns({"lang": F.lit("toxic"), "n_tokens": 2 * F.col("n_tokens")})),
            ("delete", poor),
        ):
            for _ in range(2):
                rollup.commit(f"{op}-{version}", batch.withColumn("op", F.lit(op)))
    return rollup.totals()


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under a byte-level vocabulary and by words."""
    return roll_up(spark, sf_dir, ("byte_bpe_50k", rollups.WORDS_VERSION))


def rollup_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by words alone, which SQL can count too."""
    return roll_up(spark, sf_dir, (rollups.WORDS_VERSION,))


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = surrogates.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), surrogate_key(spark))
    return docs.select("doc_id", "text", F.size("pii_kinds").alias("n_entities"), F.array_join("pii_kinds", ",").alias("kinds"))


def op7_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_all(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix owes each document's source, which SQL can tell too; the draws it cannot."""
    sizes = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count("text").alias("size"))
    due = mixing.targets(sizes).withColumnRenamed("source", "of")
    return sizes.join(F.broadcast(due) if due.count() <= mixing.FEW_SOURCES else due, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(urls, url_rules.rules_frame(spark, URL_RULES)).drop("url")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.add_score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return audit.interactions(docs, table(spark, sf_dir, "labels"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.mark(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair(dialogue.damaged(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_main_text": op1_main_text,
        "op2_simhash": op2_simhash,
        "op3_nearest": op3_nearest,
        "op4_decontamination": op4_decontamination,
        "op5_token_counts": op5_token_counts,
        "rollup_of_words": rollup_of_words,
        "op6_surrogates": op6_surrogates,
        "op7_deleted_interpolation": op7_deleted_interpolation,
        "op8_cube_mix": op8_cube_mix,
        "mix_targets": mix_targets,
        "op9_url_rules": op9_url_rules,
        "op10_toxicity": op10_toxicity,
        "op11_filter_audit": op11_filter_audit,
        "op12_exact_dedup": op12_exact_dedup,
        "op13_conversation_repair": op13_conversation_repair,
    }
