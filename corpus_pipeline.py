"""A training-corpus pipeline over ``documents``.

Each stage takes whatever columns its predecessor wrote, passes on those that it does not decide on, and works on whole texts of
any length.  An empty table passes through all stages.  Extra columns may have any names but ``copy``, which the mix replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontam, mixing, simhash, surrogates, toxicity
from strandline.llm.queries import surrogate_key
from strandline.llm.util import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents that are not held out; documents that score at the threshold or above go.

    Null and empty texts have the score of the model's bias, and stay unless that is at the threshold.  Rows without a doc_id are scored
    and do not train; rows that repeat one train once and are each judged; equal texts are judged alike.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (Jaccard similarity of 0.8 or more on five-word shingles) stays, that of the
    least doc_id; ties go to the least text hash, and repeated rows become one.

    Null texts and texts without words are one group.  A document without a doc_id stays only where no other of its group has one.
    """
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts hold none.  Repeated rows are judged alike."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to surrogates; n_chars follows the text.  Null texts stay null, with a null n_chars; repeated rows are
    rewritten alike."""
    out = surrogates.pseudonymise(docs, surrogate_key(spark), kinds=None)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, counted by ``copy`` from 1.

    Null and empty texts have size 0; a null source is a source.  Rows that repeat a doc_id and source are taken alike, those without
    a doc_id by text.
    """
    return mixing.sample(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
