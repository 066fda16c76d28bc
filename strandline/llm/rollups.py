"""Token counts kept as delta-maintained rollups.

A batch is a table of changes: ``op`` (insert, delete or revise), doc_id, source, lang, tokenizer_version, n_tokens.  A commit
turns it into signed rows: an insert adds a document and its tokens, a delete takes away what the ledger holds for the
document and version, a revise does both.  The rows go to ``<root>/ledger``, their sums by source, language and version to
``<root>/deltas``, each under the batch's id; the marker in ``<root>/commits``, written last, makes the batch count.  Totals are
the sums of committed deltas, so they are additive and never need the documents again.

A commit sums of the ledger only the rows of documents that it changes (a semi-join before any sum); to find them it scans the
ledger's ids, snapshot included, as the files are plain Parquet.  After every ``COMPACT``
commits the ledger and the deltas are compacted into a snapshot, which stands for the batches named in its marker, so neither
the number of files nor the rows read follow the number of commits.

* A batch id commits once: repeating a commit changes nothing, and a commit that was cut off is written anew in full.
* Within a batch the changes of a document and version are one: if any is a delete, it goes; else the revised, or inserted,
  row of the most tokens stands (rows that repeat change nothing).  Inserting what is there, or revising what is not, sets the
  count; deleting what is not there does nothing.
* A null source or language is a group of its own; rows without a doc_id, an op or a count (where one is needed) are not
  changes.  Totals of groups without documents are left out.  Null and empty texts have no tokens and count as documents; very
  long ones are counted whole.  An empty batch commits and changes nothing.  Extra columns, whatever their names, pass through
  the counting and are not looked at by commits; a column named like the count is replaced.
* Commits to one root come one at a time.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import session, small_batches

KEYS = ["source", "lang", "tokenizer_version"]
LEDGER = "doc_id long, source string, lang string, tokenizer_version string, docs long, tokens long"
DELTAS = "source string, lang string, tokenizer_version string, docs long, tokens long"
TOKENIZERS = "/opt/tokenizers"
COMPACT = 16
WORDS_VERSION = "words-1"
#: The pre-tokeniser's pattern of the byte-level vocabularies; fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

LOADED: dict = {}


def load(name: str, ranks: bytes):
    if name not in LOADED:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        LOADED[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return LOADED[name]


def count_tokens(docs: DataFrame, version: str = "byte_bpe_50k", folder: str = TOKENIZERS, text: str = "text", to: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of the whole text; a null text has none.

    The vocabulary file ``<folder>/<version>.tiktoken``, under a megabyte, is read where the query is made and broadcast.
    """
    if version == WORDS_VERSION:
        return docs.withColumn(to, F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long"))
    spark = session(docs)
    small_batches(spark)
    with open(f"{folder}/{version}.tiktoken", "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        encoder = load(version, sent.value)
        return pa.array([len(encoder.encode_ordinary(t)) if t else 0 for t in texts.to_pylist()], pa.int64())

    return docs.withColumn(to, count(F.col(text)))


class Rollup:
    """Totals under a root folder that all executors can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, kind: str) -> list[str]:
        at = self.path(f"{self.root}/{kind}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def committed(self) -> list[str]:
        return self.names("commits")

    def snapshot(self) -> tuple[str | None, set[str]]:
        """The latest snapshot and the batches that it stands for."""
        last = max(self.names("snapshots"), default=None)
        if last is None:
            return None, set()
        return last, {r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{self.root}/compact/{last}/batches").collect()}

    def read(self, kind: str, schema: str) -> DataFrame:
        last, covered = self.snapshot()
        paths = [f"{self.root}/{kind}/{b}" for b in self.committed() if b not in covered]
        paths += [f"{self.root}/compact/{last}/{kind}"] if last else []
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def mark(self, kind: str, name: str) -> None:
        """What makes a batch or a snapshot count."""
        self.fs.mkdirs(self.path(f"{self.root}/{kind}"))
        self.fs.create(self.path(f"{self.root}/{kind}/{name}"), False).close()

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """True if the batch was committed now, False if it had been before."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch) or batch.startswith((".", "_")):
            raise ValueError("a batch id has letters, digits, and ._- only, and starts with a letter or digit")
        if batch in self.committed():
            return False
        self.signed(changes).write.mode("overwrite").parquet(f"{self.root}/ledger/{batch}")
        written = self.spark.read.schema(LEDGER).parquet(f"{self.root}/ledger/{batch}")
        self.sums(written).write.mode("overwrite").parquet(f"{self.root}/deltas/{batch}")
        self.mark("commits", batch)
        if len(self.committed()) - len(self.snapshot()[1]) >= COMPACT:
            self.compact()
        return True

    @staticmethod
    def sums(rows: DataFrame, *more: str) -> DataFrame:
        out = rows.groupBy(*more, *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return out.filter("docs <> 0 or tokens <> 0")

    def compact(self) -> None:
        """One table of what the ledger holds and one of the sums, in place of all committed batches."""
        batches = self.committed()
        name = f"{len(batches):012d}"
        at = f"{self.root}/compact/{name}"
        self.sums(self.read("ledger", LEDGER), "doc_id").write.mode("overwrite").parquet(f"{at}/ledger")
        self.sums(self.read("deltas", DELTAS)).write.mode("overwrite").parquet(f"{at}/deltas")
        self.spark.createDataFrame([(b,) for b in batches], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{at}/batches")
        self.mark("snapshots", name)

    def signed(self, changes: DataFrame) -> DataFrame:
        changes = changes.filter("doc_id is not null and (op = 'delete' or op in ('insert', 'revise') and n_tokens is not null)")
        order: Column = F.struct((F.col("op") == "delete").alias("a"), (F.col("op") == "revise").alias("b"), "n_tokens", "source", "lang")
        state = changes.groupBy("doc_id", "tokenizer_version").agg(F.max(order).alias("c"))
        new = state.filter("not c.a").select("doc_id", "c.source", "c.lang", "tokenizer_version", F.lit(1).cast("long").alias("docs"), F.col("c.n_tokens").cast("long").alias("tokens"))
        if not self.committed():
            return new
        keys = state.select(F.col("doc_id").alias("_d"), F.col("tokenizer_version").alias("_v"))
        held = self.read("ledger", LEDGER).join(keys, (F.col("doc_id") == F.col("_d")) & F.col("tokenizer_version").eqNullSafe(F.col("_v")), "left_semi")
        old = held.select("doc_id", *KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))
        return self.sums(old.unionByName(new), "doc_id")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens."""
        return self.sums(self.read("deltas", DELTAS)).withColumnsRenamed({"docs": "n_docs", "tokens": "n_tokens"})
