"""What the operators of this subpackage share: the shared folder, lineage cuts, row keys and word splitting."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BATCH_BYTES = 1 << 20
HOT = 1000


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.  Where that is unset, a local session makes do with a
    temporary folder; on a cluster, where executors don't share one, it is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='strandline-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write as Parquet to the shared folder and read back: computed once, without lineage, safe from lost executors.

    The files lie under ``strandline/`` in the shared folder and can go when the job has ended.
    """
    spark = session(df)
    path = f"{shared_dir(spark)}/strandline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


stored = cut


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a cut that nothing needs any more."""
    path = session(df).sparkContext._jvm.org.apache.hadoop.fs.Path(df.cut_path)
    path.getFileSystem(session(df).sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def join_hot(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows joined with the one row of table for their key; both are stored tables.

    Keys that hold over a thousandth of the rows, of which there are at most a thousand, are broadcast; only the others'
    rows are shuffled, so no task gets a hot key.
    """
    most = rows.count() / HOT
    hot = rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > F.lit(max(most, 1.0))).select(key)
    hot = cut(table.join(F.broadcast(hot), key), "hot")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(table, key))


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Whole texts go to Python: bound the Arrow batches by bytes, so that very long ones fit in memory.  Rows that are short fill
    batches as before, so nothing else that runs in the session becomes slower."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB"))
    if now > most:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that do not clash with those of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def byte_table(keep: bytes) -> bytes:
    """For bytes.translate: A-Z to a-z, every ASCII byte outside keep to a space, bytes from 0x80 stay."""
    out = bytearray(range(256))
    for b in range(128):
        low = b + 32 if 65 <= b <= 90 else b
        out[b] = low if low in keep else 32
    return bytes(out)


ALNUM = byte_table(b"0123456789" + LOWER.encode())


def encode_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """ASCII-white-space words of each text: offsets per text, codes into the distinct words, the distinct words."""
    parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts.cast(pa.large_string())))
    if isinstance(parts, pa.ChunkedArray):
        parts = parts.combine_chunks()
    offsets = np.asarray(parts.offsets, dtype=np.int64)
    flat = parts.values.slice(offsets[0], offsets[-1] - offsets[0]) if len(offsets) else parts.values
    offsets = offsets - offsets[0]
    coded = flat.dictionary_encode()
    codes = np.asarray(coded.indices, dtype=np.int64)
    words = coded.dictionary
    lens = np.asarray(pc.binary_length(words), dtype=np.int64)
    empty = np.flatnonzero(lens == 0)
    if len(empty):  # the only word of an empty text
        keep = codes != empty[0]
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
        codes = codes - (codes > empty[0])
        words = words.filter(pa.array(lens > 0))
    return offsets, codes, words


def strings(array: pa.Array) -> pa.Array:
    """Nulls as empty strings."""
    return pc.fill_null(array, "")
