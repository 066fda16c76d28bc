"""The same trimming and merging over streams: every read stands for itself, so no state is kept but for the tally."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import Options
from ..operators import tally as R
from ..operators import trim as T
from ..operators import umi as U


def trim_stream(reads: DataFrame, o: Options, paired: bool) -> DataFrame:
    """A stream of rec_idx, name, s1, q1 (and s2, q2) with result, rx and qx; append mode."""
    if o.auto:
        raise ValueError("adapters are inferred over a table, not over a stream")
    out = T.merge_pairs(reads, o) if paired else T.trim_single(reads, o)
    return U.extract(out, o, paired=paired)


def tally_stream(trimmed: DataFrame, o: Options, paired: bool) -> DataFrame:
    """The running tally; complete mode."""
    return R.tally(trimmed.select(R.outcome(o, paired=paired).alias("outcome")))
