"""Molecular barcodes cut from the ends of fragments and reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Options
from ..functions.sequence import reverse_complement


def tags(fs, fq, rs, rq, o: Options) -> tuple[Column, Column]:
    """RX and QX: forward and reverse, by a hyphen and by a space."""
    if o.umi_f and o.umi_r:
        return F.concat(fs, F.lit("-"), rs), F.concat(fq, F.lit(" "), rq)
    return (fs, fq) if o.umi_f else (rs, rq)


def unknown(n: int, c: str) -> Column:
    return F.lit(c * n)


def head(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def tail(c: Column, n: int) -> Column:
    return F.substring(c, F.greatest(F.length(c) - n + 1, F.lit(1)), F.lit(n))


def without(c: Column, first: int, last: int) -> Column:
    return F.substring(c, F.lit(first + 1), F.greatest(F.length(c) - first - last, F.lit(0)))


def extract(df: DataFrame, o: Options, result: str = "result", paired: bool = True) -> DataFrame:
    """The result struct with barcodes cut, and ``rx``, ``qx`` (null without barcodes).

    A new sequence shorter than all that is to be cut fails with U; so does a kept read that is too short (if it had not failed
    before).  Kept pairs, failed ones too, give the forward barcode from the start of read 1 and the reverse one, turned, from
    the start of read 2; from read 2 the bases are cut at its end, or at its start if ``umi_kept_reverse_from_start``.
    """
    if not o.umi:
        return df.withColumns({"rx": F.lit(None).cast("string"), "qx": F.lit(None).cast("string")})
    f, r, cf, cr = o.umi_f, o.umi_r, o.umi_f + o.umi_trim_f, o.umi_r + o.umi_trim_r
    get = lambda n: F.col(f"{result}.{n}")
    seq, qual, code = get("seq"), get("qual"), get("code")
    new = F.length(seq) > 0
    short = new & (F.length(seq) < cf + cr)
    s1, q1, s2, q2 = (get(n) for n in ("s1", "q1", "s2", "q2"))
    short_kept = ~new & ((F.length(s1) < cf) | ((F.length(s2) < cr) if paired else F.lit(False)))
    nx, ny = tags(unknown(f, "N"), unknown(f, "!"), unknown(r, "N"), unknown(r, "!"), o)
    mx, my = tags(head(seq, f), head(qual, f), tail(seq, r), tail(qual, r), o)
    if paired:
        kx, ky = tags(head(s1, f), head(q1, f), reverse_complement(head(s2, r)), F.reverse(head(q2, r)), o)
    else:
        kx, ky = tags(head(s1, f), head(q1, f), unknown(r, "N"), unknown(r, "!"), o)
    kept = ~new & ~short_kept
    pick = lambda m, k: F.when(short | short_kept, nx if m is mx else ny).when(new, m).otherwise(k)
    whole = new & ~short
    at_start = o.umi_kept_reverse_from_start
    fields = {
        "code": F.when((short | short_kept) & (code == " "), F.lit("U")).otherwise(code),
        "seq": F.when(whole, without(seq, cf, cr)).otherwise(seq),
        "qual": F.when(whole, without(qual, cf, cr)).otherwise(qual),
        "cut": get("cut"),
        "s1": F.when(kept, without(s1, cf, 0)).otherwise(s1),
        "q1": F.when(kept, without(q1, cf, 0)).otherwise(q1),
        "s2": F.when(kept & F.lit(paired), without(s2, cr if at_start else 0, 0 if at_start else cr)).otherwise(s2),
        "q2": F.when(kept & F.lit(paired), without(q2, cr if at_start else 0, 0 if at_start else cr)).otherwise(q2),
    }
    return df.withColumns({"rx": pick(mx, kx), "qx": pick(my, ky), result: F.struct(*[v.alias(k) for k, v in fields.items()])})
