"""DuckDB SQL, written from the formulas alone, for the queries of the catalogue."""

from __future__ import annotations

import math

from ..config import CHIMERAS, FORWARD, REVERSE, padded
from .synthetic import CLEAR_PAIRS, PAIRS, SINGLE

LAM = repr(math.log10(0.25))
REVERSE_FULL = padded(REVERSE)
LIMIT = repr(math.log10(1 / 20))


def e(q: str) -> str:
    return f"pow(10.0, -greatest({q}, 2) / 10.0)"


def match(q: str) -> str:
    return f"log10(1 - {e(q)})"


def mismatch(q: str) -> str:
    return f"log10({e(q)} / 3)"


def density(x: str, loc: float, scale: float) -> str:
    v = f"greatest({x}, 1)"
    return f"(-pow(ln({v}) - {loc}, 2) / (2 * {scale} * {scale}) / ln(10) - log10({scale} * sqrt(2 * pi()) * {v}))"


def survival_table(loc: float, scale: float, most: int = 140) -> str:
    rows = ", ".join(f"({x}, {math.log10(0.5 * math.erfc((math.log(max(x, 1)) - loc) / (scale * math.sqrt(2))))!r})" for x in range(most))
    return f"surv(sx, sv) AS (VALUES {rows})"


def bases(table: str, name: str, key: str, seq: str, qual: str) -> str:
    return f"""{name} AS (SELECT {key} AS id, i, substr({seq}, CAST(i + 1 AS INT), 1) AS b, ascii(substr({qual}, CAST(i + 1 AS INT), 1)) - 33 AS q
      FROM {table}, range(0, 130) t(i) WHERE i < length({seq}))"""


def adapter_sums(name: str, frame: str, base: str, n: str, adapter: str, xs: str) -> str:
    """id, x, ll, hits of A(x)."""
    score = f"CASE WHEN {base}.b = a.ab OR a.ab = 'I' THEN {match(base + '.q')} ELSE {mismatch(base + '.q')} END"
    hit = f"CASE WHEN {base}.b = a.ab OR a.ab = 'I' THEN 1 ELSE 0 END"
    return f"""{name}_a AS (SELECT i AS j, substr('{adapter}', CAST(i + 1 AS INT), 1) AS ab FROM range(0, {min(30, len(adapter))}) t(i)),
    {name}_s AS (SELECT c.id, c.x, any_value(c.{n}) AS n, count(*) AS m, sum({score}) AS full_s, sum({score}) FILTER (a.j < 10) AS s10,
        sum({hit}) AS h, sum({hit}) FILTER (a.j < 10) AS h10, floor(sum(greatest({base}.q, 0)) FILTER (a.j < 10) / 10.0) AS qb
      FROM {xs} c JOIN {name}_a a ON c.x + a.j < c.{n} JOIN {base} ON {base}.id = c.id AND {base}.i = c.x + a.j GROUP BY c.id, c.x),
    {name} AS (SELECT id, x,
        CASE WHEN m >= 10 AND s10 - 10 * {LAM} < -8 THEN s10 + (m - 10) * (0.75 * {mismatch("qb")} + 0.25 * {match("qb")}) ELSE full_s END + {LAM} * greatest(0, n - x - m) AS ll,
        CASE WHEN m >= 10 AND s10 - 10 * {LAM} < -8 THEN h10 ELSE h END AS hits FROM {name}_s)"""


def top_two(candidates: str, status: str) -> str:
    """id, best, second, best_ll, second_ll, hits out of id, x, ll, hits and id, ll0."""
    return f"""al AS (SELECT id, x, ll, hits FROM {candidates} UNION ALL SELECT id, -1, ll0, 0 FROM {status}),
    rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ll DESC, x) AS r FROM al),
    top AS (SELECT id, max(x) FILTER (r = 1) AS best, max(ll) FILTER (r = 1) AS best_ll, max(x) FILTER (r = 2) AS second,
        max(ll) FILTER (r = 2) AS second_ll, max(hits) FILTER (r = 1) AS hits FROM rk WHERE r <= 2 GROUP BY id)"""


def single(prior: tuple[float, float] | None = None, cutoff: int = 1, source: str = SINGLE) -> str:
    p = f" + {density('c.x', *prior)}" if prior else ""
    s = f" + (SELECT sv FROM surv WHERE sx = greatest(length(seq) - {cutoff}, 0))" if prior else ""
    return f"""WITH reads AS ({source}), {survival_table(*prior) + "," if prior else ""}
    {bases("reads", "bs", "read_id", "seq", "qual")},
    xs AS (SELECT read_id AS id, length(seq) AS n, x FROM reads, range(0, 130) t(x) WHERE x < length(seq) - {cutoff}),
    {adapter_sums("ad", "reads", "bs", "n", padded(FORWARD), "xs")},
    cand AS (SELECT c.id, c.x, ad.ll + c.x * {LAM}{p} AS ll, ad.hits FROM xs c JOIN ad ON ad.id = c.id AND ad.x = c.x),
    quo AS (SELECT read_id AS id, length(seq) * {LAM}{s} AS ll0 FROM reads),
    {top_two("cand", "quo")}"""


def chimeras(seq_table: str, key: str, base: str, length: str) -> str:
    found = [padded(c) for c in [*CHIMERAS.split(","), FORWARD]]
    rows = ", ".join(f"('{c}')" for c in found)
    score = f"CASE WHEN {base}.b = substr(c.c, CAST({base}.i + s.s + 1 AS INT), 1) OR substr(c.c, CAST({base}.i + s.s + 1 AS INT), 1) = 'I' THEN {match(base + '.q')} ELSE {mismatch(base + '.q')} END"
    return f"""chim(c) AS (VALUES {rows}),
    bad AS (SELECT DISTINCT id FROM (SELECT {base}.id, c.c, s.s, sum({score}) AS ll, count(*) AS m
        FROM {base}, chim c, range(0, 2) s(s) WHERE {base}.i < length(c.c) - s.s GROUP BY {base}.id, c.c, s.s) WHERE ll > m * {LAM})"""


def paired(partial: bool = False, prior: tuple[float, float] | None = None) -> str:
    least = 1 if prior else 10
    partial = partial or bool(prior)
    end = f"least(2 * greatest(length(s1), length(s2)) - {least}, length(s1) + length(s2) + 1" + ("" if partial else ", greatest(length(s1), length(s2)) + 1") + ")"
    p = f" + {density('c.x', *prior)}" if prior else ""
    s = f" + (SELECT sv FROM surv WHERE sx = 2 * greatest(length(s1), length(s2)) - {least})" if prior else ""
    a, b = e("one.q"), e("two.q")
    score = f"""CASE WHEN one.b = two.b THEN log10((1 - {a}) * (1 - {b}) + 3 * ({a} / 3) * ({b} / 3))
        ELSE log10((1 - {a}) * ({b} / 3) + ({a} / 3) * (1 - {b}) + 2 * ({a} / 3) * ({b} / 3)) END"""
    return f"""WITH pairs AS ({PAIRS}), {survival_table(*prior) + "," if prior else ""}
    turned AS (SELECT *, reverse(translate(s2, 'ACGTN', 'TGCAN')) AS r2, reverse(q2) AS rq2 FROM pairs),
    {bases("pairs", "one", "pair_id", "s1", "q1")}, {bases("pairs", "mate", "pair_id", "s2", "q2")}, {bases("turned", "two", "pair_id", "r2", "rq2")},
    xs AS (SELECT pair_id AS id, length(s1) AS n1, length(s2) AS n2, x FROM pairs, range(0, 130) t(x) WHERE x < {end}),
    {adapter_sums("f", "pairs", "one", "n1", padded(FORWARD), "xs")}, {adapter_sums("r", "pairs", "mate", "n2", REVERSE_FULL, "xs")},
    ov AS (SELECT c.id, c.x, sum({score}) AS ll, sum(CASE WHEN one.b = two.b THEN 1 ELSE 0 END) AS hits
      FROM xs c JOIN one ON one.id = c.id JOIN two ON two.id = c.id AND two.i = one.i + c.n2 - c.x GROUP BY c.id, c.x),
    cand AS (SELECT c.id, c.x, coalesce(f.ll, 0) + coalesce(r.ll, 0) + coalesce(ov.ll, 0) + c.x * {LAM}{p} AS ll,
        coalesce(f.hits, 0) + coalesce(r.hits, 0) + coalesce(ov.hits, 0) AS hits
      FROM xs c LEFT JOIN f ON f.id = c.id AND f.x = c.x LEFT JOIN r ON r.id = c.id AND r.x = c.x LEFT JOIN ov ON ov.id = c.id AND ov.x = c.x),
    quo AS (SELECT pair_id AS id, (length(s1) + length(s2)) * {LAM}{s} AS ll0 FROM pairs),
    {top_two("cand", "quo")}, {chimeras("pairs", "pair_id", "one", "s1")},
    dec AS (SELECT t.*, bad.id IS NOT NULL AS chimera, bad.id IS NULL AND best >= 0 AND second_ll - best_ll < {LIMIT} AND hits >= {least} AS sure FROM top t LEFT JOIN bad ON bad.id = t.id)"""


DECISION = "SELECT id AS pair_id, CAST(CASE WHEN sure THEN best ELSE -1 END AS INT) AS cut, chimera FROM dec"


def consensus_sql() -> str:
    w = lambda b, q, k: f"CASE WHEN {b} = '{k}' THEN greatest(1 - {e(q)}, 0.25) ELSE (1 - greatest(1 - {e(q)}, 0.25)) / 3 END"
    ws = ", ".join(f"({w('b1', 'q1', k)}) * ({w('b2', 'q2', k)}) AS w{k}" for k in "ACGT")
    total = "(wA + wC + wG + wT)"

    def quality(b: str) -> str:
        cases = " ".join(f"WHEN {b} = '{k}' THEN {' + '.join('w' + j for j in 'ACGT' if j != k)}" for k in "ACGT")
        return f"CASE WHEN {b} = 'N' THEN 0 ELSE floor(least(60, -10 * log10((CASE {cases} END) / {total})) + 0.5) END"

    return f"""{paired()},
    pos AS (SELECT d.id, i, d.best AS x, n1, n2 FROM dec d JOIN (SELECT pair_id, length(s1) AS n1, length(s2) AS n2 FROM pairs) p ON p.pair_id = d.id, range(0, 130) t(i) WHERE d.sure AND i < d.best),
    obs AS (SELECT p.id, p.i, one.b AS b1, one.q AS q1, two.b AS b2, two.q AS q2 FROM pos p LEFT JOIN one ON one.id = p.id AND one.i = p.i LEFT JOIN two ON two.id = p.id AND two.i = p.i + p.n2 - p.x),
    wt AS (SELECT *, {ws} FROM obs WHERE b1 IS NOT NULL AND b2 IS NOT NULL),
    col AS (SELECT id, i, CASE WHEN b1 = b2 THEN b1 WHEN q1 > q2 THEN b1 WHEN q2 > q1 THEN b2
               WHEN (id * 7919 + i * 104729 + 15485863) % 1009 >= 505 THEN b2 ELSE b1 END AS b, greatest({quality("b1")}, {quality("b2")}) AS q FROM wt
      UNION ALL SELECT id, i, coalesce(b1, b2), coalesce(q1, q2) FROM obs WHERE b1 IS NULL OR b2 IS NULL)
    SELECT id AS pair_id, string_agg(b, '' ORDER BY i) AS seq, string_agg(chr(CAST(q + 33 AS INT)), '' ORDER BY i) AS qual FROM col GROUP BY id"""


def trim_sql(prior=None) -> str:
    return f"""{single(prior)}, {chimeras("reads", "read_id", "bs", "seq")},
    dec AS (SELECT r.read_id, r.seq, r.qual, bad.id IS NOT NULL AS chimera, t.best >= 0 AND t.second_ll - t.best_ll < {LIMIT} AS sure, t.best
      FROM reads r JOIN top t ON t.id = r.read_id LEFT JOIN bad ON bad.id = r.read_id)
    SELECT read_id, CASE WHEN chimera OR sure AND best < 5 THEN 'D' ELSE ' ' END AS code, CAST(CASE WHEN sure AND NOT chimera THEN best ELSE -1 END AS INT) AS cut,
      CASE WHEN sure AND NOT chimera AND best >= 5 THEN substr(seq, 1, CAST(best AS INT)) ELSE '' END AS seq,
      CASE WHEN sure AND NOT chimera AND best >= 5 THEN substr(qual, 1, CAST(best AS INT)) ELSE '' END AS qual FROM dec"""


def edits(s: str, k: str) -> str:
    return f"""(abs(length({s}) - length({k})) + len(list_filter(range(1, CAST(least(length({s}), length({k})) AS BIGINT) + 1),
        lambda i: substr({s}, CAST(i AS INT), 1) <> substr({k}, CAST(i AS INT), 1) AND substr({k}, CAST(i AS INT), 1) <> 'N')))"""


def tally_sql() -> str:
    return f"""{paired()}, out AS (SELECT CASE WHEN chimera THEN 'chimera' WHEN NOT sure OR best = 0 THEN 'kept' WHEN best > greatest(length(s1), length(s2)) THEN 'merged_overlap' ELSE 'merged_trim' END AS o
      FROM dec JOIN pairs ON pair_id = id)
    SELECT count(*) AS total, count(*) FILTER (o = 'merged_trim') AS merged_trim, count(*) FILTER (o = 'merged_overlap') AS merged_overlap, count(*) FILTER (o = 'kept') AS kept,
      count(*) FILTER (o = 'trimmed') AS trimmed, count(*) FILTER (o = 'chimera') AS chimera, count(*) FILTER (o = 'failed_key') AS failed_key, count(*) FILTER (o = 'umi_problem') AS umi_problem FROM out"""


INFER = f"""WITH pairs AS ({CLEAR_PAIRS}), turned AS (SELECT *, reverse(translate(s2, 'ACGTN', 'TGCAN')) AS r2, reverse(q2) AS rq2 FROM pairs),
    {bases("pairs", "one", "pair_id", "s1", "q1")}, {bases("turned", "two", "pair_id", "r2", "rq2")},
    xs AS (SELECT pair_id AS id, length(s1) AS n1, length(s2) AS n2, x FROM pairs, range(0, 130) t(x)
      WHERE x < least(2 * greatest(length(s1), length(s2)) - 10, greatest(length(s1), length(s2)) - 1)),
    ov AS (SELECT c.id, c.x, sum(CASE WHEN one.b = two.b THEN log10((1 - {e("one.q")}) * (1 - {e("two.q")}) + {e("one.q")} * {e("two.q")} / 3)
        ELSE log10((1 - {e("one.q")}) * ({e("two.q")} / 3) + ({e("one.q")} / 3) * (1 - {e("two.q")}) + 2 * {e("one.q")} * {e("two.q")} / 9) END) AS ll
      FROM xs c JOIN one ON one.id = c.id JOIN two ON two.id = c.id AND two.i = one.i + c.n2 - c.x GROUP BY c.id, c.x),
    cand AS (SELECT c.id, c.x, coalesce(ov.ll, 0) + {LAM} * (c.x + greatest(0, n1 - c.x - 1) + greatest(0, n2 - c.x - 1)) AS ll, 0 AS hits FROM xs c LEFT JOIN ov ON ov.id = c.id AND ov.x = c.x),
    quo AS (SELECT pair_id AS id, (length(s1) + length(s2)) * {LAM} AS ll0 FROM pairs), {top_two("cand", "quo")},
    acc AS (SELECT p.*, t.best, t.best >= 0 AND t.second_ll - t.best_ll < -40 AND q.ll0 - t.best_ll < -40 AS accepted FROM pairs p JOIN top t ON t.id = p.pair_id JOIN quo q ON q.id = p.pair_id)"""

INFER_CONSENSUS = f"""{INFER}, hang AS (SELECT 'F' AS side, substr(s1, CAST(best + 1 AS INT)) AS seq, substr(q1, CAST(best + 1 AS INT)) AS qual FROM acc WHERE accepted AND best < length(s1)
      UNION ALL SELECT 'S', substr(s2, CAST(best + 1 AS INT)), substr(q2, CAST(best + 1 AS INT)) FROM acc WHERE accepted AND best < length(s2)),
    ob AS (SELECT side, i AS position, substr(seq, CAST(i + 1 AS INT), 1) AS b, ascii(substr(qual, CAST(i + 1 AS INT), 1)) - 33 AS q FROM hang, range(0, 31) t(i) WHERE i < length(seq)),
    ll AS (SELECT side, position, k, sum(CASE WHEN b = 'N' THEN {LAM} WHEN b = k THEN {match("q")} ELSE {mismatch("q")} END) AS v FROM ob, (VALUES ('A'), ('C'), ('G'), ('T')) t(k) GROUP BY ALL),
    mx AS (SELECT side, position, max(v) AS top, arg_max(k, v) AS best FROM ll GROUP BY ALL),
    ms AS (SELECT ll.side, ll.position, sum(pow(10.0, v - top)) AS mass, any_value(best) AS best FROM ll JOIN mx ON mx.side = ll.side AND mx.position = ll.position GROUP BY ALL)
    SELECT side, CAST(position AS INT) AS position, CASE WHEN (mass - 1) / mass < 0.01 THEN best ELSE 'I' END AS base FROM ms"""
