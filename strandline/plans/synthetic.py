"""Reads made from the key columns of plain tables, by SQL that Spark and DuckDB run alike."""

from __future__ import annotations

LETTERS = "'0123456789abcdef', 'ACGTACGTACGTACGT'"
QUALS = "'0123456789abcdef', '#%)-27:=?ACEFGHI'"
FORWARD_30 = "AGATCGGAAGAGCACACGTCTGAACTCCAG"
REVERSE_30 = "AGATCGGAAGAGCGTCGTGTAGGGAAAGAG"
TAIL = "TCACGATTACAGATTACACCATGGTTAACCGGATATCCGGTACGATTACAGATTACAGGCATT"
CHIMERA = "ACACTCTTTCCCTACACGTCTGAACTCCAG"


def hexes(salts: str, k: str = "k") -> str:
    return " || ".join(f"md5('{s}' || CAST({k} AS STRING))" for s in salts)


#: read_id, seq, qual: up to 50 bases; some empty, some chimeric, some with a wrong base or N.
SINGLE = f"""
SELECT k AS read_id, seq, substr(translate(hq, {QUALS}), 1, length(seq)) AS qual
FROM (
  SELECT k, hq,
         CASE WHEN k % 97 = 0 THEN ''
              WHEN k % 19 = 0 THEN substr('{CHIMERA}' || s0, 1, 45)
              WHEN k % 3 = 0 THEN substr(s0, 1, m - 1) || translate(substr(s0, m, 1), 'ACGT', 'CGTA') || substr(s0, m + 1)
              WHEN k % 11 = 0 THEN substr(s0, 1, m - 1) || 'N' || substr(s0, m + 1)
              ELSE s0 END AS seq
  FROM (
    SELECT k, {hexes("qr")} AS hq, CAST(k * 31 % 40 + 1 AS INT) AS m,
           substr(substr(translate({hexes("st")}, {LETTERS}), 1, CAST((k * 7919 + 13) % 61 AS INT)) || '{FORWARD_30}' || '{TAIL}', 1, CAST(50 - k % 7 AS INT)) AS s0
    FROM (SELECT o_orderkey AS k FROM orders) o
  ) a
) b
"""

#: pair_id, ins, len, s1, q1, s2, q2: mates of up to 60 bases of fragments of 0 to 110 bases.
PAIRS = f"""
SELECT k AS pair_id, ins, len,
       CASE WHEN k % 4 = 0 THEN substr(a1, 1, m - 1) || translate(substr(a1, m, 1), 'ACGT', 'CGTA') || substr(a1, m + 1)
            WHEN k % 13 = 0 THEN substr(a1, 1, m - 1) || 'N' || substr(a1, m + 1)
            WHEN k % 37 = 0 THEN substr('{CHIMERA}' || a1, 1, 50) ELSE a1 END AS s1,
       substr(translate({hexes("uv")}, {QUALS}), 1, length(CASE WHEN k % 37 = 0 AND k % 4 <> 0 AND k % 13 <> 0 THEN substr('{CHIMERA}' || a1, 1, 50) ELSE a1 END)) AS q1,
       a2 AS s2, substr(translate({hexes("wx")}, {QUALS}), 1, length(a2)) AS q2
FROM (
  SELECT k, ins, len, CAST(k * 29 % 50 + 1 AS INT) AS m,
         substr(substr(ins, 1, len) || '{FORWARD_30}' || '{TAIL}', 1, CAST(60 - k % 5 AS INT)) AS a1,
         substr(reverse(translate(substr(ins, 1, len), 'ACGT', 'TGCA')) || '{REVERSE_30}' || '{TAIL}', 1, CAST(60 - k % 3 AS INT)) AS a2
  FROM (SELECT k, CAST((k * 7919 + 13) % 111 AS INT) AS len, translate({hexes("efgh")}, {LETTERS}) AS ins FROM (SELECT c_custkey AS k FROM customer) c) d
) e
"""

#: Longer mates of the same fragments, with good qualities throughout.
CLEAR_PAIRS = f"""
SELECT pair_id, s1, repeat('G', CAST(length(s1) AS INT)) AS q1, s2, repeat('F', CAST(length(s2) AS INT)) AS q2
FROM (
  SELECT k AS pair_id, substr(substr(ins, 1, len) || '{FORWARD_30}' || '{TAIL}', 1, CAST(100 - k % 5 AS INT)) AS s1,
         substr(reverse(translate(substr(ins, 1, len), 'ACGT', 'TGCA')) || '{REVERSE_30}' || '{TAIL}', 1, CAST(100 - k % 3 AS INT)) AS s2
  FROM (SELECT k, CAST((k * 7919 + 13) % 111 AS INT) AS len, translate({hexes("efgh")}, {LETTERS}) AS ins FROM (SELECT c_custkey AS k FROM customer) c) d
) e
"""
