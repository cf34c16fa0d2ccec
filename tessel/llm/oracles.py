"""DuckDB SQL of the operators that it can express and whose text is long."""

from __future__ import annotations


def codes_sql(rounds: int = 4, parts: int = 4, entries: int = 256) -> str:
    """Operator 12: every part against every entry. Integers are held as doubles, which are exact here."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (SELECT p.part, p.r, min(CAST(p.sq - 2 * list_inner_product(p.v, c.v) + list_inner_product(c.v, c.v) AS BIGINT) * {entries} + c.e) AS best
  FROM p JOIN c{i} c ON c.part = p.part GROUP BY p.part, p.r),
n{i} AS (SELECT part, e, list(x ORDER BY j) AS v FROM (
  SELECT part, e, j, floor(sum(x) / count(*)) AS x FROM (
    SELECT p.part, a.best % {entries} AS e, unnest(p.v) AS x, generate_subscripts(p.v, 1) AS j FROM a{i} a JOIN p ON p.part = a.part AND p.r = a.r)
  GROUP BY part, e, j) GROUP BY part, e),
c{i + 1} AS MATERIALIZED (SELECT c.part, c.e, coalesce(n.v, c.v) AS v FROM c{i} c LEFT JOIN n{i} n ON n.part = c.part AND n.e = c.e)""")
    last = f"a{rounds}"
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT r, CAST(t.part AS BIGINT) AS part, list_slice(v, 1 + t.part * (len(v) // {parts}), (t.part + 1) * (len(v) // {parts})) AS v FROM k, range({parts}) t(part)),
p AS MATERIALIZED (SELECT r, part, v, list_inner_product(v, v) AS sq FROM q),
c0 AS MATERIALIZED (SELECT part, r - 1 AS e, v FROM p WHERE r <= {entries}),{",".join(steps)},
f AS (SELECT r, string_agg(printf('%02x', best % {entries}), '' ORDER BY part) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM {last} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, e)) AS h FROM c{rounds})
SELECT k.vec_id, f.code, f.error, CAST(sum(f.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, h.h AS codebooks_sha256
FROM k JOIN f ON f.r = k.r CROSS JOIN h
"""


def repair_sql() -> str:
    """Operator 13: least (cost, audit) from each place and state to the end, as text that sorts so, row by
    row from the last; crc32 by its table."""

    def longer(v: str, cost: str, letter: str) -> str:
        return f"printf('%09d', CAST({v}[1:9] AS INTEGER) + {cost}) || '{letter}' || {v}[10:]"

    def read(state: int, following: int, kept: dict[str, int]) -> str:
        ways = [f"WHEN init = '{i}' THEN {longer(f's{to}', 'cut', 'K')}" for i, to in kept.items()]
        keep = f"CASE WHEN gone THEN NULL {' '.join(ways)} END"
        return f"least({longer(f's{state}', '4', 'D')}, {keep}, CASE WHEN NOT gone THEN {longer(f's{following}', '3 + cut', 'R')} END)"

    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE bit(b, c, k) AS (SELECT b, b, 0 FROM range(256) t(b) UNION ALL
  SELECT b, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, k + 1 FROM bit WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM bit WHERE k = 8),
keyed AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
acted AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: xor(c // 256, t[CAST(xor(c % 256, x) AS INTEGER) + 1]))) % 20 AS act
  FROM keyed, tab),
rows AS (SELECT conv_id, turn, CASE act WHEN 4 THEN 'user' ELSE role END AS role, copy,
  CASE act WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM acted, range(2) t(copy) WHERE act <> 0 AND (copy = 0 OR act = 3)),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, copy) AS i, right(rtrim(text, {spaces}), 1) AS mark, left(role, 1) AS init FROM rows),
judged AS MATERIALIZED (SELECT *, CASE WHEN mark = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN mark NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
  lag(init) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
coded AS MATERIALIZED (SELECT conv_id, i, init, coalesce(fault IN ('blank', 'duplicate'), false) AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS cut FROM judged),
facts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || init NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
dp(conv_id, i, s0, s1, s2, s3) AS (
  SELECT conv_id, n, '000000000', '000000006II', '000000003I', '000000000' FROM facts
  UNION ALL
  SELECT conv_id, i, least(b0, {longer("u", "3", "I")}), least(b1, {longer("u", "3", "I")}), u, least(b3, {longer("b2", "3", "I")}) FROM (
    SELECT *, least(b2, {longer("b3", "3", "I")}) AS u FROM (
      SELECT dp.conv_id, dp.i - 1 AS i, {read(0, 2, {"s": 1, "u": 2})} AS b0, {read(1, 2, {"u": 2})} AS b1, {read(2, 3, {"a": 3})} AS b2, {read(3, 2, {"u": 2})} AS b3
      FROM dp JOIN coded ON coded.conv_id = dp.conv_id AND coded.i = dp.i))),
best AS MATERIALIZED (SELECT conv_id, CAST(s0[1:9] AS BIGINT) AS cost, s0[10:] AS audit FROM dp WHERE i = 0),
letters AS (SELECT conv_id, unnest(string_split(audit, '')) AS e, generate_subscripts(string_split(audit, ''), 1) AS k FROM best WHERE audit <> ''),
walked AS (SELECT conv_id, k, e, count(*) FILTER (e <> 'I') OVER w AS i, count(*) FILTER (e <> 'D') OVER w AS m FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
said AS (SELECT w.conv_id, w.k, w.e, w.m, p.role, p.text, max(CASE WHEN w.e = 'K' AND p.init = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY w.conv_id) AS led
  FROM walked w LEFT JOIN placed p ON p.conv_id = w.conv_id AND p.i = w.i),
joined AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (m - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS repaired FROM said WHERE e <> 'D' GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts USING (conv_id) LEFT JOIN best USING (conv_id) LEFT JOIN joined USING (conv_id)
"""
