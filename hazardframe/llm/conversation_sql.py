"""DuckDB SQL for the queries over conversations: dynamic programming row by row, and joins of whole paths."""


def crc32(text: str) -> str:
    """The CRC-32 of an ASCII string, bit by bit."""
    return f"""xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295)"""


TRIE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, r, x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, sha256(x)) AS pos FROM t),
i AS (SELECT conv_id, conv_id - conv_id % 5 AS base, count(*) AS n, {crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM p GROUP BY conv_id),
k AS (SELECT i.*, coalesce(least(i.h, b.n), 0) AS kept FROM i LEFT JOIN i AS b ON b.conv_id = i.base),
s AS (
  SELECT k.conv_id AS c, pos AS d, r, x FROM k JOIN p ON p.conv_id = k.base AND pos <= kept
  UNION ALL SELECT k.conv_id, kept + pos - h, r, x FROM k JOIN p ON p.conv_id = k.conv_id AND pos > h
), m AS (
  SELECT c, d, octet_length(encode(x)) AS size, sha256(string_agg(sha256(length(r) || ':' || r || x), '') OVER (PARTITION BY c ORDER BY d)) AS node FROM s
  UNION ALL SELECT conv_id, 0, 0, '' FROM i
), e AS (SELECT *, max(d) OVER (PARTITION BY c) AS last, lag(node) OVER (PARTITION BY c ORDER BY d) AS up FROM m),
g AS (
  SELECT node, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(size) AS size, any_value(up) AS up,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = last), '')) AS ends_sha256 FROM e GROUP BY node
), ch AS (SELECT up AS node, count(*) AS n_children FROM g WHERE up IS NOT NULL GROUP BY up),
leaf AS (SELECT DISTINCT e.c, e.node AS leaf FROM e LEFT JOIN ch USING (node) WHERE d = last AND n_children IS NULL),
lv AS (SELECT e.node, count(DISTINCT leaf) AS n_leaves FROM e JOIN leaf USING (c) GROUP BY e.node),
sv AS (SELECT e.node, sum((g.n_convs - 1) * g.size) AS saved_tokens FROM g JOIN e ON e.c = g.conv_id AND e.d <= g.depth GROUP BY e.node)
SELECT g.conv_id, CAST(g.depth AS BIGINT) AS depth, pg.conv_id AS parent_conv_id, g.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, g.ends_sha256
FROM g LEFT JOIN g AS pg ON pg.node = g.up LEFT JOIN ch ON ch.node = g.node JOIN lv ON lv.node = g.node JOIN sv ON sv.node = g.node
"""

REPAIR = f"""
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id FROM conversations),
o AS (SELECT conv_id AS c, turn AS t, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT *, {crc32("k")} % 20 AS kind FROM o),
dm AS (SELECT c, t, CASE WHEN kind = 4 THEN 'user' ELSE r END AS r, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(x, '.!?', '') ELSE x END AS x
       FROM h CROSS JOIN (VALUES (1), (2)) AS v (copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
f AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY t NULLS FIRST, r, x) AS i, rtrim(x, e' \\t\\n\\x0b\\x0c\\r') AS body FROM dm),
f2 AS (SELECT *, CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY c, r, x ORDER BY i) > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
       left(r, 1) AS a, lag(left(r, 1)) OVER (PARTITION BY c ORDER BY i) || left(r, 1) AS pair FROM f),
ins AS (SELECT * FROM (VALUES (0, '', 0, 0, ''), (0, 'I', 3, 2, e'\\nuser:'), (0, 'II', 6, 3, e'\\nuser:\\nassistant:'), (1, '', 0, 1, ''), (1, 'I', 3, 2, e'\\nuser:'), (1, 'II', 6, 3, e'\\nuser:\\nassistant:'),
       (2, '', 0, 2, ''), (2, 'I', 3, 3, e'\\nassistant:'), (3, '', 0, 3, ''), (3, 'I', 3, 2, e'\\nuser:')) AS v (q, said, price, mid, out)),
ed AS (SELECT * FROM (VALUES (0, 0, 'D', ''), (1, 1, 'D', ''), (2, 2, 'D', ''), (3, 3, 'D', ''), (0, 1, 'K', 's'), (0, 2, 'K', 'u'), (1, 2, 'K', 'u'), (3, 2, 'K', 'u'), (2, 3, 'K', 'a'),
       (0, 2, 'R', 'user'), (1, 2, 'R', 'user'), (3, 2, 'R', 'user'), (2, 3, 'R', 'assistant')) AS v (mid, after, edit, becomes)),
w AS (
  SELECT conv_id AS c, CAST(0 AS BIGINT) AS i, 0 AS q, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS out FROM ids
  UNION ALL
  SELECT c, i, q, cost, audit, out FROM (
    SELECT w.c, f2.i, after AS q, w.cost + price + CASE edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN edit <> 'D' AND fault = 't' THEN 3 ELSE 0 END AS cost, audit || ins.said || edit AS audit,
           w.out || ins.out || CASE edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || r || ':' || x ELSE chr(10) || becomes || ':' || x END AS out
    FROM w JOIN f2 ON f2.c IS NOT DISTINCT FROM w.c AND f2.i = w.i + 1 JOIN ins ON ins.q = w.q JOIN ed ON ed.mid = ins.mid
    WHERE edit = 'D' OR (fault NOT IN ('b', 'd') AND (edit = 'R' OR becomes = a))
  ) QUALIFY row_number() OVER (PARTITION BY c, q ORDER BY cost, audit) = 1
), z AS (SELECT w.c, w.cost + price AS cost, audit || said AS audit, w.out || ins.out AS out FROM w JOIN ins ON ins.q = w.q AND mid IN (0, 3)
         WHERE w.i = (SELECT count(*) FROM f2 WHERE f2.c IS NOT DISTINCT FROM w.c) QUALIFY row_number() OVER (PARTITION BY w.c ORDER BY w.cost + price, audit || said) = 1),
n AS (SELECT c, coalesce(max(t) - min(t) + 1 - count(DISTINCT t), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
      count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f2 GROUP BY c)
SELECT z.c AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       cost, audit, sha256(substring(out, 2)) AS repaired_sha256
FROM z LEFT JOIN n ON n.c IS NOT DISTINCT FROM z.c
"""
