"""DuckDB SQL of the contracts of operators 1, 2 and 5, written from the contracts and not from the operators."""

from __future__ import annotations

import string

BASE = ("assign", "access", "hex")
#: kind -> pattern, group whose length counts (0: the match), least length; the first three as the contract words them.
RULES = {
    "assign": (r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 20),
    "forge": (r"gh[opsur]_[A-Za-z0-9]+", 0, 24),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
}

SUFFIX = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
l AS (SELECT r, list_transform(range(1, octet_length(b) - 198), lambda s: md5(b[s:s + 199])) AS m FROM d WHERE octet_length(b) >= 200),
w AS (SELECT r, unnest(m) AS m, unnest(range(1, len(m) + 1)) AS s FROM l),
u AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
h AS (SELECT r, s FROM w SEMI JOIN u USING (m)),
g AS (SELECT r, s, CASE WHEN s - lag(s) OVER (PARTITION BY r ORDER BY s) <= 200 THEN 0 ELSE 1 END AS fresh FROM h),
k AS (SELECT r, s, sum(fresh) OVER (PARTITION BY r ORDER BY s) AS span FROM g),
p AS (SELECT r, span, min(s) AS a, max(s) + 200 AS z FROM k GROUP BY r, span),
q AS (SELECT p.r, a, z, hex(b[coalesce(lag(z) OVER (PARTITION BY p.r ORDER BY a), 1):a - 1]) AS before FROM p JOIN d ON d.r = p.r),
o AS (SELECT r, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed, string_agg(before, '' ORDER BY a) AS kept, max(z) AS last FROM q GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(CASE WHEN o.r IS NULL THEN b ELSE unhex(kept || hex(b[last:octet_length(b)])) END) AS kept_sha256
FROM d LEFT JOIN o ON o.r = d.r
"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _kind(order: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = _quoted(pattern)
    return f"""SELECT r, {order} AS o, {_quoted(kind)} AS kind, i, coalesce(list_sum(list_transform(cut[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS s, len(m[i]) AS n
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT r, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {group}) AS g, regexp_split_to_array(t, {p}) AS cut FROM d WHERE regexp_matches(t, {p})))
  WHERE len(g[i]) >= {least}"""


def secrets() -> str:
    """Places follow from the lengths of the matches and of what lies between them."""
    kinds = "\n  UNION ALL ".join(_kind(i, k, *rule) for i, (k, rule) in enumerate(RULES.items()))
    shown = "string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, o)"
    counts = ", ".join(f"coalesce(count(*) FILTER (kind = '{k}'), 0) AS n_{k}" for k in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({kinds}),
a AS (SELECT r, {counts}, {shown} FILTER (o < {len(BASE)}) AS base, {shown} AS spans FROM f GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob
FROM d LEFT JOIN a USING (r)
"""


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS g
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
l AS (SELECT DISTINCT n FROM q),
g AS (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, l WHERE len(w) >= n)),
m AS (SELECT DISTINCT r, k, n, item_id FROM g JOIN q USING (n, g)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM m) GROUP BY r),
item AS (SELECT r, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items FROM (SELECT DISTINCT r, coalesce(item_id::VARCHAR, 'null') AS id FROM m) GROUP BY r),
-- proximity: the window's rarest term (in words of all documents; the earlier on ties) in place, every other within 2 places of its own
t AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS w FROM d WHERE len(w) > 0),
f AS (SELECT w, count(*) AS df FROM t GROUP BY w),
v AS (SELECT item_id, k, o, n, x.w, coalesce(df, 0) AS df FROM (
        SELECT item_id, k, n, unnest(range(n)) AS o, unnest(u) AS w FROM (
          SELECT item_id, k, least(len(w), 10) AS n, w[k:k + least(len(w), 10) - 1] AS u FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0))) x LEFT JOIN f ON f.w = x.w),
a AS (SELECT item_id, k, n, min_by(o, df * 100 + o) AS o, min_by(w, df * 100 + o) AS w FROM v GROUP BY item_id, k, n),
c AS (SELECT item_id, k, n, r, p - o AS s FROM a JOIN t ON t.w = a.w),
e AS (SELECT DISTINCT c.item_id, c.k, c.n, c.r, c.s, v.o FROM c JOIN v ON v.item_id IS NOT DISTINCT FROM c.item_id AND v.k = c.k JOIN t ON t.r = c.r AND t.w = v.w AND t.p BETWEEN c.s + v.o - 2 AND c.s + v.o + 2),
near AS (SELECT r, count(DISTINCT id) AS n_near FROM (SELECT r, coalesce(item_id::VARCHAR, 'null') AS id FROM e GROUP BY item_id, k, n, r, s HAVING count(*) = n) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN hit USING (r) LEFT JOIN item USING (r) LEFT JOIN near USING (r)
"""
