"""DuckDB SQL for the same queries, written from the definitions."""

from __future__ import annotations

from corpusloom.plans import ast

TOKENS = r"""tok AS (
  SELECT doc_id, (unnest(range(len(t))))::INT AS pos, unnest(t) AS token FROM (
    SELECT doc_id, list_transform(regexp_extract_all(strip_accents(text), '[\p{L}\p{N}]+'), lambda x: lower(x)) AS t FROM documents))"""


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


class Sql:
    def __init__(self, node: ast.Node):
        self.node, self.at = node, {t: i for i, t in enumerate(ast.terms(node))}

    def _tf(self, t: str) -> str:
        return f"tf_{self.at[t]}"

    def weight(self, t: str) -> str:
        return f"(CASE WHEN {self._tf(t)} > 0 THEN 1 + ln({self._tf(t)}) ELSE 0 END)::FLOAT"

    def chains(self, q: ast.Quote) -> str:
        prev = "s"
        for k, t in enumerate(q.terms[1:], 1):
            prev = f"list_min(list_filter(p_{self.at[t]}, lambda x{k}: x{k} > {prev}))"
        return f"coalesce(len(list_filter(p_{self.at[q.terms[0]]}, lambda s: coalesce({prev} - s + 1 <= {q.dist}, false))), 0)"

    def match(self, node: ast.Node) -> str:
        match node:
            case ast.Term(t):
                return f"{self._tf(t)} IS NOT NULL"
            case ast.Quote():
                return f"{self.chains(node)} > 0"
            case ast.Not(c):
                return f"NOT ({self.match(c)})"
            case ast.And(a, b):
                return f"({self.match(a)}) AND ({self.match(b)})"
        return f"({self.match(node.left)}) OR ({self.match(node.right)})"

    def size(self, node: ast.Node) -> str:
        match node:
            case ast.Term(t):
                return f"(SELECT count(*) FROM post WHERE term = {_lit(t)})"
            case ast.Quote(ts):
                return "least(" + ", ".join(self.size(ast.Term(t)) for t in ts) + ")"
            case ast.Not(c):
                return f"((SELECT count(*) FROM documents) - {self.size(c)})"
            case ast.And(a, b):
                return f"least({self.size(a)}, {self.size(b)})"
        return f"least({self.size(node.left)} + {self.size(node.right)}, (SELECT count(*) FROM documents))"

    def rank(self, node: ast.Node) -> str:
        match node:
            case ast.Term(t):
                return self.weight(t)
            case ast.Not(c):
                return f"(10 * (ln((SELECT count(*) FROM documents) / nullif({self.size(c)}, 0))::FLOAT)::DOUBLE)::FLOAT"
            case ast.And(a, b):
                return f"({self.rank(a)} + {self.rank(b)})::FLOAT"
            case ast.Or(a, b):
                return f"(CASE WHEN ({self.match(a)}) AND ({self.match(b)}) THEN ({self.rank(a)} + {self.rank(b)})::FLOAT WHEN {self.match(a)} THEN {self.rank(a)} ELSE {self.rank(b)} END)"
        first, *rest = dict.fromkeys(node.terms)
        total, k = self.weight(first), len(node.terms)
        for t in rest:
            total = f"({total} + {self.weight(t)})::FLOAT"
        text = f"ln(1 + {total}::DOUBLE)::FLOAT::DOUBLE"
        return f"(((0.05::FLOAT)::DOUBLE * {text})::FLOAT::DOUBLE + (1::FLOAT - 0.05::FLOAT)::FLOAT::DOUBLE * ln(1 + floor({self.chains(node)} * {k * k * 10} / {node.dist})))::FLOAT"

    def base(self) -> str:
        names = list(self.at)
        pivot = ", ".join(f"max(tf) FILTER (term = {_lit(t)}) AS tf_{i}, any_value(positions) FILTER (term = {_lit(t)}) AS p_{i}" for i, t in enumerate(names))
        return f"""{TOKENS},
post AS (SELECT token AS term, doc_id, count(*)::INT AS tf, list(pos ORDER BY pos) AS positions FROM tok WHERE token IN ({', '.join(map(_lit, names))}) GROUP BY 1, 2),
pv AS (SELECT doc_id, {pivot} FROM post GROUP BY doc_id),
base AS (SELECT d.doc_id, pv.* EXCLUDE (doc_id) FROM documents d LEFT JOIN pv USING (doc_id))"""

    def ranked(self, most: int, low: int = 1, high: int = 10**9) -> str:
        return f"""WITH {self.base()},
m AS (SELECT doc_id, {self.rank(self.node)} AS rank FROM base WHERE {self.match(self.node)} ORDER BY rank DESC, doc_id DESC LIMIT {most}),
n AS (SELECT (row_number() OVER (ORDER BY rank DESC, doc_id DESC))::INT AS rank_pos, doc_id, round(rank::DOUBLE, 4) AS rank, 0 AS stage FROM m)
SELECT * FROM n WHERE rank_pos BETWEEN {low} AND {high}"""

    def matches(self) -> str:
        return f"WITH {self.base()} SELECT doc_id FROM base WHERE {self.match(self.node)}"


def cascade(stages: dict[int, ast.Node], most: int) -> str:
    """Stage after stage, by number and tree."""
    first, *_ = stages.values()
    if len(stages) == 1:
        return Sql(first).ranked(most).replace("0 AS stage", "1 AS stage")
    whole = Sql(first)
    parts, done = [], []
    for k, node in stages.items():
        out = "".join(f" AND doc_id NOT IN (SELECT doc_id FROM s{i})" for i in done)
        parts.append(f"s{k} AS (SELECT doc_id, {whole.rank(node)} AS rank, {k} AS stage FROM base WHERE ({whole.match(node)}){out} ORDER BY rank DESC, doc_id DESC LIMIT {most})")
        done.append(k)
    every = " UNION ALL ".join(f"SELECT * FROM s{k}" for k in done)
    return f"WITH {whole.base()},\n" + ",\n".join(parts) + f"\nSELECT (row_number() OVER (ORDER BY stage DESC, rank DESC, doc_id DESC))::INT AS rank_pos, doc_id, round(rank::DOUBLE, 4) AS rank, stage FROM ({every})"


def snippets(found: str, words: list[str]) -> str:
    """rank_pos, doc_id, snippet of the documents in ``found`` (rank_pos, doc_id, text): every context up to what can matter, then the last that fits."""
    wanted = ", ".join(map(_lit, words))
    running = [f"max(i) FILTER (w = {_lit(w)}) OVER (PARTITION BY doc_id ORDER BY i)" for w in words]
    return rf"""WITH found AS ({found}),
g AS (SELECT rank_pos, doc_id, length(coalesce(text, '')) AS chars, regexp_extract_all(replace(coalesce(text, ''), chr(10), ' '), '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]') AS g FROM found),
s AS (SELECT doc_id, i, lower(strip_accents(x)) AS w FROM (SELECT doc_id, unnest(range(len(g))) AS i, unnest(g) AS x FROM g)),
near AS (SELECT doc_id, list(last ORDER BY i) AS last FROM (SELECT doc_id, i, max(CASE WHEN w IN ({wanted}) THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS last FROM s) GROUP BY doc_id),
h AS (SELECT *, (SELECT count(DISTINCT w) FROM s x WHERE x.doc_id = s.doc_id AND w IN ({wanted})) AS every FROM s WHERE w IN ({wanted})),
e AS (SELECT doc_id, i, every, [{', '.join(running)}] AS l FROM h),
win AS (SELECT doc_id, arg_min(list_min(l), (i - list_min(l)) * 1000000000 + i) AS l, arg_min(i, (i - list_min(l)) * 1000000000 + i) AS r FROM e WHERE len(list_filter(l, lambda x: x IS NOT NULL)) = every GROUP BY doc_id),
ar AS (SELECT *, greatest(l - ar, 0) AS a, least(r + ar + 1, len(g)) AS z FROM (SELECT *, unnest(range(1, 312, 5)) AS ar FROM g JOIN near USING (doc_id) JOIN win USING (doc_id))),
c AS (SELECT doc_id, chars, ar, a = 0 AND z = len(g) AS whole, (CASE WHEN l - ar > 0 THEN '...' ELSE '' END) || array_to_string(g[a + 1:z], '') || (CASE WHEN r + ar + 1 < len(g) THEN '...' ELSE '' END) AS uncut,
  (CASE WHEN l - ar > 0 THEN '...' ELSE '' END) || array_to_string(list_transform(range(a, z), lambda i: CASE
    WHEN last[i + 1] = i OR i - greatest(coalesce(last[i + 1], -1), a - 1) < ar THEN g[i + 1]
    WHEN i - greatest(coalesce(last[i + 1], -1), a - 1) = ar THEN g[i + 1] || '...' ELSE '' END), '') AS cut FROM ar),
stop AS (SELECT doc_id, min(ar) AS stop FROM c WHERE length(cut) >= least(300, chars) OR whole GROUP BY doc_id),
best AS (SELECT doc_id, arg_max(CASE WHEN length(uncut) <= 300 THEN uncut ELSE cut END, ar) AS best FROM c JOIN stop USING (doc_id) WHERE ar <= stop AND (length(uncut) <= 300 OR length(cut) <= 300) GROUP BY doc_id)
SELECT rank_pos, doc_id, coalesce(nullif(best, ''), array_to_string(list_append(g[1:50], '...'), ' ')) AS snippet FROM g LEFT JOIN best USING (doc_id)"""
