"""DuckDB SQL for the numbered queries that SQL can express; tests hold the others against plain Python."""

from __future__ import annotations

from tessel.llm import secrets
from tessel.llm.queries import URL_RULES

LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _spans(k: int, rule: secrets.Rule) -> str:
    # possessive loops, which DuckDB lacks, find the same spans as plain ones in these patterns
    pattern = rule.pattern.replace("*+", "*").replace("}+", "}").replace("'", "''")
    enough = f"length(regexp_extract(hit, '{pattern}', {rule.group})) >= {rule.least}"
    return f"""SELECT doc_id, {k} AS rank, '{rule.kind}' AS kind, pos AS start, pos + length(hit) AS stop FROM (
  SELECT doc_id, hits[i] AS hit, list_sum(list_transform(gaps[:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(hits[:i - 1], lambda x: length(x))), 0)::BIGINT AS pos
  FROM (SELECT doc_id, gaps, hits, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '{pattern}') AS gaps, regexp_extract_all(coalesce(text, ''), '{pattern}', 0) AS hits FROM documents))) WHERE {enough}"""


_LISTED = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop)"
_COUNTS = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE)
_PER_KIND = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE)

_RULES = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in URL_RULES)

SQL: dict[str, str] = {
    "op5_secrets": f"""WITH f AS ({" UNION ALL ".join(_spans(k, r) for k, r in enumerate(secrets.RULES))}),
g AS (SELECT doc_id, {_PER_KIND}, {_LISTED} FILTER (WHERE rank < {len(secrets.BASE)}) AS base, {_LISTED} AS spans FROM f GROUP BY doc_id)
SELECT doc_id, {_COUNTS}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN g USING (doc_id)""",
    "op7_urls": f"""WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), {LETTERS}) AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT * FROM (VALUES {_RULES}) AS t(h, s, v)),
m AS (SELECT p.*, h || s AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || s) DESC NULLS LAST, v DESC) AS n FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE n = 1""",
    "op9_jaccard": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) ELSE [array_to_string(w, ' ')] END) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT c.a, c.b FROM c JOIN n x ON c.a = x.doc_id JOIN n y ON c.b = y.doc_id WHERE 100 * k >= 90 * (x.n + y.n - k)),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.seen = e.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, low AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(seen) AS low FROM r GROUP BY 1) USING (doc_id)""",
    "op12_trie": """WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS turns FROM t GROUP BY conv_id),
h AS (SELECT *, (4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))) % 6 AS h FROM o),
r AS (SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns FROM h c LEFT JOIN o b ON b.conv_id = c.conv_id - c.conv_id % 100),
p AS (SELECT conv_id, len(turns) AS n, d, turns[1:d] AS path, turns[1:d - 1] AS up, CASE WHEN d > 0 THEN length(turns[d].t) ELSE 0 END AS size FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM r)),
n AS (SELECT path, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256 FROM p GROUP BY path, d),
k AS (SELECT up AS path, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
a AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON n.path = k.path AND n.d = k.d),
b AS (SELECT path[1:e] AS path, e AS d, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM a) GROUP BY ALL)
SELECT a.conv_id, a.d AS depth, u.conv_id AS parent_conv_id, a.n_convs, a.n_children, b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, a.ends_sha256
FROM a JOIN b ON a.path = b.path AND a.d = b.d LEFT JOIN n u ON a.d > 0 AND u.path = a.up AND u.d = a.d - 1""",
}
