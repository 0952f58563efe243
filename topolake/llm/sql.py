"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
             CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


# The contract's patterns, written out here on their own so that an error in the operator's cannot hide.
_EITHER = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = "(" + _EITHER + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_BLOB, _ENDPOINT, _SCOPE = r"[A-Za-z0-9+/]{40,}", r"(?:https?|s3|ftp|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9][A-Za-z0-9.:@_/-]+", 256
_ORDER = ("assign", "access", "hex", "blob", "endpoint")


def _found(kind: str, pattern: str, group: int) -> str:
    """Spans of one kind: lengths of gaps and matches in turn give the places."""
    p = pattern.replace("'", "''")
    return f"""
  SELECT rid, '{kind}' AS kind, {_ORDER.index(kind)} AS k, s AS start, s + len(m) AS fin, m, v FROM (
    SELECT rid, unnest(ms) AS m, unnest(vs) AS v,
           unnest(list_transform(range(1, len(ms) + 1), lambda i: CAST(coalesce(list_sum(list_transform(gs[1:i], lambda x: len(x))), 0)
                  + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: len(x))), 0) AS BIGINT))) AS s
    FROM (SELECT rid, regexp_extract_all(t, '{p}', 0) AS ms, regexp_extract_all(t, '{p}', {group}) AS vs,
                 string_split_regex(t, '{p}') AS gs FROM d))"""


_SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
base AS (SELECT * FROM ({_found("assign", _ASSIGN, 2)}) WHERE len(v) >= 8
  UNION ALL SELECT * FROM ({_found("access", "AKIA[A-Z0-9]+", 0)}) WHERE len(v) >= 16 UNION ALL SELECT * FROM ({_found("hex", "[0-9a-f]+", 0)}) WHERE len(v) >= 32),
w AS (SELECT * FROM ({_found("blob", _BLOB, 0)}) b
      WHERE NOT EXISTS (SELECT 1 FROM base x WHERE x.rid = b.rid AND x.start <= b.start AND x.fin >= b.fin)
        AND EXISTS (SELECT 1 FROM base x WHERE x.rid = b.rid AND x.kind = 'access'
                    AND b.start - x.fin <= {_SCOPE} AND x.start - b.fin <= {_SCOPE})),
e AS (SELECT * FROM ({_found("endpoint", _ENDPOINT, 0)}) b
      WHERE EXISTS (SELECT 1 FROM (SELECT rid, start, fin FROM base WHERE kind IN ('assign', 'access') UNION ALL SELECT rid, start, fin FROM w) x
                    WHERE x.rid = b.rid AND b.start - x.fin <= {_SCOPE} AND x.start - b.fin <= {_SCOPE})),
s AS (SELECT * FROM base UNION ALL SELECT * FROM w UNION ALL SELECT * FROM e),
g AS (SELECT rid, string_agg(kind || ':' || start || ':' || fin, ',' ORDER BY start, k) AS spans,
             string_agg(CASE WHEN k < 3 THEN kind || ':' || start || ':' || fin END, ',' ORDER BY start, k) AS base,
             count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c FROM s GROUP BY rid)
SELECT d.doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(b, 0) AS BIGINT) AS n_access,
       CAST(coalesce(c, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""

_NEAR = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
                                 WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM sets),
x AS (SELECT doc_id, unnest(s) AS s FROM sets),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, m.component_id, n.doc_id = m.component_id AS kept FROM n JOIN m USING (doc_id)
"""

_REPEATS = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS spot, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT rid, spot, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT rid, spot, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d)),
m AS (SELECT s, min(spot) AS lo FROM w GROUP BY s),
k AS (SELECT rid, i FROM w JOIN m USING (s) WHERE m.lo < w.spot),
f AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM k),
n AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS run FROM f),
r AS (SELECT rid, run, min(i) AS a, max(i) + 50 AS b FROM n GROUP BY rid, run),
p AS (SELECT rid, run, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY run), 0) AS z FROM r),
t AS (SELECT rid, count(*) AS n_spans, sum(b - a) AS n_removed,
             string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY run) || substr(any_value(h), 2 * max(b) + 1) AS kept
      FROM p JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN t USING (rid)
"""

# What of op3 and op9 SQL can state, as queries of their own: sizes and targets; the base model with all documents to learn from.
_TARGETS = r"""
WITH d AS (SELECT source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS n, (CASE (row_number() OVER (ORDER BY source IS NULL, source COLLATE C) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END) AS w FROM d GROUP BY source),
o AS (SELECT *, 2.0 * n / w AS r FROM s WHERE n > 0),
u AS (SELECT *, (1.5 * sum(n) OVER () - coalesce(sum(2.0 * n) OVER (ORDER BY r, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
                (sum(w) OVER (ORDER BY r, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS unit FROM o),
f AS (SELECT min(unit) AS unit FROM (SELECT unit, row_number() OVER (ORDER BY r, source) AS k, min(CASE WHEN unit <= r THEN rn END) OVER () AS first FROM (SELECT *, row_number() OVER (ORDER BY r, source) AS rn FROM u)) WHERE k = first)
SELECT s.source, CAST(s.n AS BIGINT) AS source_size, round(CASE WHEN s.n = 0 THEN 0.0 WHEN f.unit IS NULL THEN 2.0 * s.n ELSE least(2.0 * s.n, f.unit * s.w) END, 6) AS target FROM s, (SELECT max(unit) AS unit FROM f) f
"""
_BASE = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, unnest(list_append(ws, chr(10))) AS w FROM t), c AS (SELECT w, count(*) AS c FROM x GROUP BY w),
n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_tokens, CAST(any_value(n) AS BIGINT) AS train_tokens, round(sum(log10((c + 0.5) / (n + 0.5 * (v + 1)))), 5) AS base_score FROM x JOIN c USING (w), n GROUP BY doc_id
"""

PARTS = {"mix_source_targets": _TARGETS, "lm_base_of_all": _BASE}
ORACLE = {"op1_near_duplicates": _NEAR, "op2_repeat_removal": _REPEATS, "op4_secret_scans": _SECRETS, "op10_exact_top_k": _TOP_K}
