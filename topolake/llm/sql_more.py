"""DuckDB SQL for op12 and op13, each with a logic of its own: plain counting, and a search from behind over whole strings."""

from __future__ import annotations

# A crc32 bit by bit, of text that is ASCII.
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({key}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
  lambda acc, b: list_reduce(list_prepend(xor(acc, b), CAST(range(8) AS BIGINT[])), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295)"""


def _edit(cost: str, letter: str, line: str, rest: str) -> str:
    return f"{{'c': {rest}.c + {cost}, 'a': '{letter}' || {rest}.a, 't': {line} || {rest}.t}}"


def _least(*options: str) -> str:
    return f"list_sort([{', '.join(options)}])[1]"


def _insert(role: str, rest: str) -> str:
    return _edit("3", "I", f"chr(10) || '{role}:'", rest)


_NONE = "{'c': CAST(1000000 AS BIGINT), 'a': '~', 't': ''}"
_END = "{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}"


def _row(q: int) -> str:
    """The best of what may be done with a row where q tells what was said before: 0 nothing, 1 system, 2 user, 3 assistant."""
    to, role = ("b3", "assistant") if q == 2 else ("b2", "user")
    stay = {0: "CASE ini WHEN 's' THEN b1 WHEN 'u' THEN b2 END", 1: "CASE ini WHEN 'u' THEN b2 END", 2: "CASE ini WHEN 'a' THEN b3 END", 3: "CASE ini WHEN 'u' THEN b2 END"}[q]
    keep = f"CASE WHEN free AND ({stay}) IS NOT NULL THEN {_edit('more', 'K', 'chr(10) || role || chr(58) || text', f'({stay})')} ELSE {_NONE} END"
    reroll = f"CASE WHEN free THEN {_edit('3 + more', 'R', f'chr(10) || {chr(39)}{role}:{chr(39)} || text', to)} ELSE {_NONE} END"
    return _least(_edit("4", "D", "''", f"b{q}"), keep, reroll)


def _with_inserts(inner: str) -> str:
    """(conv_id, i, b0 to b3) of raw (conv_id, i, r0 to r3): inserts before the place added."""
    two = f"SELECT conv_id, i, r0, r1, {_least('r2', _insert('assistant', 'r3'))} AS b2, {_least('r3', _insert('user', 'r2'))} AS b3 FROM ({inner})"
    return f"SELECT conv_id, i, {_least('r0', _insert('user', 'b2'))} AS b0, {_least('r1', _insert('user', 'b2'))} AS b1, b2, b3 FROM ({two})"


_REPAIR = rf"""
WITH RECURSIVE c0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format(key="(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS h FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy FROM c0 WHERE h <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS MATERIALIZED (SELECT conv_id, turn, role, text, i, left(role, 1) AS ini, coalesce(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS odd,
  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
       WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM r),
g AS (SELECT conv_id, i, ini, role, text, fault NOT IN ('blank', 'duplicate') AS free, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS more FROM f),
z AS (({_with_inserts(f"SELECT conv_id, max(i) + 1 AS i, {_END} AS r0, {_NONE} AS r1, {_NONE} AS r2, {_END} AS r3 FROM f GROUP BY conv_id")})
  UNION ALL ({_with_inserts(f"SELECT z.conv_id, g.i, {_row(0)} AS r0, {_row(1)} AS r1, {_row(2)} AS r2, {_row(3)} AS r3 FROM z JOIN g ON g.conv_id IS NOT DISTINCT FROM z.conv_id AND g.i = z.i - 1")})),
s AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (odd) AS illegal FROM f GROUP BY conv_id),
o AS (SELECT DISTINCT conv_id FROM conversations)
SELECT o.conv_id, CAST(coalesce(s.gaps, 0) AS BIGINT) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated,
  coalesce(s.illegal, 0) AS illegal, coalesce(z.b0.c, 0) AS cost, coalesce(z.b0.a, '') AS audit, sha256(coalesce(substr(z.b0.t, 2), '')) AS repaired_sha256
FROM o LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM o.conv_id AND z.i = 1
"""

_DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY 1, 2 HAVING count(DISTINCT rid) >= 10),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(total) AS HUGEINT) AS n FROM kept GROUP BY 1),
groups AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
size AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY 1, 2),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (CAST(coalesce(c.n, 0) AS HUGEINT) + 2)) // (coalesce(s.n, 0) + 2 * v.v) AS p,
        1 + (1000000000 * (CAST(k.total AS HUGEINT) + 2)) // (v.n + 2 * v.v) AS q
      FROM groups g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN size s ON s.lang = g.lang AND s.source = g.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts) WHERE part = 'pair' OR rank <= 10
"""

MORE = {"op12_source_divergence": _DIVERGENCE, "op13_conversation_repair": _REPAIR}
