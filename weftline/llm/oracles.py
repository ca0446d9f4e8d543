"""DuckDB twins of the queries on conversations.  DuckDB has no crc32: it is worked out from its table, which is worked out, too."""

from __future__ import annotations

#: c: the text's crc32; t: the table of 256
_CRC = r"""
steps AS (SELECT list(list_reduce(list_prepend(i::BIGINT, [0 FOR x IN range(8)]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i))"""


def _crc(text: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(ch)::BIGINT FOR ch IN string_split({text}, '')]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


#: the marks of the template, and the escape behind the first character of what looks like one
OP11 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, k, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(k, r)),
e AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(replace(text, '\', '\\'), '#(## )', '#\\\1', 'g'), '<(/turn>)', '<\\\1', 'g'), '<(\|endoftext\|>)', '<\\\1', 'g') AS body FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('### ') + length(role) + length(': ') + length(body) + length('</turn>x'))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def _least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _step(state: int, due: int, kept: dict[str, int]) -> str:
    """The least (cost, audit) from a state when a row comes next and none is put in before it."""
    add = lambda cost, to, edit: f"{{'c': {cost} + p{to}.c, 'a': '{edit}' || p{to}.a}}"
    keep = " ".join(f"WHEN NOT gone AND r = '{r}' THEN {add('t', to, 'K')}" for r, to in kept.items())
    return _least(add("4", state, "D"), f"CASE WHEN NOT gone THEN {add('3 + t', due, 'R')} END", f"CASE {keep} END")


_IN = "{{'c': 3 + {0}.c, 'a': 'I' || {0}.a}}"
_IN2 = "{{'c': 6 + {0}.c, 'a': 'II' || {0}.a}}"
#: from the last row to the first: of each state (0 start, 1 system, 2 user, 3 assistant) the least (cost, audit) to the end
OP12 = rf"""
WITH RECURSIVE {_CRC.strip()},
x AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations, steps),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM x, range(2) AS c(i) WHERE kind <> 0 AND (i = 0 OR kind = 3)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS (SELECT *, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n),
m AS MATERIALIZED (SELECT conv_id, turn, i, role, text, role[1] AS r, last = '' AS blank, last <> '' AND again AS dup, last <> '' AND NOT again AND last NOT IN ('.', '!', '?') AS cut,
             before IS NOT NULL AND before || role[1] NOT IN ('su', 'ua', 'au') AS bad FROM f),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(dup) AS duplicate, count_if(cut) AS truncated, count_if(bad) AS illegal, max(i) AS n FROM m GROUP BY conv_id),
back AS (
  SELECT conv_id, n AS i, {{'c': 0::BIGINT, 'a': ''}} AS p0, {{'c': 6::BIGINT, 'a': 'II'}} AS p1, {{'c': 3::BIGINT, 'a': 'I'}} AS p2, {{'c': 0::BIGINT, 'a': ''}} AS p3 FROM c
  UNION ALL
  SELECT conv_id, i, {_least("a0", _IN.format("a2"), _IN2.format("a3"))}, {_least("a1", _IN.format("a2"), _IN2.format("a3"))}, {_least("a2", _IN.format("a3"))}, {_least("a3", _IN.format("a2"))}
  FROM (SELECT conv_id, i, {_step(0, 2, {"s": 1, "u": 2})} AS a0, {_step(1, 2, {"u": 2})} AS a1, {_step(2, 3, {"a": 3})} AS a2, {_step(3, 2, {"u": 2})} AS a3
        FROM (SELECT b.conv_id, b.i - 1 AS i, p0, p1, p2, p3, r, blank OR dup AS gone, CASE WHEN cut THEN 3 ELSE 0 END AS t FROM back b JOIN m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.i = b.i))),
found AS (SELECT conv_id, p0.c AS cost, p0.a AS audit FROM back WHERE i = 0),
e AS (SELECT conv_id, p, edit, sum((edit <> 'I')::INT) OVER w AS i, sum((edit <> 'D')::INT) OVER w AS j
      FROM (SELECT conv_id, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS p FROM found WHERE audit <> '') WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
s AS (SELECT e.conv_id, edit, j, role, text, bool_or(j = 1 AND edit = 'K' AND r = 's') OVER (PARTITION BY e.conv_id) AS system FROM e LEFT JOIN m ON edit <> 'I' AND e.conv_id IS NOT DISTINCT FROM m.conv_id AND e.i = m.i),
l AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (j - coalesce(system, false)::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS sha
      FROM s WHERE edit <> 'D' GROUP BY conv_id),
o AS (SELECT DISTINCT conv_id FROM conversations)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM o LEFT JOIN c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN found ON o.conv_id IS NOT DISTINCT FROM found.conv_id LEFT JOIN l ON o.conv_id IS NOT DISTINCT FROM l.conv_id
"""

#: paths are told by lists of turns, not by chained digests; sums over subtrees go from each node to the nodes above it
OP13 = rf"""
WITH {_CRC.strip()},
ids AS (SELECT conv_id, {_crc("conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), steps),
own AS (SELECT conv_id, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS w FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
made AS (SELECT ids.conv_id AS c, list_concat(coalesce(base.w[1:h], []), own.w[h + 1:]) AS w FROM ids JOIN own USING (conv_id) LEFT JOIN own base ON base.conv_id = ids.conv_id - ids.conv_id % 5),
p AS MATERIALIZED (SELECT c, d, md5(w[1:d]::VARCHAR || to_json([[v.r, v.x] FOR v IN w[1:d]])::VARCHAR) AS g, md5(w[1:d - 1]::VARCHAR || to_json([[v.r, v.x] FOR v IN w[1:d - 1]])::VARCHAR) AS above, CASE WHEN d > 0 THEN strlen(w[d].x) ELSE 0 END AS size, d = len(w) AS ends
      FROM (SELECT c, w, unnest(generate_series(0, len(w))) AS d FROM made)),
n AS MATERIALIZED (SELECT d, g, any_value(above) AS above, min(c) AS c, count(*) AS m, max(size) AS size, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends) AS ends FROM p GROUP BY d, g),
k AS (SELECT d - 1 AS d, above AS g, count(*) AS children FROM n WHERE d > 0 GROUP BY ALL),
v AS (SELECT n.*, coalesce(children, 0) AS children FROM n LEFT JOIN k USING (d, g)),
up AS (SELECT a.d, a.g, sum((v.m - 1) * v.size) AS saved, count_if(v.children = 0) AS leaves FROM v JOIN p a ON a.c = v.c AND a.d <= v.d GROUP BY ALL)
SELECT v.c AS conv_id, v.d AS depth, o.c AS parent_conv_id, v.m AS n_convs, v.children::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN up USING (d, g) LEFT JOIN n o ON o.d = v.d - 1 AND o.g = v.above AND v.d > 0
"""
