"""SQL of the numbered queries that plain SQL can express: spelling variants and repair of conversations."""

from __future__ import annotations

import string
import zlib

_TABLE = "[" + ", ".join(str(zlib.crc32(bytes([b ^ 0xFF]), 0) ^ 0xFF000000) for b in range(256)) + "]"


def crc32(text: str) -> str:
    """The crc32 of the UTF-8 bytes of an expression, byte by byte over the table of the polynomial."""
    raw = f"hex(encode({text}))"
    data = f"list_transform(range(0, length({raw}), 2), lambda i: ('0x' || substr({raw}, CAST(i + 1 AS BIGINT), 2))::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {data}), lambda c, b: xor(({_TABLE}::UBIGINT[])[CAST(xor(c, b) & 255 AS BIGINT) + 1], c >> 8)), 4294967295::UBIGINT)::BIGINT"


SPELLING_VARIANTS = f"""WITH RECURSIVE runs AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' AS head, translate(run, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
summed AS (SELECT run, c, {crc32("head || run")} AS h FROM runs),
counted AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(c) AS BIGINT) AS n FROM summed GROUP BY ALL),
words AS (SELECT * FROM counted WHERE length(word) >= 5 AND n >= 3),
cuts AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS near, b.n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word UNION SELECT a.word, w.word, w.n FROM cuts a JOIN words w ON w.word = a.rest UNION SELECT w.word, a.word, a.n FROM cuts a JOIN words w ON w.word = a.rest),
best AS (SELECT word, count(*) OVER (PARTITION BY word) AS n_near, near, n AS near_n, row_number() OVER (PARTITION BY word ORDER BY n DESC, near) AS place FROM pairs),
known AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 2 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 2 * w.n THEN b.near_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word AND b.place = 1),
chain AS (SELECT word, word AS root, 0 AS steps FROM known UNION ALL SELECT c.word, k.form, steps + 1 FROM chain c JOIN known k ON k.word = c.root WHERE k.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM known JOIN (SELECT word, arg_max(root, steps) AS root FROM chain GROUP BY word) USING (word)"""

_DUE = "CASE {s} WHEN 2 THEN 3 ELSE 2 END"
_NAME = "CASE {s} WHEN 2 THEN 'user' ELSE 'assistant' END"


def _inserts(of: str) -> str:
    """Rows of `of` (state, cost, audit, lines, ...) after none, one or two inserted rows; more never help."""
    one = f"SELECT * REPLACE ({_DUE.format(s='state')} AS state, cost + 3 AS cost, audit || 'I' AS audit, lines || chr(10) || {_NAME.format(s='(' + _DUE.format(s='state') + ')')} || ':' AS lines) FROM "
    return f"SELECT * FROM ({of}) UNION ALL {one} ({of}) UNION ALL {one} ({one} ({of}))"


_KEEPS = "CASE WHEN ini = 's' AND state = 0 THEN 1 WHEN ini = 'u' AND state <> 2 THEN 2 WHEN ini = 'a' AND state = 2 THEN 3 END"
CONVERSATION_REPAIR = f"""WITH RECURSIVE base AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind, dense_rank() OVER (ORDER BY conv_id) AS c FROM conversations),
damaged AS (SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM base WHERE kind <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY c, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen, regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g') AS bare, left(role, 1) AS ini FROM damaged),
faulty AS (SELECT *, CASE WHEN bare = '' THEN 'b' WHEN seen THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(ini) OVER (PARTITION BY c ORDER BY i) AS before FROM numbered),
counted AS (SELECT c, max(i) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY c),
walk AS (SELECT c, 0::BIGINT AS i, 0 AS state, 0 AS cost, '' AS audit, '' AS lines FROM base GROUP BY c UNION ALL
    SELECT c, i, state, CAST(left(min(lpad(cost::VARCHAR, 12, '0') || audit), 12) AS INTEGER) AS cost, substr(min(lpad(cost::VARCHAR, 12, '0') || audit), 13) AS audit, arg_min(lines, lpad(cost::VARCHAR, 12, '0') || audit) AS lines FROM (
    SELECT c, i + 1 AS i, e.state AS state, cost + e.cost AS cost, audit || e.letter AS audit, lines || e.line AS lines FROM (SELECT *, unnest([
        {{'state': state, 'cost': 4, 'letter': 'D', 'line': ''}},
        {{'state': CASE WHEN fault NOT IN ('b', 'd') THEN {_KEEPS} END, 'cost': CASE WHEN fault = 't' THEN 3 ELSE 0 END, 'letter': 'K', 'line': chr(10) || role || ':' || text}},
        {{'state': CASE WHEN fault NOT IN ('b', 'd') THEN {_DUE.format(s='state')} END, 'cost': CASE WHEN fault = 't' THEN 6 ELSE 3 END, 'letter': 'R', 'line': chr(10) || {_NAME.format(s='(' + _DUE.format(s='state') + ')')} || ':' || text}}]) AS e
        FROM ({_inserts("SELECT w.*, f.role, f.text, f.ini, f.fault FROM walk w JOIN faulty f ON f.c = w.c AND f.i = w.i + 1")})) WHERE e.state IS NOT NULL) GROUP BY c, i, state),
ends AS (SELECT c, min(lpad(cost::VARCHAR, 12, '0') || audit) AS best, arg_min(lines, lpad(cost::VARCHAR, 12, '0') || audit) AS lines FROM ({_inserts("SELECT w.* FROM walk w LEFT JOIN counted n ON n.c = w.c WHERE w.i = coalesce(n.rows, 0)")}) WHERE state IN (0, 3) GROUP BY c)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(left(best, 12) AS BIGINT) AS cost, substr(best, 13) AS audit, sha256(substr(lines, 2)) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM base) b JOIN ends e ON e.c = b.c LEFT JOIN counted n ON n.c = b.c"""

ORACLE_SQL = {"op11_spelling_variants": SPELLING_VARIANTS, "op12_conversation_repair": CONVERSATION_REPAIR}
