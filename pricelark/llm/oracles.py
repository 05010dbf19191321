"""SQL of the operators on fill-in-the-middle, chats and conversations, written apart from how the operators work."""

from __future__ import annotations

#: Tokens as a list; parts of it put together again.
SQL_OP11 = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), d AS (
  SELECT *, len(w) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(w) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(w) + 1) AS b, CAST('0x' || h[17:24] AS BIGINT) % 100 AS c, CAST('0x' || h[25:32] AS BIGINT) % 100 AS s FROM t
), f AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 90 THEN 'plain' WHEN s < 20 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(w[1 : least(a, b)], '') AS p, array_to_string(w[least(a, b) + 1 : greatest(a, b)], '') AS m, array_to_string(w[greatest(a, b) + 1 : n], '') AS e FROM d
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || e || '<M>' || m ELSE '<S>' || e || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM f
"""

#: Turns straight from the rows; lengths as the template's escapes make them.
SQL_OP12 = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\#\# ')) AS text_chars,
         length(replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\#\# '), ': ', ':\ ')) AS role_chars FROM r
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(14 + role_chars + text_chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

_DELETE = "CASE WHEN {0} IS NOT NULL THEN {{'x': {0}.x + 2, 'y': {0}.y || 'D'}} END"
_TURN = "CASE WHEN {0} IS NOT NULL AND stays THEN {{'x': {0}.x + extra + CASE WHEN i = '{1}' THEN 0 ELSE 1 END, 'y': {0}.y || CASE WHEN i = '{1}' THEN 'K' ELSE 'R' END}} END"
_INSERT = "CASE WHEN {0} IS NOT NULL THEN {{'x': {0}.x + {2}, 'y': {0}.y || '{1}'}} END"
_SYSTEM = "CASE WHEN a IS NOT NULL AND stays AND i = 's' THEN {'x': a.x + extra, 'y': a.y || 'K'} END"
_KIND = "CAST({} AS STRUCT(x BIGINT, y VARCHAR))"


def _least(*some: str) -> str:
    return _KIND.format(f"list_min(list_filter([{', '.join(some)}], lambda x: x IS NOT NULL))")


_A, _B = _KIND.format(_DELETE.format("a")), _least(_DELETE.format("b"), _SYSTEM)
_C, _D = _least(_DELETE.format("c"), *(_TURN.format(x, "u") for x in "abd")), _least(_DELETE.format("d"), _TURN.format("c", "a"))
_CI, _DI = _least("c", *(_INSERT.format(x, "I", 5) for x in "abd")), _least("d", _INSERT.format("c", "I", 5), _INSERT.format("a", "II", 10), _INSERT.format("b", "II", 10))
_NONE = _KIND.format("NULL")

#: crc32 bit by bit; the fold as a recursion over the rows' places, all conversations at once; the audit read back letter by letter.
SQL_OP13 = rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), c AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(key, ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, CAST(3988292384 AS BIGINT)) ELSE a // 2 END), CAST(4294967295 AS BIGINT)) % 20 AS d FROM k
), m AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN d = 3 THEN [1, 2] ELSE [1] END) AS copy FROM c WHERE d <> 0
), g AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, row_number() OVER o AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen,
         lag(left(role, 1)) OVER o || left(role, 1) AS pair
  FROM m WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), f AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM g
), r AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen) AS n FROM (SELECT * EXCLUDE (n), fault NOT IN ('blank', 'duplicate') AS stays, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra FROM f)
), fold AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, {_KIND.format("{'x': 0, 'y': ''}")} AS a, {_NONE} AS b, {_NONE} AS c, {_NONE} AS d FROM (SELECT DISTINCT conv_id FROM r)
  UNION ALL
  SELECT conv_id, n, {_A}, {_B}, {_C}, {_D}
  FROM (SELECT w.conv_id, r.n, a, b, {_CI} AS c, {_DI} AS d, stays, extra, i FROM fold w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.n = w.n + 1)
), best AS (
  SELECT conv_id, n, {_least("a", "d", _INSERT.format("c", "I", 5), _INSERT.format("a", "II", 10), _INSERT.format("b", "II", 10))} AS e FROM fold
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1
), audit AS (
  SELECT conv_id, e.x AS cost, e.y AS audit FROM best
), letter AS (
  SELECT conv_id, p, substr(audit, CAST(p AS INTEGER), 1) AS l, p - length(replace(substr(audit, 1, CAST(p AS INTEGER)), 'I', '')) AS ins FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS p FROM audit)
), made AS (
  SELECT x.conv_id, p, l, r.role, CASE WHEN l = 'I' THEN '' ELSE r.text END AS text, row_number() OVER (PARTITION BY x.conv_id ORDER BY p) AS place,
         count(*) FILTER (WHERE l = 'K' AND r.i = 's') OVER (PARTITION BY x.conv_id ORDER BY p) AS systems
  FROM letter x LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM x.conv_id AND r.n = x.p - x.ins WHERE l <> 'D'
), fixed AS (
  SELECT conv_id, string_agg(CASE WHEN l = 'K' THEN role WHEN (place - systems) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS text FROM made GROUP BY 1
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(fixed.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN audit ON audit.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN fixed ON fixed.conv_id IS NOT DISTINCT FROM o.conv_id
"""
