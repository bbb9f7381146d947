"""DuckDB SQL for the queries that SQL can express.

The other queries (sampled draws and fitted models, hashes that SQL engines lack, iterated links) are compared
with brute force in tests/llm.
"""

from __future__ import annotations

import string

from panelforge.llm import pii, urls

LOWER = f"translate({{}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


CONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, {WORDS}) AS ws FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all({LOWER.format("coalesce(text, '')")}, {WORDS}) AS ws FROM benchmark),
windows AS (SELECT DISTINCT item, least(13, len(ws)) AS size, ws[i:i + least(13, len(ws)) - 1] AS gram FROM items, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) t(i) WHERE len(ws) > 0),
seen AS (SELECT rid, i, size, ws[i:i + size - 1] AS gram FROM d, (SELECT DISTINCT size FROM windows), unnest(range(1, len(ws) - size + 2)) t(i)),
hits AS (SELECT rid, i, s.size, item FROM seen s JOIN windows w ON s.size = w.size AND s.gram = w.gram),
words AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + size)) FROM hits) GROUP BY rid),
held AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words ON d.rid = words.rid LEFT JOIN held ON d.rid = held.rid"""


def _located(source: str, text: str, pattern: str, extra: str, shift: str = "0") -> str:
    """Matches of a pattern with their places, from the gaps between them. ``extra`` columns (rid among them) are passed on."""
    return f"""(SELECT * EXCLUDE (gap), {shift} + sum(length(gap) + length(value)) OVER w - length(value) AS mstart, {shift} + sum(length(gap) + length(value)) OVER w AS mend
  FROM (SELECT {extra}, i, ms[i] AS value, gaps[i] AS gap FROM (SELECT {extra}, regexp_extract_all({text}, {_quoted(pattern)}) AS ms, string_split_regex({text}, {_quoted(pattern)}) AS gaps FROM {source}), unnest(range(1, len(ms) + 1)) t(i))
  WINDOW w AS (PARTITION BY {extra} ORDER BY i))"""


# The patterns as they are given, without the guards that keep Java's matcher linear.
_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
_LUHN = "list_sum(list_transform(range(1, len(digits) + 1), lambda p: CASE WHEN (len(digits) - p) % 2 = 1 THEN 2 * CAST(digits[p] AS INTEGER) - CASE WHEN CAST(digits[p] AS INTEGER) > 4 THEN 9 ELSE 0 END ELSE CAST(digits[p] AS INTEGER) END)) % 10 = 0"
_VALID = f"""CASE kind WHEN 'ip' THEN regexp_full_match(value, {_quoted(pii.PART + '(?:' + chr(92) + '.' + pii.PART + '){3}')}) WHEN 'card' THEN len(digits) BETWEEN 14 AND 19 AND {_LUHN} WHEN 'phone' THEN len(digits) BETWEEN 10 AND 15 ELSE true END"""
_RULE = pii.Disclosure()
_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
PERSONAL_DATA = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, t FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM documents)),
found AS ({" UNION ALL ".join(f"SELECT rid, {i} AS kno, '{k}' AS kind, value, mstart, mend FROM {_located('d', 't', p, 'rid')}" for i, (k, p) in enumerate(_PATTERNS.items()))}),
ent AS (SELECT * FROM (SELECT *, {_DIGITS} AS digits FROM found) WHERE {_VALID}),
ctx AS (SELECT e.rid, kind || ':' || CASE WHEN kind IN ('card', 'phone') THEN digits ELSE {LOWER.format("value")} END AS entity, CAST(mstart AS BIGINT) AS es, CAST(mend AS BIGINT) AS ee,
    substring(t, CAST(greatest(mstart - {_RULE.near + 1}, 0) AS BIGINT) + 1, CAST(mstart - greatest(mstart - {_RULE.near + 1}, 0) AS BIGINT)) AS b, substring(t, CAST(mend AS BIGINT) + 1, {_RULE.near + 1}) AS a
  FROM ent e JOIN d ON e.rid = d.rid),
near AS (SELECT rid, entity, {LOWER.format("value")} AS term, mstart, mend FROM {_located('ctx', 'b', _TERM, 'rid, entity, es, ee, b', 'es - length(b)')} WHERE NOT (length(b) > {_RULE.near} AND mstart = es - length(b))
  UNION ALL SELECT rid, entity, {LOWER.format("value")}, mstart, mend FROM {_located('ctx', 'a', _TERM, 'rid, entity, es, ee, a', 'ee')} WHERE NOT (length(a) > {_RULE.near} AND mend = ee + length(a))),
pairs AS (SELECT entity, term, count(DISTINCT rid) AS n_et FROM near GROUP BY 1, 2 HAVING count(DISTINCT rid) >= {_RULE.support}),
n_ent AS (SELECT entity, count(DISTINCT rid) AS n_e FROM ctx GROUP BY 1),
dfs AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT rid, unnest(regexp_extract_all({LOWER.format("t")}, {_quoted(_TERM)})) AS term FROM d) WHERE term IN (SELECT term FROM pairs) GROUP BY 1),
told AS (SELECT p.entity, p.term FROM pairs p JOIN dfs ON p.term = dfs.term JOIN n_ent n ON p.entity = n.entity, (SELECT CAST(count(*) AS DOUBLE) AS n_docs FROM d)
  WHERE ln(n_docs / n_e) > 0 AND ln(n_et * n_docs / (n_e * df)) / ln(n_docs / n_e) >= {_RULE.generalise}),
tellers AS (SELECT DISTINCT ctx.rid, term FROM ctx JOIN told ON ctx.entity = told.entity),
telling AS (SELECT rid, t FROM d WHERE rid IN (SELECT rid FROM tellers)),
words AS (SELECT rid, {LOWER.format("value")} AS term, mstart, mend FROM {_located('telling', 't', _TERM, 'rid, t')}),
hits AS (SELECT DISTINCT near.rid, mstart, mend FROM near JOIN told ON near.entity = told.entity AND near.term = told.term
  UNION SELECT words.rid, mstart, mend FROM words JOIN tellers ON words.rid = tellers.rid AND words.term = tellers.term),
terms AS (SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM ent e WHERE e.rid = h.rid AND h.mstart < e.mend AND e.mstart < h.mend)),
spans AS (SELECT rid, kno, kind, CAST(mstart AS BIGINT) AS s, CAST(mend AS BIGINT) AS e FROM ent UNION ALL SELECT rid, 4, 'term', CAST(mstart AS BIGINT), CAST(mend AS BIGINT) FROM terms),
out AS (SELECT rid, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in pii.KINDS)},
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kno, e) FILTER (WHERE kno < 4), '') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kno, e) AS spans FROM spans GROUP BY rid)
SELECT o.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents o LEFT JOIN d ON o.doc_id IS NOT DISTINCT FROM d.doc_id AND coalesce(o.text, '') = d.t LEFT JOIN out ON d.rid = out.rid"""


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(_quoted(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


_HOSTS = _values([(r, a, r.partition("/")[0], "/" + r.partition("/")[2]) for r, a in urls.HOST_RULES])
_WILDCARDS = _values([(p, a, urls.compile_pattern(p)[0]) for p, a in urls.PATTERNS])
URLS = f"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, url, {LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
h AS (SELECT * FROM (VALUES {_HOSTS}) t(rule, action, rule_host, rule_path)),
w AS (SELECT * FROM (VALUES {_WILDCARDS}) t(rule, action, expression)),
fits AS (SELECT rid, rule, action, 1 AS tier FROM p JOIN h ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  UNION ALL SELECT rid, rule, action, 0 FROM p JOIN w ON regexp_matches({LOWER.format("url")}, expression)),
best AS (SELECT * FROM fits QUALIFY row_number() OVER (PARTITION BY rid ORDER BY tier DESC, length(rule) DESC, rule DESC) = 1)
SELECT page_id, host, path, CASE WHEN tier = 1 THEN rule END AS rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN best ON p.rid = best.rid"""

_SAID = "'\\### Assistant: </turn> ok'"
_ESCAPED = r"regexp_replace(replace({}, '\', '\\'), '<(/?turn)', '<\\\1', 'g')"
CHAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', {_SAID}), (-7, 1, 'assistant', {_SAID}))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<turn ' || replace({_ESCAPED.format("role")}, '>', '\\>') || '>' || chr(10) || {_ESCAPED.format("text")} || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""

def _moves() -> str:
    """(state, state after, cost, letters, initial that the row needs, row may stay): up to two insertions, then an edit of the next row."""
    states = {0: "su", 1: "u", 2: "a", 3: "u"}
    after = {"s": 1, "u": 2, "a": 3}
    rows = []
    for q in states:
        reach, j = [(q, 0, "")], q
        for n in (1, 2):
            j = 3 if j == 2 else 2
            if j != q:
                reach.append((j, 2 * n, "I" * n))
        for j, cost, letters in reach:
            rows.append((q, j, cost + 3, letters + "D", "", False))
            for role in states[j]:
                rows.append((q, after[role], cost, letters + "K", role, True))
                if role != "s":
                    rows.append((q, after[role], cost + 2, letters + "R", "", True))
            rows.append((q, j, cost, letters, "end", False))
    return _values(rows)


_SPACES = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
REPAIR = f"""
WITH RECURSIVE bits AS (SELECT i, 0 AS n, CAST(i AS BIGINT) AS v FROM range(256) t(i) UNION ALL SELECT i, n + 1, xor(v >> 1, 3988292384 * (v & 1)) FROM bits WHERE n < 8),
crc AS (SELECT list(v ORDER BY i) AS tab FROM bits WHERE n = 8),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS key FROM conversations),
f AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295], [CAST(ascii(c) AS BIGINT) FOR c IN string_split(key, '')]), lambda a, b: xor(a >> 8, tab[1 + (xor(a, b) & 255)])), 4294967295) % 20 AS fault FROM k, crc),
d AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM f, unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) t(copy) WHERE fault <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, rtrim(text, {_SPACES}) AS body, left(role, 1) AS initial FROM d),
r AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  pos > 1 AND lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial NOT IN ('su', 'ua', 'au') AS odd FROM p),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE odd) AS illegal, max(pos) AS n FROM r GROUP BY conv_id),
moves(q, nxt, cost, letters, need, stays) AS (VALUES {_moves()}),
rec AS (SELECT conv_id, CAST(0 AS BIGINT) AS pos, 0 AS q, '000000000' AS best FROM facts
  UNION ALL SELECT r.conv_id, r.pos, m.nxt, min(lpad(CAST(CAST(best[1:9] AS INTEGER) + m.cost + CASE WHEN m.stays AND fault = 'truncated' THEN 1 ELSE 0 END AS VARCHAR), 9, '0') || best[10:] || m.letters)
  FROM rec JOIN r ON rec.conv_id IS NOT DISTINCT FROM r.conv_id AND r.pos = rec.pos + 1 JOIN moves m ON m.q = rec.q AND m.need <> 'end' AND (NOT m.stays OR fault NOT IN ('blank', 'duplicate') AND (m.need = '' OR m.need = r.initial)) GROUP BY 1, 2, 3),
best AS (SELECT facts.conv_id, min(lpad(CAST(CAST(best[1:9] AS INTEGER) + m.cost AS VARCHAR), 9, '0') || best[10:] || m.letters) AS best
  FROM facts JOIN rec ON facts.conv_id IS NOT DISTINCT FROM rec.conv_id AND rec.pos = n JOIN moves m ON m.q = rec.q AND m.need = 'end' AND m.nxt IN (0, 3) GROUP BY facts.conv_id),
letters AS (SELECT conv_id, i, best[9 + i:9 + i] AS letter, length(replace(best[10:], 'D', '')) AS size FROM best, unnest(range(1, length(best) - 8)) t(i)),
edits AS (SELECT *, sum(CAST(letter <> 'I' AS INTEGER)) OVER w AS pos, sum(CAST(letter <> 'D' AS INTEGER)) OVER w AS nth FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
said AS (SELECT e.conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (nth - size % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS lines
  FROM edits e LEFT JOIN r ON e.conv_id IS NOT DISTINCT FROM r.conv_id AND e.pos = r.pos WHERE letter <> 'D' GROUP BY e.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(best[1:9] AS BIGINT), 0) AS cost, coalesce(best[10:], '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts ON c.conv_id IS NOT DISTINCT FROM facts.conv_id LEFT JOIN best ON c.conv_id IS NOT DISTINCT FROM best.conv_id LEFT JOIN said ON c.conv_id IS NOT DISTINCT FROM said.conv_id"""

NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same, CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score FROM v a JOIN v r ON a.vec_id % 100 = 0 AND len(a.q) = len(r.q)),
pos AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same AND other_id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
neg AS (SELECT p.anchor_id, positive_id, positive_score, other_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
  FROM pos p JOIN s ON p.anchor_id = s.anchor_id WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 5"""

ORACLES: dict[str, str] = {
    "op1_decontaminate": CONTAMINATION,
    "op3_personal_data": PERSONAL_DATA,
    "op6_url_filter": URLS,
    "op9_chat_format": CHAT,
    "op11_repair_conversations": REPAIR,
    "op12_hard_negatives": NEGATIVES,
}
