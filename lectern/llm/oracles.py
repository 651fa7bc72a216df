"""SQL that gives the same rows as some of the queries, for DuckDB over the same tables."""

from __future__ import annotations

from lectern.llm import chat, decontam

#: All conversations, and the planted one.
_CONTROLS = r"\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>"
_MARKS = " ".join(f"WHEN '{role}' THEN {len(p.opening) + len(p.closing)}" for role, p in chat.INSTRUCT.parts.items())

CHAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
t AS (SELECT *, length(text) + len(regexp_extract_all(text, '{_CONTROLS}')) + CASE role {_MARKS}
    ELSE 8 + length(role) + len(regexp_extract_all(role, '{_CONTROLS}')) + len(regexp_extract_all(role, '\\n')) END AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

SUBSTRINGS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM d WHERE n >= 50)),
m AS (SELECT g, min(doc_id) AS first FROM w GROUP BY g),
r AS (SELECT w.doc_id, p FROM w JOIN m USING (g) WHERE first < w.doc_id),
s AS (SELECT doc_id, p, max(p + 50) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
i AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM s),
sp AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY doc_id, k),
kept AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t FROM sp UNION ALL SELECT doc_id, max(b), NULL FROM sp GROUP BY doc_id),
hx AS (SELECT doc_id, string_agg(CASE WHEN t IS NULL THEN substr(h, 2 * f + 1) ELSE substr(h, 2 * f + 1, 2 * (t - f)) END, '' ORDER BY f) AS hx FROM kept JOIN d USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM sp GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(hx, h))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN hx USING (doc_id)
"""

#: The supplied pages hold their article in an element of that name, in headings and paragraphs, and few kinds of references.
PAGES = """
WITH a AS (SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(p|h1|h2|h3|div)>') AS parts FROM pages),
b AS (SELECT page_id, url, list_transform(parts, lambda p: replace(replace(replace(replace(replace(regexp_replace(replace(p, '<br>', ' '), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) AS parts FROM a),
c AS (SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g'), ' ')), lambda p: p <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM c
"""

#: CRC-32 of the decimal digits of conv_id, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

TRIE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, list(sha256(length(role) || ':' || role || text) ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS k,
  list(octet_length(encode(text)) ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS b FROM t GROUP BY conv_id),
h AS (SELECT *, {_CRC} % 9 AS h FROM s),
r AS (SELECT h.conv_id, list_concat(coalesce(base.k[1:h.h], []), h.k[h.h + 1:]) AS k, list_concat(coalesce(base.b[1:h.h], []), h.b[h.h + 1:]) AS b FROM h LEFT JOIN s base ON base.conv_id = h.conv_id - h.conv_id % 5),
m AS (SELECT conv_id, d, array_to_string(k[1:d], '') AS p, coalesce(b[d], 0) AS size, d = len(k) AS ended FROM r, unnest(range(0, len(k) + 1)) AS u(d)),
n AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * max(size) AS saved, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended) AS ends FROM m GROUP BY p, d),
c AS (SELECT substr(p, 1, 64 * (d - 1)) AS p, count(*) AS children FROM n WHERE d > 0 GROUP BY 1),
e AS (SELECT n.*, coalesce(children, 0) AS children FROM n LEFT JOIN c USING (p)),
a AS (SELECT substr(p, 1, 64 * k) AS p, sum(saved) AS saved, count(*) FILTER (children = 0) AS leaves FROM e, unnest(range(0, d + 1)) AS u(k) GROUP BY 1)
SELECT e.conv_id, e.d AS depth, up.conv_id AS parent_conv_id, e.n AS n_convs, e.children AS n_children, a.leaves AS n_leaves, a.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ends, '')) AS ends_sha256
FROM e JOIN a USING (p) LEFT JOIN n up ON up.p = substr(e.p, 1, 64 * (e.d - 1)) AND up.d = e.d - 1
"""

INFILL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
r AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, '<P>' || substr(text, 1, a) AS x, '<M>' || substr(text, a + 1, b - a) AS y, '<S>' || substr(text, b + 1) AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN z || x || y ELSE x || z || y END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""

_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINES = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM d),
k AS (SELECT *, translate(trim(line, {_WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

ORACLES = {"op11_prefix_trie": TRIE, "op13_lines": LINES, "op12_infill": INFILL, "op3_html": PAGES, "op5_chat": CHAT, "op9_substrings": SUBSTRINGS, "op10_decontamination": decontam.ORACLE}
