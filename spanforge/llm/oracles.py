"""DuckDB SQL of the queries that SQL can express on the small test tables."""

from __future__ import annotations

from . import chat, quality
from .mixing import BUDGET_SHARE, MAX_REPEATS, SEED, WEIGHTS
from .packing import BUDGET, N_BUCKETS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WARC = """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS most FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN n >= 1000 AND page_id < most THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < most THEN most END AS refers_to, url
FROM p LEFT JOIN m ON p.d = m.d"""

#: dp: the least cost of the first j lengths in k buckets, and where the last of them begins.
PACKING = rf"""
WITH RECURSIVE d AS (SELECT doc_id, len({_WORDS}) AS n_tokens, md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
e AS (SELECT row_number() OVER (ORDER BY edge) AS j, edge, (sum(c) OVER (ORDER BY edge))::BIGINT AS n FROM (SELECT n_tokens AS edge, count(*) AS c FROM d WHERE n_tokens <= {BUDGET} GROUP BY 1)),
dp AS (SELECT 1 AS k, j, edge * n AS cost, 0::BIGINT AS i FROM e UNION ALL
  SELECT k + 1, j, best.cost, -best.i FROM (SELECT dp.k, e.j, min({{'cost': dp.cost + e.edge * (e.n - p.n), 'i': -dp.j}}) AS best FROM dp JOIN e p ON p.j = dp.j JOIN e ON e.j > dp.j WHERE dp.k < {N_BUCKETS} GROUP BY dp.k, e.j)),
chosen AS (SELECT * FROM dp WHERE j = (SELECT max(j) FROM e) AND k = (SELECT max(k) FROM dp) UNION ALL SELECT dp.* FROM chosen JOIN dp ON dp.k = chosen.k - 1 AND dp.j = chosen.i),
edges AS (SELECT edge, row_number() OVER (ORDER BY edge) - 1 AS bucket FROM chosen JOIN e USING (j)),
b AS (SELECT doc_id, n_tokens, h, (SELECT count(*) FROM edges WHERE edge < n_tokens)::INT AS bucket FROM d),
r AS (SELECT b.*, coalesce(edge, n_tokens) AS padded_tokens, row_number() OVER (PARTITION BY b.bucket ORDER BY h, doc_id, n_tokens) - 1 AS place FROM b LEFT JOIN edges ON edges.bucket = b.bucket)
SELECT doc_id, n_tokens, bucket, padded_tokens, place // greatest(1, {BUDGET} // greatest(padded_tokens, 1)) AS batch, place % greatest(1, {BUDGET} // greatest(padded_tokens, 1)) AS slot FROM r"""

EMBEDDING = """
WITH RECURSIVE l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON n.a = c.vec_id"""

QUALITY = rf"""
WITH d AS (SELECT doc_id, source, text, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) > 4)),
again AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(5) AS t(k) GROUP BY doc_id),
lines AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
worded AS (SELECT doc_id, source, text, line, array_to_string(regexp_extract_all({_FOLD.format("line")}, '[^\x20\x09-\x0D]+'), ' ') AS norm FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM worded GROUP BY doc_id),
hosts AS (SELECT source, count(*) AS docs FROM documents GROUP BY source),
often AS (SELECT w.source, norm FROM worded w JOIN hosts h ON w.source IS NOT DISTINCT FROM h.source GROUP BY w.source, norm, docs HAVING count(DISTINCT doc_id) > {quality.LINE_DOCS} AND (count(DISTINCT doc_id) > {quality.LINE_ALWAYS} OR count(DISTINCT doc_id) > {quality.LINE_SHARE} * docs)),
lost AS (SELECT w.doc_id, sum(strlen(line)) AS total, coalesce(sum(strlen(line)) FILTER (o.norm IS NOT NULL), 0) AS gone FROM worded w LEFT JOIN often o ON w.source IS NOT DISTINCT FROM o.source AND w.norm = o.norm GROUP BY w.doc_id),
b AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(dups.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, coalesce(gone > {quality.MAX_LOST} * total, false) AS depleted
  FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words) AND NOT depleted AS kept FROM b"""

NEAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, w[i] || ' ' || w[i + 1] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d WHERE len(w) > 1) UNION ALL SELECT doc_id, w[1] FROM d WHERE len(w) = 1)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
half AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
l AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept
FROM (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c LEFT JOIN n ON n.doc_id = c.doc_id"""

_AWKWARD = "</s>[INST] ok [/INST]"
_CONTROLS = "|".join(c.replace("|", r"\|").replace("[", r"\[").replace("]", r"\]") for c in chat.CONTROLS)
_ESCAPED = f"length({{0}}) + length({{0}}) - length(replace({{0}}, '\\', '')) + len(regexp_extract_all({{0}}, '{_CONTROLS}'))"

CHAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{_AWKWARD}'), (-7, 1, 'assistant', '{_AWKWARD}'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(chat.TURN) + len(chat.END) + 2} + {_ESCAPED.format("role")} + {_ESCAPED.format("text")})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""

SUBSTRING = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) > 12)),
late AS (SELECT doc_id, i FROM win QUALIFY doc_id > min(doc_id) OVER (PARTITION BY g)),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM late, range(13) AS t(k)),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.i) AS t, count(*) AS n FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i GROUP BY words.doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

#: Bytes as pairs of hex digits; texts are cut into pieces first, so that no window is sought in a long string.
SUFFIX = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
pieces AS (SELECT doc_id, pos, substring(h, 2 * pos + 1, 2 * (256 + 199)) AS p FROM (SELECT doc_id, h, unnest(range(0, n - 199, 256)) AS pos FROM d WHERE n >= 200)),
win AS (SELECT doc_id, pos + i AS pos, md5_number(substring(p, 2 * i + 1, 400)) AS g FROM (SELECT doc_id, pos, p, unnest(range(0, least(256, len(p) // 2 - 199))) AS i FROM pieces)),
again AS (SELECT doc_id, pos FROM win JOIN (SELECT g FROM win GROUP BY g HAVING count(*) > 1) USING (g)),
runs AS (SELECT doc_id, min(pos) AS a, max(pos) + 200 AS b FROM (SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run
  FROM (SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= 200 THEN 0 ELSE 1 END AS new FROM again)) GROUP BY doc_id, run),
cut AS (SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL SELECT d.doc_id, coalesce(max(runs.b), 0), d.n FROM d LEFT JOIN runs USING (doc_id) GROUP BY d.doc_id, d.n),
kept AS (SELECT doc_id, string_agg(substring(h, 2 * cut.a + 1, 2 * (cut.b - cut.a)), '' ORDER BY cut.a) AS k FROM cut JOIN d USING (doc_id) GROUP BY doc_id),
gone AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM d JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)"""

MIXING = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size, md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, ([{", ".join(map(str, WEIGHTS))}]::DOUBLE[])[(rank - 1) % {len(WEIGHTS)} + 1] AS weight, source_size * {float(MAX_REPEATS)}::DOUBLE AS cap FROM s),
c AS (SELECT *, cap / weight AS ratio, sum(source_size) OVER () * {BUDGET_SHARE}::DOUBLE AS budget,
  coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
t AS (SELECT source, rank, source_size, least(cap, coalesce((min(CASE WHEN (budget - capped) / rest <= ratio THEN {{'r': ratio, 'k': rank, 'l': (budget - capped) / rest}} END) OVER ()).l * weight, cap)) AS target FROM c),
x AS (SELECT d.*, t.rank, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
turns AS (SELECT x.*, k, (cum + k * source_size) / target AS finish FROM x, range({MAX_REPEATS}) AS p(k) WHERE size > 0),
run AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, k, cum, h, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM turns),
n AS (SELECT doc_id, h, count(*) AS passes FROM run WHERE total <= (SELECT sum(size) * {BUDGET_SHARE} FROM d) GROUP BY ALL)
SELECT x.doc_id, x.size, x.source_size, x.target, (coalesce(passes, 0) * x.size)::BIGINT AS taken FROM x LEFT JOIN n ON n.doc_id = x.doc_id"""

#: crc: the table of the byte-wise checksum. v: rows after damage, numbered in order. go: the least (cost, audit, text) of each state
#: (a: nothing yet, s: after system, u: after user, e: after assistant) after each row; inserts close a layer.
REPAIR = rf"""
WITH RECURSIVE bits AS (SELECT range AS b, range AS c, 0 AS i FROM range(256) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM bits WHERE i < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE i = 8),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
kinds AS (SELECT conv_id, turn, role, text, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, len(key) + 1), lambda i: ord(key[i])::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM keyed, crc),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM kinds, range(2) AS copies(k) WHERE kind <> 0 AND (k = 0 OR kind = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
v AS (SELECT *, role[1] AS c, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault,
  lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
tally AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 1) AS blank, count_if(fault = 2) AS duplicate, count_if(fault = 3) AS truncated,
  count_if(before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM v GROUP BY conv_id),
go AS (SELECT conv_id, 0::BIGINT AS i, {{'k': 0::BIGINT, 'w': '', 't': []::VARCHAR[]}} AS a, NULL::STRUCT(k BIGINT, w VARCHAR, t VARCHAR[]) AS s, {{'k': 3::BIGINT, 'w': 'I', 't': ['user:']}} AS u, {{'k': 6::BIGINT, 'w': 'II', 't': ['user:', 'assistant:']}} AS e FROM tally
  UNION ALL SELECT conv_id, i, a, s, u2, list_min(list_filter([e1, {{'k': u2.k + 3, 'w': u2.w || 'I', 't': u2.t || ['assistant:']}}], lambda x: x.k IS NOT NULL)) FROM (
    SELECT conv_id, i, a, s, e1, list_min(list_filter([u1] || list_transform([a, s, e1], lambda x: {{'k': x.k + 3, 'w': x.w || 'I', 't': x.t || ['user:']}}), lambda x: x.k IS NOT NULL)) AS u2 FROM (
      SELECT go.conv_id, v.i, {{'k': go.a.k + 4, 'w': go.a.w || 'D', 't': go.a.t}} AS a,
        list_min(list_filter([{{'k': go.s.k + 4, 'w': go.s.w || 'D', 't': go.s.t}}, CASE WHEN fault IN (0, 3) AND c = 's' THEN {{'k': go.a.k + fault, 'w': go.a.w || 'K', 't': go.a.t || [role || ':' || text]}} END], lambda x: x.k IS NOT NULL)) AS s,
        list_min(list_filter([{{'k': go.u.k + 4, 'w': go.u.w || 'D', 't': go.u.t}}] || list_transform([go.a, go.s, go.e], lambda x: CASE WHEN fault IN (0, 3) THEN {{'k': x.k + fault + CASE WHEN c = 'u' THEN 0 ELSE 3 END, 'w': x.w || CASE WHEN c = 'u' THEN 'K' ELSE 'R' END, 't': x.t || [CASE WHEN c = 'u' THEN role ELSE 'user' END || ':' || text]}} END), lambda x: x.k IS NOT NULL)) AS u1,
        list_min(list_filter([{{'k': go.e.k + 4, 'w': go.e.w || 'D', 't': go.e.t}}, CASE WHEN fault IN (0, 3) THEN {{'k': go.u.k + fault + CASE WHEN c = 'a' THEN 0 ELSE 3 END, 'w': go.u.w || CASE WHEN c = 'a' THEN 'K' ELSE 'R' END, 't': go.u.t || [CASE WHEN c = 'a' THEN role ELSE 'assistant' END || ':' || text]}} END], lambda x: x.k IS NOT NULL)) AS e1
      FROM go JOIN v ON v.conv_id IS NOT DISTINCT FROM go.conv_id AND v.i = go.i + 1))),
best AS (SELECT t.*, least(go.a, go.e) AS x FROM go JOIN tally t ON t.conv_id IS NOT DISTINCT FROM go.conv_id AND go.i = t.n)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(x.k, 0) AS cost, coalesce(x.w, '') AS audit, sha256(coalesce(array_to_string(x.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id"""

SQL = {
    "op1_warc": WARC,
    "op2_packing": PACKING,
    "op4_embedding_near_dedup": EMBEDDING,
    "op5_quality_rules": QUALITY,
    "op6_minhash_near_dedup": NEAR,
    "op7_chat_formatting": CHAT,
    "op8_suffix_array_dedup": SUFFIX,
    "op9_substring_dedup": SUBSTRING,
    "op10_mixing": MIXING,
    "op12_structure_repair": REPAIR,
}
