"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from somatlas.llm.chat import CLOSE, OPEN, SEP
from somatlas.llm.revisit import TRACKING_PARAMETERS

# CRC-32, reflected: a table of 256 remainders by eight shift steps each, then one look-up a byte.
_CRC = """
bits AS (SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
crc AS (SELECT d.*, CASE WHEN strlen(coalesce(text, '')) = 0 THEN 0 ELSE xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(rtrim(regexp_replace(hex(encode(text)), '(..)', '\\1 ', 'g')), ' '), lambda h: CAST('0x' || h AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) END AS crc32 FROM documents d CROSS JOIN bits)
"""

_SHARD = "(SELECT arg_max(s, (-1.0 / ln((CAST('0x' || substr(md5(s || ':' || coalesce(CAST(doc_id AS VARCHAR), chr(0) || 'null')), 1, 13) AS BIGINT) + 1) / 4503599627370497.0), -s)) FROM range({n}) r(s))"

RENDEZVOUS = f"""
WITH {_CRC}, placed AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, crc32, {_SHARD.format(n=16)} AS shard, {_SHARD.format(n=17)} AS grown FROM crc)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, crc32, size) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM placed
"""

_ESC = "replace(replace(replace({c}, '\\', '\\b'), '" + CLOSE + "', '\\e'), '" + OPEN + "', '\\h')"
_SAYING = "'\\### Assistant: </turn> ok'"

CHAT = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -7, 0, 'user', {_SAYING}, 'user', {_SAYING} UNION ALL SELECT -7, 1, 'assistant', {_SAYING}, 'assistant', {_SAYING})
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(OPEN + SEP + CLOSE) + 1} + length(replace({_ESC.format(c="role")}, '{SEP}', '\\c')) + length({_ESC.format(c="text")})) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""

_PLAIN = "(code IN (45, 46, 95, 126) OR code BETWEEN 48 AND 57 OR code BETWEEN 65 AND 90 OR code BETWEEN 97 AND 122)"


def _percent(c: str) -> str:
    code = "CAST('0x' || s[1:2] AS INTEGER)"
    return f"array_to_string(list_transform(string_split({c}, '%'), lambda s, i: CASE WHEN i = 1 THEN s WHEN regexp_matches(s, '^[0-9A-Fa-f]{{2}}') THEN (CASE WHEN {_PLAIN.replace('code', code)} THEN chr({code}) ELSE '%' || upper(s[1:2]) END) || s[3:] ELSE '%' || s END), '')"


_STEP = "CASE WHEN x[1] = '.' THEN acc WHEN x[1] = '..' THEN (CASE WHEN len(acc) > 1 THEN acc[1:len(acc) - 1] ELSE acc END) ELSE list_concat(acc, x) END"
_DOTS = f"array_to_string(list_reduce([CAST([] AS VARCHAR[])] || list_transform(string_split(p, '/'), lambda s: [s]) || (CASE WHEN string_split(p, '/')[-1] IN ('.', '..') THEN [['']] ELSE [] END), lambda acc, x: {_STEP}), '/')"

REVISITS = f"""
WITH pg AS (SELECT page_id AS n, url, md5(coalesce(html, '')) AS digest, lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') AS day, CAST(page_id // 4 AS VARCHAR) AS g FROM pages),
caps AS (
  SELECT n, 0 AS visit, url, n * 10 AS seen, digest, [{{'k': 'etag', 'v': digest}}, {{'k': 'content-type', 'v': 'text/html'}}, {{'k': 'cache-control', 'v': 'max-age=60'}}] AS h FROM pg
  UNION ALL SELECT n, 1, url, n * 10 + 1, digest, [{{'k': 'etag', 'v': 'W/' || digest}}, {{'k': 'content-type', 'v': 'text/plain'}}, {{'k': 'date', 'v': day}}] FROM pg
  UNION ALL SELECT n, 2, url, n * 10 + 2, digest, CASE WHEN n % 3 = 0 THEN [{{'k': 'etag', 'v': 'other'}}] ELSE [{{'k': 'expires', 'v': day}}] END FROM pg
  UNION ALL SELECT n, 3, url, -1, digest, [{{'k': 'date', 'v': day}}] FROM pg WHERE n % 5 = 0
  UNION ALL SELECT n, 4, s, n * 10 + 3, digest, CASE WHEN n % 2 = 0 THEN [{{'k': 'etag', 'v': digest}}, {{'k': 'vary', 'v': 'accept'}}] ELSE [{{'k': 'last-modified', 'v': day}}, {{'k': 'server', 'v': 's'}}] END FROM (SELECT *, CASE WHEN n % 2 = 0 THEN 'https://www.Archive.example/v/~' || g ELSE 'HTTP://archive.example:80/old/../v/./%7e' || g || '/?utm_source=feed#top' END AS s FROM pg)
  UNION ALL SELECT n, 5, s, n * 10 + 15, digest, CASE WHEN n % 2 = 0 THEN [{{'k': 'etag', 'v': digest}}, {{'k': 'last-modified', 'v': day}}] ELSE [{{'k': 'last-modified', 'v': day}}, {{'k': 'content-location', 'v': '/c'}}] END FROM (SELECT *, CASE WHEN n % 2 = 0 THEN 'https://www.Archive.example/v/~' || g ELSE 'HTTP://archive.example:80/old/../v/./%7e' || g || '/?utm_source=feed#top' END AS s FROM pg)
  UNION ALL SELECT n, 6, s, n * 10 + 16, digest, [{{'k': 'vary', 'v': '*'}}, {{'k': 'server', 'v': 't'}}] FROM (SELECT *, CASE WHEN n % 2 = 0 THEN 'https://www.Archive.example/v/~' || g ELSE 'HTTP://archive.example:80/old/../v/./%7e' || g || '/?utm_source=feed#top' END AS s FROM pg)),
u1 AS (SELECT *, regexp_replace(trim(url), '#.*$', '') AS u FROM caps),
u2 AS (SELECT *, regexp_matches(u, '(?i)^https://') AS secure, regexp_replace(u, '(?i)^https?://(www\\.)?', '') AS r FROM u1),
u3 AS (SELECT *, regexp_replace(lower(regexp_extract(r, '^[^/?]*')), CASE WHEN secure THEN ':443$' ELSE ':80$' END, '') AS host, {_percent("regexp_extract(r, '^[^/?]*([^?]*)', 1)")} AS p, list_filter(string_split({_percent("regexp_extract(r, '^[^?]*[?](.*)$', 1)")}, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^({TRACKING_PARAMETERS})(=|$)')) AS q FROM u2),
u4 AS (SELECT *, {_DOTS} AS path, array_to_string(q, '&') AS query FROM u3),
c AS (SELECT n * 8 + visit AS capture_id, seen, digest, h, visit NOT IN (0, 4) AS rv, CASE WHEN url IS NULL THEN NULL WHEN query = '' THEN host || regexp_replace(path, '/$', '') ELSE host || path || '?' || query END AS canonical,
  list_filter(h, lambda e: e.k = 'etag')[1].v AS etag, list_filter(h, lambda e: e.k = 'last-modified')[1].v AS lm FROM u4),
line AS (SELECT *, last_value(CASE WHEN NOT rv THEN {{'id': capture_id, 'd': digest, 'h': h, 'etag': etag, 'lm': lm}} END IGNORE NULLS) OVER w AS o FROM c
  WINDOW w AS (PARTITION BY canonical ORDER BY seen, capture_id, rv ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
judged AS (SELECT *, CASE WHEN canonical IS NULL OR o IS NULL THEN 'no_original'
  WHEN CASE WHEN etag IS NOT NULL THEN regexp_replace(etag, '^W/', '') IS NOT DISTINCT FROM regexp_replace(o.etag, '^W/', '') WHEN lm IS NOT NULL THEN lm IS NOT DISTINCT FROM o.lm ELSE digest = o.d END THEN 'resolved' ELSE 'validator_mismatch' END AS status,
  list_filter(h, lambda e: e.k IN ('cache-control', 'content-location', 'date', 'etag', 'expires', 'vary') OR (e.k = 'last-modified' AND etag IS NULL)) AS new FROM line WHERE rv),
merged AS (SELECT *, CASE WHEN status = 'resolved' THEN list_filter(o.h, lambda e: NOT list_contains(list_transform(new, lambda x: x.k), e.k)) || new ELSE h END AS out FROM judged)
SELECT capture_id, canonical, CASE WHEN canonical IS NOT NULL THEN o.id END AS original_id, status, CASE WHEN status = 'resolved' THEN o.d ELSE digest END AS digest,
  array_to_string(list_sort(list_transform(out, lambda e: e.k || '=' || e.v)), ';') AS headers
FROM merged
"""

_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, row_number() OVER () AS no, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item, no, l, q, array_to_string(list_slice(w, q, q + l - 1), ' ') AS g FROM (SELECT item, no, w, l, unnest(range(1, len(w) - l + 2)) AS q FROM (SELECT *, least(13, len(w)) AS l FROM b WHERE len(w) > 0))),
dw AS (SELECT doc_id, l, p, array_to_string(list_slice(w, p, p + l - 1), ' ') AS g FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)),
hits AS (SELECT dw.doc_id, dw.p, bw.item, bw.no, bw.q, bw.l FROM dw JOIN bw ON dw.l = bw.l AND dw.g = bw.g),
n AS (SELECT doc_id, count(DISTINCT p + o) AS n_hit FROM (SELECT doc_id, p, unnest(range(l)) AS o FROM hits) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256,
  coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest_match
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN (SELECT doc_id, max(m) AS longest FROM (SELECT doc_id, no, g1, g2, max(l) + count(*) - 1 AS m FROM (SELECT doc_id, no, l, p - q AS g1, p - row_number() OVER (PARTITION BY doc_id, no, p - q ORDER BY p) AS g2 FROM hits) GROUP BY doc_id, no, g1, g2) GROUP BY doc_id) r USING (doc_id)
"""

def oracle_sql() -> dict[str, str]:
    return {"op1_rendezvous_shards": RENDEZVOUS, "op2_chat_reply_trees": CHAT, "op4_warc_revisits": REVISITS, "op10_decontaminate": DECONTAMINATE}
