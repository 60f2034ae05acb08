"""DuckDB statements for the queries that SQL can express. They take plainer
routes than the operators: every quotient ranked, every text grouped."""

from __future__ import annotations

from . import chat, mixing


def op3() -> str:
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(concat_ws(':', '{mixing.SEED}', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))) AS draw
  FROM documents
), n AS (
  SELECT least({mixing.MOST_SHARDS}, greatest(1, CAST(ceil(count(*) / {mixing.SHARD_DOCS}.0) AS BIGINT))) AS shards FROM d
), p AS (
  SELECT d.*, CAST('0x' || substr(draw, 1, 8) AS BIGINT) % n.shards AS shard FROM d, n
), l AS (
  SELECT source, shard, CAST(sum(size) AS BIGINT) AS line FROM p GROUP BY ALL
), s0 AS (
  SELECT source, CAST(sum(line) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) AS party FROM l GROUP BY source
), s1 AS (
  SELECT *, [{", ".join(map(str, mixing.WEIGHTS))}][(party - 1) % {len(mixing.WEIGHTS)} + 1] AS weight FROM s0
), s2 AS (
  SELECT *, {mixing.REPEATS} * source_size AS cap, CAST({mixing.REPEATS} * source_size AS DOUBLE) / weight AS ratio FROM s1
), s3 AS (
  SELECT x.source, x.ratio,
         CAST((SELECT sum(source_size) FROM s2) - coalesce((SELECT sum(y.cap) FROM s2 y WHERE (y.ratio, y.party) < (x.ratio, x.party)), 0) AS DOUBLE)
         / ((SELECT sum(weight) FROM s2) - coalesce((SELECT sum(y.weight) FROM s2 y WHERE (y.ratio, y.party) < (x.ratio, x.party)), 0)) AS level,
         x.party
  FROM s2 x
), lv AS (
  SELECT arg_min(level, (ratio, party)) AS level FROM s3 WHERE level <= ratio
), t AS (
  SELECT s2.*, least(CAST(cap AS DOUBLE), lv.level * weight) AS target FROM s2, lv
), bids AS (
  SELECT party, row_number() OVER (ORDER BY target / (k + 0.5) DESC, party) AS rank
  FROM (SELECT party, target, unnest(range(0, CAST(ceil(target / {mixing.BLOCK}) AS BIGINT) + 2)) AS k FROM t WHERE target > 0)
), won AS (
  SELECT party, count(*) AS blocks FROM bids
  WHERE rank <= (SELECT round(sum(source_size) / {mixing.BLOCK}.0) FROM t) GROUP BY party
), sh AS (
  SELECT l.*, t.party, t.source_size, t.target, coalesce(won.blocks, 0) AS blocks
  FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source LEFT JOIN won ON won.party = t.party
), sbids AS (
  SELECT party, shard, blocks, row_number() OVER (PARTITION BY party ORDER BY line / (k + 0.5) DESC, shard) AS rank
  FROM (SELECT party, shard, line, blocks, unnest(range(0, {mixing.REPEATS} * line // {mixing.BLOCK} + 3)) AS k FROM sh WHERE line > 0)
), swon AS (
  SELECT party, shard, count(*) AS quota FROM sbids WHERE rank <= blocks GROUP BY ALL
), q0 AS (
  SELECT sh.*, coalesce(quota, 0) * {mixing.BLOCK} AS asked, {mixing.REPEATS} * line AS most FROM sh LEFT JOIN swon ON swon.party = sh.party AND swon.shard = sh.shard
), q1 AS (
  SELECT *, CAST(sum(greatest(most - asked, 0)) OVER (PARTITION BY party) AS HUGEINT) AS rooms,
         CAST(sum(greatest(asked - most, 0)) OVER (PARTITION BY party) AS HUGEINT) AS excess,
         CAST(sum(greatest(most - asked, 0)) OVER (PARTITION BY party ORDER BY shard) AS HUGEINT) AS upto FROM q0
), q AS (
  SELECT *, least(asked, most) + CASE WHEN rooms > 0 THEN CAST(upto * least(excess, rooms) // rooms
           - (upto - greatest(most - asked, 0)) * least(excess, rooms) // rooms AS BIGINT) ELSE 0 END AS words,
         CASE WHEN line > 0 THEN CAST('0x' || substr(md5(concat_ws(':', '{mixing.SEED}', coalesce(source, ''), CAST(shard AS VARCHAR))), 1, 8) AS BIGINT) % line ELSE 0 END AS start
  FROM q1
), a AS (
  SELECT p.*, sum(size) OVER (PARTITION BY source, shard ORDER BY draw, doc_id ROWS UNBOUNDED PRECEDING) - size AS pos FROM p
)
SELECT a.doc_id, a.size, q.source_size, q.target,
       CASE WHEN a.size = 0 THEN 0 ELSE CAST((words // line) * a.size
         + greatest(least(start + words % line, line, pos + a.size) - greatest(start, pos), 0)
         + greatest(least(start + words % line - line, pos + a.size) - pos, 0) AS BIGINT) END AS taken
FROM a JOIN q ON a.source IS NOT DISTINCT FROM q.source AND a.shard = q.shard
"""

OP6 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
"""

# The tables' pages keep their text in one article element of headings, paragraphs and
# bold runs, without menus or notices inside: there, plain patterns say what is main text.
_DECODED = "x"
for _name, _char in (("&amp;", "chr(1)"), ("&amp", "chr(1)"), ("&quot;", "chr(34)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&#x27;", "chr(39)"), ("&#39;", "chr(39)")):
    _DECODED = f"replace({_DECODED}, '{_name}', {_char})"
OP1 = rf"""
WITH a AS (
  SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?b>', '', 'g') AS body FROM pages
), p AS (
  SELECT page_id, url, list_transform(regexp_split_to_array(body, '</?(?:p|h1|br)>'), lambda x: trim(regexp_replace(replace({_DECODED}, chr(1), '&'), '\s+', ' ', 'g'))) AS parts FROM a
), t AS (
  SELECT page_id, url, coalesce(array_to_string(list_filter(parts, lambda x: x <> ''), ' '), '') AS text FROM p
)
SELECT page_id, url, text, length(text) AS n_chars, CAST(0 AS BIGINT) AS n_removed FROM t
"""

_NL = "chr(10)"
OP9 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, md5(coalesce(text, '')) AS digest,
         coalesce(CAST(floor(turn / {chat.SEGMENT}.0) AS BIGINT), -1) AS segment FROM conversations
), n AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id, segment ORDER BY turn NULLS FIRST, role, digest) - 1) // {chat.PART} AS part FROM t
), s AS (SELECT DISTINCT conv_id, role AS perspective FROM t), v AS (
  SELECT n.*, s.perspective, role = perspective AS own,
         CASE WHEN role = perspective THEN '<|assistant|>' || {_NL} ELSE '<|user:' || role || '|>' || {_NL} END AS head,
         text || '<|end|>' || {_NL} AS body
  FROM n JOIN s ON n.conv_id IS NOT DISTINCT FROM s.conv_id
), o AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective ORDER BY segment, turn NULLS FIRST, role, digest ROWS UNBOUNDED PRECEDING) AS stop FROM v
)
SELECT conv_id, perspective, segment, part, CAST(min(stop - length(head) - length(body)) AS BIGINT) AS start,
       count(*) AS n_turns, count(*) FILTER (own) AS n_own,
       string_agg(head || body, '' ORDER BY turn NULLS FIRST, role, digest) AS rendered,
       CAST(sum(length(head) + length(body)) AS BIGINT) AS n_chars,
       CAST(coalesce(sum(length(body)) FILTER (own), 0) AS BIGINT) AS mask_chars,
       coalesce(string_agg(CAST(stop - length(body) AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY stop) FILTER (own), '') AS mask
FROM o GROUP BY conv_id, perspective, segment, part
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_html_main_text": OP1, "op3_source_mixing": op3(), "op6_exact_dedup": OP6, "op9_chat_perspectives": OP9}
