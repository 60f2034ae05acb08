"""DuckDB statements with the results of plans/queries.py. They take their own
routes: recursive folds, plain arithmetic on the corners, window sums."""

from __future__ import annotations

BOX = """b AS (
  SELECT user_id AS frame_id, event_id AS box_id, event_id * 37 % 944 AS x0, event_id * 53 % 708 AS y0,
         event_id * 37 % 944 + 20 + event_id * 7 % 60 AS x1, event_id * 53 % 708 + 10 + event_id * 11 % 40 AS y1,
         event_type AS text, value / 500 AS score
  FROM events
)"""

# The corners of a tilted quad in reading order; see views.quads for how it is tilted.
QUAD = f"""{BOX}, q0 AS (
  SELECT frame_id, box_id, score, x0 + box_id % 3 AS tlx, y0 AS tly, x1 AS trx, y0 + box_id % 5 AS try,
         x1 - box_id % 4 AS brx, y1 AS bry, x0 AS blx, y1 - box_id % 2 AS bly FROM b
), q AS (
  -- The two rightmost corners keep their order as they stand: the sides are 20 wide at least.
  SELECT * FROM q0
)"""

_PAIRS = """p AS (
  SELECT item_id, CAST(item_id % 4 AS VARCHAR) AS category, text AS expected, m.ord, m.mode,
         CASE m.ord WHEN 0 THEN translate(text, 'lIO', '1l0') WHEN 1 THEN '| ' || text ELSE replace(text, 'e', '') END AS text,
         CAST(item_id * 3 % 97 + m.ord * 10 AS DOUBLE) AS ms
  FROM benchmark, (VALUES (0, 'rec'), (1, 'stretch'), (2, 'pad')) m(ord, mode)
)"""

# This levenshtein counts bytes, so each letter beyond ASCII stands as one control character.
_LETTERS = "ÄÇÈÉÊÑÖÜßäçèéêíñóöüáúàùâîôûëï"
_STAND = " || ".join(f"chr({k})" for k in [*range(1, 9), *range(14, 32), 127, 11, 12])


def _norm(c: str) -> str:
    return f"translate({c}, ' |' || chr(9), '')"


def _byte(c: str) -> str:
    return f"translate({c}, '{_LETTERS}', {_STAND})"


def _scored(source: str, keep: str) -> str:
    got, want = _norm("text"), _norm("expected")
    return f"SELECT {keep}, {got} = {want} AS match, levenshtein({_byte(got)}, {_byte(want)}) / CAST(greatest(1, length({want})) AS DOUBLE) AS cer, ms FROM {source}"


_SCORED = f"{_PAIRS}, s AS ({_scored('p', 'item_id, category, mode, text')})"

_ENGINES = ("own", "own_raw", "other", "other_x2", "other_x3", "other_x2_filters")
_ENGINE_SCORES = f"""r AS (
  SELECT item_id AS region_id, 's' || (item_id % 4) AS screen, CAST(item_id % 3 AS VARCHAR) AS category, text AS expected, e.ord AS engine_ord, e.engine,
         CASE (item_id + e.ord) % 3 WHEN 0 THEN text WHEN 1 THEN translate(text, 'aeo', '') ELSE translate(text, 't', '') END AS text,
         CAST(item_id % 50 + e.ord * 5 AS DOUBLE) AS ms
  FROM benchmark, (VALUES {", ".join(f"({k}, '{n}')" for k, n in enumerate(_ENGINES))}) e(ord, engine)
), s0 AS ({_scored("r", "region_id, screen, category, engine, engine_ord")}
), best AS (
  SELECT * FROM s0 WHERE engine NOT IN ('own', 'own_raw') QUALIFY row_number() OVER (PARTITION BY screen, region_id ORDER BY cer, engine_ord) = 1
)"""

_LOGITS = """l AS (
  SELECT vec_id AS crop_id, t, c, CAST(embedding[t * 8 + c + 1] AS DOUBLE) AS p
  FROM embeddings, range(8) a(t), range(8) z(c)
)"""

_CTC = f"""
WITH {_LOGITS}, m AS (
  SELECT crop_id, t, arg_max(c, (p, -c)) AS idx, max(p) AS p FROM l GROUP BY ALL
), k AS (
  SELECT *, idx <> 0 AND coalesce(lag(idx) OVER (PARTITION BY crop_id ORDER BY t) <> idx, true) AS kept FROM m
)
SELECT crop_id, coalesce(string_agg(substr('ABCDEFG', idx, 1), '' ORDER BY t) FILTER (kept), '') AS text,
       round(coalesce(avg(p) FILTER (kept), 0), 4) AS score
FROM k GROUP BY crop_id
"""

_CYCLES = "c AS (SELECT event_id % 50 AS cycle, event_type AS metric, user_id AS screen_id, value FROM events)"


def _lines(source: str, keys: str) -> str:
    """Lines over rows (keys, seq, cy, tall, text, score) of a relation; a null seq
    is a group without pieces."""
    return f"""
    SELECT {keys}, coalesce(string_agg(gap || text, '' ORDER BY seq) FILTER (seq IS NOT NULL), '') AS text,
           round(coalesce(avg(score), 0), 6) AS score, count(seq) AS n_pieces
    FROM (SELECT *, CASE WHEN lag(seq) OVER w IS NULL THEN '' WHEN abs(cy - lag(cy) OVER w) < lag(tall) OVER w / 2.0 THEN ' ' ELSE chr(10) END AS gap
          FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY seq))
    GROUP BY {keys}"""


def _corner(*points: tuple[str, str]) -> str:
    return " || '-' || ".join(f"'(' || CAST({x} AS BIGINT) || ',' || CAST({y} AS BIGINT) || ')'" for x, y in points)


_TL, _TR, _BR, _BL = ("tlx", "tly"), ("trx", "try"), ("brx", "bry"), ("blx", "bly")
_GIVEN = (_BR, _BL, _TL, _TR)


def _mapped(fx: str, fy: str) -> str:
    return _corner(*[(fx.format(x), fy.format(y)) for x, y in _GIVEN])


def _hypot(a: tuple[str, str], b: tuple[str, str]) -> str:
    return f"sqrt(({a[0]} - {b[0]}) ** 2 + ({a[1]} - {b[1]}) ** 2)"


# Whether a quad's right pair swaps: top is the smaller y, and of equal ones the second by x.
_WIDTH, _HEIGHT = f"greatest({_hypot(_TL, _TR)}, {_hypot(_BR, _BL)})", f"greatest({_hypot(_TL, _BL)}, {_hypot(_TR, _BR)})"

_SPANS = """z AS (SELECT event_id AS size_id, CAST(300 + event_id % 1700 AS INTEGER) AS width, CAST(300 + event_id % 900 AS INTEGER) AS height FROM events),
n AS (SELECT *, CASE WHEN width <= 480 THEN 1 ELSE (width - 256 + 223) // 224 END AS nx, CASE WHEN height <= 480 THEN 1 ELSE (height - 256 + 223) // 224 END AS ny FROM z),
s AS (SELECT *, (width + (nx - 1) * 256) // nx AS w, (height + (ny - 1) * 256) // ny AS h FROM n)"""

# The bars of views.bars that are read: dark enough that 1 - ink / 255 is 0.4 or more,
# no marks, of a shade that the stand-in is sure of. Bars of a row make a line.
_BARS = """e AS (
  SELECT CAST(event_id // 16 AS VARCHAR) AS frame_id, event_id % 16 // 4 AS row, event_id % 4 AS col, event_id % 9 AS shade, event_id % 11 = 5 AS mark FROM events
), s AS (
  SELECT frame_id, row, col, chr(CAST(65 + shade AS INTEGER)) AS letter, CASE shade WHEN 3 THEN 0.3::DOUBLE ELSE 0.5::DOUBLE + 0.05::DOUBLE * shade END AS sure
  FROM e WHERE NOT mark AND 1 - (12 + 26 * shade) / 255.0::DOUBLE >= 0.4 AND shade <> 3
)"""
_BAR_LINES = """SELECT d.frame_id, d.region_id, coalesce(t.text, '') AS text, round(coalesce(t.score, 0), 5) AS score, CAST(coalesce(t.n, 0) AS INTEGER) AS n_pieces
FROM d LEFT JOIN (
  SELECT frame_id, region_id, string_agg(line, chr(10) ORDER BY row) AS text, sum(total) / sum(n) AS score, sum(n) AS n
  FROM (SELECT frame_id, region_id, row, string_agg(letter, ' ' ORDER BY col) AS line, sum(sure) AS total, count(*) AS n FROM m GROUP BY ALL) GROUP BY ALL
) t ON t.frame_id = d.frame_id AND t.region_id = d.region_id"""


SQL: dict[str, str] = {
    "scored_reads": f"WITH {_SCORED} SELECT item_id, category, mode, match, round(cer, 6) AS cer, ms FROM s",
    "tally_by_mode": f"""WITH {_SCORED}
SELECT mode, CASE WHEN grouping(category) = 1 THEN 'all' ELSE category END AS category, count(*) AS n, count(*) FILTER (match) AS matched,
       round(avg(cer), 6) AS mean_cer, round(avg(ms), 6) AS mean_ms
FROM s GROUP BY GROUPING SETS ((mode, category), (mode))""",
    "tally_by_engine": f"""WITH {_ENGINE_SCORES}, s AS (
  SELECT engine, screen, category, match, cer, ms FROM s0 UNION ALL SELECT 'other_best', screen, category, match, cer, 0.0 FROM best
), g AS (
  SELECT *, unnest(['all', 'screen ' || screen, 'category ' || category]) AS "group" FROM s
)
SELECT engine, "group", count(*) AS n, count(*) FILTER (match) AS matched, round(avg(cer), 6) AS mean_cer, round(avg(ms), 6) AS mean_ms FROM g GROUP BY ALL""",
    "best_engine_reads": f"WITH {_ENGINE_SCORES} SELECT screen, region_id, engine_ord, match, round(cer, 6) AS cer, CAST(0 AS DOUBLE) AS ms FROM best",
    "overall_report": f"WITH {_SCORED} SELECT count(*) FILTER (match) AS matched, count(*) AS total, round(coalesce(avg(ms), 0), 6) AS ms_per_region FROM s",
    "printed_summary": f"""WITH {_SCORED}, g AS (SELECT *, unnest(['all', category]) AS c FROM s)
SELECT mode, c AS category, count(*) FILTER (match) || '/' || count(*) AS matched, printf('%.3f', round(avg(cer), 6)) AS mean_cer, printf('%.1f', avg(ms)) AS mean_ms FROM g GROUP BY mode, c""",
    "printed_reads": f"""WITH {_SCORED}
SELECT item_id, category, mode, printf('%.1f', ms) AS ms, CASE WHEN match THEN 'yes' ELSE 'no' END AS match, printf('%.2f', round(cer, 6)) AS cer, replace(text, chr(10), ' | ') AS text FROM s""",
    "frame_dimensions": r"""WITH p AS (
  SELECT event_id, 'screens/' || event_type || CASE WHEN event_id % 11 = 0 THEN '-' ELSE '_' END || (300 + event_id % 1700)
         || CASE WHEN event_id % 7 = 0 THEN 'by' ELSE 'x' END || (300 + event_id % 900)
         || CASE event_id % 5 WHEN 0 THEN '.bgr888.part' WHEN 1 THEN '.raw' ELSE '.bgr888' END AS path
  FROM events
), d AS (SELECT *, regexp_extract(path, '_([0-9]+)x([0-9]+)\.bgr888', ['w', 'h']) AS m FROM p)
SELECT event_id, path, regexp_replace(regexp_replace(path, '^.*/', ''), '\.[^.]*$', '') AS screen,
       coalesce(try_cast(m.w AS INTEGER), 0) AS width, coalesce(try_cast(m.h AS INTEGER), 0) AS height FROM d""",
    "region_lines": """WITH r AS (
  SELECT event_id, 'r' || event_id AS id, event_type AS category, event_id * 37 % 944 AS x, event_id * 53 % 708 AS y,
         CASE WHEN event_id % 13 = 0 THEN 0 ELSE 20 + event_id % 60 END AS width, 10 + event_id % 40 AS height, event_id % 6 AS kind FROM events
)
SELECT event_id, id, category, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(width AS INTEGER) AS width, CAST(height AS INTEGER) AS height,
       CASE kind WHEN 0 THEN 'Start | Stop' ELSE 'Reset' END AS expected FROM r WHERE kind IN (0, 2)""",
    "argument_checks": f"""WITH {BOX}, f AS (SELECT *, 1024 - box_id % 40 * 30 AS fw, 768 - box_id % 30 * 30 AS fh FROM b)
SELECT frame_id, box_id, CAST(CASE WHEN box_id % 17 = 0 OR fw <= 0 OR fh <= 0 OR box_id % 3 = 0 OR x1 > fw OR y1 > fh THEN -1 ELSE 0 END AS INTEGER) AS code FROM f""",
    "tile_grid": f"""WITH {_SPANS}
SELECT size_id, width, height, 0 AS tile, 0 AS x, 0 AS y, width AS w, height AS h FROM s
UNION ALL
SELECT size_id, width, height, CAST(1 + j * nx + i AS INTEGER), CAST(CASE WHEN i = nx - 1 THEN width - w ELSE i * (w - 256) END AS INTEGER),
       CAST(CASE WHEN j = ny - 1 THEN height - h ELSE j * (h - 256) END AS INTEGER), w, h
FROM (SELECT *, unnest(range(0, nx)) AS i FROM (SELECT *, unnest(range(0, ny)) AS j FROM s WHERE nx > 1 OR ny > 1))""",
    "region_windows": f"""WITH {BOX}, o AS (
  SELECT *, greatest(x0 - 8, 0) AS ox, greatest(y0 - 8, 0) AS oy, least(x1 + 8, 960) AS ex, least(y1 + 8, 720) AS ey FROM b
)
SELECT frame_id, box_id, ox AS outer_x, oy AS outer_y, ex - ox AS outer_width, ey - oy AS outer_height,
       x0 - ox AS keep_x, y0 - oy AS keep_y, x1 - x0 AS keep_width, y1 - y0 AS keep_height FROM o""",
    "crop_shapes": f"""WITH {QUAD}, s AS (SELECT frame_id, box_id, CAST(floor({_WIDTH}) AS INTEGER) AS width, CAST(floor({_HEIGHT}) AS INTEGER) AS height FROM q)
SELECT *, height / CAST(width AS DOUBLE) >= 1.5 AS rotated, CAST(least(greatest(ceil(48 * width / CAST(greatest(height, 1) AS DOUBLE)), 1), 320) AS INTEGER) AS letterbox FROM s""",
    "quad_measures": f"""WITH {QUAD}
SELECT frame_id, box_id,
       round(abs(tlx * try - trx * tly + trx * bry - brx * try + brx * bly - blx * bry + blx * tly - tlx * bly) / 2.0, 4) AS area,
       round({_hypot(_TL, _TR)} + {_hypot(_TR, _BR)} + {_hypot(_BR, _BL)} + {_hypot(_BL, _TL)}, 4) AS perimeter,
       round((tlx + trx + brx + blx) / 4.0, 4) AS cx, round((tly + try + bry + bly) / 4.0, 4) AS cy,
       CAST(greatest(bry, bly) - least(tly, try) AS DOUBLE) AS tall, round({_hypot(_TL, _BL)}, 4) AS edge_height, round({_hypot(_TL, _TR)}, 4) AS edge_width
FROM q""",
    "quad_order": f"WITH {QUAD} SELECT frame_id, box_id, {_corner(_TL, _TR, _BR, _BL)} AS corners FROM q",
    "quad_mapping": f"""WITH {QUAD}
SELECT frame_id, box_id, {_mapped("{} - 40", "{} - 30")} AS shifted,
       {_mapped("least(greatest({} - 40, 0), 899)", "least(greatest({} - 30, 0), 699)")} AS clipped,
       {_mapped("least(floor({} / (480 / 1024.0::DOUBLE) + 0.5), 1800)", "least(floor({} / (480 / 768.0::DOUBLE) + 0.5), 1000)")} AS rescaled FROM q""",
    "unclipped_boxes": f"""WITH {BOX}, d AS (SELECT *, (x1 - x0) * (y1 - y0) * CAST(1.8 AS DOUBLE) / (2 * (x1 - x0 + y1 - y0)) AS d FROM b)
SELECT frame_id, box_id, CAST(floor((x0 - d) * 1000 + 0.5) AS BIGINT) AS x0, CAST(floor((y0 - d) * 1000 + 0.5) AS BIGINT) AS y0,
       CAST(floor((x1 + d) * 1000 + 0.5) AS BIGINT) AS x1, CAST(floor((y1 + d) * 1000 + 0.5) AS BIGINT) AS y1 FROM d""",
    "sized_boxes": f"""WITH {QUAD}, k AS (
  SELECT frame_id, box_id, score, least(tlx, 959) AS tlx, least(tly, 719) AS tly, least(trx, 959) AS trx, least(try, 719) AS try, least(blx, 959) AS blx, least(bly, 719) AS bly FROM q
)
SELECT frame_id, box_id FROM k WHERE floor({_hypot(_TL, _TR)}) > 3 AND floor({_hypot(_TL, _BL)}) > 3 AND {_hypot(_TL, _BL)} >= 10 AND {_hypot(_TL, _TR)} >= 8 AND score >= 0.4""",
    "candidates": f"WITH {BOX} SELECT frame_id, box_id, n FROM (SELECT *, CAST(count(*) OVER (PARTITION BY frame_id ORDER BY box_id) AS INTEGER) AS n FROM b) WHERE n <= 3000",
    "overlap_pairs": f"""WITH {BOX}
SELECT p.frame_id, p.box_id AS box_a, q.box_id AS box_b,
       round((least(p.x1, q.x1) - greatest(p.x0, q.x0)) * (least(p.y1, q.y1) - greatest(p.y0, q.y0))
         / (least((p.x1 - p.x0) * (p.y1 - p.y0), (q.x1 - q.x0) * (q.y1 - q.y0)) + CAST(1e-6 AS DOUBLE)), 6) AS iom
FROM b p JOIN b q ON p.frame_id = q.frame_id AND p.box_id < q.box_id AND p.x0 < q.x1 AND q.x0 < p.x1 AND p.y0 < q.y1 AND q.y0 < p.y1""",
    "reading_order": f"""WITH RECURSIVE {BOX}, o AS (
  SELECT frame_id, box_id, x0, y0, row_number() OVER (PARTITION BY frame_id ORDER BY y0, x0, box_id) AS rn FROM b
), f AS (
  SELECT frame_id, rn, [{{'x': x0, 'y': y0, 'id': box_id}}] AS acc FROM o WHERE rn = 1
  UNION ALL
  SELECT frame_id, rn, acc[1:k] || [e] || acc[k + 1:] AS acc FROM (
    SELECT o.frame_id, o.rn, f.acc, {{'x': o.x0, 'y': o.y0, 'id': o.box_id}} AS e,
           coalesce(list_max(list_filter(range(1, len(f.acc) + 1), lambda j: NOT (abs(o.y0 - f.acc[j].y) < 10 AND o.x0 < f.acc[j].x))), 0) AS k
    FROM f JOIN o ON o.frame_id = f.frame_id AND o.rn = f.rn + 1)
), done AS (SELECT frame_id, arg_max(acc, rn) AS acc FROM f GROUP BY frame_id), u AS (SELECT frame_id, acc, unnest(range(0, len(acc))) AS seq FROM done)
SELECT frame_id, acc[seq + 1].id AS box_id, acc[seq + 1].x AS x0, acc[seq + 1].y AS y0, CAST(seq AS INTEGER) AS seq FROM u""",
    "overlap_suppression": f"""WITH RECURSIVE {BOX}, o AS (
  SELECT *, (x1 - x0) * (y1 - y0) AS size, row_number() OVER (PARTITION BY frame_id ORDER BY (x1 - x0) * (y1 - y0) DESC, box_id) AS rn FROM b
), nb AS (
  SELECT p.frame_id, p.rn, p.box_id, list(q.box_id) FILTER (q.box_id IS NOT NULL) AS near
  FROM o p LEFT JOIN o q ON p.frame_id = q.frame_id AND q.rn < p.rn
    AND greatest(least(p.x1, q.x1) - greatest(p.x0, q.x0), 0) * greatest(least(p.y1, q.y1) - greatest(p.y0, q.y0), 0) / (least(p.size, q.size) + 1e-6) > 0.6
  GROUP BY ALL
), f AS (
  SELECT frame_id, rn, [box_id] AS kept FROM nb WHERE rn = 1
  UNION ALL
  SELECT nb.frame_id, nb.rn, CASE WHEN near IS NULL OR len(list_intersect(near, kept)) = 0 THEN kept || [nb.box_id] ELSE kept END
  FROM f JOIN nb ON nb.frame_id = f.frame_id AND nb.rn = f.rn + 1
)
SELECT frame_id, unnest(arg_max(kept, rn)) AS box_id FROM f GROUP BY frame_id""",
    "region_readings": f"""WITH {BOX}, g(region_id, x, y, width, height) AS (VALUES (0, 0, 0, 472, 354), (1, 472, 0, 472, 354), (2, 0, 354, 472, 354), (3, 472, 354, 472, 354), (4, 2000, 2000, 10, 10)),
r AS (SELECT * FROM (SELECT DISTINCT frame_id FROM b), g),
p AS (SELECT frame_id, box_id AS seq, (x0 + x1) / 2.0::DOUBLE AS cx, (y0 + y1) / 2.0::DOUBLE AS cy, y1 - y0 AS tall, text, score FROM b WHERE score >= 0.4),
m AS (
  SELECT r.frame_id, r.region_id, seq, cy, tall, text, score FROM r LEFT JOIN p ON p.frame_id = r.frame_id
    AND round_even(cx, 0) >= x AND round_even(cx, 0) < x + width AND round_even(cy, 0) >= y AND round_even(cy, 0) < y + height
)
{_lines("m", "frame_id, region_id")}""",
    "conversation_lines": f"""WITH m AS (
  SELECT conv_id, turn AS seq, turn * 13 % 40 AS cy, 20 AS tall, replace(text, chr(10), ' | ') AS text, length(text) % 100 / 100.0::DOUBLE AS score FROM conversations
)
{_lines("m", "conv_id")}""",
    "ctc_rows": _CTC,
    "ctc_arrays": _CTC,
    "timing_summary": f"WITH {_CYCLES} SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(value) AS n FROM c GROUP BY metric",
    "timed_means": f"WITH {_CYCLES} SELECT screen_id, metric, round(avg(value), 6) AS ms FROM c WHERE cycle > 0 GROUP BY ALL",
    "last_cycles": f"""WITH {_CYCLES}, n AS (SELECT screen_id, cycle, count(*) AS n_crops, max(value) AS value FROM c GROUP BY ALL)
SELECT screen_id, cycle, n_crops, round(value, 6) AS value FROM n QUALIFY row_number() OVER (PARTITION BY screen_id ORDER BY cycle DESC) = 1""",
    "process_usage": f"""WITH {_CYCLES}, u AS (SELECT screen_id, sum(value) AS busy, sum(cycle - 20) AS clock, max(value) AS most, avg(value) AS mean FROM c GROUP BY screen_id)
SELECT screen_id, round(CASE WHEN clock > 0 THEN busy / clock * 100 * 8 ELSE 0 END, 4) AS cpu_pct, round(most, 4) AS most, round(most - mean, 4) AS other FROM u""",
    "sweep_grid": """SELECT row_number() OVER (ORDER BY i, d, b, u) AS run, image || '_1024x768.bgr888' AS image, CAST(d AS DOUBLE) AS det_thresh, CAST(b AS DOUBLE) AS box_thresh, CAST(u AS DOUBLE) AS unclip_ratio
FROM (VALUES (0, 'alarm'), (1, 'auto_1'), (2, 'auto_2'), (3, 'normal'), (4, 'full')) x(i, image), (VALUES (0.2), (0.3), (0.4)) y(d), (VALUES (0.3), (0.4), (0.5), (0.6)) z(b), (VALUES (1.0), (1.5), (2.0)) w(u)""",
    "sweep_report": f"""WITH {BOX} SELECT frame_id, CAST(d AS DOUBLE) AS det_thresh, count(*) AS n_pieces, string_agg(text, ';' ORDER BY box_id) AS recognized_text
FROM b, (VALUES (0.2), (0.3), (0.4)) t(d) WHERE score >= CAST(d AS DOUBLE) GROUP BY frame_id, d""",
    "report_fields": """SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'NA' ELSE (conv_id % 97) || '.5' END AS det_ms, count(*) AS n_pieces,
       string_agg(replace(replace(text, '"', ''''), chr(10), ' | '), ';' ORDER BY turn) AS recognized_text FROM conversations GROUP BY conv_id""",
    "tidied_texts": """SELECT conv_id, turn, replace(trim(translate(text, ',', ' '), ' ' || chr(10)), chr(10), ' | ') AS tidied,
       chr(10) || translate(replace(text, ',', ''), ' |', '') || chr(13) || chr(10) || chr(12) AS normalised FROM conversations""",
    "result_rows": f"""WITH {BOX}
SELECT frame_id, arg_min(text, box_id) AS text, CAST(floor(round(avg(score), 9) * 100 + 0.5) AS INTEGER) AS confidence, CAST(count(*) AS INTEGER) AS count, CAST(sum(x1) AS BIGINT) AS right_sum FROM b GROUP BY frame_id""",
    "barred_frame_readings": f"""WITH {_BARS}, d AS (SELECT DISTINCT frame_id, 'all' AS region_id FROM e), m AS (SELECT *, 'all' AS region_id FROM s)
SELECT frame_id, text, score, n_pieces FROM ({_BAR_LINES})""",
    "barred_region_reads": f"""WITH {_BARS}, d AS (SELECT DISTINCT frame_id, r.region_id FROM e, (VALUES ('half'), ('row'), ('cell'), ('none')) r(region_id)),
m AS (
  SELECT *, 'half' AS region_id FROM s WHERE col < 2
  UNION ALL SELECT *, 'row' FROM s WHERE row = 1
  UNION ALL SELECT *, 'cell' FROM s WHERE row = 2 AND col = 2
)
{_BAR_LINES}""",
    # A flat block has one coefficient, 8 times its level: the steps are 16 and 17.
    "recompressed_colours": """WITH c AS (
  SELECT event_id, CAST(event_id * 7 % 256 AS DOUBLE) AS b, CAST(event_id * 11 % 256 AS DOUBLE) AS g, CAST(event_id * 13 % 256 AS DOUBLE) AS r FROM events
), p AS (
  SELECT event_id, round_even(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 0) AS y,
         least(round_even(0.5::DOUBLE * b - 0.168736::DOUBLE * r - 0.331264::DOUBLE * g + 128, 0), 255) AS cb,
         least(round_even(0.5::DOUBLE * r - 0.418688::DOUBLE * g - 0.081312::DOUBLE * b + 128, 0), 255) AS cr FROM c
), q AS (
  SELECT event_id, least(greatest(round_even(round_even((y - 128) * 8 / 16, 0) * 2 + 128, 0), 0), 255) AS y,
         least(greatest(round_even(round_even((cb - 128) * 8 / 17, 0) * 17 / 8 + 128, 0), 0), 255) - 128 AS cb,
         least(greatest(round_even(round_even((cr - 128) * 8 / 17, 0) * 17 / 8 + 128, 0), 0), 255) - 128 AS cr FROM p
)
SELECT event_id, CAST(least(greatest(round_even(y + 1.772::DOUBLE * cb, 0), 0), 255) AS INTEGER) AS b,
       CAST(least(greatest(round_even(y - 0.344136::DOUBLE * cb - 0.714136::DOUBLE * cr, 0), 0), 255) AS INTEGER) AS g,
       CAST(least(greatest(round_even(y + 1.402::DOUBLE * cr, 0), 0), 255) AS INTEGER) AS r, true AS even FROM q""",
    "map_scores": """WITH p AS (SELECT vec_id, i % 8 AS x, i // 8 AS y, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(64) a(i))
SELECT vec_id, count(*) FILTER (v > 0.2) AS n_above, round(avg(v) FILTER (x BETWEEN vec_id % 4 AND vec_id % 4 + 3 AND y BETWEEN vec_id % 3 AND vec_id % 3 + 4), 5) AS score,
       round((8 * (avg(v) FILTER (y = 0) + avg(v) FILTER (y = 7)) + 8 * (avg(v) FILTER (x = 0) + avg(v) FILTER (x = 7))) / 32, 5) AS edge
FROM p GROUP BY vec_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
