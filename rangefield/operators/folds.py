"""Sequential state machines as folds over one ordered array per key.

The rows of a key are sorted by (t_ms, seq) and folded with Catalyst's
`aggregate`, so no Python runs; the checking SQL steps through row numbers.
"""

from __future__ import annotations

from ..functions.dialect import spark_sql
from ..plans import sites
from ..plans.relations import with_

#: Exponential smoothing of a node's distance: time constant 2 s, a gap of 30 s starts anew, variance alongside.
_SMOOTH = """SELECT device_id, node_id, round(s.m, 6) AS mean, round(s.v, 6) AS variance, size(a) AS n FROM (
  SELECT device_id, node_id, a, aggregate(slice(a, 2, size(a)), named_struct('t', a[0].t_ms, 'm', a[0].distance, 'v', 0.0D),
    (s, e) -> CASE WHEN e.t_ms - s.t >= 30000 THEN named_struct('t', e.t_ms, 'm', e.distance, 'v', 0.0D)
      ELSE named_struct('t', e.t_ms, 'm', s.m + least(greatest(1.0D - exp(-(e.t_ms - s.t) / 2000.0D), 0.05D), 1.0D) * (e.distance - s.m),
        'v', greatest((1.0D - least(greatest(1.0D - exp(-(e.t_ms - s.t) / 2000.0D), 0.05D), 1.0D)) * s.v + least(greatest(1.0D - exp(-(e.t_ms - s.t) / 2000.0D), 0.05D), 1.0D) * (e.distance - s.m)
          * (e.distance - (s.m + least(greatest(1.0D - exp(-(e.t_ms - s.t) / 2000.0D), 0.05D), 1.0D) * (e.distance - s.m))), 0.0D)) END) AS s
  FROM (SELECT device_id, node_id, array_sort(collect_list(struct(t_ms, seq, distance))) AS a FROM obs WHERE distance IS NOT NULL GROUP BY device_id, node_id))"""
_SMOOTH_STEPS = """WITH RECURSIVE numbered AS (SELECT device_id, node_id, t_ms, distance, row_number() OVER (PARTITION BY device_id, node_id ORDER BY t_ms, seq) AS k, count(*) OVER (PARTITION BY device_id, node_id) AS n FROM obs WHERE distance IS NOT NULL),
  steps AS (SELECT device_id, node_id, t_ms, k, n, distance AS m, 0.0D AS v FROM numbered WHERE k = 1
    UNION ALL SELECT r.device_id, r.node_id, r.t_ms, r.k, r.n, CASE WHEN r.t_ms - s.t_ms >= 30000 THEN r.distance ELSE s.m + least(greatest(1.0D - exp(-(r.t_ms - s.t_ms) / 2000.0D), 0.05D), 1.0D) * (r.distance - s.m) END,
      CASE WHEN r.t_ms - s.t_ms >= 30000 THEN 0.0D ELSE greatest((1.0D - least(greatest(1.0D - exp(-(r.t_ms - s.t_ms) / 2000.0D), 0.05D), 1.0D)) * s.v + least(greatest(1.0D - exp(-(r.t_ms - s.t_ms) / 2000.0D), 0.05D), 1.0D) * (r.distance - s.m)
        * (r.distance - (s.m + least(greatest(1.0D - exp(-(r.t_ms - s.t_ms) / 2000.0D), 0.05D), 1.0D) * (r.distance - s.m))), 0.0D) END
    FROM steps s JOIN numbered r ON r.device_id = s.device_id AND r.node_id = s.node_id AND r.k = s.k + 1)
  SELECT device_id, node_id, round(m, 6) AS mean, round(v, 6) AS variance, CAST(n AS INTEGER) AS n FROM steps WHERE k = n"""

#: Positions smoothed with the confidence as a factor: time constant 0.8 s, a gap of 30 s starts anew.
_EMA = """SELECT device_id, round(s.x, 6) AS x, round(s.y, 6) AS y FROM (SELECT device_id, aggregate(slice(a, 2, size(a)), named_struct('t', a[0].t_ms, 'x', a[0].x, 'y', a[0].y),
    (s, e) -> CASE WHEN e.t_ms - s.t >= 30000 THEN named_struct('t', e.t_ms, 'x', e.x, 'y', e.y) ELSE named_struct('t', e.t_ms,
      'x', s.x + least(greatest((1.0D - exp(-(e.t_ms - s.t) / 800.0D)) * e.c, 0.02D), 1.0D) * (e.x - s.x), 'y', s.y + least(greatest((1.0D - exp(-(e.t_ms - s.t) / 800.0D)) * e.c, 0.02D), 1.0D) * (e.y - s.y)) END) AS s
  FROM (SELECT device_id, array_sort(collect_list(struct(t_ms, seq, x, y, least(confidence / 100.0D, 1.0D) AS c))) AS a FROM upstream GROUP BY device_id))"""
_EMA_STEPS = """WITH RECURSIVE numbered AS (SELECT device_id, t_ms, x, y, least(confidence / 100.0D, 1.0D) AS c, row_number() OVER (PARTITION BY device_id ORDER BY t_ms, seq) AS k, count(*) OVER (PARTITION BY device_id) AS n FROM upstream),
  steps AS (SELECT device_id, t_ms, k, n, x, y FROM numbered WHERE k = 1
    UNION ALL SELECT r.device_id, r.t_ms, r.k, r.n, CASE WHEN r.t_ms - s.t_ms >= 30000 THEN r.x ELSE s.x + least(greatest((1.0D - exp(-(r.t_ms - s.t_ms) / 800.0D)) * r.c, 0.02D), 1.0D) * (r.x - s.x) END,
      CASE WHEN r.t_ms - s.t_ms >= 30000 THEN r.y ELSE s.y + least(greatest((1.0D - exp(-(r.t_ms - s.t_ms) / 800.0D)) * r.c, 0.02D), 1.0D) * (r.y - s.y) END
    FROM steps s JOIN numbered r ON r.device_id = s.device_id AND r.k = s.k + 1) SELECT device_id, round(x, 6) AS x, round(y, 6) AS y FROM steps WHERE k = n"""

#: A room is committed on first sight; a new candidate holds one step at least and 200 ms before it is committed.
_HOLD = """SELECT device_id, s.room AS room, s.changes AS changes FROM (SELECT device_id, aggregate(slice(a, 2, size(a)), named_struct('room', a[0].name, 'cand', CAST(NULL AS STRING), 'since', CAST(0 AS BIGINT), 'changes', 0),
    (s, e) -> CASE WHEN e.name = s.room THEN named_struct('room', s.room, 'cand', CAST(NULL AS STRING), 'since', CAST(0 AS BIGINT), 'changes', s.changes)
      WHEN s.cand IS NULL OR s.cand <> e.name THEN named_struct('room', s.room, 'cand', e.name, 'since', e.t_ms, 'changes', s.changes)
      WHEN e.t_ms - s.since >= 200 THEN named_struct('room', e.name, 'cand', CAST(NULL AS STRING), 'since', CAST(0 AS BIGINT), 'changes', s.changes + 1) ELSE s END) AS s
  FROM (SELECT device_id, array_sort(collect_list(struct(t_ms, seq, name))) AS a FROM obs GROUP BY device_id))"""
_HOLD_STEPS = """WITH RECURSIVE numbered AS (SELECT device_id, t_ms, name, row_number() OVER (PARTITION BY device_id ORDER BY t_ms, seq) AS k, count(*) OVER (PARTITION BY device_id) AS n FROM obs),
  steps AS (SELECT device_id, k, n, name AS room, CAST(NULL AS STRING) AS cand, CAST(0 AS BIGINT) AS since, 0 AS changes FROM numbered WHERE k = 1
    UNION ALL SELECT r.device_id, r.k, r.n, CASE WHEN r.name <> s.room AND s.cand = r.name AND r.t_ms - s.since >= 200 THEN r.name ELSE s.room END,
      CASE WHEN r.name = s.room THEN NULL WHEN s.cand IS NULL OR s.cand <> r.name THEN r.name WHEN r.t_ms - s.since >= 200 THEN NULL ELSE s.cand END,
      CASE WHEN r.name = s.room THEN 0 WHEN s.cand IS NULL OR s.cand <> r.name THEN r.t_ms WHEN r.t_ms - s.since >= 200 THEN 0 ELSE s.since END,
      s.changes + CASE WHEN r.name <> s.room AND s.cand = r.name AND r.t_ms - s.since >= 200 THEN 1 ELSE 0 END
    FROM steps s JOIN numbered r ON r.device_id = s.device_id AND r.k = s.k + 1) SELECT device_id, room, CAST(changes AS INTEGER) AS changes FROM steps WHERE k = n"""

#: A filter of position and speed: the covariance of all axes is one 2 x 2 block, so the state is 4 means (x, y, speeds) and 3 numbers.
_DT = "least((e.t_ms - s.t) / 1000.0D, 5.0D)"
_S2 = "((0.5D / greatest(0.1D, e.c)) * (0.5D / greatest(0.1D, e.c)))"
_KALMAN = f"""SELECT device_id, round(s.x, 4) AS x, round(s.y, 4) AS y, round(s.vx, 4) AS vx, round(s.pp, 4) AS pp FROM (SELECT device_id, aggregate(slice(a, 2, size(a)),
    named_struct('t', a[0].t_ms, 'x', a[0].x, 'y', a[0].y, 'vx', 0.0D, 'vy', 0.0D, 'pp', (0.5D / greatest(0.1D, a[0].c)) * (0.5D / greatest(0.1D, a[0].c)), 'pv', 0.0D, 'vv', 4.0D),
    (s, e) -> CASE WHEN e.t_ms - s.t < 0 OR e.t_ms - s.t >= 30000 THEN named_struct('t', e.t_ms, 'x', e.x, 'y', e.y, 'vx', 0.0D, 'vy', 0.0D, 'pp', {_S2}, 'pv', 0.0D, 'vv', 4.0D)
      ELSE transform(array(named_struct('dt', {_DT}, 'pp', s.pp + 2 * {_DT} * s.pv + {_DT} * {_DT} * s.vv + 0.25D * {_DT} * {_DT} * {_DT} * {_DT} / 4, 'pv', s.pv + {_DT} * s.vv + 0.25D * {_DT} * {_DT} * {_DT} / 2, 'vv', s.vv + 0.25D * {_DT} * {_DT})),
        q -> named_struct('t', e.t_ms, 'x', s.x + q.dt * s.vx + q.pp / (q.pp + {_S2}) * (e.x - s.x - q.dt * s.vx), 'y', s.y + q.dt * s.vy + q.pp / (q.pp + {_S2}) * (e.y - s.y - q.dt * s.vy),
          'vx', s.vx + q.pv / (q.pp + {_S2}) * (e.x - s.x - q.dt * s.vx), 'vy', s.vy + q.pv / (q.pp + {_S2}) * (e.y - s.y - q.dt * s.vy),
          'pp', q.pp - q.pp * q.pp / (q.pp + {_S2}), 'pv', q.pv - q.pp * q.pv / (q.pp + {_S2}), 'vv', q.vv - q.pv * q.pv / (q.pp + {_S2})))[0] END) AS s
  FROM (SELECT device_id, array_sort(collect_list(struct(t_ms, seq, x, y, least(confidence / 100.0D, 1.0D) AS c))) AS a FROM upstream GROUP BY device_id))"""
_D = "least((r.t_ms - s.t_ms) / 1000.0D, 5.0D)"
_KALMAN_STEPS = f"""WITH RECURSIVE numbered AS (SELECT device_id, t_ms, x, y, (0.5D / greatest(0.1D, least(confidence / 100.0D, 1.0D))) * (0.5D / greatest(0.1D, least(confidence / 100.0D, 1.0D))) AS s2, row_number() OVER (PARTITION BY device_id ORDER BY t_ms, seq) AS k, count(*) OVER (PARTITION BY device_id) AS n FROM upstream),
  steps AS (SELECT device_id, t_ms, k, n, x, y, 0.0D AS vx, 0.0D AS vy, s2 AS pp, 0.0D AS pv, 4.0D AS vv FROM numbered WHERE k = 1
    UNION ALL SELECT device_id, t_ms, k, n, CASE WHEN fresh THEN zx ELSE x + dt * vx + qp / (qp + s2) * (zx - x - dt * vx) END, CASE WHEN fresh THEN zy ELSE y + dt * vy + qp / (qp + s2) * (zy - y - dt * vy) END,
      CASE WHEN fresh THEN 0.0D ELSE vx + qv / (qp + s2) * (zx - x - dt * vx) END, CASE WHEN fresh THEN 0.0D ELSE vy + qv / (qp + s2) * (zy - y - dt * vy) END,
      CASE WHEN fresh THEN s2 ELSE qp - qp * qp / (qp + s2) END, CASE WHEN fresh THEN 0.0D ELSE qv - qp * qv / (qp + s2) END, CASE WHEN fresh THEN 4.0D ELSE qw - qv * qv / (qp + s2) END
    FROM (SELECT r.device_id, r.t_ms, r.k, r.n, r.s2, r.x AS zx, r.y AS zy, s.x, s.y, s.vx, s.vy, r.t_ms - s.t_ms >= 30000 AS fresh, {_D} AS dt,
        s.pp + 2 * {_D} * s.pv + {_D} * {_D} * s.vv + 0.25D * {_D} * {_D} * {_D} * {_D} / 4 AS qp, s.pv + {_D} * s.vv + 0.25D * {_D} * {_D} * {_D} / 2 AS qv, s.vv + 0.25D * {_D} * {_D} AS qw
      FROM steps s JOIN numbered r ON r.device_id = s.device_id AND r.k = s.k + 1) q)
  SELECT device_id, round(x, 4) AS x, round(y, 4) AS y, round(vx, 4) AS vx, round(pp, 4) AS pp FROM steps WHERE k = n"""

#: Pushes of a node that the rate limit of 10 s lets through: it counts from the last one that went out.
_LIMIT = """SELECT node_id, e.seq AS seq, e.t_ms AS t_ms FROM (SELECT node_id, explode(aggregate(a, named_struct('last', CAST(NULL AS BIGINT), 'out', CAST(array() AS ARRAY<STRUCT<t_ms: BIGINT, seq: BIGINT>>)),
    (s, e) -> CASE WHEN s.last IS NULL OR e.t_ms - s.last >= 10000 THEN named_struct('last', e.t_ms, 'out', array_append(s.out, e)) ELSE s END, s -> s.out)) AS e
  FROM (SELECT node_id, array_sort(collect_list(named_struct('t_ms', CAST(t_ms AS BIGINT), 'seq', CAST(seq AS BIGINT)))) AS a FROM settings GROUP BY node_id))"""
_LIMIT_STEPS = """WITH RECURSIVE numbered AS (SELECT node_id, t_ms, seq, row_number() OVER (PARTITION BY node_id ORDER BY t_ms, seq) AS k FROM settings),
  steps AS (SELECT node_id, t_ms, seq, k, t_ms AS last, true AS goes FROM numbered WHERE k = 1
    UNION ALL SELECT r.node_id, r.t_ms, r.seq, r.k, CASE WHEN r.t_ms - s.last >= 10000 THEN r.t_ms ELSE s.last END, r.t_ms - s.last >= 10000 FROM steps s JOIN numbered r ON r.node_id = s.node_id AND r.k = s.k + 1)
  SELECT node_id, seq, t_ms FROM steps WHERE goes"""


#: Pins as they are recorded: the first one less than a metre away is taken up again and keeps its place, or a new one is added.
#: A click that is near a pin changes no place, so places come from the first clicks of a device and from those later that are near
#: none of them (of those at one place the first); then every click finds its pin among those of its square metre and of the eight
#: around, whichever task holds it. A pin is known by its first click's number: pins that share it are taken up together. A click
#: without a place is a pin of its own.
_NEAR = "sqrt((p.x - e.x) * (p.x - e.x) + (p.y - e.y) * (p.y - e.y)) < 1.0D"
_PLACES = f"""SELECT device_id, explode(aggregate(array_sort(collect_list(struct(t_ms, seq, x, y))), CAST(array() AS ARRAY<STRUCT<t_ms: BIGINT, seq: BIGINT, x: DOUBLE, y: DOUBLE>>),
    (s, e) -> CASE WHEN exists(s, p -> {_NEAR}) THEN s ELSE array_append(s, e) END)) AS p"""
_CELLS = """SELECT device_id, cx, cy, array_sort(collect_list(p)) AS ps FROM (SELECT device_id, p, cx, explode(sequence(floor(p.y) - 1, floor(p.y) + 1)) AS cy
    FROM (SELECT device_id, p, explode(sequence(floor(p.x) - 1, floor(p.x) + 1)) AS cx FROM {places})) GROUP BY device_id, cx, cy"""
_BESIDE = "e.device_id <=> c.device_id AND floor(e.x) = c.cx AND floor(e.y) = c.cy"
_PINS = f"""WITH recorded AS (SELECT device_id, CAST(t_ms AS BIGINT) AS t_ms, CAST(seq AS BIGINT) AS seq, x, y, coalesce(abs(x) < double('Infinity') AND abs(y) < double('Infinity'), false) AS placed FROM pin_events),
  early AS ({_PLACES} FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY t_ms, seq, x, y) AS k FROM recorded WHERE placed) WHERE k <= 1000 GROUP BY device_id),
  early_cells AS ({_CELLS.format(places="early")}),
  late AS ({_PLACES} FROM (SELECT device_id, m.t_ms AS t_ms, m.seq AS seq, x, y FROM (SELECT e.device_id, e.x, e.y, min(struct(e.t_ms, e.seq)) AS m FROM recorded e LEFT JOIN early_cells c ON {_BESIDE}
    WHERE e.placed AND NOT coalesce(exists(c.ps, p -> {_NEAR}), false) GROUP BY e.device_id, e.x, e.y)) GROUP BY device_id),
  nowhere AS (SELECT device_id, struct(t_ms, seq, x, y) AS p FROM recorded WHERE NOT placed),
  kin AS (SELECT device_id, struct(p.t_ms, p.seq, p.x, p.y, array_distinct(collect_list(p) OVER (PARTITION BY device_id, p.seq)) AS kin) AS p FROM (SELECT * FROM early UNION ALL SELECT * FROM late UNION ALL SELECT * FROM nowhere)),
  pin_cells AS ({_CELLS.format(places="(SELECT * FROM kin WHERE abs(p.x) < double('Infinity') AND abs(p.y) < double('Infinity'))")}),
  beside AS (SELECT e.device_id, struct(e.t_ms, e.seq, e.x, e.y) AS e, get(filter(c.ps, p -> {_NEAR}), 0) AS p FROM recorded e LEFT JOIN pin_cells c ON {_BESIDE} WHERE e.placed),
  taken AS (SELECT device_id, e.t_ms AS t_ms, e.seq AS seq, false AS alone, explode(CASE WHEN struct(p.t_ms, p.seq, p.x, p.y) = e THEN array(e) ELSE filter(p.kin, q -> q.seq = p.seq AND q <= e) END) AS p FROM beside
    UNION ALL SELECT device_id, p.t_ms, p.seq, true, p FROM nowhere)
  SELECT device_id, first_seq, last_seq, n - copies + 1 AS n, x, y FROM (SELECT *, explode(sequence(1, copies)) AS copy FROM (
    SELECT device_id, p.seq AS first_seq, max_by(seq, struct(t_ms, seq)) AS last_seq, count(*) AS n, greatest(count_if(alone), 1) AS copies, round(p.x, 6) AS x, round(p.y, 6) AS y FROM taken GROUP BY device_id, p))"""
_PINS_STEPS = """WITH RECURSIVE numbered AS (SELECT device_id, seq, x, y, row_number() OVER (PARTITION BY device_id ORDER BY t_ms, seq) AS k, count(*) OVER (PARTITION BY device_id) AS total FROM pin_events),
  steps AS (SELECT device_id, k, total, [{'x': x, 'y': y, 'first': CAST(seq AS BIGINT), 'last': CAST(seq AS BIGINT), 'n': CAST(1 AS BIGINT)}] AS s FROM numbered WHERE k = 1
    UNION ALL SELECT r.device_id, r.k, r.total, CASE WHEN len(list_filter(t.s, lambda p: sqrt((p.x - r.x) * (p.x - r.x) + (p.y - r.y) * (p.y - r.y)) < 1.0D)) > 0
      THEN list_transform(t.s, lambda p: CASE WHEN p.first = list_filter(t.s, lambda q: sqrt((q.x - r.x) * (q.x - r.x) + (q.y - r.y) * (q.y - r.y)) < 1.0D)[1].first THEN {'x': p.x, 'y': p.y, 'first': p.first, 'last': CAST(r.seq AS BIGINT), 'n': p.n + 1} ELSE p END)
      ELSE list_append(t.s, {'x': r.x, 'y': r.y, 'first': CAST(r.seq AS BIGINT), 'last': CAST(r.seq AS BIGINT), 'n': CAST(1 AS BIGINT)}) END FROM steps t JOIN numbered r ON r.device_id = t.device_id AND r.k = t.k + 1)
  SELECT device_id, p.first AS first_seq, p.last AS last_seq, p.n AS n, round(p.x, 6) AS x, round(p.y, 6) AS y FROM (SELECT device_id, unnest(s) AS p FROM steps WHERE k = total) z"""


#: Least number of doors between rooms of a site: breadth first from every room, over the one array of the site's ways.
_HOPS = """SELECT site, a, h.b AS b, h.hops AS hops FROM (SELECT r.site, r.room_id AS a, explode(aggregate(sequence(1, coalesce(size(w.ways), 0) + 1), array(named_struct('b', r.room_id, 'hops', 0)),
    (s, k) -> concat(s, transform(array_distinct(transform(filter(coalesce(w.ways, array()), e -> exists(s, x -> x.b = e.a AND x.hops = k - 1) AND NOT exists(s, x -> x.b = e.b)), e -> e.b)), b -> named_struct('b', b, 'hops', k))))) AS h
  FROM h_rooms r LEFT JOIN (SELECT site, collect_list(struct(a, b)) AS ways FROM (SELECT site, a, b FROM h_walk UNION ALL SELECT site, b, a FROM h_walk) u GROUP BY site) w ON r.site = w.site)"""

_SQL = {"w02_smoothed_distance": _SMOOTH, "w04_kalman": _KALMAN, "w05_position_ema": _EMA, "w06_hysteresis": _HOLD, "w10_rate_limit": _LIMIT, "m01_recorded_pins": _PINS, "g17_hops": _HOPS}
QUERIES = {k: spark_sql(with_(v)) for k, v in _SQL.items()}
_STEPS = {"w02_smoothed_distance": _SMOOTH_STEPS, "w04_kalman": _KALMAN_STEPS, "w05_position_ema": _EMA_STEPS, "w06_hysteresis": _HOLD_STEPS, "w10_rate_limit": _LIMIT_STEPS, "m01_recorded_pins": _PINS_STEPS, "g17_hops": sites.HOPS}
ORACLES = {k: with_(v, engine="duckdb") for k, v in _STEPS.items()}
