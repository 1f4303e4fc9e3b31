"""Device settings, read models, scalar functions over columns, outboxes, and the solved path-loss regression."""

from __future__ import annotations

CURRENT = """current_n AS (SELECT node_id, absorption FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY t_ms DESC, seq DESC) AS k FROM absorptions) z WHERE k = 1)"""

#: Weighted normal equations of 10 * n * log10(measured) on 10 * log10(distance), inner walls, outer walls and doors; every pair of nodes weighs the same.
NORMAL = """by_pair AS (SELECT g.listener_id, g.transmitter_id, CAST(count(*) AS DOUBLE) AS c, avg(10.0D * log10(g.true_dist)) AS x, avg(10.0D * g.absorption * log10(g.measured)) AS y,
      avg(100.0D * log10(g.true_dist) * g.absorption * log10(g.measured)) AS xy, avg(10.0D * g.absorption * log10(g.measured) * 10.0D * g.absorption * log10(g.measured)) AS yy
    FROM gt_samples g WHERE g.measured > 0.1D AND g.true_dist > 1.0D AND g.absorption > 0.1D GROUP BY g.listener_id, g.transmitter_id),
  rows_ AS (SELECT p.*, CAST(w.interior AS DOUBLE) AS i, CAST(w.exterior AS DOUBLE) AS e, CAST(w.doors AS DOUBLE) AS d FROM by_pair p JOIN counted w ON least(p.listener_id, p.transmitter_id) = w.a AND greatest(p.listener_id, p.transmitter_id) = w.b),
  normal AS (SELECT count(*) AS pairs, CAST(sum(c) AS BIGINT) AS samples, sum(x * x) AS xx, sum(x * i) AS xi, sum(x * e) AS xe, sum(x * d) AS xd, sum(i * i) AS ii, sum(i * e) AS ie, sum(i * d) AS id, sum(e * e) AS ee, sum(e * d) AS ed, sum(d * d) AS dd,
      sum(xy) AS xy, sum(i * y) AS iy, sum(e * y) AS ey, sum(d * y) AS dy, sum(y) AS sy, sum(yy) AS yy FROM rows_),
  ridged AS (SELECT *, xx * 1.02D AS a00, xi AS a01, xe AS a02, xd AS a03, ii * 1.1D AS a11, ie AS a12, id AS a13, ee * 1.2D AS a22, ed AS a23, dd * 2.0D AS a33,
      xy + 0.02D * xx * 3.0D AS b0, iy + 0.1D * ii * 4.0D AS b1, ey + 0.2D * ee * 10.0D AS b2, dy AS b3 FROM normal),
  first_ AS (SELECT *, a11 - a01 * a01 / a00 AS c11, a12 - a01 * a02 / a00 AS c12, a13 - a01 * a03 / a00 AS c13, a22 - a02 * a02 / a00 AS c22, a23 - a02 * a03 / a00 AS c23, a33 - a03 * a03 / a00 AS c33,
      b1 - a01 * b0 / a00 AS f1, b2 - a02 * b0 / a00 AS f2, b3 - a03 * b0 / a00 AS f3 FROM ridged WHERE pairs >= 10 AND a00 > 1e-12),
  second_ AS (SELECT *, c22 - c12 * c12 / c11 AS g22, c23 - c12 * c13 / c11 AS g23, c33 - c13 * c13 / c11 AS g33, f2 - c12 * f1 / c11 AS h2, f3 - c13 * f1 / c11 AS h3 FROM first_ WHERE c11 > 1e-12),
  third_ AS (SELECT *, (h3 - g23 * h2 / g22) / (g33 - g23 * g23 / g22) AS beta3 FROM second_ WHERE g22 > 1e-12 AND g33 - g23 * g23 / g22 > 1e-12),
  solved_ AS (SELECT *, (f1 - c12 * beta2 - c13 * beta3) / c11 AS beta1 FROM (SELECT *, (h2 - g23 * beta3) / g22 AS beta2 FROM third_) t),
  beta AS (SELECT *, (b0 - a01 * beta1 - a02 * beta2 - a03 * beta3) / a00 AS beta0 FROM solved_)"""
#: The squares of distances differ within a pair only by their mean, as a pair's distance is fixed.
ERROR = """greatest(yy - 2.0D * (beta0 * xy + beta1 * iy + beta2 * ey + beta3 * dy) + beta0 * beta0 * xx + beta1 * beta1 * ii + beta2 * beta2 * ee + beta3 * beta3 * dd
      + 2.0D * (beta0 * beta1 * xi + beta0 * beta2 * xe + beta0 * beta3 * xd + beta1 * beta2 * ie + beta1 * beta3 * id + beta2 * beta3 * ed), 0.0D)"""

QUERIES: dict[str, str] = {
    "s07_device_config": "SELECT original_id, alias, name, ref_rssi FROM device_settings",
    "j15_settings_by_alias": """SELECT d.device_id, coalesce(a.name, b.name) AS name, coalesce(a.ref_rssi, b.ref_rssi) AS ref_rssi, CASE WHEN a.original_id IS NOT NULL THEN 'id' WHEN b.alias IS NOT NULL THEN 'alias' ELSE 'none' END AS found_by
        FROM (SELECT DISTINCT device_id FROM obs UNION SELECT DISTINCT alias FROM device_settings WHERE alias IS NOT NULL) d LEFT JOIN device_settings a ON d.device_id = a.original_id
        LEFT JOIN (SELECT alias, name, ref_rssi FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY original_id) AS k FROM device_settings WHERE alias IS NOT NULL) s WHERE k = 1) b ON d.device_id = b.alias""",
    "j06_points_in_rooms": "SELECT seq, round(x, 6) AS x, round(y, 6) AS y, room_id FROM located",
    "j07_edge_adjacency": "SELECT least(a, b) AS a, greatest(a, b) AS b FROM shared_edges",
    "j08_path_walls": "SELECT a, b, wall, exterior, round(t, 6) AS t FROM crossed",
    "j14_rooms_of_nodes": "SELECT n.node_id, n.room_label, r.room_id, n.room_label IS NOT NULL AS explicit FROM all_nodes n LEFT JOIN node_rooms r ON n.node_id = r.node_id",
    "f12_unconfigured_online": """SELECT s.node_id, s.t_ms FROM (SELECT node_id, payload, t_ms, row_number() OVER (PARTITION BY node_id ORDER BY t_ms DESC, seq DESC) AS k FROM parsed WHERE kind = 'status') s
        LEFT JOIN all_nodes n ON s.node_id = n.node_id WHERE s.k = 1 AND n.node_id IS NULL AND lower(trim(s.payload)) = 'online'""",
    "f13_visible_devices": "SELECT device_id, last_seen FROM (SELECT device_id, max(t_ms) AS last_seen FROM obs GROUP BY device_id) d CROSS JOIN (SELECT max(t_ms) AS now_ms FROM obs) n WHERE n.now_ms - d.last_seen <= 10000",
    "f16_restored_rows": """SELECT seq, node_id, old_value, new_value, t_ms FROM (SELECT seq, {json: line; nodeId} AS node_id, {num: {json: line; oldValue}} AS old_value, {num: {json: line; newValue}} AS new_value, CAST({num: {json: line; timestamp}} AS BIGINT) AS t_ms
        FROM audit_lines WHERE {isjson: line}) a WHERE node_id IS NOT NULL AND old_value IS NOT NULL AND new_value IS NOT NULL AND t_ms > 0""",
    "s11_audit_load": """SELECT seq, node_id, t_ms FROM (SELECT seq, {json: line; nodeId} AS node_id, {num: {json: line; newValue}} AS new_value, CAST({num: {json: line; timestamp}} AS BIGINT) AS t_ms FROM audit_lines WHERE {isjson: line}) a
        WHERE node_id IS NOT NULL AND new_value IS NOT NULL AND t_ms > 0 ORDER BY seq LIMIT 200""",
    "p08_significant_change": f"WITH {CURRENT} SELECT f.listener_id AS node_id, round(f.n - c.absorption, 6) AS change, abs(f.n - c.absorption) >= 0.05D AS selected FROM node_fits f JOIN current_n c ON f.listener_id = c.node_id",
    "p09_rate_limits": """SELECT node_id, last_ms + 10000 - now_ms AS clears_in, row_number() OVER (ORDER BY last_ms, node_id) AS place FROM (SELECT node_id, max(t_ms) AS last_ms FROM settings GROUP BY node_id) s
        CROSS JOIN (SELECT max(t_ms) AS now_ms FROM settings) n WHERE last_ms + 10000 - now_ms > 0""",
    "t10_pairs_by_change": "SELECT listener_id, transmitter_id, row_number() OVER (ORDER BY round(abs(n - mean_n), 9) DESC, listener_id, transmitter_id) AS place FROM (SELECT *, avg(n) OVER (PARTITION BY listener_id) AS mean_n FROM pair_fits) p",
    "t07_two_closest": "SELECT device_id, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY d, i) AS k FROM fixes) f WHERE k <= 2 GROUP BY device_id",
    "t09_nearest_fix": "SELECT device_id, node_id, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY d, i) AS k FROM fixes) f WHERE k = 1",
    "u03_snapshot_or_bias": """SELECT device_id, node_id FROM fixes UNION SELECT p.device_id, f.node_id FROM pins p JOIN obs f ON p.device_id = f.device_id JOIN nodes n ON f.node_id = n.node_id
        WHERE f.distance IS NOT NULL AND sqrt((p.x-n.x)*(p.x-n.x)+(p.y-n.y)*(p.y-n.y)+(p.z-n.z)*(p.z-n.z)) >= 1.0D""",
    "x03_sample_exponent": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(n, 6) AS n FROM gt_valid",
    "x05_forward_model": f"WITH {CURRENT} SELECT o.seq, round(CASE WHEN o.distance <= 0 OR f.n <= 0 OR c.absorption <= 0 THEN o.distance ELSE power(o.distance, f.n / c.absorption) END, 6) AS expected FROM obs o JOIN node_fits f ON o.node_id = f.listener_id JOIN current_n c ON o.node_id = c.node_id WHERE o.distance IS NOT NULL",
    "x08_implied_rssi": f"WITH {CURRENT} SELECT o.seq, round(coalesce(CASE WHEN o.seq % 5 > 0 THEN o.rssi END, -59.0D - 10.0D * coalesce(c.absorption, 2.7D) * log10(greatest(0.1D, o.distance))), 6) AS rssi FROM obs o LEFT JOIN current_n c ON o.node_id = c.node_id WHERE o.distance IS NOT NULL",
    "x12_inverse": """SELECT listener_id, round((e * i - f * f) / det, 4) AS m00, round((c * f - b * i) / det, 4) AS m01, round((b * f - c * e) / det, 4) AS m02, round((a * i - c * c) / det, 4) AS m11, round((b * c - a * f) / det, 4) AS m12, round((a * e - b * b) / det, 4) AS m22
        FROM (SELECT *, a * (e * i - f * f) - b * (b * i - c * f) + c * (b * f - c * e) AS det FROM (SELECT listener_id, CAST(count(*) AS DOUBLE) AS a, sum(ln(mean_true)) AS b, sum(n) AS c, sum(ln(mean_true) * ln(mean_true)) + 0.1D AS e, sum(ln(mean_true) * n) AS f, sum(n * n) + 0.1D AS i FROM pair_fits GROUP BY listener_id) m) q WHERE abs(det) >= 1e-12""",
    "x26_open_to": """SELECT seq, target, coalesce({num: {json: line; doorX}}, NULL) AS door_x, coalesce({num: {json: line; width}}, 0.8D) AS width, lower(target) = 'outside' AS is_outside
        FROM (SELECT seq, line, coalesce({json: line; id}, CASE WHEN line LIKE '"%' THEN replace(line, '"', '') END) AS target FROM open_lines) o""",
    "x28_iso_dates": "SELECT seq, coalesce(CAST({div: {us: try_cast(text AS TIMESTAMP)}; 1000} AS BIGINT), CAST(1704067200000 AS BIGINT)) AS t_ms FROM (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 7 = 0 THEN 'soon' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) || 'T00:00:00' END AS text FROM {t:orders}) d",
    "x29_zone_ids": """SELECT p_partkey, CASE WHEN k = 1 THEN base ELSE base || '_' || CAST(k AS STRING) END AS zone_id FROM (SELECT p_partkey, base, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS k
        FROM (SELECT p_partkey, {rx: {rx: lower(p_brand); '[^a-z0-9]+'; '_'}; '^_+|_+$'; ''} AS base FROM {t:part}) b) z""",
    "k02_config_outbox": """SELECT 'site/settings/' || original_id || '/config' AS topic, '{"id":"' || coalesce(alias, original_id) || '","name":"' || name || '","rssi@1m":' || CAST(ref_rssi AS STRING) || '}' AS payload, 1 AS qos, true AS retain FROM device_settings""",
    "k03_presence_outbox": """SELECT 'site/presence/' || device_id AS topic, state AS payload, 1 AS qos, false AS retain, seq FROM (SELECT *, lag(state) OVER (PARTITION BY device_id ORDER BY t_ms, seq) AS before FROM (
        SELECT device_id, seq, t_ms, coalesce(room_id, 'not_home') AS state FROM located) a) b WHERE before IS NULL OR before <> state""",
    # sums of a weight above 10,000 are all scaled down to it
    "w11_clamped": """SELECT listener_id, transmitter_id, round(w * f, 6) AS w, round(sn * f, 6) AS sum_n, round(sn2 * f, 6) AS sum_n2, round(st * f, 6) AS sum_true, round(sm * f, 6) AS sum_measured, w > 10000.0D AS clamped
        FROM (SELECT *, CASE WHEN w > 10000.0D THEN 10000.0D / w ELSE 1.0D END AS f FROM pair_merged) p""",
    "z06_away_rows": """SELECT device_id, seq, t_ms + 2000 AS t_ms, 'not_home' AS state FROM (SELECT device_id, seq, t_ms, lead(t_ms) OVER (PARTITION BY device_id ORDER BY t_ms, seq) AS next_ms FROM upstream) o WHERE next_ms IS NULL OR next_ms - t_ms > 2000""",
    "z07_upstream_offsets": """SELECT device_id, count(*) AS n, round(avg(off), 6) AS mean, round(CASE WHEN count(*) < 2 THEN 0.0D ELSE stddev_pop(off) END, 6) AS sigma FROM (
        SELECT u.device_id, sqrt((u.x - n.x) * (u.x - n.x) + (u.y - n.y) * (u.y - n.y)) AS off FROM (SELECT device_id, seq, is_up, x, y, {lastn: node_id} OVER (PARTITION BY device_id ORDER BY t_ms, is_up, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS node_id
          FROM (SELECT device_id, seq, t_ms, 0 AS is_up, node_id, CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS y FROM obs WHERE distance IS NOT NULL UNION ALL SELECT device_id, seq, t_ms, 1, CAST(NULL AS STRING), x, y FROM upstream) v) u JOIN nodes n ON u.node_id = n.node_id WHERE u.is_up = 1) o GROUP BY device_id""",
    "m02_active_pins": """SELECT device_id, pin_ts, k = 1 AS active, CASE WHEN k = 1 THEN pin_ts * 1000 + 1800000 ELSE 0 END AS active_until_ms FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY pin_ts DESC) AS k FROM pins) p""",
    "m03_moved_pins": """SELECT p.device_id, p.pin_ts, CASE WHEN p.pin_ts % 5 = 0 THEN p.y ELSE p.x END AS x, CASE WHEN p.pin_ts % 5 = 0 THEN p.x ELSE p.y END AS y, CASE WHEN p.pin_ts % 5 = 0 THEN CAST(0 AS BIGINT) ELSE coalesce(b.n, CAST(0 AS BIGINT)) END AS bias_samples, p.pin_ts % 5 <> 0 AS keeps_state
        FROM pins p LEFT JOIN (SELECT device_id, count(*) AS n FROM obs WHERE distance IS NOT NULL GROUP BY device_id) b ON p.device_id = b.device_id""",
    "m07_options": """SELECT seq, {json: line; enabled} = 'true' AS enabled, CASE WHEN {num: {json: line; minDelta}} > 0 THEN {num: {json: line; minDelta}} ELSE 0.1D END AS min_delta, CASE WHEN {num: {json: line; intervalMs}} > 0 THEN CAST({num: {json: line; intervalMs}} AS BIGINT) ELSE CAST(300000 AS BIGINT) END AS interval_ms FROM option_lines""",
    "w18_comparison_as_of": """SELECT device_id, seq, t_ms, round(x, 6) AS x, round(y, 6) AS y FROM (SELECT device_id, seq, t_ms, is_up, {lastn: x} OVER (PARTITION BY device_id ORDER BY t_ms, is_up DESC, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x,
          {lastn: y} OVER (PARTITION BY device_id ORDER BY t_ms, is_up DESC, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y
        FROM (SELECT device_id, seq, t_ms, 0 AS is_up, CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS y FROM obs UNION ALL SELECT device_id, seq, t_ms, 1, x, y FROM upstream) u) v WHERE is_up = 0""",
    "k04_calibration_rows": "SELECT listener_id, transmitter_id, round(w, 6) AS w, round(w * n, 6) AS sum_n, last_ms, 1 AS version FROM pair_stats",
    "k05_pin_owners": "SELECT d.device_id, coalesce(p.pins, 0) AS pins, coalesce(u.compared, 0) AS compared, 1 AS version FROM (SELECT device_id FROM pins UNION SELECT device_id FROM upstream) d LEFT JOIN (SELECT device_id, count(*) AS pins FROM pins GROUP BY device_id) p ON d.device_id = p.device_id LEFT JOIN (SELECT device_id, count(*) AS compared FROM upstream GROUP BY device_id) u ON d.device_id = u.device_id",
    "k06_audit_rows": "SELECT node_id, seq, t_ms, 1 AS version FROM settings ORDER BY t_ms DESC, seq DESC LIMIT 200",
    "s09_calibration_load": """SELECT seq, listener_id, transmitter_id, w, sum_n, last_ms FROM (SELECT seq, {json: line; listener} AS listener_id, {json: line; transmitter} AS transmitter_id, {num: {json: line; W}} AS w, {num: {json: line; SumN}} AS sum_n, CAST({num: {json: line; lastUpdateMs}} AS BIGINT) AS last_ms
        FROM stat_lines WHERE {isjson: line}) a WHERE listener_id IS NOT NULL AND transmitter_id IS NOT NULL AND w > 0 AND sum_n IS NOT NULL AND last_ms > 0""",
    "s10_pins_load": """SELECT seq, device_id, x, y, z, pin_ts, false AS active FROM (SELECT seq, {json: line; deviceId} AS device_id, {num: {json: line; x}} AS x, {num: {json: line; y}} AS y, {num: {json: line; z}} AS z, CAST({num: {json: line; timestamp}} AS BIGINT) AS pin_ts
        FROM pin_lines WHERE {isjson: line}) a WHERE device_id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL""",
    "g14_wall_refs": """SELECT node_id, wall, round(along, 6) AS along, round(apart, 6) AS apart, round(corner, 6) AS corner FROM (SELECT q.*, row_number() OVER (PARTITION BY node_id ORDER BY round(apart, 9), wall) AS k FROM (
          SELECT node_id, wall, t * sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)) AS along, sqrt((x - ax - t * (bx - ax)) * (x - ax - t * (bx - ax)) + (y - ay - t * (b_y - ay)) * (y - ay - t * (b_y - ay))) AS apart,
            least(sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay)), sqrt((x - bx) * (x - bx) + (y - b_y) * (y - b_y))) AS corner
          FROM (SELECT n.node_id, n.x, n.y, s.wall, s.ax, s.ay, s.bx, s.b_y, least(greatest(((n.x - s.ax) * (s.bx - s.ax) + (n.y - s.ay) * (s.b_y - s.ay)) / ((s.bx - s.ax) * (s.bx - s.ax) + (s.b_y - s.ay) * (s.b_y - s.ay)), 0.0D), 1.0D) AS t FROM all_nodes n CROSS JOIN solid s) p) q) r WHERE k = 1""",
    # without a wall of some kind on any path the equations have no solution: the row then holds counts only
    "a13_rf_fit": f"""WITH {NORMAL}, fitted AS (SELECT samples AS of_samples, round(least(greatest(beta0, 1.5D), 8.0D), 4) AS exponent, round(least(greatest(beta1, 0.0D), 30.0D), 4) AS wall_db, round(least(greatest(beta2, 0.0D), 30.0D), 4) AS exterior_db, round(least(greatest(beta3, 0.0D), 30.0D), 4) AS door_db,
        round(CASE WHEN yy - sy * sy / pairs > 1e-9 THEN greatest(0.0D, 1.0D - {ERROR} / (yy - sy * sy / pairs)) ELSE 0.0D END, 4) AS r2, round(sqrt({ERROR} / greatest(1.0D, pairs - 4.0D)), 4) AS residual_db FROM beta)
        SELECT n.samples, n.pairs, f.exponent, f.wall_db, f.exterior_db, f.door_db, f.r2, f.residual_db FROM normal n LEFT JOIN fitted f ON n.samples = f.of_samples""",
}
