"""Ingest, filters, row views, scalar functions."""

from __future__ import annotations

QUERIES: dict[str, str] = {
    "s02_topic_parse": "SELECT seq, t_ms, topic, kind, node_id, device_id, setting FROM parsed",
    "s03_device_payload": """SELECT seq, t_ms, device_id, node_id, {json: payload; name} AS name, CAST({json: payload; distance} AS DOUBLE) AS distance_cm,
        CAST(coalesce({json: payload; refRssi}, {json: payload; ref_rssi}) AS DOUBLE) AS ref_rssi FROM parsed WHERE kind = 'device' AND {isjson: payload}""",
    "s04_node_status": """SELECT node_id, lower(trim(status)) = 'online' AS online, status_at FROM (SELECT node_id, payload AS status, t_ms AS status_at,
        row_number() OVER (PARTITION BY node_id ORDER BY t_ms DESC, seq DESC) AS k FROM parsed WHERE kind = 'status') s WHERE k = 1""",
    "s05_telemetry": """SELECT node_id, t_ms, CAST({json: payload; uptime} AS BIGINT) AS uptime, CAST({json: payload; freeHeap} AS BIGINT) AS free_heap, {json: payload; version} AS version, true AS online
        FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY t_ms DESC, seq DESC) AS k FROM parsed WHERE kind = 'telemetry') s WHERE k = 1""",
    "s06_upstream_positions": """SELECT device_id, seq, t_ms, round(x, 6) AS x, round(y, 6) AS y, round(least(greatest(confidence / 100.0D, 0.0D), 1.0D), 6) AS confidence FROM upstream WHERE x IS NOT NULL AND y IS NOT NULL""",
    "s12_ruler_history": "SELECT id, label, round(config_distance, 6) AS config_distance, round(actual_distance, 6) AS actual_distance FROM ruler",
    "f01_tracked": """SELECT o.device_id, o.name, o.n FROM (SELECT device_id, name, count(*) AS n FROM obs GROUP BY device_id, name) o
        WHERE NOT EXISTS (SELECT 1 FROM rules r WHERE r.kind = 'exclude' AND (o.device_id LIKE r.id_like ESCAPE '!' OR o.name LIKE r.name_like ESCAPE '!'))
          AND ((SELECT count(*) FROM rules WHERE kind = 'include') = 0 OR EXISTS (SELECT 1 FROM rules r WHERE r.kind = 'include' AND (o.device_id LIKE r.id_like ESCAPE '!' OR o.name LIKE r.name_like ESCAPE '!')))""",
    "f02_message_kinds": "SELECT kind, count(*) AS n, min(t_ms) AS first_ms, max(t_ms) AS last_ms FROM parsed GROUP BY kind",
    "f03_fresh_fixes": """SELECT f.device_id, f.node_id, f.t_ms FROM fix_last f JOIN (SELECT device_id, max(t_ms) AS now_ms FROM obs GROUP BY device_id) t ON f.device_id = t.device_id WHERE f.t_ms >= t.now_ms - 30000""",
    "f04_valid_distance": "SELECT seq, device_id, node_id, round(distance, 6) AS distance FROM obs WHERE distance IS NOT NULL",
    "f05_gt_valid": "SELECT listener_id, transmitter_id, count(*) AS n FROM gt_samples WHERE measured > 0 AND true_dist > 1.0D GROUP BY listener_id, transmitter_id",
    "f06_plausible_exponent": "SELECT listener_id, count(*) AS n, round(min(n), 6) AS least_n, round(max(n), 6) AS most_n FROM gt_valid WHERE n >= 1.5D AND n <= 8.0D GROUP BY listener_id",
    "f07_rf_valid": "SELECT listener_id, transmitter_id, count(*) AS n FROM gt_samples WHERE measured > 0.1D AND true_dist > 1.0D AND absorption > 0.1D GROUP BY listener_id, transmitter_id",
    "f08_absorption": "SELECT node_id, t_ms, value, round(absorption, 6) AS absorption FROM absorptions",
    "f10_nodes_on_floor": "SELECT node_id, x, y, z FROM all_nodes WHERE x IS NOT NULL AND y IS NOT NULL",
    "f17_node_index": "SELECT node_id, x, y, z FROM all_nodes WHERE enabled",
    "w01_latest": "SELECT device_id, node_id, seq, t_ms, round(distance, 6) AS distance, round(rssi, 6) AS rssi FROM fix_last",
    "a19_device_row": """SELECT device_id, count(distance) AS fixes, min(CASE WHEN k = 1 AND distance IS NOT NULL THEN node_id END) AS closest_node, round(min(distance), 6) AS closest, round(max(rssi), 6) AS strongest_rssi
        FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY CASE WHEN distance IS NULL THEN 1 ELSE 0 END, distance, node_id) AS k FROM fix_last) f GROUP BY device_id""",
    "a20_status": "SELECT (SELECT count(*) FROM all_nodes) AS nodes, (SELECT count(DISTINCT device_id) FROM obs) AS devices, (SELECT count(*) FROM messages) AS messages, (SELECT max(t_ms) FROM obs) AS last_ms",
    "t01_by_distance": "SELECT device_id, node_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY device_id ORDER BY CASE WHEN distance IS NULL THEN 1 ELSE 0 END, distance, node_id) AS place FROM fix_last",
    # ranks over all devices: a rank within a stretch of the order, and the number of devices in the stretches before
    "t04_recent_devices": """SELECT d.device_id, d.last_seen, b.before + row_number() OVER (PARTITION BY d.stretch ORDER BY d.last_seen DESC, d.device_id) AS place
        FROM (SELECT device_id, last_seen, {div: last_seen; 500} AS stretch FROM (SELECT device_id, max(t_ms) AS last_seen FROM obs GROUP BY device_id) a) d
        JOIN (SELECT stretch, CAST(sum(n) OVER (ORDER BY stretch DESC) - n AS BIGINT) AS before FROM (SELECT {div: last_seen; 500} AS stretch, count(*) AS n FROM (SELECT max(t_ms) AS last_seen FROM obs GROUP BY device_id) a GROUP BY {div: last_seen; 500}) c) b ON d.stretch = b.stretch""",
    "t06_three_closest": "SELECT device_id, node_id, k FROM (SELECT device_id, node_id, row_number() OVER (PARTITION BY device_id ORDER BY d, i) AS k FROM fixes) f WHERE k <= 3",
    "t11_device_order": """SELECT d.device_id, b.before + row_number() OVER (PARTITION BY d.stretch ORDER BY d.device_id) AS place FROM (SELECT DISTINCT device_id, substring(device_id, 1, 6) AS stretch FROM obs) d
        JOIN (SELECT stretch, CAST(sum(n) OVER (ORDER BY stretch) - n AS BIGINT) AS before FROM (SELECT substring(device_id, 1, 6) AS stretch, count(DISTINCT device_id) AS n FROM obs GROUP BY substring(device_id, 1, 6)) c) b ON d.stretch = b.stretch""",
    "u01_device_union": "SELECT device_id FROM pins UNION SELECT device_id FROM obs",
    "u02_node_union": "SELECT listener_id AS node_id FROM gt_samples UNION SELECT node_id FROM settings UNION SELECT node_id FROM obs",
    "u07_nodes_then_others": """SELECT node_id, true AS configured FROM all_nodes UNION ALL SELECT s.node_id, false FROM (SELECT DISTINCT node_id FROM parsed WHERE kind = 'status') s
        LEFT JOIN nodes n ON s.node_id = n.node_id WHERE n.node_id IS NULL""",
    "j01_known_fixes": "SELECT o.seq, o.device_id, o.node_id, n.x, n.y, n.z FROM obs o JOIN nodes n ON o.node_id = n.node_id",
    "j10_calibration": """SELECT coalesce(g.node_id, s.node_id) AS node_id, coalesce(g.n, 0) AS gt_count, round(g.bias, 6) AS bias, s.value, row_number() OVER (ORDER BY CASE WHEN g.n > 0 THEN 2 ELSE 0 END DESC, abs(coalesce(g.bias, 0.0D)) DESC, coalesce(g.node_id, s.node_id)) AS place
        FROM (SELECT listener_id AS node_id, count(*) AS n, avg(measured - true_dist) AS bias FROM gt_samples GROUP BY listener_id) g
        FULL JOIN (SELECT node_id, value FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY t_ms DESC, seq DESC) AS k FROM settings) z WHERE k = 1) s ON g.node_id = s.node_id""",
    "j11_configured_nodes": """SELECT n.node_id, n.enabled, coalesce(lower(trim(s.payload)) = 'online', false) AS online FROM all_nodes n LEFT JOIN (
        SELECT node_id, payload FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY t_ms DESC, seq DESC) AS k FROM parsed WHERE kind = 'status') z WHERE k = 1) s ON n.node_id = s.node_id""",
    "j19_upstream_as_of": """SELECT device_id, seq, t_ms, node_id AS last_node FROM (SELECT device_id, seq, t_ms, is_up, {lastn: node_id} OVER (PARTITION BY device_id ORDER BY t_ms, is_up, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS node_id
        FROM (SELECT device_id, seq, t_ms, 0 AS is_up, node_id FROM obs WHERE distance IS NOT NULL UNION ALL SELECT device_id, seq, t_ms, 1, CAST(NULL AS STRING) FROM upstream) u) v WHERE is_up = 1""",
    "j21_setting_as_of": """SELECT listener_id, t_ms, k1, k2, k3, round(absorption, 6) AS absorption FROM (SELECT listener_id, t_ms, k1, k2, k3, is_sample,
          {lastn: absorption} OVER (PARTITION BY listener_id ORDER BY t_ms, is_sample, k1, k2, k3 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS absorption
        FROM (SELECT listener_id, t_ms, l_orderkey AS k1, l_partkey AS k2, CAST(l_linenumber AS BIGINT) AS k3, 1 AS is_sample, CAST(NULL AS DOUBLE) AS absorption FROM gt_samples
          UNION ALL SELECT node_id, t_ms * 1000, seq, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0, absorption FROM absorptions) u) v WHERE is_sample = 1""",
    # a node counts from its first message to 30 s after the last of a run; starts and ends add up along each device's time
    "j20_snapshot_sizes": """SELECT device_id, seq, CAST(fixes AS BIGINT) AS fixes FROM (
          SELECT device_id, seq, is_end, sum(step) OVER (PARTITION BY device_id ORDER BY t_ms, is_end, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fixes FROM (
            SELECT device_id, seq, t_ms, 0 AS is_end, CASE WHEN before IS NULL OR t_ms - before > 30000 THEN 1 ELSE 0 END AS step FROM (
              SELECT device_id, seq, t_ms, lag(t_ms) OVER (PARTITION BY device_id, node_id ORDER BY t_ms, seq) AS before FROM obs) a
            UNION ALL SELECT device_id, seq, t_ms + 30000, 1, -1 FROM (
              SELECT device_id, seq, t_ms, lead(t_ms) OVER (PARTITION BY device_id, node_id ORDER BY t_ms, seq) AS after FROM obs) b WHERE after IS NULL OR after - t_ms > 30000) e) s WHERE is_end = 0""",
    "w03_ring_buffer": "SELECT listener_id, count(*) AS kept, min(t_ms) AS first_ms, max(t_ms) AS last_ms FROM ring GROUP BY listener_id",
    "w09_changes": "SELECT device_id, seq, name FROM (SELECT device_id, seq, name, lag(name) OVER (PARTITION BY device_id ORDER BY t_ms, seq) AS before FROM obs) o WHERE before IS NULL OR before <> name",
    "w13_away": "SELECT device_id, seq, t_ms + 2000 AS away_ms FROM (SELECT device_id, seq, t_ms, lead(t_ms) OVER (PARTITION BY device_id ORDER BY t_ms, seq) AS next_ms FROM obs) o WHERE next_ms IS NULL OR next_ms - t_ms > 2000",
    "w14_retention": "SELECT device_id, max(t_ms) AS last_seen FROM obs GROUP BY device_id HAVING (SELECT max(t_ms) FROM obs) - max(t_ms) <= 3000",
    "w12_pin_sessions": """SELECT device_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(t_ms) AS start_ms, max(t_ms) + 1800 AS end_ms FROM (SELECT *, sum(fresh) OVER (PARTITION BY device_id ORDER BY t_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session
        FROM (SELECT *, CASE WHEN t_ms - lag(t_ms) OVER (PARTITION BY device_id ORDER BY t_ms, seq) <= 1800 THEN 0 ELSE 1 END AS fresh FROM obs) a) b GROUP BY device_id, session""",
    "x01_distances": "SELECT a.node_id AS a, b.node_id AS b, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), 6) AS d2, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), 6) AS d3 FROM nodes a JOIN nodes b ON a.node_id < b.node_id",
    "x02_forward_rssi": "SELECT seq, round(-59.0D - 30.0D * log10(greatest(1.0D, raw)), 6) AS rssi FROM obs_raw",
    "x04_corrected_distance": "SELECT o.seq, round(CASE WHEN o.distance > 0 AND f.n > 0 THEN power(o.distance, 2.7D / f.n) ELSE o.distance END, 6) AS corrected FROM obs o JOIN node_fits f ON o.node_id = f.listener_id WHERE o.distance IS NOT NULL",
    "x06_losses": """SELECT seq, round(CASE WHEN abs(r) <= 1.5D THEN 0.5D * r * r ELSE 1.5D * (abs(r) - 0.75D) END, 6) AS huber, round(CASE WHEN r > 0 THEN 1.0D / (1.0D + (r / 1.5D) * (r / 1.5D)) ELSE 1.0D END, 6) AS cauchy
        FROM (SELECT seq, raw - 4.0D AS r FROM obs_raw) o""",
    "x07_map_transform": "SELECT node_id, 12.0D - x AS flipped_x, 10.0D - y AS flipped_y FROM nodes",
    "x09_decay": "SELECT seq, round(exp(-greatest(t_ms - 1000, 0) / 3600.0D), 6) AS w FROM obs",
    "x11_round_half_up": "SELECT seq, CAST(floor(rssi + 0.5D) AS BIGINT) AS whole, round(least(greatest(rssi, -80.0D), -60.0D), 6) AS clamped FROM obs",
    "x13_rssi_stop": "SELECT seq, CASE WHEN t <= 0.25D THEN 0 WHEN t <= 0.5D THEN 1 WHEN t <= 0.75D THEN 2 ELSE 3 END AS stop, round(t, 6) AS t FROM (SELECT seq, least(greatest((rssi + 120.0D) / 80.0D, 0.0D), 1.0D) AS t FROM obs) o",
    # fixed values: the colours at the ends of four equal stretches of the scale from -120 to -40
    "x13_rgba": """WITH stops AS (SELECT * FROM (VALUES (0, 68, 1, 84, 59, 82, 139), (1, 59, 82, 139, 33, 144, 140), (2, 33, 144, 140, 94, 201, 97), (3, 94, 201, 97, 253, 231, 37)) AS s(stop, r0, g0, b0, r1, g1, b1))
        SELECT o.seq, CAST(floor(r0 + f * (r1 - r0) + 0.5D) AS BIGINT) AS r, CAST(floor(g0 + f * (g1 - g0) + 0.5D) AS BIGINT) AS g, CAST(floor(b0 + f * (b1 - b0) + 0.5D) AS BIGINT) AS b, 255 AS a FROM (SELECT seq, stop, (t - stop * 0.25D) / 0.25D AS f FROM (
          SELECT seq, t, CASE WHEN t <= 0.25D THEN 0 WHEN t <= 0.5D THEN 1 WHEN t <= 0.75D THEN 2 ELSE 3 END AS stop FROM (SELECT seq, least(greatest((rssi + 120.0D) / 80.0D, 0.0D), 1.0D) AS t FROM obs) i) k) o JOIN stops s ON o.stop = s.stop""",
    "x20_slugify": "SELECT p_partkey, {rx: {rx: lower(p_name || ' - ' || p_brand); '[^a-z0-9]+'; '_'}; '^_+|_+$'; ''} AS slug FROM {t:part}",
    "x21_glob": """SELECT g.pattern, t.text, t.text LIKE replace(replace(replace(replace(g.pattern, '!', '!!'), '%', '!%'), '_', '!_'), '*', '%') ESCAPE '!' AS hit
        FROM (VALUES ('dev_1*3'), ('dev_*'), ('x'), ('a.b'), ('*.*'), ('100%*'), ('PROMO*'), ('*')) AS g(pattern)
        CROSS JOIN (SELECT DISTINCT p_type AS text FROM {t:part} UNION SELECT DISTINCT 'dev_' || CAST(user_id AS STRING) FROM {t:events} UNION SELECT v.text FROM (VALUES ('dev_13x'), ('dev_'), ('devX123'), ('X'), ('a.b'), ('axb'), ('100% x'), ('1000'), ('')) AS v(text)) t""",
    "x22_duration": """SELECT text, CASE WHEN {like: lower(text); '^[0-9]+([.][0-9]+)? *[dhwm]?$'} THEN CAST(round(CAST({grab: lower(text); '^([0-9]+([.][0-9]+)?)'; 1} AS DOUBLE) * CASE {grab: lower(text); '([dhwm]?)$'; 1}
        WHEN 'w' THEN 604800000 WHEN 'd' THEN 86400000 WHEN 'h' THEN 3600000 WHEN 'm' THEN 60000 ELSE 1000 END) AS BIGINT) ELSE 2592000000 END AS ms
        FROM (SELECT DISTINCT text FROM (SELECT * FROM (VALUES ('30d'), ('12h'), ('2w'), ('30m'), ('3600'), ('bogus'), ('1.5h')) AS d(text)
          UNION ALL SELECT CASE WHEN o_orderkey % 11 = 0 THEN lower(o_orderpriority) ELSE CAST({div: o_orderkey; 7} AS STRING) || CASE o_orderkey % 6 WHEN 0 THEN 'd' WHEN 1 THEN ' h' WHEN 2 THEN 'W' WHEN 3 THEN '.5m' WHEN 4 THEN '' ELSE ' days' END END FROM {t:orders}) u) d""",
    "x23_imperial": """SELECT text, round((coalesce({num: nullif({grab: text; '^([0-9.]+) *(ft|[q])'; 1}, '')}, 0.0D) * 12.0D + coalesce({num: nullif({grab: text; '([0-9.]+) *i?$'; 1}, '')}, 0.0D)) * 0.0254D, 6) AS meters
        FROM (SELECT DISTINCT text FROM (SELECT * FROM (VALUES ('17q6i'), ('5.5ft'), ('6i'), ('210')) AS d(text)
          UNION ALL SELECT CAST(p_size AS STRING) || CASE p_partkey % 3 WHEN 0 THEN 'q' || CAST(p_partkey % 12 AS STRING) || 'i' WHEN 1 THEN '.25 ft' ELSE '' END FROM {t:part}) u) d""",
    "x24_inches": "SELECT seq, round(raw / 0.0254D, 1) AS inches, CAST(floor(round(raw / 0.0254D, 1) / 12.0D) AS BIGINT) AS feet FROM obs_raw",
    "x25_relative": "SELECT device_id, CASE WHEN age < 60 THEN 's' WHEN age < 3600 THEN 'm' WHEN age < 86400 THEN 'h' ELSE 'd' END AS unit, age FROM (SELECT device_id, {div: (SELECT max(t_ms) FROM obs) - max(t_ms); 10} AS age FROM obs GROUP BY device_id) a",
    # lengths as texts: for input boxes and for display, in metres and in feet and inches
    "x24_displays": """SELECT seq, metre_text || ' m' AS metric, metre_text AS metric_input, inch_text AS imperial_input, CASE WHEN meters < 0 THEN '-' ELSE '' END || CASE WHEN tenths >= 120 THEN CAST({div: tenths; 120} AS STRING) || ' ft ' || CAST({div: tenths % 120; 10} AS STRING) || '.' || CAST(tenths % 10 AS STRING) ELSE CAST({div: tenths; 10} AS STRING) || '.' || CAST(tenths % 10 AS STRING) END || ' in' AS imperial
        FROM (SELECT seq, meters, CAST(floor(abs(meters) / 0.0254D * 10 + 0.5D) AS BIGINT) AS tenths, CASE WHEN meters < 0 THEN '-' ELSE '' END || CAST({div: cm; 100} AS STRING) || '.' || lpad(CAST(cm % 100 AS STRING), 2, '0') AS metre_text, CASE WHEN meters < 0 THEN '-' ELSE '' END || CAST({div: ci; 100} AS STRING) || '.' || lpad(CAST(ci % 100 AS STRING), 2, '0') AS inch_text
          FROM (SELECT seq, raw - 5.0D AS meters, CAST(floor(abs(raw - 5.0D) * 100 + 0.5D) AS BIGINT) AS cm, CAST(floor(abs(raw - 5.0D) / 0.0254D * 100 + 0.5D) AS BIGINT) AS ci FROM obs_raw) r) d""",
    # ages, countdowns and running times as texts
    "x25_texts": """SELECT seq, CASE WHEN ms < 1000 THEN 'just now' WHEN ms < 60000 THEN CAST({div: ms; 1000} AS STRING) || 's ago' WHEN ms < 3600000 THEN CAST({div: ms; 60000} AS STRING) || 'm ago' ELSE CAST({div: ms; 3600000} AS STRING) || 'h ago' END AS relative,
        CASE WHEN ms < 60000 THEN CAST({div: ms; 1000} AS STRING) || 's ago' WHEN ms < 3600000 THEN CAST({div: ms; 60000} AS STRING) || 'm ago' WHEN ms < 86400000 THEN CAST({div: ms; 3600000} AS STRING) || 'h ago' ELSE CAST({div: ms; 86400000} AS STRING) || 'd ago' END AS relative_long,
        CASE WHEN ms <= 0 THEN 'now' WHEN {div: ms + 999; 1000} < 60 THEN CAST({div: ms + 999; 1000} AS STRING) || 's' ELSE CAST({div: ms + 999; 60000} AS STRING) || 'm ' || lpad(CAST({div: ms + 999; 1000} % 60 AS STRING), 2, '0') || 's' END AS countdown,
        CASE WHEN ms >= 86400000 THEN CAST({div: ms; 86400000} AS STRING) || 'd ' || CAST({div: ms % 86400000; 3600000} AS STRING) || 'h' WHEN ms >= 3600000 THEN CAST({div: ms; 3600000} AS STRING) || 'h ' || CAST({div: ms % 3600000; 60000} AS STRING) || 'm' ELSE CAST({div: ms; 60000} AS STRING) || 'm' END AS uptime
        FROM (SELECT seq, t_ms * t_ms AS ms FROM obs_raw) a""",
    "x27_topics": "SELECT DISTINCT 'site/' || device_id || '/' || room_id || '/state' AS topic FROM fixes WHERE room_id IS NOT NULL",
    # the median lies in one thousandth of the scale; only rows of that one are put in order
    "a15_ruler_scale": """WITH scales AS (SELECT id, actual_distance / config_distance AS s, CAST(floor(actual_distance / config_distance * 1000.0D) AS BIGINT) AS b FROM ruler WHERE config_distance > 0),
        steps AS (SELECT b, upto - c AS before, upto, n FROM (SELECT b, c, sum(c) OVER (ORDER BY b) AS upto, sum(c) OVER () AS n FROM (SELECT b, count(*) AS c FROM scales GROUP BY b) g) h),
        m AS (SELECT s AS median, CAST(n AS BIGINT) AS n FROM (SELECT x.s, p.n, p.before, row_number() OVER (ORDER BY x.s, x.id) AS k FROM scales x JOIN steps p ON x.b = p.b WHERE p.before < {div: CAST(p.n AS BIGINT); 2} + 1 AND p.upto >= {div: CAST(p.n AS BIGINT); 2} + 1) y WHERE before + k = {div: CAST(n AS BIGINT); 2} + 1)
        SELECT round(m.median, 6) AS median, m.n, round(avg(CASE WHEN NOT (m.n >= 3 AND abs(r.s - m.median) > 0.03D) THEN r.s END), 6) AS trimmed, count(CASE WHEN m.n >= 3 AND abs(r.s - m.median) > 0.03D THEN 1 END) AS outliers
        FROM scales r CROSS JOIN m GROUP BY m.median, m.n""",
    "p05_ruler_class": "SELECT id, CASE WHEN abs(actual_distance / config_distance - 1.0D) < 0.03D THEN 'good' WHEN abs(actual_distance / config_distance - 1.0D) < 0.1D THEN 'fair' ELSE 'bad' END AS class FROM ruler WHERE config_distance > 0",
}
