"""The domain relations as SQL: the scene, and streams derived from the star-schema tables.

Each entry is the body of a common table expression; `with_` puts those that a
query names, and what they depend on, in front of it.  SPARK holds what Spark
computes in another way than the checking engine.
"""

from __future__ import annotations

import re

from . import sites

RELATIONS: dict[str, str] = {
    # rooms of one floor: a grid of 4 m x 5 m rectangles, corners counter-clockwise
    "rooms": """SELECT * FROM (VALUES
        (0, 'living', 'Living', 0.0D, 0.0D, 4.0D, 5.0D, 'main_open'), (1, 'kitchen', 'Kitchen', 4.0D, 0.0D, 8.0D, 5.0D, 'main_open'),
        (2, 'office', 'Office', 8.0D, 0.0D, 12.0D, 5.0D, CAST(NULL AS STRING)), (3, 'hall', 'Hall', 0.0D, 5.0D, 4.0D, 10.0D, CAST(NULL AS STRING)),
        (4, 'bedroom', 'Bedroom', 4.0D, 5.0D, 8.0D, 10.0D, CAST(NULL AS STRING)), (5, 'bath', 'Bath', 8.0D, 5.0D, 12.0D, 10.0D, CAST(NULL AS STRING)))
        AS r(ord, room_id, room_name, x0, y0, x1, y1, floor_area)""",
    "open_to": """SELECT * FROM (VALUES ('living', 'hall', 2.0D, 5.0D, 0.8D), ('office', 'bath', 10.0D, 5.0D, 0.9D),
        ('hall', 'outside', 0.0D, 7.5D, 1.0D), ('hall', 'bedroom', 4.0D, 7.5D, 0.8D), ('bedroom', 'bath', 8.0D, 6.0D, 0.8D))
        AS o(room_id, target, door_x, door_y, width)""",
    # floors in order, with the heights between which they reach (null: any), and the floor of each room
    "floors": "SELECT 0 AS ord, 'main' AS floor_id, 'Main floor' AS floor_name, CAST(NULL AS DOUBLE) AS z0, CAST(NULL AS DOUBLE) AS z1",
    "room_floors": "SELECT ord, room_id, 'main' AS floor_id FROM rooms",
    "vertices": """SELECT ord, room_id, 0 AS v, x0 AS x, y0 AS y FROM rooms UNION ALL SELECT ord, room_id, 1, x1, y0 FROM rooms
        UNION ALL SELECT ord, room_id, 2, x1, y1 FROM rooms UNION ALL SELECT ord, room_id, 3, x0, y1 FROM rooms""",
    "edges": """SELECT a.ord, a.room_id, a.v, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y
        FROM (SELECT *, count(*) OVER (PARTITION BY room_id) AS corners FROM vertices) a JOIN vertices b ON a.room_id = b.room_id AND b.v = (a.v + 1) % a.corners""",
    "all_nodes": """SELECT 'n' || CAST(2 * ord AS STRING) AS node_id, 2 * ord AS ord, x0 + 1.0D AS x, y0 + 1.0D AS y, 1.2D AS z, CAST(NULL AS STRING) AS room_label, true AS enabled FROM rooms
        UNION ALL SELECT 'n' || CAST(2 * ord + 1 AS STRING), 2 * ord + 1, x0 + 3.0D, y0 + 4.0D, 2.0D, CAST(NULL AS STRING), true FROM rooms
        UNION ALL SELECT 'n12', 12, 12.0D, 5.0D, 1.0D, 'office', false""",
    "nodes": "SELECT * FROM all_nodes WHERE enabled",
    # a node's room: the explicit label, else the first room that holds its point
    "node_hits": """SELECT n.node_id, e.ord, e.room_id, sum(CASE WHEN (e.ay > n.y) <> (e.b_y > n.y)
          AND n.x < (e.bx - e.ax) * (n.y - e.ay) / (CASE WHEN e.b_y = e.ay THEN 1.0D ELSE e.b_y - e.ay END) + e.ax THEN 1 ELSE 0 END) % 2 AS inside
        FROM all_nodes n CROSS JOIN edges e GROUP BY n.node_id, e.ord, e.room_id""",
    "node_rooms": """SELECT n.node_id, n.ord, n.x, n.y, n.z, n.enabled, coalesce(l.room_id, p.room_id) AS room_id
        FROM all_nodes n LEFT JOIN rooms l ON n.room_label = l.room_id OR n.room_label = l.room_name
        LEFT JOIN (SELECT h.node_id, h.room_id FROM (SELECT node_id, room_id, row_number() OVER (PARTITION BY node_id ORDER BY ord) AS k FROM node_hits WHERE inside = 1) h WHERE k = 1) p
          ON n.node_id = p.node_id""",
    # radio observations, one per event; time is compressed so that half-minute constants matter
    "obs_raw": """SELECT event_id AS seq, {div: {us: ts} - 1704067200000000; 50000000} AS t_ms, user_id,
          'dev_' || CAST(user_id AS STRING) AS device_id, 'n' || CAST((event_id * 7 + user_id) % 12 AS STRING) AS node_id,
          event_type AS name, 0.3D + least(value, 150.0D) / 12.0D AS raw, CAST({json: props; k} AS BIGINT) AS k FROM {t:events}""",
    "obs": """SELECT seq, t_ms, user_id, device_id, node_id, name, CASE WHEN k = 0 THEN NULL ELSE raw END AS distance,
          -59.0D - 27.0D * log10(greatest(raw, 0.1D)) AS rssi FROM obs_raw""",
    "messages": """SELECT seq, t_ms, 'site/devices/' || device_id || '/' || node_id AS topic,
          CASE WHEN seq % 97 = 0 THEN '{"distance": ' ELSE CASE WHEN seq % 2 = 0 THEN '{"refRssi": -' ELSE '{"ref_rssi": -' END || CAST(50 + seq % 20 AS STRING)
            || CASE WHEN seq % 89 = 0 THEN '' ELSE ', "name": "' || name || '"' END || CASE WHEN k = 0 THEN '' ELSE ', "distance": ' || CAST(CAST(round(raw * 100) AS BIGINT) AS STRING) END || '}' END AS payload FROM obs_raw
        UNION ALL SELECT 1000000000 + s_suppkey, s_suppkey * 1000, 'site/rooms/' || CASE WHEN s_suppkey % 10 = 9 THEN 'spare' || CAST(s_suppkey % 3 AS STRING) ELSE 'n' || CAST(s_suppkey % 12 AS STRING) END || '/status',
          CASE WHEN s_suppkey % 3 = 0 THEN ' Online ' ELSE 'offline' END FROM {t:supplier}
        UNION ALL SELECT 2000000000 + s_suppkey, s_suppkey * 1000, 'site/rooms/n' || CAST(s_suppkey % 12 AS STRING) || '/absorption', CAST(s_suppkey % 5 AS STRING) || '.5' FROM {t:supplier}
        UNION ALL SELECT 3000000000 + s_suppkey, s_suppkey * 1000, 'site/rooms/n' || CAST(s_suppkey % 12 AS STRING) || '/absorption/set', '9' FROM {t:supplier}
        UNION ALL SELECT 4000000000 + s_suppkey, s_suppkey * 1000, 'site/rooms/n' || CAST(s_suppkey % 12 AS STRING) || '/telemetry', '{"uptime": ' || CAST(s_suppkey * 60 AS STRING) || ', "freeHeap": 1000, "version": "v' || CAST(s_suppkey % 4 AS STRING) || '"}' FROM {t:supplier}""",
    "parsed": """SELECT seq, t_ms, topic, payload, kind, node_id, device_id, setting FROM (
          SELECT *, CASE WHEN n <> 4 OR p3 = '' OR p4 = '' THEN NULL WHEN p2 = 'devices' THEN 'device' WHEN p2 = 'rooms' AND p4 = 'status' THEN 'status'
              WHEN p2 = 'rooms' AND p4 = 'telemetry' THEN 'telemetry' WHEN p2 = 'rooms' THEN 'setting' END AS kind,
            CASE WHEN p2 = 'devices' THEN p4 ELSE p3 END AS node_id, CASE WHEN p2 = 'devices' THEN p3 END AS device_id, CASE WHEN p2 = 'rooms' THEN p4 END AS setting
          FROM (SELECT *, {parts: topic} AS n, {part: topic; 2} AS p2, {part: topic; 3} AS p3, {part: topic; 4} AS p4 FROM messages) m) k WHERE kind IS NOT NULL""",
    "settings": """SELECT 'n' || CAST(s_suppkey % 12 AS STRING) AS node_id, s_suppkey * 1000 AS t_ms, s_suppkey AS seq,
          CASE WHEN s_suppkey % 5 = 0 THEN '0' WHEN s_suppkey % 7 = 0 THEN '2.9dB' ELSE CAST({cents: 2.0D + abs(s_acctbal) / 5000.0D} AS STRING) END AS value FROM {t:supplier}""",
    "absorptions": """SELECT node_id, t_ms, seq, value, CASE WHEN n > 0.1D THEN n ELSE 2.7D END AS absorption
        FROM (SELECT *, {num: nullif({grab: value; '^ *([+-]?[0-9]+([.][0-9]+)?)'; 1}, '')} AS n FROM settings) s""",
    "gt_all": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {days: l_shipdate; 1995-01-01} * CAST(6000 AS BIGINT) AS t_ms,
          'n' || CAST(l_suppkey % 12 AS STRING) AS listener_id, 'n' || CAST(l_partkey % 12 AS STRING) AS transmitter_id, l_quantity, 2.0D + 0.25D * l_linenumber AS absorption
        FROM {t:lineitem} WHERE l_suppkey % 12 <> l_partkey % 12""",
    "gt_samples": """SELECT g.*, d.true_dist, d.true_dist * (0.6D + l_quantity / 50.0D) AS measured FROM gt_all g JOIN (
          SELECT a.node_id AS la, b.node_id AS tb, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS true_dist FROM nodes a JOIN nodes b ON a.node_id <> b.node_id) d
        ON g.listener_id = d.la AND g.transmitter_id = d.tb""",
    # the exponent of a sample, without what the walls on its way take (in decibels, as a natural logarithm)
    "gt_valid": """SELECT g.*, (g.absorption * ln(g.measured) - coalesce(w.loss_db, 0.0D) * ln(10.0D) / 10.0D) / ln(g.true_dist) AS n FROM gt_samples g
        LEFT JOIN wall_loss w ON least(g.listener_id, g.transmitter_id) = w.a AND greatest(g.listener_id, g.transmitter_id) = w.b WHERE g.measured > 0 AND g.true_dist > 1.0D""",
    # decayed sums of the path-loss exponent by pair, an hour's time constant: partial sums of each hour, as of its end,
    # merge by decaying them to the last accepted sample, so no window over a pair's samples is needed
    "pair_hours": """SELECT listener_id, transmitter_id, hour, count(*) AS samples, max(t_ms) AS last_ms, sum(w) AS w, sum(w * n) AS sn, sum(w * n * n) AS sn2, sum(w * true_dist) AS st, sum(w * measured) AS sm
        FROM (SELECT *, {div: t_ms; 3600000} AS hour, exp((t_ms - ({div: t_ms; 3600000} + 1) * 3600000) / 3600000.0D) AS w FROM gt_valid WHERE n >= 1.5D AND n <= 8.0D) a GROUP BY listener_id, transmitter_id, hour""",
    "pair_merged": """SELECT listener_id, transmitter_id, sum(samples) AS samples, max(last_ms) AS last_ms, sum(k * w) AS w, sum(k * sn) AS sn, sum(k * sn2) AS sn2, sum(k * st) AS st, sum(k * sm) AS sm
        FROM (SELECT h.*, exp(((h.hour + 1) * 3600000 - l.upto) / 3600000.0D) AS k FROM pair_hours h JOIN (SELECT listener_id AS li, transmitter_id AS ti, max(last_ms) AS upto FROM pair_hours GROUP BY listener_id, transmitter_id) l ON h.listener_id = l.li AND h.transmitter_id = l.ti) a
        GROUP BY listener_id, transmitter_id""",
    "pair_stats": """SELECT listener_id, transmitter_id, CAST(samples AS BIGINT) AS samples, last_ms, w, sn / w AS n, greatest(sn2 / w - (sn / w) * (sn / w), 0.0D) AS var_n, st / w AS mean_true, sm / w AS mean_measured FROM pair_merged""",
    "pair_fits": "SELECT listener_id, transmitter_id, samples, w, n, 1.0D / (1.0D + var_n) AS r2, mean_true, mean_measured FROM pair_stats WHERE w >= 5",
    "node_stats": """SELECT listener_id, count(*) AS samples, sum(w) AS w, sum(w * lx) / sum(w) AS mx, sum(w * ly) / sum(w) AS my,
          sum(w * lx * lx) AS sxx, sum(w * lx * ly) AS sxy, sum(w * ly * ly) AS syy
        FROM (SELECT listener_id, exp(-(last_ms - t_ms) / 3600000.0D) AS w, ln(true_dist) AS lx, absorption * ln(measured) AS ly
          FROM (SELECT *, max(t_ms) OVER (PARTITION BY listener_id) AS last_ms FROM ring) a) b GROUP BY listener_id""",
    "ring": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY listener_id ORDER BY t_ms DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS back
          FROM gt_valid) r WHERE back <= 1000""",
    "node_fits": """SELECT listener_id, samples, w, least(greatest(sxy / sxx, 1.5D), 8.0D) AS n,
          CASE WHEN syy > 0 THEN least(greatest(1.0D - greatest(syy - 2 * (sxy / sxx) * sxy + (sxy / sxx) * (sxy / sxx) * sxx, 0.0D) / syy, 0.0D), 1.0D) END AS r2 FROM node_stats WHERE w >= 5""",
    "upstream": """SELECT o_orderkey AS seq, 'dev_' || CAST(o_custkey % 150 AS STRING) AS device_id, o_totalprice % 14.0D - 1.0D AS x, (o_totalprice / 7.0D) % 12.0D - 1.0D AS y,
          o_orderkey % 120 AS confidence, {days: o_orderdate; 1995-01-01} * CAST(20 AS BIGINT) AS t_ms FROM {t:orders}""",
    # three pins a device, over as many devices as the events have
    "pin_devices": "SELECT count(DISTINCT user_id) AS n FROM {t:events}",
    "pins": """SELECT 'dev_' || CAST(c_custkey % n AS STRING) AS device_id, c_custkey AS pin_ts, c_custkey * 37 % 120 / 10.0D AS x, c_custkey * 53 % 100 / 10.0D AS y, 1.0D AS z
        FROM {t:customer} CROSS JOIN pin_devices WHERE c_custkey < 3 * n""",
    # when each pin is set; a pin stands only if its device has been measured before, and lasts until the device's next one
    "pin_clicks": "SELECT device_id, pin_ts, x, y, z, pin_ts * 37 % 50 * 1000 AS placed_ms FROM pins",
    "pin_measured": """SELECT device_id, pin_ts, placed_ms, x, y, z, node_id, measured FROM (SELECT p.device_id, p.pin_ts, p.placed_ms, p.x, p.y, p.z, o.node_id, {last_of: coalesce(o.distance, 0.0D); o.t_ms; o.seq} AS measured
          FROM pin_clicks p JOIN obs o ON p.device_id = o.device_id AND o.t_ms < p.placed_ms GROUP BY p.device_id, p.pin_ts, p.placed_ms, p.x, p.y, p.z, o.node_id) m WHERE measured > 0""",
    "pin_spans": """SELECT *, lead(placed_ms) OVER (PARTITION BY device_id ORDER BY placed_ms, pin_ts) AS next_ms FROM (SELECT DISTINCT device_id, pin_ts, placed_ms, x, y, z FROM pin_measured) d""",
    # plausible samples of a pin while it is active; half an hour (1800 ms of the test clock) after the last one it is not
    "pin_samples": """SELECT * FROM (SELECT s.*, s.t_ms - lag(s.t_ms, 1, s.placed_ms) OVER (PARTITION BY s.device_id, s.pin_ts ORDER BY s.t_ms, s.seq) AS gap FROM (
          SELECT p.device_id, p.pin_ts, p.placed_ms, o.seq, o.t_ms, o.node_id, o.distance / sqrt((p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y) + (p.z - n.z) * (p.z - n.z)) AS bias
          FROM obs o JOIN pin_spans p ON o.device_id = p.device_id AND o.t_ms >= p.placed_ms AND (p.next_ms IS NULL OR o.t_ms < p.next_ms) JOIN nodes n ON o.node_id = n.node_id
          WHERE o.distance > 0 AND (p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y) + (p.z - n.z) * (p.z - n.z) >= 1.0D) s WHERE s.bias >= 0.2D AND s.bias <= 5.0D) g""",
    "pin_breaks": "SELECT device_id, pin_ts, min(t_ms) AS broken_ms FROM pin_samples WHERE gap >= 1800 GROUP BY device_id, pin_ts",
    "pin_kept": """SELECT s.device_id, s.pin_ts, s.placed_ms, s.seq, s.t_ms, s.node_id, s.bias FROM pin_samples s LEFT JOIN pin_breaks b ON s.device_id = b.device_id AND s.pin_ts = b.pin_ts WHERE b.broken_ms IS NULL OR s.t_ms < b.broken_ms""",
    # beyond 10,000 samples of a node each one makes those before it weigh a ten thousandth less
    "pin_sums": """SELECT device_id, pin_ts, node_id, least(max(k), 10000) AS n, sum(w * bias) / sum(w) AS mean, sum(w * bias * bias) / sum(w) AS mean2 FROM (
          SELECT r.*, CASE WHEN c > 10000 THEN power(0.9999D, c - greatest(k, 10000)) ELSE 1.0D END AS w FROM (SELECT device_id, pin_ts, node_id, bias, row_number() OVER (PARTITION BY device_id, pin_ts, node_id ORDER BY t_ms, seq) AS k,
            count(*) OVER (PARTITION BY device_id, pin_ts, node_id) AS c FROM pin_kept) r) w GROUP BY device_id, pin_ts, node_id""",
    "pin_nodes": """SELECT p.device_id, p.pin_ts, i.node_id, m.measured, coalesce(s.n, 0) AS n, s.mean, s.mean2, sqrt((p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y) + (p.z - n.z) * (p.z - n.z)) AS true_dist
        FROM (SELECT device_id, pin_ts, node_id FROM pin_measured UNION SELECT device_id, pin_ts, node_id FROM pin_sums) i JOIN pin_spans p ON i.device_id = p.device_id AND i.pin_ts = p.pin_ts JOIN nodes n ON i.node_id = n.node_id
        LEFT JOIN pin_measured m ON i.device_id = m.device_id AND i.pin_ts = m.pin_ts AND i.node_id = m.node_id LEFT JOIN pin_sums s ON i.device_id = s.device_id AND i.pin_ts = s.pin_ts AND i.node_id = s.node_id""",
    "pin_states": """SELECT p.device_id, p.pin_ts, p.placed_ms, p.x, p.y, CASE WHEN p.next_ms IS NULL THEN coalesce(k.last_ms, p.placed_ms) + 1800 ELSE 0 END AS active_until_ms, p.next_ms IS NULL AND coalesce(k.last_ms, p.placed_ms) + 1800 > w.now_ms AS active
        FROM pin_spans p LEFT JOIN (SELECT device_id, pin_ts, max(t_ms) AS last_ms FROM pin_kept GROUP BY device_id, pin_ts) k ON p.device_id = k.device_id AND p.pin_ts = k.pin_ts CROSS JOIN (SELECT max(t_ms) AS now_ms FROM obs) w""",
    # messages as JSON, some with fields of the wrong type
    "observed_lines": """SELECT seq, device_id, node_id, CASE WHEN seq % 59 = 0 THEN '{"distance"' ELSE '{"rssi": -' || CAST(50 + seq % 30 AS STRING) || CASE WHEN seq % 2 = 0 THEN ', "refRssi": -' ELSE ', "ref_rssi": -' END || CAST(50 + seq % 20 AS STRING)
          || CASE WHEN seq % 3 = 0 THEN ', "distVar": 0.5' WHEN seq % 3 = 1 THEN ', "dist_var": 0.25, "rssi_var": 2' ELSE ', "distVar": 1, "dist_var": 9, "rssiVar": 3.5' END || CASE WHEN seq % 47 = 0 THEN ', "name": 7' WHEN seq % 5 = 0 THEN '' ELSE ', "name": "' || name || '"' END
          || CASE WHEN k = 0 THEN '' WHEN seq % 41 = 0 THEN ', "distance": "3"' WHEN seq % 43 = 0 THEN ', "distance": null' ELSE ', "distance": ' || CAST(CAST(round(raw * 100) AS BIGINT) AS STRING) || CASE WHEN seq % 7 = 0 THEN '.5' ELSE '' END END || ', "more": [1]}' END AS line FROM obs_raw""",
    "telemetry_lines": """SELECT 'n' || CAST(s_suppkey % 12 AS STRING) AS node_id, s_suppkey AS seq, s_suppkey * 1000 AS t_ms, CASE WHEN s_suppkey % 23 = 0 THEN '{"uptime": 1' ELSE '{"uptime": ' || CASE WHEN s_suppkey % 17 = 0 THEN '"60"' ELSE CAST(s_suppkey * 60 AS STRING) END
          || ', "rssi": -' || CAST(40 + s_suppkey % 50 AS STRING) || ', "freeHeap": ' || CAST(90000 + s_suppkey AS STRING) || ', "maxAllocHeap": ' || CAST(60000 + s_suppkey AS STRING) || ', "memoryFragmentation": ' || CAST(s_suppkey % 40 AS STRING) || '.5, "count": ' || CAST(s_suppkey % 9 AS STRING)
          || ', "adverts": ' || CAST(s_suppkey * 3 AS STRING) || ', "seen": ' || CAST(s_suppkey * 2 AS STRING) || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE ', "reported": ' || CAST(s_suppkey AS STRING) END || ', "scanHighWater": 7, "ip": ' || CASE WHEN s_suppkey % 19 = 0 THEN 'null' ELSE '"10.0.0.' || CAST(s_suppkey % 250 AS STRING) || '"' END
          || CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE ', "firmware": "basic"' END || ', "version": "v' || CAST(s_suppkey % 4 AS STRING) || '.1"}' END AS line FROM {t:supplier}""",
    "attribute_lines": """SELECT 'dev_' || CAST(o_custkey % 150 AS STRING) AS device_id, o_orderkey AS seq, {days: o_orderdate; 1970-01-01} * CAST(86400000 AS BIGINT) + 43200000 AS arrived_ms,
          CASE WHEN o_orderkey % 29 = 0 THEN '{"x": 1' ELSE '{"x": ' || CASE WHEN o_orderkey % 9 = 0 THEN '"4"' ELSE CAST(o_orderkey % 14 AS STRING) || '.5' END || ', "y": ' || CASE WHEN o_orderkey % 13 = 0 THEN 'null' ELSE CAST(o_custkey % 12 AS STRING) END || CASE WHEN o_orderkey % 4 = 0 THEN ', "z": 1.25' WHEN o_orderkey % 4 = 1 THEN ', "z": "up"' ELSE '' END
          || ', "confidence": ' || CASE WHEN o_orderkey % 7 = 0 THEN '"high"' ELSE CAST(o_orderkey % 120 - 10 AS STRING) END || ', "fixes": ' || CAST(o_orderkey % 6 AS STRING) || CASE WHEN o_orderkey % 2 = 0 THEN '.5' ELSE '' END || ', "best_scenario": ' || CASE WHEN o_orderkey % 8 = 0 THEN '3' ELSE '"plan ' || CAST(o_orderkey % 5 AS STRING) || '"' END
          || CASE WHEN o_orderkey % 10 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN ', "last_seen": "soon"' ELSE ', "last_seen": "' || CAST(CAST(o_orderdate AS DATE) - CAST(o_orderkey % 3 AS INT) AS STRING) || 'T12:00:00"' END || '}' END AS line FROM {t:orders}""",
    # settings that users apply by hand, one or more at a time; one in four updates keeps the residuals
    "manual_updates": """SELECT s_suppkey AS seq, s_suppkey * 1000 AS t_ms, CASE WHEN s_suppkey % 21 = 0 THEN '' ELSE 'n' || CAST(s_suppkey % 12 AS STRING) END AS node_id, CASE WHEN s_suppkey % 3 <> 1 THEN 2.0D + s_suppkey % 300 / 128.0D END AS absorption,
          CASE WHEN s_suppkey % 4 < 2 THEN s_suppkey % 21 / 2.0D - 5.0D END AS rx_adj, CASE WHEN s_suppkey % 5 = 0 THEN -59.0D - s_suppkey % 9 / 4.0D END AS tx_ref, s_suppkey % 4 <> 3 AS resets FROM {t:supplier}""",
    "ruler": """SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS config_distance, p_size * p_retailprice / 950.0D AS actual_distance, CASE WHEN p_partkey % 3 = 0 THEN 'Wall: ' || p_name ELSE p_brand END AS label FROM {t:part}""",
    # the latest fixes of each device as of its last message, one per node, within 30 s, in order of first sight
    "fix_last": """SELECT device_id, node_id, seq, t_ms, distance, rssi FROM (
          SELECT *, row_number() OVER (PARTITION BY device_id, node_id ORDER BY t_ms DESC, seq DESC) AS k FROM obs) o WHERE k = 1""",
    "fixes": """SELECT f.device_id, f.node_id, n.x, n.y, n.z, f.distance AS d, f.rssi, r.room_id, row_number() OVER (PARTITION BY f.device_id ORDER BY n.ord) AS i, count(*) OVER (PARTITION BY f.device_id) AS m
        FROM fix_last f JOIN nodes n ON f.node_id = n.node_id JOIN node_rooms r ON f.node_id = r.node_id
        JOIN (SELECT device_id, max(t_ms) AS now_ms FROM obs GROUP BY device_id) t ON f.device_id = t.device_id
        WHERE f.distance IS NOT NULL AND f.t_ms >= t.now_ms - 30000""",
    "shared_edges": """SELECT DISTINCT a.room_id AS a, b.room_id AS b FROM edges a JOIN edges b ON a.ord < b.ord
        AND ((abs(a.ax - b.ax) < 0.1D AND abs(a.ay - b.ay) < 0.1D AND abs(a.bx - b.bx) < 0.1D AND abs(a.b_y - b.b_y) < 0.1D)
          OR (abs(a.ax - b.bx) < 0.1D AND abs(a.ay - b.b_y) < 0.1D AND abs(a.bx - b.ax) < 0.1D AND abs(a.b_y - b.ay) < 0.1D))""",
    "walk": """SELECT least(a, b) AS a, greatest(a, b) AS b FROM (
          SELECT o.room_id AS a, coalesce(r.room_id, o.target) AS b FROM open_to o LEFT JOIN rooms r ON o.target = r.room_id OR o.target = r.room_name
          UNION SELECT p.room_id, q.room_id FROM rooms p JOIN rooms q ON p.floor_area = q.floor_area AND p.ord < q.ord) u GROUP BY least(a, b), greatest(a, b)""",
    "trust": "SELECT a, b FROM (SELECT least(a, b) AS a, greatest(a, b) AS b FROM shared_edges UNION SELECT a, b FROM walk) u WHERE a <> 'outside' AND b <> 'outside'",
    "trust2": "SELECT a, b FROM trust UNION SELECT b, a FROM trust",
    # walls: room edges that no other room of the same open area shares, with doors as openings
    "walls": """SELECT DISTINCT least(e.ax, e.bx) AS ax, least(e.ay, e.b_y) AS ay, greatest(e.ax, e.bx) AS bx, greatest(e.ay, e.b_y) AS b_y,
          (SELECT count(DISTINCT f.room_id) FROM edges f WHERE abs(least(f.ax, f.bx) - least(e.ax, e.bx)) < 0.05D AND abs(least(f.ay, f.b_y) - least(e.ay, e.b_y)) < 0.05D
            AND abs(greatest(f.ax, f.bx) - greatest(e.ax, e.bx)) < 0.05D AND abs(greatest(f.ay, f.b_y) - greatest(e.ay, e.b_y)) < 0.05D) = 1 AS exterior
        FROM edges e""",
    "inner_edges": """SELECT DISTINCT least(a.ax, a.bx) AS ax, least(a.ay, a.b_y) AS ay, greatest(a.ax, a.bx) AS bx, greatest(a.ay, a.b_y) AS b_y FROM edges a JOIN rooms p ON a.room_id = p.room_id
        JOIN rooms q ON p.floor_area = q.floor_area AND p.room_id <> q.room_id JOIN edges b ON b.room_id = q.room_id
          AND abs(least(a.ax, a.bx) - least(b.ax, b.bx)) < 0.05D AND abs(least(a.ay, a.b_y) - least(b.ay, b.b_y)) < 0.05D
          AND abs(greatest(a.ax, a.bx) - greatest(b.ax, b.bx)) < 0.05D AND abs(greatest(a.ay, a.b_y) - greatest(b.ay, b.b_y)) < 0.05D""",
    "solid": """SELECT w.*, row_number() OVER (ORDER BY w.ax, w.ay, w.bx, w.b_y) AS wall FROM walls w LEFT JOIN inner_edges i ON w.ax = i.ax AND w.ay = i.ay AND w.bx = i.bx AND w.b_y = i.b_y WHERE i.ax IS NULL""",
    "doors": """SELECT s.wall, o.door_x, o.door_y, o.width FROM open_to o JOIN solid s ON abs((s.bx - s.ax) * (o.door_y - s.ay) - (s.b_y - s.ay) * (o.door_x - s.ax)) < 0.01D
          AND o.door_x >= s.ax - 0.01D AND o.door_x <= s.bx + 0.01D AND o.door_y >= s.ay - 0.01D AND o.door_y <= s.b_y + 0.01D""",
    "paths": "SELECT a.node_id AS a, b.node_id AS b, a.x AS px, a.y AS py, b.x AS qx, b.y AS qy FROM nodes a JOIN nodes b ON a.node_id < b.node_id",
    "cuts": "SELECT p.a, p.b, s.wall, s.exterior, s.ax, s.ay, s.bx, s.b_y, p.px, p.py, p.qx, p.qy, (p.qx - p.px) * (s.b_y - s.ay) - (p.qy - p.py) * (s.bx - s.ax) AS den FROM paths p CROSS JOIN solid s",
    "crossed": """SELECT a, b, wall, exterior, t, px + t * (qx - px) AS hx, py + t * (qy - py) AS hy FROM (
          SELECT c.*, ((ax - px) * (b_y - ay) - (ay - py) * (bx - ax)) / nullif(den, 0.0D) AS t, ((ax - px) * (qy - py) - (ay - py) * (qx - px)) / nullif(den, 0.0D) AS u FROM cuts c WHERE abs(den) >= 1e-12) z
        WHERE t >= 0 AND t <= 1 AND u >= 0 AND u <= 1""",
    "wall_kinds": """SELECT c.a, c.b, c.wall, c.t, max(CASE WHEN d.wall IS NOT NULL THEN 2 WHEN c.exterior THEN 1 ELSE 0 END) AS kind FROM crossed c
        LEFT JOIN doors d ON c.wall = d.wall AND abs(c.hx - d.door_x) <= d.width / 2 AND abs(c.hy - d.door_y) <= d.width / 2 GROUP BY c.a, c.b, c.wall, c.t""",
    "wall_hits": """SELECT a, b, max(kind) AS kind FROM (SELECT k.*, sum(fresh) OVER (PARTITION BY a, b ORDER BY t, wall ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM (
          SELECT k.*, CASE WHEN t - lag(t) OVER (PARTITION BY a, b ORDER BY t, wall) <= 0.005D THEN 0 ELSE 1 END AS fresh FROM wall_kinds k) k) g GROUP BY a, b, grp""",
    "counted": """SELECT p.a, p.b, coalesce(sum(CASE WHEN m.kind = 0 THEN 1 ELSE 0 END), 0) AS interior, coalesce(sum(CASE WHEN m.kind = 1 THEN 1 ELSE 0 END), 0) AS exterior, coalesce(sum(CASE WHEN m.kind = 2 THEN 1 ELSE 0 END), 0) AS doors
        FROM paths p LEFT JOIN wall_hits m ON p.a = m.a AND p.b = m.b GROUP BY p.a, p.b""",
    "wall_loss": "SELECT a, b, 4.0D * interior + 10.0D * exterior + 0.0D * doors AS loss_db FROM counted",
    # room middles: the area centroid, or the vertex mean where that lies outside the room
    "shoelace": "SELECT room_id, sum(ax * b_y - bx * ay) / 2.0D AS area, sum((ax + bx) * (ax * b_y - bx * ay)) AS sx, sum((ay + b_y) * (ax * b_y - bx * ay)) AS sy FROM edges GROUP BY room_id",
    "centroids": "SELECT room_id, abs(area) AS area, sx / (6.0D * area) AS cx, sy / (6.0D * area) AS cy FROM shoelace",
    "anchors": """SELECT c.room_id, CASE WHEN h.inside = 1 THEN c.cx ELSE m.mx END AS x, CASE WHEN h.inside = 1 THEN c.cy ELSE m.my END AS y FROM centroids c
        JOIN (SELECT c.room_id, sum(CASE WHEN (e.ay > c.cy) <> (e.b_y > c.cy) AND c.cx < (e.bx - e.ax) * (c.cy - e.ay) / (CASE WHEN e.b_y = e.ay THEN 1.0D ELSE e.b_y - e.ay END) + e.ax THEN 1 ELSE 0 END) % 2 AS inside
          FROM centroids c JOIN edges e ON c.room_id = e.room_id GROUP BY c.room_id) h ON c.room_id = h.room_id
        JOIN (SELECT room_id, avg(x) AS mx, avg(y) AS my FROM vertices GROUP BY room_id) m ON c.room_id = m.room_id""",
    # upstream points against room polygons by ray casting; the first room in config order wins
    "hits": """SELECT p.seq, e.ord, e.room_id, sum(CASE WHEN (e.ay > p.y) <> (e.b_y > p.y)
          AND p.x < (e.bx - e.ax) * (p.y - e.ay) / (CASE WHEN e.b_y = e.ay THEN 1.0D ELSE e.b_y - e.ay END) + e.ax THEN 1 ELSE 0 END) % 2 AS inside
        FROM upstream p CROSS JOIN edges e GROUP BY p.seq, e.ord, e.room_id""",
    "located": """SELECT u.device_id, u.seq, u.t_ms, u.x, u.y, h.room_id FROM upstream u LEFT JOIN (SELECT seq, room_id FROM (
          SELECT seq, room_id, row_number() OVER (PARTITION BY seq ORDER BY ord) AS k FROM hits WHERE inside = 1) a WHERE k = 1) h ON u.seq = h.seq""",
    "room_distances": """SELECT p.seq, e.room_id, min(sqrt((p.x - e.ax - t * (e.bx - e.ax)) * (p.x - e.ax - t * (e.bx - e.ax)) + (p.y - e.ay - t * (e.b_y - e.ay)) * (p.y - e.ay - t * (e.b_y - e.ay)))) AS distance
        FROM (SELECT u.seq, u.x, u.y, f.room_id AS r, f.v, least(greatest(((u.x - f.ax) * (f.bx - f.ax) + (u.y - f.ay) * (f.b_y - f.ay)) / ((f.bx - f.ax) * (f.bx - f.ax) + (f.b_y - f.ay) * (f.b_y - f.ay)), 0.0D), 1.0D) AS t FROM upstream u CROSS JOIN edges f) p
        JOIN edges e ON p.r = e.room_id AND p.v = e.v GROUP BY p.seq, e.room_id""",
    # settings of devices as retained messages; the last valid one counts, found by its own id or by its alias
    "device_configs": """SELECT c_custkey AS seq, c_custkey * 10 AS t_ms, 'dev_' || CAST(c_custkey % n AS STRING) AS original_id, CASE WHEN c_custkey % 11 = 0 THEN '{"id": ' ELSE
          '{"name": "' || c_mktsegment || '"' || CASE WHEN c_custkey % 13 = 0 THEN '' ELSE ', "id": "tag_' || CAST(c_custkey % 50 AS STRING) || '"' END || ', "rssi@1m": -' || CAST(55 + c_custkey % 12 AS STRING) || '.5}' END AS payload
        FROM {t:customer} CROSS JOIN pin_devices""",
    "device_settings": """SELECT original_id, {json: payload; id} AS alias, {json: payload; name} AS name, CAST(floor({num: {jsonq: payload; rssi@1m}} + 0.5D) AS BIGINT) AS ref_rssi FROM (
          SELECT *, row_number() OVER (PARTITION BY original_id ORDER BY t_ms DESC, seq DESC) AS k FROM device_configs WHERE {isjson: payload}) c WHERE k = 1""",
    # lines of saved state, some damaged: an audit log and connections of rooms, which are a name or an object
    "audit_lines": """SELECT s_suppkey AS seq, CASE WHEN s_suppkey % 17 = 0 THEN '{"nodeId": "n' ELSE '{"nodeId": ' || CASE WHEN s_suppkey % 19 = 0 THEN 'null' ELSE '"n' || CAST(s_suppkey % 12 AS STRING) || '"' END || ', "oldValue": 2.5, "newValue": '
          || CASE WHEN s_suppkey % 7 = 0 THEN '"high"' ELSE '3.' || CAST(s_suppkey % 10 AS STRING) END || ', "timestamp": ' || CAST(s_suppkey * 1000 AS STRING) || '}' END AS line FROM {t:supplier}""",
    "open_lines": """SELECT n_nationkey AS seq, CASE WHEN n_nationkey % 3 = 0 THEN '"' || CASE WHEN n_nationkey % 2 = 0 THEN 'Outside' ELSE 'room_' || CAST(n_nationkey % 5 AS STRING) END || '"' ELSE '{"id": "room_' || CAST(n_nationkey % 5 AS STRING) || '"'
          || CASE WHEN n_nationkey % 3 = 1 THEN ', "doorX": ' || CAST(n_nationkey AS STRING) || '.5' ELSE ', "width": 1.2' END || '}' END AS line FROM {t:nation}""",
    # pins as they are recorded over time, and lines of saved pins and statistics
    "pin_events": "SELECT device_id, seq, t_ms, x, y FROM upstream",
    # what users do with pins: set one, take up the nearest one again, or let go of all
    "pin_actions": "SELECT device_id, seq, t_ms, x, y, CASE seq % 3 WHEN 0 THEN 'record' WHEN 1 THEN 'activate' ELSE 'deactivate' END AS kind FROM upstream",
    "pin_lines": """SELECT c_custkey AS seq, CASE WHEN c_custkey % 23 = 0 THEN '{"deviceId": "d' ELSE '{"deviceId": "dev_' || CAST(c_custkey % 15 AS STRING) || '", "x": ' || CASE WHEN c_custkey % 9 = 0 THEN 'null' ELSE CAST(c_custkey % 12 AS STRING) || '.5' END
          || ', "y": ' || CAST(c_custkey % 10 AS STRING) || '.0, "z": 1.0, "timestamp": ' || CAST(c_custkey * 10 AS STRING) || ', "active": true}' END AS line FROM {t:customer}""",
    "stat_lines": """SELECT s_suppkey AS seq, '{"listener": "n' || CAST(s_suppkey % 12 AS STRING) || '", "transmitter": "n' || CAST((s_suppkey * 5 + 1) % 12 AS STRING) || '", "W": ' || CASE WHEN s_suppkey % 8 = 0 THEN '"many"' WHEN s_suppkey % 13 = 0 THEN '0' ELSE CAST(s_suppkey % 9 AS STRING) || '.5' END
          || ', "SumN": ' || CAST(s_suppkey % 9 * 3 AS STRING) || '.25, "lastUpdateMs": ' || CAST(s_suppkey * 100 + 1 AS STRING) || '}' AS line FROM {t:supplier}""",
    "option_lines": """SELECT n_nationkey AS seq, '{"enabled": ' || CASE WHEN n_nationkey % 2 = 0 THEN 'true' ELSE 'false' END || ', "minDelta": ' || CASE WHEN n_nationkey % 5 = 0 THEN '-1' WHEN n_nationkey % 7 = 0 THEN '"x"' ELSE '0.' || CAST(n_nationkey % 9 + 1 AS STRING) END
          || ', "intervalMs": ' || CAST(n_nationkey % 4 * 60000 AS STRING) || '}' AS line FROM {t:nation}""",
    # which devices are tracked: rules with * as the only wild card, made into patterns of LIKE
    "rules": """SELECT kind, id_glob, name_glob, replace(replace(replace(replace(id_glob, '!', '!!'), '%', '!%'), '_', '!_'), '*', '%') AS id_like,
          replace(replace(replace(replace(name_glob, '!', '!!'), '%', '!%'), '_', '!_'), '*', '%') AS name_like
        FROM (VALUES ('exclude', 'dev_1*3', CAST(NULL AS STRING)), ('exclude', CAST(NULL AS STRING), 'err*'), ('include', 'dev_*', CAST(NULL AS STRING))) AS g(kind, id_glob, name_glob)""",
}

_SIDE = "CASE WHEN (e.ay > u.y) <> (e.b_y > u.y) AND u.x < (e.bx - e.ax) * (u.y - e.ay) / (CASE WHEN e.b_y = e.ay THEN 1.0D ELSE e.b_y - e.ay END) + e.ax THEN 1 ELSE 0 END"
_ALONG = "least(greatest(((u.x - e.ax) * (e.bx - e.ax) + (u.y - e.ay) * (e.b_y - e.ay)) / ((e.bx - e.ax) * (e.bx - e.ax) + (e.b_y - e.ay) * (e.b_y - e.ay)), 0.0D), 1.0D)"
#: For Spark: all polygons are one broadcast row of arrays, so points are tested where they are read and nothing is shuffled.
SPARK: dict[str, str] = {
    "polygons": """SELECT array_sort(collect_list(struct(ord, room_id, es))) AS rooms FROM (SELECT ord, room_id, collect_list(struct(ax, ay, bx, b_y)) AS es FROM edges GROUP BY ord, room_id)""",
    "hits": f"""SELECT seq, r.ord AS ord, r.room_id AS room_id, r.inside AS inside FROM (SELECT u.seq, explode(transform(p.rooms, r -> struct(r.ord AS ord, r.room_id AS room_id, aggregate(r.es, 0, (k, e) -> k + {_SIDE}) % 2 AS inside))) AS r
        FROM upstream u CROSS JOIN polygons p)""",
    "located": f"""SELECT u.device_id, u.seq, u.t_ms, u.x, u.y, get(filter(p.rooms, r -> aggregate(r.es, 0, (k, e) -> k + {_SIDE}) % 2 = 1), 0).room_id AS room_id FROM upstream u CROSS JOIN polygons p""",
    "room_distances": f"""SELECT seq, r.room_id AS room_id, r.distance AS distance FROM (SELECT u.seq, explode(transform(p.rooms, r -> struct(r.room_id AS room_id, array_min(transform(r.es, e -> array_max(transform(array({_ALONG}),
          t -> sqrt((u.x - e.ax - t * (e.bx - e.ax)) * (u.x - e.ax - t * (e.bx - e.ax)) + (u.y - e.ay - t * (e.b_y - e.ay)) * (u.y - e.ay - t * (e.b_y - e.ay))))))) AS distance))) AS r FROM upstream u CROSS JOIN polygons p)""",
}


def _needs(sql: str, known: dict[str, str]) -> list[str]:
    return [x for x in known if re.search(rf"\b(?:FROM|JOIN)\s+{x}\b", sql, re.I)]


def needed(sql: str) -> list[str]:
    """The relations that a query reads in Spark, directly or through others."""
    known = RELATIONS | sites.RELATIONS | SPARK
    out: list[str] = []

    def visit(text: str) -> None:
        for name in _needs(text, known):
            if name not in out:
                out.append(name)
                visit(known[name])

    visit(sql)
    return out


def with_(sql: str, given: tuple[str, ...] = (), engine: str = "spark", scene: dict[str, str] | None = None) -> str:
    """A query with the relations that it needs in front, each after those that it depends on, but for those `given`.

    `scene` holds relations of another house, as `sources.config.scene` makes them.
    """
    known = RELATIONS | sites.RELATIONS | (SPARK if engine == "spark" else {}) | (scene or {})
    order: list[str] = list(given)

    def visit(text: str) -> None:
        for name in _needs(text, known):
            if name not in order:
                visit(known[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    body = ", ".join(f"{x} AS ({known[x]})" for x in order if x not in given)
    if not body:
        return sql
    if sql.lstrip().upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {body}, {sql.lstrip()[14:]}"
    if sql.lstrip().upper().startswith("WITH"):
        return f"WITH {body}, {sql.lstrip()[4:]}"
    return f"WITH {body} {sql}"
