"""Geometry, room graphs, presence and zones."""

from __future__ import annotations

QUERIES: dict[str, str] = {
    "g01_point_in_polygon": "SELECT seq, room_id, inside = 1 AS inside FROM hits",
    "g02_find_room": "SELECT device_id, seq, room_id FROM located",
    "g03_centroid": "SELECT room_id, round(cx, 6) AS cx, round(cy, 6) AS cy FROM centroids",
    "g04_area_bbox": "SELECT c.room_id, round(c.area, 6) AS area, min(v.x) AS min_x, min(v.y) AS min_y, max(v.x) AS max_x, max(v.y) AS max_y FROM centroids c JOIN vertices v ON c.room_id = v.room_id GROUP BY c.room_id, c.area",
    "g05_room_anchor": "SELECT room_id, round(x, 6) AS x, round(y, 6) AS y FROM anchors",
    "g06_adjacency": "SELECT a, b FROM shared_edges",
    "g08_segment_hits": "SELECT a, b, wall, round(t, 6) AS t, round(hx, 6) AS x, round(hy, 6) AS y FROM crossed",
    "g09_crossings": "SELECT a, b, CAST(interior AS BIGINT) AS interior, CAST(exterior AS BIGINT) AS exterior, CAST(doors AS BIGINT) AS doors FROM counted",
    "g10_obstruction_loss": "SELECT a, b, loss_db FROM wall_loss",
    "g11_pair_loss": "SELECT g.listener_id, g.transmitter_id, count(*) AS n, max(4.0D * c.interior + 10.0D * c.exterior) AS loss_db FROM gt_samples g JOIN counted c ON least(g.listener_id, g.transmitter_id) = c.a AND greatest(g.listener_id, g.transmitter_id) = c.b GROUP BY g.listener_id, g.transmitter_id",
    "g12_heatmap": """WITH gx AS (SELECT {unnest: 0; 59} AS i), gy AS (SELECT {unnest: 0; 49} AS j)
        SELECT n.node_id, i, j, round(-59.0D - 30.0D * log10(greatest(1.0D, sqrt(((i + 0.5D) * 0.2D - n.x) * ((i + 0.5D) * 0.2D - n.x) + ((j + 0.5D) * 0.2D - n.y) * ((j + 0.5D) * 0.2D - n.y) + (1.0D - n.z) * (1.0D - n.z)))), 6) AS rssi
        FROM gx CROSS JOIN gy CROSS JOIN nodes n""",
    "g15_label_size": "SELECT r.room_id, round(least(greatest(least(least(sqrt(c.area) * 0.33D, (r.x1 - r.x0) / (0.58D * length(r.room_name))), (r.y1 - r.y0) / 2.5D), 0.14D), 0.32D), 6) AS size FROM rooms r JOIN centroids c ON r.room_id = c.room_id",
    "g16_walk_graph": "SELECT a, b FROM walk UNION SELECT b, a FROM walk",
    "g18_distance_to_room": "SELECT seq, room_id, round(distance, 6) AS distance FROM room_distances",
    "g19_node_rooms": "SELECT node_id, room_id FROM node_rooms",
    "g20_circle_hits": """SELECT a.device_id, a.node_id AS a, b.node_id AS b, round(a.x + h * (b.x - a.x) / g - s * sqrt(greatest(a.d * a.d - h * h, 0.0D)) * (b.y - a.y) / g, 4) AS x,
          round(a.y + h * (b.y - a.y) / g + s * sqrt(greatest(a.d * a.d - h * h, 0.0D)) * (b.x - a.x) / g, 4) AS y
        FROM (SELECT device_id, i, j, g, (ra * ra - rb * rb + g * g) / (2.0D * g) AS h FROM (SELECT a.device_id, a.i AS i, b.i AS j, a.d AS ra, b.d AS rb, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS g
            FROM fixes a JOIN fixes b ON a.device_id = b.device_id AND a.i < b.i) q WHERE g > 1e-6 AND g <= ra + rb AND g >= abs(ra - rb)) z
        JOIN fixes a ON z.device_id = a.device_id AND z.i = a.i JOIN fixes b ON z.device_id = b.device_id AND z.j = b.i CROSS JOIN (SELECT 1.0D AS s UNION ALL SELECT -1.0D) sign""",
    "g21_location": "SELECT device_id, seq, room_id, CASE WHEN room_id IS NOT NULL OR (x >= 0 AND x <= 12 AND y >= 0 AND y <= 10) THEN 'first_floor' END AS floor_id FROM located",
    "g22_reported_room": "SELECT seq, CASE WHEN seq % 3 = 0 THEN 'outside' ELSE room_id END AS room_id, seq % 3 <> 1 AS room_reported FROM located",
    "a24_corners": "SELECT round(x, 3) AS x, round(y, 3) AS y, count(DISTINCT room_id) AS rooms, min(room_id) AS first_room FROM vertices GROUP BY round(x, 3), round(y, 3)",
    "a25_bounds": "SELECT min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM (SELECT x, y FROM vertices UNION ALL SELECT x, y FROM all_nodes) p",
    "a28_area_tags": "SELECT DISTINCT floor_area FROM rooms WHERE floor_area IS NOT NULL",
    "j22_open_targets": "SELECT o.room_id, o.target, r.room_id AS resolved FROM open_to o LEFT JOIN rooms r ON o.target = r.room_id OR o.target = r.room_name",
    "j23_reverse_refs": "SELECT DISTINCT r.room_id FROM rooms r WHERE EXISTS (SELECT 1 FROM open_to o WHERE o.target = r.room_id)",
    "j17_door_walls": """SELECT room_id, target, wall, round(apart, 6) AS apart FROM (SELECT d.*, row_number() OVER (PARTITION BY room_id, target ORDER BY round(apart, 9), wall) AS k FROM (
          SELECT room_id, target, wall, sqrt((door_x - ax - t * (bx - ax)) * (door_x - ax - t * (bx - ax)) + (door_y - ay - t * (b_y - ay)) * (door_y - ay - t * (b_y - ay))) AS apart
          FROM (SELECT o.room_id, o.target, o.door_x, o.door_y, s.wall, s.ax, s.ay, s.bx, s.b_y, least(greatest(((o.door_x - s.ax) * (s.bx - s.ax) + (o.door_y - s.ay) * (s.b_y - s.ay)) / ((s.bx - s.ax) * (s.bx - s.ax) + (s.b_y - s.ay) * (s.b_y - s.ay)), 0.0D), 1.0D) AS t FROM open_to o CROSS JOIN solid s) p) d) e WHERE k = 1""",
    "u04_adjacent_pairs": "SELECT a, b FROM trust",
    "u05_reverse_only": "SELECT target AS room_id FROM open_to EXCEPT SELECT room_id FROM open_to",
    "u06_connections": "SELECT room_id AS a, target AS b FROM open_to UNION SELECT target, room_id FROM open_to",
    "p06_zones": """WITH zones AS (SELECT * FROM (VALUES ('quiet', 'bedroom'), ('quiet', 'bath'), ('open', 'Living'), ('open', 'kitchen')) AS z(zone_id, room))
        SELECT l.seq, z.zone_id, max(CASE WHEN lower(z.room) = lower(coalesce(l.room_id, '')) THEN 1 ELSE 0 END) = 1 AS inside FROM located l CROSS JOIN zones z GROUP BY l.seq, z.zone_id""",
    "p07_default_state": "SELECT seq, coalesce(nullif(room_id, ''), CASE WHEN x >= 0 AND x <= 12 AND y >= 0 AND y <= 10 THEN 'first_floor' END, 'not_home') AS state FROM located",
    "w09_presence_changes": """SELECT device_id, seq, state FROM (SELECT *, lag(state) OVER (PARTITION BY device_id ORDER BY t_ms, seq) AS before FROM (
        SELECT device_id, seq, t_ms, coalesce(room_id, 'not_home') AS state FROM located) a) b WHERE before IS NULL OR before <> state""",
    "z05_discovery_rows": """SELECT device_id, room_id, seq FROM (SELECT device_id, room_id, seq, row_number() OVER (PARTITION BY device_id, room_id ORDER BY t_ms, seq) AS k FROM located WHERE room_id IS NOT NULL) a WHERE k = 1""",
}
