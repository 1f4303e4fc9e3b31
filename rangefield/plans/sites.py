"""Many houses at once: a house for every supplier, and all that is computed from floors, rooms, doors and nodes.

Each site takes one of three plans and its own scale, so rooms, walls, paths
and crossings grow with the table; everything is keyed and joined by site, and
no site meets another.  The relations are those of `relations.py` with a site,
and walls are built in full: edges split at the corners of other rooms, both
sides probed for rooms, doors merged into openings.
"""

from __future__ import annotations

#: Fixed values in metres: how close a corner is to an edge that it splits, least piece of an edge, how close ends are the same, how far sides are probed, mounting, merging.
SPLIT, PIECE, SAME, PROBE, MOUNTED, MERGED = "0.05D", "0.02D", "0.05D", "0.15D", "0.1D", "0.005D"


def side(px: str, py: str) -> str:
    """1 for an edge e that a ray from the point crosses."""
    return f"CASE WHEN (e.ay > {py}) <> (e.b_y > {py}) AND {px} < (e.bx - e.ax) * ({py} - e.ay) / (CASE WHEN e.b_y = e.ay THEN 1.0D ELSE e.b_y - e.ay END) + e.ax THEN 1 ELSE 0 END"


def along(px: str, py: str, s: str = "s") -> str:
    """Where on segment s (0 to 1) the point is closest."""
    return f"least(greatest((({px} - {s}.ax) * ({s}.bx - {s}.ax) + ({py} - {s}.ay) * ({s}.b_y - {s}.ay)) / (({s}.bx - {s}.ax) * ({s}.bx - {s}.ax) + ({s}.b_y - {s}.ay) * ({s}.b_y - {s}.ay)), 0.0D), 1.0D)"


RELATIONS: dict[str, str] = {
    "plan_rooms": """SELECT * FROM (VALUES
        (0, 0, 'living', 'Living', 'main_open', 0), (0, 1, 'kitchen', 'Kitchen', 'main_open', 0), (0, 2, 'office', 'Office', CAST(NULL AS STRING), 0), (0, 3, 'hall', 'Hall', CAST(NULL AS STRING), 0), (0, 4, 'bedroom', 'Bedroom', CAST(NULL AS STRING), 0), (0, 5, 'bath', 'Bath', CAST(NULL AS STRING), 0),
        (1, 0, 'ell', 'Ell', 'big', 0), (1, 1, 'den', 'Den', CAST(NULL AS STRING), 0), (1, 2, 'nook', 'Nook', 'big', 0), (1, 3, 'store', 'Store', CAST(NULL AS STRING), 0),
        (2, 0, 'shop', 'Shop', CAST(NULL AS STRING), 0), (2, 1, 'stair', 'Stair', CAST(NULL AS STRING), 0), (2, 2, 'loft', 'Loft', CAST(NULL AS STRING), 1), (2, 3, 'attic', 'Attic', 'top', 1), (2, 4, 'terrace', 'Terrace', 'top', 1))
        AS r(plan, ord, room_id, room_name, floor_area, level)""",
    # an L with a T-junction (plan 1), and two floors with a long wall that three rooms meet (plan 2)
    "plan_corners": """SELECT plan, ord, k - 1 AS v, {num: {grab: pt; '^ *([-0-9.]+) '; 1}} AS x, {num: {grab: pt; ' ([-0-9.]+) *$'; 1}} AS y FROM (SELECT plan, ord, k, {part_of: outline; ','; k} AS pt FROM (SELECT * FROM (VALUES
        (0, 0, '0 0,4 0,4 5,0 5', 4), (0, 1, '4 0,8 0,8 5,4 5', 4), (0, 2, '8 0,12 0,12 5,8 5', 4), (0, 3, '0 5,4 5,4 10,0 10', 4), (0, 4, '4 5,8 5,8 10,4 10', 4), (0, 5, '8 5,12 5,12 10,8 10', 4),
        (1, 0, '0 0,6 0,6 2,2 2,2 6,0 6', 6), (1, 1, '2 2,6 2,6 6,2 6', 4), (1, 2, '6 0,9 0,9 4,6 4', 4), (1, 3, '6 4,9 4,9 6,6 6', 4),
        (2, 0, '0 0,10 0,10 4,0 4', 4), (2, 1, '0 4,4 4,4 8,0 8', 4), (2, 2, '0 0,10 0,10 3,0 3', 4), (2, 3, '0 3,5 3,5 8,0 8', 4), (2, 4, '5 3,10 3,10 8,5 8', 4))
        AS c(plan, ord, outline, n)) o CROSS JOIN (SELECT {unnest: 1; 6} AS k) i WHERE k <= n) p""",
    "plan_doors": """SELECT * FROM (VALUES (0, 'living', 'hall', 2.0D, 5.0D, 0.8D), (0, 'office', 'Bath', 10.0D, 5.0D, 0.9D), (0, 'hall', 'outside', 0.0D, 7.5D, 1.0D), (0, 'hall', 'bedroom', 4.0D, 7.5D, 0.8D), (0, 'bedroom', 'hall', 4.0D, 7.8D, 0.8D), (0, 'bedroom', 'bath', 8.0D, 6.0D, 0.8D),
        (1, 'ell', 'Den', 4.0D, 2.0D, 1.0D), (1, 'ell', 'outside', 0.0D, 3.0D, 0.9D), (1, 'den', 'store', 6.0D, 5.0D, 0.8D), (1, 'nook', 'store', 7.5D, 4.0D, 0.8D), (2, 'shop', 'outside', 5.0D, 0.0D, 1.2D), (2, 'shop', 'Stair', 2.0D, 4.0D, 0.8D), (2, 'stair', 'attic', 2.0D, 6.0D, 0.8D), (2, 'attic', 'loft', 2.5D, 3.0D, 0.8D))
        AS d(plan, room_id, target, x, y, width)""",
    "plan_nodes": """SELECT * FROM (VALUES (0, 0, 1.0D, 1.0D, 1.2D, 0, CAST(NULL AS STRING)), (0, 1, 5.0D, 4.0D, 2.0D, 0, CAST(NULL AS STRING)), (0, 2, 9.0D, 1.0D, 1.2D, 0, CAST(NULL AS STRING)), (0, 3, 3.0D, 9.0D, 2.0D, 0, CAST(NULL AS STRING)), (0, 4, 8.0D, 7.0D, 1.0D, 0, 'Bedroom'), (0, 5, 11.0D, 9.0D, 1.0D, 0, CAST(NULL AS STRING)),
        (1, 0, 1.0D, 1.0D, 1.0D, 0, CAST(NULL AS STRING)), (1, 1, 4.0D, 4.0D, 2.0D, 0, 'Den'), (1, 2, 7.5D, 2.0D, 1.0D, 0, CAST(NULL AS STRING)), (1, 3, 8.5D, 5.5D, 1.0D, 0, CAST(NULL AS STRING)), (1, 4, 1.0D, 5.5D, 1.0D, 0, CAST(NULL AS STRING)),
        (2, 0, 1.0D, 1.0D, 1.0D, 0, CAST(NULL AS STRING)), (2, 1, 9.0D, 2.0D, 1.0D, 0, CAST(NULL AS STRING)), (2, 2, 2.0D, 7.0D, 1.0D, 0, CAST(NULL AS STRING)), (2, 3, 2.0D, 1.0D, 4.0D, 1, CAST(NULL AS STRING)), (2, 4, 8.0D, 6.0D, 4.0D, 1, CAST(NULL AS STRING)))
        AS n(plan, ord, x, y, z, level, room_label)""",
    "sites": "SELECT s_suppkey AS site, s_suppkey % 3 AS plan, 1.0D + (s_suppkey % 7) / 20.0D AS fx, 1.0D + (s_suppkey % 5) / 10.0D AS fy FROM {t:supplier}",
    "h_rooms": "SELECT s.site, r.ord, r.room_id, r.room_name, r.floor_area, r.level FROM sites s JOIN plan_rooms r ON s.plan = r.plan",
    "h_vertices": "SELECT s.site, r.ord, r.room_id, r.level, c.v, c.x * s.fx AS x, c.y * s.fy AS y FROM sites s JOIN plan_rooms r ON s.plan = r.plan JOIN plan_corners c ON c.plan = r.plan AND c.ord = r.ord",
    "h_edges": "SELECT a.site, a.ord, a.room_id, a.level, a.v, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM (SELECT *, count(*) OVER (PARTITION BY site, room_id) AS corners FROM h_vertices) a JOIN h_vertices b ON a.site = b.site AND a.room_id = b.room_id AND b.v = (a.v + 1) % a.corners",
    "h_open": "SELECT s.site, d.room_id, d.target, d.x * s.fx AS door_x, d.y * s.fy AS door_y, d.width FROM sites s JOIN plan_doors d ON s.plan = d.plan",
    "h_all_nodes": "SELECT s.site, 'n' || CAST(n.ord AS STRING) AS node_id, n.ord, n.x * s.fx AS x, n.y * s.fy AS y, n.z, n.level, n.room_label, (s.site + n.ord) % 11 <> 0 AS enabled FROM sites s JOIN plan_nodes n ON s.plan = n.plan",
    "h_nodes": "SELECT * FROM h_all_nodes WHERE enabled",
    "h_node_rooms": f"""SELECT n.site, n.node_id, n.ord, n.x, n.y, n.z, n.level, n.enabled, n.room_label, coalesce(l.room_id, p.room_id) AS room_id
        FROM h_all_nodes n LEFT JOIN h_rooms l ON n.site = l.site AND (n.room_label = l.room_id OR n.room_label = l.room_name)
        LEFT JOIN (SELECT site, node_id, room_id FROM (SELECT site, node_id, room_id, row_number() OVER (PARTITION BY site, node_id ORDER BY ord) AS k FROM (
            SELECT n.site, n.node_id, e.ord, e.room_id, sum({side("n.x", "n.y")}) % 2 AS inside FROM h_all_nodes n JOIN h_edges e ON n.site = e.site AND n.level = e.level GROUP BY n.site, n.node_id, e.ord, e.room_id) h WHERE inside = 1) q WHERE k = 1) p ON n.site = p.site AND n.node_id = p.node_id""",
    "h_shared": """SELECT DISTINCT a.site, least(a.room_id, b.room_id) AS a, greatest(a.room_id, b.room_id) AS b FROM h_edges a JOIN h_edges b ON a.site = b.site AND a.ord < b.ord
        AND ((abs(a.ax - b.ax) < 0.1D AND abs(a.ay - b.ay) < 0.1D AND abs(a.bx - b.bx) < 0.1D AND abs(a.b_y - b.b_y) < 0.1D) OR (abs(a.ax - b.bx) < 0.1D AND abs(a.ay - b.b_y) < 0.1D AND abs(a.bx - b.ax) < 0.1D AND abs(a.b_y - b.ay) < 0.1D))""",
    "h_targets": "SELECT o.site, o.room_id, o.target, r.room_id AS resolved, o.door_x, o.door_y, o.width FROM h_open o LEFT JOIN h_rooms r ON o.site = r.site AND (o.target = r.room_id OR o.target = r.room_name)",
    "h_walk": """SELECT DISTINCT site, least(a, b) AS a, greatest(a, b) AS b FROM (SELECT site, room_id AS a, coalesce(resolved, target) AS b FROM h_targets
        UNION ALL SELECT p.site, p.room_id, q.room_id FROM h_rooms p JOIN h_rooms q ON p.site = q.site AND p.floor_area = q.floor_area AND p.ord < q.ord) u""",
    "h_trust": "SELECT DISTINCT site, a, b FROM (SELECT site, a, b FROM h_shared UNION ALL SELECT site, a, b FROM h_walk) u WHERE a <> 'outside' AND b <> 'outside'",
    "h_shoelace": "SELECT site, room_id, sum(ax * b_y - bx * ay) / 2.0D AS area, sum((ax + bx) * (ax * b_y - bx * ay)) AS sx, sum((ay + b_y) * (ax * b_y - bx * ay)) AS sy FROM h_edges GROUP BY site, room_id",
    "h_centroids": "SELECT site, room_id, abs(area) AS area, sx / (6.0D * area) AS cx, sy / (6.0D * area) AS cy FROM h_shoelace",
    "h_anchors": f"""SELECT c.site, c.room_id, CASE WHEN h.inside = 1 THEN c.cx ELSE m.mx END AS x, CASE WHEN h.inside = 1 THEN c.cy ELSE m.my END AS y FROM h_centroids c
        JOIN (SELECT c.site, c.room_id, sum({side("c.cx", "c.cy")}) % 2 AS inside FROM h_centroids c JOIN h_edges e ON c.site = e.site AND c.room_id = e.room_id GROUP BY c.site, c.room_id) h ON c.site = h.site AND c.room_id = h.room_id
        JOIN (SELECT site, room_id, avg(x) AS mx, avg(y) AS my FROM h_vertices GROUP BY site, room_id) m ON c.site = m.site AND c.room_id = m.room_id""",
    # edges split where a corner of any room lies on them
    "h_splits": f"""SELECT site, ord, room_id, level, v, ax, ay, bx, b_y, t FROM (SELECT e.site, e.ord, e.room_id, e.level, e.v, e.ax, e.ay, e.bx, e.b_y, round(((w.x - e.ax) * (e.bx - e.ax) + (w.y - e.ay) * (e.b_y - e.ay)) / ((e.bx - e.ax) * (e.bx - e.ax) + (e.b_y - e.ay) * (e.b_y - e.ay)), 9) AS t
          FROM h_edges e JOIN h_vertices w ON e.site = w.site AND abs((w.x - e.ax) * (e.b_y - e.ay) - (w.y - e.ay) * (e.bx - e.ax)) <= {SPLIT} * sqrt((e.bx - e.ax) * (e.bx - e.ax) + (e.b_y - e.ay) * (e.b_y - e.ay))) q WHERE t > {PIECE} AND t < 1.0D - {PIECE}
        UNION SELECT site, ord, room_id, level, v, ax, ay, bx, b_y, 0.0D FROM h_edges UNION SELECT site, ord, room_id, level, v, ax, ay, bx, b_y, 1.0D FROM h_edges""",
    "h_pieces": f"""SELECT site, ord, level, v, t, ax + t * (bx - ax) AS ax, ay + t * (b_y - ay) AS ay, ax + u * (bx - ax) AS bx, ay + u * (b_y - ay) AS b_y FROM (SELECT *, lead(t) OVER (PARTITION BY site, ord, v ORDER BY t) AS u FROM (
          SELECT * FROM (SELECT *, t - lag(t) OVER (PARTITION BY site, ord, v ORDER BY t) AS step FROM h_splits) s WHERE step IS NULL OR step > {PIECE}) k) p WHERE u IS NOT NULL""",
    # the first piece of each place in the plane stays, in the order of rooms and edges
    "h_once": f"""SELECT site, ax, ay, bx, b_y, row_number() OVER (PARTITION BY site ORDER BY ord, v, t) AS wall FROM (SELECT p.*, row_number() OVER (PARTITION BY site, least(round(ax, 3) * 100000 + round(ay, 3), round(bx, 3) * 100000 + round(b_y, 3)), greatest(round(ax, 3) * 100000 + round(ay, 3), round(bx, 3) * 100000 + round(b_y, 3)) ORDER BY ord, v, t) AS k FROM h_pieces p) q WHERE k = 1""",
    "h_probes": f"""SELECT site, wall, 0 AS side, (ax + bx) / 2.0D - {PROBE} * (b_y - ay) / l AS px, (ay + b_y) / 2.0D + {PROBE} * (bx - ax) / l AS py FROM (SELECT *, sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)) AS l FROM h_once) a
        UNION ALL SELECT site, wall, 1, (ax + bx) / 2.0D + {PROBE} * (b_y - ay) / l, (ay + b_y) / 2.0D - {PROBE} * (bx - ax) / l FROM (SELECT *, sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)) AS l FROM h_once) b""",
    "h_sides": f"""SELECT site, wall, side, ord, room_id FROM (SELECT *, row_number() OVER (PARTITION BY site, wall, side ORDER BY ord) AS k FROM (
          SELECT p.site, p.wall, p.side, e.ord, e.room_id, sum({side("p.px", "p.py")}) % 2 AS inside FROM h_probes p JOIN h_edges e ON p.site = e.site GROUP BY p.site, p.wall, p.side, e.ord, e.room_id) i WHERE inside = 1) f WHERE k = 1""",
    "h_solid": """SELECT w.site, w.wall, w.ax, w.ay, w.bx, w.b_y, a.room_id AS left_room, b.room_id AS right_room, a.room_id IS NULL OR b.room_id IS NULL AS exterior FROM h_once w
        LEFT JOIN h_sides a ON w.site = a.site AND w.wall = a.wall AND a.side = 0 LEFT JOIN h_sides b ON w.site = b.site AND w.wall = b.wall AND b.side = 1
        LEFT JOIN h_rooms p ON a.site = p.site AND a.room_id = p.room_id LEFT JOIN h_rooms q ON b.site = q.site AND b.room_id = q.room_id WHERE NOT coalesce(p.floor_area = q.floor_area, false)""",
    # each door on its nearest wall, as the part of the wall that it opens; parts that overlap are one
    "h_door_walls": f"""SELECT * FROM (SELECT d.*, row_number() OVER (PARTITION BY site, room_id, target, door_x, door_y ORDER BY round(apart, 9), wall) AS k FROM (
          SELECT site, room_id, target, door_x, door_y, width, wall, len, t, sqrt((door_x - ax - t * (bx - ax)) * (door_x - ax - t * (bx - ax)) + (door_y - ay - t * (b_y - ay)) * (door_y - ay - t * (b_y - ay))) AS apart
          FROM (SELECT o.*, s.wall, s.ax, s.ay, s.bx, s.b_y, sqrt((s.bx - s.ax) * (s.bx - s.ax) + (s.b_y - s.ay) * (s.b_y - s.ay)) AS len, {along("o.door_x", "o.door_y")} AS t FROM h_open o JOIN h_solid s ON o.site = s.site) p) d) e WHERE k = 1""",
    "h_openings": """SELECT site, wall, part, min(t0) AS t0, max(t1) AS t1 FROM (SELECT *, sum(fresh) OVER (PARTITION BY site, wall ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part FROM (
          SELECT *, CASE WHEN t0 <= max(t1) OVER (PARTITION BY site, wall ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM (
            SELECT DISTINCT site, wall, greatest(0.0D, t - width / (2.0D * len)) AS t0, least(1.0D, t + width / (2.0D * len)) AS t1 FROM h_door_walls WHERE len >= 1e-6) r) f) g GROUP BY site, wall, part""",
    # paths from a sender to a listener of the same floor; a wall at the sender counts if the sender's room is on its other side
    "h_paths": "SELECT a.site, a.node_id AS a, b.node_id AS b, a.x AS px, a.y AS py, b.x AS qx, b.y AS qy, m.x AS mx, m.y AS my FROM h_node_rooms a JOIN h_node_rooms b ON a.site = b.site AND a.node_id <> b.node_id AND a.level = b.level AND a.enabled AND b.enabled LEFT JOIN h_anchors m ON a.site = m.site AND a.room_id = m.room_id",
    "h_crossed": f"""SELECT site, a, b, wall, exterior, t, u, px + t * (qx - px) AS hx, py + t * (qy - py) AS hy FROM (
          SELECT p.*, s.wall, s.exterior, ((s.ax - p.px) * (s.b_y - s.ay) - (s.ay - p.py) * (s.bx - s.ax)) / nullif((p.qx - p.px) * (s.b_y - s.ay) - (p.qy - p.py) * (s.bx - s.ax), 0.0D) AS t, ((s.ax - p.px) * (p.qy - p.py) - (s.ay - p.py) * (p.qx - p.px)) / nullif((p.qx - p.px) * (s.b_y - s.ay) - (p.qy - p.py) * (s.bx - s.ax), 0.0D) AS u,
            sqrt((p.px - s.ax - {along("p.px", "p.py")} * (s.bx - s.ax)) * (p.px - s.ax - {along("p.px", "p.py")} * (s.bx - s.ax)) + (p.py - s.ay - {along("p.px", "p.py")} * (s.b_y - s.ay)) * (p.py - s.ay - {along("p.px", "p.py")} * (s.b_y - s.ay))) < {MOUNTED} AS mounted,
            ((s.bx - s.ax) * (p.my - s.ay) - (s.b_y - s.ay) * (p.mx - s.ax)) * ((s.bx - s.ax) * (p.qy - s.ay) - (s.b_y - s.ay) * (p.qx - s.ax)) AS sides
          FROM h_paths p JOIN h_solid s ON p.site = s.site WHERE abs((p.qx - p.px) * (s.b_y - s.ay) - (p.qy - p.py) * (s.bx - s.ax)) >= 1e-12) z WHERE t >= 0 AND t <= 1 AND u >= 0 AND u <= 1 AND (NOT mounted OR coalesce(sides < 0, false))""",
    "h_kinds": "SELECT c.site, c.a, c.b, c.wall, c.t, max(CASE WHEN o.wall IS NOT NULL THEN 2 WHEN c.exterior THEN 1 ELSE 0 END) AS kind FROM h_crossed c LEFT JOIN h_openings o ON c.site = o.site AND c.wall = o.wall AND c.u >= o.t0 AND c.u <= o.t1 GROUP BY c.site, c.a, c.b, c.wall, c.t",
    "h_hits": f"""SELECT site, a, b, max(kind) AS kind FROM (SELECT k.*, sum(fresh) OVER (PARTITION BY site, a, b ORDER BY t, wall ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM (
          SELECT k.*, CASE WHEN t - lag(t) OVER (PARTITION BY site, a, b ORDER BY t, wall) < {MERGED} THEN 0 ELSE 1 END AS fresh FROM h_kinds k) k) g GROUP BY site, a, b, grp""",
    "h_counted": """SELECT p.site, p.a, p.b, coalesce(sum(CASE WHEN m.kind = 0 THEN 1 ELSE 0 END), 0) AS interior, coalesce(sum(CASE WHEN m.kind = 1 THEN 1 ELSE 0 END), 0) AS exterior, coalesce(sum(CASE WHEN m.kind = 2 THEN 1 ELSE 0 END), 0) AS doors
        FROM h_paths p LEFT JOIN h_hits m ON p.site = m.site AND p.a = m.a AND p.b = m.b GROUP BY p.site, p.a, p.b""",
}

QUERIES: dict[str, str] = {
    "f10_nodes_on_floor": "SELECT site, level, node_id, x, y, z FROM h_all_nodes WHERE level = 0",
    "f17_node_index": "SELECT site, node_id, x, y, z FROM h_nodes",
    "x01_distances": "SELECT a.site, a.node_id AS a, b.node_id AS b, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), 6) AS d2, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), 6) AS d3 FROM h_nodes a JOIN h_nodes b ON a.site = b.site AND a.node_id < b.node_id",
    "x07_map_transform": """SELECT n.site, n.node_id, round(m.x1 - n.x, 6) AS flipped_x, round(m.y1 - n.y, 6) AS flipped_y, round(m.x1 - (m.x1 - n.x), 6) AS back_x, round(m.y1 - (m.y1 - n.y), 6) AS back_y
        FROM h_nodes n JOIN (SELECT site, max(x) AS x1, max(y) AS y1 FROM h_vertices GROUP BY site) m ON n.site = m.site""",
    "g03_centroid": "SELECT site, room_id, round(cx, 6) AS cx, round(cy, 6) AS cy FROM h_centroids",
    "g04_area_bbox": "SELECT c.site, c.room_id, round(c.area, 6) AS area, round(min(v.x), 6) AS min_x, round(min(v.y), 6) AS min_y, round(max(v.x), 6) AS max_x, round(max(v.y), 6) AS max_y FROM h_centroids c JOIN h_vertices v ON c.site = v.site AND c.room_id = v.room_id GROUP BY c.site, c.room_id, c.area",
    "g05_room_anchor": "SELECT site, room_id, round(x, 6) AS x, round(y, 6) AS y FROM h_anchors",
    "g06_adjacency": "SELECT site, a, b FROM h_shared",
    "g07_walls": "SELECT w.site, w.wall, round(w.ax, 6) AS ax, round(w.ay, 6) AS ay, round(w.bx, 6) AS bx, round(w.b_y, 6) AS b_y, w.exterior, w.left_room, w.right_room FROM h_solid w",
    "g07_openings": "SELECT site, wall, round(t0, 6) AS t0, round(t1, 6) AS t1 FROM h_openings",
    "g08_segment_hits": "SELECT site, a, b, wall, round(t, 6) AS t, round(u, 6) AS u, round(hx, 6) AS x, round(hy, 6) AS y FROM h_crossed",
    "g09_crossings": "SELECT site, a, b, CAST(interior AS BIGINT) AS interior, CAST(exterior AS BIGINT) AS exterior, CAST(doors AS BIGINT) AS doors FROM h_counted",
    "g10_obstruction_loss": "SELECT site, a, b, 4.0D * interior + 10.0D * exterior + 0.0D * doors AS loss_db FROM h_counted",
    "g12_heatmap": """WITH size AS (SELECT site, max(x) AS w, max(y) AS h FROM h_vertices GROUP BY site), gx AS (SELECT {unnest: 0; 99} AS i), gy AS (SELECT {unnest: 0; 99} AS j), sender AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY ord) AS k FROM h_nodes) n WHERE k = 1)
        SELECT s.site, n.node_id, i, j, round(-59.0D - 30.0D * log10(greatest(1.0D, sqrt(((i + 0.5D) * 0.2D - n.x) * ((i + 0.5D) * 0.2D - n.x) + ((j + 0.5D) * 0.2D - n.y) * ((j + 0.5D) * 0.2D - n.y) + (1.0D - n.z) * (1.0D - n.z)))), 6) AS rssi
        FROM size s JOIN sender n ON s.site = n.site CROSS JOIN gx CROSS JOIN gy WHERE i * 0.2D < s.w AND j * 0.2D < s.h""",
    "g14_wall_refs": f"""SELECT site, node_id, wall, round(along, 6) AS along, round(apart, 6) AS apart, round(corner, 6) AS corner FROM (SELECT q.*, row_number() OVER (PARTITION BY site, node_id ORDER BY round(apart, 9), wall) AS k FROM (
          SELECT site, node_id, wall, t * sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)) AS along, sqrt((x - ax - t * (bx - ax)) * (x - ax - t * (bx - ax)) + (y - ay - t * (b_y - ay)) * (y - ay - t * (b_y - ay))) AS apart,
            least(sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay)), sqrt((x - bx) * (x - bx) + (y - b_y) * (y - b_y))) AS corner
          FROM (SELECT n.site, n.node_id, n.x, n.y, s.wall, s.ax, s.ay, s.bx, s.b_y, {along("n.x", "n.y")} AS t FROM h_all_nodes n JOIN h_solid s ON n.site = s.site) p) q) r WHERE k = 1""",
    "g15_label_size": """SELECT r.site, r.room_id, round(least(greatest(least(least(sqrt(c.area) * 0.33D, (b.x1 - b.x0) / (0.58D * length(r.room_name))), (b.y1 - b.y0) / 2.5D), 0.14D), 0.32D), 6) AS size FROM h_rooms r JOIN h_centroids c ON r.site = c.site AND r.room_id = c.room_id
        JOIN (SELECT site, room_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM h_vertices GROUP BY site, room_id) b ON r.site = b.site AND r.room_id = b.room_id""",
    "g16_walk_graph": "SELECT site, a, b FROM h_walk UNION ALL SELECT site, b, a FROM h_walk",
    "g19_node_rooms": "SELECT site, node_id, level, room_id FROM h_node_rooms",
    "a24_corners": "SELECT site, round(x, 3) AS x, round(y, 3) AS y, count(DISTINCT room_id) AS rooms, min(room_id) AS first_room FROM h_vertices GROUP BY site, round(x, 3), round(y, 3)",
    "a25_bounds": "SELECT site, round(min(x), 6) AS min_x, round(min(y), 6) AS min_y, round(max(x), 6) AS max_x, round(max(y), 6) AS max_y FROM (SELECT site, x, y FROM h_vertices UNION ALL SELECT site, x, y FROM h_all_nodes) p GROUP BY site",
    "a28_area_tags": "SELECT DISTINCT site, floor_area FROM h_rooms WHERE floor_area IS NOT NULL",
    "j07_edge_adjacency": "SELECT site, least(a, b) AS a, greatest(a, b) AS b FROM h_shared",
    "j08_path_walls": "SELECT site, a, b, wall, exterior, round(t, 6) AS t FROM h_crossed",
    "j14_rooms_of_nodes": "SELECT site, node_id, room_label, room_id, room_label IS NOT NULL AS explicit FROM h_node_rooms",
    "j17_door_walls": "SELECT site, room_id, target, wall, round(apart, 6) AS apart, round(t, 6) AS t FROM h_door_walls",
    "j22_open_targets": "SELECT site, room_id, target, resolved FROM h_targets",
    "j23_reverse_refs": "SELECT DISTINCT site, resolved AS room_id, room_id AS named_by FROM h_targets WHERE resolved IS NOT NULL",
    "u04_adjacent_pairs": "SELECT site, a, b FROM h_trust",
    "u05_reverse_only": "SELECT DISTINCT t.site, t.resolved AS room_id FROM h_targets t LEFT JOIN h_open o ON t.site = o.site AND t.resolved = o.room_id WHERE t.resolved IS NOT NULL AND o.room_id IS NULL",
    "u06_connections": "SELECT DISTINCT site, a, b FROM (SELECT site, room_id AS a, coalesce(resolved, target) AS b FROM h_targets UNION ALL SELECT site, coalesce(resolved, target), room_id FROM h_targets) u",
    "k07_scaled_rooms": "SELECT site, room_id, v, round(x * 1.1D, 3) AS x, round(y * 1.1D, 3) AS y FROM h_vertices",
}
#: Least steps between rooms of a site, in the checking engine.
HOPS = """WITH RECURSIVE trips(site, a, b, hops) AS (SELECT site, room_id, room_id, 0 FROM h_rooms UNION SELECT p.site, p.a, w.b, p.hops + 1 FROM trips p JOIN (SELECT site, a, b FROM h_walk UNION SELECT site, b, a FROM h_walk) w ON p.site = w.site AND p.b = w.a WHERE p.hops < 7)
  SELECT site, a, b, min(hops) AS hops FROM trips GROUP BY site, a, b"""
