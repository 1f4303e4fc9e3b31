"""Locators that SQL can express, over the latest fixes of each device, and what is derived from them.

Every chain works on a relation of fixes(id, node_id, x, y, z, d, room_id, i, m):
`i` orders the fixes of one problem `id`, `m` counts them.
"""

from __future__ import annotations

import re

FIXES = "fx AS (SELECT device_id AS id, node_id, x, y, z, d, room_id, i, m FROM fixes)"
#: One problem per device and left-out node.
LEFT_OUT = """fx AS (SELECT f.device_id || '/' || o.node_id AS id, f.node_id, f.x, f.y, f.z, f.d, f.room_id, f.i, f.m - 1 AS m
    FROM fixes f JOIN fixes o ON f.device_id = o.device_id AND f.node_id <> o.node_id WHERE f.m >= 4)"""
R3 = "sqrt((p.x - f.x) * (p.x - f.x) + (p.y - f.y) * (p.y - f.y) + (p.z - f.z) * (p.z - f.z))"
R2 = "sqrt((p.x - f.x) * (p.x - f.x) + (p.y - f.y) * (p.y - f.y))"


IDW = "{idw}"  # the reweighted centroids s4(id, x, y, z) and weights w4, which the registry fills in for either engine
IDW_KEPT = "{idw_kept}"  # the same without the outliers of the first solution


def kept(sql: str) -> str:
    """A chain of relations under names of its own, over the fixes that are no outliers."""
    return re.sub(r"\b(fx|w0|w1|w2|w3|w4|s0|s1|s2|s3|s4|solved|middle|fit|nadaraya)\b", r"\1_kept", sql)


def idw_relational(turns: int = 4) -> str:
    """Inverse-square centroids, reweighted `turns` times against fixes that measure too far, as a chain of joins."""
    mean = "sum(w * x) / sum(w) AS x, sum(w * y) / sum(w) AS y, sum(w * z) / sum(w) AS z"
    out = [f"w0 AS (SELECT id, node_id, x, y, z, d, m, 1.0D / (d * d + 1e-6) AS w FROM fx), s0 AS (SELECT id, {mean} FROM w0 GROUP BY id)"]
    for k in range(1, turns + 1):
        out.append(
            f"w{k} AS (SELECT f.id, f.node_id, f.x, f.y, f.z, f.d, f.m, f.w * CASE WHEN f.d - {R3} > 0 THEN 1.0D / (1.0D + ((f.d - {R3}) / 1.5D) * ((f.d - {R3}) / 1.5D)) ELSE 1.0D END AS w "
            f"FROM w{k - 1} f JOIN s{k - 1} p ON f.id = p.id), s{k} AS (SELECT id, {mean} FROM w{k} GROUP BY id)"
        )
    return ", ".join(out)


def idw_arrays(turns: int = 4) -> str:
    """The same over one array of fixes per problem: every turn reads the one before once, and nothing is joined."""
    mean = "transform(array('x', 'y', 'z'), c -> aggregate(q, 0.0D, (t, e) -> t + e.w * CASE c WHEN 'x' THEN e.x WHEN 'y' THEN e.y ELSE e.z END) / aggregate(q, 0.0D, (t, e) -> t + e.w))"
    far = "sqrt((s.p[0] - e.x) * (s.p[0] - e.x) + (s.p[1] - e.y) * (s.p[1] - e.y) + (s.p[2] - e.z) * (s.p[2] - e.z))"
    weight = f"e.w * CASE WHEN e.d - {far} > 0 THEN 1.0D / (1.0D + ((e.d - {far}) / 1.5D) * ((e.d - {far}) / 1.5D)) ELSE 1.0D END"
    again = f"transform(s.a, e -> struct(e.i AS i, e.node_id AS node_id, e.x AS x, e.y AS y, e.z AS z, e.d AS d, e.m AS m, {weight} AS w))"
    solve = f"q -> struct(q AS a, {mean} AS p)"  # binds the array, so that it is computed once
    first = "SELECT id, array_sort(collect_list(struct(i, node_id, x, y, z, d, m, 1.0D / (d * d + 1e-6D) AS w))) AS a FROM fx GROUP BY id"
    fold = f"aggregate(sequence(1, {turns}), transform(array(a), {solve})[0], (s, k) -> transform(array({again}), {solve})[0])"
    sql = f"SELECT id, s.a AS a, s.p AS p FROM (SELECT id, {fold} AS s FROM ({first}))"
    return f"solved AS ({sql}), s4 AS (SELECT id, p[0] AS x, p[1] AS y, p[2] AS z FROM solved), w4 AS (SELECT id, e.node_id, e.x, e.y, e.z, e.d, e.m, e.w FROM (SELECT id, explode(a) AS e FROM solved))"


CENTRE = f"""middle AS (SELECT id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, i) AS k FROM fx WHERE m < 3) a WHERE k <= 2 GROUP BY id),
  fit AS (SELECT f.id, sqrt(sum(f.w * (f.d - {R3}) * (f.d - {R3})) / sum(f.w)) AS rmse, max(f.m) AS m FROM w4 f JOIN s4 p ON f.id = p.id GROUP BY f.id),
  nadaraya AS (SELECT s.id, s.x, s.y, s.z, least(greatest(0.7D / (1.0D + t.rmse / 2.0D) + 0.3D * least(1.0D, t.m / 6.0D), 0.0D), 1.0D) AS confidence, t.m AS fixes FROM s4 s JOIN fit t ON s.id = t.id WHERE t.m >= 3
    UNION ALL SELECT c.id, c.x, c.y, c.z, 0.2D, t.m FROM middle c JOIN fit t ON c.id = t.id)"""
#: Places that the registry fills in: as chains of relations for the checking engine, from the vectorised locators for Spark.
PLACES: dict[str, str] = {}
PLACES["nadaraya"] = f"{IDW}, {CENTRE}"
NADARAYA = "{place_nadaraya}"
#: Plain inverse-square means.
PLAIN = "plain AS (SELECT id, sum(x / (d * d + 1e-6)) / sum(1.0D / (d * d + 1e-6)) AS x, sum(y / (d * d + 1e-6)) / sum(1.0D / (d * d + 1e-6)) AS y, sum(z / (d * d + 1e-6)) / sum(1.0D / (d * d + 1e-6)) AS z, count(*) AS m FROM fx GROUP BY id)"

NEAREST = """nearest AS (SELECT a.id, coalesce(r.x, a.x) AS x, coalesce(r.y, a.y) AS y, a.z,
      greatest(0.0D, 1.0D - a.d / 10.0D) AS confidence, a.m AS fixes FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, i) AS k FROM fx) a LEFT JOIN anchors r ON a.room_id = r.room_id WHERE k = 1)"""

#: The two crossing points of every pair of fix circles.
CROSSINGS = """pairs AS (SELECT a.id, a.node_id AS na, b.node_id AS nb, a.room_id AS room_a, b.room_id AS room_b, a.d AS ra, b.d AS rb, a.x AS px, a.y AS py, b.x AS qx, b.y AS qy,
      sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS g FROM fx a JOIN fx b ON a.id = b.id AND a.i < b.i),
  meets AS (SELECT p.*, (ra * ra - rb * rb + g * g) / (2.0D * g) AS h FROM pairs p WHERE g >= 1e-6 AND g <= ra + rb AND g >= abs(ra - rb)),
  candidates AS (SELECT m.id, m.na, m.nb, m.room_a, m.room_b, m.ra, m.rb, m.g, s.s,
      px + h * (qx - px) / g - s.s * sqrt(greatest(ra * ra - h * h, 0.0D)) * (qy - py) / g AS x, py + h * (qy - py) / g + s.s * sqrt(greatest(ra * ra - h * h, 0.0D)) * (qx - px) / g AS y
    FROM meets m CROSS JOIN (SELECT 1.0D AS s UNION ALL SELECT -1.0D) s)"""

VOTE = """vote AS (SELECT id, room_id FROM (SELECT id, room_id, row_number() OVER (PARTITION BY id ORDER BY round(sum(1.0D / (d * d + 1e-6)), 9) DESC, min(i)) AS k
      FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, i) AS near FROM fx) a WHERE near <= 3 AND room_id IS NOT NULL GROUP BY id, room_id) v WHERE k = 1),
  linked AS (SELECT f.id, f.node_id, v.room_id AS home, CASE WHEN v.room_id IS NULL THEN 0 WHEN f.room_id = v.room_id OR t.a IS NOT NULL THEN 1 ELSE 0 END AS near
    FROM fx f LEFT JOIN vote v ON f.id = v.id LEFT JOIN trust2 t ON t.a = v.room_id AND t.b = f.room_id)"""

ROOM_AWARE = "{place_room_aware}"
ROOM_AWARE_CHAIN = f"""{PLAIN}, {CROSSINGS}, {VOTE},
  weighed AS (SELECT c.*, greatest(0.01D, 1.0D - ((ra * ra + rb * rb - g * g) / (2.0D * ra * rb)) * ((ra * ra + rb * rb - g * g) / (2.0D * ra * rb))) / (ra * rb)
      * CASE WHEN la.home IS NULL THEN 0.3D WHEN la.near = 1 AND lb.near = 1 THEN CASE WHEN c.room_a = la.home AND c.room_b = la.home THEN 1.0D ELSE 0.8D END WHEN la.near + lb.near = 1 THEN 0.3D ELSE 0.005D END
      * (0.5D + 0.5D * greatest(coalesce(r1.r2, 0.0D), coalesce(r2.r2, 0.0D))) AS w
    FROM candidates c JOIN linked la ON c.id = la.id AND c.na = la.node_id JOIN linked lb ON c.id = lb.id AND c.nb = lb.node_id
    LEFT JOIN pair_fits r1 ON r1.listener_id = c.na AND r1.transmitter_id = c.nb LEFT JOIN pair_fits r2 ON r2.listener_id = c.nb AND r2.transmitter_id = c.na),
  backed AS (SELECT c.id, c.na, c.nb, c.s, c.x, c.y, c.w, coalesce(sum(CASE WHEN abs({R2.replace("p.", "c.")} - f.d) < 0.15D * f.d
      THEN CASE WHEN l.near = 1 THEN 1.0D ELSE 0.3D END * (1.0D - abs({R2.replace("p.", "c.")} - f.d) / (0.15D * f.d)) END), 0.0D) AS cons
    FROM weighed c LEFT JOIN fx f ON c.id = f.id AND f.node_id <> c.na AND f.node_id <> c.nb LEFT JOIN linked l ON f.id = l.id AND f.node_id = l.node_id
    GROUP BY c.id, c.na, c.nb, c.s, c.x, c.y, c.w),
  middle2 AS (SELECT id, sum(w * (1.0D + cons) * x) / sum(w * (1.0D + cons)) AS x, sum(w * (1.0D + cons) * y) / sum(w * (1.0D + cons)) AS y FROM backed GROUP BY id),
  agreed AS (SELECT f.id, max(f.m) AS m, coalesce(sum(CASE WHEN l.near = 1 AND abs({R2} - f.d) < 1.5D THEN 1.0D ELSE 0.0D END) / nullif(sum(l.near), 0), 0.0D) AS agree
    FROM fx f JOIN middle2 p ON f.id = p.id JOIN linked l ON f.id = l.id AND f.node_id = l.node_id GROUP BY f.id),
  room_aware AS (SELECT b.id, coalesce(c.x, b.x) AS x, coalesce(c.y, b.y) AS y, b.z, CASE WHEN c.id IS NULL THEN 0.3D ELSE least(0.6D * a.agree + 0.4D * least(1.0D, a.m / 6.0D), 1.0D) END AS confidence, b.m AS fixes, v.room_id
    FROM plain b LEFT JOIN middle2 c ON b.id = c.id LEFT JOIN agreed a ON b.id = a.id LEFT JOIN vote v ON b.id = v.id WHERE b.m >= 2)"""

#: Of at least three fixes; without crossings, or with fewer fixes, the centroid.
INTERSECTION = "{place_crossing}"
PLACES["crossing"] = f"""{PLACES["nadaraya"]}, {PLAIN}, {CROSSINGS},
  scored AS (SELECT c.id, c.na, c.nb, c.s, c.x, c.y, sum(greatest(0.0D, 1.0D - abs({R2.replace("p.", "c.")} - f.d) / 1.5D)) AS score FROM candidates c JOIN fx f ON c.id = f.id WHERE f.m >= 3 GROUP BY c.id, c.na, c.nb, c.s, c.x, c.y),
  best AS (SELECT id, sum(score * x) / sum(score) AS x, sum(score * y) / sum(score) AS y FROM (SELECT *, max(score) OVER (PARTITION BY id) AS top FROM scored) a WHERE score >= 0.7D * top - 1e-9 GROUP BY id HAVING sum(score) > 0),
  crossing AS (SELECT p.id, p.x, p.y, max(q.z) AS z, 0.7D * avg(CASE WHEN abs({R2} - f.d) <= 1.5D THEN 1.0D ELSE 0.0D END) + 0.3D * least(1.0D, max(f.m) / 6.0D) AS confidence, max(f.m) AS fixes FROM best p JOIN fx f ON p.id = f.id JOIN plain q ON p.id = q.id GROUP BY p.id, p.x, p.y
    UNION ALL SELECT n.id, n.x, n.y, n.z, n.confidence, n.fixes FROM nadaraya n LEFT JOIN best b ON n.id = b.id WHERE b.id IS NULL)"""

OUTLIERS = f"""residuals AS (SELECT f.id, f.node_id, f.i, f.m, abs(f.d - {R3}) AS r FROM fx f JOIN s4 p ON f.id = p.id),
  centre AS (SELECT r.id, c.med, median(abs(r.r - c.med)) AS mad FROM residuals r JOIN (SELECT id, median(r) AS med FROM residuals GROUP BY id) c ON r.id = c.id GROUP BY r.id, c.med),
  flagged AS (SELECT r.id, r.node_id, r.r, CASE WHEN r.m >= 5 AND 1.4826D * c.mad >= 1e-6 AND r.r > greatest(1.0D, c.med + 3.0D * 1.4826D * c.mad)
      AND row_number() OVER (PARTITION BY r.id ORDER BY r.r DESC, r.i) <= least(CAST(floor(0.3D * r.m) AS BIGINT), r.m - 3) THEN 1 ELSE 0 END AS rejected FROM residuals r JOIN centre c ON r.id = c.id)"""

#: The centroid solved again without the outliers of the first solution.
WRAPPED = "{place_nadaraya_kept}"
PLACES["nadaraya_kept"] = f"""{IDW}, {OUTLIERS}, fx_kept AS (SELECT f.id, f.node_id, f.x, f.y, f.z, f.d, f.room_id, f.i, count(*) OVER (PARTITION BY f.id) AS m FROM fx f JOIN flagged g ON f.id = g.id AND f.node_id = g.node_id WHERE g.rejected = 0),
  {IDW_KEPT}, {kept(CENTRE)}"""
BOTH = f"WITH {FIXES}, {ROOM_AWARE}, {NEAREST}, {WRAPPED}, alternatives AS (SELECT id, 'nearest_node' AS algorithm, x, y FROM nearest UNION ALL SELECT id, 'nadaraya_watson', x, y FROM nadaraya_kept), "
APART = """apart AS (SELECT a.id, t.algorithm, sqrt((a.x - t.x) * (a.x - t.x) + (a.y - t.y) * (a.y - t.y)) AS delta, CASE WHEN (a.x >= 0 AND a.x <= 12 AND a.y >= 0 AND a.y <= 10) <> (t.x >= 0 AND t.x <= 12 AND t.y >= 0 AND t.y <= 10) THEN 1 ELSE 0 END AS in_out
    FROM room_aware a JOIN alternatives t ON a.id = t.id)"""
PLACES["room_aware"] = ROOM_AWARE_CHAIN
ROUND = "round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z, round(confidence, 4) AS confidence, fixes"

QUERIES: dict[str, str] = {
    "l01_nadaraya_watson": f"WITH {FIXES}, {NADARAYA} SELECT id AS device_id, {ROUND} FROM nadaraya",
    "l02_nearest_node": f"WITH {FIXES}, {NEAREST} SELECT id AS device_id, x, y, z, confidence, fixes FROM nearest",
    "l09_room_aware": f"WITH {FIXES}, {ROOM_AWARE} SELECT id AS device_id, {ROUND}, room_id FROM room_aware",
    "l13_intersection": f"WITH {FIXES}, {INTERSECTION} SELECT id AS device_id, {ROUND} FROM crossing",
    "a10_room_vote": f"WITH {FIXES}, {VOTE} SELECT id AS device_id, room_id FROM vote",
    "a14_outliers": f"WITH {FIXES}, {IDW}, {OUTLIERS} SELECT id AS device_id, node_id, round(r, 4) AS residual, rejected = 1 AS rejected FROM flagged",
    "l06_outlier_wrapped_idw": f"WITH {FIXES}, {WRAPPED} SELECT id AS device_id, {ROUND} FROM nadaraya_kept",
    "u08_rejected_flags": f"WITH {FIXES}, {IDW}, {OUTLIERS} SELECT id AS device_id, CAST(sum(rejected) AS BIGINT) AS dropped, CAST(sum(1 - rejected) AS BIGINT) AS kept, round(max(r), 4) AS worst FROM flagged GROUP BY id",
    "a02_leave_one_out": f"WITH {LEFT_OUT}, {ROOM_AWARE} SELECT o.node_id, count(*) AS n, round(avg(o.d - sqrt((p.x - o.x) * (p.x - o.x) + (p.y - o.y) * (p.y - o.y) + (p.z - o.z) * (p.z - o.z))), 4) AS mean FROM room_aware p JOIN fixes o ON p.id = o.device_id || '/' || o.node_id GROUP BY o.node_id",
    "j04_fix_pairs": f"WITH {FIXES}, {CROSSINGS} SELECT id AS device_id, na, nb, round(g, 4) AS apart FROM meets",
    "j05_consensus": f"WITH {FIXES}, {ROOM_AWARE_CHAIN} SELECT id AS device_id, na, nb, s, round(cons, 4) AS consensus FROM backed",
    "a16_isotropy": f"""WITH {FIXES}, {IDW} SELECT id AS device_id, round(4.0D * (xx * yy - xy * xy) / ((xx + yy) * (xx + yy)), 4) AS isotropy FROM (SELECT f.id, sum(ux * ux) AS xx, sum(ux * uy) AS xy, sum(uy * uy) AS yy, count(*) AS k
        FROM (SELECT f.id, (f.x - p.x) / {R2} AS ux, (f.y - p.y) / {R2} AS uy FROM fx f JOIN s4 p ON f.id = p.id WHERE {R2} > 1e-3) f GROUP BY f.id) a WHERE k >= 2""",
    "a17_weighted_rmse": f"WITH {FIXES}, {IDW} SELECT f.id AS device_id, round(sqrt(sum((f.d - {R3}) * (f.d - {R3}) / (f.d * f.d + 1e-6)) / sum(1.0D / (f.d * f.d + 1e-6))), 4) AS rmse FROM fx f JOIN s4 p ON f.id = p.id GROUP BY f.id",
    "a04_compare": f"{BOTH} {APART} SELECT id AS device_id, algorithm, round(delta, 4) AS delta, in_out FROM apart",
    "a05_pooled": f"{BOTH} {APART} SELECT algorithm, count(*) AS n, round(avg(delta), 4) AS mean, round(stddev_pop(delta), 4) AS sigma, CAST(sum(in_out) AS BIGINT) AS in_out FROM apart GROUP BY algorithm",
    "a26_legend_means": f"{BOTH} {APART} SELECT algorithm, round(sum(delta) / count(*), 3) AS mean FROM apart GROUP BY algorithm",
    "a29_headline": f"{BOTH} {APART} SELECT max(CASE WHEN near = 1 THEN algorithm END) AS closest, max(CASE WHEN far = 1 THEN algorithm END) AS farthest FROM (SELECT algorithm, row_number() OVER (ORDER BY round(avg(delta), 9), algorithm) AS near, row_number() OVER (ORDER BY round(avg(delta), 9) DESC, algorithm) AS far FROM apart GROUP BY algorithm) z",
    "j18_alternatives": f"{BOTH} {APART} SELECT a.id AS device_id, a.algorithm, b.algorithm AS other, round(abs(a.delta - b.delta), 4) AS gap FROM apart a JOIN apart b ON a.id = b.id AND a.algorithm < b.algorithm",
    "l14_bundle": f"{BOTH} z AS (SELECT id, 'room_aware' AS algorithm, x, y FROM room_aware UNION ALL SELECT id, algorithm, x, y FROM alternatives) SELECT id AS device_id, algorithm, round(x, 4) AS x, round(y, 4) AS y FROM z",
    "p01_position_rows": f"WITH {FIXES}, {ROOM_AWARE} SELECT id AS device_id, {ROUND}, 'room_aware' AS algorithm, room_id IS NOT NULL AS room_reported FROM room_aware",
    "f14_positioned": f"WITH {FIXES}, {ROOM_AWARE} SELECT count(*) AS devices, count(CASE WHEN confidence >= 0.5D THEN 1 END) AS sure FROM room_aware",
    "a21_measurement_summary": f"WITH {FIXES}, {IDW}, {OUTLIERS} SELECT id AS device_id, CAST(sum(1 - rejected) AS BIGINT) AS kept, CAST(sum(rejected) AS BIGINT) AS dropped, round(max(CASE WHEN rejected = 0 THEN r END), 4) AS worst_kept FROM flagged GROUP BY id",
    "j12_measurements": f"WITH {FIXES}, {IDW}, {OUTLIERS} SELECT m.device_id, m.node_id, round(m.distance, 6) AS distance, round(g.r, 4) AS residual, coalesce(g.rejected = 1, false) AS rejected FROM fix_last m LEFT JOIN flagged g ON m.device_id = g.id AND m.node_id = g.node_id",
    "j09_path_exponents": f"""WITH {FIXES}, {PLAIN}, toward AS (SELECT f.id, f.node_id, f.x, f.y, p.x - f.x AS dx, p.y - f.y AS dy, {R2} AS far FROM fx f JOIN plain p ON f.id = p.id),
        alike AS (SELECT t.id, t.node_id, q.n, q.r2, t.far, sqrt((b.x - t.x) * (b.x - t.x) + (b.y - t.y) * (b.y - t.y)) AS path, (b.x - t.x) * t.dx + (b.y - t.y) * t.dy AS dot FROM toward t JOIN pair_fits q ON t.node_id = q.listener_id JOIN nodes b ON q.transmitter_id = b.node_id WHERE t.far >= 1e-6 AND q.r2 >= 0.25D AND q.n > 0),
        weighed AS (SELECT id, node_id, n, r2 * exp(-abs(path - far) / 3.0D) * (dot / (path * far)) * (dot / (path * far)) AS w FROM alike WHERE path >= 1e-6 AND dot > 0)
        SELECT id AS device_id, node_id, round(sum(n * w) / sum(w), 4) AS n, round(least(1.0D, sum(w)), 4) AS certainty FROM weighed GROUP BY id, node_id HAVING sum(w) > 1e-9""",
    "w15_pin_lock": f"""WITH {FIXES}, {ROOM_AWARE}, active AS (SELECT device_id, x, y, z FROM (SELECT p.*, row_number() OVER (PARTITION BY p.device_id ORDER BY pin_ts DESC) AS k FROM pins p) a WHERE k = 1 AND pin_ts % 3 = 0)
        SELECT r.id AS device_id, round(coalesce(a.x, r.x), 4) AS x, round(coalesce(a.y, r.y), 4) AS y, round(coalesce(a.z, r.z), 4) AS z, round(CASE WHEN a.device_id IS NULL THEN r.confidence ELSE 1.0D END, 4) AS confidence, a.device_id IS NOT NULL AS pinned, round(r.x, 4) AS raw_x, round(r.y, 4) AS raw_y FROM room_aware r LEFT JOIN active a ON r.id = a.device_id""",
}
