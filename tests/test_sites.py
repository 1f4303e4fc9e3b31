"""Walls, openings and crossings of many houses against a plain scalar builder, and outlines of groups."""

from __future__ import annotations

import math
from collections import defaultdict

import pytest

from rangefield.functions.dialect import spark_sql
from rangefield.plans import catalog
from rangefield.plans.relations import with_

SMALL = "/root/testdata/sf0.001"


def inside(x, y, corners):
    out = False
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            out = not out
    return out


@pytest.fixture(scope="module")
def houses(spark):
    """By site: rooms (id -> corners, in order), tags, doors, nodes."""
    ask = lambda sql: spark_sql(with_(sql))(spark, SMALL).collect()
    sites: dict = defaultdict(lambda: {"rooms": defaultdict(list), "tag": {}, "doors": [], "nodes": {}})
    for r in ask("SELECT * FROM h_vertices ORDER BY site, ord, v"):
        sites[r.site]["rooms"][r.room_id].append((r.x, r.y))
    for r in ask("SELECT site, room_id, floor_area FROM h_rooms"):
        sites[r.site]["tag"][r.room_id] = r.floor_area
    for r in ask("SELECT * FROM h_open"):
        sites[r.site]["doors"].append((r.door_x, r.door_y, r.width))
    for r in ask("SELECT n.*, m.x AS mx, m.y AS my FROM h_node_rooms n LEFT JOIN h_anchors m ON n.site = m.site AND n.room_id = m.room_id WHERE enabled"):
        sites[r.site]["nodes"][r.node_id] = ((r.x, r.y), (r.mx, r.my), r.level)
    return sites


def close_to(p, a, b):
    ux, uy = b[0] - a[0], b[1] - a[1]
    t = max(0.0, min(1.0, ((p[0] - a[0]) * ux + (p[1] - a[1]) * uy) / (ux * ux + uy * uy)))
    return math.dist(p, (a[0] + t * ux, a[1] + t * uy)), t


def build(house):
    """[(a, b, exterior, openings)] in the order of rooms and edges."""
    every = [p for c in house["rooms"].values() for p in c]
    pieces = []
    for corners in house["rooms"].values():
        for a, b in zip(corners, corners[1:] + corners[:1], strict=True):
            length = math.dist(a, b)
            cuts = [0.0]
            for t in sorted(((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / length**2 for p in every if abs((p[0] - a[0]) * (b[1] - a[1]) - (p[1] - a[1]) * (b[0] - a[0])) <= 0.05 * length):
                if 0.02 < t < 0.98 and t - cuts[-1] > 0.02:
                    cuts.append(t)
            cuts.append(1.0)
            at = [(a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])) for t in cuts]
            pieces += list(zip(at, at[1:], strict=False))
    once = []
    same = lambda p, q: abs(p[0] - q[0]) < 0.05 and abs(p[1] - q[1]) < 0.05
    for a, b in pieces:
        if not any((same(a, c) and same(b, d)) or (same(a, d) and same(b, c)) for c, d in once):
            once.append((a, b))
    walls = []
    for a, b in once:
        length = math.dist(a, b)
        nx, ny = -(b[1] - a[1]) / length * 0.15, (b[0] - a[0]) / length * 0.15
        mx, my = (a[0] + b[0]) / 2, (a[1] + b[1]) / 2
        sides = [next((r for r, c in house["rooms"].items() if inside(mx + s * nx, my + s * ny, c)), None) for s in (1, -1)]
        tags = [house["tag"].get(s) for s in sides]
        if not (tags[0] and tags[0] == tags[1]):
            walls.append([a, b, None in sides, []])
    for x, y, width in house["doors"]:
        wall = min(walls, key=lambda w: round(close_to((x, y), w[0], w[1])[0], 9))
        t, half = close_to((x, y), wall[0], wall[1])[1], width / (2 * math.dist(wall[0], wall[1]))
        wall[3].append((max(0.0, t - half), min(1.0, t + half)))
    for w in walls:
        merged: list = []
        for lo, hi in sorted(w[3]):
            if merged and lo <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi])
        w[3] = merged
    return walls


def count(walls, p, q, middle):
    hits = []
    for a, b, exterior, opens in walls:
        turn = lambda s, a=a, b=b: (b[0] - a[0]) * (s[1] - a[1]) - (b[1] - a[1]) * (s[0] - a[0])
        if close_to(p, a, b)[0] < 0.1 and (middle[0] is None or turn(middle) * turn(q) >= 0):
            continue
        den = (q[0] - p[0]) * (b[1] - a[1]) - (q[1] - p[1]) * (b[0] - a[0])
        if abs(den) < 1e-12:
            continue
        t = ((a[0] - p[0]) * (b[1] - a[1]) - (a[1] - p[1]) * (b[0] - a[0])) / den
        u = ((a[0] - p[0]) * (q[1] - p[1]) - (a[1] - p[1]) * (q[0] - p[0])) / den
        if 0 <= t <= 1 and 0 <= u <= 1:
            hits.append((t, 2 if any(lo <= u <= hi for lo, hi in opens) else int(exterior)))
    out, start, worst = [0, 0, 0], None, None
    for t, kind in sorted(hits):
        if start is not None and t - start < 0.005:
            worst = max(worst, kind)
            continue
        if start is not None:
            out[worst] += 1
        start, worst = t, kind
    if start is not None:
        out[worst] += 1
    return tuple(out)


def test_walls_openings_and_crossings(spark, houses):
    ask = lambda name: catalog.queries()[name](spark, SMALL).collect()
    got, opened, crossed = defaultdict(dict), defaultdict(list), {(r.site, r.a, r.b): (r.interior, r.exterior, r.doors) for r in ask("g09_crossings")}
    for r in ask("g07_walls"):
        got[r.site][r.wall] = r
    for r in ask("g07_openings"):
        opened[r.site, r.wall].append((r.t0, r.t1))
    kinds = set()
    for site, house in houses.items():
        walls = build(house)
        key = lambda a, b: tuple(round(v, 4) + 0.0 for v in (*a, *b))
        want = {key(a, b): (out, [tuple(round(round(v, 6), 5) for v in o) for o in opens]) for a, b, out, opens in walls}
        have = {key((r.ax, r.ay), (r.bx, r.b_y)): (r.exterior, [tuple(round(v, 5) for v in o) for o in sorted(opened[site, r.wall])]) for r in got[site].values()}
        assert have == want, site
        for a, (p, middle, level) in house["nodes"].items():
            for b, (q, _, other) in house["nodes"].items():
                if a != b and level == other:
                    assert crossed.pop((site, a, b)) == count(walls, p, q, middle), (site, a, b)
        kinds |= {bool(w[2]) for w in walls} | {f"{len(w[3])} openings" for w in walls}
    assert not crossed and {True, False, "0 openings", "1 openings"} <= kinds


def test_rooms_split_walls_at_t_junctions(spark, houses):
    """The L of plan 1 ends up with more walls than edges, as other rooms' corners lie on them."""
    site = next(s for s, h in houses.items() if "ell" in h["rooms"])
    assert len(build(houses[site])) > 10
    assert {h for h in (r.hops for r in catalog.queries()["g17_hops"](spark, SMALL).collect())} >= {0, 1, 2, 3}


def test_outlines_of_groups(spark, houses):
    """Every outline is closed and turns at right angles; walked in order it holds as much as the cells within a tenth of a metre of the group."""
    got = defaultdict(lambda: defaultdict(list))
    for r in catalog.queries()["g13_outlines"](spark, SMALL).orderBy("site", "floor_area", "part", "corner").collect():
        got[r.site, r.floor_area][r.part].append((r.x, r.y))
    want = {(s, t) for s, h in houses.items() for t in h["tag"].values() if t}
    assert set(got) == want
    for (site, tag), parts in got.items():
        rooms = [c for r, c in houses[site]["rooms"].items() if houses[site]["tag"][r] == tag]
        area = 0.0
        for line in parts.values():
            for a, b in zip(line, line[1:] + line[:1], strict=True):
                assert (abs(a[0] - b[0]) < 1e-6) != (abs(a[1] - b[1]) < 1e-6)
                area += (a[0] * b[1] - b[0] * a[1]) / 2
        x0, y0 = min(p[0] for c in rooms for p in c) - 0.2, min(p[1] for c in rooms for p in c) - 0.2
        x1, y1 = max(p[0] for c in rooms for p in c), max(p[1] for c in rooms for p in c)
        cols, rows = math.ceil((x1 + 0.2 - x0) / 0.1) + 1, math.ceil((y1 + 0.2 - y0) / 0.1) + 1
        full = {(r, c) for r in range(rows) for c in range(cols) if any(inside(x0 + (c + 0.5) * 0.1, y0 + (r + 0.5) * 0.1, k) for k in rooms)}
        grown = {(r + i, c + j) for r, c in full for i in (-1, 0, 1) for j in (-1, 0, 1)}
        assert abs(abs(area) - len(grown) * 0.01) < 1e-4, (site, tag)


def test_outlines_with_a_hole_and_two_parts():
    import numpy as np

    from rangefield.operators import outlines

    grid = np.zeros((12, 20), bool)
    grid[2:9, 2:9] = True
    grid[4:6, 4:7] = False
    grid[3:5, 12:18] = True
    found = outlines.borders(grid)
    areas = sorted(float(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, np.roll(p, -1, 0), strict=True)) / 2) for p in found)
    assert [abs(a) for a in sorted(areas, key=abs)] == [6, 12, 49] and abs(sum(areas)) == 55  # a hole runs the other way round
