"""Locators against plain scalar versions, one device and one fix at a time."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest

from rangefield.functions.dialect import spark_sql
from rangefield.operators import solvers
from rangefield.plans import catalog, relations
from rangefield.plans.relations import with_

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def scene(spark):
    """Fixes by device, trusted room pairs, path fits (listener, transmitter) -> (n, r2), node places, exponents in force."""
    ask = lambda sql: spark_sql(with_(sql))(spark, SMALL).collect()
    fixes = defaultdict(list)
    for r in ask("SELECT * FROM fixes ORDER BY device_id, i"):
        fixes[r.device_id].append(r)
    trust = {(r.a, r.b) for r in ask("SELECT a, b FROM trust2")}
    fits = {(r.listener_id, r.transmitter_id): (r.n, r.r2) for r in ask("SELECT * FROM pair_fits")}
    nodes = {r.node_id: (r.x, r.y) for r in ask("SELECT * FROM nodes")}
    last = {}
    for r in ask("SELECT * FROM absorptions ORDER BY t_ms, seq"):
        last[r.node_id] = r.absorption
    return fixes, trust, fits, nodes, last


def weighted(points, weights):
    total = sum(weights)
    return tuple(sum(w * p[k] for w, p in zip(weights, points, strict=True)) / total for k in range(len(points[0])))


def plain(own):
    return weighted([(f.x, f.y, f.z) for f in own], [1 / (f.d**2 + 1e-6) for f in own])


def crossings(own):
    """(index of both fixes, point) of all crossing circles."""
    for i, a in enumerate(own):
        for j in range(i + 1, len(own)):
            b = own[j]
            gap = complex(b.x - a.x, b.y - a.y)
            if abs(gap) < 1e-6 or not abs(a.d - b.d) <= abs(gap) <= a.d + b.d:
                continue
            cosine = (a.d**2 + abs(gap) ** 2 - b.d**2) / (2 * a.d * abs(gap))
            turn = math.acos(max(-1, min(1, cosine)))
            for way in (turn, -turn):
                p = complex(a.x, a.y) + gap / abs(gap) * a.d * complex(math.cos(way), math.sin(way))
                yield i, j, p


def centre(own, trips=4):
    """The reweighted centroid with its confidence."""
    if len(own) < 3:
        two = sorted(own, key=lambda f: f.d)
        a, b = two[0], two[min(1, len(two) - 1)]
        return tuple((u + v) / 2 for u, v in ((a.x, b.x), (a.y, b.y), (a.z, b.z))), 0.2
    points, trusts = [(f.x, f.y, f.z) for f in own], [1.0] * len(own)
    for turn in range(trips + 1):
        weights = [t / (f.d**2 + 1e-6) for t, f in zip(trusts, own, strict=True)]
        at = weighted(points, weights)
        over = [f.d - math.dist(at, p) for f, p in zip(own, points, strict=True)]
        if turn < trips:
            trusts = [t / (1 + (max(o, 0) / 1.5) ** 2) for t, o in zip(trusts, over, strict=True)]
    rmse = math.sqrt(sum(w * o * o for w, o in zip(weights, over, strict=True)) / sum(weights))
    return at, 0.7 / (1 + rmse / 2) + 0.3 * min(1, len(own) / 6)


def good_fixes(own, at):
    """What the median rule leaves."""
    if len(own) < 5:
        return own
    off = [abs(math.dist(at, (f.x, f.y, f.z)) - f.d) for f in own]
    middle = float(np.median(off))
    spread = 1.4826 * float(np.median([abs(o - middle) for o in off]))
    if spread < 1e-6:
        return own
    limit, room = max(1.0, middle + 3 * spread), min(int(0.3 * len(own)), len(own) - 3)
    bad = set(sorted((i for i, o in enumerate(off) if o > limit), key=lambda i: -off[i])[:room])
    return [f for i, f in enumerate(own) if i not in bad]


def test_room_aware(spark, scene):
    fixes, trust, fits, _, _ = scene
    got = {r.device_id: r for r in catalog.queries()["l09_room_aware"](spark, SMALL).collect()}
    assert set(got) == {d for d, own in fixes.items() if len(own) >= 2}
    for device, row in got.items():
        own = fixes[device]
        votes = defaultdict(float)
        for f in sorted(own, key=lambda f: f.d)[:3]:
            votes[f.room_id] += 1 / (f.d**2 + 1e-6)
        home = max(votes, key=votes.get)
        near = [f.room_id == home or (home, f.room_id) in trust for f in own]
        points, scores = [], []
        for i, j, p in crossings(own):
            a, b = own[i], own[j]
            rooms = 0.005 if not (near[i] or near[j]) else 0.3 if near[i] != near[j] else 1.0 if a.room_id == b.room_id == home else 0.8
            cosine = (a.d**2 + b.d**2 - (a.x - b.x) ** 2 - (a.y - b.y) ** 2) / (2 * a.d * b.d)
            r2 = max(fits.get((a.node_id, b.node_id), (0, 0))[1], fits.get((b.node_id, a.node_id), (0, 0))[1])
            agree = sum((1.0 if near[k] else 0.3) * max(0.0, 1 - abs(abs(p - complex(f.x, f.y)) - f.d) / (0.15 * f.d)) for k, f in enumerate(own) if k not in (i, j))
            points.append((p.real, p.imag))
            scores.append(max(0.01, 1 - cosine**2) / (a.d * b.d) * rooms * (0.5 + 0.5 * r2) * (1 + agree))
        x, y, z = plain(own)
        confidence = 0.3
        if points:
            x, y = weighted(points, scores)
            hits = [abs(math.dist((x, y), (f.x, f.y)) - f.d) < 1.5 for f, ok in zip(own, near, strict=True) if ok]
            confidence = 0.6 * sum(hits) / max(1, len(hits)) + 0.4 * min(1, len(own) / 6)
        assert row.room_id == home and row.fixes == len(own)
        assert np.allclose((row.x, row.y, row.z, row.confidence), (x, y, z, confidence), atol=2e-4)


def test_intersection(spark, scene):
    fixes = scene[0]
    got = {r.device_id: r for r in catalog.queries()["l13_intersection"](spark, SMALL).collect()}
    assert set(got) == set(fixes)
    for device, row in got.items():
        own = fixes[device]
        points = [p for _, _, p in crossings(own)] if len(own) >= 3 else []
        if not points:
            at, confidence = centre(own)
        else:
            score = [sum(max(0.0, 1 - abs(abs(p - complex(f.x, f.y)) - f.d) / 1.5) for f in own) for p in points]
            top = [(p, s) for p, s in zip(points, score, strict=True) if s >= 0.7 * max(score) - 1e-9]
            x, y = weighted([(p.real, p.imag) for p, _ in top], [s for _, s in top])
            at = (x, y, plain(own)[2])
            confidence = 0.7 * np.mean([abs(math.dist((x, y), (f.x, f.y)) - f.d) <= 1.5 for f in own]) + 0.3 * min(1, len(own) / 6)
        assert np.allclose((row.x, row.y, row.z, row.confidence), (*at, confidence), atol=2e-4)


def test_wrapped_centroid(spark, scene):
    got = {r.device_id: r for r in catalog.queries()["l06_outlier_wrapped_idw"](spark, SMALL).collect()}
    also = {r.device_id: r for r in solvers.located(solvers.problems(spark, SMALL), ("nadaraya_watson",)).collect()}
    changed = 0
    for device, own in scene[0].items():
        first, _ = centre(own)
        kept = good_fixes(own, first)
        changed += len(kept) < len(own)
        at, confidence = centre(kept)
        for row in (got[device], also[device]):
            assert row.fixes == len(kept) and np.allclose((row.x, row.y, row.z, row.confidence), (*at, confidence), atol=2e-4)
    assert changed


LOSSES = {
    "l03_nelder_mead": lambda r, d: (0.5 * r * r if abs(r) <= 1.5 else 1.5 * (abs(r) - 0.75)) / (d * d + 1e-6),
    "l04_bfgs": lambda r, d: r * r / (1 + (max(-r, 0) / 1.5) ** 2) / (d * d + 1e-6),
    "l05_mle": lambda r, d: r * r / (d + 1e-6),
}


@pytest.mark.parametrize("name", LOSSES)
def test_optimisers_reach_a_minimum(spark, scene, name):
    """The place is no worse than the seed and, but for the optimiser's own tolerance, than any point around it."""
    loss = LOSSES[name]
    for row in catalog.queries()[name](spark, SMALL).collect():
        own = scene[0][row.device_id]
        total = lambda x, y, own=own: sum(loss(math.dist((x, y), (f.x, f.y)) - f.d, f.d) for f in own)
        if row.fixes < len(own) or len(own) < 3:
            continue  # solved without outliers
        here, seed = total(row.x, row.y), total(*centre(own)[0][:2])
        assert here <= seed + 1e-9
        if name != "l04_bfgs":  # whose direction leaves out how the penalty itself changes
            around = min(total(row.x + 0.05 * math.cos(k), row.y + 0.05 * math.sin(k)) for k in range(7))
            assert here <= around + 1e-6
        rms = math.sqrt(np.mean([(math.dist((row.x, row.y), (f.x, f.y)) - f.d) ** 2 for f in own]))
        assert abs(row.confidence - (0.7 / (1 + rms / 1.5) + 0.3 * min(1, len(own) / 6))) < 1e-9


def exponent(f, at, fits, nodes, own_n):
    """The exponent of the listener's paths that resemble the one to `at`; None if there is none."""
    length = math.dist((f.x, f.y), at[:2])
    total = mean = 0.0
    for (listener, other), (n, r2) in fits.items():
        if listener != f.node_id or r2 < 0.25 or length < 1e-6:
            continue
        path = math.dist((f.x, f.y), nodes[other])
        cosine = ((nodes[other][0] - f.x) * (at[0] - f.x) + (nodes[other][1] - f.y) * (at[1] - f.y)) / (path * length)
        if cosine > 0:
            w = cosine**2 * math.exp(-abs(path - length) / 3) * r2
            total, mean = total + w, mean + w * n
    return None if total <= 1e-9 else own_n + min(1, total) * (mean / total - own_n)


class Moved:
    """A fix with another distance."""

    def __init__(self, f, d):
        self.node_id, self.x, self.y, self.z, self.d = f.node_id, f.x, f.y, f.z, d


def test_path_aware(spark, scene):
    fixes, _, fits, nodes, last = scene

    def fixed(own, at):
        out = []
        for f in own:
            n = last.get(f.node_id, 2.7)
            e = exponent(f, at, fits, nodes, n)
            out.append(Moved(f, f.d if e is None else f.d ** (n / e)))
        return out

    def solve(own):
        at, before = centre(own)[0], math.inf
        for turn in range(4):
            new = centre(fixed(own, at))[0]
            moved = math.dist(at[:2], new[:2])
            at = new
            if moved < 0.05 and not (turn and moved >= before) or turn and moved >= before:
                break
            before = moved
        return at

    got = {r.device_id: r for r in catalog.queries()["l07_path_aware"](spark, SMALL).collect()}
    rows = defaultdict(dict)
    for r in catalog.queries()["l16_path_diagnostics"](spark, SMALL).collect():
        rows[r.device_id][r.node_id] = r
    for device, own in fixes.items():
        first = solve(own)
        kept = good_fixes(own, first)
        at = first if len(kept) == len(own) else solve(kept)
        assert np.allclose((got[device].x, got[device].y, got[device].z), at, atol=1e-6)
        final = fixed(own, at)
        stay = {f.node_id for f in good_fixes(final, at)}
        assert set(rows[device]) == {f.node_id for f in own}
        for f, c in zip(own, final, strict=True):
            r = rows[device][f.node_id]
            assert np.allclose((r.raw, r.corrected, r.expected), (f.d, c.d, math.dist(at, (f.x, f.y, f.z))), atol=1e-6) and r.rejected == (f.node_id not in stay)


def test_environment_aware_improves_its_own_loss(spark, scene):
    fixes, _, fits, nodes, last = scene

    def loss(own, at):
        total = 0.0
        for f in own:
            n = last.get(f.node_id, 2.7)
            e = exponent(f, at, fits, nodes, n) or n
            r = f.d - math.dist((f.x, f.y), at[:2]) ** (e / n)
            total += r * r / (1 + (max(r, 0) / 1.5) ** 2) / (f.d**2 + 1e-6)
        return total

    better = [loss(fixes[r.device_id], (r.x, r.y)) <= loss(fixes[r.device_id], centre(fixes[r.device_id])[0]) + 1e-6 for r in catalog.queries()["l08_environment_aware"](spark, SMALL).collect()]
    assert np.mean(better) >= 0.8  # the exponents change with the place, so single devices may end a little worse


def test_room_middle_of_a_concave_room(spark, monkeypatch):
    corners = [(0, 0), (6, 0), (6, 1), (1, 1), (1, 6), (0, 6)]
    rows = ", ".join(f"(0, 'ell', {v}, {x}.0D, {y}.0D)" for v, (x, y) in enumerate(corners))
    monkeypatch.setitem(relations.RELATIONS, "vertices", f"SELECT * FROM (VALUES {rows}) AS v(ord, room_id, v, x, y)")
    monkeypatch.setitem(relations.RELATIONS, "edges", relations.RELATIONS["edges"].replace("% 4", "% 6"))
    row = spark_sql(with_("SELECT * FROM anchors"))(spark, SMALL).first()
    assert (row.x, row.y) == (sum(x for x, _ in corners) / 6, sum(y for _, y in corners) / 6)


def test_rate_limit_counts_from_the_last_push(spark, monkeypatch):
    monkeypatch.setitem(relations.RELATIONS, "settings", "SELECT * FROM (VALUES ('a', 0, 1), ('a', 6000, 2), ('a', 12000, 3), ('a', 21000, 4), ('a', 22000, 5), ('b', 5, 6)) AS s(node_id, t_ms, seq)")
    from rangefield.operators import folds

    got = spark_sql(with_(folds._LIMIT))(spark, SMALL).collect()
    assert sorted(r.seq for r in got) == [1, 3, 5, 6]


def test_snapshot_sizes(spark):
    got = {(r.device_id, r.seq): r.fixes for r in catalog.queries()["j20_snapshot_sizes"](spark, SMALL).collect()}
    by_device = defaultdict(list)
    for r in spark_sql(with_("SELECT device_id, node_id, t_ms, seq FROM obs"))(spark, SMALL).collect():
        by_device[r.device_id].append((r.t_ms, r.seq, r.node_id))
    want = {}
    for device, own in by_device.items():
        for t, seq, _ in own:
            want[device, seq] = len({n for u, s, n in own if t - 30000 <= u and (u, s) <= (t, seq)})
    assert got == want


def test_wall_losses_of_the_radio_locators(spark):
    """The losses between nodes by the array code against those by joins; and places that stay in reach of the house."""
    rows = solvers.problems(spark, SMALL).limit(1).toArrow().combine_chunks().to_batches()[0]
    house = solvers.House({c: rows.column(c)[0].as_py() for c in ("walls", "rooms", "trust")})
    nodes = {r.node_id: (r.x, r.y) for r in spark_sql(with_("SELECT * FROM nodes"))(spark, SMALL).collect()}
    pairs = spark_sql(with_("SELECT a, b, loss_db FROM wall_loss"))(spark, SMALL).collect()
    a, b = (np.array([nodes[r[k]] for r in pairs]) for k in (0, 1))
    got = house.loss(a[:, 0], a[:, 1], a[:, 0], a[:, 1], b[:, 0], b[:, 1])
    assert len(pairs) == 66 and np.allclose(got, [r.loss_db for r in pairs])
    for name in ("l10_rf_physics", "l11_rf_room_aware"):
        places = catalog.queries()[name](spark, SMALL).collect()
        assert len(places) == 15 and all(-6 < r.x < 18 and -6 < r.y < 16 and 0 <= r.confidence <= 1 for r in places)


def test_all_alternatives_against_the_active_place(spark):
    """Distances and rooms of every alternative, from the places that the queries of the locators give."""
    active = {r.device_id: r for r in catalog.queries()["l09_room_aware"](spark, SMALL).collect()}
    places = defaultdict(dict)
    for r in catalog.queries()["l14_solver_bundle"](spark, SMALL).collect():
        places[r.algorithm][r.device_id] = (r.x, r.y)
    places["nearest_node"] = {r.device_id: (r.x, r.y) for r in catalog.queries()["l02_nearest_node"](spark, SMALL).collect()}
    rooms = {r.room_id: (r.x0, r.y0, r.x1, r.y1) for r in spark_sql(with_("SELECT * FROM rooms"))(spark, SMALL).collect()}
    where = lambda x, y: next((k for k, (x0, y0, x1, y1) in rooms.items() if x0 < x < x1 and y0 < y < y1), None)
    got = catalog.queries()["a04_all_locators"](spark, SMALL).collect()
    assert {(r.algorithm, r.device_id) for r in got} == {(a, d) for a, own in places.items() for d in own if d in active} and len(places) == 9
    for r in got:
        (x, y), own = places[r.algorithm][r.device_id], active[r.device_id]
        assert abs(r.delta - math.hypot(x - own.x, y - own.y)) < 1e-3
        assert r.room_off == (where(x, y) != where(own.x, own.y)) and r.in_out == ((where(x, y) is None) != (where(own.x, own.y) is None))
    pooled = {r.algorithm: r for r in catalog.queries()["a05_all_locators"](spark, SMALL).collect()}
    for name, row in pooled.items():
        own = [r for r in got if r.algorithm == name]
        assert row.n == len(own) and abs(row["mean"] - np.mean([r.delta for r in own])) < 1e-5 and abs(row.room_rate - np.mean([r.room_off for r in own])) < 1e-5
        assert abs(row.sigma - np.std([r.delta for r in own])) < 1e-5 and abs(row.in_out_rate - np.mean([r.in_out for r in own])) < 1e-5
