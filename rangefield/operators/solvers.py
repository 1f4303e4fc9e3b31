"""Iterative locators, solved for all devices of an Arrow batch at once.

Spark gathers each device's fixes (and what is known of every listener's paths)
into one row, as there are only as many fixes as nodes; `mapInArrow` then runs
the optimisers on padded matrices, a row per device, so no Python code runs per
device.  Rows of a batch that have converged are left out of further steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.house import house_sql

#: Distance floor, width of the penalty on distances measured too long, its turns, widths of the Huber losses.
FLOOR, SHADOW, TURNS, HUBER = 1e-6, 1.5, 4, 1.5
#: Outliers: least number of fixes, fixes that stay, share that may go, least residual, spread factor times 3.
LEAST, STAY, SHARE, RESIDUAL, SPREAD = 5, 3, 0.3, 1.0, 3 * 1.4826
#: Paths: least fit quality, distance scale, evidence that counts as certain, turns, movement that ends them.
QUALITY, LIKE, CERTAIN, CORRECTIONS, STILL = 0.25, 3.0, 1.0, 4, 0.05

#: Radio: loss of an inner wall, an outer wall and a door in decibels, what weighs as one e-fold, reference and exponent, widths.
WALL_DB, EXTERIOR_DB, DOOR_DB, FOLD_DB, REFERENCE, EXPONENT, HUBER_DB = 4.0, 10.0, 0.0, 4.0, -59.0, 3.0, 8.0
#: Exponent of a node that was never set, for the radio locator.
UNSET = 4.0
#: How close to a wall a node counts as mounted on it, and how close along a path crossings count as one.
MOUNTED, MERGED = 0.1, 0.005
#: Share of a distance within which a circle passes a point; bonus of the closest node's room and of those next to it, up to what distance.
AGREE, SAME_ROOM, NEXT_ROOM, ROOM_REACH = 0.15, 2.0, 1.4, 6.0

PROBLEMS = """WITH heard AS (SELECT p.listener_id, collect_list(struct(n.x AS x, n.y AS y, p.n AS n, p.r2 AS r2, p.transmitter_id AS other)) AS fits
    FROM pair_fits p JOIN nodes n ON p.transmitter_id = n.node_id WHERE p.listener_id <> p.transmitter_id AND p.n > 0 GROUP BY p.listener_id),
  set_n AS (SELECT node_id, absorption FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY t_ms DESC, seq DESC) AS k FROM absorptions) z WHERE k = 1),
  openings AS (SELECT s.wall, collect_list(struct(((d.door_x - s.ax) * (s.bx - s.ax) + (d.door_y - s.ay) * (s.b_y - s.ay)) / l2 AS t, d.width / 2 / sqrt(l2) AS half)) AS opens
    FROM (SELECT *, (bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay) AS l2 FROM solid) s JOIN doors d ON s.wall = d.wall GROUP BY s.wall),
  house AS (SELECT (SELECT collect_list(struct(s.ax, s.ay, s.bx, s.b_y, s.exterior, o.opens)) FROM solid s LEFT JOIN openings o ON s.wall = o.wall) AS walls, (SELECT rooms FROM polygons) AS rooms, (SELECT collect_list(struct(a, b)) FROM trust2) AS trust)
  SELECT f.id, f.fixes, f.calibrated, h.walls, h.rooms, h.trust FROM (SELECT f.device_id AS id,
      array_sort(collect_list(struct(f.i AS i, f.node_id AS node_id, f.x AS x, f.y AS y, f.z AS z, f.d AS d, coalesce(c.absorption, 2.7D) AS n, c.absorption AS set_n, f.rssi AS rssi, f.room_id AS room_id, coalesce(m.x, f.x) AS mx, coalesce(m.y, f.y) AS my, h.fits AS fits))) AS fixes,
      (SELECT count(*) FROM pair_fits) > 0 AS calibrated
    FROM fixes f LEFT JOIN heard h ON f.node_id = h.listener_id LEFT JOIN set_n c ON f.node_id = c.node_id LEFT JOIN anchors m ON f.room_id = m.room_id GROUP BY f.device_id) f CROSS JOIN house h"""


class House:
    """Walls, rooms and which rooms are next to each other, the same for all devices."""

    def __init__(self, row: dict):
        walls = row["walls"] or []
        self.walls = np.array([[w["ax"], w["ay"], w["bx"], w["b_y"]] for w in walls], np.float64).reshape(-1, 4)
        self.exterior = np.array([w["exterior"] for w in walls], bool)
        self.opens = [np.array([[o["t"] - o["half"], o["t"] + o["half"]] for o in w["opens"] or []]).reshape(-1, 2) for w in walls]
        self.rooms = [r["room_id"] for r in row["rooms"]]
        self.edges = [np.array([[e["ax"], e["ay"], e["bx"], e["b_y"]] for e in r["es"]]) for r in row["rooms"]]
        place = {x: i for i, x in enumerate(self.rooms)}
        self.near = np.eye(len(self.rooms) + 1, dtype=bool)  # the last place stands for no room
        self.near[-1, -1] = False
        for t in row["trust"] or []:
            if t["a"] in place and t["b"] in place:
                self.near[place[t["a"]], place[t["b"]]] = True

    def room(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The first room around each point, or the number of rooms."""
        out = np.full(x.shape, len(self.rooms))
        for i in reversed(range(len(self.rooms))):
            inside = np.zeros(x.shape, bool)
            for ax, ay, bx, by in self.edges[i]:
                inside ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay if by != ay else 1.0) + ax)
            out[inside] = i
        return out

    def loss(self, fx, fy, mx, my, x, y) -> np.ndarray:
        """Decibels that walls take on the way from nodes (fx, fy) in rooms around (mx, my) to places (x, y), which broadcast together."""
        fx, fy, mx, my, x, y = np.broadcast_arrays(fx, fy, mx, my, x, y)
        count = len(self.walls)
        at = np.full((count, *x.shape), np.inf)
        kind = np.zeros((count, *x.shape), np.int8)  # 0 inner, 1 outer, 2 opening
        for w, (ax, ay, bx, by) in enumerate(self.walls):
            dx, dy, ux, uy = x - fx, y - fy, bx - ax, by - ay
            den = dx * uy - dy * ux
            safe = np.where(np.abs(den) < 1e-12, 1.0, den)
            t, u = ((ax - fx) * uy - (ay - fy) * ux) / safe, ((ax - fx) * dy - (ay - fy) * dx) / safe
            hit = (np.abs(den) >= 1e-12) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
            along = np.clip(((fx - ax) * ux + (fy - ay) * uy) / (ux * ux + uy * uy), 0, 1)
            mounted = np.hypot(fx - ax - along * ux, fy - ay - along * uy) < MOUNTED
            side = (ux * (my - ay) - uy * (mx - ax)) * (ux * (y - ay) - uy * (x - ax))
            hit &= ~mounted | (side < 0)
            at[w] = np.where(hit, t, np.inf)
            through = np.zeros(x.shape, bool)
            for lo, hi in self.opens[w]:
                through |= (u >= lo) & (u <= hi)
            kind[w] = np.where(through, 2, self.exterior[w])
        order = np.argsort(at, axis=0, kind="stable")
        at, kind = np.take_along_axis(at, order, 0), np.take_along_axis(kind, order, 0)
        price = np.array([WALL_DB, EXTERIOR_DB, DOOR_DB])
        total, start, strongest = np.zeros(x.shape), np.full(x.shape, -np.inf), np.full(x.shape, -1, np.int8)
        for k in range(count):
            live = np.isfinite(at[k])
            fresh = live & (at[k] - start >= MERGED)
            total += np.where(fresh & (strongest >= 0), price[strongest], 0.0)
            strongest = np.where(fresh, kind[k], np.where(live, np.maximum(strongest, kind[k]), strongest))
            start = np.where(fresh, at[k], start)
        return total + np.where(strongest >= 0, price[strongest], 0.0)


@dataclass
class Fixes:
    """Padded fixes of many devices: (device, fix) matrices, and (device, fix, path) arrays of the listeners' known paths."""

    x: np.ndarray
    y: np.ndarray
    z: np.ndarray
    d: np.ndarray
    n: np.ndarray
    on: np.ndarray
    path_x: np.ndarray
    path_y: np.ndarray
    path_n: np.ndarray
    path_r2: np.ndarray
    calibrated: np.ndarray
    rssi: np.ndarray
    middle_x: np.ndarray
    middle_y: np.ndarray
    room: np.ndarray
    pair_r2: np.ndarray
    #: exponents that were set, NaN where none was
    set_n: np.ndarray
    house: House

    def rows(self, pick: np.ndarray) -> Fixes:
        return Fixes(*(getattr(self, f.name)[pick] for f in fields(self)[:-1]), self.house)

    @property
    def count(self) -> np.ndarray:
        return self.on.sum(1)

    @property
    def near_weight(self) -> np.ndarray:
        return np.where(self.on, 1 / (self.d * self.d + FLOOR), 0.0)

    def flat(self, at: np.ndarray) -> np.ndarray:
        """Distances on the floor plan between places (device, 2) and the nodes."""
        return np.hypot(at[:, :1] - self.x, at[:, 1:2] - self.y)

    def far(self, at: np.ndarray) -> np.ndarray:
        """Distances in space between places (device, 3) and the nodes."""
        return np.sqrt((at[:, :1] - self.x) ** 2 + (at[:, 1:2] - self.y) ** 2 + (at[:, 2:3] - self.z) ** 2)


@dataclass
class Places:
    """A solution per device."""

    at: np.ndarray
    confidence: np.ndarray
    count: np.ndarray


def unpack(batch: pa.RecordBatch) -> tuple[Fixes, list]:
    """The fixes of a batch as made by PROBLEMS, and the node of each fix by device."""
    column = batch.column("fixes")
    length = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    struct = column.flatten()
    part = dict(zip([f.name for f in struct.type], struct.flatten(), strict=True))
    rows, most = len(length), int(length.max(initial=1))
    slot = np.repeat(np.arange(rows) * most - (np.cumsum(length) - length), length) + np.arange(length.sum())

    def spread(values, fill=0.0):
        out = np.full(rows * most, fill)
        out[slot] = values.to_numpy(zero_copy_only=False)
        return out.reshape(rows, most)

    paths = part["fits"]
    size = np.nan_to_num(paths.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    inner = paths.flatten()
    own = dict(zip([f.name for f in inner.type], inner.flatten(), strict=True))
    wide = int(size.max(initial=1))
    where = np.repeat(slot * wide - (np.cumsum(size) - size), size) + np.arange(size.sum())

    def paths_of(name):
        out = np.zeros(rows * most * wide)
        out[where] = own[name].to_numpy(zero_copy_only=False)
        return out.reshape(rows, most, wide)

    on = np.zeros(rows * most, bool)
    on[slot] = True
    house = House({c: batch.column(c)[0].as_py() for c in ("walls", "rooms", "trust")})
    names = part["node_id"].to_pylist()
    number = {x: i for i, x in enumerate(dict.fromkeys([*names, *own["other"].to_pylist()]))}
    # the fit quality of both directions between any two fixes of a device
    node = np.full(rows * most, len(number))
    node[slot] = [number[x] for x in names]
    quality = np.zeros((len(number) + 1, len(number) + 1))
    listener = np.repeat([number[x] for x in names], size)
    other = np.array([number[x] for x in own["other"].to_pylist()], np.int64)
    quality[listener, other] = own["r2"].to_numpy(zero_copy_only=False)
    quality = np.maximum(quality, quality.T)
    node = node.reshape(rows, most)
    place = {x: i for i, x in enumerate(house.rooms)}
    room = np.full(rows * most, len(place))
    room[slot] = [place.get(x, len(place)) for x in part["room_id"].to_pylist()]
    fixes = Fixes(
        *(spread(part[c]) for c in ("x", "y", "z", "d")), spread(part["n"], 1.0), on.reshape(rows, most), *(paths_of(c) for c in ("x", "y", "n", "r2")),
        batch.column("calibrated").to_numpy(zero_copy_only=False).astype(bool),
        spread(part["rssi"].fill_null(np.nan)), spread(part["mx"]), spread(part["my"]), room.reshape(rows, most), quality[node[:, :, None], node[:, None, :]], spread(part["set_n"].fill_null(np.nan), np.nan), house,
    )
    ends = np.cumsum(length)
    return fixes, [names[e - k : e] for e, k in zip(ends, length, strict=True)]


def centroid(fixes: Fixes) -> Places:
    """Inverse-square centroid, reweighted against distances measured too long; of one or two fixes, their middle."""
    weight = fixes.near_weight
    for turn in range(TURNS + 1):
        total = weight.sum(1)
        at = np.stack([(weight * c).sum(1) / total for c in (fixes.x, fixes.y, fixes.z)], 1)
        over = fixes.d - fixes.far(at)
        if turn < TURNS:
            weight = weight / (1 + np.where(over > 0, over / SHADOW, 0.0) ** 2)
    error = np.sqrt((weight * over * over).sum(1) / total)
    confidence = np.clip(0.7 / (1 + error / 2) + 0.3 * np.minimum(1, fixes.count / 6), 0, 1)
    few = np.flatnonzero(fixes.count < 3)
    if len(few):
        order = np.argsort(np.where(fixes.on, fixes.d, np.inf)[few], axis=1, kind="stable")
        first = order[:, 0]
        second = np.where(fixes.count[few] > 1, order[:, min(1, order.shape[1] - 1)], first)
        at[few] = np.stack([(c[few, first] + c[few, second]) / 2 for c in (fixes.x, fixes.y, fixes.z)], 1)
        confidence[few] = 0.2
    return Places(at, confidence, fixes.count)


def _median(values: np.ndarray, on: np.ndarray) -> np.ndarray:
    n = on.sum(1)
    ordered = np.sort(np.where(on, values, np.inf), axis=1)
    row = np.arange(len(n))
    return (ordered[row, np.maximum(n - 1, 0) // 2] + ordered[row, np.minimum(n // 2, on.shape[1] - 1)]) / 2


def inliers(fixes: Fixes, at: np.ndarray) -> np.ndarray:
    """Which fixes stay: the worst ones go while their residuals stand out from the median by far."""
    n = fixes.count
    residual = np.abs(fixes.far(at) - fixes.d)
    middle = _median(residual, fixes.on)
    spread = _median(np.abs(residual - middle[:, None]), fixes.on)
    limit = np.maximum(RESIDUAL, middle + SPREAD * spread)
    allowed = np.where((n >= LEAST) & (1.4826 * spread >= 1e-6), np.minimum(np.floor(SHARE * n + 1e-12), n - STAY), 0)
    order = np.argsort(np.where(fixes.on, -residual, np.inf), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(len(order), 0), 1)
    return fixes.on & ~((residual > limit[:, None]) & (place < allowed[:, None]))


def robust(solve: Callable[[Fixes], Places], fixes: Fixes) -> Places:
    """Solves, leaves out the outliers of that solution, and solves again where there were any."""
    out = solve(fixes)
    keep = inliers(fixes, out.at)
    again = np.flatnonzero((keep != fixes.on).any(1))
    if len(again):
        part = fixes.rows(again)
        more = solve(replace(part, on=keep[again]))
        solved = ~np.isnan(more.at[:, 0])
        again, more = again[solved], Places(more.at[solved], more.confidence[solved], more.count[solved])
        out.at[again], out.confidence[again], out.count[again] = more.at, more.confidence, more.count
    return out


def simplex(value: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, step: float = 1.0, close: float = 5e-3, turns: int = 200) -> np.ndarray:
    """Downhill simplex in the plane for many problems; value(points, rows) is the objective of those rows."""
    n = len(start)
    corners = np.stack([start, start + [step, 0], start + [0, step]], 1)
    every = np.arange(n)
    height = np.stack([value(corners[:, k], every) for k in range(3)], 1)
    live = every
    for _ in range(turns):
        order = np.argsort(height[live], axis=1, kind="stable")
        corners[live] = np.take_along_axis(corners[live], order[:, :, None], 1)
        height[live] = np.take_along_axis(height[live], order, 1)
        size = np.hypot(*(corners[live, 1:] - corners[live, :1]).transpose(2, 0, 1)).max(1)
        live = live[size >= close]
        if not len(live):
            break
        best, worst = corners[live, 0], corners[live, 2]
        low, mid, high = height[live].T
        middle = (corners[live, 0] + corners[live, 1]) / 2
        mirrored = middle + (middle - worst)
        at_mirrored = value(mirrored, live)
        grow, keep = at_mirrored < low, (at_mirrored >= low) & (at_mirrored < mid)
        # one more point each: beyond the mirrored one, or on the better half of the way to it
        trial = np.where(grow[:, None], middle + 2 * (mirrored - middle), middle + 0.5 * np.where((at_mirrored < high)[:, None], mirrored - middle, worst - middle))
        at_trial = value(trial, live)
        use_trial = np.where(grow, at_trial < at_mirrored, np.where(at_mirrored < high, at_trial <= at_mirrored, at_trial < high)) & ~keep
        use_mirrored = keep | (grow & ~use_trial)
        corners[live[use_trial], 2], height[live[use_trial], 2] = trial[use_trial], at_trial[use_trial]
        corners[live[use_mirrored], 2], height[live[use_mirrored], 2] = mirrored[use_mirrored], at_mirrored[use_mirrored]
        shrink = ~(use_trial | use_mirrored)
        if shrink.any():
            rows = live[shrink]
            for k in (1, 2):
                corners[rows, k] = best[shrink] + 0.5 * (corners[rows, k] - best[shrink])
                height[rows, k] = value(corners[rows, k], rows)
    order = np.argsort(height, axis=1, kind="stable")
    return corners[every, order[:, 0]]


def quasi_newton(value, slope, start: np.ndarray, turns: int, close: float, halvings: int, least: float) -> np.ndarray:
    """Quasi-Newton descent in the plane with halved steps, for many problems; value and slope take (points, rows)."""
    at = start.copy()
    every = np.arange(len(at))
    height, g = value(at, every), slope(at, every)
    inverse = np.tile(np.eye(2), (len(at), 1, 1))
    live = every
    for _ in range(turns):
        live = live[np.hypot(*g[live].T) >= close]
        if not len(live):
            break
        way = -np.einsum("pij,pj->pi", inverse[live], g[live])
        fall = (g[live] * way).sum(1)
        length = np.ones(len(live))
        new = value(at[live] + way, live)
        for _ in range(halvings):
            short = np.flatnonzero((new > height[live] + 1e-4 * length * fall) & (length > least))
            if not len(short):
                break
            length[short] *= 0.5
            new[short] = value(at[live[short]] + length[short, None] * way[short], live[short])
        step = length[:, None] * way
        moves = np.hypot(*step.T) >= close
        live, step, new = live[moves], step[moves], new[moves]
        if not len(live):
            break
        place = at[live] + step
        after = slope(place, live)
        change = after - g[live]
        curve = (change * step).sum(1)
        fit = np.abs(curve) > 1e-10
        rows, s, y, rho = live[fit], step[fit], change[fit], 1 / curve[fit]
        turn = np.eye(2) - rho[:, None, None] * s[:, :, None] * y[:, None, :]
        inverse[rows] = turn @ inverse[rows] @ turn.transpose(0, 2, 1) + rho[:, None, None] * s[:, :, None] * s[:, None, :]
        at[live], g[live], height[live] = place, after, new
    return at


def _fitted(fixes: Fixes, solve: Callable[[Fixes, np.ndarray], np.ndarray]) -> Places:
    """A planar solution from the centroid on, scored by its plain residuals; fewer than three fixes keep the centroid."""
    seed = centroid(fixes)
    enough = np.flatnonzero(fixes.count >= 3)
    if len(enough):
        part = fixes.rows(enough)
        flat = solve(part, seed.at[enough, :2])
        residual = np.where(part.on, part.flat(flat) - part.d, 0.0)
        error = np.sqrt((residual**2).sum(1) / part.count)
        seed.at[enough, :2] = flat
        seed.confidence[enough] = np.clip(0.7 / (1 + error / 1.5) + 0.3 * np.minimum(1, part.count / 6), 0, 1)
    return seed


def nelder_mead(fixes: Fixes) -> Places:
    """Simplex on a Huber loss, weighted by inverse square distance."""

    def solve(part: Fixes, start: np.ndarray) -> np.ndarray:
        weight = part.near_weight

        def loss(points, rows):
            r = np.abs(np.hypot(points[:, :1] - part.x[rows], points[:, 1:] - part.y[rows]) - part.d[rows])
            return (weight[rows] * np.where(r <= HUBER, 0.5 * r * r, HUBER * (r - 0.5 * HUBER))).sum(1)

        return simplex(loss, start)

    return _fitted(fixes, solve)


def likelihood(fixes: Fixes) -> Places:
    """Simplex on squares with a variance in proportion to the distance."""

    def solve(part: Fixes, start: np.ndarray) -> np.ndarray:
        weight = np.where(part.on, 1 / (part.d + FLOOR), 0.0)

        def loss(points, rows):
            r = np.hypot(points[:, :1] - part.x[rows], points[:, 1:] - part.y[rows]) - part.d[rows]
            return (weight[rows] * r * r).sum(1)

        return simplex(loss, start)

    return _fitted(fixes, solve)


def bfgs(fixes: Fixes) -> Places:
    """Quasi-Newton on squares that forgive distances measured too long."""

    def solve(part: Fixes, start: np.ndarray) -> np.ndarray:
        weight = part.near_weight

        def terms(points, rows):
            dx, dy = points[:, :1] - part.x[rows], points[:, 1:] - part.y[rows]
            length = np.hypot(dx, dy)
            r = length - part.d[rows]
            return dx, dy, length, r, weight[rows] / (1 + np.where(r < 0, r / SHADOW, 0.0) ** 2)

        def loss(points, rows):
            _, _, _, r, w = terms(points, rows)
            return (w * r * r).sum(1)

        def slope(points, rows):
            dx, dy, length, r, w = terms(points, rows)
            factor = np.where(length < 1e-9, 0.0, 2 * w * r / np.maximum(length, 1e-9))
            return np.stack([(factor * dx).sum(1), (factor * dy).sum(1)], 1)

        return quasi_newton(loss, slope, start, 50, 1e-5, 30, 1e-12)

    return _fitted(fixes, solve)


def path_exponents(fixes: Fixes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The path-loss exponent towards each place, from the listener's known paths in like direction and length; and whether there were any."""
    ux, uy = at[:, :1] - fixes.x, at[:, 1:2] - fixes.y
    length = np.hypot(ux, uy)
    px, py = fixes.path_x - fixes.x[:, :, None], fixes.path_y - fixes.y[:, :, None]
    path = np.hypot(px, py)
    usable = (fixes.path_r2 >= QUALITY) & (path >= 1e-6) & (length >= 1e-6)[:, :, None]
    cosine = (px * ux[:, :, None] + py * uy[:, :, None]) / np.where(usable, path * length[:, :, None], 1.0)
    weight = np.where(usable, np.maximum(cosine, 0.0) ** 2 * np.exp(-np.abs(path - length[:, :, None]) / LIKE) * fixes.path_r2, 0.0)
    total = weight.sum(2)
    known = total > 1e-9
    mean = (weight * fixes.path_n).sum(2) / np.where(known, total, 1.0)
    return np.where(known, fixes.n + np.minimum(1, total / CERTAIN) * (mean - fixes.n), fixes.n), known


def corrected(fixes: Fixes, at: np.ndarray) -> Fixes:
    """The fixes with distances corrected for the exponents of their paths."""
    exponent, known = path_exponents(fixes, at)
    good = known & (fixes.n > 0) & (exponent > 0) & (fixes.d > 0)
    return replace(fixes, d=np.where(good, np.where(fixes.d > 0, fixes.d, 1.0) ** (fixes.n / np.where(good, exponent, 1.0)), fixes.d))


def path_confidence(fixes: Fixes, at: np.ndarray, settled: np.ndarray) -> np.ndarray:
    """Blend of fit, directions, calibration cover and number of fixes."""
    n = np.maximum(fixes.count, 1)
    weight = fixes.near_weight
    residual = np.where(fixes.on, fixes.far(at) - fixes.d, 0.0)
    error = np.sqrt((weight * residual**2).sum(1) / np.maximum(weight.sum(1), 1e-300))
    dx, dy = fixes.x - at[:, :1], fixes.y - at[:, 1:2]
    length = np.hypot(dx, dy)
    seen = fixes.on & (length >= 1e-6)
    ux, uy = (np.where(seen, c / np.maximum(length, 1e-6), 0.0) for c in (dx, dy))
    xx, xy, yy = (ux * ux).sum(1), (ux * uy).sum(1), (uy * uy).sum(1)
    spread = np.where(seen.sum(1) >= 2, np.clip(4 * (xx * yy - xy * xy) / np.maximum((xx + yy) ** 2, 1e-300), 0, 1), 0.0)
    cover = np.where(fixes.on, np.minimum(1, (fixes.path_r2 > 0).sum(2) / 3), 0.0).sum(1) / n
    blend = 0.55 / (1 + error / 3) + 0.2 * spread + 0.15 * cover + 0.1 * np.minimum(1, fixes.count / 6)
    return np.clip(blend * np.where(settled, 1.0, 0.9), 0, 1)


def path_aware(fixes: Fixes) -> Places:
    """The centroid of distances that are corrected for their paths towards it, until it stays."""
    out = centroid(fixes)
    settled = ~fixes.calibrated
    last = np.full(len(settled), np.inf)
    live = np.flatnonzero(fixes.calibrated)
    for turn in range(CORRECTIONS):
        if not len(live):
            break
        found = centroid(corrected(fixes.rows(live), out.at[live]))
        moved = np.hypot(*(found.at[:, :2] - out.at[live, :2]).T)
        out.at[live], out.confidence[live] = found.at, found.confidence
        swings = (moved >= last[live]) & (turn > 0)
        still = ~swings & (moved < STILL)
        settled[live[still]] = True
        last[live] = moved
        live = live[~swings & ~still]
    final = replace(fixes, d=np.where(fixes.calibrated[:, None], corrected(fixes, out.at).d, fixes.d))
    kept = replace(final, on=inliers(final, out.at))
    return Places(out.at, path_confidence(kept, out.at, settled), kept.count)


def environment_aware(fixes: Fixes) -> Places:
    """Quasi-Newton on distances as the path towards the place would make them, with the paths taken anew each turn."""
    out = centroid(fixes)
    enough = np.flatnonzero(fixes.count >= 3)
    if not len(enough):
        return out
    part = fixes.rows(enough)
    at = out.at[enough, :2].copy()

    def model(at, part):
        exponent, _ = path_exponents(part, at)
        ratio = np.where(exponent > 0, exponent / part.n, 1.0)
        residual = part.d - part.flat(at) ** ratio
        return ratio, residual, part.near_weight / (1 + np.where(residual > 0, residual / SHADOW, 0.0) ** 2)

    live = np.arange(len(at))
    for _ in range(CORRECTIONS):
        own = part.rows(live)
        ratio, _, weight = model(at[live], own)

        def terms(points, rows, own=own, ratio=ratio):
            dx, dy = points[:, :1] - own.x[rows], points[:, 1:] - own.y[rows]
            length = np.hypot(dx, dy)
            seen = length ** ratio[rows]
            return dx, dy, length, seen, own.d[rows] - seen

        def loss(points, rows, weight=weight, terms=terms):
            return (weight[rows] * terms(points, rows)[4] ** 2).sum(1)

        def slope(points, rows, weight=weight, ratio=ratio, terms=terms):
            dx, dy, length, seen, r = terms(points, rows)
            factor = np.where(length < 1e-9, 0.0, -2 * weight[rows] * r * ratio[rows] * seen / np.maximum(length, 1e-9) ** 2)
            return np.stack([(factor * dx).sum(1), (factor * dy).sum(1)], 1)

        new = quasi_newton(loss, slope, at[live], 30, 1e-4, 20, 1e-10)
        moved = np.hypot(*(new - at[live]).T)
        at[live] = new
        live = live[moved >= STILL]
        if not len(live):
            break
    _, residual, weight = model(at, part)
    error = np.sqrt((weight * residual**2).sum(1) / weight.sum(1))
    agree = (part.on & (np.abs(residual) < 1.5)).sum(1) / part.count
    out.at[enough, :2] = at
    out.confidence[enough] = np.clip(0.45 / (1 + error / 3) + 0.3 * agree + 0.25 * np.minimum(1, part.count / 6), 0, 1)
    return out


def _crossings(fixes: Fixes) -> tuple[np.ndarray, ...]:
    """Both crossing points of every pair of fixes: (device, candidate) arrays x, y, whether there is one, first and second fix, angle quality."""
    most = fixes.d.shape[1]
    i, j = np.triu_indices(most, 1)
    a, b = fixes.d[:, i], fixes.d[:, j]
    dx, dy = fixes.x[:, j] - fixes.x[:, i], fixes.y[:, j] - fixes.y[:, i]
    gap = np.hypot(dx, dy)
    good = fixes.on[:, i] & fixes.on[:, j] & (gap >= 1e-6) & (gap <= a + b) & (gap >= np.abs(a - b))
    safe = np.where(good, gap, 1.0)
    along = (a * a - b * b + gap * gap) / (2 * safe)
    up = np.sqrt(np.maximum(a * a - along * along, 0.0))
    x, y = fixes.x[:, i] + along * dx / safe, fixes.y[:, i] + along * dy / safe
    cosine = np.clip((a * a + b * b - gap * gap) / np.where(good, 2 * a * b, 1.0), -1, 1)
    angle = np.maximum(0.01, 1 - cosine * cosine) / np.where(good, a * b, 1.0)
    both = lambda c: np.repeat(c, 2, axis=-1)
    sign = np.tile([1.0, -1.0], len(i))
    return both(x) - sign * both(up * dy / safe), both(y) + sign * both(up * dx / safe), both(good), both(i), both(j), both(angle)


def _best_crossing(fixes: Fixes) -> tuple[np.ndarray, np.ndarray]:
    """The crossing that walls, rooms and the other circles speak for most, and whether a device has any."""
    x, y, good, i, j, angle = _crossings(fixes)
    row = np.arange(len(x))[:, None]
    house = fixes.house
    loss = house.loss(fixes.x[:, None, :], fixes.y[:, None, :], fixes.middle_x[:, None, :], fixes.middle_y[:, None, :], x[:, :, None], y[:, :, None])
    clear = np.exp(-loss / FOLD_DB)
    pick = np.arange(x.shape[1])[None, :]
    score = angle * clear[row, pick, i] * clear[row, pick, j] * (0.5 + 0.5 * fixes.pair_r2[:, i, j])
    nearest = np.where(fixes.on, fixes.d, np.inf).argmin(1)
    one = np.arange(len(nearest))
    home = np.where(fixes.d[one, nearest] <= ROOM_REACH, fixes.room[one, nearest], len(house.rooms))
    room = house.room(x, y)
    known = (home < len(house.rooms))[:, None]
    score = score * np.where(known & (room == home[:, None]), SAME_ROOM, np.where(known & house.near[room, home[:, None]], NEXT_ROOM, 1.0))
    off = np.abs(np.hypot(x[:, :, None] - fixes.x[:, None, :], y[:, :, None] - fixes.y[:, None, :]) - fixes.d[:, None, :])
    reach = AGREE * fixes.d[:, None, :]
    others = fixes.on[:, None, :] & (np.arange(fixes.d.shape[1]) != i[:, None]) & (np.arange(fixes.d.shape[1]) != j[:, None])
    agree = np.where(others & (off <= reach), clear * (1 - off / np.where(reach > 0, reach, 1.0)), 0.0).sum(2)
    score = np.where(good, score * (1 + agree), -1.0)
    best = score.argmax(1)
    return np.stack([x[one, best], y[one, best]], 1), good.any(1)


def _plain(fixes: Fixes) -> np.ndarray:
    weight = fixes.near_weight
    return np.stack([(weight * c).sum(1) / np.maximum(weight.sum(1), 1e-300) for c in (fixes.x, fixes.y, fixes.z)], 1)


def _from_crossing(fixes: Fixes, refine: Callable[[Fixes, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Places:
    """Refines the best crossing; plain means without one; no place (NaN) with fewer than two fixes."""
    out = Places(_plain(fixes), np.full(len(fixes.d), 0.3), fixes.count)
    for lo in range(0, len(fixes.d), 64):
        own = np.arange(lo, min(lo + 64, len(fixes.d)))
        part = fixes.rows(own)
        start, found = _best_crossing(part)
        found &= part.count >= 2
        if found.any():
            at, agree = refine(part.rows(found), start[found])
            out.at[own[found], :2] = at
            out.confidence[own[found]] = np.clip(0.6 * agree + 0.4 * np.minimum(1, part.count[found] / 6), 0, 1)
    out.at[fixes.count < 2] = np.nan
    return out


def _wall_loss(fixes: Fixes, at: np.ndarray) -> np.ndarray:
    return fixes.house.loss(fixes.x, fixes.y, fixes.middle_x, fixes.middle_y, at[:, :1], at[:, 1:2])


def rf_room_aware(fixes: Fixes) -> Places:
    """The best crossing, refined on distances where being too far out weighs ten times as much as being too close."""

    def refine(part: Fixes, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weight = part.near_weight

        def loss(points, rows):
            r = np.hypot(points[:, :1] - part.x[rows], points[:, 1:] - part.y[rows]) - part.d[rows]
            size = np.abs(r)
            return (weight[rows] * np.where(r > 0, 1.0, 0.1) * np.where(size <= HUBER, 0.5 * r * r, HUBER * (size - 0.5 * HUBER))).sum(1)

        at = simplex(loss, start)
        clear = np.where(part.on, np.exp(-_wall_loss(part, at) / FOLD_DB), 0.0)
        near = np.abs(part.flat(at) - part.d) < 1.5
        return at, (clear * near).sum(1) / np.maximum(clear.sum(1), 1e-300)

    return _from_crossing(fixes, refine)


def rf_physics(fixes: Fixes) -> Places:
    """The best crossing, refined on signal strengths as distance and walls would make them."""

    def refine(part: Fixes, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own_n = np.where(part.set_n > 0.1, part.set_n, UNSET)
        heard = np.where(np.isnan(part.rssi), REFERENCE - 10 * own_n * np.log10(np.maximum(part.d, 0.1)), part.rssi)

        def off(points, own, sounds):
            length = own.flat(points)
            walls = _wall_loss(own, points)
            return length, walls, REFERENCE - 10 * EXPONENT * np.log10(np.maximum(length, 1e-9)) - walls - sounds

        def loss(points, rows):
            own = part.rows(rows)
            length, walls, r = off(points, own, heard[rows])
            size = np.abs(r)
            cost = np.where(size <= HUBER_DB, 0.5 * r * r, HUBER_DB * (size - 0.5 * HUBER_DB))
            return np.where(own.on & (length >= 0.1), np.exp(-walls / FOLD_DB) * np.where(r < 0, 1.0, 0.15) * cost, 0.0).sum(1)

        at = simplex(loss, start)
        length, _, r = off(at, part, heard)
        counted = part.on & (length >= 0.1)
        return at, (counted & (np.abs(r) < HUBER_DB)).sum(1) / np.maximum(counted.sum(1), 1)

    return _from_crossing(fixes, refine)


#: Active locator: weight of a pair of fixes by how many of its nodes are in or next to the voted room (both in it: 1), and how many fixes vote.
OUT_OF_REACH, HALF_NEAR, BOTH_NEAR, VOTERS = 0.005, 0.3, 0.8, 3


def voted_room(fixes: Fixes) -> np.ndarray:
    """The room that the nearest nodes speak for, or the number of rooms."""
    none = len(fixes.house.rooms)
    near = np.argsort(np.where(fixes.on, fixes.d, np.inf), axis=1, kind="stable")[:, :VOTERS]
    room = np.take_along_axis(np.where(fixes.on, fixes.room, none), near, 1)
    weight = np.take_along_axis(fixes.near_weight, near, 1)
    votes = np.zeros(room.shape)
    for k in range(room.shape[1]):  # a room's votes add up from the nearest node on
        votes += np.where(room == room[:, k : k + 1], weight[:, k : k + 1], 0.0)
    votes[room == none] = -1.0
    return room[np.arange(len(room)), votes.argmax(1)]


def room_aware(fixes: Fixes) -> Places:
    """The mean of all crossings, weighted by angle, size, rooms, path quality and the other circles through them; no place (NaN) with fewer than two fixes."""
    x, y, good, i, j, angle = _crossings(fixes)
    house, row = fixes.house, np.arange(len(fixes.d))[:, None]
    home = voted_room(fixes)[:, None]
    known = home < len(house.rooms)
    near = known & house.near[home, fixes.room]
    first, second = near[:, i], near[:, j]
    inside = (fixes.room[:, i] == home) & (fixes.room[:, j] == home)
    rooms = np.where(first & second, np.where(inside, 1.0, BOTH_NEAR), np.where((first | second) | ~known, HALF_NEAR, OUT_OF_REACH))
    off = np.abs(np.hypot(x[:, :, None] - fixes.x[:, None, :], y[:, :, None] - fixes.y[:, None, :]) - fixes.d[:, None, :])
    reach = AGREE * fixes.d[:, None, :]
    each = np.arange(fixes.d.shape[1])
    others = fixes.on[:, None, :] & (each != i[:, None]) & (each != j[:, None])
    agree = np.where(others & (off <= reach), np.where(near, 1.0, 0.3)[:, None, :] * (1 - off / np.where(reach > 0, reach, 1.0)), 0.0).sum(2)
    score = np.where(good, angle * rooms * (0.5 + 0.5 * fixes.pair_r2[row, i, j]) * (1 + agree), 0.0)
    total = score.sum(1)
    found = total > 0
    out = Places(_plain(fixes), np.full(len(total), 0.3), fixes.count)
    safe = np.where(found, total, 1.0)
    for k, c in enumerate((x, y)):
        out.at[:, k] = np.where(found, (score * c).sum(1) / safe, out.at[:, k])
    counted = fixes.on & near
    close = counted & (np.abs(fixes.flat(out.at) - fixes.d) < 1.5)
    share = close.sum(1) / np.maximum(counted.sum(1), 1)
    out.confidence[found] = np.clip(0.6 * share + 0.4 * np.minimum(1, fixes.count / 6), 0, 1)[found]
    out.at[fixes.count < 2] = np.nan
    return out


#: Intersection locator: width of agreement in metres, share of the best score that counts.
AGREED, TOP_SHARE = 1.5, 0.7


def intersection(fixes: Fixes) -> Places:
    """The mean of the crossings that nearly as many circles pass as the best one; without crossings, or with fewer than three fixes, the centroid."""
    out = centroid(fixes)
    x, y, good, _, _, _ = _crossings(fixes)
    off = np.abs(np.hypot(x[:, :, None] - fixes.x[:, None, :], y[:, :, None] - fixes.y[:, None, :]) - fixes.d[:, None, :])
    score = np.where(good, np.where(fixes.on[:, None, :], np.maximum(0.0, 1 - off / AGREED), 0.0).sum(2), -1.0)
    score = np.where(score >= TOP_SHARE * score.max(1, initial=-1.0, keepdims=True) - 1e-9, np.maximum(score, 0.0), 0.0)
    total = score.sum(1)
    found = (total > 0) & (fixes.count >= 3)
    safe = np.where(total > 0, total, 1.0)
    at = np.stack([(score * x).sum(1) / safe, (score * y).sum(1) / safe, _plain(fixes)[:, 2]], 1)
    close = (fixes.on & (np.abs(fixes.flat(at) - fixes.d) <= AGREED)).sum(1) / np.maximum(fixes.count, 1)
    out.at[found] = at[found]
    out.confidence[found] = (0.7 * close + 0.3 * np.minimum(1, fixes.count / 6))[found]
    return out


SOLVERS: dict[str, Callable[[Fixes], Places]] = {
    "nadaraya_watson": centroid,
    "nelder_mead": nelder_mead,
    "bfgs": bfgs,
    "mle": likelihood,
    "path_aware": path_aware,
    "environment_aware": environment_aware,
    "rf_room_aware": rf_room_aware,
    "rf_physics": rf_physics,
}
PLACES = "device_id string, algorithm string, x double, y double, z double, confidence double, fixes long"


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows over as many tasks as a shuffle has: few bytes are much work here, so small partitions are not to be put together."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def problems(spark, sf_dir: str) -> DataFrame:
    """A row per device with its fixes and their listeners' known paths."""
    return dealt(house_sql(PROBLEMS)(spark, sf_dir), "id")


def located(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Positions of the devices in rows (as PROBLEMS makes them) by each of the named locators, outliers left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fixes, _ = unpack(batch)
            for name in names:
                out = robust(SOLVERS[name], fixes)
                found = np.flatnonzero(~np.isnan(out.at[:, 0]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(found)), pa.array([name] * len(found), pa.string()), *(pa.array(out.at[found, k]) for k in range(3)), pa.array(out.confidence[found]), pa.array(out.count[found].astype(np.int64))],
                    [x.split()[0] for x in PLACES.split(", ")],
                )

    return rows.mapInArrow(run, PLACES)


#: Locators of fixes(id, fixes array of structs) alone; the last one also names the room that the nearest nodes speak for.
PLAIN_SOLVERS: dict[str, Callable[[Fixes], Places]] = {"nadaraya": centroid, "nadaraya_kept": lambda fixes: robust(centroid, fixes), "crossing": intersection, "room_aware": room_aware}
GATHERED = "SELECT id, array_sort(collect_list(struct(i, node_id, x, y, z, d, room_id))) AS fixes FROM fx GROUP BY id"
SOLVED = "id string, x double, y double, z double, confidence double, fixes long, room_id string"


def gathered(batch: pa.RecordBatch, house: House, nodes: dict[str, int], quality: np.ndarray) -> Fixes:
    """The padded fixes of a batch as made by GATHERED."""
    column = batch.column("fixes")
    length = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    struct = column.flatten()
    part = dict(zip([f.name for f in struct.type], struct.flatten(), strict=True))
    shape = len(length), int(length.max(initial=1))
    on = np.arange(shape[1]) < length[:, None]

    def spread(values, fill=0.0):
        out = np.full(shape, fill)
        out[on] = values
        return out

    x, y, z, d = (spread(part[c].to_numpy(zero_copy_only=False)) for c in ("x", "y", "z", "d"))
    place = {r: i for i, r in enumerate(house.rooms)}
    room = spread([place.get(r, len(place)) for r in part["room_id"].to_pylist()], len(place)).astype(np.int64)
    node = spread([nodes.get(n, len(nodes)) for n in part["node_id"].to_pylist()], len(nodes)).astype(np.int64)
    none = np.zeros((*shape, 0))
    return Fixes(x, y, z, d, np.ones(shape), on, none, none, none, none, np.zeros(shape[0], bool), d, x, y, room, quality[node[:, :, None], node[:, None, :]], np.full(shape, np.nan), house)


def solved(rows: DataFrame, name: str, rooms: list[str], trust: list[tuple[str, str]], fits: list[tuple[str, str, float]]) -> DataFrame:
    """Places by one of PLAIN_SOLVERS for rows as made by GATHERED; rooms, trusted pairs and path qualities are those of one house."""
    house = House({"walls": [], "rooms": [{"room_id": r, "es": []} for r in rooms], "trust": [{"a": a, "b": b} for a, b in trust]})
    nodes = {n: i for i, n in enumerate(dict.fromkeys([n for a, b, _ in fits for n in (a, b)]))}
    quality = np.zeros((len(nodes) + 1, len(nodes) + 1))
    for a, b, r2 in fits:
        quality[nodes[a], nodes[b]] = r2
    quality = np.maximum(quality, quality.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                fixes = gathered(part, house, nodes, quality)
                out = PLAIN_SOLVERS[name](fixes)
                names = np.array([*house.rooms, None], object)[voted_room(fixes)]
                found = np.flatnonzero(~np.isnan(out.at[:, 0]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(found)), *(pa.array(out.at[found, k]) for k in range(3)), pa.array(out.confidence[found]), pa.array(out.count[found].astype(np.int64)), pa.array(names[found].tolist(), pa.string())],
                    [x.split()[0] for x in SOLVED.split(", ")],
                )

    return dealt(rows, "id").mapInArrow(run, SOLVED)


COMPARED = "device_id string, algorithm string, delta double, room_off boolean, in_out boolean"


def nearest_node(fixes: Fixes) -> Places:
    """The middle of the nearest node's room."""
    nearest, row = np.where(fixes.on, fixes.d, np.inf).argmin(1), np.arange(len(fixes.d))
    at = np.stack([c[row, nearest] for c in (fixes.middle_x, fixes.middle_y, fixes.z)], 1)
    return Places(at, np.maximum(0.0, 1 - fixes.d[row, nearest] / 10), fixes.count)


def compared(rows: DataFrame) -> DataFrame:
    """How far each alternative is from the active locator's place, and whether room or being inside differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fixes, _ = unpack(batch)
            active = room_aware(fixes).at
            none = len(fixes.house.rooms)
            home = fixes.house.room(active[:, 0], active[:, 1])
            for name, solve in (SOLVERS | {"nearest_node": nearest_node}).items():
                at = (robust(solve, fixes) if name != "nearest_node" else solve(fixes)).at
                room = fixes.house.room(at[:, 0], at[:, 1])
                found = np.flatnonzero(~np.isnan(at[:, 0]) & ~np.isnan(active[:, 0]))
                values = [np.hypot(*(at - active)[found, :2].T), (room != home)[found], ((room == none) != (home == none))[found]]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(found)), pa.array([name] * len(found), pa.string()), *map(pa.array, values)], [x.split()[0] for x in COMPARED.split(", ")])

    return rows.mapInArrow(run, COMPARED)


def _pooled(spark, sf_dir: str) -> DataFrame:
    """By alternative: mean and spread of the distance from the active place, and the rates of other rooms and of in against out."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return compared(problems(spark, sf_dir)).groupBy("algorithm").agg(
        F.count("*").alias("n"), F.round(F.avg("delta"), 6).alias("mean"), F.round(F.stddev_pop("delta"), 6).alias("sigma"), rate("room_off").alias("room_rate"), rate("in_out").alias("in_out_rate")
    )


DIAGNOSTICS = "device_id string, node_id string, raw double, corrected double, expected double, raw_residual double, corrected_residual double, n_effective double, n_assumed double, rejected boolean, confidence double"


def diagnosed(rows: DataFrame) -> DataFrame:
    """What the path-aware locator makes of every fix at the place that it finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fixes, nodes = unpack(batch)
            at = robust(path_aware, fixes).at
            exponent, known = path_exponents(fixes, at)
            fixed = corrected(fixes, at)
            expected, keep = fixes.far(at), inliers(fixed, at)
            confidence = path_confidence(replace(fixed, on=keep), at, np.ones(len(at), bool))
            on = fixes.on
            device = np.repeat(np.arange(len(at)), fixes.count)
            values = [fixes.d, fixed.d, expected, fixes.d - expected, fixed.d - expected]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(device)),
                    pa.array([x for own in nodes for x in own]),
                    *(pa.array(v[on]) for v in values),
                    pa.array(exponent[on], mask=~known[on]),
                    pa.array(fixes.n[on]),
                    pa.array(~keep[on]),
                    pa.array(confidence[device]),
                ],
                [x.split()[0] for x in DIAGNOSTICS.split(", ")],
            )

    return rows.mapInArrow(run, DIAGNOSTICS)


def _one(name: str):
    return lambda spark, sf_dir: located(problems(spark, sf_dir), (name,))


def _bundle(spark, sf_dir: str) -> DataFrame:
    return located(problems(spark, sf_dir), tuple(SOLVERS))


QUERIES = {
    "l03_nelder_mead": _one("nelder_mead"),
    "l04_bfgs": _one("bfgs"),
    "l05_mle": _one("mle"),
    "l07_path_aware": _one("path_aware"),
    "l08_environment_aware": _one("environment_aware"),
    "l10_rf_physics": _one("rf_physics"),
    "l11_rf_room_aware": _one("rf_room_aware"),
    "l14_solver_bundle": _bundle,
    "a04_all_locators": lambda spark, sf_dir: compared(problems(spark, sf_dir)),
    "a05_all_locators": _pooled,
    "l16_path_diagnostics": lambda spark, sf_dir: diagnosed(problems(spark, sf_dir)),
}
