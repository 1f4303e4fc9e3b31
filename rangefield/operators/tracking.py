"""Positions over time: every message of every device replayed in order, with all that is remembered between messages.

A device's state is what a live service would keep: the smoothed distance of
each node, the position filter, pins with what they have learned, the room that
is held, the room posterior.  Its size does not grow with the history.  Each
message is handled as it would have been on arrival:

1. the node's distance is smoothed (a message without one forgets the node);
2. fixes are the nodes heard within `stale_ms`; each is corrected by the bias
   that the device's pins show near the *previous* position;
3. the active locator solves them;
4. an active pin learns from the sample, or is let go if the place is far off;
5. the place goes into the filter, or the pin overrides it;
6. the place's room is held against flicker, and changes are published;
7. rooms get probabilities by a forward step over the room graph, and a room is
   committed once it leads by a margin or for long enough.

As the bias depends on the last position, messages of one device cannot be
solved apart; different devices can.  So devices are dealt over tasks, rows come
in order of time, and the k-th message of all devices in an Arrow batch is
handled at once on matrices with a row per device.  A task holds one batch and
the states of its devices.  Devices that fall silent are told at the ticks of
`cleanup_ms`, up to `until_ms` at the end of the input.

`Tracker` is used by `replay` on tables and by `streaming.live` on streams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import spark_sql
from ..plans.house import inlined
from ..plans.relations import with_
from .solvers import Fixes, House, dealt, room_aware

OUTSIDE = "outside"


@dataclass(frozen=True)
class Settings:
    """Fixed defaults: times in milliseconds, lengths in metres."""

    stale_ms: int = 30_000
    away_ms: int = 120_000
    cleanup_ms: int = 30_000
    # smoothing of distances and places
    distance_tau_ms: float = 2000.0
    distance_least: float = 0.05
    place_tau_ms: float = 800.0
    place_least: float = 0.02
    gap_ms: int = 30_000
    position_filter: str = "kalman"
    acceleration: float = 0.5
    noise: float = 0.5
    start_speed: float = 2.0
    longest_step_s: float = 5.0
    # pins
    pin_ms: int = 1_800_000
    pin_again: float = 1.0
    pin_leave: float = 8.0
    pin_least_distance: float = 1.0
    pin_bias: tuple[float, float] = (0.2, 5.0)
    pin_samples: int = 5
    pin_full: int = 50
    pin_most: int = 10_000
    pin_reach: float = 3.0
    pin_least_weight: float = 0.05
    bias_least: float = 0.1
    # rooms
    room_ms: int = 0
    room_far_ms: int = 0
    stay: float = 1.6
    teleport: float = 0.001
    teleport_outside: float = 0.001
    door_sigma: float = 1.5
    door_floor: float = 0.05
    door_width: float = 0.8
    commit_ms: int = 2000
    commit_margin: float = 0.15
    blend_least: float = 0.05


@dataclass
class Scene:
    """What is known of the house: bounded by its rooms and nodes, so it is sent to every task."""

    house: House
    nodes: list[str]
    place: np.ndarray
    node_room: np.ndarray
    pair_r2: np.ndarray
    floors: list[tuple[str, float, float]]
    room_floor: np.ndarray
    #: over rooms and outside: is there a way through, least steps (inf: none), doors as (from, to, x, y, width)
    graph: np.ndarray
    steps: np.ndarray
    doors: list[tuple[int, int, float | None, float | None, float | None]] = field(default_factory=list)


def scene_of(spark, sf_dir: str, own: dict[str, str] | None = None) -> Scene:
    """The scene of a folder's tables; `own` holds the relations of another house, as `sources.config.scene` makes them."""

    def rows(sql: str) -> list:
        return spark_sql(with_(sql, scene=own if own is not None else inlined(spark, sql)))(spark, sf_dir).collect()

    outlines: dict[str, list[dict]] = {}
    for e in rows("SELECT ord, room_id, v, ax, ay, bx, b_y FROM edges ORDER BY ord, v"):
        outlines.setdefault(e.room_id, []).append(e.asDict())
    # the closing edge first: of two points as close, the one found first counts
    house = House({"walls": [], "rooms": [{"room_id": r, "es": [es[-1], *es[:-1]]} for r, es in outlines.items()], "trust": [t.asDict() for t in rows("SELECT a, b FROM trust2")]})
    number = {x: i for i, x in enumerate(house.rooms)}
    none = len(number)
    nodes = rows("SELECT node_id, x, y, z, room_id FROM node_rooms WHERE enabled ORDER BY ord")
    at = {r.node_id: i for i, r in enumerate(nodes)}
    quality = np.zeros((len(nodes), len(nodes)))
    for r in rows("SELECT listener_id, transmitter_id, r2 FROM pair_fits"):
        if r.listener_id in at and r.transmitter_id in at:
            quality[at[r.listener_id], at[r.transmitter_id]] = r.r2
    floors = [(r.floor_id, -np.inf if r.z0 is None else r.z0, np.inf if r.z1 is None else r.z1) for r in rows("SELECT floor_id, z0, z1 FROM floors ORDER BY ord")]
    floor_no = {f[0]: i for i, f in enumerate(floors)}
    room_floor = np.zeros(none, np.int64)
    for r in rows("SELECT room_id, floor_id FROM room_floors"):
        if r.room_id in number:
            room_floor[number[r.room_id]] = floor_no[r.floor_id]
    place = number | {OUTSIDE: none}
    graph = np.zeros((none + 1, none + 1), bool)
    for r in rows("SELECT a, b FROM walk"):
        if r.a in place and r.b in place and r.a != r.b:
            graph[place[r.a], place[r.b]] = graph[place[r.b], place[r.a]] = True
    steps = np.where(np.eye(none + 1, dtype=bool), 0.0, np.where(graph, 1.0, np.inf))
    for k in range(none + 1):
        steps = np.minimum(steps, steps[:, k : k + 1] + steps[k : k + 1])
    doors = []
    for r in rows("SELECT o.room_id AS a, coalesce(r.room_id, o.target) AS b, o.door_x, o.door_y, o.width FROM open_to o LEFT JOIN rooms r ON o.target = r.room_id OR o.target = r.room_name"):
        if r.a in place and r.b in place and r.a != r.b:
            doors.append((place[r.a], place[r.b], r.door_x if r.door_x > -1e6 else None, r.door_y, r.width))
    return Scene(
        house, [r.node_id for r in nodes], np.array([[r.x, r.y, r.z] for r in nodes]), np.array([number.get(r.room_id, none) for r in nodes]),
        np.maximum(quality, quality.T), floors, room_floor, graph, steps, doors,
    )


#: State of a device: name -> (shape after the device, with N nodes, P pins, S rooms and outside; value of a new device).
STATE: dict[str, tuple[tuple, float]] = {
    "mean": (("N",), np.nan), "mean_at": (("N",), np.nan), "variance": (("N",), 0.0), "heard": (("N",), -np.inf), "rssi": (("N",), np.nan),
    "seen": ((), np.nan), "at": ((3,), np.nan), "at_ms": ((), np.nan), "kalman": ((6,), np.nan), "cov": ((3,), 0.0), "kalman_ms": ((), np.nan),
    "pins": ((), 0.0), "pin_at": (("P", 3), np.nan), "pin_ms": (("P",), np.nan), "pin_until": (("P",), 0.0), "pin_snap": (("P", "N"), np.nan), "pin_n": (("P", "N"), 0.0), "pin_sum": (("P", "N"), 0.0),
    "room": ((), -1.0), "floor": ((), -1.0), "wish": ((), -1.0), "wish_ms": ((), 0.0), "told": ((), -1.0), "told_floor": ((), -1.0),
    "chance": (("S",), np.nan), "kept": ((), -1.0), "next": ((), -1.0), "next_ms": ((), 0.0), "smart": ((), -1.0), "smart_floor": ((), -1.0),
}

OUT = (
    "device_id string, kind string, seq long, t_ms long, node_id string, fixes int, raw_x double, raw_y double, raw_z double, confidence double, x double, y double, z double, algorithm string, "
    "room_id string, floor_id string, state string, changed boolean, smart_x double, smart_y double, smart_room string, smart_chance double, smart_state string, smart_changed boolean, pin_ms long, pin_samples long"
)
HEARD = OUT + ", heard array<struct<node_id: string, d: double, rssi: double>>"
#: States that a device reports: a room, else a floor, else this.
AWAY = "not_home"


class Tracker:
    """The states of many devices, and one step for all of them."""

    def __init__(self, scene: Scene, settings: Settings = Settings()):  # noqa: B008  frozen
        self.scene, self.set = scene, settings
        self.size = {"N": len(scene.nodes), "P": 1, "S": len(scene.house.rooms) + 1}
        self.row: dict[str, int] = {}
        self.node = {x: i for i, x in enumerate(scene.nodes)}
        self.s = {k: np.full((0, *self._shape(k)), v) for k, (_, v) in STATE.items()}
        self._transitions()

    def _shape(self, name: str) -> tuple[int, ...]:
        return tuple(self.size.get(x, x) for x in STATE[name][0])

    def _transitions(self) -> None:
        """Weights between rooms that no observation changes, and the doors."""
        s, n = self.set, self.size["S"]
        base = np.where(np.arange(n) == n - 1, s.teleport_outside, s.teleport)
        base = np.where((np.arange(n) == n - 1)[:, None], s.teleport_outside, base[None, :])
        hops = self.scene.steps
        far = np.where(np.isfinite(hops) & (hops >= 2), base / np.maximum(hops - 1, 1) ** 2, 0.0)
        self.base = np.where(self.scene.graph, s.door_width, np.where(np.eye(n, dtype=bool), s.stay, far))
        self.gates = [(a, b, x, y, s.door_width if w is None else w) for a, b, x, y, w in self.scene.doors]

    def devices(self, names: list[str]) -> np.ndarray:
        """Rows of the named devices; new ones start empty."""
        fresh = [x for x in dict.fromkeys(names) if x not in self.row]
        if fresh:
            need, have = len(self.row) + len(fresh), len(self.s["seen"])
            if need > have:
                more = max(need - have, have, 16)
                for k, (_, v) in STATE.items():
                    self.s[k] = np.concatenate([self.s[k], np.full((more, *self._shape(k)), v)])
            for x in fresh:
                self.row[x] = len(self.row)
        return np.array([self.row[x] for x in names], np.int64)

    def _room_for_pins(self) -> None:
        self.size["P"] *= 2
        for k in ("pin_at", "pin_ms", "pin_until", "pin_snap", "pin_n", "pin_sum"):
            old = self.s[k]
            self.s[k] = np.full((len(old), *self._shape(k)), STATE[k][1])
            self.s[k][:, : old.shape[1]] = old

    # --- what users do with pins

    def record(self, d: int, t: int, at: tuple[float, float, float]) -> None:
        """A click: takes up a pin within reach, which keeps its place and what it has learned, or sets a new one."""
        s = self.s
        near = s["mean"][d]
        if not (near > 0).any():  # nothing heard, nothing to compare
            return
        n = int(s["pins"][d])
        s["pin_until"][d, :n][s["pin_until"][d, :n] > t] = 0
        close = np.flatnonzero(np.hypot(s["pin_at"][d, :n, 0] - at[0], s["pin_at"][d, :n, 1] - at[1]) < self.set.pin_again)
        if len(close):
            k = close[0]
        else:
            k = n
            if k == self.size["P"]:
                self._room_for_pins()
                s = self.s
            s["pins"][d] = n + 1
            s["pin_at"][d, k], s["pin_ms"][d, k] = at, t
        s["pin_snap"][d, k] = np.where(near > 0, near, np.nan)
        s["pin_until"][d, k] = t + self.set.pin_ms

    def activate(self, d: int, t: int, pin_ms: float) -> None:
        """Takes up the pin that was set at pin_ms, closes the others, and moves the filter there."""
        s, n = self.s, int(self.s["pins"][d])
        hit = s["pin_ms"][d, :n] == pin_ms
        if not n:
            return
        s["pin_until"][d, :n][~hit & (s["pin_until"][d, :n] > t)] = 0
        s["pin_until"][d, :n][hit] = t + self.set.pin_ms
        if hit.any():
            at = s["pin_at"][d, np.flatnonzero(hit)[-1]]
            if not np.isnan(s["kalman"][d, 0]):
                s["kalman"][d] = [*at, 0, 0, 0]
            s["at"][d], s["at_ms"][d] = at, t

    def nearest_pin(self, d: int, x: float, y: float) -> float:
        """When the pin closest to a place was set."""
        n = int(self.s["pins"][d])
        if not n:
            return np.nan
        return self.s["pin_ms"][d, np.hypot(self.s["pin_at"][d, :n, 0] - x, self.s["pin_at"][d, :n, 1] - y).argmin()]

    def deactivate(self, d: int) -> None:
        self.s["pin_until"][d] = 0

    # --- messages

    def away(self, d: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Devices that were silent for too long at a tick up to `now` (forgetting their place), and that tick."""
        s, tick = self.s, self.set.cleanup_ms
        due = (np.floor((s["seen"][d] + self.set.away_ms) / tick) + 1) * tick
        gone = ~np.isnan(s["at"][d, 0]) & (due <= now)
        d, due = d[gone], due[gone]
        s["at"][d], s["kalman"][d], s["cov"][d] = np.nan, np.nan, 0.0
        s["room"][d], s["wish"][d] = -1, -1
        s["told"][d], s["told_floor"][d] = self.size["S"], -1
        s["smart"][d], s["smart_floor"][d] = self.size["S"], -1
        return d, due

    def _hear(self, d, t, node, distance, rssi) -> None:
        """Smooths the distance of one node of each device."""
        s, own = self.s, self.set
        on = node >= 0
        d, t, node, distance, rssi = d[on], t[on], node[on], distance[on], rssi[on]
        mean, at, variance = s["mean"][d, node], s["mean_at"][d, node], s["variance"][d, node]
        step = np.maximum(t - at, 0)
        anew = ~(step < own.gap_ms)  # also without a last value
        share = np.clip(1 - np.exp(-np.where(anew, 0, step) / own.distance_tau_ms), own.distance_least, 1.0)
        off = distance - mean
        moved = np.where(anew, distance, mean + share * off)
        s["variance"][d, node] = np.where(anew | np.isnan(distance), 0.0, np.maximum((1 - share) * variance + share * off * (distance - moved), 0.0))
        s["mean"][d, node], s["mean_at"][d, node] = moved, np.where(np.isnan(distance), np.nan, t)
        s["heard"][d, node], s["rssi"][d, node] = t, rssi

    def _biases(self, d: np.ndarray) -> np.ndarray:
        """What distances of each node are divided by, from the pins near the last position."""
        s, own = self.s, self.set
        n = int(s["pins"][d].max(initial=0))
        if not n:
            return np.ones((len(d), self.size["N"]))
        pin = s["pin_at"][d, :n]
        true = np.sqrt(((pin[:, :, None, :] - self.scene.place) ** 2).sum(-1))
        with np.errstate(invalid="ignore", divide="ignore"):
            mean, snap = s["pin_sum"][d, :n] / s["pin_n"][d, :n], s["pin_snap"][d, :n] / true
        low, high = own.pin_bias
        learned = (s["pin_n"][d, :n] >= own.pin_samples) & (mean >= low) & (mean <= high)
        usable = (true >= own.pin_least_distance) & (learned | ((snap >= low) & (snap <= high)))
        bias, samples = np.where(learned, mean, snap), np.where(learned, s["pin_n"][d, :n], 1.0)
        last = np.nan_to_num(s["at"][d])  # the origin before there is a place
        gap = np.sqrt(((pin - last[:, None, :]) ** 2).sum(-1))
        weight = np.where(usable, np.exp(-((gap / own.pin_reach) ** 2))[:, :, None] * (0.2 + 0.8 * np.minimum(own.pin_full, samples) / own.pin_full), 0.0)
        total = weight.sum(1)
        known = total >= own.pin_least_weight
        pooled = np.where(known, (weight * np.where(usable, bias, 0.0)).sum(1) / np.where(known, total, 1.0), 1.0)
        shrunk = 1 + np.where(known, np.minimum(1, total), 0.0) * (pooled - 1)
        return np.where(shrunk > own.bias_least, shrunk, 1.0)

    def _fixes(self, d: np.ndarray, t: np.ndarray) -> Fixes:
        s, scene = self.s, self.scene
        on = ~np.isnan(s["mean"][d]) & (s["heard"][d] >= (t - self.set.stale_ms)[:, None])
        distance = np.where(on, np.where(on, s["mean"][d], 1.0) / self._biases(d), 0.0)
        wide = lambda x: np.broadcast_to(x, on.shape)
        none = np.zeros((*on.shape, 0))
        place = scene.place
        return Fixes(
            wide(place[:, 0]), wide(place[:, 1]), wide(place[:, 2]), distance, np.ones(on.shape), on, none, none, none, none, np.zeros(len(d), bool), s["rssi"][d],
            wide(place[:, 0]), wide(place[:, 1]), wide(scene.node_room), np.broadcast_to(scene.pair_r2, (len(d), *scene.pair_r2.shape)), np.full(on.shape, np.nan), scene.house,
        )

    def _active(self, d: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The first open pin of each device, or -1."""
        until = self.s["pin_until"][d] > t[:, None]
        return np.where(until.any(1), until.argmax(1), -1)

    def _learn(self, d, t, node, found, solved) -> np.ndarray:
        """Active pins take the sample in, or are let go; which devices have learned."""
        s, own = self.s, self.set
        pin = self._active(d, t)
        on = (pin >= 0) & (node >= 0)
        on[on] &= ~np.isnan(s["mean"][d[on], node[on]])
        i = np.flatnonzero(on)
        spot = s["pin_at"][d[i], pin[i]]
        near = ~solved[i] | (np.hypot(found[i, 0] - spot[:, 0], found[i, 1] - spot[:, 1]) <= own.pin_leave)
        s["pin_until"][d[i[~near]], pin[i[~near]]] = 0
        i, spot = i[near], spot[near]
        true = np.sqrt(((spot - self.scene.place[node[i]]) ** 2).sum(1))
        bias = s["mean"][d[i], node[i]] / np.maximum(true, 1e-300)
        fine = (s["mean"][d[i], node[i]] > 0) & (true >= own.pin_least_distance) & (bias >= own.pin_bias[0]) & (bias <= own.pin_bias[1])
        i, bias = i[fine], bias[fine]
        at = d[i], pin[i], node[i]
        full = np.where(s["pin_n"][at] >= own.pin_most, (own.pin_most - 1) / own.pin_most, 1.0)
        s["pin_n"][at] = np.where(full < 1, own.pin_most - 1, s["pin_n"][at]) + 1
        s["pin_sum"][at] = s["pin_sum"][at] * full + bias
        s["pin_until"][d[i], pin[i]] = t[i] + own.pin_ms
        out = np.zeros(len(d), bool)
        out[i] = True
        return out

    def _filter(self, d, t, found, confidence) -> None:
        """Moves the filtered places on to the solved ones."""
        s, own = self.s, self.set
        sigma2 = (own.noise / np.maximum(0.1, confidence)) ** 2
        step = t - s["kalman_ms"][d]
        anew = np.isnan(s["kalman"][d, 0]) | ~((step >= 0) & (step < own.gap_ms))
        dt = np.where(anew, 0.0, np.minimum(own.longest_step_s, np.nan_to_num(step) / 1000))
        x = np.where(anew[:, None], 0.0, s["kalman"][d])
        pp, pv, vv = s["cov"][d].T  # the same for all axes
        q = own.acceleration**2
        pp, pv, vv = pp + 2 * dt * pv + dt * dt * vv + q * dt**4 / 4, pv + dt * vv + q * dt**3 / 2, vv + q * dt * dt
        ahead = x[:, :3] + dt[:, None] * x[:, 3:]
        off = found - ahead
        gain, drift = pp / (pp + sigma2), pv / (pp + sigma2)
        new = np.concatenate([ahead + gain[:, None] * off, x[:, 3:] + drift[:, None] * off], 1)
        cov = np.stack([pp - gain * pp, pv - gain * pv, vv - drift * pv], 1)
        start = np.concatenate([found, np.zeros((len(d), 3))], 1)
        s["kalman"][d] = np.where(anew[:, None], start, new)
        s["cov"][d] = np.where(anew[:, None], np.stack([sigma2, np.zeros(len(d)), np.full(len(d), own.start_speed**2)], 1), cov)
        s["kalman_ms"][d] = t
        if own.position_filter == "kalman":
            s["at"][d] = s["kalman"][d, :3]
        elif own.position_filter == "ema":
            gap = np.maximum(t - s["at_ms"][d], 0)
            fresh = np.isnan(s["at"][d, 0]) | ~(gap < own.gap_ms)
            share = np.clip((1 - np.exp(-np.where(fresh, 0, gap) / own.place_tau_ms)) * np.clip(confidence, 0, 1), own.place_least, 1)
            s["at"][d] = np.where(fresh[:, None], found, s["at"][d] + share[:, None] * (found - s["at"][d]))
        else:
            s["at"][d] = found
        s["at_ms"][d] = t

    def _resolve(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Room (or the number of rooms) and floor (or -1) of places: the first floor at that height with a room there, else the first floor."""
        scene, none = self.scene, len(self.scene.house.rooms)
        room, floor = np.full(len(at), none), self._level(at[:, 2])
        inside = self._inside(at[:, 0], at[:, 1])
        for k, (_, low, high) in enumerate(scene.floors):
            own = inside & (scene.room_floor == k) & ((at[:, 2] >= low) & (at[:, 2] <= high))[:, None]
            new = (room == none) & own.any(1)
            room, floor = np.where(new, own.argmax(1), room), np.where(new, k, floor)
        return room, floor

    def _level(self, z: np.ndarray) -> np.ndarray:
        """The first floor at a height, or -1."""
        fits = np.array([[(z >= low) & (z <= high)] for _, low, high in self.scene.floors]).reshape(len(self.scene.floors), len(z))
        return np.where(fits.any(0), fits.argmax(0), -1)

    def _inside(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which rooms are around each place: (place, room)."""
        out = np.zeros((len(x), len(self.scene.house.rooms)), bool)
        for i, edges in enumerate(self.scene.house.edges):
            for ax, ay, bx, by in edges:
                out[:, i] ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay if by != ay else 1.0) + ax)
        return out

    def _hold(self, d, t, room, floor) -> tuple[np.ndarray, np.ndarray]:
        """The room that is held: a new one must last first, longer if no door leads there."""
        s, own = self.s, self.set
        if own.room_ms <= 0 and own.room_far_ms <= 0:
            return room, floor
        held, none = s["room"][d], self.size["S"] - 1
        first, same = held < 0, held == room
        waiting = ~first & ~same
        fresh = waiting & (s["wish"][d] != room)
        s["wish"][d] = np.where(waiting, np.where(fresh, room, s["wish"][d]), -1)
        s["wish_ms"][d] = np.where(fresh, t, s["wish_ms"][d])
        far = (held >= 0) & (held < none) & (room < none) & ~self.scene.graph[np.maximum(held, 0).astype(int), room]
        need = np.where(far & (own.room_far_ms > 0), max(own.room_ms, own.room_far_ms), own.room_ms)
        go = first | same | (waiting & ~fresh & ((need <= 0) | (t - s["wish_ms"][d] >= need)))
        s["wish"][d] = np.where(go, -1, s["wish"][d])
        s["room"][d], s["floor"][d] = np.where(go, room, held), np.where(go, floor, s["floor"][d])
        return s["room"][d].astype(int), s["floor"][d].astype(int)

    def _shortest(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distance to each room's outline and the closest point there: (place, room)."""
        n, m = len(x), len(self.scene.house.rooms)
        best, px, py = np.full((n, m), np.inf), np.zeros((n, m)), np.zeros((n, m))
        for i, edges in enumerate(self.scene.house.edges):
            for ax, ay, bx, by in edges:
                ux, uy = bx - ax, by - ay
                long = ux * ux + uy * uy
                k = np.clip(((x - ax) * ux + (y - ay) * uy) / long, 0, 1) if long >= 1e-12 else np.zeros(n)
                cx, cy = ax + k * ux, ay + k * uy
                gap = (cx - x) ** 2 + (cy - y) ** 2
                closer = gap < best[:, i]
                best[:, i], px[:, i], py[:, i] = np.where(closer, gap, best[:, i]), np.where(closer, cx, px[:, i]), np.where(closer, cy, py[:, i])
        return np.sqrt(best), px, py

    def forward(self, chance: np.ndarray, x: np.ndarray, y: np.ndarray, inside: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """Room probabilities after one more place; rows of `chance` that are NaN start uniform."""
        own, n = self.set, self.size["S"]
        way = np.broadcast_to(self.base, (len(x), n, n)).copy()
        for a, b, dx, dy, width in self.gates:
            value = np.full(len(x), width)
            if dx is not None:
                value = width * np.maximum(own.door_floor, np.exp(-np.hypot(x - dx, y - dy) / own.door_sigma))
            way[:, a, b] = way[:, b, a] = value
        way /= way.sum(2, keepdims=True)
        ahead = np.where(np.isnan(chance[:, :1]), 1 / n, np.einsum("df,dft->dt", np.nan_to_num(chance), way))
        seen = np.concatenate([np.where(inside, 1.0, np.exp(-gap)), np.where(inside.any(1), 0.01, 0.5)[:, None]], 1)
        out = ahead * seen
        total = out.sum(1, keepdims=True)
        return np.where(total > 0, out / np.where(total > 0, total, 1.0), 1 / n)

    def _commit(self, d, t, chance) -> np.ndarray:
        """The room that is reported: the most probable one once it leads by a margin or for long enough."""
        s, own = self.s, self.set
        top, kept = chance.argmax(1), s["kept"][d].astype(int)
        first, same = kept < 0, kept == top
        turn = ~first & ~same
        fresh = turn & (s["next"][d] != top)
        s["next_ms"][d] = np.where(fresh, t, np.where(turn, s["next_ms"][d], 0))
        s["next"][d] = np.where(turn, top, -1)
        row = np.arange(len(d))
        lead = chance[row, top] - chance[row, np.maximum(kept, 0)] >= own.commit_margin
        go = first | (turn & (lead | (t - s["next_ms"][d] >= own.commit_ms)))
        s["kept"][d] = np.where(go, top, kept)
        s["next"][d], s["next_ms"][d] = np.where(go, -1, s["next"][d]), np.where(go, 0, s["next_ms"][d])
        return s["kept"][d].astype(int)

    def _blend(self, chance, x, y, inside, px, py) -> np.ndarray:
        """The mean of the places closest to `at` in every likely room."""
        use = np.where(chance >= self.set.blend_least, chance, 0.0)
        cx, cy = (np.concatenate([np.where(inside, c[:, None], p), c[:, None]], 1) for c, p in ((x, px), (y, py)))
        total = use.sum(1)
        safe = np.where(total > 0, total, 1.0)
        return np.stack([np.where(total > 0, (use * c).sum(1) / safe, own) for c, own in ((cx, x), (cy, y))], 1)

    def _tell(self, d, room, floor, key: str) -> tuple[list[str], np.ndarray]:
        """The states that devices report, and which are news."""
        s, house, none = self.s, self.scene.house, self.size["S"] - 1
        floor = np.where(room < none, -1, floor)  # a room tells all
        news = (s[key][d] != room) | (s[f"{key}_floor"][d] != floor)
        # without room and floor it is the same as being away
        nowhere = (room >= none) & (floor < 0)
        news &= ~(nowhere & (s[key][d] == self.size["S"]))
        s[key][d], s[f"{key}_floor"][d] = np.where(nowhere, self.size["S"], room), floor
        return [house.rooms[r] if r < none else self.scene.floors[f][0] if f >= 0 else AWAY for r, f in zip(room, floor, strict=True)], news

    def step(self, d: np.ndarray, t: np.ndarray, node: np.ndarray, distance: np.ndarray, rssi: np.ndarray) -> dict:
        """One message of each of the devices d (all different): their places, rooms and states."""
        s, none = self.s, self.size["S"] - 1
        s["seen"][d] = t
        self._hear(d, t, node, distance, rssi)
        fixes = self._fixes(d, t)
        found = room_aware(fixes)
        solved = ~np.isnan(found.at[:, 0])
        learned = self._learn(d, t, node, found.at, solved)
        n = len(d)
        out = {"fixes": fixes.count, "on": fixes.on, "d": fixes.d, "raw": found.at, "confidence": np.where(solved, found.confidence, np.nan), "room": np.full(n, -1), "floor": np.full(n, -1), "state": np.full(n, None, object), "changed": np.zeros(n, bool)}
        out |= {"smart": np.full((n, 2), np.nan), "smart_room": np.full(n, -1), "smart_chance": np.full(n, np.nan), "smart_state": np.full(n, None, object), "smart_changed": np.zeros(n, bool)}
        g = np.flatnonzero(solved)
        if len(g):
            own, now = d[g], t[g]
            # the tracker by probabilities sees what pins have just learned
            inner, again = found.at[g].copy(), np.flatnonzero(learned[g])
            if len(again):
                inner[again] = room_aware(self._fixes(own[again], now[again])).at
            pin = self._active(own, now)
            free, fast = np.flatnonzero(pin < 0), np.flatnonzero(pin >= 0)
            self._filter(own[free], now[free], found.at[g[free]], found.confidence[g[free]])
            spot = s["pin_at"][own[fast], pin[fast]]
            s["kalman"][own[fast]] = np.concatenate([spot, np.zeros((len(fast), 3))], 1)
            s["kalman_ms"][own[fast]] = now[fast]
            s["at"][own[fast]], s["at_ms"][own[fast]] = spot, now[fast]
            out["confidence"][g[fast]] = 1.0

            room, floor = self._hold(own, now, *self._resolve(found.at[g]))
            out["room"][g], out["floor"][g] = room, floor
            out["state"][g], out["changed"][g] = self._tell(own, room, floor, "told")

            x, y = inner[:, 0], inner[:, 1]
            inside = self._inside(x, y)
            gap, px, py = self._shortest(x, y)
            chance = self.forward(s["chance"][own], x, y, inside, gap)
            s["chance"][own] = chance
            kept = self._commit(own, now, chance)
            out["smart"][g], out["smart_room"][g] = self._blend(chance, x, y, inside, px, py), kept
            out["smart_chance"][g] = chance[np.arange(len(g)), kept]
            floor = np.where(kept < none, self.scene.room_floor[np.minimum(kept, none - 1)], self._level(inner[:, 2]))
            out["smart_state"][g], out["smart_changed"][g] = self._tell(own, kept, floor, "smart")
        out["at"] = s["at"][d].copy()
        pin = self._active(d, t)
        out["pin"] = np.where(pin >= 0, s["pin_ms"][d, np.maximum(pin, 0)], np.nan)
        out["pin_n"] = np.where(pin >= 0, s["pin_n"][d, np.maximum(pin, 0)].sum(1), np.nan)
        return out

    # --- rows in, rows out

    def run(self, batch: pa.RecordBatch) -> list[dict]:
        """Handles rows (device_id, kind, seq, t_ms, node_id, distance, rssi, x, y, z) in order; column dictionaries of what came of them."""
        c = {k: batch.column(k) for k in batch.schema.names}
        names = c["device_id"].to_pylist()
        d = self.devices(names)
        t = c["t_ms"].to_numpy().astype(np.int64)
        seq = c["seq"].to_numpy().astype(np.int64)
        kind = np.array(c["kind"].to_pylist(), object)
        node = np.array([self.node.get(x, -1) for x in c["node_id"].to_pylist()], np.int64)
        distance, rssi, x, y, z = (c[k].to_numpy(zero_copy_only=False).astype(np.float64) for k in ("distance", "rssi", "x", "y", "z"))
        distance = np.where(np.isfinite(distance), distance, np.nan)
        order = np.argsort(d, kind="stable")
        first = np.searchsorted(d[order], d[order])
        turn = np.empty(len(d), np.int64)
        turn[order] = np.arange(len(d)) - first
        out = []
        by_turn = np.argsort(turn, kind="stable")
        for rows in np.split(by_turn, np.flatnonzero(np.diff(turn[by_turn])) + 1):
            rows = np.sort(rows)
            gone, due = self.away(d[rows], t[rows])
            if len(gone):
                out.append(self._away_rows(gone, due))
            for i in rows[kind[rows] != "message"]:
                if kind[i] == "record":
                    self.record(d[i], t[i], (x[i], y[i], z[i]))
                elif kind[i] == "activate":
                    self.activate(d[i], t[i], self.nearest_pin(d[i], x[i], y[i]))
                elif kind[i] == "deactivate":
                    self.deactivate(d[i])
            rows = rows[kind[rows] == "message"]
            if len(rows):
                out.append(self._message_rows(rows, [names[i] for i in rows], seq, t, node, c["node_id"], self.step(d[rows], t[rows], node[rows], distance[rows], rssi[rows])))
        return out

    def _message_rows(self, rows, names, seq, t, node, node_ids, got) -> dict:
        none = self.size["S"] - 1
        rooms = np.array([*self.scene.house.rooms, None, None], object)
        smart = np.array([*self.scene.house.rooms, OUTSIDE, None], object)
        floors = np.array([*[f[0] for f in self.scene.floors], None], object)
        solved = ~np.isnan(got["raw"][:, 0])
        pinned = solved & ~np.isnan(got["pin"])
        on = got["on"]
        place = np.nonzero(on)
        heard = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(on.sum(1))]), pa.int32()),
            pa.StructArray.from_arrays([pa.array([self.scene.nodes[i] for i in place[1]], pa.string()), pa.array(got["d"][on]), pa.array(self.s["rssi"][[self.row[x] for x in names]][on], from_pandas=True)], ["node_id", "d", "rssi"]),
        )
        opt = lambda v: pa.array(np.asarray(v, np.float64), from_pandas=True)
        whole = lambda v: pa.array([None if np.isnan(a) else int(a) for a in v], pa.int64())
        return {
            "device_id": names, "kind": ["message"] * len(rows), "seq": seq[rows], "t_ms": t[rows], "node_id": node_ids.take(pa.array(rows)), "fixes": got["fixes"],
            "raw_x": opt(got["raw"][:, 0]), "raw_y": opt(got["raw"][:, 1]), "raw_z": opt(got["raw"][:, 2]), "confidence": opt(got["confidence"]),
            "x": opt(got["at"][:, 0]), "y": opt(got["at"][:, 1]), "z": opt(got["at"][:, 2]),
            "algorithm": [None if not a else "pin_anchored" if b else "room_aware" for a, b in zip(solved, pinned, strict=True)],
            "room_id": rooms[got["room"]].tolist(), "floor_id": floors[got["floor"]].tolist(), "state": got["state"].tolist(), "changed": got["changed"],
            "smart_x": opt(got["smart"][:, 0]), "smart_y": opt(got["smart"][:, 1]), "smart_room": smart[np.where(got["smart_room"] < 0, none + 1, got["smart_room"])].tolist(), "smart_chance": opt(got["smart_chance"]),
            "smart_state": got["smart_state"].tolist(), "smart_changed": got["smart_changed"], "pin_ms": whole(got["pin"]), "pin_samples": whole(got["pin_n"]), "heard": heard,
        }

    def _away_rows(self, d: np.ndarray, due: np.ndarray) -> dict:
        names = list(self.row)
        n = len(d)
        return {"device_id": [names[i] for i in d], "kind": ["away"] * n, "t_ms": due.astype(np.int64), "state": [AWAY] * n, "changed": np.ones(n, bool), "smart_state": [AWAY] * n, "smart_changed": np.ones(n, bool)}

    def finish(self, until: float) -> list[dict]:
        """Devices that are away at `until`, and every pin with what it has learned."""
        d = np.arange(len(self.row))
        gone, due = self.away(d, np.full(len(d), until))
        out = [self._away_rows(gone, due)] if len(gone) else []
        names = list(self.row)
        which = [(i, k) for i in d for k in range(int(self.s["pins"][i]))]
        if which:
            i, k = np.array(which).T
            at, n = self.s["pin_at"][i, k], self.s["pin_n"][i, k].sum(1)
            out.append({"device_id": [names[a] for a in i], "kind": ["pin"] * len(i), "t_ms": self.s["pin_until"][i, k].astype(np.int64), "x": at[:, 0], "y": at[:, 1], "z": at[:, 2], "pin_ms": self.s["pin_ms"][i, k].astype(np.int64), "pin_samples": n.astype(np.int64)})
        return out

    # --- one device's state as bytes, for state stores

    def dump(self, device: str) -> bytes:
        i = self.row[device]
        return np.concatenate([[self.size["P"]], *[self.s[k][i].ravel() for k in STATE]]).astype(np.float64).tobytes()

    def load(self, device: str, data: bytes) -> None:
        values = np.frombuffer(data, np.float64)
        while self.size["P"] < values[0]:
            self._room_for_pins()
        i, own, at = int(self.devices([device])[0]), self.size | {"P": int(values[0])}, 1
        for k, (shape, _) in STATE.items():
            dims = tuple(own.get(x, x) for x in shape)
            n = int(np.prod(dims, dtype=np.int64))
            part = values[at : at + n].reshape(dims)
            if "P" in shape:
                self.s[k][i] = STATE[k][1]
                self.s[k][i, : dims[0]] = part
            else:
                self.s[k][i] = part
            at += n


def to_batches(parts: list[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of column dictionaries; columns that are left out are null."""
    for part in parts:
        n = len(part["device_id"])
        arrays = []
        for f in schema:
            value = part.get(f.name)
            value = pa.nulls(n, f.type) if value is None else value if isinstance(value, (pa.Array, pa.ChunkedArray)) else pa.array(value, f.type)
            arrays.append(value if value.type == f.type else value.cast(f.type))
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)


MESSAGES = "SELECT device_id, 'message' AS kind, seq, CAST(t_ms AS BIGINT) AS t_ms, node_id, distance, CAST(rssi AS DOUBLE) AS rssi, CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS y, CAST(NULL AS DOUBLE) AS z FROM obs"
ACTIONS = "SELECT device_id, kind, CAST(seq AS BIGINT), CAST(t_ms AS BIGINT), CAST(NULL AS STRING), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), x, y, 0.0D FROM pin_actions"


def events(spark, sf_dir: str, pins: bool = True, own: dict[str, str] | None = None) -> DataFrame:
    """Messages and what users do with pins, as one table."""
    return spark_sql(with_(f"{MESSAGES} UNION ALL {ACTIONS}" if pins else MESSAGES, scene=own))(spark, sf_dir)


def replay(rows: DataFrame, scene: Scene, settings: Settings = Settings(), until_ms: int | None = None, heard: bool = False) -> DataFrame:  # noqa: B008
    """A row for every message (and for every device that goes away, and every pin at the end) of rows as `events` makes them.

    At equal times what users do comes before messages.  `heard` adds the fixes
    as the locator saw them.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = HEARD if heard else OUT
    schema = to_arrow_schema(_parse_datatype_string(fields))
    shared = rows.sparkSession.sparkContext.broadcast(scene)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tracker = Tracker(shared.value, settings)
        for batch in batches:
            if batch.num_rows:
                yield from to_batches(tracker.run(batch), schema)
        if tracker.row:
            yield from to_batches(tracker.finish(-np.inf if until_ms is None else until_ms), schema)

    own = rows.select("device_id", "kind", "seq", "t_ms", "node_id", "distance", "rssi", "x", "y", "z")
    return dealt(own, "device_id").sortWithinPartitions("t_ms", F.col("kind") == "message", "seq").mapInArrow(run, fields)


#: The clock of the test tables runs 50,000 times too fast, so whoever is silent for 1.2 s is away.
QUICK = Settings(room_ms=100, room_far_ms=400, away_ms=1200, cleanup_ms=300, commit_ms=300)


def tracked(spark, sf_dir: str, settings: Settings = QUICK, own: dict[str, str] | None = None) -> DataFrame:
    """The replay of a folder's messages and pins, with everyone away at its end who has been silent for long enough."""
    until = spark_sql(with_("SELECT CAST(max(t_ms) AS BIGINT) AS t FROM obs"))(spark, sf_dir).first().t
    return replay(events(spark, sf_dir, own=own), scene_of(spark, sf_dir, own), settings, until)


def _rounded(*names: str) -> list:
    return [F.round(x, 6).alias(x) for x in names]


def _positions(spark, sf_dir: str) -> DataFrame:
    own = tracked(spark, sf_dir).filter("kind = 'message' AND raw_x IS NOT NULL")
    return own.select("device_id", "seq", "t_ms", "fixes", *_rounded("raw_x", "raw_y", "raw_z", "confidence", "x", "y", "z"), "algorithm", "room_id", "floor_id")


def _posterior(spark, sf_dir: str) -> DataFrame:
    return tracked(spark, sf_dir).filter("smart_room IS NOT NULL").select("device_id", "seq", "t_ms", *_rounded("smart_x", "smart_y", "smart_chance"), "smart_room")


def _presence(spark, sf_dir: str) -> DataFrame:
    """What devices report when it changes: by the held room, and by room probabilities; not_home also of devices that fall silent."""
    told = tracked(spark, sf_dir).filter("changed OR smart_changed")
    news = F.explode(F.array(*[F.struct(F.lit(e).alias("entity"), F.col(s).alias("state"), F.col(c).alias("news")) for e, s, c in (("location", "state", "changed"), ("smart", "smart_state", "smart_changed"))]))
    return told.select("device_id", "t_ms", "kind", news.alias("n")).filter("n.news").select("device_id", "t_ms", "kind", "n.entity", "n.state")


def _pin_book(spark, sf_dir: str) -> DataFrame:
    return tracked(spark, sf_dir).filter("kind = 'pin'").select("device_id", "pin_ms", *_rounded("x", "y", "z"), F.col("t_ms").alias("active_until_ms"), F.col("pin_samples").alias("samples"))


def _upstream_offsets(spark, sf_dir: str) -> DataFrame:
    """Each upstream place against the device's active place when it arrived."""
    at = tracked(spark, sf_dir).filter("kind = 'message' AND x IS NOT NULL").select("device_id", "t_ms", "seq", "x", "y")
    up = spark_sql(with_("SELECT device_id, CAST(t_ms AS BIGINT) AS t_ms, CAST(seq AS BIGINT) AS seq, x AS ux, y AS uy FROM upstream"))(spark, sf_dir)
    both = at.select("*", F.lit(None).cast("double").alias("ux"), F.lit(None).cast("double").alias("uy")).unionByName(up.withColumns({"x": F.lit(None).cast("double"), "y": F.lit(None).cast("double")}))
    past = Window.partitionBy("device_id").orderBy("t_ms", F.col("ux").isNotNull(), "seq").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumns({"x": F.last("x", True).over(past), "y": F.last("y", True).over(past)}).filter("ux IS NOT NULL AND x IS NOT NULL")
    return seen.select("device_id", "seq", F.round(F.hypot(F.col("ux") - F.col("x"), F.col("uy") - F.col("y")), 6).alias("off"))


QUERIES = {
    "w01_replayed_positions": _positions,
    "l12_bayesian": _posterior,
    "w09_presence_log": _presence,
    "m02_pin_book": _pin_book,
    "j19_upstream_offsets": _upstream_offsets,
}

__all__ = ["AWAY", "HEARD", "OUT", "Scene", "Settings", "Tracker", "events", "replay", "scene_of", "to_batches"]
