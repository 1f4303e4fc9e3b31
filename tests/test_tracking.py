"""The replay of positions against a plain scalar one that handles one message after the other."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest

from rangefield.functions.dialect import spark_sql
from rangefield.operators import tracking
from rangefield.plans.relations import with_
from rangefield.sources import config

SMALL = "/root/testdata/sf0.001"
SET = tracking.Settings(room_ms=100, room_far_ms=400, away_ms=1200, cleanup_ms=300, commit_ms=300, pin_ms=2500, stale_ms=2000, pin_most=20)


def inside(x, y, corners):
    out = False
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            out = not out
    return out


def closest(x, y, corners):
    best = (math.inf, None)
    for (ax, ay), (bx, by) in zip(corners[-1:] + corners[:-1], corners, strict=True):
        ux, uy = bx - ax, by - ay
        k = max(0.0, min(1.0, ((x - ax) * ux + (y - ay) * uy) / (ux * ux + uy * uy)))
        p = ax + k * ux, ay + k * uy
        best = min(best, ((p[0] - x) ** 2 + (p[1] - y) ** 2, p), key=lambda b: b[0])
    return math.sqrt(best[0]), best[1]


class House:
    """The scene as plain lists and dictionaries."""

    def __init__(self, ask):
        self.nodes = {r.node_id: (r.x, r.y, r.z) for r in ask("SELECT * FROM node_rooms WHERE enabled ORDER BY ord")}
        self.node_room = {r.node_id: r.room_id for r in ask("SELECT * FROM node_rooms WHERE enabled")}
        self.rooms = defaultdict(list)
        for r in ask("SELECT * FROM vertices ORDER BY ord, v"):
            self.rooms[r.room_id].append((r.x, r.y))
        self.floors = [tuple(r) for r in ask("SELECT floor_id, z0, z1 FROM floors ORDER BY ord")]
        self.floor_of = {r.room_id: r.floor_id for r in ask("SELECT room_id, floor_id FROM room_floors")}
        self.trust = {(r.a, r.b) for r in ask("SELECT a, b FROM trust2")}
        self.r2 = defaultdict(float)
        for r in ask("SELECT listener_id, transmitter_id, r2 FROM pair_fits"):
            self.r2[r.listener_id, r.transmitter_id] = r.r2
        self.doors, self.ways = {}, defaultdict(set)
        names = {r.room_name: r.room_id for r in ask("SELECT room_id, room_name FROM rooms")}
        for r in ask("SELECT * FROM open_to"):
            other = names.get(r.target, r.target)
            self.doors[frozenset((r.room_id, other))] = (r.door_x, r.door_y, r.width)
        for r in ask("SELECT a, b FROM walk"):
            self.ways[r.a].add(r.b)
            self.ways[r.b].add(r.a)

    def level(self, z):
        return next((f for f, lo, hi in self.floors if (lo is None or z >= lo) and (hi is None or z <= hi)), None)

    def where(self, x, y, z):
        for f, lo, hi in self.floors:
            if (lo is None or z >= lo) and (hi is None or z <= hi):
                for room, corners in self.rooms.items():
                    if self.floor_of[room] == f and inside(x, y, corners):
                        return room, f
        return None, self.level(z)

    def any_room(self, x, y):
        return any(inside(x, y, c) for c in self.rooms.values())

    def hops(self, a):
        out, front = {a: 0}, [a]
        while front:
            front = [y for x in front for y in self.ways[x] if y not in out and not out.update({y: out[x] + 1})]
        return out

    def solve(self, fixes):
        """The active locator over [(node, distance)]."""
        if len(fixes) < 2:
            return None
        at = self.nodes
        pull = [1 / (d * d + 1e-6) for _, d in fixes]
        plain = [sum(w * at[n][k] for w, (n, _) in zip(pull, fixes, strict=True)) / sum(pull) for k in range(3)]
        votes = {}
        for n, d in sorted(fixes, key=lambda f: f[1])[:3]:
            if self.node_room[n]:
                votes[self.node_room[n]] = votes.get(self.node_room[n], 0) + 1 / (d * d + 1e-6)
        home = max(votes, key=votes.get) if votes else None
        tied = lambda r: home is not None and r is not None and (r == home or (home, r) in self.trust)
        sums = [0.0, 0.0, 0.0]
        for i, (a, ra) in enumerate(fixes):
            for b, rb in fixes[i + 1 :]:
                g = math.dist(at[a][:2], at[b][:2])
                if g < 1e-6 or g > ra + rb or g < abs(ra - rb):
                    continue
                h = (ra * ra - rb * rb + g * g) / (2 * g)
                up = math.sqrt(max(0.0, ra * ra - h * h))
                ex, ey = (at[b][0] - at[a][0]) / g, (at[b][1] - at[a][1]) / g
                cosine = (ra * ra + rb * rb - g * g) / (2 * ra * rb)
                quality = max(0.01, 1 - cosine * cosine) / (ra * rb) * (0.5 + 0.5 * max(self.r2[a, b], self.r2[b, a]))
                ta, tb = tied(self.node_room[a]), tied(self.node_room[b])
                rooms = 0.3 if home is None or ta != tb else 0.005 if not ta else 1.0 if self.node_room[a] == self.node_room[b] == home else 0.8
                for s in (up, -up):
                    px, py = at[a][0] + h * ex - s * ey, at[a][1] + h * ey + s * ex
                    extra = 0.0
                    for n, d in fixes:
                        off = abs(math.dist((px, py), at[n][:2]) - d)
                        if n not in (a, b) and off <= 0.15 * d:
                            extra += (1.0 if tied(self.node_room[n]) else 0.3) * (1 - off / (0.15 * d))
                    w = quality * rooms * (1 + extra)
                    sums = [sums[0] + w, sums[1] + w * px, sums[2] + w * py]
        if not sums[0]:
            return (*plain, 0.3)
        x, y = sums[1] / sums[0], sums[2] / sums[0]
        own = [abs(math.dist((x, y), at[n][:2]) - d) < 1.5 for n, d in fixes if tied(self.node_room[n])]
        return x, y, plain[2], min(1.0, 0.6 * (sum(own) / len(own) if own else 0) + 0.4 * min(1, len(fixes) / 6))


class Device:
    def __init__(self, house, settings):
        self.h, self.o = house, settings
        self.near, self.pins = {}, []
        self.at = self.kalman = self.seen = self.held = self.wish = self.told = self.smart = None
        self.chance = self.kept = None
        self.next = (None, 0)

    def bias(self, node):
        weight = total = 0.0
        for p in self.pins:
            true = math.dist(p["at"], self.h.nodes[node])
            if true < 1:
                continue
            n, added = p["learned"].get(node, (0, 0.0))
            value, count = (added / n, n) if n >= 5 and 0.2 <= added / n <= 5 else (p["snap"].get(node, -1) / true, 1)
            if not 0.2 <= value <= 5:
                continue
            w = math.exp(-((math.dist(p["at"], self.at or (0, 0, 0)) / 3) ** 2)) * (0.2 + 0.8 * min(50, count) / 50)
            weight, total = weight + w * value, total + w
        if total < 0.05:
            return 1.0
        out = 1 + min(1, total) * (weight / total - 1)
        return out if out > 0.1 else 1.0

    def fixes(self, now):
        return [(n, self.near[n]["mean"] / self.bias(n)) for n in self.h.nodes if n in self.near and self.near[n]["mean"] is not None and self.near[n]["seen"] >= now - self.o.stale_ms]

    def open_pin(self, now):
        return next((p for p in self.pins if p["until"] > now), None)

    def act(self, kind, now, x, y):
        if kind == "record":
            snap = {n: m["mean"] for n, m in self.near.items() if m["mean"] is not None}
            if not snap:
                return
            for p in self.pins:
                if p["until"] > now:
                    p["until"] = 0
            found = next((p for p in self.pins if math.dist(p["at"][:2], (x, y)) < 1), None)
            if found is None:
                found = {"at": (x, y, 0.0), "set": now, "learned": {}}
                self.pins.append(found)
            found |= {"snap": snap, "until": now + self.o.pin_ms}
        elif kind == "activate" and self.pins:
            stamp = min(self.pins, key=lambda p: math.dist(p["at"][:2], (x, y)))["set"]
            for p in self.pins:
                if p["set"] == stamp:
                    p["until"], spot = now + self.o.pin_ms, p["at"]
                elif p["until"] > now:
                    p["until"] = 0
            if self.kalman:
                self.kalman[0] = [*spot, 0, 0, 0]
            self.at = spot
        elif kind == "deactivate":
            for p in self.pins:
                p["until"] = 0

    def silent(self, now):
        """The tick at which the device was found to be away, up to now."""
        if self.seen is None or self.at is None:
            return None
        tick = 0
        while tick - self.seen <= self.o.away_ms:
            tick += self.o.cleanup_ms
        if tick > now:
            return None
        self.at = self.kalman = self.held = self.wish = None
        self.told = self.smart = "not_home"
        return tick

    def message(self, now, node, distance):
        self.seen = now
        if node in self.h.nodes:
            old = self.near.get(node, {"mean": None})
            new = {"mean": distance, "seen": now, "var": 0.0}
            if distance is not None and old["mean"] is not None and now - old["seen"] < 30000:
                share = min(1, max(0.05, 1 - math.exp(-max(0, now - old["seen"]) / 2000)))
                new["mean"] = old["mean"] + share * (distance - old["mean"])
            self.near[node] = new
        fixes = self.fixes(now)
        found = self.h.solve(fixes)
        pin = self.open_pin(now)
        if pin and distance is not None and node in self.h.nodes:
            if found is None or math.dist(found[:2], pin["at"][:2]) <= 8:
                true = math.dist(pin["at"], self.h.nodes[node])
                value = self.near[node]["mean"] / true if true else 0
                if true >= 1 and 0.2 <= value <= 5:
                    n, total = pin["learned"].get(node, (0, 0.0))
                    if n >= self.o.pin_most:
                        n, total = self.o.pin_most - 1, total * (self.o.pin_most - 1) / self.o.pin_most
                    pin["learned"][node] = (n + 1, total + value)
                    pin["until"] = now + self.o.pin_ms
            else:
                pin["until"] = 0
        out = {"fixes": len(fixes), "raw": found}
        if found is None:
            return out | {"at": self.at}
        x, y, z, sure = found
        inner = self.h.solve(self.fixes(now))
        pin = self.open_pin(now)
        if pin:
            self.kalman = [[*pin["at"], 0, 0, 0], self.kalman[1] if self.kalman else np.zeros((6, 6)), now]
            self.at = pin["at"]
        else:
            self.move(np.array([x, y, z]), sure, now)
            self.at = tuple(self.kalman[0][:3])
        room = self.hold(self.h.where(x, y, z), now)
        state = room[0] or room[1] or "not_home"
        out |= {"at": self.at, "room": room[0], "state": state, "changed": state != self.told, "pin": pin and pin["set"]}
        self.told = state
        smart, spot = self.forward(inner[0], inner[1], now)
        level = self.h.level(inner[2]) if smart == "outside" else None
        state = level or "not_home" if smart == "outside" else smart
        out |= {"smart": smart, "spot": spot, "chances": self.chance, "smart_state": state, "smart_changed": state != self.smart}
        self.smart = state
        return out

    def move(self, z, sure, now):
        r = (0.5 / max(0.1, sure)) ** 2
        if self.kalman is None or not 0 <= now - self.kalman[2] < 30000:
            self.kalman = [[*z, 0, 0, 0], np.diag([r] * 3 + [4.0] * 3), now]
            return
        dt = min(5, (now - self.kalman[2]) / 1000)
        f, eye = np.eye(6), np.eye(3)
        f[:3, 3:] = dt * eye
        q = 0.25 * np.block([[dt**4 / 4 * eye, dt**3 / 2 * eye], [dt**3 / 2 * eye, dt**2 * eye]])
        x, p = f @ np.array(self.kalman[0]), f @ self.kalman[1] @ f.T + q
        gain = p[:, :3] @ np.linalg.inv(p[:3, :3] + r * eye)
        self.kalman = [list(x + gain @ (z - x[:3])), p - gain @ p[:3], now]

    def hold(self, raw, now):
        if self.held is None or raw[0] == self.held[0]:
            self.held, self.wish = raw, None
        elif self.wish is None or self.wish[0] != raw[0]:
            self.wish = (raw[0], now)
        else:
            far = self.held[0] and raw[0] and raw[0] not in self.h.ways[self.held[0]]
            if now - self.wish[1] >= (max(self.o.room_ms, self.o.room_far_ms) if far else self.o.room_ms):
                self.held, self.wish = raw, None
        return self.held

    def forward(self, x, y, now):
        states = [*self.h.rooms, "outside"]
        if self.chance is None:
            ahead = dict.fromkeys(states, 1 / len(states))
        else:
            ahead = dict.fromkeys(states, 0.0)
            for a in states:
                hops, row = self.h.hops(a), {a: 1.6}
                for b in states:
                    if b == a:
                        continue
                    if b in self.h.ways[a]:
                        door = self.h.doors.get(frozenset((a, b)))
                        row[b] = 0.8 if door is None else door[2] * (1.0 if door[0] <= -1e6 else max(0.05, math.exp(-math.dist(door[:2], (x, y)) / 1.5)))
                    else:
                        row[b] = 0.001 / (hops[b] - 1) ** 2 if hops.get(b, 0) >= 2 else 0.0
                for b in row:
                    ahead[b] += self.chance[a] * row[b] / sum(row.values())
        seen = {r: 1.0 if inside(x, y, c) else math.exp(-closest(x, y, c)[0]) for r, c in self.h.rooms.items()}
        seen["outside"] = 0.01 if self.h.any_room(x, y) else 0.5
        total = sum(ahead[s] * seen[s] for s in states)
        self.chance = {s: ahead[s] * seen[s] / total for s in states}
        top = max(states, key=self.chance.get)
        if self.kept is None or top == self.kept:
            self.kept, self.next = top, (None, 0)
        else:
            if self.next[0] != top:
                self.next = (top, now)
            if self.chance[top] - self.chance[self.kept] >= 0.15 or now - self.next[1] >= self.o.commit_ms:
                self.kept, self.next = top, (None, 0)
        px = py = total = 0.0
        for s, p in self.chance.items():
            if p >= 0.05:
                spot = (x, y) if s == "outside" or inside(x, y, self.h.rooms[s]) else closest(x, y, self.h.rooms[s])[1]
                px, py, total = px + p * spot[0], py + p * spot[1], total + p
        return self.kept, (px / total, py / total)


#: Inner walls where no mirrored place falls on one.
TWO_FLOORS = {
    "floors": [
        {"id": "down", "bounds": [[0, 0, 0], [12, 10, 1.4]], "rooms": [
            {"id": "ell", "name": "Ell", "points": [[0, 0], [12, 0], [12, 4.03], [5.07, 4.03], [5.07, 10], [0, 10]], "open_to": [{"id": "den", "door": [8.0, 4.03], "width": 1.0}, "outside"]},
            {"id": "den", "points": [[5.07, 4.03], [12, 4.03], [12, 10], [5.07, 10]], "open_to": ["loft"]}]},
        {"id": "up", "bounds": [[0, 0, 1.4], [12, 10, 5]], "rooms": [{"id": "loft", "points": [[0, 0], [12, 0], [12, 10], [0, 10]]}]}],
    "nodes": [{"id": f"n{i}", "point": [1 + (i * 5) % 11, 1 + (i * 3) % 9, 0.5 + i % 4]} for i in range(11)],
}


@pytest.mark.parametrize("own", [None, config.scene(config.validate(TWO_FLOORS))], ids=["six rooms", "two floors"])
def test_replay_equals_scalar(spark, own):
    ask = lambda sql: spark_sql(with_(sql, scene=own))(spark, SMALL).collect()
    scene = tracking.scene_of(spark, SMALL, own)
    rows = tracking.events(spark, SMALL, own=own)
    until = 60_000
    got = tracking.replay(rows, scene, SET, until, heard=True).collect()
    house, devices, told = House(ask), {}, []
    by_key = {(r.device_id, r.seq): r for r in got if r.kind == "message"}
    order = sorted(rows.collect(), key=lambda r: (r.t_ms, r.kind == "message", r.seq))
    kinds = set()
    for r in order:
        d = devices.setdefault(r.device_id, Device(house, SET))
        gone = d.silent(r.t_ms)
        if gone is not None:
            told.append((r.device_id, gone))
        if r.kind != "message":
            d.act(r.kind, r.t_ms, r.x, r.y)
            continue
        want, have = d.message(r.t_ms, r.node_id, r.distance), by_key.pop((r.device_id, r.seq))
        assert have.fixes == want["fixes"] == len(have.heard)
        if want["raw"] is None:
            assert have.raw_x is None and have.state is None
            continue
        kinds.add(have.algorithm)
        assert np.allclose((have.raw_x, have.raw_y, have.raw_z), want["raw"][:3], atol=1e-6), r
        assert np.allclose((have.x, have.y, have.z), want["at"], atol=1e-6), r
        assert (have.room_id, have.state, have.changed, have.pin_ms) == (want["room"], want["state"], want["changed"], want["pin"]), r
        assert (have.smart_room, have.smart_state, have.smart_changed) == (want["smart"], want["smart_state"], want["smart_changed"]), r
        assert np.allclose((have.smart_x, have.smart_y), want["spot"], atol=1e-6) and abs(have.smart_chance - want["chances"][want["smart"]]) < 1e-9
        assert abs(sum(want["chances"].values()) - 1) < 1e-9
    assert not by_key and kinds == {"room_aware", "pin_anchored"}
    told += [(name, gone) for name, d in devices.items() if (gone := d.silent(until)) is not None]
    assert sorted(told) == sorted((r.device_id, r.t_ms) for r in got if r.kind == "away") and len(told) > 5
    pins = {(r.device_id, r.pin_ms, round(r.x, 6), round(r.y, 6)): r.pin_samples for r in got if r.kind == "pin"}
    want = {(name, p["set"], round(p["at"][0], 6), round(p["at"][1], 6)): sum(int(n) for n, _ in p["learned"].values()) for name, d in devices.items() for p in d.pins}
    assert pins == want and max(pins.values()) > 0


def test_clicks_on_pins(spark):
    """A click within a metre takes up the pin where it is; one a metre away or more sets a new one."""
    scene = tracking.scene_of(spark, SMALL)
    t = tracking.Tracker(scene, tracking.Settings())
    d = t.devices(["a"])
    t.record(d[0], 0, (0.0, 0.0, 0.0))
    assert t.s["pins"][0] == 0  # nothing heard yet
    t.step(d, np.array([1]), np.array([0]), np.array([2.0]), np.array([-60.0]))
    for k, x in enumerate((0.0, 0.9, 1.8, 3.0)):
        t.record(d[0], 10 + k, (x, 0.0, 0.0))
    assert t.s["pin_at"][0, : int(t.s["pins"][0]), 0].tolist() == [0.0, 1.8, 3.0]
    assert (t.s["pin_until"][0] > 20).sum() == 1  # one is open
    t.activate(0, 30, 12)
    assert (t.s["pin_until"][0] > 30).tolist()[:3] == [False, True, False] and t.s["at"][0].tolist() == [1.8, 0.0, 0.0]
    t.deactivate(0)
    assert not (t.s["pin_until"][0] > 30).any()
    copy = tracking.Tracker(scene)
    copy.load("a", t.dump("a"))
    assert all(np.array_equal(copy.s[k][0], t.s[k][0], equal_nan=True) for k in tracking.STATE)
