"""Checked messages, pins, calibration rows and applied settings against plain Python, message by message."""

from __future__ import annotations

import json
import math
import statistics
from collections import defaultdict
from datetime import datetime, timezone

import oracle
import pytest

from rangefield.functions.dialect import spark_sql
from rangefield.plans import catalog, readmodels
from rangefield.plans.relations import with_

SMALL = "/root/testdata/sf0.001"


def rows(spark, sql, scene=None):
    return [r.asDict() for r in spark_sql(with_(sql, scene=scene))(spark, SMALL).collect()]


def result(spark, name):
    return [r.asDict() for r in catalog.queries()[name](spark, SMALL).collect()]


@pytest.mark.parametrize("name", list(readmodels.QUERIES))
def test_against_sql(spark, name):
    assert not oracle.difference(catalog.queries()[name](spark, SMALL), catalog.oracle_sql()[name], SMALL)


def parsed(line):
    try:
        return json.loads(line)
    except ValueError:
        return None


def is_number(x):
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def fits(message, fields):
    return message is not None and all(k not in message or (is_number(message[k]) if t == "number" else isinstance(message[k], str)) for k, t in fields.items())


def test_messages_with_a_wrong_field_are_dropped(spark):
    want = {}
    for r in rows(spark, "SELECT * FROM observed_lines"):
        m = parsed(r["line"])
        if fits(m, readmodels.OBSERVED):
            want[r["seq"]] = tuple(m.get(a, m.get(b)) for a, b in (("distance", ""), ("rssi", ""), ("refRssi", "ref_rssi"), ("name", ""), ("distVar", "dist_var"), ("rssiVar", "rssi_var")))
    got = {r["seq"]: tuple(r[c] for c in ("distance", "rssi", "ref_rssi", "name", "dist_var", "rssi_var")) for r in result(spark, "s03_checked_messages")}
    assert got == want and 0 < len(want) < len(rows(spark, "SELECT seq FROM observed_lines"))


def test_last_sound_telemetry_of_each_node(spark):
    want = {}
    for r in sorted(rows(spark, "SELECT * FROM telemetry_lines"), key=lambda r: (r["t_ms"], r["seq"])):
        m = parsed(r["line"])
        if fits(m, readmodels.TELEMETRY):
            want[r["node_id"]] = (r["t_ms"], True, *(m.get(k) for k in readmodels.TELEMETRY))
    got = {r["node_id"]: (r["telemetry_at"], r["online"], *(r[readmodels.snake(k)] for k in readmodels.TELEMETRY)) for r in result(spark, "s05_telemetry_fields")}
    assert got == want


def test_reports_of_the_other_system(spark):
    want = set()
    for r in rows(spark, "SELECT * FROM attribute_lines"):
        m = parsed(r["line"])
        if m is None or not is_number(m.get("x")) or not is_number(m.get("y")):
            continue
        seen = r["arrived_ms"]
        try:
            seen = int(datetime.fromisoformat(m["last_seen"]).replace(tzinfo=timezone.utc).timestamp() * 1000)
        except (KeyError, ValueError):
            pass
        if r["arrived_ms"] - seen > 86_400_000:
            continue
        z = m["z"] if is_number(m.get("z")) else None
        scenario = m["best_scenario"] if isinstance(m["best_scenario"], str) else None
        sure = m["confidence"] if is_number(m["confidence"]) else 0
        want.add((r["device_id"], r["seq"], m["x"], m["y"], z, min(1, max(0, sure / 100)), math.floor(m["fixes"] + 0.5), scenario, seen))
    columns = ("device_id", "seq", "x", "y", "z", "confidence", "fixes", "scenario", "last_seen")
    assert {tuple(r[c] for c in columns) for r in result(spark, "s06_checked_attributes")} == want
    assert {w[-2] is None for w in want} == {True, False} and {w[4] is None for w in want} == {True, False}


class Pin:
    def __init__(self, click, snapshot):
        self.click, self.snapshot, self.until, self.sums = click, snapshot, click["placed_ms"] + 1800, defaultdict(lambda: [0, 0.0, 0.0])


#: Three devices that are heard all the time but for three pauses, and nine clicks.
DENSE = {
    "obs": """SELECT id AS seq, id * 2 AS t_ms, id % 3 AS user_id, 'dev_' || CAST(id % 3 AS STRING) AS device_id, 'n' || CAST(id * 7 % 12 AS STRING) AS node_id, 'x' AS name,
        CASE WHEN id % 11 > 0 THEN 1.0D + id * 31 % 97 / 12.0D END AS distance, -60.0D AS rssi FROM range(24000) WHERE id % 8000 < 6500""",
    "pins": "SELECT 'dev_' || CAST(id % 3 AS STRING) AS device_id, id AS pin_ts, id * 37 % 120 / 10.0D AS x, id * 53 % 100 / 10.0D AS y, 1.0D AS z FROM range(9)",
}


@pytest.fixture(scope="module", params=[None, DENSE], ids=["given", "dense"])
def pins(request, spark):
    """All pins after every click and observation has been taken in order of time."""
    scene = request.param
    nodes = {r["node_id"]: r for r in rows(spark, "SELECT * FROM nodes")}
    events = [(r["placed_ms"], 0, r["pin_ts"], r) for r in rows(spark, "SELECT * FROM pin_clicks", scene)]
    observed = rows(spark, "SELECT device_id, seq, t_ms, node_id, distance FROM obs", scene)
    events += [(r["t_ms"], 1, r["seq"], r) for r in observed]
    latest, kept = defaultdict(dict), defaultdict(list)
    for t, kind, _, r in sorted(events, key=lambda e: e[:3]):
        own = kept[r["device_id"]]
        if kind == 0:
            snapshot = {n: d for n, d in latest[r["device_id"]].items() if d and d > 0}
            if snapshot:
                for p in own:
                    p.until = 0
                own.append(Pin(r, snapshot))
            continue
        latest[r["device_id"]][r["node_id"]] = r["distance"]
        active = [p for p in own if p.until > t]
        if not active or not r["distance"] or r["node_id"] not in nodes:
            continue
        far = math.dist([active[0].click[c] for c in "xyz"], [nodes[r["node_id"]][c] for c in "xyz"])
        if far >= 1 and 0.2 <= r["distance"] / far <= 5:
            s = active[0].sums[r["node_id"]]
            s[0], s[1], s[2] = s[0] + 1, s[1] + r["distance"] / far, s[2] + (r["distance"] / far) ** 2
            active[0].until = t + 1800
    return scene, nodes, kept, max(r["t_ms"] for r in observed)


def test_pins_by_node(spark, pins):
    scene, nodes, kept, now = pins
    want = {}
    for device, own in kept.items():
        for p in own:
            for node in (set(p.snapshot) | set(p.sums)) & set(nodes):
                n, s, s2 = p.sums.get(node, (0, 0.0, 0.0))
                far = math.dist([p.click[c] for c in "xyz"], [nodes[node][c] for c in "xyz"])
                mean = s / n if n else None
                bias = (None, None) if far < 1 else (mean, n) if n >= 5 and 0.2 <= mean <= 5 else (p.snapshot[node] / far, 1) if node in p.snapshot and 0.2 <= p.snapshot[node] / far <= 5 else (None, None)
                want[device, p.click["pin_ts"], node] = (p.until > now, p.snapshot.get(node), n, mean, math.sqrt(max(0, s2 / n - mean * mean)) if n else None, *bias)
    got = {(r["device_id"], r["pin_ts"], r["node_id"]): tuple(r[c] for c in ("active", "measured", "n", "mean", "sigma", "bias", "bias_samples")) for r in rows(spark, readmodels.QUERIES["p02_pin_nodes"], scene)}
    assert got.keys() == want.keys() and len(want) > 20
    for k, g in got.items():
        for x, y in zip(g, want[k], strict=True):
            assert x == y or abs(x - y) < 2e-4, k
    assert any(w[2] >= 50 for w in want.values()) == (scene is not None) and any(w[6] == 1 for w in want.values())


def test_order_of_pins_and_reference_level(spark, pins):
    scene, nodes, kept, now = pins
    absorption = {}
    for r in sorted(rows(spark, "SELECT * FROM absorptions"), key=lambda r: (r["t_ms"], r["seq"])):
        absorption[r["node_id"]] = r["absorption"]
    order, levels = set(), {}
    for device, own in kept.items():
        newest = sorted(own, key=lambda p: (-p.click["placed_ms"], -p.click["pin_ts"]))
        chosen = next((p for p in newest if p.until > now), newest[0] if newest else None)
        order |= {(device, p.click["pin_ts"], p.until > now, p.until, i + 1, p is chosen) for i, p in enumerate(newest)}
        deltas = []
        for node in (set(chosen.snapshot) | set(chosen.sums)) & set(nodes) if chosen else ():
            far = math.dist([chosen.click[c] for c in "xyz"], [nodes[node][c] for c in "xyz"])
            n, s, _ = chosen.sums.get(node, (0, 0, 0))
            ratio = s / n if n >= 5 else chosen.snapshot[node] / far if node in chosen.snapshot else 0
            if far >= 1 and ratio > 0:
                deltas.append(-10 * absorption.get(node, 2.7) * math.log10(ratio))
        if len(deltas) >= 3:
            levels[device] = (len(deltas), math.floor(-59 + statistics.median(deltas) + 0.5))
    got = {tuple(r[c] for c in ("device_id", "pin_ts", "active", "active_until_ms", "newest", "calibrates")) for r in rows(spark, readmodels.QUERIES["t05_pins_in_order"], scene)}
    # a pin that has run out keeps the time at which it did; one that another has replaced has none
    assert got == order and {r["device_id"]: (r["nodes"], r["ref_rssi"]) for r in rows(spark, readmodels.QUERIES["a12_pin_reference"], scene)} == levels


def test_bias_at_places(spark, pins):
    scene, nodes, kept, _ = pins
    pin_nodes = defaultdict(list)
    for r in rows(spark, f"WITH {readmodels.ESTIMATE} SELECT * FROM estimates WHERE bias IS NOT NULL", scene):
        pin_nodes[r["device_id"], r["node_id"]].append(r)
    clicks = {(d, p.click["pin_ts"]): p.click for d, own in kept.items() for p in own}
    want = {}
    for u in rows(spark, "SELECT * FROM upstream"):
        for (device, node), found in pin_nodes.items():
            if device == u["device_id"]:
                w = wb = 0.0
                for e in found:
                    c = clicks[device, e["pin_ts"]]
                    g = math.exp(-(math.hypot(c["x"] - u["x"], c["y"] - u["y"]) / 3) ** 2) * (0.2 + 0.8 * min(50, e["bias_samples"]) / 50)
                    w, wb = w + g, wb + g * e["bias"]
                divisor = 1 if w < 0.05 else 1 + min(1, w) * (wb / w - 1)
                if divisor > 0.1:
                    want[u["seq"], node] = divisor
    got = {(r["seq"], r["node_id"]): r["divisor"] for r in rows(spark, readmodels.QUERIES["x10_bias_at_places"], scene)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_many_samples_become_a_moving_average(spark):
    made = {"pin_kept": "SELECT 'd' AS device_id, CAST(1 AS BIGINT) AS pin_ts, 'n1' AS node_id, id AS seq, id AS t_ms, 1.0D + (id * 7919 % 13) / 10.0D + CASE WHEN id > 10500 THEN 1.0D ELSE 0.0D END AS bias FROM range(12000)"}
    n, s, s2 = 0, 0.0, 0.0
    for i in range(12_000):
        b = 1 + i * 7919 % 13 / 10 + (i > 10_500)
        if n >= 10_000:
            n, s, s2 = 9_999, s * 0.9999, s2 * 0.9999
        n, s, s2 = n + 1, s + b, s2 + b * b
    (got,) = rows(spark, "SELECT * FROM pin_sums", made)
    assert got["n"] == n and abs(got["mean"] - s / n) < 1e-9 and abs(got["mean2"] - s2 / n) < 1e-9


def test_calibration_rows(spark):
    off, last, said = defaultdict(list), {}, {}
    for r in sorted(rows(spark, "SELECT * FROM gt_samples"), key=lambda r: (r["t_ms"], r["l_orderkey"], r["l_linenumber"], r["l_partkey"], r["l_suppkey"])):
        off[r["listener_id"]].append(r["measured"] - r["true_dist"])
        last[r["listener_id"]] = (r["transmitter_id"], r["measured"], r["true_dist"], r["t_ms"])
    for r in sorted(rows(spark, "SELECT * FROM settings"), key=lambda r: (r["t_ms"], r["seq"])):
        said[r["node_id"]] = r["value"]
    known = {r["node_id"] for r in rows(spark, "SELECT node_id FROM nodes")}
    want = sorted((n for n in set(off) | set(said) if n in known or off[n]), key=lambda n: (not off[n], -round(abs(statistics.fmean(off[n])) if off[n] else 0, 9), n))
    got = sorted(result(spark, "k10_calibration_rows"), key=lambda r: r["place"])
    assert [r["node_id"] for r in got] == want
    for r in got:
        own = off[r["node_id"]]
        assert r["gt_count"] == len(own) and r["absorption_setting"] == said.get(r["node_id"])
        if own:
            assert abs(r["gt_mean"] - statistics.fmean(own)) < 1e-5 and abs(r["gt_sigma"] - statistics.pstdev(own)) < 1e-5
            assert r["last_from"] == last[r["node_id"]][0] and abs(r["last_measured"] - last[r["node_id"]][1]) < 1e-5 and r["last_ms"] == last[r["node_id"]][3]


def test_settings_applied_by_hand(spark):
    want, resets = set(), []
    for u in rows(spark, "SELECT * FROM manual_updates"):
        if not u["node_id"]:
            continue
        topic = "site/rooms/" + u["node_id"] + "/{}/set"
        if u["absorption"] is not None:
            want.add((u["seq"], topic.format("absorption"), f"{math.floor(u['absorption'] * 100 + 0.5) / 100:.2f}"))
        for setting, x in (("rx_adj_rssi", u["rx_adj"]), ("tx_ref_rssi", u["tx_ref"])):
            if x is not None:
                want.add((u["seq"], topic.format(setting), str(math.floor(x + 0.5))))
        if u["resets"]:
            resets.append(u["t_ms"])
    assert {(r["seq"], r["topic"], r["payload"]) for r in result(spark, "m08_applied_settings")} == want
    left = defaultdict(int)
    for r in rows(spark, "SELECT * FROM gt_samples"):
        left[r["listener_id"]] += r["t_ms"] > max(resets)
    assert {r["listener_id"]: r["n"] for r in result(spark, "m08_residuals_after_apply")} == {k: v for k, v in left.items() if v}
