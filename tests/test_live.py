"""The live tracker against the replay, and what comes without any further message."""

from __future__ import annotations

import copy
import dataclasses
import math
import time
from collections import Counter
from pathlib import Path

import pytest

from rangefield.functions.dialect import spark_sql
from rangefield.operators import folds, tracking
from rangefield.plans.relations import RELATIONS, with_
from rangefield.streaming import live

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Messages and pins of three devices in four files, in order."""
    path = tmp_path_factory.mktemp("events")
    rows = tracking.events(spark, SMALL).filter("device_id IN ('dev_1', 'dev_2', 'dev_5')").orderBy("t_ms", "seq").toPandas()
    step = -(-len(rows) // 4)
    for i in range(4):
        rows.iloc[i * step : (i + 1) * step].to_parquet(path / f"part-{i}.parquet", index=False)
    return str(path)


def test_live_equals_replay_and_tells_silence(spark, parts, tmp_path):
    before = {k: spark.conf.get(k, None) for k in live.STORE}
    for k, v in live.STORE.items():
        spark.conf.set(k, v)
    settings = tracking.Settings(room_ms=100, away_ms=4000, cleanup_ms=300)
    scene = tracking.scene_of(spark, SMALL)
    try:
        stream = spark.readStream.schema(live.IN).option("maxFilesPerTrigger", 1).parquet(parts)
        out = live.live(stream, scene, settings)
        query = out.writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path)).trigger(processingTime="1 second").start()
        want = tracking.replay(spark.read.schema(live.IN).parquet(parts), scene, settings, 10**9).filter("kind <> 'pin'").collect()
        deadline = time.time() + 120
        while time.time() < deadline and spark.table("live").count() < len(want):
            time.sleep(1)
        got = spark.table("live").collect()
        query.stop()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    order = lambda rows: sorted((r.device_id, r.t_ms, r.kind, r.seq or 0, r.state, r.smart_room, r.pin_samples, None if r.x is None else round(r.x, 6)) for r in rows)
    assert [str(r) for r in order(got)] == [str(r) for r in order(want)]
    last = {r.device_id: r for r in sorted(got, key=lambda r: r.t_ms)}
    assert {d: r.state for d, r in last.items()} == dict.fromkeys(("dev_1", "dev_2", "dev_5"), tracking.AWAY)


def test_recorded_pins_keep_their_place(spark, monkeypatch):
    clicks = [("a", i, i, x, 0.0) for i, x in enumerate((0.0, 0.9, 1.8, 0.95, 3.0, 2.0))] + [("b", i, i, x, 0.0) for i, x in enumerate((0.0, 1.0))]
    monkeypatch.setitem(RELATIONS, "pin_events", "SELECT * FROM (VALUES " + ", ".join(f"('{d}', {s}, {t}, {x}D, {y}D)" for d, s, t, x, y in clicks) + ") AS c(device_id, seq, t_ms, x, y)")
    got = sorted(tuple(r) for r in spark_sql(with_(folds._PINS))(spark, SMALL).select("device_id", "first_seq", "last_seq", "n", "x").collect())
    pins: dict = {}
    for device, seq, _, x, y in clicks:
        own = pins.setdefault(device, [])
        near = next((p for p in own if math.dist((p[3], p[4]), (x, y)) < 1), None)
        if near:
            near[1], near[2] = seq, near[2] + 1
        else:
            own.append([seq, seq, 1, x, y])
    assert got == sorted((d, *p[:4]) for d, own in pins.items() for p in own)
    assert [r[4] for r in got] == [0.0, 1.8, 3.0, 0.0, 1.0]


def test_many_recorded_pins(spark, monkeypatch):
    """30,000 clicks a device, new places also late, some clicks nowhere and two pins with one number, against one click after the other."""
    monkeypatch.setitem(RELATIONS, "pin_events", """SELECT 'd' || CAST(id % 2 AS STRING) AS device_id, CASE WHEN id < 8 THEN id % 4 ELSE id END AS seq, id div 3 AS t_ms,
        CASE WHEN id % 7001 = 7 THEN NULL WHEN id % 7001 = 9 THEN double('NaN') ELSE pmod(id * 7919, 1201) / 100.0D - 6 + id div 20000 * 5 END AS x, pmod(id * 104729, 1009) / 100.0D - 5 AS y FROM range(60000)""")
    pins: dict = {}
    for device, seq, _, x, y in sorted(map(tuple, spark_sql(with_("SELECT device_id, seq, t_ms, x, y FROM pin_events"))(spark, SMALL).collect()), key=lambda r: r[:1] + r[2:0:-1]):
        own = pins.setdefault(device, [])
        near = next((p for p in own if None not in (x, p[3]) and math.sqrt((p[3] - x) ** 2 + (p[4] - y) ** 2) < 1), None)
        if near:
            for p in own:
                if p[0] == near[0]:
                    p[1], p[2] = seq, p[2] + 1
        else:
            own.append([seq, seq, 1, x, y])
    brief = lambda rows: Counter((*r[:4], *(x if x is None else f"{x:.4f}" for x in r[4:])) for r in rows)
    want = brief((d, *p) for d, own in pins.items() for p in own)
    began = time.time()
    got = brief(spark_sql(with_(folds._PINS))(spark, SMALL).collect())
    assert time.time() - began < 60
    assert got == want and len(got) > 200 and sum(r[1] < 4 for r in got) > len({r[:2] for r in got if r[1] < 4})


def test_a_changed_house_shows_in_the_next_batch(spark, parts, tmp_path):
    """The third batch meets another house: its rooms are reported from then on, and states start anew."""
    one = tracking.scene_of(spark, SMALL)
    two = dataclasses.replace(one, house=copy.deepcopy(one.house))
    two.house.rooms = [f"new_{r}" for r in one.house.rooms]
    asked, got = [], {}

    def current():
        asked.append(None)
        return ("one", one) if len(asked) <= 2 else ("two", two)

    def publish(rows, number):
        got[number] = rows.collect()

    stream = spark.readStream.schema(live.IN).option("maxFilesPerTrigger", 1).parquet(parts)
    live.in_batches(stream, current, str(tmp_path), publish).trigger(availableNow=True).start().awaitTermination()
    assert sorted(got) == [0, 1, 2, 3] and len(asked) == 4
    files = sorted(Path(parts).glob("*.parquet"))
    for own, scene in ((files[:2], one), (files[2:], two)):
        want = tracking.replay(spark.read.schema(live.IN).parquet(*map(str, own)), scene).filter("kind = 'message'").collect()
        have = [r for n in ((0, 1) if scene is one else (2, 3)) for r in got[n] if r.kind == "message"]
        brief = lambda rows, state: sorted((r.device_id, r.seq, r.room_id or "", r[state] or "", round(r.x or 0, 6)) for r in rows)
        assert brief(have, "reported") == brief(want, "state")
    assert {r.room_id[:4] for n in (2, 3) for r in got[n] if r.room_id} == {"new_"}
