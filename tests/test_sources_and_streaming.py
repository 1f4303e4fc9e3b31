"""Configuration, saved state, and the streaming twin against the batch queries."""

from __future__ import annotations

import json

import numpy as np
import pytest

import oracle
from rangefield.functions.dialect import duck_sql, spark_sql
from rangefield.plans import catalog, geometry, relations, views
from rangefield.plans.relations import with_
from rangefield.sources import config, state, versions
from rangefield.streaming import feed, replay

SMALL = "/root/testdata/sf0.001"
HOUSE = {
    "floors": [{"id": "ground", "rooms": [
        {"id": "ell", "name": "Ell", "points": [[0, 0], [6, 0], [6, 2], [2, 2], [2, 6], [0, 6]], "open_to": [{"id": "den", "door": [4.0, 2.0], "width": 1.0}, "outside"], "floor_area": "big"},
        {"id": "den", "name": "Den", "points": [[2, 2], [6, 2], [6, 6], [2, 6]], "open_to": ["nook"]},
        {"id": "nook", "name": "Nook", "points": [[6, 0], [9, 0], [9, 6], [6, 6]]}]}],
    "nodes": [{"id": "n0", "point": [1, 1, 1]}, {"id": "n1", "point": [4, 4, 2], "room": "Den"}, {"id": "n2", "point": [7.5, 3, 1]}, {"id": "n3", "point": [1, 5, 1]}, {"id": "n4", "point": [0, 0, 0], "enabled": False}],
}
ON_ANY_HOUSE = ["g01_point_in_polygon", "g02_find_room", "g03_centroid", "g05_room_anchor", "g06_adjacency", "g08_segment_hits", "g09_crossings", "g18_distance_to_room", "g19_node_rooms", "j22_open_targets", "a25_bounds"]


@pytest.mark.parametrize("name", ON_ANY_HOUSE)
def test_queries_on_another_house(spark, name):
    own = config.scene(config.validate(HOUSE))
    sql = catalog.SQL[name]
    got = spark_sql(with_(sql, scene=own))(spark, SMALL)
    assert got.count() > 0
    assert not oracle.difference(got, duck_sql(with_(sql, engine="duckdb", scene=own)), SMALL)


def test_points_of_a_concave_room(spark):
    own = config.scene(config.validate(HOUSE))
    rows = spark_sql(with_("SELECT seq, x, y, room_id FROM located", scene=own))(spark, SMALL).collect()
    for r in rows:
        if r.x in (0, 2, 6, 9) or r.y in (0, 2, 6):
            continue  # on an edge
        where = None
        if 0 < r.y < 6 and 0 < r.x < 9:
            where = "nook" if r.x > 6 else "ell" if r.x < 2 or r.y < 2 else "den"
        assert r.room_id == where


def test_configuration_file(tmp_path):
    (tmp_path / "empty.json").write_text(" ")
    assert config.load(str(tmp_path / "empty.json")) == config.DEFAULTS
    (tmp_path / "house.json").write_text(json.dumps(HOUSE))
    assert config.load(str(tmp_path / "house.json"))["nodes"] == HOUSE["nodes"]
    for bad in ([1], {"nodes": {}}, {"nodes": [{"id": "a", "point": [1, 2]}]}, {"floors": [{"rooms": [{"id": "r", "points": [[1]]}]}]}):
        with pytest.raises(ValueError):
            config.validate(bad)


def test_state_round_trip(spark, tmp_path):
    path = str(tmp_path / "state")
    audit = spark.createDataFrame([(f"n{i % 3}", 2.5, 2.5 + i, float(i), 10.0, 0.9, 1000 + i) for i in range(250)] + [("bad", 1.0, None, 0.0, 1.0, 1.0, 5), (None, 1.0, 2.0, 1.0, 1.0, 1.0, 6)], state.AUDIT)
    pins = spark.createDataFrame([("dev_1", 1, 1.0, 2.0, 1.0, 99), ("dev_2", 2, None, 2.0, 1.0, 99)], state.PINS)
    assert state.save(audit, "audit", path) and state.save(pins, "pins", path)
    assert not state.save(audit.limit(0), "audit", path)  # what is there stays
    found = state.load(spark, "audit", path).collect()
    assert [r.t_ms for r in found] == list(range(1249, 1049, -1))
    assert [(r.device_id, r.active_until_ms) for r in state.load(spark, "pins", path).collect()] == [("dev_1", 0)]
    assert state.load(spark, "calibration", path).count() == 0
    snapshot, again = str(tmp_path / "snapshot"), str(tmp_path / "again")
    state.export(spark, path, snapshot, json.dumps(HOUSE))
    assert json.loads(state.restore(spark, snapshot, again)) == HOUSE
    assert state.load(spark, "audit", again).count() == 200 and state.load(spark, "pins", again).count() == 1
    spark.createDataFrame([(2, "{}")], "version int, config string").write.mode("overwrite").json(f"{snapshot}/head")
    with pytest.raises(ValueError):
        state.restore(spark, snapshot, again)


def test_a_crash_leaves_the_old_or_the_new_state(spark, tmp_path, monkeypatch):
    path, snapshot = str(tmp_path / "state"), str(tmp_path / "snapshot")
    pins = lambda n: spark.createDataFrame([(f"dev_{i}", i, 1.0, 2.0, 1.0, 99) for i in range(n)], state.PINS)
    audit = lambda n: spark.createDataFrame([("n1", 2.5, 3.0, 0.5, 10.0, 0.9, 1000 + i) for i in range(n)], state.AUDIT)
    now = lambda: (state.load(spark, "pins", path).count(), state.load(spark, "audit", path).count())
    state.save(pins(3), "pins", snapshot)
    state.save(audit(3), "audit", snapshot)
    with pytest.raises(ValueError):
        state.restore(spark, snapshot, path)  # no head: not a whole snapshot
    state.export(spark, snapshot, snapshot, "")
    state.save(pins(1), "pins", path)
    state.save(audit(1), "audit", path)
    whole = state._write
    for step in range(3):  # dies before the first, second, third part

        def dying(rows, kind, where, left=[step]):  # noqa: B006
            if not left[0]:
                raise OSError("lost")
            left[0] -= 1
            return whole(rows, kind, where)

        monkeypatch.setattr(state, "_write", dying)
        with pytest.raises(OSError):
            state.restore(spark, snapshot, path)
        assert now() == (1, 1)
    monkeypatch.setattr(state, "_write", whole)
    # a manifest that was not written to its end does not count
    number = versions.append(spark, f"{path}/manifest", {"pins": "x"})
    place, store = versions.files(spark, f"{path}/manifest/{number:012d}.json")
    store.create(place, True).close()
    assert now() == (1, 1)
    state.restore(spark, snapshot, path)
    assert now() == (3, 3)
    for n in range(1, 20):
        state.save(pins(n), "pins", path)
    assert now() == (19, 3)
    kept, store = versions.files(spark, f"{path}/parts")
    assert len(list(store.listStatus(kept))) <= 12


def test_feed_goes_on_from_an_offset(spark, parts, tmp_path):
    path = str(tmp_path / "feed")
    with pytest.raises(ValueError):
        feed.poll(spark, path)
    stream = replay.observations(spark, parts)
    stream.writeStream.foreachBatch(feed.sink(path)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    obs = spark_sql(with_("SELECT device_id, t_ms, seq FROM obs"))(spark, SMALL).collect()
    order = sorted(obs, key=lambda r: (r.t_ms, r.seq))
    want = {r.device_id: r.seq for r in order}
    last = lambda rows: {r.device_id: r.seq for r in rows.collect()}
    first = feed.poll(spark, path)
    assert first.snapshot and last(first.rows) == want and first.offset == 4
    # whoever comes back with an offset has the same last states in the end
    known = {r.device_id: r.seq for r in order[:500]}
    more = feed.poll(spark, path, 2)
    assert not more.snapshot and {**known, **last(more.rows)} == want and set(last(more.rows)) == {r.device_id for r in order[500:]}
    assert last(feed.poll(spark, path, 4).rows) == {}
    one = feed.follow(spark, path, "map")
    feed.done(spark, path, "map", one)
    assert one.snapshot and not feed.follow(spark, path, "map").snapshot
    feed.sink(path)(spark.read.schema(replay.OBS).parquet(parts).limit(0), 4)  # a tick without changes
    beat = feed.follow(spark, path, "map")
    assert beat.offset == 5 and last(beat.rows) == {}
    assert feed.compact(spark, path) == 5
    again = feed.poll(spark, path, 2)
    assert again.snapshot and last(again.rows) == want and feed.follow(spark, path, "map").offset == 5


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The observations in files of 250 messages, in order."""
    path = tmp_path_factory.mktemp("obs")
    obs = spark_sql(with_("SELECT seq, CAST(t_ms AS BIGINT) AS t_ms, device_id, node_id, name, distance, rssi FROM obs"))(spark, SMALL).orderBy("t_ms", "seq").toPandas()
    for i in range(0, len(obs), 250):
        obs.iloc[i : i + 250].to_parquet(path / f"part-{i:06d}.parquet", index=False)
    return str(path)


def drain(frame, mode):
    query = frame.writeStream.format("memory").queryName("drained").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return frame.sparkSession.table("drained").collect()


def test_smoothing_stream_equals_batch(spark, parts):
    last = {}
    for r in drain(replay.smoothed(replay.observations(spark, parts)), "update"):
        if r.n >= last.get((r.device_id, r.node_id), r).n:
            last[r.device_id, r.node_id] = r
    want = {(r.device_id, r.node_id): r for r in catalog.queries()["w02_smoothed_distance"](spark, SMALL).collect()}
    assert set(last) == set(want)
    for k, r in want.items():
        assert last[k].n == r.n and np.allclose((last[k].mean, last[k].variance), (r.mean, r.variance), atol=1e-6)


def test_presence_stream(spark, parts):
    got = [(r.device_id, r.t_ms, r.state) for r in drain(replay.presence(replay.observations(spark, parts)), "append")]
    want = []
    obs = spark_sql(with_("SELECT device_id, t_ms, seq, name FROM obs"))(spark, SMALL).collect()
    seen = {}
    for r in sorted(obs, key=lambda r: (r.t_ms, r.seq)):
        last, place = seen.get(r.device_id, (None, None))
        if last is not None and r.t_ms - last > replay.AWAY_MS:
            want.append((r.device_id, last + replay.AWAY_MS, "not_home"))
            place = None
        if r.name != place:
            want.append((r.device_id, r.t_ms, r.name))
        seen[r.device_id] = (r.t_ms, r.name)
    assert sorted(got) == sorted(want)


def test_latest_per_batch_and_windows(spark, parts, tmp_path):
    batches = []
    replay.latest(replay.observations(spark, parts), lambda df, n: batches.append((n, {r.device_id: r.seq for r in df.collect()})), str(tmp_path / "c")).awaitTermination()
    obs = spark_sql(with_("SELECT device_id, t_ms, seq FROM obs"))(spark, SMALL).collect()
    newest = {}
    for r in sorted(obs, key=lambda r: (r.t_ms, r.seq)):
        newest[r.device_id] = r.seq
    found = {}
    for _, b in sorted(batches, key=lambda b: b[0]):
        found |= b
    assert found == newest and [n for n, _ in batches] == list(range(len(batches)))
    rows = drain(replay.windowed(replay.observations(spark, parts)), "append")
    assert all(r.n > 0 for r in rows)


def test_regression_with_every_kind_of_wall(spark, monkeypatch):
    """The solved parameters against numpy, with outer walls and doors on some paths."""
    monkeypatch.setitem(relations.RELATIONS, "counted", "SELECT a, b, length(a) % 2 + px % 3 AS interior, CASE WHEN px + qx > 9 THEN 1 ELSE 0 END AS exterior, CASE WHEN py > qy THEN 1 ELSE 0 END AS doors FROM paths")
    row = spark_sql(with_(views.QUERIES["a13_rf_fit"]))(spark, SMALL).first()
    data = spark_sql(with_("SELECT g.listener_id l, g.transmitter_id t, g.true_dist, g.measured, g.absorption, c.interior, c.exterior, c.doors FROM gt_samples g JOIN counted c ON least(g.listener_id, g.transmitter_id) = c.a AND greatest(g.listener_id, g.transmitter_id) = c.b"))(spark, SMALL).toPandas()
    data = data[(data.measured > 0.1) & (data.true_dist > 1)]
    w = (1 / data.groupby(["l", "t"]).true_dist.transform("count")).to_numpy()
    x = np.stack([10 * np.log10(data.true_dist), data.interior, data.exterior, data.doors], 1).astype(float)
    y = (10 * data.absorption * np.log10(data.measured)).to_numpy()
    gram, moment = (x * w[:, None]).T @ x, x.T @ (w * y)
    extra = np.array([0.02, 0.1, 0.2, 1.0]) * np.diag(gram)
    beta = np.linalg.solve(gram + np.diag(extra), moment + extra * np.array([3, 4, 10, 0]))
    sse = (w * (y - x @ beta) ** 2).sum()
    sst = (w * (y - (w * y).sum() / w.sum()) ** 2).sum()
    want = (np.clip(beta[0], 1.5, 8), *np.clip(beta[1:], 0, 30), max(0.0, 1 - sse / sst), np.sqrt(sse / max(1, w.sum() - 4)))
    assert np.allclose((row.exponent, row.wall_db, row.exterior_db, row.door_db, row.r2, row.residual_db), want, atol=2e-4)
    assert row.samples == len(data) and geometry.QUERIES


def test_regression_on_more_samples_than_a_ring_holds(spark, monkeypatch):
    """All samples of a listener count, however many there are; the parameters against numpy."""
    size = "/root/testdata/sf0.01"
    monkeypatch.setitem(relations.RELATIONS, "counted", "SELECT a, b, length(a) % 2 + px % 3 AS interior, CASE WHEN px + qx > 9 THEN 1 ELSE 0 END AS exterior, CASE WHEN py > qy THEN 1 ELSE 0 END AS doors FROM paths")
    row = spark_sql(with_(views.QUERIES["a13_rf_fit"]))(spark, size).first()
    walls = {(r.a, r.b): (r.interior, r.exterior, r.doors) for r in spark_sql(with_("SELECT * FROM counted"))(spark, size).collect()}
    data = spark_sql(with_("SELECT listener_id l, transmitter_id t, true_dist, measured, absorption FROM gt_samples WHERE measured > 0.1D AND true_dist > 1.0D"))(spark, size).toPandas()
    assert data.groupby("l").size().min() > 1000 and row.samples == len(data)
    data["x"], data["y"] = 10 * np.log10(data.true_dist), 10 * data.absorption * np.log10(data.measured)
    pairs = data.groupby(["l", "t"])[["x", "y"]].mean().reset_index()
    x = np.array([(p.x, *walls[min(p.l, p.t), max(p.l, p.t)]) for p in pairs.itertuples()], float)
    extra = np.array([0.02, 0.1, 0.2, 1.0]) * np.diag(x.T @ x)
    beta = np.linalg.solve(x.T @ x + np.diag(extra), x.T @ pairs.y.to_numpy() + extra * np.array([3, 4, 10, 0]))
    assert row.pairs == len(pairs)
    assert np.allclose((row.exponent, row.wall_db, row.exterior_db, row.door_db), (np.clip(beta[0], 1.5, 8), *np.clip(beta[1:], 0, 30)), atol=2e-4)
