"""A sample of every family of queries against its SQL; the driver compares all of them."""

from __future__ import annotations

import math

import oracle
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from rangefield.functions.dialect import duck_sql, render, spark_sql
from rangefield.plans import catalog
from rangefield.plans.relations import RELATIONS, with_

SMALL = "/root/testdata/sf0.001"
#: What SQL cannot express: iterative locators, checked in test_locators.py.
WITHOUT_SQL = {"l03_nelder_mead", "l04_bfgs", "l05_mle", "l07_path_aware", "l08_environment_aware", "l10_rf_physics", "l11_rf_room_aware", "l14_solver_bundle", "l16_path_diagnostics"}
#: Replays in order of time, checked in test_tracking.py.
WITHOUT_SQL |= {"w01_replayed_positions", "l12_bayesian", "w09_presence_log", "m02_pin_book", "j19_upstream_offsets", "g13_outlines", "a04_all_locators", "a05_all_locators"}
SAMPLE = [
    "s02_topic_parse", "s03_device_payload", "s07_device_config", "f01_tracked", "a19_device_row", "j10_calibration", "j15_settings_by_alias", "j19_upstream_as_of", "j21_setting_as_of", "x21_glob", "x22_duration",
    "x26_open_to", "x28_iso_dates", "g02_find_room", "g06_adjacency", "g09_crossings", "g17_hops", "g18_distance_to_room", "a06_pair_fits", "a08_node_fit", "a15_ruler_scale", "f15_auto_apply", "a12_reference_rssi", "t04_recent_devices",
    "m01_recorded_pins", "s10_pins_load", "w02_smoothed_distance", "w04_kalman", "w05_position_ema", "w06_hysteresis", "w10_rate_limit", "l02_nearest_node", "l13_intersection", "l14_bundle", "j09_path_exponents",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    assert not oracle.difference(catalog.queries()[name](spark, SMALL), catalog.oracle_sql()[name], SMALL)


def test_flagship(spark):
    name = catalog.FLAGSHIP
    assert not oracle.difference(catalog.queries()[name](spark, SMALL), catalog.oracle_sql()[name], SMALL)


@pytest.mark.parametrize("devices,size", [(15, "sf0.001"), (150, "sf0.01")])
def test_pins_follow_the_number_of_devices(spark, devices, size):
    got = catalog.queries()["t05_pins_newest"](spark, f"/root/testdata/{size}").collect()
    want = {(f"dev_{k % devices}", k, 3 - k // devices) for k in range(3 * devices)}  # FIXTURES.md 2.2
    assert len(got) == len(want) and {(r.device_id, r.pin_ts, r.place) for r in got} == want


def test_every_query_has_sql():
    assert set(catalog.queries()) - WITHOUT_SQL == set(catalog.oracle_sql())


def test_every_sql_gives_rows():
    for name, sql in catalog.oracle_sql().items():
        assert oracle.duck(sql, "/root/testdata/sf0.01")[1], name


def test_settings_between_two_hundredths(spark, tmp_path):
    """Balances of every multiple of 25, whose settings lie half-way between two hundredths, and of cents beside them."""
    for t in oracle.TABLES:
        if t != "supplier":
            (tmp_path / f"{t}.parquet").symlink_to(f"{SMALL}/{t}.parquet")
    cents = [c + d for c in range(-1_000_000, 1_000_001, 2500) for d in (-1, 0, 1)]
    supplier = pa.table({"s_suppkey": [35 * i + 1 for i in range(len(cents))], "s_name": [""] * len(cents), "s_nationkey": pa.array([0] * len(cents), pa.int32()), "s_acctbal": [c / 100 for c in cents]})
    pq.write_table(supplier, tmp_path / "supplier.parquet")
    for name in ("f08_absorption", "m08_manual_apply"):
        assert not oracle.difference(catalog.queries()[name](spark, str(tmp_path)), catalog.oracle_sql()[name], str(tmp_path))


def test_known_hops_and_edges(spark):
    hops = {(r.a, r.b): r.hops for r in catalog.queries()["g17_hops"](spark, SMALL).collect()}
    assert hops[("kitchen", "office")] == 5 and hops[("living", "living")] == 0
    assert spark_sql(with_(catalog.SQL["g06_adjacency"]))(spark, SMALL).count() == 7
    assert catalog.queries()["g06_adjacency"](spark, SMALL).groupBy("site").count().filter("site % 3 = 0 AND count <> 7").count() == 0


def test_duration_golden(spark):
    got = {r.text: r.ms for r in catalog.queries()["x22_duration"](spark, SMALL).collect()}
    assert got["2w"] == 1_209_600_000 and got["3600"] == 3_600_000 and got["bogus"] == 2_592_000_000


def test_forms_render_inside_out():
    assert render("{div: {us: ts} - 1; 5}", "duckdb", str) == "((epoch_us(ts) - 1) // (5))"
    assert duck_sql("SELECT 1.5D") == "SELECT 1.5::DOUBLE"


def test_relations_come_after_what_they_need():
    text = with_("SELECT * FROM fixes")
    assert text.index("fix_last AS") < text.index("fixes AS") and set(RELATIONS) >= {"obs", "fixes"}


def test_texts_and_colours_as_the_map_shows_them(spark):
    ask = lambda sql: {r.seq: r for r in spark_sql(with_(sql))(spark, SMALL).collect()}
    raw, obs = ask("SELECT seq, raw, t_ms FROM obs_raw"), ask("SELECT seq, rssi FROM obs")
    half_up = lambda v, n: math.floor(abs(v) * 10**n + 0.5) / 10**n
    for r in catalog.queries()["x24_displays"](spark, SMALL).collect():
        meters = raw[r.seq].raw - 5
        sign, inches = "-" if meters < 0 else "", half_up(meters / 0.0254, 1)
        feet = math.floor(inches / 12 + 1e-9)
        assert r.metric_input == f"{sign}{half_up(meters, 2):.2f}" and r.metric == f"{r.metric_input} m" and r.imperial_input == f"{sign}{half_up(meters / 0.0254, 2):.2f}"
        assert r.imperial == sign + (f"{feet} ft {inches - 12 * feet:.1f} in" if feet else f"{inches:.1f} in")
    seen = set()
    for r in catalog.queries()["x25_texts"](spark, SMALL).collect():
        ms = raw[r.seq].t_ms ** 2
        s, m, h, d = ms // 1000, ms // 60_000, ms // 3_600_000, ms // 86_400_000
        assert r.relative == ("just now" if ms < 1000 else f"{s}s ago" if s < 60 else f"{m}m ago" if m < 60 else f"{h}h ago")
        assert r.relative_long == (f"{s}s ago" if s < 60 else f"{m}m ago" if m < 60 else f"{h}h ago" if h < 24 else f"{d}d ago")
        up = -(-ms // 1000)
        assert r.countdown == ("now" if ms <= 0 else f"{up}s" if up < 60 else f"{up // 60}m {up % 60:02d}s")
        assert r.uptime == (f"{d}d {h % 24}h" if d else f"{h}h {m % 60}m" if h else f"{m}m")
        seen.add(r.relative_long[-5])
    assert seen >= {"d", "h", "m"}
    stops = [(68, 1, 84), (59, 82, 139), (33, 144, 140), (94, 201, 97), (253, 231, 37)]
    for r in catalog.queries()["x13_rgba"](spark, SMALL).collect():
        t = min(max((obs[r.seq].rssi + 120) / 80, 0.0), 1.0)
        i = next(k for k in range(4) if t <= (k + 1) / 4)
        want = [math.floor(a + (t - i / 4) * 4 * (b - a) + 0.5) for a, b in zip(stops[i], stops[i + 1], strict=True)]
        assert [r.r, r.g, r.b] == want and r.a == 255
