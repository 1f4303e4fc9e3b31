"""Saved state as JSON lines: audit log, pins, calibration; and snapshots of all three.

Every part is written to a new folder; then one small numbered file, the
manifest, names the folders that count.  So a change of one part or of all of
them (a restored snapshot) is one step, and a writer that dies before it leaves
the old state whole.  Folders that no recent manifest names are removed.  A
part is left alone when there is nothing to save.  Readers check the types of
every row and drop what does not fit.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import versions

VERSION = 1
AUDIT_ROWS = 200
AUDIT = "node_id string, old_value double, new_value double, delta double, valid_samples double, r_squared double, t_ms long"
PINS = "device_id string, pin_ts long, x double, y double, z double, active_until_ms long"
CALIBRATION = "listener_id string, transmitter_id string, w double, sum_n double, sum_n2 double, mean_true double, mean_measured double, last_ms long"
SCHEMAS = {"audit": AUDIT, "pins": PINS, "calibration": CALIBRATION}


#: Manifests whose folders are kept for readers that began before the switch.
KEPT = 3


def _write(rows: DataFrame, kind: str, path: str) -> str | None:
    """The name of a new folder with the rows; None if there are none."""
    if rows.isEmpty():
        return None
    name = f"{kind}-{uuid.uuid4().hex}"
    rows.select(*[x.split()[0] for x in SCHEMAS[kind].split(", ")]).withColumn("version", F.lit(VERSION)).write.json(f"{path}/parts/{name}")
    return name


def _commit(spark: SparkSession, path: str, parts: dict[str, str]) -> None:
    """Makes new folders count, all at once, and removes those that no recent manifest names."""
    _, found = versions.last(spark, f"{path}/manifest")
    versions.append(spark, f"{path}/manifest", (found or {}) | parts)
    every = versions.numbers(spark, f"{path}/manifest")
    named = {name for n in every[-KEPT:] for name in (versions.read(spark, f"{path}/manifest", n) or {}).values()}
    for n in every[:-KEPT]:
        for name in set((versions.read(spark, f"{path}/manifest", n) or {}).values()) - named:
            place, store = versions.files(spark, f"{path}/parts/{name}")
            store.delete(place, True)
        place, store = versions.files(spark, f"{path}/manifest/{n:012d}.json")
        store.delete(place, False)


def save(rows: DataFrame, kind: str, path: str) -> bool:
    """Makes the rows of a kind of state count at path; False, and nothing changed, if there are none."""
    name = _write(rows, kind, path)
    if name is None:
        return False
    _commit(rows.sparkSession, path, {kind: name})
    return True


def load(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """The valid rows of a kind of state; a part that was never saved gives none."""
    schema = SCHEMAS[kind]
    _, found = versions.last(spark, f"{path}/manifest")
    if not found or kind not in found:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema + ", version int").json(f"{path}/parts/{found[kind]}").filter(F.col("version") == VERSION).drop("version")
    if kind == "audit":
        fine = rows.filter("node_id IS NOT NULL AND new_value IS NOT NULL AND NOT isnan(new_value) AND t_ms > 0")
        return fine.orderBy(F.desc("t_ms"), "node_id").limit(AUDIT_ROWS)
    if kind == "pins":  # a restart closes every pin
        return rows.filter("device_id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").withColumn("active_until_ms", F.lit(0).cast("long"))
    return rows.filter("listener_id IS NOT NULL AND transmitter_id IS NOT NULL AND w > 0 AND sum_n IS NOT NULL AND sum_n2 IS NOT NULL AND last_ms > 0")


def _put(spark: SparkSession, found: dict[str, DataFrame], path: str) -> None:
    """Writes all parts first, then switches to them in one step."""
    names = {kind: _write(rows, kind, path) for kind, rows in found.items()}
    parts = {kind: name for kind, name in names.items() if name is not None}
    if parts:
        _commit(spark, path, parts)


def export(spark: SparkSession, path: str, target: str, config: str) -> None:
    """A snapshot: the state of path and the text of the configuration, one folder; without its head, which comes last, it is refused."""
    _put(spark, {kind: load(spark, kind, path) for kind in SCHEMAS}, target)
    spark.createDataFrame([(VERSION, config)], "version int, config string").coalesce(1).write.mode("overwrite").json(f"{target}/head")


def restore(spark: SparkSession, snapshot: str, path: str) -> str:
    """Checks a snapshot as a whole, then puts its state into path; returns the configuration's text."""
    from .config import validate

    place, store = versions.files(spark, f"{snapshot}/head/_SUCCESS")
    if not store.exists(place):
        raise ValueError("not a whole snapshot")
    head = spark.read.schema("version int, config string").json(f"{snapshot}/head").first()
    if head is None or head.version != VERSION:
        raise ValueError("not a snapshot of this version")
    validate(json.loads(head.config) if head.config.strip() else {})
    _put(spark, {kind: load(spark, kind, snapshot) for kind in SCHEMAS}, path)
    return head.config
