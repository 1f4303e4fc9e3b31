"""Positions of a live stream: the tracker of `operators.tracking` with its state in Spark's state store, and timers for silence.

Each device is a key; its state (bounded, see `tracking.STATE`) is one value
that expires after `keep_ms` without a message.  A processing-time timer runs
out `away_ms` after a device's last message, so `not_home` comes although no
further message of that device arrives.  Within a micro-batch the rows of a
device are taken in order of time, and at equal times what users do first, as
`tracking.replay` does.

The session needs the RocksDB state store (`STORE`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import _parse_datatype_string

from ..operators.tracking import OUT, Scene, Settings, Tracker, to_batches
from ..sources import versions

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
IN = "device_id string, kind string, seq long, t_ms long, node_id string, distance double, rssi double, x double, y double, z double"
KEEP_MS = 30 * 86_400_000


class Live(StatefulProcessor):
    """One device's tracker between micro-batches."""

    def __init__(self, scene: Scene, settings: Settings, keep_ms: int):
        self.scene, self.settings, self.keep_ms = scene, settings, keep_ms
        self.rows, self.out = (to_arrow_schema(_parse_datatype_string(x)) for x in (IN, OUT))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("device", "data binary", self.keep_ms)

    def _tracker(self, device: str) -> Tracker:
        tracker = Tracker(self.scene, self.settings)
        if self.kept.exists():
            tracker.load(device, bytes(self.kept.get()[0]))
        else:
            tracker.devices([device])
        return tracker

    def _frames(self, parts: list[dict]) -> Iterator[pd.DataFrame]:
        for batch in to_batches(parts, self.out):
            yield batch.to_pandas()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tracker = self._tracker(key[0])
        frame = pd.concat(list(rows))
        frame = frame.iloc[np.lexsort((frame["seq"], frame["kind"] == "message", frame["t_ms"]))]
        batch = pa.RecordBatch.from_pandas(frame[self.rows.names], schema=self.rows, preserve_index=False)
        parts = tracker.run(batch)
        self.kept.update((tracker.dump(key[0]),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.settings.away_ms)
        yield from self._frames(parts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        tracker = self._tracker(key[0])
        gone, due = tracker.away(np.array([0]), np.array([np.inf]))
        if len(gone):
            self.kept.update((tracker.dump(key[0]),))
            yield from self._frames([tracker._away_rows(gone, due)])

    def close(self) -> None:
        pass


def live(stream: DataFrame, scene: Scene, settings: Settings = Settings(), keep_ms: int = KEEP_MS) -> DataFrame:  # noqa: B008  frozen
    """Rows as `tracking.replay` gives them (but for pins) for a stream of rows as `IN`."""
    return stream.groupBy("device_id").transformWithStateInPandas(
        statefulProcessor=Live(scene, settings, keep_ms), outputStructType=_parse_datatype_string(OUT), outputMode="Append", timeMode="ProcessingTime"
    )


STATES = "device_id string, state binary"


def in_batches(stream: DataFrame, current: Callable[[], tuple[str, Scene]], path: str, publish: Callable[[DataFrame, int], None], settings: Settings = Settings()):  # noqa: B008
    """Starts a query whose house may change while it runs.

    `current` is asked at every micro-batch for the version of the house and its
    scene.  States are a table per batch; with another version they start anew,
    as rooms and nodes are no longer the same.  Rows and states of a batch are
    written first, then its number is noted, and then `publish` gets the rows;
    a batch that is repeated is computed once and published again.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = f"{path}/batches/{number:012d}"
        _, done = versions.last(spark, f"{path}/done")
        if done is None or done["number"] < number:
            version, scene = current()
            known = done is not None and done["version"] == version
            states = spark.read.parquet(done["folder"]).filter("state IS NOT NULL").select("device_id", "state") if known else spark.createDataFrame([], STATES)
            _stepped(batch, states, scene, settings).write.mode("overwrite").parquet(folder)
            versions.append(spark, f"{path}/done", {"number": number, "version": version, "folder": folder})
        publish(spark.read.parquet(folder).filter("state IS NULL").drop("state"), number)
        old, store = versions.files(spark, f"{path}/batches/{number - 2:012d}")
        store.delete(old, True)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint")


def _stepped(batch: DataFrame, states: DataFrame, scene: Scene, settings: Settings) -> DataFrame:
    """The rows that a micro-batch gives, and the states after it."""
    rows, out = (to_arrow_schema(_parse_datatype_string(x)) for x in (IN, OUT))
    out = out.append(pa.field("state_after", pa.binary()))

    def step(key: tuple, mine: pa.Table, kept: pa.Table) -> pa.Table:
        device = key[0].as_py()
        tracker = Tracker(scene, settings)
        if kept.num_rows:
            tracker.load(device, kept.column("state")[0].as_py())
        parts = []
        if mine.num_rows:
            table = mine.select(rows.names).append_column("act", pa.array([k == "message" for k in mine.column("kind").to_pylist()]))
            table = table.sort_by([("t_ms", "ascending"), ("act", "ascending"), ("seq", "ascending")]).select(rows.names).cast(rows).combine_chunks()
            parts = tracker.run(table.to_batches()[0])
        parts.append({"device_id": [device], "state_after": [tracker.dump(device)]})
        return pa.Table.from_batches(list(to_batches(parts, out)), out)

    own = batch.select(*rows.names)
    done = own.groupBy("device_id").cogroup(states.groupBy("device_id")).applyInArrow(step, OUT + ", state_after binary")
    return done.withColumnRenamed("state", "reported").withColumnRenamed("state_after", "state")
