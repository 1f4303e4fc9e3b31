"""The streaming twin: the same state machines over an unbounded stream of observations.

Messages come from any Structured Streaming source with the columns of `OBS`;
state lives in Spark's state store, one small record per key, so a key's
history is never gathered.  Within a micro-batch the rows of a key are taken in
the order of (t_ms, seq), as the batch queries do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OBS = "seq long, t_ms long, device_id string, node_id string, name string, distance double, rssi double"
TAU_MS, GAP_MS, LEAST = 2000.0, 30_000, 0.05
AWAY_MS = 2000


def observations(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of observation files."""
    return spark.readStream.schema(OBS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def late_dropped(stream: DataFrame, delay: str = "30 seconds") -> DataFrame:
    """The stream with event time `ts` and a watermark, for windows and joins."""
    return stream.withColumn("ts", F.timestamp_millis("t_ms")).withWatermark("ts", delay)


def _ordered(frames: Iterator[pd.DataFrame], *columns: str) -> list[np.ndarray]:
    rows = pd.concat(list(frames)).sort_values(["t_ms", "seq"], kind="stable")
    return [rows[c].to_numpy() for c in columns]


def smoothed(stream: DataFrame) -> DataFrame:
    """Exponentially smoothed distance and variance of every (device, node), as of its last message of each micro-batch."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t, mean, variance, n = state.get if state.exists else (None, 0.0, 0.0, 0)
        for now, d in zip(*_ordered(frames, "t_ms", "distance"), strict=True):
            if t is None or now - t >= GAP_MS:
                mean, variance = float(d), 0.0
            else:
                # time that runs backwards counts as none
                share = min(max(1 - np.exp(-max(now - t, 0) / TAU_MS), LEAST), 1.0)
                moved = mean + share * (d - mean)
                variance = max((1 - share) * variance + share * (d - mean) * (d - moved), 0.0)
                mean = moved
            t, n = int(now), n + 1
        state.update((t, float(mean), float(variance), n))
        yield pd.DataFrame({"device_id": [key[0]], "node_id": [key[1]], "t_ms": [t], "mean": [mean], "variance": [variance], "n": [n]})

    return stream.filter("distance IS NOT NULL").groupBy("device_id", "node_id").applyInPandasWithState(
        fold, "device_id string, node_id string, t_ms long, mean double, variance double, n int", "t long, mean double, variance double, n int", "update", GroupStateTimeout.NoTimeout
    )


def presence(stream: DataFrame) -> DataFrame:
    """Changes of every device's place (`name`), and `not_home` once it was silent for AWAY_MS of its own time."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, place = state.get if state.exists else (None, None)
        out = []
        for seq, now, name in zip(*_ordered(frames, "seq", "t_ms", "name"), strict=True):
            if last is not None and now - last > AWAY_MS:
                out.append((key[0], int(seq), int(last + AWAY_MS), "not_home"))
                place = None
            if name != place:
                out.append((key[0], int(seq), int(now), name))
                place = name
            last = int(now)
        state.update((last, place))
        yield pd.DataFrame(out, columns=["device_id", "seq", "t_ms", "state"])

    return stream.groupBy("device_id").applyInPandasWithState(
        fold, "device_id string, seq long, t_ms long, state string", "last long, place string", "append", GroupStateTimeout.NoTimeout
    )


def latest(stream: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that gives `publish` each micro-batch's last row per device, with the batch's number for sinks that must not repeat it."""

    def each(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("device_id").agg(F.max_by(F.struct(*batch.columns), F.struct("t_ms", "seq")).alias("r")).select("r.*")
        publish(newest, number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, width: str = "1 minute") -> DataFrame:
    """Messages and mean distance by node and tumbling window, once the watermark has passed it."""
    timed = late_dropped(stream)
    return timed.groupBy(F.window("ts", width), "node_id").agg(F.count("*").alias("n"), F.avg("distance").alias("mean")).select(F.col("window.start").alias("start"), "node_id", "n", "mean")
