"""A change feed of positions: each tick's last row of every device, a snapshot first, and consumers that go on where they stopped.

A tick is a micro-batch.  Its changes are one folder named by its number, so a
batch that is repeated after a failure replaces its own tick.  A consumer with
no offset, or one from before the last compaction, gets a snapshot; after that,
the last row of each device that changed since its offset.  An empty tick is a
heartbeat: it moves the offset and gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import versions


def newest(rows: DataFrame) -> DataFrame:
    """The last row of each device by (tick and) time."""
    order = [c for c in ("tick", "t_ms", "seq") if c in rows.columns]
    return rows.groupBy("device_id").agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns]), F.struct(*order)).alias("r")).select("r.*")


def sink(path: str) -> Callable[[DataFrame, int], None]:
    """What `foreachBatch` calls to publish a micro-batch."""

    def each(batch: DataFrame, number: int) -> None:
        newest(batch).write.mode("overwrite").parquet(f"{path}/ticks/tick={number + 1:012d}")

    return each


@dataclass
class Answer:
    """What a consumer gets: rows, the offset to come back with, and whether it is a snapshot."""

    rows: DataFrame
    offset: int
    snapshot: bool


def _ticks(spark: SparkSession, path: str) -> list[int]:
    """Ticks that are complete."""
    place, store = versions.files(spark, f"{path}/ticks")
    if not store.exists(place):
        return []
    names = [x.getPath() for x in store.listStatus(place) if x.getPath().getName().startswith("tick=")]
    return sorted(int(x.getName()[5:]) for x in names if store.exists(versions.files(spark, f"{x}/_SUCCESS")[0]))


def poll(spark: SparkSession, path: str, offset: int | None = None) -> Answer:
    """The changes after `offset`, or all devices."""
    ticks = _ticks(spark, path)
    _, base = versions.last(spark, f"{path}/base")
    start = base["upto"] if base else 0
    whole = offset is None or offset < start
    wanted = [t for t in ticks if t > (start if whole else offset)]
    rows = None
    if whole and base:
        rows = spark.read.parquet(f"{path}/bases/{base['name']}").withColumn("tick", F.lit(start))
    for t in wanted:
        part = spark.read.parquet(f"{path}/ticks/tick={t:012d}").withColumn("tick", F.lit(t))
        rows = part if rows is None else rows.unionByName(part)
    upto = max([*wanted, start, offset or 0])
    if rows is None:
        if not ticks:
            raise ValueError("the feed has no tick yet")
        rows = spark.read.parquet(f"{path}/ticks/tick={ticks[-1]:012d}").limit(0).withColumn("tick", F.lit(0))
    return Answer(newest(rows).drop("tick"), upto, whole)


def compact(spark: SparkSession, path: str) -> int:
    """Puts all ticks so far into one base, then removes them; the last tick it holds."""
    answer = poll(spark, path)
    name = f"upto-{answer.offset:012d}"
    answer.rows.write.mode("overwrite").parquet(f"{path}/bases/{name}")
    versions.append(spark, f"{path}/base", {"upto": answer.offset, "name": name})
    for t in _ticks(spark, path):
        # the last tick stays, so that there is always one to read the columns from
        if t < answer.offset:
            place, store = versions.files(spark, f"{path}/ticks/tick={t:012d}")
            store.delete(place, True)
    return answer.offset


def follow(spark: SparkSession, path: str, consumer: str) -> Answer:
    """The next answer for a named consumer; `done` moves its offset on."""
    _, found = versions.last(spark, f"{path}/consumers/{consumer}")
    return poll(spark, path, found["offset"] if found else None)


def done(spark: SparkSession, path: str, consumer: str, answer: Answer) -> None:
    """Notes that a consumer has handled an answer."""
    versions.append(spark, f"{path}/consumers/{consumer}", {"offset": answer.offset})
