"""Small numbered files in a shared folder, as the one thing that is switched when several parts change at once.

A new number is created exclusively, so of two writers one has to take the next
number; a file that is not whole (its writer died) does not parse and is not
read.  Works on any store that Spark's file systems reach.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession


def files(spark: SparkSession, path: str):
    """A path and its file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers that were begun, in order."""
    place, store = files(spark, folder)
    if not store.exists(place):
        return []
    return sorted(int(x.getPath().getName()[:-5]) for x in store.listStatus(place) if x.getPath().getName().endswith(".json"))


def read(spark: SparkSession, folder: str, number: int) -> Any | None:
    """What was written under a number; None if it is not whole."""
    place, store = files(spark, f"{folder}/{number:012d}.json")
    stream = store.open(place)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    except ValueError:
        return None
    finally:
        stream.close()


def last(spark: SparkSession, folder: str) -> tuple[int, Any]:
    """The highest number that is whole, and what it holds; (0, None) before the first."""
    for number in reversed(numbers(spark, folder)):
        found = read(spark, folder, number)
        if found is not None:
            return number, found
    return 0, None


def append(spark: SparkSession, folder: str, what: Any) -> int:
    """Writes `what` under the next free number."""
    number = max(numbers(spark, folder), default=0)
    while True:
        number += 1
        place, store = files(spark, f"{folder}/{number:012d}.json")
        try:
            out = store.create(place, False)
        except Exception as e:  # taken by another writer
            if store.exists(place):
                continue
            raise e
        try:
            out.write(bytearray(json.dumps(what).encode()))
        finally:
            out.close()
        return number
