"""Intermediate tables that survive the loss of executors.

They are Parquet folders under the session's `spark.checkpoint.dir`.  Where
that is unset, a local session uses a temporary folder and any other session
the warehouse if it is a shared store; a cluster with neither is refused.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, tempfile.TemporaryDirectory] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master.startswith("local") and not master.startswith("local-cluster"):
            if "" not in _LOCAL:
                _LOCAL[""] = tempfile.TemporaryDirectory(prefix="rangefield-")
            found = f"file://{_LOCAL[''].name}"
        else:
            found = spark.conf.get("spark.sql.warehouse.dir")
            if ":" not in found.split("/")[0] or found.startswith("file:"):
                raise ValueError("on a cluster, set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{found.rstrip('/')}/rangefield-scratch"


def save(df: DataFrame) -> DataFrame:
    """Writes df to a new folder and returns the table read from there."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes the folder of a table made by `save`, once no later step reads it."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
