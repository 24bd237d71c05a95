"""Small state kept beside the tables: each save is a new numbered folder, the last complete one counts."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if it is absent."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def complete(spark: SparkSession, path: str) -> list[str]:
    """Folders in a folder whose write has ended, in order."""
    return [name for name in names_in(spark, path) if "_SUCCESS" in names_in(spark, f"{path}/{name}")]


class State:
    """A JSON value in a folder that all drivers reach. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def load(self, default: Any = None) -> Any:
        done = complete(self.spark, self.path)
        return json.loads(self.spark.read.schema("state string").json(f"{self.path}/{done[-1]}").first()["state"]) if done else default

    def save(self, value: Any) -> None:
        names = names_in(self.spark, self.path)
        row = self.spark.createDataFrame([(json.dumps(value),)], "state string")
        row.coalesce(1).write.mode("error").json(f"{self.path}/{int(names[-1]) + 1 if names else 1:09d}")
