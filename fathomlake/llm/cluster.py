"""The cluster's shared folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of this machine only where that is unset and the driver is all there is, as in tests."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    have = context._jsc.sc().getCheckpointDir()
    if found is None and not have.isEmpty():
        return have.get()
    if found is None and not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    found = found or tempfile.mkdtemp(prefix="checkpoints-")
    if have.isEmpty():
        context.setCheckpointDir(found)
    return found


def saved(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: its lineage ends there and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """df.where(condition), evaluated on the columns as computed.

    A filter that moves below the projection takes the columns' expressions with it, into lambdas even, where an array would be
    built again for each element. It doesn't move past a row number, and the row number is not pruned, as the filter reads it.
    """
    numbered = df.withColumn("__row_number", F.monotonically_increasing_id())
    return numbered.where(condition & (F.col("__row_number") >= 0)).drop("__row_number")
