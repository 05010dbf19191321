"""Readying a session for Python workers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a dimension that may be broadcast.
BROADCAST_ROWS = 1_000_000


def workers_find_package(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it (on a cluster, ship it as a py-file)."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def checked_broadcast(dimension: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A dimension with a broadcast hint if it has no more than `rows` rows, and one that keeps Spark from it otherwise.

    Estimates of a joined dimension multiply, so without the hint Spark may
    take the fact table for the smaller side. Those of a file go by its size on
    disk, so that repeating texts would be broadcast whatever their number.
    """
    return F.broadcast(dimension) if dimension.count() <= rows else dimension.hint("merge")
