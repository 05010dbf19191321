"""Tables between steps, in the folder that the cluster names in spark.checkpoint.dir.

Writing a table cuts lineage: a lost executor costs a re-read, not a
recomputation.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def setting(spark: SparkSession, key: str, default: str) -> str:
    try:
        return spark.conf.get(key) or default
    except Exception:  # an unset key without a default raises
        return default


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(setting(spark, "spark.sql.shuffle.partitions", "200")))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder. Only a session on one machine may do without one; it gets a local folder."""
    base = setting(spark, "spark.checkpoint.dir", "")
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pricelark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone at exit
        pass


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes tables made by materialise() that nothing reads any more."""
    for f in frames:
        path = getattr(f, "_scratch_path", None)
        if path:
            _delete(spark, path)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A path for a new table in the shared folder; what is there when the process ends is deleted."""
    path = f"{scratch_dir(spark)}/pricelark/{tag}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def materialise(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back; it is deleted when the process ends."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out
