"""Sinks: versioned tables that change together, batches for the API, failure and metric rows (SNK-1 to SNK-8)."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NO_ERROR = "Error desconocido"


class CommitConflict(RuntimeError):
    """Another commit came between reading and writing."""


@dataclass(frozen=True)
class Snapshot:
    """What one pointer names. All that a change is computed from is read through one snapshot, and its number goes to commit()."""

    store: Store
    number: int
    state: dict[str, str]

    def table(self, name: str) -> DataFrame:
        """SRC-1. A table is the union of the folders that its version lists."""
        return self.store._load(name, self.state[name])

    def has_buckets(self, name: str, n: int) -> bool:
        return self.state.get(f"buckets:{name}") == str(n)

    def buckets(self, name: str, numbers: list[int]) -> DataFrame:
        """The rows of some buckets of a table that has_buckets(); the others aren't read."""
        found = [v for v in self.state[name].split(",") if int(v.rsplit("=", 1)[1]) in numbers]
        return self.store._load(name, ",".join(found)) if found else self.table(name).limit(0)


class Store:
    """Tables under one folder. A commit writes new versions of some of them and then adds one pointer.

    Readers see the versions that the last pointer names, so a commit is seen
    whole or not at all; a job that fails, or loses executors, before the
    pointer is there leaves only files that nothing names. A writer names the
    snapshot that its frames were computed from: if another commit came since,
    its own fails and can start anew. The pointer is one file, written aside and
    renamed without overwriting, so that holds for commits at the same moment
    too, as surely as the file system renames (HDFS: atomic). A commit without a
    snapshot must not depend on what was there, as an append doesn't.

    A commit with a batch (stream, number) that isn't after the stream's last
    one does nothing, which makes foreachBatch idempotent; only that last
    number is kept. An append writes its own rows alone; FANOUT folders of a
    level are merged into one of the next, so a table of n appends has about
    FANOUT * log(n) folders and each row is rewritten log(n) times. A table
    committed with `buckets` is kept by a hash of its key, so a later commit
    may replace some of its buckets.
    """

    FANOUT = 16

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(self._Path(self.path)).toUri(), spark._jsc.hadoopConfiguration())

    def _pointers(self) -> list[int]:
        folder = self._Path(f"{self.path}/_commits")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit())

    def _read(self, n: int) -> dict[str, str]:
        rows = self.spark.read.text(f"{self.path}/_commits/{n}").collect()  # one line per table
        return dict(r[0].split("=", 1) for r in rows if r[0])

    def _point(self, n: int, state: dict[str, str]) -> None:
        """Adds pointer n, or raises if another writer has."""
        aside, at = self._Path(f"{self.path}/_tmp/{uuid.uuid4().hex}"), self._Path(f"{self.path}/_commits/{n}")
        self._fs.mkdirs(at.getParent())
        out = self._fs.create(aside, False)
        out.write(bytearray("".join(f"{k}={v}\n" for k, v in sorted(state.items())), "utf-8"))
        out.close()
        no_options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._files.rename(aside, at, no_options)
        except Exception as e:
            if self._fs.exists(at):
                self._fs.delete(aside, False)
                raise CommitConflict("another commit came first") from e
            raise

    def snapshot(self) -> Snapshot:
        """The last commit, read once."""
        n = self._pointers()
        return Snapshot(self, n[-1], self._read(n[-1])) if n else Snapshot(self, 0, {})

    def state(self) -> dict[str, str]:
        """Table (or `stream:` id) -> folders (or number), as of the last commit."""
        return self.snapshot().state

    def _load(self, name: str, folders: str) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/{name}/{v}" for v in folders.split(",")))

    def table(self, name: str) -> DataFrame:
        return self.snapshot().table(name)

    def has_buckets(self, name: str, n: int) -> bool:
        return self.snapshot().has_buckets(name, n)

    def buckets(self, name: str, numbers: list[int]) -> DataFrame:
        return self.snapshot().buckets(name, numbers)

    def _write(self, name: str, df: DataFrame, level: int = 0) -> str:
        version = f"{level}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}/{version}")
        return version

    def _write_buckets(self, name: str, df: DataFrame, key: str, n: int) -> dict[int, str]:
        version, column = f"0-{uuid.uuid4().hex}", "pricelark_bucket"
        marked = df.withColumn(column, bucket(F.col(key), n))
        marked.repartition(column, F.pmod(F.xxhash64(key), F.lit(8))).write.partitionBy(column).parquet(f"{self.path}/{name}/{version}")
        made = self._fs.listStatus(self._Path(f"{self.path}/{name}/{version}"))
        names = (s.getPath().getName() for s in made)
        return {int(x.split("=")[1]): f"{version}/{x}" for x in names if x.startswith(column)}

    def _append(self, name: str, now: str | None, df: DataFrame) -> str:
        folders = [*(now.split(",") if now else []), self._write(name, df)]
        level = 0
        while sum(int(x.split("-")[0]) == level for x in folders) >= self.FANOUT:
            merged = [x for x in folders if int(x.split("-")[0]) == level]
            folders = [x for x in folders if x not in merged] + [self._write(name, self._load(name, ",".join(merged)), level + 1)]
            level += 1
        return ",".join(folders)

    def commit(self, replaced: dict[str, DataFrame] | None = None, appended: dict[str, DataFrame] | None = None, batch: tuple[str, int] | None = None, patched: dict[str, tuple[DataFrame, str, int, list[int] | None]] | None = None, base: Snapshot | None = None) -> bool:
        """SNK-2, SNK-3, SNK-4. patched: table -> rows, key, number of buckets, and the buckets to replace (None: all).

        base: the snapshot that the frames were computed from.
        """
        now = self.snapshot()
        last, state = now.number, dict(now.state)
        if batch is not None and batch[1] <= int(state.get(f"stream:{batch[0]}", "-1")):
            return False
        if base is not None and base.number != last:
            raise CommitConflict("another commit came first")
        for name, df in (replaced or {}).items():
            state[name] = self._write(name, df)
            state.pop(f"buckets:{name}", None)
        for name, df in (appended or {}).items():
            state[name] = self._append(name, state.get(name), df)
        for name, (df, key, n, numbers) in (patched or {}).items():
            kept = {int(v.rsplit("=", 1)[1]): v for v in state[name].split(",")} if numbers is not None else {}
            made = {k: v for k, v in kept.items() if k not in numbers} if numbers is not None else {}
            made |= self._write_buckets(name, df, key, n)
            state[name], state[f"buckets:{name}"] = ",".join(made[k] for k in sorted(made)), str(n)
        if batch is not None:
            state[f"stream:{batch[0]}"] = str(batch[1])
        self._point(last + 1, state)
        return True


def bucket(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def write_sorted_history(history: DataFrame, path: str, partitions: int) -> None:
    """Layout: rows of a variant together and in order of time, so row groups can be skipped by their statistics."""
    history.repartitionByRange(partitions, "variant_id").sortWithinPartitions("variant_id", "captured_at").write.parquet(path)


def save_by_variant(variants: DataFrame, history: DataFrame, buckets: int, prefix: str = "") -> tuple[str, str]:
    """SRC-1: both tables in the catalogue, in buckets of variant_id and sorted in them, so that joins, means and ranks by variant shuffle neither."""
    names = f"{prefix}variants", f"{prefix}history"
    for name, rows, order in zip(names, (variants, history), (("variant_id",), ("variant_id", "captured_at")), strict=True):
        dealt = rows.repartition(buckets, "variant_id")  # a bucket is one file
        dealt.write.mode("overwrite").bucketBy(buckets, "variant_id").sortBy(*order).saveAsTable(name)
    return names


def write_batch(items: DataFrame, path: str) -> None:
    """SNK-5: gzip JSON lines."""
    items.write.option("compression", "gzip").json(path)


def failure_rows(attempts: DataFrame) -> DataFrame:
    """SNK-7: failed attempts with their defaults."""
    return attempts.where("NOT ok").select("variant_id", F.col("attempted_at").alias("failed_at"), "url", F.coalesce(F.nullif(F.trim("error"), F.lit("")), F.lit(NO_ERROR)).alias("error"), "proxy", "strategy", F.coalesce("html", F.lit("")).alias("html"))


def metric_rows(attempts: DataFrame, always_ok: bool = False) -> DataFrame:
    """SNK-8: a metric per attempt; those of the extension always count as successes."""
    return attempts.select("site_id", "variant_id", (F.lit(True) if always_ok else F.col("ok")).alias("ok"), "method", "source", F.coalesce("confidence", F.lit(0)).alias("confidence"), F.coalesce("latency_ms", F.lit(0)).alias("latency_ms"), F.col("attempted_at").alias("recorded_at"))
