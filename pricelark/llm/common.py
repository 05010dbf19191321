"""Shared pieces of the training-data operators.

Every operator selects the few columns it needs by name before it does
anything else, so further columns of its input (whatever their names) never
clash with its own. Where ids are handed back as numbers, a doc_id that isn't a
whole number counts as null.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelark.scratch import discard, materialise, shuffle_partitions  # noqa: F401
from pricelark.session import workers_find_package

#: Rows of a key set that may be broadcast (16 to 24 bytes each in memory, so
#: about 50 MB). Beyond it the same step runs as a shuffled join.
BROADCAST_ROWS = 1_000_000

#: Documents, and bytes of their texts, that an operator works on at once. Spark
#: bounds what it hands over by arrow.maxBytesPerBatch (64 MB) and 10,000 rows.
PIECE_ROWS, PIECE_BYTES = 1_000, 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only. A text of ASCII alone takes lower()'s byte loop."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as decimal text, modulo n (a null id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def small(keys: DataFrame, bound: int = BROADCAST_ROWS) -> bool:
    """Whether a (written) table of keys has no more rows than may be broadcast. A limit here would bring rows to one task."""
    return keys.count() <= bound


#: A group with more than this share of all rows is hot, so at most HOT_GROUPS are.
HOT_GROUPS, HOT_ROWS = 4096, 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, group_key: str, size: str) -> DataFrame:
    """rows (a written table) left-joined with one row per group, whatever the groups' sizes.

    Hot groups are broadcast; there are at most HOT_GROUPS of them by
    arithmetic. Only rows of other groups are shuffled by their key.
    """
    most = max(HOT_ROWS, rows.count() // HOT_GROUPS)
    hot = F.broadcast(groups.where(F.col(size) > most))
    rest = groups.where(F.col(size) <= most)
    same = lambda g: rows[key] == g[group_key]
    return rows.join(hot, same(hot)).unionByName(rows.join(hot, same(hot), "left_anti").join(rest, rows[key] == rest[group_key], "left"))


def with_batches(df: DataFrame) -> DataFrame:
    """Readies a frame for Python: workers find this package."""
    workers_find_package(df.sparkSession)
    return df


def pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most PIECE_ROWS rows, and PIECE_BYTES bytes of a column unless one value is longer."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            end = int(np.searchsorted(ends, before + PIECE_BYTES, side="right"))
            end = min(max(end, at + 1), at + PIECE_ROWS, b.num_rows)
            yield b.slice(at, end - at)
            at = end


_HELD: dict = {}


def _give_back() -> None:
    """Returns freed memory to the system: allocators keep it otherwise, and a worker that goes on to another operator holds both."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def worker_table(key, make: Callable):
    """What make() made for this key in this Python worker.

    Workers serve one task after another; only the last operator's tables are
    kept, so a session that runs many operators doesn't add them up. Memory
    that the one before has freed is returned as well, whether it kept a table
    or not.
    """
    if key not in _HELD:
        _HELD.clear()
        _give_back()
        _HELD[key] = make()
    return _HELD[key]


def forget_tables(operator: str) -> None:
    """Drops what other operators left in this Python worker, for one that keeps no table."""
    worker_table(operator, lambda: None)


def drop_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose (doc_id, hash of text) is in `gone(gone_id, gone_hash)`.

    `gone` is broadcast if it is small and joined with a shuffle otherwise.
    """
    gone = materialise(gone.select("gone_id", "gone_hash").distinct(), "gone")
    if small(gone):
        gone = F.broadcast(gone)
    same = docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_hash"])
    return docs.join(gone, same, "left_anti")


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
