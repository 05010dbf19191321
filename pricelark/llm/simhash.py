"""SimHash near-dedup with covering locality-sensitive hashing.

Fingerprint: lower-case A-Z, words `[^\\x20\\x09-\\x0D]+`, shingles of three
words (repeats included), XXH64 with seed 42 of each; a bit is 1 if it is set
in over half of them. A text of fewer words has one shingle, one of no words
(null, empty) the fingerprint zero, which is linked like any other.

Linking (Pagh, "CoveringLSH", 2016): bit i gets a vector m(i) of GF(2)^4 other
than zero. For each of the 15 other vectors v there is a table whose key keeps
the bits i with <m(i), v> = 1. Fingerprints that differ in at most three bits
span at most three dimensions with their m(i), so some v is orthogonal to all
of them and the pair meets in that table: no pair within the radius is missed.

Work is done on distinct fingerprints, so a group of equal texts is one node.
Tables are grouped by key with a count; keys held by one fingerprint end
there. Of two fingerprints the distance is taken in SQL. Of up to BUCKET, a
search tree over the bucket yields at most n - 1 links (never all pairs). A
larger bucket isn't gathered: its members get 15 finer keys, built by the same
rule over the bits that are still free. Of 64 bits at most 32, 16 and 8 stay
free after one, two and three levels; with 8 free bits a bucket can't hold
over 256 distinct fingerprints, so three levels suffice for any BUCKET from
256 up and nothing is dropped.

Defined cases: null doc_id takes part but is never a component's id unless all
are null; rows repeated are one node; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from pricelark.llm.common import drop_rows, forget_tables, join_groups, materialise, pieces, small, with_batches
from pricelark.llm.components import components
from pricelark.llm.hashing import cut

SEED = 42
WORDS = 3
_BLANK = re.compile(rb"[\x20\x09-\x0d]")
RADIUS = 3
#: Most distinct fingerprints of a bucket that one task compares.
BUCKET = 2048


def fingerprint(data: bytes | None) -> int:
    """Bits are counted piece by piece; the last words of a piece are carried into the next."""
    digest = xxhash.xxh64_intdigest
    ones, total, words = np.zeros(64, dtype=np.int64), 0, []

    def count(shingles: list[bytes]) -> None:
        nonlocal ones, total
        hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(shingles)

    for piece in cut(data or b"", _BLANK):
        words = words[-(WORDS - 1) :] + piece.lower().split()
        if len(words) >= WORDS:
            count([b" ".join(x) for x in zip(words, words[1:], words[2:], strict=False)])
    if not total and words:
        count([b" ".join(words)])
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0]) if total else 0


def _map_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget_tables("simhash")
    for b in pieces(batches, "data"):
        found = np.array([fingerprint(x.as_py()) for x in b.column("data")], dtype=np.uint64).view(np.int64)
        kept = [n for n in b.schema.names if n != "data"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array(found)], names=[*kept, "fp"])


def _whole(docs: DataFrame) -> bool:
    """Whether ids are whole numbers by their type."""
    return isinstance(docs.schema["doc_id"].dataType, IntegralType)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp (the 64 bits as a long) for every row; `name`, the id as text, too if ids are of another type than whole numbers."""
    name = [] if _whole(docs) else [F.col("doc_id").cast("string").alias("name")]
    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), *name, F.col("text").cast("binary").alias("data"))
    return with_batches(rows).mapInArrow(_map_fingerprints, f"doc_id long, text_hash long, {'name string, ' if name else ''}fp long")


def covering_masks(kept: int = 0) -> list[int]:
    """The 15 masks over the bits that `kept` leaves free, each together with kept."""
    free = [i for i in range(64) if not kept >> i & 1]
    masks = set()
    for v in range(1, 16):
        masks.add(kept | sum(1 << bit for j, bit in enumerate(free) if (v & (j % 15 + 1)).bit_count() & 1))
    return sorted(masks)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks_of(spark: SparkSession, level: int) -> DataFrame:
    """mask -> its finer masks, at most 15 to the power of level rows: fixed by rule, whatever the data."""
    at = [0]
    for _ in range(level):
        at = sorted({m for k in at for m in covering_masks(k)})
    rows = [(_signed(k), [_signed(m) for m in covering_masks(k)]) for k in at]
    return spark.createDataFrame(rows, "coarse long, finer array<long>")


def tree_links(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links of a spanning forest of the values within the radius of each other."""
    left, links = values, []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= radius
            if near.any():
                found = left[near]
                left = left[~near]
                queue.extend(found)
                links.extend((int(at), int(x)) for x in found)
    return links


def _map_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        links = [x for fps in b.column("fps") for x in tree_links(fps.values.to_numpy(zero_copy_only=False).view(np.uint64))]
        ends = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["u", "v"])


def _among(keys: DataFrame, buckets: DataFrame) -> DataFrame:
    """Keys that are in `buckets`, which is broadcast only if it is small."""
    return keys.join(F.broadcast(buckets) if small(buckets) else buckets, ["mask", "key"])


def near_links(fps: DataFrame) -> DataFrame:
    """Links (u, v) that connect all distinct `fp` within RADIUS; connectivity is complete."""
    spark = fps.sparkSession
    found = []
    first = F.array(*(F.lit(_signed(m)).cast("long") for m in covering_masks()))
    keys = fps.select("fp", F.explode(first).alias("mask"))
    for level in range(3):
        if level:
            finer = F.broadcast(_masks_of(spark, level))
            keys = keys.join(finer, F.col("mask") == F.col("coarse")).select("fp", F.explode("finer").alias("mask"))
        keys = keys.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        buckets = keys.groupBy("mask", "key").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1")
        buckets = materialise(buckets, "buckets")
        found.append(buckets.where((F.col("n") == 2) & (F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= RADIUS)).select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        members = _among(keys, buckets.where(F.col("n").between(3, BUCKET)).select("mask", "key"))
        lists = members.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
        found.append(lists.mapInArrow(_map_buckets, "u long, v long"))
        large = buckets.where(F.col("n") > BUCKET).select("mask", "key")
        if not large.limit(1).count():
            break
        keys = materialise(_among(keys, large).select("fp", "mask"), "large-buckets")
    links = found[0]
    for x in found[1:]:
        links = links.union(x)
    return links


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp, component_id, root for every row.

    The root (a fingerprint) tells components apart; ids may be null or repeated, so component_id may not.
    """
    rows = materialise(fingerprints(docs), "fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("rows")), "fingerprint-nodes")
    roots = components(near_links(nodes.select("fp")))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least_id", "rows", F.coalesce("root", "fp").alias("root"))
    named = materialise(named, "fingerprint-roots")
    heads = named.groupBy(F.col("root").alias("head")).agg(F.min("least_id").alias("component_id"), F.count("*").alias("size"))
    ids = join_groups(named, heads, "root", "head", "size").select(F.col("fp").alias("node"), "component_id", "root", "rows")
    return join_groups(rows, ids, "fp", "node", "rows").select(*rows.columns, "component_id", "root")


def _keep_named(docs: DataFrame, found: DataFrame) -> DataFrame:
    """keep_one() where ids aren't whole numbers by type: least whole number first, then least hash of the text, then least id as text."""
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "name")
    heads = materialise(found.groupBy(F.col("root").alias("c")).agg(F.min(rank).alias("stays"), F.count("*").alias("n")), "near-heads")
    gone = join_groups(found, heads, "root", "c", "n").where(~rank.eqNullSafe(F.col("stays"))).select(F.col("name").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
    gone = materialise(gone.distinct(), "gone")
    same = docs["doc_id"].cast("string").eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_hash"])
    return docs.join(F.broadcast(gone) if small(gone) else gone, same, "left_anti").dropDuplicates(["doc_id", "text"])


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, the one with its smallest doc_id."""
    found = materialise(near_dedup(docs), "near-found")
    if not _whole(docs):
        return _keep_named(docs, found)
    gone = found.where("component_id IS DISTINCT FROM doc_id").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
    # Only components whose least id is repeated, or that have no id, have several rows here; the least text hash stays.
    heads = found.where("component_id <=> doc_id").select("doc_id", "root", "text_hash")
    several = heads.groupBy(F.col("root").alias("c")).agg(F.min("text_hash").alias("stays"), F.count("*").alias("n")).where("n > 1")
    several = materialise(several, "near-several")
    if several.limit(1).count():
        others = heads.join(several, F.col("root") == F.col("c")).where("text_hash != stays")
        gone = gone.union(others.select("doc_id", "text_hash"))
        docs = docs.dropDuplicates(["doc_id", "text"])
    return drop_rows(docs, gone)
