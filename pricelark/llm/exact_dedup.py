"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Two texts are equal when they are identical after lower-casing A-Z; a null
text counts as empty. Of a group of equal texts the row with the largest
doc_id stays.

1. `length`: byte lengths that occur once belong to texts without a copy.
2. `head`: among the others, a hash of the first bytes splits the groups.
3. `full`: only rows whose (length, head) occurs again are read whole and
   hashed with SHA-256; groups of equal hashes are the groups of copies.

Steps 1 and 2 pass on the set of keys that occur more than once. It is
broadcast when it has no more rows than `common.BROADCAST_ROWS`, and texts stay
where they are. A larger set is joined by a shuffle of the rows that the step
before left open; keys that hold more than a HOT_GROUPS-th of them are
broadcast first, so a hot key's rows aren't shuffled. Every grouping combines
before its shuffle, so a group with a third of all rows costs one row per
task. Results are handed back by a join that broadcasts hot groups only.

A caller that asks for every text's digest (digest_all, as op7's contract
does) has all texts hashed; the steps then only keep the grouping small.

Defined cases: null text = ''; null doc_id ranks below every other and is
returned as null; rows repeated with the same id and text are counted each in
group_size and exactly one of them is kept; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelark.llm.common import HOT_GROUPS, HOT_ROWS, drop_rows, join_groups, lower_ascii, materialise, small

#: Bytes of the prefix that the second step hashes.
HEAD_CHARS = 64


def _gate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Leaves open only rows whose key occurs more than once among open rows."""
    again = rows.where("open").groupBy(*keys).agg(F.count("*").alias("g_n")).where("g_n > 1").select(*(F.col(k).alias(f"g_{k}") for k in keys), "g_n")
    again = materialise(again, "exact-again")

    def mark(some: DataFrame, seen: DataFrame) -> DataFrame:
        met = some.join(seen, [some[k] == seen[f"g_{k}"] for k in keys], "left")
        return met.withColumn("open", F.col("open") & F.col("g_n").isNotNull()).drop("g_n", *(f"g_{k}" for k in keys))

    if small(again):
        return mark(rows, F.broadcast(again))
    total = again.agg(F.sum("g_n")).first()[0] or 0
    most = max(HOT_ROWS, total // HOT_GROUPS)
    hot = F.broadcast(again.where(F.col("g_n") > most))  # at most HOT_GROUPS rows
    on = [rows[k] == hot[f"g_{k}"] for k in keys]
    closed, left = rows.where("NOT open"), rows.where("open")
    return closed.unionByName(left.join(hot, on, "left_semi")).unionByName(mark(left.join(hot, on, "left_anti"), again.where(F.col("g_n") <= most)))


def exact_dedup(docs: DataFrame, digest_all: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, copies, text_hash, text_sha256.

    copies: rows of the group that have its largest doc_id (more than 1 only
    for repeated rows). text_hash and text_sha256 are null for texts that
    needn't be read whole, unless digest_all is set.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "text", F.octet_length(text).alias("length"), F.lit(True).alias("open"))
    rows = _gate(rows, ["length"])
    rows = rows.withColumn("head", F.when(F.col("open"), F.xxhash64(lower_ascii(F.substring(text, 1, HEAD_CHARS)))))
    rows = _gate(rows, ["length", "head"])
    whole = lambda x: x if digest_all else F.when(F.col("open"), x)
    rows = rows.select("doc_id", whole(F.xxhash64("text")).alias("text_hash"), "open", whole(F.sha2(lower_ascii(text), 256)).alias("text_sha256"))
    rows = materialise(rows, "exact-keys")

    open_rows = rows.where("open")
    by_id = open_rows.groupBy("text_sha256", "doc_id").agg(F.count("*").alias("n"))
    groups = by_id.groupBy(F.col("text_sha256").alias("g_sha")).agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"), F.max(F.struct(F.col("doc_id"), F.col("n")))["n"].alias("copies")).where("group_size > 1")
    groups = materialise(groups, "exact-groups")
    found = join_groups(open_rows, groups, "text_sha256", "g_sha", "group_size")
    found = found.withColumns({"single": F.col("g_sha").isNull(), "group_size": F.coalesce("group_size", F.lit(1)), "copies": F.coalesce("copies", F.lit(1))})
    found = found.withColumn("keep_id", F.when(F.col("single"), F.col("doc_id")).otherwise(F.col("keep_id")))
    found = found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))

    out = ["doc_id", "keep_id", "group_size", "kept", "copies", "text_hash", "text_sha256"]
    plain = found.where(~(F.col("kept") & (F.col("copies") > 1))).select(*out)
    one = Window.partitionBy("doc_id", "text_sha256").orderBy("text_hash")
    repeated = found.where(F.col("kept") & (F.col("copies") > 1)).withColumn("kept", F.row_number().over(one) == 1).select(*out)
    alone = rows.where("NOT open").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lit(1).cast("long").alias("copies"), "text_hash", "text_sha256")
    return plain.unionByName(repeated).unionByName(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without exact copies, with all its columns."""
    found = materialise(exact_dedup(docs), "exact-found")
    gone = found.where("keep_id IS DISTINCT FROM doc_id").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
    left = drop_rows(docs, gone)
    if found.where("copies > 1").limit(1).count():
        key = "pricelark_exact_key"
        left = left.withColumn(key, F.sha2(lower_ascii(F.coalesce(F.col("text"), F.lit(""))), 256)).dropDuplicates(["doc_id", key]).drop(key)
    return left
