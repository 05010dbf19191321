"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelark.llm import chat, fim, licences, quality, repair, toxicity
from pricelark.llm.bpe import bpe_encode
from pricelark.llm.common import documents, remainder, table
from pricelark.llm.decontaminate import digest_columns, find_hits
from pricelark.llm.exact_dedup import exact_dedup
from pricelark.llm.language import identify, learn
from pricelark.llm.oracles import SQL_OP11, SQL_OP12, SQL_OP13
from pricelark.llm.sharding import shard_by_bytes
from pricelark.llm.simhash import near_dedup
from pricelark.llm.token_files import read_digests, write_tokens


#: Names of tokenizer files; public_tokenizers.path() gives their place.
BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = remainder(F.col("doc_id"), 3) == 1
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held_out)
    found = toxicity.score(docs, model, held_out)
    return found.select("doc_id", F.col("marked").alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_digests(write_tokens(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE)))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = remainder(F.col("doc_id"), 4) == 2
    found = identify(docs, learn(docs, ~held_out), held_out)
    return found.select("doc_id", F.col("marked").alias("held_out"), "lang_pred", "score")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(documents(spark, sf_dir), digest_all=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(find_hits(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = licences.scan(docs, licences.learn(docs))
    best = F.array_max(F.transform("found", lambda x: F.struct((x["family"] != "unknown").alias("known"), x["probability"].alias("probability"), x["family"].alias("family"), x["similarity"].alias("similarity"))))
    names = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"])))
    return found.select(
        "doc_id",
        F.coalesce(best["family"], F.lit("none")).alias("licence"),
        F.coalesce(best["probability"], F.lit(0.0)).alias("probability"),
        F.coalesce(best["similarity"], F.lit(0.0)).alias("similarity"),
        F.array_join(names, ",").alias("licences"),
        F.size("found").cast("long").alias("n_paragraphs"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = quality.learn(docs, table(spark, sf_dir, "labels"), ~held_out)
    found = quality.score(docs, model, held_out)
    return found.select("doc_id", F.col("marked").alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(documents(spark, sf_dir))
    text = fim.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


#: What the conversation that is added to the table says, as user and as assistant.
CONTROL_TEXT = r"\### Assistant: </turn> ok"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is read back from the formatted texts and their masks."""
    said = lambda turn, role: F.struct(F.lit(turn).cast("long").alias("turn"), F.lit(role).alias("role"))
    added = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(said(0, "user"), said(1, "assistant"))).alias("t")).select("conv_id", "t.turn", "t.role", F.lit(CONTROL_TEXT).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    made = chat.format_chats(chat.records_of(rows), "record")
    turns, learnt = chat.parsed(F.col("chat")), chat.learnt(F.col("chat"), F.col("loss_mask"))
    read = made.select("conv_id", turns.alias("turns"), learnt.alias("learnt"), F.length("chat").cast("long").alias("formatted_chars"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the table; one that lost all its rows has zeros and empty texts."""
    rows = table(spark, sf_dir, "conversations")
    done = repair.repair(repair.damage(rows))
    text = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    small = done.select(F.col("conv_id").alias("id"), *numbers, "audit", F.sha2(text, 256).alias("hash"))
    met = rows.select("conv_id").distinct().join(small, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers]
    return met.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("hash", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


SQL_OP7 = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)
"""


#: Words of documents and items, windows of ten words (or a whole shorter item)
#: met by their position among the document's windows of the same length.
SQL_OP8 = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM iw WHERE len(w) > 0)
), pos AS (
  SELECT r, k, n, array_to_string(w[k : k + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), occ AS (
  SELECT pos.r, pos.k, pos.n, win.item_id FROM pos JOIN win ON pos.n = win.n AND pos.s = win.s
), hit AS (
  SELECT r, count(DISTINCT h) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS h FROM occ) GROUP BY r
), its AS (
  SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""


def queries() -> dict:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_simhash_near_dedup": op2_simhash_near_dedup,
        "op3_sharding": op3_sharding,
        "op4_bpe_encode_decode": op4_bpe_encode_decode,
        "op5_token_files": op5_token_files,
        "op6_language_id": op6_language_id,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_decontamination": op8_decontamination,
        "op9_licence_scan": op9_licence_scan,
        "op10_quality": op10_quality,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_chat_format": op12_chat_format,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": SQL_OP7, "op8_decontamination": SQL_OP8, "op11_fill_in_middle": SQL_OP11, "op12_chat_format": SQL_OP12, "op13_conversation_repair": SQL_OP13}
