"""A saved index of 3-grams for searches by contained text (FLT-8, TOP-9).

The index is two plain Parquet tables: postings(gram, id), each pair once, and
counts(gram, n). A file of postings holds a share of the ids, in the order of
gram and id. A search reads the counts of its text's grams, then only the
postings of the rarest ones: row groups and pages that can't hold them are
skipped by their statistics. What is found are the ids
of all rows that may hold the text; the caller's own rule decides among them,
so an index changes what is read and never the result.

Grams are taken of folded text (lower case, both forms of the Greek sigma as
one), so that searches with and without regard to case share an index. Every
place of a text begins a gram, the last two shorter ones, so a search of one or
two characters is a search by the beginning of grams.

Writing shuffles the texts once, by id, and never the grams, which are many
times larger: a gram that all texts hold (of `https://`, say) is divided by its
ids. The texts of one id are read by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelark.scratch import shuffle_partitions

WIDTH = 3
#: Grams of a search whose postings are read and met by id, the rarest first.
READ = 3
#: A search is a scan if even its rarest gram is held by more than this share of the ids.
SHARE = 0.25
#: Bytes of a row group of postings: small, as a search reads a few grams.
ROW_GROUP = 8 << 20


def folded(text: str) -> str:
    return text.lower().replace("ς", "σ")


def _grams(text: Column) -> Column:
    text = F.translate(F.lower(text), "ς", "σ")
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text)), lambda at: F.substr(text, at, F.lit(WIDTH))))


def write_postings(texts: DataFrame, path: str) -> None:
    """Writes the index of texts(id, text) to a new folder. An id may have several texts; null ids, null and empty texts aren't indexed.

    The row '' of counts holds the number of ids.
    """
    spark = texts.sparkSession
    spread = shuffle_partitions(spark)
    dealt = texts.where("id IS NOT NULL AND text <> ''").select("id", "text").repartition(spread, "id")
    held = dealt.select("id", F.explode(_grams(F.col("text"))).alias("gram")).distinct()  # an id is in one task: no shuffle
    held.select("gram", "id").sortWithinPartitions("gram", "id").write.option("parquet.block.size", str(ROW_GROUP)).parquet(f"{path}/postings")
    written = spark.read.parquet(f"{path}/postings")
    counts = written.groupBy("gram").agg(F.count("*").alias("n"))
    ids = written.agg(F.lit("").alias("gram"), F.count_distinct("id").alias("n"))
    counts.unionByName(ids).repartitionByRange(spread, "gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")


def candidates(spark: SparkSession, path: str, text: str) -> DataFrame | None:
    """The ids of rows that may hold the text, each once; None if the index can't leave enough of them out.

    All that hold it are among them. At most a row for each character of the
    text comes to the driver.
    """
    q = folded(text)
    if not q:
        return None
    postings, counts = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/counts")
    if len(q) < WIDTH:
        return postings.where(F.startswith("gram", F.lit(q))).select("id").distinct()
    asked = {q[k : k + WIDTH] for k in range(len(q) - WIDTH + 1)}
    often = {r["gram"]: r["n"] for r in counts.where(F.col("gram").isin("", *sorted(asked))).collect()}
    ids = often.pop("", 0)
    if len(often) < len(asked):  # a gram that no text holds
        return postings.where("false").select("id")
    rare = sorted(asked, key=lambda g: (often[g], g))[:READ]
    if often[rare[0]] > SHARE * ids:
        return None
    met = postings.where(F.col("gram").isin(*rare)).groupBy("id").agg(F.count("*").alias("n"))
    return met.where(F.col("n") == len(rare)).select("id")


def product_texts(products: DataFrame) -> DataFrame:
    """(id, text): names, brands and categories by product."""
    return products.select(F.col("product_id").alias("id"), F.explode(F.array("product_name", "brand", "category")).alias("text"))


def catalog_texts(products: DataFrame, variants: DataFrame) -> DataFrame:
    """(id, text): what a search of the catalogue looks into, by product: names, brands, categories, URLs and SKUs."""
    return product_texts(products).unionByName(variants.select(F.col("product_id").alias("id"), F.explode(F.array("url", "sku")).alias("text")))


def narrowed(rows: DataFrame, ids: DataFrame | None, key: str = "product_id") -> DataFrame:
    """The rows of a search's candidates; all rows if there is no list of them."""
    return rows if ids is None else rows.join(ids.withColumnRenamed("id", key), key, "left_semi")
