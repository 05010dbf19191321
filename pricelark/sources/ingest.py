"""Sources of captures (SRC-1 to SRC-4, SRC-7, SRC-9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelark import schemas
from pricelark.functions.text import blank

#: Bytes of a page: default and most.
PAGE_BYTES, PAGE_BYTES_MOST = 5 << 20, 6 << 20


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-1: a domain table with its declared schema; nothing is inferred."""
    return spark.read.schema(schema).parquet(path)


def footer_count(spark: SparkSession, path: str) -> DataFrame:
    """SRC-9: one row with the number of rows of a saved table, from the files' footers alone.

    Only the newer reader of Parquet hands counts to the footers; a session of
    its own has it switched on, so the caller's settings stay.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "avro,csv,json,kafka,orc,text")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own.read.parquet(path).agg(F.count("*").alias("rows"))


def row_count(spark: SparkSession, path: str) -> int:
    """SRC-9."""
    return footer_count(spark, path).first()["rows"]


def read_bulk(spark: SparkSession, path: str) -> DataFrame:
    """SRC-2: files that are a JSON array of price items each, gzip or not. One file is one batch, and one task."""
    return spark.read.schema(schemas.BULK_ITEM).option("multiLine", True).json(path)


def stream_bulk(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """SRC-2 as a stream of files; `files` per batch bounds a batch."""
    return spark.readStream.schema(schemas.BULK_ITEM).option("multiLine", True).option("maxFilesPerTrigger", files).json(path)


def parse_extension(bodies: DataFrame, column: str = "body") -> DataFrame:
    """SRC-3: items with a SKU and a URL; others, and what isn't JSON, are rejected."""
    item = F.from_json(column, schemas.EXTENSION_ITEM).alias("item")
    return bodies.select(item).select("item.*").where(~blank(F.col("sku")) & ~blank(F.col("url")))


def capture_status(url: Column, html: Column, limit: int | None = None) -> Column:
    """SRC-4: 200, 400 for a blank page or a URL that isn't absolute http(s), 413 for a page over the limit."""
    most = min(max(limit or PAGE_BYTES, 1), PAGE_BYTES_MOST)
    scheme, host = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.try_parse_url(url, F.lit("HOST"))
    sound = F.coalesce(scheme.isin("http", "https") & host.isNotNull(), F.lit(False))
    return F.when(blank(html), 400).when(~sound, 400).when(F.octet_length(html) > most, 413).otherwise(200)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """SRC-7: saved pages `{domain}_{timestamp}.html` as domain, saved_at (text), html. A file is one row."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    got = spark.read.text(path, wholetext=True).select(name.alias("file"), F.col("value").alias("html"))
    return got.select("file", F.regexp_extract("file", r"^(.+?)_[^_]*\.html$", 1).alias("domain"), F.regexp_extract("file", r"_([^_]*)\.html$", 1).alias("saved_at"), "html")
