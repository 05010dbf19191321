"""Compact JSON logs (SRC-5, SRC-6, SNK-6, FLT-10, FN-30, FN-31, STF-10, TOP-8)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelark import schemas
from pricelark.functions.text import log_level_push, log_level_record

#: Source and prefix of events that workers push.
SOURCE, PREFIX = "pricelark.worker", "[Worker] "


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5: one record per line; malformed and blank lines are left out.

    Names like `log-YYYYMM.json` in the path prune whole months.
    """
    rows = spark.read.schema(schemas.LOG).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.coalesce(*(F.col(f"`{c}`") for c in rows.columns)).isNotNull()).select(*_record(lambda c: F.col(f"`{c}`")))


def _record(of: Callable[[str], Column]) -> list[Column]:
    """The columns of a log record."""
    return [
        F.to_timestamp(of("@t")).alias("at"), log_level_record(of("@l")).alias("level"), F.coalesce(of("@m"), of("@mt"), F.lit("")).alias("message"),
        of("JobId").alias("job_id"), of("TraceId").alias("trace_id"), of("ProductSKU").alias("sku"), of("SourceContext").alias("source"), of("@x").alias("exception"),
    ]


def log_lines(spark: SparkSession, path: str, first_month: str | None = None, last_month: str | None = None) -> DataFrame:
    """SRC-5, TOP-8: the records of read_logs() with where they stand: file, split (where it begins), and place_ (ascending in a split).

    Months (YYYYMM) prune files `log-YYYYMM.json` by their names before any is
    read. A split is read by one task from its beginning, so places in it don't
    depend on how splits are dealt out.
    """
    name = F.col("_metadata.file_name")
    lines = spark.read.text(path)
    if first_month:
        lines = lines.where(name >= f"log-{first_month}")
    if last_month:
        lines = lines.where(name <= f"log-{last_month}.json")
    told = F.from_json("value", f"{schemas.LOG}, bad_ string", {"columnNameOfCorruptRecord": "bad_"})
    placed = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place_"), told.alias("r"))
    any_ = F.coalesce(*(F.col("r").getField(c) for c in ("@t", "@m", "@mt", "@l", "JobId", "TraceId", "ProductSKU", "SourceContext", "@x")))
    return placed.where(F.col("r").isNotNull() & F.col("r.bad_").isNull() & any_.isNotNull()).select("file", "split", "place_", *_record(lambda c: F.col("r").getField(c)))


def log_page_by_line(lines: DataFrame, page: int, size: int) -> DataFrame:
    """TOP-8: a page of log_lines() (filtered or not) in the reverse order of the files.

    Counts of the splits (a row per split) and their running sum number the
    lines; only the splits' own tasks order their lines.
    """
    counts = lines.groupBy("file", "split").agg(F.count("*").alias("n_"))
    order = Window.orderBy(F.desc("file"), F.desc("split"))
    behind = counts.select(F.col("file").alias("f_"), F.col("split").alias("s_"), (F.sum("n_").over(order) - F.col("n_")).alias("behind_"))
    last = Window.partitionBy("file", "split").orderBy(F.desc("place_"))
    met = lines.withColumn("back_", F.row_number().over(last)).join(F.broadcast(behind), (F.col("file") == F.col("f_")) & (F.col("split") == F.col("s_")))
    skip = max(0, page - 1) * size
    here = met.withColumn("line_", F.col("behind_") + F.col("back_") - 1).where(F.col("line_").between(skip, skip + size - 1))
    return here.orderBy("line_").drop("file", "split", "place_", "back_", "f_", "s_", "behind_", "line_")


def parse_push(bodies: DataFrame, column: str = "body") -> DataFrame:
    """SRC-6, FN-30, FN-31, STF-10: bodies that are `{events: [...]}`, a list, or one object; works on streams too.

    A body of another kind gives one row with `error` set.
    """
    v = F.try_parse_json(column)
    kind = F.schema_of_variant(v)
    listed = F.try_variant_get(v, "$.events", "array<variant>")
    events = F.when(F.startswith(kind, F.lit("ARRAY")), v.cast("array<variant>")).when(listed.isNotNull(), listed).when(F.startswith(kind, F.lit("OBJECT")), F.array(v))
    one = bodies.select(F.col(column).alias("body"), F.explode_outer(events).alias("e"))
    get = lambda *paths: F.coalesce(*(F.try_variant_get("e", p, "string") for p in paths))
    opt = lambda name: F.nullif(F.coalesce(get(f"$.{name}"), F.lit("")), F.lit(""))
    return one.select(
        log_level_push(F.coalesce(get("$['@l']", "$.level"), F.lit("Information"))).alias("level"),
        F.concat(F.lit(PREFIX), F.coalesce(get("$['@m']", "$['@mt']", "$.message"), F.lit(""))).alias("message"),
        opt("JobId").alias("job_id"), opt("TraceId").alias("trace_id"), opt("ProductSKU").alias("sku"), F.lit(SOURCE).alias("source"), F.nullif(F.coalesce(get("$['@x']"), F.lit("")), F.lit("")).alias("exception"),
        F.when(F.col("e").isNull(), F.lit("unexpected body")).alias("error"),
    )


def filter_logs(logs: DataFrame, level: str = "All", text: str = "") -> DataFrame:
    """FLT-10: level whatever its case; text in the message, exception, SKU, ids or source."""
    q = text.strip().lower()
    rows = logs if level.lower() == "all" else logs.where(F.lower("level") == level.lower())
    if not q:
        return rows
    hit = F.lit(False)
    for c in ("message", "exception", "sku", "job_id", "trace_id", "source"):
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(q)), F.lit(False))
    return rows.where(hit)


def log_page(logs: DataFrame, page: int, size: int) -> DataFrame:
    """TOP-8: newest first. By time, message and ids, as files that are read in parallel have no line numbers."""
    return logs.orderBy(F.desc("at"), F.desc("message"), F.desc("job_id"), F.desc("trace_id")).offset(max(0, page - 1) * size).limit(size)


def export_line(source: str = "Sistema") -> Column:
    """SNK-6: `[time] [LEVEL] [source] message`, with lines for SKU and ids if they are there."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    first = F.concat(F.lit("["), F.date_format("at", "yyyy-MM-dd HH:mm:ss"), F.lit("] ["), F.upper("level"), F.lit("] ["), F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit(source)), F.lit("] "), F.col("message"))
    sku = F.when(has("sku"), F.concat(F.lit("  └─ SKU: "), F.col("sku")))
    ids = F.when(has("job_id") | has("trace_id"), F.concat(F.lit("  └─ JobId: "), F.coalesce("job_id", F.lit("N/A")), F.lit(" TraceId: "), F.coalesce("trace_id", F.lit("N/A"))))
    return F.concat_ws("\n", first, sku, ids)


def export_logs(logs: DataFrame, path: str) -> None:
    """SNK-6: as text files, in order of time across the files."""
    logs.orderBy("at").select(export_line().alias("value")).write.text(path)
