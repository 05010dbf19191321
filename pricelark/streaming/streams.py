"""Structured Streaming forms of the stateful rules (STF-1 to STF-10).

State is keyed (variant or proxy), so it is spread by the key's hash and holds
a few numbers per key (state.py). Rows of a key come unordered inside a
micro-batch and are sorted there; a change that spans batches out of order
isn't seen again, as in the batch rules. The rules with state need RocksDB as
the session's state store provider; streams write their checkpoints to the
folder they are given.
"""

from __future__ import annotations

from collections.abc import Callable
from threading import Event

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from pricelark.operators.analytics import failure_categories
from pricelark.operators.merge import bulk_merge
from pricelark.operators.stateful import ATTEMPTS_A_DAY
from pricelark.operators.store import CommitConflict, Store, bucket
from pricelark.session import workers_find_package
from pricelark.streaming import state


def _stated(rows: DataFrame, keys: list[str], processor: StatefulProcessor, time: str = "none") -> DataFrame:
    workers_find_package(rows.sparkSession)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, processor.OUT, "append", time)


def price_changes(captures: DataFrame) -> DataFrame:
    """STF-1 as a stream of change rows."""
    return _stated(captures, ["variant_id"], state.PriceChanges())


def limited_attempts(attempts: DataFrame, limit: int = ATTEMPTS_A_DAY, keep_ms: int = state.DAY_MS) -> DataFrame:
    """STF-2: attempts with their number of the day; a day's count expires `keep_ms` after its last change.

    Expiry goes by processing time, for which Spark makes batches without rows
    as long as the query runs; under availableNow set
    spark.sql.streaming.noDataMicroBatches.enabled to false, so that it ends.
    """
    return _stated(attempts, ["variant_id"], state.AttemptLimiter(limit, keep_ms), "processingTime")


def proxy_health(results: DataFrame, unban: bool = False, silent_ms: int = 0) -> DataFrame:
    """STF-4: results with the failures in a row, the ban and, if they have latency_ms, the latency of the last success."""
    return _stated(results, ["proxy_id"], state.ProxyHealth(unban=unban, silent_ms=silent_ms), "processingTime" if silent_ms else "none")


def promotions(candidates: DataFrame) -> DataFrame:
    """site_id, xpath, validated_at of each selector when its last needed variant confirms it; the newest is the site's.

    State is keyed by site and selector, so a busy site is spread and a key holds at most three ids.
    """
    return _stated(candidates.where("trim(xpath) <> ''"), ["site_id", "xpath"], state.SelectorPromotion())


def escalations(detections: DataFrame) -> DataFrame:
    """STF-5: detections with the site's strategy after each."""
    return _stated(detections, ["site_id"], state.StrategyEscalation())


def site_sessions(metrics: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """An addition: sessions of a site's attempts; one is closed when the watermark has passed its gap, later rows are left out."""
    timed = metrics.withColumn("at", F.col("recorded_at").cast("timestamp")).withWatermark("at", late)
    found = timed.groupBy("site_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("attempts"), F.count_if(~F.col("ok")).alias("failed"), F.min("recorded_at").alias("first_at"), F.max("recorded_at").alias("last_at"))
    return found.select("site_id", "first_at", "last_at", "attempts", "failed")


def live_quality(metrics: DataFrame) -> DataFrame:
    """STF-8, AGG-4: the figures of all attempts so far, a row that each batch updates (output mode complete or update)."""
    return metrics.agg(F.count("*").alias("total"), F.round(F.count_if("ok") * 100.0 / F.count("*"), 6).alias("success_pct"), F.round(F.avg("latency_ms"), 6).alias("mean_latency"))


def live_failures(failures: DataFrame) -> DataFrame:
    """STF-8, AGG-12: the overlapping classes of all failures so far."""
    return failure_categories(failures)


def live_hours(metrics: DataFrame, late: str = "1 hour") -> DataFrame:
    """STF-8: attempts per site and hour; hours that the watermark has passed leave the state, and rows for them are late and left out."""
    timed = metrics.withColumn("at", F.col("recorded_at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("site_id", F.window("at", "1 hour").alias("w")).agg(F.count("*").alias("total"), F.count_if(~F.col("ok")).alias("failed")).select("site_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "total", "failed")


def keep_live(figures: DataFrame, store: Store, name: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """STF-8: a dashboard's table of figures, replaced as a whole after each batch; readers see the one or the other."""
    started, query = Event(), []

    def replace(batch: DataFrame, number: int) -> None:
        started.wait()
        store.commit({name: batch}, batch=(query[0].id, number))

    query.append(figures.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "30 seconds"})).start())
    started.set()
    return query[0]


def hourly_metrics(metrics: DataFrame, late: str = "1 hour") -> DataFrame:
    """An addition: counts per hour of event time, with a watermark that bounds the state."""
    timed = metrics.withColumn("at", F.col("recorded_at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 hour").alias("w")).agg(F.count("*").alias("total"), F.count_if(~F.col("ok")).alias("failed")).select(F.col("w.start").alias("start"), "total", "failed")


def notifications(items: DataFrame) -> DataFrame:
    """STF-9: one message per item."""
    said = F.when(F.col("price") > 0, F.concat(F.lit("$"), F.format_string("%,.2f", F.col("price").cast("double")))).otherwise(F.lit("Agotado / Sin precio"))
    return items.select("sku", F.concat_ws(" · ", "name", said).alias("message"))


#: Buckets of the variants; a batch rewrites those that it touches.
BUCKETS = 64


def merge_batches(captures: DataFrame, store: Store, checkpoint: str, trigger: dict | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """STF-1, STF-6, STF-7, MRG-1: each micro-batch is merged into the store's variants, sites and history.

    If another writer commits in between, the batch is merged anew. A batch that
    is run again after a failure finds its stream's number in the store and does nothing; streams are told apart by the id in their
    checkpoint. An empty batch is left out. The first batch divides variants
    into buckets by their ids; later ones read and rewrite those that they
    touch. Spark's tasks are the consumers; how much a batch takes is bounded
    by the source (maxFilesPerTrigger).
    """
    started, query = Event(), []

    def merge(batch: DataFrame, number: int) -> None:
        started.wait()
        touched = [r[0] for r in batch.select(bucket(F.col("variant_id"), buckets)).distinct().collect()]  # at most `buckets` numbers
        while touched:
            seen = store.snapshot()
            divided = seen.has_buckets("variants", buckets)
            done = bulk_merge(seen.buckets("variants", touched) if divided else seen.table("variants"), seen.table("sites"), batch, checked=True)
            try:
                store.commit({"sites": done.sites}, {"history": done.history}, batch=(query[0].id, number), patched={"variants": (done.variants, "variant_id", buckets, touched if divided else None)}, base=seen)
                return
            except CommitConflict:  # merge anew into what the other writer left
                continue

    query.append(captures.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 minutes"})).start())
    started.set()
    return query[0]


def watch(stream: DataFrame, each: Callable[[DataFrame], None], checkpoint: str, seconds: int = 30) -> StreamingQuery:
    """STF-8: hands every micro-batch to a function, as a dashboard's refresh."""
    return stream.writeStream.foreachBatch(lambda df, _: each(df)).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
