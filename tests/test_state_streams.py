"""Streams with state over several micro-batches, against the batch forms; state read back and expired."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pricelark.operators import analytics as an
from pricelark.operators import stateful as st
from pricelark.operators.store import Store
from pricelark.streaming import streams

T0 = datetime(2024, 1, 1)
SCHEMA = "id long, k long, at timestamp_ntz, ok boolean, latency_ms int"


class Feed:
    """Rows that come in three batches, in order of time; a batch is a file."""

    def __init__(self, spark, path, n=150):
        self.spark, self.path, self.done = spark, str(path), 0
        rows = [(i, i % 3, T0 + timedelta(minutes=25 * i), i % 4 == 0, None if i % 8 == 0 else i) for i in range(n)]
        self.parts = [rows[: n // 3], rows[n // 3 : n // 2], rows[n // 2 :]]
        self.all = spark.createDataFrame(rows, SCHEMA)
        self.stream = spark.readStream.schema(self.all.schema).option("maxFilesPerTrigger", 1).parquet(self.path)

    def add(self):
        self.spark.createDataFrame(self.parts[self.done], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        self.done += 1

    def so_far(self):
        return self.spark.createDataFrame([r for p in self.parts[: self.done] for r in p], SCHEMA)


@pytest.fixture
def no_idle_batches(spark):
    """Rules that go by processing time would make batches without rows for ever, so availableNow would never end."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


@pytest.fixture
def feed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    return Feed(spark, tmp_path / "in")


def attempts(df):
    return df.select(F.col("id").alias("attempt_id"), F.col("k").alias("variant_id"), F.col("at").alias("attempted_at"))


def results(df):
    return df.select(F.col("id").alias("result_id"), F.col("k").alias("proxy_id"), F.col("at").alias("tried_at"), "ok", "latency_ms")


def detections(df):
    kind = F.when(F.col("id") % 7 == 6, "Cloudflare").when(F.col("id") % 5 == 0, "Heavy-JS").otherwise("Standard")
    return df.select(F.col("id").alias("detection_id"), F.col("k").alias("site_id"), F.col("at").alias("detected_at"), kind.alias("strategy"))


def candidates(df):
    return df.select(F.col("id").alias("candidate_id"), F.col("k").alias("site_id"), (F.col("id") % 9).alias("variant_id"), F.concat(F.lit("//x"), (F.col("id") % 4).cast("string")).alias("xpath"), F.when(F.col("ok"), 0).otherwise(5).cast("decimal(18,2)").alias("price"), F.col("at").alias("validated_at"))


def captures(df):
    return df.select(F.col("k").cast("int").alias("variant_id"), F.when(F.col("id") % 6 < 3, 5).otherwise(7).cast("decimal(18,2)").alias("price"), (F.col("id") % 10 < 7).alias("in_stock"), F.col("at").alias("captured_at"))


def changes(df):
    rows = captures(df).withColumns({c: F.lit(0) for c in ("k1", "k2", "k3")})
    return an.change_points(rows).select("variant_id", "price", "in_stock", "captured_at")


RULES = {
    "changes": (lambda df: streams.price_changes(captures(df)), changes),
    "limits": (lambda df: streams.limited_attempts(attempts(df)), lambda df: st.attempt_limiter(attempts(df))),
    "health": (lambda df: streams.proxy_health(results(df)), lambda df: st.proxy_health(results(df)).select("result_id", "proxy_id", "tried_at", "ok", "failures", "banned", "proxy_latency")),
    "escalations": (lambda df: streams.escalations(detections(df)), lambda df: st.strategy_escalation(detections(df))),
    "promotions": (lambda df: streams.promotions(candidates(df)), lambda df: st.selector_promotion(candidates(df)).where("promoted_at IS NOT NULL").select("site_id", "xpath", F.col("promoted_at").alias("validated_at"))),
}


@pytest.mark.parametrize("rule", sorted(RULES))
def test_rule_over_three_batches(spark, feed, tmp_path, rule, no_idle_batches):
    stream, batch = RULES[rule]
    key = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    for _ in range(3):
        feed.add()
        stream(feed.stream).writeStream.foreachBatch(lambda df, _: df.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(batch(feed.all))
    name = {"changes": "last", "limits": "days", "health": "health", "escalations": "now", "promotions": "known"}[rule]
    held = spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "ck"))
    if rule == "health":
        want = {r["proxy_id"]: (r["failures"], r["banned"], r["proxy_latency"]) for r in st.proxy_health(results(feed.all)).orderBy("tried_at", "result_id").collect()}
        assert {r["key"]["proxy_id"]: tuple(r["value"]) for r in held.collect()} == want
    elif rule == "promotions":
        assert held.groupBy("key").count().agg(F.max("count")).first()[0] <= 3
    else:
        assert held.select("key").distinct().count() == 3


def test_counts_expire(spark, feed, tmp_path, no_idle_batches):
    """A day's count whose time is over isn't there any more, and the limit begins anew."""
    for wait in (0, 3):
        feed.add()
        time.sleep(wait)
        streams.limited_attempts(attempts(feed.stream), keep_ms=1000).writeStream.foreachBatch(lambda df, _: df.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    got = {r["attempt_id"]: r["attempts_today"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    kept = {r["attempt_id"]: r["attempts_today"] for r in st.attempt_limiter(attempts(feed.so_far())).collect()}
    first = [r[0] for r in feed.parts[1][:3]]
    assert [got[i] for i in first] == [1, 1, 1] and [kept[i] for i in first] != [1, 1, 1]


def test_silent_proxies_are_forgotten(spark, feed, tmp_path, no_idle_batches):
    """A timer clears those that aren't banned."""
    q = streams.proxy_health(results(feed.stream), silent_ms=500).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    try:
        spark.createDataFrame([(1, 1, T0, True, 3), (2, 2, T0, False, None), *((k, 9, T0 + timedelta(minutes=k), False, None) for k in range(10, 16))], SCHEMA).coalesce(1).write.mode("append").parquet(feed.path)
        q.processAllAvailable()
        time.sleep(2)
        spark.createDataFrame([(30, 7, T0, True, 3)], SCHEMA).coalesce(1).write.mode("append").parquet(feed.path)
        q.processAllAvailable()
    finally:
        q.stop()
    held = spark.read.format("statestore").option("stateVarName", "health").load(str(tmp_path / "ck"))
    assert {r["key"]["proxy_id"] for r in held.collect()} == {7, 9}


def test_live_figures(spark, feed, tmp_path):
    """After each batch the stored figures are those of the batch queries."""
    store = Store(spark, f"file://{tmp_path}/store")
    metrics = lambda df: df.select(F.col("k").alias("site_id"), "ok", "latency_ms", F.col("at").alias("recorded_at"))
    failed = lambda df: df.where("NOT ok").select(F.when(F.col("id") % 3 == 0, "XPath Timeout").when(F.col("id") % 3 == 1, "403").otherwise("x").alias("error"))
    figures = {"quality": lambda df: streams.live_quality(metrics(df)), "failures": lambda df: streams.live_failures(failed(df))}
    for _ in range(3):
        feed.add()
        for name, f in figures.items():
            streams.keep_live(f(feed.stream), store, name, str(tmp_path / name), {"availableNow": True}).awaitTermination()
            assert [tuple(r) for r in store.table(name).collect()] == [tuple(r) for r in f(feed.so_far()).collect()]
    sites = spark.createDataFrame([(k, f"s{k}") for k in range(3)], "site_id long, site_name string")
    got = store.table("quality").first()
    want = an.quality_global(metrics(feed.all), sites, "2024-01-20 00:00:00").first()
    assert (got["total"], got["success_pct"], got["mean_latency"]) == (want["total"], want["success_pct"], want["mean_latency"])


def test_late_rows_and_sessions(spark, tmp_path):
    """Rows for an hour that the watermark has passed are left out; sessions come once they are over."""
    (tmp_path / "in").mkdir()
    schema = "site_id long, ok boolean, recorded_at timestamp_ntz"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    at = lambda minutes: T0 + timedelta(minutes=minutes)
    batches = [[(1, True, at(0)), (1, False, at(20)), (1, True, at(120))], [(1, True, at(150)), (2, True, at(400))], [(1, True, at(10)), (2, False, at(410)), (1, True, at(900))]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for name, df in (("hours", streams.live_hours(stream)), ("sessions", streams.site_sessions(stream))):
            df.writeStream.outputMode("append").foreachBatch(lambda df, _, name=name: df.write.mode("append").parquet(str(tmp_path / name))).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start().awaitTermination()
    read = lambda name: sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / name)).collect())
    assert read("sessions") == [(1, at(0), at(20), 2, 1), (1, at(120), at(150), 2, 0), (2, at(400), at(410), 2, 1)]
    assert read("hours") == [(1, at(0), 2, 1), (1, at(120), 2, 0), (2, at(360), 2, 1)]
    whole = an.attempt_sessions(spark.createDataFrame([r for b in batches[:2] for r in b], schema)).orderBy("site_id", "first_at").collect()
    assert [tuple(r)[1:4] for r in whole] == [(at(0), at(20), 2), (at(120), at(150), 2), (at(400), at(400), 1)]
