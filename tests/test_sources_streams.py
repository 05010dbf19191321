import gzip
import json
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from pricelark import schemas
from pricelark.operators import merge as mg
from pricelark.operators import stateful as st
from pricelark.operators.store import Store, failure_rows, metric_rows, write_batch
from pricelark.sources import ingest, logs
from pricelark.streaming import streams

T0 = datetime(2024, 1, 1)


def test_bulk_files_and_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in range(3):
        items = [{"variant_id": 1, "price": 10 + k // 2, "in_stock": True, "captured_at": f"2024-01-0{k + 1}T00:00:00"}]
        with gzip.open(src / f"b{k}.json.gz", "wt") as f:
            json.dump(items, f)
    assert ingest.read_bulk(spark, str(src)).count() == 3
    stream = streams.price_changes(ingest.stream_bulk(spark, str(src)).select("variant_id", "price", "in_stock", "captured_at"))
    stream.writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(int(r["price"]) for r in spark.table("changes").collect()) == [10, 11]


def test_merge_stream_is_idempotent(spark, tmp_path):
    v = "variant_id int, site_id int, price decimal(18,2), prev_price decimal(18,2), in_stock boolean, updated_at timestamp_ntz, image_url string"
    store = Store(spark, f"file://{tmp_path}/store")
    store.commit({"variants": spark.createDataFrame([(1, 1, Decimal(10), None, True, T0, None)], v), "sites": spark.createDataFrame([(1, None)], "site_id int, last_crawl timestamp_ntz"), "history": spark.createDataFrame([(1, Decimal(10), True, T0)], "variant_id int, price decimal(18,2), in_stock boolean, captured_at timestamp_ntz")})
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text(json.dumps([{"variant_id": 1, "price": 12, "in_stock": True, "captured_at": "2024-01-02T00:00:00"}]))
    for _ in range(2):
        streams.merge_batches(ingest.stream_bulk(spark, str(src)), store, str(tmp_path / "ck"), {"availableNow": True}).awaitTermination()
    assert store.table("history").count() == 2 and store.table("variants").first()["price"] == Decimal(12)


def test_stateful_streams_equal_batch(spark, tmp_path):
    rows = [(k, k % 3, T0 + timedelta(hours=k % 40), k % 4 == 0) for k in range(120)]
    src = str(tmp_path / "ev")
    spark.createDataFrame(rows, "result_id long, proxy_id long, tried_at timestamp_ntz, ok boolean").coalesce(1).write.parquet(src)
    batch = spark.read.parquet(src)
    stream = spark.readStream.schema(batch.schema).parquet(src)

    def run(df, name):
        df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.table(name).collect()))

    assert [r[:6] for r in run(streams.proxy_health(stream), "health")] == sorted(tuple(r) for r in st.proxy_health(batch).select("result_id", "proxy_id", "tried_at", "ok", "failures", "banned").collect())
    names = ["attempt_id", "variant_id", "attempted_at", "ok"]
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    got = run(streams.limited_attempts(stream.toDF(*names)), "limits")
    assert got == sorted(tuple(r) for r in st.attempt_limiter(batch.toDF(*names)).select("attempt_id", "variant_id", "attempted_at", "attempts_today", "allowed").collect())
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    kind = F.when(F.col("result_id") % 7 == 0, "Cloudflare").when(F.col("result_id") % 5 == 0, "Heavy-JS").otherwise("Standard")
    seen = lambda df: df.select(F.col("result_id").alias("detection_id"), F.col("proxy_id").alias("site_id"), F.col("tried_at").alias("detected_at"), kind.alias("strategy"))
    assert run(streams.escalations(seen(stream)), "escalations") == sorted(map(tuple, st.strategy_escalation(seen(batch)).collect()))
    cand = lambda df: df.select(F.col("result_id").alias("candidate_id"), F.col("proxy_id").alias("site_id"), (F.col("result_id") % 9).cast("int").alias("variant_id"), F.concat(F.lit("//x"), (F.col("result_id") % 4).cast("string")).alias("xpath"), F.when(F.col("ok"), 0).otherwise(5).cast("decimal(18,2)").alias("price"), F.col("tried_at").alias("validated_at"))
    assert run(streams.promotions(cand(stream)), "promotions") == sorted((r["site_id"], r["xpath"], r["promoted_at"]) for r in st.selector_promotion(cand(batch)).where("promoted_at IS NOT NULL").collect())
    m = spark.readStream.schema(batch.schema).parquet(src).select(F.col("tried_at").alias("recorded_at"), "ok")
    m = streams.hourly_metrics(m)
    m.writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "hours")).trigger(availableNow=True).start().awaitTermination()
    assert sum(r["total"] for r in spark.table("hours").collect()) == 120


def test_extension_and_captures(spark):
    body = [json.dumps({"sku": "1", "url": "u", "price": 2.5}), json.dumps({"sku": " ", "url": "u"}), "nope", None]
    assert [r["sku"] for r in ingest.parse_extension(spark.createDataFrame([(b,) for b in body], "body string")).collect()] == ["1"]
    rows = [("https://s.com", "<p>"), ("ftp://s.com", "<p>"), ("/rel", "<p>"), (None, "<p>"), ("http://s.com", " "), ("http://s.com", "x" * 11)]
    got = spark.createDataFrame(rows, schemas.CAPTURE).select(ingest.capture_status(F.col("url"), F.col("html"), 10)).collect()
    assert [r[0] for r in got] == [200, 400, 400, 400, 400, 413]
    msgs = streams.notifications(spark.createDataFrame([("a", "N", Decimal("1234.5")), ("b", "M", Decimal(0))], "sku string, name string, price decimal(18,2)"))
    assert [r["message"] for r in msgs.orderBy("sku").collect()] == ["N · $1,234.50", "M · Agotado / Sin precio"]


def test_snapshots(spark, tmp_path):
    (tmp_path / "a.com_2024.html").write_text("<p>\n1")
    assert [tuple(r)[1:] for r in ingest.read_snapshots(spark, str(tmp_path)).collect()] == [("a.com", "2024", "<p>\n1")]


def test_logs(spark, tmp_path):
    lines = ['{"@t":"2024-01-01T00:00:00Z","@m":"Hola","@l":"Error","ProductSKU":"S1"}', "{bad", "", '{"@t":"2024-01-02T00:00:00Z","@mt":"Plantilla","JobId":"J"}']
    (tmp_path / "log-202401.json").write_text("\n".join(lines))
    got = logs.read_logs(spark, f"{tmp_path}/log-*.json")
    assert sorted((r["level"], r["message"]) for r in got.collect()) == [("Error", "Hola"), ("Information", "Plantilla")]
    assert logs.filter_logs(got, "error").count() == 1 and logs.filter_logs(got, "All", " s1 ").count() == 1 and logs.filter_logs(got, text="zzz").count() == 0
    assert [r["message"] for r in logs.log_page(got, 1, 1).collect()] == ["Plantilla"]
    said = {r[0] for r in got.select(logs.export_line()).collect()}
    assert said == {"[2024-01-01 00:00:00] [ERROR] [Sistema] Hola\n  └─ SKU: S1", "[2024-01-02 00:00:00] [INFORMATION] [Sistema] Plantilla\n  └─ JobId: J TraceId: N/A"}
    bodies = ['{"events":[{"@m":"a","@l":"ERR"},{"message":"b","level":"w"}]}', '[{"@mt":"c"}]', '{"@m":"d","@x":"boom"}', '"text"', "nope"]
    pushed = logs.parse_push(spark.createDataFrame([(b,) for b in bodies], "body string")).collect()
    assert sorted((r["level"], r["message"]) for r in pushed if r["error"] is None) == [("Error", "[Worker] a"), ("Information", "[Worker] c"), ("Information", "[Worker] d"), ("Warning", "[Worker] b")]
    assert sum(r["error"] is not None for r in pushed) == 2


def test_rows_and_sinks(spark, tmp_path):
    a = spark.createDataFrame([(1, 2, False, T0, "u", " ", None, None, None, None, None, None, None)], "site_id int, variant_id int, ok boolean, attempted_at timestamp_ntz, url string, error string, proxy string, strategy string, html string, method string, source string, confidence int, latency_ms int")
    f = failure_rows(a).first()
    assert (f["error"], f["html"]) == ("Error desconocido", "")
    assert metric_rows(a, always_ok=True).first()["ok"] and not metric_rows(a).first()["ok"]
    write_batch(mg.latest_items(spark.createDataFrame([(1, Decimal(1), True, T0, None)], schemas.BULK_ITEM)), str(tmp_path / "out"))
    assert list((tmp_path / "out").glob("*.json.gz"))


def test_streams_have_their_own_numbers(spark, tmp_path):
    """A second stream, and one with a new checkpoint, begin at 0 and lose nothing; only touched buckets are rewritten."""
    v = "variant_id int, site_id int, price decimal(18,2), prev_price decimal(18,2), in_stock boolean, updated_at timestamp_ntz, image_url string"
    store = Store(spark, f"file://{tmp_path}/store")
    store.commit({"variants": spark.createDataFrame([(k, 1, Decimal(10), None, True, T0, None) for k in range(30)], v), "sites": spark.createDataFrame([(1, None)], "site_id int, last_crawl timestamp_ntz"), "history": spark.createDataFrame([(1, Decimal(10), True, T0)], "variant_id int, price decimal(18,2), in_stock boolean, captured_at timestamp_ntz")})
    folders = []
    for name, price in (("a", 12), ("b", 13), ("a2", 14)):
        src = tmp_path / name
        src.mkdir()
        (src / "x.json").write_text(json.dumps([{"variant_id": 1, "price": price, "in_stock": True, "captured_at": "2024-01-02T00:00:00"}]))
        streams.merge_batches(ingest.stream_bulk(spark, str(src)), store, str(tmp_path / f"ck-{name}"), {"availableNow": True}, 8).awaitTermination()
        folders.append(set(store.state()["variants"].split(",")))
    assert sorted(int(r["price"]) for r in store.table("history").collect()) == [10, 12, 13, 14]
    got = {r["variant_id"]: int(r["price"]) for r in store.table("variants").collect()}
    assert got == {k: 14 if k == 1 else 10 for k in range(30)}
    assert 1 < len(folders[0]) <= 8 and len(folders[1] - folders[0]) == len(folders[2] - folders[1]) == 1
