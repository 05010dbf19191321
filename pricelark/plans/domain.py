"""Domain tables made from the star-schema test tables, and the same as SQL.

Site = region, product = part, variant = (product, site), history = the line
items of a variant in the order of (ship date, order, line, supplier, price),
metrics and failures = events. Ids stay BIGINT.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelark.session import checked_broadcast, workers_find_package

#: Products whose names may be broadcast to their variants.
PRODUCT_ROWS = 100_000

#: Times that the queries take for now.
HISTORY_AS_OF = "2001-11-05 06:00:00"
EVENT_AS_OF = "2024-01-31 00:00:00"

ERRORS = ["Selector no encontrado", "Timeout 30000ms exceeded", "net::ERR_CONNECTION_RESET", "Cloudflare challenge 403", "Captcha detectado", "XPath Timeout", "Error desconocido"]


class Domain:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        workers_find_package(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def sites(self) -> DataFrame:
        k = F.col("r_regionkey")
        return self.table("region").select(
            k.alias("site_id"),
            F.col("r_name").alias("site_name"),
            F.concat(F.lit("https://"), F.replace(F.lower("r_name"), F.lit(" "), F.lit("-")), F.lit(".example.com")).alias("url_base"),
            (k % 5 != 4).alias("active"),
            (360 * (1 + k)).cast("int").alias("interval_minutes"),
            F.when(k % 3 == 0, "Standard").when(k % 3 == 1, "Heavy-JS").otherwise("Cloudflare").alias("strategy"),
        )

    @cached_property
    def products(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"))

    @cached_property
    def history(self) -> DataFrame:
        """One row per capture. Suppliers with their regions are a dimension, broadcast if a count says that it is small."""
        where = self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
        return (
            self.table("lineitem")
            .join(checked_broadcast(where), F.col("l_suppkey") == F.col("s_suppkey"))
            .select(
                (F.col("l_partkey") * 5 + F.col("n_regionkey")).alias("variant_id"),
                F.col("l_partkey").alias("product_id"),
                F.col("n_regionkey").alias("site_id"),
                F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
                (F.col("l_linestatus") == "O").alias("in_stock"),
                F.col("l_shipdate").alias("captured_at"),
                F.col("l_orderkey").alias("k1"),
                F.col("l_linenumber").alias("k2"),
                F.col("l_suppkey").alias("k3"),
            )
        )

    @cached_property
    def variants(self) -> DataFrame:
        """Current state: the last capture of each variant with the price before it.

        The first filter leaves two captures a variant, so that they are cut
        before the shuffle (WindowGroupLimit); lead() beside it would keep all.
        Names of products repeat, so their file's size doesn't tell what they
        take in the driver: they are broadcast by their count.
        """
        last = Window.partitionBy("variant_id").orderBy(*(F.desc(c) for c in ("captured_at", "k1", "k2", "k3", "price")))
        two = self.history.withColumn("rn", F.row_number().over(last)).where("rn <= 2")
        now = two.withColumn("prev_price", F.lead("price").over(Window.partitionBy("variant_id").orderBy("rn"))).where("rn = 1")
        v = F.col("variant_id")
        tail = F.when(v % 4 == 0, "?utm_source=feed").when(v % 4 == 1, "/").when(v % 4 == 2, "#top").otherwise("")
        return (
            now.join(checked_broadcast(self.products.select("product_id", "product_name"), PRODUCT_ROWS), "product_id")
            .join(self.sites.select("site_id", "url_base"), "site_id")
            .select(
                "variant_id",
                "product_id",
                "site_id",
                F.col("product_name").alias("variant_name"),
                F.concat(F.lit("SKU-"), F.col("product_id").cast("string")).alias("sku"),
                F.concat("url_base", F.lit("/p/"), F.col("product_id").cast("string"), tail).alias("url"),
                "price",
                "prev_price",
                "in_stock",
                F.col("captured_at").alias("updated_at"),
                (v % 11 != 0).alias("active"),
                F.when(v % 3 != 0, F.concat(F.lit("https://cdn.shopify.com/i/"), F.col("product_id").cast("string"), F.lit(".jpg"))).alias("image_url"),
                (v % 14).cast("int").alias("attempts_today"),
            )
        )

    def _events(self) -> DataFrame:
        u = F.col("user_id")
        return self.table("events").withColumns({"site_id": (u % 5).cast("int"), "variant_id": (u + 1) * 5 + u % 5})

    @cached_property
    def metrics(self) -> DataFrame:
        kind = F.col("event_type")
        return self._events().select(
            F.col("event_id").alias("metric_id"),
            "site_id",
            "variant_id",
            (kind != "error").alias("ok"),
            F.when(kind == "view", "JSON-LD").when(kind == "click", "Meta").when(kind == "purchase", "DOM").alias("method"),
            F.when(F.col("event_id") % 4 != 0, kind).alias("source"),
            F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("confidence"),
            F.floor("value").cast("int").alias("latency_ms"),
            F.col("ts").alias("recorded_at"),
        )

    @cached_property
    def failures(self) -> DataFrame:
        n = F.col("event_id") % len(ERRORS)
        text = F.element_at(F.array(*map(F.lit, ERRORS)), (n + 1).cast("int"))
        return self._events().where("event_type = 'error'").select(F.col("event_id").alias("failure_id"), "variant_id", F.col("ts").alias("failed_at"), text.alias("error"), F.when(F.col("event_id") % 3 == 0, "Standard").alias("strategy"))


SITE = """site AS (
  SELECT r_regionkey AS site_id, r_name AS site_name, 'https://' || replace(lower(r_name), ' ', '-') || '.example.com' AS url_base,
         r_regionkey % 5 <> 4 AS active, CAST(360 * (1 + r_regionkey) AS INTEGER) AS interval_minutes,
         CASE r_regionkey % 3 WHEN 0 THEN 'Standard' WHEN 1 THEN 'Heavy-JS' ELSE 'Cloudflare' END AS strategy
  FROM region)"""
PRODUCT = "product AS (SELECT p_partkey AS product_id, p_name AS product_name, p_brand AS brand, p_type AS category FROM part)"
HISTORY = """history AS (
  SELECT l_partkey * 5 + n_regionkey AS variant_id, l_partkey AS product_id, n_regionkey AS site_id, CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
         l_linestatus = 'O' AS in_stock, l_shipdate AS captured_at, l_orderkey AS k1, l_linenumber AS k2, l_suppkey AS k3
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""
VARIANT = """variant AS (
  SELECT r.variant_id, r.product_id, r.site_id, product_name AS variant_name, 'SKU-' || r.product_id AS sku,
         url_base || '/p/' || r.product_id || CASE r.variant_id % 4 WHEN 0 THEN '?utm_source=feed' WHEN 1 THEN '/' WHEN 2 THEN '#top' ELSE '' END AS url,
         price, prev_price, in_stock, captured_at AS updated_at, r.variant_id % 11 <> 0 AS active,
         CASE WHEN r.variant_id % 3 <> 0 THEN 'https://cdn.shopify.com/i/' || r.product_id || '.jpg' END AS image_url, CAST(r.variant_id % 14 AS INTEGER) AS attempts_today
  FROM (SELECT *, row_number() OVER w AS rn, lead(price) OVER w AS prev_price FROM history
        WINDOW w AS (PARTITION BY variant_id ORDER BY captured_at DESC, k1 DESC, k2 DESC, k3 DESC, price DESC)) r
  JOIN product USING (product_id) JOIN site USING (site_id) WHERE rn = 1)"""
METRIC = """metric AS (
  SELECT event_id AS metric_id, CAST(user_id % 5 AS INTEGER) AS site_id, (user_id + 1) * 5 + user_id % 5 AS variant_id, event_type <> 'error' AS ok,
         CASE event_type WHEN 'view' THEN 'JSON-LD' WHEN 'click' THEN 'Meta' WHEN 'purchase' THEN 'DOM' END AS method,
         CASE WHEN event_id % 4 <> 0 THEN event_type END AS source, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS confidence,
         CAST(floor(value) AS INTEGER) AS latency_ms, ts AS recorded_at
  FROM events)"""
FAILURE = f"""failure AS (
  SELECT event_id AS failure_id, (user_id + 1) * 5 + user_id % 5 AS variant_id, ts AS failed_at, ([{", ".join(f"'{e}'" for e in ERRORS)}])[event_id % {len(ERRORS)} + 1] AS error,
         CASE WHEN event_id % 3 = 0 THEN 'Standard' END AS strategy
  FROM events WHERE event_type = 'error')"""
ALL = ",\n".join([SITE, PRODUCT, HISTORY, VARIANT, METRIC, FAILURE])


def sql(body: str) -> str:
    """A query over the domain tables for the oracle; unused ones cost nothing."""
    return f"WITH {ALL}\n{body}" if not body.lstrip().startswith(",") else f"WITH {ALL}\n{body.lstrip()}"
