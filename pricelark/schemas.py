"""Schemas of the domain tables and of the records that come in."""

from __future__ import annotations

SITE = "site_id int, site_name string, url_base string, active boolean, interval_minutes int, sel_product string, sel_price string, sel_stock string, sel_name string, sel_image string, strategy string, last_crawl timestamp_ntz"
PRODUCT = "product_id int, product_name string, brand string, category string, description string, created_at timestamp_ntz"
VARIANT = "variant_id int, product_id int, site_id int, sku string, variant_name string, url string, price decimal(18,2), prev_price decimal(18,2), in_stock boolean, updated_at timestamp_ntz, attempts_today int, last_attempt_at timestamp_ntz, image_url string, active boolean"
HISTORY = "history_id bigint, variant_id int, price decimal(18,2), in_stock boolean, captured_at timestamp_ntz"
PROXY = "proxy_id int, ip string, port int, user string, password string, active boolean, latency_ms int, failures int, last_used timestamp_ntz, banned boolean"
FAILURE = "failure_id int, variant_id int, failed_at timestamp_ntz, url string, error string, proxy string, strategy string, html string"
CANDIDATE = "candidate_id int, site_id int, variant_id int, xpath string, price decimal(18,2), url string, validated_at timestamp_ntz"
METRIC = "metric_id bigint, site_id int, variant_id int, ok boolean, method string, source string, confidence int, latency_ms int, recorded_at timestamp_ntz"

BULK_ITEM = "variant_id int, price decimal(18,2), in_stock boolean, captured_at timestamp_ntz, image_url string"
EXTENSION_ITEM = "sku string, name string, url string, price decimal(18,2), image_url string, domain string, brand string, sel_name string, sel_price string, sel_image string, method string, source string, confidence int, latency_ms int"
CAPTURE = "url string, html string"
LOG = "`@t` string, `@m` string, `@mt` string, `@l` string, JobId string, TraceId string, ProductSKU string, SourceContext string, `@x` string"
