"""The canonical nested price row, the star tables it splits into, and the request schemas.

A catalog is one DataFrame of nested rows, one row per priced item. Its prices live in an array on the row, so
lookups, filters and minima need neither a join nor a shuffle; the star tables are a storage layout only.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Field names and types of the row format.
RESOURCE_ATTRS_DDL = (
    "vcpu bigint, memory_gb double, storage_gb double, gpu_count bigint, gpu_model string, architecture string, "
    "context_length bigint, max_output_tokens bigint, modality array<string>, capabilities array<string>, "
    "quantization string, durability_nines bigint, availability_tier string, extra string"
)
TERMS_DDL = (
    "commitment string, tenancy string, os string, support_tier string, upfront string, payment_option string"
)
PRICE_DDL = "dimension string, tier string, tier_upper string, amount double, unit string"
HEALTH_DDL = (
    "uptime_30d double, latency_p50_ms bigint, latency_p95_ms bigint, throughput_tokens_per_sec double, "
    "observed_at bigint"
)
ROW_DDL = (
    "sku_id string, provider string, service string, kind string, resource_name string, region string, "
    "region_normalized string, terms_hash string, "
    f"resource_attrs struct<{RESOURCE_ATTRS_DDL}>, terms struct<{TERMS_DDL}>, prices array<struct<{PRICE_DDL}>>, "
    f"health struct<{HEALTH_DDL}>, is_aggregated boolean"
)
SKU_COLUMNS = (
    "sku_id", "provider", "service", "kind", "resource_name", "region", "region_normalized", "terms_hash",
)
TERM_FIELDS = ("commitment", "tenancy", "os", "support_tier", "upfront", "payment_option")
PRICE_FIELDS = ("dimension", "tier", "tier_upper", "amount", "unit")
HEALTH_FIELDS = (
    "uptime_30d", "latency_p50_ms", "latency_p95_ms", "throughput_tokens_per_sec", "observed_at",
)


_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def _struct(ddl: str) -> T.StructType:
    """Struct of plain fields, without needing a session at import time."""
    return T.StructType([T.StructField(*(pair[0], _TYPES[pair[1]])) for pair in (f.split() for f in ddl.split(", "))])


RESOURCE_ATTRS = _struct(RESOURCE_ATTRS_DDL)
TERMS = _struct(TERMS_DDL)
PRICE = _struct(PRICE_DDL)
HEALTH = _struct(HEALTH_DDL)
ROW = T.StructType(
    [T.StructField(c, T.StringType()) for c in SKU_COLUMNS]
    + [T.StructField("resource_attrs", RESOURCE_ATTRS), T.StructField("terms", TERMS),
       T.StructField("prices", T.ArrayType(PRICE)), T.StructField("health", HEALTH),
       T.StructField("is_aggregated", T.BooleanType())]
)
ATTR_FIELDS = tuple(f.name for f in RESOURCE_ATTRS)

# Primary keys of the star tables: what a snapshot diff compares and a change table addresses.
STAR_KEYS = {
    "skus": ("sku_id",),
    "resource_attrs": ("sku_id",),
    "terms": ("sku_id",),
    "prices": ("sku_id", "dimension", "tier"),
    "health": ("sku_id",),
    "metadata": ("key",),
}
# Supported range of the catalog layout version.
MIN_SCHEMA_VERSION = 1
MAX_SCHEMA_VERSION = 1

ITEM_DDL = (
    "item_index bigint, raw string, provider string, service string, resource string, kind string, "
    "params map<string,string>, error string"
)
WORKLOAD_DDL = "items array<struct<provider string, service string, resource string, params map<string,string>>>"
BATCH_DDL = (
    "command string, args map<string,string>, preset string, profile string, jq string, fields string, "
    "format string, pretty boolean, include_raw boolean, include_aggregated boolean"
)
