"""Landed upstream documents as flat frames. A multi-line JSON file is one task; `offers` reads documents of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# The shapes of the upstream documents, only the fields the feeds read.
OFFER_DDL = (
    "products map<string, struct<productFamily string, attributes map<string,string>>>, "
    "terms struct<OnDemand map<string, map<string, struct<priceDimensions map<string, struct<unit string, "
    "description string, beginRange string, endRange string, pricePerUnit map<string,string>>>>>>>"
)
RETAIL_DDL = (
    "Items array<struct<currencyCode string, tierMinimumUnits double, retailPrice double, unitPrice double, "
    "armRegionName string, location string, meterId string, meterName string, productId string, skuId string, "
    "productName string, skuName string, armSkuName string, serviceName string, serviceFamily string, "
    "unitOfMeasure string, type string>>"
)
BILLING_DDL = (
    "skus array<struct<name string, skuId string, description string, category struct<serviceDisplayName string, "
    "resourceFamily string, resourceGroup string, usageType string>, serviceRegions array<string>, "
    "pricingInfo array<struct<pricingExpression struct<usageUnit string, tieredRates array<struct<"
    "startUsageAmount double, unitPrice struct<currencyCode string, units string, nanos bigint>>>>>>>>"
)
MACHINE_DDL = (
    "items map<string, struct<machineTypes array<struct<name string, guestCpus bigint, memoryMb bigint, zone string, "
    "accelerators array<struct<guestAcceleratorType string>>>>>>"
)
MODELS_DDL = (
    "data array<struct<id string, context_length bigint, architecture struct<modality string, "
    "input_modalities array<string>>, pricing map<string,string>, top_provider struct<context_length bigint, "
    "max_completion_tokens bigint>, supported_parameters array<string>>>"
)
ENDPOINTS_DDL = (
    "data struct<id string, endpoints array<struct<tag string, provider_name string, quantization string, "
    "context_length bigint, max_completion_tokens bigint, uptime_last_30m double, latency struct<p50_ms bigint, "
    "p95_ms bigint>, throughput_tokens_per_second double, currency string, pricing map<string,string>>>>"
)


def read_documents(spark: SparkSession, paths: str | list[str], ddl: str) -> DataFrame:
    """One row per document with its file name."""
    return spark.read.schema(ddl).json(paths, multiLine=True).withColumn("file", F.col("_metadata.file_path"))


def offer_prices(documents: DataFrame, families: list[str] | None = None) -> DataFrame:
    """On-demand prices of an offer, one row per price dimension of the first term of each product.

    Columns: file, pos (product order), sku_id, family, attributes, dim_pos, unit, description, begin_range,
    end_range, usd. Reserved terms and unread fields never leave the scan; products without a term drop out of the
    inner join.
    """
    products = documents.select("file", F.posexplode("products").alias("pos", "sku_id", "p")).select(
        "file", "pos", "sku_id", F.col("p.productFamily").alias("family"), F.col("p.attributes").alias("attributes"))
    if families:
        products = products.filter(F.col("family").isin(*families))
    terms = documents.select("file", F.explode("terms.OnDemand").alias("sku_id", "t"))
    return first_term_prices(products, terms)


def first_term_prices(products: DataFrame, terms: DataFrame) -> DataFrame:
    """Products (file, pos, sku_id, family, attributes) joined to the price dimensions of their first term."""
    first_term = F.get(F.map_values("t"), F.lit(0))
    dims = terms.select("file", "sku_id", F.posexplode(first_term["priceDimensions"]).alias("dim_pos", "dim", "d"))
    return products.join(dims, ["file", "sku_id"]).select(
        "file", "pos", "sku_id", "family", "attributes", "dim_pos", F.col("d.unit").alias("unit"),
        F.col("d.description").alias("description"), F.col("d.beginRange").alias("begin_range"),
        F.col("d.endRange").alias("end_range"), F.col("d.pricePerUnit")["USD"].try_cast("double").alias("usd"))


def retail_items(documents: DataFrame) -> DataFrame:
    """Retail price items with their order in the feed."""
    return documents.select("file", F.posexplode("Items").alias("pos", "i")).select("file", "pos", "i.*")


def billing_skus(documents: DataFrame) -> DataFrame:
    """Billing catalog entries with their order, first pricing expression and all its rates."""
    s = documents.select("file", F.posexplode("skus").alias("pos", "s")).select("file", "pos", "s.*")
    pricing = F.get("pricingInfo", F.lit(0))["pricingExpression"]
    return s.select("file", "pos", F.col("skuId").alias("sku_id"), "description", "category.resourceFamily",
                    "category.resourceGroup", "category.usageType", "category.serviceDisplayName", "serviceRegions",
                    pricing["usageUnit"].alias("usage_unit"), pricing["tieredRates"].alias("rates"))


def machine_types(documents: DataFrame) -> DataFrame:
    """Machine types over all zones."""
    zone = documents.select(F.explode("items").alias("zone_key", "z"))
    return zone.select(F.explode("z.machineTypes").alias("m")).select(
        F.col("m.name").alias("name"), F.col("m.guestCpus").alias("vcpu"), F.col("m.memoryMb").alias("memory_mb"),
        F.size(F.coalesce("m.accelerators", F.array())).alias("n_accelerators"))


def models(documents: DataFrame) -> DataFrame:
    return documents.select(F.posexplode("data").alias("pos", "m")).select("pos", "m.*")


def endpoints(documents: DataFrame) -> DataFrame:
    """One row per (model, endpoint) from the per-model documents."""
    return documents.select(F.col("data.id").alias("id"), F.posexplode("data.endpoints").alias("e_pos", "e")).select(
        "id", "e_pos", "e.*")
