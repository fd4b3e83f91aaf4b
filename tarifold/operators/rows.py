"""Building and reading nested rows: assembling from star tables, splitting into them, price helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tarifold import schemas as S
from tarifold.functions.cases import col
from tarifold.functions.terms import empty_to_null_terms, terms_hash_of


_CAST_ROW = [f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in S.ROW]


def price(dimension: Column | str, amount: Column, unit: Column | str, tier: Column | str = "",
          tier_upper: Column | str = "") -> Column:
    """One price struct in canonical field order."""
    return F.named_struct(F.lit("dimension"), col(dimension), F.lit("tier"), col(tier), F.lit("tier_upper"),
                          col(tier_upper), F.lit("amount"), amount.cast("double"), F.lit("unit"), col(unit))


def attrs(**values: Column) -> Column:
    """Resource attributes from the given columns, every other field null."""
    nulls = F.expr("named_struct(" + ", ".join(
        f"'{f.name}', CAST(NULL AS {f.dataType.simpleString()})" for f in S.RESOURCE_ATTRS) + ")")
    out = nulls
    for name, value in values.items():
        out = out.withField(name, value.cast(S.RESOURCE_ATTRS[name].dataType))
    return out


def json_object(**fields: Column | str) -> Column:
    """Compact JSON object text that keeps null fields, as the catalog stores extras."""
    parts = F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()))
    return F.to_json(parts, {"ignoreNullFields": "false"})


def normalized_rows(df: DataFrame, *, provider, service, kind, sku_id: Column, resource_name: Column, region: Column,
                    region_normalized: Column, terms: Column, prices: Column, resource_attrs: Column | None = None,
                    health: Column | None = None, is_aggregated: Column | None = None) -> DataFrame:
    """Project a feed frame to the canonical row; the terms hash is derived here and nowhere else."""
    def c(v):
        return v if isinstance(v, Column) else F.lit(v)
    out = df.select(
        sku_id.cast("string").alias("sku_id"), c(provider).alias("provider"), c(service).alias("service"),
        c(kind).alias("kind"), resource_name.alias("resource_name"), region.alias("region"),
        region_normalized.alias("region_normalized"),
        (resource_attrs if resource_attrs is not None else attrs()).alias("resource_attrs"),
        terms.alias("terms"), prices.alias("prices"),
        (health if health is not None else F.lit(None).cast(S.HEALTH)).alias("health"),
        (is_aggregated if is_aggregated is not None else F.lit(False)).alias("is_aggregated"),
    )
    out = out.withColumn("terms_hash", terms_hash_of(F.col("terms")))
    return out.selectExpr(*_CAST_ROW)


def min_price(prices: Column | str = "prices") -> Column:
    """Cheapest amount over all dimensions, null when there is no price. No join: the prices sit on the row."""
    prices = F.col(prices) if isinstance(prices, str) else prices
    return F.array_min(prices["amount"])


def sorted_prices(prices: Column | str = "prices") -> Column:
    """Prices in presentation order: by dimension, then tier, both as text."""
    prices = F.col(prices) if isinstance(prices, str) else prices
    return F.array_sort(prices)


def split_star(rows: DataFrame) -> dict[str, DataFrame]:
    """The star tables of a set of nested rows (a storage layout)."""
    return {
        "skus": rows.select(*S.SKU_COLUMNS),
        "resource_attrs": rows.select("sku_id", "resource_attrs.*"),
        "terms": rows.withColumn("terms", empty_to_null_terms(F.col("terms"))).select("sku_id", "terms.*"),
        "prices": rows.select("sku_id", F.explode("prices").alias("p")).select("sku_id", "p.*")
                      .fillna("", ["tier", "tier_upper"]),
        "health": rows.filter("health IS NOT NULL").select("sku_id", "health.*"),
    }


def assemble_rows(star: dict[str, DataFrame]) -> DataFrame:
    """Nested rows from star tables: inner to terms, left to the rest, prices gathered per item.

    All inputs are hashed on sku_id once; the price array is bounded by the key (dimension, tier).
    """
    skus, terms = star["skus"], star["terms"]
    term = terms.select("sku_id", F.struct(*S.TERM_FIELDS).alias("terms"))
    attr = star["resource_attrs"].select("sku_id", F.struct(*S.ATTR_FIELDS).alias("resource_attrs"))
    prices = star["prices"].groupBy("sku_id").agg(
        F.array_sort(F.collect_list(F.struct(*S.PRICE_FIELDS))).alias("prices"))
    out = skus.join(term, "sku_id").join(attr, "sku_id", "left").join(prices, "sku_id", "left")
    if "health" in star:
        out = out.join(star["health"].select("sku_id", F.struct(*S.HEALTH_FIELDS).alias("health")), "sku_id", "left")
    else:
        out = out.withColumn("health", F.lit(None).cast(S.HEALTH))
    out = out.withColumn("is_aggregated", F.col("provider") == "openrouter")
    out = out.withColumn("prices", F.coalesce("prices", F.array().cast(S.ROW["prices"].dataType)))
    return out.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in S.ROW))


def empty_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], S.ROW)


def shard_metadata(rows: DataFrame) -> DataFrame:
    """Per (provider, service) summary: counts and sorted distinct vocabularies.

    The distinct sets are closed vocabularies, so collecting them per group is bounded whatever the row count.
    """
    def distinct(col: str) -> Column:
        return F.sort_array(F.collect_set(F.coalesce(F.col(col), F.lit(""))))
    return rows.groupBy("provider", "service").agg(
        F.count(F.lit(1)).alias("row_count"),
        distinct("kind").alias("allowed_kinds"),
        distinct("terms.commitment").alias("allowed_commitments"),
        distinct("terms.tenancy").alias("allowed_tenancies"),
        distinct("terms.os").alias("allowed_oses"),
    )
