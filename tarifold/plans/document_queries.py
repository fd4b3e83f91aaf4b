"""Price documents made of the driver tables as JSON text, parsed and joined as landed documents are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tarifold.plans.registry import query
from tarifold.plans.star import table
from tarifold.sources.offers import offer_entry_prices


def _entry(file: Column, key: Column, value: Column) -> list[Column]:
    return [file.cast("string").alias("file"), key.cast("bigint").alias("pos"), key.cast("string").alias("key"),
            F.to_json(value).alias("value")]


@query("offer_document_prices", """
WITH dims AS (SELECT l_partkey, l_returnflag || '-' || l_linestatus AS dim, min(l_extendedprice / l_quantity) AS usd
  FROM lineitem WHERE l_partkey % 11 <> 0 GROUP BY ALL)
SELECT p_partkey::VARCHAR AS sku_id, p_brand AS family, p_size::VARCHAR AS size, p_name AS name,
  (row_number() OVER (PARTITION BY p_partkey ORDER BY dim) - 1)::INT AS dim_pos, dim || ' "x"' AS description, usd
FROM dims JOIN part ON p_partkey = l_partkey WHERE p_brand IN ('Brand#11', 'Brand#13')""")
def _offer_document_prices(spark: SparkSession, d: str) -> DataFrame:
    """One product per part and its terms: the first holds the lowest unit price per flag and status, the second must not
    be read. Parts divisible by 11 have no terms."""
    part = table(spark, d, "part")
    products = part.select(*_entry(F.pmod("p_partkey", F.lit(7)), F.col("p_partkey"), F.struct(
        F.col("p_partkey").cast("string").alias("sku"), F.col("p_brand").alias("productFamily"),
        F.struct(F.col("p_size").cast("string").alias("size"), F.col("p_name").alias("name"), F.lit("unread").alias("other")).alias(
            "attributes"))))
    dim = F.concat_ws("-", "l_returnflag", "l_linestatus")
    lowest = table(spark, d, "lineitem").groupBy("l_partkey", dim.alias("dim")).agg(
        F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("usd"))
    def rate(slot: Column) -> Column:
        return F.struct(slot["dim"], F.struct(
            F.lit("Hrs").alias("unit"), F.concat(slot["dim"], F.lit(' "x"')).alias("description"), F.lit("0").alias("beginRange"),
            F.create_map(F.lit("USD"), slot["usd"].cast("string")).alias("pricePerUnit")))
    # At most six combinations of flag and status.
    slots = F.array_sort(F.collect_list(F.struct("dim", "usd")))
    per_part = lowest.groupBy("l_partkey").agg(slots.alias("slots")).withColumn("r", F.transform("slots", rate))
    dims = F.map_from_entries("r")
    offer = F.create_map(F.lit("first"), F.struct(dims.alias("priceDimensions")),
                         F.lit("second"), F.struct(F.map_from_entries(F.slice("r", 1, 1)).alias("priceDimensions")))
    terms = per_part.filter("l_partkey % 11 <> 0").select(
        *_entry(F.pmod("l_partkey", F.lit(7)), F.col("l_partkey"), offer))
    prices = offer_entry_prices(products, terms, ["Brand#11", "Brand#13"])
    return prices.select("sku_id", "family", F.col("attributes")["size"].alias("size"), F.col("attributes")["name"].alias("name"),
                         "dim_pos", "description", "usd")
