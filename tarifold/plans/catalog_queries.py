"""Catalog reads over the derived catalog: identity, lookups, search, comparison, regions, unit mix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tarifold.functions.terms import terms_hash
from tarifold.operators import compare as C, lookup as L
from tarifold.operators.rows import assemble_rows, min_price, shard_metadata, split_star
from tarifold.plans.registry import query, register
from tarifold.plans.star import STAR_SQL, kind_of, lines_and_rows, star_rows, table, with_names

WITH = "WITH " + STAR_SQL


def _flat(rows: DataFrame, *extra: Column | str) -> DataFrame:
    return rows.select("sku_id", "provider", "service", "kind", "resource_name", "region",
                       "terms_hash", F.size("prices").alias("n_prices"), *extra)


_FLAT = "sku_id, provider, service, kind, resource_name, region, terms_hash, n_prices"


@query("terms_hash", """
SELECT l_returnflag AS commitment, l_linestatus AS tenancy, o_orderpriority AS os, o_orderstatus AS support_tier,
       substr(sha256(to_json([l_returnflag, l_linestatus, o_orderpriority, o_orderstatus,
              CASE WHEN l_linenumber % 2 = 0 THEN 'even' ELSE '' END, ''])), 1, 32) AS terms_hash, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
GROUP BY 1, 2, 3, 4, 5""")
def _terms_hash(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    upfront = F.when(F.pmod("l_linenumber", F.lit(2)) == 0, "even")
    keys = ["l_returnflag", "l_linestatus", "o_orderpriority", "o_orderstatus"]
    grouped = df.groupBy(*keys, upfront.alias("upfront")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(
        F.col("l_returnflag").alias("commitment"), F.col("l_linestatus").alias("tenancy"),
        F.col("o_orderpriority").alias("os"), F.col("o_orderstatus").alias("support_tier"),
        terms_hash(*keys, "upfront", F.lit(None)).alias("terms_hash"), "n")


@query("catalog_rows", WITH + f"SELECT {_FLAT}, min_price, vcpu, memory_gb, mode FROM sku")
def _catalog_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = star_rows(spark, d).withColumn("min_price", F.coalesce(min_price(), F.lit(0.0)))
    return _flat(rows, "min_price", "resource_attrs.vcpu", "resource_attrs.memory_gb",
                 C.extra_field("mode").alias("mode"))


@query("price_attach", WITH + """
SELECT s.sku_id, count(p.dimension) AS n_prices,
       coalesce(string_agg(p.dimension || '=' || p.unit, ',' ORDER BY p.dimension), '') AS prices
FROM sku s LEFT JOIN price p ON p.sku_id = s.sku_id GROUP BY s.sku_id""")
def _price_attach(spark: SparkSession, d: str) -> DataFrame:
    star = split_star(star_rows(spark, d))
    rows = assemble_rows(star)
    listed = F.transform("prices", lambda p: F.concat(p["dimension"], F.lit("="), p["unit"]))
    return rows.select("sku_id", F.size("prices").cast("bigint").alias("n_prices"),
                       F.array_join(listed, ",").alias("prices"))


@query("min_price", WITH + "SELECT sku_id, min_amount AS min_price FROM sku")
def _min_price(spark: SparkSession, d: str) -> DataFrame:
    return star_rows(spark, d).select("sku_id", min_price().alias("min_price"))


@query("catalog_metadata", WITH + """
SELECT provider, service, count(*) AS row_count, string_agg(DISTINCT kind, ',' ORDER BY kind) AS allowed_kinds,
       string_agg(DISTINCT commitment, ',' ORDER BY commitment) AS allowed_commitments,
       string_agg(DISTINCT tenancy, ',' ORDER BY tenancy) AS allowed_tenancies,
       string_agg(DISTINCT os, ',' ORDER BY os) AS allowed_oses
FROM sku GROUP BY 1, 2""")
def _catalog_metadata(spark: SparkSession, d: str) -> DataFrame:
    meta = shard_metadata(star_rows(spark, d))
    names = ["allowed_kinds", "allowed_commitments", "allowed_tenancies", "allowed_oses"]
    return meta.select("provider", "service", "row_count", *(F.array_join(n, ",").alias(n) for n in names))


def _requests(line: DataFrame) -> DataFrame:
    """Every order line asks for the price of what it bought, naming more or fewer conditions by its flags."""
    pinned = terms_hash(F.lit("on_demand"), *(F.lit("") for _ in range(5)))
    return line.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", F.concat_ws("::", "l_partkey", "l_suppkey")).alias("request_id"),
        "kind", F.col("p_name").alias("resource_name"),
        F.col("s_name").alias("provider"), F.when(F.col("l_linestatus") == "O", F.col("p_brand")).alias("service"),
        F.when(F.col("l_returnflag") != "R", F.col("n_name")).alias("region"),
        F.when(F.col("l_returnflag") == "N", pinned).alias("terms_hash"),
    )


_MASKS = [("service", "region"), ("region",), ("service",), (), ("service", "region", "terms_hash"),
          ("region", "terms_hash")]


_REQUESTS_SQL = """,
request AS (
  SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || s.sku_id AS request_id, kind, resource_name, provider,
         CASE WHEN l_linestatus = 'O' THEN service END AS service,
         CASE WHEN l_returnflag <> 'R' THEN region END AS region,
         CASE WHEN l_returnflag = 'N' THEN substr(sha256(to_json(['on_demand', '', '', '', '', ''])), 1, 32) END AS h
  FROM lineitem JOIN sku s ON s.sku_id = l_partkey || '::' || l_suppkey),
answer AS (
  SELECT request_id, s.sku_id, s.n_prices
  FROM request r JOIN sku s ON s.kind = r.kind AND s.resource_name = r.resource_name AND s.provider = r.provider
   AND (r.service IS NULL OR s.service = r.service) AND (r.region IS NULL OR s.region = r.region)
   AND (r.h IS NULL OR s.terms_hash = r.h))
"""


@query("lookup_bulk", WITH + _REQUESTS_SQL + "SELECT request_id, sku_id, n_prices FROM answer")
def _lookup_bulk(spark: SparkSession, d: str) -> DataFrame:
    lines, rows = lines_and_rows(spark, d)
    return L.lookup_many(rows, _requests(lines), optional=("service", "region"), masks=_MASKS, entered=[()],
                         required=("kind", "resource_name", "provider"), shown=("sku_id", F.size("prices").alias("n_prices")))


@query("lookup_not_found", WITH + _REQUESTS_SQL + """
SELECT request_id, 'not_found' AS code FROM request WHERE request_id NOT IN (SELECT request_id FROM answer)""")
def _lookup_not_found(spark: SparkSession, d: str) -> DataFrame:
    # an anti join takes nulls from one side only, so the two sides couldn't read one exchange of lines_and_rows()
    lines = with_names(spark, d, table(spark, d, "lineitem")).withColumn("kind", kind_of(F.col("p_partkey")))
    return L.lookup_missing(star_rows(spark, d), _requests(lines), optional=("service", "region"),
                            required=("kind", "resource_name", "provider"), masks=_MASKS, entered=[()]).select("request_id", "code")


_TERMS = {
    "compute.vm": ("shared", "linux"), "db.relational": ("postgres", "single-az"), "storage.object": ("", ""),
    "db.nosql": ("firestore-native", ""), "cache.kv": ("redis", ""), "container.orchestration": ("kubernetes", "standard"),
    "search.engine": ("shared", "managed-cluster"),
}
_STAR_LOOKUPS = [k for k in L.LOOKUP_KINDS if k in C.COMPARE_KINDS]


def _typed_lookup(kind: str) -> None:
    tenancy, os = _TERMS.get(kind, ("", ""))
    resource = "red widget" if kind != "db.nosql" else "blue bolt"

    def run(spark: SparkSession, d: str) -> DataFrame:
        return _flat(L.lookup(star_rows(spark, d), kind, resource, commitment="on_demand", tenancy=tenancy, os=os))

    register("lookup_" + kind.replace(".", "_"), run, WITH + f"""
SELECT {_FLAT} FROM sku WHERE kind = '{kind}' AND resource_name = '{resource}'
  AND commitment = 'on_demand' AND tenancy = '{tenancy}' AND os = '{os}' AND support_tier = ''""")


for _kind in _STAR_LOOKUPS:
    _typed_lookup(_kind)


@query("lookup_paas_columns", WITH + f"""
SELECT {_FLAT} FROM sku WHERE kind = 'paas.app' AND commitment = 'on_demand' AND support_tier = 'premium'
  AND region = 'NATION_16'""")
def _lookup_paas(spark: SparkSession, d: str) -> DataFrame:
    return _flat(L.lookup_by_term_columns(star_rows(spark, d), "paas.app", region="NATION_16", support_tier="premium"))


@query("lookup_warehouse_columns", WITH + f"""
SELECT {_FLAT} FROM sku WHERE kind = 'warehouse.query' AND resource_name = 'blue bolt' AND commitment = 'on_demand'
  AND os = 'on-demand' AND tenancy = 'shared'""")
def _lookup_warehouse(spark: SparkSession, d: str) -> DataFrame:
    return _flat(L.lookup_by_term_columns(star_rows(spark, d), "warehouse.query", "blue bolt",
                                          commitment="on_demand", os="on-demand", tenancy="shared"))


_SEARCH_ORDER = {
    "resource_name": "resource_name, sku_id", "price": "min_amount ASC NULLS LAST, sku_id",
    "vcpu": "vcpu ASC NULLS FIRST, sku_id", "memory": "memory_gb ASC NULLS FIRST, sku_id",
}


def _search(sort: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _flat(L.search(star_rows(spark, d), "Supplier#000000007", "Brand#7", sort=sort, limit=10))

    register("search_by_" + sort, run, WITH + f"""
SELECT {_FLAT} FROM sku WHERE provider = 'Supplier#000000007' AND service = 'Brand#7'
ORDER BY {_SEARCH_ORDER[sort]} LIMIT 10""")


for _sort in _SEARCH_ORDER:
    _search(_sort)


@query("search_filtered", WITH + f"""
SELECT {_FLAT} FROM sku WHERE provider = 'Supplier#000000003' AND service = 'Brand#5' AND vcpu >= 5
  AND memory_gb >= 920 AND min_amount <= 2500""")
def _search_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _flat(L.search(star_rows(spark, d), "Supplier#000000003", "Brand#5", min_vcpu=5, min_memory_gb=920,
                          max_price=2500, limit=0))


_REGION_LIST = [f"NATION_{i}" for i in range(0, 25, 2)]
_REGION_SQL = "region IN (" + ", ".join(f"'{r}'" for r in _REGION_LIST) + ")"
# kind -> (spec, the same predicates in SQL)
_COMPARES: dict[str, tuple[dict, str]] = {
    "compute.vm": ({"vcpu": 4, "memory_gb": 905.0},
                   "tenancy = 'shared' AND os = 'linux' AND (gpu_count IS NULL OR gpu_count = 0) "
                   "AND vcpu >= 4 AND memory_gb >= 905"),
    "storage.object": ({"durability_nines": 3, "availability_tier": "standard"},
                       "tenancy = '' AND os = '' AND durability_nines >= 3 AND availability_tier = 'standard'"),
    "db.relational": ({"engine": "postgres", "deployment_option": "single-az", "storage_gb": 500.0},
                      "tenancy IN ('postgres', 'aurora-postgres', 'azure-postgres', 'cloud-sql-postgres') "
                      "AND os = 'single-az' AND storage_gb >= 500"),
    "cache.kv": ({"memory_gb": 1000.0, "engine": "redis"},
                 "tenancy = 'redis' AND memory_gb BETWEEN 900 AND 1500"),
    "container.orchestration": ({"tier": "standard"}, "mode = 'control-plane' AND os = 'standard'"),
    "search.engine": ({"vcpu": 3, "mode": "serverless"}, "mode = 'serverless' AND vcpu >= 3"),
    "paas.app": ({"tier": "basic", "memory_gb": 910.0},
                 "os = 'linux' AND support_tier = 'basic' AND memory_gb >= 910"),
    "warehouse.query": ({"edition": "enterprise", "storage_tier": "long-term"},
                        "mode = 'on-demand' AND edition = 'enterprise' AND storage_tier = 'long-term'"),
    "messaging.queue": ({"mode": "alpha", "ops": 1000}, "mode = 'alpha'"),
    "messaging.topic": ({"mode": "beta"}, "mode = 'beta'"),
    "dns.zone": ({"mode": "gamma", "queries": 5}, "mode = 'gamma'"),
    "api.gateway": ({}, "TRUE"),
    "network.cdn": ({"mode": "alpha", "gb": 10.0}, "mode = 'alpha'"),
    "db.nosql": ({"engine": "sql", "mode": "beta"}, "tenancy = 'sql' AND mode = 'beta'"),
}


def _compare(kind: str, capped: bool) -> None:
    spec, predicate = _COMPARES[kind]
    spec = {**spec, "max_price": 1500.0} if capped else spec

    def run(spark: SparkSession, d: str) -> DataFrame:
        return _flat(C.compare(star_rows(spark, d), kind, C.CompareSpec(**spec), regions=_REGION_LIST,
                               expanded=True), "min_price")

    cap = " AND min_amount <= 1500" if capped else ""
    register("compare_" + kind.replace(".", "_") + ("_capped" if capped else ""), run, WITH + f"""
SELECT {_FLAT}, min_price FROM sku WHERE kind = '{kind}' AND commitment = 'on_demand' AND {predicate}
  AND {_REGION_SQL}{cap} ORDER BY min_price, provider, resource_name, sku_id LIMIT 20""")


for _kind in C.COMPARE_KINDS:
    _compare(_kind, False)
    _compare(_kind, True)


def _compare_sorted(sort: str, key: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _flat(C.compare(star_rows(spark, d), "compute.vm", sort=sort, limit=50), "min_price")

    register(f"compare_sorted_by_{sort}", run, WITH + f"""
SELECT {_FLAT}, min_price FROM sku WHERE kind = 'compute.vm' AND commitment = 'on_demand' AND tenancy = 'shared'
  AND os = 'linux' AND coalesce(gpu_count, 0) = 0 ORDER BY {key}, provider, resource_name, sku_id LIMIT 50""")


_compare_sorted("vcpu", "coalesce(vcpu, 0)")
_compare_sorted("memory", "coalesce(memory_gb, 0)")


@query("region_group", """
WITH asked AS (
  SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE r_name END AS region
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT c_custkey, region AS region_literal FROM asked
UNION SELECT c_custkey, 'global' FROM asked WHERE region IN (SELECT r_name FROM region)
UNION SELECT c_custkey, n_name FROM asked JOIN region ON r_name = region JOIN nation ON n_regionkey = r_regionkey""")
def _region_group(spark: SparkSession, d: str) -> DataFrame:
    place = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    asked = table(spark, d, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.when(F.pmod("c_custkey", F.lit(2)) == 0, F.col("n_name")).otherwise(F.col("r_name"))
        .alias("region"))
    groups = place.select(F.col("r_name").alias("group"), F.col("n_name").alias("member"))
    return C.expand_region_requests(asked, "c_custkey", "region", groups)


@query("mixed_units", WITH + """,
unit AS (SELECT DISTINCT kind, region, unit FROM sku JOIN price USING (sku_id)),
family AS (SELECT kind, region, unit, CASE unit WHEN '1M-req' THEN 'count' WHEN 'request' THEN 'count'
  WHEN 'requests' THEN 'count' WHEN 'hr' THEN 'hour' WHEN 'hour' THEN 'hour' WHEN 'gb' THEN 'byte'
  WHEN 'gb-mo' THEN 'byte' WHEN 'gib-mo' THEN 'byte' WHEN 'month' THEN 'month' END AS family FROM unit)
SELECT kind, region, coalesce(string_agg(DISTINCT family, ',' ORDER BY family), '') AS families,
       count(DISTINCT family) > 1 AS mixed,
       bool_or(unit IN ('1M-req', 'request')) AND bool_or(unit IN ('hr', 'hour')) AS mixed_gateway
FROM family GROUP BY 1, 2""")
def _mixed_units(spark: SparkSession, d: str) -> DataFrame:
    return C.mixed_units(star_rows(spark, d), ["kind", "region"])


@query("json_path", """
SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n
FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1, 2""")
def _json_path(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("bigint").alias("k")
    return (table(spark, d, "events").select("event_type", k).filter("k IS NOT NULL")
            .groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n")))
