"""Cost estimation over a rate card derived from `part` and a workload derived from `lineitem`.

Parts are dealt to the thirteen estimators, two parts per region and estimator, so lookups hit, miss and collide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tarifold.functions.cases import first_case
from tarifold.functions.numbers import significant
from tarifold.functions.terms import literal_terms
from tarifold.functions.tiers import count_bound, tier_bound, tier_entries, walk_tiers
from tarifold.operators.estimate import estimate, estimate_total, parse_items, rounded_lines
from tarifold.operators.rows import attrs, json_object, normalized_rows, price
from tarifold.plans.registry import query, register
from tarifold.plans.star import table

KINDS = (
    "compute.vm", "storage.object", "llm.text", "db.relational.aurora", "db.relational.spanner", "db.nosql.cosmos",
    "search.engine.opensearch", "paas.app.appservice", "warehouse.query.bigquery", "messaging.queue", "dns.zone",
    "api.gateway", "network.cdn",
)


def _deal(df: DataFrame, key: str, only: int | None) -> DataFrame:
    """Deal keys to estimators: k is the estimator, g the region group, v which of the two parts of the group.

    With `only`, every part and every order line goes to that one estimator.
    """
    deal = F.floor(F.col(key) / len(KINDS)).cast("bigint") if only is None else F.col(key)
    k = F.pmod(F.col(key), F.lit(len(KINDS))).cast("int") if only is None else F.lit(only)
    return df.withColumns({"k": k, "g": F.floor(deal / 2), "v": F.pmod(deal, F.lit(2)).cast("int")})


def _pick(*options: Column | str) -> Column:
    return first_case((F.col("k") == i, o) for i, o in enumerate(options))


def _by_variant(first: Column | str, second: Column | str) -> Column:
    def c(v):
        return v if isinstance(v, Column) else F.lit(v)
    return F.when(F.col("v") == 0, c(first)).otherwise(c(second))


def _group() -> Column:
    return F.col("g").cast("string")


def _vm() -> Column:
    """Name of the machine; in every seventh group both parts share one name, so the lookup is ambiguous."""
    return F.concat(F.lit("vm-"), F.when(F.pmod("g", F.lit(7)) == 0, 0).otherwise(F.col("v")))


def card_rows(spark: SparkSession, d: str, only: int | None = None) -> DataFrame:
    """The rate card, one row per part. Parts are dealt to tasks while rows are narrow: a file of many is one row group, so one task."""
    part = _deal(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice").repartition("p_partkey"), "p_partkey", only)
    base = F.col("p_retailprice")
    provider = _pick("aws", "aws", F.concat(F.lit("prov"), F.col("v")), "aws", "gcp", "azure", "aws", "azure", "gcp",
                     _by_variant("aws", "azure"), "aws", _by_variant("aws", "azure"), "azure")
    service = _pick("ec2", "s3", "text", "aurora", "spanner", "cosmosdb", "opensearch", "appservice", "bigquery",
                    _by_variant("sqs", "event-hubs"), "route53", _by_variant("api-gateway", "apim"), "front-door")
    kind = _pick("compute.vm", "storage.object", "llm.text", "db.relational", "db.relational", "db.nosql",
                 "search.engine", "paas.app", "warehouse.query", "messaging.queue", "dns.zone", "api.gateway",
                 "network.cdn")
    resource = _pick(
        _vm(), F.concat(F.lit("standard"), F.col("v")), F.concat(F.lit("model-"), _group()),
        _by_variant("db.r5", "aurora-serverless-v2"), _by_variant("spanner-standard", "spanner-enterprise"),
        _by_variant("cosmos-provisioned", "cosmos-serverless"), _by_variant("r6g.large", "opensearch-serverless"),
        F.concat(F.lit("P"), F.col("v")), _by_variant("on-demand", "storage-active"),
        _by_variant("standard", "premium"), F.concat(F.lit("public-"), _group(), F.lit("-"), F.col("v")),
        _by_variant("rest", "basic"), "standard")
    region = F.concat(F.lit("r"), _group())
    region = F.when(F.col("k") == 2, "").when((F.col("k") == 10) | ((F.col("k") == 12) & (F.col("v") == 1)),
                                              "global").otherwise(region)
    tenancy = _pick("shared", "", "", "aurora-postgres", F.col("resource"), "sql", "shared", "dedicated", "shared",
                    "", "", "", "")
    os = _pick("linux", "", "", "single-az", "", _by_variant("provisioned", "serverless"),
               _by_variant("managed-cluster", "serverless"), "linux", "on-demand", "", "", "", "")

    def one(dimension: str, amount: Column, unit: str, tier: str = "", upper: str = "") -> Column:
        return price(dimension, amount, unit, tier, upper)

    sets = {
        0: [one("compute", base / 1000, "hour")],
        1: [one("storage", base / 10000, "gb-mo"), one("requests-put", base / 1e6, "requests"),
            one("requests-get", base / 1e7, "requests")],
        2: [one("prompt", base / 1e6, "token"), one("completion", base / 5e5, "token")],
        (3, 0): [one("compute", base / 1000, "hrs"), one("io", base / 2000, "hrs")],
        (3, 1): [one("compute", base / 3000, "acu-hr")],
        4: [one("compute", base / 1e6, "pu-hour")],
        (5, 0): [one("provisioned", base / 1e7, "ru/s-hour")],
        (5, 1): [one("serverless", base / 4000, "1M-ru")],
        (6, 0): [one("instance", base / 1000, "hrs"), one("reserve", base / 1500, "hrs")],
        (6, 1): [one("compute-ocu", base / 4000, "ocu-hour"), one("storage", base / 9000, "gb-mo")],
        7: [one("instance", base / 1200, "hrs")],
        (8, 0): [one("query", base / 150, "tb")],
        (8, 1): [one("storage", base / 50000, "gb-month")],
        (9, 0): [one("request", base * 0, "request", "0", "1M"), one("request", base / 1e9, "request", "1M", "100B"),
                 one("request", base / 2e9, "request", "100B", "")],
        (9, 1): [one("ppu_hour", base / 1000, "hour", "0", "")],
        10: [one("hosted_zone", base / 2000, "month", "0", "25"), one("hosted_zone", base / 10000, "month", "25", ""),
             one("query", base / 2e9, "request", "0", "1B"), one("query", base / 4e9, "request", "1B", "")],
        (11, 0): [one("request", base / 3e8, "request", "0", "333M"), one("request", base / 4e8, "request", "333M", "1B"),
                  one("request", base / 6e8, "request", "1B", "")],
        (11, 1): [one("unit_hour", base / 5000, "hour", "0", "")],
        (12, 0): [one("egress", base / 12000, "gb", "0", "10TB"), one("egress", base / 20000, "gb", "10TB", "")],
        (12, 1): [one("base-fee", base / 30, "month")],
    }
    unpriced = (F.col("k") == 0) & (F.pmod("p_size", F.lit(10)) == 0)
    cases = [(unpriced, F.slice(F.array(*sets[0]), 1, 0))]
    for key, options in sets.items():
        hit = (F.col("k") == key[0]) & (F.col("v") == key[1]) if isinstance(key, tuple) else F.col("k") == key
        cases.append((hit, F.array(*options)))
    prices = first_case(cases)
    extra = F.when(F.col("k") == 12, json_object(mode=_by_variant("edge-egress", "base-fee"),
                                                 sku=F.concat(F.lit("plan-"), _group()))).otherwise("{}")
    return normalized_rows(
        part.withColumn("resource", resource), provider=provider, service=service, kind=kind,
        sku_id=F.concat(F.lit("card-"), F.col("p_partkey")), resource_name=F.col("resource"), region=region,
        region_normalized=region, prices=prices, resource_attrs=attrs(extra=extra),
        terms=literal_terms(commitment="on_demand", tenancy=tenancy, os=os,
                            support_tier=F.when(F.col("k") == 7, "premium").otherwise("")))


def workload(spark: SparkSession, d: str, only: int | None = None) -> DataFrame:
    """One workload item in text form per order line."""
    line = _deal((table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity")), "l_partkey", only)
    ln, qty = F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("bigint").cast("string")
    even = F.pmod("l_linenumber", F.lit(2)) == 0
    place = F.concat(F.lit(":region="), F.when(F.col("l_linenumber") == 7, "nowhere")
                     .otherwise(F.concat(F.lit("r"), _group())))

    def text(*parts: Column | str) -> Column:
        return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))

    raw = _pick(
        text("aws/ec2:", _vm(), place, ":count=", ln),
        text("aws/s3:standard", F.col("v").cast("string"), place, ":gb_month=", qty, "K:put_requests=10:get_requests=",
             ln),
        text("llm:model-", _group(), ":input=1M:output=", qty, "K",
             F.when(even, text(":serving_provider=prov", F.col("v").cast("string"))).otherwise("")),
        _by_variant(text("aws/aurora:db.r5", place, ":hours=100:count=", ln),
                    text("aws/aurora:serverless-v2", place, ":acu_hours=", qty)),
        text("gcp/spanner:", _by_variant("standard", "enterprise"), place, F.when(even, ":pu=100").otherwise(":node=2"),
             ":hours=", qty),
        _by_variant(text("azure/cosmosdb:provisioned", place, ":ru_per_sec=400:hours=", qty),
                    text("azure/cosmosdb:serverless", place, ":ru_million=", qty)),
        _by_variant(text("aws/opensearch:r6g.large", place, ":count=", ln),
                    text("aws/opensearch:serverless", place, ":ocu_hours=", qty)),
        text("azure/appservice:P", F.col("v").cast("string"), place, ":tier=premium:count=", ln),
        _by_variant(text("gcp/bigquery:on-demand", place, ":tb_queried=", qty),
                    text("gcp/bigquery:storage-active", place, ":gb_month=", qty)),
        _by_variant(text("aws/sqs:standard", place, ":ops=", qty, "G"),
                    text("azure/event-hubs:premium", place, ":ppu_hours=", qty)),
        text("aws/route53:public-", _group(), "-", F.col("v").cast("string"), ":zones=", qty, ":queries=", ln, "G"),
        _by_variant(text("aws/api-gateway:rest", place, ":requests=", qty, "0M"),
                    text("azure/apim:basic", place, ":units=", ln, ":hours=", qty)),
        text("azure/front-door:standard", place, ":gb=", qty, "00"))
    return parse_items(line.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("item_index"),
                                   raw.alias("raw")))


_LINES_SQL = """
WITH card AS (
  SELECT p_partkey, p_partkey % 13 AS k, p_partkey // 26 AS g, (p_partkey // 13) % 2 AS v, p_retailprice AS base, p_size,
         count(*) OVER (PARTITION BY p_partkey % 13, p_partkey // 26) AS pair
  FROM part),
fee AS (SELECT g, base / 30 AS fee FROM card WHERE k = 12 AND v = 1),
want AS (
  SELECT l_orderkey * 8 + l_linenumber AS item_index, c.*, l_linenumber AS ln, CAST(l_quantity AS BIGINT) AS qty, fee
  FROM lineitem JOIN card c ON p_partkey = l_partkey LEFT JOIN fee f ON f.g = c.g AND k = 12),
priced AS (
  SELECT *, CASE
    WHEN ln = 7 AND k NOT IN (2, 10) THEN NULL
    WHEN k = 0 THEN CASE WHEN (g % 7 = 0 AND pair > 1) OR p_size % 10 = 0 THEN NULL
                         ELSE (base / 1000) * (730.0::DOUBLE * ln) END
    WHEN k = 1 THEN (qty * 1e3) * (base / 10000) + 10.0::DOUBLE * (base / 1e6) + ln * (base / 1e7)
    WHEN k = 2 THEN CASE WHEN ln % 2 = 1 AND pair > 1 THEN NULL ELSE 1e6 * (base / 1e6) + (qty * 1e3) * (base / 5e5) END
    WHEN k = 3 THEN CASE v WHEN 0 THEN (base / 1000) * (100.0::DOUBLE * ln) ELSE (base / 3000) * qty END
    WHEN k = 4 THEN (base / 1e6) * ((CASE WHEN ln % 2 = 0 THEN 100 ELSE 2000 END)::DOUBLE * qty)
    WHEN k = 5 THEN CASE v WHEN 0 THEN (base / 1e7) * (400.0::DOUBLE * qty) ELSE (base / 4000) * qty END
    WHEN k = 6 THEN CASE v WHEN 0 THEN (base / 1500) * (730.0::DOUBLE * ln) ELSE (base / 4000) * qty END
    WHEN k = 7 THEN (base / 1200) * (730.0::DOUBLE * ln)
    WHEN k = 8 THEN CASE v WHEN 0 THEN (base / 150) * qty ELSE (base / 50000) * qty END
    WHEN k = 9 THEN CASE v WHEN 0 THEN least(qty * 1e9 - 1e6, 99999e6) * (base / 1e9)
                            + greatest(qty * 1e9 - 1e11, 0) * (base / 2e9) ELSE (base / 1000) * qty END
    WHEN k = 10 THEN (least(qty, 25) * (base / 2000) + greatest(qty - 25, 0) * (base / 10000))
                   + (least(ln * 1e9, 1e9) * (base / 2e9) + greatest(ln * 1e9 - 1e9, 0) * (base / 4e9))
    WHEN k = 11 THEN CASE v WHEN 0 THEN least(qty * 1e7, 333e6) * (base / 3e8)
                              + greatest(least(qty * 1e7, 1e9) - 333e6, 0) * (base / 4e8)
                              + greatest(qty * 1e7 - 1e9, 0) * (base / 6e8)
                             ELSE (base / 5000) * ln * qty END
    WHEN k = 12 THEN CASE WHEN v = 1 THEN CASE WHEN pair > 1 THEN (qty * 100.0::DOUBLE) * (
                              (SELECT c2.base FROM card c2 WHERE c2.k = 12 AND c2.v = 0 AND c2.g = want.g) / 12000) + fee END
                          ELSE (qty * 100.0::DOUBLE) * (base / 12000) + coalesce(fee, 0) END
    END AS monthly
  FROM want),
lines AS (
  SELECT item_index,
    CASE k WHEN 0 THEN 'compute.vm' WHEN 1 THEN 'storage.object' WHEN 2 THEN 'llm.text' WHEN 3 THEN 'db.relational.aurora'
      WHEN 4 THEN 'db.relational.spanner' WHEN 5 THEN 'db.nosql.cosmos' WHEN 6 THEN 'search.engine.opensearch'
      WHEN 7 THEN 'paas.app.appservice' WHEN 8 THEN 'warehouse.query.bigquery' WHEN 9 THEN 'messaging.queue'
      WHEN 10 THEN 'dns.zone' WHEN 11 THEN 'api.gateway' ELSE 'network.cdn' END AS kind,
    CASE WHEN monthly IS NOT NULL THEN 'card-' || CASE WHEN k = 12 AND v = 1 THEN p_partkey - 13 ELSE p_partkey END END
      AS sku_id,
    round(monthly, 9) AS monthly_usd, monthly IS NULL AS failed,
    CASE WHEN monthly IS NOT NULL THEN CASE k WHEN 0 THEN base / 1000 WHEN 3 THEN CASE v WHEN 0 THEN base / 1000 ELSE base / 3000 END
      WHEN 4 THEN base / 1e6 WHEN 5 THEN CASE v WHEN 0 THEN base / 1e7 ELSE base / 4000 END
      WHEN 6 THEN CASE v WHEN 0 THEN base / 1500 ELSE base / 4000 END WHEN 7 THEN base / 1200
      WHEN 8 THEN CASE v WHEN 0 THEN base / 150 ELSE base / 50000 END WHEN 9 THEN CASE v WHEN 1 THEN base / 1000 END
      WHEN 11 THEN CASE v WHEN 1 THEN base / 5000 END END END AS hourly_usd,
    CASE WHEN monthly IS NOT NULL THEN CASE k WHEN 0 THEN 730.0::DOUBLE * ln WHEN 1 THEN qty * 1e3 WHEN 2 THEN 1e6 + qty * 1e3
      WHEN 3 THEN CASE v WHEN 0 THEN 100.0::DOUBLE * ln ELSE qty END WHEN 4 THEN (CASE WHEN ln % 2 = 0 THEN 100 ELSE 2000 END)::DOUBLE * qty
      WHEN 5 THEN CASE v WHEN 0 THEN 400.0::DOUBLE * qty ELSE qty END WHEN 6 THEN CASE v WHEN 0 THEN 730.0::DOUBLE * ln ELSE qty END
      WHEN 7 THEN 730.0::DOUBLE * ln WHEN 8 THEN qty WHEN 9 THEN CASE v WHEN 0 THEN qty * 1e9 ELSE qty END
      WHEN 11 THEN CASE v WHEN 0 THEN qty * 1e7 ELSE ln * qty END WHEN 12 THEN qty * 100.0::DOUBLE END::DOUBLE END AS quantity,
    CASE WHEN monthly IS NOT NULL THEN CASE k WHEN 0 THEN 'hour' WHEN 1 THEN 'gb-mo' WHEN 2 THEN 'token'
      WHEN 3 THEN CASE v WHEN 0 THEN 'hrs' ELSE 'acu-hr' END WHEN 4 THEN 'pu-hour' WHEN 5 THEN CASE v WHEN 0 THEN 'ru/s-hour' ELSE '1M-ru' END
      WHEN 6 THEN CASE v WHEN 0 THEN 'hrs' ELSE 'ocu-hour' END WHEN 7 THEN 'hrs' WHEN 8 THEN CASE v WHEN 0 THEN 'tb' ELSE 'gb-month' END
      WHEN 9 THEN CASE v WHEN 0 THEN 'request' ELSE 'ppu-hr' END WHEN 11 THEN CASE v WHEN 0 THEN 'request' ELSE 'unit-hr' END
      WHEN 12 THEN 'gb' END END AS quantity_unit,
    CASE WHEN monthly IS NULL THEN CASE WHEN ln = 7 AND k NOT IN (2, 10) THEN 'no matching catalog row'
      WHEN k = 0 THEN CASE WHEN g % 7 = 0 AND pair > 1 THEN 'ambiguous: more than one catalog row' ELSE 'no matching price' END
      WHEN k = 2 THEN 'ambiguous: name a serving_provider' ELSE 'no matching catalog row' END END AS error
  FROM priced)
"""


def _lines(spark: SparkSession, d: str, only: int | None = None) -> DataFrame:
    lines = estimate(workload(spark, d, only), card_rows(spark, d, only), list(KINDS) if only is None else None)
    return lines.select("item_index", "kind", "sku_id", F.round("monthly_usd", 9).alias("monthly_usd"),
                        F.col("error").isNotNull().alias("failed"), "hourly_usd", "quantity", "quantity_unit", "error")


_SELECT = "SELECT item_index, kind, sku_id, monthly_usd, failed, hourly_usd, quantity, quantity_unit, error FROM lines"
register("estimate_mixed_workload", _lines, _LINES_SQL + _SELECT)


def _one_kind(i: int, kind: str) -> None:
    sql = (_LINES_SQL.replace("p_partkey % 13", str(i)).replace("p_partkey // 26", "p_partkey // 2")
           .replace("(p_partkey // 13) % 2", "p_partkey % 2").replace("p_partkey - 13", "p_partkey - 1"))
    register("estimate_" + kind.replace(".", "_"), lambda spark, d: _lines(spark, d, i), sql + _SELECT)


for _i, _kind in enumerate(KINDS):
    _one_kind(_i, _kind)


@query("estimate_total", _LINES_SQL + """
SELECT round(sum(monthly_usd) / 1e3, 0) AS monthly_kusd, 'USD' AS currency, count(monthly_usd) AS n_items FROM lines""")
def _total(spark: SparkSession, d: str) -> DataFrame:
    # A sum of doubles depends on order, so the check compares thousands of dollars.
    total = estimate_total(estimate(workload(spark, d), card_rows(spark, d), list(KINDS)), strict=False, digits=15)
    return total.select(F.round(F.col("monthly_usd") / 1e3, 0).alias("monthly_kusd"), "currency", "n_items")


@query("estimate_errors", _LINES_SQL + """
SELECT kind, count(*) FILTER (WHERE failed) AS n_failed, count(*) AS n FROM lines GROUP BY kind""")
def _errors(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).groupBy("kind").agg(
        F.count(F.when(F.col("failed"), 1)).alias("n_failed"), F.count(F.lit(1)).alias("n"))


@query("estimate_rounding", """
SELECT l_orderkey, l_linenumber,
       CASE WHEN x = 0 THEN 0 ELSE floor(x * f + 0.5) / f END AS amount
FROM (SELECT l_orderkey, l_linenumber, x, pow(10.0::DOUBLE, 5.0 - floor(log10(x))) AS f
      FROM (SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) / 7 AS x FROM lineitem))""")
def _rounding(spark: SparkSession, d: str) -> DataFrame:
    amount = F.col("l_extendedprice") * (1 - F.col("l_discount")) / 7
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", significant(amount).alias("amount"))


@query("tier_walk", """
WITH tier(lower, upper, amount) AS (VALUES (0.0, 10000.0, 0.5), (10000.0, 1000000.0, 0.25), (1000000.0, NULL, 0.125)),
volume AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity * l_extendedprice) AS BIGINT) AS volume FROM lineitem)
SELECT l_orderkey, l_linenumber, volume,
       sum(greatest(least(volume, coalesce(upper, 1e18)) - lower, 0)::DOUBLE * amount::DOUBLE) AS cost
FROM volume, tier GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY l_orderkey, l_linenumber, volume, rowid")
       .replace("AS volume FROM lineitem", "AS volume, row_number() OVER () AS rowid FROM lineitem"))
def _tier_walk(spark: SparkSession, d: str) -> DataFrame:
    prices = F.array(price("unit", F.lit(0.5), "x", "0", "10K"), price("unit", F.lit(0.25), "x", "10K", "1M"),
                     price("unit", F.lit(0.125), "x", "1M", ""))
    volume = F.floor(F.col("l_quantity") * F.col("l_extendedprice"))
    return (table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", volume.alias("volume"))
            .withColumn("cost", walk_tiers(tier_entries(prices, "unit", "count"), F.col("volume"))))


@query("tier_bounds", """
SELECT p_size AS n, count(*) AS parts, CASE p_size % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 1e4 WHEN 2 THEN 333e6 ELSE 2e10 END
  AS known, CASE WHEN p_size % 4 = 3 THEN 2e10 WHEN p_size % 4 = 2 THEN 333e6 WHEN p_size % 4 = 1 THEN 1e4 ELSE p_size END
  AS bound FROM part GROUP BY p_size""")
def _tier_bounds(spark: SparkSession, d: str) -> DataFrame:
    four = F.pmod("p_size", F.lit(4)).cast("int")
    token = F.get(F.array(*(F.lit(t) for t in ("0", "10K", "333M", "20B"))), four)
    shown = F.when(four == 0, F.col("p_size").cast("string")).otherwise(token)
    return table(spark, d, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("parts")).select(
        F.col("p_size").alias("n"), "parts", count_bound(token).alias("known"),
        tier_bound(shown, "count").alias("bound"))
