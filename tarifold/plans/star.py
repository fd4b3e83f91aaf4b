"""A price catalog derived from the order tables, so that every catalog operator runs over whole tables.

One item per (part, supplier) that was ever sold, priced at the lowest unit price per return flag and line status.
`STAR_SQL` states the same catalog for an independent check.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tarifold.operators.rows import attrs, json_object, normalized_rows, price
from tarifold.functions.terms import literal_terms
from tarifold.operators.compare import COMPARE_KINDS
from tarifold.schemas import ROW

UNITS = {"A-F": "hour", "A-O": "gb-mo", "N-F": "hour", "N-O": "hour", "R-F": "request", "R-O": "gb-mo"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(key: Column, options: list[str]) -> Column:
    """Pick by number from a literal array; out of range is null."""
    return F.get(F.array(*(F.lit(o) for o in options)), key.cast("int"))


def _kind_terms(code: Column, supp: Column) -> Column:
    def is_kind(name: str) -> Column:
        return code == COMPARE_KINDS.index(name)

    two, three = F.pmod(supp, F.lit(2)), F.pmod(supp, F.lit(3))
    tenancy = (F.when(is_kind("compute.vm"), F.when(three == 2, "dedicated").otherwise("shared"))
               .when(is_kind("storage.object"), F.when(three == 2, "shared").otherwise(""))
               .when(is_kind("db.relational"), _case(three, ["postgres", "aurora-postgres", "mysql"]))
               .when(is_kind("cache.kv"), _case(two, ["redis", "memcached"]))
               .when(is_kind("container.orchestration"), "kubernetes")
               .when(is_kind("db.nosql"), _case(two, ["firestore-native", "sql"]))
               .when(is_kind("search.engine"), "shared").when(is_kind("warehouse.query"), "shared")
               .when(is_kind("paas.app"), "dedicated").otherwise(""))
    os = (F.when(is_kind("compute.vm"), _case(two, ["linux", "windows"]))
          .when(is_kind("db.relational"), _case(two, ["single-az", "multi-az"]))
          .when(is_kind("container.orchestration"), _case(two, ["standard", "premium"]))
          .when(is_kind("paas.app"), _case(two, ["linux", "windows"]))
          .when(is_kind("search.engine"), "managed-cluster").when(is_kind("warehouse.query"), "on-demand").otherwise(""))
    support = F.when(is_kind("paas.app"), _case(three, ["basic", "standard", "premium"])).otherwise("")
    commitment = F.when(F.pmod(supp, F.lit(5)) == 4, "reserved").otherwise("on_demand")
    return literal_terms(commitment=commitment, tenancy=tenancy, os=os, support_tier=support)


def _mode(code: Column, supp: Column) -> Column:
    def is_kind(name: str) -> Column:
        return code == COMPARE_KINDS.index(name)

    two = F.pmod(supp, F.lit(2))
    return (F.when(is_kind("container.orchestration"), _case(two, ["control-plane", "fargate"]))
            .when(is_kind("search.engine"), _case(two, ["managed-cluster", "serverless"]))
            .when(is_kind("warehouse.query"), _case(two, ["on-demand", "capacity"]))
            .otherwise(_case(F.pmod(supp, F.lit(3)), ["alpha", "beta", "gamma"])))


def star_prices(lineitem: DataFrame) -> DataFrame:
    """(part, supplier, prices): one hash aggregate with map-side combine, six conditional minima, one shuffle."""
    grouped = lineitem.groupBy("l_partkey", "l_suppkey").agg(*_minima(F.lit(True)))
    return grouped.select("l_partkey", "l_suppkey", _prices().alias("prices"))


def _minima(among: Column, prefix: str = "", per_unit: Column | None = None) -> list[Column]:
    slot = F.concat_ws("-", "l_returnflag", "l_linestatus")
    per_unit = F.col("l_extendedprice") / F.col("l_quantity") if per_unit is None else per_unit
    return [F.min(F.when(among & (slot == s), per_unit)).alias(prefix + s) for s in UNITS]


def _prices(prefix: str = "") -> Column:
    prices = F.filter(F.array(*(price(s, F.col(f"`{prefix}{s}`"), unit) for s, unit in UNITS.items())),
                      lambda p: p["amount"].isNotNull())
    unpriced = F.pmod(F.col("l_partkey"), F.lit(11)) == 0
    return F.when(unpriced, F.slice(prices, 1, 0)).otherwise(prices)


def with_names(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    """Add part, supplier, nation and region columns by part and supplier key."""
    place = (table(spark, sf_dir, "supplier")
             .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
             .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
             .select("s_suppkey", "s_name", "n_name", "r_name"))
    return (lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
            .join(place, F.col("l_suppkey") == F.col("s_suppkey")))


def kind_of(part: Column) -> Column:
    return _case(F.pmod(part, F.lit(14)), list(COMPARE_KINDS))


def star_rows(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """The derived catalog as nested rows. Dimension joins carry no hint: the optimizer checks sizes."""
    return _star_rows(spark, sf_dir, star_prices(table(spark, sf_dir, "lineitem") if lines is None else lines))


def kept_star_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """star_rows() for plans that read it often. Items are persisted as plain columns, which Spark's cache compresses, unlike structs and
    arrays; rows are made of them at each reading."""
    items = with_names(spark, sf_dir, table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(*_minima(F.lit(True))))
    plain = ["l_partkey", "l_suppkey", *UNITS, "p_name", "p_brand", "p_size", "p_retailprice", "s_name", "n_name", "r_name"]
    items = items.select(*(F.col(f"`{c}`") for c in plain), kind_of(F.col("l_partkey")).alias("kind")).persist()
    return _item_rows(items.withColumns({"p_partkey": F.col("l_partkey"), "s_suppkey": F.col("l_suppkey"), "prices": _prices()}))


def star_snapshots(spark: SparkSession, sf_dir: str, *conditions: Column) -> list[DataFrame]:
    """The catalog of the lines that meet each condition, as star_rows() gives it of these lines.

    Lines are aggregated and named once; items cross one exchange by sku_id, which serves all snapshots and what joins them. They cross it as
    plain columns, and rows are made of them behind it."""
    met = [F.coalesce(c, F.lit(False)) for c in conditions]
    lines = table(spark, sf_dir, "lineitem").filter(reduce(Column.__or__, met)).select(
        "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", (F.col("l_extendedprice") / F.col("l_quantity")).alias("per_unit"),
        *(c.alias(f"in_{k}") for k, c in enumerate(met)))
    # few lines share an item, so they cross one exchange as they are, which also serves the join to the parts
    grouped = lines.repartition("l_partkey").groupBy("l_partkey", "l_suppkey").agg(*(m for k in range(len(met)) for m in (
        F.max(f"in_{k}").alias(f"in_{k}"), *_minima(F.col(f"in_{k}"), f"{k}_", F.col("per_unit")))))
    named = with_names(spark, sf_dir, grouped)
    plain = [c for c in (*grouped.columns, "p_name", "p_brand", "p_size", "p_retailprice", "s_name", "n_name", "r_name")]
    # as outputs of a generator all columns stay in the exchange, so that all snapshots and their tables read the same one
    items = named.select(_sku_id().alias("sku_id"), F.array(F.struct(*(F.col(f"`{c}`") for c in plain))).alias("own")).repartition("sku_id").select(
        "sku_id", F.inline("own")).withColumns({"p_partkey": F.col("l_partkey"), "s_suppkey": F.col("l_suppkey"), "kind": kind_of(F.col("l_partkey"))})
    return [_item_rows(items.filter(f"in_{k}").withColumn("prices", _prices(f"{k}_")), sku_id=F.col("sku_id")) for k in range(len(met))]


def lines_and_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Order lines with their kind and the columns of with_names, and the catalog as star_rows() gives it.

    Lines are named once and cross one exchange by kind, part name and supplier name: items are grouped where their lines are, and what
    joins both by these names needs no other exchange."""
    lines = with_names(spark, sf_dir, table(spark, sf_dir, "lineitem")).withColumn("kind", kind_of(F.col("p_partkey")))
    # as outputs of a generator the columns that only one side reads stay in the exchange, so that both sides read the same one
    own = F.struct("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", (F.col("l_extendedprice") / F.col("l_quantity")).alias("per_unit"))
    keys, dimensions = ["kind", "l_partkey", "l_suppkey", "p_name", "p_brand", "s_name", "n_name"], ["r_name", "p_size", "p_retailprice"]
    lines = lines.select(*keys, *dimensions, F.array(own).alias("own")).repartition("kind", "p_name", "s_name").select(
        *keys, *dimensions, F.inline("own"))
    items = lines.groupBy(*keys).agg(*_minima(F.lit(True), per_unit=F.col("per_unit")), *(F.first(c).alias(c) for c in dimensions))
    return lines, _item_rows(items.withColumns({"prices": _prices(), "p_partkey": F.col("l_partkey"), "s_suppkey": F.col("l_suppkey")}))


def _star_rows(spark: SparkSession, sf_dir: str, priced: DataFrame) -> DataFrame:
    return _item_rows(with_names(spark, sf_dir, priced).withColumn("kind", kind_of(F.col("p_partkey"))))


def _sku_id() -> Column:
    return F.concat_ws("::", "p_partkey", "s_suppkey")


def _item_rows(df: DataFrame, sku_id: Column | None = None) -> DataFrame:
    supp, code = F.col("s_suppkey"), F.pmod(F.col("p_partkey"), F.lit(14))
    return normalized_rows(
        df, provider=F.col("s_name"), service=F.col("p_brand"), kind=F.col("kind"),
        sku_id=_sku_id() if sku_id is None else sku_id, resource_name=F.col("p_name"), region=F.col("n_name"),
        region_normalized=F.col("r_name"), terms=_kind_terms(code, supp), prices=F.col("prices"),
        resource_attrs=attrs(
            vcpu=F.when(F.pmod(F.col("p_size"), F.lit(7)) != 0, F.col("p_size")),
            memory_gb=F.col("p_retailprice"),
            storage_gb=F.when(F.pmod(F.col("p_size"), F.lit(3)) != 0, F.col("p_size") * F.lit(100.0)),
            gpu_count=_case(F.pmod(supp, F.lit(4)), ["0", "1", "2"]).cast("bigint"),
            durability_nines=F.pmod(F.col("p_size"), F.lit(12)),
            availability_tier=_case(F.pmod(supp, F.lit(2)), ["standard", "infrequent"]),
            extra=json_object(mode=_mode(code, supp),
                              edition=_case(F.pmod(F.col("p_partkey"), F.lit(3)), ["standard", "enterprise", "plus"]),
                              storage_tier=_case(F.pmod(F.col("p_partkey"), F.lit(2)), ["active", "long-term"])),
        ),
    )


# The same catalog as common table expressions: sku (one row per item) and price (one row per item and dimension).
STAR_SQL = """
line AS (
  SELECT l_partkey, l_suppkey, l_returnflag || '-' || l_linestatus AS dimension,
         min(l_extendedprice / l_quantity) AS amount
  FROM lineitem GROUP BY 1, 2, 3),
price AS (
  SELECT l_partkey || '::' || l_suppkey AS sku_id, dimension, amount,
         CASE dimension WHEN 'A-F' THEN 'hour' WHEN 'A-O' THEN 'gb-mo' WHEN 'N-F' THEN 'hour' WHEN 'N-O' THEN 'hour'
                        WHEN 'R-F' THEN 'request' WHEN 'R-O' THEN 'gb-mo' END AS unit
  FROM line WHERE l_partkey % 11 <> 0),
lowest AS (SELECT sku_id, min(amount) AS min_amount, count(*) AS n_prices FROM price GROUP BY 1),
base AS (
  SELECT p_partkey || '::' || s_suppkey AS sku_id, s_name AS provider, p_brand AS service,
         CASE p_partkey % 14 WHEN 0 THEN 'api.gateway' WHEN 1 THEN 'cache.kv' WHEN 2 THEN 'compute.vm'
           WHEN 3 THEN 'container.orchestration' WHEN 4 THEN 'db.nosql' WHEN 5 THEN 'db.relational'
           WHEN 6 THEN 'dns.zone' WHEN 7 THEN 'messaging.queue' WHEN 8 THEN 'messaging.topic'
           WHEN 9 THEN 'network.cdn' WHEN 10 THEN 'paas.app' WHEN 11 THEN 'search.engine'
           WHEN 12 THEN 'storage.object' ELSE 'warehouse.query' END AS kind,
         p_name AS resource_name, n_name AS region, r_name AS region_normalized, p_partkey, s_suppkey,
         CASE WHEN p_size % 7 <> 0 THEN p_size END AS vcpu, p_retailprice AS memory_gb,
         CASE WHEN p_size % 3 <> 0 THEN p_size * 100.0::DOUBLE END AS storage_gb,
         CASE s_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS gpu_count,
         p_size % 12 AS durability_nines,
         CASE s_suppkey % 2 WHEN 0 THEN 'standard' ELSE 'infrequent' END AS availability_tier,
         CASE p_partkey % 3 WHEN 0 THEN 'standard' WHEN 1 THEN 'enterprise' ELSE 'plus' END AS edition,
         CASE p_partkey % 2 WHEN 0 THEN 'active' ELSE 'long-term' END AS storage_tier
  FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) l
  JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
  JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
termed AS (
  SELECT *,
    CASE WHEN s_suppkey % 5 = 4 THEN 'reserved' ELSE 'on_demand' END AS commitment,
    CASE kind WHEN 'compute.vm' THEN CASE WHEN s_suppkey % 3 = 2 THEN 'dedicated' ELSE 'shared' END
      WHEN 'storage.object' THEN CASE WHEN s_suppkey % 3 = 2 THEN 'shared' ELSE '' END
      WHEN 'db.relational' THEN CASE s_suppkey % 3 WHEN 0 THEN 'postgres' WHEN 1 THEN 'aurora-postgres' ELSE 'mysql' END
      WHEN 'cache.kv' THEN CASE s_suppkey % 2 WHEN 0 THEN 'redis' ELSE 'memcached' END
      WHEN 'container.orchestration' THEN 'kubernetes'
      WHEN 'db.nosql' THEN CASE s_suppkey % 2 WHEN 0 THEN 'firestore-native' ELSE 'sql' END
      WHEN 'search.engine' THEN 'shared' WHEN 'warehouse.query' THEN 'shared' WHEN 'paas.app' THEN 'dedicated'
      ELSE '' END AS tenancy,
    CASE kind WHEN 'compute.vm' THEN CASE s_suppkey % 2 WHEN 0 THEN 'linux' ELSE 'windows' END
      WHEN 'db.relational' THEN CASE s_suppkey % 2 WHEN 0 THEN 'single-az' ELSE 'multi-az' END
      WHEN 'container.orchestration' THEN CASE s_suppkey % 2 WHEN 0 THEN 'standard' ELSE 'premium' END
      WHEN 'paas.app' THEN CASE s_suppkey % 2 WHEN 0 THEN 'linux' ELSE 'windows' END
      WHEN 'search.engine' THEN 'managed-cluster' WHEN 'warehouse.query' THEN 'on-demand' ELSE '' END AS os,
    CASE WHEN kind = 'paas.app' THEN CASE s_suppkey % 3 WHEN 0 THEN 'basic' WHEN 1 THEN 'standard' ELSE 'premium' END
      ELSE '' END AS support_tier,
    CASE kind WHEN 'container.orchestration' THEN CASE s_suppkey % 2 WHEN 0 THEN 'control-plane' ELSE 'fargate' END
      WHEN 'search.engine' THEN CASE s_suppkey % 2 WHEN 0 THEN 'managed-cluster' ELSE 'serverless' END
      WHEN 'warehouse.query' THEN CASE s_suppkey % 2 WHEN 0 THEN 'on-demand' ELSE 'capacity' END
      ELSE CASE s_suppkey % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END END AS mode
  FROM base),
sku AS (
  SELECT t.*, substr(sha256(to_json([commitment, tenancy, os, support_tier, '', ''])), 1, 32) AS terms_hash,
         min_amount, coalesce(min_amount, 0) AS min_price, coalesce(n_prices, 0) AS n_prices
  FROM termed t LEFT JOIN lowest USING (sku_id))
"""
