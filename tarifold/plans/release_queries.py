"""Versioning, guards, audits, profiles, shaping and batch requests over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tarifold import vocab
from tarifold.functions.terms import vocabulary_violations, with_kind_defaults
from tarifold.operators import batch as B, quality as Q, shape as O, versions as V
from tarifold.operators.rows import price, split_star
from tarifold.plans.estimate_queries import card_rows
from tarifold.plans.registry import query
from tarifold.plans.star import STAR_SQL, kept_star_rows, star_rows, star_snapshots, table
from tarifold.schemas import STAR_KEYS

WITH = "WITH " + STAR_SQL

# --- versions --------------------------------------------------------------------------------------------------

_V = """
WITH v1 AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'P'),
v2 AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 1
         ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderstatus <> 'F' OR o_custkey % 3 = 0),
v3 AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_custkey % 2 = 0)
"""


def _versions(spark: SparkSession, d: str) -> list[DataFrame]:
    orders = table(spark, d, "orders")
    keep = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return [
        orders.filter("o_orderstatus <> 'P'").select(*keep),
        orders.filter("o_orderstatus <> 'F' OR o_custkey % 3 = 0").withColumn("o_totalprice", urgent).select(*keep),
        orders.filter("o_custkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2).select(*keep)]


@query("snapshot_diff", _V + """
SELECT CASE WHEN v2.o_orderkey IS NULL THEN 'delete' ELSE 'upsert' END AS op, coalesce(v2.o_orderkey, v1.o_orderkey) AS o_orderkey
FROM v1 FULL JOIN v2 ON v1.o_orderkey = v2.o_orderkey
WHERE v1.o_orderkey IS NULL OR v2.o_orderkey IS NULL OR v1.o_totalprice <> v2.o_totalprice""")
def _snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    v1, v2, _ = _versions(spark, d)
    return V.diff_tables(v1, v2, ["o_orderkey"]).select("op", "o_orderkey")


@query("snapshot_apply", _V + "SELECT * FROM v2")
def _snapshot_apply(spark: SparkSession, d: str) -> DataFrame:
    v1, v2, _ = _versions(spark, d)
    return V.apply_changes(v1, V.diff_tables(v1, v2, ["o_orderkey"]), ["o_orderkey"])


@query("delta_chain", _V + "SELECT * FROM v3")
def _delta_chain(spark: SparkSession, d: str) -> DataFrame:
    v1, v2, v3 = _versions(spark, d)
    keys = ["o_orderkey"]
    chain = [("1", "2", V.diff_tables(v1, v2, keys)), ("2", "3", V.diff_tables(v2, v3, keys))]
    return V.apply_chain(v1, "1", chain, keys)[0]


@query("star_change_groups", """
WITH ol AS (SELECT l_partkey || '::' || l_suppkey AS s, l_returnflag || '-' || l_linestatus AS dim, l_partkey AS pk,
   min(l_extendedprice / l_quantity) AS a FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL),
nl AS (SELECT l_partkey || '::' || l_suppkey AS s, l_returnflag || '-' || l_linestatus AS dim, l_partkey AS pk,
   min(l_extendedprice / l_quantity) AS a FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL),
os AS (SELECT DISTINCT s FROM ol), ns AS (SELECT DISTINCT s FROM nl),
op AS (SELECT * FROM ol WHERE pk % 11 <> 0), np AS (SELECT * FROM nl WHERE pk % 11 <> 0),
gone AS (SELECT s FROM os EXCEPT SELECT s FROM ns),
pd AS (SELECT coalesce(op.s, np.s) AS s, np.s IS NULL AS lost FROM op FULL JOIN np ON op.s = np.s AND op.dim = np.dim
       WHERE op.s IS NULL OR np.s IS NULL OR op.a <> np.a),
live AS (SELECT s FROM (SELECT s FROM ns EXCEPT SELECT s FROM os UNION SELECT s FROM pd) WHERE s NOT IN (SELECT s FROM gone))
SELECT 0 AS change_group, 'skus' AS "table", 'delete' AS op, count(*) AS n FROM gone
UNION ALL SELECT 1, 'prices', 'delete', count(*) FROM pd WHERE lost AND s NOT IN (SELECT s FROM gone)
UNION ALL SELECT 2, t, 'upsert', count(*) FROM live, (VALUES ('skus'), ('terms'), ('resource_attrs')) x(t) GROUP BY t
UNION ALL SELECT 2, 'prices', 'upsert', count(*) FROM np WHERE s IN (SELECT s FROM live)""")
def _star_change_groups(spark: SparkSession, d: str) -> DataFrame:
    changes = V.star_delta(*_two_stars(spark, d))
    return changes.groupBy("change_group", "table", "op").agg(F.count(F.lit(1)).alias("n"))


def _two_stars(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    old, new = star_snapshots(spark, d, F.col("l_linestatus") == "F", F.col("l_returnflag") != "R")
    return old, new


@query("star_delta_apply", "WITH " + STAR_SQL.replace(
    "FROM lineitem", "FROM (SELECT * FROM lineitem WHERE l_returnflag <> 'R') lineitem") + """
SELECT s.sku_id, s.provider, s.kind, s.region, s.tenancy, nullif(s.support_tier, '') AS support_tier, s.memory_gb, s.mode, dimension,
  amount, unit FROM sku s LEFT JOIN price p ON p.sku_id = s.sku_id""")
def _star_delta_apply(spark: SparkSession, d: str) -> DataFrame:
    old, new = _two_stars(spark, d)
    star = V.apply_star_delta(split_star(old), V.star_delta(old, new))
    terms = star["terms"].select("sku_id", "tenancy", "support_tier")
    attrs = star["resource_attrs"].select("sku_id", "memory_gb", F.get_json_object("extra", "$.mode").alias("mode"))
    return (star["skus"].select("sku_id", "provider", "kind", "region").join(terms, "sku_id").join(attrs, "sku_id")
            .join(star["prices"].select("sku_id", "dimension", "amount", "unit"), "sku_id", "left"))


_MANIFEST_SQL = """
WITH manifest AS (
  SELECT s_name AS shard, s_suppkey AS k, lpad((s_suppkey % 50)::VARCHAR, 3, '0') AS baseline_version, '060' AS head_version,
    CASE WHEN s_suppkey % 17 = 0 THEN 2 WHEN s_suppkey % 19 = 0 THEN 0 ELSE 1 END AS v,
    [{'f': '050', 't': '055'}, {'f': '055', 't': '060'}] AS deltas,
    CASE WHEN s_suppkey % 13 <> 0 THEN lpad(((s_suppkey % 14) * 5)::VARCHAR, 3, '0') END AS local_version FROM supplier),
chained AS (SELECT *, list_filter(deltas, lambda x: x.f >= local_version) AS chain FROM manifest),
planned AS (SELECT *, CASE WHEN v > 1 THEN 'schema_too_new' WHEN v < 1 THEN 'schema_too_old'
    WHEN local_version IS NULL OR local_version < baseline_version THEN 'baseline'
    WHEN len(chain) = 0 THEN 'none' WHEN chain[1].f <> local_version THEN 'baseline_after_bad_chain' ELSE 'deltas' END AS action FROM chained)
"""


@query("update_plan", _MANIFEST_SQL + """
SELECT shard, local_version, action, CASE WHEN action LIKE 'baseline%' THEN baseline_version WHEN action = 'deltas' THEN head_version
  ELSE local_version END AS target_version, CASE WHEN action = 'deltas' THEN len(chain) ELSE 0 END AS n_deltas FROM planned""")
def _update_plan(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    step = "array(named_struct('from', '050', 'to', '055'), named_struct('from', '055', 'to', '060'))"
    manifest = s.selectExpr(
        "s_name AS shard", "lpad(CAST(s_suppkey % 50 AS STRING), 3, '0') AS baseline_version", "'060' AS head_version",
        "CASE WHEN s_suppkey % 17 = 0 THEN 2 WHEN s_suppkey % 19 = 0 THEN 0 ELSE 1 END AS shard_schema_version",
        f"{step} AS deltas")
    local = s.filter("s_suppkey % 13 <> 0").selectExpr(
        "s_name AS shard", "lpad(CAST((s_suppkey % 14) * 5 AS STRING), 3, '0') AS local_version")
    return V.update_plan(manifest, local, max_chain=V.MAX_CHAIN)


@query("next_manifest", """
SELECT s_name AS shard, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 4 = 0 THEN 'new' ELSE 'base' END AS baseline_version,
  CASE WHEN s_suppkey % 2 = 0 THEN 'new' ELSE 'old' END AS head_version,
  CASE WHEN s_suppkey % 4 = 0 THEN 0 WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END AS n_deltas,
  CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE 7 END AS row_count FROM supplier""")
def _next_manifest(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    previous = s.selectExpr(
        "s_name AS shard", "'base' AS baseline_version", "CAST(1 AS BIGINT) AS baseline_size", "'old' AS head_version",
        "'1.0' AS min_client", "1 AS shard_schema_version", "array(named_struct('from', 'base', 'to', 'old')) AS deltas",
        "CAST(7 AS BIGINT) AS row_count", "'old' AS last_updated")
    sidecars = s.filter("s_suppkey % 2 = 0").selectExpr(
        "s_name AS shard", "s_suppkey % 4 = 0 AS has_baseline", "'old' AS delta_from", "'new' AS delta_to",
        "s_suppkey AS row_count", "CAST(2 AS BIGINT) AS baseline_size")
    out = V.next_manifest(previous, sidecars, "1.1")
    return out.select("shard", "baseline_version", "head_version", F.size("deltas").alias("n_deltas"), "row_count")


@query("changed_shards", """
WITH ind AS (SELECT o_custkey, max(o_orderkey) AS i FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
prev AS (SELECT o_custkey, max(o_orderkey) AS i FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey AS shard, CASE WHEN ind.i IS NULL THEN 'error' WHEN ind.i IS DISTINCT FROM prev.i THEN 'changed' ELSE 'unchanged' END AS status
FROM customer LEFT JOIN ind ON ind.o_custkey = c_custkey LEFT JOIN prev ON prev.o_custkey = c_custkey""")
def _changed_shards(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "shard")

    def latest(condition: str) -> DataFrame:
        return orders.filter(condition).groupBy("shard").agg(F.max("o_orderkey").alias("indicator"))
    requested = table(spark, d, "customer").select(F.col("c_custkey").alias("shard"))
    return V.changed_shards(requested, latest("o_orderstatus <> 'P'"), latest("o_orderstatus = 'F'")).select("shard", "status")


@query("merge_indicators", """
SELECT user_id AS shard, props AS indicator FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def _merge_indicators(spark: SparkSession, d: str) -> DataFrame:
    return V.merge_indicators(table(spark, d, "events").select(
        F.col("user_id").alias("shard"), F.col("props").alias("indicator"), F.col("ts").alias("written_at"),
        F.col("event_id").alias("source")))


@query("feed_fingerprint", """
WITH item AS (SELECT l_suppkey, l_orderkey::VARCHAR AS a, l_linenumber::VARCHAR AS b, l_returnflag AS c FROM lineitem),
hashed AS (SELECT l_suppkey, md5(length(a) || ':' || a || length(b) || ':' || b || length(c) || ':' || c) AS h FROM item)
SELECT l_suppkey, sha256(count(*) || ':' || sum(('0x' || substr(h, 1, 7))::BIGINT)::BIGINT || ':'
  || sum(('0x' || substr(h, 8, 7))::BIGINT)::BIGINT || ':' || sum(('0x' || substr(h, 15, 7))::BIGINT)::BIGINT || ':'
  || sum(('0x' || substr(h, 22, 7))::BIGINT)::BIGINT) AS fingerprint FROM hashed GROUP BY 1""")
def _fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return V.fingerprint(table(spark, d, "lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_returnflag"])


@query("catalog_status", """
WITH latest AS (SELECT l_suppkey, max(l_shipdate) AS g FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY 1)
SELECT s_suppkey AS shard, g IS NOT NULL AS installed, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE coalesce(greatest(0,
  floor(epoch(TIMESTAMP '2000-06-01 12:00:00' - g) / 86400)), 0)::BIGINT END AS age_days,
  CASE WHEN s_suppkey % 5 <> 0 AND epoch(TIMESTAMP '2000-06-01 12:00:00' - g) >= 86400 * 30 THEN 'error'
       WHEN s_suppkey % 5 <> 0 AND epoch(TIMESTAMP '2000-06-01 12:00:00' - g) >= 86400 * 3 THEN 'warn' ELSE 'ok' END AS freshness
FROM supplier LEFT JOIN latest ON l_suppkey = s_suppkey""")
def _catalog_status(spark: SparkSession, d: str) -> DataFrame:
    at = table(spark, d, "lineitem").filter("l_suppkey % 3 <> 0").groupBy(F.col("l_suppkey").alias("shard")).agg(
        F.max("l_shipdate").alias("g"))
    text = F.when(F.pmod("shard", F.lit(5)) == 0, "not a time").otherwise(F.date_format("g", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    installed = at.select("shard", F.lit("v1").alias("catalog_version"), text.alias("generated_at"))
    now = F.lit("2000-06-01 12:00:00").cast("timestamp")
    out = V.catalog_status(table(spark, d, "supplier").select(F.col("s_suppkey").alias("shard")), installed, now)
    return out.select("shard", "installed", "age_days", V.staleness(F.col("age_days"), 3, 30).alias("freshness"))


@query("serving_providers", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand || '|' || p_type WHEN 1 THEN p_brand || '|' || p_type ELSE '' END AS providers FROM part""")
def _serving_providers(spark: SparkSession, d: str) -> DataFrame:
    three = F.pmod("p_partkey", F.lit(3))
    value = F.when(three == 0, F.to_json(F.array("p_brand", "p_type"))).when(
        three == 1, F.concat(F.lit(" "), "p_brand", F.lit(" , "), "p_type", F.lit(",")))
    return table(spark, d, "part").select(
        "p_partkey", F.array_join(V.serving_providers(value), "|").alias("providers"))


# --- guards and audits -----------------------------------------------------------------------------------------

@query("row_count_drift", """
WITH c AS (SELECT l_suppkey, count(*) AS current_rows FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1),
p AS (SELECT l_suppkey, count(*) AS previous_rows FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT l_suppkey, previous_rows, coalesce(current_rows, 0) AS current_rows,
  100.0::DOUBLE * abs(coalesce(current_rows, 0) - previous_rows) / previous_rows AS drift_percent
FROM p LEFT JOIN c USING (l_suppkey) WHERE 100.0::DOUBLE * abs(coalesce(current_rows, 0) - previous_rows) / previous_rows > 5""")
def _row_count_drift(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    return Q.row_count_drift(lines.filter("l_returnflag <> 'R'"), lines.filter("l_linestatus = 'F'"), ["l_suppkey"])


@query("orphan_prices", """
SELECT l_orderkey AS sku_id, count(*) AS n FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""")
def _orphans(spark: SparkSession, d: str) -> DataFrame:
    prices = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "sku_id")
    skus = table(spark, d, "orders").filter("o_orderstatus = 'F'").withColumnRenamed("o_orderkey", "sku_id")
    return Q.orphan_prices(prices, skus).groupBy("sku_id").agg(F.count(F.lit(1)).alias("n"))


@query("lost_families", """
WITH f AS (SELECT p_brand, regexp_extract(p_type || '-' || p_size, '^([^-.]+)', 1) AS family, p_size FROM part)
SELECT DISTINCT p_brand, family FROM f WHERE (p_brand, family) NOT IN (SELECT p_brand, family FROM f WHERE p_size > 40)""")
def _lost_families(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").withColumn("resource_name", F.concat_ws("-", "p_type", "p_size"))
    return Q.lost_families(part.filter("p_size > 40"), part, by=("p_brand",))


@query("over_budget", """
SELECT source AS shard, sum(n_chars)::BIGINT AS bytes, 100000 AS max_bytes FROM documents WHERE lang <> 'xx' GROUP BY 1
HAVING sum(n_chars) > 100000""")
def _over_budget(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").filter("lang <> 'xx'")
    sizes = documents.groupBy(F.col("source").alias("shard")).agg(F.sum("n_chars").alias("bytes"))
    budgets = vocab.literal_frame(spark, ["shard", "max_bytes"], [(f"src{i}", 100_000) for i in range(200)])
    return Q.over_budget(sizes, budgets)


@query("tier_contiguity", """
SELECT p_partkey::VARCHAR AS sku_id, 'request' AS dimension, '1M' AS tier, '250M' AS tier_upper, '100M' AS expected
FROM part WHERE p_partkey % 5 = 0
UNION ALL SELECT p_partkey::VARCHAR, 'request', '100M', '1B', '' FROM part WHERE p_size % 7 = 0""")
def _tier_contiguity(spark: SparkSession, d: str) -> DataFrame:
    zero = F.lit(0.0)
    broken = F.when(F.pmod("p_partkey", F.lit(5)) == 0, "250M").otherwise("100M")
    closed = F.when(F.pmod("p_size", F.lit(7)) == 0, "1B").otherwise("")
    rows = table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("sku_id"), F.lit("messaging.queue").alias("kind"),
        F.array(price("request", zero, "request", "100M", closed), price("request", zero, "request", "0", "1M"),
                price("request", zero, "request", "1M", broken)).alias("prices"))
    return Q.tier_gaps(rows)


_UPSTREAM = """
WITH up AS (SELECT l_partkey, CASE WHEN l_suppkey % 11 = 0 THEN 0 ELSE 900 + (l_partkey % 3 + CASE WHEN l_partkey % 4 = 0 THEN l_suppkey % 2 ELSE 0 END) * 20 END AS price
  FROM lineitem),
one AS (SELECT l_partkey, CASE WHEN min(price) FILTER (WHERE price > 0) = max(price) FILTER (WHERE price > 0) THEN max(price) END AS u FROM up GROUP BY 1),
res AS (SELECT p_partkey, p_brand, p_retailprice, u, abs(p_retailprice - u) / u * 100 AS delta,
  CASE WHEN u IS NULL THEN 'missing' WHEN abs(p_retailprice - u) / u * 100 >= 1 THEN 'drift' ELSE 'pass' END AS status
  FROM part LEFT JOIN one ON l_partkey = p_partkey)
"""


def _drift(spark: SparkSession, d: str) -> DataFrame:
    varies = F.when(F.pmod("l_partkey", F.lit(4)) == 0, F.pmod("l_suppkey", F.lit(2))).otherwise(0)
    quoted = F.when(F.pmod("l_suppkey", F.lit(11)) == 0, 0).otherwise(900 + (F.pmod("l_partkey", F.lit(3)) + varies) * 20)
    upstream = Q.upstream_price(table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"), quoted.alias("price")), ["p_partkey"])
    sample = table(spark, d, "part").select("p_partkey", "p_brand", F.col("p_retailprice").alias("price_amount"))
    return Q.price_drift(sample, upstream, ["p_partkey"])


@query("price_drift", _UPSTREAM + "SELECT p_partkey, u AS upstream_price, delta AS delta_percent, status FROM res")
def _price_drift(spark: SparkSession, d: str) -> DataFrame:
    return _drift(spark, d).select("p_partkey", "upstream_price", "delta_percent", "status")


@query("drift_report", _UPSTREAM + """
SELECT p_brand, count(*) AS samples, count(*) FILTER (WHERE status = 'drift') AS drifted, count(*) FILTER (WHERE status = 'missing') AS missing,
  CASE WHEN count(*) FILTER (WHERE status = 'drift') > 0 THEN 'fail' ELSE 'pass' END AS result FROM res GROUP BY 1""")
def _drift_report(spark: SparkSession, d: str) -> DataFrame:
    return Q.drift_report(_drift(spark, d), ["p_brand"])


@query("first_positive_price", """
SELECT l_partkey AS p_partkey, arg_min(p, o) AS upstream_price FROM (
  SELECT l_partkey, l_extendedprice - 30000 AS p, l_orderkey * 10 + l_linenumber + l_suppkey / 100000.0 AS o FROM lineitem) WHERE p > 0 GROUP BY 1
UNION ALL SELECT l_partkey, NULL FROM lineitem GROUP BY 1 HAVING max(l_extendedprice) <= 30000""")
def _first_positive(spark: SparkSession, d: str) -> DataFrame:
    up = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"), (F.col("l_extendedprice") - 30000).alias("price"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber") + F.col("l_suppkey") / 100000.0).alias("position"))
    return Q.upstream_price(up, ["p_partkey"], first_positive=True)


@query("free_tier_drift", """
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 0 ELSE 100 END AS delta_percent, CASE WHEN p_size % 3 = 0 THEN 'pass' ELSE 'drift' END AS status
FROM part""")
def _free_tier(spark: SparkSession, d: str) -> DataFrame:
    sample = table(spark, d, "part").select("p_partkey", F.pmod("p_size", F.lit(3)).cast("double").alias("price_amount"))
    return Q.free_tier_drift(sample).select("p_partkey", "delta_percent", "status")


@query("second_source_prices", """
SELECT s_name AS resource_name, 'r' || (s_nationkey % 5) AS region, s_acctbal AS price FROM supplier WHERE s_acctbal > 0""")
def _second_source(spark: SparkSession, d: str) -> DataFrame:
    quote = F.create_map(F.lit("linux"), F.struct(F.col("s_acctbal").cast("string").alias("ondemand")),
                         F.lit("windows"), F.struct(F.lit("9").alias("ondemand")))
    records = table(spark, d, "supplier").select(
        F.col("s_name").alias("instance_type"),
        F.create_map(F.concat(F.lit("r"), F.pmod("s_nationkey", F.lit(5))), quote).alias("pricing"))
    return Q.second_source_prices(records)


@query("upstream_prefix_match", """
SELECT l_partkey || CASE WHEN l_suppkey % 2 = 0 THEN '-' ELSE ':' END || l_suppkey AS our_id, p_partkey::VARCHAR AS upstream_id
FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN part ON p_partkey = l_partkey""")
def _prefix(spark: SparkSession, d: str) -> DataFrame:
    mark = F.when(F.pmod("l_suppkey", F.lit(2)) == 0, "-").otherwise(":")
    ours = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct().select(
        F.concat("l_partkey", mark, "l_suppkey").alias("our_id"))
    upstream = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("upstream_id"))
    return Q.prefix_matches(ours, upstream, "our_id", "upstream_id").select("our_id", "upstream_id")


@query("stratified_sample", WITH + """,
pool AS (SELECT s.sku_id, s.region, s.resource_name, p.dimension, p.amount, split_part(s.resource_name, '.', 1) AS family,
  md5('7|' || s.sku_id || '|' || p.dimension) AS draw FROM sku s JOIN price p ON p.sku_id = s.sku_id),
large AS (SELECT region FROM pool GROUP BY 1 ORDER BY count(*) DESC, region LIMIT 3),
wide AS (SELECT family FROM (SELECT family, row_number() OVER (ORDER BY count(*) DESC, family) AS k, count(*) OVER () AS n
  FROM pool GROUP BY 1) WHERE k <= 3 AND k <= greatest(1, ceil(3.0 / n))),
first AS (SELECT *, 0 AS stratum FROM pool WHERE region IN (FROM large) ORDER BY draw LIMIT 14),
second AS (SELECT *, 1 AS stratum FROM pool WHERE region NOT IN (FROM large) ORDER BY draw LIMIT 2),
two AS (FROM first UNION ALL FROM second),
third AS (SELECT *, 2 AS stratum FROM pool WHERE family IN (FROM wide) AND draw NOT IN (SELECT draw FROM two) ORDER BY draw LIMIT 3),
three AS (FROM two UNION ALL FROM third),
last AS (SELECT *, 3 AS stratum FROM pool WHERE draw NOT IN (SELECT draw FROM three) ORDER BY draw LIMIT 20)
SELECT sku_id, region, resource_name, dimension, amount, stratum FROM (FROM three UNION ALL FROM last) ORDER BY stratum, draw LIMIT 20""")
def _sample(spark: SparkSession, d: str) -> DataFrame:
    prices = star_rows(spark, d).select("sku_id", "region", "resource_name", F.inline("prices"))
    return Q.stratified_sample(prices.select("sku_id", "region", "resource_name", "dimension", "amount"), 20, 7)


@query("kind_defaults", """
SELECT p_partkey::VARCHAR AS sku_id, CASE p_size % 3 WHEN 0 THEN 'compute.vm' WHEN 1 THEN 'paas.app' ELSE 'dns.zone' END AS kind,
  CASE p_size % 3 WHEN 0 THEN 'shared' WHEN 1 THEN 'dedicated' ELSE '' END AS tenancy,
  CASE WHEN p_partkey % 2 = 0 THEN 'windows' WHEN p_size % 3 = 2 THEN '' ELSE 'linux' END AS os FROM part""")
def _kind_defaults(spark: SparkSession, d: str) -> DataFrame:
    three = F.pmod("p_size", F.lit(3))
    kind = F.when(three == 0, "compute.vm").when(three == 1, "paas.app").otherwise("dns.zone")
    none = F.lit(None).cast("string")
    terms = F.struct(none.alias("commitment"), none.alias("tenancy"),
                     F.when(F.pmod("p_partkey", F.lit(2)) == 0, "windows").alias("os"), none.alias("support_tier"),
                     none.alias("upfront"), none.alias("payment_option"))
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("sku_id"), kind.alias("kind"),
                                          terms.alias("terms"), F.lit("").alias("terms_hash"))
    return with_kind_defaults(rows).select("sku_id", "kind", "terms.tenancy", "terms.os")


@query("vocabulary_violations", WITH + """
SELECT sku_id, 'commitment' AS field, commitment AS value FROM sku WHERE commitment = 'reserved'""")
def _violations(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary_violations(star_rows(spark, d))


# --- profiles --------------------------------------------------------------------------------------------------

@query("coverage_profile", """
WITH ids AS (SELECT lang, source, doc_id::VARCHAR AS id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id::VARCHAR) AS r FROM documents)
SELECT lang, source, (SELECT count(*) FROM documents d WHERE d.lang = i.lang AND d.source = i.source) AS sku_count,
  string_agg(id, ',' ORDER BY id) AS sample_ids, CASE WHEN source = 'src0' AND lang = 'en' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS coverage_ratio
FROM ids i WHERE r <= 3 GROUP BY 1, 2""")
def _profile(spark: SparkSession, d: str) -> DataFrame:
    shards = vocab.literal_frame(spark, ["lang", "source", "shard"], [("en", "src0", "english")])
    out = Q.coverage_profile(table(spark, d, "documents"), ["lang", "source"], "doc_id",
                             F.array(F.lit("text"), F.lit("n_chars")), shards)
    return out.select("lang", "source", "sku_count", F.array_join("sample_ids", ",").alias("sample_ids"), "coverage_ratio")


@query("coverage_report", """
SELECT event_type, count(*) AS sku_count, 'k' AS attributes FROM events GROUP BY 1""")
def _report(spark: SparkSession, d: str) -> DataFrame:
    shards = vocab.literal_frame(spark, ["event_type", "shard"], [("click", "clicks")])
    profile = Q.coverage_profile(table(spark, d, "events"), ["event_type"], "event_id", F.json_object_keys("props"), shards)
    return Q.coverage_report(profile, "event_type").select("event_type", "sku_count", "attributes")


# --- output and batch ------------------------------------------------------------------------------------------

@query("envelope", WITH + """
SELECT s.provider, s.sku_id, s.kind, s.resource_name AS name, s.region AS provider_region, nullif(tenancy, '') AS tenancy, nullif(os, '') AS os,
  n_prices, f.dimension AS first_dimension, f.amount AS first_amount
FROM sku s LEFT JOIN (SELECT * FROM price QUALIFY row_number() OVER (PARTITION BY sku_id ORDER BY dimension) = 1) f USING (sku_id)""")
def _envelope(spark: SparkSession, d: str) -> DataFrame:
    e = O.preset(O.envelope(star_rows(spark, d)), "full")
    first = F.get("price", F.lit(0))
    return e.select("provider", "sku_id", "resource.kind", "resource.name", "location.provider_region", "terms.tenancy", "terms.os",
                    F.size("price").alias("n_prices"), first["dimension"].alias("first_dimension"),
                    first["amount"].alias("first_amount"))


@query("preset_compare", WITH + """
SELECT provider, kind, resource_name AS name, region_normalized AS normalized_region,
  CASE WHEN kind IN ('compute.vm', 'db.relational') THEN vcpu END AS vcpu, CASE WHEN kind = 'db.relational' THEN storage_gb END AS storage_gb,
  CASE WHEN kind = 'storage.object' THEN durability_nines END AS durability_nines, CASE WHEN kind = 'db.relational' THEN tenancy END AS tenancy FROM sku""")
def _preset_compare(spark: SparkSession, d: str) -> DataFrame:
    e = O.preset(O.envelope(star_rows(spark, d)), "compare")
    return e.select("provider", "resource.kind", "resource.name", "location.normalized_region", "resource.vcpu", "resource.storage_gb",
                    "resource.durability_nines", "terms.tenancy")


@query("project_fields", WITH + """
SELECT s.sku_id, f.amount AS price_0_amount, s.resource_name AS resource_name
FROM sku s LEFT JOIN (SELECT * FROM price QUALIFY row_number() OVER (PARTITION BY sku_id ORDER BY dimension) = 1) f USING (sku_id)""")
def _fields(spark: SparkSession, d: str) -> DataFrame:
    return O.project_fields(O.envelope(star_rows(spark, d)), "sku_id, price.0.amount, resource.name, resource.nothing")


@query("json_lines")
def _json_lines(spark: SparkSession, d: str) -> DataFrame:
    # Number formatting differs between engines; a test checks the text.
    return O.to_json_lines(O.preset(O.envelope(star_rows(spark, d)), "agent"))


@query("term_slots", WITH + """
SELECT sku_id, kind, CASE WHEN kind IN ('db.relational', 'cache.kv') THEN 'engine' ELSE 'product_family' END AS meaning, tenancy AS value FROM sku
WHERE kind IN ('db.relational', 'cache.kv', 'container.orchestration') AND tenancy <> ''
UNION ALL SELECT sku_id, kind, CASE WHEN kind = 'db.relational' THEN 'deployment_option' ELSE 'tier_or_mode' END, os FROM sku
WHERE kind IN ('db.relational', 'cache.kv', 'container.orchestration') AND os <> ''""")
def _term_slots(spark: SparkSession, d: str) -> DataFrame:
    return O.label_term_slots(star_rows(spark, d))


def _batch_lines(spark: SparkSession, d: str) -> DataFrame:
    """Request lines: lookups, estimates, a comment, an unknown field and an unknown command."""
    line = table(spark, d, "lineitem").selectExpr(
        "xxhash64(l_orderkey, l_linenumber, l_partkey, l_suppkey) AS request_id", "l_linenumber AS ln",
        "concat('r', floor(l_partkey / 26)) AS region", "l_partkey % 2 AS v")
    text = F.expr("""CASE ln
      WHEN 1 THEN '# comment' WHEN 2 THEN '{"command": "estimate", "nope": 1}' WHEN 3 THEN '{"command": "fly"}' WHEN 4 THEN ''
      WHEN 5 THEN concat('{"command": "aws ec2 price", "args": {"instance_type": "vm-', v, '", "region": "', region, '"}}')
      ELSE concat('{"command": "estimate", "args": {"item": "aws/ec2:vm-', v, ':region=', region, '"}}') END""")
    return line.select("request_id", text.alias("value"))


@query("batch_parse", """
SELECT CASE l_linenumber WHEN 2 THEN 'unknown field nope' WHEN 3 THEN 'unknown command' END AS error, count(*) AS n
FROM lineitem WHERE l_linenumber NOT IN (1, 4) GROUP BY 1""")
def _batch_parse(spark: SparkSession, d: str) -> DataFrame:
    return B.parse_requests(_batch_lines(spark, d)).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def _request_lines(spark: SparkSession, d: str) -> DataFrame:
    """One request per order, dealt to the six commands and to requests that cannot run. A file of many orders is one row group, so
    orders are dealt to tasks while they are narrow."""
    text = F.expr("""CASE o % 9
      WHEN 0 THEN concat('{"command": "aws ec2 price", "args": {"instance_type": "vm-', o % 2, '", "region": "r', g, '"}}')
      WHEN 1 THEN concat('{"command": "aws ec2 list", "args": {"instance_type": "vm-', o % 2, '", "os": "linux"}}')
      WHEN 2 THEN concat('{"command": "llm price", "args": {"model": "model-', g, '"}, "include_aggregated": ', IF(o % 2 = 0, 'true', 'false'), '}')
      WHEN 3 THEN concat('{"command": "llm compare", "args": {"model": "model-', g, '"}, "include_aggregated": ', IF(o % 2 = 0, 'true', 'false'), '}')
      WHEN 4 THEN concat('{"command": "compare", "args": {"kind": "compute.vm", "vcpu": ', 4 * (o % 5), ', "memory": "', 900 + 20 * (o % 7),
                         '", "sort": "', element_at(array('price', 'vcpu', 'memory'), CAST(o % 3 AS int) + 1), '", "limit": ', o % 4, IF(o % 2 = 0, ', "max_price": 1500', ''),
                         IF(o % 11 < 5, ', "regions": "ASIA, NATION_3"', ''), '}}')
      WHEN 5 THEN concat('{"command": "compare", "args": {"kind": "db.relational", "storage_gb": ', 500 * (o % 6), ', "limit": 5}}')
      WHEN 6 THEN concat('{"command": "compare", "args": {"kind": "', element_at(array('dns.zone', 'cache.kv', 'nothing'), CAST(o % 3 AS int) + 1), '", "memory": ',
                         IF(o % 2 = 0, '1000', '0'), ', "regions": ["', IF(o % 5 = 0, 'nowhere', 'NATION_4'), '"]}}')
      WHEN 7 THEN concat('{"command": "estimate", "args": {"items": ["aws/s3:standard0:region=r', g, ':gb_month=10", "aws/ec2:vm-', o % 2, ':region=r', g, ':count=2"]}}')
      ELSE IF(o % 2 = 0, '{"command": "llm price", "args": {}}', '{"command": "fly"}') END""")
    orders = table(spark, d, "orders").selectExpr("o_orderkey AS o", "o_custkey % 90 AS g").repartition("o")
    return orders.select(F.col("o").alias("request_id"), text.alias("value"))


_BATCH_SQL = WITH + """,
card AS (SELECT p_partkey, p_partkey % 13 AS k, p_partkey // 26 AS g, (p_partkey // 13) % 2 AS v, p_retailprice AS base, p_size FROM part),
ask AS (SELECT o_orderkey AS o, o_custkey % 90 AS g, o_orderkey % 9 AS c FROM orders),
vm AS (SELECT 'card-' || p_partkey AS sku_id, 'vm-' || CASE WHEN g % 7 = 0 THEN 0 ELSE v END AS name, 'r' || g AS region,
         CASE WHEN p_size % 10 <> 0 THEN base / 1000 END AS price FROM card WHERE k = 0),
llm AS (SELECT 'card-' || p_partkey AS sku_id, 'prov' || v AS provider, g, base / 1e6 AS price FROM card WHERE k = 2
        UNION ALL SELECT 'sum-' || p_partkey, 'openrouter', g, base / 1e6 FROM card WHERE k = 2 AND v = 0),
machine AS (
  SELECT o, sku_id, price, row_number() OVER (PARTITION BY o ORDER BY region, sku_id) AS position
  FROM ask JOIN vm ON name = 'vm-' || (o % 2) AND (c = 1 OR region = 'r' || g) WHERE c IN (0, 1)),
model AS (
  SELECT o, sku_id, price, row_number() OVER (PARTITION BY o ORDER BY CASE WHEN c = 3 THEN price END, provider, sku_id) AS position
  FROM ask JOIN llm USING (g) WHERE c IN (2, 3) AND (o % 2 = 0 OR provider <> 'openrouter')),
offer AS (
  SELECT s.*, r_name FROM sku s JOIN nation ON n_name = region JOIN region ON r_regionkey = n_regionkey WHERE commitment = 'on_demand'),
compared AS (
  SELECT o, sku_id, min_price AS price, provider, resource_name, CASE o % 4 WHEN 0 THEN 20 ELSE o % 4 END AS most,
    CASE o % 3 WHEN 0 THEN min_price WHEN 1 THEN coalesce(vcpu, 0) ELSE memory_gb END AS first
  FROM ask JOIN offer ON kind = 'compute.vm' AND tenancy = 'shared' AND os = 'linux' AND coalesce(gpu_count, 0) = 0
    AND (o % 5 = 0 OR vcpu >= 4 * (o % 5)) AND memory_gb >= 900 + 20 * (o % 7) AND (o % 2 = 1 OR min_amount <= 1500)
    AND (o % 11 >= 5 OR r_name = 'ASIA' OR region = 'NATION_3')
  WHERE c = 4
  UNION ALL
  SELECT o, sku_id, min_price, provider, resource_name, 5, min_price FROM ask JOIN offer ON kind = 'db.relational' AND os = 'single-az'
    AND tenancy IN ('postgres', 'aurora-postgres') AND (o % 6 = 0 OR storage_gb >= 500 * (o % 6)) WHERE c = 5
  UNION ALL
  SELECT o, sku_id, min_price, provider, resource_name, 20, min_price FROM ask JOIN offer ON kind = 'cache.kv' AND region = 'NATION_4'
    AND (o % 2 = 1 OR memory_gb BETWEEN 900 AND 1500) WHERE c = 6 AND o % 3 = 1 AND o % 5 <> 0
  UNION ALL
  SELECT o, sku_id, min_price, provider, resource_name, 20, min_price FROM ask JOIN offer ON kind = 'dns.zone' AND region = 'NATION_4'
    WHERE c = 6 AND o % 3 = 0 AND o % 5 <> 0 AND o % 2 = 1),
best AS (SELECT o, sku_id, price, row_number() OVER (PARTITION BY o ORDER BY first, provider, resource_name, sku_id) AS position, most FROM compared),
item AS (
  SELECT o, a.sku_id AS s3, 10 * (a.base / 10000) AS s3_price, n, m.sku_id AS vm, m.price AS vm_price
  FROM ask LEFT JOIN (SELECT g, base, 'card-' || p_partkey AS sku_id FROM card WHERE k = 1 AND v = 0) a USING (g)
  LEFT JOIN (SELECT name, region, count(*) AS n, min(sku_id) AS sku_id, min(price) AS price FROM vm GROUP BY name, region) m
    ON m.name = 'vm-' || (o % 2) AND m.region = 'r' || g WHERE c = 7),
verdict AS (
  SELECT *, CASE WHEN s3 IS NULL OR vm IS NULL THEN 'no matching catalog row' WHEN n > 1 THEN 'ambiguous: more than one catalog row'
    WHEN vm_price IS NULL THEN 'no matching price' END AS bad FROM item),
answer AS (
  SELECT o, position, sku_id, price, 0 AS exit_code, NULL AS error FROM machine
  UNION ALL SELECT o, position, sku_id, price, 0, NULL FROM model
  UNION ALL SELECT o, position, sku_id, price, 0, NULL FROM best WHERE position <= most
  UNION ALL SELECT o, 1, s3, s3_price, 0, NULL FROM verdict WHERE bad IS NULL
  UNION ALL SELECT o, 2, vm, vm_price * (730.0::DOUBLE * 2), 0, NULL FROM verdict WHERE bad IS NULL
  UNION ALL SELECT o, NULL, NULL, NULL, 1, bad FROM verdict WHERE bad IS NOT NULL
  UNION ALL SELECT o, NULL, NULL, NULL, 4, CASE WHEN c = 8 THEN CASE WHEN o % 2 = 0 THEN 'missing model' ELSE 'unknown command' END
    WHEN o % 3 = 2 THEN 'unsupported kind' WHEN o % 3 = 0 AND o % 2 = 0 THEN 'dns.zone does not take memory_gb' ELSE 'unknown region' END
    FROM ask WHERE c = 8 OR (c = 6 AND (o % 3 = 2 OR (o % 3 = 0 AND o % 2 = 0) OR o % 5 = 0)))
SELECT o AS request_id, position, sku_id, price, exit_code, error FROM answer
UNION ALL SELECT o, NULL, NULL, NULL, 3, 'not_found' FROM ask WHERE o NOT IN (SELECT o FROM answer)"""


@query("batch_run", _BATCH_SQL)
def _batch_run(spark: SparkSession, d: str) -> DataFrame:
    card = card_rows(spark, d).persist()  # by itself: Spark merges unions, and a persisted one would be lost in the next
    sums = card.filter("kind = 'llm.text' AND provider = 'prov0'").withColumns({
        "sku_id": F.regexp_replace("sku_id", "card-", "sum-"), "provider": F.lit("openrouter"), "is_aggregated": F.lit(True)})
    place = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    places = place.select(F.col("n_name").alias("name"), F.array("n_name").alias("literals")).unionByName(
        place.groupBy(F.col("r_name").alias("name")).agg(F.collect_list("n_name").alias("literals")))
    rows = card.unionByName(sums).unionByName(kept_star_rows(spark, d))
    records = B.run_batch(B.parse_requests(_request_lines(spark, d)), rows, places)
    # a request without an answer shows its filters; the code is what both sides state
    error = F.when(F.col("exit_code") == 3, F.get_json_object("error", "$.code")).otherwise(F.col("error"))
    return records.select("request_id", F.col("position").cast("bigint").alias("position"), "sku_id", "price", "exit_code", error.alias("error"))
