"""Feed jobs over upstream documents derived from `lineitem`: every order line becomes one entry of the feed.

`Frame` states the derived columns once; it yields both the Spark frame and the SQL of the same frame, so the job
and its check read identical input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tarifold import vocab
from tarifold.feeds import aws, azure, gcp, llm
from tarifold.functions.cases import text_literal
from tarifold.plans.registry import register
from tarifold.plans.star import table

_REGIONS = {p: [r for q, r, _ in vocab.region_rows() if q == p] for p in ("aws", "azure", "gcp")}
REGION_SQL = "region_map(provider, region, region_normalized) AS (VALUES " + ", ".join(
    f"('{p}', '{r}', '{g}')" for p, r, g in vocab.region_rows()) + ")"


class Frame:
    """Derived columns: name -> (choices, key expression) picks by key modulo length; text is a plain expression.
    A third part is a condition, else null, and a fourth and fifth are the choices and key where it does not hold.

    Expressions must mean the same in both dialects and read pk, sk, ln, qty, usd, flag, status.
    """

    BASE = ("concat(l_partkey, '/', l_suppkey) AS file", "l_orderkey * 8 + l_linenumber AS pos", "l_partkey AS pk",
            "l_suppkey AS sk", "l_linenumber AS ln", "l_quantity AS qty", "l_extendedprice / 1000 AS usd",
            "l_returnflag AS flag", "l_linestatus AS status")

    def __init__(self, **columns) -> None:
        self.columns = columns

    @staticmethod
    def _pick(options: list, key: str, sql: bool) -> str:
        listed, n = ", ".join(text_literal(o) for o in options), len(options)
        return (f"([{listed}])[1 + CAST(({key}) % {n} AS INT)]" if sql
                else f"get(array({listed}), CAST(({key}) % {n} AS INT))")

    def _texts(self, sql: bool) -> list[str]:
        out = []
        for name, spec in self.columns.items():
            if isinstance(spec, str):
                out.append(f"{spec} AS {name}")
                continue
            options, key, condition, *other = spec if len(spec) > 2 else (*spec, None)
            text = self._pick(options, key, sql)
            if condition is not None:
                text = f"CASE WHEN {condition} THEN {text}" + (
                    f" ELSE {self._pick(*other, sql)}" if other else "") + " END"
            out.append(f"{text} AS {name}")
        return out

    def spark(self, spark: SparkSession, d: str) -> DataFrame:
        return (table(spark, d, "lineitem").select(
            "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag",
            "l_linestatus")).selectExpr(*self.BASE).selectExpr("*", *self._texts(False))

    def sql(self) -> str:
        return (f"base AS (SELECT {', '.join(self.BASE)} FROM lineitem), feed AS (SELECT *, "
                + ", ".join(self._texts(True)) + " FROM base)")


_OUT = "sku_id, resource_name, region, region_normalized, tenancy, os, dimension, tier, tier_upper, amount, unit"


def _flat(rows: DataFrame) -> DataFrame:
    """One output row per price."""
    return rows.select("sku_id", "resource_name", "region", "region_normalized", "terms.tenancy", "terms.os",
                       F.inline("prices")).selectExpr(*_OUT.split(", "))


def _offer(frame: Frame, attributes: list[str], family: str = "family") -> Callable[[SparkSession, str], DataFrame]:
    """Flat offer frame from a derived frame: attributes gathered into the map the jobs read."""
    def build(spark: SparkSession, d: str) -> DataFrame:
        df = frame.spark(spark, d)
        names = set(df.columns)
        pairs = [x for a in attributes for x in (F.lit(a), F.col(a))]

        def optional(name: str, default: Column) -> Column:
            return F.col(name) if name in names else default
        text = F.lit(None).cast("string")
        return df.select(
            "file", "pos", optional("sku_id", F.concat_ws("-", F.lit("P"), "file", "pos")).alias("sku_id"),
            F.col(family).alias("family"), F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("attributes"),
            optional("dim_pos", F.lit(0)).cast("int").alias("dim_pos"), optional("unit", F.lit("Hrs")).alias("unit"),
            optional("description", text).alias("description"), optional("begin_range", text).alias("begin_range"),
            optional("end_range", text).alias("end_range"), F.col("usd").cast("double").alias("usd"))
    return build


def _retail(frame: Frame) -> Callable[[SparkSession, str], DataFrame]:
    def build(spark: SparkSession, d: str) -> DataFrame:
        df = frame.spark(spark, d)
        names = set(df.columns)

        def column(name: str, default) -> Column:
            return (F.col(name) if name in names else F.lit(default)).alias(name)
        return df.select(
            "file", "pos", column("currencyCode", "USD"), column("type", "Consumption"),
            column("tierMinimumUnits", None), F.col("usd").alias("retailPrice"), column("armRegionName", None),
            column("meterId", None), column("meterName", None), column("skuId", None), column("productName", None),
            column("skuName", None), column("armSkuName", None), column("serviceName", None),
            column("unitOfMeasure", "1 Hour")).withColumn("tierMinimumUnits", F.col("tierMinimumUnits").cast("double"))
    return build


def _billing(frame: Frame, n_rates: int = 1) -> Callable[[SparkSession, str], DataFrame]:
    """Flat billing frame; rate i of n costs (i + 1) times the base price and starts at i."""
    def build(spark: SparkSession, d: str) -> DataFrame:
        df = frame.spark(spark, d)
        names = set(df.columns)

        def column(name: str, default) -> Column:
            return (F.col(name) if name in names else F.lit(default).cast("string")).alias(name)
        nanos = F.round(F.col("usd") * 1_000_000).cast("bigint")
        count = F.col("n_rates").cast("int") if "n_rates" in names else F.lit(n_rates)
        rates = F.transform(F.sequence(F.lit(1), count), lambda i: F.struct(
            (i - 1).cast("double").alias("startUsageAmount"), F.struct(
                F.coalesce(F.col("currency") if "currency" in names else F.lit(None), F.lit("USD")).alias("currencyCode"),
                F.lit("0").alias("units"), (nanos * i).alias("nanos")).alias("unitPrice")))
        return df.select(
            "file", "pos", F.concat_ws("-", F.lit("G"), "file", "pos").alias("sku_id"), column("description", None),
            column("resourceFamily", None), column("resourceGroup", None), column("usageType", "OnDemand"),
            column("serviceDisplayName", None), F.array("region").alias("serviceRegions"), column("usage_unit", "h"),
            rates.alias("rates"))
    return build


_USD = "(CAST(round(usd * 1000000) AS BIGINT) / 1000000000.0::DOUBLE)"


def _job(name: str, source, job, sql: str | None, frame: Frame | None = None) -> None:
    text = None if sql is None else f"WITH {REGION_SQL}, {frame.sql()} {sql}"
    register("feed_" + name, lambda spark, d: _flat(job(source(spark, d))), text)


def _join(provider: str, region: str = "f.region") -> str:
    return f"JOIN region_map r ON r.provider = '{provider}' AND r.region = {region}"


def _select(sku: str, name: str, tenancy: str, os: str, dimension: str, amount: str, unit: str, tail: str,
            region: str = "r.region", group: str = "region_normalized", tier: str = "''", upper: str = "''") -> str:
    return (f"SELECT {sku} AS sku_id, {name} AS resource_name, {region} AS region, {group} AS region_normalized, "
            f"{tenancy} AS tenancy, {os} AS os, {dimension} AS dimension, {tier} AS tier, {upper} AS tier_upper, "
            f"{amount} AS amount, {unit} AS unit {tail}")


_AWS_REGION = {"regionCode": (_REGIONS["aws"] + ["xx-nowhere-1"], "sk")}
_SKU = "concat('P-', file, '-', pos)"
_GSKU = "concat('G-', file, '-', pos)"


def _aws_flat() -> None:
    f = Frame(family=(["Compute Instance", "Storage"], "qty"), operatingSystem=(["Linux", "Windows", "RHEL", "SUSE"], "ln"),
              tenancy=(["Shared", "Dedicated", "Host"], "sk + ln"), preInstalledSw=(["SQL", "NA", "NA", "NA"], "pk"),
              capacitystatus=(["Used", "Used", "UnusedCapacityReservation"], "pk + ln"),
              instanceType=(["m5.large", "c5.xlarge", "r6g.large"], "pk"), vcpu="CAST(ln AS STRING)",
              memory="concat(ln * 4, ' GiB')", physicalProcessor="'cpu'", networkPerformance="'high'", **_AWS_REGION)
    _job("aws_ec2", _offer(f, ["operatingSystem", "tenancy", "preInstalledSw", "capacitystatus", "instanceType", "vcpu",
                               "memory", "physicalProcessor", "networkPerformance", "regionCode"]), aws.ec2,
         _select(_SKU, "instanceType", "lower(tenancy)", "lower(operatingSystem)", "'compute'", "usd", "'hrs'",
                 f"FROM feed f {_join('aws', 'regionCode')} WHERE family = 'Compute Instance' AND preInstalledSw = 'NA' "
                 "AND capacitystatus = 'Used' AND operatingSystem <> 'SUSE' AND tenancy <> 'Host'"), f)
    f = Frame(family=(["Storage", "Compute Instance", "Storage"], "pk"), unit="'GB-Mo'",
              volumeApiName=(["gp2", "gp3", "io1", "io2", "st1", "sc1", "standard"], "ln + sk"), **_AWS_REGION)
    _job("aws_ebs", _offer(f, ["volumeApiName", "regionCode"]), aws.ebs,
         _select(_SKU, "volumeApiName", "''", "''", "'storage'", "usd", "'gb-mo'",
                 f"FROM feed f {_join('aws', 'regionCode')} WHERE family = 'Storage' "
                 "AND volumeApiName IN ('gp3', 'gp2', 'io2', 'st1', 'sc1')"), f)
    f = Frame(family=(["Database Instance", "Database Storage"], "pk"), deploymentOption=(
        list(aws.RDS_DEPLOYMENTS) + ["Other"], "ln"), databaseEngine=(list(aws.RDS_ENGINES) + ["Db2"], "sk"),
              instanceType=(["db.m5.large", "db.r5.large"], "pk"), licenseModel="'none'", vcpu="'2'", memory="'8 GiB'",
              **_AWS_REGION)
    engine = "CASE databaseEngine WHEN 'PostgreSQL' THEN 'postgres' WHEN 'SQL Server' THEN 'sqlserver' ELSE lower(databaseEngine) END"
    deployment = ("CASE deploymentOption WHEN 'Single-AZ' THEN 'single-az' WHEN 'Multi-AZ' THEN 'multi-az' "
                  "ELSE 'multi-az-cluster' END")
    _job("aws_rds", _offer(f, ["deploymentOption", "databaseEngine", "instanceType", "licenseModel", "vcpu", "memory",
                               "regionCode"]), aws.rds,
         _select(_SKU, "instanceType", engine, deployment, "'compute'", "usd", "'hrs'",
                 f"FROM feed f {_join('aws', 'regionCode')} WHERE family = 'Database Instance' AND databaseEngine <> 'Db2' "
                 "AND deploymentOption <> 'Other'"), f)
    f = Frame(family=(["Cache Instance", "Other"], "ln"), cacheEngine=(["Redis", "Memcached", "Valkey"], "pk"),
              instanceType=(["cache.m5.large", "", "cache.r5.large"], "sk"), vcpu="'2'", memory="'6.38 GiB'", **_AWS_REGION)
    _job("aws_elasticache", _offer(f, ["cacheEngine", "instanceType", "vcpu", "memory", "regionCode"]), aws.elasticache,
         _select(_SKU, "instanceType", "lower(cacheEngine)", "''", "'compute'", "usd", "'hrs'",
                 f"FROM feed f {_join('aws', 'regionCode')} WHERE family = 'Cache Instance' AND instanceType <> '' "
                 "AND cacheEngine <> 'Valkey'"), f)
    f = Frame(family=(["Database Instance", "ServerlessV2", "Database Storage", "System Operation"], "ln"),
              databaseEngine=(["Aurora MySQL", "Aurora PostgreSQL", "MySQL"], "pk"), storageMedia="'Aurora:Storage'",
              group="'Aurora-IO-Operation'", usagetype=(["Aurora:StorageUsage", "Aurora:I/O-OptimizedUsage"], "sk"),
              instanceType="'db.r6g.large'", vcpu="'2'", memory="'16 GiB'", unit=(["Hrs", "ACU-Hr"], "ln"), **_AWS_REGION)
    _job("aws_aurora", _offer(f, ["databaseEngine", "storageMedia", "group", "usagetype", "instanceType", "vcpu", "memory",
                                  "regionCode"]), aws.aurora,
         _select(_SKU, "CASE family WHEN 'ServerlessV2' THEN 'aurora-serverless-v2' ELSE instanceType END",
                 "CASE databaseEngine WHEN 'Aurora MySQL' THEN 'aurora-mysql' ELSE 'aurora-postgres' END", "'single-az'",
                 "'compute'", "usd", "lower(unit)", f"FROM feed f {_join('aws', 'regionCode')} "
                 "WHERE family IN ('Database Instance', 'ServerlessV2') AND databaseEngine <> 'MySQL'"), f)


def _pivot_sql(keys: str, dims: dict[str, str], where: str, provider: str, region: str, sku: str = _SKU,
               amount: str = "usd") -> str:
    """Last entry per (key, region, dimension), for keys that have every dimension."""
    need = " AND ".join(f"count(*) FILTER (WHERE dimension = '{d}') > 0" for d in dims)
    return f""", hit AS (SELECT *, {keys} AS klass FROM feed {where}),
 last AS (SELECT h.*, r.region AS rg, r.region_normalized, {sku} AS up, {amount} AS amt
   FROM hit h JOIN region_map r ON r.provider = '{provider}' AND r.region = {region}
   WHERE dimension IS NOT NULL AND klass IS NOT NULL
   QUALIFY row_number() OVER (PARTITION BY klass, r.region, dimension ORDER BY file DESC, pos DESC) = 1),
 whole AS (SELECT klass, rg, string_agg(up, '::' ORDER BY up) AS sku_id FROM last GROUP BY 1, 2 HAVING {need})"""


def _aws_pivots() -> None:
    group = (list(aws.S3_GROUPS) + ["S3-API-Other"], "pk + ln")
    volumes = list(aws.S3_CLASSES)
    # Requests carry no volume type in half of the entries.
    f = Frame(family=(["Storage", "API Request", None], "pk"), group=group,
              volumeType=(volumes, "sk + ln", "pk % 3 = 0 OR ln % 2 = 0"),
              unit=(["GB-Mo", "Requests", "Requests"], "pk"), begin_range=(["0", "0", "51200"], "ln + pk"), **_AWS_REGION)
    classes = ", ".join(f"('{k}', '{v}')" for k, v in aws.S3_CLASSES.items())
    groups = ", ".join(f"('{g}', '{c}', '{dim}')" for g, (cs, dim) in aws.S3_GROUPS.items() for c in cs)
    plain = "CASE \"group\" WHEN 'S3-API-Tier1' THEN 'requests-put' WHEN 'S3-API-Tier2' THEN 'requests-get' END"
    s3 = f""", cls(vt, klass) AS (VALUES {classes}), grp(g, klass, dimension) AS (VALUES {groups}),
 hit AS (
  SELECT feed.*, klass, 'storage' AS dimension FROM feed JOIN cls ON vt = volumeType WHERE family = 'Storage' AND begin_range = '0'
  UNION ALL SELECT feed.*, klass, {plain} FROM feed JOIN cls ON vt = volumeType WHERE coalesce(family, '') <> 'Storage'
  UNION ALL SELECT feed.*, klass, dimension FROM feed JOIN grp ON g = "group" WHERE coalesce(family, '') <> 'Storage' AND volumeType IS NULL),
 last AS (SELECT h.*, r.region AS rg, r.region_normalized, {_SKU} AS up FROM hit h {_join('aws', 'regionCode').replace('f.', 'h.')}
  WHERE dimension IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY klass, r.region, dimension ORDER BY file DESC, pos DESC) = 1),
 whole AS (SELECT klass, rg, string_agg(up, '::' ORDER BY up) AS sku_id FROM last GROUP BY 1, 2 HAVING count(*) = 3) """
    _job("aws_s3", _offer(f, ["group", "volumeType", "regionCode"]), aws.s3, s3 + _select(
        "w.sku_id", "l.klass", "''", "''", "dimension", "usd", "lower(unit)",
        "FROM last l JOIN whole w ON w.klass = l.klass AND w.rg = l.rg", region="l.rg"), f)
    f = Frame(family=(["Database Storage", "Amazon DynamoDB PayPerRequest Throughput"], "pk"), begin_range="'0'",
              storageClass=(["Standard", "Standard - Infrequent Access"], "sk"), unit="'Units'",
              group=(["DDB-ReadUnits", "DDB-WriteUnits", "DDB-ReadUnitsIA", "DDB-WriteUnitsIA", "DDB-Other"], "ln"),
              operation="'PayPerRequestThroughput'", **_AWS_REGION)
    klass = ("CASE WHEN family = 'Amazon DynamoDB PayPerRequest Throughput' AND right(\"group\", 2) = 'IA' THEN 'standard-ia' "
             "WHEN storageClass = 'Standard' THEN 'standard' ELSE 'standard-ia' END")
    dimension = ("CASE WHEN family = 'Database Storage' THEN 'storage' WHEN \"group\" LIKE 'DDB-Read%' THEN "
                 "'read_request_units' WHEN \"group\" LIKE 'DDB-Write%' THEN 'write_request_units' END")
    dims = {"storage": "", "read_request_units": "", "write_request_units": ""}
    sql = _pivot_sql(klass, dims, "", "aws", "regionCode").replace("SELECT *, ", f"SELECT *, {dimension} AS dimension, ", 1)
    out = _select("w.sku_id", "l.klass", "''", "''", "dimension", "amt", "'units'",
                  "FROM last l JOIN whole w ON w.klass = l.klass AND w.rg = l.rg", region="l.rg")
    _job("aws_dynamodb", _offer(f, ["storageClass", "group", "operation", "regionCode"]), aws.dynamodb, sql + out, f)
    f = Frame(family=(["Serverless", "Other"], "pk"), archSupport=(["x86", "arm", None], "sk"), unit="'Req'",
              group=(list(aws.LAMBDA_GROUPS) + ["AWS-Lambda-Edge"], "ln"), **_AWS_REGION)
    arch = ("CASE archSupport WHEN 'x86' THEN 'x86_64' WHEN 'arm' THEN 'arm64' ELSE CASE WHEN \"group\" LIKE '%-ARM' "
            "THEN 'arm64' ELSE 'x86_64' END END")
    dimension = ("CASE WHEN \"group\" LIKE 'AWS-Lambda-Requests%' THEN 'requests' WHEN \"group\" LIKE 'AWS-Lambda-Duration%' "
                 "THEN 'duration' END")
    sql = _pivot_sql(arch, {"requests": "", "duration": ""}, "WHERE family = 'Serverless'", "aws", "regionCode").replace(
        "SELECT *, ", f"SELECT *, {dimension} AS dimension, ", 1)
    out = _select("w.sku_id", "l.klass", "''", "''", "dimension", "amt", "'req'",
                  "FROM last l JOIN whole w ON w.klass = l.klass AND w.rg = l.rg", region="l.rg")
    _job("aws_lambda", _offer(f, ["archSupport", "group", "regionCode"]), aws.aws_lambda, sql + out, f)
    f = Frame(family=(["Data Transfer", "Request"], "pk"), transferType=(["CloudFront Outbound", "Inter"], "ln"), unit="'GB'",
              fromLocation=(list(vocab.EDGE_REGIONS) + ["Any"], "sk"), begin_range=(["0", "10240"], "qty"))
    edges = ", ".join(f"('{k}', '{v}')" for k, v in vocab.EDGE_REGIONS.items())
    _job("aws_cloudfront", _offer(f, ["transferType", "fromLocation"]), aws.cloudfront,
         f", edge(loc, code) AS (VALUES {edges}) " + _select(
             _SKU, "'standard'", "''", "''", "'egress'", "usd", "'gb'",
             f"FROM feed f JOIN edge ON loc = fromLocation {_join('aws', 'code')} WHERE family = 'Data Transfer' AND "
             "transferType = 'CloudFront Outbound' AND begin_range = '0' "
             "QUALIFY row_number() OVER (PARTITION BY code ORDER BY file DESC, pos DESC) = 1", tier="'0'"), f)
    f = Frame(family=(["Amazon OpenSearch Service Instance", "Amazon OpenSearch Serverless"], "pk"),
              instanceType=(["m5.large.search", "t3.small.search", "x9.large.search", "m5.large"], "sk"),
              operation=(["SearchOCU", "IndexingOCU", "StorageUsedInS3ByteHour", "Other"], "ln"), **_AWS_REGION)
    managed = _select(_SKU, "instanceType", "'shared'", "'managed-cluster'", "'instance'", "usd", "'hour'",
                      f"FROM feed f {_join('aws', 'regionCode')} WHERE family = 'Amazon OpenSearch Service Instance' "
                      "AND instanceType LIKE '%.search'")
    ocu = ("CASE operation WHEN 'SearchOCU' THEN 'compute-ocu' WHEN 'IndexingOCU' THEN 'indexing-ocu' ELSE 'storage' END")
    serverless = _select("concat('opensearch-serverless-', r.region)", "'opensearch-serverless'", "'shared'",
                         "'serverless'", ocu, "usd", "CASE operation WHEN 'StorageUsedInS3ByteHour' THEN 'gb-month' ELSE 'hour' END",
                         f"FROM feed f {_join('aws', 'regionCode')} WHERE family = 'Amazon OpenSearch Serverless' "
                         "AND operation <> 'Other' QUALIFY row_number() OVER (PARTITION BY r.region, operation "
                         "ORDER BY file DESC, pos DESC) = 1")
    _job("aws_opensearch", _offer(f, ["instanceType", "operation", "regionCode"]), aws.opensearch,
         f" SELECT * FROM ({managed}) UNION ALL SELECT * FROM ({serverless})", f)
    f = Frame(family="'Compute'", operation=(["CreateOperation", "ExtendedSupport", "FargatePod", "ACKUsage"], "ln"),
              usagetype=(["Fargate-vCPU-Hours:perCPU", "Fargate-GB-Hours", "Outposts", "plain", "Fargate-EphemeralStorage-GB-Hours"],
                         "pk"), eksproducttype=(["Standard", "AutoMode"], "sk"), **_AWS_REGION)
    keep = "operation <> 'ACKUsage' AND eksproducttype <> 'AutoMode'"
    plane_case = ("CASE WHEN operation = 'CreateOperation' AND usagetype <> 'Outposts' THEN 'standard' "
                  "WHEN operation = 'ExtendedSupport' THEN 'extended-support' "
                  "WHEN usagetype LIKE '%Fargate-vCPU-Hours%' THEN 'vcpu' "
                  "WHEN usagetype LIKE '%Fargate-GB-Hours%' THEN 'memory' END")
    plane = _select(_SKU, f"concat('eks-', {plane_case})", "'kubernetes'", plane_case, "'cluster'", "usd", "'hrs'",
                    f"FROM feed f {_join('aws', 'regionCode')} WHERE {keep} AND {plane_case} IN ('standard', 'extended-support')")
    fargate = _select("concat('aws-eks-fargate-', r.region)", "'eks-fargate'", "'kubernetes'", "'fargate'", plane_case,
                      "usd", "'hrs'", f"FROM feed f {_join('aws', 'regionCode')} WHERE {keep} AND {plane_case} IN ('vcpu', 'memory') "
                      f"QUALIFY row_number() OVER (PARTITION BY r.region, {plane_case} ORDER BY file DESC, pos DESC) = 1")
    _job("aws_eks", _offer(f, ["operation", "usagetype", "eksproducttype", "regionCode"]), aws.eks,
         f" SELECT * FROM ({plane}) UNION ALL SELECT * FROM (SELECT *, FROM ({fargate}) QUALIFY count(*) OVER "
         "(PARTITION BY region) = 2)", f)


def _aws_tiers() -> None:
    f = Frame(family=(["API Request", "Other"], "sk"), queueType=(list(aws.SQS_QUEUES) + ["Fair"], "pk"),
              begin_range=(["0", "100000000000", "200000000000"], "ln"), end_range=(["100000000000", "200000000000", "Inf"], "ln"),
              sku_id="concat('Q-', pk, '-', pos)", dim_pos="ln", **{"regionCode": (_REGIONS["aws"], "sk + pk")})
    lo = "CASE begin_range WHEN '0' THEN '0' WHEN '100000000000' THEN '100B' ELSE '200B' END"
    hi = "CASE end_range WHEN 'Inf' THEN '' WHEN '100000000000' THEN '100B' ELSE '200B' END"
    name = "CASE queueType WHEN 'Standard' THEN 'standard' ELSE 'fifo' END"
    tiers = (f", hit AS (SELECT f.*, r.region_normalized, r.region AS rg, {name} AS name, {lo} AS lo, {hi} AS hi FROM feed f "
             f"{_join('aws', 'regionCode')} WHERE family = 'API Request' AND queueType <> 'Fair'), "
             "ids AS (SELECT name, rg, min(sku_id) AS sku_id FROM hit GROUP BY 1, 2) ")
    _job("aws_sqs", _offer(f, ["queueType", "regionCode"]), aws.sqs, tiers + _select(
        "i.sku_id", "h.name", "''", "''", "'request'", "usd", "'request'",
        "FROM hit h JOIN ids i ON i.name = h.name AND i.rg = h.rg QUALIFY row_number() OVER (PARTITION BY h.name, h.rg, lo "
        "ORDER BY h.sku_id, dim_pos) = 1", region="h.rg", tier="lo", upper="hi"), f)
    places = list(vocab.LOCATION_REGIONS) + ["AWS GovCloud (US)"]
    place_sql = ", places(loc, code) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in vocab.LOCATION_REGIONS.items()) + ")"
    f = Frame(family=(["API Request", "Other"], "pk"), location=(places, "sk"), unit="'Requests'",
              begin_range=(["0", "1000000"], "ln"), end_range=(["1000000", "Inf"], "ln"),
              description="concat('$', usd, ' per 1 million requests')")
    _job("aws_sns", _offer(f, ["location"]), aws.sns, place_sql + f""", hit AS (
  SELECT f.*, code, region_normalized, {_SKU} AS up, CASE begin_range WHEN '0' THEN 'free' ELSE 'paid' END AS part
  FROM feed f JOIN places ON loc = location {_join('aws', 'code')} WHERE family = 'API Request'
  QUALIFY row_number() OVER (PARTITION BY code, begin_range = '0' ORDER BY file DESC, pos DESC) = 1),
 pair AS (SELECT f.code, f.region_normalized, f.up || '::' || p.up AS sku_id, p.usd / 1e6 AS paid
  FROM hit f JOIN hit p ON f.code = p.code AND f.part = 'free' AND p.part = 'paid')
 SELECT sku_id, 'standard' AS resource_name, code AS region, region_normalized, '' AS tenancy, '' AS os,
  'request' AS dimension, t.tier, t.tier_upper, CASE t.tier WHEN '0' THEN 0.0 ELSE paid END AS amount, 'requests' AS unit
 FROM pair, (VALUES ('0', '1M'), ('1M', '')) t(tier, tier_upper)""", f)
    f = Frame(family=(["DNS Zone", "DNS Query"], "pk"), group=(["HostedZone", "Other"], "sk"),
              usagetype=(["DNS-Queries", "USE1-DNS-Queries", "Geo-DNS-Queries", "Other"], "ln"), begin_range="'0'")
    first = ("ORDER BY file, pos LIMIT 1")
    r53 = f""", zone AS (SELECT usd FROM feed WHERE family = 'DNS Zone' AND "group" = 'HostedZone' {first}),
 ask AS (SELECT usd FROM feed WHERE family = 'DNS Query' AND usagetype IN ('DNS-Queries', 'USE1-DNS-Queries') {first}),
 part AS (SELECT n, 'hosted_zone' AS dimension, usd, 'mo' AS unit FROM zone, (VALUES ('public'), ('private')) t(n)
  UNION ALL SELECT 'public', 'query', usd, 'query' FROM ask) """
    _job("aws_route53", _offer(f, ["group", "usagetype"]), aws.route53, r53 + _select(
        "concat('R53-ZONE-001-', n)", "n", "''", "''", "dimension", "usd", "unit", "FROM part", region="'global'",
        group="'global'", tier="'0'"), f)
    f = Frame(family=(["API Calls", "Other"], "pk"), operation=(["ApiGatewayRequest", "ApiGatewayHttpApi", "ApiGatewayWebSocket"], "ln"),
              location=(places, "sk"), begin_range="'0'", end_range=(["333000000", "Inf"], "qty"))
    _job("aws_api_gateway", _offer(f, ["operation", "location"]), aws.api_gateway, place_sql + " " + _select(
        _SKU, "CASE operation WHEN 'ApiGatewayRequest' THEN 'rest' ELSE 'http' END", "''", "''", "'request'", "usd",
        "'request'", f"FROM feed f JOIN places ON loc = location {_join('aws', 'code')} WHERE family = 'API Calls' AND "
        "operation <> 'ApiGatewayWebSocket' QUALIFY row_number() OVER (PARTITION BY operation, code "
        "ORDER BY file DESC, pos DESC) = 1", tier="'0'", upper="CASE end_range WHEN 'Inf' THEN '' ELSE '333M' END"), f)


_AZ = {"armRegionName": (_REGIONS["azure"] + ["nowhere"], "sk")}


def _azure() -> None:
    f = Frame(serviceName=(["Virtual Machines", "Storage"], "ln"), type=(["Consumption", "Reservation", "Consumption"], "pk"),
              productName=(["Dv5 Windows", "Dv5", "Dv5 Spot", "Ev4 Low Priority", "Ev4"], "pk + ln"), armSkuName="concat('D', pk % 9)",
              meterId="concat('m', pk, '-', sk % 3)", unitOfMeasure=(["1 Hour", "100 Hours"], "pk"), **_AZ)
    _job("azure_vm", _retail(f), azure.vm, _select(
        "meterId", "armSkuName", "'shared'", "CASE WHEN productName LIKE '%Windows%' THEN 'windows' ELSE 'linux' END",
        "'compute'", "usd / CASE unitOfMeasure WHEN '1 Hour' THEN 1.0 ELSE 100.0 END", "'hrs'",
        f"FROM (SELECT * FROM feed WHERE serviceName = 'Virtual Machines' AND type = 'Consumption' AND productName NOT LIKE "
        "'%Spot%' AND productName NOT LIKE '%Low Priority%' AND usd > 0 QUALIFY row_number() OVER (PARTITION BY meterId ORDER BY "
        f"file, pos) = 1) f {_join('azure', 'armRegionName')}"), f)
    for job, (service_name, engine, service) in azure.HOSTED_DATABASES.items():
        f = Frame(serviceName=([service_name, "Other"], "ln"), productName=(
            ["X Managed Instance", "X Elastic Pool", "X Single Database", "X Flexible Server", "X Unknown"], "pk"),
            skuName="concat('G', pk % 9)", meterId="concat('m', pk, '-', sk % 5)", unitOfMeasure=(["1 Hour", "1 GB/Month"], "sk + ln"), **_AZ)
        os = ("CASE productName WHEN 'X Managed Instance' THEN 'managed-instance' WHEN 'X Elastic Pool' THEN 'elastic-pool' "
              "WHEN 'X Single Database' THEN 'single-az' ELSE 'flexible-server' END")
        _job(job, _retail(f), azure.JOBS[job], _select(
            "meterId", "skuName", f"'{engine}'", os, "'compute'", "usd", "'hrs'",
            f"FROM feed f {_join('azure', 'armRegionName')} WHERE serviceName = '{service_name}' AND productName <> 'X Unknown' "
            "AND unitOfMeasure = '1 Hour' QUALIFY row_number() OVER (PARTITION BY meterId ORDER BY file, pos) = 1"), f)
    f = Frame(serviceName="'Storage'", skuName=(["Hot LRS", "Cool LRS", "Archive LRS", "Hot GRS"], "ln + sk"),
              meterName=(["Hot Data Stored", "Hot Read Operations", "Hot Write Operations", "Other"], "pk"),
              unitOfMeasure=(["1 GB/Month", "10K", "10K", "1"], "pk"), meterId=_SKU, **_AZ)
    dimension = ("CASE WHEN meterName LIKE '%Data Stored' THEN 'storage' WHEN meterName LIKE '%Read Operations' THEN 'read-ops' "
                 "WHEN meterName LIKE '%Write Operations' THEN 'write-ops' END")
    sql = _pivot_sql("CASE skuName WHEN 'Hot LRS' THEN 'hot' WHEN 'Cool LRS' THEN 'cool' WHEN 'Archive LRS' THEN 'archive' END",
                     {"storage": "", "read-ops": "", "write-ops": ""}, "", "azure", "armRegionName", "meterId",
                     "usd / CASE unitOfMeasure WHEN '10K' THEN 10000.0 ELSE 1.0 END").replace(
        "SELECT *, ", f"SELECT *, {dimension} AS dimension, ", 1)
    _job("azure_blob", _retail(f), azure.blob, sql + _select(
        "w.sku_id", "l.klass", "''", "''", "dimension", "amt", "CASE dimension WHEN 'storage' THEN 'gb-mo' ELSE 'requests' END",
        "FROM last l JOIN whole w ON w.klass = l.klass AND w.rg = l.rg", region="l.rg"), f)
    f = Frame(serviceName=(["Storage", "Other"], "ln"), productName=(list(azure.DISK_TYPES) + ["Ultra Disks"], "pk"),
              unitOfMeasure=(["1/Month", "1 GB/Month"], "sk"), meterId=_SKU, **_AZ)
    disk = "CASE productName WHEN 'Standard HDD Managed Disks' THEN 'standard-hdd' WHEN 'Standard SSD Managed Disks' THEN 'standard-ssd' ELSE 'premium-ssd' END"
    _job("azure_disks", _retail(f), azure.disks, _select(
        "meterId", disk, "''", "''", "'storage'", "usd", "'month'", f"FROM feed f {_join('azure', 'armRegionName')} WHERE "
        "serviceName = 'Storage' AND productName <> 'Ultra Disks' AND unitOfMeasure = '1/Month'"), f)
    f = Frame(serviceName="'Functions'", skuName=(["Standard", "Premium"], "ln"), meterName=(list(azure.FUNCTION_METERS) + ["Other"], "pk"),
              unitOfMeasure=(["10", "1 GB Second", "10"], "pk"), meterId=_SKU, **_AZ)
    sql = _pivot_sql("'x86_64'", {"executions": "", "duration": ""}, "WHERE skuName = 'Standard'", "azure", "armRegionName", "meterId",
                     "usd / CASE unitOfMeasure WHEN '10' THEN 10.0 ELSE 1.0 END").replace(
        "SELECT *, ", "SELECT *, CASE meterName WHEN 'Standard Total Executions' THEN 'executions' WHEN 'Standard Execution Time' "
        "THEN 'duration' END AS dimension, ", 1)
    _job("azure_functions", _retail(f), azure.functions, sql + _select(
        "w.sku_id || '::' || l.rg", "'x86_64'", "''", "''", "dimension", "amt",
        "CASE dimension WHEN 'duration' THEN 'gb-seconds' ELSE 'requests' END",
        "FROM last l JOIN whole w ON w.klass = l.klass AND w.rg = l.rg", region="l.rg"), f)
    f = Frame(productName=(["Azure Cosmos DB", "Cosmos Mongo", "Cosmos Cassandra", "Cosmos Table", "Cosmos Gremlin"], "sk + ln"),
              meterName=(["Serverless 1M Request Units", "Data Storage", "100 RU/s", "1 RU/s", "Backup"], "pk"), skuId=_SKU, **_AZ)
    mode = "CASE meterName WHEN 'Serverless 1M Request Units' THEN 'serverless' WHEN 'Data Storage' THEN 'storage' ELSE 'provisioned' END"
    api = "CASE WHEN productName = 'Azure Cosmos DB' THEN 'sql' ELSE lower(substr(productName, 8)) END"
    _job("azure_cosmosdb", _retail(f), azure.cosmosdb, _select(
        "skuId", f"concat('cosmos-', {mode})", api, mode, mode, "CASE meterName WHEN '100 RU/s' THEN usd / 100.0 ELSE usd END",
        "'1 hour'", f"FROM feed f {_join('azure', 'armRegionName')} WHERE meterName <> 'Backup' AND usd > 0"), f)
    f = Frame(productName="'Redis'", meterName=(["Standard C1 Cache", "Premium P2 Cache", "Basic C0 Cache", "Other"], "pk"),
              skuId="concat('R', pk % 50)", unitOfMeasure=(["1 Hour", "1/Month"], "ln"), **_AZ)
    _job("azure_redis", _retail(f), azure.redis, """, hit AS (
  SELECT f.*, r.region AS rg, region_normalized, lower(split_part(meterName, ' ', 1)) AS tier_name,
   split_part(meterName, ' ', 2) AS size, lower(replace(meterName, ' ', '-')) AS slug,
   count(*) OVER (PARTITION BY skuId) AS n FROM feed f """ + _join("azure", "armRegionName") + """
  WHERE meterName <> 'Other' AND unitOfMeasure = '1 Hour' AND usd > 0),
 named AS (SELECT *, CASE WHEN n > 1 THEN skuId || '-' || slug ELSE skuId END AS id FROM hit),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file, pos) AS k FROM named) """ + _select(
            "CASE WHEN k = 1 THEN id ELSE id || '-' || k END", "upper(tier_name[1]) || tier_name[2:] || ' ' || size", "'redis'", "tier_name", "'compute'",
            "usd", "'hrs'", "FROM ranked", region="rg"), f)
    f = Frame(productName="'Azure Kubernetes Service'", meterName=(list(azure.AKS_METERS) + ["Other"], "pk"), **_AZ)
    tier = "CASE meterName WHEN 'Standard Uptime SLA' THEN 'standard' ELSE 'premium' END"
    base = f"FROM feed f {_join('azure', 'armRegionName')} WHERE meterName <> 'Other'"
    paid = _select(f"concat('azure-aks-', {tier}, '-', r.region)", f"concat('aks-', {tier})", "'kubernetes'", tier, "'cluster'",
                   "usd", "'hour'", base)
    free = _select("concat('azure-aks-free-', r.region)", "'aks-free'", "'kubernetes'", "'free'", "'cluster'", "0.0", "'hour'",
                   base + " AND meterName = 'Standard Uptime SLA'")
    _job("azure_aks", _retail(f), azure.aks, f" SELECT * FROM ({paid}) UNION ALL SELECT DISTINCT * FROM ({free})", f)
    f = Frame(productName=(["App Service Premium v3 Plan - Linux", "App Service Basic Plan", "App Service Isolated v2 Plan - Windows", "Other"], "pk"),
              skuName=(["P1 v3", "B2", "I1 v2", "P1 v3"], "pk"), meterName="'App'", skuId=_SKU, **_AZ)
    _job("azure_appservice", _retail(f), azure.appservice, _select(
        "skuId", "replace(skuName, ' ', '')", "'dedicated'", "CASE WHEN productName LIKE '%Windows' THEN 'windows' ELSE 'linux' END",
        "'instance'", "usd", "'hrs'", f"FROM feed f {_join('azure', 'armRegionName')} WHERE productName <> 'Other' AND usd > 0"), f)
    f = Frame(serviceName="'API Management'", skuName=(["Consumption", "Developer", "Premium V2", "Basic v2", "Standard"], "pk"),
              unitOfMeasure=(["10K", "1 Hour", "1/Month"], "ln"), skuId=_SKU, **_AZ)
    name = "CASE skuName WHEN 'Premium V2' THEN 'premium-v2' ELSE lower(skuName) END"
    calls = (f"(SELECT f.*, r.region AS rg, region_normalized FROM feed f {_join('azure', 'armRegionName')} WHERE skuName = 'Consumption' "
             "AND unitOfMeasure = '10K' AND usd > 0 QUALIFY row_number() OVER (PARTITION BY r.region ORDER BY usd DESC, file, pos) = 1)")
    units = (f"(SELECT f.*, r.region AS rg, region_normalized FROM feed f {_join('azure', 'armRegionName')} WHERE skuName IN ('Developer', "
             "'Premium V2', 'Standard') QUALIFY row_number() OVER (PARTITION BY r.region, skuName ORDER BY "
             "CASE unitOfMeasure WHEN '1 Hour' THEN 0 ELSE 1 END, file, pos) = 1)")
    _job("azure_apim", _retail(f), azure.apim, " SELECT * FROM (" + _select(
        "skuId", "'consumption'", "''", "''", "'call'", "CASE t.lo WHEN '0' THEN 0.0 ELSE usd / 10000.0 END", "'request'",
        f"FROM {calls} c, (VALUES ('0', '1M'), ('1M', '')) t(lo, hi)", region="rg", tier="t.lo", upper="t.hi")
        + ") UNION ALL SELECT * FROM (" + _select("skuId", name, "''", "''", "'unit_hour'", "usd", "'hr'", f"FROM {units} u WHERE usd > 0",
                                                  region="rg", tier="'0'") + ")", f)
    for job, prefix in (("azure_service_bus_queues", "SB"), ("azure_service_bus_topics", "SBT")):
        f = Frame(serviceName="'Service Bus'", skuName=(["Standard", "Premium"], "pk"),
                  meterName=(["Standard Messaging Operations", "Premium Messaging Unit"], "pk"),
                  unitOfMeasure=(["1M", "1 Hour"], "pk"), armRegionName=(_REGIONS["azure"] * 150, "pk * 7 + sk * 13 + ln"))
        paid = (f"SELECT r.region AS rg, region_normalized, list(usd / 1e6 ORDER BY usd DESC) AS a FROM feed f "
                f"{_join('azure', 'armRegionName')} WHERE skuName = 'Standard' AND usd > 0 GROUP BY 1, 2 HAVING count(*) = 3")
        unit = (f"SELECT r.region AS rg, region_normalized, usd FROM feed f {_join('azure', 'armRegionName')} WHERE skuName = 'Premium' "
                "QUALIFY row_number() OVER (PARTITION BY r.region ORDER BY file, pos) = 1")
        _job(job, _retail(f), azure.JOBS[job], " SELECT * FROM (" + _select(
            f"concat('{prefix}-STD-', rg)", "'standard'", "''", "''", "'request'", "CASE t.i WHEN 0 THEN 0.0 ELSE a[t.i] END", "'request'",
            f"FROM ({paid}) p, (VALUES (0, '0', '13M'), (1, '13M', '100M'), (2, '100M', '2500M'), (3, '2500M', '')) t(i, lo, hi)",
            region="rg", tier="t.lo", upper="t.hi") + ") UNION ALL SELECT * FROM (" + _select(
            f"concat('{prefix}-PREM-', rg)", "'premium'", "''", "''", "'mu_hour'", "usd", "'hr'", f"FROM ({unit}) u", region="rg",
            tier="'0'") + ")", f)
    f = Frame(serviceName="'Event Hubs'", skuName=(["Standard", "Standard", "Premium"], "pk"), meterName=(list(azure.EVENT_METERS), "pk"),
              unitOfMeasure=(["1 Hour", "1M", "1 Hour"], "pk"), **_AZ)
    dim = "CASE meterName WHEN 'Standard Throughput Unit' THEN 'tu_hour' WHEN 'Standard Ingress Events' THEN 'event' ELSE 'ppu_hour' END"
    hub = "CASE skuName WHEN 'Premium' THEN 'premium' ELSE 'standard' END"
    last = (f"SELECT f.*, r.region AS rg, region_normalized, {dim} AS dimension, {hub} AS name FROM feed f {_join('azure', 'armRegionName')} "
            "WHERE usd > 0 QUALIFY row_number() OVER (PARTITION BY r.region, meterName ORDER BY file DESC, pos DESC) = 1")
    _job("azure_event_hubs", _retail(f), azure.event_hubs, f", l AS ({last}) " + _select(
        "concat(CASE name WHEN 'premium' THEN 'EH-PREM-' ELSE 'EH-STD-' END, rg)", "name", "''", "''", "dimension",
        "CASE dimension WHEN 'event' THEN usd / 1e6 ELSE usd END", "CASE dimension WHEN 'event' THEN 'request' ELSE 'hr' END",
        "FROM l QUALIFY name = 'premium' OR count(*) OVER (PARTITION BY rg, name) = 2", region="rg", tier="'0'"), f)
    f = Frame(productName="'Azure Front Door'", skuName=(["Standard", "Premium", "Classic"], "sk"),
              meterName=(["Base Fees", "Standard Data Transfer Out", "Premium Requests", "Other"], "pk"), skuId=_SKU,
              armRegionName=(list(azure.EDGE_ZONES) + ["US Gov"], "ln + sk"), tierMinimumUnits="pk % 1000",
              unitOfMeasure=(["1/Month", "1 GB", "10K", "1"], "pk"))
    zones = ", zones(zone, code) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in azure.EDGE_ZONES.items()) + ")"
    zoned = f"FROM feed f JOIN zones ON zone = armRegionName {_join('azure', 'code')}"
    tokens = ", ".join(f"({i + 1}, '{t}')" for i, t in enumerate(azure.EDGE_TOKENS))
    _job("azure_front_door", _retail(f), azure.front_door, zones + f""", toks(i, tok) AS (VALUES {tokens}),
 eg AS (SELECT skuName, zone, region_normalized, skuId, usd, row_number() OVER (PARTITION BY skuName, zone ORDER BY tierMinimumUnits, file, pos) AS i
   {zoned} WHERE meterName = 'Standard Data Transfer Out' AND skuName <> 'Classic' AND usd > 0 QUALIFY i <= 7),
 egn AS (SELECT *, max(i) OVER (PARTITION BY skuName, zone) AS n, first_value(skuId) OVER (PARTITION BY skuName, zone ORDER BY i) AS base_id FROM eg)
 SELECT * FROM (""" + _select("concat(base_id, ':edge-egress:', zone)", "lower(skuName)", "''", "''", "'egress'", "usd", "'gb'",
                              "FROM egn JOIN toks t ON t.i = egn.i LEFT JOIN toks u ON u.i = egn.i + 1 AND egn.i < n",
                              region="region_normalized", tier="t.tok", upper="coalesce(u.tok, '')") + ") UNION ALL SELECT * FROM (" + _select(
        "concat(skuId, ':request:', zone)", "lower(skuName)", "''", "''", "'request'", "usd / 10000.0", "'requests'",
        f"{zoned} WHERE meterName = 'Premium Requests' AND skuName <> 'Classic' AND usd > 0 QUALIFY row_number() OVER (PARTITION BY skuName, "
        "zone ORDER BY tierMinimumUnits, file, pos) = 1", region="region_normalized", tier="'0'") + ") UNION ALL SELECT * FROM (" + _select(
        "concat(skuId, ':base-fee:global')", "lower(skuName)", "''", "''", "'fee'", "usd", "'month'",
        "FROM feed WHERE meterName = 'Base Fees' AND skuName <> 'Classic' AND usd > 0 QUALIFY row_number() OVER (PARTITION BY skuName ORDER BY "
        "file, pos) = 1", region="'global'", group="'global'", tier="'0'") + ")", f)


_GC = {"region": (_REGIONS["gcp"] + ["nowhere"], "sk")}


def _gcp() -> None:
    f = Frame(serviceDisplayName=(["Cloud SQL", "Other"], "ln"), resourceFamily="'ApplicationServices'",
              description=(["Cloud SQL for MySQL: Regional - 4 vCPU + 15GB RAM in X", "Cloud SQL for PostgreSQL: Zonal - 2 vCPU + 7.5GB RAM in X",
                            "Cloud SQL for SQL Server: Zonal - vCPU", "Other"], "pk"), **_GC)
    mysql = "description LIKE '%MySQL%'"
    _job("gcp_cloud_sql", _billing(f), gcp.cloud_sql, _select(
        _GSKU, f"CASE WHEN {mysql} THEN 'db-custom-4-15360' ELSE 'db-custom-2-7680' END",
        f"CASE WHEN {mysql} THEN 'cloud-sql-mysql' ELSE 'cloud-sql-postgres' END", f"CASE WHEN {mysql} THEN 'regional' ELSE 'zonal' END",
        "'compute'", _USD, "'hrs'", f"FROM feed f {_join('gcp')} WHERE serviceDisplayName = 'Cloud SQL' AND description LIKE '%RAM%'"), f)
    f = Frame(description=(["Spanner Enterprise Plus PU", "Enterprise PU", "Standard PU", "SSD Storage", "Backup"], "pk"), **_GC)
    name = ("CASE description WHEN 'Spanner Enterprise Plus PU' THEN 'spanner-enterprise-plus' WHEN 'Enterprise PU' THEN 'spanner-enterprise' "
            "WHEN 'Standard PU' THEN 'spanner-standard' ELSE 'spanner-storage' END")
    _job("gcp_spanner", _billing(f), gcp.spanner, _select(
        _GSKU, name, name, "''", "CASE description WHEN 'SSD Storage' THEN 'storage' ELSE 'compute' END", _USD,
        "CASE description WHEN 'SSD Storage' THEN 'gb-month' ELSE 'pu-hour' END",
        f"FROM feed f {_join('gcp')} WHERE description <> 'Backup'"), f)
    f = Frame(serviceDisplayName="'Cloud Storage'",
              description=(["Standard Storage", "Regional Class A Operations", "Regional Class B Operations"], "pk"),
              resourceGroup=(["RegionalStorage", "NearlineStorage", "MultiRegionalStorage"], "ln", "pk % 3 = 0",
                             ["RegionalOps", "NearlineOps"], "ln"),
              usage_unit=(["GiBy.mo", "count", "count"], "pk"),
              region=(_REGIONS["gcp"], "sk", "pk % 3 = 0", ["global"], "0"))
    klass = ("CASE resourceGroup WHEN 'RegionalStorage' THEN 'standard' WHEN 'RegionalOps' THEN 'standard' "
             "WHEN 'NearlineStorage' THEN 'nearline' WHEN 'NearlineOps' THEN 'nearline' END")
    _job("gcp_gcs", _billing(f), gcp.gcs, f""", hit AS (
  SELECT *, {klass} AS klass, CASE WHEN description LIKE '%Class A%' THEN 'read-ops' WHEN description LIKE '%Class B%' THEN 'write-ops'
    ELSE 'storage' END AS dim, {_USD} AS amt, {_GSKU} AS up FROM feed),
 ops AS (SELECT klass, dim, amt FROM hit WHERE region = 'global' AND klass IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY klass, dim ORDER BY file DESC, pos DESC) = 1),
 stored AS (SELECT h.*, region_normalized FROM hit h {_join('gcp', 'h.region')} WHERE klass IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY klass, h.region ORDER BY file DESC, pos DESC) = 1),
 whole AS (SELECT s.*, o.dim AS od, o.amt AS oa FROM stored s JOIN ops o ON o.klass = s.klass
  QUALIFY count(*) OVER (PARTITION BY s.klass, s.region) = 2)
 SELECT * FROM (""" + _select("up", "klass", "''", "''", "od", "oa", "'requests'", "FROM whole", region="region")
         + ") UNION ALL SELECT DISTINCT * FROM (" + _select("up", "klass", "''", "''", "'storage'", "amt", "'gb-mo'",
                                                             "FROM whole", region="region") + ")", f)
    for job, display, request in (("gcp_run", "Cloud Run", "Requests"), ("gcp_functions", "Cloud Run Functions", "Invocations")):
        f = Frame(serviceDisplayName=([display, "Other"], "ln"), resourceGroup="'Compute'",
                  description=(["Services CPU", "Services Memory", request, "CPU Commitment"], "pk"), usage_unit=(["s", "GiBy.s", "count", "s"], "pk"), **_GC)
        dim = "CASE description WHEN 'Services CPU' THEN 'cpu-second' WHEN 'Services Memory' THEN 'memory-gb-second' ELSE 'requests' END"
        last = (f"SELECT r.region AS rg, region_normalized, {dim} AS dimension, {_GSKU} AS up, {_USD} AS amt, usage_unit FROM feed f {_join('gcp')} "
                f"WHERE serviceDisplayName = '{display}' AND description <> 'CPU Commitment' AND (description <> '{request}' OR {_USD} <> 0) "
                "QUALIFY row_number() OVER (PARTITION BY r.region, dimension ORDER BY file DESC, pos DESC) = 1")
        _job(job, _billing(f), gcp.JOBS[job], f", l AS ({last}), ok AS (SELECT rg, max(up) FILTER (WHERE dimension = 'cpu-second') AS sku_id FROM l GROUP BY 1 "
             "HAVING count(*) FILTER (WHERE dimension IN ('cpu-second', 'memory-gb-second')) = 2) " + _select(
            "ok.sku_id", "'x86_64'", "''", "''", "dimension", "amt", "CASE usage_unit WHEN 's' THEN 's' WHEN 'count' THEN 'requests' ELSE 'gb-s' END",
            "FROM l JOIN ok ON ok.rg = l.rg", region="l.rg"), f)
    f = Frame(serviceDisplayName=(["Cloud Memorystore for Redis", "Cloud Memorystore for Memcached", "Other"], "ln"),
              description=(["Basic 4 GB", "Standard M3 node", "Custom Core", "Custom RAM"], "pk"), **_GC)
    engine = "CASE serviceDisplayName WHEN 'Cloud Memorystore for Redis' THEN 'redis' ELSE 'memcached' END"
    size = "CASE description WHEN 'Basic 4 GB' THEN 'basic-4gb' WHEN 'Standard M3 node' THEN 'standard-16gb' ELSE 'standard-1gb' END"
    _job("gcp_memorystore", _billing(f), gcp.memorystore, _select(
        _GSKU, f"concat('memorystore-', {engine}, '-', {size})", engine, "''", "'compute'", _USD, "'hour'",
        f"FROM feed f {_join('gcp')} WHERE serviceDisplayName <> 'Other' AND description <> 'Custom Core' AND {_USD} > 0"), f)
    f = Frame(description=(["Autopilot Pod mCPU Requests", "Autopilot Pod Memory Requests", "Autopilot Pod Ephemeral Storage Requests",
                            "Autopilot Pod mCPU Requests Spot"], "pk"), **_GC)
    dim = "CASE description WHEN 'Autopilot Pod mCPU Requests' THEN 'vcpu' WHEN 'Autopilot Pod Memory Requests' THEN 'memory' ELSE 'storage' END"
    last = (f"SELECT r.region AS rg, region_normalized, {dim} AS dimension, {_USD} AS amt FROM feed f {_join('gcp')} WHERE description NOT LIKE '%Spot' "
            "QUALIFY row_number() OVER (PARTITION BY r.region, description ORDER BY file DESC, pos DESC) = 1")
    _job("gcp_gke", _billing(f), gcp.gke, f", l AS ({last}) SELECT * FROM (" + _select(
        "concat('gke-autopilot-', rg)", "'gke-autopilot'", "'kubernetes'", "'autopilot'", "dimension", "amt",
        "CASE dimension WHEN 'vcpu' THEN 'milliCPU-hr' ELSE 'GiBy-hr' END", "FROM l QUALIFY count(*) OVER (PARTITION BY rg) = 3", region="rg")
        + ") UNION ALL SELECT * FROM (" + _select("concat('B561-BFBD-1264-', region)", "'gke-standard'", "'kubernetes'", "'standard'", "'cluster'",
                                                  "0.10", "'hr'", "FROM region_map WHERE provider = 'gcp'", region="region") + ")", f)
    f = Frame(description=(["Analysis", "Enterprise Plus Edition slot", "Standard Edition slot", "Active Logical Storage", "Long-Term Logical Storage",
                            "Active Physical Storage", "BI Engine"], "pk"), usage_unit=(["TiBy", "h", "h", "GiBy.mo", "GiBy.mo", "GiBy.mo", "h"], "pk"),
              region=(_REGIONS["gcp"] + ["us", "EU", "nowhere"], "sk"))
    name = ("CASE description WHEN 'Analysis' THEN 'on-demand' WHEN 'Enterprise Plus Edition slot' THEN 'capacity-enterprise-plus' WHEN 'Standard Edition slot' "
            "THEN 'capacity-standard' WHEN 'Active Logical Storage' THEN 'storage-active' ELSE 'storage-long-term' END")
    place = "CASE region WHEN 'us' THEN 'bq-us' WHEN 'EU' THEN 'bq-eu' ELSE region END"
    _job("gcp_bigquery", _billing(f), gcp.bigquery, _select(
        f"concat({_GSKU}, '-', r.region)", name, "'shared'", "'on-demand'",
        f"CASE WHEN {name} LIKE 'capacity%' THEN 'slot' WHEN {name} LIKE 'storage%' THEN 'storage' ELSE 'query' END", _USD,
        "CASE usage_unit WHEN 'TiBy' THEN 'tb' WHEN 'h' THEN 'slot-hour' ELSE 'gb-month' END",
        f"FROM (SELECT * REPLACE ({place} AS region) FROM feed) f {_join('gcp')} WHERE description NOT LIKE '%Physical%' AND description <> 'BI Engine' AND {_USD} > 0 "
        "QUALIFY row_number() OVER (PARTITION BY description, r.region ORDER BY file, pos) = 1"), f)
    f = Frame(resourceGroup=(list(gcp.FIRESTORE_GROUPS) + ["DatastoreOps"], "pk"),
              description=(["Firestore North America", "Firestore Europe", "Firestore Asia", "Firestore Mars"], "ln"), region="'x'")
    dim = ("CASE resourceGroup WHEN 'FirestoreEntityPutOps' THEN 'document_write' WHEN 'FirestoreEntityDeleteOps' THEN 'document_delete' "
           "WHEN 'FirestoreReadOps' THEN 'document_read' WHEN 'FirestoreStorage' THEN 'storage' END")
    code = "CASE description WHEN 'Firestore North America' THEN 'us-east1' WHEN 'Firestore Europe' THEN 'europe-west1' WHEN 'Firestore Asia' THEN 'asia-northeast1' END"
    _job("gcp_firestore", _billing(f), gcp.firestore, f", l AS (SELECT r.region AS rg, region_normalized, {dim} AS dimension, {_USD} AS amt FROM feed f "
         f"{_join('gcp', code)} WHERE resourceGroup <> 'DatastoreOps' QUALIFY row_number() OVER (PARTITION BY r.region, resourceGroup "
         "ORDER BY file DESC, pos DESC) = 1) " + _select(
             "concat('FIRESTORE-NATIVE-', rg)", "'native'", "'firestore-native'", "''", "dimension", "amt",
             "CASE dimension WHEN 'storage' THEN 'gb-mo' ELSE 'request' END", "FROM l QUALIFY count(*) OVER (PARTITION BY rg) = 4", region="rg"), f)
    for job in ("gcp_pubsub_queues", "gcp_pubsub_topics"):
        f = Frame(resourceGroup=(["Message", "Other"], "ln"), description=(["Message Delivery Basic", "Seek"], "pk"), region="'global'")
        _job(job, _billing(f, 2), gcp.JOBS[job], _select(
            "'PUBSUB-BASIC-GLOBAL'", "'throughput'", "''", "''", "'throughput'",
            "(CAST(round(usd * 1000000) AS BIGINT) * 2 / 1000000000.0::DOUBLE) / 1024.0", "'gb-mo'",
            f"FROM feed WHERE resourceGroup = 'Message' AND description = 'Message Delivery Basic' AND {_USD} > 0",
            region="'global'", group="'global'", tier="'0'"), f)
    f = Frame(resourceGroup=(["CDNCacheEgress", "Cdn", "EdgeCacheEgress"], "pk"), region="'global'",
              description=([gcp.CDN_EGRESS_PREFIX + p for p in gcp.CDN_REGIONS] + ["Other"], "sk"))
    places = ", places(loc, code) AS (VALUES " + ", ".join(f"('{gcp.CDN_EGRESS_PREFIX}{k}', '{v}')" for k, v in gcp.CDN_REGIONS.items()) + ")"
    tokens = "(VALUES (1, '0', '10TB'), (2, '10TB', '150TB'), (3, '150TB', '1PB'), (4, '1PB', '')) t(i, lo, hi)"
    _job("gcp_cloud_cdn", _billing(f, 4), gcp.cloud_cdn, places + " SELECT * FROM (" + _select(
        f"concat('CLOUD-CDN-EGRESS-', upper(replace(replace(description, '{gcp.CDN_EGRESS_PREFIX}', ''), ' ', '-')))", "'standard'", "''", "''", "'egress'",
        "(CAST(round(usd * 1000000) AS BIGINT) * t.i / 1000000000.0::DOUBLE)", "'gb'",
        f"FROM feed f JOIN places ON loc = description, {tokens} WHERE resourceGroup = 'CDNCacheEgress'", region="code", group="'global'",
        tier="t.lo", upper="t.hi") + ") UNION ALL SELECT * FROM (" + _select(
        "'CLOUD-CDN-REQUESTS-GLOBAL'", "'standard'", "''", "''", "'request'", _USD, "'request'",
        "FROM feed WHERE resourceGroup = 'Cdn' QUALIFY row_number() OVER (ORDER BY file DESC, pos DESC) = 1", region="'global'", group="'global'",
        tier="'0'") + ")", f)
    f = Frame(resourceGroup=(["DNS", "Other"], "ln"), description=(["ManagedZone", "DNS Query (port 53)", "Other"], "pk"), region="'global'",
              n_rates=([3, 2, 1], "pk"))
    pick = "FROM feed WHERE resourceGroup = 'DNS' AND description = '{}' ORDER BY file, pos LIMIT 1"
    rate = "(CAST(round(usd * 1000000) AS BIGINT) * t.i / 1000000000.0::DOUBLE)"
    _job("gcp_cloud_dns", _billing(f), gcp.cloud_dns, " SELECT * FROM (" + _select(
        "'GCP-DNS-PUBLIC-GLOBAL'", "'public'", "''", "''", "'hosted_zone'", rate, "'mo'",
        f"FROM (SELECT usd {pick.format('ManagedZone')}) z, (VALUES (1, '0', '25'), (2, '25', '10K'), (3, '10K', '')) t(i, lo, hi)", region="'global'",
        group="'global'", tier="t.lo", upper="t.hi") + ") UNION ALL SELECT * FROM (" + _select(
        "'GCP-DNS-PUBLIC-GLOBAL'", "'public'", "''", "''", "'query'", rate, "'request'",
        f"FROM (SELECT usd {pick.format('DNS Query (port 53)')}) q, (VALUES (1, '0', '1B'), (2, '1B', '')) t(i, lo, hi)", region="'global'",
        group="'global'", tier="t.lo", upper="t.hi") + ")", f)


def _component_price() -> None:
    """Machines are the parts, component prices the order lines."""
    families = [k for k in gcp.FAMILY_PREFIXES][:5]
    cpu = [gcp.FAMILY_PREFIXES[k][0] + " running in X" for k in families]
    ram = [gcp.FAMILY_PREFIXES[k][1] + " running in X" for k in families]
    f = Frame(serviceDisplayName="'Compute Engine'", resourceFamily="'Compute'", usage_unit=(["h"] * 5 + ["GiBy.h"] * 5, "pk"),
              description=(cpu + ram, "pk"), **_GC)

    def job(spark: SparkSession, d: str) -> DataFrame:
        five = F.pmod("p_partkey", F.lit(5)).cast("int")
        machines = table(spark, d, "part").select(
            F.concat(F.get(F.array(*(F.lit(k) for k in families)), five), F.lit("-"), F.col("p_partkey")).alias("name"),
            F.col("p_size").cast("bigint").alias("vcpu"), (F.col("p_size") * 4096).cast("bigint").alias("memory_mb"),
            F.when(F.pmod("p_partkey", F.lit(9)) == 0, 1).otherwise(0).alias("n_accelerators"))
        return _flat(gcp.gce(_billing(f)(spark, d), machines))
    names = ", ".join(f"'{k}'" for k in families)
    register("feed_gcp_gce", job, f"""WITH {REGION_SQL}, {f.sql()},
 comp AS (SELECT r.region AS rg, region_normalized, pk % 5 AS fam, pk % 10 < 5 AS is_cpu, {_GSKU} AS up, {_USD} AS amt
  FROM feed f {_join('gcp')} QUALIFY row_number() OVER (PARTITION BY r.region, description ORDER BY file DESC, pos DESC) = 1),
 machine AS (SELECT ([{names}])[1 + CAST(p_partkey % 5 AS INT)] || '-' || p_partkey AS name, p_partkey % 5 AS fam, p_size FROM part WHERE p_partkey % 9 <> 0) """
             + _select("c.up || ':' || name", "name", "'shared'", "'linux'", "'compute'", "p_size * c.amt + p_size * 4.0::DOUBLE * m.amt", "'hrs'",
                       "FROM machine JOIN comp c ON c.fam = machine.fam AND c.is_cpu JOIN comp m ON m.fam = machine.fam AND NOT m.is_cpu AND m.rg = c.rg",
                       region="c.rg", group="c.region_normalized"))


def _llm() -> None:
    """Models are the parts and their endpoints the order lines of the part."""
    def frames(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
        part = table(spark, d, "part")
        money = F.create_map(F.lit("prompt"), (F.col("p_retailprice") / 1e6).cast("string"),
                             F.lit("completion"), (F.col("p_retailprice") / 5e5).cast("string"), F.lit("image"), F.lit("0"))
        models = part.select(
            F.col("p_partkey").alias("pos"), F.concat(F.lit("m/"), F.col("p_partkey")).alias("id"),
            (F.col("p_size") * 1000).cast("bigint").alias("context_length"),
            F.struct(F.lit("text").alias("modality"), F.when(F.pmod("p_partkey", F.lit(2)) == 0, F.array(F.lit("text"))).otherwise(
                F.array(F.lit("text"), F.lit("image"))).alias("input_modalities")).alias("architecture"), money.alias("pricing"),
            F.struct(F.lit(None).cast("bigint").alias("context_length"), F.lit(1).cast("bigint").alias("max_completion_tokens")).alias("top_provider"),
            F.array(F.lit("tools")).alias("supported_parameters"))
        line = (table(spark, d, "lineitem"))
        own = F.create_map(F.lit("prompt"), (F.col("l_quantity") / 1e6).cast("string"), F.lit("completion"),
                           (F.col("l_quantity") / 5e5).cast("string"))
        endpoints = line.select(
            F.concat(F.lit("m/"), F.col("l_partkey")).alias("id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("e_pos"),
            F.concat(F.lit("s"), F.pmod("l_suppkey", F.lit(10))).alias("tag"), F.lit("x").alias("provider_name"),
            F.when(F.col("l_returnflag") == "A", "fp8").alias("quantization"), F.lit(4096).cast("bigint").alias("context_length"),
            F.lit(1).cast("bigint").alias("max_completion_tokens"), F.col("l_discount").alias("uptime_last_30m"),
            F.struct(F.lit(1).cast("bigint").alias("p50_ms"), F.lit(2).cast("bigint").alias("p95_ms")).alias("latency"),
            F.lit(1.0).alias("throughput_tokens_per_second"), own.alias("pricing"))
        return models, endpoints

    def rows(spark: SparkSession, d: str) -> DataFrame:
        return llm.openrouter(*frames(spark, d), observed_at=0)
    text = """WITH offer AS (
  SELECT 'm/' || l_partkey AS id, 's' || (l_suppkey % 10) AS provider, CASE l_returnflag WHEN 'A' THEN 'fp8' ELSE 'default' END AS quant,
   l_quantity / 1e6 AS prompt, l_quantity / 5e5 AS completion, l_discount AS uptime, p_partkey % 2 = 0 AS plain
  FROM lineitem JOIN part ON p_partkey = l_partkey
  UNION ALL SELECT 'm/' || p_partkey, 'openrouter', 'default', p_retailprice / 1e6, p_retailprice / 5e5, NULL, p_partkey % 2 = 0 FROM part
  WHERE p_partkey IN (SELECT l_partkey FROM lineitem)),
 best AS (SELECT * FROM offer QUALIFY row_number() OVER (PARTITION BY id, provider, quant ORDER BY prompt + completion, coalesce(uptime, -1) DESC) = 1)
"""
    register("feed_openrouter", lambda spark, d: rows(spark, d).select(
        "sku_id", "provider", "kind", "resource_name", "health.uptime_30d", "is_aggregated",
        F.get("prices", F.lit(0))["amount"].alias("prompt"), F.size("prices").alias("n_prices")), text + """
 SELECT id || '::' || provider || '::' || quant AS sku_id, provider, CASE WHEN plain THEN 'llm.text' ELSE 'llm.multimodal' END AS kind,
  id AS resource_name, uptime AS uptime_30d, provider = 'openrouter' AS is_aggregated, prompt, 2 AS n_prices FROM best""")
    from tarifold.operators.compare import headline_price, routing_score
    from tarifold.operators.lookup import lookup_llm
    register("lookup_llm", lambda spark, d: lookup_llm(rows(spark, d), "m/7", "").select(
        "sku_id", "provider", F.size("prices").alias("n_prices")), text + """
 SELECT id || '::' || provider || '::' || quant AS sku_id, provider, 2 AS n_prices FROM best WHERE id = 'm/7' AND provider <> 'openrouter'""")
    register("compare_llm_headline", lambda spark, d: rows(spark, d).filter("NOT is_aggregated").groupBy("resource_name").agg(
        F.min(headline_price()).alias("cheapest"), F.count(F.lit(1)).alias("offers")), text + """
 SELECT id AS resource_name, min(prompt) AS cheapest, count(*) AS offers FROM best WHERE provider <> 'openrouter' GROUP BY 1""")
    register("llm_routing_score", lambda spark, d: routing_score(rows(spark, d)).select(
        "sku_id", F.round("routing_score", 12).alias("routing_score")), text + """
 SELECT id || '::' || provider || '::' || quant AS sku_id, round(completion - 0.01::DOUBLE * uptime + 0.0001::DOUBLE * 2, 12) AS routing_score
 FROM best WHERE provider <> 'openrouter'""")


for _build in (_aws_flat, _aws_pivots, _aws_tiers, _azure, _gcp, _component_price, _llm):
    _build()
