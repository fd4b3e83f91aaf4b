"""Feed jobs over retail price documents. Each takes the flat frame of `sources.documents.retail_items`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tarifold.feeds.ops import (
    first_per, joined_id, pivot_dimensions, suffix_collisions, with_region_group, zipped_tiers,
)
from tarifold.functions.cases import first_case, keyword_class, mapped
from tarifold.functions.numbers import canonical_unit
from tarifold.functions.terms import literal_terms
from tarifold.operators.rows import attrs, json_object, normalized_rows, price

PROVIDER = "azure"

# Names in the retail feed and what they mean.
SPOT_HINTS = ("Spot", "Low Priority")
DEPLOYMENT_HINTS = (
    ("Managed Instance", "managed-instance"),
    ("Elastic Pool", "elastic-pool"),
    ("Single Database", "single-az"),
    ("Single Server", "single-az"),
    ("Flexible Server", "flexible-server"),
)
HOSTED_DATABASES = {
    "azure_sql": ("SQL Database", "azure-sql", "sql"),
    "azure_postgres": ("Azure Database for PostgreSQL", "azure-postgres", "postgres"),
    "azure_mysql": ("Azure Database for MySQL", "azure-mysql", "mysql"),
    "azure_mariadb": ("Azure Database for MariaDB", "azure-mariadb", "mariadb"),
}
BLOB_TIERS = {"Hot LRS": "hot", "Cool LRS": "cool", "Archive LRS": "archive"}
BLOB_AVAILABILITY = {"hot": "standard", "cool": "infrequent", "archive": "archive"}
BLOB_METERS = {"Data Stored": "storage", "Read Operations": "read-ops", "Write Operations": "write-ops"}
DISK_TYPES = {
    "Standard HDD Managed Disks": "standard-hdd",
    "Standard SSD Managed Disks": "standard-ssd",
    "Premium SSD Managed Disks": "premium-ssd",
}
FUNCTION_METERS = {"Standard Total Executions": "executions", "Standard Execution Time": "duration"}
COSMOS_APIS = (("mongo", "mongo"), ("cassandra", "cassandra"), ("table", "table"), ("gremlin", "gremlin"),
               ("graph", "gremlin"))
REDIS_MEMORY_GB = {
    "basic": {"C0": 0.25, "C1": 1.0},
    "standard": {"C0": 0.25, "C1": 1.0, "C2": 2.5, "C3": 6.0, "C4": 13.0, "C5": 26.0, "C6": 53.0},
    "premium": {"P1": 6.0, "P2": 13.0, "P3": 26.0, "P4": 53.0, "P5": 120.0},
    "enterprise": {"E5": 12.0, "E10": 25.0, "E20": 50.0, "E50": 100.0, "E100": 200.0},
}
AKS_METERS = {"Standard Uptime SLA": "standard", "Standard Long Term Support": "premium"}
# App plan -> vCPU and memory.
PLAN_SPECS = {
    "F1": (1, 1.0), "D1": (1, 1.75), "B1": (1, 1.75), "B2": (2, 3.5), "B3": (4, 7.0), "S1": (1, 1.75),
    "S2": (2, 3.5), "S3": (4, 7.0), "P1v2": (1, 3.5), "P2v2": (2, 7.0), "P3v2": (4, 14.0), "P0v3": (1, 4.0),
    "P1v3": (2, 8.0), "P2v3": (4, 16.0), "P3v3": (8, 32.0), "I1v2": (2, 8.0), "I2v2": (4, 16.0),
    "I3v2": (8, 32.0), "I4v2": (16, 64.0), "I5v2": (32, 128.0), "I6v2": (64, 256.0), "I1": (2, 3.5),
    "I2": (4, 7.0), "I3": (8, 14.0),
}
PLAN_TIERS = (
    ("isolated v2", "isolatedv2"), ("isolated", "isolated"), ("premium v3", "premiumv3"), ("premiumv3", "premiumv3"),
    ("premium v2", "premium"), ("premiumv2", "premium"), ("premium", "premium"), ("standard", "standard"),
    ("basic", "basic"), ("shared", "shared"), ("free", "free"),
)
PLAN_PATTERN = r"(?i)\b(F1|D1|B[123]|S[123]|P[0-3]\s*v[23]|I[1-6]\s*v2|I[1-3])\b"
APIM_SKUS = {"consumption": "consumption", "developer": "developer", "basic": "basic", "standard": "standard",
             "premium": "premium", "isolated": "isolated", "premium v2": "premium-v2"}
BUS_TOKENS = ("13M", "100M", "2500M")
EVENT_METERS = {"Standard Throughput Unit": "tu", "Standard Ingress Events": "event", "Premium Processing Unit": "ppu"}
EDGE_TOKENS = ("0", "10TB", "50TB", "150TB", "500TB", "1PB", "5PB")
EDGE_ZONES = {
    "Zone 1": "eastus", "Zone 2": "japaneast", "Zone 3": "brazilsouth", "Zone 4": "australiaeast",
    "Zone 5": "centralindia", "Zone 6": "westeurope", "Zone 7": "southafricanorth", "Zone 8": "koreacentral",
}


def _order() -> Column:
    return F.struct("file", "pos")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _paid(items: DataFrame, service: str | None = None, strict_type: bool = True) -> DataFrame:
    """US-dollar pay-as-you-go items, with region and price under short names."""
    kind, currency = F.col("type"), F.col("currencyCode")
    if not strict_type:
        kind, currency = F.coalesce(kind, F.lit("Consumption")), F.coalesce(currency, F.lit("USD"))
    out = items.filter((kind == "Consumption") & (currency == "USD"))
    if service is not None:
        out = out.filter(F.col("serviceName") == service)
    return out.withColumns({"region": _text("armRegionName"), "usd": F.coalesce("retailPrice", F.lit(0.0))})


def _divided(df: DataFrame, family: str) -> DataFrame:
    """Divide the price by the unit of measure; items in an unknown unit are dropped."""
    df = df.withColumn("_u", canonical_unit(F.col("unitOfMeasure"), family)).filter("_u IS NOT NULL")
    return df.withColumns({"amount": F.col("usd") / F.col("_u.divisor"), "unit": F.col("_u.unit")})


def _unit_or_error(family: str) -> Column:
    return F.coalesce(canonical_unit(F.col("unitOfMeasure"), family), F.raise_error(
        F.concat(F.lit("unsupported unit of measure: "), _text("unitOfMeasure"))).cast(
        "struct<divisor:double,unit:string>"))


def _rows(df: DataFrame, service: str, kind: str, name: Column, terms: Column, prices: Column, sku_id: Column,
          **extra) -> DataFrame:
    return normalized_rows(df, provider=PROVIDER, service=service, kind=kind, sku_id=sku_id, resource_name=name,
                           region=F.col("region"), region_normalized=F.col("region_normalized"), terms=terms,
                           prices=prices, **extra)


def _sku_or(*parts: Column | str) -> Column:
    made = F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.coalesce(F.nullif("skuId", F.lit("")), made)


def vm(items: DataFrame) -> DataFrame:
    """First item of a meter wins, before regions are filtered."""
    product = F.col("productName")
    df = _paid(items, "Virtual Machines").filter(
        ~product.rlike("|".join(SPOT_HINTS)) & (F.col("usd") > 0))
    df = first_per(df, ["meterId"], _order())
    df = with_region_group(df, PROVIDER).withColumn("_u", _unit_or_error("hour"))
    return _rows(df, "vm", "compute.vm", F.col("armSkuName"),
                 literal_terms(commitment="on_demand", tenancy="shared",
                               os=F.when(product.contains("Windows"), "windows").otherwise("linux")),
                 F.array(price("compute", F.col("usd") / F.col("_u.divisor"), F.col("_u.unit"))), F.col("meterId"),
                 resource_attrs=attrs(architecture=F.lit("x86_64"), extra=json_object(product_name=product)))


def hosted_database(items: DataFrame, service_name: str, engine: str, service: str) -> DataFrame:
    """One scanner for the four hosted databases; the first item of a meter wins after the filters."""
    df = _paid(items, service_name).withColumn(
        "deployment", keyword_class(F.col("productName"), DEPLOYMENT_HINTS)).filter("deployment IS NOT NULL")
    df = first_per(_divided(with_region_group(df, PROVIDER), "hour"), ["meterId"], _order())
    return _rows(df, service, "db.relational", F.col("skuName"),
                 literal_terms(commitment="on_demand", tenancy=engine, os=F.col("deployment")),
                 F.array(price("compute", F.col("amount"), F.col("unit"))), F.col("meterId"),
                 resource_attrs=attrs(extra=json_object(product_name=F.col("productName"),
                                                        deployment_option=F.col("deployment"))))


def blob(items: DataFrame) -> DataFrame:
    meter = _text("meterName")
    dimension = first_case((meter.endswith(suffix), d) for suffix, d in BLOB_METERS.items())
    df = _paid(items, "Storage").withColumns({"tier": mapped(_text("skuName"), BLOB_TIERS), "dimension": dimension})
    df = with_region_group(df.filter("tier IS NOT NULL AND dimension IS NOT NULL"), PROVIDER)
    df = df.withColumn("_u", F.when(F.col("dimension") == "storage", _unit_or_error("storage")).otherwise(
        _unit_or_error("request")))
    df = df.withColumns({"amount": F.col("usd") / F.col("_u.divisor"), "unit": F.col("_u.unit")})
    dims = ["storage", "read-ops", "write-ops"]
    wide = pivot_dimensions(df, ["tier", "region", "region_normalized"], dims, ["meterId", "amount", "unit"], _order())
    return _rows(wide, "blob", "storage.object", F.col("tier"), literal_terms(commitment="on_demand"),
                 F.array(*(price(d, F.col(f"`{d}`.amount"), F.col(f"`{d}`.unit")) for d in dims)),
                 joined_id(*(F.col(f"`{d}`.meterId") for d in dims)),
                 resource_attrs=attrs(durability_nines=F.lit(11),
                                      availability_tier=mapped(F.col("tier"), BLOB_AVAILABILITY),
                                      extra=json_object(redundancy="lrs")))


def disks(items: DataFrame) -> DataFrame:
    df = _paid(items, "Storage").withColumn("name", mapped(_text("productName"), DISK_TYPES)).filter(
        F.col("name").isNotNull() & (F.col("unitOfMeasure") == "1/Month"))
    df = _divided(with_region_group(df, PROVIDER), "storage")
    return _rows(df, "disks", "storage.block", F.col("name"), literal_terms(commitment="on_demand"),
                 F.array(price("storage", F.col("amount"), F.col("unit"))), F.col("meterId"),
                 resource_attrs=attrs(extra=json_object(product_name=F.col("productName"), redundancy="lrs")))


def functions(items: DataFrame) -> DataFrame:
    df = _paid(items, "Functions").filter(F.col("skuName") == "Standard").withColumn(
        "dimension", mapped(_text("meterName"), FUNCTION_METERS)).filter("dimension IS NOT NULL")
    runs, uom = F.col("dimension") == "executions", F.col("unitOfMeasure")
    divisor = F.coalesce(canonical_unit(uom, "request")["divisor"],
                         F.when(uom.rlike(r"^\d+$"), uom.try_cast("double")), F.lit(1.0))
    df = with_region_group(df, PROVIDER).withColumns({
        "amount": F.when(runs, F.col("usd") / divisor).otherwise(F.col("usd")),
        "unit": F.when(runs, "requests").otherwise("gb-seconds")})
    dims = ["executions", "duration"]
    wide = pivot_dimensions(df, ["region", "region_normalized"], dims, ["meterId", "amount", "unit"], _order())
    return _rows(wide, "functions", "compute.function", F.lit("x86_64"), literal_terms(commitment="on_demand"),
                 F.array(*(price(d, F.col(f"{d}.amount"), F.col(f"{d}.unit")) for d in dims)),
                 F.concat_ws("::", joined_id(*(F.col(f"{d}.meterId") for d in dims)), "region"),
                 resource_attrs=attrs(architecture=F.lit("x86_64"), extra=json_object(plan="consumption")))


def cosmosdb(items: DataFrame) -> DataFrame:
    meter, lower = _text("meterName"), F.lower(_text("meterName"))
    mode = first_case([
        (lower.contains("serverless") & lower.contains("request"), "serverless"),
        (lower.contains("storage"), "storage"), (lower.contains("ru/s"), "provisioned")])
    df = _paid(items, strict_type=False).filter((F.col("region") != "") & (F.col("usd") > 0)).withColumns({
        "mode": mode, "api": keyword_class(F.lower(_text("productName")), COSMOS_APIS, "sql")})
    df = with_region_group(df.filter("mode IS NOT NULL"), PROVIDER)
    df = df.withColumn("amount", F.when((F.col("mode") == "provisioned") & lower.contains("100 ru/s"),
                                        F.col("usd") / 100.0).otherwise(F.col("usd")))
    mode, api, amount = F.col("mode"), F.col("api"), F.col("amount")
    extra = (F.when(mode == "storage", json_object(capacity_mode=mode, kind="storage", gb_month_usd=amount,
                                                   upstream_meter=meter))
             .when(mode == "serverless", json_object(capacity_mode=mode, api=api, ru_million_usd=amount,
                                                     upstream_meter=meter))
             .otherwise(json_object(capacity_mode=mode, api=api, ru_per_sec_hour_usd=amount, upstream_meter=meter)))
    return _rows(df, "cosmosdb", "db.nosql", F.concat(F.lit("cosmos-"), mode),
                 literal_terms(commitment="on_demand", tenancy=api, os=mode),
                 F.array(price(mode, amount, F.lower(_text("unitOfMeasure")))),
                 _sku_or("cosmosdb-", mode, "-", api, "-", F.col("region")), resource_attrs=attrs(extra=extra))


def redis(items: DataFrame) -> DataFrame:
    """Cache sizes; upstream ids that collide get the meter name and a number."""
    tiers = "(Basic|Standard|Premium|Enterprise)"
    product = F.regexp_extract(F.trim(_text("productName")), f"(?i)^Azure Redis Cache {tiers}$", 1)
    meter = F.trim(_text("meterName"))
    by_meter = f"(?i)^{tiers}\\s+([CPE]\\d+)"
    tier = F.lower(F.when(product != "", product).otherwise(F.regexp_extract(meter, by_meter, 1)))
    size = F.upper(F.when(product != "", F.trim(_text("skuName"))).otherwise(F.regexp_extract(meter, by_meter, 2)))
    memory = mapped(F.concat_ws(" ", "tier", "size"),
                    {f"{t} {s}": gb for t, sizes in REDIS_MEMORY_GB.items() for s, gb in sizes.items()})
    df = _paid(items, strict_type=False).withColumns({"tier": tier, "size": size, "by_product": product != ""})
    df = df.withColumn("memory_gb", memory).filter(
        (F.col("tier") != "") & (~F.col("by_product") | F.col("memory_gb").isNotNull())
        & (F.col("region") != "") & (F.col("usd") > 0))
    df = _divided(with_region_group(df, PROVIDER), "hour").withColumn(
        "sku_id", _sku_or("redis-", F.col("tier"), "-", F.col("size"), "-", F.col("region")))
    label = F.nullif(F.trim(F.regexp_replace(F.lower(_text("meterName")), "[^a-z0-9]+", "-"), F.lit("-")), F.lit(""))
    df = df.withColumns({"_label": F.coalesce(label, F.lit("meter")), "_order": _order()})
    df = suffix_collisions(df, "sku_id", "_label", "_order", F.struct("file", F.floor(F.col("pos") / 65536)))
    tier = F.col("tier")
    return _rows(df, "redis", "cache.kv", F.concat_ws(" ", F.initcap(tier), "size"),
                 literal_terms(commitment="on_demand", tenancy="redis", os=tier),
                 F.array(price("compute", F.col("amount"), F.col("unit"))), F.col("sku_id"),
                 resource_attrs=attrs(memory_gb=F.col("memory_gb"), extra=json_object(
                     engine="redis", tier=tier, upstream_meter=_text("meterName"))))


def aks(items: DataFrame, container_items: DataFrame | None = None) -> DataFrame:
    """Cluster tiers, a free tier wherever there is a standard one, and virtual nodes from a second feed."""
    def cluster(df: DataFrame, tier: Column, amount: Column) -> DataFrame:
        return _rows(df, "aks", "container.orchestration", F.concat(F.lit("aks-"), tier),
                     literal_terms(commitment="on_demand", tenancy="kubernetes", os=tier),
                     F.array(price("cluster", amount, "hour")),
                     F.concat_ws("-", F.lit("azure-aks"), tier, "region"),
                     resource_attrs=attrs(extra=json_object(mode="control-plane", tier=tier)))
    df = _paid(items).filter((F.col("productName") == "Azure Kubernetes Service") & (F.col("region") != "")
                             ).withColumn("tier", mapped(_text("meterName"), AKS_METERS)).filter("tier IS NOT NULL")
    df = with_region_group(df, PROVIDER)
    free = df.filter("tier = 'standard'").select("region", "region_normalized").distinct()
    out = cluster(df, F.col("tier"), F.col("usd")).unionByName(cluster(free, F.lit("free"), F.lit(0.0)))
    if container_items is None:
        return out
    meter = _text("meterName")
    memory, vcpu = meter.contains("Memory"), meter.contains("vCPU")
    nodes = container_items.withColumn("type", F.coalesce("type", F.lit("Consumption")))
    nodes = _paid(nodes).filter(
        (F.col("productName") == "Container Instances") & (F.col("skuName") == "Standard")
        & (F.col("region") != "")).withColumn("dimension", first_case([
            (vcpu & ~memory & (F.col("unitOfMeasure") == "1 Hour"), "vcpu"),
            (memory & (F.col("unitOfMeasure") == "1 GB Hour"), "memory")])).filter("dimension IS NOT NULL")
    wide = pivot_dimensions(with_region_group(nodes, PROVIDER), ["region", "region_normalized"], ["vcpu", "memory"],
                            ["usd"], _order())
    return out.unionByName(_rows(
        wide, "aks", "container.orchestration", F.lit("aks-virtual-nodes-linux"),
        literal_terms(commitment="on_demand", tenancy="kubernetes", os="virtual-nodes"),
        F.array(price("vcpu", F.col("vcpu.usd"), "hour"), price("memory", F.col("memory.usd"), "gb-hour")),
        F.concat(F.lit("azure-aks-vn-linux-"), F.col("region")),
        resource_attrs=attrs(extra=json_object(mode="virtual-nodes", aci_os="linux"))))


def appservice(items: DataFrame) -> DataFrame:
    product, meter = _text("productName"), _text("meterName")
    raw = F.coalesce(F.nullif(F.regexp_extract(_text("skuName"), PLAN_PATTERN, 1), F.lit("")),
                     F.regexp_extract(meter, PLAN_PATTERN, 1))
    plan = F.regexp_replace(F.regexp_replace(F.upper(raw), " ", ""), r"^([PI]\d)V(\d)$", "$1v$2")
    named_os = r"(?i)\b(Linux|Windows)\b"
    os = F.coalesce(*(F.nullif(F.lower(F.regexp_extract(t, named_os, 1)), F.lit("")) for t in (product, meter)),
                    F.lit("linux"))
    df = _divided(_paid(items, strict_type=False).filter(F.col("region") != ""), "hour").filter("amount > 0")
    df = df.withColumns({"plan": plan, "os": os, "tier": keyword_class(F.lower(product), PLAN_TIERS)})
    df = with_region_group(df.filter("plan <> '' AND tier IS NOT NULL"), PROVIDER)
    plan, os, tier = F.col("plan"), F.col("os"), F.col("tier")
    vcpu = mapped(plan, {k: v for k, (v, _) in PLAN_SPECS.items()})
    extra = F.when(vcpu.isNotNull(), json_object(tier=tier, os=os)).otherwise(
        json_object(tier=tier, os=os, unknown_sku=F.lit(True)))
    return _rows(df, "appservice", "paas.app", plan,
                 literal_terms(commitment="on_demand", tenancy="dedicated", os=os, support_tier=tier),
                 F.array(price("instance", F.col("amount"), F.col("unit"))),
                 _sku_or("appservice-", plan, "-", os, "-", F.col("region")),
                 resource_attrs=attrs(vcpu=vcpu, memory_gb=mapped(plan, {k: m for k, (_, m) in PLAN_SPECS.items()}),
                                      extra=extra))


def apim(items: DataFrame) -> DataFrame:
    """Gateway units by hour, and consumption calls with a free first million at the dearest paid rate."""
    sku = F.lower(F.trim(_text("skuName")))
    df = _paid(items, "API Management", strict_type=False).withColumn("name", mapped(sku, APIM_SKUS)).filter(
        "name IS NOT NULL AND region <> ''")
    df = with_region_group(df, PROVIDER)
    fallback = F.concat(F.lit("APIM-"), F.upper("name"), F.lit("-"), F.col("region"))
    df = df.withColumn("sku_id", F.coalesce(F.nullif("skuId", F.lit("")), fallback))
    keys = ["region", "region_normalized", "name"]
    calls = df.filter("name = 'consumption' AND unitOfMeasure = '10K' AND usd > 0").groupBy(*keys).agg(
        # The dearest wins, the first one among equals.
        F.min_by(F.struct("sku_id", "usd"), F.struct((-F.col("usd")).alias("d"), "file", "pos")).alias("m"))
    hourly = F.when(F.col("unitOfMeasure") == "1 Hour", 0).otherwise(1)
    units = df.filter("name <> 'consumption'").groupBy(*keys).agg(
        F.min_by(F.struct("sku_id", "usd"), F.struct(hourly.alias("h"), "file", "pos")).alias("m")).filter("m.usd > 0")

    def gateway(frame: DataFrame, mode: str, prices: Column) -> DataFrame:
        return _rows(frame, "apim", "api.gateway", F.col("name"), literal_terms(commitment="on_demand"), prices,
                     F.col("m.sku_id"), resource_attrs=attrs(extra=json_object(mode=mode)))
    return gateway(calls, "consumption", F.array(
        price("call", F.lit(0.0), "request", "0", "1M"),
        price("call", F.col("m.usd") / 10_000.0, "request", "1M", ""))).unionByName(
        gateway(units, "provisioned", F.array(price("unit_hour", F.col("m.usd"), "hr", "0", ""))))


def service_bus(items: DataFrame, service: str, kind: str, prefix: str) -> DataFrame:
    """A free tier plus exactly three paid ones, dearest first; regions with another count are dropped."""
    df = with_region_group(_paid(items, "Service Bus", strict_type=False).filter("region <> ''"), PROVIDER)
    keys = ["region", "region_normalized"]
    ops = _divided(df.filter("skuName = 'Standard' AND meterName = 'Standard Messaging Operations' AND usd > 0"),
                   "request")
    # Count before gathering, so a region with many meters is dropped without being collected.
    complete = ops.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(BUS_TOKENS))
    tiers = ops.join(F.broadcast(complete), keys, "left_semi").groupBy(*keys).agg(
        F.sort_array(F.collect_list("amount"), asc=False).alias("amounts"))
    free = F.array(price("request", F.lit(0.0), "request", "0", "13M"))
    standard = _rows(tiers, service, kind, F.lit("standard"), literal_terms(commitment="on_demand"),
                     F.concat(free, zipped_tiers(F.col("amounts"), "request", "request", BUS_TOKENS)),
                     F.concat(F.lit(prefix + "-STD-"), F.col("region")),
                     resource_attrs=attrs(extra=json_object(mode="standard")))
    units = first_per(_divided(df.filter("skuName = 'Premium' AND meterName = 'Premium Messaging Unit'"), "hour")
                      .select(*keys, "file", "pos", "amount"), keys, _order())
    premium = _rows(units, service, kind, F.lit("premium"), literal_terms(commitment="on_demand"),
                    F.array(price("mu_hour", F.col("amount"), "hr", "0", "")),
                    F.concat(F.lit(prefix + "-PREM-"), F.col("region")),
                    resource_attrs=attrs(extra=json_object(mode="premium")))
    return standard.unionByName(premium)


def event_hubs(items: DataFrame) -> DataFrame:
    sku = _text("skuName")
    df = _paid(items, "Event Hubs", strict_type=False).filter("region <> '' AND usd > 0").withColumn(
        "dimension", mapped(_text("meterName"), EVENT_METERS))
    standard, premium = sku.contains("Standard"), ~sku.contains("Standard") & sku.contains("Premium")
    df = df.filter((standard & F.col("dimension").isin("tu", "event")) | (premium & (F.col("dimension") == "ppu")))
    unit = F.when(F.col("dimension") == "event", canonical_unit(F.col("unitOfMeasure"), "request")).otherwise(
        canonical_unit(F.col("unitOfMeasure"), "hour"))
    df = with_region_group(df.withColumn("_u", unit).filter("_u IS NOT NULL"), PROVIDER).withColumn(
        "amount", F.col("usd") / F.col("_u.divisor"))
    keys = ["region", "region_normalized"]

    def tier(required: list[str], name: str, prefix: str, prices: Column) -> DataFrame:
        wide = pivot_dimensions(df, keys, required, ["amount"], _order())
        return _rows(wide, "event-hubs", "messaging.queue", F.lit(name), literal_terms(commitment="on_demand"),
                     prices, F.concat(F.lit(prefix), F.col("region")),
                     resource_attrs=attrs(extra=json_object(mode=name)))
    return tier(["tu", "event"], "standard", "EH-STD-", F.array(
        price("tu_hour", F.col("tu.amount"), "hr", "0", ""),
        price("event", F.col("event.amount"), "request", "0", ""))).unionByName(
        tier(["ppu"], "premium", "EH-PREM-", F.array(price("ppu_hour", F.col("ppu.amount"), "hr", "0", ""))))


def front_door(items: DataFrame) -> DataFrame:
    """Base fee, egress tiers and requests of two plans. Zones stand for region groups, so a row's region is one."""
    meter, plan = F.lower(_text("meterName")), F.trim(_text("skuName"))
    mode = first_case([(meter.contains("base fee"), "base-fee"), (meter.contains("data transfer out"), "edge-egress"),
                       (meter.contains("request"), "request")])
    df = _paid(items, strict_type=False).withColumns({"plan": plan, "mode": mode, "zone": F.col("region")}).filter(
        (F.trim(_text("productName")) == "Azure Front Door") & F.col("plan").isin("Standard", "Premium")
        & F.col("mode").isNotNull() & (F.col("usd") > 0))
    df = df.withColumn("base_id", F.coalesce(F.nullif("skuId", F.lit("")), F.concat(F.lit("afd-"), F.lower("plan"))))
    mode, slug = F.col("mode"), F.concat(F.lit("front-door-"), F.lower("plan"))
    minimum = F.coalesce("tierMinimumUnits", F.lit(0.0))

    def rows(frame: DataFrame, extra: Column, prices: Column, sku_id: Column) -> DataFrame:
        return _rows(frame, "front-door", "network.cdn", F.lower("plan"), literal_terms(commitment="on_demand"),
                     prices, sku_id, resource_attrs=attrs(extra=extra))
    fee = first_per(df.filter(mode == "base-fee").select("plan", "file", "pos", "base_id", "usd", "unitOfMeasure"),
                    ["plan"], _order()).withColumn("_u", canonical_unit(F.col("unitOfMeasure"), "storage"))
    fee = fee.withColumns({"region": F.lit("global"), "region_normalized": F.lit("global")})
    base = rows(fee, json_object(sku=slug, mode="base-fee"), F.array(price(
        "fee", F.col("usd") / F.coalesce("_u.divisor", F.lit(1.0)), F.coalesce("_u.unit", F.lit("month")), "0", "")),
        F.concat(F.col("base_id"), F.lit(":base-fee:global")))
    zoned = df.filter(mode != "base-fee").withColumn("region", mapped(F.col("zone"), EDGE_ZONES)).filter(
        "region IS NOT NULL")
    zoned = with_region_group(zoned, PROVIDER).withColumn("region", F.col("region_normalized")).withColumn("lo", minimum)
    keys = ["plan", "zone", "region", "region_normalized"]
    # Only the first seven tiers count; the rank limit keeps a hot zone from being gathered.
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("lo", "file", "pos"))
    egress = zoned.filter(mode == "edge-egress").withColumn("_r", rank).filter(F.col("_r") <= len(EDGE_TOKENS))
    egress = egress.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_r", "usd"))).alias("t"), F.min_by("base_id", "_r").alias("base_id"))
    request = first_per(zoned.filter(mode == "request").select(*keys, "lo", "file", "pos", "base_id", "usd",
                                                               "unitOfMeasure"), keys, F.struct("lo", "file", "pos"))
    request = request.withColumn("_u", canonical_unit(F.col("unitOfMeasure"), "request"))
    return base.unionByName(rows(
        egress, json_object(sku=slug, mode="edge-egress", billing_zone=F.col("zone")),
        zipped_tiers(F.col("t.usd"), "egress", "gb", EDGE_TOKENS),
        F.concat_ws(":", "base_id", F.lit("edge-egress"), "zone"))).unionByName(rows(
            request, json_object(sku=slug, mode="request", billing_zone=F.col("zone")),
            F.array(price("request", F.col("usd") / F.coalesce("_u.divisor", F.lit(10_000.0)), "requests", "0", "")),
            F.concat_ws(":", "base_id", F.lit("request"), "zone")))


JOBS = {
    "azure_vm": vm, "azure_blob": blob, "azure_disks": disks, "azure_functions": functions,
    "azure_cosmosdb": cosmosdb, "azure_redis": redis, "azure_aks": aks, "azure_appservice": appservice,
    "azure_apim": apim, "azure_event_hubs": event_hubs, "azure_front_door": front_door,
    "azure_service_bus_queues": lambda items: service_bus(items, "service-bus-queues", "messaging.queue", "SB"),
    "azure_service_bus_topics": lambda items: service_bus(items, "service-bus-topics", "messaging.topic", "SBT"),
    **{job: (lambda items, a=args: hosted_database(items, *a)) for job, args in HOSTED_DATABASES.items()},
}
