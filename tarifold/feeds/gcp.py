"""Feed jobs over billing catalogs. Each takes the flat frame of `sources.documents.billing_skus`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tarifold import vocab
from tarifold.feeds.ops import first_per, last_per, pivot_dimensions, with_region_group, zipped_tiers
from tarifold.functions.cases import first_case, keyword_class, mapped
from tarifold.functions.numbers import canonical_unit, leading_number, units_nanos
from tarifold.functions.terms import literal_terms
from tarifold.operators.rows import attrs, json_object, normalized_rows, price

PROVIDER = "gcp"

# Price prefixes of machine families, and names in the billing catalog.
FAMILY_PREFIXES: dict[str, tuple[str, str]] = {
    "n1": ("N1 Predefined Instance Core", "N1 Predefined Instance Ram"),
    "n2": ("N2 Instance Core", "N2 Instance Ram"),
    "n2d": ("N2D AMD Instance Core", "N2D AMD Instance Ram"),
    "n4": ("N4 Instance Core", "N4 Instance Ram"),
    "e2": ("E2 Instance Core", "E2 Instance Ram"),
    "c2": ("Compute optimized Core", "Compute optimized Ram"),
    "c2d": ("C2D AMD Instance Core", "C2D AMD Instance Ram"),
    "c3": ("C3 Instance Core", "C3 Instance Ram"),
    "c3d": ("C3D AMD Instance Core", "C3D AMD Instance Ram"),
    "c4": ("C4 Instance Core", "C4 Instance Ram"),
    "t2a": ("T2A Arm Instance Core", "T2A Arm Instance Ram"),
    "t2d": ("T2D AMD Instance Core", "T2D AMD Instance Ram"),
    "m1": ("Memory-optimized Instance Core", "Memory-optimized Instance Ram"),
    "m2": ("M2 Memory-optimized Instance Core", "M2 Memory-optimized Instance Ram"),
    "m3": ("M3 Memory-optimized Instance Core", "M3 Memory-optimized Instance Ram"),
}
SQL_ENGINES = (("PostgreSQL", "cloud-sql-postgres"), ("MySQL", "cloud-sql-mysql"),
               ("SQL Server", "cloud-sql-sqlserver"))
SQL_DEPLOYMENTS = (("Regional", "regional"), ("Zonal", "zonal"))
SPANNER_EDITIONS = (("enterprise plus", "enterprise-plus"), ("enterprise", "enterprise"), ("standard", "standard"))
GCS_CLASSES = {"RegionalStorage": "standard", "StandardStorage": "standard", "NearlineStorage": "nearline",
               "ColdlineStorage": "coldline", "ArchiveStorage": "archive"}
GCS_OPS = {"RegionalOps": "standard", "NearlineOps": "nearline", "ColdlineOps": "coldline", "ArchiveOps": "archive"}
GCS_AVAILABILITY = {"standard": "standard", "nearline": "infrequent", "coldline": "cold", "archive": "archive"}
FUNCTIONS_EXCLUDED = ("Min-Instance", "Min Instance", "Tier 2", "Commitment", r"\(1st Gen\)")
RUN_EXCLUDED = (*FUNCTIONS_EXCLUDED, "Worker Pools", "Jobs CPU", "Jobs Memory")
MEMORY_TIERS = {"1": 5.0, "2": 10.0, "3": 16.0, "4": 64.0, "5": 128.0}
GKE_REGIONAL_SKU = "B561-BFBD-1264"
GKE_DEFAULT_PRICE = 0.10
WAREHOUSE_EXCLUDED = "batch|bi engine|legacy|flat rate|streaming|dml"
FIRESTORE_GROUPS = {"FirestoreEntityPutOps": "document_write", "FirestoreEntityDeleteOps": "document_delete",
                    "FirestoreReadOps": "document_read", "FirestoreStorage": "storage"}
FIRESTORE_REGIONS = {"North America": "us-east1", "Europe": "europe-west1", "Asia": "asia-northeast1",
                     "South America": "southamerica-east1"}
CDN_REGIONS = {"North America": "us-east1", "Europe": "europe-west1", "Asia": "asia-northeast1",
               "Latin America": "southamerica-east1", "Oceania": "australia-southeast1", "Other": "us-east1",
               "China": "asia-east1"}
CDN_EGRESS_PREFIX = "Networking Cloud CDN Traffic Cache Data Transfer to "
CDN_TOKENS = ("0", "10TB", "150TB", "1PB")
DNS_ZONE_TOKENS = ("0", "25", "10K")
DNS_QUERY_TOKENS = ("0", "1B")


def _order() -> Column:
    return F.struct("file", "pos")


def _amount(rate: Column) -> Column:
    return units_nanos(F.coalesce(rate["unitPrice"]["units"], F.lit("0")),
                       F.coalesce(rate["unitPrice"]["nanos"], F.lit(0)))


def _first_rate(skus: DataFrame, strict_usage: bool = False) -> DataFrame:
    """On-demand dollar entries with the amount of their first rate and their first region."""
    rate = F.get("rates", F.lit(0))
    usage, currency = F.col("usageType"), rate["unitPrice"]["currencyCode"]
    if not strict_usage:
        usage, currency = F.coalesce(usage, F.lit("OnDemand")), F.coalesce(currency, F.lit("USD"))
    return skus.filter(rate.isNotNull() & (usage == "OnDemand") & (currency == "USD")).withColumns(
        {"amount": _amount(rate), "region": F.get("serviceRegions", F.lit(0))})


def _per_unit(df: DataFrame) -> DataFrame:
    """Amount per canonical unit; entries in an unknown usage unit are dropped."""
    df = df.withColumn("_u", canonical_unit(F.col("usage_unit"), "usage")).filter("_u IS NOT NULL")
    return df.withColumns({"amount": F.col("amount") / F.col("_u.divisor"), "unit": F.col("_u.unit")})


def _rates_ascending(rates: Column) -> Column:
    """Amounts of all rates by rising start of usage."""
    return F.transform(F.array_sort(F.transform(rates, lambda r, i: F.struct(
        F.coalesce(r["startUsageAmount"], F.lit(0.0)).alias("lo"), i.alias("i"), _amount(r).alias("amount")))),
        lambda r: r["amount"])


def _rows(df: DataFrame, service: str, kind: str, name: Column, terms: Column, prices: Column, sku_id: Column,
          **extra) -> DataFrame:
    return normalized_rows(df, provider=PROVIDER, service=service, kind=kind, sku_id=sku_id, resource_name=name,
                           region=F.col("region"), region_normalized=F.col("region_normalized"), terms=terms,
                           prices=prices, **extra)


def _global(df: DataFrame) -> DataFrame:
    return df.withColumns({"region": F.lit("global"), "region_normalized": F.lit("global")})


def machine_specs(machines: DataFrame) -> DataFrame:
    """(name, vcpu, ram_gib, cpu_prefix, ram_prefix); GPU, custom and sole-tenant shapes are left out, the first zone
    of a name wins, and an unknown family is an error."""
    kept = machines.filter((F.col("n_accelerators") <= 0) & ~F.col("name").startswith("custom-")
                           & ~F.col("name").contains("-sole-tenant-")).dropDuplicates(["name"])
    fam = F.substring_index("name", "-", 1)

    def prefix(i: int) -> Column:
        return F.coalesce(mapped(fam, {k: p[i] for k, p in FAMILY_PREFIXES.items()}), F.raise_error(
            F.concat(F.lit("unknown machine family: "), F.col("name"))).cast("string"))
    return kept.select("name", "vcpu", (F.col("memory_mb") / 1024.0).alias("ram_gib"), prefix(0).alias("cpu_prefix"),
                       prefix(1).alias("ram_prefix"))


def gce(skus: DataFrame, machines: DataFrame) -> DataFrame:
    """Machine price = cores x core price + memory x memory price, per region that has both."""
    df = _first_rate(skus, strict_usage=True).filter(
        "serviceDisplayName = 'Compute Engine' AND resourceFamily = 'Compute' AND region IS NOT NULL")
    df = _per_unit(df)

    def priced(i: int, unit: str, name: str) -> DataFrame:
        prefix = first_case((F.col("description").startswith(p[i]), p[i]) for p in FAMILY_PREFIXES.values())
        hit = df.withColumn(name, prefix).filter(F.col(name).isNotNull() & (F.col("unit") == unit))
        return last_per(hit.select("region", name, "file", "pos", "sku_id", "amount"), ["region", name], _order())
    cpu = priced(0, "hrs", "cpu_prefix").select("region", "cpu_prefix", "sku_id", F.col("amount").alias("cpu"))
    ram = priced(1, "gb-hr", "ram_prefix").select("region", "ram_prefix", F.col("amount").alias("ram"))
    both = machine_specs(machines).join(cpu, "cpu_prefix").join(ram, ["region", "ram_prefix"])
    amount = F.col("vcpu") * F.col("cpu") + F.col("ram_gib") * F.col("ram")
    return _rows(with_region_group(both, PROVIDER), "gce", "compute.vm", F.col("name"),
                 literal_terms(commitment="on_demand", tenancy="shared", os="linux"),
                 F.array(price("compute", amount, "hrs")), F.concat_ws(":", "sku_id", "name"),
                 resource_attrs=attrs(architecture=F.lit("x86_64"), extra=json_object(
                     vcpu=F.col("vcpu"), ram_gib=F.col("ram_gib"), cpu_desc_prefix=F.col("cpu_prefix"))))


def cloud_sql(skus: DataFrame) -> DataFrame:
    shape = r"(\d+)\s*vCPU\s*\+\s*(\d+(?:\.\d+)?)GB\s*RAM"
    text = F.col("description")
    df = _first_rate(skus, strict_usage=True).filter(
        "serviceDisplayName = 'Cloud SQL' AND resourceFamily = 'ApplicationServices' AND region IS NOT NULL")
    df = df.withColumns({"engine": keyword_class(text, SQL_ENGINES), "deployment": keyword_class(text, SQL_DEPLOYMENTS),
                         "vcpu": F.regexp_extract(text, shape, 1),
                         "ram_mb": (leading_number(text, shape, 2) * 1024).cast("bigint")})
    df = _per_unit(with_region_group(
        df.filter("engine IS NOT NULL AND deployment IS NOT NULL AND vcpu <> ''"), PROVIDER))
    return _rows(df, "cloud-sql", "db.relational", F.concat_ws("-", F.lit("db-custom"), "vcpu", "ram_mb"),
                 literal_terms(commitment="on_demand", tenancy=F.col("engine"), os=F.col("deployment")),
                 F.array(price("compute", F.col("amount"), F.col("unit"))), F.col("sku_id"),
                 resource_attrs=attrs(extra=json_object(description=text, engine=F.col("engine"),
                                                        deployment_option=F.col("deployment"))))


def spanner(skus: DataFrame) -> DataFrame:
    text = F.coalesce("description", F.lit(""))
    storage = text.rlike("(?i)ssd") & text.rlike("(?i)storage")
    name = F.when(storage, "storage").otherwise(keyword_class(F.lower(text), SPANNER_EDITIONS))
    df = with_region_group(_first_rate(skus).withColumn("edition", name).filter(
        "edition IS NOT NULL AND region IS NOT NULL"), PROVIDER)
    amount, edition = F.col("amount"), F.col("edition")
    is_storage = edition == "storage"
    extra = F.when(is_storage, json_object(description=text, kind="storage", ssd_gb_month_usd=amount)).otherwise(
        json_object(description=text, edition=edition, pu_hour_usd=amount, node_hour_usd=amount * 1000))
    full = F.concat(F.lit("spanner-"), edition)
    return _rows(df, "spanner", "db.relational", full, literal_terms(commitment="on_demand", tenancy=full),
                 F.array(price(F.when(is_storage, "storage").otherwise("compute"), amount,
                               F.when(is_storage, "gb-month").otherwise("pu-hour"))), F.col("sku_id"),
                 resource_attrs=attrs(extra=extra))


def gcs(skus: DataFrame) -> DataFrame:
    """Storage classes; operation prices sold globally fill every region of their class that lacks its own.

    Class A operations are published as read-ops and class B as write-ops, as the catalog has it.
    """
    text = F.lower("description")
    dimension = first_case([(text.contains("class a operations"), "read-ops"),
                            (text.contains("class b operations"), "write-ops")], "storage")
    df = _first_rate(skus, strict_usage=True).filter(
        "serviceDisplayName = 'Cloud Storage' AND region IS NOT NULL").withColumns({
            "dimension": dimension, "ops_class": mapped(F.col("resourceGroup"), GCS_OPS),
            "klass": mapped(F.col("resourceGroup"), GCS_CLASSES)})
    df = _per_unit(df)
    shared = df.filter("ops_class IS NOT NULL AND region = 'global' AND dimension <> 'storage'").filter(
        F.col("description").contains("Regional"))
    shared = pivot_dimensions(shared, ["ops_class"], [], ["amount", "unit"], _order(),
                              optional=("read-ops", "write-ops")).select(
        F.col("ops_class").alias("klass"), F.col("`read-ops`").alias("shared_read"),
        F.col("`write-ops`").alias("shared_write"))
    own = with_region_group(df.filter("klass IS NOT NULL"), PROVIDER)
    wide = pivot_dimensions(own, ["klass", "region", "region_normalized"], ["storage"],
                            ["amount", "unit", "sku_id", "description", "resourceGroup"], _order(),
                            optional=("read-ops", "write-ops"))

    def bare(name: str) -> Column:
        c = F.col(f"`{name}`")
        return F.when(c.isNotNull(), F.struct(c["amount"].alias("amount"), c["unit"].alias("unit")))
    # One row per storage class, so the right side is as small as the class vocabulary.
    wide = wide.join(F.broadcast(shared), "klass", "left").withColumns({
        "r": F.coalesce(bare("read-ops"), "shared_read"), "w": F.coalesce(bare("write-ops"), "shared_write")})
    wide = wide.filter("r IS NOT NULL AND w IS NOT NULL")
    return _rows(wide, "gcs", "storage.object", F.col("klass"), literal_terms(commitment="on_demand"), F.array(
        price("storage", F.col("storage.amount"), F.col("storage.unit")),
        price("read-ops", F.col("r.amount"), F.col("r.unit")), price("write-ops", F.col("w.amount"), F.col("w.unit"))),
        F.col("storage.sku_id"), resource_attrs=attrs(
            durability_nines=F.lit(11), availability_tier=mapped(F.col("klass"), GCS_AVAILABILITY),
            extra=json_object(description=F.col("storage.description"), resource_group=F.col("storage.resourceGroup"))))


def serverless(skus: DataFrame, service: str, display: str, request_text: str, excluded: tuple[str, ...],
               group: str = "Compute") -> DataFrame:
    """Processor and memory seconds per region; the global request price fills regions without their own."""
    text, lower = F.col("description"), F.lower("description")
    dimension = first_case([
        ((F.col("usage_unit") == "count") | text.rlike(request_text), "requests"),
        (text.rlike("|".join(excluded)), None),
        (lower.contains("cpu") | lower.contains("core"), "cpu-second"),
        (lower.contains("memory"), "memory-gb-second")])
    df = _first_rate(skus, strict_usage=True).filter(
        (F.col("serviceDisplayName") == display) & (F.col("resourceGroup") == group) & F.col("region").isNotNull())
    df = _per_unit(df.withColumn("dimension", dimension).filter("dimension IS NOT NULL")).filter(
        "dimension <> 'requests' OR amount <> 0")
    shared = df.filter("region = 'global' AND dimension = 'requests'").groupBy().agg(
        F.max_by(F.struct("amount", "unit"), _order()).alias("shared"))
    wide = pivot_dimensions(with_region_group(df, PROVIDER), ["region", "region_normalized"],
                            ["cpu-second", "memory-gb-second"], ["amount", "unit", "sku_id", "description"], _order(),
                            optional=("requests",))
    own = F.col("requests")
    # The right side is one row: the latest global request price, or null.
    wide = wide.withColumn("_one", F.lit(1)).join(F.broadcast(shared.withColumn("_one", F.lit(1))), "_one", "left")
    request = F.coalesce(F.when(own.isNotNull(), F.struct(own["amount"].alias("amount"), own["unit"].alias("unit"))),
                         F.col("shared"))
    wide = wide.withColumn("q", request)
    both = [price(d, F.col(f"`{d}`.amount"), F.col(f"`{d}`.unit")) for d in ("cpu-second", "memory-gb-second")]
    with_requests = F.array(*both, price("requests", F.col("q.amount"), F.col("q.unit")))
    return _rows(wide, service, "compute.function", F.lit("x86_64"), literal_terms(commitment="on_demand"),
                 F.when(F.col("q").isNotNull(), with_requests).otherwise(F.array(*both)),
                 F.col("`cpu-second`.sku_id"), resource_attrs=attrs(architecture=F.lit("x86_64"), extra=json_object(
                     description=F.col("`cpu-second`.description"), resource_group=group)))


def memorystore(skus: DataFrame) -> DataFrame:
    """One row per listed region; the id carries the region only when there are several."""
    text, display = F.coalesce("description", F.lit("")), F.lower(F.coalesce("serviceDisplayName", F.lit("")))
    engine = first_case([(display.contains("redis"), "redis"), (display.contains("memcached"), "memcached")])
    memory = F.coalesce(
        leading_number(text, r"(?i)(\d+(?:\.\d+)?)\s*GB"),
        F.when(~text.rlike(r"(?i)\bCustom\s+Core\b"), F.when(text.rlike(r"(?i)\bCustom\s+RAM\b"), 1.0).otherwise(
            mapped(F.regexp_extract(text, r"(?i)\bM([1-5])\b", 1), MEMORY_TIERS))))
    tier = F.coalesce(F.nullif(F.lower(F.regexp_extract(text, r"(?i)\b(basic|standard)\b", 1)), F.lit("")),
                      F.lit("standard"))
    df = _first_rate(skus).withColumns({"engine": engine, "memory_gb": memory, "tier": tier}).filter(
        "engine IS NOT NULL AND memory_gb IS NOT NULL AND amount > 0")
    name = F.concat(F.lit("memorystore-"), F.col("engine"), F.lit("-"), F.col("tier"), F.lit("-"),
                    F.col("memory_gb").cast("bigint"), F.lit("gb"))
    df = df.withColumns({"name": name, "several": F.size("serviceRegions") > 1,
                         "base_id": F.coalesce("sku_id", name)})
    df = with_region_group(df.drop("region").withColumn("region", F.explode("serviceRegions")), PROVIDER)
    return _rows(df, "memorystore", "cache.kv", F.col("name"),
                 literal_terms(commitment="on_demand", tenancy=F.col("engine")),
                 F.array(price("compute", F.col("amount"), "hour")),
                 F.when(F.col("several"), F.concat_ws("-", "base_id", "region")).otherwise(F.col("base_id")),
                 resource_attrs=attrs(memory_gb=F.col("memory_gb"), extra=json_object(
                     engine=F.col("engine"), tier=F.col("tier"))))


def gke(skus: DataFrame) -> DataFrame:
    """A control-plane row for every tracked region, at the upstream or the default price, plus autopilot rows."""
    amount = F.coalesce(_amount(F.get("rates", F.lit(0))), F.lit(0.0))
    df = skus.withColumn("amount", amount)
    regional = (F.col("sku_id") == GKE_REGIONAL_SKU) & (F.col("amount") > 0)
    listed = F.array(*(F.struct(F.lit(r).alias("region"), F.lit(g).alias("region_normalized"))
                       for p, r, g in vocab.region_rows() if p == PROVIDER))
    plane = df.groupBy().agg(F.max_by(F.when(regional, F.col("amount")), F.when(regional, _order())).alias("seen"))
    plane = plane.select("seen", F.inline(listed))
    base = {"tier": "standard", "mode": "control-plane"}
    out = _rows(plane, "gke", "container.orchestration", F.lit("gke-standard"),
                literal_terms(commitment="on_demand", tenancy="kubernetes", os="standard"),
                F.array(price("cluster", F.coalesce("seen", F.lit(GKE_DEFAULT_PRICE)), "hr")),
                F.concat(F.lit(GKE_REGIONAL_SKU + "-"), F.col("region")), resource_attrs=attrs(
                    extra=F.when(F.col("seen").isNotNull(), json_object(**base)).otherwise(
                        json_object(**base, price_source="default_fallback"))))
    text = F.coalesce("description", F.lit(""))
    part = first_case([(text.contains("Autopilot Pod mCPU Requests") & ~text.rlike("Committed|Commitment"), "vcpu"),
                       (text.contains("Autopilot Pod Memory Requests"), "memory"),
                       (text.contains("Autopilot Pod Ephemeral Storage Requests"), "storage")])
    pods = df.filter(~text.rlike("Spot|Arm") & (F.col("sku_id") != GKE_REGIONAL_SKU)).withColumn(
        "dimension", part).filter("dimension IS NOT NULL").withColumn("region", F.explode("serviceRegions"))
    dims = {"vcpu": "milliCPU-hr", "memory": "GiBy-hr", "storage": "GiBy-hr"}
    wide = pivot_dimensions(with_region_group(pods, PROVIDER), ["region", "region_normalized"], list(dims), ["amount"],
                            _order())
    return out.unionByName(_rows(
        wide, "gke", "container.orchestration", F.lit("gke-autopilot"),
        literal_terms(commitment="on_demand", tenancy="kubernetes", os="autopilot"),
        F.array(*(price(d, F.col(f"{d}.amount"), u) for d, u in dims.items())),
        F.concat(F.lit("gke-autopilot-"), F.col("region")),
        resource_attrs=attrs(extra=json_object(tier="autopilot", mode="autopilot"))))


def bigquery(skus: DataFrame) -> DataFrame:
    """Pricing modes per region; the first entry of a (mode, region) wins and the first paid rate counts."""
    text = F.lower(F.coalesce("description", F.lit("")))
    slot, storage = text.contains("slot"), text.contains("storage")
    plus = text.contains("enterprise plus") | text.contains("enterprise_plus")
    name = first_case([
        (text.rlike(WAREHOUSE_EXCLUDED) | (text.contains("physical") & storage), None),
        (plus, F.when(slot, "capacity-enterprise-plus")),
        (text.contains("enterprise"), F.when(slot, "capacity-enterprise")),
        (text.contains("standard") & text.contains("edition"), F.when(slot, "capacity-standard")),
        (text.contains("long-term") | text.contains("long term"), F.when(storage, "storage-long-term")),
        (text.contains("active"), F.when(storage, "storage-active")),
        (text.contains("analysis") | text.contains("on-demand"), "on-demand")])
    paid = F.get(F.filter(F.transform("rates", _amount), lambda a: a > 0), F.lit(0))
    df = skus.withColumns({"name": name, "amount": paid}).filter(
        "name IS NOT NULL AND amount > 0 AND coalesce(sku_id, '') <> ''")
    multi = {"us": "bq-us", "eu": "bq-eu"}
    named = F.transform("serviceRegions", lambda r: F.coalesce(mapped(F.lower(r), multi), r))
    both = F.array(F.lit("bq-us"), F.lit("bq-eu"))
    df = df.withColumn("region", F.explode(F.when(F.coalesce(F.size("serviceRegions"), F.lit(0)) > 0, named
                                                  ).otherwise(both)))
    df = with_region_group(df.select("file", "pos", "sku_id", "name", "amount", "usage_unit", "region"), PROVIDER)
    df = first_per(df, ["name", "region", "region_normalized"], _order())
    name, raw = F.col("name"), F.coalesce("usage_unit", F.lit(""))
    capacity, stored = name.startswith("capacity"), name.startswith("storage")
    dimension = F.when(capacity, "slot").when(stored, "storage").otherwise("query")
    unit = first_case([(raw.contains("TiBy") | F.lower(raw).contains("tebibyte"), "tb"),
                       (raw.contains("GiBy") | F.lower(raw).contains("mo"), "gb-month"), (capacity, "slot-hour")], "hour")
    edition = F.regexp_replace(name, "^capacity-", "")
    extra = (F.when(capacity, json_object(mode="capacity", edition=edition))
             .when(stored, json_object(mode="storage", storage_tier=F.regexp_replace(name, "^storage-", "")))
             .otherwise(json_object(mode="on-demand")))
    return _rows(df, "bigquery", "warehouse.query", name, literal_terms(
        commitment="on_demand", tenancy="shared", os="on-demand",
        support_tier=F.when(capacity, edition).when(stored, name).otherwise("")),
        F.array(price(dimension, F.col("amount"), unit)), F.concat_ws("-", "sku_id", "region"),
        resource_attrs=attrs(extra=extra))


def firestore(skus: DataFrame) -> DataFrame:
    place = mapped(F.regexp_extract(F.coalesce("description", F.lit("")),
                                    "(North America|Europe|Asia|South America)", 1), FIRESTORE_REGIONS)
    df = _first_rate(skus).withColumns({"region": place, "dimension": mapped(F.col("resourceGroup"), FIRESTORE_GROUPS)})
    df = with_region_group(df.filter("dimension IS NOT NULL AND region IS NOT NULL"), PROVIDER)
    dims = {"storage": "gb-mo", "document_read": "request", "document_write": "request", "document_delete": "request"}
    wide = pivot_dimensions(df, ["region", "region_normalized"], list(dims), ["amount"], _order())
    return _rows(wide, "firestore", "db.nosql", F.lit("native"),
                 literal_terms(commitment="on_demand", tenancy="firestore-native"),
                 F.array(*(price(d, F.col(f"{d}.amount"), u) for d, u in dims.items())),
                 F.concat(F.lit("FIRESTORE-NATIVE-"), F.col("region")),
                 resource_attrs=attrs(extra=json_object(mode="native")))


def pubsub(skus: DataFrame, service: str, kind: str) -> DataFrame:
    """Global throughput price: the last tier, quoted per TiB and published per GiB."""
    df = _first_rate(skus).filter((F.col("resourceGroup") == "Message")
                                  & F.col("description").contains("Message Delivery Basic"))
    df = _global(df.withColumn("amount", F.element_at(_rates_ascending(F.col("rates")), -1)).filter("amount > 0"))
    return _rows(df, service, kind, F.lit("throughput"), literal_terms(commitment="on_demand"),
                 F.array(price("throughput", F.col("amount") / 1024.0, "gb-mo", "0", "")),
                 F.lit("PUBSUB-BASIC-GLOBAL"), resource_attrs=attrs(extra=json_object(mode="throughput")))


def _exact_tiers(rates: Column, tokens: tuple[str, ...], dimension: str, unit: str) -> Column:
    """Rates zipped with tokens; another number of rates is an error."""
    amounts = F.when(F.size(rates) == len(tokens), _rates_ascending(rates)).otherwise(F.raise_error(F.concat(
        F.lit(f"expected {len(tokens)} rates for {dimension}, got "), F.size(rates))).cast("array<double>"))
    return zipped_tiers(amounts, dimension, unit, tokens)


def cloud_cdn(skus: DataFrame) -> DataFrame:
    text = F.coalesce("description", F.lit(""))
    df = skus.filter((F.coalesce("usageType", F.lit("OnDemand")) == "OnDemand") & (F.size("rates") > 0))
    place = F.when(text.startswith(CDN_EGRESS_PREFIX), F.regexp_replace(text, "^" + CDN_EGRESS_PREFIX, ""))
    egress = df.filter("resourceGroup = 'CDNCacheEgress'").withColumn("place", place).withColumns({
        "region": mapped(F.col("place"), CDN_REGIONS), "region_normalized": F.lit("global")}).filter("region IS NOT NULL")
    plan = {"sku": "cloud-cdn-standard"}
    out = _rows(egress, "cloud-cdn", "network.cdn", F.lit("standard"), literal_terms(commitment="on_demand"),
                _exact_tiers(F.col("rates"), CDN_TOKENS, "egress", "gb"),
                F.concat(F.lit("CLOUD-CDN-EGRESS-"), F.upper(F.replace("place", F.lit(" "), F.lit("-")))),
                resource_attrs=attrs(extra=json_object(mode="edge-egress", **plan)))
    request = df.filter("resourceGroup = 'Cdn'").groupBy().agg(
        F.max_by(_amount(F.get("rates", F.lit(0))), _order()).alias("amount")).filter("amount IS NOT NULL")
    return out.unionByName(_rows(
        _global(request), "cloud-cdn", "network.cdn", F.lit("standard"), literal_terms(commitment="on_demand"),
        F.array(price("request", F.col("amount"), "request", "0", "")), F.lit("CLOUD-CDN-REQUESTS-GLOBAL"),
        resource_attrs=attrs(extra=json_object(mode="request", **plan))))


def cloud_dns(skus: DataFrame) -> DataFrame:
    text = F.lower(F.coalesce("description", F.lit("")))
    zone = text.contains("managedzone") | text.contains("managed zone")
    queries = ~zone & text.contains("dns query")
    df = skus.filter((F.col("resourceGroup") == "DNS") & (F.size("rates") > 0))
    one = df.groupBy().agg(F.min_by(F.when(zone, F.col("rates")), F.when(zone, _order())).alias("zone"),
                           F.min_by(F.when(queries, F.col("rates")), F.when(queries, _order())).alias("query"))
    zones = _exact_tiers(F.col("zone"), DNS_ZONE_TOKENS, "hosted_zone", "mo")
    asked = _exact_tiers(F.col("query"), DNS_QUERY_TOKENS, "query", "request")
    return _rows(_global(one.filter("zone IS NOT NULL")), "cloud-dns", "dns.zone", F.lit("public"),
                 literal_terms(commitment="on_demand"),
                 F.when(F.col("query").isNotNull(), F.concat(zones, asked)).otherwise(zones),
                 F.lit("GCP-DNS-PUBLIC-GLOBAL"), resource_attrs=attrs(extra=json_object(mode="public")))


JOBS = {
    "gcp_cloud_sql": cloud_sql, "gcp_spanner": spanner, "gcp_gcs": gcs, "gcp_memorystore": memorystore,
    "gcp_gke": gke, "gcp_bigquery": bigquery, "gcp_firestore": firestore, "gcp_cloud_cdn": cloud_cdn,
    "gcp_cloud_dns": cloud_dns,
    "gcp_run": lambda skus: serverless(skus, "run", "Cloud Run", "^Requests$", RUN_EXCLUDED),
    "gcp_functions": lambda skus: serverless(skus, "functions", "Cloud Run Functions", "(?i)invocation",
                                                FUNCTIONS_EXCLUDED),
    "gcp_pubsub_queues": lambda skus: pubsub(skus, "pubsub-queues", "messaging.queue"),
    "gcp_pubsub_topics": lambda skus: pubsub(skus, "pubsub-topics", "messaging.topic"),
}
# gce also takes the machine types: gce(skus, machines).
