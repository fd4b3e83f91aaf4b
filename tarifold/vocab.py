"""Closed vocabularies and lookup tables. Every table here is of fixed size, so broadcasting it is always safe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------------------------------------------
# These must equal the published catalog's vocabularies for results to agree.
# ---------------------------------------------------------------------------------------------------------------

# Provider regions by region group.
REGION_GROUPS: dict[str, dict[str, tuple[str, ...]]] = {
    "us-east": {
        "aws": ("us-east-1", "us-east-2", "ca-central-1"),
        "azure": ("canadaeast", "eastus", "eastus2", "canadacentral"),
        "gcp": ("us-east1", "us-east4", "us-east5", "northamerica-northeast1", "northamerica-northeast2"),
    },
    "us-central": {
        "aws": ("mx-central-1",),
        "azure": ("centralus", "northcentralus", "southcentralus", "mexicocentral"),
        "gcp": ("us-central1", "us-south1", "northamerica-south1"),
    },
    "us-west": {
        "aws": ("us-west-1", "us-west-2", "ca-west-1"),
        "azure": ("westus", "westcentralus", "westus2", "westus3"),
        "gcp": ("us-west1", "us-west2", "us-west3", "us-west4"),
    },
    "eu-west": {
        "aws": ("eu-west-1", "eu-west-2", "eu-west-3", "eu-south-1", "eu-south-2"),
        "azure": ("belgiumcentral", "westeurope", "uksouth", "ukwest", "francecentral", "francesouth", "italynorth",
                  "spaincentral"),
        "gcp": ("europe-west1", "europe-west2", "europe-west4", "europe-west8", "europe-west9", "europe-west12",
                "europe-southwest1"),
    },
    "eu-central": {
        "aws": ("eu-central-1", "eu-central-2"),
        "azure": ("austriaeast", "germanywestcentral", "germanynorth", "polandcentral", "switzerlandnorth",
                  "switzerlandwest"),
        "gcp": ("europe-west3", "europe-west6", "europe-west10", "europe-central2"),
    },
    "eu-north": {
        "aws": ("eu-north-1",),
        "azure": ("denmarkeast", "northeurope", "norwayeast", "norwaywest", "swedencentral"),
        "gcp": ("europe-north1", "europe-north2"),
    },
    "asia-ne": {
        "aws": ("ap-east-1", "ap-east-2", "ap-northeast-1", "ap-northeast-2", "ap-northeast-3"),
        "azure": ("eastasia", "japaneast", "japanwest", "koreacentral", "koreasouth"),
        "gcp": ("asia-northeast1", "asia-northeast2", "asia-northeast3", "asia-east1", "asia-east2"),
    },
    "asia-se": {
        "aws": ("ap-southeast-1", "ap-southeast-3", "ap-southeast-5", "ap-southeast-7"),
        "azure": ("indonesiacentral", "malaysiawest", "southeastasia"),
        "gcp": ("asia-southeast1", "asia-southeast2", "asia-southeast3"),
    },
    "asia-south": {
        "aws": ("ap-south-1", "ap-south-2"),
        "azure": ("centralindia", "southindia", "westindia"),
        "gcp": ("asia-south1", "asia-south2"),
    },
    "oceania": {
        "aws": ("ap-southeast-2", "ap-southeast-4", "ap-southeast-6"),
        "azure": ("australiacentral", "australiacentral2", "australiaeast", "australiasoutheast", "newzealandnorth"),
        "gcp": ("australia-southeast1", "australia-southeast2"),
    },
    "sa": {
        "aws": ("sa-east-1",),
        "azure": ("brazilsouth", "brazilsoutheast", "chilecentral"),
        "gcp": ("southamerica-east1", "southamerica-west1"),
    },
    "africa": {
        "aws": ("af-south-1",),
        "azure": ("southafricanorth", "southafricawest"),
        "gcp": ("africa-south1",),
    },
    "middle-east": {
        "aws": ("il-central-1", "me-south-1", "me-central-1"),
        "azure": ("israelcentral", "qatarcentral", "uaecentral", "uaenorth"),
        "gcp": ("me-west1", "me-central1", "me-central2"),
    },
}
# Warehouse multi-regions are their own group, and "global" is a legal literal of no group.
SELF_REGIONS = ("bq-us", "bq-eu")
GLOBAL_REGION = "global"

# Location names of the offer feeds; Europe appears in two spellings.
LOCATION_REGIONS: dict[str, str] = {
    "US East (N. Virginia)": "us-east-1",
    "US East (Ohio)": "us-east-2",
    "US West (N. California)": "us-west-1",
    "US West (Oregon)": "us-west-2",
    "Canada (Central)": "ca-central-1",
    "Canada West (Calgary)": "ca-west-1",
    "Mexico (Central)": "mx-central-1",
    "EU (Ireland)": "eu-west-1",
    "Europe (Ireland)": "eu-west-1",
    "EU (London)": "eu-west-2",
    "Europe (London)": "eu-west-2",
    "EU (Paris)": "eu-west-3",
    "Europe (Paris)": "eu-west-3",
    "EU (Frankfurt)": "eu-central-1",
    "Europe (Frankfurt)": "eu-central-1",
    "EU (Milan)": "eu-south-1",
    "Europe (Milan)": "eu-south-1",
    "EU (Stockholm)": "eu-north-1",
    "Europe (Stockholm)": "eu-north-1",
    "Europe (Spain)": "eu-south-2",
    "Europe (Zurich)": "eu-central-2",
    "Asia Pacific (Tokyo)": "ap-northeast-1",
    "Asia Pacific (Seoul)": "ap-northeast-2",
    "Asia Pacific (Osaka)": "ap-northeast-3",
    "Asia Pacific (Singapore)": "ap-southeast-1",
    "Asia Pacific (Sydney)": "ap-southeast-2",
    "Asia Pacific (Jakarta)": "ap-southeast-3",
    "Asia Pacific (Melbourne)": "ap-southeast-4",
    "Asia Pacific (Malaysia)": "ap-southeast-5",
    "Asia Pacific (New Zealand)": "ap-southeast-6",
    "Asia Pacific (Thailand)": "ap-southeast-7",
    "Asia Pacific (Hong Kong)": "ap-east-1",
    "Asia Pacific (Taipei)": "ap-east-2",
    "Asia Pacific (Mumbai)": "ap-south-1",
    "Asia Pacific (Hyderabad)": "ap-south-2",
    "South America (Sao Paulo)": "sa-east-1",
    "Middle East (Bahrain)": "me-south-1",
    "Middle East (UAE)": "me-central-1",
    "Israel (Tel Aviv)": "il-central-1",
    "Africa (Cape Town)": "af-south-1",
}

# Edge locations of the content-delivery feed.
EDGE_REGIONS: dict[str, str] = {
    "United States, Mexico, & Canada": "us-east-1",
    "Europe, Israel": "eu-west-1",
    "Asia Pacific (including Japan & Taiwan)": "ap-northeast-1",
    "United States": "us-east-1",
    "Canada": "ca-central-1",
    "Europe": "eu-west-1",
    "Asia Pacific": "ap-northeast-1",
    "Japan": "ap-northeast-1",
    "Australia": "ap-southeast-2",
    "India": "ap-south-1",
    "South America": "sa-east-1",
    "Middle East": "me-central-1",
    "South Africa": "af-south-1",
}

# Raw unit spelling -> (divisor, canonical unit), by family.
UNITS: dict[str, dict[str, tuple[float, str]]] = {
    "hour": {
        "1 Hour": (1.0, "hrs"),
        "1 Hours": (1.0, "hrs"),
        "1/Hour": (1.0, "hrs"),
        "100 Hours": (100.0, "hrs"),
    },
    "storage": {
        "1 GB/Month": (1.0, "gb-mo"),
        "1 GB/Hour": (1.0, "gb-hr"),
        "1/Month": (1.0, "month"),
    },
    "request": {
        "1000000": (1_000_000.0, "requests"),
        "1M": (1_000_000.0, "requests"),
        "10K": (10_000.0, "requests"),
        "1K": (1_000.0, "requests"),
        "1": (1.0, "requests"),
    },
    "usage": {
        "h": (1.0, "hrs"),
        "GiBy.h": (1.0, "gb-hr"),
        "GiBy.mo": (1.0, "gb-mo"),
        "GiBy.d": (1.0 / 30.4375, "gb-mo"),
        "By.mo": (1.0 / 1024**3, "gb-mo"),
        "count": (1.0, "requests"),
        "s": (1.0, "s"),
        "GiBy.s": (1.0, "gb-s"),
    },
}

# Tier tokens by domain.
COUNT_TOKENS = (
    "0", "25", "100", "10K", "1M", "13M", "100M", "250M", "300M", "333M", "667M", "2500M",
    "1B", "5B", "10B", "19B", "20B", "100B", "200B",
)
BYTE_TOKENS = (
    "0", "100GB", "500GB", "1TB", "10TB", "40TB", "50TB", "100TB", "150TB", "500TB", "1PB", "5PB",
)
QUANTITY_SUFFIX = {"K": 1e3, "M": 1e6, "G": 1e9, "T": 1e12, "P": 1e15}

# Closed vocabularies of kinds and terms.
ENUMS: dict[str, tuple[str, ...]] = {
    "kind": (
        "llm.text", "llm.multimodal", "llm.embedding", "llm.image", "llm.audio", "compute.vm", "db.relational",
        "storage.object", "compute.function", "storage.block", "db.nosql", "network.cdn", "cache.kv",
        "container.orchestration", "search.engine", "paas.app", "warehouse.query", "messaging.queue",
        "messaging.topic", "dns.zone", "api.gateway",
    ),
    "commitment": ("on_demand",),
    "tenancy": (
        "", "shared", "dedicated", "postgres", "mysql", "mariadb", "oracle", "sqlserver", "aurora-postgres",
        "aurora-mysql", "azure-sql", "azure-postgres", "azure-mysql", "azure-mariadb", "cloud-sql-postgres",
        "cloud-sql-mysql", "cloud-sql-sqlserver", "redis", "memcached", "sql", "mongo", "cassandra", "table",
        "gremlin", "spanner-standard", "spanner-enterprise", "spanner-enterprise-plus", "spanner-storage",
        "kubernetes", "messaging", "dns", "api-gateway", "cdn", "firestore-native",
    ),
    "os": (
        "", "linux", "windows", "rhel", "single-az", "multi-az", "multi-az-cluster", "managed-instance",
        "elastic-pool", "flexible-server", "zonal", "regional", "provisioned", "serverless", "serverless-v2",
        "storage", "basic", "standard", "premium", "enterprise", "extended-support", "fargate", "free",
        "virtual-nodes", "autopilot", "managed-cluster", "on-demand", "fifo", "topic", "pubsub-throughput",
        "event-hubs-standard", "event-hubs-premium", "apim-consumption", "apim-developer", "apim-basic",
        "apim-standard", "apim-premium", "apim-premium-v2", "apim-isolated", "rest-api", "http-api", "dns-public",
        "dns-private", "cdn-egress", "cdn-request", "cdn-origin-shield", "cdn-cache-fill",
    ),
    "support_tier": (
        "", "free", "shared", "basic", "standard", "premium", "premiumv3", "isolated", "isolatedv2", "enterprise",
        "enterprise-plus", "storage-active", "storage-long-term",
    ),
    "payment_option": ("",),
}
CHECKED_TERMS = ("commitment", "tenancy", "os", "support_tier", "payment_option")

# Kinds whose default terms are more than on_demand: (tenancy, os, support_tier).
DEFAULT_TERMS: dict[str, tuple[str, str, str]] = {
    "compute.vm": ("shared", "linux", ""),
    "db.relational": ("mysql", "single-az", ""),
    "container.orchestration": ("kubernetes", "standard", ""),
    "search.engine": ("shared", "managed-cluster", ""),
    "paas.app": ("dedicated", "linux", "free"),
    "warehouse.query": ("shared", "on-demand", ""),
}

# What the two reused term slots mean, by kind.
TERM_SLOTS: dict[str, dict[str, tuple[str, tuple[str, ...]]]] = {
    "db.relational": {
        "tenancy": ("engine", ("postgres", "mysql", "mariadb", "oracle", "sqlserver", "aurora-postgres",
                               "aurora-mysql", "azure-sql", "azure-postgres", "azure-mysql", "azure-mariadb",
                               "cloud-sql-postgres", "cloud-sql-mysql", "cloud-sql-sqlserver")),
        "os": ("deployment_option", ("single-az", "multi-az", "multi-az-cluster", "managed-instance",
                                     "elastic-pool", "flexible-server", "zonal", "regional")),
    },
    "cache.kv": {
        "tenancy": ("engine", ("redis", "memcached", "sql", "mongo", "cassandra", "table", "gremlin",
                               "spanner-standard", "spanner-enterprise", "spanner-enterprise-plus",
                               "spanner-storage")),
        "os": ("tier_or_mode", ("basic", "standard", "premium", "enterprise", "provisioned", "serverless", "storage")),
    },
    "container.orchestration": {
        "tenancy": ("product_family", ("kubernetes",)),
        "os": ("tier_or_mode", ("standard", "extended-support", "fargate", "free", "virtual-nodes", "autopilot")),
    },
}

# provider/service -> estimator kind.
ESTIMATE_KINDS: dict[str, str] = {
    "aws/ec2": "compute.vm",
    "aws/rds": "compute.vm",
    "azure/vm": "compute.vm",
    "gcp/gce": "compute.vm",
    "aws/s3": "storage.object",
    "azure/blob": "storage.object",
    "gcp/gcs": "storage.object",
    "llm/text": "llm.text",
    "aws/aurora": "db.relational.aurora",
    "azure/cosmosdb": "db.nosql.cosmos",
    "gcp/spanner": "db.relational.spanner",
    "aws/opensearch": "search.engine.opensearch",
    "azure/appservice": "paas.app.appservice",
    "gcp/bigquery": "warehouse.query.bigquery",
    "aws/sqs": "messaging.queue",
    "azure/service-bus-queues": "messaging.queue",
    "azure/event-hubs": "messaging.queue",
    "gcp/pubsub-queues": "messaging.queue",
    "aws/sns": "messaging.topic",
    "azure/service-bus-topics": "messaging.topic",
    "gcp/pubsub-topics": "messaging.topic",
    "aws/route53": "dns.zone",
    "gcp/cloud-dns": "dns.zone",
    "aws/api-gateway": "api.gateway",
    "azure/apim": "api.gateway",
    "aws/cloudfront": "network.cdn",
    "azure/front-door": "network.cdn",
    "gcp/cloud-cdn": "network.cdn",
    "gcp/firestore": "db.nosql",
}

# Services that take part in a comparison, by kind (provider, service).
COMPARE_SERVICES: dict[str, tuple[tuple[str, str], ...]] = {
    "compute.vm": (("aws", "ec2"), ("azure", "vm"), ("gcp", "gce")),
    "storage.object": (("aws", "s3"), ("azure", "blob"), ("gcp", "gcs")),
    "db.relational": (
        ("aws", "rds"), ("aws", "aurora"), ("azure", "sql"), ("azure", "postgres"), ("azure", "mysql"),
        ("azure", "mariadb"), ("gcp", "cloud-sql"), ("gcp", "spanner"),
    ),
    "cache.kv": (("aws", "elasticache"), ("azure", "redis"), ("gcp", "memorystore")),
    "container.orchestration": (("aws", "eks"), ("azure", "aks"), ("gcp", "gke")),
    "search.engine": (("aws", "opensearch"),),
    "paas.app": (("azure", "appservice"),),
    "warehouse.query": (("gcp", "bigquery"),),
    "messaging.queue": (
        ("aws", "sqs"), ("azure", "service-bus-queues"), ("azure", "event-hubs"), ("gcp", "pubsub-queues"),
    ),
    "messaging.topic": (("aws", "sns"), ("azure", "service-bus-topics"), ("gcp", "pubsub-topics")),
    "dns.zone": (("aws", "route53"), ("gcp", "cloud-dns")),
    "api.gateway": (("aws", "api-gateway"), ("azure", "apim")),
    "network.cdn": (("aws", "cloudfront"), ("azure", "front-door"), ("gcp", "cloud-cdn")),
    "db.nosql": (("gcp", "firestore"),),
}

# Unit -> commensurable family, for the mixed-unit warning.
UNIT_FAMILIES = {
    "1M-req": "count",
    "request": "count",
    "requests": "count",
    "hr": "hour",
    "hour": "hour",
    "gb": "byte",
    "gb-mo": "byte",
    "gib-mo": "byte",
    "month": "month",
}


# ---------------------------------------------------------------------------------------------------------------
# Access
# ---------------------------------------------------------------------------------------------------------------

def literal_frame(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A fixed table as an inline VALUES relation: no job, exact size statistics, never a Python RDD."""
    def lit(v) -> str:
        if v is None:
            return "CAST(NULL AS STRING)"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, int):
            return f"{v}L"
        if isinstance(v, float):
            return f"{v!r}D"
        return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"

    values = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")


def region_rows() -> list[tuple[str, str, str]]:
    """(provider, region, group) of every tracked region."""
    rows = [
        (provider, region, group)
        for group, providers in REGION_GROUPS.items()
        for provider, names in providers.items()
        for region in names
    ]
    return rows + [("gcp", name, name) for name in SELF_REGIONS]


def regions(spark: SparkSession) -> DataFrame:
    return literal_frame(spark, ["provider", "region", "region_normalized"], region_rows())


def provider_regions(spark: SparkSession, provider: str) -> DataFrame:
    """(region, region_normalized) of one provider."""
    return literal_frame(spark, ["region", "region_normalized"],
                         [(r, g) for p, r, g in region_rows() if p == provider])


def terms_defaults(spark: SparkSession) -> DataFrame:
    """(kind, _default struct) for every kind."""
    rows = [(kind, "on_demand", *DEFAULT_TERMS.get(kind, ("", "", "")), "", "") for kind in ENUMS["kind"]]
    frame = literal_frame(
        spark, ["kind", "commitment", "tenancy", "os", "support_tier", "upfront", "payment_option"], rows)
    return frame.selectExpr(
        "kind", "struct(commitment, tenancy, os, support_tier, upfront, payment_option) AS _default")


def term_slots(spark: SparkSession) -> DataFrame:
    """(kind, slot, meaning, value): one row per allowed value of a reused term slot."""
    return literal_frame(spark, ["kind", "slot", "meaning", "value"], [
        (kind, slot, meaning, value)
        for kind, slots in TERM_SLOTS.items()
        for slot, (meaning, values) in slots.items()
        for value in values
    ])
