"""Cross-provider comparison: one rule table, one function, one plan over all services."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tarifold import vocab
from tarifold.functions.cases import mapped
from tarifold.operators.rows import min_price, sorted_prices

DEFAULT_LIMIT = 20


@dataclass(frozen=True)
class CompareSpec:
    """What to compare. Zero or empty means the condition is off."""

    vcpu: int = 0
    memory_gb: float = 0.0
    gpu_count: int = 0
    max_price: float = 0.0
    storage_class: str = ""
    durability_nines: int = 0
    availability_tier: str = ""
    storage_gb: float = 0.0
    engine: str = ""
    deployment_option: str = ""
    tier: str = ""
    mode: str = ""
    plan_os: str = ""
    edition: str = ""
    storage_tier: str = ""
    resource: str = ""
    ops: int = 0
    queries: int = 0
    requests: int = 0
    gb: float = 0.0


# Which spec fields each kind takes besides max_price.
ACCEPTED: dict[str, tuple[str, ...]] = {
    "compute.vm": ("vcpu", "memory_gb", "gpu_count", "engine", "deployment_option", "plan_os", "edition",
                   "storage_tier"),
    "storage.object": ("storage_class", "durability_nines", "availability_tier", "engine", "deployment_option",
                       "plan_os", "edition", "storage_tier"),
    "db.relational": ("vcpu", "memory_gb", "storage_gb", "engine", "deployment_option", "plan_os", "edition",
                      "storage_tier"),
    "cache.kv": ("memory_gb", "engine", "plan_os", "edition", "storage_tier"),
    "container.orchestration": ("tier", "mode"),
    "search.engine": ("vcpu", "memory_gb", "deployment_option", "mode", "resource"),
    "paas.app": ("plan_os", "tier", "vcpu", "memory_gb", "resource"),
    "warehouse.query": ("mode", "edition", "storage_tier"),
    "messaging.queue": ("ops", "mode"),
    "messaging.topic": ("ops", "mode"),
    "dns.zone": ("queries", "mode"),
    "api.gateway": ("requests", "mode"),
    "network.cdn": ("gb", "mode"),
    "db.nosql": ("vcpu", "memory_gb", "engine", "mode"),
}
_VOLUMES = ("ops", "queries", "requests", "gb")
_OPEN_VOLUME_KINDS = (
    "compute.vm", "storage.object", "db.relational", "cache.kv", "container.orchestration", "search.engine",
    "paas.app", "warehouse.query",
)
ENGINE_TENANCIES: dict[str, tuple[str, ...]] = {
    "postgres": ("postgres", "aurora-postgres", "azure-postgres", "cloud-sql-postgres"),
    "mysql": ("mysql", "aurora-mysql", "azure-mysql", "cloud-sql-mysql"),
    "mariadb": ("mariadb", "azure-mariadb"),
    "sqlserver": ("sqlserver", "azure-sql", "cloud-sql-sqlserver"),
}
DEFAULT_MODE = {
    "container.orchestration": "control-plane",
    "search.engine": "managed-cluster",
    "warehouse.query": "on-demand",
}
CACHE_MEMORY_BAND = (0.9, 1.5)
COMPARE_KINDS = tuple(sorted(ACCEPTED))


def check_spec(kind: str, spec: CompareSpec, sort: str = "price") -> None:
    """Reject fields a kind does not take, more than one volume, and sorts a kind does not have."""
    if kind not in ACCEPTED:
        raise ValueError(f"unsupported kind {kind!r}; supported: {', '.join(COMPARE_KINDS)}")
    if sum(bool(getattr(spec, v)) for v in _VOLUMES) > 1:
        raise ValueError("at most one of ops, queries, requests and gb may be given")
    allowed = set(ACCEPTED[kind]) | {"max_price"}
    if kind in _OPEN_VOLUME_KINDS:
        allowed |= set(_VOLUMES)
    extra = [f.name for f in fields(spec) if getattr(spec, f.name) and f.name not in allowed]
    if extra:
        raise ValueError(f"{kind} does not take {', '.join(extra)}")
    if sort not in ("price", "vcpu", "memory"):
        raise ValueError(f"unsupported sort {sort!r}; allowed: price, vcpu, memory")
    if kind == "storage.object" and sort != "price":
        raise ValueError("storage.object sorts by price only")


def expand_regions(inputs: list[str]) -> list[str]:
    """Region literals of a list of groups and literals, sorted. A group also brings its own name and "global"."""
    out: set[str] = set()
    literals = {r for _, r, _ in vocab.region_rows()} | {vocab.GLOBAL_REGION}
    for name in inputs:
        if not name:
            continue
        if name in vocab.REGION_GROUPS:
            members = vocab.REGION_GROUPS[name].values()
            out |= {r for names in members for r in names} | {name, vocab.GLOBAL_REGION}
        elif name in literals:
            out.add(name)
        else:
            raise ValueError(f"unknown region or group {name!r}")
    return sorted(out)


def expand_region_requests(requests: DataFrame, key: str, region: str, groups: DataFrame) -> DataFrame:
    """Bulk form over a table of (key, region-or-group) and a table of (group, member).

    A group yields its members, its own name and "global"; a literal yields itself.
    """
    names = groups.select(F.col("group").alias(region)).distinct()
    members = groups.select(F.col("group").alias(region), F.col("member"))
    grouped = requests.join(members, region).select(key, F.col("member").alias("region_literal"))
    own = (requests.join(names, region, "left_semi")
           .select(key, F.explode(F.array(F.col(region), F.lit(vocab.GLOBAL_REGION))).alias("region_literal")))
    literal = (requests.join(names, region, "left_anti").filter(F.col(region) != "")
               .select(key, F.col(region).alias("region_literal")))
    return grouped.unionByName(own).unionByName(literal).distinct()


def _at_least(column: str, floor) -> Column:
    return F.col(column) >= F.lit(floor)


def extra_field(name: str) -> Column:
    return F.get_json_object(F.col("resource_attrs.extra"), f"$.{name}")


def kind_predicates(kind: str, spec: CompareSpec) -> list[Column]:
    """The pins and optional conditions of one kind."""
    terms = F.col("terms")
    out = [F.col("kind") == kind, terms["commitment"] == "on_demand"]

    def when(value, condition: Column) -> None:
        if value:
            out.append(condition)

    vcpu, memory = "resource_attrs.vcpu", "resource_attrs.memory_gb"
    mode = spec.mode or DEFAULT_MODE.get(kind, "")
    if kind == "compute.vm":
        out += [terms["tenancy"] == "shared", terms["os"] == "linux"]
        gpus = F.col("resource_attrs.gpu_count")
        out.append(gpus >= spec.gpu_count if spec.gpu_count > 0 else gpus.isNull() | (gpus == 0))
    elif kind == "storage.object":
        out += [terms["tenancy"] == "", terms["os"] == ""]
        when(spec.storage_class, F.col("resource_name") == spec.storage_class)
        when(spec.durability_nines, _at_least("resource_attrs.durability_nines", spec.durability_nines))
        when(spec.availability_tier, F.col("resource_attrs.availability_tier") == spec.availability_tier)
    elif kind == "db.relational":
        if not spec.engine or not spec.deployment_option:
            raise ValueError("db.relational needs an engine and a deployment option")
        out += [terms["tenancy"].isin(*ENGINE_TENANCIES.get(spec.engine, (spec.engine,))),
                terms["os"] == spec.deployment_option]
        when(spec.storage_gb, _at_least("resource_attrs.storage_gb", spec.storage_gb))
    elif kind == "cache.kv":
        low, high = CACHE_MEMORY_BAND
        when(spec.memory_gb, F.col(memory).between(F.lit(spec.memory_gb * low), F.lit(spec.memory_gb * high)))
        when(spec.engine, terms["tenancy"] == spec.engine)
    elif kind == "container.orchestration":
        when(spec.tier, terms["os"] == spec.tier)
    elif kind == "paas.app":
        out.append(terms["os"] == (spec.plan_os or "linux"))
        when(spec.tier, terms["support_tier"] == spec.tier)
    elif kind == "warehouse.query":
        when(spec.edition, extra_field("edition") == spec.edition)
        when(spec.storage_tier, extra_field("storage_tier") == spec.storage_tier)
    elif kind == "db.nosql":
        when(spec.engine, terms["tenancy"] == spec.engine)
    if kind in ("search.engine", "paas.app"):
        when(spec.resource, F.col("resource_name") == spec.resource)
    if kind in ("compute.vm", "db.relational", "search.engine", "paas.app"):
        when(spec.vcpu, _at_least(vcpu, spec.vcpu))
        when(spec.memory_gb, _at_least(memory, spec.memory_gb))
    if kind not in ("compute.vm", "storage.object", "db.relational", "cache.kv", "paas.app"):
        when(mode, extra_field("mode") == mode)
    return out


def compare(rows: DataFrame, kind: str, spec: CompareSpec = CompareSpec(), regions: list[str] | None = None,
            sort: str = "price", limit: int = DEFAULT_LIMIT, expanded: bool = False,
            services: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """Equivalent offers of a kind across providers, cheapest first.

    An item without a price counts as 0 and so sorts first, and a missing vcpu or memory sorts as 0. Give
    `expanded=True` when `regions` already holds literals, and `services` to restrict to the kind's services.
    """
    check_spec(kind, spec, sort)
    keep = kind_predicates(kind, spec)
    if regions:
        keep.append(F.col("region").isin(*(regions if expanded else expand_regions(regions))))
    if services is not None:
        keep.append(reduce(lambda a, b: a | b, [
            (F.col("provider") == p) & (F.col("service") == s) for p, s in services]))
    out = rows.filter(reduce(lambda a, b: a & b, keep)).withColumn("_min", min_price())
    if spec.max_price > 0:
        out = out.filter(F.col("_min") <= spec.max_price)
    out = out.withColumn("min_price", F.coalesce("_min", F.lit(0.0))).drop("_min")
    first = {
        "vcpu": F.coalesce(F.col("resource_attrs.vcpu"), F.lit(0)),
        "memory": F.coalesce(F.col("resource_attrs.memory_gb"), F.lit(0.0)),
    }.get(sort, F.col("min_price"))
    ordered = out.withColumn("prices", sorted_prices()).orderBy(first, "provider", "resource_name", "sku_id")
    return ordered.limit(limit) if limit > 0 else ordered


def mixed_units(rows: DataFrame, by: list[str]) -> DataFrame:
    """Groups whose prices mix unit families, and the separate per-call against per-hour test of gateways."""
    unit = F.explode(F.array_distinct(F.col("prices.unit"))).alias("unit")
    return (
        rows.select(*by, unit).withColumn("family", mapped(F.col("unit"), vocab.UNIT_FAMILIES))
        .groupBy(*by).agg(
            F.sort_array(F.collect_set("family")).alias("families"),
            F.coalesce(F.max(F.col("unit").isin("1M-req", "request")), F.lit(False)).alias("_call"),
            F.coalesce(F.max(F.col("unit").isin("hr", "hour")), F.lit(False)).alias("_hour"),
        )
        .select(*by, F.array_join("families", ",").alias("families"),
                (F.size("families") > 1).alias("mixed"),
                (F.col("_call") & F.col("_hour")).alias("mixed_gateway"))
    )


def compare_llm(rows: DataFrame, model: str) -> DataFrame:
    """Serving providers of a model by headline price: the prompt price, or the cheapest of all when that is unset."""
    return (rows.filter((F.col("resource_name") == model) & (F.col("provider") != "openrouter"))
            .withColumn("headline_price", headline_price())
            .orderBy("headline_price", "provider", "sku_id"))


def headline_price() -> Column:
    """Cheapest prompt price, else cheapest price of any kind; zero amounts count as unset."""
    def cheapest(keep) -> Column:
        return F.array_min(F.filter("prices", lambda p: keep(p) & (p["amount"] != 0))["amount"])
    return F.coalesce(cheapest(lambda p: p["dimension"] == "prompt"), cheapest(lambda p: F.lit(True)), F.lit(0.0))


def routing_score(rows: DataFrame) -> DataFrame:
    """Composite score of concrete providers: first listed price less a reward for uptime plus a latency penalty."""
    price = F.get(sorted_prices(), F.lit(0))["amount"]
    score = (price - F.lit(0.01) * F.coalesce(F.col("health.uptime_30d"), F.lit(0.0))
             + F.lit(0.0001) * F.coalesce(F.col("health.latency_p95_ms"), F.lit(0)))
    return rows.filter(~F.coalesce("is_aggregated", F.lit(False))).withColumn("routing_score", score)


def capable_models(rows: DataFrame, capabilities: list[str], max_input: float = 0.0,
                   max_output: float = 0.0) -> DataFrame:
    """Model rows that have every capability and fit the input and output price budget."""
    keep = [F.array_contains("resource_attrs.capabilities", c) for c in capabilities]

    def cheapest(dimension: str) -> Column:
        return F.array_min(F.filter("prices", lambda p: p["dimension"] == dimension)["amount"])

    for dimension, budget in (("prompt", max_input), ("completion", max_output)):
        if budget > 0:
            keep.append(cheapest(dimension) <= budget)
    keep.append(F.col("kind").startswith("llm."))
    return rows.filter(reduce(lambda a, b: a & b, keep))
