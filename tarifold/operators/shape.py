"""Output shaping: the result envelope, presets, field projection and the dictionary of reused term slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

PRESETS = ("agent", "price", "full", "compare")
_RESOURCE = ("vcpu", "memory_gb", "storage_gb", "gpu_count", "context_length", "max_output_tokens", "capabilities",
             "durability_nines", "availability_tier")
# What the compare preset adds per kind.
COMPARE_EXTRAS = {
    "llm.text": ("context_length", "capabilities"),
    "llm.multimodal": ("context_length", "capabilities"),
    "llm.embedding": ("context_length", "capabilities"),
    "compute.vm": ("vcpu", "memory_gb", "gpu_count"),
    "storage.object": ("durability_nines", "availability_tier"),
    "db.relational": ("vcpu", "memory_gb", "storage_gb"),
}


def _blank(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def envelope(rows: DataFrame, currency: str = "USD", catalog_version: str = "",
             include_aggregated: bool = False) -> DataFrame:
    """Nested result per row. Empty strings become null; aggregated rows are dropped unless asked for."""
    if not include_aggregated:
        rows = rows.filter(~F.coalesce("is_aggregated", F.lit(False)))
    attr, terms = F.col("resource_attrs"), F.col("terms")
    return rows.select(
        "provider", "service", "sku_id",
        F.struct(F.col("kind"), F.col("resource_name").alias("name"), *(attr[f].alias(f) for f in _RESOURCE),
                 F.when(F.col("is_aggregated"), F.struct(F.lit(True).alias("aggregated"))).alias("attributes"),
                 ).alias("resource"),
        F.struct(_blank(F.col("region")).alias("provider_region"),
                 _blank(F.col("region_normalized")).alias("normalized_region"),
                 F.lit(None).cast("string").alias("availability_zone")).alias("location"),
        F.transform(F.array_sort("prices"), lambda p: F.struct(
            p["amount"].alias("amount"), F.lit(currency).alias("currency"), p["unit"].alias("unit"),
            p["dimension"].alias("dimension"), F.nullif(p["tier"], F.lit("")).alias("tier"))).alias("price"),
        F.when(terms["commitment"] != "", F.struct(
            terms["commitment"].alias("commitment"),
            *(_blank(terms[f]).alias(f) for f in ("tenancy", "os", "support_tier", "upfront", "payment_option")),
        )).alias("terms"),
        "health",
        F.struct(F.lit(catalog_version).alias("catalog_version"), F.lit("daily").alias("freshness")).alias("source"),
    )


def preset(envelopes: DataFrame, name: str = "agent") -> DataFrame:
    """Trim envelopes to a preset; the compare preset keeps other attributes per kind."""
    if name not in PRESETS:
        name = "agent"
    if name == "full":
        return envelopes
    if name == "price":
        return envelopes.select("price")
    if name == "agent":
        return envelopes.select(
            "provider", "service", F.struct("resource.name").alias("resource"),
            F.struct("location.provider_region").alias("location"), "price",
            F.when(F.col("terms").isNotNull(), F.struct("terms.commitment")).alias("terms"))
    kind = F.col("resource.kind")
    extras = sorted({f for names in COMPARE_EXTRAS.values() for f in names})

    def kept(field: str) -> Column:
        kinds = [k for k, names in COMPARE_EXTRAS.items() if field in names]
        return F.when(kind.isin(*kinds), F.col(f"resource.{field}")).alias(field)

    return envelopes.select(
        "provider", F.struct("resource.kind", "resource.name", *(kept(f) for f in extras)).alias("resource"),
        F.struct("location.normalized_region").alias("location"), "price",
        F.when((kind == "db.relational") & F.col("terms").isNotNull(),
               F.struct("terms.commitment", "terms.tenancy", "terms.os")).alias("terms"),
        F.when(kind.startswith("llm.") & kind.isin(*COMPARE_EXTRAS) & F.col("health").isNotNull(),
               F.struct("health.uptime_30d", "health.latency_p95_ms")).alias("health"))


def to_json_lines(shaped: DataFrame) -> DataFrame:
    """One JSON text per row. Null fields are left out, except the location keys and the tier of a price."""
    parts = [F.col(c) for c in shaped.columns if c not in ("location", "price")]
    out = F.to_json(F.struct(*parts))
    for name in ("price", "location"):
        if name in shaped.columns:
            block = F.to_json(F.col(name), {"ignoreNullFields": "false"})
            inner = F.regexp_replace(out, r"^\{", "")
            out = F.concat(F.lit('{"' + name + '":'), block, F.when(inner == "}", inner).otherwise(
                F.concat(F.lit(","), inner)))
    return shaped.select(out.alias("value"))


def _resolve(df: DataFrame, path: str) -> Column | None:
    """Column of a dotted path such as price.0.amount, null when the schema does not have it."""
    parts = path.split(".")
    if parts[0] not in df.columns:
        return None
    column, kind = F.col(f"`{parts[0]}`"), df.schema[parts[0]].dataType
    for part in parts[1:]:
        if isinstance(kind, T.ArrayType) and part.isdigit():
            column, kind = F.get(column, F.lit(int(part))), kind.elementType
        elif isinstance(kind, T.StructType) and part in kind.fieldNames():
            column, kind = column[part], kind[part].dataType
        elif isinstance(kind, T.MapType):
            column, kind = F.try_element_at(column, F.lit(part)), kind.valueType
        else:
            return None
    return column


def project_fields(df: DataFrame, fields: str) -> DataFrame:
    """Keep comma-separated dotted paths; a path the schema lacks is dropped. Only the named leaves are read."""
    picked = [(p, _resolve(df, p)) for p in (f.strip() for f in fields.split(",")) if p]
    return df.select(*(c.alias(p.replace(".", "_")) for p, c in picked if c is not None))


def label_term_slots(rows: DataFrame) -> DataFrame:
    """Rows with the reused term slots under their meaning: (sku_id, kind, meaning, value)."""
    from tarifold import vocab
    slots = vocab.term_slots(rows.sparkSession).select("kind", "slot", "meaning").distinct()
    used = rows.select("sku_id", "kind", F.explode(F.create_map(
        F.lit("tenancy"), F.col("terms.tenancy"), F.lit("os"), F.col("terms.os"))).alias("slot", "value"))
    return used.join(F.broadcast(slots), ["kind", "slot"]).filter("value <> ''").select(
        "sku_id", "kind", "meaning", "value")
