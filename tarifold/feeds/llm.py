"""The language-model feed: models with their serving endpoints, and one synthetic aggregate row per model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tarifold.functions.terms import literal_terms
from tarifold.operators.rows import attrs, normalized_rows
from tarifold.schemas import HEALTH, PRICE

# The price fields that are published.
PRICE_FIELDS = ("prompt", "completion", "image", "request")
AGGREGATED = "openrouter"


def price_fields(pricing: Column) -> Column:
    """Price field map as an array of prices; blank and zero fields are left out."""
    return _prices({f: F.nullif(pricing[f], F.lit("")).cast("double") for f in PRICE_FIELDS})


def _prices(amounts: dict[str, Column]) -> Column:
    every = F.array(*(F.struct(
        F.lit(f).alias("dimension"), F.lit("").alias("tier"), F.lit("").alias("tier_upper"), amount.alias("amount"),
        F.lit("request" if f == "request" else "token").alias("unit")) for f, amount in amounts.items()))
    return F.filter(every, lambda p: p["amount"].isNotNull() & (p["amount"] != 0))


def _read_fields() -> Column:
    """What is read of the price field map, as a struct: the map itself is wide and stays out of exchanges."""
    return F.struct(*(F.col("pricing")[f].alias(f) for f in (*PRICE_FIELDS, "currency"))).alias("pricing")


def model_kind(modality: Column, inputs: Column) -> Column:
    """llm.text for text models that read nothing but text, else llm.multimodal."""
    only_text = F.size(F.array_except(F.transform(inputs, F.lower), F.array(F.lit("text")))) == 0
    return F.when((F.lower(F.coalesce(modality, F.lit(""))) == "text") & only_text, "llm.text").otherwise(
        "llm.multimodal")


def _currency() -> Column:
    return F.upper(F.coalesce(F.nullif(F.col("pricing")["currency"], F.lit("")), F.lit("USD")))


def offers(models: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Every priced offer before the currency guard: one per endpoint, and the aggregate one per served model."""
    model = models.select(F.col("pos"), "id", "architecture", "supported_parameters",
                          F.col("context_length").alias("m_context"), _read_fields().alias("m_pricing"), "top_provider")
    narrow = endpoints.select(*(c for c in endpoints.columns if c != "pricing"), _read_fields())
    served = narrow.join(model.select("id", "pos", "architecture", "supported_parameters"), "id")
    shared = ["id", "pos", "architecture", "supported_parameters"]
    own = served.select(
        *shared, "e_pos", F.coalesce(F.nullif("tag", F.lit("")), "provider_name").alias("provider"), "quantization",
        "pricing", "context_length", F.col("max_completion_tokens").alias("max_output"),
        F.struct(F.col("uptime_last_30m").alias("uptime_30d"), F.col("latency.p50_ms").alias("latency_p50_ms"),
                 F.col("latency.p95_ms").alias("latency_p95_ms"),
                 F.col("throughput_tokens_per_second").alias("throughput_tokens_per_sec"),
                 F.lit(None).cast("bigint").alias("observed_at")).cast(HEALTH).alias("health"),
        F.lit(False).alias("is_aggregated"))
    with_endpoints = model.join(endpoints.select("id").distinct(), "id", "left_semi")
    aggregate = with_endpoints.select(
        *shared, F.lit(2**31 - 1).alias("e_pos"), F.lit(AGGREGATED).alias("provider"),
        F.lit(None).cast("string").alias("quantization"), F.col("m_pricing").alias("pricing"),
        F.coalesce(F.nullif("top_provider.context_length", F.lit(0)), "m_context").alias("context_length"),
        F.col("top_provider.max_completion_tokens").alias("max_output"), F.lit(None).cast(HEALTH).alias("health"),
        F.lit(True).alias("is_aggregated"))
    return own.unionByName(aggregate)


def rejected(models: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Offers priced in another currency, for the report of the lenient mode."""
    return offers(models, endpoints).filter(_currency() != "USD").select("id", "provider", _currency().alias("currency"))


def openrouter(models: DataFrame, endpoints: DataFrame, observed_at: int | None = None,
               skip_non_usd: bool = False) -> DataFrame:
    """Model rows, one per (model, provider, quantization).

    Duplicates keep the cheapest by price sum and among equals the healthiest, which for equal prices is simply the
    healthiest. It is one aggregate with map-side combine, so a model with very many endpoints is no hot spot.
    Another currency fails the job unless the lenient mode skips it.
    """
    df = offers(models, endpoints)
    usd = _currency() == "USD"
    df = df.filter(usd if skip_non_usd else F.when(usd, True).otherwise(F.raise_error(F.concat_ws(
        "/", F.lit("non-usd endpoint"), "id", "provider")).cast("boolean")))
    df = df.withColumns({
        "provider": F.coalesce("provider", F.raise_error(F.concat(
            F.lit("missing serving provider for "), F.col("id"))).cast("string")),
        # four numbers travel, the prices with their names are built from the best offer
        "amounts": F.struct(*(F.nullif(F.col("pricing")[f], F.lit("")).cast("double").alias(f) for f in PRICE_FIELDS)),
        "sku_id": F.concat_ws("::", "id", "provider", F.coalesce(F.nullif("quantization", F.lit("")), F.lit("default")))})
    total = reduce(lambda a, b: a + b, (F.coalesce(F.col("amounts")[f], F.lit(0.0)) for f in PRICE_FIELDS))
    uptime = F.coalesce("health.uptime_30d", F.lit(-1.0))
    keep = [c for c in df.columns if c not in ("sku_id", "pricing", "pos", "e_pos")]
    best = df.groupBy("sku_id").agg(F.min_by(
        F.struct(*keep), F.struct(total.alias("t"), (-uptime).alias("u"), F.col("pos").alias("p"),
                                  F.col("e_pos").alias("e"))).alias("b")).select("sku_id", "b.*")
    best = best.withColumns({
        "inputs": F.coalesce("architecture.input_modalities", F.array().cast("array<string>")),
        "prices": _prices({f: F.col("amounts")[f] for f in PRICE_FIELDS}).cast(f"array<{PRICE.simpleString()}>")})
    health = F.when(F.col("health").isNotNull(), F.col("health").withField(
        "observed_at", F.lit(observed_at).cast("bigint")))
    kind = model_kind(F.col("architecture.modality"), F.col("inputs"))
    return normalized_rows(
        best, provider=F.col("provider"), service="llm", kind=kind, sku_id=F.col("sku_id"), resource_name=F.col("id"),
        region=F.lit(""), region_normalized=F.lit(""), terms=literal_terms(commitment="on_demand"),
        prices=F.col("prices"), health=health, is_aggregated=F.col("is_aggregated"),
        resource_attrs=attrs(context_length=F.col("context_length"), max_output_tokens=F.col("max_output"),
                             modality=F.col("inputs"), quantization=F.col("quantization"),
                             capabilities=F.coalesce("supported_parameters", F.array().cast("array<string>"))))
