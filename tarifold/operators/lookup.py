"""Exact lookups, one at a time or a whole table of requests, and the filtered search."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window, functions as F

from tarifold.functions.cases import first_case
from tarifold.functions.terms import terms_hash
from tarifold.operators.rows import min_price, sorted_prices
from tarifold.schemas import TERM_FIELDS

# Typed lookups and whether they need a resource name.
LOOKUP_KINDS: dict[str, bool] = {
    "compute.vm": True,
    "db.relational": True,
    "storage.object": True,
    "compute.function": True,
    "storage.block": True,
    "db.nosql": True,
    "network.cdn": True,
    "cache.kv": True,
    "container.orchestration": True,
    "search.engine": True,
    "messaging.queue": True,
    "messaging.topic": True,
    "dns.zone": True,
    "api.gateway": False,
}
AGGREGATED_PROVIDER = "openrouter"
#: Rows of one name that requests meet at a time.
BLOCK = 1024


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _with_sorted_prices(rows: DataFrame) -> DataFrame:
    return rows.withColumn("prices", sorted_prices())


def lookup(rows: DataFrame, kind: str, resource: str = "", provider: str = "", service: str = "", region: str = "",
           **terms: str) -> DataFrame:
    """Rows of a kind with the given names; terms are compared as a whole, and only if any is given."""
    if kind not in LOOKUP_KINDS:
        raise ValueError(f"no typed lookup for kind {kind!r}")
    if LOOKUP_KINDS[kind] and not resource:
        raise ValueError(f"{kind} lookup needs a resource name")
    keep = [F.col("kind") == kind]
    for column, value in (("resource_name", resource), ("provider", provider), ("service", service),
                          ("region", region)):
        if value:
            keep.append(F.col(column) == value)
    if any(terms.values()):
        keep.append(F.col("terms_hash") == terms_hash(*(F.lit(terms.get(f, "")) for f in TERM_FIELDS)))
    return _with_sorted_prices(rows.filter(_all(keep))).orderBy("region", "sku_id")


def lookup_by_term_columns(rows: DataFrame, kind: str, resource: str = "", provider: str = "", service: str = "",
                           region: str = "", **terms: str) -> DataFrame:
    """Lookup that compares single term columns: app plans (always on demand) and warehouses (resource required)."""
    if kind == "paas.app":
        terms = {**terms, "commitment": "on_demand"}
    elif kind == "warehouse.query":
        if not resource:
            raise ValueError("warehouse.query lookup needs a resource name")
    else:
        raise ValueError(f"no column lookup for kind {kind!r}")
    keep = [F.col("kind") == kind]
    for column, value in (("resource_name", resource), ("provider", provider), ("service", service),
                          ("region", region)):
        if value:
            keep.append(F.col(column) == value)
    keep += [F.col("terms")[f] == value for f, value in terms.items() if value]
    return _with_sorted_prices(rows.filter(_all(keep))).orderBy("region", "sku_id")


def lookup_llm(rows: DataFrame, model: str, serving_provider: str = "", include_aggregated: bool = False) -> DataFrame:
    """Serving rows of one model; the synthetic aggregate row is dropped unless asked for."""
    if not model:
        raise ValueError("model lookup needs a model")
    keep = [F.col("resource_name") == model]
    if serving_provider:
        keep.append(F.col("provider") == serving_provider)
    if not include_aggregated:
        keep.append(F.col("provider") != AGGREGATED_PROVIDER)
    out = rows.filter(_all(keep)).withColumn("is_aggregated", F.col("provider") == AGGREGATED_PROVIDER)
    return _with_sorted_prices(out).orderBy("provider", "sku_id")


def lookup_many(rows: DataFrame, requests: DataFrame,
                required: tuple[str, ...] = ("kind", "resource_name"),
                optional: tuple[str, ...] = ("provider", "service", "region"),
                request_id: str = "request_id", masks: list[tuple[str, ...]] | None = None,
                entered: list[tuple[str, ...]] | None = None, shown: tuple[Column | str, ...] | None = None) -> DataFrame:
    """Answer a table of lookup requests: request_id, the required and optional names, and terms_hash.

    A null in an optional column, or in terms_hash, switches that condition off. Every catalog row is entered under
    each combination of conditions that can reach it, so all requests are answered by one equi-join on exactly the
    columns they set: no request meets a row it does not name, and both sides are read once. Give `masks` (tuples of
    column names) when only some combinations occur. Adaptive execution splits a hot request key.

    Where few rows share the required names, a row needn't cross the exchange once for each combination: `entered` lists the combinations
    to enter rows under, `[()]` for the required names alone. A request meets rows under the first whose conditions it sets, and its
    other conditions are compared there. `shown` are the columns to answer with, all by default, computed once for a row, whose prices
    are in presentation order.
    """
    asked, met, keys, rest = _met(_with_sorted_prices(rows), requests, required, optional, masks, entered)
    met = met.select(*(F.col(k).alias(f"_e_{k}") for k in keys), *(F.col(f).alias(f"_r_{f}") for f in rest), *(shown or rows.columns))
    asked = asked.select(F.col(request_id).alias("_id"), *(F.col(k).alias(f"_a_{k}") for k in keys), *(F.col(f).alias(f"_w_{f}") for f in rest))
    out = asked.join(met, _meets(keys, rest))
    return out.select(F.col("_id").alias(request_id), *(c for c in met.columns if c not in (
        *(f"_e_{k}" for k in keys), *(f"_r_{f}" for f in rest))))


def _meets(keys: list[str], rest: list[str]) -> Column:
    """A request (_a_ and _w_ columns) names a row (_e_ and _r_ columns): equal keys, and equal conditions where it sets any."""
    return _all([F.col(f"_a_{k}") == F.col(f"_e_{k}") for k in keys]
                + [F.col(f"_w_{f}").isNull() | (F.col(f"_w_{f}") == F.col(f"_r_{f}")) for f in rest])


def _met(rows: DataFrame, requests: DataFrame, required: tuple[str, ...], optional: tuple[str, ...],
         masks: list[tuple[str, ...]] | None, under: list[tuple[str, ...]] | None = None
         ) -> tuple[DataFrame, DataFrame, list[str], list[str]]:
    """Requests and entered rows with the key columns on which they meet, and the conditions left to compare."""
    flags = (*optional, "terms_hash")
    if under is None:
        if masks is None:
            masks = [tuple(f for f, on in zip(flags, bits) if on) for bits in product((True, False), repeat=len(flags))]
        mask = F.concat_ws(",", *(F.when(F.col(f).isNotNull(), f) for f in flags))
        asked = requests.withColumns({"_mask": mask, **{f"_k_{f}": F.coalesce(f, F.lit("")) for f in flags}})
        under, held, rest = masks, flags, []
    else:
        sets = [(_all([F.col(f).isNotNull() for f in m]), m) for m in under]
        held = [f for f in flags if any(f in m for m in under)]
        asked = requests.withColumn("_mask", first_case((given, ",".join(m)) for given, m in sets))
        asked = asked.withColumns({f"_k_{f}": F.when(F.array_contains(F.split("_mask", ","), f), F.col(f)).otherwise("") for f in held})
        rest = list(flags)
    # Key columns first, so the rows' own columns keep their values whatever the combination.
    entered = rows.withColumn("_mask", F.explode(F.array(*(F.lit(",".join(m)) for m in under)))) if under != [()] else rows
    names = F.split("_mask", ",")
    entered = entered.withColumns({
        f"_k_{f}": F.when(F.array_contains(names, f), F.col(f)).otherwise("") for f in held}) if held else entered
    return asked, entered, [*required, *(["_mask"] if under != [()] else []), *(f"_k_{f}" for f in held)], rest


def lookup_listed(rows: DataFrame, requests: DataFrame, order: tuple[Column | str, ...], shown: tuple[Column | str, ...],
                  required: tuple[str, ...] = ("kind", "resource_name"),
                  optional: tuple[str, ...] = ("provider", "service", "region"),
                  request_id: str = "request_id", keep: tuple[str, ...] = (),
                  masks: list[tuple[str, ...]] | None = None) -> DataFrame:
    """Answers of lookup_many as lists: request_id, columns of the request to keep, position (from 1) and the shown columns of
    the row. A request without an answer has one record, whose position is null and which alone holds the columns to keep.

    Rows are numbered under each name they are entered under, so answers are neither sorted nor shuffled, however many there are. Requests
    meet the rows of their name in blocks of BLOCK: rows of one name spread over tasks, and a request travels once for each block.
    """
    asked, entered, keys, _ = _met(rows, requests, required, optional, masks)
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    listed = entered.select(*keys, position.alias("position"), F.struct(*shown).alias("_row")).withColumn(
        "_block", F.floor((F.col("position") - 1) / BLOCK))
    sizes = entered.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    asked = asked.select(request_id, *keep, *keys).join(sizes, keys, "left")
    last = F.coalesce(F.floor((F.col("_n") - 1) / BLOCK), F.lit(0).cast("bigint"))
    asked = asked.select(request_id, *(F.when(F.col("_n").isNull(), F.col(c)).alias(c) for c in keep), *keys,
                         F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_block"))
    # a fixed number of parts: requests are few bytes, and by their bytes adaptive execution would gather them in one task
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = asked.repartition(parts, *keys, "_block").join(listed, [*keys, "_block"], "left")
    return met.select(request_id, *keep, "position", "_row.*")


def lookup_exact(rows: DataFrame, requests: DataFrame, keys: tuple[str, ...],
                 request_id: str = "request_id") -> DataFrame:
    """The common case of lookup_many: every request sets the same columns, so it is a single equi-join."""
    return _with_sorted_prices(requests.select(request_id, *keys).join(rows, list(keys)))


def lookup_missing(rows: DataFrame, requests: DataFrame,
                   required: tuple[str, ...] = ("kind", "resource_name"),
                   optional: tuple[str, ...] = ("provider", "service", "region"),
                   request_id: str = "request_id", masks: list[tuple[str, ...]] | None = None,
                   entered: list[tuple[str, ...]] | None = None) -> DataFrame:
    """Not-found records of lookup_many without its answers: one anti join of the requests with the entered rows' keys.

    Ids of requests must be distinct; where they aren't, use `unmatched`."""
    asked, met, keys, rest = _met(rows, requests, required, optional, masks, entered)
    met = met.select(*(F.col(k).alias(f"_e_{k}") for k in keys), *(F.col(f).alias(f"_r_{f}") for f in rest))
    asked = asked.select(*requests.columns, *(F.col(k).alias(f"_a_{k}") for k in keys), *(F.col(f).alias(f"_w_{f}") for f in rest))
    filters = [c for c in requests.columns if c != request_id]
    return asked.join(met, _meets(keys, rest), "left_anti").select(
        request_id, F.lit("not_found").alias("code"), F.to_json(F.struct(*filters)).alias("applied_filters"))


def unmatched(requests: DataFrame, answers: DataFrame, request_id: str = "request_id") -> DataFrame:
    """Not-found records: the requests without any answer, with the filters they applied."""
    filters = [c for c in requests.columns if c != request_id]
    return (requests.join(answers.select(request_id).distinct(), request_id, "left_anti")
            .select(request_id, F.lit("not_found").alias("code"),
                    F.to_json(F.struct(*filters)).alias("applied_filters")))


SEARCH_SORTS = ("", "resource_name", "price", "vcpu", "memory")


def search(rows: DataFrame, provider: str, service: str, kind: str = "", resource: str = "", region: str = "",
           min_vcpu: int = 0, min_memory_gb: float = 0.0, max_price: float = 0.0, sort: str = "",
           limit: int = 50) -> DataFrame:
    """Filtered search in one service; a limit of 0 returns everything. Sort and limit become a top-k per task."""
    if not provider or not service:
        raise ValueError("search needs a provider and a service")
    if sort not in SEARCH_SORTS:
        raise ValueError(f"unsupported sort {sort!r}; allowed: resource_name, price, vcpu, memory")
    keep = [F.col("provider") == provider, F.col("service") == service]
    for column, value in (("kind", kind), ("resource_name", resource), ("region", region)):
        if value:
            keep.append(F.col(column) == value)
    if min_vcpu > 0:
        keep.append(F.col("resource_attrs.vcpu") >= min_vcpu)
    if min_memory_gb > 0:
        keep.append(F.col("resource_attrs.memory_gb") >= min_memory_gb)
    out = rows.filter(_all(keep)).withColumn("min_price", min_price())
    if max_price > 0:
        out = out.filter(F.col("min_price") <= max_price)
    order = {
        "price": [F.asc_nulls_last("min_price"), F.asc("sku_id")],
        "vcpu": [F.col("resource_attrs.vcpu").asc_nulls_first(), F.asc("sku_id")],
        "memory": [F.col("resource_attrs.memory_gb").asc_nulls_first(), F.asc("sku_id")],
    }.get(sort, [F.asc("resource_name"), F.asc("sku_id")])
    out = _with_sorted_prices(out).orderBy(*order)
    return out.limit(limit) if limit > 0 else out
