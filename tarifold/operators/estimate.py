"""Bulk cost estimation: a table of workload items against the catalog. The rules of the kinds are in `estimators`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tarifold import vocab
from tarifold.functions.cases import apart, first_case, mapped
from tarifold.functions.numbers import significant
from tarifold.operators.estimators import KINDS, estimators, priced_items

#: A list of key=value parameters, and one that names a key twice.
_PAIRS = r"^[^:=]+=[^:]*(?::[^:=]+=[^:]*)*\z"
_REPEATED = r"(?s):([^:=]+)=.*:\1="


# --- items -----------------------------------------------------------------------------------------------------

def _kind_of(provider: Column, service: Column) -> Column:
    return mapped(F.concat_ws("/", provider, service), vocab.ESTIMATE_KINDS)


def parse_items(lines: DataFrame, raw: str = "raw", index: str = "item_index") -> DataFrame:
    """Items from text: `provider/service:resource[:key=value...]` or `llm:model[:key=value...]`.

    A line that does not parse keeps its position and carries an error instead of stopping the job. The index may be a
    struct that names the line; numbers become bigint.
    """
    text = F.coalesce(F.col("raw"), F.lit(""))
    named = isinstance(lines.schema[index].dataType, T.StructType)
    # As a generator's output the text is computed once, and conditions on what is read from it stay above it. A kind is read from the
    # text by a short expression, since a condition on it is computed beside it.
    line = F.struct(apart(F.col(index) if named else F.col(index).cast("bigint")).alias("item_index"), F.col(raw).alias("raw"))
    df = lines.select(F.array(line).alias("line")).select(F.inline("line"))
    shown = F.lower(F.substring_index(text, ":", 1))
    df = df.withColumns({
        "kind": F.when(shown == "llm", "llm.text").otherwise(mapped(shown, vocab.ESTIMATE_KINDS)),
        "_text": apart(text), "_first": F.instr(text, ":")})
    df = df.withColumns({"_head": F.substring_index("_text", ":", 1),
                         "_rest": F.expr("IF(_first = 0, NULL, substring(_text, _first + 1))")})
    df = df.withColumns({
        "resource": F.substring_index("_rest", ":", 1),
        "_tail": F.expr("CASE WHEN instr(_rest, ':') > 0 THEN substring(_rest, instr(_rest, ':') + 1) END"),
        "_cut": F.instr("_head", "/"), "_llm": F.lower("_head") == "llm"})
    head, resource, llm, cut, tail = (F.col(c) for c in ("_head", "resource", "_llm", "_cut", "_tail"))
    df = df.withColumns({
        "provider": F.when(llm, "llm").otherwise(F.lower(F.substring_index(head, "/", 1))),
        "service": F.when(llm, "text").otherwise(F.lower(F.substr(head, cut + 1))),
    })
    error = first_case([
        (F.coalesce("raw", F.lit("")) == "", "empty item"),
        (F.col("_first") == 0, "item has no resource"),
        (~llm & ((cut <= 1) | (cut == F.length(head))), "first segment must be provider/service"),
        (resource == "", F.when(llm, "empty model").otherwise("empty resource")),
        (F.col("kind").isNull(), "unsupported provider/service"),
        (~tail.rlike(_PAIRS), "parameter must be key=value"),
        (F.concat(F.lit(":"), F.lower(tail)).rlike(_REPEATED), "duplicate parameter"),
    ])
    df = df.withColumns({"resource": apart(resource), "error": error})
    # keys in lower case, values as they are; both maps keep the order of the text
    params = F.expr("""CASE WHEN error IS NULL AND _tail IS NOT NULL THEN map_from_arrays(
        map_keys(str_to_map(lower(_tail), ':', '=')), map_values(str_to_map(_tail, ':', '=')))
        ELSE CAST(map() AS map<string,string>) END""")
    return df.select("item_index", "raw", apart(F.col("provider")).alias("provider"), "service", "resource", "kind", params.alias("params"), "error")


def workload_items(documents: DataFrame, json: str = "value") -> DataFrame:
    """Items from structured workload documents (one JSON document per row), in document order."""
    schema = "items array<struct<provider string, service string, resource string, params map<string,string>>>"
    parsed = documents.withColumn("_doc", F.from_json(F.col(json), schema, {"mode": "FAILFAST"}))
    checked = parsed.filter(F.when(F.coalesce(F.size("_doc.items"), F.lit(0)) <= 0,
                                   F.raise_error("workload items must be non-empty").cast("boolean"))
                            .otherwise(F.lit(True)))
    item = checked.select(F.posexplode("_doc.items").alias("item_index", "i")).select("item_index", "i.*")
    whole = F.transform_values(F.coalesce("params", F.create_map().cast("map<string,string>")),
                               lambda k, v: F.regexp_replace(v, r"^(-?\d+)\.0+$", "$1"))
    entries = F.transform(F.map_entries(whole), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"]))
    keys = F.transform(entries, lambda e: e["key"])
    item = item.withColumn("_entries", F.array_sort(entries)).withColumn("_keys", keys)
    provider, service = F.lower("provider"), F.lower("service")
    kind = _kind_of(provider, service)
    error = (
        F.when(F.coalesce(F.col("provider"), F.lit("")) == "", "empty provider")
        .when(F.coalesce(F.col("service"), F.lit("")) == "", "empty service")
        .when(F.coalesce(F.col("resource"), F.lit("")) == "", "empty resource")
        .when(kind.isNull(), "unsupported provider/service")
        .when(F.size(F.array_distinct("_keys")) < F.size("_keys"), "duplicate parameter")
        .when(F.exists("_entries", lambda e: e["value"].isNull()), "null parameter")
    )
    shown = F.concat_ws(":", F.concat_ws("/", provider, service), "resource", F.transform(
        "_entries", lambda e: F.concat_ws("=", e["key"], e["value"])))
    return item.select(
        F.col("item_index").cast("bigint").alias("item_index"), shown.alias("raw"), provider.alias("provider"),
        service.alias("service"), "resource", kind.alias("kind"),
        F.when(error.isNull(), F.map_from_entries("_entries")).otherwise(
            F.create_map().cast("map<string,string>")).alias("params"),
        error.alias("error"),
    )


# --- estimates -------------------------------------------------------------------------------------------------

def kinds_in(items: DataFrame) -> list[str]:
    """The kinds that occur: at most one value for each estimator."""
    found = {r.kind for r in items.select("kind").distinct().collect()}
    return [k for k in KINDS if k in found]


def estimate(items: DataFrame, rows: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Line items of a table of workload items; an item that cannot be priced carries an error and no amounts.

    The catalog rows of each kind are reduced to one card per name an item can ask for, with the few numbers that price it; all items
    join the cards of all kinds once, and the arithmetic of their kind follows. Delivery networks, whose cards are found in two
    ways, have a join of their own. No item ever meets more than one card, so the output is as large as the input
    however popular a name is; adaptive execution splits a hot name. Kinds that occur are looked up first, unless they are given; items of
    kinds that aren't given get no estimator.
    """
    kinds = kinds_in(items) if kinds is None else kinds
    every = {k: e for k, e in estimators().items() if k in kinds}
    alone = [k for k, e in every.items() if e.joined is not None]
    apart_of_rest = F.coalesce(F.col("kind").isin(*alone), F.lit(False)) if alone else F.lit(False)
    out = priced_items({k: e for k, e in every.items() if k not in alone}, items.filter(~apart_of_rest), rows)
    for kind in alone:
        out = out.unionByName(priced_items({kind: every[kind]}, items.filter(F.col("kind") == kind), rows))
    return out


def estimate_total(lines: DataFrame, strict: bool = True, digits: int = 6) -> DataFrame:
    """Monthly total in USD. Strict: the first failing item (by position) fails the job, as a single run would."""
    total = lines.agg(F.sum("monthly_usd").alias("monthly_usd"), F.count("monthly_usd").alias("n_items"),
                      F.min(F.when(F.col("error").isNotNull(), F.struct("item_index", "raw", "error"))).alias("bad"))
    if strict:
        total = total.filter(F.when(F.col("bad").isNotNull(), F.raise_error(F.concat_ws(
            " ", F.lit("item"), F.col("bad.item_index"), F.col("bad.raw"), F.col("bad.error"))).cast("boolean"))
            .otherwise(F.lit(True)))
    return total.select(significant(F.coalesce("monthly_usd", F.lit(0.0)), digits).alias("monthly_usd"),
                        F.lit("USD").alias("currency"), "n_items")


def rounded_lines(lines: DataFrame) -> DataFrame:
    """Display form: hourly and monthly amounts to six significant digits."""
    return lines.withColumns({c: significant(F.col(c)) for c in ("hourly_usd", "monthly_usd")})
