"""How the items of each kind are priced: what they ask for, the card that answers, and the arithmetic.

A card is one row per name an item can ask for, made on the catalog side: which row is priced, how many rows answer to the name,
and the amounts, units and tier indexes the kind needs. The item side only joins its card and does arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tarifold.functions.cases import apart, first_case, mapped
from tarifold.functions.numbers import quantity
from tarifold.functions.terms import terms_hash
from tarifold.functions.tiers import BYTE_BOUNDS, COUNT_BOUNDS, UNBOUNDED, bad_tiers, cost_at, tier_index
from tarifold.operators.compare import extra_field
from tarifold.operators.rows import sorted_prices

# Units and dimension names the price rules recognise, and defaults.
HOURLY_UNITS = ("hour", "hrs", "hr")
HOURS_PER_MONTH = 730.0
PUT_DIMENSIONS = ("requests-put", "write-ops")
GET_DIMENSIONS = ("requests-get", "read-ops")
PROMPT_DIMENSIONS = ("prompt", "input", "input_tokens")
COMPLETION_DIMENSIONS = ("completion", "output", "output_tokens")
EDGE_FALLBACK_BYTES = {"aws/cloudfront": 10e12}
SPANNER_EDITIONS = ("standard", "enterprise", "enterprise-plus")
WAREHOUSE_RESOURCES = ("on-demand", "capacity-standard", "capacity-enterprise", "capacity-enterprise-plus",
                       "storage-active", "storage-long-term")
QUEUE_DIMENSIONS = ("request", "call", "event")
CALL_DIMENSIONS = ("request", "call")
METERS = {"tu_hours": "tu_hour", "ppu_hours": "ppu_hour", "mu_hours": "mu_hour"}
METER_UNITS = {"tu_hours": "tu-hr", "ppu_hours": "ppu-hr", "mu_hours": "mu-hr"}

_KEYS = ("k_provider", "k_service", "k_resource", "k_region", "k_terms")
_ROW = ("sku_id", "provider", "service", "resource_name", "region")


@dataclass(frozen=True)
class Priced:
    """The numbers of a line item; error is null where they count."""

    monthly: Column
    error: list[Column]
    quantity: Column = field(default_factory=lambda: F.lit(None).cast("double"))
    unit: Column = field(default_factory=lambda: F.lit(None).cast("string"))
    hourly: Column = field(default_factory=lambda: F.lit(None).cast("double"))
    notes: Column = field(default_factory=lambda: F.lit(None).cast("array<string>"))


@dataclass(frozen=True)
class Estimator:
    """rows: the catalog rows of the kind. numbers: parameters read as quantities, with their defaults. ask: the parts of
    the name that aren't the item's provider, service, resource and region and empty terms on demand. card: cards of the
    rows; joined: items with their cards, where that is no plain join. price: the arithmetic. A parameter has the same default in all
    kinds."""

    rows: Column
    numbers: dict[str, float]
    ask: Callable[[], dict[str, Column]]
    card: Callable[[DataFrame], DataFrame] | None
    price: Callable[[], Priced]
    regional: bool = True
    joined: Callable[[DataFrame, DataFrame], DataFrame] | None = None


# --- the item side ---------------------------------------------------------------------------------------------

def _has(name: str) -> Column:
    return F.expr(f"coalesce(params['{name}'], '') <> ''")


def _given(name: str) -> Column:
    return F.expr(f"params['{name}'] IS NOT NULL")


def _param(name: str, default: str = "") -> Column:
    return F.expr(f"CASE WHEN coalesce(params['{name}'], '') = '' THEN '{default}' ELSE params['{name}'] END")


def _n(name: str) -> Column:
    """Numeric parameter: its default when not given, null when unreadable."""
    return F.col(f"n_{name}")


def _bad(name: str, minimum: float = 0.0) -> Column:
    """Error text of a parameter that is given but unreadable or too small."""
    return F.when(_given(name) & F.coalesce(_n(name) < minimum, F.lit(True)),
                  f"{name} is not a number of at least {minimum:g}")


def _needs(condition: Column, what: str) -> Column:
    return F.when(condition, f"needs {what}")


def _timed() -> list[Column]:
    whole = F.expr("coalesce(try_cast(params['count'] AS int) < 1, true)")
    return [F.when(_given("count") & whole, "count is not a whole number of at least 1"), _bad("hours")]


def _unpriced(amount: str) -> Column:
    return F.when(F.coalesce(F.col(amount), F.lit(0.0)) == 0, "no matching price")


def _many(text: str = "ambiguous: more than one catalog row") -> Column:
    return F.when(F.col("n_rows") > 1, text)


def _on_demand(tenancy: Column | str = "", os: Column | str = "") -> Column:
    def c(v):
        return v if isinstance(v, Column) else F.lit(v)
    return F.concat_ws("|", F.lit("on_demand"), c(tenancy), c(os), F.lit("||"))


def _of_kind(kinds: list[str], values: list[Column], default: Column) -> Column:
    """The value of the item's kind."""
    return first_case([(F.col("kind") == k, v) for k, v in zip(kinds, values)], default) if kinds else default


def priced_items(rules: dict[str, Estimator], items: DataFrame, rows: DataFrame) -> DataFrame:
    """Line items of the kinds of the rules; an item of another kind is an error.

    One join serves all kinds: names carry their kind, and cards of all kinds are one table. A rule with a join of its own stands alone.
    """
    kinds = list(rules)
    base = {"k_provider": F.col("provider"), "k_service": F.col("service"), "k_resource": F.col("resource"),
            "k_region": _param("region"), "k_terms": _on_demand()}
    asks = [base | e.ask() for e in rules.values()]
    ask = {n: _of_kind(kinds, [a.get(n, F.lit("")) for a in asks], F.lit("")) for n in dict.fromkeys(n for a in [base, *asks] for n in a)}
    # Many branches: see apart()
    asked = items.select("item_index", "raw", "kind", "params", "error", apart(F.col("resource")).alias("asked"),
                         *(F.coalesce(c, F.lit("")).alias(n) for n, c in ask.items()))
    own = [e for e in rules.values() if e.joined is not None]
    if own:
        (rule,) = rules.values()
        joined = rule.joined(asked, rows.filter(rule.rows))
    elif rules:
        cards = None
        for kind, e in rules.items():
            card = e.card(rows.filter(e.rows)).withColumn("k_kind", F.lit(kind))
            cards = card if cards is None else cards.unionByName(card, allowMissingColumns=True)
        on = [asked[k] == cards[k] for k in _KEYS] + [F.col("kind") == F.col("k_kind")]
        joined = asked.join(cards, on, "left").select(*(asked[c] for c in asked.columns), *(
            cards[c] for c in cards.columns if c not in _KEYS))
    else:
        joined = asked.select("*", *(F.lit(None).cast("string").alias(c) for c in _ROW))
    defaults = {n: d for e in rules.values() for n, d in e.numbers.items()}
    numbers = joined.select(*joined.columns, *(
        F.when(~_given(n), F.lit(d)).otherwise(quantity(F.col("params")[n])).alias(f"n_{n}") for n, d in defaults.items()),
        apart(F.col("params")["region"]).alias("place"))
    prices = [e.price() for e in rules.values()]
    unknown = F.when(F.col("kind") == "messaging.topic", "estimate not available for messaging.topic").otherwise("no estimator for kind")
    missing = [F.when(F.coalesce(F.col("place"), F.lit("")) == "", "missing region") if e.regional else F.lit(None).cast("string") for e in rules.values()]
    found = [F.coalesce(m, F.when(F.col("sku_id").isNull(), "no matching catalog row"), *p.error) for m, p in zip(missing, prices)]
    problem = F.coalesce(F.col("error"), _of_kind(kinds, found, unknown))

    def value(field: str, kind: str) -> Column:
        return _of_kind(kinds, [getattr(p, field) for p in prices], F.lit(None).cast(kind))

    priced = numbers.select(
        "item_index", apart(F.col("raw")).alias("raw"), "kind", *_ROW, problem.alias("problem"), value("hourly", "double").alias("hourly"),
        value("quantity", "double").alias("qty"), value("unit", "string").alias("unit"), value("monthly", "double").alias("monthly"),
        value("notes", "array<string>").alias("noted"))
    good = F.col("problem").isNull()
    shown = {"sku_id": "sku_id", "provider": "provider", "service": "service", "resource": "resource_name", "region": "region",
             "hourly_usd": "hourly", "quantity": "qty", "quantity_unit": "unit", "monthly_usd": "monthly", "notes": "noted"}
    return priced.select("item_index", "raw", "kind", *(F.when(good, F.col(c)).alias(n) for n, c in shown.items()),
                         F.col("problem").alias("error"))


# --- the catalog side ------------------------------------------------------------------------------------------

def _terms_text() -> Column:
    terms = F.col("terms")
    return F.concat_ws("|", *(F.coalesce(terms[f], F.lit("")) for f in (
        "commitment", "tenancy", "os", "support_tier", "upfront", "payment_option")))


def _names(terms: Column | None = None, **parts: Column) -> Column:
    """The name a row answers to."""
    own = {"k_provider": F.col("provider"), "k_service": F.col("service"), "k_resource": F.col("resource_name"),
           "k_region": F.col("region"), "k_terms": terms if terms is not None else _terms_text()} | parts
    return F.struct(*(F.coalesce(own[k], F.lit("")).alias(k) for k in _KEYS))


def _cards(rows: DataFrame, values: dict[str, Column], names: Column | None = None, rank: Column | None = None,
           last: bool = False) -> DataFrame:
    """One row per name: n_rows, the row of the least rank (then region, then id; or the greatest) and its values.

    names: an array of names, or nothing for the row's own. Partial sums on the map side, so a name that reaches a third
    of the catalog is no hot spot."""
    row = F.struct(*_ROW, *(c.alias(n) for n, c in values.items()))
    at = F.struct((rank if rank is not None else F.lit(0.0)).alias("rank"), "region", "sku_id")
    named = rows.withColumn("prices", sorted_prices()).select(
        (names if names is not None else F.array(_names())).alias("names"), row.alias("row"), at.alias("at")).select(
        F.inline("names"), "row", "at")
    best = F.max_by("row", "at") if last else F.min_by("row", "at")
    return named.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n_rows"), best.alias("row")).select(*_KEYS, "n_rows", "row.*")


def _fitting(dimensions: Column | tuple[str, ...] = (), units: Column | tuple[str, ...] = (), first_tier: bool = False) -> Column:
    """Prices of these dimensions and units (empty: any), in presentation order."""
    def within(names: Column | tuple[str, ...], value: Column) -> Column:
        if isinstance(names, Column):
            return names == value
        return value.isin(*names) if names else F.lit(True)
    return F.filter("prices", lambda p: within(dimensions, p["dimension"]) & within(units, p["unit"])
                    & ((p["tier"] == "0") if first_tier else F.lit(True)))


def _first(prices: Column, name: str = "hit") -> dict[str, Column]:
    price = F.get(prices, F.lit(0))
    return {name: price["amount"], f"{name}_unit": price["unit"]}


def _last(prices: Column) -> Column:
    return F.try_element_at(prices, F.lit(-1))["amount"]


def _cheapest(prices: Column) -> dict[str, Column]:
    """Cheapest positive price; of equal ones the first unit."""
    best = F.array_min(F.transform(F.filter(prices, lambda p: p["amount"] > 0), lambda p: F.struct(p["amount"], p["unit"])))
    return {"hit": best["amount"], "hit_unit": best["unit"]}


def _bound(token: Column, is_bytes: bool = False) -> Column:
    """Tier bound by literal table: empty is unbounded, then the tokens of the domain, then plain numbers."""
    known = mapped(token, BYTE_BOUNDS if is_bytes else COUNT_BOUNDS)
    return F.when(F.coalesce(token, F.lit("")) == "", F.lit(UNBOUNDED)).otherwise(F.coalesce(known, token.try_cast("double")))


def _tiers(dimension: Column) -> Column:
    entries = F.transform(F.filter("prices", lambda p: p["dimension"] == dimension), lambda p: F.struct(
        _bound(p["tier"]).alias("lower"), _bound(p["tier_upper"]).alias("upper"), p["amount"].alias("amount")))
    return F.array_sort(entries)


def _index(dimension: Column, name: str) -> dict[str, Column]:
    """Tier index of a dimension's prices, and whether its tiers can't be read."""
    entries = _tiers(dimension)
    broken = F.coalesce(bad_tiers(entries), F.lit(False))
    places = F.when(~broken & (F.size(entries) > 0), tier_index(entries))
    return {name: places, f"{name}_broken": broken}


def _has_dimension(name: str) -> Column:
    return F.exists("prices", lambda p: p["dimension"] == name)


def _used(dimensions: tuple[str, ...]) -> Column:
    """The first of the dimensions that has a price, empty if none has."""
    return first_case([(_has_dimension(d), d) for d in dimensions], "")


# --- the kinds -------------------------------------------------------------------------------------------------

def _machine() -> Estimator:
    def price() -> Priced:
        qty = _n("hours") * _n("count")
        return Priced(F.col("hit") * qty, [*_timed(), _many(), _unpriced("hit")], qty, F.col("hit_unit"), F.col("hit"))

    return Estimator(
        F.col("kind") == "compute.vm", {"hours": HOURS_PER_MONTH, "count": 1.0},
        lambda: {"k_terms": F.concat_ws("|", _param("commitment", "on_demand"), _param("tenancy", "shared"),
                                        _param("os", "linux"), F.lit("||"))},
        lambda rows: _cards(rows, _first(_fitting(("compute",), HOURLY_UNITS))), price)


def _objects() -> Estimator:
    def price() -> Priced:
        zero = F.lit(0.0)
        monthly = (_n("gb_month") * F.coalesce("hit", zero) + _n("put_requests") * F.coalesce("put", zero)
                   + _n("get_requests") * F.coalesce("gets", zero))
        return Priced(monthly, [
            _bad("gb_month"), _bad("put_requests"), _bad("get_requests"), _many(),
            F.when((_n("gb_month") > 0) & F.col("hit").isNull(), "no storage price"),
            F.when((_n("put_requests") > 0) & F.col("put").isNull(), "no put-requests price"),
            F.when((_n("get_requests") > 0) & F.col("gets").isNull(), "no get-requests price"),
        ], _n("gb_month"), F.lit("gb-mo"))

    return Estimator(
        F.col("kind") == "storage.object", {"gb_month": 0.0, "put_requests": 0.0, "get_requests": 0.0}, dict,
        lambda rows: _cards(rows, {"hit": _last(_fitting(("storage",))), "put": _last(_fitting(PUT_DIMENSIONS)),
                                   "gets": _last(_fitting(GET_DIMENSIONS))}), price)


def _models() -> Estimator:
    """A model answers by provider and, unless it is the synthetic aggregate, without one."""
    def card(rows: DataFrame) -> DataFrame:
        empty = F.lit("")
        by_provider = _names(empty, k_service=empty, k_region=empty)
        alone = _names(empty, k_provider=empty, k_service=empty, k_region=empty)
        names = F.when(F.col("provider") == "openrouter", F.array(by_provider)).otherwise(F.array(by_provider, alone))
        return _cards(rows, {"hit": _last(_fitting(PROMPT_DIMENSIONS)), "second": _last(_fitting(COMPLETION_DIMENSIONS))}, names)

    def price() -> Priced:
        zero, requests = F.lit(0.0), _n("requests")
        monthly = _n("input") * F.coalesce("hit", zero) + _n("output") * F.coalesce("second", zero)
        qty = _n("input") + _n("output")
        notes = F.array_compact(F.array(F.concat(F.lit("serving_provider="), F.col("provider")), F.when(
            requests > 0, F.concat(F.lit("requests="), requests.cast("bigint")))))
        return Priced(monthly, [
            _bad("input"), _bad("output"), _needs(qty == 0, "input and/or output tokens"), _bad("requests"),
            _many("ambiguous: name a serving_provider"),
            F.when((_n("input") > 0) & F.col("hit").isNull(), "no prompt price"),
            F.when((_n("output") > 0) & F.col("second").isNull(), "no completion price"),
        ], qty, F.lit("token"), notes=notes)

    return Estimator(
        F.col("kind").startswith("llm."), {"input": 0.0, "output": 0.0, "requests": 0.0},
        lambda: {"k_provider": F.lower(_param("serving_provider")), "k_service": F.lit(""), "k_region": F.lit(""),
                 "k_terms": F.lit("")}, card, price, regional=False)


def _aurora() -> Estimator:
    elastic = F.col("asked") == "serverless-v2"

    def card(rows: DataFrame) -> DataFrame:
        v2 = F.col("resource_name") == "aurora-serverless-v2"
        picked = F.when(v2, _fitting(("compute",), ("acu-hr",))).otherwise(_fitting(("compute",), HOURLY_UNITS))
        values = _cheapest(picked)
        return _cards(rows, values, rank=F.coalesce(values["hit"], F.lit(float("inf"))))

    def price() -> Priced:
        qty = F.when(elastic, _n("acu_hours")).otherwise(_n("hours") * _n("count"))
        return Priced(F.col("hit") * qty, [_unpriced("hit"), F.when(elastic, F.coalesce(
            _bad("acu_hours"), _needs(_n("acu_hours") <= 0, "acu_hours"))).otherwise(F.coalesce(*_timed()))],
            qty, F.col("hit_unit"), F.col("hit"))

    return Estimator(
        (F.col("kind") == "db.relational") & (F.col("service") == "aurora"),
        {"hours": HOURS_PER_MONTH, "count": 1.0, "acu_hours": 0.0},
        lambda: {"k_resource": F.when(F.col("resource") == "serverless-v2", "aurora-serverless-v2").otherwise(F.col("resource")),
                 "k_terms": _on_demand(_param("engine", "aurora-postgres"), "single-az")}, card, price)


def _spanner() -> Estimator:
    def price() -> Priced:
        qty = F.when(_n("pu") != 0, _n("pu")).otherwise(_n("node") * 1000) * _n("hours")
        return Priced(F.col("hit") * qty, [
            F.when(~F.col("asked").isin(*SPANNER_EDITIONS), "unknown edition"), _many(), _bad("pu"), _bad("node"),
            _needs((_n("pu") == 0) & (_n("node") == 0), "pu or node"), _bad("hours"), _unpriced("hit"),
        ], qty, F.lit("pu-hour"), F.col("hit"))

    def ask() -> dict[str, Column]:
        name = F.concat(F.lit("spanner-"), F.col("resource"))
        return {"k_resource": name, "k_terms": _on_demand(name)}

    return Estimator(F.col("kind") == "db.relational", {"pu": 0.0, "node": 0.0, "hours": HOURS_PER_MONTH}, ask,
                     lambda rows: _cards(rows, _first(_fitting(("compute",)))), price)


def _cosmos() -> Estimator:
    serverless = F.col("asked") == "serverless"

    def price() -> Priced:
        qty = F.when(serverless, _n("ru_million")).otherwise(_n("ru_per_sec") * _n("hours"))
        return Priced(F.col("hit") * qty, [
            F.when(~F.col("asked").isin("provisioned", "serverless"), "unknown capacity mode"), _many(),
            F.when(serverless, _bad("ru_million", 1.0)).otherwise(F.coalesce(_bad("ru_per_sec", 1.0), _bad("hours"))),
            _unpriced("hit"),
        ], qty, F.when(serverless, "1M-ru").otherwise("ru/s-hour"), F.col("hit"))

    return Estimator(
        F.col("kind") == "db.nosql", {"ru_million": 0.0, "ru_per_sec": 0.0, "hours": HOURS_PER_MONTH},
        lambda: {"k_resource": F.concat(F.lit("cosmos-"), F.col("resource")),
                 "k_terms": _on_demand(_param("api", "sql"), F.col("resource"))},
        lambda rows: _cards(rows, _first(_fitting(F.regexp_replace("resource_name", "^cosmos-", "")))), price)


def _opensearch() -> Estimator:
    serverless = F.col("asked") == "serverless"

    def card(rows: DataFrame) -> DataFrame:
        elastic = F.col("terms.os") == "serverless"
        capacity = _fitting(("compute-ocu",))
        last = {"hit": _last(capacity), "hit_unit": F.lit("ocu-hour")}
        return _cards(rows.filter(elastic & _has_dimension("compute-ocu")), last, last=True).unionByName(
            _cards(rows.filter(~F.coalesce(elastic, F.lit(False))), _cheapest(_fitting((), HOURLY_UNITS))))

    def price() -> Priced:
        qty = F.when(serverless, _n("ocu_hours")).otherwise(_n("hours") * _n("count"))
        return Priced(F.col("hit") * qty, [F.when(serverless, F.coalesce(
            _bad("ocu_hours"), _needs(_n("ocu_hours") <= 0, "ocu_hours"))).otherwise(F.coalesce(*_timed())), _unpriced("hit")],
            qty, F.col("hit_unit"), F.col("hit"))

    return Estimator(
        F.col("kind") == "search.engine", {"ocu_hours": 0.0, "hours": HOURS_PER_MONTH, "count": 1.0},
        lambda: {"k_resource": F.when(F.col("resource") == "serverless", "opensearch-serverless").otherwise(F.col("resource")),
                 "k_terms": _on_demand("shared", F.when(F.col("resource") == "serverless", "serverless").otherwise("managed-cluster"))},
        card, price)


def _app_plan() -> Estimator:
    """An app plan answers with and without its tier."""
    def card(rows: DataFrame) -> DataFrame:
        terms = F.col("terms")
        tiered = F.coalesce(terms["support_tier"], F.lit("")) != ""
        names = F.when(tiered, F.array(_names(terms["os"]), _names(F.concat_ws(",", terms["os"], terms["support_tier"])))).otherwise(
            F.array(_names(terms["os"])))
        return _cards(rows.filter(terms["commitment"] == "on_demand"), _cheapest(_fitting((), HOURLY_UNITS)), names)

    def price() -> Priced:
        qty = _n("hours") * _n("count")
        return Priced(F.col("hit") * qty, [_unpriced("hit"), *_timed()], qty, F.col("hit_unit"), F.col("hit"))

    return Estimator(
        F.col("kind") == "paas.app", {"hours": HOURS_PER_MONTH, "count": 1.0},
        lambda: {"k_terms": F.concat_ws(",", _param("os", "linux"), F.nullif(_param("tier"), F.lit("")))}, card, price)


def _warehouse() -> Estimator:
    asked = F.col("asked")
    capacity = asked.startswith("capacity-")

    def card(rows: DataFrame) -> DataFrame:
        unit = F.when(F.col("resource_name") == "on-demand", "tb").when(
            F.col("resource_name").startswith("capacity-"), "slot-hour").otherwise("gb-month")
        own = rows.filter((F.col("terms.commitment") == "on_demand") & (F.col("terms.tenancy") == "shared"))
        return _cards(own, _first(_fitting((), unit)), F.array(_names(F.col("terms.os"))))

    def price() -> Priced:
        qty = F.when(asked == "on-demand", _n("tb_queried")).when(capacity, _n("slots") * _n("hours")).otherwise(_n("gb_month"))
        return Priced(F.col("hit") * qty, [
            F.when(~asked.isin(*WAREHOUSE_RESOURCES), "unknown warehouse resource"),
            F.when(asked == "on-demand", F.coalesce(_bad("tb_queried"), _needs(_n("tb_queried") <= 0, "tb_queried")))
             .when(capacity, F.coalesce(_bad("slots"), _needs(_n("slots") <= 0, "slots"), _bad("hours")))
             .otherwise(F.coalesce(_bad("gb_month"), _needs(_n("gb_month") <= 0, "gb_month"))), _unpriced("hit"),
        ], qty, F.col("hit_unit"), F.col("hit"))

    return Estimator(
        F.col("kind") == "warehouse.query", {"tb_queried": 0.0, "slots": 0.0, "hours": HOURS_PER_MONTH, "gb_month": 0.0},
        lambda: {"k_terms": F.lit("on-demand")}, card, price)


def _queue() -> Estimator:
    def card(rows: DataFrame) -> DataFrame:
        dimension = _used(QUEUE_DIMENSIONS)
        values = {"walked": dimension, **_index(dimension, "calls"), **_index(F.lit("throughput"), "bytes")}
        for name, meter in METERS.items():
            values |= {f"p_{name}": F.get(_fitting((meter,), first_tier=True), F.lit(0))["amount"]}
        return _cards(rows, values)

    def price() -> Priced:
        ops, tib = _has("ops"), _has("tib")
        metered = [(_has(m), m) for m in METERS]
        hit = first_case([(has, F.col(f"p_{m}")) for has, m in metered[:-1]], F.col(f"p_{metered[-1][1]}"))
        qty = first_case([(ops, _n("ops")), (tib, _n("tib")), *((has, _n(m)) for has, m in metered[:-1])], _n(metered[-1][1]))
        unit = first_case([(ops, F.col("walked")), (tib, F.lit("tib-mo")), *((has, F.lit(METER_UNITS[m])) for has, m in metered[:-1])],
                          METER_UNITS[metered[-1][1]])
        monthly = first_case([(ops, cost_at(F.col("calls"), _n("ops"))),
                              (tib, cost_at(F.col("bytes"), _n("tib") * 1024.0))], hit * qty)
        none_given = ~(metered[0][0] | metered[1][0] | metered[2][0])
        checks = [F.when(has, F.coalesce(_bad(m), F.when(hit.isNull(), f"no {m} price"))) for has, m in metered]
        error = first_case([
            (ops, F.coalesce(_bad("ops"), F.when(F.col("walked") == "", "no tiered request dimension"),
                             F.when(F.col("calls_broken"), "unreadable tier"))),
            (tib, F.coalesce(_bad("tib"), F.when(F.col("bytes_broken"), "unreadable tier"))),
            (none_given, "needs ops, tib, tu_hours, ppu_hours or mu_hours"),
        ], F.coalesce(*checks))
        return Priced(monthly, [error], qty, unit, F.when(~(ops | tib), hit))

    return Estimator(F.col("kind") == "messaging.queue", {"ops": 0.0, "tib": 0.0, **{m: 0.0 for m in METERS}}, dict, card, price)


def _gateway() -> Estimator:
    def card(rows: DataFrame) -> DataFrame:
        dimension = _used(CALL_DIMENSIONS)
        return _cards(rows, {
            "walked": dimension, **_index(dimension, "calls"), "by_unit": _has_dimension("unit_hour"),
            "hit": F.get(_fitting(("unit_hour",), first_tier=True), F.lit(0))["amount"]})

    def price() -> Priced:
        by_unit = F.col("by_unit")
        monthly = F.when(by_unit, F.col("hit") * _n("units") * _n("hours")).otherwise(cost_at(F.col("calls"), _n("requests")))
        error = F.when(by_unit, F.coalesce(
            F.when(_has("requests"), "priced per unit-hour: give units and hours"), _bad("units", 1.0), _bad("hours"),
            F.when(F.col("hit").isNull(), "no unit_hour price"))).otherwise(F.coalesce(
                _bad("requests"), _needs(_n("requests") == 0, "requests"),
                F.when(_has("units") | _has("hours"), "priced per call: give requests"),
                F.when(F.col("walked") == "", "no request dimension"), F.when(F.col("calls_broken"), "unreadable tier")))
        return Priced(monthly, [error], F.when(by_unit, _n("units") * _n("hours")).otherwise(_n("requests")),
                      F.when(by_unit, "unit-hr").otherwise(F.col("walked")), F.when(by_unit, F.col("hit")))

    return Estimator(F.col("kind") == "api.gateway", {"units": 1.0, "hours": HOURS_PER_MONTH, "requests": 0.0}, dict, card, price)


def _zones() -> Estimator:
    def price() -> Priced:
        zones, queries = _n("zones"), _n("queries")
        return Priced(cost_at(F.col("zone_tiers"), zones) + cost_at(F.col("query_tiers"), queries), [
            _bad("zones"), _bad("queries"), _needs((zones == 0) & (queries == 0), "zones and/or queries"),
            F.when((zones > 0) & F.col("zone_tiers_broken"), "unreadable tier"),
            F.when((queries > 0) & F.col("query_tiers_broken"), "unreadable tier")])

    return Estimator(
        F.col("kind") == "dns.zone", {"zones": 0.0, "queries": 0.0}, lambda: {"k_region": _param("region", "global")},
        lambda rows: _cards(rows, {**_index(F.lit("hosted_zone"), "zone_tiers"), **_index(F.lit("query"), "query_tiers")}),
        price, regional=False)


def base_fees(rows: DataFrame) -> DataFrame:
    """Flat fee of an edge plan: the prices of its global base-fee row, found by the plan token in its extras."""
    total = F.aggregate("prices", F.lit(0.0), lambda acc, p: acc + p["amount"])
    on_demand = terms_hash(F.lit("on_demand"), *(F.lit("") for _ in range(5)))
    return (rows.filter((F.col("kind") == "network.cdn") & (F.col("region") == "global")
                        & (extra_field("mode") == "base-fee") & (F.col("terms_hash") == on_demand))
            .groupBy(F.col("provider").alias("f_provider"), F.col("service").alias("f_service"),
                     F.col("resource_name").alias("f_resource"), extra_field("sku").alias("f_sku"))
            .agg(F.sum(total).alias("base_fee")))


def _edge() -> Estimator:
    """A delivery plan answers by its mode; where a name has a single row, to any mode."""
    def cards(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        egress = F.get(_fitting(("egress",), first_tier=True), F.lit(0))
        upper = _bound(egress["tier_upper"], is_bytes=True)
        edge = F.when(egress.isNotNull(), upper)
        for name, fallback in EDGE_FALLBACK_BYTES.items():
            edge = F.when((edge == UNBOUNDED) & (F.concat_ws("/", "provider", "service") == name), F.lit(fallback)).otherwise(edge)
        values = {"hit": egress["amount"], "edge": edge, "plan": extra_field("sku")}
        mode = F.coalesce(extra_field("mode"), F.lit(""))
        with_mode = F.concat_ws("#", _terms_text(), mode)
        fees = base_fees(rows)

        def charged(cards: DataFrame) -> DataFrame:
            on = [F.col("provider") == F.col("f_provider"), F.col("service") == F.col("f_service"),
                  F.col("resource_name") == F.col("f_resource"), F.col("plan") == F.col("f_sku")]
            return cards.join(fees, on, "left").select(*cards.columns, "base_fee")

        return charged(_cards(rows, values, F.array(_names(with_mode)))), charged(_cards(rows, values | {"own_mode": mode}))

    def joined(asked: DataFrame, rows: DataFrame) -> DataFrame:
        by_mode, any_mode = cards(rows)
        taken = ("n_rows", *_ROW, "hit", "edge", "base_fee")
        exact = by_mode.select(*(F.col(k).alias(f"m_{k}") for k in _KEYS), F.struct(
            *taken, F.lit(True).alias("in_mode")).alias("exact"))
        other = any_mode.select(*_KEYS, F.struct(*taken, F.lit(False).alias("in_mode")).alias("other"), F.col("n_rows").alias("named"))
        with_mode = F.concat_ws("#", "k_terms", "asked_mode")
        on = [F.col(k) == F.col(f"m_{k}") for k in _KEYS[:-1]] + [with_mode == F.col("m_k_terms")]
        both = asked.join(other, list(_KEYS), "left").join(exact, on, "left")
        card = F.coalesce("exact", "other")
        return both.select(*asked.columns, "named", *(card[c].alias(c) for c in (*taken, "in_mode")))

    def price() -> Priced:
        gb = _n("gb")
        return Priced(gb * F.col("hit") + F.coalesce("base_fee", F.lit(0.0)), [
            _needs(~_has("gb"), "gb"), _bad("gb"), F.when(~F.col("in_mode") & (F.col("named") != 1), "no row with mode"),
            F.when(F.col("hit").isNull(), "no tier-0 egress price"), F.when(F.col("edge").isNull(), "unreadable tier"),
            F.when(gb * 1e9 > F.col("edge"), "volume exceeds the first tier")], gb, F.lit("gb"))

    return Estimator(F.col("kind") == "network.cdn", {"gb": 0.0}, lambda: {"asked_mode": _param("mode", "edge-egress")},
                     None, price, joined=joined)


def estimators() -> dict[str, Estimator]:
    """Estimators by item kind. Columns need a session, so they are made when they are asked for."""
    return {
        "compute.vm": _machine(), "storage.object": _objects(), "llm.text": _models(), "db.relational.aurora": _aurora(),
        "db.relational.spanner": _spanner(), "db.nosql.cosmos": _cosmos(), "search.engine.opensearch": _opensearch(),
        "paas.app.appservice": _app_plan(), "warehouse.query.bigquery": _warehouse(), "messaging.queue": _queue(),
        "dns.zone": _zones(), "api.gateway": _gateway(), "network.cdn": _edge(),
    }


KINDS = ("compute.vm", "storage.object", "llm.text", "db.relational.aurora", "db.relational.spanner", "db.nosql.cosmos",
         "search.engine.opensearch", "paas.app.appservice", "warehouse.query.bigquery", "messaging.queue", "dns.zone",
         "api.gateway", "network.cdn")
