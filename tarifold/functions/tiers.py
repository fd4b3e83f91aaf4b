"""Tier tokens, tier bounds and the tiered cost of a volume, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tarifold import vocab
from tarifold.functions.cases import mapped

# Multipliers of the decimal suffixes.
_COUNT_SUFFIX = {"K": 1e3, "M": 1e6, "B": 1e9}
_BYTE_SUFFIX = {"GB": 1e9, "TB": 1e12, "PB": 1e15}
UNBOUNDED = float("inf")


def _bounds(tokens: tuple[str, ...], suffixes: dict[str, float]) -> dict[str, float]:
    out = {}
    for token in tokens:
        digits = token.rstrip("KMBGTP")
        out[token] = float(digits) * suffixes.get(token[len(digits):], 1.0)
    return out


COUNT_BOUNDS = _bounds(vocab.COUNT_TOKENS, _COUNT_SUFFIX)
BYTE_BOUNDS = _bounds(vocab.BYTE_TOKENS, _BYTE_SUFFIX)


def count_bound(token: Column) -> Column:
    """Numeric bound of a count token; null when the token is not in the vocabulary."""
    return mapped(token, COUNT_BOUNDS)


def byte_bound(token: Column) -> Column:
    """Numeric bound of a byte token; null when the token is not in the vocabulary."""
    return mapped(token, BYTE_BOUNDS)


def tier_bound(token: Column, domain: str) -> Column:
    """Bound as the estimator reads it: empty is unbounded, then tokens, then plain numbers, else null."""
    known = count_bound(token) if domain == "count" else byte_bound(token)
    return F.when(F.coalesce(token, F.lit("")) == "", F.lit(UNBOUNDED)).otherwise(
        F.coalesce(known, token.try_cast("double"))
    )


def number_token(value: Column, tokens: tuple[str, ...] = vocab.COUNT_TOKENS) -> Column:
    """Token of a whole number (333000000 gives 333M); null when the result is outside the vocabulary.

    The largest unit that divides the number is taken first, then the smaller ones.
    """
    whole = value.cast("bigint")
    spelled = F.coalesce(
        F.when(whole == 0, F.lit("0")),
        *(
            F.when((whole % factor == 0) & F.concat((whole / factor).cast("bigint"), F.lit(name)).isin(*tokens),
                   F.concat((whole / factor).cast("bigint"), F.lit(name)))
            for name, factor in (("B", 1_000_000_000), ("M", 1_000_000), ("K", 1_000))
        ),
        whole.cast("string"),
    )
    return F.when(spelled.isin(*tokens), spelled)


def tier_entries(prices: Column, dimension: str | Column, domain: str) -> Column:
    """The prices of one dimension as an array of (lower, upper, amount), ascending by lower bound."""
    want = F.lit(dimension) if isinstance(dimension, str) else dimension
    picked = F.filter(prices, lambda p: p["dimension"] == want)
    return F.array_sort(F.transform(picked, lambda p: F.struct(
        tier_bound(p["tier"], domain).alias("lower"),
        tier_bound(p["tier_upper"], domain).alias("upper"),
        p["amount"].alias("amount"),
    )))


def has_bad_bound(entries: Column) -> Column:
    return F.exists(entries, lambda e: e["lower"].isNull() | e["upper"].isNull())


def walk_tiers(entries: Column, volume: Column) -> Column:
    """Cost of a volume over ascending tiers; each takes what is left up to its width, an unbounded one the rest."""
    start = F.struct(volume.cast("double").alias("left"), F.lit(0.0).alias("cost"))

    def step(state: Column, tier: Column) -> Column:
        used = F.when(state["left"] <= 0, F.lit(0.0)).when(
            tier["upper"] == F.lit(UNBOUNDED), state["left"]
        ).otherwise(F.least(state["left"], tier["upper"] - tier["lower"]))
        return F.struct((state["left"] - used).alias("left"), (state["cost"] + used * tier["amount"]).alias("cost"))

    cost = F.aggregate(entries, start, step, lambda s: s["cost"])
    return F.when((volume <= 0) | (F.size(entries) == 0), F.lit(0.0)).otherwise(cost)


def tier_index(entries: Column) -> Column:
    """The tier walk prepared once: array of (start, cost, amount) by position, the cost of all before a start summed up.

    A volume's cost is then the cost at the last start below it and its rest at that place's amount. A last place of
    amount 0 follows bounded tiers, whose rest is free. Bounds must be readable and no tier may end below its start.
    """
    state = F.struct(F.lit(0.0).alias("start"), F.lit(0.0).alias("cost"),
                     F.expr("CAST(array() AS array<struct<start:double,cost:double,amount:double>>)").alias("places"))

    def step(s: Column, tier: Column) -> Column:
        place = F.struct(s["start"].alias("start"), s["cost"].alias("cost"), tier["amount"].alias("amount"))
        width = tier["upper"] - tier["lower"]
        ends = width == F.lit(UNBOUNDED)
        return F.struct((s["start"] + width).alias("start"),
                        F.when(ends, s["cost"]).otherwise(s["cost"] + width * tier["amount"]).alias("cost"),
                        F.concat(s["places"], F.array(place)).alias("places"))

    def done(s: Column) -> Column:
        end = F.struct(s["start"].alias("start"), s["cost"].alias("cost"), F.lit(0.0).alias("amount"))
        return F.filter(F.concat(s["places"], F.array(end)), lambda p: p["start"] < F.lit(UNBOUNDED))

    return F.aggregate(entries, state, step, done)


def bad_tiers(entries: Column) -> Column:
    """Whether a bound is unreadable or a tier ends below its start."""
    return F.exists(entries, lambda e: e["lower"].isNull() | e["upper"].isNull() | (e["upper"] < e["lower"]))


def probe(index: Column, volume: Column, places: int) -> Column:
    """Cost of a volume by a tier index of at most so many places: comparisons and one product, no loop over an array."""
    cost = None
    for k in reversed(range(places)):
        place = F.get(index, F.lit(k))
        value = place["cost"] + (volume - place["start"]) * place["amount"]
        cost = F.when(volume > place["start"], value) if cost is None else cost.when(volume > place["start"], value)
    return F.lit(0.0) if cost is None else cost.otherwise(0.0)


def cost_at(index: Column, volume: Column) -> Column:
    """Cost of a volume by a tier index of any size: that of the last place which starts below it; without an index 0."""
    cost = F.aggregate(index, F.lit(0.0), lambda cost, place: F.when(
        volume > place["start"], place["cost"] + (volume - place["start"]) * place["amount"]).otherwise(cost))
    return F.when(index.isNull(), F.lit(0.0)).otherwise(cost)
