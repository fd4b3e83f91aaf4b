"""Quantities, price decoding, unit divisors and display rounding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tarifold import vocab
from tarifold.functions.cases import mapped


# A number and its suffix; blanks may stand around the number only if there is a suffix.
_QUANTITY = (r"^(?=[^ ]|.*[KMGTPkmgtp]$)[ ]*([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?)"
             r"(?:[ ]*([KMGTPkmgtp]))?$")


def quantity(text: Column) -> Column:
    """Number with an optional decimal suffix K, M, G, T or P in either case; null when it is not a number.

    The text is used twice only: many quantities in one projection shall stay a small method.
    """
    number = F.regexp_extract(text, _QUANTITY, 1).try_cast("double")
    return number * mapped(F.upper(F.regexp_extract(text, _QUANTITY, 2)), {"": 1.0, **vocab.QUANTITY_SUFFIX})


def units_nanos(units: Column, nanos: Column) -> Column:
    """Whole units plus billionths."""
    return units.cast("bigint") + nanos / F.lit(1_000_000_000)


def canonical_unit(raw: Column, family: str) -> Column:
    """Struct (divisor, unit) of a raw unit spelling within one family; null when unknown."""
    units = vocab.UNITS[family]
    return F.when(raw.isin(*units), F.struct(
        mapped(raw, {k: float(d) for k, (d, _) in units.items()}).alias("divisor"),
        mapped(raw, {k: u for k, (_, u) in units.items()}).alias("unit")))


def significant(value: Column, digits: int = 6) -> Column:
    """Round to significant digits, halves away from zero; zero stays zero."""
    factor = F.pow(F.lit(10.0), F.lit(float(digits - 1)) - F.floor(F.log10(F.abs(value))))
    scaled = value * factor
    rounded = F.signum(scaled) * F.floor(F.abs(scaled) + F.lit(0.5)) / factor
    return F.when((value == 0) | value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), value
                  ).otherwise(rounded)


def leading_number(text: Column, pattern: str, group: int = 1) -> Column:
    """The number a pattern captures in a text, null when the pattern does not match."""
    return F.regexp_extract(text, pattern, group).try_cast("double")


def gib(text: Column) -> Column:
    """Gigabytes in a phrase such as "8 GiB" with thousands separators."""
    return leading_number(F.regexp_replace(text, ",", ""), r"(?i)^\s*([0-9.]+)\s*(?:GiB|GB)\b")
