"""Identity of a set of commercial terms, kind defaults and closed-vocabulary checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tarifold import vocab
from tarifold.schemas import TERM_FIELDS


def terms_hash(commitment, tenancy, os, support_tier, upfront, payment_option) -> Column:
    """First 32 hex digits of SHA-256 over the compact JSON array of the six fields; null counts as empty."""
    parts = [
        F.coalesce(p if isinstance(p, Column) else F.col(p), F.lit(""))
        for p in (commitment, tenancy, os, support_tier, upfront, payment_option)
    ]
    return F.substring(F.sha2(F.to_json(F.array(*parts)), 256), 1, 32)


def terms_hash_of(terms: Column) -> Column:
    return terms_hash(*(terms[f] for f in TERM_FIELDS))


def literal_terms(**values: str) -> Column:
    """Struct of terms from literals or columns; fields left out are empty."""
    return F.struct(*(
        (values[f] if isinstance(values.get(f), Column) else F.lit(values.get(f, ""))).alias(f) for f in TERM_FIELDS
    ))


def empty_to_null_terms(terms: Column) -> Column:
    """Storage form: the last three terms store an empty string as null, the first three keep it."""
    return F.struct(
        *(F.coalesce(terms[f], F.lit("")).alias(f) for f in TERM_FIELDS[:3]),
        *(F.nullif(terms[f], F.lit("")).alias(f) for f in TERM_FIELDS[3:]),
    )


def with_kind_defaults(rows: DataFrame) -> DataFrame:
    """Fill null terms from the defaults of the row's kind; a kind without defaults is an error."""
    defaults = vocab.terms_defaults(rows.sparkSession)
    joined = rows.join(F.broadcast(defaults), "kind", "left")
    known = F.when(F.col("_default").isNull(),
                   F.raise_error(F.concat(F.lit("no terms defaults for kind "), F.col("kind")))).otherwise(F.lit(True))
    filled = F.struct(*(F.coalesce(F.col("terms")[f], F.col("_default")[f]).alias(f) for f in TERM_FIELDS))
    return (joined.filter(known)
            .withColumn("terms", filled)
            .withColumn("terms_hash", terms_hash_of(F.col("terms")))
            .select(*rows.columns))


def vocabulary_violations(rows: DataFrame) -> DataFrame:
    """One row per (sku_id, field, value) whose value lies outside its closed vocabulary."""
    fields = {"kind": F.col("kind"), **{f: F.coalesce(F.col("terms")[f], F.lit("")) for f in vocab.CHECKED_TERMS}}
    bad = F.array(*(
        F.when(~value.isin(*vocab.ENUMS[name]),
               F.struct(F.lit(name).alias("field"), value.alias("value")))
        for name, value in fields.items()
    ))
    return rows.select("sku_id", F.inline(F.array_compact(bad)))
