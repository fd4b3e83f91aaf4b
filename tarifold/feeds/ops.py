"""Building blocks the feed jobs are composed of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tarifold import vocab
from tarifold.functions.cases import mapped


def with_region_group(df: DataFrame, provider: str, region: str = "region", strict: bool = False) -> DataFrame:
    """Add region_normalized from the fixed region table; an untracked region drops its row, or fails when strict."""
    regions = F.broadcast(vocab.provider_regions(df.sparkSession, provider).withColumnRenamed("region", region))
    if not strict:
        return df.join(regions, region)
    out = df.join(regions, region, "left")
    return out.withColumn("region_normalized", F.coalesce("region_normalized", F.raise_error(
        F.concat(F.lit(f"untracked region {provider}/"), F.col(region))).cast("string")))


def location_region(location: Column) -> Column:
    """Region of a location name in the offer feeds, null when unknown."""
    return mapped(location, vocab.LOCATION_REGIONS)


def first_per(df: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """The first row of every key in the given order. An aggregate with map-side combine, so a key that holds a
    third of all rows still reaches the reducer as one row per task."""
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*cols), order).alias("_row")).select(*keys, "_row.*")


def last_per(df: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """The last row of every key in the given order."""
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("_row")).select(*keys, "_row.*")


def pivot_dimensions(df: DataFrame, keys: list[str], required: list[str], values: list[str],
                     order: Column | str, dimension: str = "dimension", keep: str = "last",
                     optional: tuple[str, ...] = ()) -> DataFrame:
    """One row per key with a struct column per dimension; keys that miss a required dimension are dropped.

    The last row (or the first) in source order wins within a dimension. One aggregate, map-side combined.
    """
    pick = F.max_by if keep == "last" else F.min_by
    order = F.col(order) if isinstance(order, str) else order
    aggs = []
    for d in (*required, *optional):
        hit = F.col(dimension) == d
        aggs.append(pick(F.when(hit, F.struct(*values)), F.when(hit, order)).alias(d))
    out = df.groupBy(*keys).agg(*aggs)
    for d in required:
        out = out.filter(F.col(f"`{d}`").isNotNull())
    return out


def joined_id(*ids: Column) -> Column:
    """Identifier of a row made from several upstream entries: their ids sorted and joined."""
    return F.array_join(F.array_sort(F.array(*ids)), "::")


def chained_tiers(entries: Column, dimension: str, unit: str, token) -> Column:
    """Prices from (lo, usd) entries sorted by lower bound; each tier ends where the next begins, the last is open."""
    ordered = F.array_sort(entries)

    def build(e: Column, i: Column) -> Column:
        following = F.get(ordered, i + 1)
        return F.struct(F.lit(dimension).alias("dimension"), token(e["lo"]).alias("tier"),
                        F.when(following.isNull(), "").otherwise(token(following["lo"])).alias("tier_upper"),
                        e["usd"].alias("amount"), F.lit(unit).alias("unit"))
    return F.transform(ordered, build)


def zipped_tiers(rates: Column, dimension: str, unit: Column | str, tokens: tuple[str, ...], scale: Column | float = 1.0
                 ) -> Column:
    """Prices from an ordered array of amounts zipped with canonical tokens; the last tier is open."""
    names = F.array(*(F.lit(t) for t in tokens))
    unit = F.lit(unit) if isinstance(unit, str) else unit
    scale = F.lit(scale) if not isinstance(scale, Column) else scale
    return F.transform(rates, lambda a, i: F.struct(
        F.lit(dimension).alias("dimension"), F.get(names, i).alias("tier"),
        F.when(i + 1 < F.size(rates), F.get(names, i + 1)).otherwise("").alias("tier_upper"),
        (a * scale).alias("amount"), unit.alias("unit")))


def suffix_collisions(df: DataFrame, key: str, label: str, order: str, bucket: Column) -> DataFrame:
    """Make colliding ids unique: an id that occurs more than once gets a slug of a label, then -2, -3, and so on.

    Numbering inside a hot id is done in two levels: rows are counted per (id, bucket of the source order), the
    counts are turned into offsets, and only rows of one bucket are ranked together. `bucket` must rise with `order`.
    """
    from pyspark.sql import Window
    slug = F.trim(F.regexp_replace(F.lower(label), r"[^a-z0-9]+", "-"), F.lit("-"))
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    named = df.join(counts, key).withColumns({
        "_id": F.when(F.col("_n") > 1, F.concat_ws("-", key, slug)).otherwise(F.col(key)), "_b": bucket})
    per = named.groupBy("_id", "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(
        Window.partitionBy("_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per.withColumn("_before", before).select("_id", "_b", "_before")
    inside = F.row_number().over(Window.partitionBy("_id", "_b").orderBy(order))
    ranked = named.withColumn("_in", inside).join(offsets, ["_id", "_b"])
    rank = F.col("_before") + F.col("_in")
    unique = F.when(rank == 1, F.col("_id")).otherwise(F.concat_ws("-", "_id", rank))
    return ranked.withColumn(key, unique).select(*df.columns)
