"""Release guards, invariants, price-drift audits, stratified audit samples and coverage profiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tarifold.functions.cases import first_case

ROW_DRIFT_PERCENT = 5.0
PRICE_DRIFT_PERCENT = 1.0


def orphan_prices(prices: DataFrame, skus: DataFrame) -> DataFrame:
    """Prices of items that do not exist."""
    return prices.join(skus.select("sku_id"), "sku_id", "left_anti")


def row_count_drift(current: DataFrame, previous: DataFrame, by: list[str],
                    limit: float = ROW_DRIFT_PERCENT) -> DataFrame:
    """Groups whose row count moved by more than the limit, counted once on each side."""
    now = current.groupBy(*by).agg(F.count(F.lit(1)).alias("current_rows"))
    then = previous.groupBy(*by).agg(F.count(F.lit(1)).alias("previous_rows"))
    both = then.join(now, by, "left").withColumn("current_rows", F.coalesce("current_rows", F.lit(0)))
    drift = 100.0 * F.abs(F.col("current_rows") - F.col("previous_rows")) / F.col("previous_rows")
    return both.filter(F.col("previous_rows") > 0).withColumn("drift_percent", drift).filter(
        F.col("drift_percent") > limit)


def family(name: Column) -> Column:
    """Resource family: the part before the first dash or dot."""
    return F.regexp_extract(name, r"^([^-.]+)", 1)


def lost_families(current: DataFrame, previous: DataFrame, name: str = "resource_name",
                  by: tuple[str, ...] = ()) -> DataFrame:
    """Families present before and gone now."""
    def families(df: DataFrame) -> DataFrame:
        return df.select(*by, family(F.col(name)).alias("family")).distinct()
    return families(previous).join(families(current), [*by, "family"], "left_anti")


def schema_drift(current: dict[str, DataFrame], previous: dict[str, DataFrame]) -> list[tuple[str, str]]:
    """(table, added | removed | changed) between two sets of tables; schemas only, no data is read."""
    out = [(t, "added") for t in current.keys() - previous.keys()]
    out += [(t, "removed") for t in previous.keys() - current.keys()]
    out += [(t, "changed") for t in current.keys() & previous.keys() if current[t].schema != previous[t].schema]
    return sorted(out)


def release_errors(rows: DataFrame, metadata: DataFrame, prices: DataFrame, previous: DataFrame | None) -> DataFrame:
    """All guard failures of a release as (check, detail); empty when it may ship."""
    missing = metadata.filter("key = 'generated_at' AND coalesce(value, '') <> ''").select(
        F.count(F.lit(1)).alias("n")).filter("n = 0").select(
        F.lit("missing_generated_at").alias("check"), F.lit("metadata has no generated_at").alias("detail"))
    orphans = orphan_prices(prices, rows).select(F.count(F.lit(1)).alias("n")).filter("n > 0").select(
        F.lit("orphan_prices").alias("check"), F.col("n").cast("string").alias("detail"))
    out = missing.unionByName(orphans)
    if previous is None:
        empty = rows.select(F.count(F.lit(1)).alias("n")).filter("n = 0").select(
            F.lit("empty_first_release").alias("check"), F.lit("no rows").alias("detail"))
        return out.unionByName(empty)
    drift = row_count_drift(rows.withColumn("_all", F.lit(1)), previous.withColumn("_all", F.lit(1)), ["_all"]).select(
        F.lit("row_count_drift").alias("check"), F.col("drift_percent").cast("string").alias("detail"))
    lost = lost_families(rows.filter("kind = 'compute.vm'"), previous.filter("kind = 'compute.vm'")).select(
        F.lit("lost_family").alias("check"), F.col("family").alias("detail"))
    return out.unionByName(drift).unionByName(lost)


def over_budget(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """Shards whose compressed size exceeds their byte budget: sizes(shard, bytes), budgets(shard, max_bytes)."""
    return sizes.join(budgets, "shard").filter("bytes > max_bytes")


def tier_gaps(rows: DataFrame) -> DataFrame:
    """Tiers that do not continue into the next one: per item and dimension, each upper bound must be the next lower
    bound and the last must be open. It reads the price array in place, so nothing is shuffled."""
    from tarifold.functions.tiers import tier_bound
    bounded = F.transform("prices", lambda p: F.struct(
        p["dimension"].alias("dimension"), F.when(F.col("kind") == "network.cdn", tier_bound(p["tier"], "bytes")).otherwise(tier_bound(p["tier"], "count")).alias("lower"), p["tier"].alias("tier"),
        p["tier_upper"].alias("tier_upper")))
    ordered = F.array_sort(bounded)
    df = rows.select("sku_id", "kind", ordered.alias("t"))
    size = F.size("t")
    nexts = F.transform("t", lambda x, i: F.when(i + 1 < size, F.get("t", i + 1)))
    pairs = F.arrays_zip(F.col("t").alias("cur"), nexts.alias("nxt"))
    df = df.select("sku_id", "kind", F.inline(pairs))
    same = F.col("nxt.dimension") == F.col("cur.dimension")
    wanted = F.when(F.coalesce(same, F.lit(False)), F.col("nxt.tier")).otherwise("")
    return df.filter(F.coalesce("cur.tier_upper", F.lit("")) != wanted).select(
        "sku_id", F.col("cur.dimension").alias("dimension"), F.col("cur.tier").alias("tier"),
        F.col("cur.tier_upper").alias("tier_upper"), wanted.alias("expected"))


def unpriced_families(families: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Machine families whose processor or memory price prefix occurs in no on-demand description.

    The " running in ..." suffix is cut off first, so the prefixes are compared by plain equality.
    """
    offered = descriptions.select(F.substring_index("description", " running in ", 1).alias("prefix")).distinct()
    wanted = families.select("family", F.explode(F.array("cpu_prefix", "ram_prefix")).alias("prefix"))
    return wanted.join(offered, "prefix", "left_anti").select("family").distinct()


# --- drift audits ----------------------------------------------------------------------------------------------

def upstream_price(upstream: DataFrame, keys: list[str], first_positive: bool = False,
                   position: str = "position") -> DataFrame:
    """One upstream price per key. Several distinct positive prices are ambiguous and count as missing, unless the
    feed takes the first positive one. Both are plain aggregates with map-side combine."""
    positive = F.when(F.col("price") > 0, F.col("price"))
    if first_positive:
        return upstream.groupBy(*keys).agg(
            F.min_by(positive, F.when(positive.isNotNull(), F.col(position))).alias("upstream_price"))
    low, high = F.min(positive), F.max(positive)
    return upstream.groupBy(*keys).agg(F.when(low == high, low).alias("upstream_price"))


def price_drift(sample: DataFrame, upstream: DataFrame, keys: list[str], limit: float = PRICE_DRIFT_PERCENT,
                keep_unmatched: bool = True) -> DataFrame:
    """Compare sampled prices with upstream ones: status pass, drift or missing, with the difference in percent.

    sample(keys, price_amount, ...), upstream(keys, upstream_price) with one row per key.
    """
    joined = sample.join(upstream, keys, "left" if keep_unmatched else "inner")
    delta = F.abs(F.col("price_amount") - F.col("upstream_price")) / F.col("upstream_price") * 100.0
    joined = joined.withColumn("delta_percent", F.when(F.col("upstream_price") > 0, delta))
    return joined.withColumn("status", first_case([
        (F.col("delta_percent").isNull(), "missing"), (F.col("delta_percent") >= limit, "drift")], "pass"))


def free_tier_drift(sample: DataFrame) -> DataFrame:
    """Samples of synthetic free tiers have no upstream meter: ours must be exactly 0."""
    return sample.withColumns({
        "upstream_price": F.lit(0.0), "delta_percent": F.when(F.col("price_amount") == 0, 0.0).otherwise(100.0),
        "status": F.when(F.col("price_amount") == 0, "pass").otherwise("drift")})


def drift_report(results: DataFrame, by: list[str]) -> DataFrame:
    """Per group: counts by status and an overall pass, fail or skipped."""
    def n(status: str) -> Column:
        return F.count(F.when(F.col("status") == status, 1))
    counts = results.groupBy(*by).agg(F.count(F.lit(1)).alias("samples"), n("drift").alias("drifted"),
                                      n("missing").alias("missing"))
    return counts.withColumn("result", first_case([
        (F.col("samples") == 0, "skipped"), (F.col("drifted") > 0, "fail")], "pass"))


def second_source_prices(records: DataFrame) -> DataFrame:
    """Flatten (instance_type, pricing region -> os -> {ondemand}) into (resource_name, region, price) for linux."""
    by_region = records.select("instance_type", F.explode("pricing").alias("region", "by_os"))
    price = F.col("by_os")["linux"]["ondemand"].try_cast("double")
    return by_region.select(F.col("instance_type").alias("resource_name"), "region", price.alias("price")).filter(
        F.col("price") > 0)


def prefix_matches(ours: DataFrame, upstream: DataFrame, our_id: str, upstream_id: str, region: str | None = None,
                   upstream_regions: str | None = None) -> DataFrame:
    """Rows of ours whose id is an upstream id, or starts with one followed by "-" or ":".

    With both region columns, an id that only starts with the upstream's also needs our region in its list of regions,
    where bq-us and bq-eu may stand as US and EU. No list serves global, bq-us and bq-eu only.

    Every prefix of ours that ends before such a separator becomes a key, so the prefix test is an equi-join.
    """
    ends = F.filter(F.sequence(F.lit(1), F.length(our_id) + 1), lambda i: (
        (i == F.length(our_id) + 1) | F.substr(F.col(our_id), i, F.lit(1)).isin("-", ":")))
    keyed = ours.withColumn(upstream_id, F.explode(F.transform(
        ends, lambda i: F.substr(F.col(our_id), F.lit(1), i - 1))))
    if region is None or upstream_regions is None:
        return keyed.join(upstream, upstream_id)
    ours_is, listed = F.col(region), F.col(upstream_regions)
    other_name = first_case([(ours_is == "bq-us", "US"), (ours_is == "bq-eu", "EU")], ours_is)
    served = F.when(F.coalesce(F.size(listed), F.lit(0)) <= 0, ours_is.isin("global", "bq-us", "bq-eu")).otherwise(
        F.array_contains(listed, ours_is) | F.array_contains(listed, other_name))
    return keyed.join(upstream, upstream_id).filter((F.col(our_id) == F.col(upstream_id)) | served)


# --- sampling --------------------------------------------------------------------------------------------------

def stratified_sample(prices: DataFrame, budget: int = 20, seed: int = 0) -> DataFrame:
    """At most `budget` prices: 70 % from the three largest regions, 10 % from the others, 15 % from the largest
    families, the rest from anywhere, each (sku_id, dimension) once, at its least amount.

    prices(sku_id, region, resource_name, dimension, amount). A row's draw is md5 of (seed, sku_id, dimension), so the
    sample is the same whatever the partitioning. The `budget` lowest draws of each cell (large region or not, large
    family or not) hold every row that any stratum can take, since no more than `budget` are taken in all; they are
    limited by rank on the map side, and the strata are filled by priority from these 4 * budget rows.
    """
    family = F.substring_index("resource_name", ".", 1)
    regions = prices.groupBy("region").count().orderBy(F.desc("count"), "region").limit(3).select(
        F.col("region").alias("_r"))
    families = prices.groupBy(family.alias("_f")).count()
    most = max(1, math.ceil(budget * 0.15))
    n_families = families.select(F.count(F.lit(1)).alias("n")).scalar()
    rank = F.row_number().over(Window.orderBy(F.desc("count"), "_f"))
    top = families.orderBy(F.desc("count"), "_f").limit(most).withColumn("_rank", rank).filter(
        F.col("_rank") <= F.greatest(F.lit(1), F.ceil(F.lit(budget * 0.15) / n_families))).select("_f")
    shares = [max(1, int(budget * share)) for share in (0.70, 0.10, 0.15)]

    key = ["sku_id", "dimension"]
    rest_of = [c for c in prices.columns if c not in key]
    least = F.min_by(F.struct(*rest_of), F.struct("amount", "region", "resource_name"))
    unique = prices.groupBy(*key).agg(least.alias("_row")).select(*key, "_row.*")
    cells = (unique.join(F.broadcast(regions), F.col("region").eqNullSafe(F.col("_r")), "left")
             .join(F.broadcast(top), family == F.col("_f"), "left")
             .select(*prices.columns, F.col("_r").isNotNull().alias("_large"), F.col("_f").isNotNull().alias("_family"),
                     F.md5(F.concat_ws("|", F.lit(str(seed)), "sku_id", "dimension")).alias("_draw")))
    order = ["_draw", *key]
    in_cell = F.row_number().over(Window.partitionBy("_large", "_family").orderBy(*order))
    few = cells.withColumn("_k", in_cell).filter(F.col("_k") <= budget)

    def place(by: str) -> Column:
        return F.row_number().over(Window.partitionBy(by).orderBy(*order))
    # The first two strata split the rows by region; the third takes from what they leave, the last from what is left then.
    few = few.withColumn("_k", place("_large")).withColumn("stratum", F.when(
        F.col("_large") & (F.col("_k") <= shares[0]), 0).when(~F.col("_large") & (F.col("_k") <= shares[1]), 1))
    few = few.withColumn("_open", F.col("stratum").isNull() & F.col("_family")).withColumn("_k", place("_open"))
    few = few.withColumn("stratum", F.coalesce("stratum", F.when(F.col("_open") & (F.col("_k") <= shares[2]), 2), F.lit(3)))
    return few.orderBy("stratum", *order).limit(budget).select(*prices.columns, "stratum")


# --- profiles --------------------------------------------------------------------------------------------------

def coverage_profile(items: DataFrame, bucket: list[str], item_id: str, attributes: Column, shards: DataFrame,
                     ) -> DataFrame:
    """Per bucket: how many items, which attribute keys, three sample ids, and the shard that covers it.

    shards(bucket columns, shard). Samples are the three smallest ids, kept by a bounded merge rather than by
    collecting the ids of a bucket; attribute keys are a distinct over (bucket, key) of all items.
    """
    keyed = items.withColumns({"_id": F.col(item_id).cast("string"), "_keys": attributes})
    counts = keyed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("sku_count"))
    keys = (keyed.select(*bucket, F.explode("_keys").alias("k")).distinct()
            .groupBy(*bucket).agg(F.sort_array(F.collect_list("k")).alias("attribute_keys")))
    samples = smallest_ids(keyed, bucket, "_id", 3).withColumnRenamed("ids", "sample_ids")
    out = counts.join(keys, bucket, "left").join(samples, bucket, "left").join(shards, bucket, "left")
    return out.withColumn("coverage_ratio", F.when(F.col("shard").isNotNull(), 1.0).otherwise(0.0))


def smallest_ids(df: DataFrame, by: list[str], column: str, n: int) -> DataFrame:
    """The n smallest distinct values per group. Rank limits are pushed into the map side by the optimizer, so each
    task ships at most n rows per group."""
    distinct = df.select(*by, column).distinct()
    ranked = distinct.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(column))).filter(
        F.col("_r") <= n)
    return ranked.groupBy(*by).agg(F.sort_array(F.collect_list(column)).alias("ids"))


def coverage_report(profile: DataFrame, label: str) -> DataFrame:
    """Report order and form: largest first, six attribute keys and a count of the rest."""
    keys = F.coalesce("attribute_keys", F.array().cast("array<string>"))
    more = F.size(keys) - 6
    shown = F.concat(F.array_join(F.slice(keys, 1, 6), ", "),
                     F.when(more > 0, F.concat(F.lit(" +"), more, F.lit(" more"))).otherwise(""))
    return profile.withColumn("attributes", shown).orderBy(F.desc("sku_count"), label)
