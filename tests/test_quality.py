from pyspark.sql import functions as F

from tarifold.operators import quality as Q
from tests.rows import VM, hourly, make


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_sample_is_stratified_and_repeatable(spark):
    prices = spark.range(400).select(
        F.concat(F.lit("s"), "id").alias("sku_id"),
        F.when(F.col("id") < 300, F.concat(F.lit("big"), F.col("id") % 3)).otherwise(
            F.concat(F.lit("small"), F.col("id") % 10)).alias("region"),
        F.concat(F.lit("fam"), F.col("id") % 4, F.lit(".large")).alias("resource_name"),
        F.lit("compute").alias("dimension"), F.col("id").cast("double").alias("amount"))
    one = Q.stratified_sample(prices, 20, 1).collect()
    assert len(one) == 20 == len({(r.sku_id, r.dimension) for r in one})
    by = [sum(r.stratum == i for r in one) for i in range(4)]
    assert by == [14, 2, 3, 1]
    assert all(r.region.startswith("big") for r in one if r.stratum == 0)
    assert all(r.region.startswith("small") for r in one if r.stratum == 1)
    again = Q.stratified_sample(prices.repartition(7), 20, 1).collect()
    assert {r.sku_id for r in one} == {r.sku_id for r in again}
    assert {r.sku_id for r in one} != {r.sku_id for r in Q.stratified_sample(prices, 20, 2).collect()}


def test_release_guard(spark):
    rows = make(spark, *({"id": str(i), "name": f"m{i % 2}.x", "terms": VM, "prices": [hourly(1.0)]} for i in range(40)))
    meta = frame(spark, [("generated_at", "2026-01-01T00:00:00Z")], "key string, value string")
    prices = rows.select("sku_id", F.inline("prices"))
    assert Q.release_errors(rows, meta, prices, rows).isEmpty()
    fewer = rows.filter("resource_name = 'm1.x'")
    found = {r.check for r in Q.release_errors(fewer, meta.limit(0), prices, rows).collect()}
    assert found == {"missing_generated_at", "orphan_prices", "row_count_drift", "lost_family"}
    assert {r.check for r in Q.release_errors(rows.limit(0), meta, prices.limit(0), None).collect()} == {
        "empty_first_release"}


def test_ambiguous_upstream_price_is_missing(spark):
    up = frame(spark, [("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 2.0), ("c", 0.0), ("d", 1.005)], "k string, price double")
    sample = frame(spark, [(k, 1.0) for k in "abcde"], "k string, price_amount double")
    got = {r.k: r.status for r in Q.price_drift(sample, Q.upstream_price(up, ["k"]), ["k"]).collect()}
    assert got == {"a": "pass", "b": "missing", "c": "missing", "d": "pass", "e": "missing"}


def test_schema_drift(spark):
    a, b = spark.range(1), spark.range(1).withColumn("x", F.lit(1))
    assert Q.schema_drift({"t": a, "n": a}, {"t": b, "o": a}) == [("n", "added"), ("o", "removed"), ("t", "changed")]


def test_unpriced_families(spark):
    families = frame(spark, [("n1", "N1 Core", "N1 Ram"), ("n2", "N2 Core", "N2 Ram")],
                     "family string, cpu_prefix string, ram_prefix string")
    text = frame(spark, [("N1 Core running in X",), ("N1 Ram running in Y",), ("N2 Core",)], "description string")
    assert [r.family for r in Q.unpriced_families(families, text).collect()] == ["n2"]


def test_prefix_match_needs_the_region(spark):
    ours = frame(spark, [("a-1", "us-east1"), ("a:2", "europe-west1"), ("b", "bq-eu"), ("b-x", "bq-us"), ("ab", "us-east1")],
                 "our_id string, region string")
    upstream = frame(spark, [("a", ["us-east1", "us-east4"], 1.0), ("a", ["europe-west1"], 2.0), ("b", ["EU"], 3.0), ("b", [], 4.0)],
                     "upstream_id string, regions array<string>, price double")
    got = Q.prefix_matches(ours, upstream, "our_id", "upstream_id", "region", "regions")
    assert {(r.our_id, r.price) for r in got.collect()} == {("a-1", 1.0), ("a:2", 2.0), ("b", 3.0), ("b", 4.0), ("b-x", 4.0)}
    assert Q.prefix_matches(ours, upstream, "our_id", "upstream_id").count() == 8


def test_sample_amount_does_not_depend_on_the_partitioning(spark):
    tiers = spark.range(300).select(
        F.concat(F.lit("s"), F.col("id") % 30).alias("sku_id"), F.lit("r").alias("region"), F.lit("f.x").alias("resource_name"),
        F.lit("requests").alias("dimension"), (F.lit(400.0) - F.col("id")).alias("amount"))
    one, two = (sorted((r.sku_id, r.amount) for r in Q.stratified_sample(t, 20, 1).collect()) for t in (tiers, tiers.repartition(5)))
    assert one == two and all(a == 130.0 - int(s[1:]) for s, a in one)
