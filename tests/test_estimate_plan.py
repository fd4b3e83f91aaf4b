"""Estimates of many kinds are one join, and long projections stay out of whole-stage code."""

from pyspark.sql import functions as F

from tarifold.functions.tiers import cost_at, tier_entries, tier_index, walk_tiers
from tarifold.operators.estimate import estimate, parse_items
from tarifold.operators.estimators import KINDS
from tarifold.operators.rows import empty_rows, price


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_all_kinds_read_the_items_twice(spark, tmp_path):
    path = str(tmp_path / "items")
    spark.createDataFrame([(0, "aws/ec2:m5:region=r"), (1, "x")], "item_index bigint, raw string").write.parquet(path)
    lines = estimate(parse_items(spark.read.parquet(path)), empty_rows(spark), list(KINDS))
    # once for delivery networks and once for all other kinds; a scan a kind before
    assert plan_of(lines).count("FileScan parquet") <= 2
    assert {r.item_index: r.error for r in lines.collect()} == {0: "no matching catalog row", 1: "item has no resource"}


def test_prices_are_computed_outside_whole_stage_code(spark):
    items = parse_items(spark.createDataFrame([(0, "aws/sqs:s:region=r:ops=1")], "item_index bigint, raw string"))
    lines = estimate(items, empty_rows(spark), ["messaging.queue"])
    assert any("transform(" in line and "*(" not in line for line in plan_of(lines).splitlines())


def test_cost_at_is_the_walk(spark):
    prices = F.array(price("u", F.lit(0.5), "x", "0", "10K"), price("u", F.lit(0.25), "x", "10K", "1M"),
                     price("u", F.lit(0.125), "x", "1M", ""))
    entries = tier_entries(prices, "u", "count")
    df = spark.createDataFrame([(v,) for v in (None, -1.0, 0.0, 5.0, 1e4, 10001.0, 1e6, 5e9)], "v double")
    for r in df.select("v", walk_tiers(entries, F.col("v")).alias("a"), cost_at(tier_index(entries), F.col("v")).alias("b")).collect():
        assert r.b == (r.a if r.v is not None else 0.0)
