import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from tarifold import vocab
from tarifold.feeds.aws import rate_divisor
from tarifold.functions.numbers import canonical_unit, gib, quantity, significant, units_nanos
from tarifold.functions.terms import terms_hash, vocabulary_violations, with_kind_defaults
from tarifold.functions.tiers import COUNT_BOUNDS, number_token, tier_bound, tier_entries, walk_tiers
from tarifold.operators.rows import price
from tests.rows import make


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_terms_hash_is_sha_of_compact_json(spark):
    terms = ["on_demand", "shared", "linux", "", "", ""]
    want = hashlib.sha256(json.dumps(terms, separators=(",", ":")).encode()).hexdigest()[:32]
    assert one(spark, terms_hash(*map(F.lit, terms[:3]), F.lit(None), F.lit(""), F.lit(None))) == want


@pytest.mark.parametrize("text, value", [("730", 730.0), ("1M", 1e6), ("2.5k", 2500.0), ("1 G", 1e9), ("3t", 3e12),
                                         ("1P", 1e15), ("x", None), ("1e3", 1000.0)])
def test_quantity(spark, text, value):
    assert one(spark, quantity(F.lit(text))) == value


@pytest.mark.parametrize("value, shown", [(123456.789, 123457.0), (0.000123456789, 0.000123457), (0.0, 0.0),
                                          (-2.5, -2.5), (1234565.0, 1234570.0)])
def test_significant(spark, value, shown):
    assert one(spark, significant(F.lit(value))) == pytest.approx(shown, rel=1e-12)


def test_units(spark):
    assert one(spark, units_nanos(F.lit("2"), F.lit(500_000_000))) == 2.5
    assert one(spark, canonical_unit(F.lit("100 Hours"), "hour")["divisor"]) == 100.0
    assert one(spark, canonical_unit(F.lit("GiBy.d"), "usage")["unit"]) == "gb-mo"
    assert one(spark, canonical_unit(F.lit("parsec"), "hour")) is None
    assert one(spark, gib(F.lit("1,952 GiB"))) == 1952.0


def test_tokens(spark):
    assert COUNT_BOUNDS["2500M"] == 2.5e9
    assert one(spark, tier_bound(F.lit(""), "count")) == math.inf
    assert one(spark, tier_bound(F.lit("10TB"), "bytes")) == 1e13
    assert one(spark, tier_bound(F.lit("777"), "count")) == 777.0
    assert one(spark, tier_bound(F.lit("huge"), "count")) is None
    assert [one(spark, number_token(F.lit(n))) for n in (0, 333_000_000, 10_000, 25, 777)] == [
        "0", "333M", "10K", "25", None]


@pytest.mark.parametrize("volume, cost", [(0, 0.0), (5_000, 2_500.0), (20_000, 7_500.0), (2_000_000, 377_500.0)])
def test_tier_walk(spark, volume, cost):
    prices = F.array(price("u", F.lit(0.25), "x", "10K", "1M"), price("u", F.lit(0.5), "x", "0", "10K"),
                     price("u", F.lit(0.125), "x", "1M", ""), price("other", F.lit(9.0), "x", "0", ""))
    assert one(spark, walk_tiers(tier_entries(prices, "u", "count"), F.lit(volume))) == cost


def test_rate_divisor(spark):
    assert one(spark, rate_divisor(F.lit("$0.50 per 1 million Requests"), F.lit(0.5))) == 1e6
    assert one(spark, rate_divisor(F.lit("$0.50 per 1 million Requests"), F.lit(0.0000005))) == 1.0


def test_regions_are_unique_and_complete():
    rows = vocab.region_rows()
    assert len({(p, r) for p, r, _ in rows}) == len(rows) > 100
    assert set(vocab.LOCATION_REGIONS.values()) | set(vocab.EDGE_REGIONS.values()) <= {r for p, r, _ in rows if p == "aws"}


def test_defaults_and_violations(spark):
    rows = make(spark, {"id": "a", "terms": {"tenancy": "moon"}}, {"id": "b", "terms": {"tenancy": "shared"}})
    assert [(r.sku_id, r.field, r.value) for r in vocabulary_violations(rows).collect()] == [("a", "tenancy", "moon")]
    bare = rows.withColumn("terms", F.col("terms").withField("os", F.lit(None).cast("string")))
    assert {r.os for r in with_kind_defaults(bare).select("terms.os").collect()} == {"linux"}
