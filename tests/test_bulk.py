"""Bulk comparisons against single ones, and the tier index against the walk."""

import pytest
from pyspark.sql import functions as F

from tarifold.functions.tiers import probe, tier_entries, tier_index, walk_tiers
from tarifold.operators.batch import argument_error, parse_requests
from tarifold.operators.compare import CompareSpec, capable_models, compare
from tarifold.operators.compare_bulk import compare_many
from tests.rows import VM, hourly, make

SPECS = [
    {"kind": "compute.vm", "vcpu": 4, "memory_gb": 8.0},
    {"kind": "compute.vm", "vcpu": 3, "sort": "vcpu", "max_price": 0.5},
    {"kind": "compute.vm", "sort": "memory", "limit": 3},
    {"kind": "compute.vm", "vcpu": 4, "memory_gb": 8.0, "regions": ["us-east"]},
    {"kind": "cache.kv", "memory_gb": 10.0, "engine": "redis"},
    {"kind": "search.engine", "resource": "big"},
]


@pytest.fixture(scope="module")
def offers(spark):
    out = []
    for k in range(60):
        region = ("us-east-1", "us-east-2", "eu-west-1")[k % 3]
        out.append({"id": f"vm{k}", "name": f"t{k % 7}", "region": region, "terms": VM, "prices": [hourly(0.05 * (k % 13))] if k % 5 else [],
                    "attrs": {"vcpu": k % 9 if k % 4 else None, "memory_gb": float(k % 17), "gpu_count": k % 2 or None}})
        out.append({"id": f"c{k}", "service": "elasticache", "kind": "cache.kv", "name": f"n{k}", "region": region, "terms": {"tenancy": ("redis", "memcached")[k % 2]},
                    "attrs": {"memory_gb": 1.0 * k}, "prices": [hourly(0.01 * k)]})
        out.append({"id": f"s{k}", "service": "opensearch", "kind": "search.engine", "name": ("big", "small")[k % 2], "region": region, "terms": {"os": "managed-cluster"},
                    "attrs": {"extra": '{"mode":"managed-cluster"}'}, "prices": [hourly(0.02 * k)]})
    return make(spark, *out).persist()


def test_compare_many_equals_compare(spark, offers):
    schema = "request_id int, kind string, vcpu bigint, memory_gb double, max_price double, engine string, resource string, sort string, `limit` int, regions array<string>"
    names = [f.split()[0].strip("`") for f in schema.split(", ")][1:]
    asked = SPECS + SPECS[:1]  # equal requests are answered alike
    requests = spark.createDataFrame([(k, *(s.get(n) for n in names)) for k, s in enumerate(asked)], schema)
    got = compare_many(offers, requests).collect()
    for k, s in enumerate(asked):
        spec = CompareSpec(**{n: v for n, v in s.items() if n not in ("kind", "sort", "limit", "regions")})
        want = compare(offers, s["kind"], spec, s.get("regions"), s.get("sort", "price"), s.get("limit", 20)).collect()
        assert [r.sku_id for r in sorted((r for r in got if r.request_id == k), key=lambda r: r.position)] == [r.sku_id for r in want], s
    assert any(r.request_id == 5 for r in got)


def test_compare_many_tells_what_is_wrong(spark, offers):
    rows = [(1, "nothing", None, None), (2, "dns.zone", 4, None), (3, "compute.vm", None, ["mars"]), (4, "compute.vm", 1000, None)]
    got = compare_many(offers, spark.createDataFrame(rows, "request_id int, kind string, vcpu int, regions array<string>")).collect()
    assert {r.request_id: r.error for r in got} == {1: "unsupported kind", 2: "dns.zone does not take vcpu", 3: "unknown region"}
    assert compare_many(offers, spark.createDataFrame([], "request_id int, kind string")).count() == 0


def test_arguments_are_checked(spark):
    lines = ['{"command": "estimate", "args": {}}', '{"command": "aws ec2 price", "args": {"instance_type": "x"}}', '{"command": "llm compare"}']
    requests = parse_requests(spark.createDataFrame(list(enumerate(lines)), "request_id bigint, value string"))
    assert [r.e for r in requests.orderBy("request_id").select(argument_error().alias("e")).collect()] == ["missing items", "missing region", "missing model"]


@pytest.mark.parametrize("tiers", [[("0", "10K", 0.5), ("10K", "1M", 0.25), ("1M", "", 0.125)], [("0", "10K", 0.5), ("10K", "1M", 0.25)], [("0", "", 2.0)], []])
def test_tier_index_equals_walk(spark, tiers):
    prices = F.expr("CAST(array(" + ", ".join(f"struct('u', '{a}', '{b}', {c}D, 'x')" for a, b, c in tiers) + ") AS array<struct<dimension:string,tier:string,tier_upper:string,amount:double,unit:string>>)")
    df = spark.createDataFrame([(float(v),) for v in (0, -3, 1, 9_999, 10_000, 10_001, 1_000_000, 5_000_000)], "v double")
    entries = tier_entries(prices, "u", "count")
    for r in df.select(walk_tiers(entries, F.col("v")).alias("a"), probe(tier_index(entries), F.col("v"), 4).alias("b")).collect():
        assert r.a == r.b


def test_capable_models(spark):
    rows = make(spark, *({"id": f"m{k}", "provider": "p", "kind": "llm.text", "attrs": {"capabilities": ["tools"] if k % 2 else []},
                          "prices": [("prompt", "", "", float(k), "token"), ("completion", "", "", 2.0 * k, "token")]} for k in range(6)))
    assert {r.sku_id for r in capable_models(rows, ["tools"], max_input=4.0, max_output=6.0).collect()} == {"m1", "m3"}
