import json

import pytest
from pyspark.sql import functions as F

from tarifold.operators.batch import batch_exit_code, parse_requests, run_batch
from tarifold.operators.estimate import estimate, estimate_total, parse_items, workload_items
from tests.rows import VM, hourly, make


@pytest.fixture(scope="module")
def card(spark):
    od = {"tenancy": "", "os": ""}
    tiers = [("request", "0", "1M", 0.0, "request"), ("request", "1M", "100B", 1e-6, "request"),
             ("request", "100B", "", 5e-7, "request")]
    return make(
        spark,
        {"id": "vm", "terms": VM, "prices": [hourly(0.1)]},
        {"id": "q", "service": "sqs", "kind": "messaging.queue", "name": "standard", "terms": od, "prices": tiers},
        {"id": "m1", "provider": "p1", "service": "llm", "kind": "llm.text", "name": "a/b", "region": "", "terms": od,
         "prices": [("prompt", "", "", 1e-6, "token"), ("completion", "", "", 2e-6, "token")]},
        {"id": "m2", "provider": "p2", "service": "llm", "kind": "llm.text", "name": "a/b", "region": "", "terms": od,
         "prices": [("prompt", "", "", 3e-6, "token")]},
        {"id": "m0", "provider": "openrouter", "service": "llm", "kind": "llm.text", "name": "a/b", "region": "",
         "terms": od, "prices": [("prompt", "", "", 9e-6, "token")], "aggregated": True},
        {"id": "cf", "service": "cloudfront", "kind": "network.cdn", "name": "standard", "terms": od,
         "attrs": {"extra": '{"mode":"edge-egress","sku":"k"}'}, "prices": [("egress", "0", "", 0.08, "gb")]},
        {"id": "fee", "service": "cloudfront", "kind": "network.cdn", "name": "standard", "region": "global", "terms": od,
         "attrs": {"extra": '{"mode":"base-fee","sku":"k"}'}, "prices": [("fee", "0", "", 35.0, "month")]},
        {"id": "au1", "service": "aurora", "kind": "db.relational", "name": "db.r5", "prices": [hourly(0.9)],
         "terms": {"tenancy": "aurora-postgres", "os": "single-az"}},
        {"id": "au2", "service": "aurora", "kind": "db.relational", "name": "db.r5", "prices": [hourly(0.3)],
         "terms": {"tenancy": "aurora-postgres", "os": "single-az"}},
        {"id": "api", "service": "api-gateway", "kind": "api.gateway", "name": "rest", "terms": od, "prices": tiers})


def price(spark, card, *texts):
    items = parse_items(spark.createDataFrame(list(enumerate(texts)), "item_index bigint, raw string"))
    return [(r.sku_id, r.monthly_usd, r.error) for r in estimate(items, card).orderBy("item_index").collect()]


def test_estimates(spark, card):
    got = price(
        spark, card, "aws/ec2:m5.large:region=us-east-1:count=2:hours=10", "aws/ec2:m5.large:region=us-east-1",
        "aws/sqs:standard:region=us-east-1:ops=3M", "llm:a/b:input=1M:output=1M:serving_provider=P1",
        "llm:a/b:input=1M:serving_provider=openrouter", "aws/cloudfront:standard:region=us-east-1:gb=100",
        "aws/aurora:db.r5:region=us-east-1:hours=1", "aws/api-gateway:rest:region=us-east-1:requests=2M")
    want = [("vm", 2.0), ("vm", 73.0), ("q", 2.0), ("m1", 3.0), ("m0", 9.0), ("cf", 43.0), ("au2", 0.3), ("api", 1.0)]
    assert [(s, pytest.approx(m)) for s, m, e in got] == want and not any(e for *_, e in got)


@pytest.mark.parametrize("text, error", [
    ("", "empty item"), ("aws/ec2", "item has no resource"), ("aws:x", "first segment must be provider/service"),
    ("aws/moon:x", "unsupported provider/service"), ("aws/ec2:x:region", "parameter must be key=value"),
    ("aws/ec2:x:a=1:A=2", "duplicate parameter"), ("aws/ec2:m5.large", "missing region"),
    ("aws/ec2:none:region=us-east-1", "no matching catalog row"),
    ("aws/ec2:m5.large:region=us-east-1:count=0", "count is not a whole number of at least 1"),
    ("llm:a/b:input=1M", "ambiguous: name a serving_provider"), ("llm:a/b", "needs input and/or output tokens"),
    ("aws/cloudfront:standard:region=us-east-1:gb=20000", "volume exceeds the first tier"),
    ("aws/api-gateway:rest:region=us-east-1:requests=1:hours=2", "priced per call: give requests"),
    ("aws/sns:standard:region=us-east-1", "estimate not available for messaging.topic"),
    ("gcp/firestore:x:region=r", "no estimator for kind")])
def test_errors(spark, card, text, error):
    (sku, monthly, got), = price(spark, card, text)
    assert (sku, monthly, got) == (None, None, error)


def test_total_is_strict(spark, card):
    items = parse_items(spark.createDataFrame(
        [(0, "aws/ec2:m5.large:region=us-east-1"), (1, "aws/ec2:x")], "item_index bigint, raw string"))
    lines = estimate(items, card)
    assert estimate_total(lines, strict=False).first().monthly_usd == pytest.approx(73.0)
    with pytest.raises(Exception, match="missing region"):
        estimate_total(lines).collect()


def test_workload_document(spark):
    doc = '{"items": [{"provider": "AWS", "service": "ec2", "resource": "m5", "params": {"Region": "r", "count": 2.0}}]}'
    row = workload_items(spark.createDataFrame([(doc,)], "value string")).first()
    assert row.raw == "aws/ec2:m5:count=2:region=r" and row.kind == "compute.vm" and row.error is None
    with pytest.raises(Exception, match="non-empty"):
        workload_items(spark.createDataFrame([('{"items": []}',)], "value string")).collect()


def test_batch(spark, card):
    lines = [(0, "# note"), (1, '{"command": "aws ec2 price", "args": {"instance_type": "m5.large", "region": "us-east-1"}}'),
             (2, '{"command": "llm price", "args": {"model": "none"}}'), (3, '{"command": "x"}'), (4, "not json"),
             (5, '{"command": "estimate", "args": {"item": "aws/ec2:m5.large:region=us-east-1"}}'),
             (6, '{"command": "estimate", "args": {"item": "aws/ec2"}}')]
    requests = parse_requests(spark.createDataFrame(lines, "request_id bigint, value string"))
    records = run_batch(requests, card)
    got = {r.request_id: r.exit_code for r in records.collect()}
    assert got == {1: 0, 2: 3, 3: 4, 4: 4, 5: 0, 6: 1}
    assert batch_exit_code(records).first().exit_code == 4


def test_batch_lists_every_row(spark, card):
    twins = card.unionByName(card.filter("resource_name = 'm5.large' AND region = 'us-east-1'").withColumns(
        {"sku_id": F.concat("sku_id", F.lit("-b")), "region": F.lit("us-west-2")}))
    line = '{"command": "aws ec2 list", "args": {"instance_type": "m5.large"}}'
    requests = parse_requests(spark.createDataFrame([(1, line)], "request_id bigint, value string"))
    wanted = {r.sku_id for r in twins.filter("resource_name = 'm5.large' AND kind = 'compute.vm' AND provider = 'aws' "
                                             "AND service = 'ec2'").collect()}
    records = run_batch(requests, twins).collect()
    assert len(wanted) > 1 and {r.exit_code for r in records} == {0}
    assert sorted(json.loads(r.output)["sku_id"] for r in records) == sorted(wanted)
