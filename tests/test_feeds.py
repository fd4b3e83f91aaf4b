import json

import pytest
from pyspark.sql import functions as F

from tarifold.feeds import aws, azure, gcp, llm
from tarifold.feeds.ops import suffix_collisions, with_region_group
from tarifold.sources import documents as D


def save(path, doc):
    path.write_text(json.dumps(doc))
    return str(path)


def offer(*products):
    """products: (sku, family, attributes, [price dimensions])."""
    return {"products": {s: {"productFamily": f, "attributes": a} for s, f, a, _ in products},
            "terms": {"OnDemand": {s: {s + ".T": {"priceDimensions": {f"{s}.{i}": d for i, d in enumerate(ds)}}}
                                   for s, _, _, ds in products if ds}}}


def dim(usd, unit="Hrs", **more):
    return {"unit": unit, "pricePerUnit": {"USD": str(usd)}, **more}


VM = {"instanceType": "m5.large", "regionCode": "us-east-1", "operatingSystem": "Linux", "tenancy": "Shared",
      "preInstalledSw": "NA", "capacitystatus": "Used", "vcpu": "2", "memory": "8 GiB"}


def test_offer_document_to_rows(spark, tmp_path):
    path = save(tmp_path / "offer.json", offer(
        ("A", "Compute Instance", VM, [dim(0.096), dim(9.0)]), ("B", "Compute Instance", {**VM, "regionCode": "moon"}, [dim(1)]),
        ("C", "Compute Instance", VM, [])))
    row, = aws.ec2(D.offer_prices(D.read_documents(spark, path, D.OFFER_DDL))).collect()
    assert (row.sku_id, row.region_normalized, row.resource_attrs.vcpu, row.resource_attrs.memory_gb) == (
        "A", "us-east", 2, 8.0)
    assert [(p.dimension, p.amount, p.unit) for p in row.prices] == [("compute", 0.096, "hrs")]


def test_tiers_follow_numeric_order(spark, tmp_path):
    zone = [dim(0.1, beginRange="25", endRange="Inf"), dim(0.5, beginRange="0", endRange="25")]
    path = save(tmp_path / "dns.json", offer(("Z", "DNS Zone", {"group": "HostedZone"}, zone),
                                             ("Q", "DNS Query", {"usagetype": "DNS-Queries"}, [dim(4e-7, beginRange="0")])))
    rows = {r.resource_name: r for r in aws.route53(D.offer_prices(D.read_documents(spark, path, D.OFFER_DDL))).collect()}
    assert [(p.tier, p.tier_upper, p.amount) for p in rows["private"].prices] == [("0", "25", 0.5), ("25", "", 0.1)]
    assert len(rows["public"].prices) == 3


def test_gateway_tier_outside_vocabulary_fails(spark, tmp_path):
    path = save(tmp_path / "api.json", offer(("A", "API Calls", {
        "operation": "ApiGatewayRequest", "location": "EU (Ireland)"}, [dim(1, beginRange="7", endRange="Inf")])))
    with pytest.raises(Exception, match="outside the vocabulary"):
        aws.api_gateway(D.offer_prices(D.read_documents(spark, path, D.OFFER_DDL))).collect()


def item(**fields):
    return {"currencyCode": "USD", "type": "Consumption", "retailPrice": 1.0, "armRegionName": "eastus",
            "unitOfMeasure": "1 Hour", **fields}


def test_first_meter_wins_before_regions_are_filtered(spark, tmp_path):
    vm = dict(serviceName="Virtual Machines", productName="D Series", armSkuName="D2", meterId="m")
    path = save(tmp_path / "vm.json", {"Items": [{**item(**vm), "armRegionName": "moon"}, item(**vm)]})
    items = D.retail_items(D.read_documents(spark, path, D.RETAIL_DDL))
    assert azure.vm(items).isEmpty()
    database = {**vm, "serviceName": "SQL Database", "productName": "X Elastic Pool", "skuName": "g"}
    path = save(tmp_path / "sql.json", {"Items": [{**item(**database), "armRegionName": "moon"}, item(**database)]})
    items = D.retail_items(D.read_documents(spark, path, D.RETAIL_DDL))
    assert azure.JOBS["azure_sql"](items).first().terms.os == "elastic-pool"


def test_collisions_are_numbered_across_buckets(spark):
    df = spark.range(10).select(F.lit("k").alias("key"), F.lit("C1 Cache").alias("label"), F.col("id").alias("pos"))
    out = suffix_collisions(df, "key", "label", "pos", F.floor(F.col("pos") / 3)).orderBy("pos")
    assert [r.key for r in out.collect()] == ["k-c1-cache"] + [f"k-c1-cache-{i}" for i in range(2, 11)]


def test_strict_region(spark):
    df = spark.createDataFrame([("moon",)], "region string")
    assert with_region_group(df, "aws").isEmpty()
    with pytest.raises(Exception, match="untracked region aws/moon"):
        with_region_group(df, "aws", strict=True).collect()


def test_component_prices(spark, tmp_path):
    def sku(i, text, unit, nanos):
        return {"skuId": i, "description": text, "serviceRegions": ["us-east1"], "category": {
            "serviceDisplayName": "Compute Engine", "resourceFamily": "Compute", "usageType": "OnDemand"},
            "pricingInfo": [{"pricingExpression": {"usageUnit": unit, "tieredRates": [
                {"startUsageAmount": 0, "unitPrice": {"currencyCode": "USD", "units": "0", "nanos": nanos}}]}}]}
    path = save(tmp_path / "skus.json", {"skus": [sku("C", "N1 Predefined Instance Core running in A", "h", 30_000_000),
                                                  sku("R", "N1 Predefined Instance Ram running in A", "GiBy.h", 4_000_000)]})
    machines = save(tmp_path / "m.json", {"items": {"z": {"machineTypes": [
        {"name": "n1-standard-2", "guestCpus": 2, "memoryMb": 7680},
        {"name": "a2-gpu", "guestCpus": 2, "memoryMb": 1, "accelerators": [{"guestAcceleratorType": "x"}]}]}}})
    row, = gcp.gce(D.billing_skus(D.read_documents(spark, path, D.BILLING_DDL)),
                   D.machine_types(D.read_documents(spark, machines, D.MACHINE_DDL))).collect()
    assert row.sku_id == "C:n1-standard-2" and row.prices[0].amount == pytest.approx(2 * 0.03 + 7.5 * 0.004)


def test_models(spark, tmp_path):
    models = save(tmp_path / "models.json", {"data": [
        {"id": "a/b", "context_length": 10, "architecture": {"modality": "text", "input_modalities": ["text"]},
         "pricing": {"prompt": "0.5", "completion": "0"}}, {"id": "a/none", "pricing": {}}]})

    def endpoint(tag, uptime, prompt, **more):
        return {"tag": tag, "uptime_last_30m": uptime, "pricing": {"prompt": prompt, **more}}
    path = save(tmp_path / "e.json", {"data": {"id": "a/b", "endpoints": [
        endpoint("p", 0.9, "1"), endpoint("p", 0.99, "1"), endpoint("q", 0.9, "2"), endpoint("q", 0.1, "1"),
        endpoint("eur", 1.0, "1", currency="eur")]}})
    frames = (D.models(D.read_documents(spark, models, D.MODELS_DDL)),
              D.endpoints(D.read_documents(spark, path, D.ENDPOINTS_DDL)))
    rows = {r.provider: r for r in llm.openrouter(*frames, skip_non_usd=True).collect()}
    assert set(rows) == {"p", "q", "openrouter"} and rows["p"].kind == "llm.text"
    assert rows["p"].health.uptime_30d == 0.99 and rows["q"].health.uptime_30d == 0.1
    assert [p.dimension for p in rows["openrouter"].prices] == ["prompt"]
    assert [r.provider for r in llm.rejected(*frames).collect()] == ["eur"]
    with pytest.raises(Exception, match="non-usd"):
        llm.openrouter(*frames).collect()
