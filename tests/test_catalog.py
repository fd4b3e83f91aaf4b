import pytest

from tarifold.operators import compare as C, lookup as L, shape as O
from tarifold.operators.rows import assemble_rows, split_star
from tarifold.sources.catalog import read_catalog, read_star, write_catalog, write_star
from tests.rows import VM, hourly, make


@pytest.fixture(scope="module")
def vms(spark):
    return make(
        spark,
        {"id": "a", "terms": VM, "attrs": {"vcpu": 4, "memory_gb": 16.0}, "prices": [hourly(0.2)]},
        {"id": "b", "provider": "azure", "service": "vm", "name": "D4", "region": "eastus", "terms": VM,
         "attrs": {"vcpu": 4, "memory_gb": 16.0}, "prices": [hourly(0.1)]},
        {"id": "c", "terms": VM, "attrs": {"vcpu": 8, "memory_gb": 32.0}},
        {"id": "d", "terms": {**VM, "os": "windows"}, "attrs": {"vcpu": 4}, "prices": [hourly(0.01)]},
        {"id": "e", "terms": VM, "attrs": {"vcpu": 4, "gpu_count": 1}, "prices": [hourly(1.0)]},
        {"id": "f", "terms": VM, "region": "eu-west-1", "prices": [hourly(0.5), ("io", "", "", 0.05, "gb")]})


def ids(df):
    return [r.sku_id for r in df.select("sku_id").collect()]


def test_compare_puts_unpriced_first_and_filters(vms):
    assert ids(C.compare(vms, "compute.vm")) == ["c", "f", "b", "a"]
    assert ids(C.compare(vms, "compute.vm", C.CompareSpec(vcpu=4, max_price=1.0), ["us-east"])) == ["b", "a"]
    assert ids(C.compare(vms, "compute.vm", C.CompareSpec(gpu_count=1))) == ["e"]
    assert ids(C.compare(vms, "compute.vm", sort="vcpu")) == ["f", "a", "b", "c"]


@pytest.mark.parametrize("kind, spec, sort", [
    ("compute.vm", C.CompareSpec(mode="x"), "price"), ("storage.object", C.CompareSpec(), "vcpu"),
    ("dns.zone", C.CompareSpec(ops=1), "price"), ("compute.vm", C.CompareSpec(ops=1, gb=1), "price"),
    ("no.kind", C.CompareSpec(), "price")])
def test_spec_is_checked(kind, spec, sort):
    with pytest.raises(ValueError):
        C.check_spec(kind, spec, sort)


def test_expand_regions():
    out = C.expand_regions(["sa", "us-east-1"])
    assert {"sa", "global", "us-east-1", "brazilsouth"} <= set(out) and out == sorted(out)
    with pytest.raises(ValueError):
        C.expand_regions(["atlantis"])


def test_lookup_ignores_terms_unless_given(vms):
    assert ids(L.lookup(vms, "compute.vm", "m5.large", region="us-east-1")) == ["a", "c", "d", "e"]
    assert ids(L.lookup(vms, "compute.vm", "m5.large", region="us-east-1", commitment="on_demand", **{
        "tenancy": "shared", "os": "windows"})) == ["d"]
    assert ids(L.lookup(vms, "compute.vm", "m5.large", commitment="on_demand")) == []
    with pytest.raises(ValueError):
        L.lookup(vms, "compute.vm")


def test_bulk_lookup_equals_single_lookups(spark, vms):
    requests = spark.createDataFrame(
        [("1", "compute.vm", "m5.large", "aws", None, "us-east-1", None), ("2", "compute.vm", "D4", None, None, None, None),
         ("3", "compute.vm", "nope", None, None, None, None)],
        "request_id string, kind string, resource_name string, provider string, service string, region string, terms_hash string")
    answers = L.lookup_many(vms, requests)
    got = {(r.request_id, r.sku_id) for r in answers.collect()}
    assert got == {("1", x) for x in "acde"} | {("2", "b")}
    assert [r.request_id for r in L.unmatched(requests, answers).collect()] == ["3"]


def test_search_orders_nulls(vms):
    assert ids(L.search(vms, "aws", "ec2", sort="vcpu"))[0] == "f"
    assert ids(L.search(vms, "aws", "ec2", sort="price"))[-1] == "c"
    assert ids(L.search(vms, "aws", "ec2", sort="price", limit=1)) == ["d"]
    with pytest.raises(ValueError):
        L.search(vms, "aws", "ec2", sort="colour")


def test_mixed_units(vms):
    row = C.mixed_units(vms.filter("sku_id = 'f'"), ["kind"]).first()
    assert row.families == "byte" and not row.mixed


def test_star_round_trip(spark, vms, tmp_path):
    star = split_star(vms)
    star["terms"] = star["terms"].fillna("")
    assert sorted(map(str, assemble_rows(star).collect())) == sorted(map(str, vms.collect()))
    meta = spark.createDataFrame([("schema_version", "1")], "key string, value string")
    write_star(vms, meta, str(tmp_path / "star"))
    assert read_star(spark, str(tmp_path / "star"))["prices"].count() == 6
    write_star(vms, meta.withColumn("value", meta.key), str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        read_star(spark, str(tmp_path / "bad"))


def test_versioned_catalog_prunes(spark, vms, tmp_path):
    root = str(tmp_path / "catalog")
    write_catalog(vms, root, "1")
    write_catalog(vms.filter("sku_id <> 'a'"), root, "2")
    assert read_catalog(spark, root).count() == 5 and read_catalog(spark, root, "1").count() == 6
    plan = C.compare(read_catalog(spark, root), "compute.vm")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan and "(kind#" in plan


def test_envelope_and_presets(vms):
    e = O.envelope(vms.filter("sku_id = 'a'"), catalog_version="7")
    row = O.preset(e, "agent").first()
    assert row.location.provider_region == "us-east-1" and row.price[0].tier is None
    assert set(O.preset(e, "price").columns) == {"price"}
    assert O.preset(e, "compare").first().resource.vcpu == 4
    text = O.to_json_lines(O.preset(e, "agent")).first().value
    assert '"location":{"provider_region":"us-east-1"}' in text and '"tier":null' in text
    assert O.project_fields(e, "price.0.amount,no.such,sku_id").columns == ["price_0_amount", "sku_id"]
