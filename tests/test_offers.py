"""The splittable scan of offers against the whole-document read."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tarifold.sources import documents as D
from tarifold.sources.offers import SplitDocuments, read_offer_prices


def offer(n, seed):
    """An offer with braces, quotes, backslashes and letters beyond ASCII in its texts, and reserved terms between."""
    r = random.Random(seed)
    odd = ['}', '{"a": {', '\\', '"', '}]}"', 'é}', '\\"}', '', '\n}', 'plain']

    def text():
        return "".join(r.choice(odd) for _ in range(r.randint(0, 6)))

    products = {f"P{i}": {"sku": f"P{i}", "productFamily": r.choice(["Storage", "Compute Instance", "Other}"]),
                          "attributes": {f"k{j}": text() for j in range(r.randint(0, 5))}} for i in range(n)}

    def term(i, part):
        return {f"P{i}.{part}.{t}": {"offerTermCode": text(), "priceDimensions": {
            f"d{j}": {"unit": "Hrs", "description": text(), "beginRange": "0", "endRange": "Inf", "appliesTo": [[], [text()]],
                      "pricePerUnit": {"USD": str(r.random())}} for j in range(r.randint(1, 3))}} for t in range(2)}
    return {"formatVersion": "v1", "note": text(), "products": products, "terms": {
        "Reserved": {f"P{i}": term(i, "R") for i in range(n)},
        "OnDemand": {f"P{i}": term(i, "O") for i in range(n) if i % 7}}, "tail": [{"x": text()}]}


@pytest.fixture(scope="module", params=[None, 1])
def landed(request, tmp_path_factory):
    root = tmp_path_factory.mktemp("offers")
    for k, n in enumerate([50, 20, 0]):
        (root / f"{k}.json").write_text(json.dumps(offer(n, k), indent=request.param, ensure_ascii=k == 0), encoding="utf-8")
    return root


def listed(df):
    cols = [c for c in df.columns if c != "pos"]
    return sorted(map(str, df.select(*cols).withColumn("attributes", F.to_json("attributes")).collect()))


@pytest.mark.parametrize("split_bytes", [3_001, 1 << 20])
def test_equals_the_whole_read(spark, landed, split_bytes):
    families = ["Storage", "Other}"]
    whole = D.offer_prices(D.read_documents(spark, str(landed), D.OFFER_DDL), families)
    split = read_offer_prices(spark, str(landed), families, split_bytes)
    found = listed(split)
    assert found and found == listed(whole)


def test_order_paths_and_splits(spark, landed):
    documents = SplitDocuments(spark, str(landed / "0.json"), 9_001)
    assert len(documents.strings) > 5
    want = json.loads((landed / "0.json").read_text())
    for path, held in ((("products",), want["products"]), (("terms", "Reserved"), want["terms"]["Reserved"]), (("none",), {})):
        rows = sorted(documents.entries(*path).collect(), key=lambda r: r.pos)
        assert [(r.key, json.loads(r.value)) for r in rows] == list(held.items())


def test_entry_longer_than_splits_and_empty_file(spark, tmp_path):
    body = {"products": {"a": {"t": "}x" * 5_000}, "b}": {"u": [{"v": 1}] * 900}, "c": 5, "d": {}}}
    (tmp_path / "long.json").write_text(json.dumps(body))
    (tmp_path / "void.json").write_text("")
    rows = sorted(SplitDocuments(spark, str(tmp_path), 4_000).entries("products").collect(), key=lambda r: r.pos)
    assert {r.key: json.loads(r.value) for r in rows} == {k: v for k, v in body["products"].items() if k != "c"}


def test_key_cut_by_a_split_is_refused(spark, tmp_path):
    (tmp_path / "key.json").write_text(json.dumps({"products": {"x}" * 3_000: {"a": 1}}}))
    with pytest.raises(Exception, match="brace"):
        SplitDocuments(spark, str(tmp_path), 1_000).entries("products").collect()
