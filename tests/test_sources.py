"""Reading normalized JSON lines, numbers in text, and byte tiers."""

import pytest
from pyspark.sql import functions as F

from tarifold.functions.numbers import quantity
from tarifold.operators.quality import tier_gaps
from tarifold.sources.catalog import read_rows_json


def test_broken_line_fails_the_read(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"sku_id": "a"}\n\n{"sku_id": "b"}\n')
    assert {r.sku_id for r in read_rows_json(spark, str(tmp_path / "good.json")).collect()} == {"a", "b"}
    (tmp_path / "bad.json").write_text('{"sku_id": "a"}\n{"sku_id": "b", "pri\n')
    with pytest.raises(Exception):
        read_rows_json(spark, str(tmp_path / "bad.json")).collect()


def test_quantity_takes_numbers_only(spark):
    df = spark.createDataFrame([("5d",), ("1f",), ("2.5K",), ("1e3",), ("NaN",)], "x string")
    assert [r[0] for r in df.select(quantity(F.col("x"))).collect()] == [None, None, 2500.0, 1000.0, None]


def test_byte_tiers_are_contiguous(spark):
    tiers = ["0", "10TB", "50TB", "150TB", "500TB"]
    prices = [("egress", a, b) for a, b in zip(tiers, [*tiers[1:], ""])]
    df = spark.createDataFrame([("s", "network.cdn", prices), ("t", "network.cdn", prices[:1] + prices[2:])],
                               "sku_id string, kind string, prices array<struct<dimension string, tier string, tier_upper string>>")
    assert [(r.sku_id, r.tier) for r in tier_gaps(df).collect()] == [("t", "0")]
