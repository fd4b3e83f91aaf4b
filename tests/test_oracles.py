"""A sample of the registered queries against the SQL that states them, over whole tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from tarifold.plans import load_all
from tarifold.plans.registry import ORACLES, QUERIES

load_all()
TABLES = "region nation customer supplier part orders lineitem events documents".split()
SAMPLE = ("terms_hash", "compare_compute_vm", "lookup_bulk", "tier_walk", "update_plan", "delta_chain", "price_drift",
          "feed_aws_ec2", "feed_aws_s3", "feed_azure_redis", "feed_gcp_gcs", "feed_openrouter", "estimate_dns_zone",
          "offer_document_prices", "star_change_groups", "star_delta_apply", "feed_fingerprint", "stratified_sample")


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return None if math.isnan(v) else float(f"{float(v):.9g}")
    return str(v)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 150


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    want = sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=repr)
    frame = QUERIES[name](spark, sf_dir)
    assert sorted(frame.columns) == sorted(columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    assert got == want
