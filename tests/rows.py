"""Invented catalog rows for the tests."""

from pyspark.sql import functions as F

from tarifold import schemas as S
from tarifold.functions.terms import terms_hash_of


def make(spark, *items):
    """Each item: dict of row fields; attrs, terms and prices may be partial."""
    data = []
    for i in items:
        attrs = {f: None for f in S.ATTR_FIELDS} | i.get("attrs", {})
        terms = {f: "" for f in S.TERM_FIELDS} | {"commitment": "on_demand"} | i.get("terms", {})
        prices = [dict(zip(S.PRICE_FIELDS, p)) for p in i.get("prices", [])]
        data.append((i["id"], i.get("provider", "aws"), i.get("service", "ec2"), i.get("kind", "compute.vm"),
                     i.get("name", "m5.large"), i.get("region", "us-east-1"), i.get("group", "us-east"), "",
                     tuple(attrs[f] for f in S.ATTR_FIELDS), tuple(terms[f] for f in S.TERM_FIELDS),
                     [tuple(p[f] for f in S.PRICE_FIELDS) for p in prices],
                     tuple(i["health"][f] for f in S.HEALTH_FIELDS) if "health" in i else None,
                     i.get("aggregated", False)))
    return spark.createDataFrame(data, S.ROW).withColumn("terms_hash", terms_hash_of(F.col("terms")))


def hourly(amount):
    return ("compute", "", "", amount, "hrs")


VM = {"tenancy": "shared", "os": "linux"}
