"""How much work queries do: inputs read once, narrow rows in exchanges."""

from pyspark.sql import functions as F

from tarifold.operators.batch import parse_requests, run_batch
from tests.rows import VM, hourly, make


def test_a_batch_reads_its_requests_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    lines = ['{"command": "llm price", "args": {"model": "m"}}', '{"command": "aws ec2 list", "args": {"instance_type": "t"}}',
             '{"command": "compare", "args": {"kind": "compute.vm"}}', '{"command": "fly"}',
             '{"command": "estimate", "args": {"item": "aws/ec2:t:region=r"}}']
    asked = spark.createDataFrame(list(enumerate(lines)), "request_id bigint, value string")
    asked = asked.withColumn("value", F.udf(seen, "string").asNondeterministic()("value"))
    rows = make(spark, {"id": "vm", "service": "ec2", "name": "t", "region": "r", "terms": VM, "prices": [hourly(0.5)]})
    records = run_batch(parse_requests(asked), rows).collect()
    assert {r.request_id: r.exit_code for r in records} == {0: 3, 1: 0, 2: 0, 3: 4, 4: 0}
    assert read.value == len(lines)


def test_offers_of_models_travel_narrow(spark, sf_dir):
    from tarifold.plans import load_all
    from tarifold.plans.registry import QUERIES
    load_all()
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    plan = QUERIES["feed_openrouter"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    (line,) = [line for line in plan.splitlines() if "partial_min_by(" in line]
    assert "prices#" not in line.split("functions=")[1]


def test_requests_without_an_answer_are_found_in_one_join(spark, sf_dir):
    from tarifold.operators.lookup import lookup_many, lookup_missing, unmatched
    from tarifold.plans import load_all
    from tarifold.plans.registry import QUERIES
    load_all()
    df = QUERIES["lookup_not_found"](spark, sf_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey#") and sum("Relation" in line and "l_orderkey#" in line for line in plan.splitlines()) == 2
    rows = make(spark, *({"id": f"s{k}", "service": f"v{k % 2}", "name": f"n{k % 3}", "region": f"r{k % 4}", "terms": VM} for k in range(8)))
    asked = spark.createDataFrame(
        [(k, "compute.vm", f"n{k % 4}", None, f"v{k % 3}" if k % 2 else None, f"r{k % 5}" if k % 3 else None, None) for k in range(40)],
        "request_id int, kind string, resource_name string, provider string, service string, region string, terms_hash string")
    want = unmatched(asked, lookup_many(rows, asked)).collect()
    assert 0 < len(want) < 40 and sorted(lookup_missing(rows, asked).collect()) == sorted(want)


def test_two_snapshots_come_from_one_pass(spark, sf_dir):
    from tarifold.plans import load_all
    from tarifold.plans.registry import QUERIES
    from tarifold.plans.star import star_rows, star_snapshots
    load_all()
    df = QUERIES["star_change_groups"](spark, sf_dir)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert sum("Scan parquet" in line and "l_partkey" in line for line in plan.splitlines()) == 1
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    met = [F.col("l_linestatus") == "F", F.col("l_returnflag") != "R", F.lit(None).cast("boolean")]
    for got, condition in zip(star_snapshots(spark, sf_dir, *met), met):
        want = star_rows(spark, sf_dir, lines.filter(condition))
        assert got.schema.simpleString() == want.schema.simpleString()
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def _executed(df):
    """Nodes of the finished plan; a reused exchange is met once."""
    todo, seen = [df._jdf.queryExecution().executedPlan()], set()
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif node.id() not in seen:
            seen.add(node.id())
            yield name, node
            todo += [node.children().apply(i) for i in range(node.children().size())]


def _shuffled_rows(df):
    """Rows that exchanges hold, by Spark's own counts, and the rows of the result."""
    n = len(df.collect())
    return sum(node.metrics().apply("shuffleRecordsWritten").value() for name, node in _executed(df) if name == "ShuffleExchangeExec"), n


def test_answers_of_a_batch_stay_where_they_are_made(spark, monkeypatch):
    from tarifold.operators import lookup
    machines, asked = 60, 100
    rows = make(spark, *({"id": f"vm{k:02}", "service": "ec2", "name": "t", "region": f"r{k % 7}", "terms": VM, "prices": [hourly(0.5)]}
                         for k in range(machines))).persist()
    line = '{"command": "aws ec2 list", "args": {"instance_type": "%s"}}'
    lines = spark.range(asked + 1).selectExpr("id AS request_id", f"IF(id = {asked}, '{line % 'u'}', '{line % 't'}') AS value")
    records = run_batch(parse_requests(lines), rows)
    shuffled, n = _shuffled_rows(records)
    assert n == machines * asked + 1 and shuffled < n / 4
    monkeypatch.setattr(lookup, "BLOCK", 8, raising=False)
    got = {}
    for r in run_batch(parse_requests(lines), rows).collect():
        got.setdefault(r.request_id, []).append((r.position, r.region, r.sku_id, r.exit_code, r.error))
    assert got.pop(asked) == [(None, None, None, 3, '{"code":"not_found","applied_filters":{"instance_type":"u"}}')]
    want = sorted((f"r{k % 7}", f"vm{k:02}") for k in range(machines))
    assert len(got) == asked and all(sorted(g) == [(i + 1, *w, 0, None) for i, w in enumerate(want)] for g in got.values())


def test_comparisons_enter_only_rows_of_kinds_and_places_asked_for(spark):
    from tarifold.operators.compare_bulk import compare_many
    rows = make(spark, *({"id": f"{kind}{k}", "kind": kind, "region": f"r{k % 10}", "terms": VM if kind == "compute.vm" else {"tenancy": "redis"},
                          "name": f"n{k}", "prices": [hourly(1.0 + k)], "attrs": {"memory_gb": float(k)}}
                         for kind in ("compute.vm", "cache.kv", "dns.zone") for k in range(200)))
    places = spark.createDataFrame([(f"r{k}", [f"r{k}"]) for k in range(10)], "name string, literals array<string>")
    asked = spark.createDataFrame([(1, "cache.kv", ["r3"], 100)], "request_id int, kind string, regions array<string>, `limit` int")
    found = compare_many(rows.persist(), asked, places)
    shuffled, n = _shuffled_rows(found)
    assert n == 20 and shuffled < 200


def _exchanged(spark, sf_dir, name):
    """Rows that exchanges of a query hold, as a multiple of the order lines, with sort-merge joins as on large tables."""
    from tarifold.plans import load_all
    from tarifold.plans.registry import QUERIES
    load_all()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES[name](spark, sf_dir)
        shuffled, _ = _shuffled_rows(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    return shuffled / spark.read.parquet(f"{sf_dir}/lineitem.parquet").count(), df


def test_lines_and_catalog_of_bulk_lookups_cross_three_exchanges(spark, sf_dir):
    assert _exchanged(spark, sf_dir, "lookup_bulk")[0] < 3.5  # by part, by supplier, by what requests name


def test_requests_without_an_answer_meet_each_row_once(spark, sf_dir):
    assert _exchanged(spark, sf_dir, "lookup_not_found")[0] < 5  # lines three times, the smaller catalog three times and its keys once


def test_rows_entered_under_few_names_answer_alike(spark):
    from itertools import product
    from tarifold.operators.lookup import lookup_many, lookup_missing
    rows = make(spark, *({"id": f"s{k}", "provider": f"p{k % 2}", "service": f"v{k % 3}", "name": f"n{k % 2}", "region": None if k == 5 else f"r{k % 4}",
                          "terms": VM if k % 5 else {"os": "windows"}, "prices": [hourly(2.0), ("a", "", "", 1.0, "hrs")][:k % 3]} for k in range(24)))
    hashes = [r.terms_hash for r in rows.select("terms_hash").distinct().collect()]
    asked = list(product(("n0", "n1", None), ("p0", None), ("v1", None), ("r0", "r2", "none", None), (hashes[0], None)))
    requests = spark.createDataFrame([(k, "compute.vm", *a) for k, a in enumerate(asked)], "request_id int, kind string, resource_name string, "
                                     "provider string, service string, region string, terms_hash string")
    want, lost = sorted(map(str, lookup_many(rows, requests).collect())), sorted(map(str, lookup_missing(rows, requests).collect()))
    assert want and lost
    for entered in ([()], [("region", "service"), ("region",), ()], [("terms_hash",), ()]):
        assert sorted(map(str, lookup_many(rows, requests, entered=entered).collect())) == want
        assert sorted(map(str, lookup_missing(rows, requests, entered=entered).collect())) == lost
    shown = lookup_many(rows, requests, entered=[()], shown=("sku_id", F.transform("prices", lambda p: p["dimension"]).alias("names")))
    assert shown.columns == ["request_id", "sku_id", "names"]
    assert {tuple(r.names) for r in shown.collect()} == {(), ("compute",), ("a", "compute")}


def test_catalog_beside_its_lines_is_the_catalog(spark, sf_dir):
    from tarifold.plans.star import lines_and_rows, star_rows
    got, want = lines_and_rows(spark, sf_dir)[1], star_rows(spark, sf_dir)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_delta_is_computed_once_for_all_tables(spark, sf_dir):
    times, df = _exchanged(spark, sf_dir, "star_delta_apply")
    assert times < 4  # lines by part, items by supplier and by sku_id, records by sku_id
    assert sum("FullOuter" in node.simpleString(1000) for name, node in _executed(df) if name == "SortMergeJoinExec") == 1


def test_kept_catalog_is_plain_columns(spark, sf_dir):
    from tarifold.plans import star
    got, want = star.kept_star_rows(spark, sf_dir), star.star_rows(spark, sf_dir)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    (kept,) = [line for line in plan.splitlines() if "InMemoryRelation [" in line]
    assert "p_name#" in kept and "resource_attrs#" not in kept and "prices#" not in kept
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
