import pytest
from pyspark.sql import functions as F

from tarifold.operators import versions as V
from tarifold.operators.rows import split_star
from tarifold.schemas import ROW, STAR_KEYS
from tarifold.sources.catalog import head_version, read_catalog, write_catalog
from tarifold.streaming.changes import apply_change_stream
from tests.rows import VM, hourly, make


@pytest.fixture(scope="module")
def snapshots(spark):
    health = dict(uptime_30d=1.0, latency_p50_ms=1, latency_p95_ms=2, throughput_tokens_per_sec=1.0, observed_at=0)
    two = [hourly(1.0), ("io", "", "", 2.0, "gb")]
    old = make(spark, {"id": "gone", "terms": VM, "prices": two}, {"id": "same", "terms": VM, "prices": two},
               {"id": "cut", "terms": VM, "prices": two}, {"id": "ill", "terms": VM, "prices": two, "health": health})
    new = make(spark, {"id": "same", "terms": VM, "prices": two}, {"id": "cut", "terms": VM, "prices": [hourly(1.0)]},
               {"id": "ill", "terms": VM, "prices": two}, {"id": "born", "terms": VM, "prices": two})
    return old, new


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_round_trip(snapshots):
    old, new = snapshots
    changes = V.diff_tables(old, new, ["sku_id"])
    assert {(r.op, r.sku_id) for r in changes.collect()} == {
        ("delete", "gone"), ("upsert", "cut"), ("upsert", "ill"), ("upsert", "born")}
    assert same(V.apply_changes(old, changes, ["sku_id"]), new)
    assert V.diff_tables(new, new, ["sku_id"]).isEmpty()


def test_star_round_trip_deletes_lost_rows(snapshots):
    old, new = (split_star(s) for s in snapshots)
    groups = {(r.change_group, r.table, r.op, r.sku_id, r.part) for r in V.diff_star(old, new, STAR_KEYS).collect()}
    assert {(0, "skus", "delete", "gone", ""), (1, "prices", "delete", "cut", "io|"),
            (1, "health", "delete", "ill", "")} <= groups
    assert not any(g[3] == "same" for g in groups)
    for name in new:
        keys = list(STAR_KEYS[name])
        assert same(V.apply_changes(old[name], V.diff_tables(old[name], new[name], keys), keys), new[name])


def test_star_delta_carries_rows(spark, snapshots):
    old, new = snapshots
    metadata = spark.createDataFrame([("catalog_version", "2")], "key string, value string")
    delta = V.star_delta(old, new, metadata)
    found = {(r.change_group, r.table, r.op, r.sku_id, r.part) for r in delta.collect()}
    assert {(0, "skus", "delete", "gone", ""), (1, "prices", "delete", "cut", "io|"), (1, "health", "delete", "ill", ""),
            (2, "prices", "upsert", "born", "io|"), (3, "metadata", "upsert", None, "catalog_version")} <= found
    assert not any(r[3] == "same" for r in found)
    applied, want = V.apply_star_delta(split_star(old), delta), split_star(new)
    assert all(same(applied[name], want[name]) for name in want)
    assert same(applied["metadata"], metadata)
    assert not V.is_noop(delta) and V.is_noop(V.star_delta(new, new, metadata)) and V.is_noop(V.star_delta(new, new))
    assert V.star_delta(old.limit(0), new).filter("op = 'delete'").isEmpty()


def test_chain_rules(snapshots):
    old, new = snapshots
    step = V.diff_tables(old, new, ["sku_id"])
    back = V.diff_tables(new, old, ["sku_id"])
    out, version = V.apply_chain(old, "1", [("1", "2", step), ("2", "3", back)], ["sku_id"])
    assert version == "3" and same(out, old)
    with pytest.raises(ValueError, match="does not start"):
        V.apply_chain(old, "0", [("1", "2", step)], ["sku_id"])
    with pytest.raises(ValueError, match="longer"):
        V.apply_chain(old, "1", [("1", "2", step)] * 21, ["sku_id"], V.MAX_CHAIN)


def test_fingerprint_ignores_order(snapshots):
    rows = snapshots[0]
    one = V.fingerprint(rows, ["kind"], ["sku_id", "region"]).first().fingerprint
    assert one == V.fingerprint(rows.orderBy(F.desc("sku_id")), ["kind"], ["sku_id", "region"]).first().fingerprint
    assert one != V.fingerprint(rows.limit(2), ["kind"], ["sku_id", "region"]).first().fingerprint


def test_change_stream_equals_batch(spark, snapshots, tmp_path):
    old, new = snapshots
    root, landing = str(tmp_path / "catalog"), str(tmp_path / "changes")
    write_catalog(old, root, "v1")
    V.diff_tables(old, new, ["sku_id"]).withColumn("seq", F.lit(1)).write.parquet(landing)
    stream = spark.readStream.schema(f"op string, sku_id string, row {ROW.simpleString()}, seq int").parquet(landing)
    apply_change_stream(stream, root, str(tmp_path / "checkpoint")).awaitTermination()
    assert head_version(spark, root) == "v1+000000"
    assert same(read_catalog(spark, root), new)
