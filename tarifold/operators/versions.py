"""Catalog versions: snapshot diff, applying change chains, update plans, release manifests, change detection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tarifold.functions.cases import first_case
from tarifold.functions.terms import empty_to_null_terms
from tarifold.schemas import MAX_SCHEMA_VERSION, MIN_SCHEMA_VERSION, ROW, SKU_COLUMNS

MAX_CHAIN = 20  # the published bound, for callers who want it


def diff_tables(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Changes from one snapshot of a keyed table to the next: (op, keys, row), op being delete or upsert.

    One full outer join on the key; rows compare field by field and null-safe, so no hash can hide a change.
    """
    cols = new.columns
    before = old.select(*(F.col(k).alias(f"_o_{k}") for k in keys), F.struct(*cols).alias("_old"))
    after = new.select(*(F.col(k).alias(f"_n_{k}") for k in keys), F.struct(*cols).alias("_new"))
    joined = before.join(after, [F.col(f"_o_{k}") == F.col(f"_n_{k}") for k in keys], "full_outer")
    op = F.when(F.col("_new").isNull(), "delete").when(~F.col("_old").eqNullSafe(F.col("_new")), "upsert")
    return (joined.withColumn("op", op).filter("op IS NOT NULL")
            .select("op", *(F.coalesce(f"_n_{k}", f"_o_{k}").alias(k) for k in keys), F.col("_new").alias("row")))


def apply_changes(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The next snapshot: untouched rows plus upserted rows."""
    kept = base.join(changes.select(*keys), keys, "left_anti").select(*base.columns)
    return kept.unionByName(changes.filter("op = 'upsert'").select("row.*").select(*base.columns))


def collapse_chain(deltas: list[DataFrame], keys: list[str]) -> DataFrame:
    """One change table that does what the deltas do in order: the last change of every key.

    A key occurs at most once per delta, so a chain costs one aggregate and one join, not one join per step.
    """
    steps = [d.withColumn("_step", F.lit(i)) for i, d in enumerate(deltas)]
    every = reduce(DataFrame.unionByName, steps)
    return (every.groupBy(*keys).agg(F.max_by(F.struct("op", "row"), "_step").alias("c"))
            .select("c.op", *keys, "c.row"))


def apply_chain(base: DataFrame, local_version: str, chain: list[tuple[str, str, DataFrame]], keys: list[str],
                max_chain: int | None = None) -> tuple[DataFrame, str]:
    """Apply (from, to, changes) steps in order. The result is a new frame, so a failing job changes nothing."""
    if not chain or chain[0][0] != local_version:
        raise ValueError(f"chain does not start at version {local_version}")
    if max_chain is not None and len(chain) > max_chain:
        raise ValueError(f"chain of {len(chain)} deltas is longer than {max_chain}")
    return apply_changes(base, collapse_chain([c for _, _, c in chain], keys), keys), chain[-1][1]


def diff_star(old: dict[str, DataFrame], new: dict[str, DataFrame], keys: dict[str, tuple[str, ...]]) -> DataFrame:
    """Keys of the change groups over star tables: 0 item deletes, 1 price deletes of live items, 2 upserts.

    Every row of a changed item is listed. A one-to-one row that vanished from a live item is deleted too. This lists keys
    only; `star_delta` gives changes that can be applied.
    """
    changes = {name: diff_tables(old[name], new[name], list(keys[name])) for name in new}
    gone = changes["skus"].filter("op = 'delete'").select("sku_id")
    touched = reduce(DataFrame.unionByName, [c.select("sku_id") for c in changes.values()]).distinct()
    live = touched.join(gone, "sku_id", "left_anti")
    out = [gone.select(F.lit(0).alias("change_group"), F.lit("skus").alias("table"), F.lit("delete").alias("op"),
                       "sku_id", F.lit("").alias("part"))]
    for name in new:
        part = F.concat_ws("|", *keys[name][1:]) if len(keys[name]) > 1 else F.lit("")
        if name != "skus":
            lost = changes[name].filter("op = 'delete'").join(gone, "sku_id", "left_anti")
            out.append(lost.select(F.lit(1).alias("change_group"), F.lit(name).alias("table"),
                                   F.lit("delete").alias("op"), "sku_id", part.alias("part")))
        out.append(new[name].join(live, "sku_id", "left_semi").select(
            F.lit(2).alias("change_group"), F.lit(name).alias("table"), F.lit("upsert").alias("op"), "sku_id",
            part.alias("part")))
    return reduce(DataFrame.unionByName, out)


STAR_TABLES = ("skus", "resource_attrs", "terms", "prices", "health")


def star_delta(old: DataFrame, new: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Changes between two snapshots of nested rows as ordered records on the star tables, with their rows.

    Records: (change_group, table, op, sku_id, part, and one struct per star table that is null but for the row of an
    upsert). Groups: 0 deletes of items (from all tables), 1 deletes of price keys and health rows of items that live on,
    2 upserts of all rows of new and changed items, 3 the metadata (key, value) of the new snapshot, which replaces the
    old. One full outer join on sku_id finds them all; prices of an item are compared without regard to order. `sku_id`
    must be unique in a snapshot, and (dimension, tier) within an item.
    """
    def side(rows: DataFrame, name: str) -> DataFrame:
        terms, tidy = empty_to_null_terms(F.col("terms")), F.array_sort(F.transform("prices", lambda p: F.struct(
            p["dimension"].alias("dimension"), F.coalesce(p["tier"], F.lit("")).alias("tier"),
            F.coalesce(p["tier_upper"], F.lit("")).alias("tier_upper"), p["amount"].alias("amount"), p["unit"].alias("unit"))))
        parts = F.struct(F.struct(*SKU_COLUMNS).alias("skus"), "resource_attrs", terms.alias("terms"),
                         F.coalesce(tidy, F.array().cast(ROW["prices"].dataType)).alias("prices"), "health")
        return rows.select(F.col("sku_id").alias(f"{name}_id"), parts.alias(name))

    both = side(old, "_old").join(side(new, "_new"), F.col("_old_id") == F.col("_new_id"), "full_outer")
    both = both.filter(~F.col("_old").eqNullSafe(F.col("_new"))).select(
        F.coalesce("_new_id", "_old_id").alias("sku_id"), "_old", "_new")

    def record(group: int, table: str, op: str, part: Column, row: Column | None = None) -> Column:
        rows = [(row if name == table and row is not None else F.lit(None)).cast(_ROW_TYPES[name]).alias(name)
                for name in (*STAR_TABLES, "metadata")]
        return F.struct(F.lit(group).alias("change_group"), F.lit(table).alias("table"), F.lit(op).alias("op"),
                        part.alias("part"), *rows)

    none, nothing = F.lit(""), F.array().cast(f"array<{_record_type()}>")

    def price_key(p: Column) -> Column:
        return F.concat_ws("|", p["dimension"], p["tier"])

    def one(name: str) -> Column:
        return F.when(F.col(f"_new.{name}").isNotNull(), F.array(record(2, name, "upsert", none, F.col(f"_new.{name}"))))
    kept = F.transform(F.col("_new.prices"), price_key)
    lost = F.filter(F.col("_old.prices"), lambda p: ~F.array_contains(kept, price_key(p)))
    lost_health = F.col("_old.health").isNotNull() & F.col("_new.health").isNull()
    live = F.concat(
        F.coalesce(F.transform(lost, lambda p: record(1, "prices", "delete", price_key(p))), nothing),
        F.when(lost_health, F.array(record(1, "health", "delete", none))).otherwise(nothing),
        *(F.coalesce(one(name), nothing) for name in ("skus", "resource_attrs", "terms", "health")),
        F.transform(F.col("_new.prices"), lambda p: record(2, "prices", "upsert", price_key(p), p)))
    records = F.when(F.col("_new").isNull(), F.array(record(0, "skus", "delete", none))).otherwise(live)
    out = both.select("sku_id", records.alias("records")).select("sku_id", F.explode("records").alias("r"))
    if metadata is not None:
        pairs = F.struct(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
        out = out.unionByName(metadata.select(F.lit(None).cast("string").alias("sku_id"), record(
            3, "metadata", "upsert", F.col("key").cast("string"), pairs).alias("r")))
    order = ("table", "op", "part", *STAR_TABLES, "metadata")
    return out.select("r.change_group", *(f"r.{c}" for c in order[:2]), "sku_id", *(f"r.{c}" for c in order[2:]))


_ROW_TYPES = {"skus": "struct<" + ", ".join(f"{c}: string" for c in SKU_COLUMNS) + ">",
              "resource_attrs": ROW["resource_attrs"].dataType.simpleString(), "terms": ROW["terms"].dataType.simpleString(),
              "prices": ROW["prices"].dataType.elementType.simpleString(), "health": ROW["health"].dataType.simpleString(),
              "metadata": "struct<key: string, value: string>"}


def _record_type() -> str:
    fields = ["change_group: int", "table: string", "op: string", "part: string"]
    return "struct<" + ", ".join(fields + [f"{name}: {kind}" for name, kind in _ROW_TYPES.items()]) + ">"


def is_noop(delta: DataFrame) -> bool:
    """Whether a star delta changes nothing but the metadata."""
    return delta.filter("change_group < 3").isEmpty()


def apply_star_delta(star: dict[str, DataFrame], delta: DataFrame) -> dict[str, DataFrame]:
    """The star tables after a delta. All rows of a touched item go, then its upserts come; metadata is replaced.

    Only the touched items travel to the tables, one anti join each. The delta is computed once: its records cross one exchange by sku_id, which
    all tables read.
    """
    # as outputs of a generator all columns stay in the exchange, whichever of them a table takes
    rest = F.array(F.struct(*(c for c in delta.columns if c != "sku_id")))
    delta = delta.select("sku_id", rest.alias("_rest")).repartition("sku_id").select("sku_id", F.inline("_rest"))
    touched = delta.filter("change_group < 3").select("sku_id").distinct()

    def upserts(name: str) -> DataFrame:
        return delta.filter((F.col("table") == name) & (F.col("op") == "upsert"))
    out = {}
    for name in (t for t in STAR_TABLES if t in star):
        rows = upserts(name).select("sku_id", *(F.col(f"{name}.{c}") for c in star[name].columns if c != "sku_id"))
        out[name] = star[name].join(touched, "sku_id", "left_anti").unionByName(rows)
    return out | {"metadata": upserts("metadata").select("metadata.*")}


def update_plan(manifest: DataFrame, local: DataFrame, channel: str = "daily", max_chain: int | None = None) -> DataFrame:
    """What to do per shard: baseline, deltas, nothing, or an unsupported layout.

    manifest(shard, baseline_version, head_version, shard_schema_version, deltas array<struct<from, to>>),
    local(shard, local_version).
    """
    joined = manifest.join(local, "shard", "left")
    chain = F.filter("deltas", lambda d: d["from"] >= F.col("local_version"))
    joined = joined.withColumn("chain", chain)
    starts = F.get("chain", F.lit(0))["from"] == F.col("local_version")
    local_version = F.coalesce("local_version", F.lit(""))
    action = first_case([
        (F.col("shard_schema_version") > MAX_SCHEMA_VERSION, "schema_too_new"),
        (F.col("shard_schema_version") < MIN_SCHEMA_VERSION, "schema_too_old"),
        (F.lit(channel == "stable") | (local_version == "") | (local_version < F.col("baseline_version")), "baseline"),
        (F.size("chain") == 0, "none"),
        (~starts | (F.size("chain") > max_chain if max_chain is not None else F.lit(False)), "baseline_after_bad_chain"),
    ], "deltas")
    out = joined.withColumn("action", action)
    return out.select("shard", "local_version", "action", first_case([
        (F.col("action").isin("baseline", "baseline_after_bad_chain"), F.col("baseline_version")),
        (F.col("action") == "deltas", F.col("head_version"))], F.col("local_version")).alias("target_version"),
        F.when(F.col("action") == "deltas", F.size("chain")).otherwise(0).alias("n_deltas"))


def next_manifest(previous: DataFrame, sidecars: DataFrame, min_client: str, schema_version: int = 1) -> DataFrame:
    """Release manifest: today's shards from their sidecars, the others carried forward.

    sidecars(shard, has_baseline, delta_from, delta_to, row_count, baseline_size). A run without a baseline needs a
    previous entry and a delta to chain.
    """
    p = previous.select("shard", F.struct(*[c for c in previous.columns if c != "shard"]).alias("p"))
    s = sidecars.select("shard", F.struct(*[c for c in sidecars.columns if c != "shard"]).alias("s"))
    both = p.join(s, "shard", "full_outer")
    orphan = F.col("s").isNotNull() & ~F.col("s.has_baseline") & (
        F.col("p").isNull() | F.col("s.delta_from").isNull())
    both = both.filter(F.when(orphan, F.raise_error(F.concat(
        F.col("shard"), F.lit(": delta without baseline or start"))).cast("boolean")).otherwise(F.lit(True)))
    today, fresh = F.col("s").isNotNull(), F.col("s").isNotNull() & F.col("s.has_baseline")
    step = F.struct(F.col("s.delta_from").alias("from"), F.col("s.delta_to").alias("to"))
    deltas = F.when(fresh, F.slice(F.array(step), 1, 0)).when(
        today, F.array_append(F.coalesce("p.deltas", F.slice(F.array(step), 1, 0)), step)).otherwise(F.col("p.deltas"))

    def pick(new: Column, old: str) -> Column:
        return F.when(today, new).otherwise(F.col(f"p.{old}"))
    return both.select(
        "shard", F.when(fresh, F.col("s.delta_to")).otherwise(F.col("p.baseline_version")).alias("baseline_version"),
        F.when(fresh, F.col("s.baseline_size")).otherwise(F.col("p.baseline_size")).alias("baseline_size"),
        pick(F.col("s.delta_to"), "head_version").alias("head_version"),
        pick(F.lit(min_client), "min_client").alias("min_client"),
        pick(F.lit(schema_version), "shard_schema_version").alias("shard_schema_version"),
        deltas.alias("deltas"), pick(F.col("s.row_count"), "row_count").alias("row_count"),
        pick(F.col("s.delta_to"), "last_updated").alias("last_updated"))


def changed_shards(requested: DataFrame, indicators: DataFrame, previous: DataFrame, rebuild: bool = False) -> DataFrame:
    """(shard, indicator, status): changed, unchanged or error (requested but no indicator was read)."""
    prior = previous.select("shard", F.col("indicator").alias("previous_indicator"))
    empty = previous.select(F.count(F.lit(1)).alias("n")).scalar() == 0
    status = first_case([
        (F.col("indicator").isNull(), "error"),
        (F.lit(rebuild) | empty, "changed"),
        (~F.col("indicator").eqNullSafe(F.col("previous_indicator")), "changed"),
    ], "unchanged")
    return (requested.select("shard").distinct().join(indicators, "shard", "left").join(prior, "shard", "left")
            .withColumn("status", status).select("shard", "indicator", "status"))


def merge_indicators(states: DataFrame) -> DataFrame:
    """Newest indicator per shard over several state files: states(shard, indicator, written_at, source)."""
    return states.groupBy("shard").agg(F.max_by("indicator", F.struct("written_at", "source")).alias("indicator"))


def fingerprint(items: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Order-free fingerprint of the items per group: SHA-256 of the count and of four sums of 28-bit slices of each
    item's MD5.

    An item is the text of its columns, each with its length before it, null as '-'. Sums are a multiset hash: repeated
    items count, order and partitioning don't. It aggregates on the map side, so no group is ever gathered or sorted.
    """
    text = [F.col(c).cast("string") for c in columns]
    item = F.md5(F.concat(*(F.coalesce(F.concat(F.char_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)))
    slices = [F.sum(F.conv(F.substring(item, 1 + 7 * i, 7), 16, 10).cast("bigint")) for i in range(4)]
    return items.groupBy(*by).agg(F.sha2(F.concat_ws(
        ":", *(n.cast("string") for n in (F.count(F.lit(1)), *slices))), 256).alias("fingerprint"))


def catalog_status(shards: DataFrame, installed: DataFrame, now: Column) -> DataFrame:
    """Every known shard with whether it is installed, its version and its age in whole days."""
    return (shards.join(installed, "shard", "left")
            .select("shard", F.col("catalog_version").isNotNull().alias("installed"), "catalog_version",
                    age_days("generated_at", now).alias("age_days")))


def age_days(generated_at: Column | str, now: Column) -> Column:
    """Whole days since an RFC 3339 time; unreadable or future is 0."""
    text = F.col(generated_at) if isinstance(generated_at, str) else generated_at
    seconds = F.unix_micros(now) - F.unix_micros(F.try_to_timestamp(text))
    return F.coalesce(F.greatest(F.lit(0), F.floor(seconds / F.lit(86_400_000_000)).cast("bigint")), F.lit(0))


def staleness(age: Column, warn_days: int = 0, error_days: int = 0, allow: bool = False) -> Column:
    """ok, warn or error by age; a threshold of 0 is off and `allow` switches the error off."""
    return first_case([
        (F.lit(error_days > 0 and not allow) & (age >= error_days), "error"),
        (F.lit(warn_days > 0) & (age >= warn_days), "warn")], "ok")


def serving_providers(value: Column) -> Column:
    """Provider list stored as a JSON array or a comma list; absent is empty."""
    text = F.trim(F.coalesce(value, F.lit("")))
    listed = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(text.startswith("["), F.from_json(text, "array<string>", {"mode": "FAILFAST"})).otherwise(listed)
