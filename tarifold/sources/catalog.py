"""Reading and writing catalogs: normalized JSON lines, versioned nested Parquet and star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tarifold import schemas as S
from tarifold.operators.rows import split_star


def read_rows_json(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Normalized rows from JSON lines. The free-form extra object is kept as text; blank lines are skipped.

    A line that doesn't parse, or has a field of another type, fails the read."""
    return spark.read.schema(S.ROW_DDL).json(paths, mode="FAILFAST")


def write_rows_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_catalog(rows: DataFrame, root: str, version: str) -> None:
    """Write one catalog version, partitioned for pruning and sorted for row-group statistics, then move the head.

    A version directory is complete before the head names it, so a failed job leaves readers on the old version.
    """
    (rows.repartition("kind", "provider", "service", F.pmod(F.xxhash64("sku_id"), F.lit(64)))
     .sortWithinPartitions("kind", "provider", "service", "resource_name", "region")
     .write.mode("overwrite").partitionBy("kind", "provider", "service").parquet(f"{root}/version={version}"))
    rows.sparkSession.sql(f"SELECT '{version}' AS version").coalesce(1).write.mode("overwrite").json(f"{root}/_head")


def head_version(spark: SparkSession, root: str) -> str:
    return spark.read.schema("version string").json(f"{root}/_head").first()["version"]


def read_catalog(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """Rows of one version, by default the head. Filters on kind, provider and service prune directories."""
    version = version or head_version(spark, root)
    out = spark.read.parquet(f"{root}/version={version}")
    return out.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in S.ROW))


def write_star(rows: DataFrame, metadata: DataFrame, root: str) -> None:
    """Write the star tables and the key/value metadata."""
    for name, table in split_star(rows).items():
        table.write.mode("overwrite").parquet(f"{root}/{name}")
    metadata.write.mode("overwrite").parquet(f"{root}/metadata")


def read_star(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Star tables behind the layout-version gate: a missing or unsupported schema_version is an error."""
    found = spark.read.parquet(f"{root}/metadata").filter("key = 'schema_version'").select("value").head(1)
    version = found[0]["value"] if found else None
    if version is None:
        raise ValueError(f"{root} has no schema_version")
    if not str(version).isdigit() or not S.MIN_SCHEMA_VERSION <= int(version) <= S.MAX_SCHEMA_VERSION:
        raise ValueError(f"schema_version {version} outside [{S.MIN_SCHEMA_VERSION},{S.MAX_SCHEMA_VERSION}]")
    return {name: spark.read.parquet(f"{root}/{name}")
            for name in ("skus", "resource_attrs", "terms", "prices", "health")}
