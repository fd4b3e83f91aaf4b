"""Streams over a catalog: applying a stream of changes version by version, and answering a stream of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from tarifold.operators.lookup import lookup_exact
from tarifold.operators.versions import apply_changes
from tarifold.sources.catalog import head_version, read_catalog, write_catalog


def apply_change_stream(changes: DataFrame, root: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Apply a stream of (seq, op, sku_id, row) to the catalog under `root`, one new version per micro-batch.

    The last change of an item within a batch wins. A version is named after its batch, so a batch that is run again
    after a failure rewrites the same version from the same parent and the result is unchanged.
    """
    spark = changes.sparkSession
    origin = head_version(spark, root).split("+")[0]

    def step(batch: DataFrame, batch_id: int) -> None:
        parent = origin if batch_id == 0 else f"{origin}+{batch_id - 1:06d}"
        last = batch.groupBy("sku_id").agg(F.max_by(F.struct("op", "row"), "seq").alias("c")).select("sku_id", "c.*")
        write_catalog(apply_changes(read_catalog(spark, root, parent), last, ["sku_id"]), root,
                      f"{origin}+{batch_id:06d}")

    writer = changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def answer_request_stream(requests: DataFrame, rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Stream-static join of lookup requests to the catalog; it keeps no state."""
    return lookup_exact(rows, requests, keys)
