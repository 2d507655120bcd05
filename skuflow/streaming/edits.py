"""Apply a stream of edits to the versioned tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from skuflow.operators.edits import Changes, apply_edits, edit_changes
from skuflow.session import stage_scope
from skuflow.sources.tables import commit, committed, read_table

TABLES = ["catalogue", "staging", "hierarchy"]
REPORTS = ["summary", "rejects"]


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """Id that a stream keeps for as long as its checkpoint exists."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first().value)["id"]


def stream_edits(
    edits: DataFrame, root: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Run every micro-batch of edits as one batch and commit one snapshot.

    A batch replayed after a failure is recognised by stream id and number and skipped,
    so each edit takes effect once. A new checkpoint is a new stream and applies its
    source from the start. Rejected edits and the summary are part of the snapshot.
    """
    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        txn = f"edits_{_stream_id(spark, checkpoint)}_{number}"
        if committed(spark, root, txn):
            return
        with stage_scope(spark):
            tables = [read_table(spark, root, t) for t in TABLES]
            result = apply_edits(*tables, batch)._asdict()
            commit(spark, root, {t: result[t] for t in TABLES + REPORTS}, txn)

    writer = edits.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stream_changes(
    edits: DataFrame, read: Callable[[SparkSession], tuple[DataFrame, DataFrame]],
    write: Callable[[Changes, str], None], checkpoint: str, trigger: dict | None = None,
) -> StreamingQuery:
    """Run every micro-batch of edits against a store that updates rows in place.

    ``read`` gives the catalogue and the staging table as they are now. ``write`` gets only
    what the batch changes, with a name for the batch: it puts all of it into the store in one
    transaction, and does nothing when it has seen the name, as a batch may come again after a
    failure. Any cut of the stream into batches leaves the same tables.
    """
    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        with stage_scope(spark):
            changes = edit_changes(*read(spark), batch)
            write(changes, f"edits_{_stream_id(spark, checkpoint)}_{number}")

    writer = edits.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
