"""Current status of every ticket from a stream of its events (L4).

The fold of ``ops.current_status`` runs as a stateful stream aggregation in
update mode: each micro-batch gives the tickets whose events it brought, with
their state so far.  Those rows are written by batch id, so a replayed batch
overwrites its own, and the last row of a ticket is its current status.  State
is one row a ticket, kept by the stream's state store in the shared checkpoint
folder; events may come late or out of order, since the latest one by
(created_at, event_id) wins.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ops
from ..session import ensure_checkpoint_dir, path_exists

SCHEMA = "event_id long, ticket_id long, status string, message string, created_at timestamp_ntz"
STATES = "ticket_id long, current_status string, n_events long, batch_id long"


def start_status(spark: SparkSession, events_dir: str, out_dir: str, checkpoint: str | None = None,
                 max_files_per_trigger: int | None = None, available_now: bool = True):
    """Start the stream over a folder of event files; returns the StreamingQuery."""
    reader = spark.readStream.schema(SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    states = ops.current_status(reader.parquet(events_dir))

    def process(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    w = states.writeStream.outputMode("update").foreachBatch(process).option(
        "checkpointLocation", checkpoint or f"{ensure_checkpoint_dir(spark)}/status-{uuid.uuid4().hex}")
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()


def read_status(spark: SparkSession, out_dir: str) -> DataFrame:
    """ticket_id, current_status, n_events: each ticket's row of the last batch that had it."""
    if not path_exists(spark, f"{out_dir}/batch_id=*"):
        return spark.createDataFrame([], STATES).drop("batch_id")
    rows = spark.read.option("basePath", out_dir).schema(STATES).parquet(out_dir)
    last = F.row_number().over(Window.partitionBy("ticket_id").orderBy(F.desc("batch_id")))
    return rows.withColumn("_n", last).where("_n = 1").select("ticket_id", "current_status", "n_events")


def run_status(spark: SparkSession, events_dir: str, out_dir: str, **options) -> DataFrame:
    """Run the stream over what is there and return the statuses."""
    query = start_status(spark, events_dir, out_dir, **options)
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return read_status(spark, out_dir)
