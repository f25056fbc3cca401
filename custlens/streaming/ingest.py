"""Continuous keyed ingest: L4 (insert-or-ignore) as a Structured Streaming job.

The reference loads its tables with ``INSERT OR IGNORE``; the streaming
form applies the same rule to every micro-batch of new files.  The target is a
``sources.loads.LoadedTable``: a micro-batch is one load, joined only with loads whose keys it can meet and
committed in one step.  ``foreachBatch`` is at-least-once; a replayed batch finds its id
in the manifest, one that died before its commit is simply done again.

No other streaming operators exist in the reference (it is batch only).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.loads import open_table
from ..sources.schemas import CSV_OPTIONS, TABLE_SCHEMAS


def keyed_ingest(spark: SparkSession, source_path: str, table: str, target_path: str,
                 checkpoint_location: str, source_format: str = "parquet", available_now: bool = True,
                 max_files_per_trigger: int | None = None, buckets: int = 64):
    """Start a stream that adds new ``table`` rows from ``source_path`` to
    the table at ``target_path`` (``open_table(...).read()``) with insert-or-ignore semantics.
    Returns the ``StreamingQuery``."""
    name = checkpoint_location.rstrip("/").rsplit("/", 1)[-1]  # ids of batches are told apart by their stream
    reader = spark.readStream.schema(TABLE_SCHEMAS[table]).format(source_format)
    if source_format == "csv":
        reader = reader.options(**CSV_OPTIONS, enforceSchema="false")  # a header in another order is an error
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(source_path)

    def apply(batch: DataFrame, epoch_id: int) -> None:
        with open_table(batch.sparkSession, target_path, table, buckets) as target:
            target.insert_or_ignore(batch, f"{name}-{epoch_id}")

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
