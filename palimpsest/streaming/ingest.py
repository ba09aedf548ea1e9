"""Streaming ingest: micro-batches become arrays; the event log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from palimpsest.store import Store


def ingest(rows: DataFrame, store: Store, collection: str, checkpoint: str, order: str | None = None, once: bool = True) -> StreamingQuery:
    """Write a stream of rows (dims, op, value, n, uts) to a collection, one array a micro-batch.

    Restarting from ``checkpoint`` writes a batch again only if it had failed;
    equal writes of one batch leave every read as it was, but for counter ADDs.
    """

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.write(collection, batch, order)

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_log(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Rows to write as they arrive in a folder of Parquet files; ``max_files`` a batch holds the rate."""
    from palimpsest.schema import WRITES

    return spark.readStream.schema(WRITES).option("maxFilesPerTrigger", max_files).parquet(folder)
