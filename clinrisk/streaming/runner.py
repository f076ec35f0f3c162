"""Starting streams: file sources, per-batch tables, run-to-completion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_table_stream(spark: SparkSession, directory: str, file_glob: str, schema, max_files: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, oldest first."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    reader = reader.option("maxFilesPerTrigger", max_files) if max_files else reader
    return reader.parquet(directory)


def start_batches(stream: DataFrame, process: Callable[[DataFrame, int], DataFrame], out: str, checkpoint: str,
                  trigger: dict | None = None, reread: bool = False, written: Callable[[int], None] | None = None,
                  mode: str = "append") -> StreamingQuery:
    """Write ``process(batch, id)`` to ``out/batch=<id>``.

    The folder of a batch is overwritten when the batch is replayed after a failure, so each batch counts once. With
    ``reread`` the batch is cached while it is processed, for processes that look at it more than once. ``written(id)`` is
    called after a batch's folder is complete.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist() if reread else batch
        try:
            process(batch, batch_id).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        finally:
            if reread:
                batch.unpersist()
        if written:
            written(batch_id)

    return (stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def start_append(stream: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append the rows to Parquet files; the file sink's own log keeps replays from doubling rows."""
    return (stream.writeStream.format("parquet").outputMode("append").option("path", out)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def finish(query: StreamingQuery) -> StreamingQuery:
    """Wait for an ``availableNow`` run to end; a failure of the stream is raised here."""
    query.awaitTermination()
    return query


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP; a zone-less column is read in the session time zone (use UTC)."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))
