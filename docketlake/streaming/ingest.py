"""Streams that append to tables: new files, log rows and sign-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from docketlake.operators.analytics import log_row
from docketlake.sources.corpus import append_new


def append_stream(stream: DataFrame, path: str, key: str, checkpoint: str, fmt: str = "parquet"):
    """Write every batch, leaving out keys the table already has; a repeated batch adds nothing."""
    return (
        stream.writeStream.foreachBatch(lambda df, _: append_new(df, path, key, fmt))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def ingest_files(spark: SparkSession, source: str, schema: T.StructType, sink: str, key: str, checkpoint: str):
    """New JSON files of a folder into a table, skipping documents that are there already."""
    return append_stream(spark.readStream.schema(schema).json(source), sink, key, checkpoint)


def log_stream(rows: DataFrame, path: str, checkpoint: str):
    """Append log or feedback rows with their texts bounded."""
    return (
        log_row(rows).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
