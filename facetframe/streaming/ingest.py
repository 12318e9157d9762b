"""Incremental reading of new files with Structured Streaming: the batch parser over a stream of binary files, results landed as Parquet."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import parse_files


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(source)
    return parse_files(files).writeStream.format("parquet").option("checkpointLocation", checkpoint).partitionBy("kind").trigger(availableNow=True).start(target)
