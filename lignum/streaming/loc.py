"""Line counts of files as they arrive in a folder of Parquet tables (path, size_bytes, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import loc

SCHEMA = "path string, size_bytes bigint, content binary"


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(folder)


def count_into(files: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append the counts of each new file; sums are a batch query over `out`, so the stream holds no state."""
    writer = loc.with_counts(files).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
