"""Apply fitted feature steps to a stream: stateless expressions and static joins."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


class Fitted(Protocol):
    def transform(self, df: DataFrame) -> DataFrame: ...


def transform_stream(
    fitted: Fitted, stream: DataFrame, path: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Write the transformed stream to parquet; the checkpoint makes restarts exact."""
    writer = (
        fitted.transform(stream)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
