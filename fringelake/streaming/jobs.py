"""Job events as a stream: the same folds as the batch operators, kept as streaming state."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter


def last_status(events: DataFrame, key: str) -> DataFrame:
    """Newest (status, event_id) of each key; output mode update or complete."""
    at = F.struct(F.col("ts").cast("timestamp"), F.col("event_id"))
    m = F.max_by(F.struct("status", "event_id"), at).alias("m")
    return events.groupBy(key).agg(m).select(key, "m.status", "m.event_id")


def merged(*streams: DataFrame) -> DataFrame:
    """Streams of one schema as one, in order of arrival."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out


def progress_sink(progress: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Appends (engine, iter, error) rows to a Parquet folder, each once."""
    return progress.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
