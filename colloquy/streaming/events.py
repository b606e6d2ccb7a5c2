"""Sink of event streams: every micro-batch is a folder of its own number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def write_events(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """events(conv_id, seq, event, data) to Parquet, complete-or-nothing a batch; a batch that is repeated replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
