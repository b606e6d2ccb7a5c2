"""Running queries that keep arbitrary state, and reading what they wrote."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import setting, shared_folder

#: The state store that transformWithState needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Groups that keys are dealt to where a state of its own for each is too dear.
SLOTS = 512


def key_text(keys: list[str]) -> Column:
    """The keys of a row as one text."""
    return F.to_json(F.struct(*keys))


def keys_of(frame: DataFrame, keys: list[str], text: str) -> list[Column]:
    """The keys, of their types in the frame, of such a text."""
    back = F.from_json(text, T.StructType([T.StructField(c, frame.schema[c].dataType) for c in keys]))
    return [back[c].alias(c) for c in keys]


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """All that the sources have by now, appended to Parquet once each; started again it goes on where it ended."""
    with setting(stream.sparkSession, *PROVIDER):  # a query that runs keeps what it was started with
        query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def replayed(parts: Iterable[DataFrame], made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Tables that arrive one after the other, a file a micro-batch, through a streaming operator: the rows it gave."""
    parts = list(parts)
    spark = parts[0].sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/replay-{uuid.uuid4().hex}"
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = made(stream)
    run_to_end(out, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(out.schema).parquet(f"{folder}/out")
