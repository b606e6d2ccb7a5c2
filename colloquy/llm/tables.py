"""Reading inputs and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. One of our own only where none is set and all runs on this machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='colloquy-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(frame: DataFrame, what: str) -> DataFrame:
    """The frame, written to the shared folder and read again, so that what follows does not repeat its work."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


#: Bits of the bitmaps of ``may_be_among``, 4 MB in all, and of one row of them (as Spark's functions have them).
SLOTS, ROW = 1 << 25, 1 << 15


def may_be_among(frame: DataFrame, key: str, found: DataFrame, name: str) -> DataFrame:
    """The frame with a boolean ``name``: false only where the hash ``key`` is not among those of ``found``.

    Bitmaps of a fixed size are broadcast, so that rows without a partner need no shuffle; a join must follow, as some of those marked true have none.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS))
    bits = found.select(slot.alias("__among_slot")).distinct().select(F.shiftright("__among_slot", 15).alias("__among_row"), F.col("__among_slot").bitwiseAND(ROW - 1).alias("__among_bit"))
    bits = bits.repartition("__among_row").groupBy("__among_row").agg(F.bitmap_construct_agg("__among_bit").alias("__among_bits"))  # dealt first: partial bitmaps would be larger than the hashes
    rows = frame.withColumn("__among_slot", slot).withColumn("__among_row", F.shiftright("__among_slot", 15)).join(F.broadcast(bits), "__among_row", "left")
    byte = F.conv(F.hex(F.substring("__among_bits", F.shiftright(F.col("__among_slot").bitwiseAND(ROW - 1), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftright(__among_byte, cast(__among_slot & 7 as int)) & 1")
    return rows.withColumn("__among_byte", byte).withColumn(name, F.coalesce(bit == 1, F.lit(False))).select(*frame.columns, name)


def numbered(frame: DataFrame, order: list[str], what: str) -> DataFrame:
    """The rows with their place in this order (``number``, from 0), sorted by ranges and written; no task sees them all."""
    rows = frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    rows = written(rows, what).withColumn("__part", F.shiftright("__at", 33))
    parts = rows.groupBy("__part").agg(F.count("*").alias("__n"))  # one row a range
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(F.broadcast(parts.select("__part", before.alias("__before"))), "__part")
    return rows.withColumn("number", F.col("__at") - F.shiftleft("__part", 33) + F.col("__before")).select(*frame.columns, "number")
