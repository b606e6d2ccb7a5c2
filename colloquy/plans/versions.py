"""Schema versions (see ``ledger``), and tables that swap in together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ledger import downgrade, upgrade

__all__ = ["committed", "commits", "downgrade", "read_version", "upgrade", "write_versions"]


def write_versions(tables: dict[str, DataFrame], folder: str) -> int:
    """Writes new versions of some tables, all or none: readers see them by one small commit row, written last."""
    spark = next(iter(tables.values())).sparkSession
    number = committed(spark, folder) + 1
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{name}/{number}")
    row = spark.range(1).select(F.lit(number).alias("number"), F.lit(",".join(sorted(tables))).alias("tables"))
    row.coalesce(1).write.mode("append").parquet(f"{folder}/commits")
    return number


def commits(spark: SparkSession, folder: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/commits")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "number int, tables string")
    return spark.read.schema("number int, tables string").parquet(f"{folder}/commits")


def committed(spark: SparkSession, folder: str) -> int:
    return commits(spark, folder).agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]


def read_version(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The last committed version of a table."""
    last = commits(spark, folder).where(F.array_contains(F.split("tables", ","), name)).agg(F.max("number")).first()[0]
    return spark.read.parquet(f"{folder}/{name}/{last}")
