"""Reading tables, and whether the engine answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def engine_session(app: str = "colloquy", **conf: str) -> SparkSession:
    """A session with the settings that results depend on."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def is_ready(spark: SparkSession) -> bool:
    """Whether the engine answers a trivial query."""
    try:
        return spark.sql("SELECT 1 AS one").first()["one"] == 1
    except Exception:  # whatever the reason, it is not ready
        return False


def readiness(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT 1 AS one").select((F.col("one") == 1).alias("database_ready"), F.when(F.col("one") == 1, "ready").otherwise("degraded").alias("status"))
