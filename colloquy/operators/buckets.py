"""Tables cut into buckets by a key, so that a write to some keys rewrites the files of their buckets alone.

A bucket is a partition of the table: the key's hash modulo their number. A change reads the buckets of the
keys it is given, applies a pure function from rows to rows (those of ``versions``), and overwrites these
partitions; files of other buckets stay as they are. The changed rows are written to the shared folder
first, so that nothing is overwritten while it is still read; a change that is cut off can be made again if
the function gives the same for rows changed before (revoking does). One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import token_hash
from ..sources.shared import setting, written
from . import versions

BUCKET, COUNT, PLACE = "bucket", "colloquy.buckets", "colloquy.place"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def create(rows: DataFrame, name: str, key: str, buckets: int = 64, path: str | None = None) -> None:
    """A new table of these rows."""
    out = rows.withColumn(BUCKET, bucket_of(key, buckets)).repartition(buckets, BUCKET).write.partitionBy(BUCKET).format("parquet")
    (out.option("path", path) if path else out).saveAsTable(name)
    # the key by its place, as Spark hides properties that name tokens
    rows.sparkSession.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{COUNT}' = '{buckets}', '{PLACE}' = '{rows.columns.index(key)}')")


def key_and_count(spark: SparkSession, name: str) -> tuple[str, int]:
    stored = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    return spark.table(name).columns[int(stored[PLACE])], int(stored[COUNT])


def rows_of(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name).drop(BUCKET)


def changed(spark: SparkSession, name: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[int]:
    """Applies a change that concerns these keys (a column named as the table's key), new ones included; returns the buckets that were rewritten."""
    key, buckets = key_and_count(spark, name)
    own = bucket_of(key, buckets)
    hit = sorted(r[0] for r in keys.select(own.alias(BUCKET)).distinct().collect())  # as many as there are buckets at most
    if not hit:
        return []
    table = spark.table(name)
    before = table.where(F.col(BUCKET).isin(hit)).drop(BUCKET)
    after = written(change(before).select(before.columns).withColumn(BUCKET, own), "buckets")
    if not after.where(~F.col(BUCKET).isin(hit)).isEmpty():
        raise ValueError(f"{name}: the change gave rows of keys that it was not given")
    filled = {r[0] for r in after.select(BUCKET).distinct().collect()}
    # sorted by bucket, each task has its own: one file a bucket
    with setting(spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
        after.select(table.columns).repartition(len(hit), BUCKET).write.insertInto(name, overwrite=True)
    for bucket in hit:
        if bucket not in filled:
            spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({BUCKET} = {bucket}) PURGE")
    return hit


def revoke(spark: SparkSession, name: str, presented: DataFrame, as_of: Column) -> list[int]:
    """``versions.revoked`` in a table of tokens cut by token_hash."""
    return changed(spark, name, presented.select("token_hash"), lambda rows: versions.revoked(rows, presented, as_of))


def rotate(spark: SparkSession, name: str, presented: DataFrame, as_of: Column, days: int) -> list[int]:
    """``versions.rotated``: buckets of the tokens presented and of the new ones."""
    keys = presented.select("token_hash").unionAll(presented.select(token_hash(F.col("new_token"))))
    return changed(spark, name, keys, lambda rows: versions.rotated(rows, presented, as_of, days))


def put(spark: SparkSession, name: str, rows: DataFrame) -> list[int]:
    """Inserts rows, in place of those that have their keys."""
    key, _ = key_and_count(spark, name)
    return changed(spark, name, rows.select(key), lambda old: old.join(rows.select(key), key, "left_anti").unionByName(rows))


def delete(spark: SparkSession, name: str, keys: DataFrame) -> list[int]:
    key, _ = key_and_count(spark, name)
    return changed(spark, name, keys, lambda old: old.join(keys.select(key), key, "left_anti"))
