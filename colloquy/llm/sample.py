"""Bounded training samples. Only models are fitted on them; everything else covers all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def bounded_sample(rows: DataFrame, group: str, id_col: str, most: int) -> DataFrame:
    """At most ``most`` ids of each group (columns id_col and group), those of the least keyed hash.

    Two levels of ranking, so that a hot group is not ranked in one task.
    """
    keyed = rows.select(F.col(group).alias(group), F.col(id_col).alias(id_col), F.xxhash64(F.lit(17), F.col(id_col)).alias("_h"))
    keyed = keyed.withColumn("_salt", F.pmod(F.xxhash64(F.lit(18), F.col(id_col)), F.lit(SALTS)))
    for by in ([group, "_salt"], [group]):
        keyed = keyed.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_h", id_col))).where(F.col("_n") <= most)
    return keyed.select(id_col, group)


def fold(id_col: str, folds: int):
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))
