"""Connected components by alternating large-star and small-star rounds, all of it distributed.

Minima are taken by aggregation with partial sums, so a node of very many neighbours is no burden
for one task; every round is written to the shared folder, so a lost executor costs a round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, label) for each node of an edge between two nodes; label is its component's least node."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    now = written(now, "edges")
    while True:
        # done when each node has one edge down or edges up only: then a component is a star around its least node
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(now.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
        if not ends.where(F.col("down") + F.col("up") > 1).agg(F.count("*")).first()[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(now.select(F.col("v"), F.col("v")).distinct())
        both = now.unionAll(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")  # repeated edges go with the last step of the round
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
