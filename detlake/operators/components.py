"""Connected components by alternating large-star and small-star steps; the smallest vertex names its component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detlake.session import cut

MAX_ROUNDS = 100


def _smaller(edges: DataFrame) -> DataFrame:
    both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
    least = both.groupBy("u").agg(F.min("v").alias("w")).withColumn("w", F.least("u", "w"))
    return both.join(least, "u")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(vertex, root) of every vertex that has an edge; nulls and loops are ignored.

    A step hangs larger (or not larger) neighbours of a vertex on its smallest neighbour. When nothing changes, each
    component is a star around its smallest vertex.
    """
    live = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    live = cut(live.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    tidy = lambda df: df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    many = live.count()
    for _ in range(MAX_ROUNDS):
        large = tidy(_smaller(live).where("v > u").select(F.col("v").alias("u"), F.col("w").alias("v")))
        # small star: a vertex and its smaller neighbours hang on the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("w"))
        joined = large.join(least, "u")
        small = cut(tidy(joined.select(F.col("v").alias("u"), F.col("w").alias("v")).unionByName(joined.select("u", F.col("w").alias("v")))))
        now = small.count()
        settled = now == many and small.join(live, ["u", "v"], "left_anti").isEmpty()
        live, many = small, now
        if settled:
            break
    else:
        raise RuntimeError("components did not settle")
    leaves = live.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    return leaves.unionByName(live.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())
