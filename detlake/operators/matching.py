"""One-to-one matching of boxes: candidate edges by an equi-join, then a greedy fold per group.

The fold accepts an edge if neither of its ends is taken, in one total order. It runs as an ``aggregate`` over the sorted
edges of a group, so nothing leaves the JVM. Groups are one image and class (one image for pairs of unequal classes); their
size is that of an image's boxes and does not grow with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detlake.functions import geometry as g


def greedy(edges: DataFrame, group: list[str], order: list[Column], left: str, right: str, keep: list[str]) -> DataFrame:
    """Accepted edges: group columns, left, right and the columns to keep.

    ``order`` is the total order as ascending columns; left and right end it, so ties don't depend on partitioning.
    """
    rank = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), F.col(left).alias("l"), F.col(right).alias("r"), F.struct(*keep).alias("k") if keep else F.lit(0).alias("k"))
    sorted_edges = edges.groupBy(*group).agg(F.sort_array(F.collect_list(rank)).alias("_e"))
    sized = sorted_edges.withColumn("_e", F.transform("_e", lambda e: F.struct(e["l"].alias("l"), e["r"].alias("r"), e["k"].alias("k"))))
    empty = F.slice("_e", 1, 0)
    folded = F.aggregate("_e", empty, lambda done, e: F.when(F.exists(done, lambda d: (d["l"] == e["l"]) | (d["r"] == e["r"])), done).otherwise(F.concat(done, F.array(e))))
    taken = sized.select(*group, F.explode(folded).alias("_m"))
    return taken.select(*group, F.col("_m.l").alias(left), F.col("_m.r").alias(right), *(F.col(f"_m.k.{k}").alias(k) for k in keep))


def _sides(gt: DataFrame, pred: DataFrame) -> tuple[DataFrame, DataFrame]:
    p = pred.select("image_id", "pi", F.col("class_id").alias("pc"), "confidence", *(F.col(c).alias(f"p{c}") for c in ("x1", "y1", "x2", "y2")))
    t = gt.select(F.col("image_id").alias("_image"), "gi", F.col("class_id").alias("gc"), *(F.col(c).alias(f"g{c}") for c in ("x1", "y1", "x2", "y2")))
    return p, t


def candidate_edges(gt: DataFrame, pred: DataFrame, same_class: bool | None = True) -> DataFrame:
    """Pairs of one image with their overlap: of the same class (equi-join), of unequal ones, or all (None)."""
    p, t = _sides(gt, pred)
    on = F.col("image_id") == F.col("_image")
    joined = p.join(t, on & (F.col("pc") == F.col("gc")) if same_class else on)
    joined = joined.where(F.col("pc") != F.col("gc")) if same_class is False else joined
    return joined.drop("_image").withColumn("overlap", g.iou(g.box("p"), g.box("g")))


def match(gt: DataFrame, pred: DataFrame, min_overlap: float = 0.5) -> DataFrame:
    """(image_id, class_id, pi, gi, overlap, confidence) of the greedy class-aware matcher.

    Predictions come by falling confidence and then box and index, each takes the free ground truth of its class with
    the greatest overlap of at least ``min_overlap``, ties by box and index. Since sorting all edges by (prediction,
    -overlap, ground truth) visits them in just that order, one fold gives the same result.
    """
    edges = candidate_edges(gt, pred).where(F.col("overlap") >= F.lit(float(min_overlap))).withColumnRenamed("pc", "class_id")
    order = [-F.col("confidence"), *g.box("p"), F.col("pi"), -F.col("overlap"), *g.box("g"), F.col("gi")]
    return greedy(edges, ["image_id", "class_id"], order, "pi", "gi", ["overlap", "confidence"])


def residual_pairs(gt: DataFrame, pred: DataFrame, low: float, high: float | None, same_class: bool) -> DataFrame:
    """(image_id, pi, gi, overlap, confidence, pc, gc): greedy pairing of what is left, overlap in [low, high)."""
    edges = candidate_edges(gt, pred, same_class).where(F.col("overlap") >= F.lit(float(low)))
    if high is not None:
        edges = edges.where(F.col("overlap") < F.lit(float(high)))
    order = [-F.col("overlap"), -F.col("confidence"), F.col("pc"), *g.box("p"), F.col("gc"), *g.box("g"), F.col("pi"), F.col("gi")]
    return greedy(edges, ["image_id"], order, "pi", "gi", ["overlap", "confidence", "pc", "gc"])


def unmatched(rows: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    return rows.join(matches.select("image_id", key), ["image_id", key], "left_anti")


def suppress(pred: DataFrame, max_overlap: float = 0.5) -> DataFrame:
    """Greedy non-maximum suppression per image and class (an extension): kept predictions, by falling confidence."""
    b = F.struct((-F.col("confidence")).alias("c"), *(F.col(c) for c in ("x1", "y1", "x2", "y2")), F.col("pi").alias("pi"))
    rows = pred.groupBy("image_id", "class_id").agg(F.sort_array(F.collect_list(b)).alias("_b"))
    f = lambda z: (z["x1"], z["y1"], z["x2"], z["y2"])
    kept = F.aggregate("_b", F.slice("_b", 1, 0), lambda done, e: F.when(F.exists(done, lambda d: g.iou(f(d), f(e)) > max_overlap), done).otherwise(F.concat(done, F.array(e))))
    return rows.select("image_id", "class_id", F.explode(kept).alias("k")).select("image_id", "class_id", F.col("k.pi").alias("pi"), (-F.col("k.c")).alias("confidence"))
