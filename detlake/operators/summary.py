"""Summaries of metric columns and of training histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from detlake.operators import ordered


def metric_summary(rows: DataFrame, metrics: list[str], by: list[str] | None = None, places: int = 4) -> DataFrame:
    """(by, metric, count, minimum, maximum, mean, median): nulls and NaN don't count; values rounded half to even."""
    by = by or []
    long = rows.select(*by, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics))).alias("x")).select(*by, "x.metric", "x.v").where("v IS NOT NULL AND NOT isnan(v)")
    # values are counted before they are ordered: a group costs one row a distinct value, and no task orders a whole group
    counted = long.groupBy(*by, "metric", "v").agg(F.count("*").alias("c"))
    ranked = ordered.cumulated(counted, [*by, "metric"], "v", ["c"]).withColumnRenamed("c_of", "n")
    middle = lambda i: F.min(F.when(F.col("c_upto") > i, F.col("v")))
    half = (F.col("n") - 1) / 2
    r = lambda c: F.bround(c, places)
    return ranked.groupBy(*by, "metric").agg(F.max("n").alias("count"), r(F.min("v")).alias("minimum"), r(F.max("v")).alias("maximum"), r(F.sum(F.col("v") * F.col("c")) / F.max("n")).alias("mean"), r((middle(F.floor(half)) + middle(F.ceil(half))) / 2).alias("median"))


def best_epochs(rows: DataFrame, by: list[str], epoch: str, fitness: str, patience: int = 20) -> DataFrame:
    """Running best of a fitness series: best so far, its epoch, epochs since, patience exhausted.

    An epoch is the best if it strictly exceeds all before it, or while the best is still 0.
    """
    w = W.partitionBy(*by).orderBy(epoch)
    before = F.coalesce(F.max(fitness).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    marked = rows.withColumn("_b", F.when((F.col(fitness) > before) | (before == 0), F.col(epoch)))
    best_epoch = F.last("_b", ignorenulls=True).over(w)
    out = marked.withColumn("best_fitness", F.greatest(F.max(fitness).over(w), F.lit(0.0))).withColumn("best_epoch", best_epoch)
    since = F.col(epoch) - F.col("best_epoch")
    return out.drop("_b").withColumn("epochs_without_improvement", since).withColumn("patience_exhausted", since >= patience)


def history_gaps(rows: DataFrame, by: list[str], epoch: str, values: list[str]) -> DataFrame:
    """Rows of a history that break its rules: epochs must be 1..n without gaps and values finite."""
    n = F.row_number().over(W.partitionBy(*by).orderBy(epoch))
    bad = F.array(F.when(F.col("_n") != F.col(epoch), "epoch_gap"), *(F.when(F.col(v).isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.concat(F.lit("not_finite:"), F.lit(v))) for v in values))
    return rows.withColumn("_n", n).withColumn("problems", F.filter(bad, lambda p: p.isNotNull())).drop("_n").where(F.size("problems") > 0)


def grouped_counts(rows: DataFrame, dimensions: list[str], measures: dict[str, str] | None = None) -> DataFrame:
    """Counts per combination and per first dimension alone (ALL elsewhere), in one pass by grouping sets."""
    aggs = [F.count("*").alias("count"), *(F.sum(c).alias(n) for n, c in (measures or {}).items())]
    first, *rest = dimensions
    sets = rows.select(*dimensions, *(measures or {}).values()).groupingSets([dimensions, [first]], *dimensions).agg(*aggs, *(F.grouping(r).alias(f"_{r}") for r in rest))
    return sets.select(first, *(F.when(F.col(f"_{r}") == 1, F.lit("ALL")).otherwise(F.col(r).cast("string")).alias(r) for r in rest), "count", *(measures or {}))
