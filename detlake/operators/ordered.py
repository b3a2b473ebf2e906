"""Runs and row numbers of ordered keys without ordering a whole key in one task.

A window over a key that holds a large share of all rows is one task. Here rows are ordered within (key, block of the
order column) only; a window over one row a block carries counts and open runs from block to block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def runs(rows: DataFrame, keys: list[str], at: str, tie: list[str], pause: Callable[[Column, Column], Column], block: int, by: list[str] | None = None) -> DataFrame:
    """Add ``run`` (0, 1, ... per key) and ``run_start`` (the order value at which the run begins).

    ``pause(previous, current)`` says whether a run ends between two neighbouring order values; it may use the columns
    ``by``, which must be constant within a key. Null keys are keys of their own.
    """
    by = by or []
    rows = rows.withColumn("_b", F.floor(F.col(at) / block))
    w = W.partitionBy(*keys, "_b").orderBy(at, *tie)
    new = F.coalesce(pause(F.lag(at).over(w), F.col(at)), F.lit(False))
    rows = rows.withColumn("_new", new)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_n", F.sum(F.col("_new").cast("long")).over(upto)).withColumn("_s", F.max(F.when(F.col("_new"), F.col(at))).over(upto))
    blocks = rows.groupBy(*keys, "_b").agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"), F.max("_n").alias("_count"), F.max("_s").alias("_last"), *(F.max(c).alias(c) for c in by if c not in keys))
    v = W.partitionBy(*keys).orderBy("_b")
    before = F.lag("_hi").over(v)
    blocks = blocks.withColumn("_opens", F.coalesce(before.isNull() | pause(before, F.col("_lo")), F.lit(False)))
    past = v.rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("_first", F.when(F.col("_opens"), F.col("_lo")))
    carried = F.last(F.coalesce("_last", "_first"), ignorenulls=True).over(past)
    base = F.coalesce(F.sum(F.col("_count") + F.col("_opens").cast("long")).over(past), F.lit(0)) + F.col("_opens").cast("long") - 1
    blocks = blocks.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate([*keys, "_b"])), base.alias("_base"), F.coalesce("_first", carried).alias("_start"))
    on = F.lit(True)
    for i, c in enumerate([*keys, "_b"]):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    joined = rows.join(blocks, on)
    return joined.withColumn("run", F.col("_base") + F.col("_n")).withColumn("run_start", F.coalesce("_s", "_start")).drop("_b", "_new", "_n", "_s", "_base", "_start", *(f"_k{i}" for i in range(len(keys) + 1)))


def numbered(rows: DataFrame, keys: list[str], at: str, tie: list[str], block: int, name: str = "n") -> DataFrame:
    """Add the row number (1, 2, ... per key, by order column and ties) and the key's size ``<name>_of``."""
    rows = rows.withColumn("_b", F.floor(F.col(at) / block))
    rows = rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_b").orderBy(at, *tie)))
    v = W.partitionBy(*keys)
    sizes = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_m"))
    offset = F.sum("_m").over(v.orderBy("_b")) - F.col("_m")
    sizes = sizes.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate([*keys, "_b"])), offset.alias("_o"), F.sum("_m").over(v).alias(f"{name}_of"))
    on = F.lit(True)
    for i, c in enumerate([*keys, "_b"]):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(sizes, on).withColumn(name, F.col("_o") + F.col("_r")).drop("_b", "_r", "_o", *(f"_k{i}" for i in range(len(keys) + 1)))


def previous(rows: DataFrame, keys: list[str], at: str, tie: list[str], value: str, block: int, name: str = "previous") -> DataFrame:
    """Add the value of the row before (by order column and ties), null for a key's first; ``value`` itself must not be null."""
    rows = rows.withColumn("_b", F.floor(F.col(at) / block))
    inside = F.lag(value).over(W.partitionBy(*keys, "_b").orderBy(at, *tie))
    last = rows.groupBy(*keys, "_b").agg(F.max_by(value, F.struct(at, *tie)).alias("_last"))
    carried = F.lag("_last").over(W.partitionBy(*keys).orderBy("_b"))
    last = last.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate([*keys, "_b"])), carried.alias("_before"))
    on = F.lit(True)
    for i, c in enumerate([*keys, "_b"]):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return rows.withColumn("_in", inside).join(last, on).withColumn(name, F.coalesce("_in", "_before")).drop("_b", "_in", "_before", *(f"_k{i}" for i in range(len(keys) + 1)))


def cumulated(rows: DataFrame, keys: list[str], at: str, sums: list[str], parts: int = 64) -> DataFrame:
    """Add, for each of ``sums``, its total over the key up to this row's order value (``<c>_upto``) and over all (``<c>_of``).

    Rows must differ in (keys, at), which must not be null. A key is cut at approximate percentiles into ``parts`` ranges that are ordered
    apart, so that a key that holds most rows is ordered in as many tasks; one row a range carries the totals.
    """
    steps = F.array(*(F.lit(i / parts) for i in range(1, parts)))
    cuts = rows.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(F.col(at), steps, F.lit(20 * parts))).alias("_cuts"))
    same = lambda other: F.lit(True) if not other else other[0] & same(other[1:])
    named = cuts.select(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(keys)), "_cuts")
    ranged = rows.join(named, same([F.col(c).eqNullSafe(F.col(f"_c{i}")) for i, c in enumerate(keys)])).drop(*(f"_c{i}" for i in range(len(keys))))
    ranged = ranged.withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col(at)))).drop("_cuts")
    inside = W.partitionBy(*keys, "_b").orderBy(at)
    ranged = ranged.select("*", *(F.sum(c).over(inside).alias(f"_{c}_in") for c in sums))
    v = W.partitionBy(*keys)
    totals = ranged.groupBy(*keys, "_b").agg(*(F.sum(c).alias(f"_{c}_t") for c in sums))
    before = [(F.sum(f"_{c}_t").over(v.orderBy("_b")) - F.col(f"_{c}_t")).alias(f"_{c}_o") for c in sums]
    whole = [F.sum(f"_{c}_t").over(v).alias(f"{c}_of") for c in sums]
    totals = totals.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate([*keys, "_b"])), *before, *whole)
    joined = ranged.join(totals, same([F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*keys, "_b"])]))
    return joined.select(*rows.columns, *((F.col(f"_{c}_in") + F.col(f"_{c}_o")).alias(f"{c}_upto") for c in sums), *(f"{c}_of" for c in sums))
