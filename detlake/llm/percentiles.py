"""Percentiles with bounded error from dyadic Count-sketches (problem 5).

A number of any size and sign is encoded as the upper LEVELS bits of its 64-bit floating-point form, made to sort like the
numbers, so no range has to be known. For every binary resolution of these codes the sketch counts the dyadic intervals:
exactly while there are few, and beyond that by a signed Count-sketch (ROWS rows of ``width`` counters; the estimate is the
median over rows). Everything is a sum of +1 or -1, so sketches of tasks, days or sites merge by addition and a withdrawn
observation is deleted by adding it with weight -1. A rank is inverted by descending from the coarsest level. Three more
cells count what has no place in an order: nulls, NaN, and values outside a range if one is asked for.

Error. Encoding moves a value by at most 2^-21 of itself. One counter row errs on an interval's count by a standard deviation
of sqrt(F2 / width) where F2 <= n * (largest interval count); width follows from the rank error that is asked for (a share
of n) with a margin of several deviations; the tests measure it.

Scale. Every task keeps one sum a group and metric over all its rows; a sum leaves as distinct codes with weights or as
counters, whichever is shorter. Sums are added in two steps, spread first by a salt that grows as the root of the number of
tasks, so that no task reads more than that root of them, whatever group is hot.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from detlake.session import cut, norm

LEVELS, EXACT_LEVELS, ROWS = 32, 10, 5
#: Default bound on |rank(estimate) / n - q|.
RANK_ERROR = 0.01
#: Distinct codes that the sums of a task hold before they leave, and that one sum holds before it becomes counters.
HELD_VALUES, MOST_VALUES = 1 << 21, 1 << 17
#: Share of a value by which encoding moves it at most.
STEP = 2.0**-21

#: Cells: exact levels one after the other (level l begins at 2^l), set-aside counts, then level, row, column of the signed ones.
NULLS = 2 << EXACT_LEVELS
NANS, OUTSIDE, SIGNED = NULLS + 1, NULLS + 2, NULLS + 3
QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def width_of(error: float) -> int:
    """Counters a row for a rank error: a power of 2 of at least 10 / error."""
    if not 0 < error < 1:
        raise ValueError("the rank error is a share between 0 and 1")
    return 1 << math.ceil(math.log2(10 / error))


def size_of(width: int) -> int:
    return SIGNED + (LEVELS - EXACT_LEVELS) * ROWS * width


def encode(value: np.ndarray) -> np.ndarray:
    """Finite or infinite numbers to 0..2^LEVELS-1, in the same order (-0.0 is 0.0)."""
    bits = (np.asarray(value, np.float64) + 0.0).view(np.int64)
    bits = bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))
    return (bits >> (64 - LEVELS)) + (1 << (LEVELS - 1))


def decode(code: np.ndarray) -> np.ndarray:
    """The middle of a code's interval; infinite codes give infinities."""
    top = np.asarray(code, np.int64) - (1 << (LEVELS - 1))
    bits = (top << (64 - LEVELS)) + (np.int64(1) << (63 - LEVELS))
    low = np.where(top < 0, (top << (64 - LEVELS)) ^ np.int64(0x7FFFFFFFFFFFFFFF), top << (64 - LEVELS)).view(np.float64)
    bits = np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)
    middle = bits.view(np.float64)
    return np.where(np.isnan(middle), np.where(np.isnan(low), np.copysign(np.inf, top), low), middle)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    z = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _signed(node: np.ndarray, level: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells (of one level, rows one after the other) and signs of nodes, shape (ROWS, nodes); rows share a hash's 64 bits."""
    bits = width.bit_length()
    each = max(1, 64 // bits)
    hashes = [_mix(node, level * ROWS + i) for i in range(-(-ROWS // each))]
    parts = np.stack([hashes[row // each] >> np.uint64(row % each * bits) for row in range(ROWS)])
    cells = ((parts >> np.uint64(1)) & np.uint64(width - 1)).astype(np.int64) + width * np.arange(ROWS)[:, None]
    return cells, 1 - 2 * (parts & np.uint64(1)).astype(np.int64)


def _base(level: int, width: int) -> int:
    return SIGNED + (level - EXACT_LEVELS - 1) * ROWS * width


def _sorted_sum(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order with their total weights."""
    if not len(codes):
        return codes.astype(np.int64), weights.astype(np.int64)
    order = np.argsort(codes, kind="stable")
    return _grouped_sum(codes[order].astype(np.int64), weights[order].astype(np.int64))


def _grouped_sum(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(codes):
        return codes, weights
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[first], np.add.reduceat(weights, first)


def cells_of(codes: np.ndarray, weights: np.ndarray, width: int) -> np.ndarray:
    """The whole sketch of encoded values with integer weights (negative: deletions)."""
    node, weight = _sorted_sum(np.asarray(codes), np.asarray(weights))
    out = np.zeros(size_of(width), np.int64)
    for level in range(LEVELS, -1, -1):
        if level < LEVELS:  # nodes stay in order, so halves of an interval are neighbours
            node, weight = _grouped_sum(node >> 1, weight)
        if not len(node):
            break
        if level <= EXACT_LEVELS:
            out[(1 << level) + node] += weight
            continue
        cell, sign = _signed(node, level, width)
        base = _base(level, width)
        out[base : base + ROWS * width] += np.rint(np.bincount(cell.ravel(), (weight * sign).ravel(), ROWS * width)).astype(np.int64)
    return out


def estimate(cells: np.ndarray, level: int, node: np.ndarray) -> np.ndarray:
    """Values in dyadic intervals of one level."""
    if level <= EXACT_LEVELS:
        return cells[(1 << level) + node].astype(float)
    width = (len(cells) - SIGNED) // ((LEVELS - EXACT_LEVELS) * ROWS)
    cell, sign = _signed(node, level, width)
    return np.median(sign * cells[_base(level, width) + cell], axis=0)


def quantiles(cells: np.ndarray, qs) -> np.ndarray:
    """Values at ranks max(1, ceil(q n)), found by descending the levels; NaN of an empty sketch."""
    qs, n = np.asarray(qs, float), int(cells[1])
    if n <= 0:
        return np.full(len(qs), np.nan)
    rank, node, mass = np.maximum(1, np.ceil(qs * n)), np.zeros(len(qs), np.int64), np.full(len(qs), float(n))
    for level in range(1, LEVELS + 1):
        left, right = np.clip(estimate(cells, level, np.r_[2 * node, 2 * node + 1]).reshape(2, -1), 0, mass)
        if level > EXACT_LEVELS:  # both halves' estimates err; the parent's count is the better known sum
            both = left + right
            left = np.where(both > 0, mass * left / np.maximum(both, 1e-300), left)
        go_left = (rank <= left) | (left >= mass)
        node = 2 * node + ~go_left
        mass, rank = np.where(go_left, left, mass - left), np.where(go_left, rank, rank - left)
    return decode(node)


class Sum:
    """A sum of sketches. Values not yet sketched travel as codes with weights, which are as good as their sketch."""

    def __init__(self, width: int):
        self.width = width
        self.codes: list[np.ndarray] = []
        self.weights: list[np.ndarray] = []
        self.aside = np.zeros(3, np.int64)
        self.size, self.cells = 0, None

    def put(self, codes: np.ndarray, weights: np.ndarray, aside: np.ndarray) -> None:
        self.aside = self.aside + aside
        self.codes.append(codes)
        self.weights.append(weights)
        self.size += len(codes)
        if self.size > MOST_VALUES:
            self._tidy()
            if self.size > MOST_VALUES // 2:
                self._sketch()

    def add(self, data: bytes) -> None:
        if data[:1] == b"d":
            cells = np.frombuffer(zlib.decompress(data[1:]), np.int64)
            self.cells = cells.copy() if self.cells is None else self.cells + cells
        else:
            n = (len(data) - 25) // 12
            self.put(np.frombuffer(data, np.uint32, n, 25).astype(np.int64), np.frombuffer(data, np.int64, n, 25 + 4 * n), np.frombuffer(data, np.int64, 3, 1))

    def _tidy(self) -> None:
        if len(self.codes) > 1:
            codes, weights = _sorted_sum(np.concatenate(self.codes), np.concatenate(self.weights))
            self.codes, self.weights, self.size = [codes], [weights], len(codes)

    def _sketch(self) -> None:
        if self.codes:
            cells = cells_of(np.concatenate(self.codes), np.concatenate(self.weights), self.width)
            self.cells = cells if self.cells is None else self.cells + cells
            self.codes, self.weights, self.size = [], [], 0

    def counters(self) -> np.ndarray:
        self._sketch()
        cells = np.zeros(size_of(self.width), np.int64) if self.cells is None else self.cells.copy()
        cells[NULLS : NULLS + 3] += self.aside
        return cells

    def packed(self) -> bytes:
        """Codes with weights or compressed counters, whichever is shorter."""
        self._tidy()
        if self.cells is None and 12 * self.size <= size_of(self.width):  # counters take a byte each at least, about
            codes = self.codes[0] if self.codes else np.zeros(0, np.int64)
            weights = self.weights[0] if self.weights else np.zeros(0, np.int64)
            return b"v" + self.aside.tobytes() + codes.astype(np.uint32).tobytes() + weights.astype(np.int64).tobytes()
        return b"d" + zlib.compress(self.counters().tobytes(), 1)


def unpack(data: bytes, width: int) -> np.ndarray:
    """Counters of a packed sketch."""
    s = Sum(width)
    s.add(data)
    return s.counters()


def _values(keys: list[str], metrics: list[str], weight: str | None, domain: tuple[float, float] | None, width: int):
    """Rows (keys, metrics, weight) -> (keys, metric, salt, cells): one sum a task, key and metric, in bounded memory."""

    def run(batches):
        sums: dict[tuple, Sum] = {}
        held = 0
        for batch in _larger(batches):
            pdf = batch.to_pandas(date_as_object=True)
            group = pdf.groupby(keys, sort=False).ngroup().to_numpy()
            names = list(pdf.drop_duplicates(keys)[keys].itertuples(index=False, name=None))
            w = pdf[weight].to_numpy(np.int64) if weight else np.ones(len(pdf), np.int64)
            for metric in metrics:
                column = batch.column(batch.schema.get_field_index(metric))
                null = column.is_null().to_numpy(zero_copy_only=False)
                value = column.to_numpy(zero_copy_only=False).astype(float)
                nan = ~null & np.isnan(value)
                out = ~null & ~nan & ((value < domain[0]) | (value > domain[1])) if domain else np.zeros(len(value), bool)
                ok = ~(null | nan | out)
                aside = np.stack([np.bincount(group[m], w[m], len(names)) for m in (null, nan, out)], axis=1).astype(np.int64)
                both, weights = _sorted_sum((group[ok].astype(np.int64) << LEVELS) | encode(value[ok]), w[ok])
                starts = np.searchsorted(both >> LEVELS, np.arange(len(names) + 1))
                for g, name in enumerate(names):
                    total = sums.setdefault((*name, metric), Sum(width))
                    before = total.size
                    total.put(both[starts[g] : starts[g + 1]] & ((1 << LEVELS) - 1), weights[starts[g] : starts[g + 1]], aside[g])
                    held += total.size - before
            if held > HELD_VALUES or len(sums) > 4096:
                yield from _leave(sums, keys)
                sums, held = {}, 0
        yield from _leave(sums, keys)

    return run


def _larger(batches, rows: int = 100_000):
    """Batches put together to so many rows or a little more."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        kept.append(batch)
        if sum(b.num_rows for b in kept) >= rows:
            yield pa.concat_batches(kept)
            kept = []
    if sum(b.num_rows for b in kept):
        yield pa.concat_batches(kept)


def _leave(sums: dict[tuple, Sum], keys: list[str]):
    entries = list(sums.items())
    for begin in range(0, len(entries), 256):
        part = entries[begin : begin + 256]
        yield _rows([k for k, _ in part], [s.packed() for _, s in part], keys)


def _rows(names: list, packed: list[bytes], keys: list[str]) -> pa.RecordBatch:
    # the salt is the task, not the content: what a repeated task sends somewhere doesn't depend on how its rows came in batches
    task = pa.array([TaskContext.get().partitionId()] * len(packed), pa.int32())
    columns = [pa.array([n[i] for n in names]) for i in range(len(keys) + 1)]
    return pa.RecordBatch.from_arrays([*columns, task, pa.array(packed, pa.binary())], names=[*keys, "metric", "salt", "cells"])


def _add(keys: list[str], width: int):
    """Sorted sketches -> their sums, one at a time."""

    def run(batches):
        now, total = None, Sum(width)
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in [*keys, "metric", "cells"]]
            for *key, cells in zip(*columns):
                if key != now:
                    if now is not None:
                        yield _rows([now], [total.packed()], keys)
                    now, total = key, Sum(width)
                total.add(cells)
        if now is not None:
            yield _rows([now], [total.packed()], keys)

    return run


def merge(sketches: DataFrame, keys: list[str], error: float = RANK_ERROR) -> DataFrame:
    """Add up sketches (keys, metric, salt, cells) that agree in keys and metric; all must be of the same error."""
    spark = sketches.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    salts = math.isqrt(tasks) + 1
    kept = sketches.select(*keys, "metric", (F.col("salt") % F.lit(salts)).alias("salt"), "cells")
    schema = kept.schema
    for by in ([*keys, "metric", "salt"], [*keys, "metric"]):
        kept = kept.repartition(tasks, *by).sortWithinPartitions(*keys, "metric").mapInArrow(_add(keys, width_of(error)), schema)
    return kept


def sketch(values: DataFrame, keys: list[str], metrics: list[str], weight: str | None = None, domain: tuple[float, float] | None = None, error: float = RANK_ERROR) -> DataFrame:
    """Sketches (keys, metric, salt, cells) of numeric columns.

    Nulls, NaN and, with a ``domain``, values outside it are counted apart; infinities are values. ``weight`` names a column of
    integers by which rows count; -1 withdraws. Rows with a null key are left out. Sketches of separate inputs (days) can
    be united and merged later.
    """
    taken = values.dropna(subset=keys).select(*keys, *(F.col(m).cast("double").alias(m) for m in metrics), *([F.col(weight).cast("long").alias(weight)] if weight else []))
    schema = T.StructType([*(taken.schema[k] for k in keys), T.StructField("metric", T.StringType()), T.StructField("salt", T.IntegerType()), T.StructField("cells", T.BinaryType())])
    return merge(taken.mapInArrow(_values(keys, metrics, weight, domain, width_of(error)), schema), keys, error)


def _read(keys: list[str], wanted: tuple[float, ...], width: int):
    names = [quantile_name(q) for q in wanted]

    def run(batches):
        for batch in batches:
            pdf = batch.to_pandas(date_as_object=True)
            found, values = [], []
            for data in pdf["cells"]:
                cells = unpack(data, width)
                found.append((int(cells[1]), int(cells[NULLS : NULLS + 3].sum())))
                values.append(quantiles(cells, wanted))
            out = pdf[[*keys, "metric"]].assign(n=[n for n, _ in found], set_aside=[a for _, a in found])
            table = np.array(values).reshape(len(found), len(names))
            for i, name in enumerate(names):
                column = pd.array(table[:, i])
                column[np.array([n <= 0 for n, _ in found], bool)] = None
                out[name] = column
            yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    return run


def quantile_name(q: float) -> str:
    return "median" if q == 0.5 else f"p{round(q * 100):02d}"


def quantiles_of(sketches: DataFrame, keys: list[str], wanted: tuple[float, ...] = QUANTILES, error: float = RANK_ERROR) -> DataFrame:
    """(keys, metric, n, set_aside, a column a quantile): the quantiles are null where n is 0."""
    schema = T.StructType(
        [*(sketches.schema[k] for k in keys), T.StructField("metric", T.StringType()), T.StructField("n", T.LongType()), T.StructField("set_aside", T.LongType()), *(T.StructField(quantile_name(q), T.DoubleType()) for q in wanted)]
    )
    return sketches.mapInArrow(_read(keys, wanted, width_of(error)), schema)


METRICS = ["confidence", "bbox_relative_area"]
#: Values of these metrics that count; others are counted as set aside.
DOMAIN = (0.0, 1.0)


def observations(detections: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """Each detection_id once, as first delivered (a null ingested_at comes last): (class_name normalised, day, metrics).

    Rows without class_name or detection_id are left out.
    """
    d = detections.where("detection_id IS NOT NULL").select("detection_id", norm("class_name").alias("class_name"), "ingested_at", *metrics)
    first = F.min(F.struct(F.col("ingested_at").isNull().alias("late"), "ingested_at", "class_name", *metrics))
    once = d.groupBy("detection_id").agg(first.alias("o")).select("o.*")
    return once.where("class_name IS NOT NULL").select("class_name", F.coalesce(F.to_date("ingested_at"), F.lit("0001-01-01").cast("date")).alias("day"), *metrics)


def daily_sketches(detections: DataFrame, metrics: list[str] = METRICS, domain: tuple[float, float] | None = DOMAIN, error: float = RANK_ERROR) -> DataFrame:
    """(class_name, day, metric, salt, cells): the mergeable results of separate days; the day of a null is 0001-01-01."""
    return sketch(observations(detections, metrics), ["class_name", "day"], metrics, domain=domain, error=error)


def class_percentiles(detections: DataFrame, metrics: list[str] = METRICS, domain: tuple[float, float] | None = DOMAIN, error: float = RANK_ERROR) -> DataFrame:
    """(class_name, day, metric, n, set_aside, p01, p05, p25, median, p75, p95, p99): a row a day, and one over all days (day null).

    The rows over all days come from the sum of the daily sketches. Empty tables give an empty result.
    """
    daily = cut(daily_sketches(detections, metrics, domain, error))
    whole = quantiles_of(merge(daily, ["class_name"], error), ["class_name"], error=error).withColumn("day", F.lit(None).cast("date"))
    return quantiles_of(daily, ["class_name", "day"], error=error).unionByName(whole)


def bound_check(detections: DataFrame, found: DataFrame, metrics: list[str] = METRICS, domain: tuple[float, float] | None = DOMAIN, error: float = RANK_ERROR) -> DataFrame:
    """(class_name, day, metric, n, set_aside, within_bound): whether all estimates of ``class_percentiles`` keep their error.

    Exact ranks of each estimate are counted over all observations, allowing for the encoding's step. A group without
    values is within the bound if its percentiles are null.
    """
    names = [quantile_name(q) for q in QUANTILES]
    obs = observations(detections, metrics)
    each = F.explode(F.array(F.col("day"), F.lit(None).cast("date"))).alias("day")  # once for its day, once for all days
    values = obs.select("class_name", each, *metrics).select("class_name", "day", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics))).alias("x")).select("class_name", "day", "x.metric", "x.v")
    ok_value = F.col("v").isNotNull() & ~F.isnan("v") & (F.col("v").between(*domain) if domain else F.lit(True))
    est = found.select("class_name", F.col("day").alias("_day"), F.col("metric").alias("_metric"), *names, F.col("n").alias("_n"), F.col("set_aside").alias("_aside")).withColumnRenamed("class_name", "_class")
    joined = values.withColumn("ok", ok_value).join(est, (F.col("class_name") == F.col("_class")) & F.col("day").eqNullSafe(F.col("_day")) & (F.col("metric") == F.col("_metric")))
    step = lambda q: F.abs(q) * F.lit(2 * STEP) + F.lit(1e-300)
    same = lambda q: F.col("v") == F.col(q)  # noqa: E731  infinities
    counts = [c for q in names for c in (F.count_if(F.col("ok") & (F.col("v") < F.col(q) - step(F.col(q))) & ~same(q)).alias(f"below_{q}"), F.count_if(F.col("ok") & ((F.col("v") <= F.col(q) + step(F.col(q))) | same(q))).alias(f"upto_{q}"))]
    ranked = joined.groupBy("class_name", "day", "metric").agg(F.count_if("ok").alias("n"), F.count_if(~F.col("ok")).alias("set_aside"), F.max("_n").alias("_n"), F.max("_aside").alias("_aside"), F.max(F.col(names[0]).isNull()).alias("_none"), *counts)
    ok = (F.col("n") == F.col("_n")) & (F.col("set_aside") == F.col("_aside"))
    held = F.lit(True)
    for q, name in zip(QUANTILES, names):
        held = held & (F.col(f"below_{name}") <= (q + error) * F.col("n")) & (F.col(f"upto_{name}") >= (q - error) * F.col("n"))
    return ranked.select("class_name", "day", "metric", "n", "set_aside", (ok & F.when(F.col("n") == 0, F.col("_none")).otherwise(held)).alias("within_bound"))
