"""Samples that follow target category proportions (problem 3), by the cube method.

A sample's balancing variables are its category indicators and the constant 1 (the size), so samples with the same set of
categories are interchangeable and there are at most 2^6 kinds. From the kinds' counts (all that reaches the driver) each
request gets inclusion probabilities by bounded least squares over the kinds: minima come first, then the size, then the
least deviation from the wanted shares, and what that leaves open goes as near to equal chances as it can.

Flight. In every partition, records of one kind fly against each other: a step that raises one and lowers another of the
same kind keeps every balance exactly, so a kind with expected total t ends with floor(t) records chosen and one unresolved
record with the rest, in a hash order seeded by the request. The unresolved records, at most one a kind, partition and
request, merge upward in two levels and fly again, at the last level also along null-space directions of the indicator
matrix across kinds. Landing resolves the at most six that remain, by the same order of aims. The report gives what was asked,
available and drawn, and the residual imbalance.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detlake.session import cut, norm

#: Class ids of the named categories.
CATEGORIES = ("D00_longitudinal_crack", "D10_transverse_crack", "D20_alligator_crack", "D40_pothole", "negative")
NEGATIVE = 4
#: Bit of a sample whose classes are known but none of them is a category.
OTHER = 5
MERGE = 64
_VECTORS = np.array([[*(m >> c & 1 for c in range(5)), 1] for m in range(64)], float)


def population(samples: DataFrame) -> DataFrame:
    """(filename, mask): each distinct file name with its categories, as bits in the order of CATEGORIES.

    Rows that repeat a file name unite their categories. An empty list is negative; a null list (unknown) gives no bit,
    and a name with unknown lists only isn't drawn; neither is a null name. Null and foreign class ids count as OTHER.
    """
    has = [F.when(F.array_contains("classes_present", c), F.lit(1 << c)).otherwise(0) for c in range(4)]
    listed = F.size("classes_present")
    mask = has[0].bitwiseOR(has[1]).bitwiseOR(has[2]).bitwiseOR(has[3])
    bits = F.when(F.col("classes_present").isNull(), F.lit(0)).when(listed == 0, F.lit(1 << NEGATIVE)).when(mask > 0, mask).otherwise(F.lit(1 << OTHER))
    return samples.where("filename IS NOT NULL").select("filename", bits.alias("bits")).groupBy("filename").agg(F.bit_or("bits").alias("mask"))


def requirements(pop: DataFrame, configs: DataFrame, shares: DataFrame) -> DataFrame:
    """(config_id, category, target_share, required, available): what each request asks of each category it names.

    required is the greater of the minimum and target_share x sample_size (0 if null). Requests are a small stated set,
    counts come as one row per kind. Categories that aren't known have nothing available.
    """
    kinds = pop.groupBy("mask").agg(F.count("*").alias("n"))
    bit = F.create_map(*(x for i, c in enumerate(CATEGORIES) for x in (F.lit(c.lower()), F.lit(1 << i))))
    needed = configs.select("config_id", "sample_size", "images_per_class", "negative_images")
    asked = shares.select("config_id", "category", "target_share").where("config_id IS NOT NULL AND category IS NOT NULL").join(needed, "config_id").select(
        "config_id", "category", F.when(F.isnan("target_share"), None).otherwise(F.col("target_share")).alias("target_share"), F.try_element_at(bit, norm("category")).alias("bit"),
        F.greatest(F.coalesce(F.when(norm("category") == "negative", F.col("negative_images")).otherwise(F.col("images_per_class")), F.lit(0)).cast("double"),
                   F.coalesce(F.when(F.isnan("target_share"), None).otherwise(F.col("target_share")) * F.col("sample_size"), F.lit(0.0))).alias("required"),
    )
    bits = asked.select("bit").where("bit IS NOT NULL").distinct()
    there = bits.join(F.broadcast(kinds), F.col("mask").bitwiseAND(F.col("bit")) > 0, "left").groupBy("bit").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("available"))
    return asked.join(there, "bit", "left").select("config_id", "category", "target_share", "required", F.coalesce("available", F.lit(0)).alias("available")).distinct()


def unmet(drawn: DataFrame, pop: DataFrame, configs: DataFrame, shares: DataFrame) -> DataFrame:
    """(config_id, category) of the report on a sample whose requirement is more than there is to draw from."""
    return report(drawn, pop, configs, shares).where("available < required").select("config_id", "category").distinct()


#: Weights of the aims: minima, size, shares, equal chances.
_AIMS = (1e5, 1e3, 1.0, 1e-2)


def bounded_least_squares(a: np.ndarray, b: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The x in 0..high with the least |a x - b|, by active sets: bounds are released by gradient, steps stop at bounds."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(20 * n):
        pull = a.T @ (b - a @ x)
        gain = np.where(free, 0.0, np.where(x <= 0, pull, np.where(x >= high, -pull, 0.0)))
        best = int(np.argmax(gain))
        if gain[best] <= 1e-10 * max(1.0, float(np.abs(pull).max())):
            break
        free[best] = True
        while free.any():
            at = np.flatnonzero(free)
            fixed = np.where(free, 0.0, x)
            y = np.linalg.lstsq(a[:, at], b - a @ fixed, rcond=None)[0]
            if ((y >= 0) & (y <= high[at])).all():
                x[at] = y
                break
            move = y - x[at]
            with np.errstate(divide="ignore", invalid="ignore"):
                room = np.where(y < 0, -x[at] / move, np.where(y > high[at], (high[at] - x[at]) / move, np.inf))
            step = int(np.argmin(room))
            x[at] = np.clip(x[at] + max(0.0, room[step]) * move, 0, high[at])
            x[at[step]] = 0.0 if y[step] < 0 else high[at[step]]
            free[at[step]] = False
            if at[step] == best and room[step] <= 0:
                return x  # the release gains nothing beyond rounding
    return x


def probabilities(counts: np.ndarray, size: float, minima: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Inclusion probability of each of the 64 kinds.

    minima: per category, at least so many (all there are, if fewer); wanted: per category the total that its share asks
    for, NaN where none does. Minima are kept even if they ask for more than the size; the size (all there are, if fewer) is kept even if
    shares ask for something else.
    """
    real = np.flatnonzero((counts > 0) & (np.arange(64) > 0))
    p = np.zeros(64)
    total = counts[real].sum()
    if not len(real):
        return p
    n, v = counts[real], _VECTORS[real]
    size = min(size, total)
    minima = np.minimum(minima, (n[:, None] * v[:, :5]).sum(axis=0))
    has = np.flatnonzero(~np.isnan(wanted))
    scale = max(size, minima.sum(), 1.0)
    k, slack = len(real), 5
    rows = [np.c_[(n[:, None] * v[:, :5]).T, -np.eye(slack) * scale] / scale, np.r_[n, np.zeros(slack)][None] / scale, np.c_[(n[:, None] * v[:, has]).T, np.zeros((len(has), slack))] / scale, np.c_[np.diag(np.sqrt(n / total)), np.zeros((k, slack))]]
    ends = [minima / scale, np.array([size / scale]), wanted[has] / scale, np.sqrt(n / total) * (size / total)]
    x = bounded_least_squares(np.vstack([w * r for w, r in zip(_AIMS, rows)]), np.concatenate([w * e for w, e in zip(_AIMS, ends)]), np.r_[np.ones(k), np.full(slack, np.inf)])
    p[real] = np.where(x[:k] > 1 - 1e-9, 1.0, np.where(x[:k] < 1e-12, 0.0, x[:k]))
    return p


def _random(h: np.ndarray, seed: int) -> np.ndarray:
    z = h.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def same_kind_flight(kind: np.ndarray, p: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Flight among records of equal kind: new probabilities, per kind all 0 or 1 but for at most one.

    Records may come with different probabilities (unresolved ones of several partitions): laid on a line in their random
    order, a record is chosen if its stretch crosses a whole number; the total of a kind is kept exactly.
    """
    out = np.zeros(len(p))
    at = np.lexsort((order, kind))
    k, q = kind[at], p[at]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, int)
    for begin, end in zip(first, [*first[1:], len(k)]):
        ends = np.cumsum(q[begin:end])
        total = ends[-1]
        whole = np.floor(total + 1e-9)
        shift = int(order[at[begin]] % np.uint64(1 << 32)) / (1 << 32)  # a random start makes every record's chance its own
        crossed = np.floor(np.minimum(ends, total) + shift + 1e-12) - np.floor(np.r_[0.0, ends[:-1]] + shift + 1e-12) >= 1
        chosen = np.flatnonzero(crossed)
        rest = total - whole
        if len(chosen) > whole and rest > 1e-9:  # one crossing more than whole: that record stays open
            out[at[begin + chosen[:-1]]] = 1.0
            out[at[begin + chosen[-1]]] = rest
        else:
            out[at[begin + chosen]] = 1.0
            if rest > 1e-9:
                open_ = np.flatnonzero(~crossed & (q[begin:end] > 0))
                if len(open_):
                    out[at[begin + open_[0]]] = rest
    return out


def cube(kind: np.ndarray, p: np.ndarray, rng: np.random.Generator, expected: np.ndarray, minima: np.ndarray, size: float, wanted: np.ndarray) -> np.ndarray:
    """Flight along null-space directions of the indicators, then landing: zeros and ones.

    expected: totals of the whole sample (categories and size), these records' probabilities included. Of all ways to land
    the one with the least shortfall of minima is taken, then the nearest size, then the least deviation from the wanted totals.
    """
    p = p.copy()
    while True:
        free = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))[:12]
        if not len(free):
            break
        a = _VECTORS[kind[free]].T
        _, s, v = np.linalg.svd(a)
        rank = int((s > 1e-9).sum())
        if len(free) <= rank:
            break
        u = v[rank + int(rng.integers(len(free) - rank))]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.min(np.where(u > 1e-12, (1 - p[free]) / u, np.where(u < -1e-12, -p[free] / u, np.inf)))
            down = np.min(np.where(u > 1e-12, p[free] / u, np.where(u < -1e-12, (p[free] - 1) / u, np.inf)))
        p[free] = p[free] + up * u if rng.random() < down / (up + down) else p[free] - down * u
        p = np.clip(np.where(np.abs(p - np.round(p)) < 1e-9, np.round(p), p), 0, 1)
    free = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))
    if len(free):
        choices = np.array(list(itertools.product((0.0, 1.0), repeat=len(free))))
        total = expected + (choices - p[free]) @ _VECTORS[kind[free]]
        short = np.maximum(minima - total[:, :5] - 1e-6, 0).sum(axis=1)
        off = np.where(np.isnan(wanted), 0.0, total[:, :5] - wanted)
        # a small term prefers likely records, so that ties don't favour one choice
        spread = (np.where(off < -1e-6, 2, 1) * off**2).sum(axis=1) + 0.01 * ((choices - p[free]) ** 2).sum(axis=1)
        p[free] = choices[np.lexsort((spread, np.round(np.abs(total[:, 5] - size), 3), np.round(short, 3)))[0]]
    return np.round(p)


_DRAWN = "config_id int, filename string, mask int, p double, h long, part int"


def draw(pop: DataFrame, configs: DataFrame, shares: DataFrame) -> DataFrame:
    """(config_id, filename, mask): the sample of every request.

    Requests with a null id are left out; null numbers are 0. A request over an empty table, or of size 0 without
    minima, is an empty sample. Draws depend on file names and seeds only up to the partitioning of the input.
    """
    counts = np.zeros(64)
    for r in pop.groupBy("mask").count().collect():  # at most 64 rows
        counts[r["mask"]] = r["count"]
    asked = {}
    for r in requirements(pop, configs, shares).collect():  # five rows a request
        asked.setdefault(r["config_id"], []).append(r)
    names = {c.lower(): i for i, c in enumerate(CATEGORIES)}
    plan: dict[int, tuple] = {}
    for c in configs.where("config_id IS NOT NULL").distinct().collect():
        size = float(c["sample_size"] or 0)
        minima, wanted = np.full(5, float(c["images_per_class"] or 0)), np.full(5, np.nan)
        minima[NEGATIVE] = c["negative_images"] or 0
        for r in asked.get(c["config_id"], []):
            if (i := names.get(r["category"].strip().lower())) is not None and r["target_share"] is not None:
                wanted[i] = r["target_share"] * size
        p = probabilities(counts, size, minima, wanted)
        there = (counts[1:, None] * _VECTORS[1:]).sum(axis=0)
        plan[c["config_id"]] = ((c["sample_seed"] or 0), p, ((p * counts) @ _VECTORS, np.minimum(minima, there[:5]), min(size, there[5]), wanted))
    sent = pop.sparkSession.sparkContext.broadcast(plan)

    def fly(batches):
        names_, masks, hashes = [], [], []
        for b in batches:
            names_.append(b.column(0))
            masks.append(b.column(1).to_numpy().astype(np.int64))
            hashes.append(b.column(2).to_numpy())
            if sum(map(len, masks)) >= 200_000:  # a flight needs no more; what it leaves open is 64 records
                yield from leave(names_, masks, hashes)
                names_, masks, hashes = [], [], []
        if masks:
            yield from leave(names_, masks, hashes)

    def leave(names_, masks, hashes):
        name, mask, h = pa.concat_arrays(names_), np.concatenate(masks), np.concatenate(hashes)
        for config, (seed, p, _) in sent.value.items():
            order = _random(h, seed)
            q = same_kind_flight(mask, p[mask], order)
            take = np.flatnonzero(q > 0)
            if len(take):
                part = TaskContext.get().partitionId() % MERGE
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(take), config), pa.int32()), name.take(pa.array(take)), pa.array(mask[take], pa.int32()), pa.array(q[take]), pa.array(order[take].view(np.int64)), pa.array(np.full(len(take), part), pa.int32())],
                    names=["config_id", "filename", "mask", "p", "h", "part"],
                )

    def again(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("filename", ignore_index=True)
        q = same_kind_flight(pdf["mask"].to_numpy(), pdf["p"].to_numpy(), pdf["h"].to_numpy().view(np.uint64))
        return pdf.assign(p=q)[q > 0]

    def land(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = again(key, pdf).reset_index(drop=True)
        seed, _, aims = sent.value[int(key[0])]
        p = cube(pdf["mask"].to_numpy(), pdf["p"].to_numpy(), np.random.default_rng(seed), *aims)
        return pdf.assign(p=p)[p > 0.5]

    one = cut(pop.where("mask > 0").select("filename", F.col("mask").cast("int").alias("mask"), F.xxhash64("filename").alias("h")).mapInArrow(fly, _DRAWN))
    chosen, open_ = one.where("p >= 1"), one.where("p < 1")
    two = cut(open_.groupBy("config_id", "part").applyInPandas(again, _DRAWN))
    three = two.where("p < 1").groupBy("config_id").applyInPandas(land, _DRAWN)
    return chosen.unionByName(two.where("p >= 1")).unionByName(three).select("config_id", "filename", "mask")


def report(drawn: DataFrame, pop: DataFrame, configs: DataFrame, shares: DataFrame) -> DataFrame:
    """(config_id, category, target_share, required, available, selected, residual, met): a row a named category of a request.

    residual is selected - required, with its sign; met says that it isn't negative. Categories that nobody knows have nothing.
    """
    asked = requirements(pop, configs, shares)
    kinds = drawn.groupBy("config_id", "mask").agg(F.count("*").alias("n"))
    each = kinds.select("config_id", "n", F.explode(F.array(*(F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) > 0, F.lit(c.lower())) for i, c in enumerate(CATEGORIES)))).alias("key")).where("key IS NOT NULL")
    got = each.groupBy("config_id", "key").agg(F.sum("n").alias("selected"))
    out = asked.withColumn("key", norm("category")).join(got, ["config_id", "key"], "left").withColumn("selected", F.coalesce("selected", F.lit(0)))
    return out.select("config_id", "category", "target_share", "required", "available", "selected", (F.col("selected") - F.col("required")).alias("residual"), (F.col("selected") >= F.col("required")).alias("met"))


def integrity(drawn: DataFrame, pop: DataFrame, configs: DataFrame) -> DataFrame:
    """(config_id, repeated, foreign, minima_short, size_met): one row a request, what must hold of any sample.

    repeated: names drawn twice; foreign: names that aren't in the population with these categories; minima_short: classes,
    negatives included, of which fewer than the minimum (or than all there are) were drawn; size_met: the size (or all there
    are) was drawn, or no less than it where minima ask for more.
    """
    asked = configs.where("config_id IS NOT NULL").select("config_id", F.coalesce("sample_size", F.lit(0)).alias("sample_size"), *(F.coalesce("negative_images" if i == NEGATIVE else "images_per_class", F.lit(0)).cast("long").alias(f"m{i}") for i in range(5))).distinct()
    has = lambda i: F.col("mask").bitwiseAND(F.lit(1 << i)) > 0
    there = pop.where("mask > 0").agg(F.count("*").alias("all"), *(F.count_if(has(i)).alias(f"a{i}") for i in range(5)))
    checked = drawn.join(pop.withColumnRenamed("mask", "_mask"), "filename", "left")
    per_name = checked.groupBy("config_id", "filename").agg(F.count("*").alias("times"), F.max("mask").alias("mask"), F.max((F.col("_mask").isNull() | (F.col("_mask") != F.col("mask"))).cast("int")).alias("foreign"))
    got = per_name.groupBy("config_id").agg(F.count_if(F.col("times") > 1).alias("repeated"), F.sum("foreign").alias("foreign"), F.count("*").alias("n"), *(F.count_if(has(i)).alias(f"g{i}") for i in range(5)))
    row = asked.join(got, "config_id", "left").crossJoin(there).na.fill(0)  # one row of counts
    short = sum((F.col(f"g{i}") < F.least(f"m{i}", f"a{i}")).cast("long") for i in range(5))
    least = F.least("sample_size", "all")
    tight = sum((F.least(f"m{i}", f"a{i}") for i in range(1, 5)), F.least("m0", "a0")) > F.col("sample_size")
    return row.select("config_id", "repeated", "foreign", short.alias("minima_short"), ((F.col("n") == least) | (tight & (F.col("n") >= least))).alias("size_met"))
