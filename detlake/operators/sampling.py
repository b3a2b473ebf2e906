"""Deterministic samples, temporal bins and frame grids. Limits here are what the operators are for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from detlake.functions.keys import frame_at, require, seeded_rank
from detlake.operators import ordered


def hash_sample(rows: DataFrame, key: str, n: int, seed: int, salt: str) -> DataFrame:
    """The first n rows by SHA-256 of ``seed:salt:key`` (an ordered limit: partial top-n per partition)."""
    require(n >= 0, "a sample size can't be negative")
    return rows.withColumn("rank_key", seeded_rank(seed, F.lit(salt), F.col(key))).orderBy("rank_key", key).limit(n)


def stratified_sample(rows: DataFrame, strata: list[str], key: str, n: int, seed: int) -> DataFrame:
    """The first n rows of each stratum in seeded hash order, with their rank."""
    rank = F.row_number().over(W.partitionBy(*strata).orderBy("rank_key", key))
    return rows.withColumn("rank_key", seeded_rank(seed, F.col(key))).withColumn("rank", rank).where(F.col("rank") <= n)


def class_showcase(samples: DataFrame, classes: list[int], per_class: int, negatives: int, seed: int) -> DataFrame:
    """(filename, chosen_for, rank): per class the samples with the largest object of it, none twice; then negatives.

    ``samples`` is (filename, areas map<int,double>, negative). Classes are served in turn, so a class can't take what
    an earlier one has; only the few rows of earlier classes are excluded from later ones.
    """
    ranked = samples.withColumn("rank_key", seeded_rank(seed, F.col("filename")))
    taken: DataFrame | None = None
    for c in classes:
        pool = ranked.where(F.try_element_at("areas", F.lit(c)).isNotNull())
        pool = pool if taken is None else pool.join(F.broadcast(taken.select("filename")), "filename", "left_anti")  # a few rows a class
        best = pool.orderBy(F.try_element_at("areas", F.lit(c)).desc(), "rank_key", F.lower("filename")).limit(per_class)
        best = best.select("filename", F.lit(str(c)).alias("chosen_for"), F.row_number().over(W.orderBy(F.try_element_at("areas", F.lit(c)).desc(), "rank_key", F.lower("filename"))).alias("rank"))
        taken = best if taken is None else taken.unionByName(best)
    none = ranked.where("negative").orderBy("rank_key", F.lower("filename")).limit(negatives)
    none = none.select("filename", F.lit("negative").alias("chosen_for"), F.row_number().over(W.orderBy("rank_key", F.lower("filename"))).alias("rank"))
    return none if taken is None else taken.unionByName(none)


def covering_sample(samples: DataFrame, positives: int, negatives: int, quota: int, seed: int) -> DataFrame:
    """(filename, role) of a sample that covers all classes and countries before it fills up in seeded hash order.

    ``samples`` is (filename, country, classes array<int>, rare boolean, positive boolean). Roles: rare (the first ``quota``
    rare positives), class (best hash rank among those that add most missing classes), country, fill, negative. The cover
    is greedy over candidates reduced to one row per (class set, country), so the driver sees a bounded number of rows.
    """
    ranked = samples.withColumn("rank_key", seeded_rank(seed, F.col("filename")))
    pos, neg = ranked.where("positive"), ranked.where("NOT positive")
    rare = pos.where("rare").orderBy("rank_key", "filename").limit(quota).collect()
    require(len(rare) == quota, "too few rare positives")
    chosen: dict[str, str] = {r["filename"]: "rare" for r in rare}
    rows = {r["filename"]: r for r in rare}
    bits = F.aggregate(F.array_distinct("classes"), F.lit(0), lambda a, c: a.bitwiseOR(F.pow(F.lit(2), c).cast("int")))
    first = pos.withColumn("bits", bits).withColumn("n", F.row_number().over(W.partitionBy("bits", "country").orderBy("rank_key", "filename")))
    # a chosen row may be the first of its kind, so a kind keeps as many rows as may have been chosen before it
    heads = first.where(F.col("n") <= quota + 8).collect()
    wanted = {c for r in heads for c in r["classes"]} - {c for r in rare for c in r["classes"]}
    while wanted:
        best = min((r for r in heads if r["filename"] not in chosen and wanted & set(r["classes"])), key=lambda r: (-len(wanted & set(r["classes"])), r["rank_key"], r["filename"]), default=None)
        require(best is not None, "a class can't be covered")
        chosen[best["filename"]], rows[best["filename"]] = "class", best
        wanted -= set(best["classes"])
    countries = {r["country"] for r in heads}
    for country in sorted(countries - {r["country"] for r in rows.values()}):
        pool = [r for r in heads if r["country"] == country and r["filename"] not in chosen]
        if pool and len(chosen) < positives:
            best = min(pool, key=lambda r: (r["rank_key"], r["filename"]))
            chosen[best["filename"]], rows[best["filename"]] = "country", best
    require(len(chosen) <= positives, "the constraints ask for more positives than wanted")
    spark = samples.sparkSession
    picked = spark.createDataFrame(list(chosen.items()), "filename string, role string")
    fill = pos.join(F.broadcast(picked), "filename", "left_anti").orderBy("rank_key", "filename").limit(positives - len(chosen)).select("filename", F.lit("fill").alias("role"))
    none = neg.orderBy("rank_key", "filename").limit(negatives).select("filename", F.lit("negative").alias("role"))
    return picked.unionByName(fill).unionByName(none)


def temporal_bins(rows: DataFrame, by: list[str], order: str, bins: int, block: int = 4096) -> DataFrame:
    """Add bin 1..bins of equal counts: bin b of n rows holds positions [b n / bins, (b + 1) n / bins)."""
    at = ordered.numbered(rows, by, order, [], block, "_i")
    # the bin of position i (from 0) is the largest b with floor(b n / bins) <= i, so both come from i and n alone
    number = F.floor((F.col("_i") * bins - 1) / F.col("_i_of"))
    edge = lambda b: F.floor(b * F.col("_i_of") / bins)
    return at.withColumn("bin", (number + 1).cast("int")).withColumn("bin_size", edge(F.col("bin")) - edge(F.col("bin") - 1)).drop("_i", "_i_of")


def normalized_rank(value: Column, by: list[str], tie: Column) -> Column:
    """Rank from 0 to 1 within a group, a lone row 0.5."""
    w = W.partitionBy(*by)
    n = F.count("*").over(w)
    return F.when(n == 1, F.lit(0.5)).otherwise((F.row_number().over(w.orderBy(value, tie)) - 1) / F.greatest(n - 1, F.lit(1)))


def representatives(rows: DataFrame, by: list[str], order: str, bins: int, weights: dict[str, float]) -> DataFrame:
    """One row per bin: the best weighted sum of within-bin ranks of the named columns, ties to the earliest."""
    binned = temporal_bins(rows, by, order, bins)
    score = F.lit(0.0)
    for column, weight in weights.items():
        score = score + normalized_rank(F.coalesce(F.col(column).cast("double"), F.lit(0.0)), [*by, "bin"], F.col(order)) * F.lit(float(weight))
    scored = binned.withColumn("score", score)
    best = F.row_number().over(W.partitionBy(*by, "bin").orderBy(F.desc("score"), order))
    return scored.withColumn("_n", best).where("_n = 1").drop("_n")


def interval_frames(videos: DataFrame, seconds: float, margin_seconds: float) -> DataFrame:
    """(video_id, frame_index) at a fixed interval inside the margins; videos need a rate and at least three frames."""
    require(seconds > 0 and margin_seconds >= 0, "interval and margin outside their domain")
    v = videos.where("fps > 0 AND frame_count >= 3")
    step = F.greatest(F.lit(1), F.bround(F.lit(seconds) * F.col("fps")).cast("long"))
    margin = F.greatest(F.lit(1), F.bround(F.lit(margin_seconds) * F.col("fps")).cast("long"))
    v = v.select("video_id", "frame_count", step.alias("step"), margin.alias("margin")).where("margin < frame_count - margin")
    return v.select("video_id", F.explode(F.sequence(F.col("margin"), F.col("frame_count") - F.col("margin") - 1, F.col("step"))).alias("frame_index"))


def distributed_frames(videos: DataFrame, n: int) -> DataFrame:
    """(video_id, sample, frame_index): n evenly spread frames a second away from the ends where there is room."""
    require(n > 0, "a sample count must be positive")
    v = videos.where((F.col("fps") > 0) & (F.col("frame_count") >= 3) & (F.col("frame_count") - 2 >= n))
    last = F.col("frame_count") - 1
    margin = F.least(F.greatest(F.lit(1), F.bround("fps").cast("long")), F.floor((last - 1) / 2))
    tight = last - 2 * margin + 1 < n
    start = F.when(tight, F.lit(1)).otherwise(margin)
    end = F.when(tight, last - 1).otherwise(last - margin)
    v = v.select("video_id", start.cast("long").alias("lo"), end.cast("long").alias("hi"))
    if n == 1:
        return v.select("video_id", F.lit(0).alias("sample"), F.floor((F.col("lo") + F.col("hi")) / 2).cast("long").alias("frame_index"))
    v = v.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return v.select("video_id", "sample", (F.col("lo") + F.floor(((F.col("hi") - F.col("lo")) * F.col("sample") + (n - 1) // 2) / (n - 1))).cast("long").alias("frame_index"))


def candidate_frames(specs: DataFrame, avoid: DataFrame) -> DataFrame:
    """(video_id, spec, frame_index) at a fixed rate in each window, less the frames inside an avoided range.

    specs: video_id, spec, start, end, before, after, rate, fps, frame_count; avoid: video_id, start, end (inclusive).
    """
    first = F.greatest(F.lit(0.0), F.col("start") - F.col("before"))
    stop = F.least((F.col("frame_count") - 1) / F.col("fps"), F.col("end") + F.col("after"))
    step = F.greatest(F.lit(1), F.bround(F.col("fps") / F.col("rate")).cast("long"))
    s = specs.select("video_id", "spec", "fps", frame_at(first, F.col("fps")).alias("a"), F.least(F.col("frame_count") - 1, frame_at(stop, F.col("fps"))).alias("b"), step.alias("step")).where("a <= b")
    frames = s.select("video_id", "spec", "fps", F.explode(F.sequence("a", "b", "step")).alias("frame_index"))
    r = avoid.select(F.col("video_id").alias("v"), F.col("start").alias("s"), F.col("end").alias("e"))
    at = F.col("frame_index") / F.col("fps")
    return frames.join(r, (F.col("video_id") == F.col("v")) & (at >= F.col("s")) & (at <= F.col("e")), "left_anti").select("video_id", "spec", "frame_index")


def lag_difference(rows: DataFrame, by: list[str], order: str, value: str, block: int = 3600) -> DataFrame:
    """Absolute difference to the previous row that has a value; rows without one are left out.

    Rows are ordered within blocks of the order column, so no task orders a whole group.
    """
    before = ordered.previous(rows.where(F.col(value).isNotNull()), by, order, [], value, block, "_p")
    return before.withColumn("difference", F.abs(F.col(value) - F.col("_p"))).drop("_p")
