"""Composed runs and validators: a whole construction, and checks of exports and runs as one relation of broken rules.

A validator gives (key, rule) rows. Every rule is an expression over one aggregated row a key or an equi-join with such rows,
so a check costs one shuffle a table however many rules it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from detlake.functions import keys as k
from detlake.operators import grouping
from detlake.session import norm


def broken(rows: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """(keys, rule) of every rule whose condition holds; a null condition doesn't."""
    names = F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items()))
    return rows.select(*keys, F.explode(F.filter(names, lambda n: n.isNotNull())).alias("rule"))


def construct(records: DataFrame, grouped: DataFrame, assigned: DataFrame, numeric: int, seconds: int, block: int) -> DataFrame:
    """(canonical_image_id, country, capture_group, split, status, reasons): what becomes of every image record.

    records (canonical_image_id, country, inclusion_status), grouped the result of ``grouping.capture_groups``, assigned
    (canonical_image_id, split). Quarantined images and those without a split keep that status; images next to a group
    of another split are excluded by the guard; all others are retained.
    """
    guard = grouping.boundary_guard(grouped, assigned, numeric=numeric, seconds=seconds, block=block)
    j = records.join(grouped.select("canonical_image_id", "capture_group"), "canonical_image_id", "left").join(assigned.select("canonical_image_id", "split"), "canonical_image_id", "left").join(guard, "canonical_image_id", "left")
    status = F.when(F.col("inclusion_status") == "quarantined", "quarantined").when(F.col("split").isNull(), "unassigned").when(F.col("reasons").isNotNull(), "guard_excluded").otherwise("retained")
    return j.select("canonical_image_id", "country", "capture_group", "split", status.alias("status"), F.coalesce(F.array_join("reasons", ";"), F.lit("")).alias("reasons"))


def export_violations(entries: DataFrame, records: DataFrame) -> DataFrame:
    """(canonical_image_id, rule) of an export: entries against the records they come from, their labels and each other.

    entries (canonical_image_id, split, width, height, source_image_sha256, exported_image_relative_path, is_positive,
    label_text) may repeat; records (canonical_image_id, inclusion_status, decoded_width, decoded_height, image_sha256,
    capture_group) are one an image.
    """
    split = F.when(norm("split") == "validation", "val").otherwise(norm("split"))
    e = entries.where("canonical_image_id IS NOT NULL").groupBy("canonical_image_id").agg(
        F.collect_set(split).alias("splits"), F.max("width").alias("width"), F.max("height").alias("height"), F.max(norm("source_image_sha256")).alias("sha"),
        F.min("exported_image_relative_path").alias("path"), F.max("is_positive").alias("positive"), F.max("label_text").alias("label"),
    )
    r = records.select("canonical_image_id", "inclusion_status", "decoded_width", "decoded_height", norm("image_sha256").alias("image_sha"), norm("capture_group").alias("capture_group"), F.lit(True).alias("known"))
    j = e.withColumn("exported", F.lit(True)).join(r, "canonical_image_id", "full_outer")
    out = F.col("exported").isNotNull()
    boxes = F.btrim(F.coalesce("label", F.lit("")), F.lit(" \t\r\n")) != ""
    rules = {
        "unknown_image": out & F.col("known").isNull(), "not_retained": out & (F.col("inclusion_status") != "retained"), "not_exported": ~out & (F.col("inclusion_status") == "retained"),
        "split_unknown": out & (F.size(F.array_intersect("splits", F.array(*map(F.lit, grouping.SPLITS)))) == 0), "split_conflict": F.size("splits") > 1,
        "size_mismatch": (F.col("width") != F.col("decoded_width")) | (F.col("height") != F.col("decoded_height")), "hash_mismatch": F.col("sha") != F.col("image_sha"), "label_missing": out & F.col("label").isNull(),
        "positive_without_boxes": out & F.col("positive") & ~boxes, "negative_with_boxes": out & ~F.col("positive") & boxes,
    }
    single = broken(j, ["canonical_image_id"], rules)
    paths = e.where("path IS NOT NULL").groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
    repeated = e.select("canonical_image_id", "path").join(paths, "path").select("canonical_image_id", F.lit("path_repeated").alias("rule"))
    placed = j.where("capture_group IS NOT NULL").select("canonical_image_id", "capture_group", F.explode("splits").alias("split"))
    torn = placed.groupBy("capture_group").agg(F.count_distinct("split").alias("n")).where("n > 1")
    apart = placed.select("canonical_image_id", "capture_group").distinct().join(torn, "capture_group").select("canonical_image_id", F.lit("group_conflict").alias("rule"))
    return single.unionByName(repeated).unionByName(apart)


def run_violations(detections: DataFrame, videos: DataFrame) -> DataFrame:
    """(video_id, rule, n): observations of analysed videos that contradict their run, and runs that didn't reach their end.

    videos (video_id, fps, frame_count) are one a video. ``incomplete`` counts the frames after the last observed one.
    """
    v = videos.select("video_id", "fps", "frame_count", F.lit(True).alias("known"))
    d = detections.where("video_id IS NOT NULL").select("detection_id", "video_id", "frame_index", "detection_index", "timestamp_ms").distinct().join(v, "video_id", "left")
    expected = F.when(F.col("fps") > 0, k.frame_ms(F.col("frame_index"), F.col("fps")))
    rules = {
        "unknown_video": F.col("known").isNull(), "negative_frame": F.col("frame_index") < 0, "beyond_end": F.col("frame_index") >= F.col("frame_count"), "clock": F.abs(F.col("timestamp_ms") - expected) > 1,
        "no_time": F.col("timestamp_ms").isNull(),
    }
    rows = broken(d, ["video_id"], rules)
    again = d.where("detection_index IS NOT NULL").groupBy("video_id", "frame_index", "detection_index").agg((F.count_distinct("detection_id") - 1).alias("n")).where("n > 0")
    ended = d.where("frame_count IS NOT NULL").groupBy("video_id").agg((F.max("frame_count") - 1 - F.max("frame_index")).alias("n")).where("n > 0")
    return (
        rows.groupBy("video_id", "rule").agg(F.count("*").alias("n"))
        .unionByName(again.groupBy("video_id").agg(F.sum("n").alias("n")).withColumn("rule", F.lit("repeated_index")))
        .unionByName(ended.withColumn("rule", F.lit("incomplete")))
    )


def support_by_site(lines: DataFrame, records: DataFrame) -> DataFrame:
    """(country, class_id, boxes, images, groups): boxes of each class, and the images and capture groups that show it."""
    j = lines.join(records.select("canonical_image_id", F.col("country").alias("_c"), norm("capture_group").alias("g")), "canonical_image_id", "left")
    return j.groupBy(F.col("_c").alias("country"), "class_id").agg(F.count("*").alias("boxes"), F.count_distinct("canonical_image_id").alias("images"), F.count_distinct("g").alias("groups"))


def availability(requested: DataFrame, decoded: DataFrame, keys: list[str]) -> DataFrame:
    """Requested frames with whether they were decoded; a frame that wasn't is a warning and no error."""
    there = decoded.select(*keys).distinct().withColumn("decoded", F.lit(True))
    j = requested.join(there, keys, "left").withColumn("decoded", F.coalesce("decoded", F.lit(False)))
    return j.withColumn("warning", F.when(~F.col("decoded"), "frame_not_decoded"))


def open_at(events: DataFrame, keys: list[str], frame: int, gap_frames: int) -> DataFrame:
    """Events that are open when a frame arrives: begun before or in it, and not too long silent."""
    return events.where((F.col("first_frame") <= frame) & (F.lit(frame) - F.col("last_frame") - 1 <= gap_frames)).select(*keys, "first_frame", "last_frame")


def refinement_terms(counts: DataFrame, ratios: dict[str, float], weights: dict[str, float], tolerance: tuple[float, float] = (2.0, 5.0)) -> DataFrame:
    """(split, term, points, value): the parts of the refinement's objective, from (split, feature, n).

    Deviations are in percentage points: of a split's size from its ratio, of a country's share in it from its share of all
    images, of its part of a class or polarity from its ratio. What exceeds the tolerance counts again with its own weight.
    """
    goal = F.create_map(*(x for s, r in ratios.items() for x in (F.lit(s), F.lit(float(r)))))
    total = F.sum("n").over(W.partitionBy("feature"))
    images = lambda part: F.sum(F.when(F.col("feature") == "images", F.col("n"))).over(part)
    j = counts.withColumn("_total", total).withColumn("_images", images(W.partitionBy("split"))).withColumn("_all", images(W.partitionBy(F.lit(0))))  # a row a split and feature
    kind = F.split("feature", ":")[0]
    part = F.lit(100.0) * F.col("n") / F.col("_total") - F.lit(100.0) * F.try_element_at(goal, F.col("split"))
    share = F.lit(100.0) * F.try_divide(F.col("n"), F.col("_images")) - F.lit(100.0) * F.col("_total") / F.col("_all")
    points = F.when(kind == "country", share).otherwise(part)
    weight = F.when(kind == "images", weights["ratio"]).when(kind == "country", weights["country"]).when(kind == "class", weights["class"]).when(kind == "polarity", weights["polarity"])
    beyond = F.greatest(F.lit(0.0), F.abs("points") - F.when(F.col("kind") == "images", tolerance[0]).otherwise(tolerance[1]))
    rows = j.select("split", F.col("feature").alias("term"), kind.alias("kind"), points.alias("points"), weight.alias("w")).where("w IS NOT NULL")
    extra = F.when(F.col("kind").isin("images", "country"), F.lit(weights["violation"]) * beyond * beyond).otherwise(0.0)
    return rows.select("split", "term", "points", (F.col("w") * F.col("points") * F.col("points") + extra).alias("value"))
