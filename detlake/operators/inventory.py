"""Inventories of label files and exports: decoded boxes, sample classes, export plans and record layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from detlake.functions.geometry import from_center_size
from detlake.operators.quality import parse_labels


def decoded_boxes(images: DataFrame, key: str = "image_id") -> DataFrame:
    """Label lines of images (key, label_text, width, height) as pixel boxes: key, line_number, class_id, x1, y1, x2, y2."""
    lines = parse_labels(images.select(key, "label_text", "width", "height"), "label_text")
    box = from_center_size(*(F.col(c) for c in ("cx", "cy", "w", "h")), F.col("width"), F.col("height"))
    return lines.select(key, "line_number", "class_id", *(c.alias(n) for c, n in zip(box, ("x1", "y1", "x2", "y2"))))


def sample_inventory(images: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, class_id, objects, max_area) of label texts, class_id null for images without lines."""
    lines = parse_labels(images.select(key, "label_text"), "label_text").groupBy(key, "class_id").agg(F.count("*").alias("objects"), F.max(F.col("w") * F.col("h")).alias("max_area"))
    return images.select(key).distinct().join(lines, key, "left").select(key, "class_id", F.coalesce("objects", F.lit(0)).alias("objects"), "max_area")


def clipped(detections: DataFrame, width, height) -> DataFrame:
    """Pixel boxes (x1, y1, x2, y2) rounded half to even and clipped to the frame; confidence clipped to 0..1."""
    clip = lambda c, most: F.greatest(F.lit(0), F.least(F.bround(F.col(c)).cast("long"), most)).cast("long")
    return detections.withColumns({"x1": clip("x1", width), "y1": clip("y1", height), "x2": clip("x2", width), "y2": clip("y2", height), "confidence": F.greatest(F.lit(0.0), F.least(F.col("confidence"), F.lit(1.0)))})


def frame_records(observations: DataFrame, by: list[str], order: str, fields: list[str]) -> DataFrame:
    """One row a frame with its detections nested in order."""
    return observations.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(order, *(f for f in fields if f != order)))).alias("detections"))


def detection_line(seconds: str, *numbers: str):
    """A log line: seconds with three decimals, then the columns with nine significant digits, comma-separated."""
    return F.concat_ws(",", F.format_string("%.3f", F.col(seconds)), *(F.format_string("%.9g", F.col(n).cast("double")) for n in numbers))


def export_plan(images: DataFrame, assigned: DataFrame, labels: DataFrame) -> DataFrame:
    """Retained images joined with split and label: id, split, path, lines, label hash, and what is missing."""
    j = images.select("canonical_image_id", "original_filename").join(assigned.select("canonical_image_id", "split"), "canonical_image_id", "left").join(labels.select("canonical_image_id", "label_text"), "canonical_image_id", "left")
    text = F.coalesce("label_text", F.lit(""))
    problem = F.when(F.col("split").isNull(), "no_split").when(~F.col("split").isin("train", "val", "test"), "unknown_split").when(F.col("label_text").isNull(), "no_label")
    return j.select("canonical_image_id", "split", F.concat_ws("/", F.lit("images"), "split", "original_filename").alias("path"), F.size(F.filter(F.split(text, "\n"), lambda x: F.btrim(x) != "")).alias("lines"), F.sha2(text, 256).alias("label_sha256"), problem.alias("problem"))


def extremes(rows: DataFrame, by: list[str], value: str, tie: str, n: int) -> DataFrame:
    """The n smallest and n largest rows of each group: by, end, rank, tie, value."""
    def side(name: str, order) -> DataFrame:
        rank = F.row_number().over(W.partitionBy(*by).orderBy(order, tie))
        return rows.where(F.col(value).isNotNull()).withColumn("rank", rank).where(F.col("rank") <= n).select(*by, F.lit(name).alias("end"), "rank", tie, value)

    return side("smallest", F.col(value).asc()).unionByName(side("largest", F.col(value).desc()))


def split_objective(features: DataFrame, ratios: dict[str, float], weights: dict[str, float]) -> DataFrame:
    """(split, feature, n, target, penalty) of (split, feature, n): weighted squared relative deviation from the ratio."""
    total = features.groupBy("feature").agg(F.sum("n").alias("total"))
    ratio = F.create_map(*(x for s, r in ratios.items() for x in (F.lit(s), F.lit(float(r)))))
    weight = F.create_map(*(x for s, r in weights.items() for x in (F.lit(s), F.lit(float(r)))))
    j = features.join(total, "feature").withColumn("target", F.col("total") * F.try_element_at(ratio, F.col("split")))
    off = (F.col("n") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0))
    return j.select("split", "feature", "n", "target", (F.try_element_at(weight, F.split("feature", ":")[0]) * off * off).alias("penalty"))
