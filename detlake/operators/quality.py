"""Annotation quality: boxes of image annotations, label text, dispositions and inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detlake.functions.geometry import to_center_size

#: Statuses of objects and images.
RETAIN, NON_TARGET, UNKNOWN = "retain_target", "known_non_target", "quarantine_unknown"


def voc_boxes(rows: DataFrame, corners: list[str], width: Column, height: Column, zero_edge: bool = True, aspects: tuple[float, float] = (0.05, 20.0), tiny: float = 4.0, canvas: int = 640) -> DataFrame:
    """One-based inclusive boxes as text in four columns: adds half_open, normalized, projected, projected_area,
    aspect_ratio and sorted flags; the derived forms are null for boxes with a hard flag.

    The stages are projections of their own, so that later ones read parsed numbers and don't parse again.
    """
    keep = rows.columns
    raw = rows.select(*keep, width.cast("double").alias("_w"), height.cast("double").alias("_h"), *(F.btrim(c).try_cast("decimal(38,18)").alias(f"_n{i}") for i, c in enumerate(corners)))
    n = [F.col(f"_n{i}") for i in range(4)]
    v = [F.col(f"_v{i}") for i in range(4)]
    parsed = raw.select(*keep, "_w", "_h", *(F.when(x == F.floor(x), x.cast("long")).alias(f"_v{i}") for i, x in enumerate(n)), F.array(*(F.when(x.isNull(), "malformed_coordinate").when(x != F.floor(x), "non_integer_coordinate") for x in n)).alias("_f"))
    x1, y1, x2, y2 = v
    edge = lambda c: F.when((c == 0) & F.lit(zero_edge), F.lit(0)).otherwise(c - 1)
    all_there = x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull()
    sized = parsed.select(*keep, "_w", "_h", *v, "_f", all_there.alias("_p"), edge(x1).cast("double").alias("_cx"), edge(y1).cast("double").alias("_cy"), (F.lit(float(canvas)) / F.greatest("_w", "_h")).alias("_s"))
    w, h, low = x2 - F.col("_cx"), y2 - F.col("_cy"), 0 if zero_edge else 1
    zero = (x1 == 0) | (y1 == 0)
    hard = {
        "negative_coordinate": F.least(*v) < 0, "zero_coordinate": (x2 == 0) | (y2 == 0) | (zero & F.lit(not zero_edge)), "inverted_box": (x2 < x1) | (y2 < y1),
        "zero_area_box": (w <= 0) | (h <= 0), "out_of_bounds": (x1 < low) | (y1 < low) | (x2 > F.col("_w")) | (y2 > F.col("_h")),
    }
    flagged = sized.select("*", F.when(F.col("_p"), F.filter(F.array(F.when(zero & F.lit(zero_edge), "source_zero_edge_coordinate"), *(F.when(c, name) for name, c in hard.items())), lambda f: f.isNotNull())).otherwise(F.array().cast("array<string>")).alias("_g"))
    sound = F.col("_p") & (F.size("_g") == F.size(F.filter("_g", lambda f: f == "source_zero_edge_coordinate")))
    measured = flagged.select("*", sound.alias("_ok")).select("*", F.when(F.col("_ok"), w / h).alias("aspect_ratio"), F.when(F.col("_ok"), (w * F.col("_s")) * (h * F.col("_s"))).alias("projected_area"))
    cx, cy, s = F.col("_cx"), F.col("_cy"), F.col("_s")
    pad_x, pad_y = (F.lit(float(canvas)) - F.col("_w") * s) / 2, (F.lit(float(canvas)) - F.col("_h") * s) / 2
    soft = F.array(F.when((F.col("aspect_ratio") < F.lit(aspects[0])) | (F.col("aspect_ratio") > F.lit(aspects[1])), "unusual_aspect_ratio"), F.when(F.col("projected_area") < F.lit(tiny), "extremely_tiny"))
    return measured.select(
        *keep, F.when(F.col("_ok"), F.array(cx.cast("long"), cy.cast("long"), x2, y2)).alias("half_open"), F.when(F.col("_ok"), F.array(cx / F.col("_w"), cy / F.col("_h"), x2 / F.col("_w"), y2 / F.col("_h"))).alias("normalized"),
        F.when(F.col("_ok"), F.array(cx * s + pad_x, cy * s + pad_y, x2 * s + pad_x, y2 * s + pad_y)).alias("projected"), "projected_area", "aspect_ratio",
        F.array_sort(F.array_distinct(F.filter(F.concat("_f", "_g", soft), lambda f: f.isNotNull()))).alias("flags"),
    )


def action(raw_class: Column, targets: list[str], non_targets: list[str]) -> Column:
    return F.when(raw_class.isin(targets), RETAIN).when(raw_class.isin(non_targets), NON_TARGET).otherwise(UNKNOWN)


def image_categories(objects: DataFrame) -> DataFrame:
    """Category and inclusion of images from (image_id, action, status); images come from their objects.

    Statuses: retain_target, reject..., quarantine...; an unknown class or a quarantined target quarantines the image.
    """
    is_ = lambda s: F.col("action") == s
    c = objects.groupBy("image_id").agg(
        F.count_if(is_(RETAIN)).alias("targets"), F.count_if(is_(RETAIN) & (F.col("status") == RETAIN)).alias("valid_targets"), F.count_if(is_(RETAIN) & F.col("status").startswith("reject")).alias("rejected_targets"),
        F.count_if(is_(RETAIN) & F.col("status").startswith("quarantine")).alias("quarantined_targets"), F.count_if(is_(NON_TARGET)).alias("non_targets"), F.count_if(is_(UNKNOWN)).alias("unknown"), F.count("*").alias("objects"),
    )
    bad = (F.col("unknown") > 0) | (F.col("quarantined_targets") > 0)
    valid, known = F.col("valid_targets") > 0, F.col("non_targets") > 0
    category = F.when(bad, "quarantined").when(valid & known, "mixed_target_and_known_non_target").when(valid, "target_only").when(known, "known_non_target_only").otherwise("empty_xml")
    return c.select("*", category.alias("image_category"), (~bad & valid).alias("is_positive"), (~bad & ~valid).alias("is_negative"), F.when(bad, "quarantined").otherwise("retained").alias("inclusion_status"))


def override(objects: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """Objects with status replaced where a rule (keys, new_status) names them; rules are a small stated table."""
    return objects.join(rules.select(*keys, "new_status"), keys, "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def label_line(class_id: Column, box, width: Column, height: Column, places: int = 8) -> Column:
    """``class cx cy w h`` with fixed decimals; null for boxes that can't be written."""
    c = to_center_size(box, width, height)
    return F.when(c.isNotNull(), F.concat_ws(" ", class_id.cast("string"), *(F.format_string(f"%.{places}f", c[n]) for n in ("cx", "cy", "w", "h"))))


def label_text(boxes: DataFrame, by: list[str], line: str, order: list[str]) -> DataFrame:
    """One text per image: its lines in order, each ended by a line feed."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(line).alias("_l")))), lambda r: r["_l"])
    return boxes.groupBy(*by).agg(F.concat(F.array_join(rows, "\n"), F.lit("\n")).alias("label_text"))


def parse_labels(texts: DataFrame, text: str) -> DataFrame:
    """Lines of label texts: all columns but the text, line_number, class_id, cx, cy, w, h; blank lines don't count."""
    keep = [c for c in texts.columns if c != text]
    lines = texts.select(*keep, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("n", "line")).where(F.btrim("line") != "")
    part = F.split(F.btrim("line"), r"\s+")
    number = lambda i: F.try_element_at(part, F.lit(i + 1)).try_cast("double")
    return lines.select(*keep, (F.col("n") + 1).alias("line_number"), F.try_element_at(part, F.lit(1)).try_cast("int").alias("class_id"), *(number(i + 1).alias(c) for i, c in enumerate(("cx", "cy", "w", "h"))), F.size(part).alias("fields"), "line")


def label_errors(texts: DataFrame, text: str, places: int | None = None, classes: int = 4) -> DataFrame:
    """Lines of label texts with the list of what is wrong with them (empty for good lines)."""
    tolerance = 0.5 * 10.0 ** -(places or 12) + 1e-12
    n = {c: F.col(c) for c in ("cx", "cy", "w", "h")}
    numeric = F.col("class_id").isNotNull() & n["cx"].isNotNull() & n["cy"].isNotNull() & n["w"].isNotNull() & n["h"].isNotNull()
    five = F.col("fields") == 5
    finite = numeric
    for c in n.values():
        finite = finite & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    out = F.lit(False)
    for c, s in (("cx", "w"), ("cy", "h")):
        out = out | (n[c] - n[s] / 2 < -tolerance) | (n[c] + n[s] / 2 > 1 + tolerance)
    ok = five & finite
    checks = [
        F.when(~five, "field_count"), F.when(five & ~numeric, "non_numeric"), F.when(five & numeric & ~F.col("class_id").between(0, classes - 1), "class_id"), F.when(five & numeric & ~finite, "non_finite"),
        F.when(ok & ~(n["cx"].between(0, 1) & n["cy"].between(0, 1)), "center_bounds"), F.when(ok & ~((n["w"] > 0) & (n["w"] <= 1) & (n["h"] > 0) & (n["h"] <= 1)), "size_bounds"), F.when(ok & out, "box_bounds"),
    ]
    if places is not None:
        checks.append(F.when(five & numeric & ~F.btrim("line").rlike(r"^\S+(\s+\S*\.\d{%d}){4}$" % places), "precision"))
    return parse_labels(texts, text).withColumn("errors", F.filter(F.array(*checks), lambda e: e.isNotNull()))


def class_inventory(objects: DataFrame, name: str, by: list[str]) -> DataFrame:
    """(by, name, objects, images): how often each class occurs and on how many images."""
    return objects.groupBy(*by, name).agg(F.count("*").alias("objects"), F.count_distinct("image_id").alias("images"))


def pair_integrity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(stem, left_count, right_count, problem) of case-folded keys that don't pair one to one."""
    count = lambda df, n: df.where(F.col(key).isNotNull()).groupBy(F.lower(key).alias("stem")).agg(F.count("*").alias(n))
    j = count(left, "left_count").join(count(right, "right_count"), "stem", "full_outer").na.fill(0, ["left_count", "right_count"])
    problem = F.when(F.col("left_count") == 0, "missing_left").when(F.col("right_count") == 0, "missing_right").when((F.col("left_count") > 1) | (F.col("right_count") > 1), "duplicate_stem")
    return j.withColumn("problem", problem).where("problem IS NOT NULL")


def histogram(rows: DataFrame, value: str, thresholds: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, bucket, count) with buckets [a, b) between thresholds and [last, inf); smaller values and nulls don't count."""
    number = F.size(F.filter(F.array(*(F.lit(float(t)) for t in thresholds)), lambda t: t <= F.col(value)))
    labels = [f"[{a:g},{b:g})" for a, b in zip(thresholds, thresholds[1:])] + [f"[{thresholds[-1]:g},inf)"]
    counted = rows.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.col(value) >= float(thresholds[0]))).groupBy(*(by or []), number.alias("i")).agg(F.count("*").alias("count"))
    return counted.select(*(by or []), F.element_at(F.array(*map(F.lit, labels)), F.col("i")).alias("bucket"), "count")


def disposition_matrix(objects: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of (row, column) with one column a value; stated values keep the pivot to one pass."""
    return objects.groupBy(row).pivot(column, values).count().na.fill(0)
