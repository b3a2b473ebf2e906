"""Registered queries of inventories, caches and consistency, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from detlake.functions import pixels
from detlake.operators import grouping, inventory, quality, reconcile, temporal
from detlake.plans import curation as c
from detlake.plans.adapters import relation, with_clause
from detlake.session import cut, norm, table


def _exports(s, d):
    """One row an exported image."""
    e = table(s, d, "export_entries").where("canonical_image_id IS NOT NULL")
    return e.groupBy("canonical_image_id").agg(F.max("label_text").alias("label_text"), F.max("width").alias("width"), F.max("height").alias("height"), F.max(norm("source_image_sha256")).alias("sha"))


def decoded_labels(s, d):
    out = inventory.decoded_boxes(_exports(s, d), "canonical_image_id")
    return out.select("canonical_image_id", "line_number", "class_id", *(F.round(x, 6).alias(x) for x in ("x1", "y1", "x2", "y2")))


def sample_inventory(s, d):
    return inventory.sample_inventory(_exports(s, d), "canonical_image_id").withColumn("max_area", F.round("max_area", 9))


def clipped_boxes(s, d):
    b = F.col("bbox_xyxy_pixel")
    rows = table(s, d, "detections").select("detection_id", "confidence", *(F.get(b, F.lit(i)).alias(x) for i, x in enumerate(("x1", "y1", "x2", "y2")))).distinct()
    for x in ("confidence", "x1", "y1", "x2", "y2"):
        rows = rows.where(F.abs(x) < F.lit(1e12))
    return inventory.clipped(rows, F.lit(1280), F.lit(720))


def frame_records(s, d):
    obs = c._observations(s, d)
    rows = inventory.frame_records(obs, ["video_id", "frame_index"], "detection_id", ["detection_id", "class_id"])
    return rows.select("video_id", "frame_index", F.size("detections").alias("n"), F.array_join(F.transform("detections", lambda x: F.concat_ws(":", x["detection_id"], x["class_id"])), ";").alias("detections"))


def detection_lines(s, d):
    obs = c._observations(s, d).withColumn("seconds", F.col("timestamp_ms") / F.lit(1000.0))
    return obs.select("detection_id", F.format_string("%.3f", F.col("seconds")).alias("seconds"))


def export_plan(s, d):
    retained = c._records(s, d).where("inclusion_status = 'retained'")
    return inventory.export_plan(retained, c._splits(s, d), c._labels(s, d))


def hash_mismatches(s, d):
    i = c._records(s, d).select("canonical_image_id", norm("image_sha256").alias("image_sha"))
    return _exports(s, d).select("canonical_image_id", "sha").join(i, "canonical_image_id").where("NOT sha <=> image_sha")


def guard_losses(s, d):
    r = c._records(s, d).select(F.coalesce("country", F.lit("unknown")).alias("country"), (F.col("inclusion_status") == "guard_excluded").alias("lost"))
    g = r.groupBy("country").agg(F.count("*").alias("images"), F.count_if("lost").alias("lost"))
    return g.withColumn("percent", F.round(F.lit(100.0) * F.col("lost") / F.col("images"), 9))


def dimension_distribution(s, d):
    r = c._records(s, d).where("decoded_width IS NOT NULL AND decoded_height IS NOT NULL")
    shape = F.when(F.col("decoded_width") > F.col("decoded_height"), "landscape").when(F.col("decoded_width") < F.col("decoded_height"), "portrait").otherwise("square")
    return r.groupBy("decoded_width", "decoded_height", shape.alias("orientation")).agg(F.count("*").alias("images"))


def repeated_filenames(s, d):
    r = c._records(s, d).where("original_filename IS NOT NULL").select(F.lower("original_filename").alias("name"))
    return reconcile.repeated_keys(r, ["name"])


def extreme_boxes(s, d):
    rows = table(s, d, "detections").where("class_id IS NOT NULL").groupBy("detection_id").agg(F.min("class_id").alias("class_id"), F.min("bbox_relative_area").alias("area")).where("area BETWEEN 0 AND 1")
    return inventory.extremes(rows, ["class_id"], "area", "detection_id", 3)


def cache_violations(s, d):
    """Boxes out of their domain and images with too many of them."""
    b = relation(s, d, "boxes")
    rules = {"class": F.col("class_id").between(0, 3), "confidence": F.col("confidence") > F.lit(0.05), "area": (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")), "bounds": (F.col("x2") <= 40) & (F.col("y2") <= 100)}
    return reconcile.violations(b, rules).select("image_id", "idx", F.array_join("broken", ",").alias("broken"))


def support_counts(s, d):
    """Images, positives, negatives and targets by site."""
    gt, images = relation(s, d, "gt"), relation(s, d, "sites")
    n = gt.groupBy("image_id").agg(F.count("*").alias("targets"))
    j = images.join(n, "image_id", "left").withColumn("targets", F.coalesce("targets", F.lit(0)))
    return j.groupBy("site").agg(
        F.count("*").alias("images"), F.count_if(F.col("targets") > 0).alias("positive"), F.count_if(F.col("targets") == 0).alias("negative"), F.sum("targets").alias("targets")
    )


def session_violations(s, d):
    """Stored sessions that contradict themselves; faults are planted (see ``curation._stored_sessions``), and some extents are turned round."""
    e = c._stored_sessions(s, d)[1].withColumn("first_frame", F.when(F.col("island") % 13 == 0, F.col("last_frame") + 1).otherwise(F.col("first_frame")))
    rules = {
        "extent": F.col("first_frame") <= F.col("last_frame"), "start": F.col("first_frame") == F.col("island"), "single": (F.col("observation_count") > 1) | (F.col("first_frame") == F.col("last_frame")),
        "confidence": F.col("max_confidence").between(0, 1),
    }
    return reconcile.violations(e, rules).select("video_id", "class_id", "island", F.array_join("broken", ",").alias("broken"))


def event_violations(s, d):
    """Events that contradict themselves; those whose timestamps run backwards between frames come out."""
    e = c.event_summary(s, d)
    rules = {
        "extent": (F.col("first_frame") <= F.col("last_frame")) & (F.col("first_timestamp_ms") <= F.col("last_timestamp_ms")), "count": F.col("observation_count") <= F.col("last_frame") - F.col("first_frame") + 1,
        "duration": F.abs(F.col("duration_seconds") - (F.col("last_timestamp_ms") - F.col("first_timestamp_ms")) / 1000) <= 1e-9, "confidence": F.col("mean_confidence") <= F.col("max_confidence") + 1e-9,
        "status": (F.col("status") == "confirmed") == (F.col("observation_count") >= c.RULES.confirmed_at), "matches": F.col("iou_matches") + F.col("center_matches") == F.col("observation_count") - 1,
    }
    return reconcile.violations(e, rules).select("event_id", "video_id", F.array_join("broken", ",").alias("broken"))


def split_objective(s, d):
    _, features = c._planned(s, d)
    both = cut(grouping.split_balance(features.join(grouping.plan_split(features), "component")))
    return inventory.split_objective(both.select("split", "feature", "n"), grouping.RATIOS, grouping.WEIGHTS)


def label_text_digests(s, d):
    e = _exports(s, d)
    return e.select("canonical_image_id", F.sha2(F.coalesce("label_text", F.lit("")), 256).alias("sha"), F.md5(F.coalesce("label_text", F.lit(""))).alias("md5"))


def gray_hashes(s, d):
    """Difference hashes of 9 x 8 gray values derived from embeddings."""
    e = table(s, d, "embeddings").select("vec_id", F.transform(F.slice(F.concat("embedding", F.slice("embedding", 1, 8)), 1, 72), lambda x: F.floor((x.cast("double") + 1) * 100).cast("int")).alias("gray"))
    return e.select("vec_id", pixels.dhash(F.col("gray")).alias("dhash"), F.round(pixels.brightness(F.col("gray")), 6).alias("brightness"))


def object_dispositions(s, d):
    """Objects of label lines with the disposition of their image."""
    lines = quality.parse_labels(c._labels(s, d).select("canonical_image_id", "label_text"), "label_text")
    i = c._records(s, d).select("canonical_image_id", "inclusion_status")
    j = lines.join(i, "canonical_image_id", "left")
    out = F.when(F.col("inclusion_status") == "retained", "exported").when(F.col("inclusion_status").isNull(), "unknown_image").otherwise(F.col("inclusion_status"))
    return j.groupBy("class_id", out.alias("disposition")).agg(F.count("*").alias("objects"))


def active_streams(s, d):
    """Videos whose stream is still open at the last arrival: the last frame seen is short of the frame count."""
    obs = c._observations(s, d)
    ends = temporal.stream_ends(obs, table(s, d, "video_runs"))
    seen = obs.groupBy("video_id").agg(F.max("frame_index").alias("seen"))
    return ends.join(seen, "video_id").where("seen < last_frame").select("video_id", "seen", "last_frame")


def queries():
    named = (
        decoded_labels, sample_inventory, clipped_boxes, frame_records, detection_lines, export_plan, hash_mismatches, guard_losses, dimension_distribution, repeated_filenames, extreme_boxes, cache_violations,
        support_counts, session_violations, event_violations, split_objective, label_text_digests, gray_hashes, object_dispositions, active_streams,
    )
    return {f.__name__: f for f in named}


_EXP = "ex AS (SELECT canonical_image_id, max(label_text) AS label_text, max(width) AS width, max(height) AS height, max(lower(trim(source_image_sha256))) AS sha FROM export_entries WHERE canonical_image_id IS NOT NULL GROUP BY 1)"


def oracle_sql():
    clip = lambda v, most: f"CASE WHEN {v} < 0 AND {v} >= -1e-4 * {most} THEN 0 WHEN {v} > {most} AND {v} <= {most} * (1 + 1e-4) THEN {most} ELSE {v} END"
    edge = lambda cx, w, sign, most: clip(f"(({cx} {sign} {w} / 2) * {most})", most)
    bits = lambda half: " | ".join(f"((g[{9 * (i // 8) + i % 8 + 2}] > g[{9 * (i // 8) + i % 8 + 1}])::BIGINT << {half + 31 - i})" for i in range(half, half + 32))
    return {
        "decoded_labels": f"""WITH {c._LAB}, {_EXP}, j AS (SELECT ln.*, width, height FROM ln JOIN ex USING (canonical_image_id))
SELECT canonical_image_id, line_number, class_id, round({edge('cx', 'w', '-', 'width')}, 6) AS x1, round({edge('cy', 'h', '-', 'height')}, 6) AS y1, round({edge('cx', 'w', '+', 'width')}, 6) AS x2, round({edge('cy', 'h', '+', 'height')}, 6) AS y2 FROM j""",
        "sample_inventory": f"WITH {c._LAB}, {_EXP}, g AS (SELECT canonical_image_id, class_id, count(*) AS objects, round(max(w * h), 9) AS max_area FROM ln GROUP BY 1, 2) SELECT canonical_image_id, class_id, coalesce(objects, 0) AS objects, max_area FROM ex LEFT JOIN g USING (canonical_image_id)",
        "clipped_boxes": """WITH r AS (SELECT DISTINCT detection_id, confidence, bbox_xyxy_pixel AS b FROM detections), f AS (SELECT * FROM r WHERE isfinite(confidence) AND isfinite(b[1]) AND isfinite(b[2]) AND isfinite(b[3]) AND isfinite(b[4]) AND abs(confidence) < 1e12 AND abs(b[1]) < 1e12 AND abs(b[2]) < 1e12 AND abs(b[3]) < 1e12 AND abs(b[4]) < 1e12)
SELECT detection_id, greatest(0, least(confidence, 1)) AS confidence, greatest(0, least(round_even(b[1], 0)::BIGINT, 1280)) AS x1, greatest(0, least(round_even(b[2], 0)::BIGINT, 720)) AS y1, greatest(0, least(round_even(b[3], 0)::BIGINT, 1280)) AS x2, greatest(0, least(round_even(b[4], 0)::BIGINT, 720)) AS y2 FROM f""",
        "frame_records": f"WITH {c._OBS} SELECT video_id, frame_index, count(*)::INT AS n, string_agg(detection_id || ':' || class_id, ';' ORDER BY detection_id) AS detections FROM obs GROUP BY 1, 2",
        "detection_lines": f"WITH {c._OBS} SELECT detection_id, (timestamp_ms // 1000) || '.' || lpad((timestamp_ms % 1000)::VARCHAR, 3, '0') AS seconds FROM obs",
        "export_plan": f"""WITH {c._REC}, {c._SPL}, {c._LAB} SELECT canonical_image_id, split, concat_ws('/', 'images', split, original_filename) AS path, len(list_filter(str_split(coalesce(label_text, ''), chr(10)), lambda x: trim(x) <> ''))::INT AS lines, sha256(coalesce(label_text, '')) AS label_sha256,
  CASE WHEN split IS NULL THEN 'no_split' WHEN split NOT IN ('train', 'val', 'test') THEN 'unknown_split' WHEN label_text IS NULL THEN 'no_label' END AS problem FROM rec LEFT JOIN spl USING (canonical_image_id) LEFT JOIN lab USING (canonical_image_id) WHERE inclusion_status = 'retained'""",
        "hash_mismatches": f"WITH {c._REC}, {_EXP}, j AS (SELECT canonical_image_id, sha, lower(trim(image_sha256)) AS image_sha FROM ex JOIN rec USING (canonical_image_id)) SELECT * FROM j WHERE sha IS DISTINCT FROM image_sha",
        "guard_losses": f"WITH {c._REC}, g AS (SELECT coalesce(country, 'unknown') AS country, count(*) AS images, count(*) FILTER (WHERE inclusion_status = 'guard_excluded') AS lost FROM rec GROUP BY 1) SELECT *, round(100.0::DOUBLE * lost / images, 9) AS percent FROM g",
        "dimension_distribution": f"WITH {c._REC} SELECT decoded_width, decoded_height, CASE WHEN decoded_width > decoded_height THEN 'landscape' WHEN decoded_width < decoded_height THEN 'portrait' ELSE 'square' END AS orientation, count(*) AS images FROM rec WHERE decoded_width IS NOT NULL AND decoded_height IS NOT NULL GROUP BY 1, 2, 3",
        "repeated_filenames": f"WITH {c._REC} SELECT lower(original_filename) AS name, count(*) AS count FROM rec WHERE original_filename IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
        "extreme_boxes": """WITH r AS (SELECT detection_id, min(class_id) AS class_id, min(bbox_relative_area) AS area FROM detections WHERE class_id IS NOT NULL GROUP BY 1), f AS (SELECT * FROM r WHERE isfinite(area) AND area BETWEEN 0 AND 1),
x AS (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY area, detection_id) AS a, row_number() OVER (PARTITION BY class_id ORDER BY area DESC, detection_id) AS b FROM f)
SELECT class_id, 'smallest' AS "end", a::INT AS rank, detection_id, area FROM x WHERE a <= 3 UNION ALL SELECT class_id, 'largest', b::INT, detection_id, area FROM x WHERE b <= 3""",
        "cache_violations": f"WITH {with_clause('boxes')}, x AS (SELECT image_id, idx, concat_ws(',', CASE WHEN class_id NOT BETWEEN 0 AND 3 THEN 'class' END, CASE WHEN confidence <= 0.05::DOUBLE THEN 'confidence' END, CASE WHEN NOT (x2 > x1 AND y2 > y1) THEN 'area' END, CASE WHEN NOT (x2 <= 40 AND y2 <= 100) THEN 'bounds' END) AS broken FROM boxes) SELECT * FROM x WHERE broken <> ''",
        "support_counts": f"WITH {with_clause('gt', 'sites')}, n AS (SELECT image_id, count(*) AS t FROM gt GROUP BY 1) SELECT site, count(*) AS images, count(t) AS positive, count(*) - count(t) AS negative, coalesce(sum(t), 0)::BIGINT AS targets FROM sites LEFT JOIN n USING (image_id) GROUP BY 1",
        "session_violations": f"""WITH {c._OBS}, {c._SESSION}, g AS (SELECT video_id, class_id, min(frame_index) AS island, max(frame_index) AS hi, count(*) AS n, max(confidence) AS top FROM ses GROUP BY video_id, class_id, s),
e AS (SELECT video_id, class_id, island, CASE WHEN island % 13 = 0 THEN hi + 1 ELSE island END AS lo, hi, n + CASE WHEN island % 7 = 0 THEN 1 ELSE 0 END AS n, top FROM g WHERE island % 11 <> 0),
x AS (SELECT video_id, class_id, island, concat_ws(',', CASE WHEN lo > hi THEN 'extent' END, CASE WHEN lo <> island THEN 'start' END, CASE WHEN n <= 1 AND lo <> hi THEN 'single' END, CASE WHEN top NOT BETWEEN 0 AND 1 THEN 'confidence' END) AS broken FROM e) SELECT * FROM x WHERE broken <> ''""",
        "label_text_digests": f"WITH {_EXP} SELECT canonical_image_id, sha256(coalesce(label_text, '')) AS sha, md5(coalesce(label_text, '')) AS md5 FROM ex",
        "gray_hashes": f"""WITH g AS (SELECT vec_id, list_transform(list_concat(embedding, embedding[1:8]), lambda x: floor((x::DOUBLE + 1) * 100)::INT) AS g FROM embeddings)
SELECT vec_id, printf('%08x', {bits(0)}) || printf('%08x', {bits(32)}) AS dhash, round(list_sum(g) / 72, 6) AS brightness FROM g""",
        "object_dispositions": f"""WITH {c._REC}, {c._LAB} SELECT class_id, CASE WHEN inclusion_status = 'retained' THEN 'exported' WHEN inclusion_status IS NULL THEN 'unknown_image' ELSE inclusion_status END AS disposition, count(*) AS objects FROM ln LEFT JOIN rec USING (canonical_image_id) GROUP BY 1, 2""",
        "active_streams": f"""WITH {c._OBS}, k AS (SELECT video_id, max(frame_count) - 1 AS k FROM video_runs WHERE video_id IS NOT NULL AND frame_count > 0 GROUP BY 1), s AS (SELECT video_id, max(frame_index) AS seen FROM obs GROUP BY 1)
SELECT video_id, seen, greatest(k, seen) AS last_frame FROM s JOIN k USING (video_id) WHERE seen < k""",
    }
