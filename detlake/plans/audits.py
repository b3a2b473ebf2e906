"""Registered queries of composed runs, validators, recomputed results and fixed byte formats, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from detlake.operators import audits, grouping, quality, reconcile, sampling
from detlake.operators import metrics as x
from detlake.plans import curation as c
from detlake.plans import detection as det
from detlake.session import cut, norm, table


def construction_run(s, d):
    """Capture groups, splits as they stand and the boundary guard put together: what becomes of every image."""
    captures = cut(c._captures(s, d))
    return audits.construct(c._records(s, d).select("canonical_image_id", "country", "inclusion_status"), captures, c._splits(s, d), numeric=5, seconds=120, block=50)


def construction_counts(s, d):
    return construction_run(s, d).groupBy("country", "split", "status").agg(F.count("*").alias("images"))


def export_violations(s, d):
    return audits.export_violations(table(s, d, "export_entries"), c._records(s, d))


def run_violations(s, d):
    return audits.run_violations(table(s, d, "detections"), c._videos(s, d))


def recomputed_metrics(s, d):
    """Stored class metrics against recomputed ones; the stored ones of class 2 are wrong on purpose."""
    true = cut(det.metrics_point(s, d).select("class_id", "tp", "fp", "precision"))
    wrong = F.col("class_id") == 2
    stored = true.select("class_id", F.when(wrong, F.col("tp") + 1).otherwise(F.col("tp")).alias("tp"), F.when(wrong, F.col("fp") - 1).otherwise(F.col("fp")).alias("fp"), "precision")
    return reconcile.value_differences(true, stored, ["class_id"], {"tp": 0.0, "fp": 0.0, "precision": 1e-12})


def recomputed_point(s, d):
    """The operating point chosen again from a sweep that is computed again; must be the same."""
    first, second = (x.select_point(x.sweep_points(det.threshold_sweep(s, d))).select("threshold", "total_tp", "total_fp", "negative_fp") for _ in range(2))
    return first.join(second, first.columns).select(*first.columns)


def class_support(s, d):
    lines = quality.parse_labels(c._labels(s, d).select("canonical_image_id", "label_text"), "label_text").where("class_id IS NOT NULL").select("canonical_image_id", "class_id")
    return audits.support_by_site(lines, c._records(s, d))


def frame_availability(s, d):
    """Frames that a sample asks for, and whether there are detections of them."""
    asked = sampling.distributed_frames(c._videos(s, d), 7).select("video_id", "sample", "frame_index")
    return audits.availability(asked, table(s, d, "detections").select("video_id", "frame_index"), ["video_id", "frame_index"]).select("video_id", "sample", "frame_index", "decoded", "warning")


def open_sessions(s, d):
    """Sessions that are open when frame 500 arrives."""
    return audits.open_at(c.gap_sessions(s, d), ["video_id", "class_id"], 500, 5)


def _standing(s, d):
    """(split, feature, n) of the splits as they stand."""
    r = c._records(s, d).join(c._splits(s, d), "canonical_image_id").where(F.col("split").isin(*grouping.SPLITS))
    kinds = F.array(F.lit("images"), F.concat(F.lit("country:"), F.coalesce("country", F.lit("unknown"))), F.when(F.coalesce("target_object_count", F.lit(0)) > 0, "polarity:positive").otherwise("polarity:negative"), F.concat(F.lit("class:"), F.coalesce("image_category", F.lit("unknown"))))
    return r.select("split", F.explode(kinds).alias("feature")).groupBy("split", "feature").agg(F.count("*").alias("n"))


def refinement_terms(s, d):
    out = audits.refinement_terms(cut(_standing(s, d)), grouping.RATIOS, grouping.REFINEMENT)
    return out.select("split", "term", F.round("points", 9).alias("points"), F.round("value", 6).alias("value"))


#: A descriptor of an export, and the classes it names.
DESCRIPTOR = "path: .\ntrain: images/train\nval: images/val\ntest: images/test\n\nnames:\n" + "".join(f"  {i}: {n}\n" for i, n in enumerate(x.NAMES))


def fingerprints(s, d):
    """(kind, split, rows, digest): digests of an export in fixed byte formats, each line's parts separated by zero characters."""
    e = table(s, d, "export_entries").where("canonical_image_id IS NOT NULL AND split IS NOT NULL").groupBy("canonical_image_id").agg(
        F.min(F.when(norm("split") == "validation", "val").otherwise(norm("split"))).alias("split"), F.min("exported_image_relative_path").alias("path"), F.min("source_image_sha256").alias("sha"), F.max("label_text").alias("label"),
    )
    e = cut(e)
    zero = lambda *cs: F.concat(F.array_join(F.array(*(F.coalesce(F.col(n).cast("string"), F.lit("")) for n in cs)), "\0"), F.lit("\n"))
    by_split = reconcile.stream_digests(e, ["split"], ["canonical_image_id"], zero("canonical_image_id", "sha")).select(F.lit("split").alias("kind"), "split", "rows", "digest")
    whole = lambda kind, df: df.select(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("split"), "rows", "digest")
    tree = e.withColumn("size", F.octet_length(F.coalesce("label", F.lit(""))))
    manifest = F.to_json(F.struct(F.coalesce("path", F.lit("")).alias("path"), F.coalesce("sha", F.lit("")).alias("sha256"), F.col("size").alias("size_bytes")))
    return (
        by_split.unionByName(whole("content", reconcile.stream_digests(e, [], ["path", "sha", "canonical_image_id"], zero("path", "sha"))))
        .unionByName(whole("plan", reconcile.stream_digests(e, [], ["canonical_image_id"], F.concat(zero("canonical_image_id", "split", "path", "sha"), F.coalesce("label", F.lit(""))), head=DESCRIPTOR)))
        .unionByName(whole("tree", reconcile.stream_digests(tree, [], ["canonical_image_id"], zero("path", "size"))))
        .unionByName(whole("manifest", reconcile.stream_digests(tree, [], ["canonical_image_id"], manifest, head="[", between=",", tail="]")))
    )


def queries():
    named = (construction_run, construction_counts, export_violations, run_violations, recomputed_metrics, recomputed_point, class_support, frame_availability, open_sessions, refinement_terms, fingerprints)
    return {f.__name__: f for f in named}


def oracle_sql():
    twins, other = c.oracle_sql(), det.oracle_sql()
    guard, frames, sessions = twins["boundary_guard"], twins["distributed_frames"], twins["gap_sessions"]
    run = f"""WITH guard AS ({guard}), {c._REC}, {c._CAP}, {c._SPL},
made AS (SELECT rec.canonical_image_id, rec.country, cap.capture_group, split, CASE WHEN inclusion_status = 'quarantined' THEN 'quarantined' WHEN split IS NULL THEN 'unassigned' WHEN reasons IS NOT NULL THEN 'guard_excluded' ELSE 'retained' END AS status, coalesce(reasons, '') AS reasons
FROM rec LEFT JOIN cap USING (canonical_image_id) LEFT JOIN spl USING (canonical_image_id) LEFT JOIN guard USING (canonical_image_id))"""
    zero = lambda *cs: " || chr(0) || ".join(f"coalesce({n}::VARCHAR, '')" for n in cs) + " || chr(10)"
    stream = lambda kind, line, order, head="''", sep="''", tail="''": f"SELECT '{kind}' AS kind, NULL::VARCHAR AS split, count(*) AS rows, sha256({head} || string_agg({line}, {sep} ORDER BY {order}) || {tail}) AS digest FROM e"
    descriptor = "'" + DESCRIPTOR.replace("\n", "' || chr(10) || '") + "'"
    weight = grouping.REFINEMENT
    goal = "CASE split " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in grouping.RATIOS.items()) + " END"
    return {
        "construction_run": f"{run} SELECT * FROM made",
        "construction_counts": f"{run} SELECT country, split, status, count(*) AS images FROM made GROUP BY 1, 2, 3",
        "export_violations": f"""WITH {c._REC}, e AS (SELECT canonical_image_id, list_sort(list(DISTINCT {c._SPLIT})) AS splits, max(width) AS width, max(height) AS height, max(lower(trim(source_image_sha256))) AS sha, min(exported_image_relative_path) AS path, bool_or(is_positive) AS positive, max(label_text) AS label, true AS exported
  FROM export_entries WHERE canonical_image_id IS NOT NULL GROUP BY 1),
j AS (SELECT coalesce(e.canonical_image_id, rec.canonical_image_id) AS canonical_image_id, e.* EXCLUDE (canonical_image_id), rec.* EXCLUDE (canonical_image_id, image_sha256, capture_group), lower(trim(image_sha256)) AS image_sha, lower(trim(capture_group)) AS g, rec.canonical_image_id IS NOT NULL AS known,
  trim(coalesce(label, ''), ' ' || chr(9) || chr(10) || chr(13)) <> '' AS boxes FROM e FULL JOIN rec ON e.canonical_image_id = rec.canonical_image_id),
p AS (SELECT canonical_image_id, g, unnest(splits) AS split FROM j WHERE g IS NOT NULL)
SELECT canonical_image_id, 'unknown_image' AS rule FROM j WHERE exported AND NOT known UNION ALL SELECT canonical_image_id, 'not_retained' FROM j WHERE exported AND inclusion_status <> 'retained' UNION ALL SELECT canonical_image_id, 'not_exported' FROM j WHERE exported IS NULL AND inclusion_status = 'retained'
UNION ALL SELECT canonical_image_id, 'split_unknown' FROM j WHERE exported AND len(list_filter(splits, lambda x: x IN ('train', 'val', 'test'))) = 0 UNION ALL SELECT canonical_image_id, 'split_conflict' FROM j WHERE len(splits) > 1
UNION ALL SELECT canonical_image_id, 'size_mismatch' FROM j WHERE width <> decoded_width OR height <> decoded_height UNION ALL SELECT canonical_image_id, 'hash_mismatch' FROM j WHERE sha <> image_sha UNION ALL SELECT canonical_image_id, 'label_missing' FROM j WHERE exported AND label IS NULL
UNION ALL SELECT canonical_image_id, 'positive_without_boxes' FROM j WHERE exported AND positive AND NOT boxes UNION ALL SELECT canonical_image_id, 'negative_with_boxes' FROM j WHERE exported AND NOT positive AND boxes
UNION ALL SELECT canonical_image_id, 'path_repeated' FROM e WHERE path IN (SELECT path FROM e WHERE path IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT DISTINCT canonical_image_id, 'group_conflict' FROM p WHERE g IN (SELECT g FROM p GROUP BY 1 HAVING count(DISTINCT split) > 1)""",
        "run_violations": f"""WITH {c._VID}, d AS (SELECT x.*, fps, frame_count, vid.video_id IS NOT NULL AS known FROM (SELECT DISTINCT detection_id, video_id, frame_index, detection_index, timestamp_ms FROM detections WHERE video_id IS NOT NULL) x LEFT JOIN vid USING (video_id)),
b AS (SELECT video_id, 'unknown_video' AS rule FROM d WHERE NOT known UNION ALL SELECT video_id, 'negative_frame' FROM d WHERE frame_index < 0 UNION ALL SELECT video_id, 'beyond_end' FROM d WHERE frame_index >= frame_count
  UNION ALL SELECT video_id, 'clock' FROM d WHERE fps > 0 AND abs(timestamp_ms - round_even(frame_index::DOUBLE * 1000 / fps, 0)::BIGINT) > 1 UNION ALL SELECT video_id, 'no_time' FROM d WHERE timestamp_ms IS NULL)
SELECT video_id, rule, count(*) AS n FROM b GROUP BY 1, 2 UNION ALL SELECT video_id, 'repeated_index', sum(n)::BIGINT FROM (SELECT video_id, count(DISTINCT detection_id) - 1 AS n FROM d WHERE detection_index IS NOT NULL GROUP BY video_id, frame_index, detection_index) WHERE n > 0 GROUP BY 1
UNION ALL SELECT video_id, 'incomplete', max(frame_count) - 1 - max(frame_index) FROM d WHERE frame_count IS NOT NULL GROUP BY 1 HAVING max(frame_count) - 1 - max(frame_index) > 0""",
        "recomputed_metrics": f"WITH t AS ({other['metrics_point']}) SELECT class_id, 'tp' AS field, tp::DOUBLE AS expected, (tp + 1)::DOUBLE AS actual FROM t WHERE class_id = 2 UNION ALL SELECT class_id, 'fp', fp::DOUBLE, (fp - 1)::DOUBLE FROM t WHERE class_id = 2",
        "recomputed_point": f"SELECT threshold, total_tp, total_fp, negative_fp FROM ({other['select_point']})",
        "class_support": f"WITH {c._LAB}, {c._REC} SELECT rec.country, class_id, count(*) AS boxes, count(DISTINCT ln.canonical_image_id) AS images, count(DISTINCT lower(trim(capture_group))) AS groups FROM ln LEFT JOIN rec USING (canonical_image_id) WHERE class_id IS NOT NULL GROUP BY 1, 2",
        "frame_availability": f"WITH f AS ({frames}), x AS (SELECT DISTINCT video_id, frame_index, true AS decoded FROM detections) SELECT video_id, sample, frame_index, coalesce(decoded, false) AS decoded, CASE WHEN decoded IS NULL THEN 'frame_not_decoded' END AS warning FROM f LEFT JOIN x USING (video_id, frame_index)",
        "open_sessions": f"SELECT video_id, class_id, first_frame, last_frame FROM ({sessions}) WHERE first_frame <= 500 AND 500 - last_frame - 1 <= 5",
        "refinement_terms": f"""WITH {c._REC}, {c._SPL}, r AS (SELECT split, unnest(['images', 'country:' || coalesce(country, 'unknown'), CASE WHEN coalesce(target_object_count, 0) > 0 THEN 'polarity:positive' ELSE 'polarity:negative' END, 'class:' || coalesce(image_category, 'unknown')]) AS term
  FROM rec JOIN spl USING (canonical_image_id) WHERE split IN ('train', 'val', 'test')), n AS (SELECT split, term, split_part(term, ':', 1) AS kind, count(*) AS n FROM r GROUP BY 1, 2),
t AS (SELECT *, sum(n) OVER (PARTITION BY term) AS total, sum(n) FILTER (WHERE term = 'images') OVER (PARTITION BY split) AS images, sum(n) FILTER (WHERE term = 'images') OVER () AS everything, {goal} AS goal FROM n),
p AS (SELECT *, CASE WHEN kind = 'country' THEN 100.0::DOUBLE * n / images - 100.0::DOUBLE * total / everything ELSE 100.0::DOUBLE * n / total - 100.0::DOUBLE * goal END AS points FROM t)
SELECT split, term, round(points, 9) AS points, round(CASE kind WHEN 'images' THEN {weight['ratio']}::DOUBLE WHEN 'country' THEN {weight['country']}::DOUBLE WHEN 'class' THEN {weight['class']}::DOUBLE ELSE {weight['polarity']}::DOUBLE END * points * points
  + CASE WHEN kind IN ('images', 'country') THEN {weight['violation']}::DOUBLE * power(greatest(0, abs(points) - CASE kind WHEN 'images' THEN 2 ELSE 5 END), 2) ELSE 0 END, 6) AS value FROM p""",
        "fingerprints": f"""WITH e AS (SELECT canonical_image_id, min({c._SPLIT}) AS split, min(exported_image_relative_path) AS path, min(source_image_sha256) AS sha, max(label_text) AS label, coalesce(strlen(max(label_text)), 0) AS size FROM export_entries WHERE canonical_image_id IS NOT NULL AND split IS NOT NULL GROUP BY 1)
SELECT 'split' AS kind, split, count(*) AS rows, sha256(string_agg({zero('canonical_image_id', 'sha')}, '' ORDER BY canonical_image_id)) AS digest FROM e GROUP BY split UNION ALL {stream('content', zero('path', 'sha'), 'path NULLS FIRST, sha NULLS FIRST, canonical_image_id')}
UNION ALL {stream('plan', zero('canonical_image_id', 'split', 'path', 'sha') + " || coalesce(label, '')", 'canonical_image_id', descriptor)} UNION ALL {stream('tree', zero('path', 'size'), 'canonical_image_id')}
UNION ALL {stream('manifest', "'{\"path\":\"' || coalesce(path, '') || '\",\"sha256\":\"' || coalesce(sha, '') || '\",\"size_bytes\":' || size || '}'", 'canonical_image_id', "'['", "','", "']'")}""",
    }
