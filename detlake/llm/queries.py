"""Queries of the operators for training data, with SQL twins where SQL can say the same."""

from __future__ import annotations

from detlake.llm import contraction, leaks, overlaps, percentiles, pieces, runs, sampling, splits, tokens
from detlake.session import cut, table


def p1_found(spark, d):
    return runs.repeated_events(table(spark, d, "detections"), least=2, settle=True).select("video_id", "first_detection_id", "last_detection_id")


def p1_runs(spark, d):
    return runs.repeated_events(table(spark, d, "detections"), settle=True)


def p2_found(spark, d):
    images = table(spark, d, "images")
    return splits.conflicts(splits.plan(images, table(spark, d, "export_entries"), table(spark, d, "split_targets")), images)


def p2_assign(spark, d):
    return splits.assign(table(spark, d, "images"), table(spark, d, "export_entries"), table(spark, d, "split_targets"))


def p2_balance(spark, d):
    return splits.balance(cut(p2_assign(spark, d)), table(spark, d, "split_targets"))


def p2_integrity(spark, d):
    return splits.integrity(cut(p2_assign(spark, d)), table(spark, d, "images"), table(spark, d, "split_targets"))


def _sampling(spark, d):
    return table(spark, d, "annotated_samples"), table(spark, d, "demo_configs"), table(spark, d, "target_shares")


def _drawn(spark, d):
    samples, configs, shares = _sampling(spark, d)
    pop = cut(sampling.population(samples))
    return sampling.draw(pop, configs, shares), pop, configs, shares


def p3_found(spark, d):
    return sampling.unmet(*_drawn(spark, d))


def p3_sample(spark, d):
    return _drawn(spark, d)[0]


def p3_report(spark, d):
    return sampling.report(*_drawn(spark, d))


def p3_integrity(spark, d):
    return sampling.integrity(*_drawn(spark, d)[:3])


def p4_found(spark, d):
    return overlaps.found_pairs(table(spark, d, "images"), table(spark, d, "export_entries"))


def p4_report(spark, d):
    return overlaps.report(table(spark, d, "images"), table(spark, d, "export_entries"))


def p5_percentiles(spark, d):
    return percentiles.class_percentiles(table(spark, d, "detections"))


def p5_daily(spark, d):
    return percentiles.quantiles_of(percentiles.daily_sketches(table(spark, d, "detections")), ["class_name", "day"])


def p5_bound(spark, d):
    detections = table(spark, d, "detections")
    return percentiles.bound_check(detections, cut(percentiles.class_percentiles(detections)))


#: A column without a known range.
_FREE = ["bbox_area_pixels"]


def p5_free_bound(spark, d):
    detections = table(spark, d, "detections")
    return percentiles.bound_check(detections, cut(percentiles.class_percentiles(detections, _FREE, None)), _FREE, None)


def p6_found(spark, d):
    return contraction.linked_images(table(spark, d, "near_duplicate_pairs"), table(spark, d, "duplicate_groups"))


def p7_ids(spark, d):
    return tokens.encode_documents(table(spark, d, "documents"))


def p8_found(spark, d):
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_spans(spark, d):
    return leaks.spans(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark, d):
    return pieces.split_found(table(spark, d, "documents"))


def p9_pieces(spark, d):
    return pieces.split_documents(table(spark, d, "documents"))


def queries():
    return {f.__name__: f for f in (p1_found, p1_runs, p2_found, p2_assign, p2_balance, p2_integrity, p3_found, p3_sample, p3_report, p3_integrity, p4_found, p4_report, p5_percentiles, p5_daily, p5_bound, p5_free_bound, p6_found, p7_ids, p8_found, p8_spans, p9_found, p9_pieces)}


_SPLIT = "CASE WHEN lower(trim({0})) = 'validation' THEN 'val' ELSE lower(trim({0})) END"

_PAIRS = f"""
img AS (SELECT DISTINCT canonical_image_id AS id, country, lower(trim(image_sha256)) AS sha,
               TRY_CAST(('0x' || regexp_replace(lower(trim(perceptual_hash_dhash64)), '^0x', '')) AS UBIGINT) AS dh FROM images),
ent AS (SELECT DISTINCT canonical_image_id AS id, {_SPLIT.format('split')} AS split FROM export_entries),
rec AS (SELECT img.*, split, split = 'train' AS train FROM img JOIN ent USING (id) WHERE split IN ('train', 'val', 'test')),
good AS (SELECT * FROM rec WHERE dh IS NOT NULL AND dh <> 0 AND dh <> 18446744073709551615),
word AS (SELECT *, unnest([{{'k': 0, 'w': dh >> 48}}, {{'k': 1, 'w': (dh >> 32) & 65535}}, {{'k': 2, 'w': (dh >> 16) & 65535}}, {{'k': 3, 'w': dh & 65535}}]) AS kw FROM good),
pair AS (
  SELECT a.id AS train_id, b.id AS eval_id, b.split, b.country, true AS exact FROM rec a JOIN rec b ON a.sha = b.sha WHERE a.train AND NOT b.train AND a.id <> b.id AND a.sha <> ''
  UNION
  SELECT a.id, b.id, b.split, b.country, false FROM word a JOIN word b ON a.kw = b.kw WHERE a.train AND NOT b.train AND a.id <> b.id AND bit_count(xor(a.dh, b.dh)) <= 2)
"""

_RUN_SQL = """
WITH RECURSIVE obs AS (
  SELECT DISTINCT detection_id AS id, video_id AS v, class_id AS c, frame_index AS f, bbox_xyxy_normalized[1] AS x1, bbox_xyxy_normalized[2] AS y1, bbox_xyxy_normalized[3] AS x2, bbox_xyxy_normalized[4] AS y2
  FROM detections
  WHERE class_id IS NOT NULL AND len(bbox_xyxy_normalized) = 4 AND len(list_filter(bbox_xyxy_normalized, lambda x: x IS NULL OR isnan(x))) = 0),
link AS (
  SELECT p.id AS a, q.id AS b FROM (SELECT *, unnest([1, 2, 3]) AS s FROM obs) p JOIN obs q ON p.v = q.v AND p.c = q.c AND q.f = p.f + p.s
  WHERE greatest(least(p.x2, q.x2) - greatest(p.x1, q.x1), 0) * greatest(least(p.y2, q.y2) - greatest(p.y1, q.y1), 0)
     >= 0.6 * ((p.x2 - p.x1) * (p.y2 - p.y1) + (q.x2 - q.x1) * (q.y2 - q.y1) - greatest(least(p.x2, q.x2) - greatest(p.x1, q.x1), 0) * greatest(least(p.y2, q.y2) - greatest(p.y1, q.y1), 0))),
"""

_SHARES = """
WITH pop AS (SELECT filename, bool_or(list_contains(classes_present, 0)) AS c0, bool_or(list_contains(classes_present, 1)) AS c1, bool_or(list_contains(classes_present, 2)) AS c2,
                    bool_or(list_contains(classes_present, 3)) AS c3, bool_or(len(classes_present) = 0) AS neg FROM annotated_samples WHERE filename IS NOT NULL GROUP BY filename),
have AS (SELECT 'd00_longitudinal_crack' AS k, count(*) FILTER (WHERE c0) AS n FROM pop UNION ALL SELECT 'd10_transverse_crack', count(*) FILTER (WHERE c1) FROM pop
         UNION ALL SELECT 'd20_alligator_crack', count(*) FILTER (WHERE c2) FROM pop UNION ALL SELECT 'd40_pothole', count(*) FILTER (WHERE c3) FROM pop
         UNION ALL SELECT 'negative', count(*) FILTER (WHERE neg) FROM pop),
ask AS (SELECT s.config_id, s.category, greatest(CASE WHEN lower(trim(category)) = 'negative' THEN negative_images ELSE images_per_class END::DOUBLE, coalesce(CASE WHEN isnan(target_share) THEN NULL ELSE target_share END * sample_size, 0)) AS required,
               coalesce(n, 0) AS available
        FROM target_shares s JOIN demo_configs USING (config_id) LEFT JOIN have ON k = lower(trim(category)))
"""

_GROUPED = f"""
WITH g AS (SELECT DISTINCT canonical_image_id AS id, lower(trim(capture_group)) AS capture_group FROM images WHERE capture_group IS NOT NULL),
e AS (SELECT DISTINCT canonical_image_id AS id, {_SPLIT.format('split')} AS split FROM export_entries WHERE split IS NOT NULL)
"""


def oracle_sql():
    # first delivery of an observation, a null time last; a day's row and one over all days (day null)
    once = """SELECT * FROM (SELECT detection_id, lower(trim(class_name)) AS class_name, coalesce(CAST(ingested_at AS DATE), DATE '0001-01-01') AS day, confidence, bbox_relative_area, bbox_area_pixels,
  row_number() OVER (PARTITION BY detection_id ORDER BY ingested_at NULLS LAST, class_name NULLS FIRST) AS nth FROM detections WHERE detection_id IS NOT NULL) WHERE nth = 1 AND class_name IS NOT NULL"""

    def bound(metrics, ok):
        each = " UNION ALL ".join(f"SELECT class_name, {day} AS day, '{m}' AS metric, {m} AS v FROM o" for m in metrics for day in ("day", "NULL::DATE"))
        return f"WITH o AS ({once}), v AS ({each}) SELECT class_name, day, metric, count(*) FILTER (WHERE {ok}) AS n, count(*) FILTER (WHERE ({ok}) IS NOT TRUE) AS set_aside, true AS within_bound FROM v GROUP BY class_name, day, metric"

    return {
        "p2_integrity": """
WITH g AS (SELECT canonical_image_id AS id, min(lower(trim(capture_group))) AS g FROM images WHERE canonical_image_id IS NOT NULL GROUP BY 1), e AS (SELECT DISTINCT canonical_image_id AS id FROM export_entries WHERE canonical_image_id IS NOT NULL)
SELECT count(*) AS images, count(DISTINCT coalesce('g ' || g, 'i ' || id)) AS components, 0::BIGINT AS torn, true AS within_one_component FROM e LEFT JOIN g USING (id)""",
        "p5_bound": bound(percentiles.METRICS, "NOT isnan(v) AND v BETWEEN 0 AND 1"),
        "p5_free_bound": bound(_FREE, "NOT isnan(v)"),
        "p2_found": _GROUPED + "SELECT capture_group FROM g JOIN e USING (id) GROUP BY capture_group HAVING count(DISTINCT split) > 1",
        "p3_found": _SHARES + "SELECT DISTINCT config_id, category FROM ask WHERE available < required",
        "p3_integrity": "SELECT DISTINCT config_id, 0::BIGINT AS repeated, 0::BIGINT AS \"foreign\", 0::BIGINT AS minima_short, true AS size_met FROM demo_configs WHERE config_id IS NOT NULL",
        "p4_found": f"WITH {_PAIRS} SELECT DISTINCT least(train_id, eval_id) AS first_image_id, greatest(train_id, eval_id) AS second_image_id FROM pair",
        "p4_report": f"WITH {_PAIRS} SELECT split, country, count(DISTINCT eval_id) AS images, count(DISTINCT eval_id) FILTER (WHERE exact) AS exact_images, count(DISTINCT (train_id, eval_id)) AS pairs FROM pair GROUP BY split, country",
        "p6_found": """
WITH RECURSIVE direct AS (
  SELECT lower(trim(first_image_id)) AS a, lower(trim(second_image_id)) AS b FROM near_duplicate_pairs WHERE hard_split_constraint
  UNION SELECT 'group ' || lower(trim(duplicate_group)), lower(trim(m)) FROM (SELECT duplicate_group, unnest(member_image_ids) AS m FROM duplicate_groups WHERE hard_split_constraint)),
edge AS (SELECT a, b FROM direct WHERE a <> b UNION SELECT b, a FROM direct WHERE a <> b),
reach(x, y) AS (SELECT a, a FROM edge UNION SELECT r.x, e.b FROM reach r JOIN edge e ON r.y = e.a)
SELECT x AS canonical_image_id, min(y) AS group_id FROM reach WHERE x NOT LIKE 'group %' AND y NOT LIKE 'group %' GROUP BY x HAVING count(DISTINCT y) > 1""",
        "p1_runs": _RUN_SQL
        + """edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(x, y) AS (SELECT a, a FROM edge UNION SELECT r.x, e.b FROM reach r JOIN edge e ON r.y = e.a),
run AS (SELECT id, coalesce(min(y), id) AS r FROM obs LEFT JOIN reach ON x = id GROUP BY id),
time AS (SELECT detection_id AS id, min(timestamp_ms) AS t FROM detections GROUP BY 1),
w AS (SELECT v, c, r, count(*) AS n, min(f) AS lo, max(f) AS hi, arg_min(id, (f, id)) AS first_id, arg_max(id, (f, id)) AS last_id FROM run JOIN obs USING (id) GROUP BY v, c, r)
SELECT v AS video_id, c AS class_id, n AS observations, lo AS first_frame, hi AS last_frame, first_id AS first_detection_id, last_id AS last_detection_id, b.t - a.t AS duration_ms FROM w JOIN time a ON a.id = first_id JOIN time b ON b.id = last_id""",
        "p1_found": _RUN_SQL
        + """edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(x, y) AS (SELECT a, a FROM edge UNION SELECT r.x, e.b FROM reach r JOIN edge e ON r.y = e.a),
run AS (SELECT x, min(y) AS r FROM reach GROUP BY x)
SELECT v AS video_id, arg_min(id, (f, id)) AS first_detection_id, arg_max(id, (f, id)) AS last_detection_id FROM run JOIN obs ON id = x GROUP BY r, v""",
    }
