"""Registered queries of temporal events, grouping, annotation quality, sampling and reconciliation, with SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from detlake.functions import keys as k
from detlake.functions.geometry import box
from detlake.operators import components as c
from detlake.operators import grouping, quality, reconcile, sampling, summary, temporal
from detlake.plans.adapters import relation, with_clause
from detlake.session import cut, norm, table

RULES = temporal.Rules()


# --- temporal events


def _observations(s, d):
    return temporal.observations(table(s, d, "detections"), table(s, d, "video_runs"))


def event_summary(s, d):
    obs = _observations(s, d)
    return temporal.finished(temporal.events(obs, RULES), temporal.stream_ends(obs, table(s, d, "video_runs")), RULES)


def event_associations(s, d):
    return temporal.associations(_observations(s, d), RULES)


def event_status_counts(s, d):
    return temporal.status_counts(temporal.events(_observations(s, d), RULES))


def _stored_sessions(s, d):
    """(observations with their session, stored sessions); every seventh stored count is one too high, every eleventh session is missing.

    The faults are planted, so that the checks below have something to find.
    """
    obs = temporal.islands(_observations(s, d), F.lit(5)).select("video_id", "class_id", "island", "frame_index", "confidence")
    true = obs.groupBy("video_id", "class_id", "island").agg(F.count("*").alias("observation_count"), F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"), F.max("confidence").alias("max_confidence"))
    stored = true.where("island % 11 <> 0").withColumn("observation_count", F.col("observation_count") + (F.col("island") % 7 == 0).cast("long"))
    return obs, stored


def event_reconciliation(s, d):
    """Stored sessions against their observations: those that differ, and those that one side lacks."""
    return reconcile.event_reconciliation(*_stored_sessions(s, d), ["video_id", "class_id", "island"])


def event_totals(s, d):
    """What the events of a video and class hold together: each valid observation counts in one event."""
    return temporal.events(_observations(s, d), RULES).groupBy("video_id", "class_id").agg(
        F.sum("observation_count").alias("observations"), F.min("first_frame").alias("first_frame"), F.max("last_frame").alias("last_frame"), F.max("max_confidence").alias("max_confidence"), F.max("max_relative_area").alias("max_area"),
        F.round(F.sum(F.col("mean_confidence") * F.col("observation_count")), 6).alias("confidence"), (F.sum(F.col("iou_matches") + F.col("center_matches") + 1)).alias("associations"),
    )


def grouped_split_integrity(s, d):
    """(plan, images, torn, off): of the plan and its refinement, components in several splits and splits far from their ratio."""
    comp, features = _planned(s, d)
    edges = grouping.boundary_edges(_captures(s, d), comp)
    plan = cut(grouping.plan_split(features))
    out = None
    for name, found in (("plan", plan), ("refined", grouping.refine_split(features, plan, edges))):
        rows = comp.join(found, "component")
        torn = rows.groupBy("component").agg(F.count_distinct("split").alias("s")).agg(F.count_if(F.col("s") > 1).alias("torn"))
        share = rows.groupBy("split").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))
        goal = F.create_map(*(x for k_, v in grouping.RATIOS.items() for x in (F.lit(k_), F.lit(v))))
        off = share.agg(F.sum("n").alias("images"), F.count_if(F.abs(F.col("share") - F.try_element_at(goal, F.col("split"))) > 0.05).alias("off"))
        row = off.crossJoin(torn).select(F.lit(name).alias("plan"), "images", "torn", "off")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def valid_observations(s, d):
    return _observations(s, d).select("detection_id", "video_id", "class_id", "frame_index", "detection_index", "confidence", "fps")


def gap_sessions(s, d):
    return temporal.sessions(_observations(s, d), 5)


def running_counts(s, d):
    return _observations(s, d).groupBy("video_id", "class_id").agg(F.count("*").alias("detections"), F.max("frame_index").alias("last_frame"))


# --- grouping and duplicates


def _records(s, d):
    """Image records, one a canonical id: its latest scan, ties by content."""
    i = table(s, d, "images").where("canonical_image_id IS NOT NULL")
    cols = ["country", "original_filename", "image_sha256", "perceptual_hash_dhash64", "decoded_width", "decoded_height", "exif_timestamp_sort_ms", "capture_group", "inclusion_status", "image_category", "target_object_count"]
    latest = i.groupBy("canonical_image_id").agg(F.max(F.struct("scanned_at", *cols)).alias("r"))
    return latest.select("canonical_image_id", *(f"r.{c}" for c in cols))


def _captures(s, d):
    r = _records(s, d).select("canonical_image_id", "country", F.col("original_filename").alias("filename"), F.col("exif_timestamp_sort_ms").alias("ts_ms"))
    return grouping.capture_groups(r, gap_seconds=3600, span_seconds=600, block=50)


def capture_groups(s, d):
    return _captures(s, d).select("canonical_image_id", "prefix", "number", "method", "run", "sequence_index", "sequence_key", "capture_group")


def capture_group_sizes(s, d):
    return grouping.half_even_quantiles(grouping.group_summary(_captures(s, d)), "images")


def _splits(s, d):
    e = table(s, d, "export_entries").where("canonical_image_id IS NOT NULL AND split IS NOT NULL")
    name = F.when(norm("split") == "validation", "val").otherwise(norm("split"))
    return e.groupBy("canonical_image_id").agg(F.min(name).alias("split"))


def boundary_guard(s, d):
    return grouping.boundary_guard(_captures(s, d), _splits(s, d), numeric=5, seconds=120, block=50).select("canonical_image_id", F.array_join("reasons", ";").alias("reasons"))


def exact_duplicates(s, d):
    return grouping.exact_duplicates(table(s, d, "images"))


def _hashes(s, d):
    digits = F.regexp_replace(norm("perceptual_hash_dhash64"), "^0x", "")
    h = F.when(digits.rlike("^[0-9a-f]{1,16}$"), k.hex64(digits))
    return _records(s, d).select(F.col("canonical_image_id").alias("id"), h.alias("hash"), F.col("image_sha256").alias("sha"), F.col("decoded_width").alias("width"), F.col("decoded_height").alias("height")).where(~F.col("hash").isin(0, -1))


def near_duplicates(s, d):
    """Pairs between classes of alike images."""
    return grouping.near_duplicate_classes(_hashes(s, d))[0]


def near_duplicate_members(s, d):
    """The class of every image with a hash."""
    return grouping.near_duplicate_classes(_hashes(s, d))[1]


def near_duplicate_groups(s, d):
    return grouping.duplicate_components(grouping.near_duplicate_links(_hashes(s, d))).select("duplicate_group", "member_count", F.array_join("members", ",").alias("members"))


def component_roots(s, d):
    pairs = table(s, d, "near_duplicate_pairs").select(norm("first_image_id").alias("a"), norm("second_image_id").alias("b"))
    return c.components(pairs, "a", "b")


def _planned(s, d):
    r = cut(_records(s, d).where("inclusion_status = 'retained'"))
    dup = grouping.exact_duplicates(r).select("duplicate_group", "canonical_image_id")
    r = r.join(dup, "canonical_image_id", "left").withColumnRenamed("duplicate_group", "exact_group").withColumn("capture_group", norm("capture_group"))
    p = table(s, d, "near_duplicate_pairs").where("hard_split_constraint").select(norm("first_image_id").alias("a"), norm("second_image_id").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    both = r.select("canonical_image_id")
    p = p.join(both.withColumnRenamed("canonical_image_id", "a"), "a", "left_semi").join(both.withColumnRenamed("canonical_image_id", "b"), "b", "left_semi")
    comp = cut(grouping.split_components(r.select("canonical_image_id", "capture_group", "exact_group"), p))
    members = r.join(comp, "canonical_image_id").select(
        "canonical_image_id", "component", F.coalesce("country", F.lit("unknown")).alias("country"), (F.coalesce("target_object_count", F.lit(0)) > 0).alias("is_positive"),
        F.create_map(F.coalesce("image_category", F.lit("unknown")), F.coalesce(F.col("target_object_count").cast("long"), F.lit(0).cast("long"))).alias("class_counts"), F.col("decoded_width").alias("width"), F.col("decoded_height").alias("height"),
    )
    return comp, cut(grouping.component_features(members))


def grouped_split(s, d):
    comp, features = _planned(s, d)
    return comp.join(grouping.plan_split(features), "component").select("canonical_image_id", "component", "split")


def grouped_split_refined(s, d):
    """The greedy plan after local search that also avoids boundaries between neighbouring capture groups."""
    comp, features = _planned(s, d)
    edges = grouping.boundary_edges(_captures(s, d), comp, seconds=120)
    return comp.join(grouping.refine_split(features, grouping.plan_split(features), edges), "component").select("canonical_image_id", "component", "split")


def grouped_split_balance(s, d):
    _, features = _planned(s, d)
    return grouping.split_balance(features.join(grouping.plan_split(features), "component"))


def split_conflicts(s, d):
    rows = table(s, d, "export_entries").select("canonical_image_id", "split").join(_records(s, d).select("canonical_image_id", "capture_group"), "canonical_image_id")
    return grouping.split_conflicts(rows, "capture_group").select("group", F.array_join("splits", ",").alias("splits"))


def pair_conflicts(s, d):
    p = table(s, d, "near_duplicate_pairs").where("hard_split_constraint").select(F.least(norm("first_image_id"), norm("second_image_id")).alias("a"), F.greatest(norm("first_image_id"), norm("second_image_id")).alias("b")).where("a <> b").distinct()
    return grouping.pair_conflicts(p, _splits(s, d))


def country_shares(s, d):
    rows = _splits(s, d).join(_records(s, d).select("canonical_image_id", F.coalesce("country", F.lit("unknown")).alias("country")), "canonical_image_id")
    return grouping.share_audit(rows, "split", "country").select("split", F.col("by").alias("country"), "n", *(F.round(x, 9).alias(x) for x in ("percent", "overall_percent", "deviation")), "within_tolerance")


def image_summary(s, d):
    r = _records(s, d).select(F.coalesce("country", F.lit("unknown")).alias("country"), F.coalesce("image_category", F.lit("unknown")).alias("image_category"), F.coalesce(F.col("target_object_count").cast("long"), F.lit(0)).alias("targets"))
    return summary.grouped_counts(r, ["country", "image_category"], {"targets": "targets"})


# --- annotation quality


def voc_boxes(s, d):
    """Boxes of image annotations as text, derived from line items: some touch zero, some are inverted or too large."""
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").distinct()
    text = lambda x: x.cast("long").cast("string")
    far = F.when(F.col("l_linenumber") == 7, F.lit("12.5")).otherwise(text(F.col("l_partkey") % 50 + F.col("l_quantity") * 2))
    li = li.select("*", text(F.col("l_partkey") % 50).alias("a"), text(F.col("l_suppkey") % 40).alias("b"), far.alias("c"), text(F.col("l_suppkey") % 40 + F.col("l_quantity") - 2).alias("e"))
    out = quality.voc_boxes(li, ["a", "b", "c", "e"], F.lit(128), F.lit(64))
    at = lambda f, i: F.get(f, F.lit(i))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.array_join("flags", ",").alias("flags"), at("half_open", 0).alias("x1"), at("half_open", 3).alias("y2"), F.round(at("normalized", 2), 9).alias("nx2"), F.round(at("projected", 1), 6).alias("py1"), F.round("projected_area", 6).alias("area"))


def _labels(s, d):
    e = table(s, d, "export_entries").where("canonical_image_id IS NOT NULL")
    return e.groupBy("canonical_image_id").agg(F.max("label_text").alias("label_text"), F.max("country").alias("country"))


def label_lines(s, d):
    rows = quality.label_errors(_labels(s, d), "label_text", places=4)
    return rows.select("canonical_image_id", "line_number", "class_id", "cx", "cy", "w", "h", F.array_join("errors", ",").alias("errors"))


def label_error_counts(s, d):
    rows = quality.label_errors(_labels(s, d), "label_text", places=4)
    return rows.select(F.explode_outer("errors").alias("error")).groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(F.count("*").alias("lines"))


def class_inventory(s, d):
    rows = quality.parse_labels(_labels(s, d), "label_text").withColumnRenamed("canonical_image_id", "image_id").where("country IS NOT NULL AND class_id IS NOT NULL")
    return quality.class_inventory(rows, "class_id", ["country"])


def label_roundtrip(s, d):
    """Boxes written as label lines and read again: the largest error of a coordinate per class."""
    b = relation(s, d, "boxes").withColumn("line", quality.label_line(F.col("class_id"), box(), F.lit(100), F.lit(100), 8))
    texts = quality.label_text(b.where("line IS NOT NULL"), ["image_id"], "line", ["idx"])
    back = quality.parse_labels(texts, "label_text")
    order = F.row_number().over(_window("image_id", "idx"))
    return back.join(b.where("line IS NOT NULL").withColumn("line_number", order).select("image_id", "line_number", "x1", F.col("class_id").alias("c")), ["image_id", "line_number"]).groupBy("class_id").agg(
        F.count("*").alias("lines"), F.count_if(F.col("c") == F.col("class_id")).alias("same_class"), (F.max(F.abs((F.col("cx") - F.col("w") / 2) * 100 - F.col("x1"))) < F.lit(1e-5)).alias("exact")
    )


def _window(*by):
    return Window.partitionBy(*by[:-1]).orderBy(by[-1])


def pair_integrity(s, d):
    a = table(s, d, "annotated_samples").select(F.regexp_replace("filename", r"\.[^.]*$", "").alias("stem")).distinct()
    i = _records(s, d).select(F.regexp_replace("original_filename", r"\.[^.]*$", "").alias("stem"))
    return quality.pair_integrity(i, a, "stem")


def image_categories(s, d):
    """Objects derived from label lines: classes over 3 are known non-targets, small boxes rejected, bad lines quarantined."""
    rows = quality.label_errors(_labels(s, d), "label_text")
    act = F.when(F.col("class_id").between(0, 3), quality.RETAIN).when(F.col("class_id") > 3, quality.NON_TARGET).otherwise(quality.UNKNOWN)
    status = F.when(F.size("errors") > 0, "quarantine_ambiguous").when(F.col("w") * F.col("h") < F.lit(0.002), "reject_tiny").otherwise(quality.RETAIN)
    return quality.image_categories(rows.select(F.col("canonical_image_id").alias("image_id"), act.alias("action"), status.alias("status")))


def area_histogram(s, d):
    rows = table(s, d, "detections").groupBy("detection_id").agg(F.min("bbox_relative_area").alias("a"), F.min("class_id").alias("class_id")).where("class_id IS NOT NULL")
    return quality.histogram(rows, "a", [0, 0.001, 0.005, 0.01, 0.05, 0.25, 1], ["class_id"])


def disposition_matrix(s, d):
    r = _records(s, d).where("inclusion_status IS NOT NULL").select(F.coalesce("country", F.lit("unknown")).alias("country"), "inclusion_status")
    return quality.disposition_matrix(r, "country", "inclusion_status", ["retained", "guard_excluded", "quarantined"])


# --- sampling and summaries


def hash_sample(s, d):
    return sampling.hash_sample(_records(s, d).select("canonical_image_id", "country"), "canonical_image_id", 100, 42, "review").select("canonical_image_id", "rank_key")


def stratified_sample(s, d):
    rows = _records(s, d).select("canonical_image_id", F.coalesce("country", F.lit("unknown")).alias("country"), F.coalesce("image_category", F.lit("unknown")).alias("image_category"))
    return sampling.stratified_sample(rows, ["country", "image_category"], "canonical_image_id", 5, 42).select("country", "image_category", "rank", "canonical_image_id")


def _showcase(s, d):
    rows = table(s, d, "annotated_samples").where("filename IS NOT NULL AND classes_present IS NOT NULL AND class_max_normalized_areas IS NOT NULL")
    entries = rows.select("filename", (F.size("classes_present") == 0).alias("negative"), F.explode_outer("class_max_normalized_areas").alias("a"))
    best = entries.where("NOT negative AND a.class_id IS NOT NULL").groupBy("filename", "a.class_id").agg(F.max("a.max_normalized_area").alias("v"))
    maps = best.groupBy("filename").agg(F.map_from_entries(F.collect_list(F.struct("class_id", "v"))).alias("areas"))
    return entries.groupBy("filename").agg(F.bool_and("negative").alias("negative")).join(maps, "filename", "left")


def class_showcase(s, d):
    return sampling.class_showcase(_showcase(s, d), [0, 1, 2, 3], 2, 2, 42)


def covering_sample(s, d):
    rows = table(s, d, "annotated_samples").where("filename IS NOT NULL AND classes_present IS NOT NULL AND country IS NOT NULL")
    known = F.array_distinct(F.filter("classes_present", lambda x: x.between(0, 3)))
    rows = rows.groupBy("filename").agg(F.max("country").alias("country"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(known)))).alias("classes"))
    return sampling.covering_sample(rows.select("filename", "country", "classes", (F.array_contains("classes", 3) & (F.col("country") == "India")).alias("rare"), (F.size("classes") > 0).alias("positive")), 24, 8, 2, 42)


def _frames(s, d):
    """One quality row a video and second, from the detections seen in it."""
    obs = _observations(s, d)
    return obs.groupBy("video_id", F.floor(F.col("frame_index") / 100).alias("second")).agg(F.round(F.max("confidence"), 6).alias("sharpness"), F.max("area").alias("contrast"), F.count("*").alias("change"))


def temporal_bins(s, d):
    return sampling.temporal_bins(_frames(s, d), ["video_id"], "second", 6).select("video_id", "second", "bin", "bin_size")


def representatives(s, d):
    rows = sampling.representatives(_frames(s, d), ["video_id"], "second", 6, {"sharpness": 0.5, "contrast": 0.25, "change": 0.25})
    return rows.select("video_id", "bin", "second", F.round("score", 9).alias("score"))


def _videos(s, d):
    return table(s, d, "video_runs").where("video_id IS NOT NULL").groupBy("video_id").agg(F.max("fps").alias("fps"), F.max("frame_count").alias("frame_count"))


def interval_frames(s, d):
    return sampling.interval_frames(_videos(s, d), 5.0, 1.0)


def distributed_frames(s, d):
    return sampling.distributed_frames(_videos(s, d), 7)


def candidate_frames(s, d):
    v = _videos(s, d).where("fps > 0 AND frame_count >= 3")
    specs = v.select("video_id", F.lit("opening").alias("spec"), F.lit(10.0).alias("start"), F.lit(30.0).alias("end"), F.lit(2.0).alias("before"), F.lit(3.0).alias("after"), F.lit(2.0).alias("rate"), "fps", "frame_count")
    avoid = v.select("video_id", F.lit(15.0).alias("start"), F.lit(18.0).alias("end"))
    return sampling.candidate_frames(specs, avoid)


def frame_differences(s, d):
    return sampling.lag_difference(_frames(s, d), ["video_id"], "second", "sharpness").select("video_id", "second", F.round("difference", 9).alias("difference"))


def quality_summary(s, d):
    """Confidence and area of each class; a metric that isn't finite is left out, the other one of its detection stays."""
    finite = lambda x: F.when(F.abs(x) < F.lit(float("inf")), F.col(x))
    rows = table(s, d, "detections").groupBy("detection_id").agg(F.min("class_id").alias("class_id"), *(F.min(finite(x)).alias(x) for x in ("confidence", "bbox_relative_area"))).where("class_id IS NOT NULL")
    return summary.metric_summary(rows, ["confidence", "bbox_relative_area"], ["class_id"])


def _epochs(s, d):
    o = table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("run"), F.date_trunc("month", "o_orderdate").alias("m")).agg(F.count("*").alias("n"))
    return o.select("run", F.row_number().over(_window("run", "m")).alias("epoch"), ((F.col("n") * 37 % 101) / F.lit(100.0)).alias("fitness"))


def best_epoch(s, d):
    return summary.best_epochs(_epochs(s, d), ["run"], "epoch", "fitness")


def history_gaps(s, d):
    rows = _epochs(s, d).where("epoch % 17 <> 5").withColumn("fitness", F.when(F.col("epoch") == 9, F.lit(float("nan"))).otherwise(F.col("fitness")))
    return summary.history_gaps(rows, ["run"], "epoch", ["fitness"]).select("run", "epoch", F.array_join("problems", ",").alias("problems"))


# --- scalars


def clock_codes(s, d):
    v = table(s, d, "detections").groupBy("detection_id").agg(F.min("timestamp_ms").alias("ms")).where("ms >= 0")
    text = k.format_clock(F.col("ms") / F.lit(1000.0))
    return v.select("detection_id", text.alias("clock"), F.round(k.parse_clock(text), 3).alias("seconds"))


def stable_ids(s, d):
    r = _records(s, d)
    return r.select("canonical_image_id", k.stable_id("img", F.coalesce("country", F.lit("")), F.col("original_filename"), length=24).alias("stable_id"), k.filename_prefix(F.col("original_filename")).alias("prefix"), k.filename_number(F.col("original_filename")).alias("number"))


# --- reconciliation


def missing_exports(s, d):
    return reconcile.set_difference(_records(s, d).where("inclusion_status = 'retained'"), table(s, d, "export_entries"), ["canonical_image_id"])


def repeated_images(s, d):
    return reconcile.repeated_keys(table(s, d, "images"), ["canonical_image_id"])


def field_differences(s, d):
    images = _records(s, d).select("canonical_image_id", F.col("decoded_width").alias("width"), F.col("decoded_height").alias("height"))
    entries = table(s, d, "export_entries").groupBy("canonical_image_id").agg(F.min("width").alias("width"), F.min("height").alias("height"))
    both = entries.join(images.select("canonical_image_id"), "canonical_image_id", "left_semi")
    known = images.join(both.select("canonical_image_id"), "canonical_image_id", "left_semi")
    return reconcile.value_differences(known, both, ["canonical_image_id"], {"width": 0.0, "height": 0.0})


def observation_violations(s, d):
    rows = table(s, d, "detections").select("detection_id", "class_id", "confidence", "bbox_relative_area", "frame_index").distinct()
    unit = lambda x: F.col(x).between(0, 1)
    rules = {"class_id": F.col("class_id").between(0, 3), "confidence": unit("confidence"), "area": unit("bbox_relative_area"), "frame": F.col("frame_index") >= 0}
    return reconcile.violations(rows, rules).select("detection_id", F.array_join("broken", ",").alias("broken"))


def unknown_videos(s, d):
    v = table(s, d, "video_runs").where("frame_count IS NOT NULL")
    return reconcile.unreferenced(table(s, d, "detections").select("detection_id", "video_id").distinct(), v, ["video_id"])


def _jobs(s, d):
    status = F.element_at(F.array(*map(F.lit, ("queued", "running", "completed", "running", "failed"))), (F.col("event_id") % 5 + 1).cast("int"))
    return table(s, d, "events").select("user_id", "event_id", status.alias("status"))


def job_transitions(s, d):
    return reconcile.bad_transitions(_jobs(s, d), "user_id", "event_id", "status")


def job_status(s, d):
    return reconcile.job_status(_jobs(s, d), "user_id", "event_id", "status")


def split_digests(s, d):
    rows = table(s, d, "export_entries").select(F.when(norm("split") == "validation", "val").otherwise(norm("split")).alias("split"), "canonical_image_id", "source_image_sha256").where("split IS NOT NULL").distinct()
    return reconcile.group_digests(rows, ["split"], ["canonical_image_id", "source_image_sha256"], ["canonical_image_id", "source_image_sha256"])


def table_digest(s, d):
    return reconcile.table_digest(table(s, d, "images").distinct(), ["canonical_image_id", "country", "image_sha256"], ["canonical_image_id", "country", "image_sha256"])


def queries():
    named = (
        event_summary, event_associations, event_status_counts, event_reconciliation, event_totals, grouped_split_integrity, valid_observations, gap_sessions, running_counts, capture_groups, capture_group_sizes, boundary_guard, exact_duplicates,
        near_duplicates, near_duplicate_members, near_duplicate_groups, component_roots, grouped_split, grouped_split_refined, grouped_split_balance, split_conflicts, pair_conflicts, country_shares, image_summary, voc_boxes, label_lines, label_error_counts,
        class_inventory, label_roundtrip, pair_integrity, image_categories, area_histogram, disposition_matrix, hash_sample, stratified_sample, class_showcase, covering_sample, temporal_bins, representatives,
        interval_frames, distributed_frames, candidate_frames, frame_differences, quality_summary, best_epoch, history_gaps, clock_codes, stable_ids, missing_exports, repeated_images, field_differences,
        observation_violations, unknown_videos, job_transitions, job_status, split_digests, table_digest,
    )
    return {f.__name__: f for f in named}


_OBS = """video AS (SELECT video_id, max(fps) AS fps FROM video_runs WHERE video_id IS NOT NULL GROUP BY 1),
raw AS (SELECT DISTINCT detection_id, video_id, class_id::INT AS class_id, frame_index, detection_index::INT AS detection_index, timestamp_ms, confidence, bbox_relative_area AS area, bbox_xyxy_normalized AS b FROM detections),
valid AS (SELECT * FROM raw WHERE class_id BETWEEN 0 AND 3 AND frame_index >= 0 AND detection_index IS NOT NULL AND timestamp_ms IS NOT NULL AND detection_id IS NOT NULL AND video_id IS NOT NULL AND isfinite(confidence) AND isfinite(area) AND isfinite(b[1]) AND isfinite(b[2]) AND isfinite(b[3]) AND isfinite(b[4]) AND confidence BETWEEN 0 AND 1 AND area BETWEEN 0 AND 1
  AND b[1] BETWEEN 0 AND 1 AND b[2] BETWEEN 0 AND 1 AND b[3] BETWEEN 0 AND 1 AND b[4] BETWEEN 0 AND 1 AND b[1] <= b[3] AND b[2] <= b[4]),
obs AS (SELECT v.*, CASE WHEN fps > 0 THEN fps ELSE 10::DOUBLE END AS fps FROM (SELECT *, row_number() OVER (PARTITION BY video_id, class_id, frame_index, detection_index ORDER BY detection_id) AS rn FROM valid) v LEFT JOIN video USING (video_id) WHERE rn = 1)"""
_SESSION = """fresh AS (SELECT *, CASE WHEN frame_index - lag(frame_index) OVER (PARTITION BY video_id, class_id ORDER BY frame_index, detection_index) - 1 <= 5 THEN 0 ELSE 1 END AS fresh FROM obs),
ses AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id, class_id ORDER BY frame_index, detection_index) AS s FROM fresh)"""
_REC = """rec AS (SELECT canonical_image_id, r.* FROM (SELECT canonical_image_id, max({'scanned_at': scanned_at, 'country': country, 'original_filename': original_filename, 'image_sha256': image_sha256, 'perceptual_hash_dhash64': perceptual_hash_dhash64, 'decoded_width': decoded_width,
  'decoded_height': decoded_height, 'exif_timestamp_sort_ms': exif_timestamp_sort_ms, 'capture_group': capture_group, 'inclusion_status': inclusion_status, 'image_category': image_category, 'target_object_count': target_object_count}) AS r
  FROM images WHERE canonical_image_id IS NOT NULL GROUP BY 1))"""
_SPLIT = "CASE WHEN lower(trim(split)) = 'validation' THEN 'val' ELSE lower(trim(split)) END"
_SPL = f"spl AS (SELECT canonical_image_id, min({_SPLIT}) AS split FROM export_entries WHERE canonical_image_id IS NOT NULL AND split IS NOT NULL GROUP BY 1)"
_STEM = "regexp_replace(regexp_replace({0}, '^.*/', ''), '(.)\\.[^.]*$', '\\1')"


def _sid(prefix: str, length: int, *parts: str) -> str:
    return f"'{prefix}_' || substr(sha256({' || chr(0) || '.join(parts)}), 1, {length})"


_CAP = f"""cap0 AS (SELECT canonical_image_id, country, exif_timestamp_sort_ms AS ts_ms, {_STEM.format('original_filename')} AS stem FROM rec),
cap1 AS (SELECT *, regexp_replace(stem, '[0-9]+$', '') AS prefix, TRY_CAST(nullif(regexp_extract(stem, '([0-9]+)$', 1), '') AS BIGINT) AS number FROM cap0),
cap2 AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY country, prefix ORDER BY ts_ms, canonical_image_id) > 3600000 THEN 1 ELSE 0 END AS fresh FROM cap1 WHERE ts_ms IS NOT NULL),
cap3 AS (SELECT *, sum(fresh) OVER (PARTITION BY country, prefix ORDER BY ts_ms, canonical_image_id)::BIGINT AS run FROM cap2),
cap4 AS (SELECT canonical_image_id, country, prefix, number, ts_ms, 'timestamp' AS method, run, ((ts_ms - min(ts_ms) OVER (PARTITION BY country, prefix, run)) // 600000)::BIGINT AS sequence_index, concat_ws('|', country, prefix, 'timestamp', 'run:' || run) AS sequence_key FROM cap3),
cap5 AS (SELECT canonical_image_id, country, prefix, number, ts_ms, 'numeric_block_proxy' AS method, NULL::BIGINT AS run, coalesce(number // 50, 0)::BIGINT AS sequence_index, concat_ws('|', country, prefix, CASE WHEN number IS NULL THEN 'numeric_block_proxy_unparsed' ELSE 'numeric_block_proxy' END) AS sequence_key
  FROM cap1 WHERE ts_ms IS NULL),
cap AS (SELECT *, {_sid('cg', 16, 'sequence_key', "CASE WHEN method <> 'timestamp' AND number IS NULL THEN canonical_image_id ELSE sequence_index::VARCHAR END")} AS capture_group FROM (SELECT * FROM cap4 UNION ALL SELECT * FROM cap5))"""
_HASH = """hashes AS (SELECT canonical_image_id AS id, image_sha256 AS sha, decoded_width AS width, decoded_height AS height, TRY_CAST('0x' || regexp_replace(lower(trim(perceptual_hash_dhash64)), '^0x', '') AS UBIGINT) AS h FROM rec),
good AS (SELECT * FROM hashes WHERE h IS NOT NULL AND h NOT IN (0, 18446744073709551615)),
band AS (SELECT *, unnest([{'k': 0, 'v': h & 65535}, {'k': 1, 'v': (h >> 16) & 65535}, {'k': 2, 'v': (h >> 32) & 65535}, {'k': 3, 'v': h >> 48}]) AS b FROM good),
cand AS (SELECT DISTINCT x.id AS a, y.id AS b, bit_count(xor(x.h, y.h))::INT AS distance FROM band x JOIN band y ON x.b = y.b AND x.id < y.id WHERE bit_count(xor(x.h, y.h)) <= 6)"""
_LAB = """lab AS (SELECT canonical_image_id, max(label_text) AS label_text, max(country) AS country FROM export_entries WHERE canonical_image_id IS NOT NULL GROUP BY 1),
ln0 AS (SELECT canonical_image_id, country, unnest(str_split_regex(label_text, '\\r?\\n')) AS line, generate_subscripts(str_split_regex(label_text, '\\r?\\n'), 1) AS line_number FROM lab),
ln1 AS (SELECT *, str_split_regex(trim(line), '\\s+') AS p FROM ln0 WHERE trim(line) <> ''),
ln AS (SELECT canonical_image_id, country, line, line_number::INT AS line_number, len(p) AS fields, TRY_CAST(p[1] AS INT) AS class_id, TRY_CAST(p[2] AS DOUBLE) AS cx, TRY_CAST(p[3] AS DOUBLE) AS cy, TRY_CAST(p[4] AS DOUBLE) AS w, TRY_CAST(p[5] AS DOUBLE) AS h FROM ln1)"""


def _errors(places: int | None) -> str:
    tol = 0.5 * 10.0 ** -(places or 12) + 1e-12
    five, num = "fields = 5", "(class_id IS NOT NULL AND cx IS NOT NULL AND cy IS NOT NULL AND w IS NOT NULL AND h IS NOT NULL)"
    fin = f"({num} AND isfinite(cx) AND isfinite(cy) AND isfinite(w) AND isfinite(h))"
    out = " OR ".join(f"{c} - {s} / 2 < -{tol!r}::DOUBLE OR {c} + {s} / 2 > 1 + {tol!r}::DOUBLE" for c, s in (("cx", "w"), ("cy", "h")))
    rules = [
        (f"NOT ({five})", "field_count"), (f"{five} AND NOT {num}", "non_numeric"), (f"{five} AND {num} AND class_id NOT BETWEEN 0 AND 3", "class_id"), (f"{five} AND {num} AND NOT {fin}", "non_finite"),
        (f"{five} AND {fin} AND NOT (cx BETWEEN 0 AND 1 AND cy BETWEEN 0 AND 1)", "center_bounds"), (f"{five} AND {fin} AND NOT (w > 0 AND w <= 1 AND h > 0 AND h <= 1)", "size_bounds"), (f"{five} AND {fin} AND ({out})", "box_bounds"),
    ]
    if places:
        rules.append((f"{five} AND {num} AND NOT regexp_full_match(trim(line), '\\S+(\\s+\\S*\\.[0-9]{{{places}}}){{4}}')", "precision"))
    return "list_filter([" + ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for cond, name in rules) + "], lambda e: e IS NOT NULL)"


_FRAMES = "frames AS (SELECT video_id, frame_index // 100 AS second, round(max(confidence), 6) AS sharpness, max(area) AS contrast, count(*) AS change FROM obs GROUP BY 1, 2)"
_BINS = """bins AS (SELECT *, (((i + 1) * 6 - 1) // n + 1)::INT AS bin FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS n, row_number() OVER (PARTITION BY video_id ORDER BY second) - 1 AS i FROM frames)),
binned AS (SELECT *, count(*) OVER (PARTITION BY video_id, bin) AS bin_size FROM bins)"""
_VID = "vid AS (SELECT video_id, max(fps) AS fps, max(frame_count) AS frame_count FROM video_runs WHERE video_id IS NOT NULL GROUP BY 1)"
_EPO = """epo AS (SELECT run, (row_number() OVER (PARTITION BY run ORDER BY m))::INT AS epoch, (n * 37 % 101) / 100.0::DOUBLE AS fitness FROM (SELECT o_orderpriority AS run, date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2))"""
_JOB = "job AS (SELECT user_id, event_id, ['queued', 'running', 'completed', 'running', 'failed'][event_id % 5 + 1] AS status FROM events)"


def _rank(column: str) -> str:
    return f"CASE WHEN bin_size = 1 THEN 0.5 ELSE (row_number() OVER (PARTITION BY video_id, bin ORDER BY {column}, second) - 1) / (bin_size - 1) END"


def oracle_sql():
    digest = lambda line, order: f"sha256(string_agg({line}, chr(10) ORDER BY {order}) || chr(10))"
    return {
        "valid_observations": f"WITH {_OBS} SELECT detection_id, video_id, class_id, frame_index, detection_index, confidence, fps FROM obs",
        "gap_sessions": f"""WITH {_OBS}, a AS (SELECT *, CASE WHEN frame_index - lag(frame_index) OVER (PARTITION BY video_id, class_id ORDER BY frame_index, detection_index) - 1 <= 5 THEN 0 ELSE 1 END AS fresh FROM obs),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id, class_id ORDER BY frame_index, detection_index) AS s FROM a)
SELECT video_id, class_id, min(frame_index) AS island, min(frame_index) AS first_frame, max(frame_index) AS last_frame, count(*) AS observations FROM b GROUP BY video_id, class_id, s""",
        "running_counts": f"WITH {_OBS} SELECT video_id, class_id, count(*) AS detections, max(frame_index) AS last_frame FROM obs GROUP BY 1, 2",
        "event_reconciliation": f"""WITH {_OBS}, {_SESSION}, g AS (SELECT video_id, class_id, s, min(frame_index) AS island, count(*) AS n, min(frame_index) AS lo, max(frame_index) AS hi, max(confidence) AS top FROM ses GROUP BY video_id, class_id, s)
SELECT video_id, class_id, island, CASE WHEN island % 11 <> 0 THEN n + 1 END AS observation_count, CASE WHEN island % 11 <> 0 THEN lo END AS first_frame, CASE WHEN island % 11 <> 0 THEN hi END AS last_frame, CASE WHEN island % 11 <> 0 THEN top END AS max_confidence, n, lo, hi, top
FROM g WHERE island % 7 = 0 OR island % 11 = 0""",
        "event_totals": f"""WITH {_OBS} SELECT video_id, class_id, count(*) AS observations, min(frame_index) AS first_frame, max(frame_index) AS last_frame, max(confidence) AS max_confidence, max(area) AS max_area, round(sum(confidence), 6) AS confidence, count(*) AS associations FROM obs GROUP BY 1, 2""",
        "grouped_split_integrity": f"""WITH {_REC}, n AS (SELECT count(*) AS images FROM rec WHERE inclusion_status = 'retained') SELECT unnest(['plan', 'refined']) AS plan, images, 0::BIGINT AS torn, 0::BIGINT AS off FROM n""",
        "capture_groups": f"WITH {_REC}, {_CAP} SELECT canonical_image_id, prefix, number, method, run, sequence_index, sequence_key, capture_group FROM cap",
        "capture_group_sizes": f"""WITH {_REC}, {_CAP}, g AS (SELECT count(*) AS v FROM cap GROUP BY capture_group), o AS (SELECT list_sort(list(v)) AS l, count(*) AS n FROM g)
SELECT n AS groups, l[1] AS minimum, {', '.join(f'l[round_even({p} * (n - 1) / 100, 0)::INT + 1] AS p{p}' for p in (10, 25, 50, 75, 90, 95, 99))}, l[n] AS maximum, len(list_filter(l, lambda x: x = 1)) AS singletons, len(list_filter(l, lambda x: x <= 5)) AS up_to_five FROM o""",
        "boundary_guard": f"""WITH {_REC}, {_CAP}, {_SPL}, r AS (SELECT cap.*, split FROM cap JOIN spl USING (canonical_image_id)),
g AS (SELECT sequence_key, sequence_index, capture_group, method, arg_min(split, canonical_image_id) AS split, min(ts_ms) AS lo, max(ts_ms) AS hi FROM r GROUP BY ALL),
p AS (SELECT *, lead(sequence_index) OVER w AS ni, lead(capture_group) OVER w AS ng, lead(split) OVER w AS ns, lead(lo) OVER w AS nl FROM g WINDOW w AS (PARTITION BY sequence_key ORDER BY sequence_index, capture_group)),
q AS (SELECT *, concat_ws(':', 'boundary_guard_between', capture_group, split, ng, ns) AS reason FROM p WHERE ni = sequence_index + 1 AND split <> ns),
hit AS (SELECT canonical_image_id, reason FROM r JOIN q USING (capture_group) WHERE CASE WHEN q.method = 'timestamp' THEN r.ts_ms >= hi - 120000 ELSE number >= (q.sequence_index + 1) * 50 - 5 END
  UNION SELECT canonical_image_id, reason FROM r JOIN q ON r.capture_group = ng WHERE CASE WHEN q.method = 'timestamp' THEN r.ts_ms <= nl + 120000 ELSE number < (q.sequence_index + 1) * 50 + 5 END)
SELECT canonical_image_id, string_agg(reason, ';' ORDER BY reason) AS reasons FROM hit GROUP BY 1""",
        "exact_duplicates": f"""WITH r AS (SELECT DISTINCT canonical_image_id, lower(trim(image_sha256)) AS key FROM images WHERE canonical_image_id IS NOT NULL), m AS (SELECT key, count(*) AS member_count FROM r WHERE key <> '' GROUP BY key HAVING count(*) > 1)
SELECT {_sid('exact', 16, 'key')} AS duplicate_group, key, member_count, canonical_image_id FROM r JOIN m USING (key)""",
        "near_duplicates": f"""WITH {_REC}, {_HASH}, cls AS (SELECT h, width, height, min(id) AS rep, count(*) AS copies FROM good GROUP BY ALL),
cb AS (SELECT *, unnest([{{'k': 0, 'v': h & 65535}}, {{'k': 1, 'v': (h >> 16) & 65535}}, {{'k': 2, 'v': (h >> 32) & 65535}}, {{'k': 3, 'v': h >> 48}}]) AS bb FROM cls),
j AS (SELECT DISTINCT x.rep AS a, y.rep AS b, bit_count(xor(x.h, y.h))::INT AS distance, coalesce(bit_count(xor(x.h, y.h)) <= 2 AND x.width = y.width AND x.height = y.height, false) AS sure, x.copies AS a_copies, y.copies AS b_copies FROM cb x JOIN cb y ON x.bb = y.bb AND x.rep < y.rep WHERE bit_count(xor(x.h, y.h)) <= 6)
SELECT a, b, distance, CASE WHEN sure THEN 'confirmed_near_duplicate' ELSE 'candidate_warning' END AS relationship, sure AS hard_split_constraint, a_copies, b_copies FROM j""",
        "near_duplicate_members": f"""WITH {_REC}, {_HASH}, cls AS (SELECT h, width, height, min(id) AS representative, arg_min(struct_pack(s := sha), id).s AS first_sha, count(*) AS copies FROM good GROUP BY ALL)
SELECT id, representative, copies, CASE WHEN id = representative THEN 'representative' WHEN sha = first_sha THEN 'exact' WHEN good.width IS NOT NULL AND good.height IS NOT NULL THEN 'confirmed_near_duplicate' ELSE 'candidate_warning' END AS relationship
FROM good JOIN cls ON good.h = cls.h AND good.width IS NOT DISTINCT FROM cls.width AND good.height IS NOT DISTINCT FROM cls.height""",
        "near_duplicate_groups": f"""WITH RECURSIVE {_REC}, {_HASH}, e AS (SELECT a, b FROM cand UNION SELECT b, a FROM cand), reach(x, y) AS (SELECT a, a FROM e UNION SELECT x, e.b FROM reach JOIN e ON y = e.a), m AS (SELECT x, min(y) AS r FROM reach GROUP BY x)
SELECT {_sid('near_candidate', 16, "string_agg(x, chr(0) ORDER BY x)")} AS duplicate_group, count(*)::INT AS member_count, string_agg(x, ',' ORDER BY x) AS members FROM m GROUP BY r""",
        "component_roots": """WITH RECURSIVE p AS (SELECT lower(trim(first_image_id)) AS a, lower(trim(second_image_id)) AS b FROM near_duplicate_pairs), e AS (SELECT a, b FROM p WHERE a <> b UNION SELECT b, a FROM p WHERE a <> b),
reach(x, y) AS (SELECT a, a FROM e UNION SELECT x, e.b FROM reach JOIN e ON y = e.a) SELECT x AS vertex, min(y) AS root FROM reach GROUP BY x""",
        "split_conflicts": f"""WITH {_REC}, j AS (SELECT DISTINCT lower(trim(capture_group)) AS g, {_SPLIT} AS s FROM export_entries JOIN rec USING (canonical_image_id) WHERE capture_group IS NOT NULL AND split IS NOT NULL)
SELECT g AS "group", string_agg(s, ',' ORDER BY s) AS splits FROM j GROUP BY g HAVING count(*) > 1""",
        "pair_conflicts": f"""WITH {_SPL}, p AS (SELECT DISTINCT least(lower(trim(first_image_id)), lower(trim(second_image_id))) AS a, greatest(lower(trim(first_image_id)), lower(trim(second_image_id))) AS b FROM near_duplicate_pairs WHERE hard_split_constraint AND first_image_id IS NOT NULL AND second_image_id IS NOT NULL)
SELECT a, b, x.split AS a_split, y.split AS b_split FROM p JOIN spl x ON x.canonical_image_id = a JOIN spl y ON y.canonical_image_id = b WHERE x.split <> y.split AND a <> b""",
        "country_shares": f"""WITH {_REC}, {_SPL}, c AS (SELECT split, coalesce(country, 'unknown') AS country, count(*) AS n FROM spl JOIN rec USING (canonical_image_id) GROUP BY 1, 2),
p AS (SELECT *, 100.0::DOUBLE * n / sum(n) OVER (PARTITION BY split) AS percent, 100.0::DOUBLE * sum(n) OVER (PARTITION BY country) / sum(n) OVER () AS overall_percent FROM c)
SELECT split, country, n, round(percent, 9) AS percent, round(overall_percent, 9) AS overall_percent, round(percent - overall_percent, 9) AS deviation, abs(percent - overall_percent) <= 5 AS within_tolerance FROM p""",
        "image_summary": f"""WITH {_REC}, r AS (SELECT coalesce(country, 'unknown') AS country, coalesce(image_category, 'unknown') AS image_category, coalesce(target_object_count, 0) AS t FROM rec)
SELECT country, CASE WHEN grouping(image_category) = 1 THEN 'ALL' ELSE image_category END AS image_category, count(*) AS count, sum(t)::BIGINT AS targets FROM r GROUP BY GROUPING SETS ((country, image_category), (country))""",
        "voc_boxes": """WITH li AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem),
c AS (SELECT *, l_partkey % 50 AS x1, l_suppkey % 40 AS y1, CASE WHEN l_linenumber = 7 THEN NULL ELSE (l_partkey % 50 + l_quantity * 2)::BIGINT END AS x2, (l_suppkey % 40 + l_quantity - 2)::BIGINT AS y2 FROM li),
e AS (SELECT *, CASE WHEN x1 = 0 THEN 0 ELSE x1 - 1 END AS cx, CASE WHEN y1 = 0 THEN 0 ELSE y1 - 1 END AS cy FROM c),
f AS (SELECT *, x2 - cx AS w, y2 - cy AS h, x2 IS NOT NULL AND least(x1, y1, x2, y2) >= 0 AND NOT (x2 = 0 OR y2 = 0) AND NOT (x2 < x1 OR y2 < y1) AND NOT (x2 - cx <= 0 OR y2 - cy <= 0) AND NOT (x2 > 128 OR y2 > 64 OR x1 < 0 OR y1 < 0) AS sound FROM e),
g AS (SELECT *, list_sort(list_filter([CASE WHEN x2 IS NULL THEN 'non_integer_coordinate' END, CASE WHEN x2 IS NOT NULL AND (x1 = 0 OR y1 = 0) THEN 'source_zero_edge_coordinate' END, CASE WHEN x2 IS NOT NULL AND least(x1, y1, x2, y2) < 0 THEN 'negative_coordinate' END,
  CASE WHEN x2 IS NOT NULL AND (x2 = 0 OR y2 = 0) THEN 'zero_coordinate' END, CASE WHEN x2 IS NOT NULL AND (x2 < x1 OR y2 < y1) THEN 'inverted_box' END, CASE WHEN w <= 0 OR (x2 IS NOT NULL AND h <= 0) THEN 'zero_area_box' END,
  CASE WHEN x2 IS NOT NULL AND (x1 < 0 OR y1 < 0 OR x2 > 128 OR y2 > 64) THEN 'out_of_bounds' END, CASE WHEN sound AND (w / h < 0.05 OR w / h > 20) THEN 'unusual_aspect_ratio' END, CASE WHEN sound AND (w * 5.0::DOUBLE) * (h * 5.0::DOUBLE) < 4 THEN 'extremely_tiny' END], lambda z: z IS NOT NULL)) AS flags FROM f)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, array_to_string(flags, ',') AS flags, CASE WHEN sound THEN cx END AS x1, CASE WHEN sound THEN y2 END AS y2, CASE WHEN sound THEN round(x2 / 128, 9) END AS nx2, CASE WHEN sound THEN round(cy * 5.0::DOUBLE + (640 - 64 * 5.0::DOUBLE) / 2, 6) END AS py1,
  CASE WHEN sound THEN round((w * 5.0::DOUBLE) * (h * 5.0::DOUBLE), 6) END AS area FROM g""",
        "label_lines": f"WITH {_LAB} SELECT canonical_image_id, line_number, class_id, cx, cy, w, h, array_to_string({_errors(4)}, ',') AS errors FROM ln",
        "label_error_counts": f"WITH {_LAB}, x AS (SELECT {_errors(4)} AS e FROM ln), y AS (SELECT unnest(CASE WHEN len(e) = 0 THEN ['none'] ELSE e END) AS error FROM x) SELECT error, count(*) AS lines FROM y GROUP BY 1",
        "class_inventory": f"WITH {_LAB} SELECT country, class_id, count(*) AS objects, count(DISTINCT canonical_image_id) AS images FROM ln WHERE country IS NOT NULL AND class_id IS NOT NULL GROUP BY 1, 2",
        "label_roundtrip": f"""WITH {with_clause('boxes')} SELECT class_id, count(*) AS lines, count(*) AS same_class, true AS exact FROM boxes WHERE x1 >= 0 AND y1 >= 0 AND x2 <= 100 AND y2 <= 100 AND x2 > x1 AND y2 > y1 GROUP BY 1""",
        "class_showcase": """WITH s AS (SELECT filename, bool_and(len(classes_present) = 0) AS negative FROM annotated_samples WHERE filename IS NOT NULL AND classes_present IS NOT NULL AND class_max_normalized_areas IS NOT NULL GROUP BY 1),
e AS (SELECT filename, unnest(class_max_normalized_areas) AS a FROM annotated_samples WHERE filename IS NOT NULL AND len(classes_present) > 0), b AS (SELECT filename, a.class_id AS c, max(a.max_normalized_area) AS v FROM e WHERE a.class_id IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, sha256('42:' || filename) AS h FROM b), """ + ", ".join(
            f"k{n} AS (SELECT filename, '{n}' AS chosen_for, (row_number() OVER (ORDER BY v DESC NULLS LAST, h, lower(filename)))::INT AS rank FROM r WHERE c = {n}" + "".join(f" AND filename NOT IN (SELECT filename FROM k{m})" for m in range(n)) + " QUALIFY rank <= 2)" for n in range(4)
        ) + """, n AS (SELECT filename, 'negative' AS chosen_for, (row_number() OVER (ORDER BY sha256('42:' || filename), lower(filename)))::INT AS rank FROM s WHERE negative QUALIFY rank <= 2)
SELECT * FROM k0 UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM k3 UNION ALL SELECT * FROM n""",
        "pair_integrity": f"""WITH {_REC}, l AS (SELECT lower(regexp_replace(original_filename, '\\.[^.]*$', '')) AS stem, count(*) AS left_count FROM rec WHERE original_filename IS NOT NULL GROUP BY 1),
r AS (SELECT lower(stem) AS stem, count(*) AS right_count FROM (SELECT DISTINCT regexp_replace(filename, '\\.[^.]*$', '') AS stem FROM annotated_samples WHERE filename IS NOT NULL) GROUP BY 1),
j AS (SELECT stem, coalesce(left_count, 0) AS left_count, coalesce(right_count, 0) AS right_count FROM l FULL JOIN r USING (stem))
SELECT * FROM (SELECT *, CASE WHEN left_count = 0 THEN 'missing_left' WHEN right_count = 0 THEN 'missing_right' WHEN left_count > 1 OR right_count > 1 THEN 'duplicate_stem' END AS problem FROM j) WHERE problem IS NOT NULL""",
        "image_categories": f"""WITH {_LAB}, o AS (SELECT canonical_image_id AS image_id, CASE WHEN class_id BETWEEN 0 AND 3 THEN 't' WHEN class_id > 3 THEN 'n' ELSE 'u' END AS a, CASE WHEN len({_errors(None)}) > 0 THEN 'q' WHEN w * h < 0.002::DOUBLE THEN 'r' ELSE 't' END AS s FROM ln),
c AS (SELECT image_id, count(*) FILTER (WHERE a = 't') AS targets, count(*) FILTER (WHERE a = 't' AND s = 't') AS valid_targets, count(*) FILTER (WHERE a = 't' AND s = 'r') AS rejected_targets, count(*) FILTER (WHERE a = 't' AND s = 'q') AS quarantined_targets, count(*) FILTER (WHERE a = 'n') AS non_targets,
  count(*) FILTER (WHERE a = 'u') AS unknown, count(*) AS objects FROM o GROUP BY 1), x AS (SELECT *, unknown > 0 OR quarantined_targets > 0 AS bad FROM c)
SELECT * EXCLUDE (bad), CASE WHEN bad THEN 'quarantined' WHEN valid_targets > 0 AND non_targets > 0 THEN 'mixed_target_and_known_non_target' WHEN valid_targets > 0 THEN 'target_only' WHEN non_targets > 0 THEN 'known_non_target_only' ELSE 'empty_xml' END AS image_category, NOT bad AND valid_targets > 0 AS is_positive,
  NOT bad AND valid_targets = 0 AS is_negative, CASE WHEN bad THEN 'quarantined' ELSE 'retained' END AS inclusion_status FROM x""",
        "area_histogram": """WITH r AS (SELECT detection_id, min(bbox_relative_area) AS a, min(class_id) AS class_id FROM detections GROUP BY 1)
SELECT class_id, CASE WHEN a < 0.001::DOUBLE THEN '[0,0.001)' WHEN a < 0.005::DOUBLE THEN '[0.001,0.005)' WHEN a < 0.01::DOUBLE THEN '[0.005,0.01)' WHEN a < 0.05::DOUBLE THEN '[0.01,0.05)' WHEN a < 0.25 THEN '[0.05,0.25)' WHEN a < 1 THEN '[0.25,1)' ELSE '[1,inf)' END AS bucket, count(*) AS count
FROM r WHERE class_id IS NOT NULL AND a >= 0 AND NOT isnan(a) GROUP BY 1, 2""",
        "disposition_matrix": f"""WITH {_REC} SELECT coalesce(country, 'unknown') AS country, count(*) FILTER (WHERE inclusion_status = 'retained') AS retained, count(*) FILTER (WHERE inclusion_status = 'guard_excluded') AS guard_excluded, count(*) FILTER (WHERE inclusion_status = 'quarantined') AS quarantined
FROM rec WHERE inclusion_status IS NOT NULL GROUP BY 1""",
        "hash_sample": f"WITH {_REC} SELECT canonical_image_id, sha256('42:review:' || canonical_image_id) AS rank_key FROM rec ORDER BY 2, 1 LIMIT 100",
        "stratified_sample": f"""WITH {_REC}, r AS (SELECT coalesce(country, 'unknown') AS country, coalesce(image_category, 'unknown') AS image_category, canonical_image_id FROM rec),
k AS (SELECT *, row_number() OVER (PARTITION BY country, image_category ORDER BY sha256('42:' || canonical_image_id), canonical_image_id) AS rank FROM r) SELECT country, image_category, rank::INT AS rank, canonical_image_id FROM k WHERE rank <= 5""",
        "temporal_bins": f"WITH {_OBS}, {_FRAMES}, {_BINS} SELECT video_id, second, bin, bin_size FROM binned",
        "representatives": f"""WITH {_OBS}, {_FRAMES}, {_BINS}, s AS (SELECT *, ({_rank('sharpness')}) * 0.5::DOUBLE + ({_rank('contrast')}) * 0.25::DOUBLE + ({_rank('change')}) * 0.25::DOUBLE AS score FROM binned),
b AS (SELECT *, row_number() OVER (PARTITION BY video_id, bin ORDER BY score DESC, second) AS k FROM s) SELECT video_id, bin, second, round(score, 9) AS score FROM b WHERE k = 1""",
        "interval_frames": f"""WITH {_VID}, v AS (SELECT *, greatest(1, round_even(5.0 * fps, 0)::BIGINT) AS step, greatest(1, round_even(1.0 * fps, 0)::BIGINT) AS margin FROM vid WHERE fps > 0 AND frame_count >= 3)
SELECT video_id, unnest(range(margin, frame_count - margin, step)) AS frame_index FROM v WHERE margin < frame_count - margin""",
        "distributed_frames": f"""WITH {_VID}, v AS (SELECT *, frame_count - 1 AS last, least(greatest(1, round_even(fps, 0)::BIGINT), (frame_count - 2) // 2) AS margin FROM vid WHERE fps > 0 AND frame_count >= 9),
w AS (SELECT video_id, CASE WHEN last - 2 * margin + 1 < 7 THEN 1 ELSE margin END AS lo, CASE WHEN last - 2 * margin + 1 < 7 THEN last - 1 ELSE last - margin END AS hi FROM v)
SELECT video_id, sample, lo + ((hi - lo) * sample + 3) // 6 AS frame_index FROM (SELECT *, unnest(range(7))::INT AS sample FROM w)""",
        "candidate_frames": f"""WITH {_VID}, v AS (SELECT video_id, fps, round_even(8.0 * fps, 0)::BIGINT AS a, least(frame_count - 1, round_even(least((frame_count - 1) / fps, 33.0) * fps, 0)::BIGINT) AS b, greatest(1, round_even(fps / 2.0, 0)::BIGINT) AS step FROM vid WHERE fps > 0 AND frame_count >= 3),
f AS (SELECT video_id, fps, unnest(range(a, b + 1, step)) AS frame_index FROM v WHERE a <= b) SELECT video_id, 'opening' AS spec, frame_index FROM f WHERE NOT (frame_index / fps BETWEEN 15 AND 18)""",
        "frame_differences": f"WITH {_OBS}, {_FRAMES} SELECT video_id, second, round(abs(sharpness - lag(sharpness) OVER (PARTITION BY video_id ORDER BY second)), 9) AS difference FROM frames",
        "quality_summary": """WITH r AS (SELECT detection_id, min(class_id) AS class_id, min(confidence) FILTER (WHERE isfinite(confidence)) AS confidence, min(bbox_relative_area) FILTER (WHERE isfinite(bbox_relative_area)) AS bbox_relative_area FROM detections GROUP BY 1),
l AS (SELECT class_id, unnest([{'metric': 'confidence', 'v': confidence}, {'metric': 'bbox_relative_area', 'v': bbox_relative_area}], recursive := true) FROM r WHERE class_id IS NOT NULL)
SELECT class_id, metric, count(*) AS count, round_even(min(v), 4) AS minimum, round_even(max(v), 4) AS maximum, round_even(avg(v), 4) AS mean, round_even(median(v), 4) AS median FROM l WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY 1, 2""",
        "best_epoch": f"""WITH {_EPO}, a AS (SELECT *, coalesce(max(fitness) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM epo), b AS (SELECT *, CASE WHEN fitness > before OR before = 0 THEN epoch END AS e FROM a),
c AS (SELECT run, epoch, fitness, greatest(max(fitness) OVER w, 0) AS best_fitness, max(e) OVER w AS best_epoch FROM b WINDOW w AS (PARTITION BY run ORDER BY epoch))
SELECT *, epoch - best_epoch AS epochs_without_improvement, epoch - best_epoch >= 20 AS patience_exhausted FROM c""",
        "history_gaps": f"""WITH {_EPO}, r AS (SELECT run, epoch, epoch = 9 AS bad, row_number() OVER (PARTITION BY run ORDER BY epoch) AS n FROM epo WHERE epoch % 17 <> 5)
SELECT run, epoch, concat_ws(',', CASE WHEN n <> epoch THEN 'epoch_gap' END, CASE WHEN bad THEN 'not_finite:fitness' END) AS problems FROM r WHERE n <> epoch OR bad""",
        "clock_codes": """WITH v AS (SELECT detection_id, min(timestamp_ms) AS ms FROM detections GROUP BY 1)
SELECT detection_id, CASE WHEN ms // 3600000 < 10 THEN lpad((ms // 3600000)::VARCHAR, 2, '0') ELSE (ms // 3600000)::VARCHAR END || ':' || lpad((ms // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((ms // 1000 % 60)::VARCHAR, 2, '0') || '.' || lpad((ms % 1000)::VARCHAR, 3, '0') AS clock, round(ms / 1000, 3) AS seconds FROM v WHERE ms >= 0""",
        "stable_ids": f"""WITH {_REC}, r AS (SELECT *, {_STEM.format('original_filename')} AS stem FROM rec) SELECT canonical_image_id, {_sid('img', 24, "coalesce(country, '')", 'original_filename')} AS stable_id, regexp_replace(stem, '[0-9]+$', '') AS prefix, TRY_CAST(nullif(regexp_extract(stem, '([0-9]+)$', 1), '') AS BIGINT) AS number FROM r""",
        "missing_exports": f"""WITH {_REC}, e AS (SELECT DISTINCT canonical_image_id FROM rec WHERE inclusion_status = 'retained'), a AS (SELECT DISTINCT canonical_image_id FROM export_entries)
SELECT canonical_image_id, 'missing' AS side FROM e ANTI JOIN a USING (canonical_image_id) UNION ALL SELECT canonical_image_id, 'unexpected' FROM a ANTI JOIN e USING (canonical_image_id)""",
        "repeated_images": "SELECT canonical_image_id, count(*) AS count FROM images GROUP BY 1 HAVING count(*) > 1",
        "field_differences": f"""WITH {_REC}, e AS (SELECT canonical_image_id, min(width) AS width, min(height) AS height FROM export_entries GROUP BY 1), j AS (SELECT canonical_image_id, decoded_width AS w, decoded_height AS h, width, height FROM rec JOIN e USING (canonical_image_id)),
x AS (SELECT canonical_image_id, 'width' AS field, w::DOUBLE AS expected, width::DOUBLE AS actual FROM j UNION ALL SELECT canonical_image_id, 'height', h, height FROM j) SELECT * FROM x WHERE (expected IS NULL) <> (actual IS NULL) OR expected <> actual""",
        "observation_violations": """WITH r AS (SELECT DISTINCT detection_id, class_id, confidence, bbox_relative_area, frame_index FROM detections),
x AS (SELECT detection_id, concat_ws(',', CASE WHEN NOT coalesce(class_id BETWEEN 0 AND 3, false) THEN 'class_id' END, CASE WHEN NOT coalesce(confidence BETWEEN 0 AND 1, false) THEN 'confidence' END, CASE WHEN NOT coalesce(bbox_relative_area BETWEEN 0 AND 1, false) THEN 'area' END,
  CASE WHEN NOT coalesce(frame_index >= 0, false) THEN 'frame' END) AS broken FROM r) SELECT * FROM x WHERE broken <> ''""",
        "unknown_videos": "SELECT detection_id, video_id FROM (SELECT DISTINCT detection_id, video_id FROM detections) d WHERE NOT EXISTS (SELECT 1 FROM video_runs v WHERE v.video_id = d.video_id AND frame_count IS NOT NULL)",
        "job_transitions": f"""WITH {_JOB}, x AS (SELECT user_id, event_id, lag(status) OVER (PARTITION BY user_id ORDER BY event_id) AS from_status, status AS to_status FROM job)
SELECT * FROM x WHERE NOT coalesce((from_status, to_status) IN (('queued', 'running'), ('queued', 'failed'), ('running', 'completed'), ('running', 'interrupted'), ('running', 'failed')), false) AND NOT (from_status IS NULL AND to_status = 'queued')""",
        "job_status": f"""WITH {_JOB} SELECT user_id, arg_max(status, event_id) AS status, min(event_id) AS created_at, min(event_id) FILTER (WHERE status = 'running') AS started_at, max(event_id) FILTER (WHERE status IN ('completed', 'failed', 'interrupted')) AS ended_at FROM job GROUP BY 1""",
        "split_digests": f"""WITH r AS (SELECT DISTINCT {_SPLIT} AS split, canonical_image_id, source_image_sha256 FROM export_entries WHERE split IS NOT NULL), l AS (SELECT *, coalesce(canonical_image_id, '') || '|' || coalesce(source_image_sha256, '') AS line FROM r),
b AS (SELECT split, substr(sha256(line), 1, 2) AS bucket, count(*) AS n, {digest('line', 'canonical_image_id NULLS FIRST, source_image_sha256 NULLS FIRST')} AS d FROM l GROUP BY 1, 2)
SELECT split, sum(n)::BIGINT AS rows, {digest('d', 'bucket')} AS digest FROM b GROUP BY 1""",
    }
