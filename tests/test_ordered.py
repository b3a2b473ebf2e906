"""Ranges of a key, digests of streams and buckets, shares of bundles, and validators, against plain versions."""

import hashlib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from detlake.operators import audits, errors, grouping, matching, ordered, reconcile


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_cumulated_equals_a_plain_sum(spark, parts):
    rng = random.Random(parts)
    rows = list({(rng.choice(("a", "a", "a", "b", None)), round(rng.random() ** 3, 3)) for _ in range(700)})
    rows = [(k, v, rng.randrange(5), "x") for k, v in rows] + [("one", 0.5, 2, "x")]
    df = spark.createDataFrame(rows, "k string, v double, c long, _b string")
    got = {(r.k, r.v): (r.c_upto, r.c_of) for r in ordered.cumulated(df.drop("_b"), ["k"], "v", ["c"], parts).collect()}
    assert len(got) == len(rows)
    for k, v, _, _ in rows:
        mine = [(x, c) for g, x, c, _ in rows if g == k]
        assert got[(k, v)] == (sum(c for x, c in mine if x <= v), sum(c for _, c in mine))
    assert ordered.cumulated(df.drop("_b").limit(0), ["k"], "v", ["c"]).count() == 0


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_previous_value_crosses_blocks(spark, block):
    rng = random.Random(block)
    rows = [(k, n, rng.random()) for k in ("a", "b", None) for n in sorted(rng.sample(range(90), 30))] + [("c", 5, 0.5)]
    got = {(r.k, r.n): r.previous for r in ordered.previous(spark.createDataFrame(rows, "k string, n long, v double").repartition(3), ["k"], "n", [], "v", block).collect()}
    for k in ("a", "b", "c", None):
        mine = [r for r in rows if r[0] == k]
        assert [got[(k, n)] for _, n, _ in mine] == [None, *(v for _, _, v in mine[:-1])]


def test_stream_digest_is_that_of_the_bytes(spark):
    rows = [(s, n, f"line {n}\n" if n % 5 else None) for n in range(60) for s in ("train", None) if (n + len(s or "")) % 3]
    df = spark.createDataFrame(rows, "split string, n long, t string").repartition(7)
    got = {r.split: (r.rows, r.digest) for r in reconcile.stream_digests(df, ["split"], ["n"], F.col("t"), head="<", between="|", tail=">").collect()}
    for s in ("train", None):
        mine = [t or "" for k, n, t in sorted(rows, key=lambda r: r[1]) if k == s]
        assert got[s] == (len(mine), hashlib.sha256(("<" + "|".join(mine) + ">").encode()).hexdigest())
    assert reconcile.stream_digests(df.limit(0), [], ["n"], F.col("t")).count() == 0


def test_group_digests_see_every_change_and_no_partitioning(spark):
    rows = [("a", f"i{n}", f"h{n}") for n in range(300)]
    digest = lambda data: reconcile.group_digests(spark.createDataFrame(data, "g string, i string, h string").repartition(3), ["g"], ["i", "h"], ["i"]).first()
    one = digest(rows)
    assert one == digest(rows[::-1]) and one.rows == 300
    assert one.digest != digest(rows[:-1] + [("a", "i299", "other")]).digest


def test_shares_are_the_cheapest_whole_numbers():
    rng = random.Random(5)
    for _ in range(200):
        grow, steep, many = [rng.uniform(-5, 5) for _ in range(3)], [rng.uniform(0.05, 3) for _ in range(3)], rng.randrange(9)
        cost = lambda c: sum(g * x + a * x * x for g, a, x in zip(grow, steep, c))
        best = min(cost((x, y, many - x - y)) for x in range(many + 1) for y in range(many + 1 - x))
        got = grouping._shares(grow, steep, many, ["a", "b", "c"])
        assert sum(got) == many and min(got) >= 0 and cost(got) <= best + 1e-6


def test_rows_of_an_image_match_as_the_matcher_does(spark):
    rng = random.Random(9)
    box = lambda: (x := rng.uniform(0, 6), y := rng.uniform(0, 6), x + rng.uniform(2, 5), y + rng.uniform(2, 5))
    gt = [(i, n, rng.randrange(2), *box()) for i in range(30) for n in range(rng.randrange(5))]
    pred = [(i, n, rng.randrange(2), rng.choice((0.1, 0.4, 0.4, 0.9)), *box()) for i in range(30) for n in range(rng.randrange(6))]
    corners = "x1 double, y1 double, x2 double, y2 double"
    g_, p_ = spark.createDataFrame(gt, f"image_id long, gi int, class_id int, {corners}"), spark.createDataFrame(pred, f"image_id long, pi int, class_id int, confidence double, {corners}")
    images = spark.createDataFrame([(i, "s", 10, 10) for i in range(31)], "image_id long, site string, width int, height int")
    at = errors.Point(0.3, overlap=0.3)
    o = errors.outcome(images, g_, p_, at)
    ids = lambda df: {(r.image_id, r.pi, r.gi) for r in df.collect()}
    want = ids(matching.match(g_, p_.where("confidence >= 0.3"), 0.3))
    assert want and ids(o.matches) == want
    assert errors.misses(o, at).count() == len(gt) - len(want) == errors.misses_exclusive(o, at).count()
    assert errors.alarms(o, at).count() == sum(p[3] >= 0.3 for p in pred) - len(want) == errors.alarms_exclusive(o).count()
    free_gt, free_pred = matching.unmatched(g_, o.matches, "gi"), matching.unmatched(p_.where("confidence >= 0.3"), o.matches, "pi")
    assert ids(o.confusions) == ids(matching.residual_pairs(free_gt, free_pred, 0.3, None, same_class=False))


def test_export_rules(spark):
    entry = "canonical_image_id string, split string, width int, height int, source_image_sha256 string, exported_image_relative_path string, is_positive boolean, label_text string, rule string"
    good = ("a", "train", 4, 4, "AA", "p/a", True, "0 0 0 0 0\n", "x")
    rows = [good, good, ("b", "val ", 4, 5, "bb", "p/b", False, "0 1\n", "x"), ("c", "odd", 4, 4, None, "p/a", True, None, "x"), ("d", "train", 4, 4, "dd", None, None, "", "x"), ("d", "validation", 4, 4, "dd", None, None, "", "x"), (None, "train", 1, 1, None, None, None, None, None)]
    record = "canonical_image_id string, inclusion_status string, decoded_width int, decoded_height int, image_sha256 string, capture_group string"
    records = [("a", "retained", 4, 4, "aa", "g"), ("b", "quarantined", 4, 4, "other", " G"), ("d", "retained", 4, 4, None, None), ("e", "retained", 4, 4, "ee", None)]
    got = {tuple(r) for r in audits.export_violations(spark.createDataFrame(rows, entry), spark.createDataFrame(records, record)).collect()}
    assert got == {
        ("a", "path_repeated"), ("a", "group_conflict"), ("b", "group_conflict"), ("b", "not_retained"), ("b", "size_mismatch"), ("b", "hash_mismatch"), ("b", "negative_with_boxes"), ("c", "unknown_image"), ("c", "split_unknown"),
        ("c", "label_missing"), ("c", "positive_without_boxes"), ("c", "path_repeated"), ("d", "split_conflict"), ("e", "not_exported"),
    }
    empty = spark.createDataFrame([], entry)
    assert audits.export_violations(empty, spark.createDataFrame([], record)).count() == 0


def test_run_rules(spark):
    d = [(1, "v", 0, 0, 0), (1, "v", 0, 0, 0), (2, "v", 0, 0, 100), (3, "v", 12, 0, 1200), (4, "v", -1, None, None), (5, "w", 3, 0, 5), (6, "u", 1, 0, 9), (None, None, 1, 1, 1)]
    rows = spark.createDataFrame(d, "detection_id long, video_id string, frame_index long, detection_index int, timestamp_ms long")
    videos = spark.createDataFrame([("v", 10.0, 10), ("w", None, 9)], "video_id string, fps double, frame_count long")
    got = {tuple(r) for r in audits.run_violations(rows, videos).select("video_id", "rule", "n").collect()}
    assert got == {("v", "beyond_end", 1), ("v", "negative_frame", 1), ("v", "clock", 1), ("v", "no_time", 1), ("v", "repeated_index", 1), ("w", "incomplete", 5), ("u", "unknown_video", 1)}


def test_exchange_paths_are_in_the_shared_folder(spark):
    from detlake.session import exchange_path, shared_folder

    a, b = exchange_path(spark, "x"), exchange_path(spark, "x")
    assert a != b and a.startswith(shared_folder(spark).rstrip("/")) and uuid.UUID(a[-32:])
