import random

import pytest
from pyspark.sql import functions as F

from detlake.functions import geometry as g
from detlake.operators import errors, matching, metrics

GT = "image_id long, gi int, class_id int, x1 double, y1 double, x2 double, y2 double"
PRED = "image_id long, pi int, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double"


def overlap(a, b):
    w = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w
    return w / u if u else 0.0


def sequential(gt, pred, least=0.5):
    """Plain greedy matcher of one image."""
    free, out = sorted(gt, key=lambda t: (t[3:], t[1])), []
    for p in sorted(pred, key=lambda p: (-p[3], p[2], p[4:], p[1])):
        options = [(-overlap(p[4:], t[3:]), t[3:], t[1], t) for t in free if t[2] == p[2] and overlap(p[4:], t[3:]) >= least]
        if options:
            best = min(options)[3]
            free.remove(best)
            out.append((p[0], p[1], best[1]))
    return out


def random_boxes(seed, images=30):
    rng = random.Random(seed)
    gt, pred = [], []

    def box():
        x, y = rng.randrange(6), rng.randrange(6)
        return (float(x), float(y), float(x + rng.randrange(3, 7)), float(y + rng.randrange(3, 7)))

    for i in range(images):
        gt += [(i, n, rng.randrange(4), *box()) for n in range(rng.randrange(5))]
        pred += [(i, n, rng.randrange(4), rng.randrange(1, 10) / 10, *box()) for n in range(rng.randrange(7))]
    return gt, pred


def test_hand_computed_overlaps(spark):
    rows = [((0, 0, 10, 10), (5, 0, 15, 10), 1 / 3), ((0, 0, 10, 10), (0, 0, 5, 10), 0.5), ((0, 0, 10, 10), (10, 0, 20, 10), 0.0)]
    df = spark.createDataFrame([(*map(float, a), *map(float, b), e) for a, b, e in rows], "px1 double, py1 double, px2 double, py2 double, gx1 double, gy1 double, gx2 double, gy2 double, e double")
    for r in df.select(g.iou(g.box("p"), g.box("g")).alias("v"), g.tracked_iou(g.box("p"), g.box("g")).alias("t"), "e").collect():
        assert r.v == pytest.approx(r.e) and r.t == pytest.approx(r.e)


def test_degenerate_boxes_and_buckets(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0)], "x1 double, y1 double, x2 double, y2 double")
    assert df.select(g.tracked_iou(g.box(), g.box()), g.area_ratio(g.box(), g.box()), g.center_distance(g.box(), g.box())).first() == (0.0, 0.0, 0.0)
    v = spark.createDataFrame([(0.009999,), (0.01,), (0.05,), (1.0,), (2.0,)], "v double")
    assert [r[0] for r in v.select(g.bucket(F.col("v"), errors.SIZES)).collect()] == ["small", "medium", "large", "large", None]


@pytest.mark.parametrize("seed", range(3))
def test_fold_equals_the_sequential_matcher(spark, seed):
    gt, pred = random_boxes(seed)
    want = sorted(m for i in range(30) for m in sequential([t for t in gt if t[0] == i], [p for p in pred if p[0] == i]))
    for a, b in ((gt, pred), (gt[::-1], pred[::-1])):
        got = matching.match(spark.createDataFrame(a, GT), spark.createDataFrame(b, PRED)).select("image_id", "pi", "gi").collect()
        assert sorted(map(tuple, got)) == want


def test_duplicates_and_negatives(spark):
    gt = [(1, 0, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 2, 0.0, 0.0, 10.0, 10.0)]
    pred = [(1, 0, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 1, 0, 0.8, 0.0, 0.0, 10.0, 10.0), (1, 2, 1, 0.7, 0.0, 0.0, 10.0, 10.0), (1, 3, 2, 0.6, 0.0, 0.0, 5.0, 10.0), (2, 0, 0, 0.9, 0.0, 0.0, 5.0, 5.0), (2, 1, 0, 0.8, 0.0, 0.0, 5.0, 5.0)]
    g_, p_ = spark.createDataFrame(gt, GT), spark.createDataFrame(pred, PRED)
    rows = {r.class_code: r for r in metrics.point(g_, p_.where("image_id = 1"), 0.0).collect()}
    assert (rows["D00"].tp, rows["D00"].fp, rows["D20"].tp, rows["D10"].fp, rows["D40"].f1) == (1, 1, 1, 1, 0.0)
    assert rows["D00"].precision == 0.5 and rows["D00"].recall == 1.0
    images = spark.createDataFrame([(1,), (2,), (3,)], "image_id long")
    assert tuple(metrics.negative_stats(images, g_, p_).first()) == (2, 2, 1, 1.0, 0.5)


def test_published_macro_f1():
    a = metrics.exact_macro_f1([(304, 302, 518), (248, 242, 328), (774, 414, 414), (340, 287, 451)])
    assert a == "6001672925/11872012152"
    assert metrics.exact_macro_f1([(303, 333, 519), (248, 287, 328), (769, 489, 419), (356, 303, 435)]) == "237211777087/478756619550"


def test_sweep_equals_matching_anew(spark):
    gt, pred = random_boxes(7)
    g_, p_ = spark.createDataFrame(gt, GT), spark.createDataFrame(pred, PRED)
    images = spark.range(32).select(F.col("id").alias("image_id"))
    grid = [0.1, 0.3, 0.5, 0.9, 0.95]
    swept = {(r.threshold, r.class_id): (r.tp, r.fp, r.fn, r.negative_fp, r.negative_images_with_fp) for r in metrics.sweep(images, g_, p_, grid).collect()}
    assert len(swept) == 20
    for t in grid:
        kept = p_.where(F.col("confidence") >= t)
        n = metrics.negative_stats(images, g_, kept).first()
        for r in metrics.point(g_, p_, t).collect():
            assert swept[t, r.class_id] == (r.tp, r.fp, r.fn, n.negative_fp, n.negative_images_with_fp)


def test_selection_order(spark):
    cols = "nms_iou double, threshold double, macro_f1_exact string, negative_fp long"
    rows = [(0.5, 0.5, "1/2", 3), (0.6, 0.6, "2/4", 2), (0.5, 0.6, "1/2", 2), (0.7, 0.9, "1/3", 0)]
    best = metrics.select_point(spark.createDataFrame(rows, cols), [0.5, 0.6, 0.7], "nms_iou").first()
    assert (best.nms_iou, best.threshold, best.points_after_f1, best.points_after_negative_fp, best.points_after_confidence) == (0.5, 0.6, 3, 2, 2)
    with pytest.raises(ValueError):
        metrics.select_point(spark.createDataFrame(rows, cols))


def test_empty_inputs(spark):
    g_, p_ = spark.createDataFrame([], GT), spark.createDataFrame([], PRED)
    images = spark.createDataFrame([(1, "India", 10, 10)], "image_id long, site string, width int, height int")
    assert [r.support for r in metrics.point(g_, p_, 0.5).collect()] == [0] * 4
    o = errors.outcome(images, g_, p_, errors.Point(0.3))
    assert errors.misses(o, errors.Point(0.3)).count() == 0 and errors.confusion_matrix(o).count() == 25
    assert errors.ranked_queues(o, errors.Point(0.3)).count() == 0


def test_suppression(spark):
    rows = [(1, 0, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 1, 0, 0.8, 1.0, 0.0, 10.0, 10.0), (1, 2, 0, 0.7, 20.0, 0.0, 30.0, 10.0), (1, 3, 1, 0.6, 0.0, 0.0, 10.0, 10.0)]
    assert sorted(r.pi for r in matching.suppress(spark.createDataFrame(rows, PRED)).collect()) == [0, 2, 3]


def test_nearest_rank(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in range(11)] + [("b", 1.0), ("a", None)], "k string, v double")
    got = {r.k: r for r in errors.nearest_rank_quantiles(rows, ["k"], "v").collect()}
    assert (got["a"].p10, got["a"].p25, got["a"].median, got["a"].p90, got["a"]["count"]) == (1.0, 2.0, 5.0, 9.0, 11)
    assert got["b"].p75 == 1.0
