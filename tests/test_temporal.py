import math
import random

import pytest
from pyspark.sql import functions as F

from detlake.operators import temporal
from detlake.streaming import events as streaming

COLS = "video_id string, class_id int, frame_index long, detection_index int, timestamp_ms long, confidence double, area double, pixels double, x1 double, y1 double, x2 double, y2 double, fps double, detection_id long"


def obs(frame, cls=0, index=0, box=(0.0, 0.0, 0.1, 0.1), conf=0.5, area=0.01, fps=10.0, video="v"):
    return (video, cls, frame, index, frame * 100, conf, area, area * 10_000, *box, fps, frame * 100 + cls * 10 + index)


def found(spark, rows, rules=temporal.Rules(), block=temporal.BLOCK_FRAMES):
    df = spark.createDataFrame(rows, COLS)
    return sorted((r.video_id, r.class_id, r.first_frame, r.first_index, r.last_frame, r.observation_count, r.status) for r in temporal.events(df, rules).collect())


def brute(rows, rules):
    """One pass over each whole video, written without islands or partitions."""
    out = []
    for video in sorted({r[0] for r in rows}):
        mine = sorted((r for r in rows if r[0] == video), key=lambda r: (r[2], r[1], r[3]))
        gap = max(0, math.floor(rules.max_gap_seconds * mine[0][12] + 1e-9))
        active = []
        for frame in sorted({r[2] for r in mine}):
            for e in [e for e in active if frame - e["last"] - 1 > gap]:
                active.remove(e)
                out.append(e)
            now = [r for r in mine if r[2] == frame]
            edges = []
            for e in active:
                for r in now:
                    a, b = e["box"], r[8:12]
                    if e["cls"] != r[1]:
                        continue
                    w = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
                    aa, ba = max(0, a[2] - a[0]) * max(0, a[3] - a[1]), max(0, b[2] - b[0]) * max(0, b[3] - b[1])
                    u, big = aa + ba - w, max(aa, ba)
                    iou, ratio = (w / u if u > 0 else 0.0), (min(aa, ba) / big if big else 0.0)
                    dist = math.hypot((a[0] + a[2]) / 2 - (b[0] + b[2]) / 2, (a[1] + a[3]) / 2 - (b[1] + b[3]) / 2)
                    if iou >= rules.min_iou or (dist <= rules.max_distance and ratio >= rules.min_area_ratio):
                        edges.append(((-iou, dist, -ratio, e["first"], r[3]), id(e), e, r))
            used_e, used_r = set(), set()
            for _, k, e, r in sorted(edges, key=lambda x: x[0]):
                if k not in used_e and r[13] not in used_r:
                    used_e.add(k)
                    used_r.add(r[13])
                    e["last"], e["box"], e["n"] = frame, r[8:12], e["n"] + 1
            for r in now:
                if r[13] not in used_r:
                    active.append({"cls": r[1], "first": (frame, r[3]), "last": frame, "box": r[8:12], "n": 1, "video": video})
        out += active
    return sorted((e["video"], e["cls"], *e["first"], e["last"], e["n"], "confirmed" if e["n"] >= rules.confirmed_at else "tentative") for e in out)


@pytest.mark.parametrize("fps, first, again", [(10.0, (0, 3), 7), (25.0, (0, 6), 13)])
def test_gap_boundaries(spark, fps, first, again):
    rows = [obs(f, fps=fps) for f in (*first, again)]
    assert [(e[2], e[4]) for e in found(spark, rows)] == [first, (again, again)]


@pytest.mark.parametrize("seed", range(2))
def test_random_videos(spark, seed):
    rng = random.Random(seed)
    rows = []
    for video in "ab":
        for f in range(0, 300):
            for i in range(rng.choice((0, 0, 1, 2))):
                x, y = rng.choice((0.1, 0.13, 0.4)), rng.choice((0.1, 0.5))
                rows.append((video, rng.randrange(2), f, i, f * 100, rng.random(), 0.04, 10.0, x, y, x + 0.2, y + rng.choice((0.2, 0.0)), 10.0, len(rows)))
    rules = temporal.Rules()
    assert found(spark, rows, rules) == brute(rows, rules)


def test_islands_over_blocks(spark):
    rows = spark.createDataFrame([obs(f) for f in (0, 1, 5, 9, 12, 40, 41)], COLS)
    got = [tuple(r) for r in temporal.islands(rows, F.lit(4), block_frames=4).select("frame_index", "island").orderBy("frame_index").collect()]
    assert got == [(0, 0), (1, 0), (5, 0), (9, 0), (12, 0), (40, 40), (41, 40)]


def test_aggregates_and_representative(spark):
    rows = [obs(0, conf=0.2, area=0.01), obs(1, conf=0.6, area=0.04), obs(2, conf=1.0, area=0.09)]
    e = temporal.events(spark.createDataFrame(rows, COLS)).first()
    assert e.mean_confidence == pytest.approx(0.6) and e.max_confidence == 1.0 and e.mean_relative_area == pytest.approx(0.14 / 3) and e.status == "confirmed"
    rows = [obs(0, conf=0.5, area=0.01), obs(1, conf=0.5, area=0.02), obs(2, conf=0.5, area=0.02)]
    e = temporal.events(spark.createDataFrame(rows, COLS)).first()
    assert (e.representative_frame, e.representative_timestamp_ms) == (1, 100)


def test_numbers_and_reasons(spark):
    rows = [obs(0), obs(1), obs(0, cls=3, box=(0.5, 0.5, 0.6, 0.6)), obs(20)]
    df = spark.createDataFrame(rows, COLS)
    ends = spark.createDataFrame([("v", 21, 10.0)], "video_id string, last_frame long, fps double")
    out = [(r.event_id, r.class_id, r.finalized_reason) for r in temporal.finished(temporal.events(df), ends).orderBy("event_id").collect()]
    assert out == [("RD0001", 0, "maximum_temporal_gap_exceeded"), ("RD0002", 3, "maximum_temporal_gap_exceeded"), ("RD0003", 0, "processing_scope_ended")]


def test_dirty_observations(spark):
    schema = "detection_id long, video_id string, class_id int, frame_index long, detection_index int, timestamp_ms long, confidence double, bbox_relative_area double, bbox_area_pixels double, bbox_xyxy_normalized array<double>, ingested_at timestamp"
    good = (1, "v", 0, 1, 0, 100, 0.5, 0.1, float("nan"), [0.0, 0.0, 0.5, 0.5], None)
    bad = [(2, None, *good[2:]), (3, "v", 9, *good[3:]), (4, "v", 0, None, *good[4:]), (5, *good[1:6], float("nan"), *good[7:]), (6, *good[1:9], [0.5, 0.0, 0.1, 0.5], None), (7, *good[1:9], None, None), (8, *good[1:6], 1.5, *good[7:])]
    videos = spark.createDataFrame([("v", None, None), (None, 5.0, 3)], "video_id string, fps double, frame_count long")
    out = temporal.observations(spark.createDataFrame([good, good, *bad], schema), videos).collect()
    assert [(r.detection_id, r.fps, r.pixels) for r in out] == [(1, 10.0, 0.0)]


def test_rules_are_checked():
    for bad in ({"min_iou": 2}, {"max_gap_seconds": -1}, {"confirmed_at": 0}):
        with pytest.raises(ValueError):
            temporal.Rules(**bad)


def test_streaming_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [obs(f, cls=rng.randrange(2), box=(0.1, 0.1, 0.3, 0.3 + rng.random() / 10)) for f in range(120) if rng.random() < 0.6]
    batch = sorted((r.class_id, r.first_frame, r.last_frame, r.observation_count) for r in temporal.events(spark.createDataFrame(rows, COLS)).collect())
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame(rows, COLS).withColumn("end", F.lit(False))
    end = df.limit(1).drop("class_id", "frame_index", "end").crossJoin(spark.createDataFrame([(0, 500, True), (1, 500, True)], "class_id int, frame_index long, end boolean")).select(df.columns)
    parts = (df.where("frame_index < 50"), df.where("frame_index BETWEEN 50 AND 80"), df.where("frame_index > 80").unionByName(end))
    for n, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{source}/{n}")
        stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(source)
        query = streaming.stream_events(stream).writeStream.foreachBatch(streaming.sealed_sink(sink)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        query.stop()
    out = spark.read.parquet(sink)
    assert sorted((r.class_id, r.first_frame, r.last_frame, r.observation_count) for r in out.collect()) == batch
