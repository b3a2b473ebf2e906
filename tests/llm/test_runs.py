import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from detlake.llm import runs

SCHEMA = "detection_id long, video_id string, frame_index long, timestamp_ms long, class_id int, bbox_xyxy_normalized array<double>, ingested_at timestamp, run_id string, edge int, a string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, "x", 1, "y") for r in rows], SCHEMA)


def brute(rows, gap=3, least=0.6):
    obs = {}
    for d, v, f, t, c, b in rows:
        if None in (d, v, f, c) or b is None or len(b) != 4 or any(x is None or x != x for x in b):
            continue
        obs[d] = (v, f, t, c, b)
    parent = {d: d for d in obs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p, q in itertools.combinations(obs, 2):
        (v, f, _, c, b), (w, g, _, k, e) = obs[p], obs[q]
        if v == w and c == k and 1 <= abs(f - g) <= gap and runs.overlap(np.array([b]), np.array([e]))[0] >= least:
            parent[find(p)] = find(q)
    groups = {}
    for d in obs:
        groups.setdefault(find(d), []).append((obs[d][1], d))
    return sorted((obs[g[0][1]][0], len(g), min(g)[1], max(g)[1]) for g in groups.values())


def mine(df, **more):
    return sorted((r.video_id, r.observations, r.first_detection_id, r.last_detection_id) for r in runs.repeated_events(df, **more).collect())


@pytest.mark.parametrize("seed", range(3))
def test_random_videos_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for n in range(260):
        x, y = rng.choice((0.1, 0.12, 0.5)), rng.choice((0.1, 0.3))
        box = [x, y, x + rng.choice((0.2, 0.21)), y + 0.2]
        rows.append((n, rng.choice("aab"), rng.randrange(60), n * 10, rng.choice((0, 0, 1, None)), rng.choice((box, box, box, box, None, [x, y, None, 1.0], [x, y, float("nan"), 1.0], [0.0, 0.0, 1.0]))))
    rows += rng.sample(rows, 40)  # deliveries that repeat
    df = frame(spark, rows)
    expected = brute(rows)
    assert mine(df, block_frames=8) == expected  # many runs cross blocks
    assert mine(df, block_frames=4096) == expected
    assert mine(df, block_frames=6, least=2) == [r for r in expected if r[1] >= 2]


def test_counts_durations_and_long_chains(spark):
    rows = [(n, "v", 2 * n, 100 * n, 0, [0.0, 0.0, 0.5, 0.5]) for n in range(200)]
    (run,) = runs.repeated_events(frame(spark, rows), block_frames=10).collect()
    assert (run.observations, run.first_frame, run.last_frame, run.duration_ms) == (200, 0, 398, 19900)


def test_nulls_and_empty_table(spark):
    assert mine(frame(spark, [])) == []
    rows = [(1, None, 1, 1, 0, [0.0, 0.0, 1.0, 1.0]), (None, "v", 1, 1, 0, [0.0, 0.0, 1.0, 1.0]), (2, "v", None, 1, 0, [0.0, 0.0, 1.0, 1.0]), (3, "v", 5, None, 0, [0.0, 0.0, float("inf"), 1.0]), (4, "v", 6, None, 0, [0.0, 0.0, float("inf"), 1.0])]
    assert mine(frame(spark, rows)) == [("v", 1, 3, 3), ("v", 1, 4, 4)]
    assert runs.repeated_events(frame(spark, rows)).select("duration_ms").first()[0] is None


def test_earliest_delivery_wins(spark):
    df = frame(spark, [(1, "v", 1, 0, 0, [0.0, 0.0, 1.0, 1.0]), (1, "v", 9, 0, 0, [0.0, 0.0, 1.0, 1.0]), (2, "v", 2, 0, 0, [0.0, 0.0, 1.0, 1.0])])
    df = df.withColumn("ingested_at", F.when(F.col("frame_index") == 9, F.lit("2026-02-02")).otherwise(F.lit("2026-01-01")).cast("timestamp"))
    assert mine(df, settle=True) == [("v", 2, 1, 2)]


def test_difference_of_row_numbers():
    entity, value = np.array([1, 1, 1, 1, 2, 2]), np.array([5, 5, 7, 7, 5, 5])
    assert runs.row_number_difference(entity, value).tolist() == [0, 0, 2, 2, 0, 0]


def _labels(island, frame, det, box):
    order, starts = runs._local_runs(island, frame, det, box, 3, 0.6)
    out = np.empty(len(frame), np.int64)
    for n, rows in enumerate(np.split(order, starts[1:])):
        out[rows] = n
        assert (np.diff(frame[rows]) >= 0).all()
    return out


@pytest.mark.parametrize("seed", range(4))
def test_ranges_lose_no_link(seed):
    rng = np.random.default_rng(seed)
    n = 220
    frame = np.sort(rng.integers(0, (4, 40)[seed % 2], n))
    island = np.r_[0, np.cumsum(np.diff(frame) > 3)]
    low = rng.choice([0.0, 0.1, 0.12, 0.5, -0.3], (n, 2)) + rng.normal(0, 0.01, (n, 2)) * (seed > 1)
    box = np.c_[low, low + rng.choice([0.2, 0.21, 0.3, 0.0, -0.1, np.inf], (n, 2), p=[0.4, 0.2, 0.3, 0.04, 0.03, 0.03])]
    got = _labels(island, frame, np.arange(n), box)
    a, b = np.nonzero((np.subtract.outer(frame, frame) >= 1) & (np.subtract.outer(frame, frame) <= 3) & (np.subtract.outer(island, island) == 0))
    ok = runs.overlap(box[a], box[b]) >= 0.6
    want = runs.components(n, a[ok], b[ok])
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_many_rows_of_one_frame():
    """A default frame index that very many observations share, some with equal boxes, isn't compared pair by pair."""
    n = 60_000
    rng = np.random.default_rng(1)
    low = np.where((np.arange(n) % 3 == 0)[:, None], 0.5, rng.random((n, 2)) * 100)
    frame = np.repeat([0, 1], n // 2)
    got = _labels(np.zeros(n, np.int64), frame, np.arange(n), np.c_[low, low + 0.05])
    assert len(set(got[::3])) == 1 and len(set(got)) > n // 2
