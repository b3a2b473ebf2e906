import datetime as dt

import numpy as np
import pytest

from detlake.llm import percentiles as p

WIDTH = p.width_of(p.RANK_ERROR)


@pytest.mark.parametrize("kind", ["uniform", "beta", "grid", "point", "signed", "huge"])
def test_rank_error_is_bounded(kind):
    rng = np.random.default_rng(7)
    v = {
        "uniform": rng.random(60_000), "beta": rng.beta(0.5, 40, 60_000), "grid": rng.integers(0, 10_000, 60_000) / 10_000, "point": np.full(60_000, 0.25),
        "signed": rng.normal(0, 1000, 60_000), "huge": rng.lognormal(0, 30, 60_000) * rng.choice([-1, 1], 60_000),
    }[kind]
    cells = p.cells_of(p.encode(v), np.ones(len(v)), WIDTH)
    got = p.quantiles(cells, p.QUANTILES)
    v.sort()
    for q, x in zip(p.QUANTILES, got):
        step = abs(x) * 2 * p.STEP
        low, high = np.searchsorted(v, x - step) / len(v), np.searchsorted(v, x + step, side="right") / len(v)
        assert low - p.RANK_ERROR <= q <= high + p.RANK_ERROR


def test_codes_keep_the_order_and_nearly_the_value():
    v = np.array([-np.inf, -1e300, -2.5, -1e-300, -0.0, 0.0, 5e-324, 1e-300, 0.1, 1.0, 1e300, np.inf])
    codes = p.encode(v)
    assert (np.diff(codes) >= 0).all() and codes[4] == codes[5] and 0 <= codes[0] and codes[-1] < 1 << p.LEVELS
    back = p.decode(codes)
    assert back[0] == -np.inf and back[-1] == np.inf
    assert np.allclose(back[1:-1], v[1:-1], rtol=2 * p.STEP, atol=1e-300)


def test_smaller_errors_take_wider_rows():
    assert p.width_of(0.001) > p.width_of(0.01) >= 1000
    with pytest.raises(ValueError):
        p.width_of(0)


def test_sketches_add_and_delete():
    rng = np.random.default_rng(1)
    a, b = p.encode(rng.random(5000)), p.encode(rng.random(3000))
    whole = p.cells_of(np.r_[a, b], np.ones(8000), WIDTH)
    assert (p.cells_of(a, np.ones(5000), WIDTH) + p.cells_of(b, np.ones(3000), WIDTH) == whole).all()
    assert (whole + p.cells_of(b, -np.ones(3000), WIDTH) == p.cells_of(a, np.ones(5000), WIDTH)).all()
    one, two = p.Sum(WIDTH), p.Sum(WIDTH)
    one.put(a, np.ones(5000, np.int64), np.array([1, 2, 3]))
    two.put(b, np.ones(3000, np.int64), np.array([10, 0, 0]))
    two._sketch()
    both = p.Sum(WIDTH)
    both.add(one.packed())
    both.add(two.packed())
    whole[p.NULLS : p.NULLS + 3] = 11, 2, 3
    assert one.packed()[:1] == b"v" and two.packed()[:1] == b"d"
    assert (p.unpack(both.packed(), WIDTH) == whole).all()


def _detections(spark):
    rng = np.random.default_rng(3)
    rows, day = [], dt.datetime(2026, 1, 1)
    for n in range(4000):
        rows.append((n, [" D40_Pothole", "d40_pothole ", "rare"][0 if n % 7 else 2 if n == 7 else 1], float(rng.random()), float(rng.beta(1, 30)), day + dt.timedelta(days=n % 5)))
    late = [(n, *r[1:4], r[4] + dt.timedelta(days=3)) for n, r in list(enumerate(rows))[:500]] + [(0, " D40_Pothole", 0.9, 0.9, None)]
    odd = [(9001, None, 0.5, 0.5, day), (9002, "d40_pothole", float("nan"), None, day), (9003, "d40_pothole", 1.5, -0.1, day), (None, "d40_pothole", 0.5, 0.5, day), (9004, "none", None, None, None)]
    schema = "detection_id long, class_name string, confidence double, bbox_relative_area double, ingested_at timestamp, metric int, salt string"
    return rows, spark.createDataFrame([(*r, 1, "x") for r in rows + late + odd], schema)


def test_days_merge_to_the_whole_and_observations_count_once(spark):
    rows, df = _detections(spark)
    out = p.class_percentiles(df).collect()
    got = {(r.class_name, r.metric): r for r in out if r.day is None}
    assert set(got) == {(c, m) for c in ("d40_pothole", "rare", "none") for m in p.METRICS}
    pot = got[("d40_pothole", "confidence")]
    assert pot.n == 3999 and pot.set_aside == 2 and got[("rare", "confidence")].n == 1
    assert got[("none", "confidence")].n == 0 and got[("none", "confidence")].median is None
    v = np.sort([r[2] for i, r in enumerate(rows[:4000]) if i != 7])
    assert abs(np.searchsorted(v, pot.median) / len(v) - 0.5) <= p.RANK_ERROR
    daily = [r for r in out if r.class_name == "d40_pothole" and r.metric == "confidence" and r.day is not None]
    assert len(daily) == 5 and sum(r.n for r in daily) == 3999 and sum(r.set_aside for r in daily) == 2
    checked = p.bound_check(df, p.class_percentiles(df)).collect()
    assert len(checked) == len(out) and all(r.within_bound for r in checked)


def test_without_a_domain_every_number_counts(spark):
    rows = [(i, "a", float(x), None) for i, x in enumerate([-5.0, 3.0, float("inf"), float("-inf"), 1e12])]
    df = spark.createDataFrame(rows, "detection_id long, class_name string, size double, ingested_at timestamp")
    (row,) = p.class_percentiles(df, ["size"], None).where("day IS NULL").collect()
    assert row.n == 5 and row.set_aside == 0 and abs(row.median - 3) < 1e-5 and row.p01 == -np.inf and row.p99 == np.inf
    assert all(r.within_bound for r in p.bound_check(df, p.class_percentiles(df, ["size"], None), ["size"], None).collect())


def test_empty(spark):
    df = spark.createDataFrame([], "detection_id long, class_name string, confidence double, bbox_relative_area double, ingested_at timestamp")
    assert p.class_percentiles(df).count() == 0
    assert np.isnan(p.quantiles(np.zeros(p.size_of(WIDTH), np.int64), [0.5])).all()


def test_withdrawn_rows(spark):
    df = spark.createDataFrame([("a", 0.1, 1), ("a", 0.9, 1), ("a", 0.9, -1)], "k string, v double, w int")
    (row,) = p.quantiles_of(p.sketch(df, ["k"], ["v"], weight="w"), ["k"]).collect()
    assert row.n == 1 and abs(row.median - 0.1) < 1e-6
