import random

import numpy as np
import pytest

from detlake.llm import sampling, splits

IMAGES = "canonical_image_id string, capture_group string, split string, id string, g int"
ENTRIES = "canonical_image_id string, split string, is_positive boolean, component string"
TARGETS = [("train", 0.7), ("val", 0.15), ("test", 0.15)]


def data(spark, seed=1, n=4000, hot=0.33):
    rng = random.Random(seed)
    images, entries = [], []
    for k in range(n):
        group = "hot" if rng.random() < hot else rng.choice((None, f" G{rng.randrange(n // 12)} ", f"g{rng.randrange(n // 12)}"))
        images.append((f"i{k}", group, "x", "y", 1))
        if k % 50:
            entries.append((f"i{k}", rng.choice(("train", "TRAIN ", "val", "validation", "test")), rng.choice((True, False, None)), "c"))
    images += images[:50]
    entries += entries[:50] + [("orphan", "val", None, "c"), (None, "val", True, "c")]
    return images, entries


@pytest.mark.parametrize("hot", [0.0, 0.33])
def test_groups_stay_together_in_proportion(spark, hot):
    images, entries = data(spark, hot=hot)
    i, e = spark.createDataFrame(images, IMAGES), spark.createDataFrame(entries, ENTRIES)
    t = spark.createDataFrame([(f" {s.upper()}", x) for s, x in TARGETS] + [(None, 1.0), ("none", 0.0)], "split string, target_share double")
    rows = splits.assign(i, e, t).collect()
    assert len(rows) == len({r.canonical_image_id for r in rows}) == len({x[0] for x in entries if x[0]})
    where = {}
    for r in rows:
        where.setdefault(r.component, set()).add(r.split)
    assert all(len(s) == 1 for s in where.values())
    group = {x[0]: x[1].strip().lower() for x in images if x[1]}
    assert all(r.component == ("g:" + group[r.canonical_image_id] if r.canonical_image_id in group else "i:" + r.canonical_image_id) for r in rows)
    for s, x in TARGETS:
        assert abs(sum(r.split == s for r in rows) - x * len(rows)) <= 2
    again = splits.assign(i.repartition(7), e.repartition(3), t).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in rows}


def test_profiles_are_balanced(spark):
    images, entries = data(spark, hot=0.0)
    i, e = spark.createDataFrame(images, IMAGES), spark.createDataFrame(entries, ENTRIES)
    rows = splits.assign(i, e, spark.createDataFrame(TARGETS, "split string, target_share double")).collect()
    positive = {x[0] for x in entries if x[2]}
    share = len(positive & {r.canonical_image_id for r in rows}) / len(rows)
    for s, _ in TARGETS:
        mine = [r.canonical_image_id in positive for r in rows if r.split == s]
        assert abs(sum(mine) / len(mine) - share) < 0.06


def test_conflicts(spark):
    images, entries = data(spark, n=300, hot=0.1)
    where, group = {}, {}
    for i, g, *_ in images:
        if g:
            group.setdefault(i, set()).add(g.strip().lower())
    for i, s, *_ in entries:
        for g in group.get(i, ()):
            where.setdefault(g, set()).add({"validation": "val"}.get(s.strip().lower(), s.strip().lower()))
    i = spark.createDataFrame(images, IMAGES)
    got = [r[0] for r in splits.conflicts(splits.plan(i, spark.createDataFrame(entries, ENTRIES), spark.createDataFrame(TARGETS, "split string, target_share double")), i).collect()]
    assert sorted(got) == sorted(g for g, s in where.items() if len(s) > 1)


def test_groups_that_share_an_image_are_united(spark):
    images = [(f"{g}{n}", g, "x", "y", 1) for g in "abcd" for n in range(25)] + [("ab", "A ", "x", "y", 1), ("ab", "b", "x", "y", 1), ("bc", "c", "x", "y", 1), ("bc", "B", "x", "y", 1)]
    i = spark.createDataFrame(images, IMAGES)
    e = spark.createDataFrame([(x, "train", True, "c") for x in {x[0] for x in images}], ENTRIES)
    t = spark.createDataFrame(TARGETS, "split string, target_share double")
    rows = splits.assign(i, e, t)
    got = {r.canonical_image_id: (r.component, r.split) for r in rows.collect()}
    assert {c for x, (c, _) in got.items() if x[0] != "d"} == {"g:a"} and got["d1"][0] == "g:d"
    assert len({s for x, (_, s) in got.items() if x[0] != "d"}) == 1
    assert splits.integrity(rows, i, t).first().torn == 0
    apart = spark.createDataFrame([(x, "g:" + x[0], "val" if x[0] == "b" else "train") for x in got], "canonical_image_id string, component string, split string")
    assert splits.integrity(apart, i, t).first().torn == 2  # ab (train) is in b as well, bc (val) in c


def test_empty_splits(spark):
    i, e = spark.createDataFrame([], IMAGES), spark.createDataFrame([], ENTRIES)
    assert splits.assign(i, e, spark.createDataFrame(TARGETS, "split string, target_share double")).count() == 0
    assert splits.conflicts(splits.plan(i, e, spark.createDataFrame(TARGETS, "split string, target_share double")), i).count() == 0
    with pytest.raises(ValueError):
        splits.assign(i, e, spark.createDataFrame([], "split string, target_share double"))


def test_flow_is_cheapest():
    bundles = [{"size": 1, "profile": "0", "n": 100}, {"size": 5, "profile": "4", "n": 20}]
    got = splits.allocate(bundles, TARGETS)
    assert got[(1, "0")] == {"train": 70, "val": 15, "test": 15} and got[(5, "4")] == {"train": 14, "val": 3, "test": 3}


def test_large_components_go_through_the_flow():
    """A component of a third of all images lands in the split that can hold it, and the others fill the quotas."""
    bundles = [{"size": 1000, "profile": "2", "n": 1}, {"size": 151, "profile": "4", "n": 2}, {"size": 7, "profile": "0", "n": 150}, {"size": 1, "profile": "0", "n": 648}]
    total = sum(b["size"] * b["n"] for b in bundles)
    got = splits.allocate(bundles, TARGETS)
    assert got[(1000, "2")]["train"] == 1
    for s, share in TARGETS:
        assert abs(sum(size * c[s] for (size, _), c in got.items()) - share * total) <= 1


SAMPLES = "filename string, classes_present array<int>, mask int, config_id int, category string"


def samples(spark, n=6000, seed=2):
    rng = random.Random(seed)
    kinds = [[], [], [2], [2], [0], [0, 2], [3], [0, 0], [2, 9], [9], [1], None, [None], [-1, 3]]
    rows = [(f"f{k}", rng.choices(kinds, [20, 20, 20, 15, 15, 5, 8, 2, 2, 3, 0.4, 2, 1, 1])[0], 1, 2, "x") for k in range(n)]
    return rows + rows[:200] + [(None, [2], 1, 2, "x")]


CONFIGS = [(1, 1000, 5, 10, 7), (2, 500, 30, 0, 8), (3, 0, 0, 0, 9), (4, None, None, None, None), (None, 5, 5, 5, 5), (5, 100000, 0, 0, 1)]
SHARES = [
    (1, "D00_longitudinal_crack", 0.2), (1, "D10_transverse_crack", 0.002), (1, "d20_alligator_crack ", 0.4), (1, "D40_pothole", 0.1), (1, "negative", 0.3), (2, "D10_transverse_crack", None), (2, "D20_alligator_crack", 0.5),
    (2, "negative", float("nan")), (2, "unknown", 0.1), (1, None, 0.5), (None, "negative", 0.5), (9, "negative", 0.5),
]
CONFIG = "config_id int, sample_size long, images_per_class int, negative_images int, sample_seed int, category string, target_share double"
SHARE = "config_id int, category string, target_share double, sample_size long"


def frames(spark, rows):
    return spark.createDataFrame(rows, SAMPLES), spark.createDataFrame([(*c, "z", 1.0) for c in CONFIGS], CONFIG), spark.createDataFrame([(*s, 3) for s in SHARES], SHARE)


def test_samples_follow_the_targets(spark):
    s, c, t = frames(spark, samples(spark))
    pop = sampling.population(s)
    rows = sampling.draw(pop, c, t).collect()
    assert len({(r.config_id, r.filename) for r in rows}) == len(rows)
    size = {k: sum(r.config_id == k for r in rows) for k in (1, 2, 3, 4, 5)}
    known = pop.where("mask > 0").count()
    assert abs(size[1] - 1000) <= 2 and abs(size[2] - 500) <= 2 and size[3] == 0 and size[4] == 0 and size[5] == known
    have = lambda k, bit: sum(bool(r.mask & bit) for r in rows if r.config_id == k)
    for bit, want in ((1, 200), (4, 400), (8, 100), (16, 300)):
        assert abs(have(1, bit) - want) <= 3
    assert have(1, 2) >= 5 and have(2, 2) >= min(30, pop.where("mask & 2 > 0").count())
    report = {(r.config_id, r.category): r for r in sampling.report(sampling.draw(pop, c, t), pop, c, t).collect()}
    assert report[(1, "negative")].selected == have(1, 16) and not report[(2, "unknown")].met


def test_unmet_requirements(spark):
    rows = samples(spark, n=800)
    s, c, t = frames(spark, rows)
    masks = {}
    for f, k, *_ in rows:
        if f and k is not None:
            masks.setdefault(f, set()).update(["negative"] if not k else [{0: "d00_longitudinal_crack", 1: "d10_transverse_crack", 2: "d20_alligator_crack", 3: "d40_pothole"}.get(x) for x in k])
    want = set()
    for k, cat, share in SHARES:
        for cid, size, per, neg, _ in CONFIGS:
            if k == cid and k is not None and cat:
                need = max((neg if cat.strip().lower() == "negative" else per) or 0, 0 if share is None or share != share else share * (size or 0))
                if sum(cat.strip().lower() in m for m in masks.values()) < need:
                    want.add((k, cat))
    pop = sampling.population(s)
    assert {tuple(r) for r in sampling.unmet(sampling.draw(pop, c, t), pop, c, t).collect()} == want


def test_empty_samples(spark):
    s, c, t = frames(spark, [])
    pop = sampling.population(s)
    drawn = sampling.draw(pop, c, t)
    assert drawn.count() == 0
    assert (1, "negative") in {tuple(r) for r in sampling.unmet(drawn, pop, c, t).collect()}


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    for _ in range(200):
        kind, p = rng.integers(1, 5, 40), rng.random(40)
        q = sampling.same_kind_flight(kind, p, rng.integers(0, 2**63, 40).astype(np.uint64))
        for k in range(1, 5):
            mine = q[kind == k]
            assert abs(mine.sum() - p[kind == k].sum()) < 1e-6 and ((mine > 1e-9) & (mine < 1 - 1e-9)).sum() <= 1


def test_flight_chances():
    """Over many seeds each record is chosen about as often as its probability says."""
    kind, p, hits = np.ones(10, int), np.full(10, 0.37), np.zeros(10)
    for seed in range(4000):
        q = sampling.same_kind_flight(kind, p, sampling._random(np.arange(10), seed))
        hits += q
    assert np.abs(hits / 4000 - 0.37).max() < 0.03


NONE = float("nan")


@pytest.mark.parametrize("minima, wanted", [((0, 0, 0, 0, 0), (NONE, 500, NONE, NONE, 500)), ((0, 0, 0, 0, 0), (400,) * 5), ((5, 15, 5, 5, 0), (NONE,) * 5), ((300, 20, 300, 50, 350), (0, 0, 900, NONE, 10))])
def test_probabilities_keep_minima_and_size(minima, wanted):
    counts = np.zeros(64)
    counts[[1, 2, 4, 5, 8, 16, 32]] = 900, 20, 900, 50, 400, 1200, 60
    p = sampling.probabilities(counts, 1000, np.array(minima, float), np.array(wanted, float))
    got = (p * counts) @ sampling._VECTORS
    assert ((p >= 0) & (p <= 1)).all() and abs(got[5] - 1000) < 1e-2 and (got[:5] >= np.array(minima) - 1e-2).all()
    assert sampling.probabilities(counts, 10_000, np.array(minima, float), np.array(wanted, float)) @ counts == pytest.approx(counts.sum())


def test_rare_categories_give_all_and_minima_beat_the_size():
    counts = np.zeros(64)
    counts[[1, 2, 16]] = 100, 20, 100
    p = sampling.probabilities(counts, 60, np.zeros(5), np.array([NONE, 50, NONE, NONE, 0.0]))
    assert p[2] > 0.99 and abs(p @ counts - 60) < 0.1
    p = sampling.probabilities(counts, 30, np.array([20, 20, 0, 0, 20.0]), np.full(5, NONE))
    assert np.allclose((p * counts)[[1, 2, 16]], 20, atol=0.05)


def test_bounded_least_squares_against_a_grid():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b, high = rng.normal(size=(4, 2)), rng.normal(size=4), rng.random(2) + 0.1
        x = sampling.bounded_least_squares(a, b, high)
        grid = np.stack(np.meshgrid(*(np.linspace(0, h, 201) for h in high)), -1).reshape(-1, 2)
        assert ((a @ x - b) ** 2).sum() <= ((grid @ a.T - b) ** 2).sum(axis=1).min() + 1e-9


def test_cube_lands_close():
    rng = np.random.default_rng(3)
    for _ in range(50):
        kind, p = rng.integers(1, 32, 24), rng.random(24)
        expected = p @ sampling._VECTORS[kind]
        q = sampling.cube(kind, p, rng, expected, np.floor(expected[:5]), expected[5], np.full(5, NONE))
        got = q @ sampling._VECTORS[kind]
        assert set(q) <= {0.0, 1.0} and (got[:5] >= np.floor(expected[:5])).all() and np.abs(got - expected).max() < 4


def test_integrity_of_a_draw(spark):
    s, c, t = frames(spark, samples(spark))
    pop = sampling.population(s)
    rows = sampling.integrity(sampling.draw(pop, c, t), pop, c).collect()
    assert {r.config_id for r in rows} == {1, 2, 3, 4, 5}
    assert all(r.repeated == r.foreign == r.minima_short == 0 and r.size_met for r in rows)
    bad = spark.createDataFrame([(1, "f1", 63), (1, "f1", 63), (1, "nowhere", 1)], "config_id int, filename string, mask int")
    (row,) = sampling.integrity(bad, pop, c).where("config_id = 1").collect()
    assert row.repeated == 1 and row.foreign == 2 and row.minima_short == 5 and not row.size_met
