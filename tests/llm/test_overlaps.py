import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from detlake.llm import overlaps


@pytest.mark.parametrize("n, symbols", [(1, 1), (7, 2), (300, 2), (400, 5)])
def test_index_finds_all_occurrences(n, symbols):
    rng = np.random.default_rng(n)
    text = rng.integers(0, symbols, n)
    index = overlaps.FullTextIndex(text, symbols)
    for m in (1, 2, 4):
        patterns = rng.integers(0, symbols, (30, m))
        low, high, length = index.search(patterns, m)
        for p, a, b, k in zip(patterns, low, high, length):
            places = [i for i in range(n - m + 1) if (text[i : i + m] == p).all()]
            assert sorted(index.locate(np.arange(a, b))) == places
            assert (k == m) == bool(places)


def test_maximal_match_runs_on_beyond_the_seed():
    index = overlaps.FullTextIndex(np.array([1, 2, 3, 4, 5]), 6)
    low, high, length = index.search(np.array([[0, 2, 3, 4], [2, 2, 3, 4], [9 % 6, 3, 3, 4]]), 2)
    assert (high - low).tolist() == [1, 1, 1] and length.tolist() == [3, 3, 2]


def tables(spark, images, entries):
    i = spark.createDataFrame(images, "canonical_image_id string, country string, image_sha256 string, perceptual_hash_dhash64 string, split string, id int")
    return i, spark.createDataFrame(entries, "canonical_image_id string, split string, train int")


@pytest.mark.parametrize("hot", [10_000_000, 1])
def test_random_hashes_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(overlaps, "HOT_PAIRS", hot)  # 1: nearly all seeds are refined
    rng = random.Random(4)
    base = [rng.getrandbits(64) & rng.choice((-1, 0xFFFF)) for _ in range(40)]
    images, entries = [], []
    for n in range(240):
        h = rng.choice(base)
        for _ in range(rng.randrange(4)):
            h ^= 1 << rng.randrange(64)
        text = rng.choice((f"{h:016x}", f"0x{h:016X}", f" {h:x} "))
        sha = rng.choice(("aa", "AA ", "bb", None, "", *(f"s{k}" for k in range(200))))
        images.append((f"i{n:03d}", rng.choice(("India", None)), sha, rng.choice((text, text, text, None, "zz", "0" * 16, "f" * 16, "0")), "x", 1))
        entries.append((f"i{n:03d}", rng.choice(("train", " TRAIN", "val", "validation", "Test", "other", None)), 1))
    images += images[:9]
    entries += entries[:9] + [("nowhere", "val", 1), (None, "train", 1)]

    def value(t):
        t = (t or "").strip().lower().removeprefix("0x")
        try:
            v = int(t, 16)
        except ValueError:
            return None
        return v if v not in (0, 2**64 - 1) else None

    side = {e[0]: {"train": 1, "val": 0, "validation": 0, "test": 0}.get((e[1] or "").strip().lower()) for e in entries}
    want = set()
    for p in images:
        for q in images:
            if side[p[0]] == 1 and side[q[0]] == 0:
                a, b = (p[2] or "").strip().lower(), (q[2] or "").strip().lower()
                x, y = value(p[3]), value(q[3])
                if (a and a == b) or (x is not None and y is not None and (x ^ y).bit_count() <= 2):
                    want.add((min(p[0], q[0]), max(p[0], q[0])))
    i, e = tables(spark, images, entries)
    got = [tuple(r) for r in overlaps.found_pairs(i, e).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_many_copies_and_small_indexes(spark, monkeypatch):
    monkeypatch.setattr(overlaps, "INDEX_SYMBOLS", 30)
    images = [(f"i{n}", None, "same", "00000000000000ff", "x", 1) for n in range(60)]
    i, e = tables(spark, images, [(f"i{n}", "train" if n % 3 else "test", 1) for n in range(60)])
    assert overlaps.found_pairs(i, e).count() == 40 * 20
    (row,) = overlaps.report(i, e).collect()
    assert (row.split, row.country, row.images, row.exact_images, row.pairs) == ("test", None, 20, 20, 800)


def test_report_counts_as_the_pairs_do(spark):
    """Images with several hashes, countries and splits, copies of each, and images on both sides."""
    rng = random.Random(6)
    images, entries = [], []
    for n in range(150):
        for _ in range(rng.choice((1, 1, 2))):
            images.append((f"i{n}", rng.choice(("India", "Japan", None)), rng.choice(("aa", "bb", None, f"s{n}")), rng.choice(("ff00", "ff01", "abc0000000000000", None)), "x", 1))
        for s in rng.choice((("train",), ("val",), ("train", "test"), ("test",))):
            entries.append((f"i{n}", s, 1))
    pairs, where = set(), {}
    for i, s, _ in entries:
        where.setdefault(i, []).append(s)
    near = lambda a, b: a is not None and b is not None and (int(a, 16) ^ int(b, 16)).bit_count() <= 2
    for p in images:
        for q in images:
            if p[0] != q[0] and "train" in where[p[0]]:
                exact = p[2] is not None and p[2] == q[2]
                if exact or near(p[3], q[3]):
                    pairs |= {(p[0], q[0], s, q[1], exact) for s in where[q[0]] if s != "train"}
    want = {}
    for s, c in {x[2:4] for x in pairs}:
        mine = [x for x in pairs if x[2:4] == (s, c)]
        want[s, c] = len({x[1] for x in mine}), len({x[1] for x in mine if x[4]}), len({x[:2] for x in mine})
    i, e = tables(spark, images, entries)
    assert {(r.split, r.country): (r.images, r.exact_images, r.pairs) for r in overlaps.report(i, e).collect()} == want
    assert {tuple(r) for r in overlaps.found_pairs(i, e).collect()} == {(min(x[:2]), max(x[:2])) for x in pairs}


def test_empty(spark):
    i, e = tables(spark, [], [])
    assert overlaps.found_pairs(i, e).count() == 0


def test_bits(spark):
    df = spark.createDataFrame([("0xFF",), ("ffffffffffffffff",), ("1" * 17,), ("0" + "1" * 16,)], "h string")
    assert [r[0] for r in df.select(overlaps.dhash_value(F.col("h"))).collect()] == [255, None, None, int("1" * 16, 16)]
