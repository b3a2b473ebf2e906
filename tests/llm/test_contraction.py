import random

import pytest
from pyspark.sql import functions as F

from detlake.llm import contraction


def brute(edges):
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for v in sorted(near):
        if v in out:
            continue
        todo, seen = [v], {v}
        while todo:
            for w in near[todo.pop()] - seen:
                seen.add(w)
                todo.append(w)
        out |= dict.fromkeys(seen, min(seen))
    return out


def mine(spark, edges):
    df = spark.createDataFrame([(a, b, 0, 0) for a, b in edges], "a string, b string, vertex int, _u int")
    return {r.member: r.group_id for r in contraction.consolidate(df).collect()}


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(180)]
    edges += edges[:20] + [(b, a) for a, b in edges[20:40]] + [("n1", None), (None, None), ("n2", "n2")]
    assert mine(spark, edges) == brute(edges)


def test_chain_and_star(spark):
    edges = [(f"c{n:04d}", f"c{n + 1:04d}") for n in range(150)] + [("hub", f"s{n}") for n in range(150)]
    assert mine(spark, edges) == brute(edges)


def test_estimated_size_grows_with_the_rounds_and_not_as_their_power(spark):
    edges = spark.createDataFrame([(n, n + 1) for n in range(3000)], "a int, b int")
    estimate = contraction.contract(edges)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert estimate.bit_length() < 64 * 30


def test_empty(spark):
    assert mine(spark, []) == {}


def test_images_of_pairs_and_lists(spark):
    pairs = spark.createDataFrame([(" A ", "b", True), ("c", "d", False), ("b", None, True), ("E", "e", True), ("x", "y", None)], "first_image_id string, second_image_id string, hard_split_constraint boolean")
    groups = spark.createDataFrame(
        [("G1", ["b", "k", None], 3, True), ("g1 ", ["M"], 1, True), ("G2", ["z"], 5, True), ("G3", None, 0, True), ("G4", ["c", "d"], 2, False), (None, ["p", "q"], 2, True), (None, ["r", "s"], 2, True)],
        "duplicate_group string, member_image_ids array<string>, member_count int, hard_split_constraint boolean",
    )
    got = {(r.canonical_image_id, r.group_id) for r in contraction.linked_images(pairs, groups).collect()}
    assert got == {("a", "a"), ("b", "a"), ("k", "a"), ("m", "a"), ("p", "p"), ("q", "p"), ("r", "r"), ("s", "r")}


def test_codes_that_vertices_share_are_drawn_anew(spark, monkeypatch):
    plain, seeds = contraction._code, []

    def narrow(name, seed):
        seeds.append(seed)
        return F.pmod(plain(name, seed), F.lit(2)) if seed < 22 else plain(name, seed)

    monkeypatch.setattr(contraction, "_code", narrow)
    pairs = spark.createDataFrame([("a", "b", True), ("c", "d", True), ("e", None, True)], "first_image_id string, second_image_id string, hard_split_constraint boolean")
    groups = spark.createDataFrame([("g1", ["d", "k"], True)], "duplicate_group string, member_image_ids array<string>, hard_split_constraint boolean")
    got = {(r.canonical_image_id, r.group_id) for r in contraction.linked_images(pairs, groups).collect()}
    assert got == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("k", "c")} and max(seeds) == 22
