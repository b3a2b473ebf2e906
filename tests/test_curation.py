import json
import random

import pytest
from pyspark.sql import functions as F

from detlake.functions import keys as k
from detlake.operators import components, grouping, ordered, quality, reconcile, sampling, summary
from detlake.plans import curation, inventories
from detlake.session import norm
from detlake.sources import files


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(900 + n, 901 + n) for n in range(60)] + [(None, 1), (5, 5)]
    got = {r.vertex: r.root for r in components.components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {v: find(v) for v in parent}
    assert components.components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_capture_groups_and_guards(spark):
    rows = [("t1", "India", "IN_1.jpg", 0), ("t2", "India", "IN_2.jpg", 5_000), ("t3", "India", "IN_3.jpg", 31_000), ("t4", "India", "IN_4.jpg", 200_000), ("n1", "Japan", "JP_48.jpg", None), ("n2", "Japan", "JP_51.jpg", None), ("n3", "Japan", "plain.jpg", None)]
    g = grouping.capture_groups(spark.createDataFrame(rows, "canonical_image_id string, country string, filename string, ts_ms long")).cache()
    got = {r.canonical_image_id: (r.method, r.run, r.sequence_index, r.prefix, r.number) for r in g.collect()}
    assert got["t2"] == ("timestamp", 0, 0, "IN_", 2) and got["t3"][2] == 1 and got["t4"][:3] == ("timestamp", 1, 0)
    assert got["n1"][2] == 0 and got["n2"][2] == 1 and got["n3"][3:] == ("plain", None)
    assigned = spark.createDataFrame([("t1", "train"), ("t2", "train"), ("t3", "val"), ("t4", "val"), ("n1", "train"), ("n2", "test"), ("n3", "val")], "canonical_image_id string, split string")
    hit = {r.canonical_image_id for r in grouping.boundary_guard(g, assigned, numeric=3, seconds=10).collect()}
    assert hit == {"t2", "t1", "t3", "n1", "n2"}


def test_identical_hashes_give_all_pairs_and_big_buckets_a_window(spark):
    df = spark.createDataFrame([(f"i{n:02d}", 255) for n in range(10)], "id string, hash long")
    assert grouping.near_duplicate_candidates(df).count() == 45
    assert grouping.near_duplicate_candidates(df, bucket_limit=5, neighbours=2).count() == 9 + 8


def test_big_buckets_give_all_pairs(spark):
    rng = random.Random(4)
    flip = lambda h, most: h ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(most))})
    hashes = [flip(0x0123456789ABCDEF, 9) for _ in range(400)] + [0x7FFF0000FFFF1234] * 230
    rows = [(f"i{n:03d}", h - (1 << 64) if h >> 63 else h) for n, h in enumerate(hashes)] + [("i000", hashes[-1])]
    near = lambda x: bin(x).count("1") <= 6 and any(x >> 16 * b & 0xFFFF == 0 for b in range(4))
    unsigned = [(i, h % (1 << 64)) for i, h in rows]
    want = {(i, j, bin(x ^ y).count("1")) for i, x in unsigned for j, y in unsigned if i < j and near(x ^ y)}
    df = spark.createDataFrame(rows, "id string, hash long")
    linked = lambda pairs: {(r.members, r.member_count) for r in grouping.duplicate_components(pairs).select(F.array_join("members", ",").alias("members"), "member_count").collect()}
    whole = linked(spark.createDataFrame([w[:2] for w in want], "a string, b string"))
    assert max(sum(h >> 48 == 0x0123 for h in hashes), 230) > 200 and len(whole) == 1
    assert sorted(map(tuple, grouping.near_duplicate_candidates(df).collect())) == sorted(want)
    close = {(x, y) for x in {h for _, h in rows} for y in {h for _, h in rows} if x < y and near((x ^ y) % (1 << 64))}
    for hot in (20, 10_000):  # refined and whole buckets
        got = [(r.ha, r.hb) for r in grouping.close_hashes(df, hot_bucket=hot).collect()]
        assert len(got) == len(close) and set(got) == close
    assert linked(grouping.near_duplicate_links(df)) == whole


def test_a_metric_stays_where_the_other_is_not_finite(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0, 0.5, nan), (2, 0, inf, 0.25), (3, 0, -inf, 0.75), (4, 0, None, inf), (5, 0, 0.7, -inf), (5, 0, 0.7, 0.5), (6, None, 0.1, 0.1)]
    spark.createDataFrame(rows, "detection_id long, class_id int, confidence double, bbox_relative_area double").write.parquet(f"{tmp_path}/detections.parquet")
    got = {r.metric: (r["count"], r.minimum, r.maximum, r["mean"], r["median"]) for r in curation.quality_summary(spark, str(tmp_path)).collect()}
    assert got == {"confidence": (2, 0.5, 0.7, 0.6, 0.6), "bbox_relative_area": (3, 0.25, 0.75, 0.5, 0.5)}


def test_events_that_run_backwards_are_reported(spark, tmp_path):
    box = [0.1, 0.1, 0.4, 0.4]
    rows = [(n, v, 0, n % 10, 0, ms, 0.9, 0.09, 100.0, box, n) for n, (v, ms) in enumerate([("back", 2000), ("back", 1000)])] + [(10 + n, "on", 0, n, 0, 1000 + n, 0.9, 0.09, 100.0, box, n) for n in range(2)]
    spark.createDataFrame(
        rows, "detection_id long, video_id string, class_id int, frame_index long, detection_index int, timestamp_ms long, confidence double, bbox_relative_area double, bbox_area_pixels double, bbox_xyxy_normalized array<double>, ingested_at long"
    ).write.parquet(f"{tmp_path}/detections.parquet")
    spark.createDataFrame([("back", 10.0, 2), ("on", 10.0, 2)], "video_id string, fps double, frame_count long").write.parquet(f"{tmp_path}/video_runs.parquet")
    assert {(r.video_id, r.broken) for r in inventories.event_violations(spark, str(tmp_path)).collect()} == {("back", "extent")}


def test_gray_difference(spark):
    df = spark.createDataFrame([([0, 255], [255, 255])], "a array<int>, b array<int>")
    assert df.select(grouping.gray_difference(F.col("a"), F.col("b"))).first()[0] == 0.5


def test_grouped_split_keeps_components(spark):
    rng = random.Random(1)
    rows = [(f"i{n}", f"c{rng.randrange(120)}", rng.choice(("India", "Japan")), rng.random() < 0.6, {"D00": rng.randrange(3), "D10": rng.randrange(2)}, 600, 600) for n in range(900)]
    members = spark.createDataFrame(rows, "canonical_image_id string, component string, country string, is_positive boolean, class_counts map<string,long>, width int, height int")
    features = grouping.component_features(members)
    plan = grouping.plan_split(features)
    assert plan.count() == plan.select("component").distinct().count() == len({r[1] for r in rows})
    assert {tuple(r) for r in plan.collect()} == {tuple(r) for r in grouping.plan_split(features.repartition(5)).collect()}
    share = {r.split: r.share for r in grouping.split_balance(features.join(plan, "component")).where("feature = 'images'").collect()}
    assert abs(share["train"] - 0.7) < 0.05 and abs(share["val"] - 0.15) < 0.05


def test_refinement_lowers_the_objective(spark):
    rng = random.Random(2)
    rows = [(f"i{n}", f"c{n // 6:03d}", rng.choice(("India", "Japan")), rng.random() < 0.5, {"D00": rng.randrange(3)}, 600, 600) for n in range(600)]
    features = grouping.component_features(spark.createDataFrame(rows, "canonical_image_id string, component string, country string, is_positive boolean, class_counts map<string,long>, width int, height int")).cache()
    poor = features.select("component", F.when(F.substring("component", 4, 1) < "5", "train").otherwise("val").alias("split"))
    edges = spark.createDataFrame([(f"c{n:03d}", f"c{n + 1:03d}", 2) for n in range(0, 98, 2)], "a string, b string, guards long")
    got = grouping.refine_split(features, poor, edges, passes=3)
    assert got.count() == 100 and {tuple(r) for r in got.collect()} == {tuple(r) for r in grouping.refine_split(features.repartition(3), poor, edges, passes=3).collect()}
    share = {r.split: r.share for r in grouping.split_balance(features.join(got, "component")).where("feature = 'images'").collect()}
    assert abs(share["train"] - 0.7) < 0.03 and abs(share["test"] - 0.15) < 0.03
    torn = lambda df: edges.join(df.select(F.col("component").alias("a"), F.col("split").alias("x")), "a").join(df.select(F.col("component").alias("b"), F.col("split").alias("y")), "b").where("x <> y").count()
    assert torn(got) < 49 * 0.6
    assert grouping.refine_split(features.limit(0), poor.limit(0), edges).count() == 0


def test_half_even_quantiles(spark):
    df = spark.createDataFrame([(v,) for v in (1, 1, 2, 3, 9)], "v long")
    r = grouping.half_even_quantiles(df, "v").first()
    assert (r.groups, r.p25, r.p50, r.p90, r.singletons, r.up_to_five) == (5, 1, 2, 9, 2, 4)


@pytest.mark.parametrize(
    "box, flags, half_open",
    [
        (("1", "1", "10", "10"), [], [0, 0, 10, 10]), (("0", "1", "10", "10"), ["source_zero_edge_coordinate"], [0, 0, 10, 10]), ((" 7 ", "1", "7.0", "1e1"), [], [6, 0, 7, 10]), (("x", "1", "2", "3"), ["malformed_coordinate"], None),
        (("1.5", "1", "2", "3"), ["non_integer_coordinate"], None), (("9", "1", "3", "9"), ["inverted_box", "zero_area_box"], None), (("1", "1", "101", "10"), ["out_of_bounds"], None), ((None, "1", "5", "5"), ["malformed_coordinate"], None),
    ],
)
def test_voc_boxes(spark, box, flags, half_open):
    df = spark.createDataFrame([box], "a string, b string, c string, d string")
    r = quality.voc_boxes(df, list("abcd"), F.lit(100), F.lit(100), tiny=0.0).first()
    assert r.flags == flags and r.half_open == half_open


def test_labels(spark):
    df = spark.createDataFrame([(1, "0 0.5000 0.5000 0.2000 0.2000\n\n7 0.5 0.5 0.1 0.1\n0 0.9 0.9 0.5 0.5\n0 x 0 0 0\n1 2\n0 nan 0.5 0.1 0.1"), (2, ""), (3, None)], "id int, t string")
    got = {(r.id, r.line_number): r.errors for r in quality.label_errors(df, "t", places=4).collect()}
    assert got[1, 1] == [] and got[1, 3] == ["class_id", "precision"] and got[1, 4] == ["box_bounds", "precision"] and got[1, 5] == ["non_numeric"] and got[1, 6] == ["field_count"] and got[1, 7][0] == "non_finite"
    assert {i for i, _ in got} == {1}


def test_scalars(spark):
    df = spark.createDataFrame([("00:01:02.5", 62.5, "00:01:02.500"), ("1:00:00", 3600.0, "01:00:00.000"), ("00:61:00", None, None), ("abc", None, None), (None, None, None)], "c string, s double, f string")
    for r in df.select(k.parse_clock(F.col("c")).alias("p"), "s", k.format_clock(F.col("s")).alias("q"), "f").collect():
        assert r.p == r.s and r.q == r.f
    r = spark.createDataFrame([("a/IN_007.tar.jpg", 3, 25.0), ("12.jpg", 1, 2.0), (".hidden", 5, 4.0)], "n string, f long, fps double")
    got = r.select(k.stem(F.col("n")), k.filename_prefix(F.col("n")), k.filename_number(F.col("n")), k.frame_ms(F.col("f"), F.col("fps"))).collect()
    assert [tuple(x) for x in got] == [("IN_007.tar", "IN_007.tar", None, 120), ("12", "", 12, 500), (".hidden", ".hidden", None, 1250)]
    h = spark.createDataFrame([("ff00000000000000", "fe00000000000001")], "a string, b string")
    assert h.select(k.hamming(k.hex64(F.col("a")), k.hex64(F.col("b")))).first()[0] == 2


def test_sampling(spark):
    rows = spark.createDataFrame([(f"f{n}", "ab"[n % 2]) for n in range(100)], "f string, s string")
    a = [r.f for r in sampling.hash_sample(rows, "f", 7, 42, "x").collect()]
    assert a == [r.f for r in sampling.hash_sample(rows.repartition(5), "f", 7, 42, "x").collect()] and len(a) == 7
    assert sampling.stratified_sample(rows, ["s"], "f", 3, 1).count() == 6
    bins = sampling.temporal_bins(spark.range(10).withColumn("v", F.lit("x")), ["v"], "id", 4)
    assert [r.bin for r in bins.orderBy("id").collect()] == [next(b + 1 for b in range(4) if b * 10 // 4 <= i < (b + 1) * 10 // 4) for i in range(10)]
    v = spark.createDataFrame([("v", 10.0, 100), ("w", None, 10), ("x", 10.0, 2)], "video_id string, fps double, frame_count long")
    assert [r.frame_index for r in sampling.interval_frames(v, 2.0, 1.0).orderBy("frame_index").collect()] == [10, 30, 50, 70]
    assert [r.frame_index for r in sampling.distributed_frames(v, 3).orderBy("sample").collect()] == [10, 50, 89]


def test_showcase_takes_no_sample_twice(spark):
    rows = [("a", {0: 0.9, 1: 0.9}, False), ("b", {0: 0.5}, False), ("c", {1: 0.1}, False), ("n", None, True), ("m", None, True)]
    s = spark.createDataFrame(rows, "filename string, areas map<int,double>, negative boolean")
    got = {(r.chosen_for, r.filename) for r in sampling.class_showcase(s, [0, 1], 2, 1, 42).collect()}
    assert {x for x in got if x[0] != "negative"} == {("0", "a"), ("0", "b"), ("1", "c")} and len(got) == 4


def test_covering_sample(spark):
    rows = [(f"f{n}", "India" if n % 3 else "Japan", [n % 4] if n % 5 else [], n % 4 == 1 and n % 3 > 0 and n % 5 > 0, n % 5 > 0) for n in range(200)]
    s = spark.createDataFrame(rows, "filename string, country string, classes array<int>, rare boolean, positive boolean")
    got = sampling.covering_sample(s, 12, 4, 2, 42).collect()
    by = {r[0]: r for r in rows}
    chosen = [by[r.filename] for r in got]
    assert len(got) == 16 and len({r.filename for r in got}) == 16 and {c for r in chosen for c in r[2]} == {0, 1, 2, 3} and {r[1] for r in chosen} == {"India", "Japan"}


def test_history(spark):
    rows = spark.createDataFrame([("r", n + 1, f) for n, f in enumerate([0.0, 0.0, 0.5, 0.5, 0.4, 0.6])], "run string, epoch int, fitness double")
    assert [r.best_epoch for r in summary.best_epochs(rows, ["run"], "epoch", "fitness", 2).orderBy("epoch").collect()] == [1, 2, 3, 3, 3, 6]
    assert summary.history_gaps(rows, ["run"], "epoch", ["fitness"]).count() == 0


def test_reconciliation(spark):
    a, b = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, None)], "id int, v double"), spark.createDataFrame([(1, 2.1), (3, 1.0)], "id int, v double")
    assert {tuple(r) for r in reconcile.set_difference(a, b, ["id"]).collect()} == {(2, "missing"), (3, "unexpected")}
    assert reconcile.bag_difference(a, a).count() == 0 and reconcile.bag_difference(a, b).count() == 5
    assert {(r.id, r.field) for r in reconcile.value_differences(a.distinct(), b, ["id"], {"v": 0.2}).collect()} == {(3, "v")}
    assert [r.broken for r in reconcile.violations(a, {"v": F.col("v") > 0}).collect()] == [["v"]]
    with pytest.raises(reconcile.InvariantError):
        reconcile.enforce("repeated", reconcile.repeated_keys(a, ["id"]))
    jobs = spark.createDataFrame([("j", 1, "queued"), ("j", 2, "RUNNING"), ("j", 3, "completed"), ("j", 4, "running")], "job string, at int, status string")
    assert [tuple(r) for r in reconcile.bad_transitions(jobs, "job", "at", "status").collect()] == [("j", 4, "completed", "running")]
    d = reconcile.table_digest(a, ["id", "v"], ["id", "v"]).first()
    assert d == reconcile.table_digest(a.repartition(3), ["id", "v"], ["id", "v"]).first() and d.rows == 3
    assert reconcile.table_digest(a.limit(0), ["id"], ["id"]).first().rows == 0


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "x")], "b int, a string")
    files.write_jsonl(df, str(tmp_path / "j"), ["b"])
    lines = [x for p in sorted((tmp_path / "j").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == ['{"a":"x","b":1}', '{"a":null,"b":2}']
    with pytest.raises(FileExistsError):
        files.write_jsonl(df, str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j"), "a string, b int").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"b": 1}\n\n{"b": }\n')
    assert files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "b int", strict=False).where("_corrupt IS NOT NULL").select("b", "_corrupt").collect()[0]._corrupt == '{"b": }'
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "b int").collect()
    files.write_csv(df, str(tmp_path / "c"))
    assert files.read_csv(spark, str(tmp_path / "c"), "b int, a string").where("a IS NULL").count() == 1
    with pytest.raises(ValueError):
        files.write_csv(df.limit(0), str(tmp_path / "e"), allow_empty=False)
    files.write_parquet(df, str(tmp_path / "p"))
    assert files.read_binary(spark, str(tmp_path / "p"), "*.parquet").select("format").distinct().count() == 1
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "One.txt").write_text("0 1 2 3 4\n")
    assert files.read_texts(spark, str(tmp_path / "labels")).select("stem", "text").first() == ("one", "0 1 2 3 4\n")
    with pytest.raises(ValueError):
        files.strict_object('{"a": 1, "a": 2}')
    with pytest.raises(ValueError):
        files.strict_object('{"a": NaN}')
    assert files.strict_object(json.dumps({"a": 1})) == {"a": 1}


def test_voc_xml(spark):
    one = "<annotation><filename>a.jpg</filename><size><width>10</width><height>20</height></size><object><name>D00</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object></annotation>"
    df = spark.createDataFrame([("a", one), ("b", "<annotation><size><width>5</width></size></annotation>"), ("c", "<annotation><broken>")], "id string, text string")
    got = {r.id: (r.parse_error, r.width, r.object_index, r.raw_class, r.xmax) for r in files.parse_voc(df).collect()}
    assert got["a"] == (False, 10, 1, "D00", "3") and got["b"][:3] == (False, 5, None) and got["c"][0] is True


def test_norm(spark):
    df = spark.createDataFrame([(" \tA b\n",), (None,), ("",)], "x string")
    assert [r[0] for r in df.select(norm("x")).collect()] == ["a b", None, ""]


def test_runs_and_numbers_over_blocks(spark):
    rng = random.Random(6)
    rows = sorted({(rng.choice(("a", "b", None)), rng.randrange(400)) for _ in range(150)}, key=str)
    df = spark.createDataFrame(rows, "k string, t long")
    want, number = {}, {}
    for key in {r[0] for r in rows}:
        run, start, before = -1, None, None
        for n, t in enumerate(sorted(t for k_, t in rows if k_ == key)):
            if before is None or t - before > 5:
                run, start = run + 1, t
            before = t
            want[key, t], number[key, t] = (run, start), n + 1
    for block in (3, 7, 1000):
        got = ordered.runs(df, ["k"], "t", [], lambda p, q: q - p > 5, block).collect()
        assert {(r.k, r.t): (r.run, r.run_start) for r in got} == want
        assert {(r.k, r.t): r.n for r in ordered.numbered(df, ["k"], "t", [], block).collect()} == number


def test_near_duplicate_classes_keep_every_link(spark):
    """Copies are members of one class; every close pair of images is a pair of their classes or lies in one class."""
    rng = random.Random(12)
    base = [rng.getrandbits(63) for _ in range(6)]
    rows = []
    for n in range(160):
        h = rng.choice(base)
        for _ in range(rng.choice((0, 0, 1, 2, 5))):
            h ^= 1 << rng.randrange(63)
        rows.append((f"i{n:03d}", h if n % 20 else None, rng.choice(("s", "t", None)), rng.choice((1, 2, None)), 1))
    df = spark.createDataFrame(rows + rows[:5], "id string, hash long, sha string, width int, height int")
    pairs, members = (x.collect() for x in grouping.near_duplicate_classes(df))
    of = {r.id: r.representative for r in members}
    assert len(of) == len(members) == sum(r[1] is not None for r in rows)
    linked = {(r.a, r.b): r for r in pairs}
    assert len(linked) == len(pairs) and all(a < b for a, b in linked)
    bands = lambda h: {(b, h >> 16 * b & 0xFFFF) for b in range(4)}
    for i, p in enumerate(rows):
        for q in rows[i + 1 :]:
            if p[1] is not None and q[1] is not None and (p[1] ^ q[1]).bit_count() <= 6 and bands(p[1]) & bands(q[1]):
                a, b = sorted((of[p[0]], of[q[0]]))
                assert a == b or linked[(a, b)].distance == (p[1] ^ q[1]).bit_count()
                assert a == b or linked[(a, b)].hard_split_constraint == ((p[1] ^ q[1]).bit_count() <= 2 and p[3] is not None and p[3] == q[3])
    copies = {}
    for r in members:
        copies[r.representative] = copies.get(r.representative, 0) + 1
    assert all(copies[r.representative] == r.copies for r in members) and all(r.a_copies == copies[r.a] and r.b_copies == copies[r.b] for r in pairs)
    assert all(x.count() == 0 for x in grouping.near_duplicate_classes(df.limit(0)))
