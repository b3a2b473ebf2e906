"""Capture groups, duplicates, leakage-safe splits and their audits."""

from __future__ import annotations

import hashlib
import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from detlake.functions import keys as k
from detlake.operators import ordered
from detlake.operators.components import components
from detlake.session import cut, norm

SPLITS = ("train", "val", "test")


def capture_groups(images: DataFrame, gap_seconds: int = 60, span_seconds: int = 30, block: int = 50, method: str = "numeric_block_proxy", block_seconds: int = 86_400) -> DataFrame:
    """Add prefix, number, method, sequence_key, sequence_index and capture_group.

    Images with a timestamp (canonical_image_id, country, filename, ts_ms) are sessionised per (country, prefix) by pauses
    and cut into spans from the session's start; others fall into blocks of their trailing number, or stand alone.
    """
    rows = images.withColumn("prefix", k.filename_prefix(F.col("filename"))).withColumn("number", k.filename_number(F.col("filename")))
    gap = gap_seconds * 1000
    timed = ordered.runs(rows.where("ts_ms IS NOT NULL"), ["country", "prefix"], "ts_ms", ["canonical_image_id"], lambda before, now: now - before > gap, block_seconds * 1000)
    timed = timed.withColumn("sequence_index", F.floor((F.col("ts_ms") - F.col("run_start")) / (span_seconds * 1000)).cast("long")).drop("run_start")
    timed = timed.withColumn("sequence_key", F.concat_ws("|", "country", "prefix", F.lit("timestamp"), F.concat(F.lit("run:"), F.col("run").cast("string")))).withColumn("method", F.lit("timestamp"))
    timed = timed.withColumn("capture_group", k.stable_id("cg", F.col("sequence_key"), F.col("sequence_index")))
    rest = rows.where("ts_ms IS NULL").withColumn("run", F.lit(None).cast("long")).withColumn("sequence_index", F.coalesce(F.floor(F.col("number") / block).cast("long"), F.lit(0)))
    tail = F.when(F.col("number").isNull(), F.lit(f"{method}_unparsed")).otherwise(F.lit(method))
    rest = rest.withColumn("sequence_key", F.concat_ws("|", "country", "prefix", tail)).withColumn("method", F.lit(method))
    part = F.when(F.col("number").isNull(), F.col("canonical_image_id")).otherwise(F.col("sequence_index").cast("string"))
    rest = rest.withColumn("capture_group", k.stable_id("cg", F.col("sequence_key"), part))
    return timed.unionByName(rest)


def group_summary(grouped: DataFrame) -> DataFrame:
    """One row per capture group: size and extent."""
    return grouped.groupBy("capture_group", "country", "prefix", "method", "sequence_key", "sequence_index").agg(F.count("*").alias("images"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.min("number").alias("first_number"), F.max("number").alias("last_number"))


def half_even_quantiles(sizes: DataFrame, value: str, percents: tuple[int, ...] = (10, 25, 50, 75, 90, 95, 99)) -> DataFrame:
    """One row: exact quantiles with index round((n - 1) f), ties to even, and counts of singletons and small groups."""
    counted = sizes.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    ranked = counted.select("v", "c", F.sum("c").over(W.orderBy("v")).alias("upto"), F.sum("c").over(W.partitionBy(F.lit(0))).alias("n"))
    pick = lambda p: F.min(F.when(F.col("upto") > F.bround(F.lit(p) * (F.col("n") - 1) / 100), F.col("v"))).alias(f"p{p}")
    return ranked.agg(F.max("n").alias("groups"), F.min("v").alias("minimum"), *map(pick, percents), F.max("v").alias("maximum"), F.sum(F.when(F.col("v") == 1, F.col("c")).otherwise(0)).alias("singletons"), F.sum(F.when(F.col("v") <= 5, F.col("c")).otherwise(0)).alias("up_to_five"))


def boundary_guard(grouped: DataFrame, assigned: DataFrame, numeric: int = 5, seconds: int = 10, block: int = 50) -> DataFrame:
    """(canonical_image_id, reasons) of images close to the boundary of neighbouring groups in different splits.

    ``assigned`` is (canonical_image_id, split). Neighbours are found with lead over one row a group; images then meet
    their group's boundaries in an equi-join.
    """
    rows = grouped.join(assigned.select("canonical_image_id", "split"), "canonical_image_id")
    groups = rows.groupBy("sequence_key", "sequence_index", "capture_group", "method").agg(F.min(F.struct("canonical_image_id", "split"))["split"].alias("split"), F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi"))
    w = W.partitionBy("sequence_key").orderBy("sequence_index", "capture_group")
    following = lambda c: F.lead(c).over(w).alias(f"n_{c}")
    pairs = groups.select("*", *map(following, ("sequence_index", "capture_group", "split", "lo")))
    pairs = pairs.where((F.col("n_sequence_index") == F.col("sequence_index") + 1) & (F.col("split") != F.col("n_split")))
    reason = F.concat_ws(":", F.lit("boundary_guard_between"), "capture_group", "split", "n_capture_group", "n_split")
    timed = F.col("method") == "timestamp"
    edge = (F.col("sequence_index") + 1) * block
    lower = pairs.select("capture_group", reason.alias("reason"), F.lit(True).alias("below"), timed.alias("timed"), F.when(timed, F.col("hi") - seconds * 1000).otherwise(edge - numeric).alias("limit"))
    upper = pairs.select(F.col("n_capture_group").alias("capture_group"), reason.alias("reason"), F.lit(False).alias("below"), timed.alias("timed"), F.when(timed, F.col("n_lo") + seconds * 1000).otherwise(edge + numeric).alias("limit"))
    j = rows.select("canonical_image_id", "capture_group", "ts_ms", "number").join(lower.unionByName(upper), "capture_group")
    at = F.when(F.col("timed"), F.col("ts_ms")).otherwise(F.col("number"))
    near = F.when(F.col("below"), at >= F.col("limit")).when(F.col("timed"), at <= F.col("limit")).otherwise(at < F.col("limit"))
    return j.where(near).groupBy("canonical_image_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def exact_duplicates(images: DataFrame, key: str = "image_sha256") -> DataFrame:
    """(duplicate_group, key, member_count, canonical_image_id): a row a member of each value that several images share.

    Null and blank values don't count. Members are rows and no list, so a value may have any number of them.
    """
    rows = images.where(F.col("canonical_image_id").isNotNull()).select("canonical_image_id", norm(key).alias("key")).where("key <> ''").distinct()
    shared = rows.groupBy("key").agg(F.count("*").alias("member_count")).where("member_count > 1")
    return rows.join(shared, "key").select(k.stable_id("exact", F.col("key")).alias("duplicate_group"), "key", "member_count", "canonical_image_id")


def gray_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two equally long arrays of gray values, as a share of 255."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda s, x: s + x) / (F.lit(255.0) * F.size(a))


#: A bucket of more distinct hashes is refined: its other 48 bits are cut into eight blocks of six, of which two hashes within six bits agree in two at least.
HOT_BUCKET = 1_000
FINE_BLOCKS, FINE_BITS = 8, 6


def close_hashes(values: DataFrame, max_distance: int = 6, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(ha, hb, distance): all pairs of distinct hashes, ha < hb, that share a 16-bit band and differ in at most ``max_distance`` bits.

    ``values`` is (hash as long). Large buckets are refined by further bits, which loses no pair; a distance over six
    bits leaves fewer blocks equal, so buckets are then compared whole.
    """

    def rest(b: int) -> Column:
        low = F.col("hash").bitwiseAND(F.lit((1 << 16 * b) - 1))
        return low if b == 3 else low.bitwiseOR(F.shiftleft(F.shiftrightunsigned("hash", 16 * (b + 1)), 16 * b))

    bands = F.array(*(F.struct(F.lit(b).alias("band"), F.shiftrightunsigned("hash", 16 * b).bitwiseAND(F.lit(0xFFFF)).alias("value"), rest(b).alias("rest")) for b in range(4)))
    rows = values.select("hash").distinct().select("hash", F.explode(bands).alias("k")).select("hash", "k.*")
    whole = F.struct(F.lit(-1).alias("blocks"), F.lit(0).cast("long").alias("fine"))
    if max_distance <= FINE_BLOCKS - 2:
        hot = rows.groupBy("band", "value").agg(F.count("*").alias("_n")).where(F.col("_n") > hot_bucket).select("band", "value", F.lit(True).alias("_hot"))
        block = lambda i: F.shiftrightunsigned("rest", FINE_BITS * i).bitwiseAND(F.lit((1 << FINE_BITS) - 1))
        fine = F.array(*(F.struct(F.lit(n).alias("blocks"), F.shiftleft(block(i), FINE_BITS).bitwiseOR(block(j)).alias("fine")) for n, (i, j) in enumerate(itertools.combinations(range(FINE_BLOCKS), 2))))
        rows = rows.join(hot, ["band", "value"], "left").select("hash", "band", "value", F.explode(F.when(F.col("_hot"), fine).otherwise(F.array(whole))).alias("k"))
    else:
        rows = rows.select("hash", "band", "value", whole.alias("k"))
    rows = rows.select("band", "value", "k.blocks", "k.fine", F.col("hash").alias("ha"))
    pairs = rows.join(rows.withColumnRenamed("ha", "hb"), ["band", "value", "blocks", "fine"]).where("ha < hb")
    return pairs.select("ha", "hb", k.hamming(F.col("ha"), F.col("hb")).cast("int").alias("distance")).where(F.col("distance") <= max_distance).distinct()


def near_duplicate_candidates(hashes: DataFrame, max_distance: int = 6, bucket_limit: int | None = None, neighbours: int = 20) -> DataFrame:
    """(a, b, distance): all pairs of ids that share a 16-bit band of a 64-bit hash and differ in at most ``max_distance`` bits.

    ``hashes`` is (id, hash as long). Ids are collapsed to distinct hashes, and close hashes are spread to ids again. Only
    with a ``bucket_limit`` (128 in the original) are pairs left out: a bucket of more ids pairs each id only with the next
    ``neighbours`` in id order.
    """
    if bucket_limit is not None:
        return _windowed_candidates(hashes, max_distance, bucket_limit, neighbours)
    rows = cut(hashes.select("id", "hash").distinct())
    side = lambda i, h: rows.select(F.col("id").alias(i), F.col("hash").alias(h))
    same = side("a", "h").join(side("b", "h"), "h").where("a < b").select("a", "b", F.lit(0).alias("distance"))
    close = close_hashes(rows, max_distance).join(side("x", "ha"), "ha").join(side("y", "hb"), "hb").where("x <> y")
    return same.unionByName(close.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")).distinct()


def near_duplicate_links(hashes: DataFrame, max_distance: int = 6) -> DataFrame:
    """(a, b): links that connect the same ids as all pairs of ``near_duplicate_candidates``.

    One link an id, to the first of its hash, and one a pair of close hashes, so copies of a hash don't cost their square.
    """
    rows = cut(hashes.select("id", "hash").distinct())
    first = cut(rows.groupBy("hash").agg(F.min("id").alias("first")))
    side = lambda i, h: first.select(F.col("first").alias(i), F.col("hash").alias(h))
    close = close_hashes(first, max_distance).join(side("a", "ha"), "ha").join(side("b", "hb"), "hb").select("a", "b")
    return rows.join(first, "hash").select(F.col("first").alias("a"), F.col("id").alias("b")).unionByName(close).where("a <> b")


def near_duplicate_classes(images: DataFrame, max_distance: int = 6, confirmed_distance: int = 2) -> tuple[DataFrame, DataFrame]:
    """Pairs between classes of alike images, and membership.

    ``images`` is (id, hash as long, sha, width, height). A class are the images of one hash and size, named by its least id. Pairs
    are (a, b, distance, relationship, hard_split_constraint, a_copies, b_copies) of all classes whose hashes share a 16-bit
    band and differ in at most ``max_distance`` bits, confirmed if the sizes agree and the hashes are close. Members are
    (id, representative, copies, relationship): exact copies of the representative by sha, else near duplicates of it. So
    copies cost a row each and not their square, and no link between different images is lost. Null hashes are left out.
    """
    rows = cut(images.where("hash IS NOT NULL").select("id", "hash", "sha", "width", "height").distinct())
    first = F.min(F.struct("id", "sha")).alias("f")
    named = rows.groupBy("hash", "width", "height").agg(first, F.count_distinct("id").alias("copies"))
    classes = cut(named.select(F.col("f.id").alias("representative"), F.col("f.sha").alias("first_sha"), "hash", "width", "height", "copies"))
    side = lambda s, h: classes.select(F.col("representative").alias(s), F.col("hash").alias(h), F.col("width").alias(f"{s}_w"), F.col("height").alias(f"{s}_h"), F.col("copies").alias(f"{s}_copies"))
    same = side("x", "h").join(side("y", "h"), "h").where("x < y").drop("h").withColumn("distance", F.lit(0))
    close = close_hashes(classes, max_distance).join(side("x", "ha"), "ha").join(side("y", "hb"), "hb").drop("ha", "hb")
    both = same.unionByName(close)
    sure = F.coalesce((F.col("distance") <= confirmed_distance) & (F.col("x_w") == F.col("y_w")) & (F.col("x_h") == F.col("y_h")), F.lit(False))
    turned = F.col("x") > F.col("y")
    pick = lambda p, q: F.when(turned, F.col(q)).otherwise(F.col(p))
    relationship = F.when(sure, "confirmed_near_duplicate").otherwise("candidate_warning")
    pairs = both.select(pick("x", "y").alias("a"), pick("y", "x").alias("b"), "distance", relationship.alias("relationship"), sure.alias("hard_split_constraint"), pick("x_copies", "y_copies").alias("a_copies"), pick("y_copies", "x_copies").alias("b_copies"))
    on = F.lit(True)
    for c in ("hash", "width", "height"):
        on = on & rows[c].eqNullSafe(classes[c])
    kind = F.when(F.col("id") == F.col("representative"), "representative").when(F.col("sha") == F.col("first_sha"), "exact").when(rows["width"].isNotNull() & rows["height"].isNotNull(), "confirmed_near_duplicate").otherwise("candidate_warning")
    members = rows.join(classes, on).select("id", "representative", "copies", kind.alias("relationship")).distinct()
    return pairs, members


def _windowed_candidates(hashes: DataFrame, max_distance: int, bucket_limit: int, neighbours: int) -> DataFrame:
    bands = F.array(*(F.struct(F.lit(b).alias("band"), F.shiftrightunsigned("hash", 16 * b).bitwiseAND(F.lit(0xFFFF)).alias("value")) for b in range(4)))
    rows = hashes.select("id", "hash").distinct().select("id", "hash", F.explode(bands).alias("k")).select("id", "hash", "k.band", "k.value")
    sizes = rows.groupBy("band", "value").agg(F.count("*").alias("members")).where("members > 1")
    rows = rows.join(sizes, ["band", "value"])
    small = rows.where(F.col("members") <= bucket_limit)
    right = lambda df, *more: df.select("band", "value", F.col("id").alias("b"), F.col("hash").alias("hb"), *more)
    pairs = small.join(right(small), ["band", "value"]).where("id < b").select(F.col("id").alias("a"), "b", "hash", "hb")
    numbered = rows.where(F.col("members") > bucket_limit).withColumn("rn", F.row_number().over(W.partitionBy("band", "value").orderBy("id")))
    reach = numbered.withColumn("rb", F.explode(F.sequence(F.col("rn") + 1, F.col("rn") + neighbours)))
    wide = reach.join(right(numbered, F.col("rn").alias("rb")), ["band", "value", "rb"]).select(F.col("id").alias("a"), "b", "hash", "hb")
    return pairs.unionByName(wide).withColumn("distance", k.hamming(F.col("hash"), F.col("hb")).cast("int")).where(F.col("distance") <= max_distance).select("a", "b", "distance").distinct()


def relations(pairs: DataFrame, images: DataFrame, confirmed_distance: int = 2, confirmed_difference: float = 0.03) -> DataFrame:
    """Candidate pairs with their relationship; ``images`` is (id, sha, width, height[, gray array]).

    Pairs of one exact hash are left out. Confirmed: close hashes, equal dimensions and, where gray values are there,
    a small mean difference.
    """
    gray = "gray" in images.columns
    cols = ["sha", "width", "height", *(["gray"] if gray else [])]
    side = lambda s: images.select(F.col("id").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in cols))
    j = pairs.join(side("a"), "a").join(side("b"), "b").where("a_sha IS NULL OR b_sha IS NULL OR a_sha <> b_sha")
    difference = gray_difference(F.col("a_gray"), F.col("b_gray")) if gray else F.lit(None).cast("double")
    sure = (F.col("distance") <= confirmed_distance) & (F.col("a_width") == F.col("b_width")) & (F.col("a_height") == F.col("b_height")) & (F.coalesce(difference, F.lit(0.0)) <= F.lit(confirmed_difference))
    sure = F.coalesce(sure, F.lit(False))
    return j.select("a", "b", "distance", difference.alias("gray_difference"), F.when(sure, "confirmed_near_duplicate").otherwise("candidate_warning").alias("relationship"), sure.alias("hard_split_constraint"))


def duplicate_components(pairs: DataFrame, prefix: str = "near_candidate") -> DataFrame:
    """(duplicate_group, member_count, members) of the components of (a, b)."""
    found = components(pairs, "a", "b").groupBy("root").agg(F.array_sort(F.collect_list("vertex")).alias("members"))
    return found.select(k.stable_id(prefix, F.array_join("members", "\0")).alias("duplicate_group"), F.size("members").alias("member_count"), "members")


def split_components(images: DataFrame, binding: DataFrame) -> DataFrame:
    """(canonical_image_id, component): images bound by capture group, exact duplicate group or a binding pair (a, b).

    Groups are vertices of their own, so a group costs one edge a member.
    """
    member = F.concat(F.lit("i:"), "canonical_image_id")
    edges = images.where("capture_group IS NOT NULL").select(member.alias("a"), F.concat(F.lit("g:"), "capture_group").alias("b"))
    edges = edges.unionByName(images.where("exact_group IS NOT NULL").select(member.alias("a"), F.concat(F.lit("x:"), "exact_group").alias("b")))
    edges = edges.unionByName(binding.select(F.concat(F.lit("i:"), "a").alias("a"), F.concat(F.lit("i:"), "b").alias("b")))
    roots = components(edges, "a", "b").where(F.col("vertex").startswith("i:")).select(F.expr("substring(vertex, 3)").alias("canonical_image_id"), F.col("root").alias("component"))
    return images.select("canonical_image_id").distinct().join(roots, "canonical_image_id", "left").withColumn("component", F.coalesce("component", F.concat(F.lit("i:"), "canonical_image_id")))


#: Weights of the balancing features.
WEIGHTS = {"images": 12.0, "class": 4.0, "country": 3.0, "polarity": 2.0, "resolution": 0.75}
RATIOS = {"train": 0.7, "val": 0.15, "test": 0.15}


def component_features(members: DataFrame) -> DataFrame:
    """(component, features map, images) from (component, country, is_positive, class_counts map, width, height)."""
    base = members.select(
        "component",
        F.map_concat(
            F.map_from_arrays(
                F.array(F.lit("images"), F.concat(F.lit("country:"), "country"), F.when(F.col("is_positive"), F.lit("polarity:positive")).otherwise(F.lit("polarity:negative")), F.concat_ws("", F.lit("resolution:"), F.col("country"), F.lit(":"), F.col("width"), F.lit("x"), F.col("height"))),
                F.array(*[F.lit(1).cast("long")] * 4),
            ),
            F.transform_keys("class_counts", lambda c, n: F.concat(F.lit("class:"), c.cast("string"))),
        ).alias("m"),
    )
    long = base.select("component", F.explode("m").alias("f", "n")).groupBy("component", "f").agg(F.sum("n").alias("n"))
    return long.groupBy("component").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("f", "n")))).alias("features"))


#: Members of a bundle are put in order by hash, in so many hash ranges.
_HASHES, _RANGES = 1 << 40, 1024


def _bundles(features: DataFrame, seed: int) -> DataFrame:
    """Components with their bundle: alike are those of one size class whose most frequent feature of each kind agrees.

    Sizes are told apart exactly up to 16 and by quarters of powers of two beyond, so bundles grow with the logarithm of the
    sizes and with the features there are, not with the components.
    """
    n = F.coalesce(F.try_element_at("features", F.lit("images")), F.lit(0))
    size = F.when(n <= 16, n).otherwise(F.floor(F.log2(n) * 4) + 1000).cast("string")
    most = lambda kind: F.array_max(F.transform(F.filter(F.map_entries("features"), lambda e: e["key"].startswith(kind)), lambda e: F.struct(e["value"].alias("n"), e["key"].alias("f"))))["f"]
    kinds = [F.coalesce(most(f"{kind}:"), F.lit("")) for kind in WEIGHTS if kind != "images"]
    return features.select("component", "features", F.concat_ws("|", size, *kinds).alias("bundle"), F.pmod(F.xxhash64(F.lit(seed), "component"), F.lit(_HASHES)).alias("h"))


def _shares(grow: list[float], steep: list[float], many: int, ties: list[str]) -> list[int]:
    """How many of ``many`` like members each split gets so that the sum of grow * c + steep * c^2 is least."""
    # the least of a convex sum has one level of marginal cost for all splits that get anything
    if min(steep) <= 0:
        real = [0.0] * len(grow)
        real[min(range(len(grow)), key=lambda i: (grow[i], ties[i]))] = float(many)
    else:
        order, width, base = sorted(range(len(grow)), key=grow.__getitem__), 0.0, 0.0
        for n, i in enumerate(order):
            width, base = width + 1 / steep[i], base + grow[i] / steep[i]
            level = (2 * many + base) / width
            if n + 1 == len(order) or level <= grow[order[n + 1]]:
                break
        real = [max(0.0, (level - g) / (2 * a)) for g, a in zip(grow, steep)]
    out = [int(x + 1e-9) for x in real]
    for _ in range(many - sum(out)):
        i = min(range(len(out)), key=lambda i: (grow[i] + steep[i] * (2 * out[i] + 1), ties[i]))
        out[i] += 1
    return out


def plan_split(features: DataFrame, ratios: dict[str, float] = RATIOS, seed: int = 42) -> DataFrame:
    """(component, split): splits of components such that the weighted squared relative deviations from the ratios stay least.

    Components are taken in bundles of alike ones, largest first. Growing a split by c members of a bundle costs a quadratic
    in c, so a whole bundle is shared out in closed form, and its members are dealt to the shares in the order of their
    hash. Only sums a bundle reach the driver. Ties fall by seeded hashes.
    """
    spark = features.sparkSession
    rows = cut(_bundles(features, seed))
    sums = rows.select("bundle", F.explode("features").alias("f", "n")).groupBy("bundle", "f").agg(F.sum("n").alias("n")).collect()
    many = {r["bundle"]: r["m"] for r in rows.groupBy("bundle").agg(F.count("*").alias("m")).collect()}
    held: dict[str, dict[str, int]] = {b: {} for b in many}
    totals: dict[str, int] = {}
    for r in sums:
        held[r["bundle"]][r["f"]] = r["n"]
        totals[r["f"]] = totals.get(r["f"], 0) + r["n"]
    goal = {(s, f): t * ratio for s, ratio in ratios.items() for f, t in totals.items()}
    above = {at: -g for at, g in goal.items()}  # what a split holds less its goal
    dealt = []
    for bundle in sorted(many, key=lambda b: (-held[b].get("images", 0) / many[b], b)):
        m = many[bundle]
        mean = {f: n / m for f, n in held[bundle].items() if n}
        factor = {(s, f): WEIGHTS[f.split(":")[0]] / max(goal[s, f], 1.0) ** 2 for s in ratios for f in mean}
        grow = [sum(2 * factor[s, f] * above[s, f] * v for f, v in mean.items()) for s in ratios]
        steep = [sum(factor[s, f] * v * v for f, v in mean.items()) for s in ratios]
        low = 0
        for s, c in zip(ratios, _shares(grow, steep, m, [hashlib.sha256(f"{seed}:{bundle}:{s}".encode()).hexdigest() for s in ratios])):
            for f, v in mean.items():
                above[s, f] += c * v
            dealt.append((bundle, s, low, low + c))
            low += c
    plan = spark.createDataFrame(dealt, "bundle string, split string, low long, high long")
    placed = ordered.numbered(rows.select("component", "bundle", "h"), ["bundle"], "h", ["component"], _HASHES // _RANGES)
    return placed.join(plan, "bundle").where("n > low AND n <= high").select("component", "split")


#: Weights of the refinement's objective, in squared percentage points, transitions and guarded images.
REFINEMENT = {"ratio": 4.0, "country": 4.0, "class": 0.25, "polarity": 0.5, "transition": 1.0, "guard": 0.1, "violation": 1000.0}


def boundary_edges(grouped: DataFrame, member: DataFrame, seconds: int = 10) -> DataFrame:
    """(a, b, guards): components of neighbouring timestamp groups, and the images that a boundary between them would cost.

    ``grouped`` is the result of ``capture_groups``, ``member`` (canonical_image_id, component).
    """
    rows = grouped.where("method = 'timestamp'").join(member, "canonical_image_id").select("sequence_key", "sequence_index", "capture_group", "component", "ts_ms")
    groups = rows.groupBy("sequence_key", "sequence_index", "capture_group").agg(F.min("component").alias("a"), F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi"))
    w = W.partitionBy("sequence_key").orderBy("sequence_index", "capture_group")
    pairs = groups.select("capture_group", "a", "hi", *(F.lead(c).over(w).alias(f"n_{c}") for c in ("sequence_index", "capture_group", "a", "lo")), "sequence_index")
    pairs = pairs.where("n_sequence_index = sequence_index + 1 AND a <> n_a")
    ends = F.array(F.struct(F.col("capture_group").alias("g"), F.lit(True).alias("below"), (F.col("hi") - seconds * 1000).alias("limit")), F.struct(F.col("n_capture_group").alias("g"), F.lit(False).alias("below"), (F.col("n_lo") + seconds * 1000).alias("limit")))
    sides = pairs.select(F.col("a"), F.col("n_a").alias("b"), F.col("capture_group").alias("edge"), F.explode(ends).alias("e")).select("a", "b", "edge", F.col("e.g").alias("capture_group"), "e.below", "e.limit")
    near = F.when(F.col("below"), F.col("ts_ms") >= F.col("limit")).otherwise(F.col("ts_ms") <= F.col("limit"))
    return rows.select("capture_group", "ts_ms").join(sides, "capture_group").where(near).groupBy("a", "b", "edge").agg(F.count("*").alias("guards")).drop("edge")


def _parts(counts: dict[str, float], split: str, totals: dict[str, float], ratios: dict[str, float], tolerance: tuple[float, float]) -> float:
    """One split's share of the objective."""
    w, images = REFINEMENT, counts.get("images", 0)
    off = 100.0 * images / totals["images"] - 100.0 * ratios[split]
    score, excess = w["ratio"] * off * off, max(0.0, abs(off) - tolerance[0]) ** 2
    countries = sorted(f for f in totals if f.startswith("country:"))
    for f in countries[:-1]:  # the last one's share follows from the others
        gap = (100.0 * counts.get(f, 0) / images if images else 0.0) - 100.0 * totals[f] / totals["images"]
        score, excess = score + w["country"] * gap * gap, excess + max(0.0, abs(gap) - tolerance[1]) ** 2
    for f, total in totals.items():
        kind = f.split(":")[0]
        if kind in ("class", "polarity") and total > 0:
            score += w[kind] * (100.0 * counts.get(f, 0) / total - 100.0 * ratios[split]) ** 2
    return score + w["violation"] * excess


def refine_split(features: DataFrame, assigned: DataFrame, edges: DataFrame, ratios: dict[str, float] = RATIOS, passes: int = 8, tolerance: tuple[float, float] = (2.0, 5.0)) -> DataFrame:
    """(component, split) after at most ``passes`` passes of local search, each accepted only if the objective falls.

    A pass is one ordered stream: it holds the splits' counters and moves a component wherever that lowers the
    objective. The splits of a component's neighbours over boundary edges are those of the pass before.
    """
    totals = {r["f"]: float(r["n"]) for r in features.select(F.explode("features").alias("f", "n")).groupBy("f").agg(F.sum("n").alias("n")).collect()}  # one row a feature
    links = cut(edges.select("a", "b", "guards").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "guards")))

    def counters(now: DataFrame) -> dict[str, dict[str, float]]:
        out: dict[str, dict[str, float]] = {s: {} for s in ratios}
        for r in split_balance(now.join(features, "component").select("split", "features")).collect():  # splits times features
            out[r["split"]][r["feature"]] = float(r["n"])
        return out

    def objective(now: DataFrame) -> tuple[float, dict]:
        counts = counters(now)
        side = lambda c: now.select(F.col("component").alias(c), F.col("split").alias(f"{c}_s"))
        crossing = links.where("a < b").join(side("a"), "a").join(side("b"), "b").where("a_s <> b_s").agg(F.count("*").alias("t"), F.coalesce(F.sum("guards"), F.lit(0)).alias("g")).first()
        return sum(_parts(counts[s], s, totals, ratios, tolerance) for s in ratios) + REFINEMENT["transition"] * crossing["t"] + REFINEMENT["guard"] * crossing["g"], counts

    best = cut(assigned.select("component", "split"))
    if not totals:
        return best
    score, counts = objective(best)
    for _ in range(passes):
        near = links.join(best.select(F.col("component").alias("b"), "split"), "b").groupBy(F.col("a").alias("component"), "split").agg((REFINEMENT["transition"] * F.count("*") + REFINEMENT["guard"] * F.sum("guards")).alias("cost"))
        near = near.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("split", "cost"))).alias("near"))
        start = counts

        def run(batches, start=start):
            now = {s: dict(c) for s, c in start.items()}
            parts = {s: _parts(c, s, totals, ratios, tolerance) for s, c in now.items()}
            for pdf in batches:
                out = []
                for own, split, neighbours in zip(pdf["features"], pdf["split"], pdf["near"]):
                    own, beside = dict(own), dict(neighbours) if neighbours is not None else {}
                    shifted = lambda s, sign, own=own: now[s] | {f: now[s].get(f, 0) + sign * n for f, n in own.items()}
                    left = shifted(split, -1)
                    left_score, choice = _parts(left, split, totals, ratios, tolerance), None
                    for s in ratios:
                        if s != split:
                            there = shifted(s, 1)
                            there_score = _parts(there, s, totals, ratios, tolerance)
                            change = left_score + there_score - parts[split] - parts[s] + beside.get(split, 0.0) - beside.get(s, 0.0)
                            if change < -1e-9 and (choice is None or change < choice[0]):
                                choice = (change, s, there, there_score)
                    if choice:
                        _, s, there, there_score = choice
                        now[s], parts[s], now[split], parts[split] = there, there_score, left, left_score
                        split = s
                    out.append(split)
                yield pd.DataFrame({"component": pdf["component"], "split": out})

        rows = features.join(best, "component").join(near, "component", "left").select("component", "features", "split", "near")
        tried = cut(rows.repartition(1).sortWithinPartitions("component").mapInPandas(run, "component string, split string"))
        new_score, new_counts = objective(tried)
        if new_score >= score - 1e-9:
            break
        best, score, counts = tried, new_score, new_counts
    return best


def split_balance(assigned: DataFrame) -> DataFrame:
    """(split, feature, n, share of the feature's total) from (split, features map)."""
    long = assigned.select("split", F.explode("features").alias("feature", "n")).groupBy("split", "feature").agg(F.sum("n").alias("n"))
    return long.withColumn("share", F.try_divide(F.col("n").cast("double"), F.sum("n").over(W.partitionBy("feature"))))


def split_conflicts(rows: DataFrame, group: str) -> DataFrame:
    """(group, splits) of groups whose members stand in several splits."""
    s = F.when(norm("split") == "validation", "val").otherwise(norm("split"))
    named = rows.select(norm(group).alias("group"), s.alias("split")).where("`group` IS NOT NULL AND split IS NOT NULL")
    return named.groupBy("group").agg(F.array_sort(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)


def pair_conflicts(pairs: DataFrame, assigned: DataFrame) -> DataFrame:
    """Binding pairs (a, b) whose ends stand in different splits."""
    side = lambda s: assigned.select(F.col("canonical_image_id").alias(s), F.col("split").alias(f"{s}_split"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where("a_split <> b_split").select("a", "b", "a_split", "b_split")


def share_audit(rows: DataFrame, split: str, by: str, tolerance: float = 5.0) -> DataFrame:
    """(split, by, n, percent, overall_percent, deviation, within_tolerance) in percentage points."""
    cells = rows.groupBy(split, by).agg(F.count("*").alias("n"))
    p = F.lit(100.0) * F.col("n") / F.sum("n").over(W.partitionBy(split))
    overall = F.lit(100.0) * F.sum("n").over(W.partitionBy(by)) / F.sum("n").over(W.partitionBy(F.lit(0)))
    out = cells.select(F.col(split).alias("split"), F.col(by).alias("by"), "n", p.alias("percent"), overall.alias("overall_percent"))
    return out.withColumn("deviation", F.col("percent") - F.col("overall_percent")).withColumn("within_tolerance", F.abs("deviation") <= tolerance)
