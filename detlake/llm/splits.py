"""Splits that keep related records together (problem 2), by min-cost flow over bundles of like components.

Components are the capture groups, united where an image's rows name several (an image without a group is one of its own).
They are bundled by identical size and identical label profile: the set of image categories that a component shows, and its
share of images with a target in quarters. Sizes are exact, so all components of a bundle are interchangeable; as sizes
add up to the number of images, N images have at most sqrt(2 N) of them. A min-cost flow sends the bundles' images to the
splits: within a label profile's quota of a split for nothing, beyond it at a cost, beyond the split's own quota at a higher
one. All components go through the flow, whatever their size. Flows are rounded to whole components, large components first
and each remainder to the split that is furthest behind, and a bundle's members are dealt to its counts in the order of
their hash.

A component that stands in several splits now costs moves in whatever split it lands; these are the conflicts.

Only bundle counts reach the driver. Members are ranked by hash within (bundle, hash bucket), with bucket offsets from
pre-aggregated counts, so a bundle that holds most components isn't ordered in one task.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from detlake.llm.contraction import consolidate
from detlake.session import cut, norm

BUCKETS = 1024
#: Costs of an image beyond its profile's quota of a split, and beyond the split's quota.
PROFILE_COST, SPLIT_COST = 1, 10
#: Label profiles that are told apart; the rarest beyond share one.
MOST_PROFILES = 1000


def split_name(column):
    return F.when(norm(column) == "validation", "val").otherwise(norm(column))


def grouped_entries(images: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per exported image: id, its component, whether it shows a target, its category, and the splits it stands in now.

    Component: the smallest normalised capture group of those connected with the image's own by images whose rows name
    several groups, else the image itself (prefix ``g:`` or ``i:``). Entries without an id are left out; a null is_positive counts as false.
    """
    named = images.where("canonical_image_id IS NOT NULL").groupBy(F.col("canonical_image_id").alias("id")).agg(F.collect_set(norm("capture_group")).alias("gs"))
    named = cut(named.where(F.size("gs") > 0).select("id", F.array_min("gs").alias("first"), "gs"))
    links = named.where(F.size("gs") > 1).select("first", F.explode("gs").alias("other"))
    united = consolidate(links, "first", "other", "first", "united")
    groups = named.select("id", "first").join(united, "first", "left").select("id", F.coalesce("united", "first").alias("g"))
    category = F.col("image_category") if "image_category" in entries.columns else F.lit(None).cast("string")
    exported = (
        entries.where("canonical_image_id IS NOT NULL")
        .groupBy(F.col("canonical_image_id").alias("id"))
        .agg(F.max(F.coalesce("is_positive", F.lit(False))).alias("positive"), F.min(norm(category)).alias("category"), F.collect_set(split_name("split")).alias("splits"))
    )
    return exported.join(groups, "id", "left").select("id", F.coalesce(F.concat(F.lit("g:"), "g"), F.concat(F.lit("i:"), "id")).alias("component"), "positive", "category", "splits")


def components(grouped: DataFrame) -> DataFrame:
    """(component, size, profile), one row per component, pre-aggregated map-side.

    profile: the categories that its images have, and the share of those with a target in quarters.
    """
    parts = grouped.groupBy("component").agg(F.count("*").alias("size"), F.sum(F.col("positive").cast("long")).alias("positives"), F.collect_set("category").alias("categories"))
    profile = F.concat_ws("|", F.ceil(F.lit(4) * F.col("positives") / F.col("size")).cast("string"), F.array_sort("categories"))
    return parts.select("component", "size", profile.alias("profile"))


def conflicts(planned: DataFrame, images: DataFrame) -> DataFrame:
    """(capture_group): groups whose exported images stand in more than one split now.

    ``planned`` is the result of ``plan``: whatever split a group's component is given, such a group has images to move.
    An image whose rows name several groups counts in each of them, one whose entries name several splits in each.
    """
    named = images.where("canonical_image_id IS NOT NULL AND capture_group IS NOT NULL").select(F.col("canonical_image_id").alias("id"), norm("capture_group").alias("capture_group")).distinct()
    stands = planned.withColumnRenamed("canonical_image_id", "id").join(named, "id").select("capture_group", F.col("split").alias("new"), F.explode("splits").alias("now"))
    cells = stands.groupBy("capture_group", "new", "now").agg(F.count("*").alias("n"))
    # moves into any one split: all places but those there already; the least over splits is 0 where one split holds all
    least = cells.groupBy("capture_group").agg((F.sum("n") - F.max("n")).alias("moves"))
    return least.where("moves > 0").select("capture_group")


class Flow:
    """Min-cost flow by successive shortest paths with potentials."""

    def __init__(self, n: int):
        self.n, self.edges, self.out = n, [], [[] for _ in range(n)]

    def add(self, a: int, b: int, capacity: int, cost: int) -> int:
        self.out[a].append(len(self.edges))
        self.edges.append([b, capacity, cost])
        self.out[b].append(len(self.edges))
        self.edges.append([a, 0, -cost])
        return len(self.edges) - 2

    def run(self, source: int, sink: int) -> None:
        potential = [0] * self.n
        while True:
            far, via = [math.inf] * self.n, [-1] * self.n
            far[source], heap = 0, [(0, source)]
            while heap:
                d, x = heapq.heappop(heap)
                if d > far[x]:
                    continue
                for e in self.out[x]:
                    y, capacity, cost = self.edges[e]
                    if capacity > 0 and (new := d + cost + potential[x] - potential[y]) < far[y]:
                        far[y], via[y] = new, e
                        heapq.heappush(heap, (new, y))
            if via[sink] < 0:
                return
            for x in range(self.n):
                if far[x] < math.inf:
                    potential[x] += far[x]
            amount, x = math.inf, sink
            while x != source:
                amount, x = min(amount, self.edges[via[x]][1]), self.edges[via[x] ^ 1][0]
            x = sink
            while x != source:
                self.edges[via[x]][1] -= amount
                self.edges[via[x] ^ 1][1] += amount
                x = self.edges[via[x] ^ 1][0]


def quotas(total: int, targets: list[tuple[str, float]]) -> dict[str, int]:
    """Whole shares of a total, by largest remainder; targets are scaled to add up to 1."""
    whole = sum(t for _, t in targets)
    exact = {s: total * t / whole for s, t in targets}
    out = {s: int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s))[: total - sum(out.values())]:
        out[s] += 1
    return out


def allocate(bundles: list[dict], targets: list[tuple[str, float]]) -> dict[tuple, dict[str, int]]:
    """Components of each bundle (size, profile) for each split; bundles: dicts of size, profile and n (components)."""
    splits = [s for s, _ in targets]
    images = lambda b: b["size"] * b["n"]
    total = sum(map(images, bundles))
    left = quotas(total, targets)
    sums: dict = {}
    for b in bundles:
        sums[b["profile"]] = sums.get(b["profile"], 0) + images(b)
    profiles = sorted(sums)
    need = {p: quotas(n, targets) for p, n in sums.items()}
    # a profile's bundles have the same costs to every split, so they enter the flow as one node and share what it sends
    first = 1 + len(profiles)
    flow = Flow(first + len(profiles) * len(splits) + len(splits) + 1)
    sink, ways = flow.n - 1, {}
    for s_at, s in enumerate(splits):
        gate = first + len(profiles) * len(splits) + s_at
        flow.add(gate, sink, left[s], 0)
        flow.add(gate, sink, total, SPLIT_COST)
        for p_at, p in enumerate(profiles):
            middle = first + p_at * len(splits) + s_at
            flow.add(middle, gate, need[p][s], 0)
            flow.add(middle, gate, total, PROFILE_COST)
            ways[p, s] = flow.add(1 + p_at, middle, sums[p], 0)
    for p_at, p in enumerate(profiles):
        flow.add(0, 1 + p_at, sums[p], 0)
    flow.run(0, sink)
    sent = {way: flow.edges[e ^ 1][1] for way, e in ways.items()}

    out: dict[tuple, dict[str, int]] = {}
    behind = dict.fromkeys(splits, 0.0)  # images that whole components have kept from each split so far
    mine = {way: 0.0 for way in ways}  # the same of each profile
    for b in sorted(bundles, key=lambda b: (-b["size"], b["profile"])):  # largest components first, so small ones even out what rounding leaves
        size, p, n = b["size"], b["profile"], b["n"]
        share = {s: n * sent[p, s] / sums[p] for s in splits}
        want = {s: max(0.0, share[s] + behind[s] / size) for s in splits}
        scale = n / sum(want.values())
        counts = {s: int(w * scale) for s, w in want.items()}
        for _ in range(n - sum(counts.values())):  # fewer than there are splits
            counts[max(splits, key=lambda s: (want[s] * scale - counts[s] + mine[p, s] / size / 8, s))] += 1
        for s in splits:
            behind[s] += (share[s] - counts[s]) * size
            mine[p, s] += (share[s] - counts[s]) * size
        out[(size, p)] = counts
    return out


def plan(images: DataFrame, entries: DataFrame, split_targets: DataFrame, seed: int = 17) -> DataFrame:
    """(canonical_image_id, component, split, splits): the new split of every exported image, and where it stands now.

    Repeated entries come out once. Proportions hold as closely as whole components allow. Empty tables give an empty
    result; targets that are null or not positive are ignored, and at least one must remain.
    """
    spark = entries.sparkSession
    targets = sorted((str(r["split"]).strip().lower(), float(r["target_share"])) for r in split_targets.collect() if r["split"] and (r["target_share"] or 0) > 0)
    if not targets:
        raise ValueError("split_targets names no split")
    grouped = cut(grouped_entries(images, entries))
    parts = components(grouped)
    common = parts.groupBy("profile").agg(F.sum("size").alias("_n")).orderBy(F.desc("_n"), "profile").limit(MOST_PROFILES).select("profile", F.col("profile").alias("_known"))
    parts = parts.join(F.broadcast(common), "profile", "left").withColumn("profile", F.coalesce("_known", F.lit("others"))).drop("_known")
    parts = cut(parts.withColumn("h", F.pmod(F.xxhash64(F.lit(seed), "component"), F.lit(1 << 40))))
    bundles = [r.asDict() for r in parts.groupBy("size", "profile").agg(F.count("*").alias("n")).collect()]
    counts = allocate(bundles, targets) if bundles else {}
    rows = [(int(size), profile, s, sum(c[t] for t, _ in targets[:k]), sum(c[t] for t, _ in targets[: k + 1])) for (size, profile), c in counts.items() for k, (s, _) in enumerate(targets) if c[s]]
    dealt = spark.createDataFrame(rows, "size long, profile string, split string, low long, high long")

    bucket = F.floor(F.col("h") / F.lit((1 << 40) // BUCKETS)).alias("bucket")
    placed = parts.withColumn("bucket", bucket)
    sizes = placed.groupBy("size", "profile", "bucket").agg(F.count("*").alias("m"))
    before = sizes.withColumn("offset", F.sum("m").over(W.partitionBy("size", "profile").orderBy("bucket")) - F.col("m")).drop("m")
    ranked = placed.withColumn("r", F.row_number().over(W.partitionBy("size", "profile", "bucket").orderBy("h", "component")))
    numbered = ranked.join(before, ["size", "profile", "bucket"]).withColumn("r", F.col("r") + F.col("offset") - 1)
    chosen = numbered.join(dealt, ["size", "profile"]).where("r >= low AND r < high").select("component", "split")
    return grouped.join(chosen, "component").select(F.col("id").alias("canonical_image_id"), "component", "split", "splits")


def assign(images: DataFrame, entries: DataFrame, split_targets: DataFrame, seed: int = 17) -> DataFrame:
    """(canonical_image_id, component, split): one new split per exported image, the same for all of a component."""
    return plan(images, entries, split_targets, seed).drop("splits")


def balance(assigned: DataFrame, split_targets: DataFrame) -> DataFrame:
    """(split, images, share, target_share) of an assignment."""
    counted = assigned.groupBy("split").agg(F.count("*").alias("images"))
    whole = assigned.agg(F.count("*").alias("n"))
    t = split_targets.select(norm("split").alias("split"), "target_share")
    return t.join(counted, "split", "left").crossJoin(whole).select("split", F.coalesce("images", F.lit(0)).alias("images"), F.coalesce(F.try_divide(F.col("images").cast("double"), F.col("n")), F.lit(0.0)).alias("share"), "target_share")


def integrity(assigned: DataFrame, images: DataFrame, split_targets: DataFrame) -> DataFrame:
    """One row: images, components, torn (0), and whether all splits' sizes are within one component of their share.

    Torn are capture groups, as the images' rows name them, and images without one that stand in several splits. The
    component is the largest one.
    """
    whole = assigned.agg(F.count("*").alias("images"), F.count_distinct("component").alias("components"))
    named = images.where("canonical_image_id IS NOT NULL AND capture_group IS NOT NULL").select("canonical_image_id", norm("capture_group").alias("g")).distinct()
    parts = assigned.join(named, "canonical_image_id", "left").groupBy(F.coalesce(F.concat(F.lit("g:"), "g"), F.concat(F.lit("i:"), "canonical_image_id")).alias("g")).agg(F.count_distinct("split").alias("s"))
    largest = assigned.groupBy("component").agg(F.count("*").alias("n")).agg(F.max("n").alias("largest"))
    off = balance(assigned, split_targets).crossJoin(whole.select(F.col("images").alias("_all"))).agg(F.max(F.abs(F.col("images") - F.col("target_share") * F.col("_all"))).alias("off"))
    checked = whole.crossJoin(parts.agg(F.count_if(F.col("s") > 1).alias("torn"))).crossJoin(off).crossJoin(largest)  # one row each
    return checked.select("images", "components", "torn", F.coalesce(F.col("off") <= F.greatest("largest", F.lit(1)), F.lit(False)).alias("within_one_component"))
