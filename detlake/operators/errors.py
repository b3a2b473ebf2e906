"""Failure analysis at one operating point: confusion, diagnoses of misses and false alarms, buckets and review queues.

Two vocabularies exist side by side. The first pairs residual boxes one to one before it diagnoses; the second diagnoses
each box on its own by the best candidate of each kind.

All of it is per image, so an image is one row: its ground truth, its predictions, all overlaps between them, and the matches
and residual pairs among these. Ground truth and predictions are shuffled once, by image, and every diagnosis is made
of arrays in that row. Collections are bounded by the boxes of an image.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from detlake.functions import geometry as g
from detlake.operators import ordered
from detlake.operators.metrics import CODES, code, per_class, spine
from detlake.session import cut

#: Bucket bounds (name, from, below).
SIZES = (("small", 0.0, 0.01), ("medium", 0.01, 0.05), ("large", 0.05, 1.0000001))
ASPECTS = (("narrow", 0.0, 0.5), ("balanced", 0.5, 2.0), ("wide", 2.0, 1_000_000.0))
DENSITIES = (("one_target", 1, 2), ("two_to_three_targets", 2, 4), ("four_or_more_targets", 4, 1_000_000))
BACKGROUND = "BACKGROUND"
NO_CANDIDATE = "no_stronger_cached_candidate_above_0.010_inference_floor"


@dataclass(frozen=True)
class Point:
    confidence: float
    overlap: float = 0.5
    floor: float = 0.1
    high: float = 0.5


_PAIR = "array<struct<pi:int,gi:int,pc:int,gc:int,confidence:double,overlap:double,p:struct<x1:double,y1:double,x2:double,y2:double>,g:struct<x1:double,y1:double,x2:double,y2:double>>>"
_CORNERS = ("x1", "y1", "x2", "y2")


@dataclass
class Outcome:
    """One operating point: ``rows`` has one row an image with arrays of gts, preds (all), pairs (all), matches, confusions, localizations."""

    images: DataFrame
    gt: DataFrame
    raw: DataFrame
    kept: DataFrame
    rows: DataFrame
    at: Point

    def _exploded(self, column: str) -> DataFrame:
        return self.rows.select("image_id", F.explode(column).alias("e")).select("image_id", "e.pi", "e.gi", "e.overlap", "e.confidence", "e.pc", "e.gc")

    @property
    def matches(self) -> DataFrame:
        return self._exploded("matches").withColumnRenamed("gc", "class_id").drop("pc")

    @property
    def confusions(self) -> DataFrame:
        return self._exploded("confusions")

    @property
    def localizations(self) -> DataFrame:
        return self._exploded("localizations")


def _corners(box: Column) -> list[Column]:
    return [box[c] for c in _CORNERS]


def _fold(pairs: Column, order) -> Column:
    """Pairs accepted greedily in an order (a function of a pair to columns): those of which neither end is taken."""
    ranked = F.array_sort(F.transform(pairs, lambda e: F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order(e))), e.alias("e"))))
    free = lambda done, e: ~F.exists(done, lambda d: (d["pi"] == e["pi"]) | (d["gi"] == e["gi"]))
    return F.aggregate(F.transform(ranked, lambda r: r["e"]), F.array().cast(_PAIR), lambda done, e: F.when(free(done, e), F.array_append(done, e)).otherwise(done))


def _match_order(e: Column) -> list[Column]:
    return [-e["confidence"], *_corners(e["p"]), e["pi"], -e["overlap"], *_corners(e["g"]), e["gi"]]


def _residual_order(e: Column) -> list[Column]:
    return [-e["overlap"], -e["confidence"], e["pc"], *_corners(e["p"]), e["gc"], *_corners(e["g"]), e["pi"], e["gi"]]


def _in(pairs: str | Column, end: str, value: Column) -> Column:
    return F.exists(pairs, lambda m: m[end] == value)


def outcome(images: DataFrame, gt: DataFrame, pred: DataFrame, at: Point) -> Outcome:
    """gt (image_id, gi, class_id, box) and pred (image_id, pi, class_id, confidence, box), matched and paired at a point."""
    box = F.struct(*_CORNERS).alias("box")
    g_ = gt.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(F.col("gi").cast("int").alias("gi"), "class_id", box))).alias("gts"))
    p_ = pred.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(F.col("pi").cast("int").alias("pi"), "class_id", F.col("confidence").cast("double").alias("confidence"), box))).alias("preds"))
    empty = lambda df, c: F.coalesce(c, F.array().cast(df.schema[c].dataType))
    rows = g_.join(p_, "image_id", "full_outer").select("image_id", empty(g_, "gts").alias("gts"), empty(p_, "preds").alias("preds"))

    def pair(p: Column, t: Column) -> Column:
        return F.struct(p["pi"].alias("pi"), t["gi"].alias("gi"), p["class_id"].alias("pc"), t["class_id"].alias("gc"), p["confidence"].alias("confidence"), g.iou(_corners(p["box"]), _corners(t["box"])).alias("overlap"), p["box"].alias("p"), t["box"].alias("g"))

    rows = rows.withColumn("pairs", F.flatten(F.transform("preds", lambda p: F.transform("gts", lambda t: pair(p, t)))).cast(_PAIR))
    kept = lambda e: e["confidence"] >= F.lit(at.confidence)
    full = lambda e: e["overlap"] >= F.lit(at.overlap)
    loose = lambda e, *taken: ~reduce(or_, (_in(t, end, e[end]) for t in taken for end in ("pi", "gi")))
    rows = rows.withColumn("matches", _fold(F.filter("pairs", lambda e: kept(e) & full(e) & (e["pc"] == e["gc"])), _match_order))
    rows = rows.withColumn("confusions", _fold(F.filter("pairs", lambda e: kept(e) & full(e) & (e["pc"] != e["gc"]) & loose(e, "matches")), _residual_order))
    close = lambda e: (e["overlap"] >= F.lit(at.floor)) & (e["overlap"] < F.lit(at.overlap))
    rows = rows.withColumn("localizations", _fold(F.filter("pairs", lambda e: kept(e) & close(e) & (e["pc"] == e["gc"]) & loose(e, "matches", "confusions")), _residual_order))
    return Outcome(images, gt, pred, pred.where(F.col("confidence") >= F.lit(at.confidence)), rows, at)


def _missed(t: Column) -> Column:
    return ~_in("matches", "gi", t["gi"])


def _false(o: Outcome, p: Column) -> Column:
    return (p["confidence"] >= F.lit(o.at.confidence)) & ~_in("matches", "pi", p["pi"])


def confusion_matrix(o: Outcome) -> DataFrame:
    """(true_class, predicted_class, count), the full square of classes and background."""
    cell = lambda t, p: F.struct(t.alias("t"), p.alias("p"))
    none = F.lit(BACKGROUND)
    cells = F.concat(
        F.transform("matches", lambda e: cell(code(e["gc"]), code(e["pc"]))), F.transform("confusions", lambda e: cell(code(e["gc"]), code(e["pc"]))),
        F.transform(F.filter("gts", lambda t: _missed(t) & ~_in("confusions", "gi", t["gi"])), lambda t: cell(code(t["class_id"]), none)),
        F.transform(F.filter("preds", lambda p: _false(o, p) & ~_in("confusions", "pi", p["pi"])), lambda p: cell(none, code(p["class_id"]))),
    )
    counts = o.rows.select(F.explode(cells).alias("c")).groupBy(F.col("c.t").alias("true_class"), F.col("c.p").alias("predicted_class")).agg(F.count("*").alias("count"))
    labels = F.array(*map(F.lit, (*CODES, BACKGROUND)))
    square = o.gt.sparkSession.range(1).select(F.explode(labels).alias("true_class")).select("true_class", F.explode(labels).alias("predicted_class"))
    return square.join(counts, ["true_class", "predicted_class"], "left").na.fill(0, ["count"])


def _best(pairs: Column | str, condition, prefer, value) -> Column:
    """Value of the pair that is greatest by ``prefer`` among those that meet the condition, null if none does."""
    ranked = F.transform(F.filter(pairs, condition), lambda e: F.struct(*(c.alias(f"k{i}") for i, c in enumerate(prefer(e))), value(e).alias("v")))
    return F.array_max(ranked)["v"]


def _first(pairs: str, end: str, of: Column, value) -> Column:
    """Value of the pair that ``of`` is an end of; it is in one pair at most."""
    return F.get(F.transform(F.filter(pairs, lambda e: e[end] == of), value), F.lit(0))


def _seen(e: Column) -> Column:
    return F.struct(e["pc"].alias("c"), e["confidence"].alias("s"), e["overlap"].alias("o"))


def _shown(e: Column) -> Column:
    return F.struct(e["overlap"].alias("o"), e["gc"].alias("c"))


def misses(o: Outcome, at: Point) -> DataFrame:
    """Diagnosed false negatives, first vocabulary.

    (image_id, gi, class_id, diagnosis, diagnostic_class, diagnostic_confidence, diagnostic_iou): class_confusion and
    poor_localization by the residual pairs, then below_frozen_confidence by a candidate under the threshold, else
    no_matching_candidate with the best overlapping retained prediction.
    """
    kept = lambda e: e["confidence"] >= F.lit(at.confidence)
    last = lambda e: [*(-c for c in _corners(e["p"])), -e["pi"]]

    def diagnosed(t: Column) -> Column:
        mine = F.filter("pairs", lambda e: e["gi"] == t["gi"])
        below = lambda e: ~kept(e) & (e["pc"] == e["gc"]) & (e["overlap"] >= F.lit(at.overlap))
        return F.struct(
            t.alias("t"), _first("confusions", "gi", t["gi"], _seen).alias("confused"), _first("localizations", "gi", t["gi"], _seen).alias("near"),
            _best(mine, below, lambda e: [e["confidence"], e["overlap"], *last(e)], _seen).alias("below"), _best(mine, kept, lambda e: [e["overlap"], e["confidence"], *last(e)], _seen).alias("any"),
        )

    j = o.rows.select("image_id", F.explode(F.transform(F.filter("gts", _missed), diagnosed)).alias("x")).select("image_id", "x.*")
    diagnosis = F.when(F.col("confused").isNotNull(), "class_confusion").when(F.col("near").isNotNull(), "poor_localization").when(F.col("below").isNotNull(), "below_frozen_confidence").otherwise("no_matching_candidate")
    d = F.coalesce("confused", "near", "below", "any")
    return j.select("image_id", "t.gi", "t.class_id", "t.box.*", diagnosis.alias("diagnosis"), d["c"].alias("diagnostic_class"), d["s"].alias("diagnostic_confidence"), F.coalesce(d["o"], F.lit(0.0)).alias("diagnostic_iou"))


def alarms(o: Outcome, at: Point) -> DataFrame:
    """Diagnosed false positives, first vocabulary: (image_id, pi, class_id, confidence, diagnosis, related_class, best_iou, high_confidence)."""

    def diagnosed(p: Column) -> Column:
        best = F.array_max(F.transform(F.filter("pairs", lambda e: e["pi"] == p["pi"]), _shown))
        return F.struct(p.alias("p"), _first("confusions", "pi", p["pi"], _shown).alias("confused"), _first("localizations", "pi", p["pi"], _shown).alias("near"), best.alias("any"))

    j = o.rows.select("image_id", F.explode(F.transform(F.filter("preds", lambda p: _false(o, p)), diagnosed)).alias("x")).select("image_id", "x.*")
    overlap = F.col("any.o")
    diagnosis = (
        F.when(F.col("confused").isNotNull(), "class_confusion").when(F.col("near").isNotNull(), "poor_localization").when(F.col("any").isNull(), "negative_image")
        .when(overlap >= F.lit(at.overlap), "duplicate_or_competing_overlap").when(overlap >= F.lit(at.floor), "nearby_unmatched_pattern").otherwise("background_or_unlabelled_pattern")
    )
    d = F.coalesce("confused", "near", "any")
    return j.select("image_id", "p.pi", "p.class_id", "p.confidence", "p.box.*", diagnosis.alias("diagnosis"), d["c"].alias("related_class"), F.coalesce(d["o"], F.lit(0.0)).alias("best_iou"), (F.col("p.confidence") >= F.lit(at.high)).alias("high_confidence"))


def misses_exclusive(o: Outcome, at: Point) -> DataFrame:
    """Diagnosed false negatives, second vocabulary: one category by priority, and which evidence there was."""
    same, kept, full = (lambda e: e["pc"] == e["gc"]), (lambda e: e["confidence"] >= F.lit(at.confidence)), (lambda e: e["overlap"] >= F.lit(at.overlap))
    prefer = lambda e: [e["overlap"], e["confidence"], -e["pc"], *(-c for c in _corners(e["p"])), -e["pi"]]
    kinds = {
        "below": lambda e: same(e) & ~kept(e) & full(e), "competition": lambda e: same(e) & kept(e) & full(e) & _in("matches", "pi", e["pi"]),
        "localization": lambda e: same(e) & kept(e) & ~full(e) & (e["overlap"] >= F.lit(at.floor)), "wrong": lambda e: ~same(e) & kept(e) & full(e), "any": lambda e: F.lit(True),
    }

    def diagnosed(t: Column) -> Column:
        mine = F.filter("pairs", lambda e: e["gi"] == t["gi"])
        return F.struct(t.alias("t"), *(_best(mine, c, prefer, _seen).alias(k) for k, c in kinds.items()))

    j = o.rows.select("image_id", F.explode(F.transform(F.filter("gts", _missed), diagnosed)).alias("x")).select("image_id", "x.*")
    there = lambda k: F.col(k).isNotNull()
    category = (
        F.when(there("below"), "below_confidence_same_class_iou_ge_0.50").when(there("competition"), "same_class_matching_competition_iou_ge_0.50")
        .when(there("localization") & (F.col("localization.o") >= F.lit(0.3)), "localization_iou_0.30_to_0.50").when(there("localization"), "localization_iou_0.10_to_0.30")
        .when(there("wrong"), "wrong_class_overlap_iou_ge_0.50").otherwise(NO_CANDIDATE)
    )
    d = F.coalesce("below", "competition", "localization", "wrong", "any")
    return j.select("image_id", "t.gi", "t.class_id", category.alias("category"), F.coalesce(d["o"], F.lit(0.0)).alias("diagnostic_iou"), d["s"].alias("diagnostic_confidence"), d["c"].alias("diagnostic_class"), *(there(k).alias(f"has_{k}") for k in ("below", "competition", "localization", "wrong")))


def alarms_exclusive(o: Outcome) -> DataFrame:
    """Diagnosed false positives, second vocabulary: (image_id, pi, class_id, confidence, category, best_iou, related_class)."""
    prefer = lambda e: [e["overlap"], -e["gc"], *(-c for c in _corners(e["g"])), -e["gi"]]

    def diagnosed(p: Column) -> Column:
        mine = F.filter("pairs", lambda e: e["pi"] == p["pi"])
        return F.struct(p.alias("p"), _best(mine, lambda e: e["pc"] == e["gc"], prefer, _shown).alias("same"), _best(mine, lambda e: e["pc"] != e["gc"], prefer, _shown).alias("other"))

    j = o.rows.select("image_id", F.explode(F.transform(F.filter("preds", lambda p: _false(o, p)), diagnosed)).alias("x")).select("image_id", "x.*")
    s, d = F.coalesce("same.o", F.lit(0.0)), F.coalesce("other.o", F.lit(0.0))
    cases = [
        (F.col("same").isNull() & F.col("other").isNull(), "negative_only_image", None), (s >= 0.5, "native_end2end_same_class_overlap_unmatched_iou_ge_0.50", "same"), (d >= 0.5, "wrong_class_overlap_iou_ge_0.50", "other"),
        (s >= F.lit(0.3), "localization_same_class_iou_0.30_to_0.50", "same"), (s >= F.lit(0.1), "localization_same_class_iou_0.10_to_0.30", "same"), (d >= F.lit(0.1), "wrong_class_weak_overlap_iou_0.10_to_0.50", "other"),
    ]
    category = F.lit("positive_image_unmatched_iou_below_0.10")
    related = F.when(s >= d, F.col("same")).otherwise(F.col("other"))
    for condition, name, side in reversed(cases):
        category = F.when(condition, name).otherwise(category)
        related = F.when(condition, F.col(side) if side else F.lit(None)).otherwise(related)
    return j.select("image_id", "p.pi", "p.class_id", "p.confidence", category.alias("category"), F.coalesce(related["o"], F.lit(0.0)).alias("best_iou"), related["c"].alias("related_class"))


def first_to_second(diagnosis: Column, overlap: Column) -> Column:
    """Miss vocabulary one in terms of two."""
    return (
        F.when(diagnosis == "below_frozen_confidence", "below_confidence_same_class_iou_ge_0.50").when(diagnosis == "class_confusion", "wrong_class_overlap_iou_ge_0.50")
        .when((diagnosis == "poor_localization") & (overlap >= F.lit(0.3)), "localization_iou_0.30_to_0.50").when(diagnosis == "poor_localization", "localization_iou_0.10_to_0.30").when(diagnosis == "no_matching_candidate", NO_CANDIDATE)
    )


def broad_alarm(category: Column) -> Column:
    """Either false-alarm vocabulary in five broad kinds."""
    return (
        F.when(category.isin("negative_image", "negative_only_image"), "negative_only_image").when(category.contains("class_confusion") | category.contains("wrong_class"), "wrong_class_overlap")
        .when(category.contains("localization") | (category == "nearby_unmatched_pattern"), "weak_localization_or_nearby")
        .when(category.contains("duplicate_or_competing") | category.contains("same_class_overlap_unmatched"), "same_class_overlap_unmatched")
        .when(category.isin("background_or_unlabelled_pattern", "positive_image_unmatched_iou_below_0.10"), "positive_image_unmatched_low_overlap")
    )


def category_counts(rows: DataFrame, category: str, by: list[str] | None = None) -> DataFrame:
    """(by, category, count, percent of the group)."""
    by = by or []
    counts = rows.groupBy(*by, category).agg(F.count("*").alias("count"))
    whole = F.sum("count").over(W.partitionBy(*by) if by else W.partitionBy(F.lit(0)))
    return counts.select(*by, F.col(category).alias("category"), "count", (F.lit(100.0) * F.col("count") / whole).alias("percent"))


def described(o: Outcome) -> DataFrame:
    """Ground truth with outcome and descriptive buckets: size, aspect ratio and density of its image."""
    each = o.rows.select("image_id", F.size("gts").alias("density"), F.explode(F.transform("gts", lambda t: F.struct(t.alias("t"), _in("matches", "gi", t["gi"]).alias("hit")))).alias("x"))
    j = each.select("image_id", "density", "x.t.gi", "x.t.class_id", "x.hit", "x.t.box.*").join(o.images.select("image_id", "site", "width", "height"), "image_id")
    b = g.box()
    return j.select(
        "image_id", "gi", "class_id", "site", "hit", g.bucket(g.relative_area(b, F.col("width"), F.col("height")), SIZES).alias("size"), g.bucket(g.aspect_ratio(b), ASPECTS).alias("aspect"),
        g.bucket(F.col("density").cast("double"), DENSITIES).alias("density"),
    )


def recall_by(rows: DataFrame, dimension: str, definitions) -> DataFrame:
    """(class_code or ALL, bucket, support, tp, fn, recall, weak_support) over the full grid of classes and buckets."""
    spark = rows.sparkSession
    counts = rows.groupBy("class_id", dimension).agg(F.count("*").alias("support"), F.count_if("hit").alias("tp"))
    names = F.array(*(F.lit(d[0]) for d in definitions))
    grid = spine(spark).select("class_id", F.explode(names).alias(dimension))
    each = grid.join(counts, ["class_id", dimension], "left").na.fill(0, ["support", "tp"])
    both = each.select(code(F.col("class_id")).alias("class_code"), F.col(dimension).alias("bucket"), "support", "tp").unionByName(each.groupBy(F.lit("ALL").alias("class_code"), F.col(dimension).alias("bucket")).agg(F.sum("support").alias("support"), F.sum("tp").alias("tp")))
    fn = F.col("support") - F.col("tp")
    return both.select("*", fn.alias("fn"), g.ratio(F.col("tp"), F.col("support")).alias("recall"), (F.col("support") < 30).alias("weak_support"))


def nearest_rank_quantiles(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, count, minimum, p10, p25, median, p75, p90, maximum, mean) with rank floor(f * (n - 1)), exact.

    Values are counted before they are ordered, so a group costs one row a distinct value, and no task orders a whole group.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    ranked = ordered.cumulated(counted, by, "_v", ["_c"])
    pick = lambda p: F.min(F.when(F.col("_c_upto") > F.floor(F.lit(p) * (F.col("_c_of") - 1) / 100), F.col("_v")))
    return ranked.groupBy(*by).agg(
        F.max("_c_of").alias("count"), F.min("_v").alias("minimum"), pick(10).alias("p10"), pick(25).alias("p25"), pick(50).alias("median"), pick(75).alias("p75"), pick(90).alias("p90"),
        F.max("_v").alias("maximum"), (F.sum(F.col("_v") * F.col("_c")) / F.max("_c_of")).alias("mean"),
    )


def ranked_queues(o: Outcome, at: Point, limit: int = 25) -> DataFrame:
    """The best ``limit`` rows of each review queue: (queue, rank, image_id, class_code, diagnosis, confidence, iou, fp, fn).

    A window per queue keeps only the first rows per partition before it orders them (top-k pushdown).
    """
    o = replace(o, rows=cut(o.rows))  # read by every queue
    fn, fp = cut(misses(o, at)), cut(alarms(o, at))
    site = o.images.select("image_id", "site")
    none_s, none_d, none_i = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("long")

    def shape(df, queue, order, class_code=none_s, diagnosis=none_s, confidence=none_d, iou=none_d, fps=none_i, fns=none_i):
        cols = [queue.alias("queue"), "image_id", class_code.alias("class_code"), diagnosis.alias("diagnosis"), confidence.alias("confidence"), iou.alias("iou"), fps.cast("long").alias("fp"), fns.cast("long").alias("fn")]
        ranked = df.withColumn("_q", queue).withColumn("rank", F.row_number().over(W.partitionBy("_q").orderBy(*order))).where(F.col("rank") <= limit)
        return ranked.select(*cols, "rank")

    seq = F.when(F.col("diagnosis") == "class_confusion", 0).when(F.col("diagnosis") == "poor_localization", 1).when(F.col("diagnosis") == "below_frozen_confidence", 2).otherwise(3)
    conf = F.coalesce("diagnostic_confidence", F.lit(0.0))
    cc = code(F.col("class_id"))
    fn_args = dict(class_code=cc, diagnosis=F.col("diagnosis"), confidence=F.col("diagnostic_confidence"), iou=F.col("diagnostic_iou"))
    fp_args = dict(class_code=cc, diagnosis=F.col("diagnosis"), confidence=F.col("confidence"), iou=F.col("best_iou"))
    negative = fp.where("diagnosis = 'negative_image'").groupBy("image_id").agg(F.count("*").alias("n"), F.max("confidence").alias("top"))
    near = o.localizations.withColumn("class_id", F.col("gc"))
    per_image = (
        fp.select("image_id", "diagnosis", "confidence", F.lit(1).alias("p"), F.lit(0).alias("n")).unionByName(fn.select("image_id", "diagnosis", F.lit(0.0).alias("confidence"), F.lit(0).alias("p"), F.lit(1).alias("n")))
        .groupBy("image_id").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.max("confidence").alias("top"), F.array_join(F.sort_array(F.collect_set("diagnosis")), ";").alias("diagnoses")).join(site, "image_id")
    )
    parts = [
        shape(fn, F.concat(cc, F.lit("_FALSE_NEGATIVE")), [seq, conf.desc(), F.col("diagnostic_iou").desc(), "image_id", "gi"], **fn_args),
        shape(fp.where("high_confidence"), F.lit("HIGH_CONFIDENCE_FALSE_POSITIVE"), [F.col("confidence").desc(), "image_id", "pi"], **fp_args),
        shape(fn.where(seq < 2).where(conf >= F.lit(at.high)), F.lit("HIGH_CONFIDENCE_FN_DIAGNOSTIC"), [conf.desc(), F.col("diagnostic_iou").desc(), "image_id", "gi"], **fn_args),
        shape(negative, F.lit("NEGATIVE_ROAD_FALSE_POSITIVE"), [F.col("top").desc(), F.col("n").desc(), "image_id"], confidence=F.col("top"), fps=F.col("n")),
        shape(fp.where("diagnosis = 'class_confusion'"), F.lit("POSSIBLE_CLASS_CONFUSION"), [F.col("confidence").desc(), F.col("best_iou").desc(), "image_id", "pi"], **fp_args),
        shape(near, F.lit("POOR_LOCALIZATION"), [F.col("confidence").desc(), F.col("overlap"), "image_id", "pi"], class_code=cc, confidence=F.col("confidence"), iou=F.col("overlap")),
        shape(per_image, F.concat(F.upper("site"), F.lit("_ERROR")), [(F.col("p") + F.col("n")).desc(), F.col("top").desc(), "image_id"], diagnosis=F.col("diagnoses"), fps=F.col("p"), fns=F.col("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def model_delta(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Values of two models side by side and their difference b - a; keys that one of them lacks come out with nulls."""
    left = a.select(*keys, *(F.col(v).alias(f"a_{v}") for v in values))
    right = b.select(*keys, *(F.col(v).alias(f"b_{v}") for v in values))
    return left.join(right, keys, "full_outer").select(*keys, *(F.col(f"{s}_{v}") for v in values for s in "ab"), *((F.col(f"b_{v}") - F.col(f"a_{v}")).alias(f"delta_{v}") for v in values))


def class_error_rows(o: Outcome, at: Point) -> DataFrame:
    """Per class: support, positive images, predictions, rates, confusions, localization errors, high-confidence alarms."""
    o = replace(o, rows=cut(o.rows))  # read by every count
    rows = per_class(o.gt, o.kept, o.matches)
    extra = {
        "positive_images": o.gt.groupBy("class_id").agg(F.count_distinct("image_id").alias("positive_images")),
        "confusions": o.confusions.groupBy(F.col("pc").alias("class_id")).agg(F.count("*").alias("confusions")),
        "localization_errors": o.localizations.groupBy(F.col("gc").alias("class_id")).agg(F.count("*").alias("localization_errors")),
        "high_confidence_fp": o.rows.select(F.explode(F.filter("preds", lambda p: _false(o, p) & (p["confidence"] >= F.lit(at.high)))).alias("p")).groupBy(F.col("p.class_id").alias("class_id")).agg(F.count("*").alias("high_confidence_fp")),
    }
    for df in extra.values():
        rows = rows.join(F.broadcast(df), "class_id", "left")  # one row a class
    return rows.na.fill(0, list(extra))
