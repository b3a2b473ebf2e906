"""Counts and rates of a detector, threshold sweeps and the choice of an operating point."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from detlake.functions.geometry import ratio
from detlake.functions.keys import require
from detlake.operators import ordered
from detlake.operators.matching import match

CLASSES = (0, 1, 2, 3)
#: Codes and names of the classes.
CODES = ("D00", "D10", "D20", "D40")
NAMES = ("D00_longitudinal_crack", "D10_transverse_crack", "D20_alligator_crack", "D40_pothole")


#: Settings that one sweep compares at most.
MOST_SETTINGS = 100


def code(class_id: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CODES)), class_id + 1)


def rates(tp: Column, fp: Column, fn: Column) -> list[Column]:
    return [ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")]


def spine(spark) -> DataFrame:
    return spark.range(len(CLASSES)).select(F.col("id").cast("int").alias("class_id"))


def per_class(gt: DataFrame, pred: DataFrame, matches: DataFrame) -> DataFrame:
    """(class_id, class_code, support, predictions, tp, fp, fn, precision, recall, f1); every class has a row."""
    count = lambda df, name: df.groupBy("class_id").agg(F.count("*").alias(name))
    out = spine(gt.sparkSession)
    for df, name in ((gt, "support"), (pred, "predictions"), (matches, "tp")):
        out = out.join(F.broadcast(count(df, name)), "class_id", "left")  # one row a class
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = out.select("class_id", code(F.col("class_id")).alias("class_code"), z("support").alias("support"), z("predictions").alias("predictions"), z("tp").alias("tp"))
    out = out.withColumn("fp", F.col("predictions") - F.col("tp")).withColumn("fn", F.col("support") - F.col("tp"))
    return out.select("*", *rates(F.col("tp"), F.col("fp"), F.col("fn")))


def point(gt: DataFrame, pred: DataFrame, confidence: float, min_overlap: float = 0.5) -> DataFrame:
    """Per-class metrics at one confidence threshold."""
    kept = pred.where(F.col("confidence") >= F.lit(float(confidence)))
    return per_class(gt, kept, match(gt, kept, min_overlap))


def micro_macro(rows: DataFrame) -> DataFrame:
    """One row of macro and micro precision, recall and F1 over per-class rows."""
    s = rows.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), *(F.sum(c).alias(f"s_{c}") for c in ("precision", "recall", "f1")))
    micro = [c.alias(f"micro_{n}") for c, n in zip(rates(F.col("tp"), F.col("fp"), F.col("fn")), ("precision", "recall", "f1"))]
    return s.select("tp", "fp", "fn", *((F.col(f"s_{c}") / len(CLASSES)).alias(f"macro_{c}") for c in ("precision", "recall", "f1")), *micro)


def negative_stats(images: DataFrame, gt: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: images without ground truth, the predictions on them, and how many images have any."""
    negatives = images.select("image_id").join(gt.select("image_id").distinct(), "image_id", "left_anti")
    hit = pred.join(negatives, "image_id", "left_semi").groupBy("image_id").agg(F.count("*").alias("n"))
    a = negatives.agg(F.count("*").alias("negative_images"))
    b = hit.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("negative_fp"), F.count("*").alias("negative_images_with_fp"))
    return a.crossJoin(b).select("*", ratio(F.col("negative_fp"), F.col("negative_images")).alias("negative_fp_per_image"), ratio(F.col("negative_images_with_fp"), F.col("negative_images")).alias("negative_images_with_fp_fraction"))


def sweep(images: DataFrame, gt: DataFrame, pred: DataFrame, grid: list[float], min_overlap: float = 0.5, group: str | None = None) -> DataFrame:
    """(threshold, class_id, tp, fp, fn, ...) for every threshold of an ascending grid, and the negative images' figures.

    Predictions are matched once: dropping those below a threshold can't change what earlier ones took. Each prediction
    is put on the greatest grid value that it reaches, and counts are summed downwards over the small grid.
    ``group`` names a column of ``pred`` (the suppression setting) for which all is done separately.
    """
    spark = gt.sparkSession
    by = [group] if group else []
    floor = pred.where(F.col("confidence") >= F.lit(float(grid[0])))
    if group:  # the group is part of the image's identity while matching
        found = [r[0] for r in pred.select(group).distinct().limit(MOST_SETTINGS + 1).collect()]
        require(len(found) <= MOST_SETTINGS, f"a sweep takes at most {MOST_SETTINGS} settings")
        kind = pred.schema[group].dataType
        settings = spark.createDataFrame([(v,) for v in found], T.StructType([T.StructField(group, kind)]))
        wide = gt.withColumn(group, F.explode(F.array(*(F.lit(v).cast(kind) for v in found)).cast(T.ArrayType(kind))))
        ident = F.struct("image_id", group)
        m = match(wide.withColumn("image_id", ident), floor.withColumn("image_id", ident), min_overlap)
        m = m.select(F.col(f"image_id.{group}").alias(group), F.col("image_id.image_id").alias("image_id"), "pi")
    else:
        m = match(gt, floor, min_overlap).select("image_id", "pi")
    negatives = images.select("image_id").join(gt.select("image_id").distinct(), "image_id", "left_anti")
    steps = F.array(*(F.lit(float(t)) for t in grid))
    at = F.size(F.filter(steps, lambda t: t <= F.col("confidence")))
    marked = floor.join(m.withColumn("hit", F.lit(True)), [*by, "image_id", "pi"], "left").select(*by, "class_id", at.alias("step"), F.coalesce("hit", F.lit(False)).alias("hit"))
    cells = marked.groupBy(*by, "class_id", "step").agg(F.count_if("hit").alias("tp"), F.count_if(~F.col("hit")).alias("fp"))
    # negative images match nothing; one counts from the highest step that any of its predictions reaches
    lone = floor.join(negatives, "image_id", "left_semi").select(*by, "image_id", at.alias("step")).groupBy(*by, "image_id", "step").agg(F.count("*").alias("b"))
    top = F.max("step").over(W.partitionBy(*by, "image_id"))
    neg = lone.withColumn("i", (F.col("step") == top).cast("long")).groupBy(*by, "step").agg(F.sum("b").alias("b"), F.sum("i").alias("i"))

    frame = spark.createDataFrame([(k + 1, float(t)) for k, t in enumerate(grid)], "step int, threshold double")
    keys = frame.crossJoin(spine(spark))
    if group:
        keys = keys.crossJoin(F.broadcast(settings))
    down = lambda *part: W.partitionBy(*by, *part).orderBy(F.col("step").desc())
    support = gt.groupBy("class_id").agg(F.count("*").alias("support"))
    n_negative = negatives.agg(F.count("*").alias("negative_images"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    table = keys.join(cells, [*by, "class_id", "step"], "left").join(F.broadcast(support), "class_id", "left")
    table = table.withColumn("tp", F.sum(z("tp")).over(down("class_id"))).withColumn("fp", F.sum(z("fp")).over(down("class_id"))).withColumn("fn", z("support") - F.col("tp"))
    base = frame if not group else frame.crossJoin(F.broadcast(settings))
    neg = base.join(neg, [*by, "step"], "left").select(*by, "step", F.sum(z("b")).over(down()).alias("negative_fp"), F.sum(z("i")).over(down()).alias("negative_images_with_fp")).crossJoin(n_negative)
    return table.join(neg, [*by, "step"]).select(*by, "threshold", "class_id", "tp", "fp", "fn", *rates(F.col("tp"), F.col("fp"), F.col("fn")), "negative_images", "negative_fp", "negative_images_with_fp")


def sweep_points(rows: DataFrame, group: str | None = None) -> DataFrame:
    """One row a threshold: macro_f1 (mean over classes), macro_f1_exact as a reduced fraction, counts and negatives."""
    by = [group] if group else []
    wide = rows.groupBy(*by, "threshold").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("class_id", "tp", "fp", "fn"))), lambda x: F.struct(x["tp"].alias("tp"), x["fp"].alias("fp"), x["fn"].alias("fn"))).alias("counts"),
        *(F.sum(c).alias(f"total_{c}") for c in ("tp", "fp", "fn")),
        *(F.first(c).alias(c) for c in ("negative_images", "negative_fp", "negative_images_with_fp")),
    )
    exact = F.udf(exact_macro_f1, "string", useArrow=False)  # one call a grid point, never a row of data
    parts = F.transform("counts", lambda c: ratio(2 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"]))
    macro = (F.element_at(parts, 1) + F.element_at(parts, 2) + F.element_at(parts, 3) + F.element_at(parts, 4)) / 4
    return wide.select(*by, "threshold", macro.alias("macro_f1"), exact("counts").alias("macro_f1_exact"), "total_tp", "total_fp", "total_fn", "negative_images", "negative_fp", "negative_images_with_fp")


def exact_macro_f1(counts) -> str:
    """Mean F1 of (tp, fp, fn) rows as a reduced fraction; a class without anything counts as 0."""
    f = [Fraction(2 * tp, 2 * tp + fp + fn) if 2 * tp + fp + fn else Fraction(0) for tp, fp, fn in counts]
    return str(sum(f, Fraction(0)) / len(f))


def _sortable(fraction: str) -> str:
    """A fraction of 0..1 by its first 80 decimals: different ones of denominators below 10^40 differ in them."""
    f = Fraction(fraction)
    return f"{f.numerator * 10**80 // f.denominator:081d}"


def select_point(points: DataFrame, order: list[float] | None = None, group: str | None = None) -> DataFrame:
    """The first point by exact macro F1, fewest negative FP, highest threshold and, if given, the declared group order.

    Columns of the point, and how many points agree with it in the first one, two and three criteria. Without a group order
    it is an error if all three leave several. Windows are over grid points, of which a sweep has at most a few thousand.
    """
    criteria = [F.desc("_f1"), F.asc("negative_fp"), F.desc("threshold")]
    names = ("points_after_f1", "points_after_negative_fp", "points_after_confidence")
    keyed = points.withColumn("_f1", F.udf(_sortable, "string", useArrow=False)("macro_f1_exact"))
    ranks = keyed.select("*", *(F.rank().over(W.orderBy(*criteria[: n + 1])).alias(name) for n, name in enumerate(names)))
    counted = ranks.select(*keyed.columns, *(F.count_if(F.col(name) == 1).over(W.partitionBy()).cast("int").alias(name) for name in names))
    last = [F.array_position(F.array(*map(F.lit, order)), F.col(group))] if order else []
    best = counted.orderBy(*criteria, *last).drop("_f1").first()
    if best is None:
        raise ValueError("no points to select from")
    if best[names[-1]] > 1 and not order:
        raise ValueError("the best point is not unique")
    schema = T.StructType([*points.schema, *(T.StructField(name, T.IntegerType()) for name in names)])
    return points.sparkSession.createDataFrame([tuple(best)], schema)


def by_site(images: DataFrame, gt: DataFrame, pred: DataFrame, matches: DataFrame) -> DataFrame:
    """(site, class_code or ALL, images, positive_images, support, predictions, tp, fp, fn, rates)."""
    site = images.select("image_id", "site")

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.join(site, "image_id").groupBy("site", "class_id").agg(F.count("*").alias(name))

    total = site.groupBy("site").agg(F.count("*").alias("images"))
    has = gt.select("image_id", "class_id").distinct().join(site, "image_id").groupBy("site", "class_id").agg(F.count("*").alias("positive_images"))
    any_ = gt.select("image_id").distinct().join(site, "image_id").groupBy("site").agg(F.count("*").alias("positive_all"))
    out = total.crossJoin(spine(images.sparkSession))
    for df in (counted(gt, "support"), counted(pred, "predictions"), counted(matches, "tp"), has):
        out = out.join(df, ["site", "class_id"], "left")
    out = out.na.fill(0, ["support", "predictions", "tp", "positive_images"])
    names = ["support", "predictions", "tp"]
    each = out.select("site", code(F.col("class_id")).alias("class_code"), "images", "positive_images", *names)
    whole = out.groupBy("site").agg(F.max("images").alias("images"), *(F.sum(n).alias(n) for n in names)).join(any_, "site", "left")
    whole = whole.select("site", F.lit("ALL").alias("class_code"), "images", F.coalesce("positive_all", F.lit(0)).alias("positive_images"), *names)
    both = each.unionByName(whole).withColumn("fp", F.col("predictions") - F.col("tp")).withColumn("fn", F.col("support") - F.col("tp"))
    return both.select("*", *rates(F.col("tp"), F.col("fp"), F.col("fn")))


def profile(images: DataFrame, gt: DataFrame, pred: DataFrame, thresholds: list[float]) -> DataFrame:
    """(scope, threshold, images, predictions, images_with_prediction, d00..d40) for all, negative and positive images."""
    positive = gt.select("image_id").distinct().withColumn("positive", F.lit(True))
    tagged = images.select("image_id").join(positive, "image_id", "left").select("image_id", F.when(F.coalesce("positive", F.lit(False)), "positive").otherwise("negative").alias("scope"))
    scopes = lambda df: df.withColumn("scope", F.explode(F.array(F.lit("all"), F.col("scope"))))
    sizes = scopes(tagged).groupBy("scope").agg(F.count("*").alias("images"))
    steps = F.array(*(F.lit(float(t)) for t in thresholds))
    hit = pred.join(tagged, "image_id").withColumn("threshold", F.explode(F.filter(steps, lambda t: t <= F.col("confidence"))))
    per_image = hit.groupBy("scope", "image_id", "threshold").agg(F.count("*").alias("n"), *(F.count_if(F.col("class_id") == c).alias(CODES[c].lower()) for c in CLASSES))
    got = scopes(per_image).groupBy("scope", "threshold").agg(F.sum("n").alias("predictions"), F.count("*").alias("images_with_prediction"), *(F.sum(c.lower()).alias(c.lower()) for c in CODES))
    grid = sizes.withColumn("threshold", F.explode(steps))
    return grid.join(got, ["scope", "threshold"], "left").na.fill(0, ["predictions", "images_with_prediction", *(c.lower() for c in CODES)])


def interpolated_ap(gt: DataFrame, pred: DataFrame, min_overlap: float = 0.5, steps: int = 100) -> DataFrame:
    """(class_id, ap): average precision with 101 recall levels (an extension, by the published definition).

    Ranks are counted per confidence value and in ranges of values, so a class may hold any share of the rows;
    predictions of equal confidence enter together.
    """
    m = match(gt, pred, min_overlap).select("image_id", "pi", F.lit(1).alias("tp"))
    levels = pred.join(m, ["image_id", "pi"], "left").groupBy("class_id", "confidence").agg(F.count("*").alias("n"), F.sum(F.coalesce("tp", F.lit(0))).alias("tp"))
    support = gt.groupBy("class_id").agg(F.count("*").alias("support"))
    downwards = lambda c: F.col(f"{c}_of") - F.col(f"{c}_upto") + F.col(c)
    curve = ordered.cumulated(levels.where("confidence IS NOT NULL"), ["class_id"], "confidence", ["n", "tp"]).select("class_id", downwards("tp").alias("t"), downwards("n").alias("k")).join(F.broadcast(support), "class_id").select("class_id", (F.col("t") / F.col("support")).alias("recall"), (F.col("t") / F.col("k")).alias("precision"))
    grid = spine(gt.sparkSession).crossJoin(gt.sparkSession.range(steps + 1).select((F.col("id") / steps).alias("level")))
    # envelope: the best precision at a recall of at least the level, from points bucketed by level
    bucketed = curve.withColumn("b", F.floor(F.col("recall") * steps + 1e-9)).groupBy("class_id", "b").agg(F.max("precision").alias("p"))
    at = grid.withColumn("b", F.bround(F.col("level") * steps).cast("long")).join(bucketed, ["class_id", "b"], "left")
    best = F.max("p").over(W.partitionBy("class_id").orderBy(F.col("b").desc()))
    return at.withColumn("best", F.coalesce(best, F.lit(0.0))).groupBy("class_id").agg(F.avg("best").alias("ap"))
