"""Registered queries of matching, metrics and failure analysis over the derived boxes, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from detlake.operators import errors as e
from detlake.operators import matching as m
from detlake.operators import metrics as x
from detlake.plans.adapters import derived, relation, with_clause
from detlake.session import cut

AT = e.Point(confidence=0.3)
GRID = [k / 10 for k in range(0, 11)]
PROFILE = [0.1, 0.2, 0.3, 0.5, 0.8]


class _Input:
    """The derived relations of one query; they stand for tables, so the boxes are materialised once."""

    def __init__(self, s, d, second: bool = False):
        boxes = cut(relation(s, d, "boxes"))
        self.images = relation(s, d, "sites")
        self.gt = derived(boxes, "gt")
        self.pred = derived(boxes, "pred")
        self.other = derived(boxes, "pred_b") if second else None

    @property
    def kept(self):
        return self.pred.where(F.col("confidence") >= F.lit(AT.confidence))


def _outcome(s, d):
    i = _Input(s, d)
    return e.outcome(i.images, i.gt, i.pred, AT)


def iou_pairs(s, d):
    i = _Input(s, d)
    edges = m.candidate_edges(i.gt, i.pred).where("overlap >= 0.5D")
    return edges.select("image_id", "pi", "gi", F.col("pc").alias("class_id"), "overlap")


def match_greedy(s, d):
    i = _Input(s, d)
    return m.match(i.gt, i.pred).select("image_id", "class_id", "pi", "gi", F.round("overlap", 9).alias("overlap"))


def metrics_point(s, d):
    i = _Input(s, d)
    return x.point(i.gt, i.pred, AT.confidence)


def micro_macro(s, d):
    return x.micro_macro(metrics_point(s, d))


def threshold_sweep(s, d):
    i = _Input(s, d)
    return x.sweep(i.images, i.gt, i.pred, GRID)


def sweep_points(s, d):
    return x.sweep_points(threshold_sweep(s, d)).drop("macro_f1_exact").withColumn("macro_f1", F.round("macro_f1", 12))


def select_point(s, d):
    return x.select_point(x.sweep_points(threshold_sweep(s, d))).select("threshold", "total_tp", "total_fp", "total_fn", "negative_fp")


def grouped_sweep(s, d):
    """Two suppression settings swept side by side; the second keeps confident predictions only."""
    i = _Input(s, d)
    both = i.pred.withColumn("nms_iou", F.lit(0.5)).unionByName(i.pred.where("confidence >= 0.4D").withColumn("nms_iou", F.lit(0.6)))
    points = x.sweep_points(x.sweep(i.images, i.gt, both, GRID, group="nms_iou"), "nms_iou")
    return x.select_point(points, [0.5, 0.6], "nms_iou").select("nms_iou", "threshold", "total_tp", "total_fp", "total_fn")


def negative_image_stats(s, d):
    i = _Input(s, d)
    return x.negative_stats(i.images, i.gt, i.kept)


def site_metrics(s, d):
    i = _Input(s, d)
    return x.by_site(i.images, i.gt, i.kept, m.match(i.gt, i.kept))


def prediction_profile(s, d):
    i = _Input(s, d)
    return x.profile(i.images, i.gt, i.pred, PROFILE)


def average_precision(s, d):
    i = _Input(s, d)
    return x.interpolated_ap(i.gt, i.pred).withColumn("ap", F.round("ap", 9))


def residual_confusion(s, d):
    return _outcome(s, d).confusions.select("image_id", "pi", "gi", "pc", "gc")


def residual_localization(s, d):
    return _outcome(s, d).localizations.select("image_id", "pi", "gi", "pc", "gc")


def confusion_matrix(s, d):
    return e.confusion_matrix(_outcome(s, d))


def fn_taxonomy_v1(s, d):
    return e.misses(_outcome(s, d), AT).select("image_id", "gi", "class_id", "diagnosis", "diagnostic_class", "diagnostic_confidence", F.round("diagnostic_iou", 9).alias("diagnostic_iou"))


def fp_taxonomy_v1(s, d):
    return e.alarms(_outcome(s, d), AT).select("image_id", "pi", "class_id", "confidence", "diagnosis", "related_class", F.round("best_iou", 9).alias("best_iou"), "high_confidence")


def fn_taxonomy_v2(s, d):
    return e.misses_exclusive(_outcome(s, d), AT).select("image_id", "gi", "class_id", "category", "diagnostic_class", "diagnostic_confidence", F.round("diagnostic_iou", 9).alias("diagnostic_iou"), *(f"has_{k}" for k in ("below", "competition", "localization", "wrong")))


def fp_taxonomy_v2(s, d):
    return e.alarms_exclusive(_outcome(s, d)).select("image_id", "pi", "class_id", "confidence", "category", F.round("best_iou", 9).alias("best_iou"), "related_class")


def fn_category_counts(s, d):
    o = _outcome(s, d)
    rows = e.misses(o, AT).withColumn("category", e.first_to_second(F.col("diagnosis"), F.col("diagnostic_iou")))
    return e.category_counts(rows, "category", ["class_id"]).withColumn("percent", F.round("percent", 9))


def fp_broad_counts(s, d):
    rows = e.alarms(_outcome(s, d), AT).withColumn("broad", e.broad_alarm(F.col("diagnosis")))
    return e.category_counts(rows, "broad").withColumn("percent", F.round("percent", 9))


def _recall(dimension, definitions):
    return lambda s, d: e.recall_by(e.described(_outcome(s, d)), dimension, definitions)


def confidence_quantiles(s, d):
    o = _outcome(s, d)
    hit = lambda p: F.exists("matches", lambda m_: m_["pi"] == p["pi"])
    kept = F.filter("preds", lambda p: p["confidence"] >= F.lit(AT.confidence))
    rows = o.rows.select(F.explode(F.transform(kept, lambda p: F.struct(F.when(hit(p), "TP").otherwise("FP").alias("outcome"), p["class_id"].alias("class_id"), p["confidence"].alias("confidence")))).alias("x")).select("x.*")
    return e.nearest_rank_quantiles(rows, ["outcome", "class_id"], "confidence").withColumn("mean", F.round("mean", 9))


def ranked_queues(s, d):
    return e.ranked_queues(_outcome(s, d), AT).withColumn("iou", F.round("iou", 9))


def class_errors(s, d):
    return e.class_error_rows(_outcome(s, d), AT)


def model_delta(s, d):
    i = _Input(s, d, second=True)
    a = x.by_site(i.images, i.gt, i.kept, m.match(i.gt, i.kept))
    other = i.other.where(F.col("confidence") >= F.lit(AT.confidence))
    b = x.by_site(i.images, i.gt, other, m.match(i.gt, other))
    return e.model_delta(a, b, ["site", "class_code"], ["tp", "fp", "fn", "recall"])


def suppressed(s, d):
    return m.suppress(_Input(s, d).pred).select("image_id", "class_id", "pi")


def queries():
    named = (
        iou_pairs, match_greedy, metrics_point, micro_macro, threshold_sweep, sweep_points, select_point, grouped_sweep, negative_image_stats, site_metrics, prediction_profile, average_precision,
        residual_confusion, residual_localization, confusion_matrix, fn_taxonomy_v1, fp_taxonomy_v1, fn_taxonomy_v2, fp_taxonomy_v2, fn_category_counts, fp_broad_counts, confidence_quantiles,
        ranked_queues, class_errors, model_delta, suppressed,
    )
    out = {f.__name__: f for f in named}
    return out | {"size_recall": _recall("size", e.SIZES), "aspect_recall": _recall("aspect", e.ASPECTS), "density_recall": _recall("density", e.DENSITIES)}


_INTER = "greatest(least(p.x2, g.x2) - greatest(p.x1, g.x1), 0) * greatest(least(p.y2, g.y2) - greatest(p.y1, g.y1), 0)"
_IOU = f"{_INTER} / ((p.x2 - p.x1) * (p.y2 - p.y1) + (g.x2 - g.x1) * (g.y2 - g.y1) - {_INTER})"
_CODE = "CASE {0} WHEN 0 THEN 'D00' WHEN 1 THEN 'D10' WHEN 2 THEN 'D20' ELSE 'D40' END"
_BASE = with_clause("gt", "pred", "pred_b", "sites")


def _fold(name: str, edges: str, group: str, order: str, extra: str = "") -> str:
    """Greedy fold over edges(pi, gi, ...) as a common table expression."""
    kept = f", {extra}" if extra else ""
    pack = "".join(f", '{c.strip()}': {c.strip()}" for c in extra.split(",") if c.strip())
    kinds = {"overlap": "DOUBLE", "confidence": "DOUBLE", "pc": "INT", "gc": "INT"}
    types = "".join(f", {c.strip()} {kinds[c.strip()]}" for c in extra.split(",") if c.strip())
    return f"""{name} AS (SELECT {group}, m.pi AS pi, m.gi AS gi{''.join(f', m.{c.strip()} AS {c.strip()}' for c in extra.split(',') if c.strip())} FROM (
  SELECT {group}, unnest(list_reduce(list({{'pi': pi, 'gi': gi{pack}}} ORDER BY {order}),
    lambda a, x: CASE WHEN len(list_filter(a, lambda z: z.pi = x.pi OR z.gi = x.gi)) > 0 THEN a ELSE list_append(a, x) END, []::STRUCT(pi INT, gi INT{types})[])) AS m
  FROM {edges} GROUP BY {group}))""" if kept or not extra else ""


def _matched(pred: str = "kept", name: str = "match") -> str:
    edges = f"""{name}_edges AS (SELECT p.image_id, p.class_id, p.pi, g.gi, p.confidence, {_IOU} AS overlap, p.x1 AS px1, p.y1 AS py1, p.x2 AS px2, p.y2 AS py2, g.x1 AS gx1, g.y1 AS gy1, g.x2 AS gx2, g.y2 AS gy2
  FROM {pred} p JOIN gt g ON p.image_id = g.image_id AND p.class_id = g.class_id WHERE {_IOU} >= 0.5::DOUBLE)"""
    return edges + ",\n" + _fold(name, f"{name}_edges", "image_id, class_id", "confidence DESC, px1, py1, px2, py2, pi, overlap DESC, gx1, gy1, gx2, gy2, gi", "overlap, confidence")


def _residual(name: str, gt: str, pred: str, condition: str) -> str:
    edges = f"""{name}_edges AS (SELECT p.image_id, p.pi, g.gi, p.confidence, p.class_id AS pc, g.class_id AS gc, {_IOU} AS overlap, p.x1 AS px1, p.y1 AS py1, p.x2 AS px2, p.y2 AS py2, g.x1 AS gx1, g.y1 AS gy1, g.x2 AS gx2, g.y2 AS gy2
  FROM {pred} p JOIN {gt} g ON p.image_id = g.image_id WHERE {condition})"""
    return edges + ",\n" + _fold(name, f"{name}_edges", "image_id", "overlap DESC, confidence DESC, pc, px1, py1, px2, py2, gc, gx1, gy1, gx2, gy2, pi, gi", "overlap, confidence, pc, gc")


_KEPT = f"kept AS (SELECT * FROM pred WHERE confidence >= {AT.confidence}::DOUBLE)"
_OUTCOME = ",\n".join(
    (
        _KEPT, _matched(),
        "left_gt AS (SELECT * FROM gt ANTI JOIN match USING (image_id, gi))", "left_pred AS (SELECT * FROM kept ANTI JOIN match USING (image_id, pi))",
        _residual("confused", "left_gt", "left_pred", f"p.class_id <> g.class_id AND {_IOU} >= 0.5::DOUBLE"),
        "near_gt AS (SELECT * FROM left_gt ANTI JOIN confused USING (image_id, gi))", "near_pred AS (SELECT * FROM left_pred ANTI JOIN confused USING (image_id, pi))",
        _residual("near", "near_gt", "near_pred", f"p.class_id = g.class_id AND {_IOU} >= 0.1::DOUBLE AND {_IOU} < 0.5::DOUBLE"),
    )
)
_CLASSES = "classes AS (SELECT unnest([0, 1, 2, 3])::INT AS class_id)"
_RATES = "coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE AS f1"
_COUNTS = """counts AS (SELECT class_id, coalesce(support, 0) AS support, coalesce(predictions, 0) AS predictions, coalesce(tp, 0) AS tp, coalesce(predictions, 0) - coalesce(tp, 0) AS fp, coalesce(support, 0) - coalesce(tp, 0) AS fn
  FROM classes LEFT JOIN (SELECT class_id, count(*) AS support FROM gt GROUP BY 1) USING (class_id) LEFT JOIN (SELECT class_id, count(*) AS predictions FROM kept GROUP BY 1) USING (class_id) LEFT JOIN (SELECT class_id, count(*) AS tp FROM match GROUP BY 1) USING (class_id))"""
_POINT = f"WITH {_BASE}, {_KEPT}, {_matched()}, {_CLASSES}, {_COUNTS}"

_GRID = f"grid AS (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in GRID)}]) AS threshold)"
_SWEEP = f"""WITH {_BASE}, {_matched('pred')}, {_CLASSES}, {_GRID},
negatives AS (SELECT image_id FROM sites ANTI JOIN gt USING (image_id)),
cells AS (SELECT threshold, class_id, (SELECT count(*) FROM pred p WHERE p.class_id = classes.class_id AND p.confidence >= threshold) AS n, (SELECT count(*) FROM match k WHERE k.class_id = classes.class_id AND k.confidence >= threshold) AS tp,
  (SELECT count(*) FROM gt g WHERE g.class_id = classes.class_id) AS support FROM grid CROSS JOIN classes),
neg AS (SELECT threshold, count(p.image_id) AS negative_fp, count(DISTINCT p.image_id) AS negative_images_with_fp FROM grid LEFT JOIN (SELECT * FROM pred SEMI JOIN negatives USING (image_id)) p ON p.confidence >= threshold GROUP BY threshold),
swept AS (SELECT threshold, class_id, tp, n - tp AS fp, support - tp AS fn, (SELECT count(*) FROM negatives) AS negative_images, negative_fp, negative_images_with_fp FROM cells JOIN neg USING (threshold))"""
_POINTS = """points AS (SELECT threshold, sum(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) / 4 AS macro_f1, sum(tp)::BIGINT AS total_tp, sum(fp)::BIGINT AS total_fp, sum(fn)::BIGINT AS total_fn,
  max(negative_images) AS negative_images, max(negative_fp) AS negative_fp, max(negative_images_with_fp) AS negative_images_with_fp FROM swept GROUP BY threshold)"""


def _site_cte(pred: str, match: str, name: str) -> str:
    return f"""{name} AS (SELECT site, class_code, images, positive_images, support, predictions, tp, predictions - tp AS fp, support - tp AS fn FROM (
  SELECT site, {_CODE.format('class_id')} AS class_code, (SELECT count(*) FROM sites s WHERE s.site = q.site) AS images, (SELECT count(DISTINCT g.image_id) FROM gt g JOIN sites USING (image_id) WHERE site = q.site AND g.class_id = q.class_id) AS positive_images,
    (SELECT count(*) FROM gt g JOIN sites USING (image_id) WHERE site = q.site AND g.class_id = q.class_id) AS support, (SELECT count(*) FROM {pred} p JOIN sites USING (image_id) WHERE site = q.site AND p.class_id = q.class_id) AS predictions,
    (SELECT count(*) FROM {match} m JOIN sites USING (image_id) WHERE site = q.site AND m.class_id = q.class_id) AS tp FROM (SELECT site, class_id FROM (SELECT DISTINCT site FROM sites) CROSS JOIN classes) q
  UNION ALL SELECT site, 'ALL', (SELECT count(*) FROM sites s WHERE s.site = q.site), (SELECT count(DISTINCT g.image_id) FROM gt g JOIN sites USING (image_id) WHERE site = q.site), (SELECT count(*) FROM gt g JOIN sites USING (image_id) WHERE site = q.site),
    (SELECT count(*) FROM {pred} p JOIN sites USING (image_id) WHERE site = q.site), (SELECT count(*) FROM {match} m JOIN sites USING (image_id) WHERE site = q.site) FROM (SELECT DISTINCT site FROM sites) q))"""


_FN1 = f"""pairs AS (SELECT g.image_id, g.gi, p.pi, p.class_id AS pc, g.class_id AS gc, p.confidence AS s, {_IOU} AS o, p.x1, p.y1, p.x2, p.y2 FROM left_gt g JOIN pred p USING (image_id)),
below AS (SELECT image_id, gi, arg_max({{'c': pc, 's': s, 'o': o}}, (s, o, -x1, -y1, -x2, -y2, -pi)) AS d FROM pairs WHERE s < {AT.confidence}::DOUBLE AND pc = gc AND o >= 0.5::DOUBLE GROUP BY 1, 2),
anyone AS (SELECT image_id, gi, arg_max({{'c': pc, 's': s, 'o': o}}, (o, s, -x1, -y1, -x2, -y2, -pi)) AS d FROM pairs WHERE s >= {AT.confidence}::DOUBLE GROUP BY 1, 2),
fn1 AS (SELECT image_id, gi, class_id, CASE WHEN c.pi IS NOT NULL THEN 'class_confusion' WHEN n.pi IS NOT NULL THEN 'poor_localization' WHEN b.d IS NOT NULL THEN 'below_frozen_confidence' ELSE 'no_matching_candidate' END AS diagnosis,
  coalesce(c.pc, n.pc, b.d.c, a.d.c) AS diagnostic_class, coalesce(c.confidence, n.confidence, b.d.s, a.d.s) AS diagnostic_confidence, coalesce(c.overlap, n.overlap, b.d.o, a.d.o, 0) AS diagnostic_iou
  FROM left_gt LEFT JOIN confused c USING (image_id, gi) LEFT JOIN near n USING (image_id, gi) LEFT JOIN below b USING (image_id, gi) LEFT JOIN anyone a USING (image_id, gi))"""
_FP1 = f"""best AS (SELECT p.image_id, p.pi, max({{'o': {_IOU}, 'c': g.class_id}}) AS d FROM left_pred p JOIN gt g USING (image_id) GROUP BY 1, 2),
fp1 AS (SELECT image_id, pi, class_id, l.confidence, CASE WHEN c.gi IS NOT NULL THEN 'class_confusion' WHEN n.gi IS NOT NULL THEN 'poor_localization' WHEN b.d IS NULL THEN 'negative_image' WHEN b.d.o >= 0.5::DOUBLE THEN 'duplicate_or_competing_overlap'
  WHEN b.d.o >= 0.1::DOUBLE THEN 'nearby_unmatched_pattern' ELSE 'background_or_unlabelled_pattern' END AS diagnosis, coalesce(c.gc, n.gc, b.d.c) AS related_class, coalesce(c.overlap, n.overlap, b.d.o, 0) AS best_iou, l.confidence >= 0.5::DOUBLE AS high_confidence
  FROM left_pred l LEFT JOIN confused c USING (image_id, pi) LEFT JOIN near n USING (image_id, pi) LEFT JOIN best b USING (image_id, pi))"""


def _best(name: str, condition: str) -> str:
    return f"arg_max({{'c': pc, 's': s, 'o': o}}, (o, s, -pc, -x1, -y1, -x2, -y2, -pi)) FILTER (WHERE {condition}) AS {name}"


_FN2 = f"""pairs AS (SELECT g.image_id, g.gi, p.pi, p.class_id AS pc, g.class_id AS gc, p.confidence AS s, {_IOU} AS o, p.x1, p.y1, p.x2, p.y2, m.gi IS NOT NULL AS taken FROM left_gt g JOIN pred p USING (image_id) LEFT JOIN match m ON m.image_id = p.image_id AND m.pi = p.pi),
kinds AS (SELECT image_id, gi, {_best('b', f'pc = gc AND s < {AT.confidence}::DOUBLE AND o >= 0.5::DOUBLE')}, {_best('k', f'pc = gc AND s >= {AT.confidence}::DOUBLE AND o >= 0.5::DOUBLE AND taken')},
  {_best('l', f'pc = gc AND s >= {AT.confidence}::DOUBLE AND o < 0.5::DOUBLE AND o >= 0.1::DOUBLE')}, {_best('w', f'pc <> gc AND s >= {AT.confidence}::DOUBLE AND o >= 0.5::DOUBLE')}, {_best('a', 'true')} FROM pairs GROUP BY 1, 2)"""

_DESCRIBED = """seen AS (SELECT gt.*, site, m.pi IS NOT NULL AS hit, (x2 - x1) * (y2 - y1) / (width * height) AS area, (x2 - x1) / (y2 - y1) AS ratio, count(*) OVER (PARTITION BY image_id) AS n FROM gt JOIN sites USING (image_id) LEFT JOIN match m USING (image_id, gi)),
described AS (SELECT *, CASE WHEN area < 0.01::DOUBLE THEN 'small' WHEN area < 0.05::DOUBLE THEN 'medium' ELSE 'large' END AS size, CASE WHEN ratio < 0.5::DOUBLE THEN 'narrow' WHEN ratio < 2 THEN 'balanced' ELSE 'wide' END AS aspect,
  CASE WHEN n < 2 THEN 'one_target' WHEN n < 4 THEN 'two_to_three_targets' ELSE 'four_or_more_targets' END AS density FROM seen)"""


def _recall_sql(dimension: str, names) -> str:
    values = ", ".join(f"'{n[0]}'" for n in names)
    return f"""WITH {_BASE}, {_KEPT}, {_matched()}, {_CLASSES}, {_DESCRIBED},
cell AS (SELECT {_CODE.format('class_id')} AS class_code, b AS bucket, (SELECT count(*) FROM described x WHERE x.class_id = c.class_id AND x.{dimension} = b) AS support, (SELECT count(*) FROM described x WHERE x.class_id = c.class_id AND x.{dimension} = b AND hit) AS tp
  FROM classes c CROSS JOIN (SELECT unnest([{values}]) AS b)),
both_ AS (SELECT * FROM cell UNION ALL SELECT 'ALL', bucket, sum(support)::BIGINT, sum(tp)::BIGINT FROM cell GROUP BY bucket)
SELECT *, support - tp AS fn, coalesce(tp / nullif(support, 0), 0)::DOUBLE AS recall, support < 30 AS weak_support FROM both_"""


def oracle_sql():
    run = f"WITH {_BASE}, {_OUTCOME}"
    code = _CODE.format
    q = lambda p: f"(list_sort(list(confidence)))[floor({p} * (count(*) - 1) / 100)::INT + 1]"
    return {
        "iou_pairs": f"WITH {_BASE} SELECT p.image_id, p.pi, g.gi, p.class_id, {_IOU} AS overlap FROM pred p JOIN gt g ON p.image_id = g.image_id AND p.class_id = g.class_id WHERE {_IOU} >= 0.5::DOUBLE",
        "match_greedy": f"WITH {_BASE}, {_matched('pred')} SELECT image_id, class_id, pi, gi, round(overlap, 9) AS overlap FROM match",
        "metrics_point": f"{_POINT} SELECT class_id, {code('class_id')} AS class_code, support, predictions, tp, fp, fn, {_RATES} FROM counts",
        "micro_macro": f"""{_POINT}, r AS (SELECT *, {_RATES} FROM counts), t AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(precision) / 4 AS macro_precision, sum(recall) / 4 AS macro_recall, sum(f1) / 4 AS macro_f1 FROM r)
SELECT tp, fp, fn, macro_precision, macro_recall, macro_f1, coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS micro_precision, coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS micro_recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE AS micro_f1 FROM t""",
        "threshold_sweep": f"{_SWEEP} SELECT threshold, class_id, tp, fp, fn, {_RATES}, negative_images, negative_fp, negative_images_with_fp FROM swept",
        "sweep_points": f"{_SWEEP}, {_POINTS} SELECT threshold, round(macro_f1, 12) AS macro_f1, total_tp, total_fp, total_fn, negative_images, negative_fp, negative_images_with_fp FROM points",
        "select_point": f"{_SWEEP}, {_POINTS} SELECT threshold, total_tp, total_fp, total_fn, negative_fp FROM points ORDER BY round(macro_f1, 12) DESC, negative_fp, threshold DESC LIMIT 1",
        "grouped_sweep": f"""WITH {_BASE}, p2 AS (SELECT * FROM pred WHERE confidence >= 0.4::DOUBLE), {_matched('pred', 'ma')}, {_matched('p2', 'mb')}, {_CLASSES}, {_GRID}, negatives AS (SELECT image_id FROM sites ANTI JOIN gt USING (image_id)),
both_ AS (SELECT 0.5::DOUBLE AS nms_iou, * FROM pred UNION ALL SELECT 0.6::DOUBLE, * FROM p2), hits AS (SELECT 0.5::DOUBLE AS nms_iou, class_id, confidence FROM ma UNION ALL SELECT 0.6::DOUBLE, class_id, confidence FROM mb),
cells AS (SELECT s.nms_iou, threshold, c.class_id, (SELECT count(*) FROM both_ p WHERE p.nms_iou = s.nms_iou AND p.class_id = c.class_id AND p.confidence >= threshold) AS n, (SELECT count(*) FROM hits k WHERE k.nms_iou = s.nms_iou AND k.class_id = c.class_id AND k.confidence >= threshold) AS tp,
  (SELECT count(*) FROM gt g WHERE g.class_id = c.class_id) AS support FROM (SELECT unnest([0.5::DOUBLE, 0.6::DOUBLE]) AS nms_iou) s CROSS JOIN grid CROSS JOIN classes c),
pt AS (SELECT nms_iou, threshold, round(sum(coalesce(2 * tp / nullif(2 * tp + (n - tp) + (support - tp), 0), 0)) / 4, 12) AS f, sum(tp)::BIGINT AS total_tp, sum(n - tp)::BIGINT AS total_fp, sum(support - tp)::BIGINT AS total_fn,
  (SELECT count(*) FROM both_ p SEMI JOIN negatives USING (image_id) WHERE p.nms_iou = cells.nms_iou AND p.confidence >= cells.threshold) AS nfp FROM cells GROUP BY nms_iou, threshold)
SELECT nms_iou, threshold, total_tp, total_fp, total_fn FROM pt ORDER BY f DESC, nfp, threshold DESC, nms_iou LIMIT 1""",
        "ranked_queues": f"""WITH {_BASE}, {_OUTCOME}, {_FN1}, {_FP1}, fnq AS (SELECT *, {code('class_id')} AS cc, coalesce(diagnostic_confidence, 0) AS s, CASE diagnosis WHEN 'class_confusion' THEN 0 WHEN 'poor_localization' THEN 1 WHEN 'below_frozen_confidence' THEN 2 ELSE 3 END AS seq FROM fn1),
fpq AS (SELECT *, {code('class_id')} AS cc FROM fp1), err AS (SELECT image_id, diagnosis, confidence, 1 AS p, 0 AS n FROM fp1 UNION ALL SELECT image_id, diagnosis, 0, 0, 1 FROM fn1),
img AS (SELECT image_id, site, sum(p)::BIGINT AS p, sum(n)::BIGINT AS n, max(confidence) AS top, string_agg(DISTINCT diagnosis, ';' ORDER BY diagnosis) AS d FROM err JOIN sites USING (image_id) GROUP BY 1, 2), neg AS (SELECT image_id, count(*) AS n, max(confidence) AS top FROM fp1 WHERE diagnosis = 'negative_image' GROUP BY 1),
q AS (SELECT cc || '_FALSE_NEGATIVE' AS queue, image_id, cc AS class_code, diagnosis, diagnostic_confidence AS confidence, diagnostic_iou AS iou, NULL::BIGINT AS fp, NULL::BIGINT AS fn, row_number() OVER (PARTITION BY cc ORDER BY seq, s DESC, diagnostic_iou DESC, image_id, gi) AS rank FROM fnq
UNION ALL SELECT 'HIGH_CONFIDENCE_FALSE_POSITIVE', image_id, cc, diagnosis, confidence, best_iou, NULL, NULL, row_number() OVER (ORDER BY confidence DESC, image_id, pi) FROM fpq WHERE high_confidence
UNION ALL SELECT 'HIGH_CONFIDENCE_FN_DIAGNOSTIC', image_id, cc, diagnosis, diagnostic_confidence, diagnostic_iou, NULL, NULL, row_number() OVER (ORDER BY s DESC, diagnostic_iou DESC, image_id, gi) FROM fnq WHERE seq < 2 AND s >= 0.5::DOUBLE
UNION ALL SELECT 'NEGATIVE_ROAD_FALSE_POSITIVE', image_id, NULL, NULL, top, NULL, n, NULL, row_number() OVER (ORDER BY top DESC, n DESC, image_id) FROM neg
UNION ALL SELECT 'POSSIBLE_CLASS_CONFUSION', image_id, cc, diagnosis, confidence, best_iou, NULL, NULL, row_number() OVER (ORDER BY confidence DESC, best_iou DESC, image_id, pi) FROM fpq WHERE diagnosis = 'class_confusion'
UNION ALL SELECT 'POOR_LOCALIZATION', image_id, {code('gc')}, NULL, confidence, overlap, NULL, NULL, row_number() OVER (ORDER BY confidence DESC, overlap, image_id, pi) FROM near
UNION ALL SELECT upper(site) || '_ERROR', image_id, NULL, d, NULL, NULL, p, n, row_number() OVER (PARTITION BY site ORDER BY p + n DESC, top DESC, image_id) FROM img)
SELECT * REPLACE (round(iou, 9) AS iou, rank::INT AS rank) FROM q WHERE rank <= 25""",
        "negative_image_stats": f"""WITH {_BASE}, {_KEPT}, negatives AS (SELECT image_id FROM sites ANTI JOIN gt USING (image_id)), hit AS (SELECT image_id, count(*) AS n FROM kept SEMI JOIN negatives USING (image_id) GROUP BY 1),
t AS (SELECT (SELECT count(*) FROM negatives) AS negative_images, (SELECT coalesce(sum(n), 0)::BIGINT FROM hit) AS negative_fp, (SELECT count(*) FROM hit) AS negative_images_with_fp)
SELECT *, coalesce(negative_fp / nullif(negative_images, 0), 0)::DOUBLE AS negative_fp_per_image, coalesce(negative_images_with_fp / nullif(negative_images, 0), 0)::DOUBLE AS negative_images_with_fp_fraction FROM t""",
        "site_metrics": f"WITH {_BASE}, {_KEPT}, {_matched()}, {_CLASSES}, {_site_cte('kept', 'match', 'a')} SELECT *, {_RATES} FROM a",
        "prediction_profile": f"""WITH {_BASE}, tagged AS (SELECT image_id, CASE WHEN EXISTS (SELECT 1 FROM gt g WHERE g.image_id = s.image_id) THEN 'positive' ELSE 'negative' END AS scope FROM sites s),
scoped AS (SELECT image_id, scope FROM tagged UNION ALL SELECT image_id, 'all' FROM tagged), grid AS (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in PROFILE)}]) AS threshold)
SELECT scope, threshold, count(DISTINCT s.image_id) AS images, count(p.pi) AS predictions, count(DISTINCT p.image_id) AS images_with_prediction, count(*) FILTER (WHERE p.class_id = 0) AS d00, count(*) FILTER (WHERE p.class_id = 1) AS d10, count(*) FILTER (WHERE p.class_id = 2) AS d20,
  count(*) FILTER (WHERE p.class_id = 3) AS d40 FROM scoped s CROSS JOIN grid LEFT JOIN pred p ON p.image_id = s.image_id AND p.confidence >= threshold GROUP BY 1, 2""",
        "average_precision": f"""WITH {_BASE}, {_matched('pred')}, {_CLASSES}, lv AS (SELECT class_id, confidence, count(*) AS n, count(m.gi) AS tp FROM pred LEFT JOIN (SELECT image_id, pi, gi FROM match) m USING (image_id, pi) GROUP BY 1, 2),
curve AS (SELECT class_id, sum(tp) OVER w / (SELECT count(*) FROM gt g WHERE g.class_id = lv.class_id) AS recall, sum(tp) OVER w / sum(n) OVER w AS precision FROM lv WINDOW w AS (PARTITION BY class_id ORDER BY confidence DESC)),
lev AS (SELECT class_id, k, coalesce((SELECT max(precision) FROM curve c WHERE c.class_id = classes.class_id AND floor(recall * 100 + 1e-9) >= k), 0) AS p FROM classes CROSS JOIN (SELECT unnest(range(101)) AS k))
SELECT class_id, round(avg(p), 9) AS ap FROM lev GROUP BY 1""",
        "residual_confusion": f"{run} SELECT image_id, pi, gi, pc, gc FROM confused",
        "residual_localization": f"{run} SELECT image_id, pi, gi, pc, gc FROM near",
        "confusion_matrix": f"""{run}, label AS (SELECT unnest(['D00', 'D10', 'D20', 'D40', 'BACKGROUND']) AS l), cell AS (SELECT {code('class_id')} AS t, {code('class_id')} AS p FROM match UNION ALL SELECT {code('gc')}, {code('pc')} FROM confused
  UNION ALL SELECT {code('class_id')}, 'BACKGROUND' FROM near_gt UNION ALL SELECT 'BACKGROUND', {code('class_id')} FROM near_pred)
SELECT a.l AS true_class, b.l AS predicted_class, (SELECT count(*) FROM cell WHERE t = a.l AND p = b.l) AS count FROM label a CROSS JOIN label b""",
        "fn_taxonomy_v1": f"{run}, {_FN1} SELECT * REPLACE (round(diagnostic_iou, 9) AS diagnostic_iou) FROM fn1",
        "fp_taxonomy_v1": f"{run}, {_FP1} SELECT * REPLACE (round(best_iou, 9) AS best_iou) FROM fp1",
        "fn_taxonomy_v2": f"""{run}, {_FN2} SELECT image_id, gi, class_id, CASE WHEN b IS NOT NULL THEN 'below_confidence_same_class_iou_ge_0.50' WHEN k IS NOT NULL THEN 'same_class_matching_competition_iou_ge_0.50' WHEN l.o >= 0.3::DOUBLE THEN 'localization_iou_0.30_to_0.50'
  WHEN l IS NOT NULL THEN 'localization_iou_0.10_to_0.30' WHEN w IS NOT NULL THEN 'wrong_class_overlap_iou_ge_0.50' ELSE '{e.NO_CANDIDATE}' END AS category, coalesce(b, k, l, w, a).c AS diagnostic_class, coalesce(b, k, l, w, a).s AS diagnostic_confidence,
  round(coalesce(coalesce(b, k, l, w, a).o, 0), 9) AS diagnostic_iou, b IS NOT NULL AS has_below, k IS NOT NULL AS has_competition, l IS NOT NULL AS has_localization, w IS NOT NULL AS has_wrong FROM left_gt LEFT JOIN kinds USING (image_id, gi)""",
        "fp_taxonomy_v2": f"""{run}, k AS (SELECT p.image_id, p.pi, arg_max({{'c': g.class_id, 'o': {_IOU}}}, ({_IOU}, -g.class_id, -g.x1, -g.y1, -g.x2, -g.y2, -g.gi)) FILTER (WHERE g.class_id = p.class_id) AS s,
  arg_max({{'c': g.class_id, 'o': {_IOU}}}, ({_IOU}, -g.class_id, -g.x1, -g.y1, -g.x2, -g.y2, -g.gi)) FILTER (WHERE g.class_id <> p.class_id) AS d, count(*) AS n FROM left_pred p JOIN gt g USING (image_id) GROUP BY 1, 2),
v AS (SELECT l.image_id, l.pi, l.class_id, l.confidence, n, s, d, coalesce(s.o, 0) AS so, coalesce(d.o, 0) AS dq FROM left_pred l LEFT JOIN k USING (image_id, pi)),
w AS (SELECT *, CASE WHEN n IS NULL THEN 'negative_only_image' WHEN so >= 0.5::DOUBLE THEN 'native_end2end_same_class_overlap_unmatched_iou_ge_0.50' WHEN dq >= 0.5::DOUBLE THEN 'wrong_class_overlap_iou_ge_0.50' WHEN so >= 0.3::DOUBLE THEN 'localization_same_class_iou_0.30_to_0.50'
  WHEN so >= 0.1::DOUBLE THEN 'localization_same_class_iou_0.10_to_0.30' WHEN dq >= 0.1::DOUBLE THEN 'wrong_class_weak_overlap_iou_0.10_to_0.50' ELSE 'positive_image_unmatched_iou_below_0.10' END AS category FROM v),
z AS (SELECT *, CASE WHEN n IS NULL THEN NULL WHEN category LIKE '%wrong_class%' THEN d WHEN category LIKE '%same_class%' THEN s WHEN so >= dq THEN s ELSE d END AS r FROM w)
SELECT image_id, pi, class_id, confidence, category, round(coalesce(r.o, 0), 9) AS best_iou, r.c AS related_class FROM z""",
        "fn_category_counts": f"""{run}, {_FN1}, c AS (SELECT class_id, CASE diagnosis WHEN 'below_frozen_confidence' THEN 'below_confidence_same_class_iou_ge_0.50' WHEN 'class_confusion' THEN 'wrong_class_overlap_iou_ge_0.50' WHEN 'no_matching_candidate' THEN '{e.NO_CANDIDATE}'
  ELSE CASE WHEN diagnostic_iou >= 0.3::DOUBLE THEN 'localization_iou_0.30_to_0.50' ELSE 'localization_iou_0.10_to_0.30' END END AS category FROM fn1)
SELECT class_id, category, count(*) AS count, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY class_id), 9) AS percent FROM c GROUP BY 1, 2""",
        "fp_broad_counts": f"""{run}, {_FP1}, c AS (SELECT CASE diagnosis WHEN 'negative_image' THEN 'negative_only_image' WHEN 'class_confusion' THEN 'wrong_class_overlap' WHEN 'poor_localization' THEN 'weak_localization_or_nearby' WHEN 'nearby_unmatched_pattern' THEN 'weak_localization_or_nearby'
  WHEN 'duplicate_or_competing_overlap' THEN 'same_class_overlap_unmatched' ELSE 'positive_image_unmatched_low_overlap' END AS category FROM fp1) SELECT category, count(*) AS count, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 9) AS percent FROM c GROUP BY 1""",
        "confidence_quantiles": f"""WITH {_BASE}, {_KEPT}, {_matched()}, r AS (SELECT CASE WHEN m.gi IS NULL THEN 'FP' ELSE 'TP' END AS outcome, k.class_id, k.confidence FROM kept k LEFT JOIN (SELECT image_id, pi, gi FROM match) m USING (image_id, pi))
SELECT outcome, class_id, count(*) AS count, min(confidence) AS minimum, {q(10)} AS p10, {q(25)} AS p25, {q(50)} AS median, {q(75)} AS p75, {q(90)} AS p90, max(confidence) AS maximum, round(avg(confidence), 9) AS mean FROM r GROUP BY 1, 2""",
        "class_errors": f"""WITH {_BASE}, {_OUTCOME}, {_CLASSES}, {_COUNTS} SELECT class_id, {code('class_id')} AS class_code, support, predictions, tp, fp, fn, {_RATES}, (SELECT count(DISTINCT image_id) FROM gt g WHERE g.class_id = c.class_id) AS positive_images,
  (SELECT count(*) FROM confused WHERE pc = c.class_id) AS confusions, (SELECT count(*) FROM near WHERE gc = c.class_id) AS localization_errors, (SELECT count(*) FROM left_pred l WHERE l.class_id = c.class_id AND l.confidence >= 0.5::DOUBLE) AS high_confidence_fp FROM counts c""",
        "model_delta": f"""WITH {_BASE}, {_KEPT}, {_matched()}, kept_b AS (SELECT * FROM pred_b WHERE confidence >= {AT.confidence}::DOUBLE), {_matched('kept_b', 'match_b')}, {_CLASSES}, {_site_cte('kept', 'match', 'a')}, {_site_cte('kept_b', 'match_b', 'b')},
ar AS (SELECT *, {_RATES} FROM a), br AS (SELECT *, {_RATES} FROM b)
SELECT site, class_code, ar.tp AS a_tp, br.tp AS b_tp, ar.fp AS a_fp, br.fp AS b_fp, ar.fn AS a_fn, br.fn AS b_fn, ar.recall AS a_recall, br.recall AS b_recall, br.tp - ar.tp AS delta_tp, br.fp - ar.fp AS delta_fp, br.fn - ar.fn AS delta_fn, br.recall - ar.recall AS delta_recall
FROM ar JOIN br USING (site, class_code)""",
        "suppressed": f"""WITH {_BASE} SELECT image_id, class_id, k.pi AS pi FROM (SELECT image_id, class_id, unnest(list_reduce(list({{'pi': pi, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY confidence DESC, x1, y1, x2, y2, pi),
  lambda a, p: CASE WHEN len(list_filter(a, lambda g: {_IOU} > 0.5::DOUBLE)) > 0 THEN a ELSE list_append(a, p) END, []::STRUCT(pi INT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[])) AS k FROM pred GROUP BY 1, 2)""",
        "size_recall": _recall_sql("size", e.SIZES),
        "aspect_recall": _recall_sql("aspect", e.ASPECTS),
        "density_recall": _recall_sql("density", e.DENSITIES),
    }
