"""Runs of repeated consecutive events (problem 1).

Events are canonicalised first and numbered afterwards. Canonicalising gives every observation of an entity (a video and
a class) the value of the object it shows: observations one to three frames apart whose boxes overlap enough have the same
value. Then the classic difference applies: among the entity's events, laid out value by value in frame order, the row
number within the entity less the row number within the entity and value is constant exactly on one run, and a run is
aggregated under that difference.

Scale. Rows are shuffled once, by (video, class, block of frames), never by video alone, so a video that holds a third of
all rows is spread like any other. Inside a block rows are sorted and streamed, and all steps are array operations on
whole islands (stretches without a pause of more than the gap). Only one row a run leaves a block. Runs that touch the
first or last frames of a block are joined with those of the neighbouring block, and chains over several blocks are
closed by randomised contraction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detlake.llm.contraction import contract
from detlake.session import cut

#: Frames in a block: small enough to spread a hot video, large enough that few runs cross blocks.
BLOCK_FRAMES = 4096
MAX_GAP = 3
MIN_IOU = 0.6

_LOCAL = (
    "video_id string, class_id int, run_id long, block long, observations long, first_frame long, last_frame long, first_detection_id long, "
    "last_detection_id long, first_ms double, last_ms double, edge array<struct<side:int,frame:long,x1:double,y1:double,x2:double,y2:double>>"
)


def row_number_difference(entity: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Row number within the entity less row number within (entity, value), for rows laid out by entity and value."""
    n = len(entity)
    at = np.arange(n)
    new_entity = np.r_[True, entity[1:] != entity[:-1]]
    new_value = new_entity | np.r_[True, value[1:] != value[:-1]]
    within_entity = at - np.maximum.accumulate(np.where(new_entity, at, 0))
    within_value = at - np.maximum.accumulate(np.where(new_value, at, 0))
    return within_entity - within_value


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of boxes (n, 4); 0 without a union."""
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        w = np.minimum(a[:, 2], b[:, 2]) - np.maximum(a[:, 0], b[:, 0])
        h = np.minimum(a[:, 3], b[:, 3]) - np.maximum(a[:, 1], b[:, 1])
        both = np.maximum(w, 0) * np.maximum(h, 0)
        area = lambda z: np.maximum(z[:, 2] - z[:, 0], 0) * np.maximum(z[:, 3] - z[:, 1], 0)
        union = area(a) + area(b) - both
        return np.where(union > 0, both / union, 0.0)


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index connected with each of n vertices."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


#: Pairs of boxes compared at once, and links kept before they are reduced to one a row.
_COMPARED, _LINKS = 1_000_000, 2_000_000


def _linked(frame_of: np.ndarray, group: np.ndarray, box: np.ndarray, gap: int, min_iou: float) -> np.ndarray:
    """The smallest index connected with each box; boxes are sorted by group (island and frame) and then x1.

    Boxes that overlap by t have left edges within (1 - t) of the left one's width or (1 - t) / t of the other's, so a
    box is compared with a range of another frame's boxes and not with all of them. Links are reduced as they come.
    """
    n, left = len(group), np.zeros(0, np.int64)
    right = left
    order = np.sort(box[:, 0])
    rank = lambda x, side: np.searchsorted(order, x, side)
    keys = group * (n + 2) + rank(box[:, 0], "left")
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    island, frame = frame_of[0][first], frame_of[1][first]
    wide = np.maximum(box[:, 2] - box[:, 0], 0)
    with np.errstate(invalid="ignore", over="ignore"):
        low, high = box[:, 0] - wide * ((1 - min_iou) / min_iou if min_iou > 0 else np.inf), box[:, 0] + wide * (1 - min_iou)
        slack = 1e-9 * (np.abs(box[:, 0]) + wide)  # rounding of the bounds loses no pair
        low, high = (np.where(np.isfinite(x), x, e) for x, e in ((low - slack, -np.inf), (high + slack, np.inf)))
    low, high = rank(low, "left"), rank(high, "right")
    for ahead in range(1, gap + 1):  # groups are different frames, so those within the gap are the next ones
        there = np.arange(len(first)) + ahead
        ok = there < len(first)
        ok[ok] = (island[there[ok]] == island[np.flatnonzero(ok)]) & (frame[there[ok]] - frame[np.flatnonzero(ok)] <= gap)
        who = np.flatnonzero(ok[group])
        if not len(who):
            break
        target = there[group[who]] * (n + 2)
        begin, end = np.searchsorted(keys, target + low[who]), np.searchsorted(keys, target + high[who])
        ends = np.cumsum(end - begin)
        for at in range(0, int(ends[-1]), _COMPARED):
            k = np.arange(at, min(at + _COMPARED, int(ends[-1])))
            row = np.searchsorted(ends, k, side="right")
            i, j = who[row], begin[row] + k - (ends[row] - (end[row] - begin[row]))
            close = overlap(box[i], box[j]) >= min_iou
            left, right = np.r_[left, i[close]], np.r_[right, j[close]]
            if len(left) > _LINKS:
                value = components(n, left, right)
                left = np.flatnonzero(value != np.arange(n))
                right = value[left]
    return components(n, left, right)


def _local_runs(island: np.ndarray, frame: np.ndarray, det: np.ndarray, box: np.ndarray, gap: int, min_iou: float):
    """Rows sorted by island, frame and detection -> (order, starts): rows laid out by run and where the runs begin."""
    n = len(frame)
    laid = np.lexsort((box[:, 3], box[:, 2], box[:, 1], box[:, 0], frame, island))
    i_, f_, b_ = island[laid], frame[laid], box[laid]
    new_group = np.r_[True, (i_[1:] != i_[:-1]) | (f_[1:] != f_[:-1])]
    fresh = new_group | np.r_[True, (b_[1:] != b_[:-1]).any(axis=1)]  # equal boxes of a frame are compared once
    reps = np.flatnonzero(fresh)
    root = _linked((i_[reps], f_[reps]), (np.cumsum(new_group) - 1)[reps], b_[reps], gap, min_iou)
    of = np.cumsum(fresh) - 1
    # equal boxes are in one run if anything links them with another frame, else each is its own
    linked = np.bincount(root, minlength=len(reps))[root] > 1
    value_laid = np.where(linked[of], laid[reps[root[of]]], laid)
    value = np.empty(n, np.int64)
    value[laid] = value_laid
    order = np.lexsort((np.arange(n), value, island))
    key = row_number_difference(island[order], value[order])
    starts = np.flatnonzero(np.r_[True, (island[order][1:] != island[order][:-1]) | (key[1:] != key[:-1])])
    return order, starts


def _kernel(block_frames: int, gap: int, min_iou: float, least: int):
    def finish(t: pa.Table, island: np.ndarray):
        t_frame, t_det = t["frame_index"].to_numpy(), t["detection_id"].to_numpy()
        again = np.r_[False, (island[1:] == island[:-1]) & (t_frame[1:] == t_frame[:-1]) & (t_det[1:] == t_det[:-1])]
        if again.any():
            keep = np.flatnonzero(~again)
            t, island = t.take(keep), island[keep]
        frame, det = t["frame_index"].to_numpy(), t["detection_id"].to_numpy()
        ms = t["timestamp_ms"].cast(pa.float64()).to_numpy()
        box = np.column_stack([t[c].to_numpy() for c in ("x1", "y1", "x2", "y2")])
        order, starts = _local_runs(island, frame, det, box, gap, min_iou)
        ends = np.r_[starts[1:], len(order)] - 1
        size = ends - starts + 1
        offset = frame - np.floor_divide(frame, block_frames) * block_frames
        side = np.where(offset < gap, -1, 0) + np.where(offset >= block_frames - gap, 2, 0)  # -1 head, 2 tail, 1 both (tiny blocks)
        touches = np.add.reduceat((side[order] != 0).astype(np.int64), starts)
        kept = np.flatnonzero((size >= least) | (touches > 0))
        first, last = order[starts[kept]], order[ends[kept]]
        counts = touches[kept]
        edge = order[(side[order] != 0)]
        edges = pa.StructArray.from_arrays(
            [pa.array(side[edge], pa.int32()), pa.array(frame[edge]), *(pa.array(box[edge, k]) for k in range(4))], names=["side", "frame", "x1", "y1", "x2", "y2"]
        )
        offsets = pa.array(np.r_[0, np.cumsum(counts)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(t["video_id"].take(pa.array(first)).to_pylist(), pa.string()),
                pa.array(t["class_id"].to_numpy()[first], pa.int32()),
                pa.array(det[first], pa.int64()),
                pa.array(np.floor_divide(frame[first], block_frames), pa.int64()),
                pa.array(size[kept], pa.int64()),
                pa.array(frame[first], pa.int64()),
                pa.array(frame[last], pa.int64()),
                pa.array(det[first], pa.int64()),
                pa.array(det[last], pa.int64()),
                pa.array(ms[first], pa.float64(), from_pandas=True),
                pa.array(ms[last], pa.float64(), from_pandas=True),
                pa.ListArray.from_arrays(offsets, edges),
            ],
            names=["video_id", "class_id", "run_id", "block", "observations", "first_frame", "last_frame", "first_detection_id", "last_detection_id", "first_ms", "last_ms", "edge"],
        )

    def stream(batches):
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            t = new if held is None else pa.concat_tables([held, new]).combine_chunks()
            cuts = _cuts(t, block_frames, gap)
            last = int(np.flatnonzero(cuts)[-1])  # the first row is always a cut
            if last:
                island = np.cumsum(cuts[:last])
                yield finish(t.slice(0, last).combine_chunks(), island)
            held = t.slice(last)
        if held is not None:
            held = held.combine_chunks()
            yield finish(held, np.cumsum(_cuts(held, block_frames, gap)))

    return stream


def _cuts(t: pa.Table, block_frames: int, gap: int) -> np.ndarray:
    """Whether an island begins at each row."""
    n, frame = t.num_rows, t["frame_index"].to_numpy()
    differs = lambda c: pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy()
    block = np.floor_divide(frame, block_frames)
    begin = np.ones(n, bool)
    if n > 1:
        begin[1:] = differs(t["video_id"]) | differs(t["class_id"]) | (block[1:] != block[:-1]) | (frame[1:] - frame[:-1] > gap)
    return begin


def repeated_events(
    detections: DataFrame, *, gap: int = MAX_GAP, min_iou: float = MIN_IOU, block_frames: int = BLOCK_FRAMES, least: int = 1, settle: bool = False
) -> DataFrame:
    """One row per run: video_id, class_id, observations, first/last frame and detection id, duration_ms.

    Rows without video, class, frame or id, and rows whose box is null, has other than four coordinates or a null or NaN
    coordinate, are set aside. Rows that repeat a detection_id are one observation; with ``settle`` the earliest
    delivery (ingested_at, a null last) wins where deliveries differ in more than that, at the price of one more shuffle. Ties at the
    first or last frame go to the smaller or larger detection_id. ``least`` drops shorter runs. duration_ms is null
    where an end has no timestamp. Infinite coordinates overlap nothing. An empty table gives an empty result.
    """
    if block_frames < 2 * gap:
        raise ValueError("a block must hold at least twice the gap")
    box = F.col("bbox_xyxy_normalized")
    corners = ("x1", "y1", "x2", "y2")
    known = F.col("detection_id").isNotNull() & F.col("video_id").isNotNull() & F.col("frame_index").isNotNull() & F.col("class_id").isNotNull() & (F.size(box) == 4)
    rows = detections.where(known).select(
        F.col("detection_id").cast("long").alias("detection_id"), "video_id", F.col("class_id").cast("int").alias("class_id"), F.col("frame_index").cast("long").alias("frame_index"), F.col("timestamp_ms").cast("long").alias("timestamp_ms"),
        *(box[i].cast("double").alias(c) for i, c in enumerate(corners)), *(["ingested_at"] if settle else []),
    )
    for c in corners:
        rows = rows.where(F.col(c).isNotNull() & ~F.isnan(c))
    if settle:
        rest = [c for c in rows.columns if c not in ("detection_id", "ingested_at")]
        first = F.min(F.struct(F.col("ingested_at").isNull().alias("late"), "ingested_at", *rest))
        rows = rows.groupBy("detection_id").agg(first.alias("_r")).select("detection_id", *(f"_r.{c}" for c in rest))
    block = F.floor(F.col("frame_index") / F.lit(block_frames))
    laid = rows.repartition("video_id", "class_id", block).sortWithinPartitions("video_id", "class_id", "frame_index", "detection_id")
    local = cut(laid.mapInArrow(_kernel(block_frames, gap, min_iou, least), _LOCAL))

    ends = local.where(F.size("edge") > 0).select("video_id", "class_id", "run_id", "block", F.explode("edge").alias("e"))
    tail = ends.where("e.side > 0").select("video_id", "class_id", (F.col("block") + 1).alias("at"), F.col("run_id").alias("a"), F.col("e").alias("p"))
    head = ends.where("e.side < 2").select("video_id", "class_id", F.col("block").alias("at"), F.col("run_id").alias("b"), F.col("e").alias("q"))
    apart = F.col("q.frame") - F.col("p.frame")
    links = tail.join(head, ["video_id", "class_id", "at"]).where((apart >= 1) & (apart <= gap) & (_iou("p", "q") >= F.lit(float(min_iou))))
    roots = contract(links.select("a", "b"))
    keys = local.where(F.size("edge") > 0).join(roots.withColumnRenamed("vertex", "run_id"), "run_id", "left").withColumn("_key", F.coalesce("root", "run_id")).drop("root", "edge", "run_id", "block")
    joined = keys.groupBy("_key").agg(
        F.first("video_id").alias("video_id"), F.first("class_id").alias("class_id"), F.sum("observations").alias("observations"),
        F.min(F.struct("first_frame", "first_detection_id", "first_ms")).alias("f"), F.max(F.struct("last_frame", "last_detection_id", "last_ms")).alias("l"),
    )
    whole = local.where(F.size("edge") == 0).select("video_id", "class_id", "observations", F.struct("first_frame", "first_detection_id", "first_ms").alias("f"), F.struct("last_frame", "last_detection_id", "last_ms").alias("l"))
    return (
        whole.unionByName(joined.drop("_key"))
        .where(F.col("observations") >= least)
        .select("video_id", "class_id", "observations", "f.first_frame", "l.last_frame", "f.first_detection_id", "l.last_detection_id", (F.col("l.last_ms") - F.col("f.first_ms")).cast("long").alias("duration_ms"))
    )


def _iou(p: str, q: str):
    c = lambda s, k: F.col(f"{s}.{k}")
    w = F.greatest(F.least(c(p, "x2"), c(q, "x2")) - F.greatest(c(p, "x1"), c(q, "x1")), F.lit(0.0))
    h = F.greatest(F.least(c(p, "y2"), c(q, "y2")) - F.greatest(c(p, "y1"), c(q, "y1")), F.lit(0.0))
    area = lambda s: F.greatest(c(s, "x2") - c(s, "x1"), F.lit(0.0)) * F.greatest(c(s, "y2") - c(s, "y1"), F.lit(0.0))
    return F.coalesce(F.try_divide(w * h, area(p) + area(q) - w * h), F.lit(0.0))
