"""Events of a video: same-class detections associated frame by frame.

The association is a sequential fold, so the work is cut where its state is empty: a pause of more than the largest gap
ends every event of a (video, class), and what follows (an island) is independent. Islands are found by windows over blocks
of frames plus one row a block, never by ordering a whole video in one task, and each is folded by a kernel that keeps
scalars only. ``streaming.events`` runs the same kernel on keyed state.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from detlake.operators import ordered
from detlake.operators.metrics import spine

BLOCK_FRAMES = 4096


@dataclass(frozen=True)
class Rules:
    """Thresholds of the association and of an event's confirmation."""

    min_iou: float = 0.3
    max_distance: float = 0.1
    min_area_ratio: float = 0.4
    max_gap_seconds: float = 0.2
    confirmed_at: int = 3

    def __post_init__(self):
        if not (0 <= self.min_iou <= 1 and 0 <= self.min_area_ratio <= 1 and self.max_distance >= 0 and self.max_gap_seconds >= 0 and self.confirmed_at >= 1):
            raise ValueError("association thresholds outside their domain")

    def gap_frames(self, fps: float) -> int:
        if not (math.isfinite(fps) and fps > 0):
            raise ValueError("fps must be finite and positive")
        return max(0, math.floor(self.max_gap_seconds * fps + 1e-9))


#: Fields of an open event, in the order in which state stores keep them.
STATE = (
    "first_frame", "first_index", "first_ms", "last_frame", "last_ms", "count", "confidence_sum", "max_confidence", "area_sum", "max_area", "max_pixels",
    "x1", "y1", "x2", "y2", "rep_confidence", "rep_area", "rep_frame", "rep_index", "rep_ms", "by_iou", "by_center",
)
EVENT_SCHEMA = (
    "video_id string, class_id int, first_frame long, first_index int, last_frame long, first_timestamp_ms long, last_timestamp_ms long, observation_count long, mean_confidence double, "
    "max_confidence double, mean_relative_area double, max_relative_area double, max_area_pixels double, representative_frame long, representative_timestamp_ms long, "
    "iou_matches long, center_matches long, status string"
)


def _measures(e: dict, o) -> tuple[float, float, float]:
    w = min(e["x2"], o.x2) - max(e["x1"], o.x1)
    h = min(e["y2"], o.y2) - max(e["y1"], o.y1)
    both = max(w, 0.0) * max(h, 0.0)
    a = max(e["x2"] - e["x1"], 0.0) * max(e["y2"] - e["y1"], 0.0)
    b = max(o.x2 - o.x1, 0.0) * max(o.y2 - o.y1, 0.0)
    union, big = a + b - both, max(a, b)
    distance = math.hypot((e["x1"] + e["x2"]) / 2 - (o.x1 + o.x2) / 2, (e["y1"] + e["y2"]) / 2 - (o.y1 + o.y2) / 2)
    return (both / union if union > 0 else 0.0), distance, (min(a, b) / big if big else 0.0)


class Associator:
    """Open events of one (video, class); feed frames in rising order."""

    def __init__(self, rules: Rules, gap: int, events: list[dict] | None = None):
        self.rules, self.gap, self.events = rules, gap, events or []

    def expire(self, frame: int) -> list[dict]:
        """Close and return the events that a frame is too late for."""
        gone = [e for e in self.events if frame - e["last_frame"] - 1 > self.gap]
        if gone:
            self.events = [e for e in self.events if frame - e["last_frame"] - 1 <= self.gap]
        return gone

    def frame(self, frame: int, observations: list) -> tuple[list[dict], list[tuple]]:
        """Closed events, and per observation (observation, event, type, iou, distance, area ratio)."""
        closed = self.expire(frame)
        edges = []
        for n, e in enumerate(self.events):
            for k, o in enumerate(observations):
                iou, distance, ratio = _measures(e, o)
                by_iou = iou >= self.rules.min_iou
                if by_iou or (distance <= self.rules.max_distance and ratio >= self.rules.min_area_ratio):
                    edges.append(((-iou, distance, -ratio, e["first_frame"], e["first_index"], o.detection_index), n, k, by_iou))
        taken_events, taken, decisions = set(), {}, []
        for (iou, distance, ratio, *_), n, k, by_iou in sorted(edges):
            if n not in taken_events and k not in taken:
                taken_events.add(n)
                taken[k] = (n, by_iou, -iou, distance, -ratio)
        for k, o in enumerate(observations):
            if k in taken:
                n, by_iou, iou, distance, ratio = taken[k]
                e = self.events[n]
                self._extend(e, o, by_iou)
                decisions.append((o, e, "matched_iou" if by_iou else "matched_center_scale", iou, distance, ratio))
            else:
                e = self._open(o)
                self.events.append(e)
                decisions.append((o, e, "new_event", None, None, None))
        return closed, decisions

    @staticmethod
    def _open(o) -> dict:
        return dict(zip(STATE, (
            int(o.frame_index), int(o.detection_index), int(o.timestamp_ms), int(o.frame_index), int(o.timestamp_ms), 1, o.confidence, o.confidence, o.area, o.area, o.pixels,
            o.x1, o.y1, o.x2, o.y2, o.confidence, o.area, int(o.frame_index), int(o.detection_index), int(o.timestamp_ms), 0, 0,
        )))

    @staticmethod
    def _extend(e: dict, o, by_iou: bool) -> None:
        better = (-o.confidence, -o.area, o.frame_index, o.detection_index) < (-e["rep_confidence"], -e["rep_area"], e["rep_frame"], e["rep_index"])
        e["last_frame"], e["last_ms"] = int(o.frame_index), int(o.timestamp_ms)
        e["count"] += 1
        e["confidence_sum"] += o.confidence
        e["area_sum"] += o.area
        for field, value in (("max_confidence", o.confidence), ("max_area", o.area), ("max_pixels", o.pixels)):
            e[field] = max(e[field], value)
        e["x1"], e["y1"], e["x2"], e["y2"] = o.x1, o.y1, o.x2, o.y2
        e["by_iou" if by_iou else "by_center"] += 1
        if better:
            e["rep_confidence"], e["rep_area"], e["rep_frame"], e["rep_index"], e["rep_ms"] = o.confidence, o.area, int(o.frame_index), int(o.detection_index), int(o.timestamp_ms)


def event_row(key: tuple, e: dict, rules: Rules) -> tuple:
    """A closed event in the order of EVENT_SCHEMA."""
    return (
        *key, e["first_frame"], e["first_index"], e["last_frame"], e["first_ms"], e["last_ms"], e["count"], e["confidence_sum"] / e["count"], e["max_confidence"], e["area_sum"] / e["count"],
        e["max_area"], e["max_pixels"], e["rep_frame"], e["rep_ms"], e["by_iou"], e["by_center"], "confirmed" if e["count"] >= rules.confirmed_at else "tentative",
    )


EVENT_COLUMNS = [c.split()[0] for c in EVENT_SCHEMA.split(", ")]


def observations(detections: DataFrame, videos: DataFrame, default_fps: float = 10.0) -> DataFrame:
    """Valid observations, each detection once (the first delivery), with the video's frame rate.

    Valid: known video, class 0..3, frame and index; confidence and relative area in 0..1; a finite box with ordered
    corners within 0..1. Rows that agree in video, class, frame and index are one observation: that of the smallest id, and of
    its deliveries the earliest. A delivery that names another video, class, frame or index is an observation of its own.
    """
    b = F.col("bbox_xyxy_normalized")
    fps = videos.where(F.col("video_id").isNotNull()).groupBy("video_id").agg(F.max("fps").alias("fps"))
    d = detections.select(
        "detection_id", "video_id", F.col("class_id").cast("int").alias("class_id"), "frame_index", F.col("detection_index").cast("int").alias("detection_index"), "timestamp_ms", "confidence",
        F.col("bbox_relative_area").alias("area"), F.coalesce(F.when(F.abs("bbox_area_pixels") < 1e18, F.col("bbox_area_pixels")), F.lit(0.0)).alias("pixels"), *(b[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))), "ingested_at",
    )
    unit = lambda c: F.col(c).between(0, 1)
    ok = F.col("class_id").between(0, 3) & (F.col("frame_index") >= 0) & F.col("detection_index").isNotNull() & F.col("timestamp_ms").isNotNull() & F.col("detection_id").isNotNull() & F.col("video_id").isNotNull()
    for c in ("confidence", "area", "x1", "y1", "x2", "y2"):
        ok = ok & unit(c)
    d = d.where(ok & (F.col("x1") <= F.col("x2")) & (F.col("y1") <= F.col("y2")))
    # the key of a delivery holds its video and frame, so one shuffle serves both kinds of repetition
    key = W.partitionBy("video_id", "class_id", "frame_index").orderBy("detection_index", "detection_id", "ingested_at")
    d = d.withColumn("_p", F.lag("detection_index").over(key)).where("_p IS NULL OR _p <> detection_index").drop("_p", "ingested_at")
    return d.join(fps, "video_id", "left").withColumn("fps", F.coalesce(F.when(F.col("fps") > 0, F.col("fps")), F.lit(float(default_fps))))


def islands(rows: DataFrame, gap_frames, block_frames: int = BLOCK_FRAMES) -> DataFrame:
    """Add ``island``: first frame of the stretch of (video_id, class_id) without a pause of more than ``gap_frames`` (a column)."""
    rows = rows.withColumn("_gap", gap_frames)
    found = ordered.runs(rows, ["video_id", "class_id"], "frame_index", ["detection_index"], lambda before, now: now - before - 1 > F.col("_gap"), block_frames, by=["_gap"])
    return found.withColumnRenamed("run_start", "island").drop("_gap", "run")


def _laid(obs: DataFrame, rules: Rules) -> DataFrame:
    gap = F.floor(F.lit(rules.max_gap_seconds) * F.col("fps") + 1e-9)
    cols = ["video_id", "class_id", "island", "frame_index", "detection_index", "detection_id", "timestamp_ms", "confidence", "area", "pixels", "x1", "y1", "x2", "y2", "fps"]
    return islands(obs, gap).select(*cols).repartition("video_id", "class_id", "island").sortWithinPartitions(*cols[:6])


def _frames(batches):
    """(key with island, frame, observations) from sorted batches; rows of a frame may straddle batches."""
    rows = (r for pdf in batches for r in pdf.itertuples(index=False))
    for key, part in groupby(rows, key=lambda r: (r.video_id, r.class_id, r.island)):
        for frame, those in groupby(part, key=lambda r: r.frame_index):
            yield key, frame, list(those)


def events(obs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per event in EVENT_SCHEMA."""

    def run(batches):
        key, state, out = None, None, []
        for k, frame, those in _frames(batches):
            if k != key:
                if state:
                    out += [event_row(key[:2], e, rules) for e in state.events]
                key, state = k, Associator(rules, rules.gap_frames(those[0].fps))
            closed, _ = state.frame(frame, those)
            out += [event_row(key[:2], e, rules) for e in closed]
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=EVENT_COLUMNS)
                out = []
        if state:
            out += [event_row(key[:2], e, rules) for e in state.events]
        if out:
            yield pd.DataFrame(out, columns=EVENT_COLUMNS)

    return _laid(obs, rules).mapInPandas(run, EVENT_SCHEMA)


ASSOCIATION_SCHEMA = "video_id string, class_id int, frame_index long, detection_index int, detection_id long, association string, iou_with_previous double, center_distance double, area_ratio double, event_first_frame long, event_first_index int"


def associations(obs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per observation: how it was associated and with which event (named by its first observation)."""
    names = [c.split()[0] for c in ASSOCIATION_SCHEMA.split(", ")]

    def run(batches):
        key, state, out = None, None, []
        for k, frame, those in _frames(batches):
            if k != key:
                key, state = k, Associator(rules, rules.gap_frames(those[0].fps))
            for o, e, kind, iou, distance, ratio in state.frame(frame, those)[1]:
                out.append((*k[:2], frame, o.detection_index, o.detection_id, kind, iou, distance, ratio, e["first_frame"], e["first_index"]))
            if len(out) >= 20_000:
                yield pd.DataFrame(out, columns=names).astype({"iou_with_previous": float, "center_distance": float, "area_ratio": float})
                out = []
        if out:
            yield pd.DataFrame(out, columns=names).astype({"iou_with_previous": float, "center_distance": float, "area_ratio": float})

    return _laid(obs, rules).mapInPandas(run, ASSOCIATION_SCHEMA)


def finished(found: DataFrame, last_frames: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Events with their number in the video, identifier, duration and the reason why they ended.

    ``last_frames`` (video_id, last_frame, fps) says where each stream ends, detections or not.
    """
    gap = F.floor(F.lit(rules.max_gap_seconds) * F.col("fps") + 1e-9)
    late = F.col("_last") - F.col("last_frame") - 1 > gap
    ends = last_frames.select("video_id", F.col("last_frame").alias("_last"), "fps")
    out = ordered.numbered(found, ["video_id"], "first_frame", ["first_index", "class_id"], BLOCK_FRAMES, "sequence").join(ends, "video_id", "left")
    return out.select(
        F.format_string("RD%04d", "sequence").alias("event_id"), *found.columns, ((F.col("last_timestamp_ms") - F.col("first_timestamp_ms")) / 1000).alias("duration_seconds"),
        F.when(late, "maximum_temporal_gap_exceeded").otherwise("processing_scope_ended").alias("finalized_reason"),
    )


def stream_ends(obs: DataFrame, videos: DataFrame) -> DataFrame:
    """(video_id, last_frame, fps): the frame count less one where it is known, else the last observed frame."""
    known = videos.where("video_id IS NOT NULL AND frame_count > 0").groupBy("video_id").agg((F.max("frame_count") - 1).alias("k"))
    seen = obs.groupBy("video_id").agg(F.max("frame_index").alias("s"), F.max("fps").alias("fps"))
    return seen.join(known, "video_id", "left").select("video_id", F.greatest("k", "s").alias("last_frame"), "fps")


def status_counts(found: DataFrame) -> DataFrame:
    """(class_id, status, events) with a row for every class and status."""
    from detlake.operators.metrics import spine

    statuses = F.array(F.lit("confirmed"), F.lit("tentative"))
    grid = spine(found.sparkSession).select("class_id", F.explode(statuses).alias("status"))
    return grid.join(found.groupBy("class_id", "status").agg(F.count("*").alias("events")), ["class_id", "status"], "left").na.fill(0, ["events"])


def sessions(rows: DataFrame, gap_frames: int) -> DataFrame:
    """Geometry-free events: (video_id, class_id, island, first_frame, last_frame, observations) by pauses alone."""
    return islands(rows, F.lit(gap_frames)).groupBy("video_id", "class_id", "island").agg(F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"), F.count("*").alias("observations"))
