"""The temporal association on Structured Streaming: keyed state of open events, a row out when one closes.

Keys are (video_id, class_id). State holds scalars of the open events only, so it is bounded by the objects in view.
Expiry follows the frame index of what arrives, not the clock; a row with ``end`` true and the stream's last frame closes
what is open. Frames must arrive in rising order per key from one micro-batch to the next; inside one they are sorted. A
row that comes late (its frame was processed already) is dropped, as a watermark would.
"""

from __future__ import annotations

import json
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from detlake.operators.temporal import EVENT_COLUMNS, EVENT_SCHEMA, Associator, Rules, event_row

#: What a streamed row must have.
INPUT_COLUMNS = ("video_id", "class_id", "frame_index", "detection_index", "timestamp_ms", "confidence", "area", "pixels", "x1", "y1", "x2", "y2", "fps", "end")


def stream_events(observations: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Closed events of a streaming (or static) DataFrame of observations, in append mode."""

    def step(key, batches, state: GroupState):
        frame_seen, kept = state.get if state.exists else (-1, "[]")
        rows = pd.concat(list(batches)).sort_values(["frame_index", "end", "detection_index"], kind="stable")
        machine = Associator(rules, rules.gap_frames(float(rows["fps"].iloc[0])), json.loads(kept))
        out = []
        for frame, part in groupby(rows.itertuples(index=False), key=lambda r: int(r.frame_index)):
            those, ended = [], False
            for r in part:
                ended |= bool(r.end)
                if not r.end and (not those or those[-1].detection_index != r.detection_index):
                    those.append(r)
            if frame > frame_seen:
                out += machine.frame(frame, those)[0]
                frame_seen = frame
            if ended:
                out += machine.events
                machine.events = []
        state.update((frame_seen, json.dumps(machine.events)))
        if out:
            yield pd.DataFrame([event_row(key, e, rules) for e in out], columns=EVENT_COLUMNS)

    wanted = observations.select(*INPUT_COLUMNS)
    return wanted.groupBy("video_id", "class_id").applyInPandasWithState(step, EVENT_SCHEMA, "frame long, events string", "append", GroupStateTimeout.NoTimeout)


def running_counts(observations: DataFrame) -> DataFrame:
    """Detections per video and class so far (complete or update mode)."""
    from pyspark.sql import functions as F

    return observations.groupBy("video_id", "class_id").agg(F.count("*").alias("detections"), F.max("frame_index").alias("last_frame"))


def sealed_sink(path: str):
    """A ``foreachBatch`` function that writes each batch once, by number, so a retried batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:010d}")

    return write
