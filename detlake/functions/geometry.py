"""Box arithmetic as column expressions, all inside code generation.

A box is four columns ``<prefix>x1, <prefix>y1, <prefix>x2, <prefix>y2``. Two families differ on purpose: evaluation boxes
have positive area and aren't clamped, tracked boxes may be degenerate and are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def intersection(p, q) -> Column:
    w = F.greatest(F.least(p[2], q[2]) - F.greatest(p[0], q[0]), F.lit(0.0))
    h = F.greatest(F.least(p[3], q[3]) - F.greatest(p[1], q[1]), F.lit(0.0))
    return w * h


def area(p) -> Column:
    return (p[2] - p[0]) * (p[3] - p[1])


def clamped_area(p) -> Column:
    return F.greatest(p[2] - p[0], F.lit(0.0)) * F.greatest(p[3] - p[1], F.lit(0.0))


def iou(p, q) -> Column:
    """Intersection over union in continuous coordinates, 0 where the union is 0."""
    both = intersection(p, q)
    return ratio(both, area(p) + area(q) - both)


def tracked_iou(p, q) -> Column:
    """As ``iou`` with degenerate boxes counting as empty."""
    both = intersection(p, q)
    return ratio(both, clamped_area(p) + clamped_area(q) - both)


def center_distance(p, q) -> Column:
    return F.hypot((p[0] + p[2]) / 2 - (q[0] + q[2]) / 2, (p[1] + p[3]) / 2 - (q[1] + q[3]) / 2)


def area_ratio(p, q) -> Column:
    """Smaller over larger area, 0 if both are degenerate."""
    return ratio(F.least(clamped_area(p), clamped_area(q)), F.greatest(clamped_area(p), clamped_area(q)))


def relative_area(p, width: Column, height: Column) -> Column:
    return area(p) / (width * height)


def aspect_ratio(p) -> Column:
    return (p[2] - p[0]) / (p[3] - p[1])


def bucket(value: Column, definitions) -> Column:
    """Name of the first half-open bucket (name, low, high) that holds the value, else null (an invariant to check)."""
    out = F.lit(None).cast("string")
    for name, low, high in reversed(definitions):
        out = F.when((value >= F.lit(float(low))) & (value < F.lit(float(high))), F.lit(name)).otherwise(out)
    return out


def to_center_size(p, width: Column, height: Column) -> Column:
    """Pixel corners to normalised (cx, cy, w, h); null unless the box is finite, positive and inside the image."""
    inside = (p[0] >= 0) & (p[1] >= 0) & (p[2] <= width) & (p[3] <= height) & (p[2] > p[0]) & (p[3] > p[1]) & (width > 0) & (height > 0)
    return F.when(inside, F.struct((((p[0] + p[2]) / 2) / width).alias("cx"), (((p[1] + p[3]) / 2) / height).alias("cy"), ((p[2] - p[0]) / width).alias("w"), ((p[3] - p[1]) / height).alias("h")))


def from_center_size(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column, slack: float = 1e-4):
    """Normalised centre and size to pixel corners, clipped where they leave the image by at most ``slack`` pixels' share."""
    def clip(v: Column, most: Column) -> Column:
        return F.when((v < 0) & (v >= -slack * most), F.lit(0.0)).when((v > most) & (v <= most * (1 + slack)), most.cast("double")).otherwise(v)

    return (clip((cx - w / 2) * width, width), clip((cy - h / 2) * height, height), clip((cx + w / 2) * width, width), clip((cy + h / 2) * height, height))
