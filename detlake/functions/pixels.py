"""Image measures over arrays of gray values (rows one after the other) and over raw file bytes.

Decoding pictures is not the engine's business: whoever decodes supplies gray arrays. All measures but the EXIF walk are
column expressions.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dhash(gray: Column) -> Column:
    """64-bit difference hash of 9 x 8 gray values as 16 hex digits: a bit is set where a value exceeds its left neighbour."""
    bit = lambda i: (F.get(gray, F.lit(9 * (i // 8) + i % 8 + 1)) > F.get(gray, F.lit(9 * (i // 8) + i % 8))).cast("long")
    words = []
    for half in (0, 32):
        word = F.lit(0).cast("long")
        for i in range(half, half + 32):
            word = F.shiftleft(word, 1).bitwiseOR(bit(i))
        words.append(F.lpad(F.lower(F.hex(word)), 8, "0"))
    return F.when(F.size(gray) == 72, F.concat(*words))


def brightness(gray: Column) -> Column:
    return F.try_divide(F.aggregate(gray, F.lit(0.0), lambda s, x: s + x), F.size(gray))


def spread_of(gray: Column) -> Column:
    """Population standard deviation."""
    return F.sqrt(F.try_divide(F.aggregate(gray, F.lit(0.0), lambda s, x: s + (x - brightness(gray)) * (x - brightness(gray))), F.size(gray)))


def laplacian_variance(gray: Column, width: int, height: int) -> Column:
    """Variance of the 4-neighbour Laplacian over inner pixels: a measure of sharpness."""
    inner = F.array(*(F.lit(y * width + x) for y in range(1, height - 1) for x in range(1, width - 1)))
    at = lambda i: F.get(gray, i).cast("double")
    values = F.transform(inner, lambda i: at(i - 1) + at(i + 1) + at(i - F.lit(width)) + at(i + F.lit(width)) - F.lit(4.0) * at(i))
    n = F.lit(float((width - 2) * (height - 2)))
    total, square = (F.aggregate(values, F.lit(0.0), f) for f in (lambda s, v: s + v, lambda s, v: s + v * v))
    return square / n - (total / n) * (total / n)


def masked(gray: Column, mask: Column) -> Column:
    """Values where the mask (an array of booleans) is set."""
    return F.filter(gray, lambda _, i: F.get(mask, i))


def mean_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of equally long arrays, null if lengths differ or either is missing."""
    return F.when(F.size(a) == F.size(b), F.try_divide(F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x), F.size(a)))


def in_polygon(x: Column, y: Column, points: list[tuple[float, float]]) -> Column:
    """Whether a point is inside a polygon, by crossings of a ray to the right."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1]):
        if y1 != y2:
            straddles = (F.lit(y1) > y) != (F.lit(y2) > y)
            crossings = crossings + F.when(straddles & (x < (y - F.lit(y1)) * F.lit((x2 - x1) / (y2 - y1)) + F.lit(x1)), 1).otherwise(0)
    return crossings % 2 == 1


#: EXIF tags.
DATE_TAKEN, DATE_MODIFIED, OFFSET_TAKEN, SUBSECONDS, EXIF_IFD = 0x9003, 0x0132, 0x9011, 0x9291, 0x8769


def exif_fields(data: bytes | None) -> dict[int, str]:
    """Text tags of a JPEG's EXIF block; empty for anything else, whatever is wrong with it."""
    out: dict[int, str] = {}
    try:
        if not data or data[:2] != b"\xff\xd8":
            return out
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
            size = struct.unpack(">H", data[at + 2 : at + 4])[0]
            block = data[at + 4 : at + 2 + size]
            if data[at + 1] == 0xE1 and block[:6] == b"Exif\0\0":
                tiff = block[6:]
                order = {b"II": "<", b"MM": ">"}[tiff[:2]]
                todo = [struct.unpack(order + "I", tiff[4:8])[0]]
                for _ in range(8):  # directories may point at each other
                    if not todo:
                        break
                    start = todo.pop()
                    for n in range(struct.unpack(order + "H", tiff[start : start + 2])[0]):
                        entry = tiff[start + 2 + 12 * n : start + 14 + 12 * n]
                        tag, kind, count = struct.unpack(order + "HHI", entry[:8])
                        if tag == EXIF_IFD:
                            todo.append(struct.unpack(order + "I", entry[8:])[0])
                        elif kind == 2:
                            where = entry[8 : 8 + count] if count <= 4 else tiff[(o := struct.unpack(order + "I", entry[8:])[0]) : o + count]
                            out[tag] = where.split(b"\0")[0].decode("ascii", "replace").strip()
            at += 2 + size
    except (struct.error, KeyError, IndexError):
        pass
    return out


def _exif(content: pd.Series) -> pd.DataFrame:
    rows = [exif_fields(bytes(c) if c is not None else None) for c in content]
    return pd.DataFrame({"taken": [r.get(DATE_TAKEN) or r.get(DATE_MODIFIED) for r in rows], "offset": [r.get(OFFSET_TAKEN) for r in rows], "subseconds": [r.get(SUBSECONDS) for r in rows]})


def exif_ms(content: Column) -> Column:
    """Milliseconds of the time a JPEG was taken, its offset honoured, else null."""
    e = F.pandas_udf(_exif, "taken string, offset string, subseconds string")(content)
    local = F.try_to_timestamp(e["taken"], F.lit("yyyy:MM:dd HH:mm:ss"))
    ok = e["offset"].rlike(r"^[+-]\d{2}:\d{2}$")
    minutes = F.when(ok, F.substring(e["offset"], 2, 2).try_cast("int") * 60 + F.substring(e["offset"], 5, 2).try_cast("int")).otherwise(0)
    sign = F.when(e["offset"].startswith("-"), -1).otherwise(1)
    return F.unix_millis(local) - sign * minutes * 60_000
