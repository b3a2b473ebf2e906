"""Identifiers, digests, time codes and other scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(prefix: str, *parts: Column, length: int = 16) -> Column:
    """prefix_ and the first hex digits of the SHA-256 of the parts joined by a zero character."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("\0", *(p.cast("string") for p in parts)), 256), 1, length))


def seeded_rank(seed, *parts: Column) -> Column:
    """Hash order of a seeded selection: SHA-256 of ``seed:part:...``."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts)), 256)


def stem(filename: Column) -> Column:
    """File name without folders and its last extension."""
    return F.regexp_replace(F.regexp_replace(filename, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def filename_prefix(filename: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(stem(filename), r"^(.*?)(\d+)$", 1), F.lit("")), F.regexp_replace(stem(filename), r"\d+$", ""))


def filename_number(filename: Column) -> Column:
    """Trailing number of the stem, null if there is none (or it exceeds 18 digits)."""
    digits = F.regexp_extract(stem(filename), r"(\d+)$", 1)
    return F.when((digits != "") & (F.length(digits) <= 18), digits.cast("long"))


def frame_ms(frame: Column, fps: Column) -> Column:
    """Milliseconds of a frame, ties to even."""
    return F.bround(frame.cast("double") * 1000 / fps).cast("long")


def frame_at(seconds: Column, fps: Column) -> Column:
    return F.bround(seconds.cast("double") * fps).cast("long")


def parse_clock(value: Column) -> Column:
    """HH:MM:SS[.fff] to seconds; null if malformed or minutes or seconds reach 60."""
    ok = value.rlike(r"^\d+:\d{1,2}:\d{1,2}(\.\d+)?$")
    part = lambda i: F.split(value, ":")[i]
    h, m, s = (F.when(ok, part(i).try_cast("double")) for i in range(3))
    return F.when((m < 60) & (s < 60), h * 3600 + m * 60 + s)


def format_clock(seconds: Column) -> Column:
    """Seconds to HH:MM:SS.mmm, milliseconds rounded half to even."""
    ms = F.bround(seconds.cast("double") * 1000).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours = F.floor(ms / 3_600_000)
    return F.concat(F.when(hours < 10, F.lpad(hours.cast("string"), 2, "0")).otherwise(hours.cast("string")), F.lit(":"), two(F.floor(ms / 60_000) % 60), F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hex64(value: Column) -> Column:
    """16 hexadecimal digits as a signed 64-bit number."""
    return F.conv(value, 16, -10).cast("long")


def ordered_digest(lines: Column, order: Column) -> Column:
    """Aggregate: SHA-256 over lines, each ended by a line feed, in the given order (ties by line)."""
    pairs = F.sort_array(F.collect_list(F.struct(order.alias("o"), lines.alias("l"))))
    return F.sha2(F.concat(F.array_join(F.transform(pairs, lambda p: p["l"]), "\n"), F.lit("\n")), 256)


def image_format(content: Column) -> Column:
    """Format by the leading bytes of a binary column."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("424D"), "bmp").when(head.startswith("52494646"), "riff").otherwise("unknown")


def batches(n: Column, size: Column) -> Column:
    """Ceiling division of whole numbers (sheets of a grid, batches of an epoch)."""
    return F.floor((n + size - 1) / size).cast("long")


class ParameterError(ValueError):
    """A parameter outside its domain."""


def require(condition: bool, message: str) -> None:
    if not condition:
        raise ParameterError(message)
