import struct

import numpy as np
from pyspark.sql import functions as F

from detlake.functions import pixels


def test_gray_measures(spark):
    rng = np.random.default_rng(1)
    g = rng.integers(0, 256, (8, 9))
    df = spark.createDataFrame([(g.ravel().tolist(), (g.ravel() // 2).tolist(), [True, False] * 36)], "a array<int>, b array<int>, m array<boolean>")
    r = df.select(pixels.dhash(F.col("a")), pixels.brightness(F.col("a")), pixels.spread_of(F.col("a")), pixels.laplacian_variance(F.col("a"), 9, 8), pixels.mean_difference(F.col("a"), F.col("b")), pixels.brightness(pixels.masked(F.col("a"), F.col("m")))).first()
    bits = (g[:, 1:] > g[:, :-1]).ravel()
    assert r[0] == f"{int(''.join('01'[b] for b in bits.tolist()), 2):016x}"
    lap = (g[1:-1, :-2] + g[1:-1, 2:] + g[:-2, 1:-1] + g[2:, 1:-1] - 4 * g[1:-1, 1:-1]).astype(float)
    assert np.allclose(r[1:], [g.mean(), g.std(), lap.var(), np.abs(g - g // 2).mean(), g.ravel()[::2].mean()])
    none = spark.createDataFrame([(None, [1]), ([], [])], "a array<int>, b array<int>")
    assert [tuple(x) for x in none.select(pixels.dhash(F.col("a")), pixels.brightness(F.col("a")), pixels.mean_difference(F.col("a"), F.col("b"))).collect()] == [(None, None, None)] * 2


def test_polygon(spark):
    df = spark.createDataFrame([(0.5, 0.5), (1.5, 0.5), (0.9, 0.95)], "x double, y double")
    assert [r[0] for r in df.select(pixels.in_polygon(F.col("x"), F.col("y"), [(0.0, 0.0), (1.0, 0.0), (1.0, 0.8), (0.0, 1.0)])).collect()] == [True, False, False]


def jpeg(order: str, tags: dict[int, bytes]) -> bytes:
    body, extra, base = b"", b"", 8 + 2 + 12 * len(tags) + 4
    for tag, text in tags.items():
        body += struct.pack(order + "HHII", tag, 2, len(text), base + len(extra))
        extra += text
    tiff = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", len(tags)) + body + b"\0" * 4 + extra
    block = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(block) + 2) + block + b"\xff\xda"


def test_exif(spark):
    taken = {pixels.DATE_TAKEN: b"2024:01:02 03:04:05\0"}
    files = [jpeg("<", taken), jpeg(">", taken | {pixels.OFFSET_TAKEN: b"+09:00\0"}), jpeg("<", {pixels.DATE_MODIFIED: b"not a date\0\0\0"}), b"\xff\xd8\xff\xe1\x00", b"text", None]
    df = spark.createDataFrame([(n, f) for n, f in enumerate(files)], "n int, content binary")
    base = 1704164645000
    assert [r[0] for r in df.orderBy("n").select(pixels.exif_ms(F.col("content"))).collect()] == [base, base - 9 * 3_600_000, None, None, None, None]
