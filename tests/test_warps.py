"""Warps and oriented gradients on odd images."""

import numpy as np
from pyspark.sql import functions as F

from tesserae.functions.oriented import oriented
from tesserae.operators import warps

SCHEMA = "id long, height int, width int, px array<int>, r int"


def test_warps_of_odd_images(spark):
    rng = np.random.default_rng(0)
    full = [int(v) for v in rng.integers(0, 256, 35)]
    df = spark.createDataFrame([(0, 5, 7, full, 9), (1, 1, 1, [7], 9), (2, 0, 0, [], 9), (3, 2, 2, None, 9)], SCHEMA)
    still = {r.id: r.px for r in warps.rotated(df, F.lit(0.0)).collect()}
    assert still == {0: full, 1: [7], 2: [], 3: None}
    half = {r.id: r for r in warps.rotated(df, F.lit(180.0)).collect()}
    img = np.array(full).reshape(5, 7)
    assert half[0].px == img[::-1, ::-1].ravel().tolist() and half[0].r == 9
    assert {r.id: r.px for r in warps.bulged(df, F.lit(0.0)).collect()}[0] == full
    draws = [r.a for r in spark.range(200).select(warps.drawn("id", 7, -15.0, 15.0).alias("a")).collect()]
    assert -15 <= min(draws) < -10 and 10 < max(draws) < 15


def test_oriented_gradients_of_odd_images(spark):
    ramp = [10 * c for _ in range(16) for c in range(16)]
    df = spark.createDataFrame([(0, 16, 16, ramp, 1), (1, 16, 16, [5] * 256, 1), (2, 5, 5, [1] * 25, 1), (3, 16, 16, None, 1)], SCHEMA)
    for dealt in (False, True):
        got = {r.id: r.v for r in df.select("id", oriented(F.col("px"), F.col("height"), F.col("width"), dealt=dealt).alias("v")).collect()}
        assert len(got[0]) == 36 and set(got[1]) == {0.0} and got[2] == [] and got[3] is None
        some = np.flatnonzero(got[0])
        # all gradients point along the row, so bin 0 has them, or shares them with the last
        assert set(some % 9) == ({0, 8} if dealt else {0}) and abs(np.linalg.norm(got[0]) - 1) < 1e-3
