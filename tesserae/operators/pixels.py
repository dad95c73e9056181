"""Pixel statistics as DataFrame operations.

An image is a row (id, height, width, px) with px an array of gray values in row order. Neighbours are read from the row's own
array by index, so counting needs no self-join; counts are made per task before the shuffle, with one row for each image and bin.
Edges are mirrored without repeating the edge pixel, except for co-occurrence (pairs inside only) and local patterns (0 outside).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANGLES = (0.0, math.pi / 4, math.pi / 2, 3 * math.pi / 4)
#: Pixel offsets (row, column) of the four angles at distance 1; at distance 2 the diagonals round to the same, as sin and cos do.
PROPERTIES = ("contrast", "dissimilarity", "homogeneity", "energy", "correlation")


def offset(distance: int, angle: float) -> tuple[int, int]:
    return round(math.sin(angle) * distance), round(math.cos(angle) * distance)


def _mirror(k: Column, size: Column) -> Column:
    k = F.when(k < 0, -k).otherwise(k)
    return F.when(k >= size, 2 * size - 2 - k).otherwise(k)


def _places(images: DataFrame) -> DataFrame:
    return images.select("*", F.explode(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)).alias("i")).withColumns({"r": F.floor(F.col("i") / F.col("width")).cast("int"), "c": (F.col("i") % F.col("width")).cast("int")})


def _at(r: Column, c: Column) -> Column:
    return F.get("px", (r * F.col("width") + c).cast("int"))


def bin_of(x: Column, bins: int, low: float, high: float) -> Column:
    """The bin of x in [low, high]; the last one holds its right edge; null outside."""
    width = (high - low) / bins
    return F.when((x >= low) & (x <= high), F.least(F.floor((x - low) / width), F.lit(bins - 1)))


def shares(values: DataFrame, bins: int, low: float, high: float) -> DataFrame:
    """id, bin, share of values (id, x); values outside the range leave the denominator; all bins stand, zeros too."""
    counted = values.withColumn("bin", bin_of(F.col("x"), bins, low, high)).groupBy("id").agg(*(F.count_if(F.col("bin") == k).alias(f"b{k}") for k in range(bins)))
    all_ = F.array(*(F.col(f"b{k}") for k in range(bins)))
    total = F.aggregate(all_, F.lit(0).cast("long"), lambda a, b: a + b)
    return counted.select("id", F.posexplode(F.transform(all_, lambda n: F.when(total > 0, n / total).otherwise(F.lit(0.0)))).alias("bin", "share"))


def histogram(images: DataFrame, bins: int = 16, low: float = 0, high: float = 256) -> DataFrame:
    return shares(images.select("id", F.explode("px").alias("x")), bins, low, high)


def moments(images: DataFrame) -> DataFrame:
    """id, mean, sd (population), skew (0 if the deviation is 1e-6 at most)."""
    x = images.select("id", F.explode("px").alias("x")).withColumn("x", F.col("x").cast("double"))
    m = x.groupBy("id").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.skewness("x").alias("skew"))
    return m.select("id", "mean", "sd", F.when(F.col("sd") <= 1e-6, F.lit(0.0)).otherwise(F.coalesce("skew", F.lit(0.0))).alias("skew"))


def bright_share(images: DataFrame, threshold: int = 240) -> DataFrame:
    bright = F.size(F.filter("px", lambda x: x >= threshold))
    return images.select("id", F.when(F.size("px") > 0, bright / F.size("px")).otherwise(F.lit(0.0)).alias("share"))


def gradients(images: DataFrame) -> DataFrame:
    """id, x: the Sobel magnitude at each pixel."""
    p = lambda dr, dc: _at(_mirror(F.col("r") + dr, F.col("height")), _mirror(F.col("c") + dc, F.col("width")))
    gx = (p(-1, 1) + 2 * p(0, 1) + p(1, 1)) - (p(-1, -1) + 2 * p(0, -1) + p(1, -1))
    gy = (p(1, -1) + 2 * p(1, 0) + p(1, 1)) - (p(-1, -1) + 2 * p(-1, 0) + p(-1, 1))
    return _places(images).select("id", F.sqrt((gx * gx + gy * gy).cast("double")).alias("x"))


def gradient_histogram(images: DataFrame, bins: int = 32) -> DataFrame:
    return shares(gradients(images), bins, 0, 255)


def cooccurrence(images: DataFrame, distances: Sequence[int] = (1, 2), angles: Sequence[float] = ANGLES, levels: int = 8) -> DataFrame:
    """id, distance, angle (its number), and the properties of the symmetric, normalised co-occurrence of gray levels."""
    level = lambda x: F.least(F.floor(x * levels / 256), F.lit(levels - 1)).cast("int")
    pairs = []
    for d in distances:
        for k, a in enumerate(angles):
            dr, dc = offset(d, a)
            r, c = F.col("r") + dr, F.col("c") + dc
            inside = (r >= 0) & (r < F.col("height")) & (c >= 0) & (c < F.col("width"))
            pairs.append(F.when(inside, F.struct(F.lit(d).alias("distance"), F.lit(k).alias("angle"), level(_at(F.col("r"), F.col("c"))).alias("a"), level(_at(r, c)).alias("b"))))
    both = _places(images).select("id", F.explode(F.array(*pairs)).alias("p")).where("p is not null").select("id", "p.*")
    counted = both.groupBy("id", "distance", "angle", "a", "b").agg(F.count("*").alias("n"))
    # the symmetric matrix has each pair in both directions: p(a, b) = (n(a, b) + n(b, a)) / (2 * all)
    turned = counted.unionByName(counted.select("id", "distance", "angle", F.col("b").alias("a"), F.col("a").alias("b"), "n")).groupBy("id", "distance", "angle", "a", "b").agg(F.sum("n").alias("n"))
    d = F.col("a") - F.col("b")
    n, total = F.col("n"), F.sum("n")
    # the matrix is symmetric, so both sides have one mean and one variance
    mean = F.sum(n * F.col("a")) / total
    var = F.sum(n * F.col("a") * F.col("a")) / total - mean * mean
    both_sides = F.sum(n * F.col("a") * F.col("b")) / total - mean * mean
    return turned.groupBy("id", "distance", "angle").agg(
        (F.sum(n * d * d) / total).alias("contrast"), (F.sum(n * F.abs(d)) / total).alias("dissimilarity"),
        (F.sum(n / (1 + d * d)) / total).alias("homogeneity"), (F.sqrt(F.sum((n * n).cast("double"))) / total).alias("energy"),
        F.when(var < 1e-12, F.lit(1.0)).otherwise(both_sides / var).alias("correlation"),
    )


def local_patterns(images: DataFrame, radius: int = 1, points: int = 8) -> DataFrame:
    """id, x: the uniform local binary pattern of each pixel, 0 to points + 1."""
    bits = []
    for k in range(points):
        dr, dc = round(-radius * math.sin(2 * math.pi * k / points), 5), round(radius * math.cos(2 * math.pi * k / points), 5)
        r0, c0 = math.floor(dr), math.floor(dc)
        fr, fc = dr - r0, dc - c0
        value = F.lit(0.0)
        for a, b, w in ((0, 0, (1 - fr) * (1 - fc)), (0, 1, (1 - fr) * fc), (1, 0, fr * (1 - fc)), (1, 1, fr * fc)):
            if w:
                r, c = F.col("r") + (r0 + a), F.col("c") + (c0 + b)
                inside = (r >= 0) & (r < F.col("height")) & (c >= 0) & (c < F.col("width"))
                value = value + F.when(inside, _at(r, c) * w).otherwise(F.lit(0.0))
        bits.append((value + 1e-9 >= _at(F.col("r"), F.col("c"))).cast("int"))
    seen = _places(images).select("id", F.array(*bits).alias("b"))
    ones = F.aggregate("b", F.lit(0), lambda s, x: s + x)
    turns = F.aggregate(F.zip_with("b", F.concat(F.slice("b", 2, points - 1), F.slice("b", 1, 1)), lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    return seen.select("id", F.when(turns <= 2, ones).otherwise(F.lit(points + 1)).alias("x"))


def pattern_histogram(images: DataFrame, radius: int = 1, points: int = 8, bins: int = 59) -> DataFrame:
    return shares(local_patterns(images, radius, points), bins, 0, bins)


def cosine_bands(images: DataFrame, fractions: tuple[float, float] = (0.15, 0.40)) -> DataFrame:
    """id, low, mid, high: shares of the energy of the orthonormal cosine transform in three diagonal blocks.

    The transform is a product of the rows' and the columns' sums with a cosine table, both as array functions over the image's own row.
    """
    h, w = F.col("height"), F.col("width")
    cell = lambda u, n, k: F.when(u == 0, F.sqrt(1.0 / n)).otherwise(F.sqrt(2.0 / n)) * F.cos(F.lit(math.pi) * (2 * k + 1) * u / (2 * n))
    span = lambda n: F.sequence(F.lit(0), n - 1)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    gray = images.withColumn("g", F.transform("px", lambda x: x / 255.0))
    rows = gray.withColumn("t", F.transform(span(h), lambda r: F.transform(span(w), lambda v: total(F.transform(span(w), lambda c: F.get("g", (r * w + c).cast("int")) * cell(v, w, c))))))
    full = rows.select("id", "height", "width", F.explode(span(h)).alias("u"), "t").select("id", "height", "width", "u", F.posexplode(F.transform(span(w), lambda v: total(F.transform(span(h), lambda r: F.get(F.get("t", r), v) * cell(F.col("u"), h, r))))).alias("v", "x"))
    side = F.least("height", "width")
    one, two = F.floor(side * fractions[0]), F.floor(side * fractions[1])
    block = lambda a, b, c, d: (F.col("u") >= a) & (F.col("u") < b) & (F.col("v") >= c) & (F.col("v") < d)
    energy = full.select("id", (F.col("x") * F.col("x")).alias("e"), block(0, one, 0, one).alias("low"), block(one, two, one, two).alias("mid"), block(two, F.col("height"), two, F.col("width")).alias("high"))
    sums = energy.groupBy("id").agg(*(F.sum(F.when(F.col(c), F.col("e")).otherwise(0.0)).alias(c) for c in ("low", "mid", "high")))
    all_ = F.greatest(F.col("low") + F.col("mid") + F.col("high"), F.lit(1e-12))
    return sums.select("id", *((F.col(c) / all_).alias(c) for c in ("low", "mid", "high")))


def flipped(images: DataFrame, direction: str = "horizontal") -> DataFrame:
    if direction not in ("horizontal", "vertical"):
        raise ValueError("direction must be horizontal or vertical")
    h, w = F.col("height"), F.col("width")
    across = lambda i: F.floor(i / w) * w + (w - 1 - i % w)
    down = lambda i: (h - 1 - F.floor(i / w)) * w + i % w
    at = across if direction == "horizontal" else down
    return images.withColumn("px", F.transform(F.sequence(F.lit(0), h * w - 1), lambda i: F.get("px", at(i).cast("int"))))


def brightened(images: DataFrame, factor: float | Column) -> DataFrame:
    """Values times the factor, clipped, decimals cut off."""
    f = F.lit(float(factor)) if not isinstance(factor, Column) else factor
    return images.withColumn("px", F.transform("px", lambda x: F.least(F.greatest(x * f, F.lit(0.0)), F.lit(255.0)).cast("int")))


def contrasted(images: DataFrame, factor: float | Column) -> DataFrame:
    """Values times the factor, rounded half to even, clipped."""
    f = F.lit(float(factor)) if not isinstance(factor, Column) else factor
    return images.withColumn("px", F.transform("px", lambda x: F.least(F.bround(F.abs(x * f), 0), F.lit(255.0)).cast("int")))


def noisy(images: DataFrame, level: float = 0.05, seed: int = 42) -> DataFrame:
    """Normal noise of deviation level * 255, drawn by hash of (seed, id, place), clipped."""
    def draw(i: Column) -> Column:
        u = lambda s: (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i, F.lit(s)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
        return F.sqrt(-2 * F.log(u(1))) * F.cos(2 * math.pi * u(2))

    noise = lambda x, i: F.least(F.greatest(x + draw(i) * (level * 255), F.lit(0.0)), F.lit(255.0)).cast("int")
    return images.withColumn("px", F.transform("px", noise))


def turned(images: DataFrame, degrees: Column) -> DataFrame:
    """Turned by multiples of 90 degrees clockwise (a sensor's orientation); other angles leave the image as it is."""
    h, w, d = F.col("height"), F.col("width"), F.pmod(degrees, F.lit(360))
    i_of = lambda i: F.when(d == 90, (h - 1 - i % h) * w + F.floor(i / h)).when(d == 180, h * w - 1 - i).when(d == 270, (i % h) * w + (w - 1 - F.floor(i / h))).otherwise(i)
    new = images.withColumn("px", F.transform(F.sequence(F.lit(0), h * w - 1), lambda i: F.get("px", i_of(i).cast("int"))))
    swap = d.isin(90, 270)
    return new.withColumns({"height": F.when(swap, w).otherwise(h), "width": F.when(swap, h).otherwise(w)})
