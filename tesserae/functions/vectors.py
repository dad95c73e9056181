"""Feature blocks as Column expressions over the arrays of an image's own row.

An image is a flat array rgb (row by row; red, green, blue) with height and width. sample() gives Columns for one square image: gray, hue (0 to 179),
saturation, value and the three of LAB, 8 bits each. A block turns a sample into an array of numbers; vector() puts the enabled blocks of a
registry one after the other in one projection. Nothing is exploded and nothing is shuffled. Counts come from text: each code is a character,
and how often it occurs is what its removal takes from the length.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.operators.pixels import ANGLES, offset

Sample = dict[str, Column]
CHANNELS = {"hsv": ("hue", "saturation", "value"), "lab": ("light", "a", "b"), "rgb": ("red", "green", "blue")}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def span(n: int | Column) -> Column:
    return F.sequence(F.lit(0), (F.lit(n) if isinstance(n, int) else n) - 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


# --- preprocessing


def _steps(n: Column, side: int) -> Column:
    """Of each of `side` places: the two pixels of n between which it lies, and how far it is from the first. Centres of pixels are aligned."""

    def at(k: Column) -> Column:
        x = F.greatest(F.least((k + 0.5) * n / side - 0.5, (n - 1).cast("double")), F.lit(0.0))
        return let(x, lambda v: F.struct(F.floor(v).cast("int").alias("i"), F.least(F.floor(v) + 1, n - 1).cast("int").alias("j"), (v - F.floor(v)).alias("f")))

    return F.transform(span(side), at)


def resized(rgb: Column, height: Column, width: Column, side: int) -> Column:
    """array<struct<red, green, blue>> of side x side pixels, by the weights of rows and of columns (bilinear), rounded half to even."""
    names = CHANNELS["rgb"]

    def pixel(r: Column, c: Column) -> Column:
        def mixed(k: int) -> Column:
            x = lambda i, j: F.get(rgb, (i * width + j) * 3 + k).cast("double")
            top = x(r["i"], c["i"]) * (1 - c["f"]) + x(r["i"], c["j"]) * c["f"]
            low = x(r["j"], c["i"]) * (1 - c["f"]) + x(r["j"], c["j"]) * c["f"]
            return F.greatest(F.least(F.bround(top * (1 - r["f"]) + low * r["f"], 0), F.lit(255.0)), F.lit(0.0))

        return F.struct(*(mixed(k).cast("int").alias(n) for k, n in enumerate(names)))

    return let(_steps(width, side), lambda cols: F.flatten(F.transform(_steps(height, side), lambda r: F.transform(cols, lambda c: pixel(r, c)))))


def gray_of(p: Column) -> Column:
    return F.bround(p["red"] * 0.299 + p["green"] * 0.587 + p["blue"] * 0.114, 0).cast("int")


def hsv_of(p: Column) -> Column:
    """struct<hue, saturation, value>: hue in steps of two degrees, the others 0 to 255."""
    r, g, b = (p[c].cast("double") for c in CHANNELS["rgb"])
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    d = F.when(high > low, high - low).otherwise(F.lit(1.0))
    angle = F.when(high == r, (g - b) / d).when(high == g, 2 + (b - r) / d).otherwise(4 + (r - g) / d)
    hue = F.when(high > low, F.pmod(angle * 60, F.lit(360.0))).otherwise(F.lit(0.0))
    return F.struct((F.bround(hue / 2, 0) % 180).cast("int").alias("hue"), F.bround(255 * (high - low) / F.greatest(high, F.lit(1.0)), 0).cast("int").alias("saturation"), high.cast("int").alias("value"))


# The matrix from linear colours to XYZ, and its white.
XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.950456, 1.0, 1.088754)


def lab_of(p: Column) -> Column:
    """struct<light, a, b>, each 0 to 255."""

    def line(c: Column) -> Column:
        x = c / 255.0
        return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))

    def cube(t: Column) -> Column:
        return F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(t * 7.787 + 16 / 116)

    def made(x: Column) -> Column:
        f = F.struct(*(cube(x[c]).alias(c) for c in "xyz"), x["y"].alias("w"))
        light = lambda v: F.when(v["w"] > 0.008856, v["y"] * 116 - 16).otherwise(v["w"] * 903.3) * 255 / 100
        byte = lambda v: F.least(F.greatest(F.bround(v, 0), F.lit(0.0)), F.lit(255.0)).cast("int")
        return let(f, lambda v: F.struct(byte(light(v)).alias("light"), byte((v["x"] - v["y"]) * 500 + 128).alias("a"), byte((v["y"] - v["z"]) * 200 + 128).alias("b")))

    lines = F.struct(*(line(p[c]).alias(c) for c in CHANNELS["rgb"]))
    xyz = lambda v: F.struct(*(((v["red"] * m[0] + v["green"] * m[1] + v["blue"] * m[2]) / w).alias(n) for n, m, w in zip("xyz", XYZ, WHITE, strict=True)))
    return let(lines, lambda v: let(xyz(v), made))


def converted(p: Column) -> Column:
    """Of a pixel, all channels."""
    hsv, lab = hsv_of(p), lab_of(p)
    both = let(F.struct(hsv.alias("hsv"), lab.alias("lab")), lambda v: F.struct(gray_of(p).alias("gray"), *(v[s][c].alias(c) for s in ("hsv", "lab") for c in CHANNELS[s]), *(p[c].alias(c) for c in CHANNELS["rgb"])))
    return both


def sample(pixels: Column, side: int) -> Sample:
    """Columns of the channels of converted pixels (an array of converted()), each an array in row order; side: a number."""
    return {c: pixels[c] for c in ("gray", *CHANNELS["hsv"], *CHANNELS["lab"], *CHANNELS["rgb"])} | {"side": side}


# --- counting


def counts(codes: Column, n: int) -> Column:
    """How often each of 0 to n - 1 (n is 64 at most) is among the codes; nulls and other codes count nowhere."""
    letters = F.array_join(F.transform(codes, lambda c: F.char(c + 48)), "")
    return let(letters, lambda s: F.transform(span(n), lambda k: F.octet_length(s) - F.octet_length(F.replace(s, F.char(k + 48), F.lit("")))))


def shares(number: Column) -> Column:
    """Numbers over their sum; zeros if that is 0."""
    return let(number, lambda ns: let(total(F.transform(ns, lambda n: n.cast("double"))), lambda t: F.transform(ns, lambda n: F.when(t > 0, n / t).otherwise(F.lit(0.0)))))


def binned(x: Column, bins: int, low: float, high: float) -> Column:
    width = (high - low) / bins
    return F.when((x >= low) & (x <= high), F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int"))


# --- blocks


def _padded(x: Column, side: int, pad: int, fill: Column) -> Column:
    """The square with a border of `pad` places, so that a neighbour is at a fixed distance."""
    rim, edge = F.array_repeat(fill, pad * (side + 2 * pad)), F.array_repeat(fill, pad)
    rows = F.transform(span(side), lambda r: F.concat(edge, F.slice(x, r * side + 1, side), edge))
    return F.concat(rim, F.flatten(rows), rim)


def _mirrored(x: Column, side: int) -> Column:
    """The square with a border of one place, mirrored without the edge."""
    fold = lambda k: F.when(k < 0, F.lit(min(1, side - 1))).when(k >= side, F.lit(max(side - 2, 0))).otherwise(k)
    row = lambda r: let(F.slice(x, fold(r) * side + 1, side), lambda v: F.concat(F.slice(v, min(2, side), 1), v, F.slice(v, max(side - 1, 1), 1)))
    return F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(side)), row))


def _places(side: int, pad: int) -> Column:
    """Where the pixels of the square are in the padded one."""
    return F.transform(span(side * side), lambda i: (F.floor(i / side).cast("int") + pad) * (side + 2 * pad) + i % side + pad)


def glcm(s: Sample, levels: int = 8, distances: Sequence[int] = (1, 2), angles: Sequence[float] = ANGLES) -> Column:
    """Contrast, then homogeneity, then energy of the co-occurrence of gray levels, each by distance and angle."""
    side = s["side"]
    level = F.transform(s["gray"], lambda x: F.least(F.floor(x * levels / 256), F.lit(levels - 1)).cast("int"))
    pad = max(distances)

    def one(q: Column, at: Column, d: int, a: float) -> Column:
        dr, dc = offset(d, a)
        codes = F.transform(at, lambda i: F.get(q, i) * levels + F.get(q, i + (dr * (side + 2 * pad) + dc)))  # null outside
        row, col = lambda k: F.floor(k / levels).cast("int"), lambda k: (k % levels).cast("int")
        gap = lambda k: F.pow((row(k) - col(k)).cast("double"), F.lit(2.0))

        def measured(n: Column) -> Column:
            t = F.greatest(total(F.transform(n, lambda x: x.cast("double"))), F.lit(1.0))
            both = lambda k: F.get(n, k) + F.get(n, col(k) * levels + row(k))
            contrast = total(F.transform(n, lambda x, k: x * gap(k)))
            near = total(F.transform(n, lambda x, k: x / (1 + gap(k))))
            energy = F.sqrt(total(F.transform(span(levels * levels), lambda k: F.pow(both(k).cast("double"), F.lit(2.0))))) / 2
            return F.array(contrast / t, near / t, energy / t)

        return let(counts(codes, levels * levels), measured)

    border = _padded(level, side, pad, F.lit(None).cast("int"))
    found = let(F.struct(border.alias("q"), _places(side, pad).alias("at")), lambda v: F.array(*(one(v["q"], v["at"], d, a) for d in distances for a in angles)))
    return let(found, lambda f: F.flatten(F.transform(span(3), lambda p: F.transform(f, lambda x: F.get(x, p)))))


def _circle(points: int, radius: int) -> list[list[tuple[int, int, float]]]:
    """For each point of the circle the pixels around it with their weights."""
    out = []
    for k in range(points):
        dr, dc = round(-radius * math.sin(2 * math.pi * k / points), 5), round(radius * math.cos(2 * math.pi * k / points), 5)
        r, c = math.floor(dr), math.floor(dc)
        corners = ((r + a, c + b, abs(1 - a - dr + r) * abs(1 - b - dc + c)) for a in (0, 1) for b in (0, 1))
        out.append([(i, j, w) for i, j, w in corners if w])
    return out


def lbp(s: Sample, radii: Sequence[int] = (1, 2, 3), points: int = 8, bins: int = 59) -> Column:
    """Shares of uniform local binary patterns, with bilinear points and 0 outside; codes behind points + 1 do not occur."""
    side, pad = s["side"], max(radii)
    wide = side + 2 * pad

    def code(x: Column, i: Column, radius: int) -> Column:
        value = lambda ways: sum((F.get(x, i + (r * wide + c)) * w for r, c, w in ways), F.lit(1e-9))
        bits = F.array(*((value(ways) >= F.get(x, i)).cast("int") for ways in _circle(points, radius)))
        ones = lambda b: F.aggregate(b, F.lit(0), lambda n, v: n + v)
        turns = lambda b: sum((F.abs(F.get(b, k) - F.get(b, (k + 1) % points)) for k in range(points)), F.lit(0))
        return let(bits, lambda b: F.when(turns(b) <= 2, ones(b)).otherwise(F.lit(points + 1)))

    def one(x: Column, at: Column, radius: int) -> Column:
        return F.concat(shares(counts(F.transform(at, lambda i: code(x, i, radius)), points + 2)), F.array_repeat(F.lit(0.0), bins - points - 2))

    ready = F.struct(_padded(s["gray"], side, pad, F.lit(0)).alias("x"), _places(side, pad).alias("at"))
    return let(ready, lambda v: F.concat(*(one(v["x"], v["at"], radius) for radius in radii)))


def color_moments(s: Sample, space: str = "hsv") -> Column:
    """Mean, population deviation and skewness of each channel; skewness is 0 where the deviation is 1e-6 at most."""

    def one(x: Column) -> Column:
        n = F.size(x).cast("double")
        mean = lambda v: total(F.transform(v, lambda e: e.cast("double"))) / n
        third = lambda m, sd: F.when(sd <= 1e-6, F.lit(0.0)).otherwise(total(F.transform(x, lambda e: F.pow((e - m) / sd, F.lit(3.0)))) / n)
        return let(mean(x), lambda m: let(F.sqrt(total(F.transform(x, lambda e: (e - m) * (e - m))) / n), lambda sd: F.array(m, sd, third(m, sd))))

    return F.concat(*(one(s[c]) for c in CHANNELS[space]))


def color_hist(s: Sample, space: str = "hsv", bins: int = 16) -> Column:
    return F.concat(*(shares(counts(F.transform(s[c], lambda x: binned(x, bins, 0, 256)), bins)) for c in CHANNELS[space]))


def gradient_hist(s: Sample, bins: int = 32) -> Column:
    """Shares of Sobel magnitudes from 0 to 255; larger ones leave the sum."""
    side = s["side"]

    def magnitude(x: Column, i: Column) -> Column:
        p = lambda dr, dc: F.get(x, i + (dr * (side + 2) + dc)).cast("double")
        gx = (p(-1, 1) + 2 * p(0, 1) + p(1, 1)) - (p(-1, -1) + 2 * p(0, -1) + p(1, -1))
        gy = (p(1, -1) + 2 * p(1, 0) + p(1, 1)) - (p(-1, -1) + 2 * p(-1, 0) + p(-1, 1))
        return let(F.struct(gx.alias("x"), gy.alias("y")), lambda g: F.sqrt(g["x"] * g["x"] + g["y"] * g["y"]))

    found = let(_mirrored(s["gray"], side), lambda x: F.transform(_places(side, 1), lambda i: magnitude(x, i)))
    return shares(counts(F.transform(found, lambda m: binned(m, bins, 0, 255)), bins))


def specular(s: Sample, threshold: float = 240.0) -> Column:
    return F.array(F.size(F.filter(s["value"], lambda v: v >= threshold)) / F.size(s["value"]))


def dct_bands(s: Sample, fractions: Sequence[float] = (0.15, 0.40)) -> Column:
    """Shares of the energy of the orthonormal cosine transform in three diagonal blocks."""
    side = s["side"]
    one, two = (int(side * f) for f in fractions)
    wave = lambda u: F.transform(span(side), lambda k: F.when(u == 0, F.lit(math.sqrt(1 / side))).otherwise(F.lit(math.sqrt(2 / side))) * F.cos(math.pi * (2 * k + 1) * u / (2 * side)))
    gray = F.transform(s["gray"], lambda x: x / 255.0)

    def transformed(waves: Column) -> Column:
        rows = let(gray, lambda g: F.transform(span(side), lambda r: F.slice(g, r * side + 1, side)))
        first = F.transform(rows, lambda row: F.transform(waves, lambda w: dot(row, w)))
        turned = let(first, lambda a: F.transform(span(side), lambda v: F.transform(a, lambda row: F.get(row, v))))
        return let(turned, lambda t: F.transform(waves, lambda w: F.transform(t, lambda col: F.pow(dot(w, col), F.lit(2.0)))))

    def bands(e: Column) -> Column:
        block = lambda a, b: total(F.transform(F.slice(e, a + 1, b - a), lambda row: total(F.slice(row, a + 1, b - a))))
        return let(F.array(block(0, one), block(one, two), block(two, side)), lambda b: F.transform(b, lambda x: x / F.greatest(total(b), F.lit(1e-12))))

    return let(F.transform(span(side), wave), lambda w: let(transformed(w), bands))


def numbers(values: np.ndarray) -> Column:
    """A constant array of doubles, in row order."""
    return F.split(F.lit(",".join(repr(float(x)) for x in np.ravel(values))), ",").cast("array<double>")


def _rows(flat: Column, side: int) -> Column:
    return F.transform(span(side), lambda r: F.slice(flat, r * side + 1, side))


def _both_ways(square: Column, first: Column, second: Column) -> Column:
    """Sums of a square's numbers (an array of rows) times waves: along rows by the first waves, then along columns by the second. Flat, with the first waves by row."""
    side = F.size(first)
    half = F.transform(square, lambda row: F.transform(first, lambda w: dot(row, w)))
    turned = let(half, lambda a: F.transform(F.sequence(F.lit(0), side - 1), lambda v: F.transform(a, lambda row: F.get(row, v))))
    return F.flatten(F.transform(turned, lambda col: F.transform(second, lambda w: dot(w, col))))


def fft_bands(s: Sample, fractions: Sequence[float] = (0.15, 0.40)) -> Column:
    """Shares of the energy of the Fourier transform in three rings around frequency 0, as shares of the farthest frequency's distance."""
    side, half = s["side"], s["side"] // 2
    one, two = fractions
    turn = 2 * math.pi * np.outer(np.arange(side), np.arange(side)) / side
    gray = F.transform(s["gray"], lambda x: x / 255.0)

    def energy(x: Column, c: Column, n: Column) -> Column:
        part = lambda a, b: _both_ways(x, a, b)
        real, other = F.zip_with(part(c, c), part(n, n), lambda a, b: a - b), F.zip_with(part(c, n), part(n, c), lambda a, b: a + b)
        return F.zip_with(real, other, lambda a, b: a * a + b * b)

    def ring(k: Column) -> Column:
        off = lambda u: ((u + half) % side - half).cast("double")
        far = lambda v: F.sqrt(v["r"] * v["r"] + v["c"] * v["c"]) / (math.hypot(half, half) or 1.0)
        return let(F.struct(off(F.floor(k / side)).alias("r"), off(k % side).alias("c")), lambda v: F.when(far(v) <= one, F.lit(0)).when(far(v) <= two, F.lit(1)).otherwise(F.lit(2)))

    def bands(e: Column) -> Column:
        own = lambda b: total(F.transform(e, lambda x, k: F.when(ring(k) == b, x).otherwise(F.lit(0.0))))
        return let(F.array(own(0), own(1), own(2)), lambda b: F.transform(b, lambda x: x / F.greatest(total(b), F.lit(1e-12))))

    ready = F.struct(_rows(gray, side).alias("x"), _rows(numbers(np.cos(turn)), side).alias("c"), _rows(numbers(np.sin(turn)), side).alias("n"))
    return let(ready, lambda v: let(energy(v["x"], v["c"], v["n"]), bands))


#: Side of the largest square whose filters are constants of the plan.
FILTERED = 64


@lru_cache(maxsize=8)
def _filters(side: int, orientations: int, sigmas: tuple, lambdas: tuple, gamma: float, ksize: int) -> tuple[np.ndarray, ...]:
    """Cosine waves of the mirrored square with the weights of their transform, sine waves, and of each filter how it weighs waves: even and odd parts.

    A square mirrored without its edge goes on with period 2 (side - 1), as a sum of products of cosines. A filter that is the same upside
    down and mirrored turns such a product into itself and the product of the sines, each times a number.
    """
    k = np.arange(side)
    angle = math.pi / max(side - 1, 1)
    ends = np.where((k == 0) | (k == side - 1), 0.5, 1.0) if side > 1 else np.ones(1)
    cos, sin = np.cos(angle * np.outer(k, k)), np.sin(angle * np.outer(k, k))
    analysis = cos * np.outer(ends, ends) * (2 / (side - 1) if side > 1 else 1)
    tap = np.arange(ksize) - ksize // 2
    y, x = np.meshgrid(tap, tap, indexing="ij")
    even, odd = np.cos(angle * np.outer(k, tap)), np.sin(angle * np.outer(k, tap))
    weights = []
    for sigma in sigmas:
        for wavelength in lambdas:
            for theta in np.arange(orientations) * np.pi / orientations:
                along, across = x * np.cos(theta) + y * np.sin(theta), y * np.cos(theta) - x * np.sin(theta)
                kernel = np.exp(-(along**2 + (gamma * across) ** 2) / (2 * sigma**2)) * np.cos(2 * np.pi * along / wavelength)
                weights.append((even @ kernel @ even.T, odd @ kernel @ odd.T))
    return analysis, cos, sin, np.array([w for w, _ in weights]), np.array([w for _, w in weights])


def gabor(s: Sample, orientations: int = 4, sigmas: Sequence[float] = (2.0, 4.0), lambdas: Sequence[float] = (6.0, 10.0), gamma: float = 0.5, ksize: int = 31) -> Column:
    """Mean and population deviation of the responses to each filter: sigma first, then wavelength, then angle. The square is mirrored outside.

    The square's cosine transform is made once; a filter weighs it and turns it back. Squares have FILTERED pixels a side at most, as the
    weights are constants of the plan; ksize is odd.
    """
    side = s["side"]
    if side > FILTERED or ksize % 2 == 0:
        raise ValueError(f"filters of an odd size on squares of at most {FILTERED} pixels a side")
    analysis, cos, sin, even, odd = _filters(side, orientations, tuple(sigmas), tuple(lambdas), gamma, ksize)
    gray = F.transform(s["gray"], lambda x: x.cast("double"))
    n = side * side

    def measured(r: Column) -> Column:
        return let(total(r) / n, lambda m: F.array(m, F.sqrt(total(F.transform(r, lambda x: (x - m) * (x - m))) / n)))

    def answered(v: Column, k: Column) -> Column:
        back = lambda weights, waves: _both_ways(_rows(F.zip_with(v["a"], F.slice(weights, k * n + 1, n), lambda a, w: a * w), side), waves, waves)
        return F.zip_with(back(v["even"], v["cos"]), back(v["odd"], v["sin"]), lambda x, y: x + y)

    def turned(waves: Column) -> Column:
        # transposed twice: once here, once on the way back
        whole = let(_both_ways(_rows(gray, side), waves, waves), lambda a: F.transform(span(n), lambda i: F.get(a, (i % side) * side + F.floor(i / side).cast("int"))))
        return whole

    ready = F.struct(let(_rows(numbers(analysis), side), turned).alias("a"), *(_rows(numbers(w), side).alias(c) for c, w in (("cos", cos), ("sin", sin))), numbers(even).alias("even"), numbers(odd).alias("odd"))
    return let(ready, lambda v: F.flatten(F.transform(span(len(even)), lambda k: let(answered(v, k), measured))))


def joint_hist(s: Sample, bins: int = 8) -> Column:
    """Hue, saturation and value together (hue first), of length 1; bins is 8 at most."""
    place = lambda c, high: F.transform(s[c], lambda x: binned(x, bins, 0, high))
    inner = F.zip_with(place("saturation", 256), place("value", 256), lambda a, b: a * bins + b)
    codes = F.zip_with(place("hue", 180), inner, lambda h, k: F.struct(h.alias("h"), k.alias("k")))
    some = lambda v, h: counts(F.transform(v, lambda x: F.when(x["h"] == h, x["k"])), bins * bins)
    found = let(codes, lambda v: F.flatten(F.transform(span(bins), lambda h: some(v, h))))
    return let(found, lambda n: let(F.sqrt(total(F.transform(n, lambda x: (x * x).cast("double")))), lambda t: F.transform(n, lambda x: x / F.greatest(t, F.lit(1e-12)))))


@dataclass(frozen=True)
class Block:
    """A named expression with its settings, and how many numbers it gives."""

    name: str
    build: Callable[..., Column]
    size: int
    settings: dict = field(default_factory=dict)
    enabled: bool = True


# Blocks and their order, which is the layout of a vector.
REGISTRY = (
    Block("glcm", glcm, 24),
    Block("lbp_multi_radius", lbp, 177),
    Block("color_moments_hsv", color_moments, 9, {"space": "hsv"}),
    Block("color_moments_lab", color_moments, 9, {"space": "lab"}),
    Block("color_hist_hsv", color_hist, 48, {"space": "hsv"}),
    Block("color_hist_lab", color_hist, 48, {"space": "lab"}, enabled=False),
    Block("gradient_mag_hist", gradient_hist, 32),
    Block("specular_ratio", specular, 1),
    Block("dct_energy_bands", dct_bands, 3),
)

#: With the blocks whose constants bound the square's side (FILTERED), as the NumPy blocks have them.
FULL = (*REGISTRY[:2], Block("gabor", gabor, 32), *REGISTRY[2:], Block("fft_energy_bands", fft_bands, 3, enabled=False))


def with_settings(blocks: Sequence[Block] = REGISTRY, **settings: dict) -> tuple[Block, ...]:
    """All blocks, those named with other settings, `enabled` or `size` among them."""
    unknown = set(settings) - {b.name for b in blocks}
    if unknown:
        raise ValueError(f"no such blocks: {sorted(unknown)}")
    new = lambda b, own: replace(b, enabled=own.get("enabled", b.enabled), size=own.get("size", b.size), settings=b.settings | {k: v for k, v in own.items() if k not in ("enabled", "size")})
    return tuple(new(b, settings.get(b.name, {})) for b in blocks)


def layout(blocks: Sequence[Block] = REGISTRY) -> list[tuple[str, int, int]]:
    """(block, start, size) of the enabled blocks."""
    out, start = [], 0
    for b in blocks:
        if b.enabled:
            out.append((b.name, start, b.size))
            start += b.size
    return out


def vector(s: Sample, blocks: Sequence[Block] = REGISTRY) -> Column:
    """The arrays of the sample are made once for all blocks. The enabled blocks' numbers one after the other as 32-bit numbers; a block that gives another number than its size stops the job."""

    def checked(b: Block, s: Sample) -> Column:
        return let(b.build(s, **b.settings), lambda v: F.when(F.size(v) == b.size, v).otherwise(F.raise_error(F.lit(f"block {b.name} does not have {b.size} numbers"))))

    some = [b for b in blocks if b.enabled]
    if not some:
        return F.array().cast("array<float>")
    channels = F.struct(*(c.alias(name) for name, c in s.items() if name != "side"))
    of = lambda v: {name: v[name] for name in s if name != "side"} | {"side": s["side"]}
    return let(channels, lambda v: F.concat(*(checked(b, of(v)) for b in some))).cast("array<float>")
