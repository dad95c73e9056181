"""Oriented-gradient vectors as expressions over a gray image's own row.

Gradients are differences of the two neighbours (0 at the border). Each pixel votes with its magnitude for its orientation, modulo 180 degrees,
in its cell: for the bin that holds it, or dealt between the two bins whose middles are nearest. Overlapping blocks of cells are divided by their
length, clipped and divided by their length again. Cells that do not fit whole are left out.

Defined cases: an image smaller than a block of cells has an empty vector; one without gradients has zeros; null pixels give null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.vectors import dot, let, span, total

BINS, CELL, BLOCK, CLIP, EPSILON = 9, 8, 2, 0.2, 1e-5


def _votes(px: Column, h: Column, w: Column, bins: int, dealt: bool) -> Column:
    """Of each pixel: a bin and its votes, and the next bin and its."""

    def of(i: Column) -> Column:
        r, c = F.floor(i / w).cast("int"), (i % w).cast("int")
        at = lambda j: F.get(px, j.cast("int")).cast("double")
        down = F.when((r > 0) & (r < h - 1), at(i + w) - at(i - w)).otherwise(F.lit(0.0))
        right = F.when((c > 0) & (c < w - 1), at(i + 1) - at(i - 1)).otherwise(F.lit(0.0))

        def voted(g: Column) -> Column:
            size = F.sqrt(g["d"] * g["d"] + g["r"] * g["r"])
            turn = F.pmod(F.atan2(g["d"], g["r"]) * (180 / math.pi), F.lit(180.0)) / (180 / bins)
            if not dealt:
                return F.struct(F.least(F.floor(turn), F.lit(bins - 1)).cast("int").alias("a"), size.alias("va"), F.lit(0).alias("b"), F.lit(0.0).alias("vb"))
            low, part = F.floor(turn - 0.5), (turn - 0.5) - F.floor(turn - 0.5)
            return F.struct(F.pmod(low, F.lit(bins)).cast("int").alias("a"), (size * (1 - part)).alias("va"), F.pmod(low + 1, F.lit(bins)).cast("int").alias("b"), (size * part).alias("vb"))

        return let(F.struct(down.alias("d"), right.alias("r")), voted)

    return F.transform(span(h * w), of)


def oriented(px: Column, height: Column, width: Column, bins: int = BINS, cell: int = CELL, block: int = BLOCK, dealt: bool = False) -> Column:
    """Blocks row by row, of each its cells row by row, of each its bins."""
    rows, cols = F.floor(height / cell).cast("int"), F.floor(width / cell).cast("int")

    def histogram(votes: Column, k: Column) -> Column:
        """The bins of cell k, each over the cell's pixels."""
        first = F.floor(k / cols).cast("int") * cell * width + (k % cols) * cell
        own = F.transform(span(cell * cell), lambda j: F.get(votes, (first + F.floor(j / cell) * width + j % cell).cast("int")))
        of = lambda v, b: F.when(v["a"] == b, v["va"]).otherwise(F.lit(0.0)) + F.when(v["b"] == b, v["vb"]).otherwise(F.lit(0.0))
        return let(own, lambda vs: F.transform(span(bins), lambda b: total(F.transform(vs, lambda v: of(v, b))) / (cell * cell)))

    def normal(v: Column) -> Column:
        unit = lambda x: let(F.sqrt(dot(x, x) + EPSILON**2), lambda n: F.transform(x, lambda e: e / n))
        return let(let(v, unit), lambda x: let(F.transform(x, lambda e: F.least(e, F.lit(CLIP))), unit))

    def blocks(cells: Column) -> Column:
        across = cols - block + 1
        corner = lambda k: F.floor(k / across).cast("int") * cols + k % across
        one = lambda k: F.flatten(F.array(*(F.get(cells, (corner(k) + a * cols + b).cast("int")) for a in range(block) for b in range(block))))
        return F.flatten(F.transform(span((rows - block + 1) * across), lambda k: normal(one(k))))

    full = let(_votes(px, height, width, bins, dealt), lambda votes: let(F.transform(span(rows * cols), lambda k: histogram(votes, k)), blocks))
    return F.when(px.isNull(), F.lit(None)).when((rows >= block) & (cols >= block), full).otherwise(F.array().cast("array<double>"))
