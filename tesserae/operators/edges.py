"""Edges with hysteresis: gradients, thinning across the edge, and weak pixels that hang together with strong ones.

The first two steps are expressions over the image's own row: Sobel gradients with the edge going on outside, |gx| + |gy| as magnitude, and of
each pixel a comparison with its two neighbours across the edge (along the row, the column or a diagonal, parted at 22.5 and 67.5 degrees).
Only pixels above the lower threshold become rows. From the strong ones, above the upper threshold, links go to weak ones among the eight
neighbours, round by round, keyed by image and place, until nothing is new; each round's tables replace those before. The joins name their
method: tables of pixels are small as files and large in memory, so none of them is broadcast through the driver.

Defined cases: an image without pixels, or with null ones, has density 0; a null id is an image; repeated ids are taken for one image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.vectors import let, span
from tesserae.sources.scratch import drop, keep

LOW, HIGH = 100, 200
TAN = 0.41421356237309503  # of 22.5 degrees


def graded(px: Column, height: Column, width: Column, low: float = LOW, high: float = HIGH) -> Column:
    """Of each pixel 0, 1 (weak) or 2 (strong); null without pixels."""
    row, col = lambda i: F.floor(i / width).cast("int"), lambda i: (i % width).cast("int")
    within = lambda k, n: F.least(F.greatest(k, F.lit(0)), n - 1)

    def gradient(i: Column) -> Column:
        p = lambda dr, dc: F.get(px, within(row(i) + dr, height) * width + within(col(i) + dc, width))
        gx = (p(-1, 1) + 2 * p(0, 1) + p(1, 1)) - (p(-1, -1) + 2 * p(0, -1) + p(1, -1))
        gy = (p(1, -1) + 2 * p(1, 0) + p(1, 1)) - (p(-1, -1) + 2 * p(-1, 0) + p(-1, 1))
        return let(F.struct(gx.alias("x"), gy.alias("y")), lambda g: F.struct(g["x"].alias("x"), g["y"].alias("y"), (F.abs(g["x"]) + F.abs(g["y"])).alias("m")))

    def grade(gs: Column, i: Column) -> Column:
        def m(dr, dc) -> Column:
            r, c = row(i) + dr, col(i) + dc
            return F.when((r >= 0) & (r < height) & (c >= 0) & (c < width), F.get(gs, r * width + c)["m"]).otherwise(F.lit(0))

        g = F.get(gs, i)
        ax, ay, own = F.abs(g["x"]), F.abs(g["y"]), g["m"]
        side = F.when((g["x"] < 0) != (g["y"] < 0), F.lit(-1)).otherwise(F.lit(1))
        level = (own > m(0, -1)) & (own >= m(0, 1))
        upright = (own > m(-1, 0)) & (own >= m(1, 0))
        slant = (own > m(-1, -side)) & (own > m(1, side))
        top = F.when(ay < ax * TAN, level).when(ay > ax * (TAN + 2), upright).otherwise(slant)
        return F.when((own > low) & top, F.when(own > high, F.lit(2)).otherwise(F.lit(1))).otherwise(F.lit(0))

    full = let(F.transform(span(height * width), gradient), lambda gs: F.transform(span(height * width), lambda i: grade(gs, i)))
    return F.when(F.size(px) > 0, full)


def linked(images: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """id, r, c of all edge pixels of rows (id, height, width, px), a kept table's rows."""
    grades = images.where(F.size("px") > 0).select(F.col("id").alias("id"), "width", graded(F.col("px"), F.col("height"), F.col("width"), low, high).alias("g"))
    found = F.filter(F.transform("g", lambda g, i: F.struct(g.alias("g"), F.floor(i / F.col("width")).cast("int").alias("r"), (i % F.col("width")).cast("int").alias("c"))), lambda x: x["g"] > 0)
    some = keep(keep(grades.select("id", found.alias("f"))).select("id", F.explode("f").alias("f")).select(F.struct("id").alias("id"), "f.*"))
    strong, weak = keep(some.where("g = 2").select("id", "r", "c")), keep(some.where("g = 1").select("id", "r", "c"))
    parts, front = [strong], strong
    while True:
        around = F.explode(F.array(*(F.struct((F.col("r") + a).alias("r"), (F.col("c") + b).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)))
        near = front.select("id", around.alias("p")).select("id", "p.r", "p.c").distinct()
        front = keep(weak.join(near.hint("merge"), ["id", "r", "c"], "left_semi"))
        if front.isEmpty():
            break
        parts.append(front)
        rest = keep(weak.join(front.hint("merge"), ["id", "r", "c"], "left_anti"))
        drop(weak)
        weak = rest
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.select("id.id", "r", "c")


def edge_density(images: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """id, density: the mean of a map that is 255 on edges and 0 elsewhere."""
    counts = linked(images, low, high).groupBy(F.struct("id").alias("of")).agg(F.count("*").alias("n"))
    rows = images.select(F.struct("id").alias("of"), "id", "height", "width")
    share = F.coalesce(F.try_divide(F.col("n") * 255.0, F.col("height") * F.col("width")), F.lit(0.0))
    return rows.join(counts.hint("merge"), "of", "left").select("id", share.alias("density"))
