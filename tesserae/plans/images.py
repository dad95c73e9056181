"""Queries on pixels, frames and feature layouts. Each embedding's 64 values stand in for an 8 x 8 gray image."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import vectors
from tesserae.functions.blocks import DEFAULT
from tesserae.functions.oriented import oriented
from tesserae.operators import edges, features, pixels, svm, warps
from tesserae.operators.distribution import counts, weights
from tesserae.plans import tabular
from tesserae.sources.scratch import keep
from tesserae.streaming.frames import throttle

QUERIES, SQL = {}, {}
INTERVAL_MS = 6 * 3600 * 1000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    gray = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.least(F.greatest(F.floor((x + 0.5) * 256), F.lit(0)), F.lit(255)).cast("int"))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.lit(8).alias("height"), F.lit(8).alias("width"), gray.alias("px"))


_PX = """px AS (SELECT id, x, i // 8 AS r, i % 8 AS c FROM (SELECT vec_id AS id, least(greatest(floor((unnest(embedding::DOUBLE[]) + 0.5) * 256), 0), 255)::INTEGER AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))"""
_MIRROR = "px p JOIN (SELECT unnest([-1, 0, 1]) AS dr) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dc)"


def _shares(values: str, bins: int, low: float, high: float) -> str:
    w = (high - low) / bins
    return f"""v AS ({values}), h AS (SELECT id, least(floor((x - {low}) / {w}), {bins - 1})::BIGINT AS bin, count(*) AS n FROM v WHERE x BETWEEN {low} AND {high} GROUP BY 1, 2), t AS (SELECT id, sum(n) AS n FROM h GROUP BY 1)
SELECT g.id, b.bin::INTEGER AS bin, round(coalesce(h.n / t.n::DOUBLE, 0), 9) AS share FROM (SELECT DISTINCT id FROM px) g CROSS JOIN (SELECT unnest(range({bins})) AS bin) b LEFT JOIN h ON h.id = g.id AND h.bin = b.bin LEFT JOIN t ON t.id = g.id"""


@query(f"WITH {_PX}, {_shares('SELECT id, x FROM px', 16, 0, 256)}")
def pixel_hist(spark, sf_dir):
    return pixels.histogram(_images(spark, sf_dir)).withColumn("share", F.round("share", 9))


@query(f"WITH {_PX}, m AS (SELECT id, avg(x) AS mean, stddev_pop(x) AS sd FROM px GROUP BY 1) SELECT id, round(any_value(mean), 6) AS mean, round(any_value(sd), 6) AS sd, round(CASE WHEN any_value(sd) <= 1e-6 THEN 0 ELSE avg(((x - mean) / sd) ** 3) END, 6) AS skew FROM px JOIN m USING (id) GROUP BY 1")
def pixel_moments(spark, sf_dir):
    return pixels.moments(_images(spark, sf_dir)).select("id", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "skew")))


@query(f"WITH {_PX} SELECT id, avg((x >= 140)::INTEGER::DOUBLE) AS share FROM px GROUP BY 1")
def specular_ratio(spark, sf_dir):
    return pixels.bright_share(_images(spark, sf_dir), 140)


_SOBEL = """SELECT id, sqrt(sum(wx * x) ** 2 + sum(wy * x) ** 2) AS x FROM (SELECT p.id, p.r, p.c, n.x, k.dc * (2 - abs(k.dr)) AS wx, k.dr * (2 - abs(k.dc)) AS wy
FROM px p, (SELECT a.v AS dr, b.v AS dc FROM (VALUES (-1), (0), (1)) a(v), (VALUES (-1), (0), (1)) b(v)) k, px n
WHERE n.id = p.id AND n.r = (CASE WHEN p.r + k.dr < 0 THEN 1 WHEN p.r + k.dr > 7 THEN 6 ELSE p.r + k.dr END) AND n.c = (CASE WHEN p.c + k.dc < 0 THEN 1 WHEN p.c + k.dc > 7 THEN 6 ELSE p.c + k.dc END)) GROUP BY id, r, c"""


@query(f"WITH {_PX}, {_shares(_SOBEL, 32, 0, 255)}")
def gradient_hist(spark, sf_dir):
    return pixels.gradient_histogram(_images(spark, sf_dir)).withColumn("share", F.round("share", 9))


_OFFSETS = ", ".join(f"({d}, {k}, {pixels.offset(d, a)[0]}, {pixels.offset(d, a)[1]})" for d in (1, 2) for k, a in enumerate(pixels.ANGLES))


@query(f"""WITH {_PX}, o AS (SELECT p.id, k.distance, k.angle, p.x * 8 // 256 AS a, n.x * 8 // 256 AS b FROM px p, (VALUES {_OFFSETS}) k(distance, angle, dr, dc), px n WHERE n.id = p.id AND n.r = p.r + k.dr AND n.c = p.c + k.dc),
s AS (SELECT * FROM o UNION ALL SELECT id, distance, angle, b, a FROM o), g AS (SELECT id, distance, angle, a, b, count(*)::DOUBLE AS n FROM s GROUP BY ALL), t AS (SELECT id, distance, angle, sum(n) AS t FROM g GROUP BY ALL)
SELECT id, distance, angle, round(sum(n / t * (a - b) ** 2), 9) AS contrast, round(sum(n / t * abs(a - b)), 9) AS dissimilarity, round(sum(n / t / (1 + (a - b) ** 2)), 9) AS homogeneity, round(sqrt(sum((n / t) ** 2)), 9) AS energy,
round(CASE WHEN sum(n / t * a * a) - sum(n / t * a) ** 2 < 1e-12 THEN 1 ELSE (sum(n / t * a * b) - sum(n / t * a) ** 2) / (sum(n / t * a * a) - sum(n / t * a) ** 2) END, 9) AS correlation
FROM g JOIN t USING (id, distance, angle) GROUP BY ALL""")
def glcm_props(spark, sf_dir):
    out = pixels.cooccurrence(_images(spark, sf_dir))
    return out.select("id", "distance", "angle", *(F.round(c, 9).alias(c) for c in pixels.PROPERTIES))


@query(f"""WITH {_PX}, b AS (SELECT p.id, p.r, p.c, sum(CASE WHEN coalesce(n.x, 0) >= p.x THEN 1 ELSE 0 END) AS ones, string_agg(CASE WHEN coalesce(n.x, 0) >= p.x THEN '1' ELSE '0' END, '' ORDER BY k.j) AS bits
FROM px p CROSS JOIN (VALUES (0, 0, 1), (1, -1, 0), (2, 0, -1), (3, 1, 0)) k(j, dr, dc) LEFT JOIN px n ON n.id = p.id AND n.r = p.r + k.dr AND n.c = p.c + k.dc GROUP BY p.id, p.r, p.c),
{_shares("SELECT id, CASE WHEN bits IN ('0101', '1010') THEN 5 ELSE ones END AS x FROM b", 6, 0, 6)}""")
def lbp_hist(spark, sf_dir):
    """With four neighbours, which lie on pixels; the eight of production lie between them."""
    return pixels.pattern_histogram(_images(spark, sf_dir), 1, 4, 6).withColumn("share", F.round("share", 9))


def _corners(points: int = 8, radius: int = 1) -> str:
    """(point, row offset, column offset, weight) of the pixels between which each point of the circle lies."""
    out = []
    for k in range(points):
        dr, dc = round(-radius * math.sin(2 * math.pi * k / points), 5), round(radius * math.cos(2 * math.pi * k / points), 5)
        r, c = math.floor(dr), math.floor(dc)
        out += [f"({k}, {r + a}, {c + b}, {abs(1 - a - dr + r) * abs(1 - b - dc + c)!r}::DOUBLE)" for a in (0, 1) for b in (0, 1)]
    return ", ".join(out)


@query(f"""WITH {_PX}, w AS (SELECT p.id, p.r, p.c, k.j, any_value(p.x) AS x, sum(coalesce(n.x, 0) * k.w) AS v FROM px p CROSS JOIN (VALUES {_corners()}) k(j, dr, dc, w) LEFT JOIN px n ON n.id = p.id AND n.r = p.r + k.dr AND n.c = p.c + k.dc GROUP BY p.id, p.r, p.c, k.j),
b AS (SELECT id, r, c, list((v + 1e-9 >= x)::INTEGER ORDER BY j) AS bits FROM w GROUP BY 1, 2, 3),
{_shares("SELECT id, CASE WHEN list_sum(list_transform(range(1, 9), lambda i: abs(bits[i] - bits[i % 8 + 1]))) <= 2 THEN list_sum(bits) ELSE 9 END AS x FROM b", 59, 0, 59)}""")
def lbp_hist_8(spark, sf_dir):
    """With the eight neighbours and 59 bins of production, which lie between pixels."""
    return pixels.pattern_histogram(_images(spark, sf_dir)).withColumn("share", F.round("share", 9))


@query(f"""WITH {_PX}, k AS (SELECT u.v AS u, x.v AS x, CASE WHEN u.v = 0 THEN sqrt(1 / 8.0::DOUBLE) ELSE sqrt(2 / 8.0::DOUBLE) END * cos(pi() * (2 * x.v + 1) * u.v / 16) AS w FROM (SELECT unnest(range(8)) AS v) u, (SELECT unnest(range(8)) AS v) x),
d AS (SELECT p.id, a.u, b.u AS v, sum(p.x / 255.0::DOUBLE * a.w * b.w) ** 2 AS e FROM px p JOIN k a ON a.x = p.r JOIN k b ON b.x = p.c GROUP BY ALL),
s AS (SELECT id, sum(CASE WHEN u < 1 AND v < 1 THEN e ELSE 0 END) AS low, sum(CASE WHEN u BETWEEN 1 AND 2 AND v BETWEEN 1 AND 2 THEN e ELSE 0 END) AS mid, sum(CASE WHEN u >= 3 AND v >= 3 THEN e ELSE 0 END) AS high FROM d GROUP BY 1)
SELECT id, round(low / (low + mid + high), 9) AS low, round(mid / (low + mid + high), 9) AS mid, round(high / (low + mid + high), 9) AS high FROM s""")
def dct_bands(spark, sf_dir):
    return pixels.cosine_bands(_images(spark, sf_dir)).select("id", *(F.round(c, 9).alias(c) for c in ("low", "mid", "high")))


@query(f"WITH {_PX} SELECT id, (r * 8 + 7 - c)::INTEGER AS place, x FROM px")
def augment_flip(spark, sf_dir):
    return pixels.flipped(_images(spark, sf_dir)).select("id", F.posexplode("px").alias("place", "x"))


@query(f"WITH {_PX} SELECT id, (r * 8 + c)::INTEGER AS place, trunc(least(x * 1.2::DOUBLE, 255))::INTEGER AS x FROM px")
def augment_brightness(spark, sf_dir):
    return pixels.brightened(_images(spark, sf_dir), 1.2).select("id", F.posexplode("px").alias("place", "x"))


@query(f"WITH {_PX} SELECT id, (r * 8 + c)::INTEGER AS place, least(round_even(x * 1.1::DOUBLE, 0), 255)::INTEGER AS x FROM px")
def augment_contrast(spark, sf_dir):
    return pixels.contrasted(_images(spark, sf_dir), 1.1).select("id", F.posexplode("px").alias("place", "x"))


@query(f"WITH {_PX} SELECT id, (c * 8 + 7 - r)::INTEGER AS place, x FROM px")
def frame_rotate(spark, sf_dir):
    return pixels.turned(_images(spark, sf_dir), F.lit(90)).select("id", F.posexplode("px").alias("place", "x"))


_EDGES = f"""WITH RECURSIVE {_PX}, k AS (SELECT * FROM (VALUES (-1), (0), (1)) a(dr), (VALUES (-1), (0), (1)) b(dc)),
g AS (SELECT p.id, p.r, p.c, sum(n.x * k.dc * (2 - abs(k.dr)))::BIGINT AS gx, sum(n.x * k.dr * (2 - abs(k.dc)))::BIGINT AS gy FROM px p, k, px n WHERE n.id = p.id AND n.r = least(greatest(p.r + k.dr, 0), 7) AND n.c = least(greatest(p.c + k.dc, 0), 7) GROUP BY ALL),
m AS MATERIALIZED (SELECT *, abs(gx) + abs(gy) AS m, CASE WHEN (gx < 0) <> (gy < 0) THEN -1 ELSE 1 END AS s FROM g),
w AS (SELECT m.*, CASE WHEN abs(gy) < abs(gx) * 0.41421356237309503::DOUBLE THEN 0 WHEN abs(gy) > abs(gx) * 2.414213562373095::DOUBLE THEN 1 ELSE s END AS sr, CASE WHEN abs(gy) < abs(gx) * 0.41421356237309503::DOUBLE THEN 'l' WHEN abs(gy) > abs(gx) * 2.414213562373095::DOUBLE THEN 'u' ELSE 'd' END AS way FROM m),
t AS (SELECT w.*, coalesce(a.m, 0) AS one, coalesce(b.m, 0) AS two FROM w
LEFT JOIN m a ON a.id = w.id AND a.r = w.r - (w.way <> 'l')::INT AND a.c = w.c - CASE w.way WHEN 'l' THEN 1 WHEN 'u' THEN 0 ELSE w.s END LEFT JOIN m b ON b.id = w.id AND b.r = w.r + (w.way <> 'l')::INT AND b.c = w.c + CASE w.way WHEN 'l' THEN 1 WHEN 'u' THEN 0 ELSE w.s END),
c AS MATERIALIZED (SELECT id, r, c, m > 200 AS strong FROM t WHERE m > 100 AND m > one AND CASE way WHEN 'd' THEN m > two ELSE m >= two END),
e AS (SELECT id, r, c FROM c WHERE strong UNION SELECT c.id, c.r, c.c FROM e JOIN c ON c.id = e.id AND abs(c.r - e.r) <= 1 AND abs(c.c - e.c) <= 1)
SELECT i.id, round(coalesce(n, 0) * 255.0::DOUBLE / 64, 6) AS density FROM (SELECT DISTINCT id FROM px) i LEFT JOIN (SELECT id, count(*) AS n FROM e GROUP BY 1) x ON x.id = i.id"""


@query(_EDGES)
def edge_density(spark, sf_dir):
    return edges.edge_density(_images(spark, sf_dir)).withColumn("density", F.round("density", 6))


def _warped_sql(row: str, col: str, low: float, high: float) -> str:
    """A gather through (row, col), expressions in r, c and the image's drawn number a."""
    inside = lambda x: f"least(greatest({x}, 0), 7)"
    return f"""WITH {_PX}, a AS (SELECT id, {low} + {high - low} * ('0x' || substr(md5('7-' || id), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS a FROM (SELECT DISTINCT id FROM px)),
s AS (SELECT id, r, c, {inside(row)} AS y, {inside(col)} AS x FROM px JOIN a USING (id)), f AS (SELECT *, floor(y)::INTEGER AS i, floor(x)::INTEGER AS j FROM s)
SELECT f.id, (f.r * 8 + f.c)::INTEGER AS place, round_even((t.x * (1 - (f.x - j)) + u.x * (f.x - j)) * (1 - (y - i)) + (v.x * (1 - (f.x - j)) + w.x * (f.x - j)) * (y - i), 0)::INTEGER AS x FROM f
JOIN px t ON t.id = f.id AND t.r = i AND t.c = j JOIN px u ON u.id = f.id AND u.r = i AND u.c = least(j + 1, 7) JOIN px v ON v.id = f.id AND v.r = least(i + 1, 7) AND v.c = j JOIN px w ON w.id = f.id AND w.r = least(i + 1, 7) AND w.c = least(j + 1, 7)"""


@query(_warped_sql("4 + (r - 4) * cos(a * (pi() / 180)) + (c - 4) * sin(a * (pi() / 180))", "4 + (c - 4) * cos(a * (pi() / 180)) - (r - 4) * sin(a * (pi() / 180))", -15.0, 15.0))
def augment_rotate(spark, sf_dir):
    """Each image turned by an angle between -15 and 15 degrees, drawn by hash."""
    return _each(warps.rotated(_images(spark, sf_dir), warps.drawn("id", 7, -15.0, 15.0)), "px", 64, "place", "x")


_RADIAL = "(1 + a * (((c - 4) / 8.0::DOUBLE) * ((c - 4) / 8.0::DOUBLE) + ((r - 4) / 8.0::DOUBLE) * ((r - 4) / 8.0::DOUBLE)))"


@query(_warped_sql(f"4.0::DOUBLE + (r - 4) / 8.0::DOUBLE * {_RADIAL} * 8", f"4.0::DOUBLE + (c - 4) / 8.0::DOUBLE * {_RADIAL} * 8", -0.1, 0.1))
def augment_bulge(spark, sf_dir):
    """Each image distorted radially, by a strength drawn by hash."""
    return _each(warps.bulged(_images(spark, sf_dir), warps.drawn("id", 7, -0.1, 0.1)), "px", 64, "place", "x")


def _oriented_sql(dealt: bool) -> str:
    """Cells of 2 x 2 pixels, so 4 x 4 cells and 3 x 3 blocks of 2 x 2 cells."""
    votes = "SELECT id, cell, (low + 9) % 9 AS bin, m * (1 - (turn - 0.5 - low)) AS v FROM t UNION ALL SELECT id, cell, (low + 10) % 9, m * (turn - 0.5 - low) FROM t" if dealt else "SELECT id, cell, least(floor(turn), 8)::BIGINT AS bin, m AS v FROM t"
    return f"""WITH {_PX}, g AS (SELECT p.id, p.r, p.c, CASE WHEN p.r BETWEEN 1 AND 6 THEN d.x - u.x ELSE 0 END AS gd, CASE WHEN p.c BETWEEN 1 AND 6 THEN k.x - l.x ELSE 0 END AS gr FROM px p
LEFT JOIN px d ON d.id = p.id AND d.c = p.c AND d.r = p.r + 1 LEFT JOIN px u ON u.id = p.id AND u.c = p.c AND u.r = p.r - 1 LEFT JOIN px k ON k.id = p.id AND k.r = p.r AND k.c = p.c + 1 LEFT JOIN px l ON l.id = p.id AND l.r = p.r AND l.c = p.c - 1),
o AS (SELECT id, r // 2 * 4 + c // 2 AS cell, sqrt(gd::DOUBLE * gd + gr::DOUBLE * gr) AS m, atan2(gd, gr) * (180 / pi()) AS a FROM g), t AS (SELECT *, floor(turn - 0.5)::BIGINT AS low FROM (SELECT *, (CASE WHEN a < 0 THEN a + 180 WHEN a >= 180 THEN a - 180 ELSE a END) / 20 AS turn FROM o)),
h AS (SELECT id, cell, bin, sum(v) / 4 AS v FROM ({votes}) GROUP BY ALL),
b AS (SELECT i.id, k.b, k.p * 9 + k.bin AS place, coalesce(h.v, 0) AS v FROM (SELECT DISTINCT id FROM px) i CROSS JOIN (SELECT b, p, bin, (b // 3 + p // 2) * 4 + b % 3 + p % 2 AS cell FROM range(9) x(b), range(4) y(p), range(9) z(bin)) k LEFT JOIN h ON h.id = i.id AND h.cell = k.cell AND h.bin = k.bin),
n AS (SELECT *, least(v / sqrt(sum(v * v) OVER (PARTITION BY id, b) + 1e-10), 0.2) AS u FROM b)
SELECT id, (b * 36 + place)::INTEGER AS k, round(u / sqrt(sum(u * u) OVER (PARTITION BY id, b) + 1e-10), 6) AS x FROM n"""


def _oriented(spark, sf_dir, dealt: bool) -> DataFrame:
    rows = _images(spark, sf_dir).withColumn("v", oriented(F.col("px"), F.col("height"), F.col("width"), cell=2, dealt=dealt))
    return _each(rows, "v", 324, "k", "x").withColumn("x", F.round("x", 6))


@query(_oriented_sql(False))
def oriented_gradients(spark, sf_dir):
    """With cells of 2 x 2 pixels, as the images are small; each pixel votes for one bin."""
    return _oriented(spark, sf_dir, False)


@query(_oriented_sql(True))
def oriented_gradients_dealt(spark, sf_dir):
    """The same with votes dealt between two bins."""
    return _oriented(spark, sf_dir, True)


# --- colour: the first 48 values of an embedding stand in for 4 x 4 pixels of three colours, which are enlarged to 8 x 8

_SIDE = 8


def _colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 48), lambda x: F.least(F.greatest(F.floor((x + 0.5) * 256), F.lit(0)), F.lit(255)).cast("int"))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.lit(4).alias("height"), F.lit(4).alias("width"), rgb.alias("rgb"))


def _each(rows: DataFrame, column: str, n: int, place: str, value: str) -> DataFrame:
    """id, place, value of the n members of an array. (An explode of the array itself would have it worked out once more, to filter by its size.)"""
    return rows.select("id", column, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(place)).select("id", place, F.get(column, place).alias(value))


_BILINEAR = "(t.x * (1 - c.f) + u.x * c.f) * (1 - r.f) + (v.x * (1 - c.f) + w.x * c.f) * r.f"
_LINE = "CASE WHEN {0} / 255.0::DOUBLE <= 0.04045 THEN {0} / 255.0::DOUBLE / 12.92 ELSE (({0} / 255.0::DOUBLE + 0.055) / 1.055) ** 2.4 END"
_CUBE = "CASE WHEN {0} > 0.008856 THEN {0} ** (1 / 3.0::DOUBLE) ELSE {0} * 7.787 + 16 / 116.0::DOUBLE END"
_HUE = "CASE WHEN hi = lo THEN 0 ELSE 60 * CASE hi WHEN red THEN (green - blue) / (hi - lo)::DOUBLE WHEN green THEN 2 + (blue - red) / (hi - lo)::DOUBLE ELSE 4 + (red - green) / (hi - lo)::DOUBLE END END"
_SAMPLED = f"""small AS (SELECT id, i // 12 AS r, i // 3 % 4 AS c, i % 3 AS k, x FROM (SELECT vec_id AS id, unnest(range(48)) AS i, least(greatest(floor((unnest(embedding[1:48]::DOUBLE[]) + 0.5) * 256), 0), 255)::INTEGER AS x FROM embeddings)),
step AS (SELECT k, floor(x)::INTEGER AS i, least(floor(x) + 1, 3)::INTEGER AS j, x - floor(x) AS f FROM (SELECT k, greatest(least((k + 0.5::DOUBLE) * 4 / {_SIDE} - 0.5, 3), 0) AS x FROM (SELECT unnest(range({_SIDE})) AS k))),
large AS (SELECT t.id, r.k AS r, c.k AS c, t.k, least(greatest(round_even({_BILINEAR}, 0), 0), 255)::INTEGER AS x FROM step r, step c, small t, small u, small v, small w
WHERE t.r = r.i AND t.c = c.i AND u.id = t.id AND u.k = t.k AND u.r = r.i AND u.c = c.j AND v.id = t.id AND v.k = t.k AND v.r = r.j AND v.c = c.i AND w.id = t.id AND w.k = t.k AND w.r = r.j AND w.c = c.j),
rgb AS (SELECT id, r, c, any_value(x) FILTER (k = 0) AS red, any_value(x) FILTER (k = 1) AS green, any_value(x) FILTER (k = 2) AS blue FROM large GROUP BY ALL),
lin AS (SELECT *, greatest(red, green, blue) AS hi, least(red, green, blue) AS lo, {_LINE.format('red')} AS lr, {_LINE.format('green')} AS lg, {_LINE.format('blue')} AS lb FROM rgb),
xyz AS (SELECT *, (lr * 0.412453 + lg * 0.357580 + lb * 0.180423) / 0.950456 AS x, (lr * 0.212671 + lg * 0.715160 + lb * 0.072169) / 1.0 AS y, (lr * 0.019334 + lg * 0.119193 + lb * 0.950227) / 1.088754 AS z, {_HUE} AS h FROM lin),
f AS (SELECT *, {_CUBE.format('x')} AS fx, {_CUBE.format('y')} AS fy, {_CUBE.format('z')} AS fz FROM xyz),
seen AS MATERIALIZED (SELECT id, r, c, red, green, blue, round_even(red * 0.299::DOUBLE + green * 0.587::DOUBLE + blue * 0.114::DOUBLE, 0)::INTEGER AS gray, round_even(CASE WHEN h < 0 THEN h + 360 ELSE h END / 2, 0)::INTEGER % 180 AS hue,
round_even(255 * (hi - lo) / greatest(hi, 1)::DOUBLE, 0)::INTEGER AS saturation, hi AS value, least(greatest(round_even(CASE WHEN y > 0.008856 THEN fy * 116 - 16 ELSE y * 903.3 END * 255 / 100, 0), 0), 255)::INTEGER AS light,
least(greatest(round_even((fx - fy) * 500 + 128, 0), 0), 255)::INTEGER AS a, least(greatest(round_even((fy - fz) * 200 + 128, 0), 0), 255)::INTEGER AS b FROM f)"""


@query(f"WITH {_SAMPLED} SELECT id, (r * {_SIDE} + c)::INTEGER AS place, gray, hue, saturation, value, light, a, b, red, green, blue FROM seen")
def image_preprocess(spark, sf_dir):
    """Small colour images resized, and each pixel's gray, HSV and LAB."""
    rows = features.preprocessed(_colours(spark, sf_dir), _SIDE)
    return _each(rows, "pixels", _SIDE * _SIDE, "place", "p").select("id", "place", "p.*")


def _block_shares(name: str, values: str, bins: int, low: float, high: float, start: int) -> str:
    """A table of (id, k, x): shares of the values by bin, from place `start` of the vector on; zeros are left out."""
    w = (high - low) / bins
    return f"""{name} AS (SELECT id, {start} + bin AS k, n / sum(n) OVER (PARTITION BY id)::DOUBLE AS x FROM (SELECT id, least(floor((x - {low}) / {w}), {bins - 1})::BIGINT AS bin, count(*) AS n FROM ({values}) WHERE x BETWEEN {low} AND {high} GROUP BY 1, 2))"""


def _vector_sql() -> str:
    start = {name: at for name, at, _ in vectors.layout()}
    lbp = lambda radius: f"""lw{radius} AS (SELECT p.id, p.r, p.c, k.j, any_value(p.x) AS x, sum(coalesce(n.x, 0) * k.w) AS v FROM px p CROSS JOIN (VALUES {_corners(8, radius)}) k(j, dr, dc, w) LEFT JOIN px n ON n.id = p.id AND n.r = p.r + k.dr AND n.c = p.c + k.dc GROUP BY p.id, p.r, p.c, k.j),
lb{radius} AS (SELECT id, r, c, list((v + 1e-9 >= x)::INTEGER ORDER BY j) AS bits FROM lw{radius} GROUP BY 1, 2, 3),
{_block_shares(f"lh{radius}", f"SELECT id, CASE WHEN list_sum(list_transform(range(1, 9), lambda i: abs(bits[i] - bits[i % 8 + 1]))) <= 2 THEN list_sum(bits) ELSE 9 END AS x FROM lb{radius}", 59, 0, 59, start["lbp_multi_radius"] + 59 * (radius - 1))}"""  # noqa: E731
    tables, parts = [f"px AS (SELECT id, r, c, gray AS x FROM seen)", *(lbp(r) for r in (1, 2, 3))], ["lh1", "lh2", "lh3"]
    tables.append(f"""o AS (SELECT p.id, k.distance, k.angle, p.x * 8 // 256 AS a, n.x * 8 // 256 AS b FROM px p, (VALUES {_OFFSETS}) k(distance, angle, dr, dc), px n WHERE n.id = p.id AND n.r = p.r + k.dr AND n.c = p.c + k.dc),
os AS (SELECT * FROM o UNION ALL SELECT id, distance, angle, b, a FROM o), og AS (SELECT id, distance, angle, a, b, count(*)::DOUBLE AS n FROM os GROUP BY ALL), ot AS (SELECT id, distance, angle, sum(n) AS t FROM og GROUP BY ALL),
op AS (SELECT id, 4 * (distance - 1) + angle AS k, [sum(n / t * (a - b) ** 2), sum(n / t / (1 + (a - b) ** 2)), sqrt(sum((n / t) ** 2))] AS v FROM og JOIN ot USING (id, distance, angle) GROUP BY ALL),
glcm AS (SELECT id, {start["glcm"]} + 8 * p + k AS k, v[p + 1] AS x FROM op, (SELECT unnest(range(3)) AS p))""")
    parts.append("glcm")
    for space in ("hsv", "lab"):
        long = "SELECT id, unnest(range(3)) AS ch, unnest([%s]) AS x FROM seen" % ", ".join(vectors.CHANNELS[space])
        tables.append(f"""m{space} AS (SELECT id, ch, avg(x) AS m, stddev_pop(x) AS sd FROM ({long}) GROUP BY 1, 2), k{space} AS (SELECT id, ch, any_value(m) AS m, any_value(sd) AS sd, CASE WHEN any_value(sd) <= 1e-6 THEN 0 ELSE avg(((x - m) / sd) ** 3) END AS skew FROM ({long}) JOIN m{space} USING (id, ch) GROUP BY 1, 2),
moments{space} AS (SELECT id, {start["color_moments_" + space]} + 3 * ch + p AS k, [m, sd, skew][p + 1] AS x FROM k{space}, (SELECT unnest(range(3)) AS p))""")
        parts.append(f"moments{space}")
    for k, c in enumerate(vectors.CHANNELS["hsv"]):
        tables.append(_block_shares(f"hist{c}", f"SELECT id, {c} AS x FROM seen", 16, 0, 256, start["color_hist_hsv"] + 16 * k))
        parts.append(f"hist{c}")
    tables.append(_block_shares("grad", _SOBEL, 32, 0, 255, start["gradient_mag_hist"]))
    tables.append(f"""spec AS (SELECT id, {start["specular_ratio"]} AS k, avg((value >= 240)::INTEGER::DOUBLE) AS x FROM seen GROUP BY 1)""")
    tables.append(f"""ck AS (SELECT u.v AS u, x.v AS x, CASE WHEN u.v = 0 THEN sqrt(1 / 8.0::DOUBLE) ELSE sqrt(2 / 8.0::DOUBLE) END * cos(pi() * (2 * x.v + 1) * u.v / 16) AS w FROM (SELECT unnest(range(8)) AS v) u, (SELECT unnest(range(8)) AS v) x),
cd AS (SELECT p.id, g.u, h.u AS v, sum(p.x / 255.0::DOUBLE * g.w * h.w) ** 2 AS e FROM px p JOIN ck g ON g.x = p.r JOIN ck h ON h.x = p.c GROUP BY ALL),
cs AS (SELECT id, [coalesce(sum(e) FILTER (u < 1 AND v < 1), 0), coalesce(sum(e) FILTER (u BETWEEN 1 AND 2 AND v BETWEEN 1 AND 2), 0), coalesce(sum(e) FILTER (u >= 3 AND v >= 3), 0)] AS e FROM cd GROUP BY 1),
dct AS (SELECT id, {start["dct_energy_bands"]} + p AS k, e[p + 1] / greatest(list_sum(e), 1e-12) AS x FROM cs, (SELECT unnest(range(3)) AS p))""")
    parts += ["grad", "spec", "dct"]
    dims = sum(n for _, _, n in vectors.layout())
    every = " UNION ALL ".join(f"SELECT id, k, x FROM {p}" for p in parts)
    return f"""WITH {_SAMPLED}, {', '.join(tables)}, every AS ({every})
SELECT g.id, d.k::INTEGER AS k, round(coalesce(e.x, 0)::FLOAT::DOUBLE, 4) + 0.0 AS x FROM (SELECT DISTINCT id FROM seen) g CROSS JOIN (SELECT unnest(range({dims})) AS k) d LEFT JOIN every e ON e.id = g.id AND e.k = d.k"""


@query(_vector_sql())
def image_feature_vector(spark, sf_dir):
    """All blocks' numbers of each small colour image, by expressions over its own row; rounded, as they are 32-bit numbers."""
    rows = features.expressed(_colours(spark, sf_dir), side=_SIDE)
    dims = sum(n for _, _, n in vectors.layout())
    return _each(rows, "features", dims, "k", "x").withColumn("x", F.round(F.col("x").cast("double"), 4) + F.lit(0.0))


@query(f"""WITH v AS (SELECT vec_id AS id, len(embedding) AS n FROM embeddings), l AS (SELECT unnest({[n for n, _, _ in vectors.layout(vectors.FULL)]}) AS block, unnest({[a for _, a, _ in vectors.layout(vectors.FULL)]}) AS start, unnest({[n for _, _, n in vectors.layout(vectors.FULL)]}) AS size)
SELECT block, start::INTEGER AS start, size::INTEGER AS size, count(*) AS images FROM l, v WHERE n >= 48 GROUP BY ALL""")
def feature_layout(spark, sf_dir):
    """Where each block stands in the vectors, and how many of the table's images have a vector that reaches over it."""
    spots = spark.createDataFrame(vectors.layout(vectors.FULL), "block string, start int, size int")
    images = _colours(spark, sf_dir).repartition(4 * spark.sparkContext.defaultParallelism)  # few bytes and much work: dealt to all cores
    rows = keep(features.expressed(images, vectors.FULL, side=_SIDE).select(F.size("features").alias("n")))
    return rows.join(F.broadcast(spots), F.col("n") >= F.col("start") + F.col("size")).groupBy("block", "start", "size").agg(F.count("*").alias("images"))


_FILTERS = "SELECT s.i * 8 + l.i * 4 + t.i AS k, s.v::DOUBLE AS sigma, l.v::DOUBLE AS lam, t.i * pi() / 4 AS theta FROM (VALUES (0, 2), (1, 4)) s(i, v), (VALUES (0, 6), (1, 10)) l(i, v), range(4) t(i)"
_FOLD = "least((({0} + {1}) % 14 + 14) % 14, 14 - (({0} + {1}) % 14 + 14) % 14)"


@query(f"""WITH {_PX}, f AS ({_FILTERS}), t AS (SELECT k, sigma, lam, y.v - 15 AS dy, x.v - 15 AS dx, (x.v - 15) * cos(theta) + (y.v - 15) * sin(theta) AS u, (y.v - 15) * cos(theta) - (x.v - 15) * sin(theta) AS v FROM f, range(31) y(v), range(31) x(v)),
w AS (SELECT k, r.v AS r, c.v AS c, {_FOLD.format('r.v', 'dy')} AS qr, {_FOLD.format('c.v', 'dx')} AS qc, sum(exp(-(u * u + 0.25::DOUBLE * t.v * t.v) / (2 * sigma * sigma)) * cos(2 * pi() * u / lam)) AS w FROM t, range(8) r(v), range(8) c(v) GROUP BY ALL),
a AS (SELECT p.id, w.k, w.r, w.c, sum(p.x * w.w) AS y FROM px p JOIN w ON w.qr = p.r AND w.qc = p.c GROUP BY ALL)
SELECT id, k::INTEGER AS k, round(avg(y), 6) + 0.0 AS mean, round(stddev_pop(y), 6) AS sd FROM a GROUP BY ALL""")
def filter_responses(spark, sf_dir):
    """Mean and deviation of each image's responses to 16 oriented filters of 31 x 31 pixels."""
    rows = _images(spark, sf_dir).where(F.size("px") == _SIDE * _SIDE)
    rows = rows.withColumn("v", vectors.gabor({"gray": F.col("px"), "side": _SIDE}))
    at = rows.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"))
    return at.select("id", "k", (F.round(F.get("v", F.col("k") * 2), 6) + F.lit(0.0)).alias("mean"), F.round(F.get("v", F.col("k") * 2 + 1), 6).alias("sd"))


@query(f"""WITH {_PX}, w AS (SELECT p.id, u.v AS u, v.v AS v, sum(p.x / 255.0::DOUBLE * cos(2 * pi() * (u.v * p.r + v.v * p.c) / 8)) ** 2 + sum(p.x / 255.0::DOUBLE * sin(2 * pi() * (u.v * p.r + v.v * p.c) / 8)) ** 2 AS e FROM px p, range(8) u(v), range(8) v(v) GROUP BY ALL),
d AS (SELECT id, e, sqrt((((u + 4) % 8 - 4) ** 2 + ((v + 4) % 8 - 4) ** 2)::DOUBLE) / sqrt(32.0::DOUBLE) AS far FROM w),
b AS (SELECT id, sum(CASE WHEN far <= 0.15 THEN e ELSE 0 END) AS low, sum(CASE WHEN far > 0.15 AND far <= 0.4 THEN e ELSE 0 END) AS mid, sum(CASE WHEN far > 0.4 THEN e ELSE 0 END) AS high FROM d GROUP BY 1)
SELECT id, round(low / greatest(low + mid + high, 1e-12), 9) AS low, round(mid / greatest(low + mid + high, 1e-12), 9) AS mid, round(high / greatest(low + mid + high, 1e-12), 9) AS high FROM b""")
def spectrum_bands(spark, sf_dir):
    """Shares of the Fourier spectrum's energy near, around and far from frequency 0."""
    rows = _images(spark, sf_dir).where(F.size("px") == _SIDE * _SIDE)
    return rows.select("id", vectors.fft_bands({"gray": F.col("px"), "side": _SIDE}).alias("v")).select("id", *(F.round(F.get("v", F.lit(k)), 9).alias(c) for k, c in enumerate(("low", "mid", "high"))))


@query(f"""WITH {_SAMPLED}, n AS (SELECT id, least(hue * 8 // 180, 7) * 64 + value // 32 + saturation // 32 * 8 AS k, count(*) AS n FROM seen GROUP BY ALL)
SELECT id, k::INTEGER AS k, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)::DOUBLE), 9) AS x FROM n""")
def joint_histogram(spark, sf_dir):
    """Hue, saturation and value of each small colour image together: the bins that are not 0 of a vector of length 1."""
    rows = features.preprocessed(_colours(spark, sf_dir), _SIDE, out="seen")
    rows = rows.withColumn("v", vectors.joint_hist(vectors.sample(F.col("seen"), _SIDE)))
    # coalesce, so that no null check of the whole expression is pushed below the explode
    return _each(rows, "v", 512, "k", "x").where("coalesce(x, 0) > 0").withColumn("x", F.round("x", 9))


@query()
def image_feature_vector_numpy(spark, sf_dir):
    """The 335 numbers of each pseudo-image with the filter responses that only the NumPy blocks have; 8 x 8 pixels are enlarged to 64 x 64."""
    # a file's rows are few bytes and much work, so they are dealt to all cores
    rows = _images(spark, sf_dir).repartition(4 * spark.sparkContext.defaultParallelism)
    rows = rows.select("id", "height", "width", F.transform("px", lambda x: F.array(x, x, x)).alias("rgb")).withColumn("rgb", F.flatten("rgb"))
    return features.extract(rows, DEFAULT, side=64)


@query(f"""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
g AS (SELECT user_id, k, event_id, ms, ms AS kept_ms, TRUE AS kept FROM e WHERE k = 1 UNION ALL
SELECT e.user_id, e.k, e.event_id, e.ms, CASE WHEN e.ms - g.kept_ms < {INTERVAL_MS} THEN g.kept_ms ELSE e.ms END, e.ms - g.kept_ms >= {INTERVAL_MS} FROM g JOIN e ON e.user_id = g.user_id AND e.k = g.k + 1)
SELECT event_id, user_id FROM g WHERE kept""")
def frame_throttle(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return throttle(events, "user_id", "ms", "event_id", INTERVAL_MS).select("event_id", "user_id")


@query()
def svm_linear_predict(spark, sf_dir):
    train, val = tabular._scaled(spark, sf_dir)
    return svm.predict(svm.train(train, weights(counts(train))), val).select("id", "predicted")


@query()
def svm_rbf_predict(spark, sf_dir):
    train, val = tabular._scaled(spark, sf_dir)
    mapped = svm.feature_map("rbf", svm.gamma_of("scale", train), 64)
    as_map = lambda df: df.withColumn("features", mapped(F.col("features")))
    return svm.predict(svm.train(as_map(train), weights(counts(train)), cost=10.0), as_map(val)).select("id", "predicted")
