"""Labels from paths, label codes, and orders that do not depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of images, codes of labels, what an unknown label is called.
SUFFIXES = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".webp")
CODES = {"glass": 0, "paper": 1, "cardboard": 2, "plastic": 3, "metal": 4, "trash": 5, "unknown": 6}
UNKNOWN = "unknown"


def unescaped(path: Column) -> Column:
    """Percent escapes of a URI resolved; other characters, `+` too, stay."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def label_of(path: Column, escaped: bool = True) -> Column:
    """The name of the folder that holds the file; percent escapes of file: paths are resolved, unless they are none."""
    plain = F.when(path.startswith("file:"), unescaped(path)).otherwise(path) if escaped else path
    return F.element_at(F.split(plain, "/"), -2)


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def is_image(path: Column) -> Column:
    return suffix_of(path).isin(*SUFFIXES)


def code_of(label: Column) -> Column:
    """The label's code; labels without one get that of `unknown`."""
    table = F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair))
    return F.coalesce(table[F.lower(label)], F.lit(CODES[UNKNOWN]))


def shuffled(seed: int, key: Column) -> Column:
    """A hexadecimal hash of seed and key: rows in its order are in random order, and in the same at every run."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), key.cast("string")).cast("binary"))


def half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def l2_normalised(v: Column) -> Column:
    """v over its length; the zero vector as it is."""
    v = v.cast("array<double>")
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(size > 0, F.transform(v, lambda x: x / size)).otherwise(v)


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    exps = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(exps, lambda e: e / F.aggregate(exps, F.lit(0.0), lambda a, b: a + b))
