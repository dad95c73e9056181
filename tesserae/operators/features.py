"""Feature vectors of images: Spark deals out rows, tasks call the blocks on one image at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tesserae.functions import vectors
from tesserae.functions.blocks import DEFAULT, Block, layout, vector
from tesserae.functions.names import fresh


def _pixels(height: int, width: int, data) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else np.asarray(data)
    channels = raw.size // max(height * width, 1)
    img = raw.reshape(height, width, channels)
    return np.repeat(img[:, :, :1], 3, axis=2) if channels < 3 else img


def extract(images: DataFrame, blocks: tuple[Block, ...] = DEFAULT, side: int = 256, pixels: str = "rgb") -> DataFrame:
    """The rows, with `features` and `error` in place of the pixels (bytes or numbers in row order).

    A row whose pixels are missing or cannot be read keeps its place, with null features and the reason in `error`.
    """
    names = [c for c in images.columns if c not in (pixels, "features", "error")]
    schema = "".join(f"`{c}` {images.schema[c].dataType.simpleString()}, " for c in names) + "features array<float>, error string"

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                b = batch.slice(k, 64)
                found, errors = [], []
                for h, w, data in zip(b.column("height").to_pylist(), b.column("width").to_pylist(), b.column(pixels).to_pylist(), strict=True):
                    try:
                        if not data or not h or h < 0:
                            raise ValueError("no pixels")
                        found.append(vector(_pixels(h, w, data), blocks, side)), errors.append(None)
                    except ValueError as e:
                        found.append(None), errors.append(str(e))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(found, pa.list_(pa.float32())), pa.array(errors, pa.string())], [*names, "features", "error"])

    return images.mapInArrow(run, schema)


def preprocessed(images: DataFrame, side: int = 256, pixels: str = "rgb", out: str = "pixels") -> DataFrame:
    """Adds `out` (an array of side * side structs: gray, hue, saturation, value, light, a, b, red, green, blue) to rows of (height, width, pixels).

    pixels: numbers in row order, red, green, blue or also alpha (which is dropped), clipped to 0 to 255. Rows without pixels, or with a
    number of them that does not fit height and width, get null.
    """
    n = F.col("height") * F.col("width")
    size = F.size(pixels)
    rgb = F.transform(F.col(pixels), lambda x: F.least(F.greatest(x, F.lit(0)), F.lit(255)))
    # of four channels the last one goes
    rgb = F.when(size == 4 * n, F.filter(rgb, lambda x, k: k % 4 != 3)).when(size == 3 * n, rgb)
    (flat,) = fresh(images, "flat")
    fits = (F.col("height") > 0) & (F.col("width") > 0) & F.col(flat).isNotNull()
    small = vectors.resized(F.col(flat), F.col("height"), F.col("width"), side)
    return images.withColumn(flat, rgb).withColumn(out, F.when(fits, F.transform(small, vectors.converted))).drop(flat)


def expressed(images: DataFrame, blocks: tuple[vectors.Block, ...] = vectors.REGISTRY, side: int = 256, pixels: str = "rgb") -> DataFrame:
    """As extract(), by expressions alone: the rows with `features` and `error` in place of the pixels (numbers in row order)."""
    (s,) = fresh(images, "sample")
    rows = preprocessed(images, side, pixels, s)
    found = F.when(F.col(s).isNotNull(), vectors.vector(vectors.sample(F.col(s), side), blocks))
    names = [c for c in images.columns if c not in (pixels, "features", "error")]
    return rows.select(*names, found.alias("features"), F.when(F.col(s).isNull(), F.lit("no pixels, or as many as do not fit")).alias("error"))


# Means and deviations of red, green and blue.
CHANNEL_MEANS, CHANNEL_DEVIATIONS = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def imagenet_normalised(rgb: Column) -> Column:
    """Numbers 0 to 255 in row order, red, green, blue: divided by 255, less the channel's mean, over its deviation."""
    of = lambda values, k: F.element_at(F.array(*(F.lit(x) for x in values)), (k % 3 + 1).cast("int"))
    return F.transform(rgb, lambda x, k: (x / 255.0 - of(CHANNEL_MEANS, k)) / of(CHANNEL_DEVIATIONS, k))


def dimensions(blocks: tuple[Block, ...] = DEFAULT) -> int:
    return sum(n for _, _, n in layout(blocks))


def with_embeddings(df: DataFrame, embed, column: str, out: str = "features") -> DataFrame:
    """Adds vectors from a function over a batch (list of values to list of vectors), as a stand-in for any embedding model."""

    @F.pandas_udf("array<float>")
    def run(values):
        import pandas as pd

        return pd.Series(list(embed(list(values))))

    return df.withColumn(out, run(F.col(column)))


def checked(df: DataFrame, dims: int, vector_column: str = "features") -> DataFrame:
    """Stops the job at a vector of another length than dims."""
    v: Column = F.col(vector_column)
    wrong = F.concat(F.lit("vector length "), F.size(v).cast("string"), F.lit(f", expected {dims}"))
    return df.withColumn(vector_column, F.when(v.isNull() | (F.size(v) == dims), v).otherwise(F.raise_error(wrong)))


def is_bytes(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, BinaryType)
