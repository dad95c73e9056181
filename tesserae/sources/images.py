"""Folders of images as tables: listing, decoding, what does not decode, and requests with images inside."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.labels import is_image, label_of, suffix_of, unescaped
from tesserae.functions.names import fresh
from tesserae.sources.scratch import keep


def _plain_path(path):
    """file:///a and file:/a are one path."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def opened(path: str):
    """(Arrow file system, path in it, what to put before its paths) of a local path or an address."""
    from pyarrow import fs

    if path.startswith(("/", "file:")):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/"), "file:"
    files, inner = fs.FileSystem.from_uri(path)
    return files, inner, path[: len(path) - len(inner)] if path.endswith(inner) else ""


def _entries(batches):
    """path, length and folder (whether it is one) of what is in each directory, empty files too."""
    from pyarrow import fs

    for b in batches:
        for path in b.column("path").to_pylist():
            files, inner, head = opened(path)
            found = [(head + x.path, x.size or 0, x.type == fs.FileType.Directory) for x in files.get_file_info(fs.FileSelector(inner, recursive=False))]
            for k in range(0, len(found), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found[k : k + 10_000], strict=True)], ["path", "length", "folder"])


def listing(spark: SparkSession, root: str, suffixes: bool = True) -> DataFrame:
    """path, length, label, suffix of all files below root, empty ones too (the binaryFile source leaves those out).

    Tasks list directories, level by level; the driver sees neither names nor contents of files. root: a local path, or an address that
    Arrow's file systems know.
    """
    todo, found = spark.createDataFrame([(root.rstrip("/") or "/",)], "path string"), None
    while True:
        level = keep(todo.mapInArrow(_entries, "path string, length long, folder boolean"))
        files = level.where("not folder").select("path", "length")
        found = files if found is None else found.unionByName(files)
        todo = level.where("folder").select("path")
        if todo.isEmpty():
            break
        todo = todo.repartition(spark.sparkContext.defaultParallelism)
    df = found.withColumn("path", _plain_path(F.col("path")))
    df = df.withColumns({"label": label_of(F.col("path"), escaped=False), "suffix": suffix_of(F.col("path"))})
    return df.where(is_image(F.col("path"))) if suffixes else df


def sorted_listing(spark: SparkSession, root: str) -> DataFrame:
    return listing(spark, root).orderBy(F.lower("path"), "path")


def images(spark: SparkSession, root: str, keep_invalid: bool = False) -> DataFrame:
    """path, label, height, width, rgb (bytes in row order) of images that Spark's image source decodes.

    With keep_invalid, rows that do not decode stay, with null pixels.
    """
    raw = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", str(not keep_invalid).lower()).load(root)
    return decoded(raw)


def decoded(raw: DataFrame) -> DataFrame:
    """Rows of the image source (batch or stream) with colours in RGB order; gray and alpha become three channels."""

    @F.pandas_udf("binary")
    def to_rgb(data, channels):
        import numpy as np
        import pandas as pd

        def one(x, c):
            px = np.frombuffer(x, np.uint8).reshape(-1, c)
            return (np.repeat(px[:, :1], 3, 1) if c == 1 else px[:, 2::-1]).tobytes()

        return pd.Series([one(x, c) if x is not None and c in (1, 3, 4) else None for x, c in zip(data, channels, strict=True)])

    path = _plain_path(unescaped(F.col("image.origin")))  # the source gives URIs
    ok = F.col("image.height") > 0
    return raw.select(
        path.alias("path"), label_of(path, escaped=False).alias("label"), F.when(ok, F.col("image.height")).alias("height"), F.when(ok, F.col("image.width")).alias("width"),
        to_rgb(F.when(ok, F.col("image.data")), "image.nChannels").alias("rgb"),
    )


def quarantine(spark: SparkSession, root: str) -> DataFrame:
    """path, label, length, reason of listed images that do not decode: `empty`, `unsupported` (webp) or `unreadable`. Nothing is deleted."""
    good = images(spark, root).select("path")
    bad = listing(spark, root).join(good, "path", "left_anti")
    reason = F.when(F.col("length") == 0, "empty").when(F.col("suffix") == ".webp", "unsupported").otherwise("unreadable")
    return bad.select("path", "label", "length", reason.alias("reason"))


REQUEST = "image string, classifier string"


def requests(rows: DataFrame, column: str = "value") -> DataFrame:
    """JSON requests: content (decoded base64, null if it is none), classifier, error (null if the request is good)."""
    taken = [c for c in rows.columns if c.lower() in ("content", "classifier", "error")]
    if taken:
        raise ValueError(f"requests have columns that are to be added: {taken}")
    (asked,) = fresh(rows, "asked")
    r = rows.withColumn(asked, F.from_json(column, REQUEST)).withColumn("content", F.try_to_binary(F.col(f"{asked}.image"), F.lit("base64")))
    name = F.lower(F.col(f"{asked}.classifier"))
    error = F.when(F.col("content").isNull(), "image is not base64").when(~F.coalesce(name.isin("knn", "svm"), F.lit(False)), "classifier must be knn or svm")
    return r.withColumn("classifier", name).withColumn("error", error).drop(asked)


def spool_names(rows: DataFrame, at: str = "ts") -> DataFrame:
    """Adds the name under which a request's image is spooled: frame_<time>_<8 hex digits>.jpg, from the row's own time and content."""
    digits = F.substring(F.md5("content"), 1, 8)
    return rows.withColumn("name", F.concat(F.lit("frame_"), F.date_format(at, "yyyyMMdd_HHmmss_SSS"), F.lit("_"), digits, F.lit(".jpg")))
