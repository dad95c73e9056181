"""Class distributions, class weights and target counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.functions.labels import half_even

TARGETS = ("min", "max", "mean", "median")


def counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))


def stats(sizes: DataFrame) -> DataFrame:
    """One row on (label, n): classes, n, smallest, largest, mean and median (both also truncated), imbalance (infinite if a class is empty)."""
    return sizes.agg(
        F.count("*").alias("classes"), F.sum("n").alias("n"), F.min("n").alias("smallest"), F.max("n").alias("largest"),
        F.avg("n").alias("mean"), F.median("n").alias("median"), F.avg("n").cast("long").alias("mean_int"), F.median("n").cast("long").alias("median_int"),
        F.when(F.min("n") == 0, F.lit(float("inf"))).otherwise(F.max("n") / F.min("n")).alias("imbalance"),
    )


def weights(sizes: DataFrame, strategy: str | None = "balanced") -> DataFrame:
    """label, weight: n / (classes * n of the class) for `balanced` and `inverse_freq`, 1 for None."""
    if strategy not in ("balanced", "inverse_freq", None):
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy is None:
        return sizes.select("label", F.lit(1.0).alias("weight"))
    every = Window.partitionBy()  # over classes, one row each
    return sizes.select("label", (F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))).alias("weight"))


def target_counts(sizes: DataFrame) -> DataFrame:
    """target, rounded (half to even) and truncated, for each of TARGETS; empty classes are left out."""
    one = sizes.where("n > 0").agg(F.min("n").cast("double").alias("min"), F.max("n").cast("double").alias("max"), F.avg("n").alias("mean"), F.median("n").alias("median"))
    long = one.select(F.explode(F.array(*(F.struct(F.lit(t).alias("target"), F.col(t).alias("x")) for t in TARGETS))).alias("t"))
    return long.select("t.target", half_even(F.col("t.x")).alias("rounded"), F.col("t.x").cast("long").alias("truncated"))


def by_size(sizes: DataFrame) -> DataFrame:
    """label, n, place: the largest class first, equal ones by label. One row for each class."""
    return sizes.select("label", "n", F.row_number().over(Window.orderBy(F.col("n").desc(), "label")).alias("place"))
