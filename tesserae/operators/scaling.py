"""Standardisation of vectors: population deviation, and scale 1 for columns that are constant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.names import fresh


def fit(df: DataFrame, vector: str = "features") -> DataFrame:
    """dim (from 0), mean, scale. Sums are made per task first, so the shuffle has one row for each task and dimension."""
    values = df.select(F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "x"))
    sd = F.stddev_pop("x")
    return values.groupBy("dim").agg(F.avg("x").alias("mean"), F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias("scale"))


def as_row(scaler: DataFrame) -> DataFrame:
    """One row: mean and scale as arrays. It has as many numbers as a vector has, so it is broadcast."""
    pairs = F.array_sort(F.collect_list(F.struct("dim", "mean", "scale")))
    return scaler.agg(F.transform(pairs, lambda p: p["mean"]).alias("mean"), F.transform(pairs, lambda p: p["scale"]).alias("scale"))


def scaled(vector: Column, mean: Column, scale: Column) -> Column:
    return F.zip_with(F.zip_with(vector.cast("array<double>"), mean, lambda x, m: x - m), scale, lambda x, s: x / s)


def transform(df: DataFrame, scaler: DataFrame, vector: str = "features") -> DataFrame:
    """Vectors scaled; one of another length than the scaler's stops the job."""
    mean, scale = fresh(df, "mean", "scale")
    one = as_row(scaler).select(F.col("mean").alias(mean), F.col("scale").alias(scale))
    fits = F.assert_true(F.size(vector) == F.size(mean), F.concat(F.lit("vector length "), F.size(vector), F.lit(", scaler "), F.size(mean)))
    out = df.join(F.broadcast(one))
    return out.withColumn(vector, F.when(fits.isNull(), scaled(F.col(vector), F.col(mean), F.col(scale)))).drop(mean, scale)
