"""Class-weighted nearest neighbours: votes, probabilities, and the sweep over k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.operators import pivots

EPSILON = 1e-10
SWEEP = tuple(range(1, 47, 5))


def neighbours(train: DataFrame, queries: DataFrame, k: int, key: str = "id", label: str = "label", vector: str = "features") -> DataFrame:
    """query_id, rank, neighbour_id, label, distance: the k nearest training rows of each query (exact); ties go to the smaller id."""
    return pivots.nearest(train, queries, k, key, label, vector)


def vote(near: DataFrame, weights: DataFrame | None = None, by_distance: bool = False) -> DataFrame:
    """query_id, predicted: the label with the largest sum of class weights (over distance + 1e-10); ties go to the label of the nearer neighbour."""
    if weights is not None:
        near = near.join(F.broadcast(weights), "label", "left")  # one row for each class
    w = F.coalesce("weight", F.lit(1.0)) if weights is not None else F.lit(1.0)
    w = w / (F.col("distance") + EPSILON) if by_distance else w
    votes = near.withColumn("w", w).groupBy("query_id", "label").agg(F.sum("w").alias("w"), F.min("rank").alias("first"))
    return votes.groupBy("query_id").agg(F.min_by("label", F.struct(-F.round("w", 9), "first")).alias("predicted"))


def probabilities(near: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """query_id, label, probability: each label's share of the k neighbours, not weighted; with `classes` (label), zeros as well."""
    shares = near.groupBy("query_id", "label").agg(F.count("*").alias("c"))
    shares = shares.withColumn("probability", F.col("c") / F.sum("c").over(Window.partitionBy("query_id"))).drop("c")
    if classes is None:
        return shares
    grid = shares.select("query_id").distinct().join(F.broadcast(classes.select("label")))
    return grid.join(shares, ["query_id", "label"], "left").fillna(0.0, ["probability"])


def ranked(shares: DataFrame) -> DataFrame:
    """query_id, label, probability, place: from the largest on, equal ones by label."""
    return shares.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("probability").desc(), "label")))


def sweep(near: DataFrame, weights: DataFrame, actual: DataFrame, ks: tuple[int, ...] = SWEEP) -> DataFrame:
    """k, accuracy, accuracy_percent for each k, all from one table of the max(ks) nearest. actual: query_id, actual."""
    each = near.withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks)))).where(F.col("rank") <= F.col("k"))
    votes = each.join(F.broadcast(weights), "label", "left").groupBy("k", "query_id", "label").agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("w"), F.min("rank").alias("first"))
    predicted = votes.groupBy("k", "query_id").agg(F.min_by("label", F.struct(-F.round("w", 9), "first")).alias("predicted"))
    right = predicted.join(actual, "query_id").groupBy("k").agg(F.avg((F.col("predicted") == F.col("actual")).cast("double")).alias("accuracy"))
    return right.select("k", "accuracy", (F.col("accuracy") * 100).alias("accuracy_percent"))


def best(swept: DataFrame) -> DataFrame:
    """The k with the largest accuracy, the smallest of equal ones."""
    return swept.agg(F.max_by("k", F.struct("accuracy", -F.col("k"))).alias("k"), F.max("accuracy").alias("accuracy"))
