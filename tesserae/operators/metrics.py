"""Evaluation tables from (actual, predicted). Everything derives from counts by pair, made per task before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.labels import ratio


def pair_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("actual", "predicted").agg(F.count("*").alias("n"))


def confusion(pairs: DataFrame) -> DataFrame:
    """actual, predicted, n over all pairs of labels that occur as actual; other predictions drop out."""
    labels = pairs.select("actual").distinct()
    grid = labels.join(F.broadcast(labels.select(F.col("actual").alias("predicted"))))
    return grid.join(pairs, ["actual", "predicted"], "left").fillna(0, ["n"])


def per_class(pairs: DataFrame, all_labels: bool = False) -> DataFrame:
    """label, precision, recall, f1, accuracy (within the class), support; 0 where a count is 0. all_labels: also labels only predicted."""
    right = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    of_actual = pairs.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("support"), F.sum(right).alias("tp"))
    of_predicted = pairs.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("called"))
    both = of_actual.join(of_predicted, "label", "full" if all_labels else "left").fillna(0, ["support", "tp", "called"])
    p, r = ratio(F.col("tp"), F.col("called")), ratio(F.col("tp"), F.col("support"))
    return both.select("label", p.alias("precision"), r.alias("recall"), ratio(2 * F.col("tp"), F.col("called") + F.col("support")).alias("f1"), r.alias("accuracy"), "support")


def overall(pairs: DataFrame) -> DataFrame:
    """One row: accuracy, balanced accuracy (both also in percent), macro and weighted averages, number of rows."""
    every = per_class(pairs, all_labels=True)
    total = F.sum("support")
    names = ("precision", "recall", "f1")
    macro = [F.avg(c).alias(f"{c}_macro") for c in names]
    weighted = [(F.sum(F.col(c) * F.col("support")) / total).alias(f"{c}_weighted") for c in names]
    accuracy, balanced = F.sum(F.col("recall") * F.col("support")) / total, F.avg(F.when(F.col("support") > 0, F.col("recall")))
    return every.agg(accuracy.alias("accuracy"), (accuracy * 100).alias("accuracy_percent"), balanced.alias("balanced_accuracy"), (balanced * 100).alias("balanced_accuracy_percent"), *macro, *weighted, total.alias("validation_samples"))


def underperforming(pairs: DataFrame, below: float = 0.5) -> DataFrame:
    return per_class(pairs).where(F.col("f1") < below)


def document(pairs: DataFrame, parameters: dict[str, str] | None = None) -> DataFrame:
    """One row with a JSON of all metrics."""
    table = lambda df: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias("t"))
    one = overall(pairs).select(F.struct("*").alias("overall"))
    one = one.join(F.broadcast(table(per_class(pairs)).withColumnRenamed("t", "per_class"))).join(F.broadcast(table(confusion(pairs)).withColumnRenamed("t", "confusion")))
    told = F.create_map(*(F.lit(str(x)) for kv in parameters.items() for x in kv)) if parameters else F.lit(None).cast("map<string,string>")
    return one.select(F.to_json(F.struct("overall", "per_class", "confusion", told.alias("parameters"))).alias("metrics"))
