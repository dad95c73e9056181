"""When a prediction stands, when it becomes `unknown`, and how sure it is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.labels import UNKNOWN, softmax

CERTAINTY, DISTANCE = 0.60, 0.80


def by_distance(predicted: Column, distance: Column, most: float = DISTANCE) -> tuple[Column, Column]:
    """Label and confidence of a single nearest neighbour: known up to `most`, confidence falling to 0 there."""
    near = distance <= most
    return F.when(near, predicted.cast("string")).otherwise(UNKNOWN), F.when(near, F.greatest(F.lit(0.0), 1 - F.try_divide(distance, F.lit(most)))).otherwise(F.lit(0.0))


def by_probability(predicted: Column, top: Column, least: float = CERTAINTY) -> tuple[Column, Column]:
    """Label and confidence by the largest class probability."""
    sure = top >= least
    return F.when(sure, predicted.cast("string")).otherwise(UNKNOWN), F.when(sure, top).otherwise(F.lit(0.0))


def by_scores(predicted: Column, scores: Column, least: float = CERTAINTY) -> tuple[Column, Column]:
    """Label and confidence by decision values; a single value s counts as [-s, s]."""
    two = F.when(F.size(scores) == 1, F.array(-scores[0], scores[0])).otherwise(scores)
    return by_probability(predicted, F.array_max(softmax(two)), least)


def of_predicted(probabilities: Column, predicted: Column) -> Column:
    """The probability of the predicted class in a map by label; 0 if it has none."""
    return F.coalesce(probabilities[predicted.cast("string")], F.lit(0.0))
