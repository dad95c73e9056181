"""End to end: images to features, features to a model with metrics, images to predictions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.blocks import DEFAULT, Block
from tesserae.functions.labels import CODES, code_of
from tesserae.operators import augment, balance, distribution, features, knn, metrics, pairwise, policy, scaling, svm
from tesserae.sources import images as image_source
from tesserae.sources.scratch import keep

#: Rows of paths that are broadcast at most.
CHOSEN = 200_000


@dataclass(frozen=True)
class Build:
    """Settings of a dataset build."""

    share: float = 0.3
    seed: int = 42
    target: str = "median"
    multiplier: float = 1.0
    side: int = 256
    blocks: tuple[Block, ...] = DEFAULT
    keys: tuple[str, ...] = augment.PRODUCTION


def build(spark: SparkSession, root: str, settings: Build = Build()) -> DataFrame:  # noqa: B008
    """path, label, split, is_augmented, features. The validation part is neither balanced nor augmented.

    Spark's image source decodes whole folders, so images that balancing leaves out are decoded as well; their pixels are dropped before
    any shuffle as long as the chosen rows can be broadcast (CHOSEN at most).
    """
    listed = image_source.listing(spark, root).select("path", "label")
    small = [r["label"] for r in balance.small_classes(distribution.counts(listed), settings.share).collect()]  # one row for each class
    if small:
        raise ValueError(f"classes with too few images to split: {sorted(small)}")
    parts = balance.split(listed, "path", share=settings.share, seed=settings.seed)
    pixels = image_source.images(spark, root).drop("label")
    wanted = balance.training_set(parts, "path", target=settings.target, multiplier=settings.multiplier, seed=settings.seed)
    wanted = keep(wanted.select("path", "label", "split", "slot"))
    small = wanted.count() <= CHOSEN
    rows = augment.apply(pixels.join(F.broadcast(wanted) if small else wanted, "path"), settings.keys, settings.seed)
    out = features.extract(rows, settings.blocks, settings.side)
    return out.select("path", "label", "split", F.col("slot").isNotNull().alias("is_augmented"), "features", "error")


def train_knn(rows: DataFrame, ks: tuple[int, ...] = knn.SWEEP) -> dict[str, DataFrame]:
    """From (id, label, features, split): scaler, knn (the scaled training rows), weights, sweep, and the metrics of the best k."""
    train, val = rows.where("split = 'train'"), rows.where("split = 'val'")
    scaler = scaling.fit(train)
    near_to = scaling.transform(train, scaler).select("id", "label", "features")
    held = scaling.transform(val, scaler)
    weights = distribution.weights(distribution.counts(train))
    actual = held.select(F.col("id").alias("query_id"), F.col("label").alias("actual"))
    near = knn.neighbours(near_to, held, max(ks))
    swept = knn.sweep(near, weights, actual, ks)
    k = knn.best(swept).first()["k"]
    pairs = metrics.pair_counts(knn.vote(near.where(F.col("rank") <= k), weights).join(actual, "query_id"))
    return {"knn_scaler": scaler, "knn": near_to, "weights": weights, "sweep": swept, "metrics": metrics.document(pairs, {"n_neighbors": k}), "confusion": metrics.confusion(pairs)}


def predict(rows: DataFrame, model: dict[str, DataFrame], k: int = 1, certainty: float = policy.CERTAINTY, distance: float = policy.DISTANCE) -> DataFrame:
    """id, label, code, confidence, error of every row of (id, features, error): rows without features keep their place, with code null."""
    good = scaling.transform(rows.where("features is not null"), model["knn_scaler"])
    near = knn.neighbours(model["knn"], good, k)
    voted = knn.vote(near, model["weights"])
    if k == 1:
        seen = voted.join(near.select("query_id", "distance"), "query_id")
        label, sure = policy.by_distance(F.col("predicted"), F.col("distance"), distance)
    else:
        top = knn.probabilities(near).groupBy("query_id").agg(F.max("probability").alias("top"))
        seen = voted.join(top, "query_id")
        label, sure = policy.by_probability(F.col("predicted"), F.col("top"), certainty)
    out = seen.select(F.col("query_id").alias("id"), label.alias("label"), sure.alias("confidence"))
    joined = rows.select("id", "error").join(out, "id", "left")
    return joined.select("id", "label", F.when(F.col("label").isNotNull(), code_of(F.col("label"))).alias("code"), "confidence", "error")


@dataclass(frozen=True)
class Machines:
    """scaler (dim, mean, scale), the machines of scaled vectors, and the labels by their numbers."""

    scaler: DataFrame
    pairs: pairwise.PairMachines
    labels: tuple[str, ...]


def train_svm(rows: DataFrame, kernel: str = "rbf", gamma: str = "scale", cost: float = 1.0, size: int = 256, iterations: int = 60) -> Machines:
    """From (id, label, features, split): machines of all pairs, weighed by class; a fifth of the training rows (by hash of the id) is for the curves alone."""
    train = rows.where("split = 'train' and features is not null and label is not null")
    scaler = scaling.fit(train)
    labels = tuple(r["label"] for r in distribution.counts(train).orderBy("label").limit(svm.MOST_CLASSES + 1).collect())
    if len(labels) > svm.MOST_CLASSES:
        raise ValueError(f"more than {svm.MOST_CLASSES} classes")
    number = (F.array_position(F.array(*(F.lit(x) for x in labels)), F.col("label")) - 1).cast("long")
    weights = distribution.weights(distribution.counts(train)).select(F.col("label").alias("name"), "weight")
    scaled = scaling.transform(train, scaler).select("id", F.col("label").alias("name"), number.alias("y"), F.col("features").alias("x")).join(F.broadcast(weights), "name")
    ready = keep(scaled.select("y", F.col("weight").cast("double").alias("weight"), "x", (F.pmod(F.xxhash64("id"), F.lit(5)) == 0).alias("aside")))
    return Machines(scaler, pairwise.train(ready, len(labels), kernel, svm.gamma_of(gamma, ready, "x"), cost, size, iterations), labels)


def predict_svm(rows: DataFrame, machines: Machines, certainty: float = policy.CERTAINTY) -> DataFrame:
    """As predict(), by machines: the class with most votes, or `unknown` where the largest probability is below `certainty`."""
    good = scaling.transform(rows.where("features is not null"), machines.scaler)
    out = machines.pairs.predict(good)
    name = F.element_at(F.array(*(F.lit(x) for x in machines.labels)), F.col("predicted") + 1)
    label, sure = policy.by_probability(name, F.array_max("probabilities"), certainty)
    joined = rows.select("id", "error").join(out.select("id", label.alias("label"), sure.alias("confidence")), "id", "left")
    return joined.select("id", "label", F.when(F.col("label").isNotNull(), code_of(F.col("label"))).alias("code"), "confidence", "error")


__all__ = ["CODES", "Build", "Machines", "build", "predict", "predict_svm", "train_knn", "train_svm"]
