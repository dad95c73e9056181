"""Stratified split, class balance plans, sampling, and slots for augmented samples. All choices follow seeded hashes of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.labels import half_even, shuffled
from tesserae.functions.names import fresh
from tesserae.operators.distribution import TARGETS
from tesserae.operators.ranking import hash_rank

STRATEGIES = ("none", "balance", "oversample_minority", "undersample_majority")


def split(df: DataFrame, key: str, label: str = "label", share: float = 0.3, seed: int = 42) -> DataFrame:
    """Adds `split`: of each class, the first ceil(share * n) rows in hash order are `val`, the others `train`."""
    rk, n = fresh(df, "rk", "n")
    ranked = hash_rank(df, label, key, seed, rk, n)
    val = F.col(rk) <= F.ceil(F.lit(share) * F.col(n))
    return ranked.withColumn("split", F.when(val, "val").otherwise("train")).drop(rk, n)


def small_classes(sizes: DataFrame, share: float = 0.3) -> DataFrame:
    """Classes that a split would leave without training rows; a caller refuses these instead of losing them."""
    return sizes.where(F.col("n") - F.ceil(F.lit(share) * F.col("n")) < 1)


def plan(sizes: DataFrame, target: str = "median", multiplier: float = 1.0) -> DataFrame:
    """label, n, target_n, keep, aug_needed. target_n = max(1, half_even(base * multiplier)), base by `target` over classes that are not empty."""
    if target not in TARGETS:
        raise ValueError(f"target must be one of {TARGETS}")
    pick = {"min": F.min, "max": F.max, "mean": F.avg, "median": F.median}[target]
    base = sizes.where("n > 0").agg(half_even(pick("n").cast("double")).alias("base"))
    goal = sizes.join(F.broadcast(base)).withColumn("target_n", F.greatest(F.lit(1), half_even(F.col("base") * F.lit(float(multiplier)))))
    return goal.select("label", "n", "target_n", F.least("n", "target_n").alias("keep"), (F.col("target_n") - F.least("n", "target_n")).alias("aug_needed"))


def sample(df: DataFrame, keep: DataFrame, key: str, label: str = "label", seed: int = 42) -> DataFrame:
    """Without replacement: of each class, as many rows as `keep` (label, keep) says; classes that it lacks stay whole."""
    rk, n, l, k = fresh(df, "rk", "n", "l", "k")
    ranked = hash_rank(df, label, key, seed, rk, n)
    limits = keep.select(F.col("label").alias(l), F.col("keep").alias(k))
    return ranked.join(limits, F.col(label) == F.col(l), "left").where(F.col(k).isNull() | (F.col(rk) <= F.col(k))).select(*df.columns)


def undersample(df: DataFrame, limits: dict[str, int], key: str, label: str = "label", seed: int = 42) -> DataFrame:
    """Only the classes named are cut down."""
    keep = df.sparkSession.createDataFrame([(k, int(v)) for k, v in limits.items()], "label string, keep long")
    return sample(df, keep, key, label, seed)


def resample(df: DataFrame, strategy: str, key: str, label: str = "label", target: str = "median", seed: int = 42) -> DataFrame:
    """`balance` and `undersample_majority` cut classes down to the target (truncated); `none` and `oversample_minority` change nothing."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    if strategy in ("none", "oversample_minority"):
        return df
    sizes = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    pick = {"min": F.min, "max": F.max, "mean": F.avg, "median": F.median}[target]
    base = sizes.agg(pick("n").cast("long").alias("keep"))
    return sample(df, sizes.select("label").join(F.broadcast(base)), key, label, seed)


def training_set(parts: DataFrame, key: str, label: str = "label", target: str = "median", multiplier: float = 1.0, seed: int = 42) -> DataFrame:
    """key, label, split, is_augmented, slot: the validation rows, the chosen training rows, and a row for each augmented sample, drawn from the chosen ones."""
    train, val = parts.where("split = 'train'"), parts.where("split = 'val'")
    goal = plan(train.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")), target, multiplier)
    chosen = sample(train, goal, key, label, seed)
    plain = val.select(key, label, "split").unionByName(chosen.select(key, label, "split"))
    plain = plain.select("*", F.lit(False).alias("is_augmented"), F.lit(None).cast("long").alias("slot"))
    more = slots(chosen, goal, key, label, seed).select(key, F.col("label").alias(label), F.lit("train").alias("split"), F.lit(True).alias("is_augmented"), "slot")
    return plain.unionByName(more)


def slots(selected: DataFrame, needed: DataFrame, key: str, label: str = "label", seed: int = 42) -> DataFrame:
    """label, slot, key: a source for each augmented sample, drawn with replacement by hash from the selected rows of its class."""
    rk, l = fresh(selected.select(label, key), "rk", "l")
    ranked = hash_rank(selected.select(label, key), label, key, seed, rk, "n_" if key == "n" or label == "n" else "n")
    sizes = selected.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    want = needed.where("aug_needed > 0").select("label", "aug_needed").join(sizes, "label")
    drawn = want.select("label", F.explode(F.sequence(F.lit(1).cast("long"), F.col("aug_needed"))).alias("slot"), "n")
    draw = F.conv(F.substring(shuffled(seed, F.concat_ws("-", "label", "slot")), 1, 8), 16, 10).cast("long") % F.col("n") + 1
    of = ranked.select(F.col(label).alias(l), F.col(key), rk)
    return drawn.select("label", "slot", draw.alias("draw")).join(of, (F.col("label") == F.col(l)) & (F.col("draw") == F.col(rk))).select("label", "slot", key)
