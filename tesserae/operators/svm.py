"""Support-vector machines: one linear machine against the rest for each class, on explicit feature maps.

MLlib has no kernel machine, and a solver over all rows would put the whole training set into one task. So the kernels are
approximated by maps that each row makes for itself: through landmarks (pairwise.landmark_map), or drawn blind: `rbf` by random Fourier
features, `poly` (degree 3) by products of random projections. A single machine is trained by MLlib. The grid is trained in one go: each pass over the rows gives the gradients of all
points and classes, so it costs as many passes as one machine. Probabilities come from a logistic curve fitted to the decision values
of held-out rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, OneVsRestModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.sources.scratch import drop, keep

# The grid, in the order of its nesting.
COSTS, GAMMAS, KERNELS = (0.1, 1.0, 10.0, 100.0), ("scale", "auto", "0.001", "0.01", "0.1", "1"), ("rbf", "linear", "poly")
MOST_CLASSES = 1000
#: What search() says of a point.
MEASURES = ("accuracy", "balanced_accuracy", "f1_macro", "f1_weighted")
#: Rows of a partition at least, in training, and numbers at most.
ROWS, NUMBERS = 4096, 1 << 23
#: Classes whose machines are trained at a time.
AT_ONCE = 4


def grid(spark: SparkSession) -> DataFrame:
    """combo (counted over all points), c, gamma, kernel; linear points stand once for each cost."""
    rows = [(c, g, k) for c in COSTS for g in GAMMAS for k in KERNELS]
    points = spark.createDataFrame([(n, *r) for n, r in enumerate(rows, 1)], "combo int, c double, gamma string, kernel string")
    return points.where(~((F.col("kernel") == "linear") & (F.col("gamma") != "scale")))


def gamma_of(gamma: str, train: DataFrame, vector: str = "features") -> float:
    """`scale`: 1 / (dims * variance of all values), `auto`: 1 / dims, else the number."""
    if gamma not in ("scale", "auto"):
        return float(gamma)
    dims, var = train.select(F.size(vector).alias("d"), F.explode(vector).alias("x")).agg(F.max("d"), F.var_pop("x")).first()
    return 1 / dims if gamma == "auto" or not var else 1 / (dims * var)


def with_gammas(points: DataFrame, train: DataFrame, vector: str = "features") -> DataFrame:
    """Adds `value`, the number that each point's gamma stands for on these vectors."""
    of = train.select(F.size(vector).alias("d"), F.explode(vector).alias("x")).agg(F.max("d").alias("d"), F.var_pop("x").alias("var"))
    number = F.when(F.col("gamma") == "scale", F.when(F.col("var") > 0, 1 / (F.col("d") * F.col("var"))).otherwise(1 / F.col("d"))).when(F.col("gamma") == "auto", 1 / F.col("d")).otherwise(F.expr("try_cast(gamma AS double)"))
    return points.join(F.broadcast(of)).withColumn("value", number).drop("d", "var")


def projection(kernel: str, gamma: float, dims: int, size: int = 256, seed: int = 42) -> Callable[[np.ndarray], np.ndarray]:
    """The map of rows (n x dims) that approximates the kernel. The numbers drawn are size * dims, whatever the rows."""
    rng = np.random.default_rng(seed)
    if kernel == "linear":
        return lambda x: x
    if kernel == "rbf":
        w, b = rng.normal(0, math.sqrt(2 * gamma), (dims, size)), rng.uniform(0, 2 * math.pi, size)
        return lambda x: np.cos(x @ w + b) * math.sqrt(2 / size)
    if kernel == "poly":
        w = rng.choice([-1.0, 1.0], (3, dims, size)) * gamma**0.5
        return lambda x: (x @ w[0]) * (x @ w[1]) * (x @ w[2]) / math.sqrt(size)
    raise ValueError(f"unknown kernel {kernel!r}")


def feature_map(kernel: str, gamma: float, dims: int, size: int = 256, seed: int = 42) -> Callable[[Column], Column]:
    """The same from a vector column to a column of the mapped vector (null stays null), in Arrow batches, 1,024 rows at a time, with one matrix for each task."""
    if kernel == "linear":
        return lambda v: v
    project = projection(kernel, gamma, dims, size, seed)

    @F.arrow_udf("array<double>")
    def run(vectors: pa.Array) -> pa.Array:
        some = vectors.drop_null()
        parts = [project(matrix(some.slice(at, 1024))) for at in range(0, len(some), 1024)]
        mapped = pa.array(np.concatenate(parts).ravel() if parts else np.zeros(0))
        lengths = np.where(vectors.is_valid(), len(mapped) // max(len(some), 1), 0)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), mapped, mask=vectors.is_null())

    return run


def spread(n: int, numbers: int, cores: int) -> int:
    """Partitions for training on n rows of so many numbers together. Every step is a job, so there are no more than cores, but for their size."""
    return max(1, min(math.ceil(n / ROWS), max(cores, math.ceil(numbers / NUMBERS))))


def train(rows: DataFrame, weights: DataFrame | None = None, cost: float = 1.0, label: str = "label", vector: str = "features", iterations: int = 50) -> OneVsRestModel:
    """Fits on integer labels; `weights` (label, weight) weighs rows by class."""
    df = rows.select(F.col(label).cast("double").alias("label"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("__l"))
    df = df.join(F.broadcast(weights.select(F.col("label").alias("__l"), "weight")), "__l") if weights is not None else df.withColumn("weight", F.lit(1.0))
    kept = keep(df.select("label", "v", "weight"))  # each class is some hundred jobs, which find the rows mapped and joined
    n, numbers = kept.agg(F.count("*"), F.sum(F.size("v"))).first()
    df = kept.select("label", array_to_vector("v").alias("x"), "weight").coalesce(spread(n, numbers or 0, rows.sparkSession.sparkContext.defaultParallelism))
    one = LinearSVC(featuresCol="x", weightCol="weight", maxIter=iterations, regParam=1 / (cost * max(n, 1)))
    fitted = OneVsRest(classifier=one, featuresCol="x", labelCol="label", weightCol="weight", predictionCol="predicted", parallelism=AT_ONCE).fit(df)
    drop(kept)
    return fitted


def predict(model: OneVsRestModel, rows: DataFrame, key: str = "id", vector: str = "features") -> DataFrame:
    """id, predicted, scores (decision value of each class)."""
    df = rows.select(F.col(key).alias("id"), array_to_vector(F.col(vector).cast("array<double>")).alias("x"))
    out = model.transform(df)
    return out.select("id", F.col("predicted").cast("int").alias("predicted"), vector_to_array("rawPrediction").alias("scores"))


def calibrate(scored: DataFrame) -> tuple[float, float]:
    """(a, b) of the curve 1 / (1 + exp(a * s + b)) from (score, hit) of held-out rows."""
    df = scored.select(array_to_vector(F.array(F.col("score").cast("double"))).alias("features"), F.col("hit").cast("double").alias("label"))
    fitted = LogisticRegression(maxIter=50).fit(df)
    return -float(fitted.coefficients[0]), -float(fitted.intercept)


def probabilities(scores: Column, a: float, b: float) -> Column:
    """Calibrated values of all classes, made to add up to 1."""
    each = F.transform(scores, lambda s: 1 / (1 + F.exp(s * a + b)))
    total = F.aggregate(each, F.lit(0.0), lambda x, y: x + y)
    return F.transform(each, lambda p: p / total)


def matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


def added(rows: DataFrame, each) -> dict[int, np.ndarray]:
    """Sums, by number, of the arrays that `each` gives for a batch. Tasks add up their own; then those of one number meet in a task."""
    schema = "k int, v array<double>"

    def batch(total):
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.ravel() for x in total.values()], pa.list_(pa.float64()))], ["k", "v"])

    def first(batches):
        total: dict = {}
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                for k, x in each(b.slice(at, 1024)).items():
                    total[k] = total.get(k, 0) + x
        if total:
            yield batch(total)

    def again(batches):
        total: dict = {}
        for b in batches:
            for i, k in enumerate(b.column("k").to_pylist()):
                total[k] = total.get(k, 0) + b.column("v")[i].values.to_numpy()
        if total:
            yield batch(total)

    got = rows.mapInArrow(first, schema).repartition("k").mapInArrow(again, schema).toArrow()
    return {k: np.array(v) for k, v in zip(got.column("k").to_pylist(), got.column("v").to_pylist(), strict=True)}


def fit_grid(rows: DataFrame, maps: list[Callable[[np.ndarray], np.ndarray]], costs: list[float], classes: list[int], iterations: int = 40) -> list[np.ndarray]:
    """For each map the weights (dims + 1, costs, classes) of its machines: those with the least |w|^2 / 2 + cost * sum of weighted squared hinges.

    rows: y (a class), weight, x. Accelerated steps on the means over rows, each to the minimum of a bound on the loss: its curvature
    is at most that of all rows together, which each map's second moments give. The driver holds weights, gradients and second moments
    alone, whose number does not depend on the rows.
    """
    spark, n = rows.sparkSession, rows.count()
    lifted = lambda project, b: np.column_stack([project(matrix(b.column("x"))), np.ones(b.num_rows)])
    moments = added(rows, lambda b: {k: (z := lifted(p, b)).T @ (z * b.column("weight").to_numpy()[:, None]) for k, p in enumerate(maps)})
    if not moments:
        return [np.zeros((1, len(costs), len(classes))) for _ in maps]
    sides = [math.isqrt(len(moments[k])) for k in range(len(maps))]
    pull = 1 / (np.array(costs) * n)
    shrink = [np.append(np.ones(d - 1), 0.0)[:, None, None] * pull[:, None] for d in sides]  # the offset is free
    bound = [[np.linalg.inv(2 * moments[k].reshape(d, d) / n + np.diag(shrink[k][:, c, 0] + 1e-9)) for c in range(len(costs))] for k, d in enumerate(sides)]
    w = [np.zeros((d, len(costs), len(classes))) for d in sides]
    ahead, t = [x.copy() for x in w], 1.0
    for _ in range(iterations):
        shared = spark.sparkContext.broadcast(ahead)

        def each(b, shared=shared):
            y, weight, out = b.column("y").to_numpy(), b.column("weight").to_numpy(), {}
            sign = np.where(y[:, None] == np.array(classes), 1.0, -1.0)[:, None, :]
            for k, p in enumerate(maps):
                z = lifted(p, b)
                short = np.maximum(1 - sign * np.einsum("nd,dcm->ncm", z, shared.value[k], optimize=True), 0)
                out[k] = -2 * np.einsum("nd,ncm->dcm", z, short * sign * weight[:, None, None], optimize=True)
            return out

        grads, before, t_before = added(rows, each), w, t
        grads = [grads[k].reshape(ahead[k].shape) / n + shrink[k] * ahead[k] for k in range(len(maps))]
        w = [np.stack([ahead[k][:, c] - bound[k][c] @ grads[k][:, c] for c in range(len(costs))], axis=1) for k in range(len(maps))]
        t = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead = [w[k] + (t_before - 1) / t * (w[k] - before[k]) for k in range(len(maps))]
    return w


def search(train_rows: DataFrame, held: DataFrame, points: DataFrame, weights: DataFrame | None = None, label: str = "label", vector: str = "features", size: int = 256, iterations: int = 40, landmarks: np.ndarray | None = None) -> DataFrame:
    """combo, c, gamma, kernel and MEASURES of every point (combo, c, gamma, kernel) on held-out rows.

    Labels are integers; `weights` (label, weight) weighs rows by class. Points that differ in their cost alone share a map: one through
    landmarks if these are given, else one that is drawn blind.
    """
    spark = train_rows.sparkSession
    as_rows = lambda df: df.select(F.col(label).cast("long").alias("y"), F.col(vector).cast("array<double>").alias("x"))
    rows = as_rows(train_rows)
    rows = rows.join(F.broadcast(weights.select(F.col("label").cast("long").alias("y"), F.col("weight").cast("double").alias("weight"))), "y") if weights is not None else rows.withColumn("weight", F.lit(1.0))
    rows = keep(rows.where("y is not null and x is not null"))
    classes = sorted(r["y"] for r in rows.select("y").distinct().limit(MOST_CLASSES + 1).collect())
    if len(classes) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    grid_rows = sorted(points.collect(), key=lambda r: r["combo"])  # the grid is small
    first = rows.select(F.size("x")).first()
    dims = first[0] if first else 0
    kinds = sorted({(r["kernel"], "scale" if r["kernel"] == "linear" else r["gamma"]) for r in grid_rows})
    values = {g: gamma_of(g, rows, "x") if first else 1.0 for _, g in kinds}
    costs = sorted({r["c"] for r in grid_rows})
    if landmarks is None:
        maps = [projection(kernel, values[g], dims, size) for kernel, g in kinds]
    else:
        from tesserae.operators.pairwise import landmark_map

        maps = [landmark_map(kernel, values[g], landmarks) for kernel, g in kinds]
    shared = spark.sparkContext.broadcast(fit_grid(rows, maps, costs, classes, iterations))
    at = [(r["combo"], kinds.index((r["kernel"], "scale" if r["kernel"] == "linear" else r["gamma"])), costs.index(r["c"])) for r in grid_rows]

    def run(batches):
        counts: dict = {}
        for b in batches:
            for part in range(0, b.num_rows, 1024):
                some = b.slice(part, 1024)
                x, y = matrix(some.column("x")), some.column("y").to_numpy()
                scores = [np.einsum("nd,dcm->ncm", np.column_stack([p(x), np.ones(len(x))]), shared.value[k], optimize=True) for k, p in enumerate(maps)]
                for combo, k, c in at:
                    predicted = np.array(classes)[scores[k][:, c].argmax(1)]
                    for (a, q), n in _pairs(y, predicted):
                        counts[combo, a, q] = counts.get((combo, a, q), 0) + n
        if counts:
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([*(pa.array([k[j] for k in keys], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.int64()))), pa.array(list(counts.values()), pa.int64())], ["combo", "actual", "predicted", "n"])

    val = as_rows(held).where("y is not null and x is not null")
    found = val.mapInArrow(run, "combo int, actual long, predicted long, n long").groupBy("combo", "actual", "predicted").agg(F.sum("n").alias("n"))
    return points.join(F.broadcast(compared(found)), "combo").select("combo", "c", "gamma", "kernel", *MEASURES)


def compared(found: DataFrame) -> DataFrame:
    """combo and MEASURES of each point, from the counts n by (combo, actual, predicted); weighted means weigh classes by their actual rows."""
    right = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    sides = found.select("combo", F.explode(F.array(F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"), right.alias("tp")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"), F.lit(0).cast("long").alias("tp")))).alias("s")).select("combo", "s.*")
    per = sides.groupBy("combo", "label").agg(*(F.sum(c).alias(c) for c in ("support", "called", "tp")))
    f1 = 2 * F.col("tp") / (F.col("called") + F.col("support"))
    measures = (F.sum("tp") / F.sum("support"), F.avg(F.when(F.col("support") > 0, F.col("tp") / F.col("support"))), F.avg(f1), F.sum(f1 * F.col("support")) / F.sum("support"))
    return per.groupBy("combo").agg(*(m.alias(name) for m, name in zip(measures, MEASURES, strict=True)))


def _pairs(a: np.ndarray, b: np.ndarray):
    """((a, b), how often) of all pairs."""
    pairs, n = np.unique(np.stack([a, b]), axis=1, return_counts=True)
    return zip(zip(*pairs.tolist(), strict=True), n.tolist(), strict=True)


def best(searched: DataFrame) -> DataFrame:
    """The point with the largest balanced accuracy, the first of equal ones; no row if none is above 0."""
    names = searched.columns
    good = searched.where(F.col("balanced_accuracy") > 0)
    return good.agg(F.max_by(F.struct(*names), F.struct("balanced_accuracy", -F.col("combo"))).alias("b")).where(F.col("b").isNotNull()).select("b.*")
