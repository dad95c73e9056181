"""Machines against plain NumPy versions of the same objectives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import svm


def rings(n=240, seed=0):
    """Two classes that only a kernel tells apart, and a third far away."""
    rng = np.random.default_rng(seed)
    kind = np.arange(n) % 3
    angle, radius = rng.uniform(0, 2 * np.pi, n), np.where(kind == 0, 0.6, 2.0) + rng.normal(0, 0.1, n)
    x = np.stack([radius * np.cos(angle), radius * np.sin(angle)], 1)
    x[kind == 2] += 6
    return x, kind


def frame(spark, x, y):
    return spark.createDataFrame([(k, int(c), v.tolist()) for k, (c, v) in enumerate(zip(y, x, strict=True))], "id long, label int, features array<double>")


def test_maps_approximate_kernels():
    x = np.random.default_rng(1).normal(size=(40, 5))
    z = svm.projection("rbf", 0.3, 5, 20_000)(x)
    assert np.allclose(z @ z.T, np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(2)), atol=0.05)
    z = svm.projection("poly", 0.5, 5, 40_000)(x)
    want = (0.5 * x @ x.T) ** 3
    assert np.corrcoef((z @ z.T).ravel(), want.ravel())[0, 1] > 0.97
    with pytest.raises(ValueError):
        svm.projection("sigmoid", 1.0, 5)


def test_feature_map_column(spark):
    x, y = rings(12)
    mapped = svm.feature_map("rbf", 0.5, 2, 8)
    rows = frame(spark, x, y).union(spark.createDataFrame([(99, 0, None)], "id long, label int, features array<double>"))
    got = {r.id: r.z for r in rows.select("id", mapped(F.col("features")).alias("z")).collect()}
    assert got[99] is None and np.allclose([got[k] for k in range(12)], svm.projection("rbf", 0.5, 2, 8)(x))


def test_feature_map_works_out_few_rows_at_a_time(spark, monkeypatch):
    """What a task holds does not grow with Arrow's batches; a batch of nulls alone stays null."""
    project, most = svm.projection("rbf", 0.5, 2, 8), 1024

    def bounded(*args):
        def run(x):
            if len(x) > most:
                raise ValueError(f"{len(x)} rows at a time")
            return project(x)

        return run

    monkeypatch.setattr(svm, "projection", bounded)
    rows = spark.range(5000).coalesce(1).select("id", F.when(F.col("id") % 7 > 0, F.array(F.sin("id"), F.cos("id"))).alias("features"))
    got = {r.id: r.z for r in rows.select("id", svm.feature_map("rbf", 0.5, 2, 8)(F.col("features")).alias("z")).collect()}
    assert all((got[k] is None) == (k % 7 == 0) for k in range(5000))
    some = [k for k in range(5000) if k % 7]
    assert np.allclose([got[k] for k in some], project(np.stack([np.sin(some), np.cos(some)], 1)))
    none = rows.where("features is null").select(svm.feature_map("rbf", 0.5, 2, 8)(F.col("features")).alias("z"))
    assert none.where("z is null").count() == 715


def test_training_reads_rows_that_are_worked_out_once(spark):
    """The classes' jobs do not go back to the mapped rows: each row is mapped once in training."""
    x, y = rings(60)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def mapped(v):
        seen.add(1)
        return v

    svm.train(frame(spark, x, y).withColumn("features", mapped("features")), iterations=3)
    assert seen.value == 60


def test_steps_have_no_more_tasks_than_cores(spark):
    """430,000 rows of 64 numbers had 105 tasks a step; rows beyond 64 MB for each core are dealt further."""
    assert svm.spread(430_000, 430_000 * 64, 12) == 12
    assert svm.spread(7_000, 7_000 * 64, 12) == 2 and svm.spread(0, 0, 12) == 1
    assert svm.spread(430_000_000, 430_000_000 * 64, 12) == 3281


def test_grid_machines_are_the_plain_optimum(spark):
    x, y = rings(150)
    weight = np.where(y == 0, 2.0, 1.0)
    rows = spark.createDataFrame([(int(c), float(w), v.tolist()) for c, w, v in zip(y, weight, x, strict=True)], "y long, weight double, x array<double>").repartition(4)
    maps, costs = [svm.projection("linear", 1.0, 2), svm.projection("rbf", 1.0, 2, 12)], [0.1, 10.0]
    got = svm.fit_grid(rows, maps, costs, [0, 1, 2], iterations=40)
    for k, project in enumerate(maps):
        z = np.column_stack([project(x), np.ones(len(x))])
        for c, cost in enumerate(costs):
            for m in range(3):
                sign = np.where(y == m, 1.0, -1.0)
                loss = lambda w, z=z, s=sign, cost=cost: w[:-1] @ w[:-1] / 2 + cost * (weight * np.maximum(1 - s * (z @ w), 0) ** 2).sum()
                w = np.zeros(z.shape[1])
                for _ in range(50):  # Newton's steps on what is active
                    on = sign * (z @ w) < 1
                    h = np.diag(np.append(np.ones(len(w) - 1), 1e-9)) + 2 * cost * (z[on].T * weight[on]) @ z[on]
                    w = w - 0.7 * np.linalg.solve(h, np.append(w[:-1], 0) - 2 * cost * z[on].T @ (weight[on] * (sign[on] - z[on] @ w)))
                assert loss(got[k][:, c, m]) <= loss(w) * 1.03 + 1e-6


def test_search_finds_the_kernel(spark):
    x, y = rings()
    df = frame(spark, x, y)
    points = spark.createDataFrame([(1, 1.0, "scale", "linear"), (2, 10.0, "1", "rbf"), (3, 10.0, "scale", "poly")], "combo int, c double, gamma string, kernel string")
    found = svm.search(df.where("id < 180"), df.where("id >= 180"), points, size=64, iterations=40)
    got = {r.combo: r for r in found.collect()}
    assert set(got) == {1, 2, 3} and got[2].accuracy > 0.95 > got[1].accuracy
    assert svm.best(found).first().combo == 2 and 0 <= got[1].f1_macro <= 1
    assert svm.grid(spark).count() == 52


def test_linear_machine_and_prediction(spark):
    x, y = rings(90)
    df = frame(spark, x, np.where(y == 2, 1, 0))
    out = {r.id: r for r in svm.predict(svm.train(df), df).collect()}
    assert all(out[k].predicted == int(y[k] == 2) for k in range(90)) and len(out[0].scores) == 2


def test_calibration_is_logistic_regression(spark):
    rng = np.random.default_rng(2)
    s = rng.normal(size=400)
    hit = rng.random(400) < 1 / (1 + np.exp(-(1.7 * s - 0.4)))
    a, b = svm.calibrate(spark.createDataFrame(list(zip(s.tolist(), hit.tolist(), strict=True)), "score double, hit boolean"))
    z, w = np.column_stack([s, np.ones(400)]), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        w += np.linalg.solve((z.T * (p * (1 - p))) @ z, z.T @ (hit - p))
    assert (-a, -b) == pytest.approx(tuple(w), abs=1e-3)
    got = spark.range(1).select(svm.probabilities(F.array(F.lit(1.0), F.lit(-1.0)), a, b).alias("p")).first().p
    plain = 1 / (1 + np.exp(a * np.array([1.0, -1.0]) + b))
    assert got == pytest.approx((plain / plain.sum()).tolist())


def test_the_best_point_has_the_largest_balanced_accuracy(spark):
    schema = "combo int, accuracy double, balanced_accuracy double, f1_macro double, f1_weighted double"
    points = [(1, 0.9, 0.6, 0.0, 0.0), (2, 0.85, 0.8, 0.0, 0.0), (3, 0.5, 0.8, 0.0, 0.0), (4, 0.99, None, 0.0, 0.0)]
    assert [r.combo for r in svm.best(spark.createDataFrame(points, schema)).collect()] == [2]
    assert svm.best(spark.createDataFrame([(1, 0.9, 0.0, 0.0, 0.0)], schema)).count() == 0
