"""Machines of pairs against plain versions."""

import numpy as np
import pytest

from tesserae.operators import pairwise, pivots, svm
from tesserae.plans import pipeline
from tests.test_svm import frame, rings


def test_landmarks_come_nearer_to_the_kernel_than_blind_maps():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(80, 6)) * 0.4 + c for c in rng.normal(size=(5, 6)) * 3])
    for kernel, gamma, want in (("rbf", 0.2, np.exp(-0.2 * ((x[:, None] - x[None]) ** 2).sum(2))), ("poly", 0.3, (0.3 * x @ x.T) ** 3)):
        error = lambda z, want=want: np.linalg.norm(z @ z.T - want)
        marked, blind = pairwise.landmark_map(kernel, gamma, pivots.chosen(x, 64))(x), svm.projection(kernel, gamma, 6, 64)(x)
        assert error(marked) < error(blind) / 5
    marks = x[:20]
    z = pairwise.landmark_map("rbf", 0.2, marks)(marks)
    assert np.allclose(z @ z.T, np.exp(-0.2 * ((marks[:, None] - marks[None]) ** 2).sum(2)), atol=1e-6)
    with pytest.raises(ValueError):
        pairwise.landmark_map("sigmoid", 1.0, marks)


def ready(spark, x, y, weight, parts=3):
    return spark.createDataFrame([(int(c), float(w), v.tolist(), k % 5 == 0) for k, (c, w, v) in enumerate(zip(y, weight, x, strict=True))], "y long, weight double, x array<double>, aside boolean").repartition(parts)


def test_pairs_are_the_plain_optimum_and_curves_too(spark):
    x, y = rings(150)
    x = x + np.random.default_rng(3).normal(size=x.shape) * 0.5  # so that no pair is apart
    weight = np.where(y == 0, 2.0, 1.0)
    rows, project, cost = ready(spark, x, y, weight), pairwise.landmark_map("rbf", 0.7, x[:12]), 3.0
    got = pairwise.fit_pairs(rows.select("y", "weight", "x"), project, 3, cost, iterations=120)
    z = np.column_stack([project(x), np.ones(len(x))])
    curves = pairwise.fit_curves(rows.select("y", "x"), project, got, 3)
    for k, (a, b) in enumerate(pairwise.pairs_of(3)):
        on = (y == a) | (y == b)
        s, f, wt = np.where(y[on] == a, 1.0, -1.0), z[on], weight[on]
        loss = lambda w, s=s, f=f, wt=wt: w[:-1] @ w[:-1] / 2 + cost * (wt * np.maximum(1 - s * (f @ w), 0) ** 2).sum()
        w = np.zeros(f.shape[1])
        for _ in range(100):  # Newton's steps on what is active
            act = s * (f @ w) < 1
            h = np.diag(np.append(np.ones(len(w) - 1), 1e-9)) + 2 * cost * (f[act].T * wt[act]) @ f[act]
            w = w - 0.7 * np.linalg.solve(h, np.append(w[:-1], 0) - 2 * cost * f[act].T @ (wt[act] * (s[act] - f[act] @ w)))
        assert loss(got[:, k]) <= loss(w) * 1.01 + 1e-6
        score, n, m = f @ got[:, k], (s > 0).sum(), (s < 0).sum()
        target = np.where(s > 0, (n + 1) / (n + 2), 1 / (m + 2))
        lik = lambda c, u=score, t=target: (t * (c[0] * u + c[1]) + np.logaddexp(0, -(c[0] * u + c[1]))).sum()
        near = [lik(curves[k] + d) for d in np.random.default_rng(k).normal(size=(200, 2)) * 0.05]
        assert lik(curves[k]) <= min(near) + 1e-9 and curves[k, 0] < 0


def plain_coupling(r, steps=20_000):
    """The least sum of squares over the simplex by small steps."""
    n = len(r)
    q = np.array([[sum(r[s, i] ** 2 for s in range(n) if s != i) if i == j else -r[j, i] * r[i, j] for j in range(n)] for i in range(n)])
    a = np.block([[q, np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
    return np.linalg.solve(a, np.append(np.zeros(n), 1.0))[:n]


def test_coupling_is_the_plain_one():
    rng = np.random.default_rng(0)
    r = np.full((40, 4, 4), 0.5)
    for a in range(4):
        for b in range(a + 1, 4):
            r[:, a, b] = rng.uniform(0.02, 0.98, 40)
            r[:, b, a] = 1 - r[:, a, b]
    p = pairwise.coupled(r)
    assert np.allclose(p.sum(1), 1) and (p > 0).all()
    for k in range(40):
        assert np.allclose(p[k], plain_coupling(r[k]), atol=1e-4)
    assert np.allclose(pairwise.coupled(np.full((2, 1, 1), 0.5)), 1) and len(pairwise.coupled(np.zeros((0, 3, 3)))) == 0
    truth = np.array([0.5, 0.3, 0.2])
    assert np.allclose(pairwise.coupled((truth[:, None] / (truth[:, None] + truth))[None])[0], truth, atol=1e-5)


def test_machines_predict_and_say_how_sure(spark):
    x, y = rings(300)
    names = np.array(["glass", "paper", "metal"])
    df = frame(spark, x, y)
    rows = spark.createDataFrame([(k, str(names[c]), v.tolist(), "train" if k < 220 else "val") for k, (c, v) in enumerate(zip(y, x, strict=True))] + [(900, None, [0.0, 0.0], "train"), (901, "glass", None, "train")], "id long, label string, features array<double>, split string")
    machines = pipeline.train_svm(rows, gamma="1", cost=10.0, size=64)
    held = rows.where("split = 'val'").selectExpr("id", "features", "cast(null as string) as error").union(spark.createDataFrame([(999, None, "unreadable")], "id long, features array<double>, error string"))
    out = {r.id: r for r in pipeline.predict_svm(held, machines, 0.5).collect()}
    assert out[999].label is None and out[999].error == "unreadable"
    right = [out[k].label == names[y[k]] for k in range(220, 300)]
    assert np.mean(right) > 0.95 and all(0.5 <= out[k].confidence <= 1 for k in range(220, 300) if out[k].label != "unknown")
    p = {r.id: r.probabilities for r in machines.pairs.predict(df.limit(5)).collect()}
    assert all(abs(sum(v) - 1) < 1e-9 and len(v) == 3 for v in p.values())
    with pytest.raises(ValueError):
        pairwise.fit_pairs(ready(spark, x[:0], y[:0], y[:0]).select("y", "weight", "x"), lambda v: v, 2)
