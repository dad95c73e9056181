"""Support-vector machines of pairs of classes, trained side by side, and their probabilities.

Each pair of classes has a machine on an explicit feature map: the least |w|^2 / 2 + cost * (sum of weighted squared hinges over the rows of
the two classes). One pass over the rows gives the gradients of all pairs, so training costs as many passes as one machine. Votes of the pairs
give the class (the first of equal ones). Each pair has a logistic curve of its own, fitted by Newton's steps to decision values of rows
that it was not trained on; the class probabilities are those that agree best with the pairs' (pairwise coupling, second method of Wu,
Lin and Weng, 2004).

The kernel maps go through landmarks: z(x) = k(x, L) k(L, L)^(-1/2), with landmarks L by k-means from a bounded sample of the rows.
The driver holds machines, gradients and second moments of classes, whose number does not depend on the rows; MOST_NUMBERS bounds them.

Defined cases: rows without a vector or class are not learned from; a pair without curve rows of both classes has the plain logistic
curve; one class alone has probability 1; of rows without a vector nothing is said (null); without any rows training stops with an error.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import pivots, svm

#: Rows of the sample from which landmarks come, and numbers that machines of all pairs may have.
SAMPLE, MOST_NUMBERS = 8192, 1 << 27
#: Rows whose probabilities are worked out together.
ROWS = 512


@dataclass(frozen=True)
class LandmarkMap:
    """The map of rows through landmarks: its products are the kernel's values, exactly so between landmarks. `linear` leaves rows as they are."""

    kernel: str
    gamma: float
    landmarks: np.ndarray
    root: np.ndarray

    def values(self, x: np.ndarray) -> np.ndarray:
        """The kernel between rows and landmarks."""
        y = self.landmarks
        if self.kernel == "rbf":
            return np.exp(-self.gamma * np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0))
        return (self.gamma * x @ y.T) ** 3

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x if self.kernel == "linear" else self.values(x) @ self.root


def landmark_map(kernel: str, gamma: float, landmarks: np.ndarray) -> LandmarkMap:
    if kernel not in svm.KERNELS:
        raise ValueError(f"unknown kernel {kernel!r}")
    if kernel == "linear":
        return LandmarkMap(kernel, gamma, landmarks, np.zeros((0, 0)))
    own, axes = np.linalg.eigh(LandmarkMap(kernel, gamma, landmarks, np.zeros((0, 0))).values(landmarks))
    some = own > own.max(initial=0) * 1e-10
    return LandmarkMap(kernel, gamma, landmarks, axes[:, some] / np.sqrt(own[some]))


def landmarks(rows: DataFrame, size: int, vector: str = "x") -> np.ndarray:
    """`size` centres of a sample of SAMPLE rows (those with the smallest hashes of their vectors)."""
    some = rows.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("x")).orderBy(F.xxhash64("x")).limit(SAMPLE).toArrow()
    return pivots.chosen(svm.matrix(some.column("x").combine_chunks()), size) if some.num_rows else np.zeros((0, 1))


def pairs_of(n: int) -> list[tuple[int, int]]:
    return list(combinations(range(n), 2))


def _signs(n: int) -> np.ndarray:
    """class x pair: 1 for the pair's first class, -1 for its second, 0 for others."""
    out = np.zeros((n, n * (n - 1) // 2))
    for k, (a, b) in enumerate(pairs_of(n)):
        out[a, k], out[b, k] = 1, -1
    return out


def _lifted(project, b: pa.RecordBatch) -> np.ndarray:
    z = project(svm.matrix(b.column("x")))
    return np.column_stack([z, np.ones(len(z))])


def _moments(project, b: pa.RecordBatch) -> dict[int, np.ndarray]:
    """Weighted second moments of each class's rows."""
    z, y, weight = _lifted(project, b), b.column("y").to_numpy(), b.column("weight").to_numpy()
    return {int(c): z[y == c].T @ (z[y == c] * weight[y == c, None]) for c in np.unique(y)}


def fit_pairs(rows: DataFrame, project, classes: int, cost: float = 1.0, iterations: int = 60) -> np.ndarray:
    """Weights (dims + 1, pairs) of all pairs' machines. rows: y (0 to classes - 1), weight, x."""
    signs = _signs(classes)
    moments = svm.added(rows, lambda b: _moments(project, b))
    if not moments:
        raise ValueError("no rows to train on")
    dims = int(np.sqrt(len(next(iter(moments.values())))))
    if dims * dims * max(len(signs[0]), 1) > MOST_NUMBERS:
        raise ValueError("too many classes for machines of all pairs")
    of = [moments[c].reshape(dims, dims) if c in moments else np.zeros((dims, dims)) for c in range(classes)]
    pull = np.append(np.ones(dims - 1), 0.0) / cost  # the offset is free
    steps = np.array([np.linalg.inv(2 * (of[a] + of[b]) + np.diag(pull + 1e-9)) for a, b in pairs_of(classes)]).reshape(-1, dims, dims)
    w = np.zeros((dims, signs.shape[1]))
    ahead, t = w.copy(), 1.0
    for _ in range(iterations if signs.shape[1] else 0):
        shared = rows.sparkSession.sparkContext.broadcast(ahead)

        def each(b, shared=shared):
            z, sign = _lifted(project, b), signs[b.column("y").to_numpy()]
            short = np.maximum(1 - sign * (z @ shared.value), 0) * sign * b.column("weight").to_numpy()[:, None]
            return {0: -2 * z.T @ short}

        grad = svm.added(rows, each)[0].reshape(w.shape) + pull[:, None] * ahead
        before, t_before = w, t
        w = ahead - np.einsum("pij,jp->ip", steps, grad)
        t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = w + (t_before - 1) / t * (w - before)
    return w


def fit_curves(rows: DataFrame, project, weights: np.ndarray, classes: int, rounds: int = 25) -> np.ndarray:
    """(pair, 2): a and b of P(first class) = 1 / (1 + exp(a * score + b)), with Platt's targets, for rows (y, x) that were not trained on."""
    signs = _signs(classes)
    got = svm.added(rows, lambda b: {0: np.bincount(b.column("y").to_numpy(), minlength=classes).astype(float)})
    n = got.get(0, np.zeros(classes))
    out, plain = np.zeros((signs.shape[1], 2)), np.array([-1.0, 0.0])
    out[:] = plain
    pairs = np.array(pairs_of(classes)).reshape(-1, 2)
    some = np.flatnonzero((n[pairs[:, 0]] > 0) & (n[pairs[:, 1]] > 0)) if len(pairs) else np.zeros(0, int)
    if not len(some):
        return out
    high, low = (n[pairs[some, 0]] + 1) / (n[pairs[some, 0]] + 2), 1 / (n[pairs[some, 1]] + 2)
    now = np.column_stack([np.zeros(len(some)), np.log((n[pairs[some, 1]] + 1) / (n[pairs[some, 0]] + 1))])
    step, best = np.zeros_like(now), np.full(len(some), np.inf)
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(now)

        def each(b, shared=shared):
            s, sign = (_lifted(project, b) @ weights)[:, some], signs[b.column("y").to_numpy()][:, some]
            on, target = sign != 0, np.where(sign > 0, high, low)
            u = s * shared.value[:, 0] + shared.value[:, 1]
            p = 1 / (1 + np.exp(np.clip(u, -500, 500)))
            loss = np.where(on, target * u + np.logaddexp(0, -u), 0)  # -log likelihood; P = 1 / (1 + exp(u))
            d, h = np.where(on, target - p, 0), np.where(on, p * (1 - p), 0)
            return {0: np.stack([loss.sum(0), (d * s).sum(0), d.sum(0), (h * s * s).sum(0), (h * s).sum(0), h.sum(0)])}

        loss, da, db, haa, hab, hbb = svm.added(rows, each)[0].reshape(6, -1)
        worse = loss > best + 1e-10
        step[worse] /= 2  # too far: half way back
        now[worse] -= step[worse]
        good = ~worse
        best[good] = loss[good]
        haa, hbb = haa + 1e-12, hbb + 1e-12
        det = np.maximum(haa * hbb - hab * hab, 1e-300)
        new = -np.column_stack([hbb * da - hab * db, haa * db - hab * da]) / det[:, None]
        step[good] = new[good]
        now[good] += new[good]
        if good.all() and np.abs(new).max() < 1e-9:
            break
    out[some] = now
    return out


def coupled(r: np.ndarray, rounds: int = 100, close: float = 1e-6) -> np.ndarray:
    """Class probabilities (rows, classes) from the pairs' r (rows, classes, classes), r[:, i, j] = P(i | i or j)."""
    n = r.shape[1]
    r = np.clip(r, 1e-7, 1 - 1e-7)
    turned = r.transpose(0, 2, 1)
    q = -turned * r
    eye = np.arange(n)
    square = turned**2
    square[:, eye, eye] = 0
    q[:, eye, eye] = square.sum(2)
    p = np.full((len(r), n), 1 / n)
    for _ in range(max(rounds, n)):
        qp = np.einsum("rij,rj->ri", q, p)
        whole = (p * qp).sum(1)
        if n < 2 or (np.abs(qp - whole[:, None]).max(initial=0)) < close / n:
            break
        for t in range(n):
            change = (whole - qp[:, t]) / q[:, t, t]
            p[:, t] += change
            whole = (whole + change * (change * q[:, t, t] + 2 * qp[:, t])) / (1 + change) ** 2
            qp = (qp + change[:, None] * q[:, t]) / (1 + change)[:, None]
            p /= (1 + change)[:, None]
    return p


@dataclass(frozen=True)
class PairMachines:
    """The map of scaled vectors, weights of all pairs, their curves, and the number of classes."""

    project: Callable[[np.ndarray], np.ndarray]
    weights: np.ndarray
    curves: np.ndarray
    classes: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.project(x)
        return np.column_stack([z, np.ones(len(z))]) @ self.weights

    def votes(self, scores: np.ndarray) -> np.ndarray:
        """The class with the most pairs won, the first of equal ones."""
        signs = _signs(self.classes)
        won = (scores > 0) @ (signs > 0).T.astype(int) + (scores <= 0) @ (signs < 0).T.astype(int)
        return won.argmax(1)

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        r = np.full((len(scores), self.classes, self.classes), 0.5)
        p = 1 / (1 + np.exp(np.clip(scores * self.curves[:, 0] + self.curves[:, 1], -500, 500)))
        for k, (a, b) in enumerate(pairs_of(self.classes)):
            r[:, a, b], r[:, b, a] = p[:, k], 1 - p[:, k]
        return coupled(r)

    def predict(self, rows: DataFrame, key: str = "id", vector: str = "features") -> DataFrame:
        """id, predicted (a class's number), probabilities of all classes; rows without a vector are left out."""
        shared = rows.sparkSession.sparkContext.broadcast(self)

        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    b, own = batch.slice(at, ROWS), shared.value
                    s = own.scores(svm.matrix(b.column("x")))
                    yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(own.votes(s).astype(np.int32)), pa.array(list(own.probabilities(s)), pa.list_(pa.float64()))], ["id", "predicted", "probabilities"])

        kind = rows.schema[key].dataType.simpleString()
        some = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x"))
        return some.mapInArrow(run, f"id {kind}, predicted int, probabilities array<double>")


def train(rows: DataFrame, classes: int, kernel: str = "rbf", gamma: float = 1.0, cost: float = 1.0, size: int = 256, iterations: int = 60) -> PairMachines:
    """From rows (y, weight, x, aside): machines of the rows that are not aside, curves from those that are."""
    project = landmark_map(kernel, gamma, np.zeros((0, 1)) if kernel == "linear" else landmarks(rows.where("not aside"), size))
    weights = fit_pairs(rows.where("not aside").select("y", "weight", "x"), project, classes, cost, iterations)
    return PairMachines(project, weights, fit_curves(rows.where("aside").select("y", "x"), project, weights, classes), classes)
