"""Nearest neighbours by pivots against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import knn, pivots

SCHEMA = "id long, label string, features array<double>, part int, bundle string"


def brute(train, queries, k):
    ids, x = [r[0] for r in train], np.array([r[2] for r in train])
    place = {i: n for n, i in enumerate(sorted(ids, key=lambda i: (i is None, i)))}
    for i, q in queries:
        d = np.sqrt(((x - np.array(q)) ** 2).sum(1))
        order = sorted(range(len(ids)), key=lambda j: (d[j], place[ids[j]]))[:k]
        for rank, j in enumerate(order, 1):
            yield i, rank, ids[j], round(float(d[j]), 9)


def run(spark, train, queries, k):
    t = spark.createDataFrame([(i, l, x, 1, "b") for i, l, x in train], SCHEMA)
    search = pivots.Nearest(t, spark.createDataFrame(queries, "id long, features array<double>"), k, "id", "label", "features")
    out = search.run()
    return search, sorted((r.query_id, r["rank"], r.neighbour_id, round(r.distance, 9)) for r in out.collect())


def clustered(rng, n, centres, dims=8):
    c = rng.normal(size=(centres, dims)) * 20
    return [[float(v) for v in c[k % centres] + rng.normal(size=dims) * 0.3] for k in range(n)]


def test_clusters_are_pruned(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BUNDLE", 64)
    rng = np.random.default_rng(0)
    train = [(k, "ab"[k % 2], x) for k, x in enumerate(clustered(rng, 1500, 25))]
    queries = [(k, [v + 0.05 for v in train[k * 7][2]]) for k in range(200)] + [(999, [100.0] * 8)]
    search, got = run(spark, train, queries, 5)
    assert got == sorted(brute(train, queries, 5))
    pairs = sum(p.agg(F.sum("pairs")).first()[0] for p in search.probes)
    assert pairs < len(train) * len(queries) / 3
    sent = search.probes[1].count()
    assert sent < 8 * len(queries)  # of 24 bundles


@pytest.mark.parametrize("most", [1 << 16, 7])
def test_ties_copies_and_few_rows(spark, monkeypatch, most):
    """A third of all rows is one vector; others stand at equal distances; ids repeat; there are fewer queries for a copy than queries."""
    monkeypatch.setattr(pivots, "BUNDLE", 16)
    monkeypatch.setattr(pivots, "MOST_QUERIES", most)
    rng = np.random.default_rng(1)
    train = [(k, "a", [0.0, 0.0]) for k in range(60)] + [(100 + k, "b", [float(k % 5 - 2), float(k % 3 - 1)]) for k in range(60)] + [(300 + k, "c", [float(v) for v in rng.normal(size=2)]) for k in range(60)]
    queries = [(k, [float(k % 3 - 1), 0.0]) for k in range(40)] + [(40 + k, [float(v) for v in rng.normal(size=2) * 3]) for k in range(20)]
    for k in (1, 7, 70, 200):
        assert run(spark, train, queries, k)[1] == sorted(brute(train, queries, k)), k


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BUNDLE", 4)
    rows = [(k, "a", [float(k), 1.0]) for k in range(9)] + [(None, "n", [3.0, 1.0])]
    both = [*rows, (77, "x", None)]
    asked = [(1, [3.1, 1.0]), (2, None)]
    assert run(spark, both, asked, 3)[1] == sorted(brute(rows, asked[:1], 3))
    t, q = spark.createDataFrame([(i, l, x, 1, "b") for i, l, x in both], SCHEMA), spark.createDataFrame(asked, "id long, features array<double>")
    assert knn.neighbours(t.limit(0), q, 3).count() == 0 and knn.neighbours(t, q.limit(0), 3).count() == 0
    named = spark.createDataFrame([("p", 1, [0.0]), ("q", 2, [0.0]), ("a", 3, [1.0])], "id string, label int, features array<float>")
    assert [tuple(r) for r in knn.neighbours(named, named.where("id = 'q'"), 2).orderBy("rank").collect()] == [("q", 1, "p", 1, 0.0), ("q", 2, "q", 2, 0.0)]


def test_what_a_task_sends_on_at_a_time_does_not_grow_with_bundles():
    """1,024 queries that see each of 200 bundles were one batch of 204,800 rows."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    rings = pivots.Rings(rng.normal(size=(50, 16)), [{"bundle": b, "cell": c, "n": 80, "lo": 0.0, "hi": 99.0} for b in range(200) for c in range(50)])
    x = pa.array(rng.normal(size=(1024, 16)).tolist(), pa.list_(pa.float64()))
    asked = pa.RecordBatch.from_arrays([pa.array(range(1024)), x, pa.array([np.inf] * 1024)], ["q", "features", "bound"])
    for second in (None, True):
        sent = list(pivots._routes(rings, 5, second, None, False)(iter([asked])))
        assert sum(b.num_rows for b in sent) == 1024 * 200 and max(b.nbytes for b in sent) < 1 << 23
        assert sum(sum(b.column("pairs").to_pylist()) for b in sent) == 1024 * 200 * 50 * 80
