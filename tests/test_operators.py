"""Operators on small tables with closed results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import labels
from tesserae.operators import balance, distribution, knn, metrics, ordering, pivots, pixels, policy, scaling


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_paths(spark):
    df = spark.createDataFrame([("file:/a/my%20glass/x.PNG",), ("a/paper/y.txt",), ("a/b.c/z",)], "p string")
    got = [(r[0], r[1], r[2]) for r in df.select(labels.label_of(F.col("p")), labels.suffix_of(F.col("p")), labels.is_image(F.col("p"))).collect()]
    assert got == [("my glass", ".png", True), ("paper", ".txt", False), ("b.c", "", False)]


def test_codes_and_vectors(spark):
    r = one(spark, labels.code_of(F.lit("METAL")), labels.code_of(F.lit("wood")), labels.l2_normalised(F.array(F.lit(3.0), F.lit(4.0))), labels.l2_normalised(F.array(F.lit(0.0))), labels.half_even(F.lit(2.5)))
    assert tuple(r) == (4, 6, [0.6, 0.8], [0.0], 2)


def sizes(spark, **n):
    return spark.createDataFrame(list(n.items()), "label string, n long")


def test_stats_use_the_true_median(spark):
    r = distribution.stats(sizes(spark, a=1, b=2, c=3, d=8)).first()
    assert (r["median"], r.median_int, r.mean_int, r.imbalance) == (2.5, 2, 3, 8.0)
    assert distribution.stats(sizes(spark, a=0, b=2)).first().imbalance == float("inf")


def test_weights(spark):
    assert {r.label: r.weight for r in distribution.weights(sizes(spark, a=1, b=3)).collect()} == {"a": 2.0, "b": pytest.approx(2 / 3)}
    assert {r.weight for r in distribution.weights(sizes(spark, a=1, b=3), None).collect()} == {1.0}
    with pytest.raises(ValueError):
        distribution.weights(sizes(spark, a=1), "other")


def test_targets_round_half_to_even(spark):
    got = {r.target: (r.rounded, r.truncated) for r in distribution.target_counts(sizes(spark, a=2, b=3, c=0)).collect()}
    assert got == {"min": (2, 2), "max": (3, 3), "mean": (2, 2), "median": (2, 2)}


def groups(spark, **n):
    return spark.createDataFrame([(f"{label}{k}", label) for label, m in n.items() for k in range(m)], "id string, label string")


def test_split_takes_the_ceiling_of_each_class(spark):
    df = groups(spark, **{f"c{n}": n for n in range(1, 11)})
    out = balance.split(df, "id")
    val = {r.label: r["count"] for r in out.where("split = 'val'").groupBy("label").count().collect()}
    assert [val[f"c{n}"] for n in range(1, 11)] == [1, 1, 1, 2, 2, 2, 3, 3, 3, 3]
    again = {(r.id, r.split) for r in balance.split(df.repartition(7), "id").collect()}
    assert again == {(r.id, r.split) for r in out.collect()}
    assert [r.label for r in balance.small_classes(distribution.counts(df)).collect()] == ["c1"]


def test_plan_sample_and_slots(spark):
    df = groups(spark, a=10, b=4, c=2)
    plan = balance.plan(distribution.counts(df))
    assert {r.label: (r.target_n, r.keep, r.aug_needed) for r in plan.collect()} == {"a": (4, 4, 0), "b": (4, 4, 0), "c": (4, 2, 2)}
    some = balance.sample(df, plan, "id")
    assert {r.label: r["count"] for r in some.groupBy("label").count().collect()} == {"a": 4, "b": 4, "c": 2}
    drawn = balance.slots(some, plan, "id").collect()
    assert len(drawn) == 2 and {r.label for r in drawn} == {"c"} and {r.slot for r in drawn} == {1, 2}
    with pytest.raises(ValueError):
        balance.plan(plan.select("label", "n"), "mode")
    with pytest.raises(ValueError):
        balance.resample(df, "other", "id")


def test_numbers_are_gapless(spark):
    df = spark.createDataFrame([(k,) for k in [5, 5, 1, 10**12, -3, 7]], "k long")
    assert sorted((r.nth, r.k) for r in ordering.numbered(df, "k").collect()) == list(enumerate([-3, 1, 5, 5, 7, 10**12]))
    assert ordering.numbered(df.limit(0), "k").count() == 0


def test_numbers_of_a_hot_key_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(ordering, "STRETCH", 40)
    keys = [7] * 500 + list(range(300)) + [None] * 90 + [10**15]
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(6)
    got = sorted((r.nth, r.k) for r in ordering.numbered(df, "k").collect())
    assert [n for n, _ in got] == list(range(len(keys)))
    assert [k for _, k in got] == sorted(keys, key=lambda k: (k is not None, k or 0))


def test_scaler_keeps_constant_columns(spark):
    train = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "features array<double>")
    scaler = scaling.fit(train)
    assert sorted((r.dim, r.mean, r.scale) for r in scaler.collect()) == [(0, 2.0, 1.0), (1, 5.0, 1.0)]
    unseen = spark.createDataFrame([([2.0, 7.0],)], "features array<double>")
    assert scaling.transform(unseen, scaler).first().features == [0.0, 2.0]
    with pytest.raises(Exception, match="vector length"):
        scaling.transform(spark.createDataFrame([([2.0],)], "features array<double>"), scaler).collect()


def test_neighbours_in_blocks_are_exact(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BUNDLE", 16)
    rng = np.random.default_rng(0)
    x = rng.integers(0, 4, (70, 3)).astype(float)
    df = spark.createDataFrame([(k, k % 3, v.tolist()) for k, v in enumerate(x)], "id long, label int, features array<double>")
    got = {(r.query_id, r["rank"], r.neighbour_id) for r in knn.neighbours(df, df.where("id < 20"), 5).collect()}
    want = {(q, r, int(i)) for q in range(20) for r, i in enumerate(np.lexsort((np.arange(70), ((x - x[q]) ** 2).sum(1)))[:5], 1)}
    assert got == want


def test_votes(spark):
    near = spark.createDataFrame([(1, 1, "b", 1.0), (1, 2, "a", 2.0), (1, 3, "a", 3.0), (1, 4, "b", 4.0), (2, 1, "a", 0.0), (2, 2, "b", 1.0), (2, 3, "b", 1.0)], "query_id int, rank int, label string, distance double")
    tell = lambda df: {r.query_id: r.predicted for r in df.collect()}
    assert tell(knn.vote(near)) == {1: "b", 2: "b"}  # a tie goes to the nearer
    assert tell(knn.vote(near, sizes(spark, a=1, b=1).select("label", F.when(F.col("label") == "a", 5.0).otherwise(1.0).alias("weight")))) == {1: "a", 2: "a"}
    assert tell(knn.vote(near, by_distance=True)) == {1: "b", 2: "a"}
    p = {(r.query_id, r.label): r.probability for r in knn.probabilities(near, sizes(spark, a=1, b=1, c=1)).collect()}
    assert p == {(1, "a"): 0.5, (1, "b"): 0.5, (1, "c"): 0.0, (2, "a"): pytest.approx(1 / 3), (2, "b"): pytest.approx(2 / 3), (2, "c"): 0.0}


def test_metrics_with_missing_classes(spark):
    df = spark.createDataFrame([("a", "a")] * 3 + [("a", "x"), ("b", "a")], "actual string, predicted string")
    pairs = metrics.pair_counts(df)
    assert {(r.actual, r.predicted): r.n for r in metrics.confusion(pairs).collect()} == {("a", "a"): 3, ("a", "b"): 0, ("b", "a"): 1, ("b", "b"): 0}
    per = {r.label: (r.precision, r.recall, r.f1) for r in metrics.per_class(pairs).collect()}
    assert per == {"a": (0.75, 0.75, 0.75), "b": (0.0, 0.0, 0.0)}
    r = metrics.overall(pairs).first()
    assert (r.accuracy, r.balanced_accuracy, r.f1_macro, r.validation_samples) == (0.6, 0.375, 0.25, 5)
    assert [x.label for x in metrics.underperforming(pairs).collect()] == ["b"]
    assert '"accuracy":0.6' in metrics.document(pairs, {"k": 1}).first().metrics


def test_policies(spark):
    label, sure = policy.by_distance(F.lit("glass"), F.lit(0.4))
    assert tuple(one(spark, label, sure)) == ("glass", pytest.approx(0.5))
    assert tuple(one(spark, *policy.by_distance(F.lit("glass"), F.lit(0.81)))) == ("unknown", 0.0)
    assert tuple(one(spark, *policy.by_probability(F.lit("glass"), F.lit(0.6)))) == ("glass", 0.6)
    assert one(spark, policy.by_scores(F.lit("glass"), F.array(F.lit(0.1)))[0])[0] == "unknown"
    m = F.create_map(F.lit("a"), F.lit(0.7))
    assert tuple(one(spark, policy.of_predicted(m, F.lit("a")), policy.of_predicted(m, F.lit("b")))) == (0.7, 0.0)


def images(spark, *grids):
    return spark.createDataFrame([(k, len(g), len(g[0]), [int(x) for row in g for x in row]) for k, g in enumerate(grids)], "id int, height int, width int, px array<int>")


def test_pixels_on_closed_images(spark):
    flat, checker, ramp = np.full((6, 6), 7), (np.indices((6, 6)).sum(0) % 2) * 255, np.tile(np.arange(6) * 10, (6, 1))
    df = images(spark, flat, checker, ramp)
    m = {r.id: (r["mean"], r.sd, r.skew) for r in pixels.moments(df).collect()}
    assert m[0] == (7.0, 0.0, 0.0) and m[1] == (127.5, 127.5, pytest.approx(0))
    g = {(r.id, r.distance, r.angle): r for r in pixels.cooccurrence(df).collect()}
    assert g[0, 1, 0].contrast == 0 and g[0, 1, 0].energy == 1 and g[1, 1, 0].contrast == 49 and g[1, 1, 1].contrast == 0
    top = {(r.id, r.x): r["count"] for r in pixels.gradients(df).groupBy("id", "x").count().collect()}
    assert top[0, 0.0] == 36 and top[2, 80.0] == 24  # inside, a step of 20 between neighbours weighs 4; edges mirror to 0
    assert {r.x for r in pixels.local_patterns(df).where("id = 0").collect()} <= {8, 5, 3}
    turned = pixels.turned(images(spark, [[1, 2, 3], [4, 5, 6]]), F.lit(90)).first()
    assert (turned.height, turned.width, turned.px) == (3, 2, [4, 1, 5, 2, 6, 3])
    noisy = [r.px for r in pixels.noisy(df).orderBy("id").collect()]
    assert noisy == [r.px for r in pixels.noisy(df.repartition(3)).orderBy("id").collect()] and noisy[0] != [7] * 36


def test_blocks_agree_with_the_frames(spark):
    from tesserae.functions import blocks

    gray = np.random.default_rng(1).integers(0, 256, (9, 9)).astype(np.uint8)
    df, s = images(spark, gray), blocks.sample(np.repeat(gray[..., None], 3, 2), 9)
    assert (s.gray == gray).all()
    shares = lambda f: np.array([r.share for r in f.orderBy("bin").collect()])
    assert np.allclose(shares(pixels.gradient_histogram(df)), blocks.gradient_hist(s))
    for radius in (1, 2, 3):
        assert np.allclose(shares(pixels.pattern_histogram(df, radius)), blocks.lbp(s, radii=(radius,)))
    got = pixels.cooccurrence(df).orderBy("distance", "angle").collect()
    assert np.allclose([r[p] for p in ("contrast", "homogeneity", "energy") for r in got], blocks.glcm(s))
    r = pixels.cosine_bands(df, (0.3, 0.6)).first()
    assert np.allclose([r.low, r.mid, r.high], blocks.dct_bands(s, (0.3, 0.6)))


def test_vector_layout():
    from tesserae.functions import blocks

    v = blocks.vector(np.zeros((256, 256, 3), np.uint8))
    assert v.dtype == np.float32 and len(v) == 335 == sum(n for *_, n in blocks.layout()) and np.isfinite(v).all()
    assert [(b.name, b.size) for b in blocks.DEFAULT] == [(n, k) for n, _, k in blocks.layout()]
    more = blocks.with_settings(fft_energy_bands={"enabled": True}, glcm={"enabled": False}, color_hist_hsv={"bins": 8})
    assert sum(n for *_, n in blocks.layout(more)) == 335 + 3 - 24 - 24
    assert len(blocks.vector(np.zeros((8, 8, 4)), ())) == 0
    with pytest.raises(ValueError):
        blocks.with_settings(nothing={})
    with pytest.raises(ValueError):
        blocks.sample(np.zeros((4, 4)))


def test_transforms():
    from tesserae.operators import augment

    img = np.random.default_rng(2).integers(0, 256, (40, 30, 3)).astype(np.uint8)
    for key in augment.KEYS:
        out = augment.augmented(img, (key,), augment.rng_of(1, "a", 1))
        assert out.shape == img.shape and out.dtype == np.uint8
        assert (out == augment.augmented(img, (key,), augment.rng_of(1, "a", 1))).all()
    assert augment.chosen([" hflip", "hflip", "clahe"]) == ("clahe", "hflip") and len(augment.chosen()) == 17
    assert augment.chosen(groups=["advanced"]) == ("coarse_dropout", "optical_distortion")
    for bad in ({"keys": ["spin"]}, {"groups": ["none"]}, {"intensity": "huge"}):
        with pytest.raises(ValueError):
            augment.chosen(**bad)
