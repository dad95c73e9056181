"""Feature blocks as expressions against the NumPy blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import blocks, vectors
from tesserae.operators import features


def pictures():
    rng = np.random.default_rng(0)
    out = []
    for k in range(6):
        h, w = (int(v) for v in rng.integers(1, 14, 2))
        img = rng.integers(0, 256, (h, w, 4 if k == 3 else 3))
        img = img // 64 * 64 if k == 1 else np.repeat(np.repeat(img[:1, :1], h, 0), w, 1) if k == 2 else img
        out.append((k, h, w, [int(v) for v in img.ravel()]))
    return out


@pytest.fixture(scope="module")
def images(spark):
    odd = [(90, 2, 2, None), (91, 0, 0, []), (92, 2, 2, [1, 2, 3]), (93, None, 2, [1, 2, 3])]
    clash = [(*r, "x", 1, 2) for r in pictures() + odd]
    return spark.createDataFrame(clash, "id long, height int, width int, rgb array<int>, sample string, flat int, gray int")


def test_preprocessing_is_the_plain_one(images):
    got = {r.id: r.seen for r in features.preprocessed(images, 8, out="seen").collect()}
    assert all(got[k] is None for k in (90, 91, 92, 93))
    for k, h, w, px in pictures():
        s = blocks.sample(np.array(px).reshape(h, w, -1), 8)
        for name, want in (("gray", s.gray), *((c, s.hsv[:, :, i]) for i, c in enumerate(vectors.CHANNELS["hsv"])), *((c, s.lab[:, :, i]) for i, c in enumerate(vectors.CHANNELS["lab"])), *((c, s.rgb[:, :, i]) for i, c in enumerate(vectors.CHANNELS["rgb"]))):
            have = np.array([p[name] for p in got[k]])
            assert (have != want.ravel()).mean() <= 0.05 and abs(have - want.ravel()).max() <= 1, (k, name)  # halves are rounded either way


def test_vectors_are_the_plain_ones(images):
    chosen = vectors.with_settings(color_hist_lab={"enabled": True})
    plain = blocks.with_settings(blocks.REGISTRY, gabor={"enabled": False}, color_hist_lab={"enabled": True})
    out = {r.id: r for r in features.expressed(images, chosen, side=10).collect()}
    assert [r.error is None for _, r in sorted(out.items())] == [True] * 6 + [False] * 4 and out[90].features is None
    assert "rgb" not in features.expressed(images, chosen, side=10).columns
    for k, h, w, px in pictures():
        want = blocks.vector(np.array(px).reshape(h, w, -1), plain, 10)
        assert len(out[k].features) == len(want) == sum(n for _, _, n in vectors.layout(chosen))
        off = np.abs(np.array(out[k].features) - want)
        assert np.quantile(off, 0.9) < 0.021 and off.max() < 0.6, (k, off.max())
        if k in (1, 2):  # no halves to round
            assert off.max() < 1e-3, (k, off.argmax())


def test_full_vectors_are_the_plain_ones(images):
    chosen = vectors.with_settings(vectors.FULL, fft_energy_bands={"enabled": True})
    plain = blocks.with_settings(blocks.REGISTRY, fft_energy_bands={"enabled": True})
    assert [x for x in vectors.layout(vectors.FULL) if x[2]][-1] == ("dct_energy_bands", 332, 3)
    out = {r.id: r.features for r in features.expressed(images.where("id < 6"), chosen, side=10).collect()}
    places = {name: slice(a, a + n) for name, a, n in vectors.layout(chosen)}
    for k, h, w, px in pictures():
        img = np.array(px).reshape(h, w, -1)
        want, got = blocks.vector(img, plain, 10), np.array(out[k])
        assert len(want) == len(got) == 338
        assert np.allclose(got[places["gabor"]], want[places["gabor"]], rtol=0.02, atol=3), k  # halves are rounded either way
        assert np.allclose(got[places["fft_energy_bands"]], want[places["fft_energy_bands"]], atol=2e-3), k
        if k in (1, 2):  # no halves to round
            assert np.allclose(got[places["gabor"]], want[places["gabor"]], rtol=1e-4, atol=1e-2), k


@pytest.mark.parametrize("side", [1, 2, 7, 16])
def test_filters_and_bands_on_given_squares(spark, side):
    rng = np.random.default_rng(side)
    grays = [rng.integers(0, 256, (side, side)) for _ in range(3)] + [np.zeros((side, side), int), np.full((side, side), 255)]
    df = spark.createDataFrame([(k, [int(v) for v in g.ravel()]) for k, g in enumerate(grays)] + [(9, None)], "id long, gray array<int>")
    s = {"gray": F.col("gray"), "side": side}
    got = {r.id: r for r in df.select("id", vectors.gabor(s).alias("g"), vectors.gabor(s, sigmas=(4.0,), lambdas=(10.0,)).alias("one"), vectors.fft_bands(s).alias("f")).collect()}
    assert got[9].g is None or all(x is None for x in got[9].g)
    for k, g in enumerate(grays):
        plain = blocks.Sample(*(g if f == "gray" else None for f in blocks.Sample.__dataclass_fields__))
        assert np.allclose(got[k].g, blocks.gabor(plain), atol=1e-6) and np.allclose(got[k].one, blocks.gabor(plain, sigmas=(4.0,), lambdas=(10.0,)), atol=1e-6)
        assert np.allclose(got[k].f, blocks.fft_bands(plain), atol=1e-9)
    with pytest.raises(ValueError):
        vectors.gabor({"gray": F.col("gray"), "side": 65})


def test_joint_histogram_is_the_plain_one(images):
    some = features.preprocessed(images.where("id < 6"), 8, out="seen")
    got = {r.id: r for r in some.select("id", "seen", vectors.joint_hist(vectors.sample(F.col("seen"), 8)).alias("j")).collect()}
    for k, *_ in pictures():
        hsv = np.array([[p[c] for c in vectors.CHANNELS["hsv"]] for p in got[k].seen]).reshape(8, 8, 3)
        plain = blocks.Sample(*(hsv if f == "hsv" else None for f in blocks.Sample.__dataclass_fields__))
        assert np.allclose(got[k].j, blocks.joint_hist(plain), atol=1e-12)


def test_settings_and_layout(images):
    assert [x for x in vectors.layout() if x[0] == "dct_energy_bands"] == [("dct_energy_bands", 300, 3)]
    some = vectors.with_settings(**{b.name: {"enabled": b.name == "specular_ratio"} for b in vectors.REGISTRY})
    assert {len(r.features) for r in features.expressed(images.where("id < 6"), some, side=4).collect()} == {1}
    none = vectors.with_settings(**{b.name: {"enabled": False} for b in vectors.REGISTRY})
    assert {len(r.features) for r in features.expressed(images.where("id < 6"), none, side=4).collect()} == {0}
    with pytest.raises(ValueError):
        vectors.with_settings(nothing={"enabled": True})
    wrong = vectors.with_settings(some, specular_ratio={"size": 2})
    with pytest.raises(Exception, match="does not have 2 numbers"):
        features.expressed(images.where("id < 6"), wrong, side=4).select(F.size("features")).collect()


def test_the_layout_has_every_block_of_the_vector(spark):
    """The query and its SQL name all nine blocks of the 335 numbers, the filter responses too, each with all images."""
    import duckdb

    import __spark_entry__ as e

    folder = "/root/testdata/sf0.001"
    want = [(*b, 500) for b in blocks.layout()]
    assert len(want) == 9 and ("gabor", 201, 32, 500) in want
    assert sorted(tuple(r) for r in e.queries()["feature_layout"](spark, folder).collect()) == sorted(want)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet')")
    assert sorted(con.execute(e.oracle_sql()["feature_layout"]).fetchall()) == sorted(want)


def test_filter_responses_are_plain_correlations_by_fast_transforms(monkeypatch):
    """94 pixels a side, the image and its mirrored edges, have the factor 47: the transforms take the next length without such factors."""
    bank, shapes = blocks._gabor_bank, []
    monkeypatch.setattr(blocks, "_gabor_bank", lambda shape, *rest: shapes.append(shape) or bank(shape, *rest))
    img = np.random.default_rng(3).integers(0, 256, (64, 64, 3))
    s = blocks.sample(img, 64)
    got = blocks.gabor(s)
    assert shapes == [(96, 96)] and [blocks._fast(n) for n in (1, 7, 94, 286, 300)] == [1, 8, 96, 288, 300]
    g = np.pad(s.gray.astype(float), 15, mode="reflect")
    y, x = np.mgrid[-15:16, -15:16]
    for k in (0, 5, 11, 15):
        sigma, lam, theta = (2, 4)[k // 8], (6, 10)[k // 4 % 2], k % 4 * np.pi / 4
        u, v = x * np.cos(theta) + y * np.sin(theta), y * np.cos(theta) - x * np.sin(theta)
        kernel = np.exp(-(u * u + 0.25 * v * v) / (2 * sigma**2)) * np.cos(2 * np.pi * u / lam)
        full = np.einsum("rcij,ij->rc", np.lib.stride_tricks.sliding_window_view(g, (31, 31)), kernel)
        assert got[2 * k : 2 * k + 2] == pytest.approx([full.mean(), full.std()], rel=1e-9, abs=1e-9)
