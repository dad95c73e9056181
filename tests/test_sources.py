"""Folders of images, requests, runs, streams, and the whole way from files to predictions."""

import base64
import json
import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.plans import pipeline, serving
from tesserae.sources import images, store
from tesserae.streaming import frames


def png(path, img):
    kind = {1: 0, 3: 2, 4: 6}[img.shape[2]]
    raw = b"".join(b"\0" + row.tobytes() for row in img.astype(np.uint8))
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", img.shape[1], img.shape[0], 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tree"))
    rng = np.random.default_rng(0)
    for label, colour in (("glass", (200, 30, 30)), ("paper", (30, 200, 30))):
        for k in range(8 if label == "glass" else 5):
            png(f"{root}/{label}/{k}.{'PNG' if k == 1 else 'png'}", np.clip(np.array(colour) + rng.normal(0, 12, (20, 24, 3)), 0, 255))
    return root


def test_listing_decoding_quarantine(spark, tmp_path):
    root = str(tmp_path)
    img = np.arange(2 * 3 * 3).reshape(2, 3, 3)
    png(f"{root}/a b/x.png", img), png(f"{root}/a b/Y.PNG", np.full((2, 2, 1), 9)), png(f"{root}/c/z.png", np.full((1, 1, 4), 7))
    for name, data in (("c/empty.jpg", b""), ("c/junk.jpg", b"no image"), ("c/w.webp", b"RIFF"), ("c/notes.txt", b"t")):
        with open(f"{root}/{name}", "wb") as f:
            f.write(data)
    assert images.listing(spark, root).count() == 6
    assert [r.path.rsplit("/", 1)[1] for r in images.sorted_listing(spark, root).collect()][:2] == ["x.png", "Y.PNG"]
    got = {r.path.rsplit("/", 1)[1]: r for r in images.images(spark, root).collect()}
    assert set(got) == {"x.png", "Y.PNG", "z.png"}
    assert got["x.png"].rgb == bytearray(img.astype(np.uint8).tobytes()) and got["x.png"].label == "a b"
    assert got["Y.PNG"].rgb == bytearray([9] * 12) and got["z.png"].rgb == bytearray([7] * 3)
    bad = {r.path.rsplit("/", 1)[1]: r.reason for r in images.quarantine(spark, root).collect()}
    assert bad == {"empty.jpg": "empty", "junk.jpg": "unreadable", "w.webp": "unsupported"}


def test_requests(spark):
    good = base64.b64encode(b"data").decode()
    rows = [(json.dumps({"image": good, "classifier": "KNN"}),), (json.dumps({"image": "@@@", "classifier": "svm"}),), (json.dumps({"image": good, "classifier": "tree"}),), ("{",)]
    got = images.requests(spark.createDataFrame(rows, "value string")).collect()
    assert [r.error for r in got] == [None, "image is not base64", "classifier must be knn or svm", "image is not base64"]
    assert got[0].content == bytearray(b"data") and got[0].classifier == "knn"
    name = images.spool_names(spark.createDataFrame([(bytearray(b"data"),)], "content binary").withColumn("ts", F.lit("2024-01-02 03:04:05").cast("timestamp"))).first().name
    assert name.startswith("frame_20240102_030405_000_") and name.endswith(".jpg")


def test_store(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1.0], "train"), (2, "b", [2.0], "val")], "id long, label string, features array<float>, split string")
    store.write_features(df, f"{tmp_path}/f")
    assert [r.id for r in store.read_features(spark, f"{tmp_path}/f", "val").collect()] == [2]
    with pytest.raises(ValueError):
        store.write_features(df.drop("split"), f"{tmp_path}/g")
    runs = store.Runs(spark, f"{tmp_path}/runs")
    first = runs.save("knn", {"knn": df, "knn_scaler": df}, {"k": 1}, {"accuracy": 0.5})
    second = runs.save("knn", {"knn": df, "scaler": df.limit(1)}, {"k": 6}, {"accuracy": 0.5})
    runs.save("svm", {"svm": df, "svm_scaler": df}, metrics={"accuracy": 0.9}, run_id="best")
    assert runs.best("knn") == first != second and runs.best("tree") is None
    assert runs.model("best")[0] == "svm" and runs.scaler(second).count() == 1 and runs.runs().count() == 3
    with pytest.raises(FileNotFoundError):
        runs.model("none")


def test_files_to_predictions(spark, tree):
    settings = pipeline.Build(side=32)
    rows = pipeline.build(spark, tree, settings).withColumn("id", F.concat_ws("#", "path", F.monotonically_increasing_id())).cache()
    n = {(r.label, r.split, r.is_augmented): r["count"] for r in rows.groupBy("label", "split", "is_augmented").count().collect()}
    # 8 and 5 images: 3 and 2 are held out, 5 and 3 left, of which the median target is 4
    assert n == {("glass", "val", False): 3, ("paper", "val", False): 2, ("glass", "train", False): 4, ("paper", "train", False): 3, ("paper", "train", True): 1}
    assert {len(r.features) for r in rows.collect()} == {335}
    model = {k: v.cache() for k, v in pipeline.train_knn(rows.select("id", "label", "features", "split"), (1, 3)).items()}
    assert '"accuracy":1.0' in model["metrics"].first().metrics
    odd = rows.select("id", "features", "error").union(spark.createDataFrame([("x", None, "no pixels")], "id string, features array<float>, error string"))
    out = {r.id: r for r in pipeline.predict(odd, model, k=3).collect()}
    assert len(out) == 14 and out["x"].code is None and out["x"].error == "no pixels"
    assert all(r.code in (0, 1) and r.confidence >= 0.6 for r in out.values() if r.id != "x")
    assert {r.label for r in pipeline.predict(odd, model, k=1, distance=0.0).collect() if r.label} >= {"glass", "paper"}  # rows of the model itself are at distance 0
    machines = pipeline.train_svm(rows.select("id", "label", "features", "split"), "linear", cost=10.0, iterations=8)
    by_svm = {r.id: r for r in pipeline.predict_svm(odd, machines, 0.5).collect()}
    right = {r.id: r.label for r in rows.collect()}
    assert by_svm["x"].error == "no pixels" and all(r.label == right[k] and 0.5 <= r.confidence <= 1 for k, r in by_svm.items() if k != "x")
    read = lambda name: base64.b64encode(open(f"{tree}/{name}", "rb").read()).decode()  # noqa: E731, SIM115
    asked = [(1, read("glass/0.png"), "knn"), (2, read("paper/3.png"), "KNN"), (3, base64.b64encode(b"no image").decode(), "knn"), (4, "@", "knn"), (5, read("glass/0.png"), "tree"), (6, read("glass/0.png"), "svm")]
    rows = spark.createDataFrame([(k, json.dumps({"image": i, "classifier": c})) for k, i, c in asked], "id long, value string")
    said = {r.id: (r.className, r.error) for r in serving.answer(rows, model, machines, side=32, k=3, certainty=0.5).collect()}
    assert said == {1: ("glass", None), 2: ("paper", None), 3: (None, "no pixels"), 4: (None, "image is not base64"), 5: (None, "classifier must be knn or svm"), 6: ("glass", None)}


def test_small_classes_are_refused(spark, tmp_path):
    png(f"{tmp_path}/only/1.png", np.zeros((2, 2, 3)))
    with pytest.raises(ValueError, match="only"):
        pipeline.build(spark, str(tmp_path))


MS = [0, 499, 500, 900, 1000, 1001]


def test_throttle(spark):
    df = spark.createDataFrame([("a", t, t) for t in MS] + [("b", 5, 5)], "device string, ms long, key long")
    assert sorted((r.device, r.key) for r in frames.throttle(df, "device", "ms", "key").collect()) == [("a", 0), ("a", 500), ("a", 1000), ("b", 5)]
    assert {(r.device, r.ms) for r in frames.latest(df, "device", "ms").collect()} == {("a", 1001), ("b", 5)}


def test_throttle_of_a_hot_device_is_spread(spark, monkeypatch):
    rng = random.Random(3)
    times = [t for t in range(0, 60_000, 7) if rng.random() < 0.3] + [rng.randrange(-9_000, 0) for _ in range(20)]
    rows = [("hot", t, 10 * t + k) for t in times for k in range(2)] + [(None, t, 10 * t) for t in (0, 499, 600, 5_000)] + [("late", 90_000, 7), ("none", None, 1), ("none", None, 2)]
    df = spark.createDataFrame(rows, "device string, ms long, key long").repartition(5)
    want, last = [], {}
    for d, t, k in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2])):
        if last.get(d) is None or t - last[d] >= 500:
            last[d] = t
            want.append((d, k))
    monkeypatch.setattr(frames, "BLOCK_MS", 1_500)
    got = frames.throttle(df, "device", "ms", "key")
    assert "collect_list" not in got._jdf.queryExecution().toString()
    assert sorted(map(repr, ((r.device, r.key) for r in got.collect()))) == sorted(map(repr, want))


def test_throttled_stream_over_batches(spark, tmp_path):
    schema = "device string, ms long, key long"
    for n, part in enumerate((MS[:3], MS[3:])):
        spark.createDataFrame([("a", t, t) for t in part], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = frames.throttle_stream(stream, "device", "ms", "key").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.ms for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 500, 1000]


def test_classified_stream(spark, tmp_path):
    schema = "device string, ms long, key long"
    spark.createDataFrame([("a", t, t) for t in MS], schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    frames.classify_stream(stream, lambda df: df.withColumn("label", F.lit("glass")), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    assert [(r.ms, r.label, r.batch_id) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(1001, "glass", 0)]


def test_throttle_blocks_are_much_longer_than_the_interval(spark, monkeypatch):
    """With the query's own interval: the few entries of a block are those of its first interval, and ways that meet are told once."""
    day = 24 * 3_600_000
    times = [t * day // 60 for t in range(600)]
    said = []
    monkeypatch.setattr(frames, "_ways", lambda ts, bound, interval, f=frames._ways: said.append(f(ts, bound, interval)) or said[-1])
    for block in (0, 16 * day):
        frames._ways(iter([t for t in times if block <= t < block + 16 * day]), block + day // 4, day // 4)
    assert all(len(until) <= 16 for until, _ in said)
    df = spark.createDataFrame([("hot", t, k) for k, t in enumerate(times)], "device string, ms long, key long")
    want, last = [], None
    for k, t in enumerate(times):
        if last is None or t - last >= day // 4:
            want, last = [*want, k], t
    assert sorted(r.key for r in frames.throttle(df, "device", "ms", "key", day // 4).collect()) == want
