"""Queries on requests, predictions, stored tables and streams, each with its SQL, and the way from requests with images to answers."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.blocks import DEFAULT
from tesserae.operators import distribution, features, knn, metrics, pairwise, policy, svm
from tesserae.plans import images as image_plans
from tesserae.plans import pipeline, tabular
from tesserae.sources import images, store
from tesserae.sources.scratch import delete_later, keep, shared_dir
from tesserae.streaming import frames, newest, requests

QUERIES, SQL = {}, {}
_SPLIT = f"s AS (SELECT vec_id AS id, label, v, split FROM ({tabular._split_sql('(SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)', 'vec_id', 'label')}))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _new(spark: SparkSession, name: str) -> str:
    """A folder in the shared one, which goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    delete_later(spark)
    return path


# --- requests


def _asked(key: str, content: Column) -> list[Column]:
    """A JSON request by row: every fifth has no base64, every seventh names an unknown classifier."""
    bad = F.col(key) % 5 == 0
    image = F.when(bad, F.lit("*")).otherwise(F.base64(content))
    kind = F.when(F.col(key) % 7 == 0, F.lit("tree")).when(F.col(key) % 2 == 0, F.lit("KNN")).otherwise(F.lit("svm"))
    return [F.col(key), F.to_json(F.struct(image.alias("image"), kind.alias("classifier"))).alias("value")]


_ERROR = "CASE WHEN {k} % 5 = 0 THEN 'image is not base64' WHEN {k} % 7 = 0 THEN 'classifier must be knn or svm' END"
_KIND = "CASE WHEN {k} % 7 = 0 THEN 'tree' WHEN {k} % 2 = 0 THEN 'knn' ELSE 'svm' END"


@query(f"SELECT doc_id, {_KIND.format(k='doc_id')} AS classifier, {_ERROR.format(k='doc_id')} AS error, CASE WHEN doc_id % 5 <> 0 THEN strlen(text) ELSE 0 END AS n_bytes, CASE WHEN doc_id % 5 <> 0 THEN md5(text) END AS digest FROM documents")
def request_parse(spark, sf_dir):
    """JSON requests to decoded content, classifier and error."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*_asked("doc_id", F.col("text").cast("binary")))
    out = images.requests(docs)
    return out.select("doc_id", "classifier", "error", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("n_bytes"), F.md5("content").alias("digest"))


def gray_of(content: Column, n: int) -> Column:
    """n gray values of as many bytes, from 0 to 1."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.conv(F.hex(F.substring(content, i, F.lit(1))), 16, 10).cast("double") / 255)


_GRAY = "list_transform(v, lambda x: least(greatest(floor((x + 0.5) * 256), 0), 255) / 255.0::DOUBLE)"
_NEAREST = f"""{_SPLIT}, g AS (SELECT id, label, split, {_GRAY} AS v FROM s),
nn AS (SELECT * FROM (SELECT q.id AS query_id, t.label, list_distance(q.v, t.v) AS distance, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, t.v), t.id) AS rank FROM g q, g t WHERE q.split = 'val' AND t.split = 'train') WHERE rank = 1)"""


@query(f"""WITH {_NEAREST} SELECT s.id, {_ERROR.format(k='s.id')} AS error, CASE WHEN s.id % 5 = 0 OR s.id % 7 = 0 THEN NULL WHEN distance <= 1.0 THEN nn.label::VARCHAR ELSE 'unknown' END AS class_name,
CASE WHEN s.id % 5 = 0 OR s.id % 7 = 0 THEN NULL WHEN distance <= 1.0 THEN round(1 - distance, 6) ELSE 0 END AS confidence FROM s JOIN nn ON nn.query_id = s.id WHERE s.split = 'val'""")
def request_answer(spark, sf_dir):
    """Requests with 64 gray bytes each: parsed, turned into vectors, and answered by the nearest training row; bad ones keep their place with the reason."""
    rows = tabular._vectors(spark, sf_dir)
    gray = F.transform("features", lambda x: F.least(F.greatest(F.floor((x + 0.5) * 256), F.lit(0)), F.lit(255)).cast("int"))
    held = rows.where("split = 'val'").withColumn("px", F.unhex(F.array_join(F.transform(gray, lambda x: F.lpad(F.hex(x), 2, "0")), "")))
    asked = images.requests(held.select(*_asked("id", F.col("px"))))
    known = rows.where("split = 'train'").select("id", "label", F.transform(gray, lambda x: x / 255.0).alias("features"))
    good = asked.where("error is null").select("id", gray_of(F.col("content"), 64).alias("features"))
    near = knn.neighbours(known, good, 1)
    label, sure = policy.by_distance(F.col("label"), F.col("distance"), 1.0)
    found = near.select(F.col("query_id").alias("id"), label.alias("class_name"), F.round(sure, 6).alias("confidence"))
    return asked.select("id", "error").join(found, "id", "left")


def _spool(folder: str):
    """Writes content to files named by md5, in tasks; gives key and path."""

    def run(batches):
        files, top, _ = images.opened(folder)
        files.create_dir(top, recursive=True)
        for b in batches:
            for name, content in zip(b.column("name").to_pylist(), b.column("content").to_pylist(), strict=True):
                with files.open_output_stream(f"{top}/{name}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([b.column("name")], ["name"])

    return run


def answer(asked: DataFrame, model: dict[str, DataFrame], machines: pipeline.Machines | None = None, key: str = "id", side: int = 256, k: int = 1, certainty: float = policy.CERTAINTY) -> DataFrame:
    """JSON requests (key, value) with encoded images to key, className, confidence, error, each by the classifier that it names.

    Contents are spooled by their digests (equal images once) into the shared folder, decoded by Spark's image source, turned into
    features, and classified as predict() or predict_svm() does. A request that fails keeps its place with null and the reason.
    """
    spark = asked.sparkSession
    folder = _new(spark, "spool")
    parsed = images.requests(asked).withColumn("name", F.concat(F.md5("content"), F.lit(".img")))
    good = parsed.where("error is null").groupBy("name").agg(F.first("content").alias("content"))
    written = good.mapInArrow(_spool(folder), "name string").count()
    if not written:
        return parsed.select(key, F.lit(None).cast("string").alias("className"), F.lit(None).cast("double").alias("confidence"), "error")
    pixels = images.images(spark, folder, keep_invalid=True).select(F.element_at(F.split("path", "/"), -1).alias("id"), "height", "width", "rgb")
    seen = keep(features.extract(pixels, DEFAULT, side))
    by = {"knn": pipeline.predict(seen, model, k, certainty), "svm": pipeline.predict_svm(seen, machines, certainty) if machines else seen.select("id", F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("confidence"), F.lit("no svm model").alias("error"))}
    said = [df.select(F.lit(kind).alias("classifier"), F.col("id").alias("name"), "label", F.col("confidence").alias("sure"), F.col("error").alias("failed")) for kind, df in by.items()]
    out = parsed.join(said[0].union(said[1]), ["name", "classifier"], "left")
    return out.select(key, F.when(F.col("error").isNull(), F.col("label")).alias("className"), F.when(F.col("error").isNull(), F.col("sure")).alias("confidence"), F.coalesce("error", "failed").alias("error"))


# --- predictions

_CODE = "CASE lower(l) WHEN 'glass' THEN 0 WHEN 'paper' THEN 1 WHEN 'cardboard' THEN 2 WHEN 'plastic' THEN 3 WHEN 'metal' THEN 4 WHEN 'trash' THEN 5 ELSE 6 END"


def _predicted(spark, sf_dir, k: int, **limits) -> DataFrame:
    """predict() over the held-out rows with class names for labels; every ninth row has no vector and says why."""
    rows = tabular._vectors(spark, sf_dir)
    name = F.element_at(F.array(*(F.lit(x) for x in tabular._NAMES)), F.col("label") % 8 + 1)
    train, val = rows.where("split = 'train'").withColumn("label", name), rows.where("split = 'val'")
    lost = F.col("id") % 9 == 0
    asked = val.select("id", F.when(~lost, F.col("features")).alias("features"), F.when(lost, F.lit("unreadable")).alias("error"))
    scaler = tabular.scaling.fit(train)
    model = {"knn_scaler": scaler, "knn": tabular.scaling.transform(train, scaler), "weights": distribution.weights(distribution.counts(train))}
    out = pipeline.predict(asked, model, k, **limits)
    return out.withColumns({"confidence": F.round("confidence", 6), "code": F.coalesce("code", F.lit(-1))})


_NAMED = f"""{tabular._S}, z AS (SELECT id, {list(tabular._NAMES)}[label % 8 + 1] AS label, split, list((x - mean) / scale ORDER BY dim) AS v FROM e JOIN sc USING (dim) GROUP BY id, label, split),
nn AS (SELECT * FROM (SELECT q.id AS query_id, t.id AS neighbour_id, t.label, list_distance(q.v, t.v) AS distance, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, t.v), t.id) AS rank
FROM z q, z t WHERE q.split = 'val' AND t.split = 'train' AND q.id % 9 <> 0) WHERE rank <= 5),
c AS (SELECT label, count(*) AS n FROM z WHERE split = 'train' GROUP BY 1), w AS (SELECT label, sum(n) OVER () / (count(*) OVER () * n::DOUBLE) AS weight FROM c)"""


@query(f"""WITH {_NAMED}, p AS (SELECT query_id, CASE WHEN distance <= 9.5 THEN label ELSE 'unknown' END AS l, CASE WHEN distance <= 9.5 THEN round(1 - distance / 9.5::DOUBLE, 6) ELSE 0 END AS confidence FROM nn WHERE rank = 1)
SELECT z.id, l AS label, CASE WHEN l IS NOT NULL THEN {_CODE} ELSE -1 END AS code, confidence, CASE WHEN z.id % 9 = 0 THEN 'unreadable' END AS error FROM z LEFT JOIN p ON p.query_id = z.id WHERE z.split = 'val'""")
def predict_nearest(spark, sf_dir):
    return _predicted(spark, sf_dir, 1, distance=9.5)


@query(f"""WITH {_NAMED}, v AS (SELECT query_id, label, round(sum(weight), 9) AS w, min(rank) AS f, count(*) AS k FROM nn JOIN w USING (label) GROUP BY 1, 2),
p AS (SELECT query_id, CASE WHEN top >= 0.4 THEN label ELSE 'unknown' END AS l, CASE WHEN top >= 0.4 THEN round(top, 6) ELSE 0 END AS confidence FROM (SELECT *, max(k) OVER (PARTITION BY query_id) / 5.0::DOUBLE AS top, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, f) AS r FROM v) WHERE r = 1)
SELECT z.id, l AS label, CASE WHEN l IS NOT NULL THEN {_CODE} ELSE -1 END AS code, confidence, CASE WHEN z.id % 9 = 0 THEN 'unreadable' END AS error FROM z LEFT JOIN p ON p.query_id = z.id WHERE z.split = 'val'""")
def predict_votes(spark, sf_dir):
    return _predicted(spark, sf_dir, 5, certainty=0.4)


@query(f"""WITH {tabular._NN} SELECT query_id, label, k / {tabular.K}.0::DOUBLE AS probability, row_number() OVER (PARTITION BY query_id ORDER BY k DESC, label)::INTEGER AS place FROM (SELECT query_id, label, count(*) AS k FROM nn WHERE rank <= {tabular.K} GROUP BY 1, 2)""")
def proba_ranked(spark, sf_dir):
    """Classes of each held-out row by falling probability."""
    return knn.ranked(knn.probabilities(tabular._near(spark, sf_dir)[0]))


@query("SELECT label, n, row_number() OVER (ORDER BY n DESC, label)::INTEGER AS place FROM (SELECT lang AS label, count(*) AS n FROM documents GROUP BY 1)")
def classes_by_size(spark, sf_dir):
    return distribution.by_size(tabular.class_distribution(spark, sf_dir))


@query(f"SELECT path FROM ({tabular._PATHS}) ORDER BY lower(path), path LIMIT 25")
def first_paths(spark, sf_dir):
    """The first 25 paths; the limit is the feature."""
    return tabular._paths(spark, sf_dir).select("path").orderBy(F.lower("path"), "path").limit(25)


# --- stored tables


@query(f"WITH {tabular._PER} SELECT round(sum(recall * support) / sum(support), 9) AS accuracy, sum(support)::BIGINT AS validation_samples, count(*) FILTER (support > 0) AS classes, (count(*) FILTER (support > 0)) ** 2 AS cells, '5' AS k, round(sum(CASE WHEN support > 0 THEN f1 END), 6) AS f1_sum FROM per")
def metrics_document(spark, sf_dir):
    """The JSON of all metrics, read back."""
    told = metrics.document(tabular._pairs(spark, sf_dir), {"n_neighbors": str(tabular.K)})
    shape = "overall struct<accuracy:double,validation_samples:bigint>, per_class array<struct<label:bigint,f1:double>>, confusion array<struct<n:bigint>>, parameters map<string,string>"
    m = told.select(F.from_json("metrics", shape).alias("m")).select("m.*")
    return m.select(
        F.round("overall.accuracy", 9).alias("accuracy"), F.col("overall.validation_samples").alias("validation_samples"), F.size("per_class").cast("long").alias("classes"), F.size("confusion").cast("double").alias("cells"),
        F.col("parameters")["n_neighbors"].alias("k"), F.round(F.aggregate("per_class", F.lit(0.0), lambda s, x: s + x["f1"]), 6).alias("f1_sum"),
    )


@query(f"WITH {_SPLIT} SELECT id, label, round(list_sum(v), 6) AS total FROM s WHERE split = 'val'")
def feature_store(spark, sf_dir):
    """Vectors written by split, and one split read back."""
    path = _new(spark, "features")
    store.write_features(tabular._vectors(spark, sf_dir), path)
    held = store.read_features(spark, path, "val")
    return held.select("id", "label", F.round(F.aggregate("features", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"WITH {tabular._SWEEP}, r AS (SELECT k, accuracy FROM sw WHERE k IN (1, 6, 11)) SELECT 'knn-' || k AS run_id, 'knn' AS kind, round(accuracy, 9) AS accuracy, accuracy = max(accuracy) OVER () AND k = min(k) OVER (PARTITION BY accuracy) AS best FROM r")
def run_registry(spark, sf_dir):
    """Three runs saved with their metrics, and which of them is the best (of equal ones the first saved)."""
    swept = knn.sweep(*tabular._near(spark, sf_dir, 11), ks=(1, 6, 11))
    runs = store.Runs(spark, _new(spark, "runs"))
    for r in sorted(swept.collect(), key=lambda r: r["k"]):
        runs.save("knn", {"sweep": swept.where(F.col("k") == r["k"])}, {"k": r["k"]}, {"accuracy": r["accuracy"]}, run_id=f"knn-{r['k']}")
    accuracy = F.round(F.get_json_object("metrics", "$.accuracy").cast("double"), 9)
    return runs.runs().select("run_id", "kind", accuracy.alias("accuracy"), (F.col("run_id") == runs.best("knn")).alias("best"))


@query(f"WITH {tabular._SWEEP} SELECT run_id, sw.k, round(accuracy, 9) AS accuracy FROM sw, (SELECT unnest(['first', 'second']) AS run_id) WHERE k <= 11")
def sweep_log(spark, sf_dir):
    """Two sweeps appended to one log, read back."""
    path = _new(spark, "log")
    swept = keep(knn.sweep(*tabular._near(spark, sf_dir, 11), ks=(1, 6, 11)))
    for run_id in ("first", "second"):
        store.log_sweep(swept, path, run_id)
    return spark.read.schema("k int, accuracy double, accuracy_percent double, run_id string").parquet(path).select("run_id", "k", F.round("accuracy", 9).alias("accuracy"))


@query(f"""WITH {tabular._S}, d AS (SELECT count(*) AS dims, round(sum(mean), 6) AS total FROM sc), l AS (SELECT * FROM (VALUES ('both', 'knn', 'knn_scaler'), ('machines', 'svm', 'svm_scaler'), ('old', 'svm', 'scaler')) v(run_id, kind, scaler))
SELECT run_id, kind, dims, round(total + CASE scaler WHEN 'knn_scaler' THEN 0 WHEN 'svm_scaler' THEN dims ELSE 2 * dims END, 6) AS total FROM l, d""")
def model_lookup(spark, sf_dir):
    """Of runs with several models and scalers, those that are preferred; told apart by what is added to the scalers' means."""
    rows = tabular._vectors(spark, sf_dir)
    fitted = keep(tabular.scaling.fit(rows.where("split = 'train'")))
    moved = lambda n: fitted.withColumn("mean", F.col("mean") + n)
    model = rows.where("split = 'train'").select("id", "label")
    runs = store.Runs(spark, _new(spark, "runs"))
    runs.save("knn", {"svm": model, "knn": model, "scaler": moved(2), "svm_scaler": moved(1), "knn_scaler": moved(0)}, run_id="both")
    runs.save("svm", {"svm": model, "scaler": moved(2), "svm_scaler": moved(1)}, run_id="machines")
    runs.save("svm", {"svm": model, "scaler": moved(2)}, run_id="old")
    found = [runs.scaler(r).agg(F.count("*").alias("dims"), F.round(F.sum("mean"), 6).alias("total")).select(F.lit(r).alias("run_id"), F.lit(runs.model(r)[0]).alias("kind"), "dims", "total") for r in ("both", "machines", "old")]
    return found[0].union(found[1]).union(found[2])


# --- streams


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def frame_latest(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return frames.latest(events, "user_id", "ms", "event_id").select("user_id", "event_id", "event_type")


@query(image_plans.SQL["frame_throttle"])
def stream_throttle(spark, sf_dir):
    """The events as a stream, throttled with a state by user, and what its sink holds."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    kept = frames.throttle_stream(events, "user_id", "ms", "event_id", image_plans.INTERVAL_MS)
    out, at = _new(spark, "kept"), _new(spark, "progress")
    kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id bigint, ms bigint, event_id bigint").parquet(out).select("event_id", "user_id")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_stream(spark, sf_dir):
    """The events as a stream of which only each user's newest goes on, with a state by user; the last that went on of each."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/events.parquet*").select("user_id", "event_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    out, at = _new(spark, "newest"), _new(spark, "progress")
    with newest.state_in_rocksdb(spark):
        rows = newest.newest_stream(events, "user_id", "ms", "event_id")
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return frames.latest(spark.read.schema(rows.schema).parquet(out), "user_id", "ms", "event_id").select("user_id", "event_id", "event_type")


def _by_nearest(asked: DataFrame, model: dict[str, DataFrame]) -> DataFrame:
    """Requests (id, value) with 64 gray bytes each, answered by the nearest of the model's rows."""
    parsed = images.requests(asked)
    good = parsed.where("error is null").select("id", gray_of(F.col("content"), 64).alias("features"))
    near = knn.neighbours(model["knn"], good, 1)
    label, sure = policy.by_distance(F.col("label"), F.col("distance"), 1.0)
    found = near.select(F.col("query_id").alias("id"), label.alias("class_name"), F.round(sure, 6).alias("confidence"))
    return parsed.select("id", "error").join(found, "id", "left")


@query(f"""WITH {_NEAREST} SELECT s.id, {_ERROR.format(k='s.id')} AS error, CASE WHEN s.id % 5 = 0 OR s.id % 7 = 0 THEN NULL WHEN distance <= 1.0 THEN nn.label::VARCHAR ELSE 'unknown' END AS class_name,
CASE WHEN s.id % 5 = 0 OR s.id % 7 = 0 THEN NULL WHEN distance <= 1.0 THEN round(1 - distance, 6) ELSE 0 END AS confidence, 'knn-1' AS run_id FROM s JOIN nn ON nn.query_id = s.id WHERE s.split = 'val'""")
def request_stream(spark, sf_dir):
    """As request_answer, from a stream of requests, with a model from the registry; answers and failures come from their tables."""
    rows = tabular._vectors(spark, sf_dir)
    gray = F.transform("features", lambda x: F.least(F.greatest(F.floor((x + 0.5) * 256), F.lit(0)), F.lit(255)).cast("int"))
    held = rows.where("split = 'val'").withColumn("px", F.unhex(F.array_join(F.transform(gray, lambda x: F.lpad(F.hex(x), 2, "0")), "")))
    spool, out = _new(spark, "asked"), _new(spark, "served")
    held.select(*_asked("id", F.col("px"))).write.parquet(spool)
    runs = store.Runs(spark, _new(spark, "runs"))
    runs.save("knn", {"knn": rows.where("split = 'train'").select("id", "label", F.transform(gray, lambda x: x / 255.0).alias("features"))}, run_id="knn-1")
    stream = spark.readStream.schema("id long, value string").parquet(spool)
    requests.Server(runs, "knn", ["knn"], _by_nearest, out).start(stream, f"{out}/progress").awaitTermination()
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{out}/{name}")
    good = read("answers", "id long, class_name string, confidence double, run_id string")
    bad = read("failures", "id long, value string, error string, run_id string")
    return good.select("id", F.lit(None).cast("string").alias("error"), "class_name", "confidence", "run_id").union(bad.select("id", "error", F.lit(None), F.lit(None), "run_id"))


# --- vectors and machines


@query("SELECT vec_id AS id, k::INTEGER AS k, round((least(greatest(v[k + 1] + 0.5, 0), 1) - [0.485, 0.456, 0.406][k % 3 + 1]) / [0.229, 0.224, 0.225][k % 3 + 1], 6) + 0.0 AS x FROM (SELECT vec_id, embedding::DOUBLE[] AS v, unnest(range(48)) AS k FROM embeddings)")
def imagenet_normalise(spark, sf_dir):
    """16 pixels in three colours, from 0 to 255, by the means and deviations of each colour."""
    px = F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 48), lambda x: F.least(F.greatest(x + 0.5, F.lit(0.0)), F.lit(1.0)) * 255)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.posexplode(features.imagenet_normalised(px)).alias("k", "x"))
    return rows.withColumn("x", F.round("x", 6) + F.lit(0.0))


@query()
def svm_search(spark, sf_dir):
    """All points of the grid, trained and compared on the held-out rows."""
    train, val = tabular._scaled(spark, sf_dir)
    marks = pairwise.landmarks(train, 256, "features")
    return svm.search(train, val, svm.grid(spark), distribution.weights(distribution.counts(train)), landmarks=marks)


@query()
def svm_search_blind(spark, sf_dir):
    """The same on maps drawn blind, to compare."""
    train, val = tabular._scaled(spark, sf_dir)
    return svm.search(train, val, svm.grid(spark), distribution.weights(distribution.counts(train)))


@query()
def svm_best(spark, sf_dir):
    return svm.best(svm_search(spark, sf_dir))


def _guessed(spark, sf_dir) -> DataFrame:
    """combo, actual, predicted, n: for each point of the grid, guesses of all labels that are right where a hash of id and point says so.

    A guess that is wrong is the label or, for every third point, class 0, so that the largest accuracy and the largest balanced one part.
    """
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("label").cast("long").alias("actual"))
    points = svm.grid(spark).select("combo")
    h = F.conv(F.substring(F.md5(F.concat_ws("-", "vec_id", "combo").cast("binary")), 1, 6), 16, 10).cast("long")
    wrong = F.when(F.col("combo") % 3 == 0, F.lit(0)).otherwise((F.col("actual") + 1 + h % 7) % 10)
    predicted = F.when(h % 100 < 40 + F.col("combo") % 30 + 20 * (F.col("actual") == 0).cast("int") * (F.col("combo") % 2), F.col("actual")).otherwise(wrong)
    return rows.join(F.broadcast(points)).select("combo", "actual", predicted.cast("long").alias("predicted")).groupBy("combo", "actual", "predicted").agg(F.count("*").alias("n"))


_COMPARED = f"""WITH g AS (SELECT combo FROM ({tabular._GRID}) WHERE NOT (kernel = 'linear' AND gamma <> 'scale')),
h AS (SELECT combo, label::BIGINT AS actual, ('0x' || substr(md5(vec_id || '-' || combo), 1, 6))::BIGINT AS h FROM embeddings, g),
p AS (SELECT combo, actual, CASE WHEN h % 100 < 40 + combo % 30 + 20 * (actual = 0)::INT * (combo % 2) THEN actual WHEN combo % 3 = 0 THEN 0 ELSE (actual + 1 + h % 7) % 10 END AS predicted FROM h),
a AS (SELECT combo, actual AS label, count(*) AS support, count(*) FILTER (actual = predicted) AS tp FROM p GROUP BY 1, 2), b AS (SELECT combo, predicted AS label, count(*) AS called FROM p GROUP BY 1, 2),
c AS (SELECT combo, label, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(called, 0) AS called FROM a FULL JOIN b USING (combo, label)),
m AS (SELECT combo, sum(tp) / sum(support)::DOUBLE AS accuracy, avg(tp / support::DOUBLE) FILTER (support > 0) AS balanced_accuracy, avg(2 * tp / (called + support)::DOUBLE) AS f1_macro, sum(2 * tp * support / (called + support)::DOUBLE) / sum(support) AS f1_weighted FROM c GROUP BY 1)"""
_ROUNDED = ", ".join(f"round({x}, 9) AS {x}" for x in svm.MEASURES)


@query(f"{_COMPARED} SELECT combo, {_ROUNDED} FROM m")
def grid_measures(spark, sf_dir):
    """What a search says of each point of the grid, for guesses over all labelled rows."""
    return svm.compared(_guessed(spark, sf_dir)).select("combo", *(F.round(x, 9).alias(x) for x in svm.MEASURES))


@query(f"{_COMPARED} SELECT combo, {_ROUNDED} FROM m ORDER BY m.balanced_accuracy DESC, combo LIMIT 1")
def grid_best(spark, sf_dir):
    """The point that a search would choose of the same."""
    return svm.best(svm.compared(_guessed(spark, sf_dir))).select("combo", *(F.round(x, 9).alias(x) for x in svm.MEASURES))


@query()
def svm_proba(spark, sf_dir):
    """id, label or `unknown`, code, confidence (coupled from the pairs' curves) by machines of all pairs of classes on a map through landmarks."""
    name = F.element_at(F.array(*(F.lit(x) for x in tabular._NAMES)), F.col("label") % 8 + 1)
    rows = tabular._vectors(spark, sf_dir).withColumn("label", name)
    held = rows.where("split = 'val'").select("id", "features", F.lit(None).cast("string").alias("error"))
    return pipeline.predict_svm(held, pipeline.train_svm(rows, cost=10.0), 0.2)
