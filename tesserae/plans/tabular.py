"""Queries on classes, splits, balancing, scaling, neighbours, metrics and policies, each with its SQL.

`documents` stands in for a tree of labelled images (dataset/<lang>/<doc_id>.JPG), `embeddings` for their vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.labels import code_of, is_image, l2_normalised, label_of, softmax, suffix_of
from tesserae.operators import balance, distribution, knn, metrics, policy, scaling, svm

QUERIES, SQL = {}, {}
K, SEED = 5, 42
LIMITS = {"en": 100, "fr": 50}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("label"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    endings = F.element_at(F.array(*(F.lit(x) for x in (".JPG", ".png", ".txt", ".tiff"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("dataset/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), endings).alias("path"))


_PATHS = "SELECT doc_id, 'dataset/' || lang || '/' || doc_id || (CASE doc_id % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.txt' ELSE '.tiff' END) AS path FROM documents"
_CLASSES = "SELECT lang AS label, count(*) AS n FROM documents GROUP BY 1"


@query(f"SELECT doc_id, path, split_part(path, '/', 2) AS label, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS suffix FROM ({_PATHS})")
def path_label(spark, sf_dir):
    return _paths(spark, sf_dir).select("doc_id", "path", label_of(F.col("path")).alias("label"), suffix_of(F.col("path")).alias("suffix"))


@query(f"SELECT doc_id, path FROM ({_PATHS}) WHERE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) IN ('.jpg','.jpeg','.png','.gif','.bmp','.tiff','.webp')")
def path_extension_filter(spark, sf_dir):
    return _paths(spark, sf_dir).where(is_image(F.col("path")))


@query(f"SELECT path FROM ({_PATHS}) ORDER BY lower(path), path")
def path_sorted(spark, sf_dir):
    return _paths(spark, sf_dir).select("path").orderBy(F.lower("path"), "path")


@query(_CLASSES)
def class_distribution(spark, sf_dir):
    return distribution.counts(_documents(spark, sf_dir))


@query(f"""SELECT count(*) AS classes, sum(n)::BIGINT AS n, min(n) AS smallest, max(n) AS largest, avg(n) AS mean, median(n) AS median,
trunc(avg(n))::BIGINT AS mean_int, trunc(median(n))::BIGINT AS median_int, max(n)::DOUBLE / min(n) AS imbalance FROM ({_CLASSES})""")
def class_distribution_stats(spark, sf_dir):
    return distribution.stats(class_distribution(spark, sf_dir))


@query(f"SELECT label, round(sum(n) OVER () / (count(*) OVER () * n::DOUBLE), 9) AS weight FROM ({_CLASSES})")
def class_weights_balanced(spark, sf_dir):
    return distribution.weights(class_distribution(spark, sf_dir)).select("label", F.round("weight", 9).alias("weight"))


_TARGETS = f"SELECT unnest(['min','max','mean','median']) AS target, unnest([min(n)::DOUBLE, max(n)::DOUBLE, avg(n), median(n)]) AS x FROM ({_CLASSES})"


@query(f"SELECT target, round_even(x, 0)::BIGINT AS rounded, trunc(x)::BIGINT AS truncated FROM ({_TARGETS})")
def class_target_counts(spark, sf_dir):
    return distribution.target_counts(class_distribution(spark, sf_dir))


def _split_sql(table: str, key: str, label: str) -> str:
    return f"""SELECT *, CASE WHEN row_number() OVER (PARTITION BY {label} ORDER BY md5('{SEED}-' || {key}), {key}) <= ceil(0.3::DOUBLE * count(*) OVER (PARTITION BY {label})) THEN 'val' ELSE 'train' END AS split FROM {table}"""


@query(f"SELECT doc_id, lang AS label, split FROM ({_split_sql('documents', 'doc_id', 'lang')})")
def stratified_split(spark, sf_dir):
    return balance.split(_documents(spark, sf_dir), "doc_id", seed=SEED).select("doc_id", "label", "split")


_PLAN = f"""SELECT t.target, c.label, c.n, greatest(1, rounded) AS target_n, least(c.n, greatest(1, rounded)) AS keep, greatest(1, rounded) - least(c.n, greatest(1, rounded)) AS aug_needed
FROM ({_CLASSES}) c, (SELECT target, round_even(x, 0)::BIGINT AS rounded FROM ({_TARGETS})) t"""


@query(_PLAN)
def balance_plan(spark, sf_dir):
    sizes = class_distribution(spark, sf_dir)
    plans = [balance.plan(sizes, t).withColumn("target", F.lit(t)) for t in distribution.TARGETS]
    out = plans[0]
    for p in plans[1:]:
        out = out.unionByName(p)
    return out


_RANKED = f"SELECT doc_id, lang AS label, row_number() OVER (PARTITION BY lang ORDER BY md5('{SEED}-' || doc_id), doc_id) AS rk FROM documents"
_SELECTED = f"SELECT r.doc_id, r.label FROM ({_RANKED}) r JOIN (SELECT * FROM ({_PLAN}) WHERE target = 'median') p USING (label) WHERE rk <= keep"


@query(_SELECTED)
def undersample_selected(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return balance.sample(docs, balance.plan(distribution.counts(docs)), "doc_id", seed=SEED).select("doc_id", "label")


@query(f"""WITH sel AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('{SEED}-' || doc_id), doc_id) AS rk, count(*) OVER (PARTITION BY label) AS m FROM ({_SELECTED})),
want AS (SELECT p.label, unnest(generate_series(1, aug_needed)) AS slot, m.m FROM (SELECT * FROM ({_PLAN}) WHERE target = 'median' AND aug_needed > 0) p JOIN (SELECT DISTINCT label, m FROM sel) m USING (label))
SELECT w.label, w.slot, s.doc_id FROM want w JOIN sel s ON s.label = w.label AND s.rk = ('0x' || substr(md5('{SEED}-' || w.label || '-' || w.slot), 1, 8))::BIGINT % w.m + 1""")
def oversample_slots(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    plan = balance.plan(distribution.counts(docs))
    return balance.slots(balance.sample(docs, plan, "doc_id", seed=SEED), plan, "doc_id", seed=SEED)


_PARTS = _split_sql("(SELECT doc_id, lang AS label FROM documents)", "doc_id", "label")


@query(f"""WITH p AS ({_PARTS}), c AS (SELECT label, count(*) AS n FROM p WHERE split = 'train' GROUP BY 1), t AS (SELECT greatest(1, round_even(median(n), 0)::BIGINT) AS target_n FROM c),
r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('{SEED}-' || doc_id), doc_id) AS rk FROM p WHERE split = 'train'), s AS (SELECT doc_id, label, rk, count(*) OVER (PARTITION BY label) AS m FROM r, t WHERE rk <= target_n),
w AS (SELECT label, unnest(generate_series(1, target_n - n)) AS slot FROM c, t WHERE n < target_n),
a AS (SELECT s.doc_id, w.label, w.slot FROM w JOIN s ON s.label = w.label AND s.rk = ('0x' || substr(md5('{SEED}-' || w.label || '-' || w.slot), 1, 8))::BIGINT % s.m + 1)
SELECT doc_id, label, 'val' AS split, FALSE AS is_augmented, 0::BIGINT AS slot FROM p WHERE split = 'val' UNION ALL SELECT doc_id, label, 'train', FALSE, 0 FROM s UNION ALL SELECT doc_id, label, 'train', TRUE, slot FROM a""")
def training_set(spark, sf_dir):
    """What a build works on: the validation part whole, the training part cut to the median class, and augmented samples of smaller classes."""
    parts = balance.split(_documents(spark, sf_dir), "doc_id", seed=SEED)
    return balance.training_set(parts, "doc_id", seed=SEED).withColumn("slot", F.coalesce("slot", F.lit(0)))


@query(f"SELECT doc_id, label FROM ({_RANKED}) WHERE (label = 'en' AND rk <= 100) OR (label = 'fr' AND rk <= 50) OR label NOT IN ('en', 'fr')")
def undersample_named(spark, sf_dir):
    return balance.undersample(_documents(spark, sf_dir), LIMITS, "doc_id", seed=SEED).select("doc_id", "label")


@query(f"""SELECT s.strategy, c.label, CASE WHEN s.strategy IN ('none', 'oversample_minority') THEN c.n ELSE least(c.n, (SELECT trunc(median(n))::BIGINT FROM ({_CLASSES}))) END AS n
FROM ({_CLASSES}) c, (SELECT unnest(['none', 'balance', 'oversample_minority', 'undersample_majority']) AS strategy) s""")
def resample_strategies(spark, sf_dir):
    docs, out = _documents(spark, sf_dir), None
    for s in balance.STRATEGIES:
        one = distribution.counts(balance.resample(docs, s, "doc_id", seed=SEED)).withColumn("strategy", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out


# --- vectors


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("features"))
    return balance.split(rows, "id", seed=SEED)


def _scaled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _vectors(spark, sf_dir)
    out = scaling.transform(rows, scaling.fit(rows.where("split = 'train'")))
    return out.where("split = 'train'"), out.where("split = 'val'")


_S = f"""s AS (SELECT vec_id AS id, label, v, split FROM ({_split_sql('(SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)', 'vec_id', 'label')})),
e AS (SELECT id, label, split, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM s),
sc AS (SELECT dim, avg(x) AS mean, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS scale FROM e WHERE split = 'train' GROUP BY dim)"""
_NN = f"""{_S}, z AS (SELECT id, label, split, list((x - mean) / scale ORDER BY dim) AS v FROM e JOIN sc USING (dim) GROUP BY id, label, split),
nn AS (SELECT * FROM (SELECT q.id AS query_id, t.id AS neighbour_id, t.label, list_distance(q.v, t.v) AS distance, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, t.v), t.id) AS rank
FROM z q, z t WHERE q.split = 'val' AND t.split = 'train') WHERE rank <= 46),
c AS (SELECT label, count(*) AS n FROM s WHERE split = 'train' GROUP BY 1), w AS (SELECT label, sum(n) OVER () / (count(*) OVER () * n::DOUBLE) AS weight FROM c)"""
_VOTE = """v AS (SELECT query_id, label, round(sum({w}), 9) AS w, min(rank) AS f FROM nn JOIN w USING (label) WHERE rank <= 5 GROUP BY 1, 2),
p AS (SELECT query_id, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, f) AS r FROM v) WHERE r = 1)"""
_PRED = f"{_NN}, {_VOTE.format(w='weight')}"
_PAIRS = f"{_PRED}, pr AS (SELECT z.label AS actual, p.predicted, count(*) AS n FROM p JOIN z ON z.id = p.query_id GROUP BY 1, 2)"


@query(f"WITH {_S} SELECT dim::INTEGER AS dim, round(mean, 9) AS mean, round(scale, 9) AS scale FROM sc")
def scaler_fit(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return scaling.fit(rows.where("split = 'train'")).select("dim", F.round("mean", 9).alias("mean"), F.round("scale", 9).alias("scale"))


@query(f"WITH {_S} SELECT id, dim::INTEGER AS dim, round((x - mean) / scale, 6) + 0.0 AS x FROM e JOIN sc USING (dim)")
def scaler_transform(spark, sf_dir):
    train, val = _scaled(spark, sf_dir)
    return train.union(val).select("id", F.posexplode("features").alias("dim", "x")).withColumn("x", F.round("x", 6) + F.lit(0.0))


@query("""SELECT vec_id AS id, (generate_subscripts(embedding, 1) - 1)::INTEGER AS dim, round(unnest(embedding::DOUBLE[]) / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) + 0.0 AS x FROM embeddings""")
def l2_normalize(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), F.posexplode(l2_normalised(F.col("embedding"))).alias("dim", "x")).withColumn("x", F.round("x", 6) + F.lit(0.0))


def _near(spark, sf_dir, k: int = K) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Neighbours of the held-out rows, class weights, and actual labels."""
    train, val = _scaled(spark, sf_dir)
    weights = distribution.weights(distribution.counts(train))
    return knn.neighbours(train, val, k), weights, val.select(F.col("id").alias("query_id"), F.col("label").alias("actual"))


@query(f"WITH {_NN} SELECT query_id, rank::INTEGER AS rank, neighbour_id, label, round(distance, 6) AS distance FROM nn WHERE rank <= {K}")
def knn_topk(spark, sf_dir):
    return _near(spark, sf_dir)[0].withColumn("distance", F.round("distance", 6))


@query(f"WITH {_PRED} SELECT * FROM p")
def knn_predict_weighted(spark, sf_dir):
    near, weights, _ = _near(spark, sf_dir)
    return knn.vote(near, weights)


@query(f"WITH {_NN}, {_VOTE.format(w='weight / (distance + 1e-10)')} SELECT * FROM p")
def knn_predict_distance_weighted(spark, sf_dir):
    near, weights, _ = _near(spark, sf_dir)
    return knn.vote(near, weights, by_distance=True)


@query(f"WITH {_NN} SELECT z.id AS query_id, c.label, coalesce(k, 0) / {K}.0::DOUBLE AS probability FROM z, c LEFT JOIN (SELECT query_id, label, count(*) AS k FROM nn WHERE rank <= {K} GROUP BY 1, 2) x ON x.query_id = z.id AND x.label = c.label WHERE z.split = 'val'")
def knn_proba(spark, sf_dir):
    near, weights, _ = _near(spark, sf_dir)
    return knn.probabilities(near, weights)


_SWEEP = f"""{_NN}, ks AS (SELECT unnest(range(1, 47, 5)) AS k), v AS (SELECT k, query_id, label, round(sum(weight), 9) AS w, min(rank) AS f FROM nn JOIN w USING (label), ks WHERE rank <= k GROUP BY 1, 2, 3),
p AS (SELECT k, query_id, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY k, query_id ORDER BY w DESC, f) AS r FROM v) WHERE r = 1),
sw AS (SELECT k::INTEGER AS k, avg((p.predicted = z.label)::INTEGER::DOUBLE) AS accuracy FROM p JOIN z ON z.id = p.query_id GROUP BY 1)"""


@query(f"WITH {_SWEEP} SELECT k, round(accuracy, 9) AS accuracy, round(accuracy * 100, 6) AS accuracy_percent FROM sw")
def knn_sweep(spark, sf_dir):
    return knn.sweep(*_near(spark, sf_dir, max(knn.SWEEP))).select("k", F.round("accuracy", 9).alias("accuracy"), F.round("accuracy_percent", 6).alias("accuracy_percent"))


@query(f"WITH {_SWEEP} SELECT k, round(accuracy, 9) AS accuracy FROM sw ORDER BY sw.accuracy DESC, k LIMIT 1")
def knn_best(spark, sf_dir):
    return knn.best(knn.sweep(*_near(spark, sf_dir, max(knn.SWEEP)))).select("k", F.round("accuracy", 9).alias("accuracy"))


def _pairs(spark, sf_dir) -> DataFrame:
    near, weights, actual = _near(spark, sf_dir)
    return metrics.pair_counts(knn.vote(near, weights).join(actual, "query_id"))


@query(f"WITH {_PAIRS}, l AS (SELECT DISTINCT actual FROM pr) SELECT a.actual, b.actual AS predicted, coalesce(n, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN pr ON pr.actual = a.actual AND pr.predicted = b.actual")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(_pairs(spark, sf_dir))


_PER = f"""{_PAIRS}, la AS (SELECT actual AS label, sum(n) AS support, sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS tp FROM pr GROUP BY 1), lp AS (SELECT predicted AS label, sum(n) AS called FROM pr GROUP BY 1),
b AS (SELECT label, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(called, 0) AS called FROM la FULL JOIN lp USING (label)),
per AS (SELECT label, CASE WHEN called = 0 THEN 0 ELSE tp / called::DOUBLE END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / support::DOUBLE END AS recall, 2 * tp / (called + support)::DOUBLE AS f1, support FROM b)"""


@query(f"WITH {_PER} SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, round(recall, 9) AS accuracy, support::BIGINT AS support FROM per WHERE support > 0")
def per_class_metrics(spark, sf_dir):
    return metrics.per_class(_pairs(spark, sf_dir)).select("label", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "accuracy")), "support")


@query(f"""WITH {_PER} SELECT round(sum(recall * support) / sum(support), 9) AS accuracy, round(100 * sum(recall * support) / sum(support), 6) AS accuracy_percent,
round(avg(CASE WHEN support > 0 THEN recall END), 9) AS balanced_accuracy, round(100 * avg(CASE WHEN support > 0 THEN recall END), 6) AS balanced_accuracy_percent,
round(avg(precision), 9) AS precision_macro, round(avg(recall), 9) AS recall_macro, round(avg(f1), 9) AS f1_macro,
round(sum(precision * support) / sum(support), 9) AS precision_weighted, round(sum(recall * support) / sum(support), 9) AS recall_weighted, round(sum(f1 * support) / sum(support), 9) AS f1_weighted,
sum(support)::BIGINT AS validation_samples FROM per""")
def overall_metrics(spark, sf_dir):
    out = metrics.overall(_pairs(spark, sf_dir))
    return out.select(*(F.round(c, 6 if c.endswith("percent") else 9).alias(c) for c in out.columns if c != "validation_samples"), "validation_samples")


@query(f"WITH {_PER} SELECT label, round(f1, 9) AS f1, support::BIGINT AS support FROM per WHERE support > 0 AND f1 < 0.5")
def underperforming(spark, sf_dir):
    return metrics.underperforming(_pairs(spark, sf_dir)).select("label", F.round("f1", 9).alias("f1"), "support")


# --- policies

#: Distances of unscaled unit vectors from their nearest neighbours lie about 1.1, where the production limit of 0.8 would call all unknown.
LIMIT = 1.1
_RAW = f"""{_S}, nn AS (SELECT * FROM (SELECT q.id AS query_id, t.label, list_distance(q.v, t.v) AS distance, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, t.v), t.id) AS rank FROM s q, s t WHERE q.split = 'val' AND t.split = 'train') WHERE rank = 1)"""


def _first(spark, sf_dir) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return knn.neighbours(rows.where("split = 'train'"), rows.where("split = 'val'"), 1)


@query(f"WITH {_RAW} SELECT query_id, CASE WHEN distance <= {LIMIT} THEN label::VARCHAR ELSE 'unknown' END AS predicted, CASE WHEN distance <= 0.8 THEN label::VARCHAR ELSE 'unknown' END AS predicted_default FROM nn")
def unknown_distance_threshold(spark, sf_dir):
    label, d = F.col("label"), F.col("distance")
    return _first(spark, sf_dir).select("query_id", policy.by_distance(label, d, LIMIT)[0].alias("predicted"), policy.by_distance(label, d)[0].alias("predicted_default"))


@query(f"WITH {_RAW} SELECT query_id, CASE WHEN distance <= {LIMIT} THEN round(greatest(0, 1 - distance / {LIMIT}::DOUBLE), 9) ELSE 0 END AS confidence FROM nn")
def nn_confidence(spark, sf_dir):
    return _first(spark, sf_dir).select("query_id", F.round(policy.by_distance(F.col("label"), F.col("distance"), LIMIT)[1], 9).alias("confidence"))


@query(f"""WITH {_PRED}, m AS (SELECT query_id, max(k) / {K}.0::DOUBLE AS top FROM (SELECT query_id, label, count(*) AS k FROM nn WHERE rank <= {K} GROUP BY 1, 2) GROUP BY 1)
SELECT query_id, CASE WHEN top >= 0.4 THEN predicted::VARCHAR ELSE 'unknown' END AS predicted, CASE WHEN top >= 0.4 THEN top ELSE 0 END AS confidence FROM p JOIN m USING (query_id)""")
def unknown_proba_threshold(spark, sf_dir):
    near, weights, _ = _near(spark, sf_dir)
    top = knn.probabilities(near).groupBy("query_id").agg(F.max("probability").alias("top"))
    label, sure = policy.by_probability(F.col("predicted"), F.col("top"), 0.4)
    return knn.vote(near, weights).join(top, "query_id").select("query_id", label.alias("predicted"), sure.alias("confidence"))


@query("""WITH t AS (SELECT vec_id, list_transform(embedding[1:4]::DOUBLE[], lambda x: 10 * x) AS s FROM embeddings), x AS (SELECT vec_id, list_transform(s, lambda y: exp(y - list_max(s))) AS e FROM t)
SELECT vec_id, round(list_max(e) / list_sum(e), 9) AS top, CASE WHEN list_max(e) / list_sum(e) >= 0.6 THEN round(list_max(e) / list_sum(e), 9) ELSE 0 END AS confidence FROM x""")
def softmax_confidence(spark, sf_dir):
    scores = F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 4), lambda x: x * 10)
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", scores.alias("s"))
    return rows.select("vec_id", F.round(F.array_max(softmax(F.col("s"))), 9).alias("top"), F.round(policy.by_scores(F.lit("x"), F.col("s"))[1], 9).alias("confidence"))


_NAMES = ("Glass", "paper", "CARDBOARD", "plastic", "metal", "trash", "unknown", "wood")


@query(f"SELECT vec_id, CASE lower(m) WHEN 'glass' THEN 0 WHEN 'paper' THEN 1 WHEN 'cardboard' THEN 2 WHEN 'plastic' THEN 3 WHEN 'metal' THEN 4 WHEN 'trash' THEN 5 ELSE 6 END AS code FROM (SELECT vec_id, {list(_NAMES)}[label % 8 + 1] AS m FROM embeddings)")
def label_code(spark, sf_dir):
    name = F.element_at(F.array(*(F.lit(x) for x in _NAMES)), F.col("label") % 8 + 1)
    return _table(spark, sf_dir, "embeddings").select("vec_id", code_of(name).alias("code"))


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 128 AS batch FROM documents")
def batch_number(spark, sf_dir):
    from tesserae.operators.ordering import numbered

    return numbered(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", F.floor(F.col("nth") / 128).alias("batch"))


_GRID = """SELECT row_number() OVER (ORDER BY a, b, d)::INTEGER AS combo, c, gamma, kernel FROM
(SELECT unnest([0.1, 1, 10, 100]::DOUBLE[]) AS c, generate_subscripts([1, 2, 3, 4], 1) AS a), (SELECT unnest(['scale', 'auto', '0.001', '0.01', '0.1', '1']) AS gamma, generate_subscripts([1, 2, 3, 4, 5, 6], 1) AS b), (SELECT unnest(['rbf', 'linear', 'poly']) AS kernel, generate_subscripts([1, 2, 3], 1) AS d)"""


@query(f"""WITH v AS (SELECT unnest(embedding::DOUBLE[]) AS x, len(embedding) AS d FROM embeddings), s AS (SELECT max(d) AS d, var_pop(x) AS var FROM v)
SELECT g.*, round(CASE gamma WHEN 'scale' THEN 1 / (d * var) WHEN 'auto' THEN 1 / d::DOUBLE ELSE try_cast(gamma AS DOUBLE) END, 9) AS value FROM ({_GRID}) g, s WHERE NOT (kernel = 'linear' AND gamma <> 'scale')""")
def svm_grid(spark, sf_dir):
    """The points of the grid, with the number that each gamma stands for on the table's vectors."""
    rows = _table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("features"))
    return svm.with_gammas(svm.grid(spark), rows).withColumn("value", F.round("value", 9))
