"""Quality classifier: a generalised additive model with pairwise interactions.

score = sigmoid(intercept + sum of table_f[bin_f] + sum of table_fg[bin_f, bin_g]). Features come from the whole text alone.
Each is cut into quantile bins. Boosting goes round the features again and again: each time a shallow tree on one feature's
bins is fitted to the residuals and added, shrunk, to that feature's table; then the same is done for the few pairs of
features whose joint table explains most of what is left. Scoring looks bins up and adds.

The tables are fitted on the driver from the features of at most `sample` labelled documents (those with the smallest
hash of the key): 20 numbers a row, 8 MB at the default bound. Features and scores of all documents are computed in tasks.

Defined cases: a null text counts as empty; an empty text (one empty line without words) is scored like any other; repeated rows are scored
alike, and each counts in training; an empty table gives an empty one; a very long text is a slice of its own; of labelled rows with
equal hashes the smaller key, then the smaller label goes first; a document with several labels counts once for each; null labels
are left out; without labels of both kinds every score is the share of label 1 (0.5 if there are none); a null key counts as held
out; columns other than key and text are not read, and accept() passes them through.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import text as T
from tesserae.llm.common import fold, keep

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "symbol", "exclaim", "pipe", "stop_comma", "high", "space",
    "distinct_words", "repeat_next", "short_words", "log_lines", "line_words", "distinct_lines", "upper_words", "mark_ends", "longest_word",
)
#: Bytes of text whose features are made at once.
SLICE = 1 << 20
_CLASSES = ("upper", "digit", "symbol", "exclaim", "pipe", "stop_comma", "high", "space")


def _class_of_byte() -> np.ndarray:
    out = np.full(256, 255, np.uint8)
    for name, chars in (("upper", bytes(range(65, 91))), ("digit", bytes(range(48, 58))), ("symbol", b"#$%&*@^~_=+<>{}[]\\/"), ("exclaim", b"!?"), ("pipe", b"|"), ("stop_comma", b".,;:"), ("high", bytes(range(128, 256))), ("space", b" \t\n\r\x0b\x0c")):
        out[list(chars)] = _CLASSES.index(name)
    return out


CLASS_OF_BYTE = _class_of_byte()


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    texts = T.plain(texts)
    n, f = len(texts), {}
    raw, at = T.data(texts)
    size = np.diff(at)
    by = np.maximum(size, 1)
    kind = CLASS_OF_BYTE[raw]
    for k, name in enumerate(_CLASSES):
        where = np.flatnonzero(kind == k)
        f[name] = np.diff(np.searchsorted(where, at)) / by
    flat, count = T.words(texts)
    code, distinct = T.codes(flat)
    doc = np.repeat(np.arange(n), count)
    some = np.maximum(count, 1)
    length = pc.binary_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    word_bytes = length[code] if len(distinct) else np.zeros(0, np.int64)
    f["log_bytes"], f["log_words"] = np.log1p(size), np.log1p(count)
    f["word_bytes"] = T.sums(word_bytes, count) / some
    f["short_words"] = T.sums((word_bytes <= 3).astype(np.int64), count) / some
    f["longest_word"] = np.log1p(np.maximum.reduceat(np.append(word_bytes, 0), np.minimum(np.cumsum(count) - count, len(word_bytes))) * (count > 0))
    pairs = np.unique(doc * max(len(distinct), 1) + code)
    f["distinct_words"] = np.bincount(pairs // max(len(distinct), 1), minlength=n)[:n] / some
    again = np.flatnonzero((code[1:] == code[:-1]) & (doc[1:] == doc[:-1]))
    f["repeat_next"] = np.bincount(doc[1:][again], minlength=n)[:n] / some
    space = kind == _CLASSES.index("space")
    first = np.append(True, space[:-1]) if len(space) else space
    first[at[:-1][size > 0]] = True
    upper_first = np.flatnonzero((kind == _CLASSES.index("upper")) & first)
    f["upper_words"] = np.diff(np.searchsorted(upper_first, at)) / some
    last = np.append(space[1:], True) if len(space) else space
    last[at[1:][size > 0] - 1] = True
    mark_last = np.flatnonzero(((kind == _CLASSES.index("symbol")) | (kind == _CLASSES.index("exclaim"))) & last)
    f["mark_ends"] = np.diff(np.searchsorted(mark_last, at)) / some
    lines = pc.split_pattern(texts, "\n")
    per = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    line, kinds = T.codes(lines.flatten())
    pairs = np.unique(np.repeat(np.arange(n), per) * max(len(kinds), 1) + line)
    f["log_lines"], f["line_words"] = np.log1p(per), np.log1p(count / np.maximum(per, 1))
    f["distinct_lines"] = np.bincount(pairs // max(len(kinds), 1), minlength=n)[:n] / np.maximum(per, 1)
    return np.stack([f[x] for x in FEATURES], axis=1).astype(np.float32) if n else np.zeros((0, len(FEATURES)), np.float32)


@dataclass(frozen=True)
class Additive:
    """edges: of each feature's bins; tables: of features; pairs: (f, g, cell edges of f and g as bin numbers, table)."""

    intercept: float
    edges: tuple[np.ndarray, ...]
    tables: tuple[np.ndarray, ...]
    pairs: tuple[tuple[int, int, np.ndarray, np.ndarray, np.ndarray], ...]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.intercept)
        for f, t in enumerate(self.tables):
            z += t[b[:, f]]
        for f, g, ef, eg, t in self.pairs:
            z += t[np.searchsorted(ef, b[:, f], side="right"), np.searchsorted(eg, b[:, g], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """A step function over bins: the best cuts of the Newton gain, one after the other."""
    gs, hs = np.append(0, np.cumsum(grad)), np.append(0, np.cumsum(hess))
    worth = lambda a, b: (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + ridge)
    cuts = [0, len(grad)]
    for _ in range(leaves - 1):
        best, at = 1e-9, 0
        for a, b in zip(cuts, cuts[1:], strict=False):
            k = np.arange(a + 1, b)
            if len(k):
                gain = worth(a, k) + worth(k, b) - worth(a, b)
                if gain.max() > best:
                    best, at = gain.max(), int(k[gain.argmax()])
        if not at:
            break
        cuts = sorted([*cuts, at])
    out = np.empty(len(grad))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + ridge)
    return out


def _pair_tree(grad: np.ndarray, hess: np.ndarray, ridge: float) -> np.ndarray:
    """A depth-two tree over a grid: the best cut of one axis, then the best cut of the other on each side."""

    def side(axis: int) -> tuple[float, np.ndarray]:
        g, h = (grad, hess) if axis == 0 else (grad.T, hess.T)
        best, out = -1.0, np.zeros_like(g)
        for k in range(1, g.shape[0]):
            now = np.empty_like(g)
            for part in (slice(0, k), slice(k, None)):
                now[part] = _tree(g[part].sum(0), h[part].sum(0), 2, ridge)
            gain = float((2 * g * now - h * now**2).sum())
            if gain > best:
                best, out = gain, now
        return best, (out if axis == 0 else out.T)

    return max((side(0), side(1)), key=lambda x: x[0])[1]


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.15, leaves: int = 4, max_bins: int = 48, n_pairs: int = 6, pair_rounds: int = 40, cells: int = 8, ridge: float = 5.0) -> Additive:
    """Cyclic boosting over features, then over the n_pairs pairs whose tables reduce the loss most."""
    none = tuple(np.zeros(0, np.float32) for _ in FEATURES), tuple(np.zeros(1) for _ in FEATURES)
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        return Additive(float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6)))), *none, ())
    edges = tuple(np.unique(np.quantile(x[:, f], np.linspace(0, 1, max_bins + 1)[1:-1])).astype(np.float32) for f in range(x.shape[1]))
    start = float(np.log(share / (1 - share)))
    model = Additive(start, edges, tuple(np.zeros(len(e) + 1) for e in edges), ())
    bins = model.bins(x)
    z = np.full(len(y), start)
    for _ in range(rounds):
        for f, t in enumerate(model.tables):
            p = 1 / (1 + np.exp(-z))
            b = bins[:, f]
            step = rate * _tree(np.bincount(b, y - p, len(t)), np.bincount(b, p * (1 - p), len(t)), leaves, ridge)
            t += step
            z += step[b]
    p = 1 / (1 + np.exp(-z))
    cut = [np.unique(np.linspace(0, len(t), cells + 1)[1:-1].astype(int)) for t in model.tables]
    cell = [np.searchsorted(c, bins[:, f], side="right") for f, c in enumerate(cut)]
    wide = cells + 1

    def grid(f: int, g: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(cell[f] * wide + cell[g], v, wide * wide).reshape(wide, wide)

    def gain(pair: tuple[int, int]) -> float:
        return float((grid(*pair, y - p) ** 2 / (grid(*pair, p * (1 - p)) + ridge)).sum())

    best = sorted(combinations(range(x.shape[1]), 2), key=gain, reverse=True)[:n_pairs]
    tables = {pair: np.zeros((wide, wide)) for pair in best}
    for _ in range(pair_rounds):
        for pair, t in tables.items():
            p = 1 / (1 + np.exp(-z))
            step = rate * _pair_tree(grid(*pair, y - p), grid(*pair, p * (1 - p)), ridge)
            t += step
            z += step[cell[pair[0]], cell[pair[1]]]
    return Additive(start, edges, model.tables, tuple((f, g, cut[f], cut[g], t) for (f, g), t in tables.items()))


def with_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and x, the features of the whole text."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in T.slices(batches, "text", SLICE):
            x = features(b.column("text"))
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column("key"), values], ["key", "x"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, x array<float>")


def _chosen(keys: DataFrame, labels: DataFrame, label: str, key: str, sample: int) -> DataFrame:
    """key and y of the labelled rows that are learned from. keys: the column key, one row for each document."""
    known = labels.select(F.col(key).alias("key"), F.col(label).alias("y")).where("key is not null and y in (0, 1)")
    return keys.join(known, "key").orderBy(F.xxhash64("key"), "key", "y").limit(sample)


def train(rows: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", sample: int = 40_000, **params) -> Additive:
    """Fits the tables to the labelled rows (key, x); more than `sample` of them: those with the smallest hashes."""
    some = _chosen(rows, labels, label, key, sample).toArrow()
    x = np.stack(some.column("x").to_numpy()).astype(np.float32) if some.num_rows else np.zeros((0, len(FEATURES)), np.float32)
    return fit(x, some.column("y").to_numpy().astype(float), **params)


def scored(rows: DataFrame, model: Additive) -> DataFrame:
    """Adds `score` to rows that have x."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = [c for c in rows.columns if c != "x"]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names) + ", score double"

    def run(batches):
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(shared.value.score(x))], [*names, "score"])

    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; labels of the held-out fold 0 are not learned from."""
    rows = keep(with_features(docs).withColumn("held_out", F.coalesce(fold("key", folds) == 0, F.lit(True))))
    model = train(rows.where(~F.col("held_out")), labels)
    out = scored(rows, model)
    return out.select(F.col("key").alias("doc_id"), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3, sample: int = 40_000) -> DataFrame:
    """The documents whose score is at least the threshold, with all columns; learned from as in classify()."""
    own = docs.select(F.col("doc_id").alias("key"), F.col("text").alias("text")).where(F.coalesce(fold("doc_id", folds) != 0, F.lit(False)))
    # at most `sample` keys go to the tasks, so that features are made for the rows learned from alone
    some = keep(_chosen(own.select("key"), labels, "quality", "doc_id", sample).select("key").distinct())
    rows = with_features(own.join(F.broadcast(some), "key"), "key")
    shared = docs.sparkSession.sparkContext.broadcast(train(rows, labels, sample=sample))

    plain, text = [f"c{k}" for k in range(len(docs.columns))], f"c{docs.columns.index('text')}"  # whatever the columns' names are

    def run(batches):
        for b in T.slices(batches, text, SLICE):
            yield b.filter(pa.array(shared.value.score(features(b.column(text))) >= threshold))

    rows = docs.toDF(*plain)
    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
