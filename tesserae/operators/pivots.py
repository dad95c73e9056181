"""Exact nearest neighbours by pivots: cells with rings, bounds by the triangle inequality, and a second round where they leave a doubt.

1. Pivots come from a bounded sample of the training rows. Each row belongs to the cell of its nearest pivot and keeps its distance
   from it. Rows in the order of (cell, distance) are dealt into bundles of about BUNDLE rows; what a bundle has of a cell is a ring,
   of which the least and the largest distance from the pivot are known.
2. For a query q in the cell of pivot p, a row x of a ring [lo, hi] around pivot r has |q - x| >= |q - r| - hi, >= lo - |q - r|, and
   >= (|q - r|^2 - |q - p|^2) / (2 |p - r|). First each query sees the rings with the least bounds that hold k rows together, which
   gives a k-th distance; then all rings whose bound is not above it. So nothing is lost.
3. A task reads a bundle's rows, and behind them, as a stream, the queries that are sent to it: a training row is shuffled once, a
   query once for each bundle that it has to see. Only bundles that very many queries see are repeated, once for each MOST_QUERIES.

Broadcast are pivots (PIVOTS at most) and rings (MOST_BUNDLES + PIVOTS at most); beyond, bundles grow.

Defined cases: rows without a vector, and queries without one, take no part; equal distances go to the smaller id (null ids last); repeated rows are
rows of their own; fewer than k training rows give what there is; empty tables give no rows; all vectors must have one length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.sources.scratch import keep

#: Training rows of a bundle, and bundles at most.
BUNDLE, MOST_BUNDLES = 4096, 65_536
#: Pivots at most; the numbers of the sample that they come from, and its rows, at most.
PIVOTS, SAMPLE_NUMBERS, SAMPLE_ROWS = 4096, 1 << 22, 16_384
#: Queries that one copy of a bundle answers.
MOST_QUERIES = 65_536
#: Distances come from products, whose rounding is this share of the vectors' lengths at most.
ROUNDING = 1e-7
#: Pairs whose distances are worked out in one go.
PAIRS = 1 << 12
#: Numbers of a table that says which rings some queries see, or of what is sent on for them.
STEP = 1 << 18


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


def chosen(sample: np.ndarray, n: int, rounds: int = 4) -> np.ndarray:
    """n centres of the sample by a few rounds of k-means, different ones only, ordered along their widest direction."""
    centres = np.unique(sample[:: max(1, len(sample) // n)][:n], axis=0)
    for _ in range(rounds):
        near = _distances(sample, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        n_of = np.bincount(near, minlength=len(centres))
        centres = np.where(n_of[:, None] > 0, sums / np.maximum(n_of, 1)[:, None], centres)
    centres = np.unique(centres, axis=0)
    axis = np.linalg.svd(centres - centres.mean(0), full_matrices=False)[2][0]
    return centres[np.argsort(centres @ axis, kind="stable")]


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0))


class Rings:
    """Pivots and rings, and which rings a query has to see."""

    def __init__(self, pivots: np.ndarray, rings: list):
        self.pivots = pivots
        self.bundle, self.cell, self.n = (np.array([r[c] for r in rings], np.int64) for c in ("bundle", "cell", "n"))
        self.lo, self.hi = (np.array([r[c] for r in rings], float) for c in ("lo", "hi"))
        self.reach = np.sqrt((pivots * pivots).sum(1)).max(initial=0)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query and ring what no distance of a row in it is below."""
        d = _distances(q, self.pivots)
        own = d.argmin(1)
        to = d[:, self.cell]
        slack = ROUNDING * (np.sqrt((q * q).sum(1))[:, None] + self.reach)
        low = np.maximum(to - self.hi, self.lo - to)
        apart = _distances(self.pivots[own], self.pivots)[:, self.cell]
        side = np.where(apart > 1e4 * slack, (to * to - (d.min(1) ** 2)[:, None]) / np.maximum(2 * apart, 1e-300), -1.0)
        return np.maximum(np.maximum(low, side) - slack * 4, 0)

    def first(self, low: np.ndarray, k: int) -> np.ndarray:
        """The rings with the least bounds that hold k rows together."""
        order = np.argsort(low, axis=1, kind="stable")
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        out = np.zeros(low.shape, bool)
        np.put_along_axis(out, order, before < k, axis=1)
        return out


def _routes(rings: Rings, k: int, second: bool | None, salts: np.ndarray | None, counting: bool):
    """Queries (q, features, bound) to probes: bundle, salt, q, features, bound, rings. second None: all rings in one go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(int(rings.bundle.max(initial=0)) + 1, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            # a query is repeated for each bundle that it sees, so what a step holds does not grow with bundles and rings
            step = max(1, min(1024, STEP // max(len(rings.n), len(seen) * (len(batch.column("features")[0]) + 8))))
            for at in range(0, batch.num_rows, step):
                b = batch.slice(at, step)
                x, bound = _matrix(b.column("features")), b.column("bound").to_numpy()
                if second is None:
                    wanted = np.ones((len(x), len(rings.n)), bool)
                else:
                    low = rings.bounds(x)
                    wanted = low <= bound[:, None] if second else rings.first(low, k)
                who, which = np.nonzero(wanted)
                if not len(who):
                    continue
                cut = np.flatnonzero((np.diff(who) != 0) | (np.diff(rings.bundle[which]) != 0)) + 1  # rings are in the order of bundles
                start = np.concatenate([[0], cut])
                row, bundle = who[start], rings.bundle[which[start]]
                if counting:
                    seen += np.bincount(bundle, minlength=len(seen))
                    continue
                q = b.column("q").to_numpy()[row]
                salt = np.zeros(len(row), np.int32) if salts is None else (q % salts[bundle]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(which)).astype(np.int32)), pa.array(which.astype(np.int32)))
                pairs = np.add.reduceat(rings.n[which], start)
                columns = [pa.array(bundle.astype(np.int32)), pa.array(salt), pa.array(q), b.column("features").take(pa.array(row)), pa.array(bound[row]), lists, pa.array(pairs)]
                yield pa.RecordBatch.from_arrays(columns, ["bundle", "salt", "q", "features", "bound", "rings", "pairs"])
        if counting and seen.any():
            some = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some])], ["bundle", "n"])

    return run


class _Bundle:
    """The rows of a bundle, by ring, then by id."""

    def __init__(self, parts: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(parts).combine_chunks()
        self.id, self.label = (rows.column(c).combine_chunks() if rows.num_rows else rows.column(c) for c in ("id", "label"))
        self.x = _matrix(rows.column("features").combine_chunks())
        self.square = (self.x * self.x).sum(1)
        ring = rows.column("pos").to_numpy()
        at = np.flatnonzero(np.diff(ring)) + 1
        self.rings = {int(ring[a]): (a, b) for a, b in zip([0, *at.tolist()], [*at.tolist(), len(ring)], strict=True)}
        self.place = np.empty(len(ring), np.int64)
        self.place[pc.sort_indices(rows.column("id")).to_numpy()] = np.arange(len(ring))

    def nearest(self, q: np.ndarray, bound: np.ndarray, rings: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, distance) of each query's k nearest rows of its rings that are no further than its bound."""
        flat, who = rings.flatten().to_numpy(), np.repeat(np.arange(len(q)), rings.value_lengths().to_numpy())
        found, square = [], (q * q).sum(1)
        for ring in np.unique(flat).tolist():
            a, b = self.rings[ring]
            some = who[flat == ring]
            x, part = self.x[a:b], q[some]
            rough = square[some][:, None] + self.square[a:b] - 2 * part @ x.T
            m = min(k, b - a)
            limit = np.minimum(np.partition(rough, m - 1, axis=1)[:, m - 1], bound[some] ** 2)
            limit = limit + 1e-12 * (square[some] + self.square[a:b].max()) + 1e-300
            qs, xs = np.nonzero(rough <= limit[:, None])
            for s in range(0, len(qs), PAIRS):
                i, j = qs[s : s + PAIRS], xs[s : s + PAIRS]
                found.append((some[i], a + j, np.sqrt(((x[j] - part[i]) ** 2).sum(1))))
        qs, xs, d = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        good = d <= bound[qs] * (1 + 1e-12)
        qs, xs, d = qs[good], xs[good], d[good]
        order = np.lexsort((self.place[xs], d, qs))
        qs, xs, d = qs[order], xs[order], d[order]
        nth = np.arange(len(qs)) - np.searchsorted(qs, qs)
        return qs[nth < k], xs[nth < k], d[nth < k]


def _search(k: int):
    """Sorted rows of bundles, each followed by its queries, to q, neighbour_id, label, distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, bundle = None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("bundle", "salt", "kind")], 1)
            cut = [0, *(np.flatnonzero((np.diff(key, axis=0) != 0).any(1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cut, cut[1:], strict=False):
                (*group, kind), some = key[a].tolist(), batch.slice(a, b - a)
                if group != now:
                    now, parts, bundle = group, [], None
                if kind == 0:
                    parts.append(some)
                    continue
                bundle = bundle or _Bundle(parts)
                for at in range(0, some.num_rows, 256):
                    x = some.slice(at, 256)
                    q, row, d = bundle.nearest(_matrix(x.column("features")), x.column("bound").to_numpy(), x.column("rings"), k)
                    if len(q):
                        yield pa.RecordBatch.from_arrays([x.column("pos").take(pa.array(q)), bundle.id.take(pa.array(row)), bundle.label.take(pa.array(row)), pa.array(d)], ["q", "neighbour_id", "label", "distance"])

    return run


class Nearest:
    """The k nearest training rows of each query. `probes` are the queries sent to bundles, with the pairs that each compares."""

    def __init__(self, train: DataFrame, queries: DataFrame, k: int, key: str, label: str, vector: str):
        self.k, self.spark = k, train.sparkSession
        self.kinds = {"id": train.schema[key].dataType.simpleString(), "label": train.schema[label].dataType.simpleString(), "query_id": queries.schema[key].dataType.simpleString()}
        numbers = F.col(vector).cast("array<double>").alias("features")
        self.train = keep(train.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(label).alias("label"), numbers))
        self.queries = keep(queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("query_id"), numbers).withColumn("q", F.monotonically_increasing_id()))
        self.probes: list[DataFrame] = []

    def _bundled(self) -> DataFrame:
        """The training rows with bundle and ring (`cell` first), written once; and the rings."""
        n = self.train.count()
        first = self.train.select("features").first()
        dims = len(first[0]) if first else 1
        rows = min(SAMPLE_ROWS, max(1, SAMPLE_NUMBERS // max(dims, 1)))
        got = self.train.orderBy(F.xxhash64("id", "features"), "id").limit(rows).select("features").toArrow().column("features").combine_chunks()
        pivots = chosen(_matrix(got), min(PIVOTS, math.ceil(math.sqrt(n)))) if n else np.zeros((0, 1))
        shared = self.spark.sparkContext.broadcast(pivots)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                step = max(1, min(1024, STEP // max(len(shared.value), 1)))
                for at in range(0, batch.num_rows, step):
                    b = batch.slice(at, step)
                    d = _distances(_matrix(b.column("features")), shared.value)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1))], ["id", "label", "features", "cell", "d"])

        cells = self.train.mapInArrow(assign, f"id {self.kinds['id']}, label {self.kinds['label']}, features array<double>, cell int, d double")
        bundles = min(max(1, math.ceil(n / BUNDLE)), MOST_BUNDLES)
        dealt = cells.withColumn("own", F.monotonically_increasing_id()).repartitionByRange(bundles, "cell", "d", "own").withColumn("bundle", F.spark_partition_id())
        dealt = keep(dealt.drop("own"))
        rings = dealt.groupBy("bundle", "cell").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count("*").alias("n")).collect()
        self.rings = Rings(pivots, sorted(rings, key=lambda r: (r["bundle"], r["cell"])))
        numbers = {(r["bundle"], r["cell"]): k for k, r in enumerate(sorted(rings, key=lambda r: (r["bundle"], r["cell"])))}
        self.bundles, self.number = len({r["bundle"] for r in rings}), numbers
        return dealt

    def _round(self, dealt: DataFrame, asked: DataFrame, second: bool | None, n: int) -> DataFrame:
        """q, neighbour_id, label, distance of what the queries (q, features, bound) find."""
        salts = None
        if n > MOST_QUERIES:
            seen = asked.mapInArrow(_routes(self.rings, self.k, second, None, True), "bundle int, n long").groupBy("bundle").agg(F.sum("n").alias("n")).collect()
            salts = np.ones(MOST_BUNDLES, np.int64)
            for r in seen:
                salts[r["bundle"]] = math.ceil(r["n"] / MOST_QUERIES)
        probes = asked.mapInArrow(_routes(self.rings, self.k, second, salts, False), "bundle int, salt int, q long, features array<double>, bound double, rings array<int>, pairs long")
        self.probes.append(probes)
        width = len(self.rings.pivots)
        table = self.spark.createDataFrame([(b * width + c, k) for (b, c), k in self.number.items()], "at long, ring long")
        rows = dealt.withColumn("at", F.col("bundle").cast("long") * width + F.col("cell")).join(F.broadcast(table), "at")  # rings, which are bounded
        if salts is None:
            rows = rows.withColumn("salt", F.lit(0))
        else:
            copies = self.spark.createDataFrame([(k, int(s)) for k, s in enumerate(salts.tolist()) if s > 1], "bundle int, copies int")
            rows = rows.join(F.broadcast(copies), "bundle", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)))
        none = lambda kind: F.lit(None).cast(kind)
        left = rows.select("bundle", "salt", F.lit(0).alias("kind"), F.col("ring").alias("pos"), "id", "label", "features", none("double").alias("bound"), none("array<int>").alias("rings"))
        right = probes.select("bundle", "salt", F.lit(1).alias("kind"), F.col("q").alias("pos"), none(self.kinds["id"]).alias("id"), none(self.kinds["label"]).alias("label"), "features", "bound", "rings")
        both = left.unionByName(right).repartition("bundle", "salt").sortWithinPartitions("bundle", "salt", "kind", "pos")
        return both.mapInArrow(_search(self.k), f"q long, neighbour_id {self.kinds['id']}, label {self.kinds['label']}, distance double")

    def run(self) -> DataFrame:
        dealt, n = self._bundled(), self.queries.count()
        asked = self.queries.select("q", "features", F.lit(math.inf).alias("bound"))
        if self.bundles <= 1:
            found = self._round(dealt, asked, None, n)
        else:
            near = self._round(dealt, asked, False, n)
            best = Window.partitionBy("q").orderBy("distance", F.col("neighbour_id").asc_nulls_last())
            bound = near.withColumn("r", F.row_number().over(best)).where(F.col("r") == self.k).select("q", F.col("distance").alias("bound"))
            again = self.queries.select("q", "features").join(bound, "q", "left").select("q", "features", F.coalesce("bound", F.lit(math.inf)).alias("bound"))
            found = self._round(dealt, keep(again), True, n)
        w = Window.partitionBy("q").orderBy("distance", F.col("neighbour_id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= self.k)
        return ranked.join(self.queries.select("q", "query_id"), "q").select("query_id", "rank", "neighbour_id", "label", "distance")


def nearest(train: DataFrame, queries: DataFrame, k: int, key: str = "id", label: str = "label", vector: str = "features") -> DataFrame:
    """query_id, rank, neighbour_id, label, distance of the k nearest training rows of each query."""
    return Nearest(train, queries, k, key, label, vector).run()
