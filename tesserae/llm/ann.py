"""Approximate nearest neighbours by inner product: lists of an inverted file, scanned by an adaptive number of dimensions.

Vectors get one more dimension, sqrt(M^2 - |x|^2) with M the largest norm (queries: 0), so that the largest inner product is the
smallest distance, and are turned by a random rotation. Lists are cells of centres (sqrt(n) of them, at most an eighth of the sample)
that are learned from at most `sample` vectors. A query probes the lists that it is nearest to, so many of them as hold the share
TARGET of the sample's true neighbours of ASKED sample vectors: few if the vectors have clusters, most if they have none. Within a
list, candidates stand in column blocks: after each block of dimensions the partial distance, scaled up, is tested against a bound
on the distance of the query's k-th best; a candidate that is farther by more than the test allows is abandoned. What is left gets
its exact inner product on the original vectors. The bound is the distance of the k-th best among the sample's vectors in the lists
that the query probes; it probes more lists until there are k. Queries that still end with too few (the tests may
abandon near candidates) are searched again in all lists without bounds.

Spark deals lists out in bundles of at most BLOCK vectors (a longer list is several bundles), and queries in blocks likewise, so a list
that a third of all vectors fall into is many groups, each of bounded size. A query goes once to each bundle that holds a list it
probes, with the numbers of these lists. Each group gives k candidates for a query at most; the best k of all stay.

Defined cases: vectors that are null, zero or hold null, NaN or infinite components take no part (as query or candidate); a row
with a null id is a candidate like any other, but no query of nearest(); shorter vectors count as padded with zeros; a row is a
candidate of every row but itself, also of rows with the same id or an equal vector, and each row with a query's id is a query of
its own; of the vectors found, ties go to the smaller id, null last (which of equally near ones are found is up to the probed lists);
an empty table gives an empty one; of more vectors than the sample holds those with the smallest hashes are in it; other columns are
not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.llm.common import keep

SAMPLE, BLOCK, COLUMNS = 16_384, 4096, 16
#: Standard deviations of the test that abandons a candidate.
Z = 2.6
#: Share of true neighbours that the probed lists are to hold, and sample vectors by which that is measured.
TARGET, ASKED = 0.96, 1024


@dataclass(frozen=True)
class Index:
    """dims: of the original vectors; top: the largest norm squared; turn: rotation; centres, sample: rotated; ids and cells of the sample; probes: lists for a query."""

    dims: int
    top: float
    turn: np.ndarray
    centres: np.ndarray
    sample: np.ndarray
    ids: np.ndarray
    cells: np.ndarray
    probes: int

    def lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.top - np.einsum("ij,ij->i", x, x), 0))
        return (np.column_stack([x, more]) @ self.turn).astype(np.float32)

    def nearest_lists(self, x: np.ndarray) -> np.ndarray:
        """All lists for each row, nearest first."""
        return ((self.centres**2).sum(1) / 2 - x @ self.centres.T).argsort(1, kind="stable")


def _matrix(lists, dims: int) -> np.ndarray:
    """Rows of an Arrow list column as doubles, padded with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n = np.diff(np.asarray(lists.offsets))
    out = np.zeros((len(n), dims))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _ids(column) -> np.ndarray:
    """Ids as 64-bit numbers, the largest one in place of nulls."""
    return pc.fill_null(column, np.iinfo(np.int64).max).to_numpy()


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and v (as they are, if they are floats, else doubles) of the vectors that take part."""
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("v")).where(F.col("v").isNotNull()).where(fine)


def _to_sample(ix: Index, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances to the sample's vectors, infinite to those with a query's own id (which makes bounds wider only)."""
    far = ((x**2).sum(1)[:, None] + (ix.sample**2).sum(1) - 2 * x @ ix.sample.T).astype(float)
    far[ids[:, None] == ix.ids] = np.inf
    return far


def fit(rows: DataFrame, k: int, sample: int = SAMPLE, rounds: int = 12) -> Index | None:
    """Centres from the vectors with the smallest hashes, at most `sample`; None if there are no vectors."""
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    dims, top, n = rows.agg(F.max(F.size("v")), F.max(norm), F.count("*")).first()
    if not n:
        return None
    some = rows.orderBy(F.xxhash64("id", "v"), "id").limit(sample).toArrow()
    rng = np.random.default_rng(9)
    turn, _ = np.linalg.qr(rng.standard_normal((dims + 1, dims + 1)))
    none = np.zeros((0, dims + 1), np.float32)
    index = Index(dims, top * (1 + 1e-9), turn, none, none, _ids(some.column("id")), np.zeros(0, int), 1)
    raw = _matrix(some.column("v"), dims)
    x = index.lifted(raw)
    lists = max(1, min(round(math.sqrt(n)), len(x) // 8))
    centres = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        own = _nearest(x, centres)
        for c in range(lists):
            if (own == c).any():
                centres[c] = x[own == c].mean(0)
    index = replace(index, centres=centres, sample=x, cells=_nearest(x, centres))
    ranks = []
    for a in range(0, min(ASKED, len(x)), 256):
        q, ids = index.lifted(raw[a : a + 256], True), index.ids[a : a + 256]
        far = _to_sample(index, q, ids)
        near = np.argsort(far, 1)[:, :k]
        place = np.argsort(index.nearest_lists(q), 1)  # of each list in the query's order
        rank = np.take_along_axis(place, index.cells[near], 1)
        ranks.append(rank[np.isfinite(np.take_along_axis(far, near, 1))])
    ranks = np.concatenate(ranks)
    return replace(index, probes=int(np.ceil(np.quantile(ranks, TARGET))) + 1 if len(ranks) else lists)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate([(x[a : a + 4096] @ centres.T - half).argmax(1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def placed(rows: DataFrame, index) -> DataFrame:
    """id, v, cell (the list that holds the vector) and row, a number of its own."""
    kind = rows.schema["v"].dataType.simpleString()

    def run(batches):
        ix = index.value
        for b in batches:
            x = ix.lifted(_matrix(b.column("v"), ix.dims))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(_nearest(x, ix.centres).astype(np.int32))], ["id", "v", "cell"])

    return keep(rows.mapInArrow(run, f"id long, v {kind}, cell int").withColumn("row", F.monotonically_increasing_id()))


def _bundles(sizes: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Of each list its (first) bundle and how many it is dealt over: small lists share one, as far as BLOCK goes."""
    out, n, room = {}, -1, 0
    for cell, size in sorted(sizes.items()):
        if size > BLOCK:
            parts = math.ceil(size / BLOCK)
            out[cell], n, room = (n + 1, parts), n + parts, 0
            continue
        if size > room:
            n, room = n + 1, BLOCK
        out[cell], room = (n, 1), room - size
    return out


def _asked(queries: DataFrame, index, bundles: dict[int, tuple[int, int]], k: int, whole: bool) -> DataFrame:
    """bundle, cells (those of the bundle that the query probes), row, id, v, bound. whole: all lists, without bound."""
    kind = queries.schema["v"].dataType.simpleString()
    n = max((first + parts for first, parts in bundles.values()), default=0)

    def run(batches):
        ix = index.value
        first = np.zeros((len(ix.centres), n), bool)  # which bundles hold a list
        for cell, (a, parts) in bundles.items():
            first[cell, a : a + parts] = True
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                ids, x = _ids(b.column("id")), ix.lifted(_matrix(b.column("v"), ix.dims), True)
                order, bound, probes = ix.nearest_lists(x), np.full(len(ids), np.inf), np.full(len(ids), len(ix.centres))
                if not whole:
                    far = _to_sample(ix, x, ids)
                    there = np.stack([np.bincount(ix.cells[np.isfinite(f)], minlength=len(ix.centres)) for f in far])
                    enough = (np.cumsum(np.take_along_axis(there, order, 1), 1) < k).sum(1) + 1
                    probes = np.minimum(np.maximum(ix.probes, enough), len(ix.centres))
                place = np.argsort(order, 1)
                probed = place < probes[:, None]
                if not whole:
                    far[~probed[:, ix.cells]] = np.inf
                    bound = np.partition(far, k - 1, 1)[:, k - 1] if far.shape[1] >= k else bound
                hit = probed.astype(np.float32) @ first.astype(np.float32) > 0
                q, bundle = np.nonzero(hit)
                cells = [np.flatnonzero(probed[i] & first[:, j]).astype(np.int32) for i, j in zip(q, bundle, strict=True)]
                take = pa.array(q)
                yield pa.RecordBatch.from_arrays([pa.array(bundle.astype(np.int32)), pa.array(cells, pa.list_(pa.int32())), b.column("row").take(take), b.column("id").take(take), b.column("v").take(take), pa.array(bound[q])], ["bundle", "cells", "row", "id", "v", "bound"])

    return queries.select("row", "id", "v").mapInArrow(run, f"bundle int, cells array<int>, row long, id long, v {kind}, bound double")


def allowance(done: int, dims: int, z: float = Z) -> float:
    """How much larger than the distance the scaled-up partial distance may be before that is taken as a sign against it.

    After a random rotation, the share of the squared distance in `done` of `dims` dimensions follows a Beta law.
    """
    return 1 + z * math.sqrt(2 * (dims - done) / (done * (dims + 2)))


def scan(q: np.ndarray, bound: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (query, candidate) that no test abandons, and how many coordinates were read in all.

    q: queries x dims; bound: each query's bound on the squared distance; x: dims x candidates, read in slabs of COLUMNS.
    Slabs are read for all pairs at once while many are alive, then for those alone.
    """
    dims, read, alive, pairs = len(x), 0, None, None
    total = np.zeros((len(q), x.shape[1]), np.float32)
    for a in range(0, dims, COLUMNS):
        b = min(dims, a + COLUMNS)
        if pairs is None:
            total += (q[:, a:b] ** 2).sum(1)[:, None] + (x[a:b] ** 2).sum(0) - 2 * (q[:, a:b] @ x[a:b])
            read += total.size * (b - a)
            alive = total * (dims / b) <= (bound * allowance(b, dims))[:, None]
            if b == dims or np.count_nonzero(alive) < alive.size / 8:
                pairs = np.nonzero(alive)
                total = total[pairs]
        else:
            total += ((q[pairs[0], a:b] - x[a:b, pairs[1]].T) ** 2).sum(1)
            read += len(total) * (b - a)
            ok = total * (dims / b) <= bound[pairs[0]] * allowance(b, dims)
            pairs, total = (pairs[0][ok], pairs[1][ok]), total[ok]
    return *pairs, read


FOUND = "row long, query_id long, vec_row long, vec_id long, score double"


def _group(index, k: int):
    """The k best of one bundle for each query of one block, list by list."""
    names = [x.split()[0] for x in FOUND.split(", ")]

    def run(queries: pa.Table, found: pa.Table) -> pa.Table:
        ix = index.value
        cells, rows, ids, unnamed = found.column("cell").to_numpy(), found.column("row").to_numpy(), _ids(found.column("id")), found.column("id").is_null().to_numpy()
        raw = _matrix(found.column("v"), ix.dims)
        x = np.ascontiguousarray(ix.lifted(raw).T) if len(raw) else np.zeros((ix.dims + 1, 0), np.float32)
        qids, qrows, qraw = queries.column("id").combine_chunks(), queries.column("row").to_numpy(), _matrix(queries.column("v"), ix.dims)
        bounds, qx = queries.column("bound").to_numpy() * (1 + 1e-5) + 1e-5, ix.lifted(qraw, True)
        lists = queries.column("cells").combine_chunks()
        probed, asker = lists.flatten().to_numpy(), np.repeat(np.arange(len(qids)), np.diff(np.asarray(lists.offsets)))
        out = []
        for cell in np.unique(cells):
            own, askers = np.flatnonzero(cells == cell), asker[probed == cell]
            part = np.ascontiguousarray(x[:, own])
            for a in range(0, len(askers), 256):
                some = askers[a : a + 256]
                one, two, _ = scan(qx[some], bounds[some], part)
                one, two = some[one], own[two]
                other = rows[two] != qrows[one]
                one, two = one[other], two[other]
                score = np.concatenate([np.einsum("ij,ij->i", raw[two[c : c + 65536]], qraw[one[c : c + 65536]]) for c in range(0, len(one), 65536)] or [np.zeros(0)])
                out.append((one, two, score))
        one, two, score = (np.concatenate(y) for y in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        best = np.lexsort((rows[two], unnamed[two], ids[two], -score, one))
        one, two, score = one[best], two[best], score[best]
        first = np.arange(len(one)) - np.searchsorted(one, one) < k
        one, two, score = one[first], two[first], score[first]
        return pa.table([pa.array(qrows[one]), qids.take(pa.array(one)), pa.array(rows[two]), pa.array(ids[two], mask=unnamed[two]), pa.array(score)], names)

    return run


def _scanned(queries: DataFrame, among: DataFrame, index, k: int, whole: bool = False) -> DataFrame:
    """The k best of each bundle for each query (FOUND). queries: row, id, v; among: as placed() gives them."""
    spark = among.sparkSession
    sizes = {r["cell"]: r["n"] for r in among.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most an eighth of the sample
    bundles = _bundles(sizes)
    blocks = max(1, math.ceil(queries.count() / BLOCK))
    table = F.broadcast(spark.createDataFrame([(c, *x) for c, x in bundles.items()], "cell int, first int, parts int"))
    left = _asked(queries, index, bundles, k, whole).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    right = among.join(table, "cell").select((F.col("first") + F.pmod(F.xxhash64("row"), "parts")).cast("int").alias("bundle"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "row", "id", "v", "cell")
    return left.groupBy("bundle", "block").cogroup(right.groupBy("bundle", "block")).applyInArrow(_group(index, k), FOUND)


def _search(queries: DataFrame, among: DataFrame, index, k: int) -> DataFrame:
    """query_id, rank, vec_id, score. queries: row (of among, if the query is one of them), id, v."""
    found = keep(_scanned(queries, among, index, k))
    want = F.least(F.lit(k), F.lit(among.count()) - (F.col("row") >= 0).cast("long"))
    short = queries.join(found.groupBy("row").agg(F.count("*").alias("n")), "row", "left").where(F.coalesce("n", F.lit(0)) < want)
    short = keep(short.select("row", "id", "v"))
    if not short.isEmpty():
        found = found.join(short.select("row"), "row", "left_anti").union(_scanned(short, among, index, k, True))
    w = Window.partitionBy("row").orderBy(F.col("score").desc(), F.asc_nulls_last("vec_id"), "vec_row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(queries: DataFrame, candidates: DataFrame, k: int = 20, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, which is not one of the candidates; both sides as usable() gives them."""
    index = fit(candidates, k, sample)
    if index is None:
        return candidates.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = candidates.sparkSession.sparkContext.broadcast(index)
    asked = keep(queries.select((-1 - F.monotonically_increasing_id()).alias("row"), "id", "v"))
    return _search(asked, placed(candidates, shared), shared, k)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, where: Column | None = None, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each vector whose id is divisible by `every`, among all others."""
    rows = usable(vectors)
    index = fit(rows, k, sample)
    if index is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = rows.sparkSession.sparkContext.broadcast(index)
    among = placed(rows, shared)
    return _search(among.where(where if where is not None else F.col("id") % every == 0), among, shared, k)
