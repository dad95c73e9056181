"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, A-Z as a-z. Seeds are pairs of neighbouring words of a test item; in a document, one other
word may stand between the two. A document that holds enough seeds of an item is aligned with the item around the places where the
item would lie (match 2, mismatch -1, gap -1; local). The document is contaminated if the best score is at least THRESHOLD of the
score of the whole item, which edited and paraphrased copies reach as well.

How many seeds are enough: let an alignment of M of an item's L words reach 2tL, t the threshold. Between two successive matches
there is a seed, or at least one word of the item is lost there (T1 such places), or at least two words are put in (T2). Scores give
2M - T1 - 2 T2 >= 2tL, and M + T1 <= L; so there are M - 1 - T1 - T2 >= L(4t - 1)/3 - 1 seeds, and all of them lie within 2L(1 - t)
of the place where the item would start. If this number is D more than one, up to D/2 pairs, the commonest in the corpus, need
not be seeds, and those that are left are that many fewer. So no pair that reaches the threshold is lost, whatever was edited; items
of three words, for which the number is 0, have the pair of their outer words as well. Only for thresholds below 1/4 + 3/(4L) the
number is below 1: then copies without any seed are not found.

Items are broadcast in chunks of at most CHUNK bytes of text; more chunks are more passes, so no item is left out. Counts are
summed per task before the shuffle, one row for each pair of the chunk at most. Texts are aligned where they are read: they are
never shuffled.

Defined cases: items of fewer than three words, null and empty items have no seeds and match nothing; null and empty documents
match nothing; repeated items and documents get rows of their own; with no items or no documents there are no rows; a very long
text is a slice of its own, whose hits are gone through by ranges of items; of alignments with equal scores the one that ends first
counts; other columns are not read, and decontaminate() passes them through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm import text as T
from tesserae.llm.common import fresh

RUN, THRESHOLD, CHUNK = 4, 0.5, 8 << 20
MATCH, MISMATCH, GAP = 2, 1, 1
#: Everything below 128 but digits and letters.
TABLE = T.byte_table(bytes(k for k in range(128) if not chr(k).isalnum()))
_MULT = np.uint64(0x9E3779B97F4A7C15)
_FILTER = 1 << 22
#: Hits that found() holds at once, unless one document has more of one item.
_HITS = 1 << 20


def _grams(h: np.ndarray, count: np.ndarray, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all pairs of words `step` apart in the same text, and the first words of them."""
    n = len(h) - step
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.ones(n, bool)
    ends = np.cumsum(count)
    for k in range(1, step + 1):
        cut = ends - k
        inside[cut[(cut >= 0) & (cut < n)]] = False
    at = np.flatnonzero(inside)
    return T.mix(h[at] * _MULT + h[at + step]), at


@dataclass(frozen=True)
class Items:
    """words: hashes of all items' words; begin, length: each item's run; need, drift: seeds that a copy holds at least, and how far apart
    the places are at most; grams: distinct pairs, sorted; gram, item, at: where each of them is."""

    ids: pa.Array
    words: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    need: np.ndarray
    drift: np.ndarray
    grams: np.ndarray
    gram: np.ndarray
    item: np.ndarray
    at: np.ndarray

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in h, number of the pair) of those in h that items have."""
        if not len(self.grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        seen = np.zeros(_FILTER, bool)
        seen[self.grams & np.uint64(_FILTER - 1)] = True
        maybe = np.flatnonzero(seen[h & np.uint64(_FILTER - 1)])
        k = np.minimum(np.searchsorted(self.grams, h[maybe]), len(self.grams) - 1)
        hit = self.grams[k] == h[maybe]
        return maybe[hit], k[hit]


def _items(ids: pa.Array, texts: pa.Array, threshold: float = THRESHOLD) -> Items:
    h, count = T.word_hashes(T.plain(texts), TABLE)
    begin = np.cumsum(count) - count
    of = np.repeat(np.arange(len(count)), count)
    (g, at), (outer, first) = _grams(h, count), _grams(h, count, 2)
    three, more = count[of[first]] == 3, count[of[at]] >= 3
    g, at = np.append(g[more], outer[three]), np.append(at[more], first[three])
    item = of[at]
    grams, gram = np.unique(g, return_inverse=True)
    need = np.maximum(np.ceil(count * (4 * threshold - 1) / 3 - 1 - 1e-9), 1).astype(np.int64)
    drift = np.maximum(np.floor(2 * count * (1 - threshold) + 1e-9), 1).astype(np.int64)
    return Items(ids, h, begin, count, need, drift, grams, gram, item, at - begin[item])


def seeds(items: Items, freq: np.ndarray) -> Items:
    """Without the commonest pairs, as many as half of what each item needs; the rarest of each RUN successive ones stays (of equal counts, the first)."""
    order = np.lexsort((items.at, items.item))
    item, count = items.item[order], freq[items.gram[order]]
    n = len(item)
    own = np.zeros(n, bool)
    if n:
        first = np.arange(n)
        last = np.searchsorted(item, item, side="right") - 1
        start = np.searchsorted(item, item)
        full = first + RUN - 1 <= last
        short = (last - start + 1 < RUN) & (first == start)
        at = first[full | short]
        reach = np.minimum(at[:, None] + np.arange(RUN), last[at][:, None])
        own[at + np.minimum(count[reach].argmin(1), last[at] - at)] = True
    common = np.flatnonzero(~own)
    common = common[np.lexsort((-count[common], item[common]))]
    nth = np.arange(len(common)) - np.searchsorted(item[common], item[common])
    gone = common[nth < (items.need[item[common]] - 1) // 2]
    need = items.need - np.bincount(item[gone], minlength=len(items.need))
    own = np.delete(order, gone)
    grams, gram = np.unique(items.grams[items.gram[own]], return_inverse=True)
    return replace(items, need=need, grams=grams, gram=gram, item=items.item[own], at=items.at[own])


def align(item: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of each row's item (n x words) in its window (n x words), and where in the window it ends."""
    n, width = window.shape
    ramp = GAP * np.arange(width + 1, dtype=np.int32)
    row, best, where = np.zeros((n, width + 1), np.int32), np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(item.shape[1]):
        now = np.zeros_like(row)
        step = np.where(item[:, i : i + 1] == window, MATCH, -MISMATCH).astype(np.int32)
        np.maximum(row[:, :-1] + step, row[:, 1:] - GAP, out=now[:, 1:])
        np.maximum(now, 0, out=now)
        row = np.maximum.accumulate(now + ramp, axis=1) - ramp
        end = row.argmax(1)
        top = row[np.arange(n), end]
        better = top > best
        best[better], where[better] = top[better], end[better] - 1
    return best, where


def found(items: Items, h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, item, best score, word at which it ends, seeds hit) of all pairs with as many seeds as a copy needs."""
    word, gram = [], []
    for step in (1, 2):
        g, at = _grams(h, count, step)
        spot, k = items.lookup(g)
        word.append(at[spot])
        gram.append(k)
    word, gram = np.concatenate(word), np.concatenate(gram)
    doc = np.searchsorted(np.cumsum(count), word, side="right")
    n, wide = len(items.length), np.arange(len(items.grams) + 1)
    by_gram = np.lexsort((items.item, items.gram))
    where = items.gram[by_gram] * n + items.item[by_gram]
    many = np.diff(np.searchsorted(where, wide * n))[gram]
    part = np.cumsum(np.bincount(doc, many, len(count)))[doc] // _HITS
    todo, out = [(part == p, 0, n) for p in np.unique(part)], []
    while todo:
        own, a, b = todo.pop()
        g = gram[own]
        first, last = np.searchsorted(where, g * n + a), np.searchsorted(where, g * n + b)
        if b - a > 1 and (last - first).sum() > 2 * _HITS:
            some, half = np.flatnonzero(own)[last > first], np.zeros(len(own), bool)
            half[some] = True
            todo += [(half, a, (a + b) // 2), (half, (a + b) // 2, b)]
        else:
            out.append(_aligned(items, h, count, doc[own], word[own], by_gram, first, last - first))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 5


def _aligned(items: Items, h: np.ndarray, count: np.ndarray, doc: np.ndarray, word: np.ndarray, by_gram: np.ndarray, first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, ...]:
    """found() for the hits at these words, where by_gram[first : first + many] have the pair."""
    ends = np.cumsum(count)
    begin = ends - count
    which = by_gram[np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
    doc, item = np.repeat(doc, many), items.item[which]
    place = np.repeat(word, many) - items.at[which]  # where the item would start
    order = np.lexsort((place, doc * len(items.length) + item))
    doc, item, place = doc[order], item[order], place[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))
    group = np.cumsum(new) - 1
    hits = np.bincount(group)
    # a place from which enough seeds lie within the drift
    reach = np.arange(len(doc)) + items.need[item] - 1
    there = np.minimum(reach, len(doc) - 1)
    start = np.flatnonzero((reach < len(doc)) & (group[there] == group) & (place[there] - place <= items.drift[item]))
    if not len(start):
        return (np.zeros(0, np.int64),) * 5
    # the places are dealt into windows that reach as far as an alignment can
    group, d, k, place = group[start], doc[start], item[start], place[start]
    p = items.drift[k]
    nth = place // p
    one = np.append(True, (group[1:] != group[:-1]) | (nth[1:] != nth[:-1]))
    group, d, k, p, low = group[one], d[one], k[one], p[one], (nth * p - p)[one]
    high = np.minimum(low + items.length[k] + 3 * p, ends[d])
    low = np.maximum(low, begin[d])
    score, end = np.zeros(len(d), np.int64), np.zeros(len(d), np.int64)
    by_size = np.argsort(items.length[k], kind="stable")
    for a in range(0, len(d), 256):
        own = by_size[a : a + 256]
        wide, long = int((high - low)[own].max()), int(items.length[k[own]].max())
        col = np.arange(max(wide, 1))
        window = np.where(col < (high - low)[own, None], h[np.minimum(low[own, None] + col, len(h) - 1)], np.uint64(0))
        col = np.arange(long)
        words = np.where(col < items.length[k[own], None], items.words[np.minimum(items.begin[k[own], None] + col, len(items.words) - 1)], np.uint64(1))
        score[own], end[own] = align(words, window)
        end[own] += low[own] - begin[d[own]]
    best = np.lexsort((end, -score, group))
    one = best[np.append(True, group[best][1:] != group[best][:-1])]
    return d[one], k[one], score[one], end[one], hits[group[one]]


def _chunks(benchmark: DataFrame, threshold: float):
    rows = benchmark.select("item_id", F.col("text").alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = math.ceil(total / CHUNK)
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toArrow()
        yield _items(part.column("item_id").combine_chunks(), part.column("text").combine_chunks(), threshold)


def _frequencies(docs: DataFrame, shared) -> DataFrame:
    def run(batches):
        items = shared.value
        n = np.zeros(len(items.grams), np.int64)
        for b in T.slices(batches, "text", 1 << 20):
            _, gram = items.lookup(_grams(*T.word_hashes(T.plain(b.column("text")), TABLE))[0])
            np.add.at(n, gram, 1)
        some = np.flatnonzero(n)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["gram", "n"])

    return docs.select(F.col("text").alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, hash (of the text), item_id, sw_score, share (of the item's full score), ends_at (word of the document), n_seeds."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", _hash().alias("hash"), F.col("text").alias("text"))
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, hash long, item_id {kinds[1]}, sw_score long, share double, ends_at long, n_seeds long"
    out = spark.createDataFrame([], schema)
    for items in _chunks(benchmark, threshold):
        counted = _frequencies(rows, spark.sparkContext.broadcast(items)).toPandas()
        freq = np.zeros(len(items.grams), np.int64)
        freq[counted["gram"]] = counted["n"]
        shared = spark.sparkContext.broadcast(seeds(items, freq))

        def run(batches, shared=shared):
            items = shared.value
            for b in T.slices(batches, "text", 1 << 20):
                d, k, score, end, n = found(items, *T.word_hashes(T.plain(b.column("text")), TABLE))
                share = score / (MATCH * items.length[k])
                ok = share >= threshold
                at = pa.array(d[ok])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("hash").take(at), items.ids.take(pa.array(k[ok])), pa.array(score[ok]), pa.array(share[ok]), pa.array(end[ok]), pa.array(n[ok])], ["doc_id", "hash", "item_id", "sw_score", "share", "ends_at", "n_seeds"])

        out = out.union(rows.mapInArrow(run, schema))
    return out


def _hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all columns."""
    id_, hash_ = fresh(docs, "id", "hash")
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias(id_), F.col("hash").alias(hash_)).distinct()
    return docs.join(bad, (_hash() == F.col(hash_)) & F.col("doc_id").eqNullSafe(F.col(id_)), "left_anti")
