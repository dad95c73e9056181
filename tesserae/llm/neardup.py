"""Near-duplicates by MinHash with tensored banding.

A text's set is its distinct 5-word shingles (the whole sequence if it has fewer words). HALVES half-keys of ROWS minhashes each
are computed once; the keys of the hash tables are all pairs of a text's half-keys. So HALVES * ROWS = 72 minhashes give
HALVES * (HALVES - 1) / 2 = 276 tables of 2 * ROWS = 6 minhashes each, which would take 1,656 if computed apart. Two texts
meet if they agree in any two half-keys. At a similarity of 0.75 a half-key agrees with 0.75^3 = 0.42, and fewer than two of
24 do with 3.6e-5; at 0.8 with 7e-7; at 0.1 any two do with 2.7e-4.

1. Texts with the same set are one class, found by a 128-bit fingerprint; only one text of each goes on.
2. Half-keys that only one class has are dropped before they are paired: they lead nowhere.
3. In each table bucket, every class is checked against the most connected class of the bucket (a star, not all pairs), by the
   full sets of both texts.
4. Links make components. Then pairs in a bucket that are still in different components, and not checked yet, are checked as
   well, so that no link is lost because a star's centre is not linked with both ends. Pairs that cannot be linked by what the two
   have in common with other components at all are left out first.
5. Components are labelled by alternating large and small stars, each round a table in the shared folder.

Keys that many rows share (half-keys, buckets, star centres, hubs) are dealt over tasks by join_spread(); buckets in step 4 are cut
into blocks, and each pair of blocks is a group of its own.

Defined cases: null and empty texts, and texts of white space, have an empty set and are linked with nothing; repeated rows and
copies are one class; a very long text is a slice of its own; a null id is larger than all others; if all ids of a group are null, so
is component_id, and its rows are kept; of equally connected classes the one with the larger fingerprint is a star's centre, which
changes no result; an empty table gives an empty one; components() stops with an error after 60 rounds (their number grows with the
logarithm of the longest chain). Columns other than doc_id and text are not read; deduplicate() passes them through. It leaves
one row of each group: of rows with the smallest id the one whose text has the smallest hash, and of repeated rows one by a hash of
all their columns. Rows with empty sets all stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm import text as T
from tesserae.llm.common import brief, drop, fresh, join_spread, keep, sieve, sifted

SIZE, HALVES, ROWS = 5, 24, 3
#: Links: SHARE * intersection >= PART * union.
SHARE, PART = 100, 75
_RANDOM = np.random.default_rng(5)
_LOW, _HIGH = (_RANDOM.integers(0, 1 << 32, HALVES * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1) for _ in range(2))
_SALT = _RANDOM.integers(0, 1 << 63, HALVES, dtype=np.uint64)
#: Numbers of 64 bits in a class's sketch, and how many bits may differ between linked classes.
WORDS, FAR = 16, 181
#: Classes of a bucket that meet in one group of a join.
BLOCK = 256
#: Pairs of one class whose text goes to one task.
MOST_TEXTS = 256
_BITS = _RANDOM.integers(0, 1 << 32, (2, WORDS * 64), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_POWERS = [pow(0x9E3779B97F4A7C15, SIZE - 1 - k, 1 << 64) for k in range(SIZE)]


def _word_hashes(distinct: pa.Array) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct))


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes of the distinct shingles of each text, one text after the other, and the sizes of the sets."""
    flat, count = T.words(texts)
    code, distinct = T.codes(flat)
    h = T.mix(_word_hashes(distinct) + np.uint64(1))[code] if len(code) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(count)), count)
    parts, own = [], []
    if len(h) >= SIZE:
        n = len(h) - SIZE + 1
        rolled = np.zeros(n, np.uint64)
        for k, p in enumerate(_POWERS):
            rolled += h[k : k + n] * np.uint64(p)
        inside = doc[SIZE - 1 :] == doc[:n]
        parts.append(T.mix(rolled[inside])), own.append(doc[:n][inside])
    begin = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < SIZE))
    rolled = np.zeros(len(short), np.uint64)
    for k in range(SIZE - 1):
        has = count[short] > k
        rolled[has] = rolled[has] * np.uint64(_POWERS[0]) + h[begin[short[has]] + k]
    parts.append(T.mix(rolled + np.uint64(0xA5A5))), own.append(short)
    value, own = np.concatenate(parts), np.concatenate(own)
    order = np.lexsort((value, own))
    value, own = value[order], own[order]
    new = np.append(True, (value[1:] != value[:-1]) | (own[1:] != own[:-1])) if len(value) else np.zeros(0, bool)
    return value[new], np.bincount(own[new], minlength=len(count))


def half_keys(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One row of HALVES for each set that is not empty."""
    begin = (np.cumsum(size) - size)[size > 0]
    low, high = value.astype(np.uint32), (value >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(begin), HALVES), np.uint64)
    for k in range(HALVES):
        key = np.full(len(begin), _SALT[k])
        for r in range(k * ROWS, (k + 1) * ROWS):
            key = T.mix(key ^ np.minimum.reduceat(low * _LOW[r] + high * _HIGH[r], begin)) if len(begin) else key
        out[:, k] = key
    return out


def fingerprints(value: np.ndarray, size: np.ndarray) -> list[bytes]:
    """128 bits that depend on the set alone."""
    begin = (np.cumsum(size) - size)[size > 0]
    if not len(begin):
        return []
    one, two = T.mix(value ^ np.uint64(0x1234567)), T.mix(value ^ np.uint64(0x89ABCDEF0))
    both = np.stack([T.mix(np.add.reduceat(one, begin) + size[size > 0].astype(np.uint64)), T.mix(np.add.reduceat(two, begin))], axis=1)
    return [x.tobytes() for x in both]


def _pieces(batches, most: int = 1 << 18):
    """Slices with about `most` words, so that columns of numbers stay in the processor's cache."""
    return T.slices(batches, "text", most * 6)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, hash (of the text), node (fingerprint of the set, null if empty), n_shingles, halves."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in _pieces(batches):
            value, size = shingle_sets(b.column("text"))
            some = np.flatnonzero(size)
            node, halves = np.full(b.num_rows, None, object), np.full(b.num_rows, None, object)
            node[some] = fingerprints(value, size)
            for k, h in zip(some.tolist(), half_keys(value, size).view(np.int64), strict=True):
                halves[k] = h
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("hash"), pa.array(node, pa.binary()), pa.array(size.astype(np.int64)), pa.array(halves, pa.list_(pa.int64()))], ["doc_id", "hash", "node", "n_shingles", "halves"])

    rows = docs.select("doc_id", _hash().alias("hash"), F.col("text").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, hash long, node binary, n_shingles long, halves array<long>")


def _hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _classes(rows: DataFrame) -> DataFrame:
    """node, first (smallest doc_id), at (doc_id and hash of one text), n_shingles, halves, copies."""
    at = F.struct("doc_id", "hash")
    return rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.min(at).alias("at"), F.first("n_shingles").alias("n_shingles"), F.first("halves").alias("halves"), F.count("*").alias("copies"))


def _tables(classes: DataFrame) -> DataFrame:
    """key, node, weight: buckets with more than one class. weight: how many classes share the node's half-keys."""
    counted = lambda df, key: df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    halves = classes.select("node", F.explode("halves").alias("half"))
    with brief() as hold:
        several = hold(counted(halves, "half"))
        some = sifted(halves, "half", sieve(several, "half"))
        own = join_spread(some, several, "half", total=HALVES * classes.count()).groupBy("node").agg(F.sort_array(F.collect_list("half")).alias("halves"), F.sum("n").alias("weight"))
        pairs = own.select("node", "weight", "halves", F.posexplode("halves").alias("k", "a"))
        keys = hold(pairs.select("node", "weight", "a", F.explode(F.slice("halves", F.col("k") + 2, F.size("halves"))).alias("b")).select(F.xxhash64("a", "b").alias("key"), "node", "weight"))
        several = hold(counted(keys, "key"))
        some = sifted(keys, "key", sieve(several, "key"))
        return keep(join_spread(some, several, "key", total=keys.count()).select("key", "node", "weight"))


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _stars(tables: DataFrame) -> DataFrame:
    """Each class of a bucket with the most connected one."""
    centre = tables.groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("centre"), F.count("*").alias("n"))
    return join_spread(tables, centre, "key").where("node <> centre").select(*_pair(F.col("node"), F.col("centre"))).distinct()


def _shared(nodes: DataFrame, texts: DataFrame, hold) -> DataFrame:
    """node, shared: how many of a class's shingles occur in another component as well. nodes: node, label."""

    def run(batches):
        for b in _pieces(batches):
            value, size = shingle_sets(b.column("text"))
            at = pa.array(np.repeat(np.arange(b.num_rows), size))
            yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("of").take(at), pa.array(value.view(np.int64))], ["id", "of", "shingle"])

    rows = texts.join(nodes, "node").select(F.xxhash64("node").alias("id"), F.xxhash64("label").alias("of"), "text")
    shingles = hold(rows.mapInArrow(run, "id long, of long, shingle long"))
    across = shingles.groupBy("shingle").agg(F.min("of").alias("l"), F.max("of").alias("m")).where("l <> m").select("shingle")
    counts = shingles.select("id", "shingle").join(across, "shingle").groupBy("id").agg(F.count("*").alias("shared"))
    return nodes.select("node", F.xxhash64("node").alias("id")).join(counts, "id").select("node", "shared")


def bits(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    """WORDS numbers of 64 bits for each set that is not empty; a bit of two sets differs with probability (1 - similarity) / 2."""
    begin = (np.cumsum(size) - size)[size > 0]
    low, high = value.astype(np.uint32), (value >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(begin), WORDS * 64), np.uint8)
    for k in range(out.shape[1] if len(begin) else 0):
        least = np.minimum.reduceat(low * _BITS[0, k] + high * _BITS[1, k], begin)
        out[:, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(31)
    return np.packbits(out, axis=1).view(np.int64)


def _sketched(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """node, w0 to w15: the bits of a class's set."""
    names = [f"w{k}" for k in range(WORDS)]

    def run(batches):
        for b in _pieces(batches):
            words = bits(*shingle_sets(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("node"), *(pa.array(np.ascontiguousarray(words[:, k])) for k in range(WORDS))], ["node", *names])

    return texts.join(nodes.select("node"), "node").select("node", "text").mapInArrow(run, "node binary, " + ", ".join(f"{x} long" for x in names))


def _rest(tables: DataFrame, classes: DataFrame, labels: DataFrame, checked: DataFrame, texts: DataFrame, hold) -> DataFrame:
    """Pairs of a bucket that are in different components, could be linked, and are not checked yet. The tables are deleted.

    Two bounds leave out pairs before they are written. What two classes of different components have in common is at most what
    each shares with other components at all. And of 1,024 bits, at most FAR differ for linked classes (128 +- 10.6 at 0.75, so
    a link fails this with 3e-7). A pair is written in the bucket of the first two half-keys that it shares, so once.
    """
    named = keep(tables.select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    drop(tables)
    mixed = named.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.count("*").alias("n")).where("l <> m").select("key", "n")
    across = keep(join_spread(named, mixed, "key").select("key", "node", "label"))
    drop(named)
    with brief() as inner:
        bounds = _shared(across.select("node", "label").distinct(), texts, inner).join(classes.select("node", "n_shingles", F.sort_array("halves").alias("halves")), "node")
        alone = SHARE * F.col("shared") >= PART * F.col("n_shingles")  # else no partner of any size is similar enough
        bounds = hold(bounds.where(alone))
    left = hold(across.join(bounds.select("node"), "node", "left_semi"))
    drop(across)
    sizes = left.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    left = hold(join_spread(left, sizes, "key").join(bounds.join(_sketched(bounds, texts), "node"), "node"))
    # a bucket is cut into blocks; each pair of blocks is joined by itself
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    left = left.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("n")
    right = left.where("other <= own").select("key", F.col("other").alias("own"), F.col("own").alias("other"), *(F.col(c).alias(f"{c}_") for c in left.columns if c not in ("key", "own", "other")))
    left = left.where("own <= other")
    most = F.least("shared", "shared_")
    could = SHARE * most >= PART * (F.col("n_shingles") + F.col("n_shingles_") - most)
    differ = sum((F.bit_count(F.col(f"w{k}").bitwiseXOR(F.col(f"w{k}_"))) for k in range(1, WORDS)), F.bit_count(F.col("w0").bitwiseXOR(F.col("w0_"))))
    common = F.array_intersect("halves", "halves_")
    once = F.col("key") == F.xxhash64(common[0], common[1])
    met = (F.col("own") < F.col("other")) | (F.col("node") < F.col("node_"))
    pairs = left.join(right, ["key", "own", "other"]).where(met & (F.col("label") != F.col("label_")) & could & (differ <= FAR) & once)
    return pairs.select(*_pair(F.col("node"), F.col("node_"))).distinct().join(checked, ["a", "b"], "left_anti")


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b), a kept table, whose full sets are similar enough. texts: node, text."""

    def run(batches):
        for batch in batches:
            for b in T.slices([batch], "text", 1 << 21):
                one, n = shingle_sets(b.column("text"))
                two, m = shingle_sets(b.column("text_b"))
                value, owner = np.concatenate([one, two]), np.concatenate([np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)])
                order = np.lexsort((value, owner))
                value, owner = value[order], owner[order]
                same = np.bincount(owner[1:][(value[1:] == value[:-1]) & (owner[1:] == owner[:-1])], minlength=len(n)) if len(value) else np.zeros(len(n), int)
                ok = (SHARE * same >= PART * (n + m - same)) & (same > 0)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok))

    both, total = pairs, pairs.count()
    for side, text in (("a", "text"), ("b", "text_b")):
        own = texts.select(F.col("node").alias(side), F.col("text").alias(text))
        both = join_spread(both, own, side, pairs.groupBy(side).agg(F.count("*").alias("n")), MOST_TEXTS, total)
    return both.select("a", "b", "text", "text_b").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, label (the smallest node of its component) for every node that has a link. Each round's tables replace those of the one before."""
    edges = keep(links.select("a", "b").where("a <> b").distinct())
    before, total = None, edges.count()
    for _ in range(max_rounds):
        with brief() as hold:
            both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
            large = hold(join_spread(both, least, "a", total=2 * total).where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct())
            least = large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n"))
            small = join_spread(large, least, "b", total=2 * total)
            old = edges
            edges = keep(small.select(F.col("m").alias("a"), "b").union(small.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
        drop(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, total = now, now[0]
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())


def _texts(docs: DataFrame, tables: DataFrame, classes: DataFrame, hold) -> DataFrame:
    """node and text of the classes in the tables. A sieve of their hashes keeps most other texts out of the shuffle."""
    needed = hold(tables.select("node").distinct().join(classes, "node").select("node", F.col("at.doc_id").alias("id"), F.col("at.hash").alias("hash")))
    own = sifted(docs.select(F.col("doc_id").alias("id_"), F.col("text").alias("text"), _hash().alias("hash_")), "hash_", sieve(needed, "hash"))
    return hold(own.join(needed, (F.col("hash_") == F.col("hash")) & F.col("id_").eqNullSafe(F.col("id"))).groupBy("node").agg(F.first("text").alias("text")))


def _labels(docs: DataFrame, classes: DataFrame, outer) -> DataFrame:
    """node, label of all linked classes, written by `outer`; what leads to it is deleted."""
    with brief() as hold:
        tables = _tables(classes)
        texts = _texts(docs, tables, classes, hold)
        stars = hold(_stars(tables))
        links = hold(confirm(stars, texts))
        first = components(links)
        with brief() as inner:
            pairs = hold(_rest(tables, classes, first, stars, texts, inner))
        more = hold(confirm(pairs, texts))
        return outer(components(links.union(more)))


def _grouped(docs: DataFrame, hold=keep) -> DataFrame:
    """doc_id, hash, n_shingles, component_id, kept, and group (of rows in a group of more than one, else null)."""
    with brief() as full:
        sketched = full(sketches(docs))
        classes = hold(_classes(sketched))
        rows = hold(sketched.drop("halves"))
    labels = _labels(docs, classes, hold)
    first = classes.join(labels, "node", "left").select("node", "first", "copies", F.coalesce("label", "node").alias("label"), F.col("label").isNotNull().alias("linked"))
    smallest = first.where("linked").groupBy("label").agg(F.min("first").alias("component_id"))
    named = first.where("linked or copies > 1").join(smallest, "label", "left").select("node", F.coalesce("component_id", "first").alias("component_id"), F.col("label").alias("group"))
    out = rows.select("doc_id", "hash", "node", "n_shingles").join(named, "node", "left")
    out = out.withColumn("component_id", F.when(F.col("group").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "hash", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "group")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, and hash (of the text) of every document."""
    return _grouped(docs).select("doc_id", "n_shingles", "component_id", "kept", "hash")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each group, with all columns."""
    id_, hash_, stays, n = fresh(docs, "id", "hash", "stays", "n")
    with brief() as hold:
        rows = keep(_grouped(docs, hold).where("group is not null").groupBy("group", "doc_id", "hash", "kept").agg(F.count("*").alias("n")))
    best = rows.where("kept").groupBy("group").agg(F.min("hash").alias("best"))
    marked = keep(rows.join(best, "group").select(F.col("doc_id").alias(id_), F.col("hash").alias(hash_), (F.col("kept") & (F.col("hash") == F.col("best"))).alias(stays), F.col("n").alias(n)))
    drop(rows)
    same = (_hash() == F.col(hash_)) & F.col("doc_id").eqNullSafe(F.col(id_))
    out = docs.join(marked.where(~F.col(stays) | (F.col(n) > 1)), same, "left_anti")
    again = marked.where(F.col(stays) & (F.col(n) > 1))
    if again.isEmpty():
        return out
    every = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    one = docs.join(again, same).groupBy(id_, hash_).agg(F.min_by(every, F.xxhash64(*plain)).alias("row")).select("row.*")
    return out.unionByName(one)
