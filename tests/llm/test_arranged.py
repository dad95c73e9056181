"""Fill-in-middle, manifest and mixing: odd rows, and plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from tesserae.llm import common, fim, manifest, mixing
from tesserae.llm.rope import UNITS, join, rope, split
from tests.llm.test_small import DOCS, prose, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# 11


def balanced(x):
    if x.left is None:
        return 0
    a, b = balanced(x.left), balanced(x.right)
    assert abs(a - b) <= 1 and (x.chars, x.units) == (x.left.chars + x.right.chars, x.left.units + x.right.units)
    return 1 + max(a, b)


@pytest.mark.parametrize("units", UNITS)
def test_ropes_split_and_join_as_strings_do(units):
    rng = random.Random(1)
    for _ in range(300):
        s = "".join(rng.choice("ab \n<é😀") for _ in range(rng.choice([0, 1, 5, 50, 300])))
        x = rope(s, units, rng.choice([1, 2, 3, 7, 64]))
        starts = UNITS[units](s)
        starts = list(range(len(s))) if starts is None else starts.tolist()
        assert str(x) == s and x.units == len(starts) and x.chars == len(s)
        k, c = rng.randint(0, len(starts)), rng.randint(0, len(s))
        cut = starts[k] if k < len(starts) else len(s)
        (a, b), (d, e) = split(x, k), split(x, c, by_chars=True)
        assert (str(a), str(b), a.units, b.units) == (s[:cut], s[cut:], k, len(starts) - k) and (str(d), str(e)) == (s[:c], s[c:])
        j = join(b, e, a, d)
        assert str(j) == s[cut:] + s[c:] + s[:cut] + s[:c]
        for y in (x, a, b, d, e, j):
            balanced(y)


def plain_fim(key, text):
    text, h = text or "", hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, a, b - a, f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}"


def test_fim_odd_rows(spark, docs, empty):
    more = spark.createDataFrame([(300 + k, t) for k, t in enumerate(["a<P>b", "<S", "S>", "<M><", prose(9, 200_000), "日本😀"] * 4)], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(more)
    got = Counter(tuple(r) for r in fim.transform(both).collect())
    assert got == Counter((r.doc_id, *plain_fim(r.doc_id, r.text)) for r in both.collect())
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    told = Counter(tuple(r) for r in fim.digest(both).collect())
    assert told == Counter((r.doc_id, *(x := plain_fim(r.doc_id, r.text))[:4], sha(x[4]), sha(r.text or "")) for r in both.collect())
    assert fim.digest(empty).count() == 0
    named = fim.restore(fim.transform(docs.withColumnRenamed("text", "output"), text="output").withColumnRenamed("n", "restored"))
    assert named.columns.count("restored") == 1 and named.count() == docs.count()


def test_fim_units(spark, docs):
    for units in ("words", "lines"):
        out = fim.restore(fim.transform(docs.where("doc_id between 0 and 9"), units=units, rate=100)).collect()
        texts = {r.doc_id: r.text or "" for r in docs.where("doc_id between 0 and 9").collect()}
        for r in out:
            assert r.restored == texts[r.doc_id]
            if r.form != "plain" and units == "words":
                assert r.n == max(1, len(WORD.findall(texts[r.doc_id])))


# 12


def H(*xs):
    return hashlib.sha256("".join(xs).encode()).hexdigest()


def plain_tree(leaves, fanout=16):
    """Root, and the (left, right) of each leaf level by level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k in range(len(leaves)):
            run = at[k] // fanout
            some = level[run * fanout : run * fanout + fanout]
            paths[k].append(("".join(some[: at[k] % fanout]), "".join(some[at[k] % fanout + 1 :])))
            at[k] = run
        level = [H(*level[k : k + fanout]) for k in range(0, len(level), fanout)]
    return level[0], paths


def plain_manifest(rows):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    lower = lambda t: t and re.sub("[A-Z]", lambda m: m[0].lower(), t)
    leaf = lambda r, t: H(*map(field, (r.doc_id, r.source, r.lang, r.n_chars, t)))
    groups = defaultdict(list)
    for r in rows:
        hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        groups[r.source].append((r.doc_id, leaf(r, r.text), leaf(r, lower(r.text)) if hit else leaf(r, r.text)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = plain_tree([x[1] for x in groups[s]])
    root, above = plain_tree([trees[s][0] for s in names])
    for s, up in zip(names, above, strict=True):
        for (key, own, now), path in zip(groups[s], trees[s][1], strict=True):
            path = path + up
            for a, b in path:
                now = H(a, now, b)
            yield key, own, trees[s][0], root, H(*(a + b for a, b in path)), now, now == root


def test_manifest_odd_rows(spark, docs, empty):
    texts = [(None if k % 50 == 7 else k, None if k % 9 == 0 else f"Text {k} É" + "X" * (k % 4), "en", [None, "b", "a", "é", "b"][k % 5] if k < 700 else f"s{k}", k, 0.5, "x", "y", 1, 2) for k in range(740)]
    more = docs.union(spark.createDataFrame(texts, DOCS)).union(spark.createDataFrame([texts[11]] * 40, DOCS))
    rows = more.collect()
    got = Counter(tuple(r) for r in manifest.verified(more.repartition(5)).collect())
    assert got == Counter(plain_manifest(rows))
    assert {x[-1] for x in got} == {True, False}
    one = docs.where("doc_id = 3")
    (r,) = manifest.verified(one).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root or not r.verified
    assert r.proof_sha256 == H("")
    assert manifest.verified(empty).count() == 0


def test_manifest_fanout(spark):
    df = spark.createDataFrame([(k, f"g{k % 2}") for k in range(21)], "k long, at string").withColumnRenamed("k", "digest")
    out = manifest.manifest(df, fields=("digest",), group="at", key="digest", fanout=3)
    leaf = lambda k: H(f"{len(str(k))}:{k}")
    roots = {g: plain_tree([leaf(k) for k in range(21) if k % 2 == g], 3)[0] for g in (0, 1)}
    assert {(r.digest, r.leaf, r.subroot, r.root) for r in out.collect()} == {(k, leaf(k), roots[k % 2], H(roots[0], roots[1])) for k in range(21)}


# 13


def filled(sizes, weights=(3, 1, 2)):
    """Targets by sharing again and again what is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w, most = {s: weights[k % 3] for k, s in enumerate(names)}, {s: 2 * sizes[s] for s in names}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(most[s] for s in capped)) / sum(w[s] for s in free) if free else 0
        new = {s for s in free if w[s] * level > most[s]}
        if not new:
            return {s: most[s] if s in capped else w[s] * level for s in names}
        capped |= new


def many(spark, seed=0):
    rng = random.Random(seed)
    rows = [(None if k % 100 == 3 else k, None if k % 13 == 0 else prose(k, rng.choice([0, 1, 5, 40, 300])), rng.choice(["a", "a", "a", "b", "c", "é", None])) for k in range(900)]
    rows += [(5000, prose(5, 30_000), "b"), (5001, "x", "tiny"), (5002, None, "none"), (5003, "dup words here", "d")] + [(5003, "dup words here", "d")] * 30
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mixing_reaches_the_targets(spark, docs, empty):
    for df in (many(spark), docs):
        source, sizes = {}, defaultdict(int)
        for r in df.collect():
            sizes[r.source] += len(WORD.findall(r.text or ""))
            source.setdefault(r.doc_id, r.source)
        want, out = filled(sizes), mixing.report(df).collect()
        assert len(out) == df.count() and all(0 <= r.taken <= 2 * r.size for r in out)
        assert sorted(r.size for r in out) == sorted(len(WORD.findall(r.text or "")) for r in df.collect())
        by = {(r.source_size, r.target) for r in out}
        assert {(sizes[s], round(t, 6)) for s, t in want.items()} == by
        taken = defaultdict(int)
        for r in out:
            taken[r.source_size, r.target] += r.taken
        for s, t in want.items():
            assert abs(taken[sizes[s], round(t, 6)] - t) <= max(mixing.BLOCK, t / 200, 1), s
    assert mixing.report(empty).count() == 0


def test_mixing_is_the_same_again(spark):
    df = many(spark, 1)
    one, two = (Counter(tuple(r) for r in mixing.report(d).collect()) for d in (df.repartition(1), df.repartition(7)))
    assert one == two


def test_mixing_schedule_is_even(spark):
    """Slots are gapless per source, no block comes twice in an epoch, and each stretch of the schedule holds its share of each source."""
    rows, plan, mix = mixing.mixed(many(spark, 2))
    plan = {r.src: r for r in plan.collect()}
    slots = defaultdict(set)
    told = mixing.schedule(spark.createDataFrame(list(plan.values()))).collect()
    all_slots = sum(r.slots for r in plan.values())
    assert len(told) == all_slots == len({r.slot for r in told})
    top = 1 << max(1, (all_slots - 1).bit_length())
    for r in told:
        key = (r.epoch, r.block)
        assert key not in slots[r.src] and r.block < plan[r.src].blocks and r.epoch < 2
        slots[r.src].add(key)
    for src, p in plan.items():
        assert len(slots[src]) == p.slots and sum(e == 0 for e, _ in slots[src]) == min(p.slots, p.blocks)
        for cut in (top // 4, top // 2):
            early = sum(r.slot < cut for r in told if r.src == src)
            assert abs(early - p.slots * cut / top) <= 2
    # a block's pieces fill it, and every word stands in one block
    sizes = {r.row: r.size for r in rows.collect()}
    words = defaultdict(set)
    parts = mixing.pieces(rows)
    for r in parts.collect():
        new = set(range(r.offset, r.offset + r.words))
        assert r.words > 0 and not words[r.row] & new
        words[r.row] |= new
    assert all(len(words[k]) == n for k, n in sizes.items())
    per = defaultdict(int)
    for r in parts.collect():
        per[r.src, r.block] += r.words
    for (src, _), n in per.items():
        assert n in (plan[src].source_size // plan[src].blocks, plan[src].source_size // plan[src].blocks + 1) and n <= mixing.BLOCK
    assert {r.slot for r in mix.select("slot").distinct().collect()} == {r.slot for r in told}


def test_no_table_of_slots_or_blocks_goes_through_the_driver(spark):
    """They are exploded from a row for each source, so joins that do not say how would broadcast them, whatever their number."""
    joins = re.compile(r"(\w+Join) \[([^\]]*)\], \[([^\]]*)\]")

    def planned(df):
        plan = re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString()).split("== Initial Plan ==")[0]
        return Counter((m[1], m[2], m[3]) for m in joins.finditer(plan)), plan.count("BroadcastExchange")

    _, plan, mix = mixing.mixed(many(spark, 3))
    slots = Counter({("SortMergeJoin", a, b): 1 for a, b in (("src, part", "g, p"), ("of, part", "g, p"), ("src, nth", "src2, nth2"))})
    told, out = mixing.schedule(plan), mixing.report(many(spark, 3))
    assert planned(told) == (slots, 0)
    for df in (mix, out):
        df.collect()  # a plan that changes as it runs keeps to this
        found, _ = planned(df)
        assert not slots - found and found["SortMergeJoin", "src, block", "src2, block2"] == 1
    assert found["SortMergeJoin", "row", "row2"] == 1
    # what is broadcast has a row for each stretch of the documents, or for each source, and is no larger than it seems
    assert {k for k in found if k[0] == "BroadcastHashJoin"} <= {("BroadcastHashJoin", "src, part", "g, p"), ("BroadcastHashJoin", "src", "src")}


def test_places_do_not_depend_on_stretches(spark, monkeypatch):
    monkeypatch.setattr(common, "STRETCH", 7)
    df = spark.createDataFrame([(k % 5 if k < 60 else 9, f"g{k % 2}") for k in range(100)], "v long, grp string")
    out = common.in_order(df, "grp", [F.col("v")], name="v_", total="n").collect()
    for g in ("g0", "g1"):
        mine = sorted((r["v_"], r["v"]) for r in out if r["grp"] == g)
        assert [k for k, _ in mine] == list(range(50)) and [v for _, v in mine] == sorted(v for _, v in mine)
        assert all(r["n"] == 50 for r in out)


def test_a_sieve_lets_all_its_keys_through(spark):
    keys = spark.range(0, 3000, 7).select((F.col("id") * 1_000_003).alias("k"))
    df = spark.range(3000).select((F.col("id") * 1_000_003).alias("k"), F.col("id").alias("nth"), F.lit(1).alias("bits"))
    out = common.sifted(df, "k", common.sieve(keys, "k"))
    assert out.columns == df.columns
    got = {r.nth for r in out.collect()}
    assert set(range(0, 3000, 7)) <= got and len(got) < 3000 / 7 + 10
    assert common.sifted(df, "k", common.sieve(keys.limit(0), "k")).count() == 0
