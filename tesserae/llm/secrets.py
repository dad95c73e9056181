"""Secret scans with linking of multipart credentials, by DataFrame functions alone.

Base kinds are reported wherever they match: `assign` (a value given to password, token and the like), `access` (an access key
identifier) and `hex` (a long run of hexadecimal digits). Other parts are weak on their own: an identifier given by name
(user, client_id, login, ...), a candidate secret (a value given to pwd, auth, ... or a long mixed token that is no base
match), and an endpoint (URL or address with port). An interval join within a document links parts that start at most SCOPE
code points apart, and weak parts are reported only when their complements are there:

- `link_id`: an identifier with a secret (candidate, assign or hex) in scope;
- `link_secret`: a candidate with an identifier (named or access) in scope;
- `link_endpoint`: an endpoint with an identifier and a secret in scope.

Positions are code points, the end exclusive. Matches of a kind are leftmost and do not overlap; they are found as what
stands between the pieces of a split, so one pass gives all positions. Parts are equi-joined by document and by stretches of
SCOPE code points with a semi-join, so no pairs are written, and a stretch holds few parts, since parts of a kind don't overlap.

Defined cases: a null text counts as empty and has no spans; documents are told apart by id (null allowed) and text, and
repeated rows get the same spans; an empty table gives an empty one; a very long text is one row as any other, whose parts are joined
by stretches; spans that start together stand in the order of the kinds; columns other than doc_id and text are not read, and
redact() passes them through, whatever they are named.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.llm.common import fresh, keep

SCOPE = 200
MASK = "[SECRET]"
BASE, LINKED = ("assign", "access", "hex"), ("link_id", "link_secret", "link_endpoint")
KINDS = BASE + LINKED


def any_case(words: str) -> str:
    """A pattern with each ASCII letter in either case."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else c for c in words)


_GIVEN = r"""["']?\x20*[:=]\x20*["']?"""
#: kind: (pattern, group that must have a length, that length). Both Java and RE2 read these alike.
PATTERNS = {
    "assign": (f"({any_case('password|passwd|secret|token|api_?key')}){_GIVEN}([A-Za-z0-9+/_.=-]+)", 2, 8),
    "access": ("AKIA[A-Z0-9]+", 0, 16),
    "hex": ("[0-9a-f]+", 0, 32),
    "id": (f"({any_case('user_?name|user_?id|user|login|account|client_?id|access_?key_?id')}){_GIVEN}([A-Za-z0-9_.@+-]+)", 2, 3),
    "named": (f"({any_case('pwd|passphrase|auth|credential|private_?key|signature')}){_GIVEN}([A-Za-z0-9+/_.=-]+)", 2, 6),
    "mixed": ("[A-Za-z0-9+/_=-]+", 0, 20),
    "endpoint": (r"""[A-Za-z][A-Za-z0-9+.-]*://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+:[0-9]+""", 0, 9),
}
#: The same matches as the patterns' that are long enough, or all of them where shorter ones matter, found faster.
_SEARCH = {"access": "AKIA[A-Z0-9]{12,}", "hex": "[0-9a-f]{32,}", "mixed": "[A-Za-z0-9+/_=-]{20,}"}


def _hits(text: Column, kind: str) -> Column:
    """Each match: gap (code points since the last match's end), size, and ok (whether it is long enough)."""
    pattern, group, least = PATTERNS[kind]
    search = _SEARCH.get(kind, pattern)
    found = F.regexp_extract_all(text, F.lit(search), F.lit(0))
    ok = lambda m: F.length(F.regexp_extract(m, pattern, group)) >= least
    if kind == "mixed":
        ok = lambda m: m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]")
    gaps = F.transform(F.slice(F.split(text, search, -1), F.lit(1), F.size(found)), F.length)
    return F.zip_with(gaps, found, lambda g, m: F.struct(g.cast("int").alias("gap"), F.length(m).cast("int").alias("size"), ok(m).alias("ok")))


_HITS = "array<struct<gap:int,size:int,ok:boolean>>"


def _key(docs: DataFrame) -> Column:
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64(F.coalesce("text", F.lit(""))), F.length(F.coalesce("text", F.lit(""))))


def _scan(docs: DataFrame) -> DataFrame:
    """doc_id, key and the matches of each kind; weak kinds are looked for only where there is an identifier."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(_HITS)
    when = lambda test, kind: F.when(test, _hits(text, kind)).otherwise(none).alias(kind)
    named = text.rlike(PATTERNS["id"][0])
    some = named | text.contains("AKIA")
    found = [when(text.rlike(PATTERNS["assign"][0]), "assign"), when(text.contains("AKIA"), "access"), when(text.rlike(_SEARCH["hex"]), "hex"), when(named, "id"), *(when(some, k) for k in ("named", "mixed", "endpoint"))]
    return docs.select("doc_id", _key(docs).alias("key"), *found)


def _parts(scan: DataFrame) -> DataFrame:
    """key, kind, start, stop of all matches that are long enough, once for each document."""
    some = scan.where(reduce(lambda a, b: a | b, (F.size(k) > 0 for k in PATTERNS))).dropDuplicates(["key"])
    kinds = some.select("key", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("hits")) for k in PATTERNS))).alias("x"))
    hits = kinds.select("key", "x.kind", F.posexplode("x.hits").alias("nth", "hit"))
    w = Window.partitionBy("key", "kind").orderBy("nth")
    stop = F.sum(F.col("hit.gap") + F.col("hit.size")).over(w)
    return hits.withColumn("stop", stop).where("hit.ok").select("key", "kind", (F.col("stop") - F.col("hit.size")).alias("start"), "stop")


def _near(parts: DataFrame, others: DataFrame) -> DataFrame:
    """Parts that have one of the others in scope."""
    left = parts.withColumn("stretch", F.floor(F.col("start") / SCOPE))
    around = others.select(F.col("key").alias("k"), F.col("start").alias("s"), F.explode(F.array(*(F.floor(F.col("start") / SCOPE) + d for d in (-1, 0, 1)))).alias("b"))
    return left.join(around, (left.key == around.k) & (left.stretch == around.b) & (F.abs(left.start - around.s) <= SCOPE), "left_semi").drop("stretch")


def _found(parts: DataFrame) -> DataFrame:
    """key, kind, start, stop of all spans to report."""
    of = lambda *kinds: parts.where(F.col("kind").isin(*kinds))
    as_kind = lambda df, kind: df.select("key", F.lit(kind).alias("kind"), "start", "stop")
    base = of(*BASE)
    ends = base.select(F.col("key").alias("k"), F.col("stop").alias("s")).distinct()
    named = of("named")
    ends = ends.union(named.select("key", "stop"))
    mixed = of("mixed")
    mixed = mixed.join(ends, (mixed.key == ends.k) & (mixed.stop == ends.s), "left_anti")
    weak = named.unionByName(mixed)
    ids, secrets = of("id", "access"), weak.unionByName(of("assign", "hex"))
    return reduce(DataFrame.unionByName, (base, as_kind(_near(of("id"), secrets), LINKED[0]), as_kind(_near(weak, ids), LINKED[1]), as_kind(_near(_near(of("endpoint"), ids), secrets), LINKED[2])))


def find(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The scanned documents (doc_id, key), and the spans (key, kind, start, stop)."""
    scan = keep(_scan(docs))
    return scan.select("doc_id", "key"), keep(_found(keep(_parts(scan))))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    rows, spans = find(docs)
    order = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind"))
    one = F.struct("start", order.alias("order"), "stop", "kind")
    n = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE]
    per = spans.groupBy("key").agg(*n, F.array_sort(F.collect_list(one)).alias("all"))
    written = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    out = rows.join(per, "key", "left")
    all_ = F.coalesce("all", F.array().cast(per.schema["all"].dataType))
    base = F.filter(all_, lambda x: x["order"] <= len(BASE))
    return out.select("doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(all_).alias("spans"))


def redact(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """The documents with all reported spans masked, overlapping ones as one; n_chars, if there, is counted anew."""
    _, spans = find(docs)
    w = Window.partitionBy("key").orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    kept = spans.withColumn("from", F.coalesce(reach, F.lit(0))).where("start >= from or from = 0")
    # kept: a piece of text ends where a span starts that no earlier span covers; the last piece starts behind all spans
    pieces = kept.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("from", (F.col("start") - F.col("from")).alias("size")))).alias("pieces"))
    last = spans.groupBy("key").agg(F.max("stop").alias("last"))
    # adjacent spans give an empty piece, which would write two masks; that is one mask for each credential
    own, key, cut, end = fresh(docs, "own", "key", "cut", "end")
    cuts = pieces.join(last, "key").select(F.col("key").alias(key), F.col("pieces").alias(cut), F.col("last").alias(end))
    text = F.col("text")
    tail = F.substring(text, F.col(end) + 1, F.length(text))
    new = F.concat(F.array_join(F.transform(cut, lambda p: F.substring(text, p["from"] + 1, p["size"])), mask), F.lit(mask), tail)
    rows = docs.withColumn(own, _key(docs)).join(cuts, F.col(own) == F.col(key), "left")
    changed = F.col(end).isNotNull()
    out = rows.withColumn("text", F.when(changed, new).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(own, key, cut, end)
