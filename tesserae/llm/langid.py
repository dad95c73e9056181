"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds the vectors of its letters, permuted by their place:
p(p(a)) * p(b) * c, with p a rotation by one. A text's vector bundles (adds) those of its trigrams; a language's prototype
bundles those of its training texts. The language with the largest cosine to the text's vector wins; ties go to the name
that sorts first. Runs of other characters count as one separator, which also stands before and after a text.

Trigrams are counted per task and language before the shuffle, and prototypes are sums of counts times trigram vectors, so no
task holds a language's texts. The prototypes (languages x dims) are all that the driver sees and that is broadcast: LANGS languages at
most (64 MB); more of them stop the job before any prototype is made.

Defined cases: `und` with score 0 if the text is null or has no letter, or if nothing was learned; a null key counts as held
out; rows without a language are not learned from; repeated rows are learned from as often as they occur and get equal rows; an empty table
gives no rows; a very long text is worked on whole, as a slice of its own; other columns are not read.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import text as T
from tesserae.llm.common import fold

DIMS = 1024
#: Languages whose prototypes are broadcast, at most.
LANGS = 8192
#: Texts whose vectors are made at once.
GROUP = 64


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else 0."""
    return np.fromiter((k if chr(k).isalpha() else 0 for k in range(sys.maxunicode + 1)), np.int64, sys.maxunicode + 1)


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(x) for x in texts], np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), lengths


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of each trigram's text, and the trigram (three letters or separators of 21 bits each)."""
    lower = ["" if x is None else x.lower() for x in texts.to_pylist()]
    points, length = _code_points([f" {x} " for x in lower])
    doc = np.repeat(np.arange(len(lower)), length)
    letter = _letters()[points]
    use = (letter > 0) | np.append(True, (letter[:-1] > 0) | (doc[1:] != doc[:-1]))[: len(letter)]
    letter, doc = letter[use], doc[use]
    some = np.bincount(doc[letter > 0], minlength=len(lower)) > 0
    ok = (doc[2:] == doc[:-2]) & some[doc[2:]] if len(doc) > 2 else np.zeros(0, bool)
    return doc[2:][ok], ((letter[:-2] << 42) | (letter[1:-1] << 21) | letter[2:])[ok]


@lru_cache(maxsize=20_000)
def _letter(point: int, dims: int) -> np.ndarray:
    return np.random.default_rng([20_011, point]).integers(0, 2, dims).astype(np.float32) * 2 - 1


def vectors(grams: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """The vectors of trigrams, one in a row."""
    out = np.ones((len(grams), dims), np.float32)
    for place in range(3):
        points, which = np.unique((grams >> (21 * place)) & 0x1FFFFF, return_inverse=True)
        if len(points):
            out *= np.stack([np.roll(_letter(int(p), dims), place) for p in points])[which]
    return out


def _counted(batches):
    """(lang, gram, n) of each slice."""
    for b in T.slices(batches, "text"):
        code, langs = T.codes(b.column("lang"))
        doc, gram = trigrams(b.column("text"))
        kinds, which = np.unique(gram, return_inverse=True)
        pair, n = np.unique(code[doc] * max(len(kinds), 1) + which, return_counts=True)
        if len(pair):
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(pair // len(kinds))), pa.array(kinds[pair % len(kinds)]), pa.array(n)], ["lang", "gram", "n"])


def prototypes(docs: DataFrame, dims: int = DIMS, lang: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages in order of name, and their prototypes."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    n = rows.select("lang").distinct().limit(LANGS + 1).count()
    if n > LANGS:
        raise ValueError(f"more than {LANGS} languages to learn")
    counts = rows.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))

    def bundle(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            code, langs = T.codes(b.column("lang"))
            gram, n = b.column("gram").to_numpy(), b.column("n").to_numpy()
            for k, name in enumerate(langs.to_pylist()):
                own = np.flatnonzero(code == k)
                for part in np.array_split(own, len(own) // 4096 + 1):
                    total[name] = total.get(name, 0) + n[part].astype(np.float64) @ vectors(gram[part], dims).astype(np.float64)
        for name, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dims), pa.array(np.arange(dims)), pa.array(v)], ["lang", "dim", "v"])

    rows = counts.mapInArrow(bundle, "lang string, dim long, v double").groupBy("lang", "dim").agg(F.sum("v").alias("v")).toPandas()
    names = sorted(set(rows["lang"]))
    place = {name: k for k, name in enumerate(names)}
    out = np.zeros((len(names), dims))
    out[rows["lang"].map(place).to_numpy(int), rows["dim"].to_numpy(int)] = rows["v"]
    return names, out


def cosines(texts: pa.Array, protos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cosine of each text with each prototype, and which texts have letters."""
    n, dims = len(texts), protos.shape[1]
    doc, gram = trigrams(texts)
    unit = (protos / np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    out = np.zeros((n, len(protos)))
    start = np.searchsorted(doc, np.arange(0, n + GROUP, GROUP))
    for k in range(0, n, GROUP):
        a, b = start[k // GROUP], start[k // GROUP + 1]
        kinds, which = np.unique(gram[a:b], return_inverse=True)
        m = min(GROUP, n - k)
        bundled = np.zeros((m, dims), np.float32)
        for c in range(0, len(kinds), 8192):
            own = (which >= c) & (which < c + 8192)
            here = min(8192, len(kinds) - c)
            counts = np.bincount((doc[a:b][own] - k) * here + which[own] - c, minlength=m * here).reshape(m, here).astype(np.float32)
            bundled += counts @ vectors(kinds[c : c + 8192], dims)
        out[k : k + m] = (bundled @ unit.T) / np.maximum(np.linalg.norm(bundled, axis=1, keepdims=True), 1e-12)
    return out, np.bincount(doc, minlength=n) > 0


def identify(docs: DataFrame, names: list[str], protos: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score, the cosine (0 if negative)."""
    shared = docs.sparkSession.sparkContext.broadcast((np.array(names, dtype=object), protos))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        names, protos = shared.value
        for b in T.slices(batches, "text"):
            if len(names):
                cos, some = cosines(b.column("text"), protos)
                lang, score = np.where(some, names[cos.argmax(1)], "und"), np.where(some, np.clip(cos.max(1), 0, 1), 0.0)
            else:
                lang, score = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang.tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify_all(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; the held-out fold's texts and languages are not learned from."""
    held_out = F.coalesce(fold("doc_id", folds) == held, F.lit(True))
    names, protos = prototypes(docs.where(~held_out))
    return identify(docs, names, protos).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
