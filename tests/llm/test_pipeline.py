"""The pipeline on small tables, held against plain versions of its stages."""

import random
import re

import sentencepiece

import corpus_pipeline
from tesserae.llm import quality
from tesserae.llm.queries import PIECES
from tests.llm.test_small import edited, plain_align, plain_base, plain_components, prose

WORD = re.compile(r"[0-9a-z]+")


def junk(seed):
    rng = random.Random(seed)
    return " ".join(w + rng.choice(("$$$", "###", "&&&")) for w in prose(seed, 60).split())


def tables(spark, root):
    item = prose(900, 40)
    docs = [(k, prose(k, 60)) for k in range(60)] + [(100 + k, junk(k)) for k in range(40)]
    docs += [(200 + k, edited(prose(5, 60), k, 1)) for k in range(3)] + [(210, prose(6, 60)), (220, prose(7, 30) + " " + item + " " + prose(8, 30)), (221, edited(item, 3, 5))]
    docs += [(230, "key " + prose(9, 40) + ' token = "0123456789abcdef0123456789abcdef01234567" ' + prose(10, 20)), (240, None), (241, "")]
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(k, int(not 100 <= k < 140), 0) for k, _ in docs], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return docs, item


def masked(text):
    """Base spans, overlapping ones as one; these texts have no linked ones."""
    spans = sorted(tuple(map(int, x.split(":")[1:])) for x in plain_base(text).split(",") if x)
    out, last = [], 0
    for a, b in spans:
        if a >= last:
            out.append(text[last:a])
        last = max(last, b)
    return "[SECRET]".join([*out, text[last:]]) if spans else text


def test_run_is_the_plain_stages(spark, tmp_path):
    docs, item = tables(spark, str(tmp_path))
    table = lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet")
    good = {r.doc_id for r in quality.classify(table("documents"), table("labels")).collect() if r.predicted}
    assert {k for k in range(60)} <= good and not good & set(range(100, 140))
    left = [(k, t) for k, t in docs if k in good]
    smallest = {k: c for (k, _, c) in plain_components(left)}
    left = [(k, t) for k, t in left if smallest[k] == k]
    assert {200, 201, 202, 210}.isdisjoint(k for k, _ in left)
    words = lambda t: WORD.findall((t or "").lower())
    left = [(k, t) for k, t in left if plain_align(words(item), words(t)) < len(words(item))]
    assert {220, 221}.isdisjoint(k for k, _ in left) and 230 in dict(left)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = {k: library.encode(masked(t or "")) for k, t in left}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want


def test_stages_keep_the_columns(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0
