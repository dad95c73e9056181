"""Documents to training tokens: quality, near-duplicates, benchmark passages, secrets, SentencePiece.

Each stage works on all that the one before kept. The first three drop documents, the fourth masks spans of texts, and the last
gives doc_id, n_tokens and ids. Models are learned here, from labels, and never from what a stage is to judge of held-out rows.

Defined cases: a null or empty text passes all stages but the first, which scores it like any other, and has no ids; a very long
text is worked on whole; of repeated rows and other copies one stays (documents without words are no copies of each other); of
equally good copies the one with the smallest id, then with the smallest hash of its text stays; empty tables give empty ones;
without labels of both kinds all documents have one score, the share of label 1 (0.5 without any label); without benchmark items the
third stage keeps all; columns with any other names pass through all stages but the last, which drops them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import decontam, neardup, quality, secrets, spiece
from tesserae.llm.common import keep, table
from tesserae.llm.queries import PIECES


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accept(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ids = spiece.encode(docs.select("doc_id", "text"), spiece.Segmenter(spiece.load(PIECES)))
    return ids.select("doc_id", F.size("ids").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good),
    ("neardup", distinct),
    ("decontam", clean),
    ("secrets", masked),
    ("sentencepiece", encoded),
]

#: Learned models, minimum hashes and alignments have no SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else keep(docs), sf_dir)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
