"""Fill-in-middle: texts cut at two unit ranks and rearranged with sentinels between the parts, by splitting and joining ropes.

The ranks, and whether and how a text is rearranged, follow from sha256 of `seed:key`, so reruns and partitions do not matter:
with n units the cuts are the smaller and the larger of h1 % (n + 1) and h2 % (n + 1). `psm` writes prefix, suffix, middle; `spm`
suffix, prefix, middle; `plain` leaves the text as it is. restore() finds the sentinels of the form and joins the parts in their old
order. A text that contains a sentinel stays plain, so the sentinels found are the ones written.

Defined cases: a null text counts as empty; an empty one is plain with n = 0; a null key counts as empty in the hash; repeated rows
give equal rows; an empty table gives an empty one; a very long text is one rope like any other, worked on whole; other columns of
the input are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.rope import Rope, join, rope, split
from tesserae.llm.text import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts, those rearranged, and of a hundred of these, those with the suffix first.
RATE, SUFFIX_FIRST = 90, 20


def draws(key: object, seed: int) -> list[int]:
    """Four unsigned 32-bit numbers of a key."""
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(h[k : k + 8], 16) for k in range(0, 32, 8)]


def rearranged(text: str, key: object, units: str = "chars", seed: int = 1, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """n units, form, code points of prefix and middle (None if plain), and the new text."""
    x, (h1, h2, h3, h4) = rope(text, units), draws(key, seed)
    if not text or h3 % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return x.units, "plain", None, None, text
    a, b = sorted((h1 % (x.units + 1), h2 % (x.units + 1)))
    prefix, rest = split(x, a)
    middle, suffix = split(rest, b - a)
    p, s, m = (Rope(mark) for mark in (PREFIX, SUFFIX, MIDDLE))
    form = "spm" if h4 % 100 < suffix_first else "psm"
    parts = (s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle)
    return x.units, form, prefix.chars, middle.chars, str(join(*parts))


def restored(output: str, form: str) -> str:
    """The text before rearranged()."""
    if form == "plain":
        return output
    one, two = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    at = output.find(two, len(one))
    last = output.find(MIDDLE, at + len(two))
    head, middle = split(rope(output), last, by_chars=True)
    head, second = split(head, at, by_chars=True)
    first, second, middle = (split(part, len(mark), by_chars=True)[1] for part, mark in ((head, one), (second, two), (middle, MIDDLE)))
    prefix, suffix = (second, first) if form == "spm" else (first, second)
    return str(join(prefix, middle, suffix))


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", units: str = "chars", seed: int = 1, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """key, n (units), form, prefix_chars, middle_chars, output of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices([batch], "text"):
                rows = [rearranged(t or "", k, units, seed, rate, suffix_first) for k, t in zip(b.column("k").to_pylist(), b.column("text").to_pylist(), strict=True)]
                n, form, prefix, middle, output = zip(*rows, strict=True)
                kinds = ((n, pa.int64()), (form, pa.string()), (prefix, pa.int64()), (middle, pa.int64()), (output, pa.string()))
                yield pa.RecordBatch.from_arrays([b.column("k"), *(pa.array(v, t) for v, t in kinds)], ["k", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"k {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("k", key)


def restore(outputs: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """Adds `restored`, the text rebuilt from output and form alone; other columns pass through."""
    if "restored" in outputs.columns:
        outputs = outputs.drop("restored")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices([batch], output):
                new = [restored(t or "", f) for t, f in zip(b.column(output).to_pylist(), b.column(form).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], [*b.schema.names, "restored"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in outputs.schema)
    return outputs.mapInArrow(run, f"{schema}, restored string")


def digest(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, with code points for units."""
    out = restore(transform(docs, seed=seed))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output"), sha("restored"))
