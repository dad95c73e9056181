"""Weighted rendezvous hashing of stable keys over shards.

Each (key, shard) pair has its own uniform draw u from md5(key # shard); the key goes to the shard with the largest
-weight / ln(u). A shard's share is its weight over all weights, and a new shard only takes keys into itself, because the
draws of the others stay as they were.

Defined cases: a null key counts as the text `\\0`; a null text has size 8 and crc 0; repeated rows go to one shard and get
slots of their own; other columns of the input are not read; a very long text is read once, for its size and
crc, and goes no further; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.llm.common import keep

#: Rows of one shard are numbered in so many parts, so that no task holds a whole shard.
PARTS = 4096
#: Repeated rows are written out in steps of so many.
STEP = 10_000


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 to len(weights) - 1) of a key; ties, which need equal draws, go to the smaller shard."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive, one for each shard")
    text = F.coalesce(key.cast("string"), F.lit("\0"))

    def score(k: int, w: float) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(text, F.lit(f"#{k}")).cast("binary")), 1, 13), 16, 10).cast("double")
        return F.lit(-float(w)) / F.log((bits + 0.5) / F.lit(float(1 << 52)))

    best = F.array_max(F.array(*[F.struct(score(k, w).alias("score"), F.lit(-k).alias("k")) for k, w in enumerate(weights)]))
    return -best["k"]


def _part(columns: Sequence[str], parts: int) -> Column:
    """From md5, so that SQL elsewhere gives the same parts."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % parts).cast("int")


def slots(df: DataFrame, shard: str, order: Sequence[str], parts: int = PARTS) -> DataFrame:
    """Adds `slot`, gapless from 0 in each shard, to rows that are told apart by the columns in `order` alone.

    Equal rows are counted before the shuffle and written out again after it; the counted rows are kept in the shared folder, so
    that the input is read once. Rows are numbered within (shard, part), where
    the part is a hash of the row; a part starts where the parts before it end.
    """
    keys = [shard, *order]
    one = keep(df.select(*keys).groupBy(*keys).agg(F.count("*").alias("copies")).withColumn("part", _part(order, parts)))
    within = Window.partitionBy(shard, "part").orderBy(*order)
    sizes = one.groupBy(shard, "part").agg(F.sum("copies").alias("n"))
    starts = sizes.select(shard, "part", (F.sum("n").over(Window.partitionBy(shard).orderBy("part")) - F.col("n")).alias("start"))
    placed = one.withColumn("before", F.sum("copies").over(within.rowsBetween(Window.unboundedPreceding, -1))).join(starts, [shard, "part"])
    first = placed.withColumn("first", F.col("start") + F.coalesce("before", F.lit(0)))
    steps = first.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(STEP).cast("long"))))
    rows = steps.withColumn("nth", F.explode(F.sequence(F.col("step"), F.least(F.col("step") + STEP - 1, F.col("copies") - 1))))
    return rows.select(*keys, (F.col("first") + F.col("nth")).cast("long").alias("slot"))


def assign_shards(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, size (UTF-8 bytes + 8), text_crc32, law, shard, grown_shard (with the weights `grown`), slot."""
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), weights).cast("int").alias("shard"),
        (rendezvous(F.col(key), grown) if grown else F.lit(None)).cast("int").alias("grown_shard"),
    )
    out = slots(rows, "shard", ["doc_id", "size", "text_crc32", "law", "grown_shard"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
