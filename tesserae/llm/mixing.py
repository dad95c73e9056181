"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions alone.

Targets: sources share BUDGET times all words by weight; a target stops at EPOCHS times its source's words, and the excess is shared
again by weight among the others until none is above.

Schedule: the documents of a source, shuffled by hash, are one run of words that is cut into blocks of equal length (BLOCK words at
most, FINE blocks at least). A source gets as many slots as bring its words next to its target. Slot i of 2^m has the van der Corput
point bitreverse(i) / 2^m, and belongs to the source in whose stretch of cumulated slots over 2^m the point lies; points behind the
last stretch are left out. As the points are a permutation of all multiples of 2^-m, each source gets exactly its slots, evenly
spread over any part of the schedule. The permutation is its own inverse, so the map is run from the stretches to the slots, which
needs no range join. A source's slots, ranked, join its blocks in an order shuffled anew for each epoch.

No task holds a source: ranks and sums run over hash parts or stretches of an order. Slots and blocks are exploded from a row for each
source, so their estimated size is that of a few rows; their joins name their method, and none of them is broadcast through the driver.

Defined cases: a null or empty text has no words and is taken 0 times; a source whose texts have no words has target 0; a null source
is a source of its own, the last one; repeated rows and null ids are rows of their own; documents that hash alike stand by id, size
and hash of the text; an empty table gives no rows; a very long text is cut by blocks like any other; other columns of the input are not
read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import before, in_order, join_spread, keep

WEIGHTS = (3, 1, 2)
BUDGET, EPOCHS = 1.5, 2
BLOCK, FINE = 256, 256
SEED = 42
#: Slots are written out in steps of so many, dealt over the tasks.
STEP = 4096
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """row, doc_id, src (source behind a mark, so that it is never null; null last), size in words, h; written once."""
    src = F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit("-"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    h = F.md5(F.concat(F.lit(f"{SEED}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).cast("binary"))
    rows = docs.select("doc_id", src.alias("src"), size.alias("size"), h.alias("h"), F.xxhash64("text").alias("t"))
    return keep(rows.withColumn("row", F.monotonically_increasing_id()))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """Adds ordinal, weight and target to sources (src, source_size). Only sums reach the driver; each round caps one source more at least."""
    named = in_order(sources, "all", [F.col("src") == "-", F.col("src")], name="ordinal").drop("total")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("ordinal") % len(weights) + 1).cast("int"))
    rows = keep(named.select("src", "n", "source_size", "ordinal", weight.alias("weight"), (F.lit(float(epochs)) * F.col("source_size")).alias("most")))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        above = F.col("weight") * level >= F.col("most")
        n, full, free = rows.agg(F.count_if(above), F.sum(F.when(above, F.col("most")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        if n == capped or not free:
            break
        capped, level = n, (budget * total - full) / free
    return rows.withColumn("target", F.least(F.col("most"), F.col("weight") * level))


def _blocks(size: Column, block: int, fine: int) -> Column:
    """How many blocks a source of so many words has."""
    return F.greatest(F.ceil(size / block), F.least(size, F.lit(fine))).cast("long")


def planned(sources: DataFrame, block: int = BLOCK, fine: int = FINE) -> DataFrame:
    """Adds to the sources of targets(): blocks, slots, and the place of the source's first slot among all; written once."""
    rows = sources.withColumn("blocks", _blocks(F.col("source_size"), block, fine))
    slots = F.floor(F.col("target") * F.col("blocks") / F.greatest("source_size", F.lit(1)) + 0.5).cast("long")
    rows = rows.withColumns({"slots": slots, "all": F.lit(0), "part": F.floor(F.col("ordinal") / 4096)})
    return keep(before(rows, "all", "part", [F.col("ordinal")], F.col("slots"), name="first", total="all_slots").drop("all", "part"))


def _steps(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(STEP).cast("long")))


def _each(rows: DataFrame, n: str, name: str) -> DataFrame:
    """Rows repeated n times, numbered from 0; rows with very many are dealt over tasks."""
    steps = rows.where(F.col(n) > 0).withColumn("step", _steps(F.col(n))).repartition("src", "step")
    return steps.withColumn(name, F.explode(F.sequence(F.col("step"), F.least(F.col("step") + STEP, F.col(n)) - 1))).drop("step")


def schedule(plan: DataFrame) -> DataFrame:
    """slot, src, epoch, block of all slots of the mix."""
    most = plan.agg(F.max("all_slots")).first()[0] or 0
    bits = max(1, (most - 1).bit_length()) if most else 1
    slot = F.conv(F.reverse(F.lpad(F.bin(F.col("first") + F.col("place")), bits, "0")), 2, 10).cast("long")
    slots = _each(plan.select("src", "first", "slots", "blocks"), "slots", "place").select("src", "blocks", slot.alias("slot"))
    # 4,096 stretches of the schedule, over which each source is spread evenly
    slots = before(slots.withColumn("part", F.shiftright("slot", max(0, bits - 12))), "src", "part", [F.col("slot")], name="nth", merge=True)
    per = _each(plan.select("src", "blocks"), "blocks", "block").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(EPOCHS).cast("long") - 1)))
    h = F.md5(F.concat_ws("-", F.lit(SEED), "src", "epoch", "block").cast("binary"))
    per = per.withColumns({"h": h, "part": F.substring(h, 1, 3), "of": F.concat_ws("-", "epoch", "src")})
    shuffled = before(per, "of", "part", [F.col("h"), F.col("block")], name="rank", merge=True)
    shuffled = shuffled.select(F.col("src").alias("src2"), "epoch", "block", (F.col("epoch") * F.col("blocks") + F.col("rank")).alias("nth2"))
    return slots.join(shuffled.hint("merge"), (F.col("src") == F.col("src2")) & (F.col("nth") == F.col("nth2"))).select("slot", "src", "epoch", "block")


def pieces(rows: DataFrame, block: int = BLOCK, fine: int = FINE) -> DataFrame:
    """src, block, row, offset (words of the document before the piece), words: what each block holds of each document.

    The first `longer` blocks of a source have one word more than the others.
    """
    order = [F.col("h"), F.col("doc_id"), F.col("size"), F.col("t")]
    x = in_order(rows.where("size > 0"), "src", order, F.col("size"), name="start", total="source_size")
    x = x.withColumn("blocks", _blocks(F.col("source_size"), block, fine)).withColumns({"least": F.expr("source_size div blocks"), "longer": F.expr("source_size % blocks")})
    block_of = lambda p: F.expr(f"CASE WHEN {p} < longer * (least + 1) THEN ({p}) div (least + 1) ELSE longer + ({p} - longer * (least + 1)) div least END")
    edge = lambda b: b * F.col("least") + F.least(b, F.col("longer"))
    x = x.withColumn("block", F.explode(F.sequence(block_of("start"), block_of("start + size - 1"))))
    a, b = F.greatest("start", edge(F.col("block"))), F.least(F.col("start") + F.col("size"), edge(F.col("block") + 1))
    return x.select("src", "block", "row", (a - F.col("start")).alias("offset"), (b - a).alias("words"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents (row, doc_id, src, size), the plan of the sources, and the mix: slot, epoch, row, offset, words.

    The mix in the order of (slot, row's place) is the training order; a document's words from `offset` on stand in the slot.
    """
    rows = sized(docs)
    sources = rows.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).withColumn("all", F.lit(0))
    plan = planned(targets(keep(sources), weights, budget), block)
    parts = pieces(rows, block).withColumnsRenamed({"src": "src2", "block": "block2"})
    mix = schedule(plan).join(parts.hint("merge"), (F.col("src") == F.col("src2")) & (F.col("block") == F.col("block2"))).select("slot", "epoch", "row", "offset", "words")
    return rows, plan, mix


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    rows, plan, mix = mixed(docs)
    taken = mix.groupBy(F.col("row").alias("row2")).agg(F.sum("words").alias("taken"))
    out = rows.select("row", "doc_id", "src", "size").join(taken.hint("merge"), F.col("row") == F.col("row2"), "left")
    of = plan.select("src", "n", "source_size", F.round("target", 6).alias("target"))
    out = join_spread(out, of, "src", total=plan.agg(F.sum("n")).first()[0] or 0)
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
