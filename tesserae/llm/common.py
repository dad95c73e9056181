"""Reading tables, folds, and tables written to the folder that the cluster shares."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.sources.scratch import clear, drop, keep, shared_dir

__all__ = ["before", "brief", "clear", "fold", "fresh", "in_order", "join_spread", "keep", "shared_dir", "sieve", "sifted", "table"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column | str, n: int) -> Column:
    """crc32 of the key as text, modulo n; null for a null key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as keep it apart from all columns of df (in either case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


@contextmanager
def brief() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A keep() whose tables are deleted at the end of the block."""
    tables: list[DataFrame] = []

    def hold(df: DataFrame) -> DataFrame:
        tables.append(keep(df))
        return tables[-1]

    yield hold
    drop(*tables)


#: Bits of a sieve, and of one of its rows.
SIEVE, ROW = 1 << 26, 1 << 15


def sieve(keys: DataFrame, key: str) -> DataFrame:
    """A bitmap of the keys' hashes, SIEVE bits (8 MB) whatever their number, in rows (nth, bitmap) that are there if they have a bit."""
    h = F.pmod(F.xxhash64(key), F.lit(SIEVE))
    return keys.select(F.floor(h / ROW).cast("int").alias("nth"), (h % ROW).alias("bit")).groupBy("nth").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def sifted(df: DataFrame, key: str, bitmap: DataFrame) -> DataFrame:
    """df without rows whose key is not in the sieve: all that are left out match none of its keys. It is for what comes before a shuffle."""
    nth, bits, h = fresh(df, "nth", "bits", "h")
    rows = df.withColumn(h, F.pmod(F.xxhash64(key), F.lit(SIEVE)))
    rows = rows.join(F.broadcast(bitmap.select(F.col("nth").alias(nth), F.col("bitmap").alias(bits))), F.floor(F.col(h) / ROW).cast("int") == F.col(nth))
    place = (F.col(h) % ROW).cast("int")
    byte = F.conv(F.hex(F.expr(f"substring({bits}, cast(({h} % {ROW}) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return rows.where(F.getbit(byte, place % 8) == 1).select(*df.columns)


#: Rows of one key that join_spread() gives to one task, and keys at most that have more.
MOST, HOT = 1 << 16, 100_000


def join_spread(many: DataFrame, one: DataFrame, key: str, counts: DataFrame | None = None, most: int = MOST, total: int | None = None) -> DataFrame:
    """many joined with one (a row for each key), where no task gets the rows of a hot key whole.

    counts: key, and n rows of `many` (None: one has n); total: of rows of `many`, at least (None: counted). Rows of a hot key are dealt
    over as many tasks as it needs, and its row of `one` is repeated for each. What is broadcast are the hot keys: a key is hot with
    more than `most` rows, and with more than a HOT-th of all rows, so there are fewer than HOT.
    """
    total = many.count() if total is None else total
    most = max(most, math.ceil(total / HOT))
    if total <= most:
        return many.join(one, key)
    # written, so that counting does not cost another shuffle of `many`
    counts = keep(one if counts is None else counts)
    one = counts if "n" in one.columns else one
    if (counts.agg(F.max("n")).first()[0] or 0) <= most:
        return many.join(one, key)
    parts, salt = fresh(many.join(one, key), "parts", "salt")
    hot = F.broadcast(counts.where(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("int").alias(parts)))
    rest = [F.col(c) for c in many.columns if c != key]
    left = many.join(hot, key, "left").withColumn(salt, F.pmod(F.xxhash64(*rest), F.coalesce(parts, F.lit(1))).cast("int"))
    right = one.join(hot, key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1)))
    return left.drop(parts).join(right.drop(parts), [key, salt]).drop(salt)


def before(df: DataFrame, group: str, part: str, order: list[Column], value: Column | None = None, name: str = "nth", total: str = "total", merge: bool = False) -> DataFrame:
    """Adds, for each row, the sum of the value (None: 1, so the rank from 0) over the rows before it in its group, and the group's sum.

    Parts of a group stand one behind the other in their own order and are summed up by themselves, so no task holds a group, but a
    row for each of its parts. Neither group nor part may be null. merge: the parts' sums are not broadcast, for rows exploded from
    few, whose estimated size says nothing of their number.
    """
    value = F.lit(1).cast("long") if value is None else value
    own, start, g, p = fresh(df, "own", "start", "g", "p")
    sums = df.groupBy(F.col(group).alias(g), F.col(part).alias(p)).agg(F.sum(value).alias(own))
    all_parts = Window.partitionBy(g)
    starts = sums.select(g, p, (F.sum(own).over(all_parts.orderBy(p)) - F.col(own)).alias(start), F.sum(own).over(all_parts).alias(total))
    local = F.sum(value).over(Window.partitionBy(group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.hint("merge") if merge else starts
    out = df.withColumn(own, local).join(starts, (F.col(group) == F.col(g)) & (F.col(part) == F.col(p)))
    return out.select(*df.columns, (F.col(start) + F.coalesce(own, F.lit(0))).cast("long").alias(name), F.col(total).cast("long").alias(total))


#: Rows of a stretch of an order, as long as that makes no more than MOST_STRETCHES.
STRETCH, MOST_STRETCHES = 8192, 20_000


def in_order(df: DataFrame, group: str, order: list[Column], value: Column | None = None, name: str = "nth", total: str = "total") -> DataFrame:
    """before(), with parts that are stretches between quantiles of (group, order); equal rows stand in any order.

    The rows are written once, dealt into stretches; one more column tells equal rows apart, so that a stretch ends within a run of them.
    """
    part, own = fresh(df, "part", "row")
    stretches = min(max(1, math.ceil(df.count() / STRETCH)), MOST_STRETCHES)
    dealt = df.withColumn(own, F.monotonically_increasing_id()).repartitionByRange(stretches, F.col(group), *order, F.col(own))
    out = before(keep(dealt.withColumn(part, F.spark_partition_id())), group, part, [*order, F.col(own)], value, name, total)
    return out.drop(part, own)
