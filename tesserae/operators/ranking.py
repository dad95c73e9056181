"""Ranks within groups of any size, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.functions.labels import shuffled
from tesserae.functions.names import fresh


def hash_rank(df: DataFrame, group: str, key: str, seed: int, rank: str = "rk", size: str = "n") -> DataFrame:
    """Adds the rank (from 1) of each row in its group in the order of a seeded hash of the key, and the group's size.

    Rows are ranked within parts of a group (by the first three digits of the hash, 4,096 parts); each part starts
    behind those before it. The table of parts is small and joins back; the largest sort is of a group's 4,096th part.
    """
    taken = [x for x in (rank, size) if x in df.columns]
    if taken:
        raise ValueError(f"the table has columns {taken}")
    h, part, c, g, p, start, local = fresh(df, "h", "part", "c", "g", "p", "start", "local")
    hashed = df.withColumn(h, shuffled(seed, F.col(key))).withColumn(part, F.substring(h, 1, 3))
    parts = hashed.groupBy(group, part).agg(F.count("*").alias(c))
    w = Window.partitionBy(group).orderBy(part)
    starts = parts.select(F.col(group).alias(g), F.col(part).alias(p), (F.sum(c).over(w) - F.col(c)).alias(start), F.sum(c).over(Window.partitionBy(group)).alias(size))
    ranked = hashed.withColumn(local, F.row_number().over(Window.partitionBy(group, part).orderBy(h, key)))
    out = ranked.join(starts, F.col(group).eqNullSafe(F.col(g)) & (F.col(part) == F.col(p)))
    return out.select(*df.columns, (F.col(start) + F.col(local)).alias(rank), size)
