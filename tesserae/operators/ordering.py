"""Numbers along a total order, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.functions.names import fresh
from tesserae.sources.scratch import keep

#: Rows of a stretch, about.
STRETCH = 1 << 20


def numbered(df: DataFrame, key: str, parts: int | None = None, nth: str = "nth") -> DataFrame:
    """Adds `nth` (or another name) from 0 in the order of a key; equal keys in any order, null ones first.

    Rows are dealt into stretches that part where the key's quantiles are, so that a stretch has about STRETCH rows wherever keys crowd; each
    starts behind those before it. A stretch of one key alone (equal keys never part) is dealt on, as its rows may stand in any order.
    """
    if nth in df.columns:
        raise ValueError(f"the table has a column {nth!r}")
    part, deal, place, start, own, c, one = fresh(df, "part", "deal", "place", "start", "own", "c", "one")
    n = parts or max(1, round(df.count() / STRETCH))
    ranged = keep(df.repartitionByRange(n, F.col(key).asc_nulls_first()).withColumns({part: F.spark_partition_id(), own: F.monotonically_increasing_id()}))
    sizes = ranged.groupBy(part).agg(F.count("*").alias(c), (F.count_distinct(key) + F.count_if(F.col(key).isNull()).cast("boolean").cast("int") == 1).alias(one))
    dealt = F.broadcast(sizes.where(one).select(part, F.ceil(F.col(c) / STRETCH).cast("int").alias(deal)))  # at most n rows
    ranged = ranged.join(dealt, part, "left").withColumn(deal, F.pmod(F.col(own), F.coalesce(deal, F.lit(1))))
    starts = ranged.groupBy(part, deal).agg(F.count("*").alias(c))
    starts = starts.select(part, deal, (F.sum(c).over(Window.orderBy(part, deal)) - F.col(c)).alias(start))  # a row for each stretch
    local = F.row_number().over(Window.partitionBy(part, deal).orderBy(F.col(key).asc_nulls_first(), own)) - 1
    return ranged.withColumn(place, local).join(F.broadcast(starts), [part, deal]).select(*df.columns, (F.col(start) + F.col(place)).alias(nth))
