"""Tables whose columns are named as helpers are."""

import pytest
from pyspark.sql import functions as F

from tesserae.operators import balance, ordering, ranking, scaling
from tesserae.sources import images, scratch


def test_helper_names_do_not_clash(spark):
    names = ("part", "deal", "place", "start", "own", "c", "one", "h", "g", "p", "local", "rk", "n", "l", "k", "mean", "scale", "asked", "__part", "__r", "nth_")
    df = spark.range(40).select(F.col("id"), F.concat(F.lit("c"), F.col("id") % 2).alias("label"), F.array(F.col("id").cast("double")).alias("features"), *(F.col("id").alias(x) for x in names))
    for out in (
        ordering.numbered(df, "id"),
        ranking.hash_rank(df, "label", "id", 1, "rank", "size"),
        balance.split(df, "id"),
        balance.undersample(df, {"c0": 3}, "id"),
        scaling.transform(df, scaling.fit(df)),
        images.requests(df.withColumn("value", F.lit("{}"))),
    ):
        assert set(df.columns) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
        assert out.where(" or ".join(f"`{x}` <> id" for x in names)).count() == 0
    assert [r.nth for r in ordering.numbered(df, "id").orderBy("id").collect()] == list(range(40))
    with pytest.raises(ValueError):
        images.requests(df.withColumns({"value": F.lit("{}"), "content": F.lit(1)}))
    with pytest.raises(ValueError):
        ranking.hash_rank(df, "label", "id", 1, "rk", "size")


def test_kept_tables_can_be_dropped(spark):
    kept = scratch.keep(spark.range(10))
    assert kept.count() == 10
    scratch.drop(kept)
    with pytest.raises(Exception, match="(?i)exist|not found"):
        kept.count()
    other = spark.read.parquet("/root/testdata/sf0.001/region.parquet")
    with pytest.raises(ValueError):
        scratch.drop(other)
