"""Edges: thin, linked, and on odd images."""

from pyspark.sql import functions as F

from tesserae.operators import edges

SCHEMA = "id long, height int, width int, px array<int>, g int"


def test_edges_are_thin_linked_and_defined(spark):
    step = [0 if c < 6 else 255 for _ in range(12) for c in range(12)]
    # a step whose height falls row by row: strong at the top, weak below, and a weak one alone
    fading = [0 if c < 6 else 120 - 6 * r for r in range(12) for c in range(12)]
    alone = [0 if c < 6 else 40 for _ in range(12) for c in range(12)]
    df = spark.createDataFrame([(0, 12, 12, step, 1), (1, 12, 12, fading, 1), (2, 12, 12, alone, 1), (3, 0, 0, [], 1), (4, 3, 3, None, 1), (None, 12, 12, step, 1)], SCHEMA)
    found = {}
    for r in edges.linked(df).collect():
        found.setdefault(r.id, set()).add((r.r, r.c))
    assert {c for _, c in found[0]} in ({5}, {6}) and len(found[0]) == 12 and found[None] == found[0]
    assert len(found[1]) >= 10 and 2 not in found
    density = {r.id: r.density for r in edges.edge_density(df).collect()}
    assert density[0] == density[None] == 12 * 255 / 144 and density[2] == density[3] == density[4] == 0
    assert edges.edge_density(df.limit(0)).count() == 0
    assert df.select(F.size(edges.graded(F.col("px"), F.col("height"), F.col("width"))).alias("n")).where("n = 144").count() == 4


def test_no_table_of_pixels_goes_through_the_driver(spark, monkeypatch):
    """Kept tables of pixels are small as files, so joins that do not say how would broadcast them."""
    kept, plans = edges.keep, []

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df)

    monkeypatch.setattr(edges, "keep", watched)
    fading = [0 if c < 6 else 120 - 9 * r for r in range(12) for c in range(12)]
    out = edges.edge_density(spark.createDataFrame([(k, 12, 12, fading, 1) for k in range(20)], SCHEMA))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 6 and sum("SortMergeJoin" in p for p in plans) >= 3
    assert not any("BroadcastExchange" in p for p in plans)
