"""Segments are dealt to cells once, and pairs that a rule has no use for are not written."""

from pyspark.sql import functions as F

from pipelens.operators import spatial, topology

SEGMENT = "id string, seq int, x1 double, y1 double, x2 double, y2 double"


def test_segments_of_several_levels_are_in_few_cells(spark):
    rows = [(f"s{k}", 0, 25.0 * k, 0.0, 25.0 * k + (200.0 if k % 10 == 9 else 24.0), 1.0) for k in range(200)]
    boxed = spatial._boxed(spark.createDataFrame(rows, SEGMENT), 32.0, F.lit(0.0))
    assert boxed.select("level").distinct().count() > 1
    assert spatial._spread(boxed, 32.0).count() < 2 * len(rows)


def test_neighbours_in_a_chain_are_no_pairs(spark):
    rows = [(f"c{k:03d}", 0, 25.0 * k, float(k % 2), 25.0 * k + 25.0, float((k + 1) % 2), 3) for k in range(40)]
    rows += [("x", 0, 10.0, -5.0, 10.0, 5.0, 3), ("y", 0, 25.0, 1.0, 0.0, 0.0, 3), ("z", 0, 12.5, 0.5, 12.5, 90.0, 3)]
    got = spatial.segment_pairs(spark.createDataFrame(rows, SEGMENT + ", tip int"), 0.0, 32.0, topology._only_tips_touch).select("a_id", "b_id").collect()
    assert {("c000", "x"), ("c000", "y"), ("c000", "z"), ("x", "y"), ("y", "z")} <= {tuple(r) for r in got}
    assert not any(a[0] == b[0] == "c" for a, b in got)
