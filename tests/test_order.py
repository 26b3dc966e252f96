"""The order of reports, which a comparison of row sets does not see, and what counts as a node."""

from pyspark.sql import functions as F

from pipelens.operators import analytics

from .test_rules import ABC, line, node, tables


def rows(frame):
    return [tuple(r) for r in frame.collect()]


def test_by_count(spark):
    frame = spark.createDataFrame([("b", "y", 2), ("a", "x", 2), (None, "z", 2), ("c", "w", 9), ("a", None, 2), ("d", "v", 1)], "cfk string, source string, n int").repartition(3)
    assert rows(analytics.by_count(frame, "cfk", "source")) == [("c", "w", 9), (None, "z", 2), ("a", None, 2), ("a", "x", 2), ("b", "y", 2), ("d", "v", 1)]
    top = analytics.first_rows(frame, F.col("n").desc(), "cfk", "source", n=3)
    assert rows(top.select("cfk", "n", "total")) == [("c", 9, 6), (None, 2, 6), ("a", 2, 6)]


def test_by_improvement_and_largest_changes(spark):
    frame = spark.createDataFrame([("a", 3), ("b", -5), ("c", 0), ("d", -5), ("e", 5)], "source string, difference int").repartition(3)
    assert rows(analytics.by_improvement(frame, "source")) == [("b", -5), ("d", -5), ("c", 0), ("a", 3), ("e", 5)]
    assert rows(analytics.largest_changes(frame, "source", n=3)) == [("b", -5), ("d", -5), ("e", 5)]


def test_by_status(spark):
    frame = spark.createDataFrame([("s2", "n1", "new"), ("s1", "n2", "resolved"), ("s1", "n1", "new"), ("s1", "n3", "remaining")], "source string, focus_node string, status string").repartition(3)
    assert rows(analytics.by_status(frame)) == [("s1", "n1", "new"), ("s2", "n1", "new"), ("s1", "n3", "remaining"), ("s1", "n2", "resolved")]


def test_components_in_order(spark):
    t = tables(spark, [*ABC, node("D"), node("E")], [line("1", "D", "C"), line("2", "B", "A")])
    assert rows(analytics.components_in_order(t))[:2] == [("A", 2), ("C", 2)]


def test_what_counts_as_a_node(spark):
    t = tables(spark, [node("A"), node("B", types=["Boom"]), node("C", types=["Gemaal"]), node("D", types=["Boom", "Overstortput"]), node("E", types=[])], [])
    assert sorted(r["node_id"] for r in analytics.roots_of_network(t).collect()) == ["A", "C", "D"]
