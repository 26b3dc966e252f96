"""What several rules read is worked out once where all rules run, and gives the same findings."""

from dataclasses import replace

from pyspark.sql import functions as F

from pipelens import findings
from pipelens.operators import graph, spatial

from .test_rules import ABC, line, tables

ON_PAIRS = ("TOP-006", "TOP-010", "TOP-011")
ON_ENDS = ("TOP-004", "HGT-004", "ATTR-006")
ON_TYPES = ("NET-005", "NET-006", "RVZ-005", "RVZ-010")


def _network(spark):
    lines = [
        line("1", "A", "B", types=["GemengdRiool"], width_mm=2000.0),
        line("2", "A", "B", types=["Hemelwaterriool"], pts=[(1000.0, 2000.02), (1050.0, 2000.02)]),
        line("3", "B", "C", types=["GemengdRiool"], pts=[(1010.0, 1990.0), (1010.0, 2010.0)]),
        line("4", "C", "A", types=["Overstortleiding"], pts=[(1005.0, 2001.0), (1009.0, 2001.0), (1009.0, 1995.0), (1005.0, 2001.0)]),
        line("4", "B", "C", types=["Vuilwaterriool"], pts=[(1020.0, 2000.5), (1020.0, 2030.0)]),
        line("5", "C", "C", types=["Hemelwaterriool"], bob_start=99.0),
        line("6", None, None, types=["Drain"], pts=[(1008.0, 2005.0), (1012.0, 2005.0)]),
        line(None, "A", "C", types=["Drain"]),
    ]
    return tables(spark, ABC, lines)


def test_rules_that_share_give_the_same_findings(spark, monkeypatch):
    t = _network(spark)
    made, pairs = [], spatial.segment_pairs
    monkeypatch.setattr(spatial, "segment_pairs", lambda *a, **k: made.append(1) or pairs(*a, **k))
    rules = [*ON_PAIRS, *ON_ENDS, *ON_TYPES]
    rows = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    alone = {r: rows(findings.run(r, t)) for r in rules}
    assert len(made) == len(ON_PAIRS) and not t.memo
    assert {r for r in (*ON_PAIRS, "HGT-004", "NET-006") if not alone[r]} == set()
    made.clear()
    many = replace(t, sharing=True)
    assert {r: rows(findings.run(r, many)) for r in rules} == alone
    assert len(made) == 1


def test_long_methods_are_left_to_operators(spark):
    graph.cut(spark.range(1))
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == graph.COMPILED


def test_staged_intervals_are_those_of_one_expression(spark):
    from pipelens.operators import topology

    rows = [(0.0, 0.0, 10.0, 0.0, *b) for b in ((2.0, 0.01, 7.0, 0.01), (3.0, -5.0, 3.0, 5.0), (20.0, 0.0, 30.0, 0.0), (4.0, 0.0, 4.0, 0.0), (-3.0, -1.0, 12.0, 1.0))] + [(1.0, 1.0, 1.0, 1.0, 0.0, 0.0, 2.0, 2.0)]
    names = [f"{side}_{c}" for side in "ab" for c in ("x1", "y1", "x2", "y2")]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    a, b = spatial.segment_columns("a"), spatial.segment_columns("b")
    one = frame.select("*", topology.interval(a, b, 0.05).alias("i")).select("*", F.col("i.lo"), F.col("i.hi")).drop("i")
    assert sorted(map(repr, topology.with_interval(frame, a, b, 0.05).collect())) == sorted(map(repr, one.collect()))
