"""Queries work out only what they read."""

import os

import pytest

from pipelens.operators import build
from pipelens.plans import export, more

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")


def _never(*_):
    raise AssertionError("not needed here")


def test_queries_of_a_few_rules_run_no_others(spark):
    queries = more.queries(_never, _never, _never)
    assert queries["agg_15"](spark, FOLDER).count() == 5
    assert queries["fnd_12"](spark, FOLDER).columns == ["component"]


def test_queries_of_statements_build_no_nodes(spark, monkeypatch):
    monkeypatch.setattr(export, "_read", {})
    monkeypatch.setattr(build, "node_table", _never)
    for name in ("mod_2", "mod_3", "mod_4", "agg_11"):
        assert export.queries()[name](spark, FOLDER).columns, name


def test_aspects_are_joined_once_and_stored_by_class(spark):
    """Aspects of a class come from the stored table without another join; doubled statements and several values change nothing."""
    rows = [("o", "hasAspect", "a"), ("o", "hasAspect", "a"), ("a", "type", "v#Inwinning"), ("a", "type", "w#Inwinning"), ("a", "hasValue", "x"), ("a", "hasValue", "b"), ("a", "hasReference", "v#R")]
    rows += [("a", "hasAspect", "w"), ("w", "type", "v#WijzeVanInwinning"), ("w", "hasReference", "v#Meting"), ("w", "hasReference", "v#Zien")]
    rows += [("a", "hasAspect", "d"), ("d", "type", "v#DatumInwinning"), ("d", "hasValue", "0"), ("d", "hasValue", "2016"), ("d", "hasValue", "2015-02-03"), ("p", "hasAspect", "n"), ("n", "type", "v#Inwinning")]
    st = build.Statements(spark.createDataFrame(rows, "s string, p string, o string"))
    found = st.aspects("owner", "Inwinning")
    assert [tuple(r) for r in found.collect()] == [("o", "a", "b")]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["aspect"], r["method"], str(r["date"])) for r in build.provenance(st).collect()] == [("o", "Meting", "2015-02-03")]


def test_a_geometry_literal_is_parsed_once(spark):
    from pyspark.sql import functions as F

    from pipelens.sources import graph

    frame = spark.createDataFrame([("<gml:Point><gml:pos>1 2</gml:pos></gml:Point>",)], "v string").select(graph.gml(F.col("v")).alias("g"))
    assert frame._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 1
    assert [(p["x"], p["y"]) for p in frame.first()["g"]["pts"]] == [(1.0, 2.0)]


def test_rules_of_one_pass_write_no_network(spark, monkeypatch):
    from pipelens import findings
    from pipelens.operators import graph
    from pipelens.plans import catalog, projection

    built, found = projection.tables(spark, FOLDER), catalog.queries()
    rows = lambda df: sorted(map(repr, df.collect()))
    whole = {r: rows(findings.run(r, built)) for r in catalog.ONE_PASS}
    assert whole["ATTR-008"] and whole["NET-003"]
    monkeypatch.setattr(projection, "_read", {})
    monkeypatch.setattr(graph, "written", _never)
    for rule_id, expected in whole.items():
        assert rows(found[rule_id.lower().replace("-", "_")](spark, FOLDER)) == expected, rule_id
    assert not projection._read
