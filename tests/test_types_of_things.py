"""Types of nodes and orientations are looked up for these alone, at once."""

from pipelens.operators import build

ROWS = [
    ("n", "hasAspect", "o"), ("n", "type", "v#B"), ("n", "type", "w#A"), ("n", "type", "v#A"), ("o", "type", "v#Putorientatie"), ("o", "hasAspect", "p"), ("p", "type", "v#Punt"), ("p", "hasValue", "<gml:Point><gml:pos>1 2</gml:pos></gml:Point>"),
    ("m", "hasAspect", "q"), ("q", "hasAspect", "r"), ("r", "type", "v#Punt"), ("r", "hasValue", "<gml:Point><gml:pos>3 4</gml:pos></gml:Point>"),
]


def test_types_are_those_of_what_is_asked(spark, monkeypatch):
    st = build.Statements(spark.createDataFrame(ROWS, "s string, p string, o string"))
    asked, types = [], build.Statements.types
    monkeypatch.setattr(build.Statements, "types", lambda self, name, things: asked.append(sorted(r[0] for r in things.collect())) or types(self, name, things))
    rows = {r["node_id"]: r for r in build.node_table(st).collect()}
    assert {k: (r["types"], r["orientation_types"], r["x"]) for k, r in rows.items()} == {"n": (["A", "B"], ["Putorientatie"], 1.0), "m": ([], None, 3.0)}
    assert asked == [["m", "n", "o", "q"]]
