"""Scenarios with one defect each: which objects a rule finds."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pipelens import config, findings
from pipelens.functions import geometry as g
from pipelens.model import Tables
from pipelens.operators import enrich, graph, hierarchy, spatial, topology
from pipelens.plans import catalog, projection

NODE = "node_id string, label string, types array<string>, x double, y double, z double, ground double, cover double, height_mm double, width_mm double, material string, begin_year int, ended boolean, multipart boolean"
LINE = "conduit_id string, label string, types array<string>, pts array<struct<x:double,y:double>>, start_id string, end_id string, bob_start double, bob_end double, width_mm double, height_mm double, length_m double, material string, shape string, begin_year int, ended boolean, multipart boolean"

VOCABULARY = {}
PLACES = {"A": (1000.0, 2000.0), "B": (1050.0, 2000.0), "C": (1100.0, 2000.0), "D": (1150.0, 2000.0)}


def node(name, **more):
    x, y = PLACES.get(name, (1000.0, 2500.0))
    row = dict(node_id=name, label=name, types=["Inspectieput"], x=x, y=y, z=10.0, ground=10.0, cover=10.0, height_mm=1500.0, width_mm=1000.0, material="Beton", begin_year=1980, ended=False, multipart=False)
    return row | more


def line(name, a, b, pts=None, **more):
    pts = pts or [PLACES[a], PLACES[b]]
    row = dict(conduit_id=name, label=name, types=["GemengdRiool"], pts=pts, start_id=a, end_id=b, bob_start=8.6, bob_end=8.5, width_mm=300.0, height_mm=300.0, length_m=50.0, material="Beton", shape="Rond", begin_year=1980, ended=False, multipart=False)
    return row | more


def tables(spark, nodes, lines, **more):
    ordered = lambda rows, ddl: [tuple(r[c.strip().split(" ")[0]] for c in _columns(ddl)) for r in rows]
    cfg = more.pop("cfg", config.Config(y_range=(0.0, 630_000.0)))
    if not VOCABULARY:
        VOCABULARY.update(Tables(node=None, conduit=None, class_edge=projection.class_tree(spark))._classes)
    return Tables(vocabulary=VOCABULARY, node=spark.createDataFrame(ordered(nodes, NODE), NODE), conduit=spark.createDataFrame(ordered(lines, LINE), LINE), class_edge=projection.class_tree(spark), cfg=cfg, **more)


def _columns(ddl):
    out, depth, word = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(word)
            word = ""
        else:
            word += c
    return [*out, word]


ABC = [node("A"), node("B"), node("C")]
AB, BC = line("1", "A", "B"), line("2", "B", "C")

SCENARIOS = [
    ("TOP-006", ABC, [AB, line("2", "A", "B", [(1000.0, 2000.02), (1050.0, 2000.02)])], {}, ["1"]),
    ("TOP-007", ABC, [AB, line("2", "B", "B")], {}, ["2"]),
    ("TOP-008", ABC, [line("1", "A", "B", [(1000.0, 2000.0), (1025.0, 2002.0), (1050.0, 2000.0)])], {}, ["1"]),
    ("TOP-009", [*ABC, node("B2", x=999_999.0)], [AB], {}, ["B2"]),
    ("TOP-010", [*ABC, node("P", x=1025.0, y=1990.0), node("Q", x=1025.0, y=2010.0)], [AB, line("9", "P", "Q", [(1025.0, 1990.0), (1025.0, 2010.0)], width_mm=400.0)], {}, ["1"]),
    ("TOP-011", [*ABC, node("P", x=1025.0, y=1990.0), node("Q", x=1025.0, y=2010.0)], [AB, line("9", "P", "Q", [(1025.0, 1990.0), (1025.0, 2010.0)])], {}, ["1"]),
    ("TOP-011", ABC, [AB, BC], {}, []),
    ("TOP-013", ABC, [AB, line("2", "A", "B"), line("3", "B", "A")], {}, ["1", "2", "3"]),
    ("TOP-014", ABC, [line(str(k), "A", "B") for k in range(4)] + [line("9", "A", "C")], {}, ["A"]),
    ("TOP-017", ABC, [line("1", "A", "B", [(0.0, 0.0), (10.0, 10.0), (10.0, 0.0), (0.0, 10.0)])], {}, ["1"]),
    ("TOP-018", ABC, [line("1", "A", "B", [(0.0, 0.0), (10.0, 0.0), (0.1, 0.1)])], {}, ["1"]),
    ("TOP-019", [node("A"), node("B", types=["BlindePut"]), node("C")], [AB, BC], {}, ["B"]),
    ("TOP-020", ABC, [line("1", "A", "B", [PLACES["B"], PLACES["A"]])], {}, ["1"]),
    ("TOP-021", [*ABC, node("X", x=1025.0, y=2000.2)], [AB, BC], {}, ["X"]),
    ("TOP-004", ABC, [line("1", "A", "B", [(1000.2, 2000.0), (1050.0, 2000.0)])], {}, ["1"]),
    ("TOP-005", [*ABC, node("A2", x=1000.1, y=2000.0)], [AB], {}, ["A"]),
    ("ADM-002", [*ABC, node("D", label="A")], [AB], {}, ["A", "D"]),
    ("ADM-006", ABC, [line("1", "A", "B", ended=True)], {}, ["1"]),
    ("ADM-007", [*ABC, node("D", types=["Overstortput"])], [AB], {}, ["D"]),
    ("ATTR-001", ABC, [line("1", "A", "B", material="PVC", width_mm=1000.0)], {}, ["1"]),
    ("ATTR-002", ABC, [line("1", "A", "B", width_mm=160.0, height_mm=160.0)], {}, ["1"]),
    ("ATTR-003", ABC, [line("1", "A", "B", material="PVC", begin_year=1940)], {}, ["1"]),
    ("ATTR-004", ABC, [line("1", "A", "B", height_mm=400.0)], {}, ["1"]),
    ("ATTR-005", ABC, [line("1", "A", "B", width_mm=30.0, height_mm=30.0)], {}, ["1", "1"]),
    ("ATTR-006", [node("A", width_mm=800.0, height_mm=None), *ABC[1:]], [line("1", "A", "B", width_mm=1200.0)], {}, ["1"]),
    ("ATTR-007", ABC, [line("1", "A", "B", begin_year=2099)], {}, ["1"]),
    ("ATTR-008", ABC, [line("1", "A", "B", length_m=500.0)], {}, ["1"]),
    ("ATTR-009", ABC, [line("1", "A", "B", length_m=100.0)], {}, ["1"]),
    ("ATTR-010", [node("A", material="PVC"), *ABC[1:]], [line("1", "A", "B", material="Metselwerk")], {}, ["1"]),
    ("ATTR-012", ABC, [line("1", "A", "B", material="Metselwerk")], {}, ["1"]),
    ("HGT-004", ABC, [line("1", "A", "B", bob_start=10.5)], {}, ["1"]),
    ("HGT-005", ABC, [line("1", "A", "B", bob_start=8.5, bob_end=8.52)], {}, ["1"]),
    ("HGT-006", ABC, [line("1", "A", "B", bob_start=8.5, bob_end=8.8)], {}, ["1"]),
    ("HGT-007", ABC, [line("1", "A", "B", bob_start=8.51, bob_end=8.5)], {}, ["1"]),
    ("HGT-008", ABC, [line("1", "A", "B", bob_start=9.5, bob_end=4.5)], {}, ["1"]),
    ("HGT-009", ABC, [line("1", "A", "B", bob_end=8.55), line("2", "B", "C", bob_start=8.0)], {}, ["B"]),
    ("HGT-010", ABC, [line("1", "A", "B", width_mm=400.0, height_mm=400.0), BC], {}, ["2"]),
    ("HGT-012", [node("A"), node("B", height_mm=12_000.0), node("C")], [AB], {}, ["B"]),
    ("HGT-013", ABC, [line("1", "A", "B", bob_start=9.5, bob_end=9.5)], {}, ["1", "1"]),
    ("HGT-014", [node("A"), node("B", ground=7.0), node("C")], [line("1", "A", "B", bob_start=5.0, bob_end=4.95)], {}, ["1"]),
    ("HGT-015", [node("A", height_mm=1450.0), node("B", height_mm=500.0), node("C")], [AB], {}, ["B"]),
    ("HGT-018", ABC, [line("1", "A", "B", bob_end=9.9)], {}, ["1"]),
    ("NET-001", [node("A", types=["Gemaal"]), *ABC[1:], node("D")], [line("1", "B", "A"), line("3", "C", "D")], {}, ["3"]),
    ("NET-003", ABC, [line("1", "A", "B", bob_start=8.0, bob_end=8.5)], {}, ["1"]),
    ("NET-004", [*ABC, node("D")], [AB, BC, line("3", "C", "B"), line("4", "C", "D")], {}, ["2"]),
    ("NET-005", [*ABC, node("D")], [AB, line("2", "B", "C", types=["Hemelwaterriool"]), line("3", "C", "D")], {}, ["2"]),
    ("NET-006", ABC, [AB, line("2", "B", "C", types=["Hemelwaterriool"])], {}, ["B"]),
    ("NET-008", [node("A"), *[node(n, types=["Lozingspunt"]) for n in "BCD"]], [AB, line("2", "A", "C"), line("3", "A", "D")], {}, ["B", "C", "D"]),
    ("RVZ-001", [*ABC, node("D", types=["Overstortput"])], [AB], {}, ["D"]),
    ("RVZ-005", [node("A"), node("B", types=["Overstortput"])], [line("1", "A", "B", types=["Hemelwaterriool"])], {}, ["B"]),
    ("RVZ-006", ABC, [AB, BC], {}, ["A"]),
    ("RVZ-008", [node("A"), node("B", types=["Bergbezinkbassin"])], [AB], {}, ["B"]),
    ("RVZ-010", [*ABC, node("D")], [AB, line("2", "B", "C", types=["Overstortleiding"]), line("3", "C", "D")], {}, ["2"]),
]


@pytest.mark.parametrize(("rule_id", "nodes", "lines", "more", "expected"), SCENARIOS, ids=[f"{s[0]}-{k}" for k, s in enumerate(SCENARIOS)])
def test_scenario(spark, rule_id, nodes, lines, more, expected):
    found = findings.run(rule_id, tables(spark, nodes, lines, **more))
    assert found.columns == findings.COLUMNS
    assert sorted(r["object_id"] for r in found.collect()) == expected


def test_clean_network_gives_nothing(spark):
    t = tables(spark, ABC, [AB, BC])
    quiet = [r for r in findings.RULES if r not in ("NET-001", "RVZ-006", "EXT-005")]
    assert findings.run_all(t, quiet).collect() == []


def test_rounded_series(spark):
    lines = [line(f"b{k:02}", "A", "B", bob_start=8.0 + k * 0.05, bob_end=8.0 + k * 0.05) for k in range(40)]
    found = findings.run("BTR-006", tables(spark, ABC, lines)).collect()
    assert [(r["object_id"], r["detail"]) for r in found] == [("b00", "invert")]


def test_closure_of_a_cycle(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("e", "d")], "child string, parent string")
    got = {(r["root"], r["cls"]) for r in hierarchy.closure(edges).collect()}
    assert got == {(x, y) for x in "abc" for y in "abc"} | {("d", "d"), ("d", "e")}


def test_climb(spark):
    parents = spark.createDataFrame([("p", "part"), ("n", "p"), ("x", "y"), ("y", "x")], "parent_id string, child_id string")
    objects = spark.createDataFrame([("part",), ("n",), ("x",)], "object_id string")
    wanted = spark.createDataFrame([("n",)], "id string")
    assert {tuple(r) for r in hierarchy.climb(objects, parents, wanted).collect()} == {("part", "n"), ("n", "n")}


def test_strong_components_against_brute_force(spark):
    rng = random.Random(4)
    edges = {(f"v{rng.randint(0, 24):02}", f"v{rng.randint(0, 24):02}") for _ in range(34)}
    reach = set(edges)
    while True:
        more = {(a, d) for a, b in reach for c, d in reach if b == c} - reach
        if not more:
            break
        reach |= more
    want = {a: min(b for x, b in reach if x == a and (b, a) in reach) for a, b in reach if (a, a) in reach}
    got = {r["id"]: r["component"] for r in graph.strong_components(spark.createDataFrame(sorted(edges), "a string, b string")).collect()}
    assert got == want


def test_overlap_against_sampling(spark):
    rng = random.Random(9)
    a, b = (0.0, 0.0, 10.0, 0.0), []
    for k in range(40):
        angle = rng.choice([0.0, 0.001, 0.004, 0.3, math.pi / 2, math.pi])
        x, y, n = rng.uniform(-3, 9), rng.uniform(-0.06, 0.06), rng.uniform(0.5, 8)
        b.append((x, y, x + n * math.cos(angle), y + n * math.sin(angle)))
    rows = [(k, *s) for k, s in enumerate(b)]
    cols = [F.lit(float(v)) for v in a]
    got = {}
    frame = spark.createDataFrame(rows, "k int, x1 double, y1 double, x2 double, y2 double").select("k", topology.interval(cols, [F.col(c) for c in ("x1", "y1", "x2", "y2")], 0.05).alias("i"))
    for r in frame.collect():
        got[r["k"]] = max(0.0, r["i"]["hi"] - r["i"]["lo"]) if r["i"]["lo"] is not None else 0.0

    def dist(p, s):
        dx, dy = s[2] - s[0], s[3] - s[1]
        t = max(0.0, min(1.0, ((p - s[0]) * dx - s[1] * dy) / (dx * dx + dy * dy)))
        return math.hypot(p - s[0] - t * dx, s[1] + t * dy)

    for k, s in enumerate(b):
        near = sum(dist(i / 2000, s) <= 0.05 for i in range(20_001)) / 2000
        assert abs(got.get(k, 0.0) - near) < 0.01, (k, s)


def test_geometry(spark):
    row = spark.sql("SELECT array(struct(0D x, 0D y), struct(4D x, 0D y), struct(4D x, 3D y)) AS pts, array(struct(0D x, 0D y), struct(4D x, 0D y), struct(4D x, 4D y), struct(0D x, 4D y), struct(0D x, 0D y)) AS ring")
    got = row.select(
        g.length(F.col("pts")).alias("n"), g.max_offset(F.col("pts")).alias("off"), g.angles(F.col("pts"))[0].alias("angle"), g.shoelace(F.col("ring")).alias("area"), g.midpoint(F.col("pts")).alias("m"),
        g.in_ring(F.lit(4.0), F.lit(2.0), F.col("ring")).alias("edge"), g.in_ring(F.lit(2.0), F.lit(2.0), F.col("ring")).alias("inside"), g.in_ring(F.lit(5.0), F.lit(2.0), F.col("ring")).alias("outside"),
    ).first()
    assert got["n"] == 7 and abs(got["off"] - 2.4) < 1e-9 and abs(got["angle"] - 90) < 1e-9 and got["area"] == 16
    assert (got["m"]["x"], got["m"]["y"]) == (3.5, 0.0) and got["edge"] and got["inside"] and not got["outside"]


def test_nearest_breaks_ties_by_id(spark):
    a = spark.createDataFrame([("p", 0.0, 0.0), ("q", None, 0.0)], "a string, ax double, ay double")
    b = spark.createDataFrame([("y", 0.05, 0.0), ("x", -0.05, 0.0), ("z", 0.2, 0.0)], "b string, bx double, by double")
    assert [tuple(r) for r in spatial.nearest(a, b, 0.1).collect()] == [("p", "x", 0.05)]


def test_findings_are_enriched(spark):
    t = tables(spark, [node("A", types=["Gemaal"]), *ABC[1:]], [line("1", "A", "B", bob_start=10.5), line("2", "A", "B"), line("3", "A", "B")])
    found = findings.run_all(t, ["HGT-004", "TOP-013", "ADM-002"])
    rich = enrich.enriched(found, t)
    rows = rich.collect()
    assert len({r["finding_id"] for r in rows}) == len(rows) == found.count()
    assert all(r["x"] is not None and r["component"] == "A" for r in rows)
    assert {r["priority"] for r in rows} == {2, 3}
    assert sum(r["stack_size"] for r in enrich.stacks(rich).select("stack_size").collect()) == 16
    outcome = {r["rule_id"]: r for r in enrich.outcomes(found, t).collect()}
    assert outcome["TOP-013"]["systemic"] and outcome["EXT-004"]["status"] == "skeleton" and outcome["TOP-001"]["found"] == 0


def test_every_rule_has_a_query():
    names = catalog.queries()
    assert {r.lower().replace("-", "_") for r in findings.RULES} <= set(names) | {"adm_008", "adm_009"}
    assert set(catalog.oracle_sql()) <= set(names)


def _layer(spark, rows):
    return spark.createDataFrame(rows, "role string, feature_id string, x double, y double")


NEAR_NONE = [("tree", "T", 0.0, 0.0)]


@pytest.mark.parametrize("rule_id", ["EXT-001", "EXT-002", "EXT-003", "EXT-005", "EXT-006", "EXT-007", "RVZ-004", "HGT-001", "HGT-002", "HGT-003", "HGT-011", "RVZ-011", "ADM-008", "ADM-009"])
@pytest.mark.parametrize("layer", [None, NEAR_NONE])
def test_rules_are_off_without_what_they_need(spark, rule_id, layer):
    nodes = [node("A", types=["Overstortput"]), node("B", types=["Lozingspunt"]), node("C")]
    t = tables(spark, nodes, [AB, BC])
    t.feature = layer and _layer(spark, layer)
    found = findings.run(rule_id, t)
    assert found.columns == findings.COLUMNS and found.count() == 0
    assert rule_id not in findings.runnable(t)


def test_a_layer_of_a_role_turns_only_its_rules_on(spark):
    t = tables(spark, [node("A", types=["Overstortput"]), node("B", types=["Lozingspunt"])], [AB])
    t.feature = _layer(spark, [("water", "W", 9000.0, 9000.0)])
    on = {r for r in findings.runnable(t) if r.startswith("EXT") or r == "RVZ-004"}
    assert on == {"EXT-002", "EXT-003", "EXT-007"}
    assert [r["object_id"] for r in findings.run("EXT-007", t).collect()] == ["B"]


def test_an_empty_layer_is_a_layer(spark):
    t = tables(spark, ABC, [AB, BC])
    t.feature, t.layers = _layer(spark, NEAR_NONE), frozenset({"cover"})
    assert sorted(r["object_id"] for r in findings.run("EXT-005", t).collect()) == ["A", "B", "C"]


def test_covers_count_testable_nodes_only(spark):
    t = tables(spark, ABC, [AB, BC])
    x, y = t.node.where("node_id = 'A'").select("x", "y").first()
    t.feature = _layer(spark, [("cover", "on", x, y), ("cover", "off", x + 500, y)])
    got = findings.run("EXT-006", t).select("object_id", "x", "y").collect()
    assert [tuple(r) for r in got] == [("off", x + 500, y)]
    t = tables(spark, ABC, [AB, BC], unreliable=spark.createDataFrame([("A",)], "object_id string"))
    t.feature = _layer(spark, [("cover", "on", x, y)])
    assert [r["object_id"] for r in findings.run("EXT-006", t).collect()] == ["on"]
    t = tables(spark, ABC, [AB, BC], unreliable=t.node.select(F.col("node_id").alias("object_id")))
    t.feature = _layer(spark, [("cover", "off", x + 500, y)])
    assert findings.run("EXT-006", t).count() == 0 and "EXT-006" not in findings.runnable(t)


def test_overflow_measures_to_the_networks_own_water(spark):
    nodes = [node("A", types=["Overstortput"]), node("B"), node("C", types=["Overstortput"])]
    dry = tables(spark, nodes, [AB])
    dry.feature = _layer(spark, [("water", "W", 0.0, 0.0)])
    assert findings.run("RVZ-004", dry).count() == 0
    wet = tables(spark, nodes, [line("1", "A", "B", types=["Oppervlaktewater"])])
    assert [r["object_id"] for r in findings.run("RVZ-004", wet).collect()] == ["C"]


def test_places_of_findings(spark):
    p = lambda x, y: {"x": x, "y": y}
    rows = [("a", [p(0.0, 0.0), p(10.0, 0.0)]), ("b", [p(2.0, -1.0), p(2.0, 1.0), p(6.0, 1.0), p(6.0, -1.0)]), ("c", [p(20.0, 0.02), p(30.0, 0.02)]), ("d", [p(18.0, 0.0), p(26.0, 0.0)])]
    t = tables(spark, ABC, [])
    own = spark.createDataFrame([(k, k + "1", k + "2", v, ["GemengdRiool"], 300.0, 300.0, "Beton") for k, v in rows], "conduit_id string, start_id string, end_id string, pts array<struct<x:double,y:double>>, types array<string>, width_mm double, height_mm double, material string")
    t.conduit = own
    where = lambda rule_id: {(r["object_id"], r["object2_id"]): (r["x"], r["y"]) for r in findings.run(rule_id, t).collect()}
    assert where("TOP-011") == {("a", "b"): (2.0, 0.0)}
    # Of the two crossings of a and b the one on the first segment; c lies along d, nearest at d's end and c's start alike: the first end.
    assert where("TOP-010") == {("a", "b"): (2.0, 0.0), ("c", "d"): (20.0, 0.01)}
    assert where("TOP-006") == {("c", "d"): (20.0, 0.01)}
