"""What must hold at any size: no depth caps, no coordinate that stops a run, exact spatial joins."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pipelens import config, findings
from pipelens.operators import analytics, build, external, graph, hierarchy, spatial

from .test_rules import ABC, line, node, tables

SPATIAL = ["TOP-001", "TOP-002", "TOP-005", "TOP-006", "TOP-007", "TOP-009", "TOP-010", "TOP-011", "TOP-016", "TOP-021", "EXT-001", "EXT-002", "EXT-003", "EXT-005", "EXT-006", "EXT-007", "RVZ-004"]


def test_stray_coordinates_change_nothing_else(spark):
    odd = {"1e12": 1e12, "1e300": 1e300, "inf": math.inf, "nan": math.nan}
    lines = [line("1", "A", "B"), line("2", "A", "B", [(1000.0, 2000.02), (1050.0, 2000.02)]), line("3", "B", "C", [(1060.0, 1990.0), (1060.0, 2010.0)]), line("4", "B", "C", [(1055.0, 2000.0), (1070.0, 2000.0)])]
    near = [("water", "W", 1020.0, 2000.5)]
    stray = [node(f"X{k}", x=v, y=2000.0) for k, v in odd.items()], [line(f"L{k}", "A", "B", [(1000.0, 2400.0), (v, 2500.0)]) for k, v in odd.items()], [("building", f"H{k}", v, 2000.0) for k, v in odd.items()]
    layer = lambda rows: spark.createDataFrame(rows, "role string, feature_id string, x double, y double")
    plain = tables(spark, ABC, lines, feature=layer(near))
    more = tables(spark, ABC + stray[0], lines + stray[1], feature=layer(near + stray[2]))
    for rule_id in SPATIAL:
        pairs = lambda t: {(r["object_id"], r["object2_id"]) for r in findings.run(rule_id, t).collect()}
        without = {p for p in pairs(more) if not any(str(x)[:1] in "XLH" for x in p)}
        assert without == pairs(plain), rule_id
    assert {f"X{k}" for k in odd} <= {r["object_id"] for r in findings.run("TOP-009", more).collect()}


def _distance(a, b):
    def to(px, py, s):
        dx, dy = s[2] - s[0], s[3] - s[1]
        t = 0.0 if dx == dy == 0 else max(0.0, min(1.0, ((px - s[0]) * dx + (py - s[1]) * dy) / (dx * dx + dy * dy)))
        return math.hypot(px - s[0] - t * dx, py - s[1] - t * dy)

    side = lambda s, x, y: (s[2] - s[0]) * (y - s[1]) - (s[3] - s[1]) * (x - s[0])
    if side(a, *b[:2]) * side(a, *b[2:]) < 0 and side(b, *a[:2]) * side(b, *a[2:]) < 0:
        return 0.0
    return min(to(*a[:2], b), to(*a[2:], b), to(*b[:2], a), to(*b[2:], a))


def _segments(seed, n, prefix):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        x, y, size = rng.uniform(-500, 500), rng.uniform(-500, 500), 10 ** rng.uniform(-1, 3.5)
        turn = rng.uniform(0, 2 * math.pi)
        out.append((f"{prefix}{k:03d}", 0, x, y, x + size * math.cos(turn), y + size * math.sin(turn)))
    return out


def test_segment_pairs_of_all_lengths(spark):
    rows = _segments(1, 120, "s")
    got = spatial.segment_pairs(spark.createDataFrame(rows, "id string, seq int, x1 double, y1 double, x2 double, y2 double"), 5.0, 32.0).select("a_id", "b_id").collect()
    found = [tuple(r) for r in got]
    near = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and _distance(a[2:], b[2:]) <= 5.0}
    assert len(found) == len(set(found)) and near <= set(found)


def test_pairs_of_two_sets(spark):
    left, right = _segments(2, 80, "l"), _segments(3, 60, "r")
    ddl = "id string, seq int, x1 double, y1 double, x2 double, y2 double"
    found = [tuple(r) for r in spatial.cross_pairs(spark.createDataFrame(left, ddl), spark.createDataFrame(right, ddl), 2.0, 32.0).select("a_id", "b_id").collect()]
    near = {(a[0], b[0]) for a in left for b in right if _distance(a[2:], b[2:]) <= 2.0}
    assert len(found) == len(set(found)) and near <= set(found)


def test_a_long_segment_touches_few_cells(spark):
    boxed = spatial._boxed(spark.createDataFrame([("a", 0, 0.0, 0.0, 1e6, 1e6), ("b", 0, 0.0, 0.0, 1.0, 1.0)], "id string, seq int, x1 double, y1 double, x2 double, y2 double"), 32.0, F.lit(0.0))
    assert spatial._dealt(boxed, 32.0).groupBy("id").count().agg({"count": "max"}).first()[0] <= 4


def test_chain_of_two_hundred_parents(spark):
    parents = spark.createDataFrame([(f"c{k}", f"c{k + 1}") for k in range(200)], "child_id string, parent_id string")
    wanted = spark.createDataFrame([("c200",)], "id string")
    objects = spark.createDataFrame([("c0",), ("c150",), ("c200",), ("z",)], "object_id string")
    assert {tuple(r) for r in hierarchy.climb(objects, parents, wanted).collect()} == {("c0", "c200"), ("c150", "c200"), ("c200", "c200")}
    assert hierarchy.closure(parents.toDF("child", "parent")).count() == 200 * 201 // 2 + 200
    chain = build.parent_chain(objects.where("object_id = 'c150'"), parents, wanted)
    assert {r["link_id"] for r in chain.collect()} == {f"c{k}" for k in range(150, 201)}


def test_climb_ends_on_a_cycle(spark):
    parents = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child_id string, parent_id string")
    assert hierarchy.climb(spark.createDataFrame([("a",)], "object_id string"), parents, spark.createDataFrame([("q",)], "id string")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_reach_as_by_search(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(50), rng.randrange(50)) for _ in range(55)] + [(100 + k, 101 + k) for k in range(40)] + [(140, 7)]
    goals = {3, 11}
    want = set(goals)
    while more := {a for a, b in edges if b in want} - want:
        want |= more
    got = graph.reaching(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(k,) for k in goals], "id long"))
    assert {r["id"] for r in got.collect()} == want


def test_areas(spark):
    square = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    rows = [("building", "big", square(900.0, 1900.0, 1030.0, 2100.0)), ("building", "tip", square(1049.5, 2000.4, 1060.0, 2010.0)), ("water", "pond", square(1095.0, 1995.0, 1105.0, 2005.0))]
    feature = spark.createDataFrame(rows, "role string, feature_id string, ring array<struct<x:double,y:double>>").withColumn("x", F.lit(None).cast("double")).withColumn("y", F.lit(None).cast("double"))
    t = tables(spark, ABC, [line("1", "A", "B"), line("2", "B", "C"), line("3", "A", "A", [(1000.0, 2000.0), (1010.0, 2000.0)])], feature=feature)
    got = {r["object_id"]: (r["object2_id"], r["detail"], r["value"]) for r in findings.run("EXT-001", t).collect()}
    assert got == {"A": ("big", "within", 0.0), "B": ("tip", "near", 0.4), "1": ("big", "crosses", 0.0), "2": ("tip", "near", 0.4), "3": ("big", "within", 0.0)}
    assert {r["object_id"] for r in findings.run("EXT-002", t).collect()} == {"2"}
    t.extent = (1040.0, 0.0, 2000.0, 3000.0)
    t.unreliable = spark.createDataFrame([("2",)], "object_id string")
    assert {r["object_id"] for r in findings.run("EXT-001", t).collect()} == {"B", "1"}


def test_role_layers(spark):
    point = spark.createDataFrame([("f", 1.0, 2.0)], "feature_id string, x double, y double")
    layer, missing = external.role_layers({"water": [point, point], "cover": []})
    assert layer.where("role = 'water'").count() == 2 and missing == ["building", "cover", "structure"]


def test_sizes_parts_and_dates_as_cataloged(spark):
    sizes = [line(str(k), "A", "B", width_mm=float(w), height_mm=float(w)) for k, w in enumerate((8, 10, 15, 80, 100, 35))]
    got = findings.run("ATTR-005", tables(spark, ABC, sizes)).where("detail = 'width'").collect()
    assert {r["value"] for r in got} == {8.0, 10.0, 15.0} and {r["severity"] for r in got} == {"F"}
    ends = [node("A", types=["Lozingsput"]), node("B", types=["Lozingsput"]), node("C", types=["Overstortput"])]
    t = tables(spark, ends, [line("1", "A", "A"), line("2", "B", "B", types=["Persleiding"])])
    assert {(r["object_id"], r["detail"]) for r in findings.run("ADM-007", t).collect()} == {("B", "Lozingsput"), ("C", "Overstortput")}
    dated = tables(spark, ABC, [line("1", "A", "B"), line("2", "B", "C")])
    day = lambda k: F.when(F.col(k) == "A", F.lit("2025-12-31")).when(F.col(k) == "B", F.lit("2026-01-01")).cast("date")
    dated.node = dated.node.withColumn("end_date", day("node_id")).withColumn("begin_date", F.when(F.col("node_id") == "C", F.lit("2026-01-02")).cast("date"))
    dated.conduit = dated.conduit.withColumn("end_date", F.lit(None).cast("date")).withColumn("begin_date", F.lit(None).cast("date"))
    assert {r["object_id"] for r in findings.run("ADM-006", dated).collect()} == {"A", "C"}


def test_a_core_without_objects_is_an_error(spark):
    found = findings.run("TOP-012", tables(spark, ABC, [line("1", "A", "A")]))
    with pytest.raises(ValueError, match="core"):
        analytics.restricted(found, found.where("false").select("object_id"))


def test_network_from_statements(spark, tmp_path):
    v, d = "http://v#", "http://d/"
    rows = []
    say = lambda s, p, o: rows.append(f"<{d}{s}> <{v}{p}> {o} .")
    thing, literal = lambda o: f"<{d}{o}>", lambda x: f'"{x}"'
    rows += [f"<{v}{a}> <{v}subClassOf> <{v}{b}> ." for a, b in config.CLASS_TREE + [("Putorientatie", "Knooppunt"), ("Leidingorientatie", "Verbinding")]]
    for name, cls, x in (("A", "Inspectieput", 0), ("B", "Gemaal", 50), ("K", "Compartiment", 51)):
        say(name, "type", f"<{v}{cls}>")
        say(name, "label", literal(f"put {name}"))
        say(name, "hasAspect", thing(f"{name}o"))
        say(f"{name}o", "type", f"<{v}Putorientatie>")
        say(f"{name}o", "hasAspect", thing(f"{name}p"))
        say(f"{name}p", "type", f"<{v}Punt>")
        say(f"{name}p", "hasValue", literal(f"<gml:Point srsDimension='2'><gml:pos>{x} 400000</gml:pos></gml:Point>"))
    say("B", "hasPart", thing("K"))
    say("C", "type", f"<{v}GemengdRiool>")
    say("C", "hasAspect", thing("Co"))
    say("Co", "type", f"<{v}Leidingorientatie>")
    say("Co", "hasAspect", thing("Cl"))
    say("Cl", "type", f"<{v}Lijn>")
    say("Cl", "hasValue", literal("<gml:LineString srsDimension='2'><gml:posList>0 400000 50 400000</gml:posList></gml:LineString>"))
    for end, to, cls, bob in (("b", "A", "Begin", "1.5"), ("e", "K", "Eind", "1.25")):
        say("Co", "hasPart", thing(f"C{end}"))
        say(f"C{end}", "type", f"<{v}{cls}puntLeiding>")
        rows.append(f"<{d}{to}o> <{v}hasConnection> <{d}C{end}> .")
        say(f"C{end}", "hasAspect", thing(f"C{end}h"))
        say(f"C{end}h", "type", f"<{v}Bob{cls}puntLeiding>")
        say(f"C{end}h", "hasValue", literal(bob))
    path = tmp_path / "export.nt"
    path.write_text("\n".join(rows))
    from pipelens.sources import graph as statements

    t = build.tables(statements.triples(spark, str(path)))
    got = t.conduit.first()
    # The compartment is a class of network node itself, so the end stays on it.
    assert (got["start_id"], got["end_id"], got["bob_start"], got["bob_end"], len(got["pts"])) == (f"{d}A", f"{d}K", 1.5, 1.25, 2)
    assert {r["node_id"]: r["label"] for r in t.node.collect()} == {f"{d}A": "put A", f"{d}B": "put B", f"{d}K": "put K"}
    assert findings.run("NET-003", t).count() == 0 and findings.run("NET-001", t).count() == 1


def _touching(rows, radius):
    """Pairs of segments of different lines within the radius, by plain arithmetic."""

    def to(p, s):
        dx, dy = s[2] - s[0], s[3] - s[1]
        n = dx * dx + dy * dy
        k = max(0.0, min(1.0, ((p[0] - s[0]) * dx + (p[1] - s[1]) * dy) / n)) if n else 0.0
        return math.hypot(p[0] - s[0] - k * dx, p[1] - s[1] - k * dy)

    def side(s, p):
        return (s[2] - s[0]) * (p[1] - s[1]) - (s[3] - s[1]) * (p[0] - s[0])

    out = set()
    for k, (a, _, *p) in enumerate(rows):
        for b, _, *q in rows[:k]:
            cross = side(p, q[:2]) * side(p, q[2:]) < 0 and side(q, p[:2]) * side(q, p[2:]) < 0
            if a != b and (cross or min(to(p[:2], q), to(p[2:], q), to(q[:2], p), to(q[2:], p)) <= radius):
                out.add((min(a, b), max(a, b)))
    return out


def _long_and_short(n_long, n_short, seed):
    """Short segments in a small area, and long ones that leave it in all directions, some of them along each other."""
    rng = random.Random(seed)
    rows = []
    for k in range(n_short):
        x, y, a = rng.uniform(-900, 900), rng.uniform(-900, 900), rng.uniform(0, 6.3)
        rows.append((f"s{k:04}", 0, x, y, x + 40 * math.cos(a), y + 40 * math.sin(a)))
    for k in range(n_long):
        x, y, a, n = rng.uniform(-900, 900), rng.uniform(-900, 900), rng.choice([0.0, 0.001, 1.0, 2.5, 4.0]), rng.choice([3e2, 5e3, 8e5])
        rows.append((f"t{k:04}", 0, x, y, x + n * math.cos(a), y + n * math.sin(a)))
    return rows


SEGMENT = "id string, seq int, x1 double, y1 double, x2 double, y2 double"


@pytest.mark.parametrize("leaf", [4, spatial.LEAF])
def test_long_segments_meet_what_they_pass(spark, monkeypatch, leaf):
    monkeypatch.setattr(spatial, "LEAF", leaf)
    rows = _long_and_short(40, 120, 1)
    pairs = spatial.segment_pairs(spark.createDataFrame(rows, SEGMENT), 2.0, 8.0).select("a_id", "b_id", "a_seq", "b_seq").collect()
    assert len(pairs) == len(set(pairs)) and all(r["a_id"] < r["b_id"] for r in pairs)
    assert _touching(rows, 2.0) <= {(r["a_id"], r["b_id"]) for r in pairs}
    left, right = rows[::2], rows[1::2]
    met = spatial.cross_pairs(spark.createDataFrame(left, SEGMENT), spark.createDataFrame(right, SEGMENT), 2.0, 8.0).select("a_id", "b_id").collect()
    names = {r[0] for r in left}
    want = {(a, b) if a in names else (b, a) for a, b in _touching(rows, 2.0) if (a in names) != (b in names)}
    assert len(met) == len(set(met)) and want <= {tuple(r) for r in met}
    points = [(f"p{k}", r[2], r[3]) for k, r in enumerate(rows[:100])]
    near = spatial.point_segment_pairs(spark.createDataFrame(points, "a string, ax double, ay double"), spark.createDataFrame(rows, SEGMENT), 2.0, 8.0).collect()
    dots = [(a, 0, x, y, x, y) for a, x, y in points]
    assert {(r["a"], r["id"]) for r in near} == {(a, b) for a, b in _touching(rows + dots, 2.0) if (a in dict((p[0], 1) for p in points)) != (b in dict((p[0], 1) for p in points))}


def test_a_long_segment_does_not_meet_all_that_its_box_holds(spark):
    counts = []
    for side in (10, 20):
        grid = [(f"g{i:03}{j:03}", 0, 100.0 * i, 100.0 * j, 100.0 * i + 20, 100.0 * j) for i in range(side) for j in range(side)]
        grid += [(f"z{k}", 0, 50.0 + k, -50.0, 50.0 + k + 1e6, 1e6) for k in range(side)]
        counts.append(spatial.segment_pairs(spark.createDataFrame(grid, SEGMENT), 1.0, 8.0).count())
    # Four times the grid and twice the long ones, each along twice as many: four times as many pairs, where boxes would give eight.
    assert counts[1] <= 5 * counts[0]
