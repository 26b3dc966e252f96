"""Study areas: reading them, what they cover together, and what touches them."""

import json
import math
import random

import pytest

from pipelens.operators import regions
from pipelens.sources import geojson

SQUARE = [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]
HOLE = [[2, 2], [4, 2], [4, 4], [2, 4], [2, 2]]
DDL = "area_id string, part string, ring int, pts array<struct<x:double,y:double>>"


def rings(spark, polygons):
    """Polygons as lists of rings, each its own part of area A."""
    return spark.createDataFrame([("A", str(k), r, [(float(x), float(y)) for x, y in pts]) for k, p in enumerate(polygons) for r, pts in enumerate(p)], DDL)


def hectares(spark, polygons):
    return regions.covered(rings(spark, polygons)).first()["hectares"]


def in_ring(x, y, pts):
    odd = False
    for (a, b), (c, d) in zip(pts, pts[1:] + pts[:1], strict=True):
        if (b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a:
            odd = not odd
    return odd


@pytest.mark.parametrize(
    ("polygons", "square_metres"),
    [
        ([[SQUARE]], 100),
        ([[SQUARE, HOLE]], 96),
        ([[SQUARE, HOLE], [HOLE]], 100),  # the hole is covered by another polygon
        ([[SQUARE], [SQUARE]], 100),
        ([[SQUARE], [[[5, 5], [15, 5], [15, 15], [5, 15]]]], 175),  # an open ring is closed
        ([[SQUARE], [[[-5, 5], [5, -5], [15, 5], [5, 15]]]], 100 + 4 * 25),  # edges cross between corners
        ([[[[0, 0], [10, 0], [0, 10], [10, 10]]]], 50),  # a bow tie by even-odd
        ([[[[0, 0], [4, 0], [4, 4], [2, 1], [0, 4]]]], 10),  # concave
    ],
)
def test_covered_area(spark, polygons, square_metres):
    assert hectares(spark, polygons) * 10_000 == pytest.approx(square_metres)


def test_slabs_grow_with_the_polygons(spark):
    counts = []
    for n in (30, 60):
        tower = [[[[k % 7 * 1.3, 20 * k], [k % 7 * 1.3 + 10, 20 * k], [k % 7 * 1.3 + 10, 20 * k + 10], [k % 7 * 1.3, 20 * k + 10]]] for k in range(n)]
        edges = regions._edges(rings(spark, tower))
        counts.append(regions._heights(edges, *regions._boxes(edges)).count())
        assert hectares(spark, tower) * 10_000 == pytest.approx(100 * n)
    # Polygons above each other have no slabs in common.
    assert counts[1] <= 2.2 * counts[0]


def test_covered_area_of_many_against_sampling(spark):
    rng = random.Random(3)
    polygons = []
    for _ in range(12):
        x, y, n = rng.uniform(0, 60), rng.uniform(0, 60), rng.randint(3, 9)
        star = lambda r: [(x + r * rng.uniform(0.5, 1) * math.cos(2 * math.pi * k / n), y + r * rng.uniform(0.5, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]  # noqa: B023, E731
        polygons.append([star(15), [(x + 1, y + 1), (x - 1, y + 1), (x, y - 2)]])
    hits = sum(any(sum(in_ring(x + 0.013, y + 0.017, r) for r in p) % 2 for p in polygons) for x in (k / 4 for k in range(-80, 320)) for y in (k / 4 for k in range(-80, 320)))
    assert hectares(spark, polygons) * 10_000 == pytest.approx(hits / 16, rel=0.01)


def test_no_area(spark):
    assert regions.covered(spark.createDataFrame([], DDL)).first().asDict() == {"areas": 0, "hectares": 0.0}


def test_what_touches_a_region(spark):
    region = rings(spark, [[SQUARE, HOLE], [[[20, 0], [30, 0], [20, 10]]]])
    points = {"in": (1, 1), "hole": (3, 3), "rim": (2, 3), "edge": (10, 5), "out": (15, 5), "second": (21, 1), "beyond": (29, 9)}
    frame = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in points.items()], "a string, ax double, ay double")
    assert {tuple(r) for r in regions.points_in(frame, region).collect()} == {(k, "A") for k in ("in", "rim", "edge", "second")}
    lines = {"across": [(-5, 5), (15, 5)], "within hole": [(2.5, 3), (3.5, 3)], "hole to hole": [(3, 3), (3, 3.5)], "out of hole": [(3, 3), (3, 6)], "past": [(12, 0), (12, 9)], "corner": [(9, 11), (11, 9)], "touches": [(10, 10), (12, 12)]}
    frame = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in v]) for k, v in lines.items()], "a string, pts array<struct<x:double,y:double>>")
    assert {tuple(r) for r in regions.lines_touching(frame, region).collect()} == {(k, "A") for k in ("across", "out of hole", "corner", "touches")}


def test_geojson(spark, tmp_path):
    poly = {"type": "Polygon", "coordinates": [SQUARE, HOLE]}
    multi = {"type": "MultiPolygon", "coordinates": [[SQUARE], [[[20, 0, 7], [30, 0, 7], [20, 10, 7], [20, 0, 7]]]]}
    files = {"bare": poly, "feature": {"type": "Feature", "properties": {"a": 1}, "geometry": multi}, "all.v2": {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": poly}, {"type": "Feature", "geometry": None}, {"type": "Feature", "geometry": multi}]}}
    want = {"bare": 96, "feature": 150, "all.v2": 150}
    for name, content in files.items():
        (tmp_path / f"{name}.geojson").write_text(json.dumps(content, indent=1))
        found = geojson.read(spark, str(tmp_path / f"{name}.geojson"))
        assert {r["area_id"] for r in found.select("area_id").collect()} == {name}
        assert regions.covered(found).first()["hectares"] * 10_000 == pytest.approx(want[name])
    for text in ("no json", '{"type": "FeatureCollection", "features": []}', '{"type": "Point", "coordinates": [1, 2]}'):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(ValueError, match="bad"):
            geojson.read(spark, str(tmp_path / "bad.json"))
