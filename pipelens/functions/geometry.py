"""Planar geometry as column expressions on arrays of points and on segment columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def point_segment(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point to a segment; a segment of no length is its first point."""
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    # No branches: what is computed in any case, generated code computes once. Without a length the quotient is null, which greatest passes over.
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - x1) * dx + (py - y1) * dy) / F.nullif(length2, F.lit(0.0))))
    return distance(px, py, x1 + t * dx, y1 + t * dy)


def cross(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def properly_cross(a: list[Column], b: list[Column]) -> Column:
    """Whether the interiors of two segments (x1, y1, x2, y2) meet in one point."""
    s1, s2 = cross(*a, b[0], b[1]), cross(*a, b[2], b[3])
    s3, s4 = cross(*b, a[0], a[1]), cross(*b, a[2], a[3])
    return (s1 * s2 < 0) & (s3 * s4 < 0)


def overlap(a: list[Column], b: list[Column]) -> Column:
    """Whether two segments lie on one line and share a stretch of some length."""
    on_line = (cross(*a, b[0], b[1]) == 0) & (cross(*a, b[2], b[3]) == 0) & (cross(*b, a[0], a[1]) == 0) & (cross(*b, a[2], a[3]) == 0)
    lo = [F.greatest(F.least(a[i], a[i + 2]), F.least(b[i], b[i + 2])) for i in (0, 1)]
    hi = [F.least(F.greatest(a[i], a[i + 2]), F.greatest(b[i], b[i + 2])) for i in (0, 1)]
    return on_line & (lo[0] <= hi[0]) & (lo[1] <= hi[1]) & ((lo[0] < hi[0]) | (lo[1] < hi[1]))


def segment_segment(a: list[Column], b: list[Column]) -> Column:
    """Distance of two segments: 0 where they cross, else the least of the ends' distances."""
    ends = F.least(
        point_segment(a[0], a[1], *b), point_segment(a[2], a[3], *b), point_segment(b[0], b[1], *a), point_segment(b[2], b[3], *a)
    )
    return F.least(F.when(properly_cross(a, b), F.lit(0.0)), ends)


def pairs_of(pts: Column) -> Column:
    """Consecutive points of a line as an array of (p, q)."""
    return F.transform(F.sequence(F.lit(1), F.size(pts) - 1), lambda i: F.struct(F.element_at(pts, i).alias("p"), F.element_at(pts, i + 1).alias("q")))


def segments(pts: Column) -> Column:
    """The segments of a line of two points or more; none of others."""
    none = F.array().cast("array<struct<p:struct<x:double,y:double>,q:struct<x:double,y:double>>>")
    return F.when(F.size(pts) >= 2, pairs_of(pts)).otherwise(none)


def length(pts: Column) -> Column:
    return F.aggregate(segments(pts), F.lit(0.0), lambda acc, s: acc + distance(s["p"]["x"], s["p"]["y"], s["q"]["x"], s["q"]["y"]))


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def max_offset(pts: Column) -> Column:
    """Largest distance of the inner points to the segment from the first to the last."""
    a, b = F.element_at(pts, 1), F.element_at(pts, -1)
    inner = F.slice(pts, 2, F.greatest(F.size(pts) - 2, F.lit(0)))
    return F.array_max(F.transform(inner, lambda p: point_segment(p["x"], p["y"], a["x"], a["y"], b["x"], b["y"])))


def angles(pts: Column) -> Column:
    """Degrees between the two segments at each inner point; 180 is straight. Segments of no length give null."""

    def at(i):
        a, b, c = F.element_at(pts, i), F.element_at(pts, i + 1), F.element_at(pts, i + 2)
        ux, uy, vx, vy = a["x"] - b["x"], a["y"] - b["y"], c["x"] - b["x"], c["y"] - b["y"]
        norm = F.nullif(F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy), F.lit(0.0))
        return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ux * vx + uy * vy) / norm))))

    return F.when(F.size(pts) >= 3, F.transform(F.sequence(F.lit(1), F.size(pts) - 2), at)).otherwise(F.array().cast("array<double>"))


def shoelace(ring: Column) -> Column:
    """Area of a closed ring of points."""
    twice = F.aggregate(segments(ring), F.lit(0.0), lambda acc, s: acc + s["p"]["x"] * s["q"]["y"] - s["q"]["x"] * s["p"]["y"])
    return F.abs(twice) / 2


def in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Whether a point lies in a closed ring, its edge included."""
    crossings = F.aggregate(
        segments(ring),
        F.lit(0),
        lambda acc, s: acc
        + F.when(
            ((s["p"]["y"] > py) != (s["q"]["y"] > py))
            & (px < (s["q"]["x"] - s["p"]["x"]) * (py - s["p"]["y"]) / F.nullif(s["q"]["y"] - s["p"]["y"], F.lit(0.0)) + s["p"]["x"]),
            1,
        ).otherwise(0),
    )
    return (crossings % 2 == 1) | on_ring(px, py, ring)


def on_ring(px: Column, py: Column, ring: Column) -> Column:
    """Whether a point lies on the edge of a closed ring."""
    return F.exists(segments(ring), lambda s: point_segment(px, py, s["p"]["x"], s["p"]["y"], s["q"]["x"], s["q"]["y"]) == 0)


def closed(ring: Column) -> Column:
    """The ring with its first point at its end."""
    return F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.array(F.element_at(ring, 1))))


def foot(px: Column, py: Column, s: list[Column]) -> Column:
    """The point of a segment that is nearest to a point."""
    dx, dy = s[2] - s[0], s[3] - s[1]
    length2 = dx * dx + dy * dy
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - s[0]) * dx + (py - s[1]) * dy) / F.nullif(length2, F.lit(0.0))))
    return F.struct((s[0] + t * dx).alias("x"), (s[1] + t * dy).alias("y"))


def crossing_point(a: list[Column], b: list[Column]) -> Column:
    """The point in which the insides of two segments cross, else null."""
    s1, s2 = cross(*b, a[0], a[1]), cross(*b, a[2], a[3])
    t = s1 / F.nullif(s1 - s2, F.lit(0.0))
    return F.when(properly_cross(a, b), F.struct((a[0] + t * (a[2] - a[0])).alias("x"), (a[1] + t * (a[3] - a[1])).alias("y")))


def with_approach(rows: DataFrame, a: list[Column], b: list[Column]) -> DataFrame:
    """Adds x and y: the middle of the nearest points of two segments, where they cross, or of the first of the four ends that is nearest.

    In steps, so that each is small and computed once.
    """
    names = [f"_{side}{k}" for side in "ab" for k in range(4)]
    rows = rows.withColumns(dict(zip(names, [*a, *b], strict=True)))
    a, b = [F.col(n) for n in names[:4]], [F.col(n) for n in names[4:]]
    ways = [(a[0], a[1], b), (a[2], a[3], b), (b[0], b[1], a), (b[2], b[3], a)]
    rows = rows.withColumn("_best", F.array_min(F.array(*[F.struct(point_segment(x, y, *s).alias("d"), F.lit(k).alias("k")) for k, (x, y, s) in enumerate(ways)]))["k"]).withColumn("_cross", crossing_point(a, b))
    pick = lambda values: F.get(F.array(*values), F.col("_best"))
    chosen = {"_px": pick([w[0] for w in ways]), "_py": pick([w[1] for w in ways]), **{f"_s{k}": pick([w[2][k] for w in ways]) for k in range(4)}}
    rows = rows.withColumns(chosen).withColumn("_foot", foot(F.col("_px"), F.col("_py"), [F.col(f"_s{k}") for k in range(4)]))
    place = {axis: F.coalesce(F.col("_cross")[axis], (F.col(f"_p{axis}") + F.col("_foot")[axis]) / 2) for axis in ("x", "y")}
    return rows.withColumns(place).drop(*names, *chosen, "_best", "_cross", "_foot")


def midpoint(pts: Column) -> Column:
    """The point halfway along a line; of a point, the point."""
    half = length(pts) / 2
    start = F.struct(F.lit(0.0).alias("done"), F.element_at(pts, 1).alias("at"))

    def step(acc, s):
        n = distance(s["p"]["x"], s["p"]["y"], s["q"]["x"], s["q"]["y"])
        inside = (acc["done"] <= half) & (half <= acc["done"] + n) & (n > 0)
        t = (half - acc["done"]) / F.nullif(n, F.lit(0.0))
        at = F.struct((s["p"]["x"] + t * (s["q"]["x"] - s["p"]["x"])).alias("x"), (s["p"]["y"] + t * (s["q"]["y"] - s["p"]["y"])).alias("y"))
        return F.struct((acc["done"] + n).alias("done"), F.when(inside, at).otherwise(acc["at"]).alias("at"))

    return F.aggregate(segments(pts), start, step, lambda acc: acc["at"])
