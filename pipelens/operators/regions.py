"""Regions of several polygons with holes: their area, each overlap once, and what touches them.

A region is rows (area_id, part, ring, pts): the rings of its polygons, ring 0 the outer one,
the others holes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipelens.functions import geometry as g
from pipelens.operators import spatial
from pipelens.operators.graph import cut

CELL = 32.0
#: Square metres of a hectare.
HECTARE = 10_000.0


def _edges(rings: DataFrame) -> DataFrame:
    """(id, seq, poly, x1, y1, x2, y2): the edges of all rings."""
    poly = F.concat_ws("/", "area_id", "part")
    rows = rings.where(F.size("pts") >= 3).select(poly.alias("poly"), "ring", F.posexplode(g.segments(g.closed(F.col("pts")))).alias("k", "s"))
    return rows.select(F.concat_ws("/", "poly", "ring", "k").alias("id"), F.lit(0).alias("seq"), "poly", F.col("s.p.x").alias("x1"), F.col("s.p.y").alias("y1"), F.col("s.q.x").alias("x2"), F.col("s.q.y").alias("y2"))


def _boxes(edges: DataFrame) -> tuple[DataFrame, float | None]:
    """The boxes of polygons (poly, lo_x, lo_y, hi_x, hi_y), and how large they are in the mean."""
    ends = {"lo": (F.min, F.least), "hi": (F.max, F.greatest)}
    boxes = edges.groupBy("poly").agg(*[f(of(f"{axis}1", f"{axis}2")).alias(f"{name}_{axis}") for name, (f, of) in ends.items() for axis in ("x", "y")])
    return boxes, boxes.agg(F.avg(F.greatest(F.col("hi_x") - F.col("lo_x"), F.col("hi_y") - F.col("lo_y")))).first()[0]


def _heights(edges: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """(poly, col, row, x0, x9, y): the slabs of each cell of a size, and where the edges of the polygons there are halfway; ``boxes`` are the polygons'."""
    cell = lambda v: F.floor(v / size)
    # A point on a border of cells belongs to both, a row up and a row down.
    both = lambda at: at.withColumn("col", F.explode(F.array_distinct(F.array(cell(F.col("x")), F.ceil(F.col("x") / size) - 1)))).withColumn("row", F.explode(F.array_distinct(F.array(cell(F.col("y")), F.ceil(F.col("y") / size) - 1))))
    pairs = spatial.segment_pairs(edges.select("id", "seq", "x1", "y1", "x2", "y2"), 0.0, CELL)
    crossed = pairs.select(g.crossing_point(spatial.segment_columns("a"), spatial.segment_columns("b")).alias("p")).where("p is not null").select("p.x", "p.y")
    corners = edges.select(F.col("x1").alias("x"), F.col("y1").alias("y")).unionByName(edges.select(F.col("x2").alias("x"), F.col("y2").alias("y")))
    first, last = cell(F.least("y1", "y2")) + 1, cell(F.greatest("y1", "y2"))
    passing = edges.where(first <= last).withColumn("line", F.explode(F.sequence(first, last)))
    passing = passing.withColumn("x", F.col("x1") + (F.col("line") * size - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1")))
    passing = passing.withColumn("row", F.explode(F.array(F.col("line") - 1, F.col("line")))).withColumn("col", F.explode(F.array_distinct(F.array(cell(F.col("x")), F.ceil(F.col("x") / size) - 1))))
    xs = both(corners.unionByName(crossed)).select("col", "row", "x").unionByName(passing.select("col", "row", "x"))
    flat = edges.where("x1 <> x2").select("poly", *[F.when(F.col("x1") < F.col("x2"), F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))])
    rows = boxes.select("poly", F.sequence(cell(F.col("lo_y")), cell(F.col("hi_y"))).alias("rows"))
    spread = flat.join(rows, "poly").withColumn("row", F.explode("rows")).withColumn("col", F.explode(F.sequence(cell(F.col("x1")), cell(F.col("x2"))))).drop("rows")
    spread = cut(spread)
    taken = spread.select("col", "row").distinct()
    borders = taken.select("col", "row", F.explode(F.array(F.col("col") * size, (F.col("col") + 1) * size)).alias("x"))
    xs = xs.where((F.col("x") >= F.col("col") * size) & (F.col("x") <= (F.col("col") + 1) * size)).unionByName(borders).distinct()
    after = F.lead("x").over(Window.partitionBy("col", "row").orderBy("x"))
    slabs = xs.select("col", "row", F.col("x").alias("x0"), after.alias("x9")).where("x9 > x0")
    middle = (F.col("x0") + F.col("x9")) / 2
    met = spread.join(slabs, ["col", "row"]).where((F.col("x1") <= middle) & (F.col("x2") > middle))
    return met.select("poly", "row", "col", "x0", "x9", (F.col("y1") + (middle - F.col("x1")) / (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("y"))


def covered(rings: DataFrame) -> DataFrame:
    """One row (areas, hectares): how many areas there are, and what they cover together; what several cover counts once, holes do not.

    The plane is cut into square cells about as large as a polygon, and each cell at every
    corner in it, every crossing of edges, and every place where an edge passes its lower or
    upper border, into slabs in which edges do not cross: there a polygon is the stretches
    between its edges, two by two, and the covered part is as long as their union halfway,
    times the slab's width. A polygon is looked at in the cells of its box only.
    """
    edges = cut(_edges(rings))
    areas = rings.agg(F.count_distinct("area_id").alias("areas"))
    boxes, size = _boxes(edges)
    if not size:
        return areas.withColumn("hectares", F.lit(0.0))
    heights = _heights(edges, boxes, size)
    ys = heights.groupBy("poly", "col", "row", "x0", "x9").agg(F.array_sort(F.collect_list("y")).alias("ys")).where("size(ys) >= 2")
    stretch = F.transform(F.sequence(F.lit(0), F.floor(F.size("ys") / 2) - 1), lambda i: F.struct(F.get("ys", (2 * i).cast("int")).alias("lo"), F.get("ys", (2 * i + 1).cast("int")).alias("hi")))
    runs = ys.select("col", "row", "x0", "x9", F.explode(stretch).alias("r"))
    # Of a stretch the part within the cell.
    runs = runs.select("col", "row", "x0", "x9", F.greatest("r.lo", F.col("row") * size).alias("lo"), F.least("r.hi", (F.col("row") + 1) * size).alias("hi")).where("hi > lo")
    above = F.max("hi").over(Window.partitionBy("col", "row", "x0", "x9").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
    piece = F.greatest(F.lit(0.0), F.col("hi") - F.greatest("lo", F.coalesce(above, F.col("lo"))))
    total = runs.select((piece * (F.col("x9") - F.col("x0"))).alias("a")).agg((F.coalesce(F.sum("a"), F.lit(0.0)) / HECTARE).alias("hectares"))
    return areas.withColumn("one", F.lit(1)).join(total.withColumn("one", F.lit(1)), "one").drop("one")


def points_in(points: DataFrame, rings: DataFrame) -> DataFrame:
    """(a, area_id): points (a, ax, ay) in or on the edge of a polygon and not within its holes; a hole's edge belongs to the polygon."""
    own = rings.select(F.struct("area_id", "part").alias("poly"), "ring", g.closed(F.col("pts")).alias("pts"))
    of = lambda where: own.where(where).select(F.struct("poly", "ring").alias("area_id"), F.col("pts").alias("ring"))
    inside = spatial.in_areas(points, of("ring = 0"), CELL).select("a", F.col("area_id.poly").alias("poly"))
    out = spatial.in_areas(points, of("ring > 0"), CELL).where("strict").select("a", F.col("area_id.poly").alias("poly"))
    return inside.join(out, ["a", "poly"], "left_anti").select("a", F.col("poly.area_id").alias("area_id")).distinct()


def lines_touching(lines: DataFrame, rings: DataFrame) -> DataFrame:
    """(a, area_id): lines (a, pts) that have a point in a region or meet one of its edges."""
    corners = lines.select("a", F.posexplode("pts").alias("k", "p"))
    inside = points_in(corners.select(F.struct("a", "k").alias("a"), F.col("p.x").alias("ax"), F.col("p.y").alias("ay")), rings).select(F.col("a.a").alias("a"), "area_id")
    edges = _edges(rings).withColumn("id", F.struct("id", "poly"))
    met = spatial.cross_pairs(spatial.line_segments(lines, "a"), edges.select("id", "seq", "x1", "y1", "x2", "y2"), 0.0, CELL)
    near = met.where(g.segment_segment(spatial.segment_columns("a"), spatial.segment_columns("b")) == 0)
    return inside.unionByName(near.select(F.col("a_id").alias("a"), F.regexp_extract("b_id.poly", "^(.*)/[^/]*$", 1).alias("area_id"))).distinct()
