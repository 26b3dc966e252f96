"""Spatial joins by grid cells: an equi-join on cells and then the exact test.

Points are dealt to one cell and looked for in the cells around. A segment has a level by
the size of its box: at level k cells are 2^k times as wide as at level 0 and at least as
wide as the box, so that it touches four cells at most whatever its length. Segments of
levels up to FINE are all dealt to the cells of level GRID that their boxes touch, five by
five at most, and meet there. A pair is taken only in the cell of the lower left corner of
what the two boxes share, so that it comes out once without a distinct.

Longer segments go down instead: from the cells of the largest level to those child cells
that their strip crosses and that hold something, until cells are those of level FINE, and
then to those of level GRID. So a long segment meets what lies along it and not all that
lies in its box. Among themselves long segments go down only from cells that hold many of
them. Only ids and ends of segments are shuffled; boxes are worked out again.

Cells are whole numbers held as doubles: a coordinate of any finite size has one. Points
and segments with a coordinate that is missing or not finite are near nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipelens.functions import geometry as g
from pipelens.operators.graph import cut, written

#: Segments of levels up to this one meet in cells of the level GRID; longer ones go down to the cells of this level first.
FINE, GRID = 3, 1
#: Levels of one step down, and long segments that may share a cell without going down further.
STEP, LEAF = 3, 256

_COLUMNS = ("id", "seq", "x1", "y1", "x2", "y2")


def _cell(v: Column, size: Column | float) -> Column:
    """The number of the cell of a coordinate, cut towards zero."""
    return v / size - (v / size) % 1


def _cells(lo: Column, hi: Column, size: Column | float, *more: Column) -> Column:
    """The cells of an interval no longer than a cell; ``more`` are points in it."""
    return F.array_distinct(F.array(*[_cell(v, size) for v in (lo, *more, hi)]))


def point_pairs(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """(left.*, right.*, dist): points (a, ax, ay) and (b, bx, by) no further apart than ``radius``."""
    size = max(6 * radius, 1e-6)
    near = left.where(g.finite(F.col("ax")) & g.finite(F.col("ay"))).withColumn("cx", F.explode(_cells(F.col("ax") - radius, F.col("ax") + radius, size, F.col("ax"))))
    near = near.withColumn("cy", F.explode(_cells(F.col("ay") - radius, F.col("ay") + radius, size, F.col("ay"))))
    cells = right.where(g.finite(F.col("bx")) & g.finite(F.col("by"))).withColumn("cx", _cell(F.col("bx"), size)).withColumn("cy", _cell(F.col("by"), size))
    dist = g.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return near.join(cells, ["cx", "cy"]).withColumn("dist", dist).where(F.col("dist") <= radius).drop("cx", "cy")


def nearest(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """(a, b, dist): for each left point the nearest right one within ``radius``; ties go to the smallest b."""
    best = point_pairs(left, right, radius).groupBy("a").agg(F.min(F.struct("dist", "b")).alias("m"))
    return best.select("a", F.col("m.b").alias("b"), F.col("m.dist").alias("dist"))


def line_segments(lines: DataFrame, id_column: str, reach: Column | None = None, tips: Column | None = None, closed: Column | None = None) -> DataFrame:
    """(id, seq, x1, y1, x2, y2) of lines with a column ``pts``, and ``reach`` where it is given.

    With ``tips``, whether a line's ends count, also ``tip``: 1 if the segment starts the line, 2 if it ends it, 3 if both, else 0; and 4 more if the line is ``closed``.
    """
    more = ([] if reach is None else [reach.alias("reach")]) + ([] if tips is None else [F.when(tips, F.size("pts")).alias("n")]) + ([] if closed is None else [closed.alias("closed")])
    rows = lines.select(F.col(id_column).alias("id"), *more, F.posexplode(g.segments(F.col("pts"))).alias("seq", "s"))
    tip = F.when(F.col("seq") == 0, 1).otherwise(0) + F.when(F.col("seq") == F.col("n") - 2, 2).otherwise(0) if tips is not None else None
    tip = tip + F.when(F.col("closed"), 4).otherwise(0) if closed is not None else tip
    return rows.select(
        "id", "seq", F.col("s.p.x").alias("x1"), F.col("s.p.y").alias("y1"), F.col("s.q.x").alias("x2"), F.col("s.q.y").alias("y2"),
        *([] if reach is None else ["reach"]), *([] if tips is None else [F.when(F.col("n").isNotNull(), tip).otherwise(0).alias("tip")]),
    )


def _boxed(segments: DataFrame, size: float, margin: Column) -> DataFrame:
    """Adds the box of each segment with a margin around it (lo_x, lo_y, hi_x, hi_y), and its level."""
    finite = [g.finite(F.col(c)) for c in ("x1", "y1", "x2", "y2")]
    out = segments.where(finite[0] & finite[1] & finite[2] & finite[3])
    for axis in ("x", "y"):
        out = out.withColumn(f"lo_{axis}", F.least(f"{axis}1", f"{axis}2") - margin).withColumn(f"hi_{axis}", F.greatest(f"{axis}1", f"{axis}2") + margin)
    # Far from the origin cells are no smaller than what a double tells apart there.
    far = F.greatest(*[F.abs(f"{end}_{axis}") for end in ("lo", "hi") for axis in ("x", "y")]) * 1e-12
    extent = F.greatest(F.col("hi_x") - F.col("lo_x"), F.col("hi_y") - F.col("lo_y"), far)
    # A box that is wider than all numbers has the last level.
    level = F.when(extent * 1.0001 <= size, 0).when(g.finite(extent), F.ceil(F.log2(extent * 1.0001 / size))).otherwise(1024)
    return out.withColumn("level", level.cast("int"))


def _levels(boxed: DataFrame) -> list[int]:
    """The levels that occur: a few dozen numbers at most."""
    return sorted(r["level"] for r in boxed.select("level").distinct().collect())


def _split(boxed: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """The segments of levels up to FINE, the longer ones, which are few and read in steps, and the levels of these. Boxes are written first, so that what is done with them is compiled apart."""
    boxed = written(boxed)
    longs = cut(boxed.where(F.col("level") > FINE))
    return boxed.where(F.col("level") <= FINE), longs, _levels(longs)


def _size(level: Column, size: float) -> Column:
    return F.pow(F.lit(2.0), level) * size


def _dealt(boxed: DataFrame, size: float) -> DataFrame:
    """A row for each cell (level, cx, cy) that a box touches at its level."""
    wide = _size(F.col("level"), size)
    for axis in ("x", "y"):
        boxed = boxed.withColumn(f"c{axis}", F.explode(_cells(F.col(f"lo_{axis}"), F.col(f"hi_{axis}"), wide)))
    return boxed


def _spread(boxed: DataFrame, size: float) -> DataFrame:
    """A row for each cell (cx, cy) of level GRID that the box of a segment of level FINE at most touches."""
    for axis in ("x", "y"):
        first, last = (_cell(F.col(f"{end}_{axis}"), 2.0**GRID * size) for end in ("lo", "hi"))
        boxed = boxed.withColumn("first", first).withColumn("step", F.explode(F.sequence(F.lit(0), (last - first).cast("int")))).withColumn(f"c{axis}", F.col("first") + F.col("step")).drop("first", "step")
    return boxed


def _apart(first: str, second: str, reach: Column) -> Column:
    """Whether the second segment is surely further than ``reach`` from the line through the first: a bound without a division."""
    a = [F.col(f"{first}_{c}") for c in ("x1", "y1", "x2", "y2")]
    x1, y1, x2, y2 = (F.col(f"{second}_{c}") for c in ("x1", "y1", "x2", "y2"))
    x, y, length = (x1 + x2) / 2, (y1 + y2) / 2, g.distance(*a)
    off = F.abs(g.cross(*a, x, y))
    # What the rounding of the cross product can add, for lines of any length.
    slack = 1e-9 + 1e-12 * length * (length + g.distance(a[0], a[1], x, y))
    return (off < float("inf")) & (off > (reach + g.distance(x1, y1, x2, y2) / 2) * length + slack)


def _up(cell: Column, levels: int) -> Column:
    """The cell so many levels above that holds a cell."""
    return _cell(cell, float(2**levels))


def _crossed(wide: float) -> Column:
    """Whether the strip of a segment with its box (x1, y1, x2, y2, lo_x, ...) meets the cell (cx, cy) of that width: boxes overlap, and the cell is not beside the strip."""
    middle, half = {}, {}
    for axis in ("x", "y"):
        cell = F.col(f"c{axis}")
        lo, hi = F.when(cell > 0, cell).otherwise(cell - 1) * wide, F.when(cell < 0, cell).otherwise(cell + 1) * wide
        middle[axis], half[axis] = (lo + hi) / 2, (hi - lo) / 2
    boxes = (F.abs((F.col("lo_x") + F.col("hi_x")) / 2 - middle["x"]) <= (half["x"] + (F.col("hi_x") - F.col("lo_x")) / 2) * 1.000001) & (
        F.abs((F.col("lo_y") + F.col("hi_y")) / 2 - middle["y"]) <= (half["y"] + (F.col("hi_y") - F.col("lo_y")) / 2) * 1.000001
    )
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    off = F.abs(dx * (middle["y"] - F.col("y1")) - dy * (middle["x"] - F.col("x1")))
    margin = F.least("x1", "x2") - F.col("lo_x")
    length = F.sqrt(dx * dx + dy * dy)
    reach = F.abs(dy) * half["x"] + F.abs(dx) * half["y"] + margin * length
    # What rounding can add, for segments and cells of any size; a product that is beyond all numbers tells nothing.
    slack = 1e-9 + 1e-12 * length * (F.abs(middle["x"]) + F.abs(middle["y"]) + F.abs("x1") + F.abs("y1"))
    return boxes & ~F.coalesce((off < float("inf")) & (off > reach * 1.000001 + slack), F.lit(False))


def _top(levels: list[int]) -> int:
    """The level that long segments start from."""
    return FINE + STEP * -(-(max(levels) - FINE) // STEP)


def _at_level(boxed: DataFrame, level: int, size: float) -> DataFrame:
    """The rows in the cells of one level, which is theirs or a larger one."""
    return _dealt(boxed.withColumn("level", F.lit(level)), size)


def _down(rows: DataFrame, size: float, level: int, levels: int = STEP) -> DataFrame:
    """Rows (with cx, cy) of the cells so many levels above ``level`` in the cells of that level that they cross."""
    factor = 2**levels
    inner = lambda lo, hi: F.array(*[F.lit(float(k)) for k in range(lo, hi)])
    for axis in ("x", "y"):
        cell = F.col(f"c{axis}")
        steps = F.when(cell > 0, inner(0, factor)).when(cell < 0, inner(1 - factor, 1)).otherwise(inner(1 - factor, factor))
        rows = rows.withColumn("step", F.explode(steps)).withColumn(f"c{axis}", cell * factor + F.col("step")).drop("step")
    return rows.withColumn("level", F.lit(level)).where(_crossed(2.0**level * size))


def _along(longs: DataFrame, levels: list[int], occupied: DataFrame, size: float) -> DataFrame:
    """The long segments in those cells of level GRID that they cross and that lie in cells of level FINE in ``occupied`` (cx, cy)."""
    top, occupied = _top(levels), cut(occupied)
    rows = cut(_at_level(longs, top, size))
    while top > FINE:
        top -= STEP
        there = occupied.select(*[_up(F.col(f"c{axis}"), top - FINE).alias(f"c{axis}") for axis in ("x", "y")]).distinct()
        # Written at each step: steps that are compiled as one take far longer than all of them apart.
        rows = cut(_down(rows, size, top).join(there, ["cx", "cy"], "left_semi"))
    return cut(_down(rows, size, GRID, FINE - GRID))


def _leaves(longs: DataFrame, levels: list[int], size: float) -> DataFrame:
    """The long segments in cells (level, cx, cy) that hold LEAF of them at most, or are of level FINE; two that come near each other share one."""
    level = _top(levels)
    rows, out = cut(_at_level(longs, level, size)), None
    while True:
        crowded = rows.groupBy("level", "cx", "cy").agg(F.count("*").alias("n")).where(F.col("n") > LEAF).drop("n")
        last = level <= FINE or crowded.isEmpty()
        done = rows if last else rows.join(crowded, ["level", "cx", "cy"], "left_anti")
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        rows, level = cut(_down(rows.join(crowded, ["level", "cx", "cy"], "left_semi"), size, level - STEP)), level - STEP


_KEY = ("p_id", "p_seq", "q_id", "q_seq")


def _box(side: str, end: str, axis: str, margin: Column) -> Column:
    """The lower ("lo") or upper ("hi") end of the box of segment p or q, as ``_boxed`` has it."""
    of = (f"{side}_{axis}1", f"{side}_{axis}2")
    return F.least(*of) - margin if end == "lo" else F.greatest(*of) + margin


def _shared_box(margins: dict[str, Column]) -> tuple[dict[str, Column], Column]:
    """The lower corner of what the boxes of two segments share, and whether they overlap; ``margins`` has the two sides."""
    box = lambda end, axis: [_box(side, end, axis, margin) for side, margin in margins.items()]
    corner = {axis: F.greatest(*box("lo", axis)) for axis in ("x", "y")}
    return corner, (corner["x"] <= F.least(*box("hi", "x"))) & (corner["y"] <= F.least(*box("hi", "y")))


def boxes_meet(radius: float, reach: bool = False) -> Column:
    """Whether the boxes of a pair of segments a and b overlap, with the margins that ``segment_pairs`` gives them."""
    return _shared_box({side: (F.col(f"{side}_reach") if reach else F.lit(0.0)) + radius / 2 + 1e-9 for side in "ab"})[1]


def _met(margins: dict[str, Column], size: float) -> tuple[Column, Column]:
    """Whether the boxes of p and q overlap, and whether a cell (cx, cy) of level GRID holds the corner of what they share."""
    corner, meet = _shared_box(margins)
    once = (F.col("cx") == _cell(corner["x"], 2.0**GRID * size)) & (F.col("cy") == _cell(corner["y"], 2.0**GRID * size))
    return meet, once


def _side(rows: DataFrame, side: str, columns: list[str], *more: str) -> DataFrame:
    """The columns of p or q."""
    return rows.select(*more, *[_known(F.col(c), c).alias(f"{side}_{c}") for c in columns])


def _known(value: Column, column: str) -> Column:
    """A column of a segment. Boxed segments have no null coordinates, and code for columns that are never null is short enough for the compiler."""
    return F.coalesce(value, F.lit(0 if column == "tip" else 0.0)) if column in ("x1", "y1", "x2", "y2", "tip") else value


def segment_pairs(segments: DataFrame, radius: float, size: float, useless: Callable[[list, list], Column] | None = None) -> DataFrame:
    """Pairs of segments of different lines (a.id < b.id) that may lie within ``radius`` of each other, each pair once.

    With a column ``reach`` two segments may lie within the sum of theirs and ``radius``; a column ``tip`` is kept where ``useless`` does not take it.
    ``useless`` tells of two segments (x1, y1, x2, y2, tip), in either order, whether their pair is not asked for.
    """
    columns = [*_COLUMNS, *[c for c in ("reach", "tip") if c in segments.columns]]
    own = lambda c: (F.col(c) if "reach" in columns else F.lit(0.0)) + radius / 2 + 1e-9
    both = F.lit(radius) + ((F.col("p_reach") + F.col("q_reach")) if "reach" in columns else F.lit(0.0))
    meet, once = _met({side: own(f"{side}_reach") for side in "pq"}, size)
    near = ~_apart("p", "q", both) & ~_apart("q", "p", both)
    if useless is not None:
        meet = meet & ~useless(*[[F.col(f"{side}_{c}") for c in (*_COLUMNS[2:], "tip")] for side in "pq"])
    small, longs, levels = _split(_boxed(segments, size, own("reach")))
    cells = _spread(small, size).select("cx", "cy", *columns)
    p, q = _side(cells, "p", columns, "cx", "cy"), _side(cells, "q", columns, "cx", "cy")
    ordered = F.col("p_id") < F.col("q_id")
    kept = [c for c in columns if c != "tip" or useless is None]
    written_columns = [f"{side}_{c}" for side in "pq" for c in kept]
    # Written, so that exact tests are compiled apart from the join.
    found = written(p.join(q, ["cx", "cy"]).where(ordered & once & meet).select(*written_columns))
    if levels:
        strips = _side(_along(longs, levels, _at_level(small, FINE, size).select("cx", "cy").distinct(), size), "p", columns, "cx", "cy")
        leaves = cut(_leaves(longs, levels, size))
        mixed = strips.join(q, ["cx", "cy"]).where((F.col("p_id") != F.col("q_id")) & meet & near)
        alike = _side(leaves, "p", columns, "level", "cx", "cy").join(_side(leaves, "q", columns, "level", "cx", "cy"), ["level", "cx", "cy"]).where(ordered & meet & near)
        found = found.unionByName(cut(mixed.select(*written_columns).unionByName(alike.select(*written_columns)).dropDuplicates(_KEY)))
    return found.select(*[_known(F.when(ordered, F.col(f"{own}_{c}")).otherwise(F.col(f"{other}_{c}")), c).alias(f"{side}_{c}") for side, own, other in (("a", "p", "q"), ("b", "q", "p")) for c in kept])


def cross_pairs(lines: DataFrame, edges: DataFrame, radius: float, size: float) -> DataFrame:
    """Pairs of a segment of ``lines`` (a) and one of ``edges`` (b) that may lie within ``radius`` of each other, each pair once."""
    margin, columns = F.lit(radius / 2 + 1e-9), list(_COLUMNS)
    meet, once = _met({"p": margin, "q": margin}, size)
    near = meet & ~_apart("p", "q", F.lit(radius)) & ~_apart("q", "p", F.lit(radius))
    parts = {side: _split(_boxed(df, size, margin)) for side, df in (("p", lines), ("q", edges))}
    cells = {side: _side(_spread(small, size), side, columns, "cx", "cy") for side, (small, _, _) in parts.items()}
    found = cells["p"].join(cells["q"], ["cx", "cy"]).where(once & meet).drop("cx", "cy")
    more = []
    for side, other in (("p", "q"), ("q", "p")):
        _, longs, levels = parts[side]
        if levels:
            strips = _along(longs, levels, _at_level(parts[other][0], FINE, size).select("cx", "cy").distinct(), size)
            more.append(_side(strips, side, columns, "cx", "cy").join(cells[other], ["cx", "cy"]).where(near))
    levels = sorted({*parts["p"][2], *parts["q"][2]})
    if parts["p"][2] and parts["q"][2]:
        both = parts["p"][1].withColumn("left", F.lit(True)).unionByName(parts["q"][1].withColumn("left", F.lit(False)))
        leaves = cut(_leaves(both, levels, size))
        more.append(_side(leaves.where("left"), "p", columns, "level", "cx", "cy").join(_side(leaves.where("not left"), "q", columns, "level", "cx", "cy"), ["level", "cx", "cy"]).where(near))
    found = written(found)
    names = [f"{side}_{c}" for side in "pq" for c in columns]
    for rows in more:
        found = found.unionByName(cut(rows.select(*names).dropDuplicates(_KEY)))
    return found.select(*[_known(F.col(f"{of}_{c}"), c).alias(f"{side}_{c}") for side, of in (("a", "p"), ("b", "q")) for c in columns])


def in_areas(points: DataFrame, areas: DataFrame, size: float) -> DataFrame:
    """(a, area_id, strict): points (a, ax, ay) within or on the edge of areas (area_id, ring); strict is whether they are not on the edge."""
    box = lambda f, axis: f(F.transform("ring", lambda p: p[axis]))
    ends = areas.where(F.size("ring") >= 3).select("area_id", "ring", box(F.array_min, "x").alias("x1"), box(F.array_min, "y").alias("y1"), box(F.array_max, "x").alias("x2"), box(F.array_max, "y").alias("y2"))
    boxed = cut(_boxed(ends, size, F.lit(0.0)))
    levels = _levels(boxed) or [0]
    wide = _size(F.col("level"), size)
    placed = points.where(g.finite(F.col("ax")) & g.finite(F.col("ay"))).withColumn("level", F.explode(F.array(*[F.lit(k) for k in levels])))
    placed = placed.withColumn("cx", _cell(F.col("ax"), wide)).withColumn("cy", _cell(F.col("ay"), wide))
    near = placed.join(_dealt(boxed, size), ["level", "cx", "cy"]).where(F.col("ax").between(F.col("lo_x"), F.col("hi_x")) & F.col("ay").between(F.col("lo_y"), F.col("hi_y")))
    inside = near.where(g.in_ring(F.col("ax"), F.col("ay"), F.col("ring")))
    return inside.select("a", "area_id", (~g.on_ring(F.col("ax"), F.col("ay"), F.col("ring"))).alias("strict"))


def point_segment_pairs(points: DataFrame, segments: DataFrame, radius: float, size: float) -> DataFrame:
    """(a, id, dist): points (a, ax, ay) and lines within ``radius``, with the least distance."""
    small, longs, levels = _split(_boxed(segments, size, F.lit(radius)))
    placed = points.where(g.finite(F.col("ax")) & g.finite(F.col("ay"))).select("a", "ax", "ay")
    dist = g.point_segment(F.col("ax"), F.col("ay"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    inside = F.lit(True)
    for axis in ("x", "y"):
        inside = inside & F.col(f"a{axis}").between(F.least(f"{axis}1", f"{axis}2") - radius, F.greatest(f"{axis}1", f"{axis}2") + radius)
    cells = lambda level: [_cell(F.col(f"a{axis}"), 2.0**level * size).alias(f"c{axis}") for axis in ("x", "y")]
    columns = ["cx", "cy", "id", "x1", "y1", "x2", "y2"]
    rows = _spread(small, size).select(*columns)
    if levels:
        rows = rows.unionByName(_along(longs, levels, placed.select(*cells(FINE)).distinct(), size).select(*columns))
    found = placed.select("*", *cells(GRID)).join(rows, ["cx", "cy"]).where(inside).select("a", "id", dist.alias("dist"))
    return found.where(F.col("dist") <= radius).groupBy("a", "id").agg(F.min("dist").alias("dist"))


def segment_columns(side: str) -> list[Column]:
    return [F.col(f"{side}_{c}") for c in ("x1", "y1", "x2", "y2")]
