"""Rules on topology and geometry."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipelens import config
from pipelens.findings import rule
from pipelens.functions import geometry as g
from pipelens.operators import spatial
from pipelens.operators.graph import written

CELL = 32.0


def _points(t) -> DataFrame:
    """Network nodes with a point, as the right side of a point join."""
    return t.node.where(t.is_a(config.NODE) & F.col("x").isNotNull() & F.col("y").isNotNull())


def _as_b(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("node_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))


def _hit(t) -> DataFrame:
    """(node_id): the nodes nearest to a line end within the snap tolerance; ends of one place are looked up once."""

    def make():
        spots = t.ends.select(F.col("px").alias("ax"), F.col("py").alias("ay")).distinct()
        best = spatial.point_pairs(spots, _as_b(_points(t)), t.cfg.snap).groupBy("ax", "ay").agg(F.min(F.struct("dist", "b")).alias("m"))
        return written(best.select(F.col("m.b").alias("node_id")).distinct())

    return t.once(("hit", t.cfg.snap), make)


@rule("TOP-001", "F", "topology")
def node_without_line_end(t):
    """Nodes that are the nearest node of no line end."""
    return _points(t).join(_hit(t), "node_id", "left_anti").select(F.col("node_id").alias("object_id"))


def _loose(t, n):
    """Gravity conduits with so many ends that have a node within the snap tolerance."""

    def make():
        ends = t.ends.where(t.is_a(config.GRAVITY)).select("conduit_id", "side", F.col("px").alias("ax"), F.col("py").alias("ay"))
        near = spatial.point_pairs(ends, _as_b(_points(t)), t.cfg.snap)
        return near.groupBy("conduit_id").agg(sum(F.max(F.when(F.col("side") == side, 1).otherwise(0)) for side in ("start", "end")).alias("hits"))

    hits = t.shared(("hits", t.cfg.snap), make)
    return t.gravity.join(hits, "conduit_id", "left").where(F.coalesce("hits", F.lit(0)) == n).select(F.col("conduit_id").alias("object_id"))


@rule("TOP-002", "F", "topology")
def both_ends_loose(t):
    return _loose(t, 0)


@rule("TOP-003", "F", "topology")
def one_end_loose(t):
    return _loose(t, 1)


@rule("TOP-004", "F", "topology")
def end_off_its_node(t):
    """Ends further from their own node than the tolerance, by side."""
    found = t.at_nodes.withColumn("value", g.distance(F.col("px"), F.col("py"), F.col("node_x"), F.col("node_y")))
    return found.where(F.col("value") > t.cfg.snap).select(F.col("conduit_id").alias("object_id"), F.col("node_id").alias("object2_id"), F.col("side").alias("detail"), "value", F.lit(t.cfg.snap).alias("threshold"), F.col("px").alias("x"), F.col("py").alias("y"))


@rule("TOP-005", "F", "topology")
def duplicate_nodes(t):
    left = _points(t).select(F.col("node_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    pairs = spatial.point_pairs(left, _as_b(_points(t)), t.cfg.duplicate_node).where("a < b")
    return pairs.select(F.col("a").alias("object_id"), F.col("b").alias("object2_id"), F.col("dist").alias("value"), F.lit(t.cfg.duplicate_node).alias("threshold"), ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"))


def _sized(t) -> DataFrame:
    """Conduits with half of their larger size in metres (r)."""
    half = F.coalesce(F.greatest(F.coalesce("width_mm", F.lit(0.0)), F.coalesce("height_mm", F.lit(0.0))), F.lit(0.0)) / 2000
    return t.conduit.select("conduit_id", "start_id", "end_id", "pts", half.alias("r"))


def _open():
    return F.element_at("pts", 1) != F.element_at("pts", -1)


def _all_pairs(t) -> DataFrame:
    """Pairs of segments that any rule on pairs of lines asks for, with their ``reach`` and ``tip``, worked out once."""
    segments = lambda: spatial.line_segments(_sized(t), "conduit_id", F.col("r"), F.lit(True), ~_open())
    return t.once("pairs", lambda: spatial.segment_pairs(segments(), max(t.cfg.overlap_tolerance, t.cfg.conflict_margin), CELL))


@rule("TOP-006", "F", "topology")
def overlapping_lines(t):
    """Pairs of lines of which the first lies along the second for the least length or more.

    Each segment of the second gives one interval on a segment of the first: the part
    within the tolerance of it. Intervals are merged by their running ends and summed.
    """
    tol = t.cfg.overlap_tolerance
    pairs = _all_pairs(t).where(spatial.boxes_meet(tol)) if t.sharing else spatial.segment_pairs(spatial.line_segments(t.conduit, "conduit_id"), tol, CELL)
    near = with_interval(pairs, spatial.segment_columns("a"), spatial.segment_columns("b"), tol)
    # Pairs without an interval have nulls and not a filter, before which it would be worked out again.
    near = near.select("a_id", "b_id", "a_seq", *[F.when(F.col("hi") > F.col("lo"), c).alias(name) for name, c in (("lo", F.col("lo")), ("hi", F.col("hi")), ("nearness", _nearness()))]).repartition("a_id", "b_id")
    order = Window.partitionBy("a_id", "b_id", "a_seq").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    piece = F.when(F.col("hi").isNotNull(), F.greatest(F.lit(0.0), F.col("hi") - F.greatest("lo", F.coalesce(reach, F.col("lo")))))
    sums = near.withColumn("piece", piece).groupBy("a_id", "b_id").agg(F.sum("piece").alias("value"), F.min("nearness").alias("nearest"))
    return _placed(sums.where(F.col("value") >= t.cfg.overlap_length)).select(F.col("a_id").alias("object_id"), F.col("b_id").alias("object2_id"), "value", F.lit(t.cfg.overlap_length).alias("threshold"), "x", "y")


def _nearness():
    """What of two segments tells how near their lines come there: the distance, then their numbers; with the segments themselves."""
    a, b = spatial.segment_columns("a"), spatial.segment_columns("b")
    return F.struct(g.segment_segment(a, b).alias("d"), "a_seq", "b_seq", *[F.col(f"{side}_{c}") for side in "ab" for c in ("x1", "y1", "x2", "y2")]).alias("nearness")


def _placed(rows: DataFrame) -> DataFrame:
    """Adds x and y: the middle of the closest approach of the nearest segments of two lines."""
    return g.with_approach(rows, *[[F.col("nearest")[f"{side}_{c}"] for c in ("x1", "y1", "x2", "y2")] for side in "ab"])


def interval(a: list, b: list, tol: float):
    """Struct (lo, hi): the part of segment ``a``, measured from its start, within ``tol`` of segment ``b``; nulls if none."""
    row = lambda columns: F.struct(*[c.alias(name) for name, c in columns.items()])

    def within(f):
        return g.let(g.distance(f["s1"], f["d1"], f["s2"], f["d2"]), lambda m: g.let(row(_turned(f, m)), lambda k: g.let(row(_ends(f, k, tol)), lambda e: row(_joined(f, e)))))

    return g.let(g.distance(*a), lambda n: g.let(row(_frame(a, b, n)), within))


def with_interval(rows: DataFrame, a: list, b: list, tol: float) -> DataFrame:
    """Adds lo and hi of ``interval``, in steps that are each worked out once."""
    before = rows.columns
    rows = rows.withColumn("n", g.distance(*a))
    rows = rows.withColumns({name: c for name, c in _frame(a, b, F.col("n")).items() if name != "n"})
    f = {name: F.col(name) for name in ("n", "s1", "d1", "s2", "d2")}
    rows = rows.withColumn("len", g.distance(f["s1"], f["d1"], f["s2"], f["d2"]))
    k = {name: F.col(name) for name in ("len", "cos", "sin")}
    rows = rows.withColumns({name: c for name, c in _turned(f, k["len"]).items() if name != "len"})
    rows = rows.withColumns(_ends(f, k, tol))
    e = {name: F.col(name) for name in ("band_lo", "band_hi", "disc_lo", "disc_hi")}
    return rows.withColumns(_joined(f, e)).select(*before, "lo", "hi")


def _frame(a: list, b: list, n) -> dict:
    """The second segment as seen along the first, of length ``n``: s along it, d across it."""
    ux, uy = (a[2] - a[0]) / F.nullif(n, F.lit(0.0)), (a[3] - a[1]) / F.nullif(n, F.lit(0.0))
    along = lambda x, y: (x - a[0]) * ux + (y - a[1]) * uy
    across = lambda x, y: (y - a[1]) * ux - (x - a[0]) * uy
    return {"n": n, "s1": along(b[0], b[1]), "d1": across(b[0], b[1]), "s2": along(b[2], b[3]), "d2": across(b[2], b[3])}


def _turned(f, length) -> dict:
    """The length of the segment (s1, d1)-(s2, d2) and which way it goes."""
    whole = F.nullif(length, F.lit(0.0))
    return {"len": length, "cos": (f["s2"] - f["s1"]) / whole, "sin": (f["d2"] - f["d1"]) / whole}


def _ends(f, k, tol: float) -> dict:
    """The parts of the axis within ``tol`` of the segment's inside (band) and of its ends (disc)."""
    far = F.lit(1e300)
    level, upright = F.abs(k["sin"]) <= 1e-12, F.abs(k["cos"]) <= 1e-12
    # Where the foot on the other segment falls within it, and where its line is near enough.
    foot = [f["s1"] + (e * k["len"] + f["d1"] * k["sin"]) / F.when(~upright, k["cos"]) for e in (0.0, 1.0)]
    met = (-f["d1"] * k["sin"]).between(F.lit(0.0), k["len"])
    foot_lo = F.when(upright, F.when(met, -far).otherwise(far)).otherwise(F.least(*foot))
    foot_hi = F.when(upright, F.when(met, far).otherwise(-far)).otherwise(F.greatest(*foot))
    line = [f["s1"] - (f["d1"] * k["cos"] + e) / F.when(~level, k["sin"]) for e in (-tol, tol)]
    line_lo = F.when(level, F.when(F.abs(f["d1"]) <= tol, -far).otherwise(far)).otherwise(F.least(*line))
    line_hi = F.when(level, F.when(F.abs(f["d1"]) <= tol, far).otherwise(-far)).otherwise(F.greatest(*line))
    disc = lambda s, d, sign: F.when(F.abs(d) <= tol, s + sign * F.sqrt(F.greatest(F.lit(0.0), tol * tol - d * d)))
    discs = lambda sign: [disc(f["s1"], f["d1"], sign), disc(f["s2"], f["d2"], sign)]
    return {"band_lo": F.greatest(foot_lo, line_lo), "band_hi": F.least(foot_hi, line_hi), "disc_lo": F.least(*discs(-1)), "disc_hi": F.greatest(*discs(1))}


def _joined(f, e) -> dict:
    band = e["band_hi"] >= e["band_lo"]
    lo, hi = F.least(F.when(band, e["band_lo"]), e["disc_lo"]), F.greatest(F.when(band, e["band_hi"]), e["disc_hi"])
    # greatest and least pass over nulls, so an interval that is not there must stay null.
    return {"lo": F.when(lo.isNotNull(), F.greatest(lo, F.lit(0.0))), "hi": F.when(hi.isNotNull(), F.least(hi, f["n"]))}


@rule("TOP-007", "F", "topology")
def unusable_line(t):
    """The first reason that holds: no line, a coordinate that is not finite, one distinct point, hardly any length."""
    pts = F.col("pts")
    bad = F.exists(pts, lambda p: ~g.finite(p["x"]) | ~g.finite(p["y"]))
    reason = (
        F.when(pts.isNull() | (F.size(pts) < 2), "no line")
        .when(bad, "not finite")
        .when(F.size(F.array_distinct(pts)) < 2, "one point")
        .when(g.length(pts) <= t.cfg.zero_length, "no length")
        .when(~simple(pts), "crosses itself")
    )
    return t.conduit.select(F.col("conduit_id").alias("object_id"), reason.alias("detail")).where("detail is not null")


def simple(pts):
    """Whether a line neither crosses nor runs back over itself; only its first and last point may meet."""
    segs = g.segments(pts)
    n = F.size(segs)
    cols = lambda s: [s["p"]["x"], s["p"]["y"], s["q"]["x"], s["q"]["y"]]
    apart = F.exists(
        F.sequence(F.lit(1), n),
        lambda i: F.exists(
            F.sequence(F.lit(1), n),
            lambda j: (j > i + 1)
            & (g.segment_segment(cols(F.element_at(segs, i)), cols(F.element_at(segs, j))) == 0)
            & ~((i == 1) & (j == n) & (F.element_at(segs, 1)["p"] == F.element_at(segs, -1)["q"])),
        ),
    )
    back = F.exists(F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: _spike(F.element_at(segs, i), F.element_at(segs, i + 1)))
    return F.when(n < 2, F.lit(True)).when(n == 2, ~back).otherwise(~apart & ~back)


def _spike(a, b):
    """Whether the second segment runs back over the first."""
    turn = g.cross(a["p"]["x"], a["p"]["y"], a["q"]["x"], a["q"]["y"], b["q"]["x"], b["q"]["y"])
    dot = (a["q"]["x"] - a["p"]["x"]) * (b["q"]["x"] - b["p"]["x"]) + (a["q"]["y"] - a["p"]["y"]) * (b["q"]["y"] - b["p"]["y"])
    return (turn == 0) & (dot < 0)


@rule("TOP-008", "F", "topology")
def bent_line(t):
    found = t.gravity.where(F.size(F.array_distinct("pts")) >= 3).withColumn("value", g.max_offset(F.col("pts")))
    return found.where(F.col("value") > t.cfg.straightness).select(F.col("conduit_id").alias("object_id"), "value", F.lit(t.cfg.straightness).alias("threshold"))


@rule("TOP-009", "F", "topology")
def outside_range(t):
    (x0, x1), (y0, y1) = t.cfg.x_range, t.cfg.y_range
    out = lambda x, y: ~(x.between(x0, x1) & y.between(y0, y1))
    nodes = _points(t).where(out(F.col("x"), F.col("y"))).select(F.col("node_id").alias("object_id"))
    lines = t.conduit.where(F.exists("pts", lambda p: out(p["x"], p["y"]))).select(F.col("conduit_id").alias("object_id"))
    return nodes.unionByName(lines)


@rule("TOP-010", "F", "topology")
def conflicting_conduits(t):
    """Lines closer than their radii allow that share no node and meet at no end."""
    sized, useless = _sized(t), lambda p, q: _tips_meet(p, q, t.cfg.snap)
    if t.sharing:
        near = _all_pairs(t).where(spatial.boxes_meet(t.cfg.conflict_margin, True) & ~useless(_tipped("a"), _tipped("b")))
    else:
        near = spatial.segment_pairs(spatial.line_segments(sized, "conduit_id", F.col("r"), F.lit(True)), t.cfg.conflict_margin, CELL, useless)
    limit = F.col("a_reach") + F.col("b_reach") + t.cfg.conflict_margin
    # Within the sum and not before it, where the distance would be worked out twice.
    within = F.when(F.col("nearness.d") <= F.col("limit"), F.col("nearness"))
    close = near.select("a_id", "b_id", _nearness(), limit.alias("limit")).groupBy("a_id", "b_id").agg(F.min(within).alias("nearest")).where("nearest is not null").withColumn("value", F.col("nearest.d"))
    side = lambda p: sized.select(F.col("conduit_id").alias(f"{p}_id"), F.array("start_id", "end_id").alias(f"{p}_nodes"), F.col("r").alias(f"{p}_r"), F.array(F.element_at("pts", 1), F.element_at("pts", -1)).alias(f"{p}_ends"))
    both = close.join(side("a"), "a_id").join(side("b"), "b_id").withColumn("threshold", F.col("a_r") + F.col("b_r") + t.cfg.conflict_margin)
    meet = F.exists("a_ends", lambda p: F.exists("b_ends", lambda q: g.distance(p["x"], p["y"], q["x"], q["y"]) <= t.cfg.snap))
    found = both.where((F.col("threshold") > 0) & (F.col("value") <= F.col("threshold")) & ~F.coalesce(F.arrays_overlap("a_nodes", "b_nodes"), F.lit(False)) & ~meet)
    return _placed(found).select(F.col("a_id").alias("object_id"), F.col("b_id").alias("object2_id"), "value", "threshold", "x", "y")


@rule("TOP-011", "W", "topology")
def crossing_lines(t):
    """Lines whose insides meet in points only: segments that cross, or a vertex inside the other line, and no shared stretch.

    The two ends of an open line are not inside it; a closed line has no ends. The place is the meeting point of the smallest x, then y.
    """
    if t.sharing:
        pairs = _all_pairs(t).where(spatial.boxes_meet(0.0) & ~_only_tips_touch(_tipped("a", opened=True), _tipped("b", opened=True)))
    else:
        pairs = spatial.segment_pairs(spatial.line_segments(t.conduit, "conduit_id", tips=_open()), 0.0, CELL, _only_tips_touch)
    a, b = spatial.segment_columns("a"), spatial.segment_columns("b")
    same = g.overlap(a, b)
    touch = F.filter(F.array(*[_touch(p, own, other) for own, other in ((a, b), (b, a)) for p in (own[:2], own[2:])]), lambda p: p.isNotNull())
    seen = pairs.select("a_id", "b_id", g.properly_cross(a, b).alias("cross"), g.crossing_point(a, b).alias("at"), same.alias("same"), touch.alias("touch")).where("cross or same or size(touch) > 0")
    # A point where segments touch counts unless it is an end of one of the lines.
    ends = lambda side: t.conduit.select(
        F.col("conduit_id").alias(f"{side}_id"), F.when(F.element_at("pts", 1) != F.element_at("pts", -1), F.array(F.element_at("pts", 1), F.element_at("pts", -1))).otherwise(F.array().cast("array<struct<x:double,y:double>>")).alias(f"{side}_ends")
    )
    met = seen.join(ends("a"), "a_id").join(ends("b"), "b_id")
    inside = F.filter("touch", lambda p: ~F.exists(F.concat("a_ends", "b_ends"), lambda q: (p["x"] == q["x"]) & (p["y"] == q["y"])))
    met = met.withColumn("inside", F.array_min(F.array_append(inside, F.col("at"))))
    found = met.groupBy("a_id", "b_id").agg(F.min("inside").alias("p"), F.max("same").alias("same")).where("p is not null and not same")
    return found.select(F.col("a_id").alias("object_id"), F.col("b_id").alias("object2_id"), "p.x", "p.y")


def _tipped(side: str, opened: bool = False) -> list:
    """A segment of a pair as (x1, y1, x2, y2, tip); with ``opened`` the ends of closed lines do not count."""
    tip = F.col(f"{side}_tip")
    return [*spatial.segment_columns(side), F.when(tip >= 4, 0).otherwise(tip) if opened else tip]


def _tips(p: list, q: list):
    """Pairs of ends of two segments (x1, y1, x2, y2, tip): whether both end their lines, and the two ends."""
    ends = lambda s: [(s[4].bitwiseAND(1) != 0, s[:2]), (s[4].bitwiseAND(2) != 0, s[2:4])]
    return [(mine & yours, a, b) for mine, a in ends(p) for yours, b in ends(q)]


def _tips_meet(p: list, q: list, snap: float):
    """Whether ends of the two lines meet."""
    return reduce(or_, [both & (g.distance(*a, *b) <= snap) for both, a, b in _tips(p, q)])


def _only_tips_touch(p: list, q: list):
    """Whether two segments have an end of both their lines in common and surely nothing else, as neither lies on the line through the other."""
    shared = reduce(or_, [both & (a[0] == b[0]) & (a[1] == b[1]) for both, a, b in _tips(p, q)])
    off = lambda s, o: (g.cross(*s[:4], *o[:2]) != 0) | (g.cross(*s[:4], *o[2:4]) != 0)
    return shared & off(p, q) & off(q, p)


def _touch(p, own, other):
    """The end ``p`` of the segment ``own`` where it lies on the segment ``other``, else null."""
    on = (g.cross(*other, *p) == 0) & p[0].between(F.least(other[0], other[2]), F.greatest(other[0], other[2])) & p[1].between(F.least(other[1], other[3]), F.greatest(other[1], other[3]))
    return F.when(on, F.struct(p[0].alias("x"), p[1].alias("y")))


@rule("TOP-012", "F", "topology")
def loop(t):
    return t.gravity.where("start_id = end_id").select(F.col("conduit_id").alias("object_id"), F.col("start_id").alias("object2_id"))


@rule("TOP-013", "W", "topology")
def parallel_conduits(t):
    pair = [F.least("start_id", "end_id").alias("a"), F.greatest("start_id", "end_id").alias("b")]
    known = t.conduit.where("start_id is not null and end_id is not null and start_id <> end_id").select("conduit_id", *pair)
    many = known.groupBy("a", "b").agg(F.count("*").alias("value")).where(F.col("value") > t.cfg.parallel)
    return known.join(many, ["a", "b"]).select(F.col("conduit_id").alias("object_id"), "value", F.lit(t.cfg.parallel).alias("threshold"))


@rule("TOP-014", "W", "topology")
def crowded_node(t):
    """Nodes with more conduit ends than allowed; a loop has two ends."""
    ends = t.ends.where("node_id is not null").groupBy("node_id").agg(F.count("*").alias("value")).where(F.col("value") > t.cfg.attached)
    return _points(t).select("node_id").join(ends, "node_id").select(F.col("node_id").alias("object_id"), "value", F.lit(t.cfg.attached).alias("threshold"))


@rule("TOP-015", "F", "topology")
def multipart(t):
    return _points(t).where("multipart").select(F.col("node_id").alias("object_id")).unionByName(t.conduit.where("multipart").select(F.col("conduit_id").alias("object_id")))


@rule("TOP-016", "F", "topology")
def invalid_geometry(t):
    """Lines without two distinct finite points, and nodes whose point is not finite."""
    pts = F.col("pts")
    ok = (F.size(F.array_distinct(pts)) >= 2) & F.forall(pts, lambda p: g.finite(p["x"]) & g.finite(p["y"]))
    lines = t.conduit.where(pts.isNotNull() & ~ok).select(F.col("conduit_id").alias("object_id"))
    nodes = _points(t).where(~(g.finite(F.col("x")) & g.finite(F.col("y")))).select(F.col("node_id").alias("object_id"))
    return lines.unionByName(nodes)


@rule("TOP-017", "W", "topology")
def line_crosses_itself(t):
    return t.conduit.where(~simple(F.col("pts"))).select(F.col("conduit_id").alias("object_id"))


@rule("TOP-018", "W", "topology")
def doubled_vertex_or_spike(t):
    segs = g.segments(F.col("pts"))
    double = F.exists(segs, lambda s: g.distance(s["p"]["x"], s["p"]["y"], s["q"]["x"], s["q"]["y"]) <= t.cfg.vertex_tolerance)
    sharp = F.array_min(g.angles(F.col("pts")))
    detail = F.when(double, "double").when(sharp <= t.cfg.spike_angle, "spike")
    return t.conduit.select(F.col("conduit_id").alias("object_id"), detail.alias("detail")).where("detail is not null")


@rule("TOP-019", "W", "topology")
def needless_node(t):
    """Nodes without a function between two ends of equal size, material and classes."""
    nodes = t.node.where(t.is_a(*config.FUNCTIONLESS))
    same = t.ends.join(nodes, "node_id", "left_semi").join(t.conduit.select("conduit_id"), "conduit_id").select("node_id", F.struct("width_mm", "height_mm", "material", F.array_sort("types").alias("types")).alias("kind"))
    equal = same.groupBy("node_id").agg(F.count("*").alias("n"), F.countDistinct(F.to_json("kind")).alias("kinds")).where("n = 2 and kinds = 1")
    return nodes.join(equal, "node_id", "left_semi").select(F.col("node_id").alias("object_id"))


@rule("TOP-020", "W", "topology")
def drawn_backwards(t):
    """Lines that fit their nodes better when turned round."""
    place = lambda p: t.node.select(F.col("node_id").alias(f"{p}_id"), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))
    first, last = F.element_at("pts", 1), F.element_at("pts", -1)
    d = lambda p, q: g.distance(p["x"], p["y"], F.col(f"{q}x"), F.col(f"{q}y"))
    found = t.gravity.where("start_id <> end_id").join(place("start"), "start_id").join(place("end"), "end_id")
    return found.where(d(first, "end") + d(last, "start") < d(first, "start") + d(last, "end")).select(F.col("conduit_id").alias("object_id"))


@rule("TOP-021", "W", "topology")
def node_on_passing_line(t):
    """Nodes that no line end meets, close to a line whose ends are further than the line; the nearest line."""
    left = written(_points(t).join(_hit(t), "node_id", "left_anti").select(F.col("node_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay")))
    near = spatial.point_segment_pairs(left, spatial.line_segments(t.conduit, "conduit_id"), t.cfg.near_line, CELL)
    ends = t.conduit.select(F.col("conduit_id").alias("id"), F.element_at("pts", 1).alias("p"), F.element_at("pts", -1).alias("q"))
    away = F.least(g.distance(F.col("ax"), F.col("ay"), F.col("p.x"), F.col("p.y")), g.distance(F.col("ax"), F.col("ay"), F.col("q.x"), F.col("q.y")))
    found = near.join(left, "a").join(ends, "id").where(away > F.col("dist")).groupBy("a").agg(F.min(F.struct("dist", "id")).alias("m"))
    return found.select(F.col("a").alias("object_id"), F.col("m.id").alias("object2_id"), F.col("m.dist").alias("value"), F.lit(t.cfg.near_line).alias("threshold"))
