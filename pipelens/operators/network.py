"""Rules on the network as a graph, and on overflow facilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipelens import config
from pipelens.findings import rule
from pipelens.functions import geometry as g
from pipelens.operators import graph, spatial


def edges(t) -> DataFrame:
    """(conduit_id, a, b) of gravity conduits with both nodes known; with direction ``invert`` rising ones are turned."""
    known = t.gravity.where("start_id is not null and end_id is not null")
    turn = F.lit(False) if t.cfg.direction == "administrative" else F.coalesce(F.col("bob_end") > F.col("bob_start"), F.lit(False))
    return known.select("conduit_id", "types", F.when(turn, F.col("end_id")).otherwise(F.col("start_id")).alias("a"), F.when(turn, F.col("start_id")).otherwise(F.col("end_id")).alias("b"))


def components(t) -> DataFrame:
    """(node_id, component): the undirected components of the gravity network."""
    return t.once("components", lambda: graph.components(edges(t).select("a", "b")).select(F.col("id").alias("node_id"), "component"))


def strong_components(t) -> DataFrame:
    return t.once("strong", lambda: graph.written(graph.strong_components(edges(t).select("a", "b"), components(t).withColumnRenamed("node_id", "id"))))


def reach(t, goals) -> DataFrame:
    """(id): nodes from which a node of the classes ``goals`` can be reached."""
    ends = t.node.where(t.is_a(*goals)).select(F.col("node_id").alias("id"))
    return t.once(("reach", *goals), lambda: graph.reaching(edges(t).select("a", "b"), ends, components(t).withColumnRenamed("node_id", "id")))


def _unreached(t, roots, goals):
    reached = reach(t, goals).select(F.col("id").alias("start_id"))
    judged = t.gravity.where(t.is_a(*roots) & F.col("start_id").isNotNull() & F.col("end_id").isNotNull())
    return judged.join(reached, "start_id", "left_anti").select(F.col("conduit_id").alias("object_id"), F.col("start_id").alias("object2_id"))


@rule("NET-001", "F", "topology")
def foul_without_pump(t):
    return _unreached(t, config.FOUL, config.OUTFLOW)


@rule("NET-002", "F", "topology")
def rain_without_discharge(t):
    return _unreached(t, config.RAIN, config.DISCHARGE)


@rule("NET-003", "F", "plausibility")
def rises(t):
    found = t.gravity.withColumn("value", F.col("bob_end") - F.col("bob_start")).where(F.col("value") > t.cfg.rise_warning)
    return found.select(F.col("conduit_id").alias("object_id"), "value", F.lit(t.cfg.rise_warning).alias("threshold"))


@rule("NET-004", "F", "topology")
def cycle(t):
    """One finding for each strongly connected part with a cycle: its size, and its smallest conduit."""
    strong = strong_components(t)
    inside = (
        edges(t)
        .join(strong.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a")
        .join(strong.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b")
        .where("ca = cb")
    )
    first = inside.groupBy(F.col("ca").alias("component")).agg(F.min("conduit_id").alias("conduit_id"))
    sizes = strong.groupBy("component").agg(F.count("*").alias("value"))
    return sizes.join(first, "component").select(F.col("conduit_id").alias("object_id"), F.col("component").alias("object2_id"), "value")


#: System types in alphabetical order; a set of them is a whole number with the bit of each.
KINDS = sorted(config.SYSTEM_TYPES)


def bits(*kinds: str) -> int:
    return sum(1 << KINDS.index(kind) for kind in kinds)


def names(kinds: Column) -> Column:
    """The names of a set of system types, with commas."""
    return F.concat_ws(",", *[F.when(kinds.bitwiseAND(bits(kind)) != 0, F.lit(kind)) for kind in KINDS])


def _bit(t):
    """A conduit's system type as a set, null without any: as ``t.system``, the first whose class it is."""
    return F.coalesce(*[F.when(t.is_a(config.SYSTEM_TYPES[kind]), F.lit(bits(kind))) for kind in KINDS])


def _typed(t) -> DataFrame:
    """(conduit_id, kinds): the system types of gravity conduits that have one."""
    return t.shared("typed", lambda: t.gravity.select("conduit_id", _bit(t).alias("kinds")).where("conduit_id is not null and kinds is not null").groupBy("conduit_id").agg(F.bit_or("kinds").alias("kinds")))


def kinds_at(t) -> DataFrame:
    """(node_id, kinds, shared): the system types of the gravity conduits at a node, and those that more than one of them has."""

    def make():
        each = t.ends.where("node_id is not null").select("node_id", "conduit_id").join(_typed(t), "conduit_id").distinct()
        many = [F.when(F.sum(F.col("kinds").bitwiseAND(bits(kind))) > bits(kind), F.lit(bits(kind))).otherwise(0) for kind in KINDS]
        return each.groupBy("node_id").agg(F.bit_or("kinds").alias("kinds"), sum(many[1:], many[0]).cast("int").alias("shared"))

    return t.shared("kinds", make)


def neighbour_types(t) -> DataFrame:
    """(conduit_id, start, end): the system types of the other gravity conduits at each end; 0 or null without any.

    What the conduit itself has counts only where another one at the node has it too.
    """

    def make():
        own = t.gravity_ends.select("conduit_id", "side", "node_id").join(_typed(t).withColumnRenamed("kinds", "own"), "conduit_id", "left")
        others = F.col("kinds").bitwiseAND(F.bitwise_not(F.coalesce("own", F.lit(0))).bitwiseOR(F.col("shared")))
        found = own.where("conduit_id is not null").join(kinds_at(t), "node_id").select("conduit_id", "side", others.alias("others"))
        return found.groupBy("conduit_id").agg(*[F.bit_or(F.when(F.col("side") == side, F.col("others"))).alias(side) for side in ("start", "end")])

    return t.shared("neighbours", make)


@rule("NET-005", "F", "consistency")
def type_unlike_neighbours(t):
    """Typed conduits with typed neighbours on both sides, none of their own type."""
    kinds = neighbour_types(t).where("start <> 0 and end <> 0")
    own = t.gravity.select("conduit_id", _bit(t).alias("kind"))
    return own.join(kinds, "conduit_id").where(F.col("start").bitwiseOR(F.col("end")).bitwiseAND(F.col("kind")) == 0).select(F.col("conduit_id").alias("object_id"), names(F.col("kind")).alias("detail"))


@rule("NET-006", "W", "consistency")
def types_meet(t):
    return kinds_at(t).withColumn("value", F.bit_count("kinds")).where("value > 1").select(F.col("node_id").alias("object_id"), names(F.col("kinds")).alias("detail"), "value")


@rule("NET-007", "F", "completeness")
def infiltration_without_weir(t):
    """Infiltration conduits in a component without any node with a weir (or overflow manhole where weirs are not given)."""
    with_weir = t.weir.select("node_id").distinct() if t.weir is not None else t.node.where(t.is_a(*config.OVERFLOW_NODE)).select("node_id")
    parts = components(t)
    served = parts.join(with_weir, "node_id", "left_semi").select("component").distinct()
    own = t.gravity.where(t.is_a(*config.INFILTRATION)).select("conduit_id", F.col("start_id").alias("node_id")).join(parts, "node_id")
    return own.join(served, "component", "left_anti").select(F.col("conduit_id").alias("object_id"), F.col("component").alias("object2_id"))


@rule("NET-008", "W", "plausibility")
def many_discharges(t):
    """Discharge nodes of small components that have more than the allowed number of them."""
    parts = components(t)
    ends = t.node.where(t.is_a(*config.DISCHARGE)).select("node_id", F.lit(1).alias("is_end"))
    sizes = parts.join(ends, "node_id", "left").groupBy("component").agg(F.count("*").alias("n"), F.count("is_end").alias("value"))
    some = sizes.where((F.col("n") <= t.cfg.component_nodes) & (F.col("value") > t.cfg.component_discharges))
    return parts.join(ends, "node_id", "left_semi").join(some, "component").select(F.col("node_id").alias("object_id"), F.col("component").alias("object2_id"), "value", F.lit(t.cfg.component_discharges).alias("threshold"))


@rule("RVZ-001", "F", "completeness")
def facility_without_conduit(t):
    both = t.node.where(t.is_a(*config.OVERFLOW_NODE, *config.TANK)).select("node_id").distinct()
    return both.join(t.incidence.select("node_id").distinct(), "node_id", "left_anti").select(F.col("node_id").alias("object_id"))


@rule("RVZ-004", "W", "plausibility")
def overflow_far_from_water(t):
    """Overflow manholes without surface water of the network itself within the distance; without any water the rule is off."""
    own = t.node.where(t.is_a(*config.OVERFLOW_NODE) & F.col("x").isNotNull()).select(F.col("node_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    points, lines = t.water
    near = spatial.point_pairs(own, points.select(F.col("node_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by")), t.cfg.water_distance).select("a")
    near = near.unionByName(spatial.point_segment_pairs(own, spatial.line_segments(lines, "conduit_id"), t.cfg.water_distance, 2 * t.cfg.water_distance).select("a")).distinct()
    return own.join(near, "a", "left_anti").select(F.col("a").alias("object_id"), F.lit(t.cfg.water_distance).alias("threshold"))


@rule("RVZ-005", "W", "plausibility")
def overflow_on_rain_only(t):
    nodes = t.node.where(t.is_a(*config.OVERFLOW_NODE)).select("node_id")
    other, rain = bits("overflow"), bits("rain", "infiltration")
    only = (F.col("kinds").bitwiseAND(rain) != 0) & (F.col("kinds").bitwiseAND(F.lit(~(rain | other))) == 0)
    return nodes.join(kinds_at(t), "node_id").where(only).select(F.col("node_id").alias("object_id"))


@rule("RVZ-006", "W", "completeness")
def mixed_without_overflow(t):
    """Components with mixed conduits and neither overflow manhole nor tank; on the smallest node, at the mean of their points."""
    parts = components(t)
    mixed = t.gravity.where(t.system == "mixed").select(F.col("start_id").alias("node_id")).join(parts, "node_id").select("component").distinct()
    served = parts.join(t.node.where(t.is_a(*config.OVERFLOW_NODE, *config.TANK)).select("node_id"), "node_id", "left_semi").select("component").distinct()
    # Sums of decimals do not depend on their order.
    mean = lambda c: (F.sum(F.col(c).cast("decimal(20,6)")).cast("double") / F.count(c)).alias(c)
    sizes = parts.join(t.node.select("node_id", *[F.when(g.finite(F.col(c)) & (F.abs(c) < 1e13), F.col(c)).alias(c) for c in ("x", "y")]), "node_id").groupBy("component").agg(F.count("*").alias("value"), mean("x"), mean("y"))
    return mixed.join(served, "component", "left_anti").join(sizes, "component").select(F.col("component").alias("object_id"), "value", "x", "y")


@rule("RVZ-008", "W", "completeness")
def tank_without_emptying(t):
    """Tanks without an emptying part and without a conduit that starts from them."""
    tanks = t.node.where(t.is_a(*config.TANK)).select("node_id")
    served = t.conduit.select(F.col("start_id").alias("node_id")).where("node_id is not null")
    if t.part is not None:
        served = served.unionByName(t.part.where(t.is_a("Ledigingsvoorziening", types="child_types")).select(F.col("parent_id").alias("node_id")))
    return tanks.join(served.distinct(), "node_id", "left_anti").select(F.col("node_id").alias("object_id"))


@rule("RVZ-009", "W", "completeness")
def tank_without_overflow(t):
    tanks = t.node.where(t.is_a(*config.TANK)).select("node_id")
    served = t.ends.where(t.is_a(*config.OVERFLOW_CONDUIT)).select("node_id").where("node_id is not null")
    if t.weir is not None:
        served = served.unionByName(t.weir.select("node_id"))
    return tanks.join(served.distinct(), "node_id", "left_anti").select(F.col("node_id").alias("object_id"))


@rule("RVZ-010", "W", "plausibility")
def overflow_between_equals(t):
    """Overflow conduits with the same types of neighbours at both ends."""
    but = lambda side: F.col(side).bitwiseAND(F.lit(~bits("overflow")))
    both = neighbour_types(t).where((but("start") != 0) & (but("start") == but("end"))).select("conduit_id", names(but("start")).alias("detail"))
    own = t.gravity.where(t.is_a(*config.OVERFLOW_CONDUIT)).select("conduit_id")
    return own.join(both, "conduit_id").select(F.col("conduit_id").alias("object_id"), "detail")


@rule("RVZ-011", "W", "plausibility")
def weir_near_top(t):
    if t.weir is None:
        return t.node.where("false").select(F.col("node_id").alias("object_id"))
    found = t.weir.join(t.tops.select("node_id", "top"), "node_id").withColumn("value", F.col("top") - F.col("level"))
    return found.where(F.col("value") < t.cfg.weir_depth).select(F.col("node_id").alias("object_id"), F.col("weir_id").alias("detail"), "value", F.lit(t.cfg.weir_depth).alias("threshold"))
