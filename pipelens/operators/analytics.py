"""What is read off findings, components and measurements: reliability, clusters, areas, names, top lists, changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipelens import config
from pipelens.functions import geometry as g
from pipelens.operators import build, network

#: Rows of a report's tables, and named items of a summary; fixed values of the reports.
TABLE_ROWS, NAMED = 15, 5
#: Source of the messages on objects whose class is too generic; fixed value of the format.
TOO_GENERIC = "CfkTypes_typ"


def unreliable(t, generic: DataFrame) -> DataFrame:
    """(object_id): objects one of whose own classes is among the too generic ones (cls)."""
    rows = t.node.select(F.col("node_id").alias("object_id"), F.explode("types").alias("cls")).unionByName(t.conduit.select(F.col("conduit_id").alias("object_id"), F.explode("types").alias("cls")))
    return rows.join(F.broadcast(generic.select("cls").distinct()), "cls", "left_semi").select("object_id").distinct()


def generic_classes(rows: DataFrame) -> DataFrame:
    """(cls): the classes that reports call too generic."""
    return rows.where(F.col("source") == TOO_GENERIC).select(F.col("focus_node").alias("cls")).distinct()


def with_reliability(found: DataFrame, bad: DataFrame) -> DataFrame:
    """Adds whether the class of a finding's object can be relied on."""
    marked = bad.select("object_id", F.lit(False).alias("ok"))
    return found.join(marked, "object_id", "left").withColumn("typing_reliable", F.coalesce("ok", F.lit(True))).drop("ok")


def present(ids: DataFrame, t) -> DataFrame:
    """Those of ``ids`` (object_id) that the network has."""
    have = t.node.select(F.col("node_id").alias("object_id")).unionByName(t.conduit.select(F.col("conduit_id").alias("object_id")))
    return ids.join(have, "object_id", "left_semi")


def components_of_objects(t) -> DataFrame:
    """(object_id, component) of nodes, and of conduits by their first node that has one."""
    parts = network.components(t)
    ends = t.ends.where("node_id is not null").join(parts, "node_id").groupBy(F.col("conduit_id").alias("object_id")).agg(F.min(F.struct(F.col("side") != "start", "component")).alias("m"))
    return parts.select(F.col("node_id").alias("object_id"), "component").unionByName(ends.select("object_id", F.col("m.component").alias("component")))


def component_names(t) -> DataFrame:
    """(component, name): ``ds-`` and the label of the smallest node; the second and later of a name get -2, -3 and so on, by component."""
    labels = network.components(t).select("component").distinct().join(t.node.select(F.col("node_id").alias("component"), "label"), "component", "left")
    named = labels.withColumn("base", F.concat(F.lit("ds-"), F.when(F.coalesce("label", F.lit("")) != "", F.col("label")).otherwise(F.col("component"))))
    nth = F.row_number().over(Window.partitionBy("base").orderBy("component"))
    return named.select("component", "base", nth.alias("nth")).select("component", F.when(F.col("nth") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "nth")).alias("name"))


def component_profile(t) -> DataFrame:
    """Per component: nodes, system types, whether it has an endpoint, a weir and a storage tank, and its name."""
    parts = network.components(t)
    node = parts.join(t.node, "node_id")
    has = lambda roots: F.coalesce(F.max(t.is_a(*roots)), F.lit(False))
    sums = node.groupBy("component").agg(F.count("*").alias("nodes"), has((*config.OUTFLOW, *config.DISCHARGE)).alias("has_endpoint"), has(config.TANK).alias("has_storage"))
    typed = t.gravity.select(F.col("start_id").alias("node_id"), t.system.alias("kind")).where("kind is not null").join(parts, "node_id")
    kinds = typed.groupBy("component").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("systems"))
    weirs = parts.join(t.weir.select("node_id").distinct(), "node_id", "left_semi").select("component").distinct().withColumn("has_weir", F.lit(True))
    joined = sums.join(kinds, "component", "left").join(weirs, "component", "left").join(component_names(t), "component", "left")
    return joined.select("component", "name", "nodes", F.coalesce("systems", F.lit("")).alias("systems"), "has_endpoint", F.coalesce("has_weir", F.lit(False)).alias("has_weir"), "has_storage")


def unreachable(t, goals: tuple[str, ...]) -> DataFrame:
    """(with_endpoint, without_endpoint): nodes that reach no goal, in components that have one and in those that have none."""
    parts = network.components(t)
    ends = t.node.where(t.is_a(*goals)).select("node_id")
    having = parts.join(ends, "node_id", "left_semi").select("component").distinct().withColumn("has", F.lit(True))
    lost = parts.join(network.reach(t, goals).select(F.col("id").alias("node_id")), "node_id", "left_anti").join(having, "component", "left")
    return lost.agg(F.count_if(F.col("has")).alias("with_endpoint"), F.count_if(F.col("has").isNull()).alias("without_endpoint"))


def shared_components(found: DataFrame, t, rules: tuple[tuple[str, ...], ...] = (("NET-001", "NET-002"), ("RVZ-006",))) -> DataFrame:
    """(component): components that each group of rules has a finding in."""
    placed = found.join(components_of_objects(t), "object_id").select("rule_id", "component")
    out = None
    for group in rules:
        part = placed.where(F.col("rule_id").isin(*group)).select("component").distinct()
        out = part if out is None else out.intersect(part)
    return out


def clusters(found: DataFrame, t, named: int = NAMED) -> DataFrame:
    """Per rule: how many components its findings lie in, the first names of them, and how many are not named."""
    names = component_names(t)
    pairs = found.join(components_of_objects(t), "object_id").select("rule_id", "component").distinct().join(names, "component")
    nth = F.row_number().over(Window.partitionBy("rule_id").orderBy("component"))
    ranked = pairs.withColumn("nth", nth)
    sums = ranked.groupBy("rule_id").agg(F.count("*").alias("clusters"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") <= named, F.struct("nth", "name")))), lambda x: x["name"]), ",").alias("names"))
    return sums.select("rule_id", "clusters", "names", F.greatest(F.col("clusters") - named, F.lit(0)).cast("long").alias("unnamed"))


def without_location(placed: DataFrame) -> DataFrame:
    """(n, rules): findings that have no point, and the rules they are of; ``placed`` has x and y."""
    lost = placed.where("x is null or y is null")
    return lost.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rules"))


def restricted(found: DataFrame, core: DataFrame, placed: DataFrame | None = None, area: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings on objects of the core (object_id) or, with ``placed`` (finding_id, x, y), in the area (area_id, ring); and per rule how many were left out.

    A core without any object is an error: nothing could be judged.
    """
    if core.isEmpty():
        raise ValueError("the core has no object")
    ids = core.select("object_id").distinct()
    if placed is None:
        return found.join(ids, "object_id", "left_semi"), found.join(ids, "object_id", "left_anti").groupBy("rule_id").agg(F.count("*").alias("omitted"))
    from pipelens.operators import external

    inside = external.in_areas(placed.select(F.col("finding_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay")), area).select(F.col("a").alias("finding_id")).distinct()
    kept = found.join(ids, "object_id", "left_semi").select("finding_id").union(inside).distinct()
    return found.join(kept, "finding_id", "left_semi"), found.join(kept, "finding_id", "left_anti").groupBy("rule_id").agg(F.count("*").alias("omitted"))


def flagged_classes(found: DataFrame, t, rule_id: str, k: int = NAMED) -> DataFrame:
    """(type_name, n): the commonest type names of the objects that a rule found. A top-k report."""
    flagged = found.where(F.col("rule_id") == rule_id).select("object_id").distinct()
    return flagged.join(build.type_names(t), "object_id").groupBy("type_name").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "type_name").limit(k)


def common_decimals(values: DataFrame, k: int = 3) -> DataFrame:
    """(decimals, n): the commonest last two decimals of ``v``. A top-k report."""
    cents = F.pmod(F.round(F.abs("v") * 100).cast("long"), F.lit(100))
    return values.where("v is not null").groupBy(F.lpad(cents.cast("string"), 2, "0").alias("decimals")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "decimals").limit(k)


def out_of_scope(t) -> DataFrame:
    """(object_id, system, x, y): mechanical conduits, which no rule on gravity conduits has tested."""
    m = g.midpoint(F.col("pts"))
    names = F.coalesce(*[F.when(t.is_a(c), F.lit(c)) for c in sorted(config.MECHANICAL)], F.lit("MechanischeLeiding"))
    mechanical = t.conduit.where(t.is_a("MechanischeLeiding", *config.MECHANICAL))
    gravity = t.gravity.select("conduit_id")
    return mechanical.join(gravity, "conduit_id", "left_anti").select(F.col("conduit_id").alias("object_id"), names.alias("system"), m["x"].alias("x"), m["y"].alias("y"))


def run_metadata(found: DataFrame, t, dataset: str, core: DataFrame | None = None) -> DataFrame:
    """One row: dataset, run date, and counts of nodes, conduits, findings by severity, rules that fired and the core."""
    one = lambda df, *aggs: df.agg(*aggs).withColumn("k", F.lit(1))
    rows = one(t.node, F.count("*").alias("nodes")).join(one(t.conduit, F.count("*").alias("conduits")), "k")
    rows = rows.join(one(found, F.count("*").alias("findings"), F.count_if(F.col("severity") == "F").alias("errors"), F.count_if(F.col("severity") == "W").alias("warnings"), F.countDistinct("rule_id").alias("rules")), "k")
    rows = rows.join(one(core.select("object_id").distinct(), F.count("*").alias("core")), "k") if core is not None else rows.withColumn("core", F.lit(None).cast("long"))
    return rows.select(F.lit(dataset).alias("dataset"), F.lit(t.cfg.today).alias("run_date"), "nodes", "conduits", "findings", "errors", "warnings", "rules", "core")


def roots_of_network(t) -> DataFrame:
    """(node_id): manholes, outflows, discharges and tanks: what counts as a node of the network."""
    return t.node.where(t.is_a(config.NODE, *config.OUTFLOW, *config.DISCHARGE, *config.TANK)).select("node_id").distinct()


def fragment(uri: Column) -> Column:
    """What stands after the first hash, or the whole."""
    at = F.instr(uri, "#")
    return F.when(at > 0, F.substr(uri, at + 1)).otherwise(uri)


def first_rows(rows: DataFrame, *order, n: int = TABLE_ROWS) -> DataFrame:
    """The first rows of a report's table, with how many there are in all. A top-k report."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).limit(n).crossJoin(F.broadcast(total)) if n else rows


def largest_changes(deltas: DataFrame, *keys: str, n: int = TABLE_ROWS) -> DataFrame:
    """The largest differences that are not zero, whatever their sign. A top-k report."""
    return deltas.where("difference <> 0").orderBy(F.abs("difference").desc(), *keys).limit(n)


def by_improvement(deltas: DataFrame, *keys: str) -> DataFrame:
    """Deltas with the best improvement first."""
    return deltas.orderBy("difference", *keys)


def by_count(rows: DataFrame, *keys: str) -> DataFrame:
    """Aggregates with the largest first; keys without a value come first among equals."""
    return rows.orderBy(F.col("n").desc(), *keys)


def by_status(changes: DataFrame) -> DataFrame:
    return changes.orderBy("status", "source", "focus_node")


def components_in_order(t) -> DataFrame:
    """(component, nodes) by smallest node."""
    return network.components(t).groupBy("component").agg(F.count("*").alias("nodes")).orderBy("component")


def shared_classes(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """(cfk): classes that both measurements have."""
    return earlier.select("cfk").intersect(later.select("cfk"))


def unequal_measurement(parts: DataFrame) -> DataFrame:
    """(kind, variants): kinds of parts (report, kind, part) in which the reports do not all list the same."""
    reports = parts.select("report").distinct()
    kinds = parts.select("kind").distinct()
    whole = reports.join(F.broadcast(kinds)).join(parts, ["report", "kind"], "left")  # a few reports times two kinds
    lists = whole.groupBy("report", "kind").agg(F.array_sort(F.collect_set("part")).alias("list"))
    return lists.groupBy("kind").agg(F.countDistinct("list").alias("variants")).where("variants > 1")


def lapsed(verdicts: DataFrame, scores: DataFrame, least: float) -> DataFrame:
    """(mapping, verdict, reservation): mappings that are not touched or stand under a typing reservation, which a score below ``least`` gives."""
    low = scores.where(F.col("score").isNotNull()).agg(F.coalesce(F.min("score") < least, F.lit(False)).alias("low"))
    judged = verdicts.withColumn("k", F.lit(1)).join(F.broadcast(low.withColumn("k", F.lit(1))), "k")
    reservation = F.col("low") & (F.col("verdict") == "touched")
    return judged.select("mapping", "verdict", reservation.alias("reservation")).where("verdict <> 'touched' or reservation").orderBy("mapping")


def verdict_changes(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """(mapping, earlier, later, changed) of the later measurement's mappings."""
    before = earlier.select("mapping", F.col("verdict").alias("earlier"))
    joined = later.select("mapping", F.col("verdict").alias("later")).join(before, "mapping", "left")
    return joined.select("mapping", "earlier", "later", (~F.col("earlier").eqNullSafe(F.col("later"))).alias("changed"))


def comparable(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """One row of guards for two measurements (cfk, dataset, ts): one dataset, a shared class, and whether the times are out of order."""
    same = earlier.select("dataset").unionByName(later.select("dataset")).agg((F.countDistinct("dataset") == 1).alias("same_dataset"))
    shared = shared_classes(earlier, later).agg((F.count("*") > 0).alias("shares_class"))
    times = earlier.agg(F.max("ts").alias("a")).withColumn("k", F.lit(1)).join(later.agg(F.min("ts").alias("b")).withColumn("k", F.lit(1)), "k").select((F.col("a") > F.col("b")).alias("out_of_order"))
    one = lambda df: df.withColumn("k", F.lit(1))
    return one(same).join(one(shared), "k").join(one(times), "k").drop("k")
