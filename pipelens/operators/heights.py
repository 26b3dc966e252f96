"""Rules on levels and slopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelens import config
from pipelens.findings import rule
from pipelens.functions import geometry as g
from pipelens.operators.attributes import largest


def _end(df: DataFrame, *more) -> DataFrame:
    return df.select(F.col("conduit_id").alias("object_id"), F.col("node_id").alias("object2_id"), F.col("side").alias("detail"), *more)


def size_m():
    """Height in metres; a height of null or zero gives way to the width."""
    return F.coalesce(F.nullif(F.col("height_mm"), F.lit(0.0)), F.col("width_mm")) / 1000


@rule("HGT-004", "F", "consistency")
def invert_outside_node(t):
    found = t.at_nodes
    high = found.where("bob > top").select("conduit_id", "node_id", F.concat("side", F.lit(":above")).alias("side"), F.col("bob").alias("value"), F.col("top").alias("threshold"))
    low = found.where("bob < floor").select("conduit_id", "node_id", F.concat("side", F.lit(":below")).alias("side"), F.col("bob").alias("value"), F.col("floor").alias("threshold"))
    return _end(high.unionByName(low), "value", "threshold")


def rising(t) -> DataFrame:
    return t.gravity.withColumn("value", F.col("bob_end") - F.col("bob_start")).select(F.col("conduit_id").alias("object_id"), "value")


@rule("HGT-005", "W", "plausibility")
def slight_rise(t):
    return rising(t).where((F.col("value") > t.cfg.rise_warning) & (F.col("value") <= t.cfg.rise_error)).withColumn("threshold", F.lit(t.cfg.rise_warning))


@rule("HGT-006", "F", "plausibility")
def rise(t):
    return rising(t).where(F.col("value") > t.cfg.rise_error).withColumn("threshold", F.lit(t.cfg.rise_error))


def slopes(conduits: DataFrame) -> DataFrame:
    """Fall over length; the registered length, or else the drawn one; none without a positive length."""
    length = F.coalesce("length_m", g.length(F.col("pts")))
    return conduits.withColumn("value", (F.col("bob_start") - F.col("bob_end")) / F.when(length > 0, length)).where("value is not null")


@rule("HGT-007", "W", "plausibility")
def flat(t):
    found = slopes(t.gravity.where(t.is_a(*config.FOUL))).where((F.col("value") >= 0) & (F.col("value") < t.cfg.slope_low))
    return found.select(F.col("conduit_id").alias("object_id"), "value", F.lit(t.cfg.slope_low).alias("threshold"))


@rule("HGT-008", "W", "plausibility")
def steep(t):
    return slopes(t.gravity).where(F.col("value") > t.cfg.slope_high).select(F.col("conduit_id").alias("object_id"), "value", F.lit(t.cfg.slope_high).alias("threshold"))


def in_and_out(t) -> tuple[DataFrame, DataFrame]:
    """Gravity conduits by the node they end at, and by the node they start from."""
    size = largest()
    one = t.gravity.withColumn("size", size)
    into = one.where("end_id is not null").select(F.col("end_id").alias("node_id"), "conduit_id", F.col("bob_end").alias("bob"), "size")
    out = one.where("start_id is not null").select(F.col("start_id").alias("node_id"), "conduit_id", F.col("bob_start").alias("bob"), "size")
    return into, out


@rule("HGT-009", "W", "plausibility")
def drop_in_node(t):
    into, out = in_and_out(t)
    low = into.groupBy("node_id").agg(F.min("bob").alias("inflow"))
    high = out.groupBy("node_id").agg(F.max("bob").alias("outflow"))
    found = low.join(high, "node_id").withColumn("value", F.col("inflow") - F.col("outflow")).where(F.col("value") > t.cfg.drop)
    return found.join(t.node.where(~t.is_a(*config.DROP)).select("node_id"), "node_id", "left_semi").select(F.col("node_id").alias("object_id"), "value", F.lit(t.cfg.drop).alias("threshold"))


@rule("HGT-010", "W", "plausibility")
def narrowing(t):
    """Nodes whose largest way out is smaller than their largest way in; on that way out, the smallest id among equals."""
    into, out = in_and_out(t)
    largest_in = into.groupBy("node_id").agg(F.max("size").alias("threshold"))
    best = out.where("size is not null").groupBy("node_id").agg(F.min(F.struct((-F.col("size")).alias("minus"), "conduit_id")).alias("m"))
    found = largest_in.join(best, "node_id").where(-F.col("m.minus") < F.col("threshold"))
    return found.select(F.col("m.conduit_id").alias("object_id"), F.col("node_id").alias("object2_id"), (-F.col("m.minus")).alias("value"), "threshold")


@rule("HGT-011", "F", "consistency")
def weir_level(t):
    """Weirs below the lowest inflow, or above the top of their node."""
    if t.weir is None:
        return t.node.where("false").select(F.col("node_id").alias("object_id"))
    low = in_and_out(t)[0].groupBy("node_id").agg(F.min("bob").alias("inflow"))
    found = t.weir.join(low, "node_id", "left").join(t.tops.select("node_id", "top"), "node_id", "left")
    detail = F.explode(F.filter(F.array(F.when(F.col("level") < F.col("inflow"), F.concat("weir_id", F.lit(":below"))), F.when(F.col("level") > F.col("top"), F.concat("weir_id", F.lit(":above")))), lambda x: x.isNotNull()))
    return found.select(F.col("node_id").alias("object_id"), detail.alias("detail"), F.col("level").alias("value"))


@rule("HGT-012", "F", "plausibility")
def node_height(t):
    h = F.col("height_mm") / 1000
    return t.node.where(t.is_a(config.NODE)).withColumn("value", h).where((F.col("value") <= 0) | (F.col("value") > t.cfg.node_height)).select(F.col("node_id").alias("object_id"), "value", F.lit(t.cfg.node_height).alias("threshold"))


@rule("HGT-013", "W", "plausibility")
def earth_cover(t):
    lo, hi = t.cfg.cover_range
    found = t.at_nodes.withColumn("value", F.col("ground") - (F.col("bob") + size_m()))
    return _end(found.where((F.col("value") < lo) | (F.col("value") > hi)), "value")


@rule("HGT-014", "W", "plausibility")
def falls_unlike_ground(t):
    ground = lambda p: t.node.select(F.col("node_id").alias(f"{p}_id"), F.col("ground").alias(f"{p}_ground"))
    found = t.gravity.join(ground("start"), "start_id").join(ground("end"), "end_id")
    found = found.withColumn("value", F.abs((F.col("bob_start") - F.col("bob_end")) - (F.col("start_ground") - F.col("end_ground"))))
    return found.where(F.col("value") > t.cfg.ground_fall).select(F.col("conduit_id").alias("object_id"), "value", F.lit(t.cfg.ground_fall).alias("threshold"))


@rule("HGT-015", "W", "consistency")
def floor_off_inverts(t):
    low = t.gravity_ends.groupBy("node_id").agg(F.min("bob").alias("low"))
    found = t.tops.where(t.is_a(config.NODE)).join(low, "node_id").withColumn("value", F.col("floor") - F.col("low"))
    detail = F.when(F.col("value") > t.cfg.floor_above, "above").when(F.col("value") < -t.cfg.floor_below, "below")
    return found.select(F.col("node_id").alias("object_id"), detail.alias("detail"), "value").where("detail is not null")


@rule("HGT-016", "W", "plausibility")
def end_above_floor(t):
    found = t.at_nodes.where(~t.is_a(*config.DROP, types="node_types")).withColumn("value", F.col("bob") - F.col("floor"))
    return _end(found.where(F.col("value") > t.cfg.drop), "value", F.lit(t.cfg.drop).alias("threshold"))


@rule("HGT-017", "W", "consistency")
def z_unlike_level(t):
    """Node z against the cover level; z of line ends against inverts where lines have z."""
    nodes = t.node.where(t.is_a(config.NODE)).select(F.col("node_id").alias("object_id"), F.lit(None).cast("string").alias("detail"), F.abs(F.col("z") - F.col("cover")).alias("value"))
    if "zs" in t.conduit.columns:
        side = lambda name, i, bob: t.gravity.select(F.col("conduit_id").alias("object_id"), F.lit(name).alias("detail"), F.abs(F.element_at("zs", i) - F.col(bob)).alias("value"))
        nodes = nodes.unionByName(side("start", 1, "bob_start")).unionByName(side("end", -1, "bob_end"))
    return nodes.where(F.col("value") > t.cfg.z_difference).withColumn("threshold", F.lit(t.cfg.z_difference))


@rule("HGT-018", "F", "consistency")
def crown_above_top(t):
    found = t.at_nodes.withColumn("value", F.col("bob") + size_m()).where(F.col("value") > F.col("top"))
    return _end(found, "value", F.col("top").alias("threshold"))
