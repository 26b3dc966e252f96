"""Rules on labels, dates and attributes of single objects, and on rounding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelens import config
from pipelens.findings import rule
from pipelens.functions import geometry as g


def lookup(t, rows: list, schema: str) -> DataFrame:
    """A lookup table of the package: a few dozen rows at most."""
    return F.broadcast(t.node.sparkSession.createDataFrame(rows, schema))


def largest(width="width_mm", height="height_mm"):
    """The larger of the positive sizes, null without any."""
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    return F.greatest(positive(width), positive(height))


@rule("ADM-002", "F", "uniqueness")
def shared_label(t):
    """Labels of more than one network node, or of more than one conduit."""
    both = t.node.where(t.is_a(config.NODE)).select(F.lit("node").alias("kind"), F.col("node_id").alias("object_id"), "label").unionByName(
        t.conduit.select(F.lit("conduit").alias("kind"), F.col("conduit_id").alias("object_id"), "label")
    )
    named = both.where("label is not null and label <> ''")
    many = named.groupBy("kind", "label").agg(F.count("*").alias("value")).where("value > 1")
    return named.join(many, ["kind", "label"]).select("object_id", F.col("label").alias("detail"), "value")


@rule("ADM-003", "F", "validity")
def label_pattern(t):
    """Labels that do not begin as the configured pattern asks; without a pattern there are no findings."""
    pattern = t.cfg.label_pattern
    bad = F.lit(False) if pattern is None else ~F.coalesce("label", F.lit("")).rlike(f"^(?:{pattern})")
    rows = t.node.select(F.col("node_id").alias("object_id"), "label").unionByName(t.conduit.select(F.col("conduit_id").alias("object_id"), "label"))
    return rows.where(bad).select("object_id", F.col("label").alias("detail"))


@rule("ADM-006", "W", "actuality")
def attached_but_not_current(t):
    """Objects whose end date has passed or whose begin date is to come, but that are still attached. Tables without dates have a flag and a year."""

    def stale(df):
        if "end_date" in df.columns:
            return (F.col("end_date") < F.lit(t.cfg.today)) | (F.col("begin_date") > F.lit(t.cfg.today))
        return F.col("ended") | (F.col("begin_year") > t.cfg.today.year)

    nodes = t.node.where(t.is_a(config.NODE) & stale(t.node)).join(t.incidence.select("node_id").distinct(), "node_id", "left_semi").select(F.col("node_id").alias("object_id"))
    conduits = t.conduit.where(stale(t.conduit) & (F.col("start_id").isNotNull() | F.col("end_id").isNotNull())).select(F.col("conduit_id").alias("object_id"))
    return nodes.unionByName(conduits)


#: Manhole classes and the conduits or parts one of which they must have; fixed values.
REQUIRED_PARTS = [("Overstortput", ["Overstortleiding", "Overstortdrempel"]), ("Lozingsput", ["VrijvervalRioolleiding", "Duiker"])]


@rule("ADM-007", "F", "completeness")
def manhole_without_function(t):
    """Manholes of a class that have neither an attached conduit nor a part of the required classes."""
    out = None
    for cls, required in REQUIRED_PARTS:
        nodes = t.node.where(t.is_a(cls)).select("node_id")
        served = t.ends.where(t.is_a(*required)).select("node_id")
        if t.part is not None:
            served = served.unionByName(t.part.where(t.is_a(*required, types="child_types")).select(F.col("parent_id").alias("node_id")))
        found = nodes.join(served.distinct(), "node_id", "left_anti").select(F.col("node_id").alias("object_id"), F.lit(cls).alias("detail"))
        out = found if out is None else out.unionByName(found)
    return out


@rule("ADM-008", "W", "consistency")
def unconnected_parts(t):
    """Network nodes of at least two part nodes that no connection (a, b, in both directions) links."""
    none = t.node.where("false").select(F.col("node_id").alias("object_id"), F.lit(0).alias("value"))
    if t.part is None or t.connection is None:
        return none
    parts = t.part.join(t.node.select(F.col("node_id").alias("child_id")), "child_id", "left_semi")
    many = parts.groupBy("parent_id").agg(F.count("*").alias("value")).where("value >= 2")
    left, right = parts.select("parent_id", F.col("child_id").alias("a")), parts.select("parent_id", F.col("child_id").alias("b"))
    joined = t.connection.join(left, "a").join(right, ["parent_id", "b"]).select("parent_id").distinct()
    return many.join(joined, "parent_id", "left_anti").select(F.col("parent_id").alias("object_id"), "value")


@rule("ADM-009", "W", "consistency")
def conduit_on_whole_node(t):
    """Ends coupled to a node that has compartments, by side."""
    if t.part is None:
        return t.node.where("false").select(F.col("node_id").alias("object_id"))
    whole = t.part.where(t.is_a("Compartiment", types="child_types")).select(F.col("parent_id").alias("node_id")).distinct()
    return t.ends.join(whole, "node_id", "left_semi").select(F.col("conduit_id").alias("object_id"), F.col("node_id").alias("object2_id"), F.col("side").alias("detail"))


@rule("RVZ-007", "W", "completeness")
def tank_without_size(t):
    """Tanks without any size or volume: the sizes of the node, or an aspect of these kinds; fixed values."""
    kinds = ["Inhoud", "NettoBerging", "NuttigeBerging", "BreedteBouwwerk", "LengteBouwwerk", "HoogteBouwwerk"]
    bare = t.node.where(t.is_a(*config.TANK) & F.col("width_mm").isNull() & F.col("height_mm").isNull()).select(F.col("node_id").alias("object_id"))
    if t.aspect is None:
        return bare
    return bare.join(t.aspect.where(F.col("kind").isin(kinds)).select("object_id"), "object_id", "left_anti")


@rule("ATTR-001", "F", "plausibility")
def size_for_material(t):
    sizes = lookup(t, config.SIZES, "material string, low int, high int")
    found = t.gravity.withColumn("value", largest()).join(sizes, "material")
    limit = F.when(F.col("value") < F.col("low"), F.col("low")).when(F.col("value") > F.col("high"), F.col("high"))
    return found.withColumn("threshold", limit).where("threshold is not null").select(F.col("conduit_id").alias("object_id"), "value", "threshold")


@rule("ATTR-002", "W", "plausibility")
def small_size(t):
    found = t.gravity.withColumn("value", largest()).where(F.col("value") < t.cfg.small_size)
    return found.select(F.col("conduit_id").alias("object_id"), "value", F.lit(t.cfg.small_size).alias("threshold"))


@rule("ATTR-003", "W", "plausibility")
def year_for_material(t):
    years = lookup(t, config.YEARS, "material string, first int, last int")
    found = t.gravity.join(years, "material").withColumn("value", F.col("begin_year"))
    limit = F.when(F.col("value") < F.col("first"), F.col("first")).when(F.col("value") > F.col("last"), F.col("last"))
    return found.withColumn("threshold", limit).where("threshold is not null").select(F.col("conduit_id").alias("object_id"), "value", "threshold")


@rule("ATTR-004", "F", "consistency")
def size_for_shape(t):
    rules = lookup(t, config.SHAPE_RULES, "shape string, asks string")
    w, h = F.col("width_mm"), F.col("height_mm")
    detail = (
        F.when(w.isNull() | h.isNull(), "size missing")
        .when((F.col("asks") == "equal") & (F.abs(w - h) > 0), "not equal")
        .when((F.col("asks") == "taller") & (h <= w), "not taller")
        .when((F.col("asks") == "wider") & (h >= w), "not wider")
    )
    return t.gravity.join(rules, "shape").select(F.col("conduit_id").alias("object_id"), detail.alias("detail")).where("detail is not null")


@rule("ATTR-005", "F", "plausibility")
def size_in_centimetres(t):
    """Small sizes that are no trade size but would be one ten times as large."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("detail"), F.col(f"{k}_mm").alias("value")) for k in ("width", "height")])).alias("s")
    trade = lambda v: F.exists(F.array(*[F.lit(float(x)) for x in t.cfg.trade_sizes]), lambda s: F.abs(s - v) < 0.5)
    found = t.gravity.select(F.col("conduit_id").alias("object_id"), kinds).select("object_id", "s.*")
    v = F.col("value")
    return found.where((v > 0) & (v <= t.cfg.centimetre_size) & ~trade(v) & trade(v * 10)).withColumn("threshold", F.lit(t.cfg.centimetre_size))


@rule("ATTR-006", "W", "plausibility")
def larger_than_its_node(t):
    sizes = {"value": largest(), "threshold": F.greatest(largest("node_width", "node_height"), F.when(F.col("node_length") > 0, F.col("node_length")))}
    found = t.at_nodes.withColumns(sizes).where(F.col("value") > F.col("threshold") + t.cfg.node_size_margin)
    return found.select(F.col("conduit_id").alias("object_id"), F.col("node_id").alias("object2_id"), F.col("side").alias("detail"), "value", "threshold")


@rule("ATTR-007", "W", "plausibility")
def odd_year(t):
    rows = t.gravity.select(F.col("conduit_id").alias("object_id"), F.col("begin_year").alias("value")).unionByName(
        t.node.where(t.is_a(config.NODE)).select(F.col("node_id").alias("object_id"), F.col("begin_year").alias("value"))
    )
    return rows.where((F.col("value") < t.cfg.first_year) | (F.col("value") > t.cfg.today.year))


@rule("ATTR-008", "W", "plausibility")
def odd_length(t):
    lo, hi = t.cfg.length_range
    return t.gravity.where((F.col("length_m") < lo) | (F.col("length_m") > hi)).select(F.col("conduit_id").alias("object_id"), F.col("length_m").alias("value"))


@rule("ATTR-009", "W", "consistency")
def drawn_length(t):
    """Lines drawn longer or shorter than registered by more than the allowed share."""
    share = F.abs(g.length(F.col("pts")) - F.col("length_m")) / F.col("length_m")
    found = t.gravity.where("length_m > 0").withColumn("value", share)
    return found.where(F.col("value") > t.cfg.length_share).select(F.col("conduit_id").alias("object_id"), "value", F.lit(t.cfg.length_share).alias("threshold"))


#: Materials of nodes that go with a conduit's material; fixed values.
NODE_MATERIALS = [
    ("Beton", ["Beton", "GewapendBeton", "Metselwerk", "Kunststof", "PVC", "PE"]),
    ("GewapendBeton", ["Beton", "GewapendBeton", "Metselwerk"]),
    ("Metselwerk", ["Metselwerk", "Beton", "GewapendBeton"]),
]


@rule("ATTR-010", "W", "plausibility")
def node_material(t):
    expected = lookup(t, NODE_MATERIALS, "material string, expected array<string>")
    found = t.at_nodes.join(expected, "material").where("node_material is not null and not array_contains(expected, node_material)")
    return found.select(F.col("conduit_id").alias("object_id"), F.col("node_id").alias("object2_id"), F.col("side").alias("detail"))


@rule("ATTR-012", "W", "plausibility")
def shape_for_material(t):
    shapes = lookup(t, config.SHAPES, "material string, allowed array<string>")
    return t.gravity.where("shape is not null").join(shapes, "material").where("not array_contains(allowed, shape)").select(F.col("conduit_id").alias("object_id"), F.col("shape").alias("detail"))


@rule("BTR-006", "W", "reliability")
def rounded_series(t):
    """Series of levels of which most lie on a raster: inverts, covers, grounds; on the smallest object."""
    rows = t.gravity_ends.select(F.lit("invert").alias("series"), F.col("conduit_id").alias("id"), F.col("bob").alias("v"))
    for name, column in (("cover", "cover"), ("ground", "ground")):
        rows = rows.unionByName(t.node.select(F.lit(name).alias("series"), F.col("node_id").alias("id"), F.col(column).alias("v")))
    return on_raster(rows.where("v is not null"), t.cfg.rounding_step).where((F.col("n") >= t.cfg.rounding_values) & (F.col("share") >= t.cfg.rounding_share)).select(
        F.col("first").alias("object_id"), F.col("series").alias("detail"), F.col("share").alias("value"), F.lit(t.cfg.rounding_share).alias("threshold")
    )


def on_raster(rows: DataFrame, step: float) -> DataFrame:
    """(series, n, share, first): the share of values within a millionth of a multiple of ``step``."""
    on = F.abs(F.col("v") / step - F.rint(F.col("v") / step)) < 1e-6
    return rows.groupBy("series").agg(F.count("*").alias("n"), (F.count_if(on) / F.count("*")).alias("share"), F.min("id").alias("first"))
