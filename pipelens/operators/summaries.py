"""Aggregates and windows over the network's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipelens import config
from pipelens.functions import geometry as g
from pipelens.operators import attributes, network


def component_attributes(t) -> DataFrame:
    """Per component: nodes, endpoints of each kind, and the centroid."""
    parts = network.components(t).join(t.node, "node_id")
    count = lambda roots: F.count_if(t.is_a(*roots))
    return parts.groupBy("component").agg(
        F.count("*").alias("nodes"), count(config.OUTFLOW).alias("outflows"), count(config.DISCHARGE).alias("discharges"), F.round(F.avg("x"), 4).alias("x"), F.round(F.avg("y"), 4).alias("y")
    )


COMPONENTS_SQL = """SELECT component, count(*) AS nodes, count(*) FILTER (cls = 'Gemaal') AS outflows, count(*) FILTER (cls IN ('Lozingspunt', 'Uitlaat', 'Lozingsput')) AS discharges,
round(avg(x), 4) AS x, round(avg(y), 4) AS y FROM comp JOIN node USING (node_id) GROUP BY 1"""


def per_pair(t) -> DataFrame:
    return t.conduit.groupBy(F.least("start_id", "end_id").alias("a"), F.greatest("start_id", "end_id").alias("b")).agg(F.count("*").alias("n"))


def per_node(t) -> DataFrame:
    return t.ends.groupBy("node_id").agg(F.count("*").alias("n"), F.min("bob").alias("low"), F.max("bob").alias("high"))


def rounding(t) -> DataFrame:
    """Share of sizes and lengths on a raster, by material."""
    rows = t.conduit.select(F.coalesce("material", F.lit("none")).alias("series"), F.col("conduit_id").alias("id"), (F.col("width_mm") / 1000).alias("v")).where("v is not null")
    return attributes.on_raster(rows, 0.4).select("series", "n", F.round("share", 6).alias("share"), "first")


ROUNDING_SQL = """SELECT coalesce(material, 'none') AS series, count(*) AS n, round(count(*) FILTER (abs(width_mm / 1000 / 0.4e0 - round(width_mm / 1000 / 0.4e0)) < 1e-6) / count(*), 6) AS share,
min(conduit_id) AS first FROM conduit WHERE width_mm IS NOT NULL GROUP BY 1"""


def rising_share(t) -> DataFrame:
    rows = t.gravity.where("bob_start is not null and bob_end is not null")
    return rows.groupBy("cls").agg(F.count("*").alias("n"), F.count_if(F.col("bob_end") - F.col("bob_start") > t.cfg.rise_warning).alias("rising"))


def dead_ends(t) -> DataFrame:
    """Nodes that gravity conduits end at and none starts from, by class."""
    into, out = t.gravity.select(F.col("end_id").alias("node_id")), t.gravity.select(F.col("start_id").alias("node_id"))
    return t.node.join(into, "node_id", "left_semi").join(out, "node_id", "left_anti").groupBy("cls").agg(F.count("*").alias("n"))


def numbered_labels(t) -> DataFrame:
    """Labels made unique: the second and later of a label get -2, -3 and so on, by id."""
    place = F.row_number().over(Window.partitionBy("label").orderBy("conduit_id"))
    return t.conduit.select("conduit_id", "label", place.alias("nth")).select("conduit_id", F.when(F.col("nth") == 1, F.col("label")).otherwise(F.concat_ws("-", "label", "nth")).alias("unique_label"))


LABELS_SQL = "SELECT conduit_id, CASE WHEN r = 1 THEN label ELSE concat(label, '-', r) END AS unique_label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY conduit_id) AS r FROM conduit)"


def node_systems(t) -> DataFrame:
    typed = t.gravity.select("conduit_id", t.system.alias("kind")).where("kind is not null")
    return t.incidence.join(typed, "conduit_id").groupBy("node_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("systems"))


def extent(t) -> DataFrame:
    box = [F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")]
    points = t.conduit.select(F.explode("pts").alias("p")).select("p.x", "p.y")
    layer = lambda df, name: df.agg(*box).select(F.lit(name).alias("layer"), "x0", "y0", "x1", "y1")
    return layer(t.node, "node").unionByName(layer(points, "conduit"))


def midpoints(t) -> DataFrame:
    """The point halfway along each conduit, and its length."""
    m = g.midpoint(F.col("pts"))
    return t.conduit.select("conduit_id", m["x"].alias("x"), m["y"].alias("y"), g.length(F.col("pts")).alias("length"))
