"""Areas of GeoJSON files: a collection of features, a feature, or a bare geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_GEOMETRY = "struct<type:string,coordinates:string>"
_FILE = f"type string, coordinates string, geometry {_GEOMETRY}, features array<struct<geometry:{_GEOMETRY}>>"
_RINGS = "array<array<array<double>>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(area_id, part, ring, pts): the rings of the polygons of each file, whose name is the area's. A file is one JSON document.

    A file that is no JSON, has no geometry, or has one that is no polygon is an error.
    """
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
    files = spark.read.text(path, wholetext=True).select(name.alias("area_id"), F.from_json("value", _FILE).alias("j"))
    bare = F.struct(F.col("j.type").alias("type"), F.col("j.coordinates").alias("coordinates"))
    one = F.when(F.col("j.geometry").isNotNull(), F.col("j.geometry")).when(F.col("j.coordinates").isNotNull(), bare)
    many = F.when(F.col("j.type") == "FeatureCollection", F.transform("j.features", lambda f: f["geometry"])).otherwise(F.array(one))
    found = files.select("area_id", F.filter(many, lambda x: x.isNotNull()).alias("all"))
    polygons = lambda x: F.when(x["type"] == "Polygon", F.array(F.from_json(x["coordinates"], _RINGS))).when(x["type"] == "MultiPolygon", F.from_json(x["coordinates"], f"array<{_RINGS}>"))
    bad = found.where(F.coalesce(F.size("all"), F.lit(0)) < 1).select("area_id").first()
    if bad is not None:
        raise ValueError(f"{bad['area_id']}: has no geometry that can be read")
    shapes = found.select("area_id", F.posexplode("all").alias("nth", "x")).select("area_id", "nth", F.col("x.type").alias("type"), polygons(F.col("x")).alias("polygons"))
    bad = shapes.where("polygons is null or exists(polygons, p -> p is null)").first()
    if bad is not None:
        raise ValueError(f"{bad['area_id']}: a geometry of type {bad['type']} is no polygon")
    parts = shapes.select("area_id", "nth", F.posexplode("polygons").alias("k", "rings")).select("area_id", F.concat_ws("-", "nth", "k").alias("part"), F.posexplode("rings").alias("ring", "pts"))
    return parts.select("area_id", "part", "ring", F.transform("pts", lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))).alias("pts"))
