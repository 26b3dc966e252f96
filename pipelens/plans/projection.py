"""The network read from the driver's tables: one node and one conduit for each order.

The texts run as they are in Spark SQL and in DuckDB. Chains of nodes break every ten
keys, so that components stay small; parallels, loops, cycles, bends, gaps and odd values
come from the key by arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipelens import config
from pipelens.model import Tables
from pipelens.operators import graph

NODE = """
SELECT concat('N', o_orderkey) AS node_id,
  concat('put-', CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey % 500 ELSE o_orderkey END) AS label,
  CASE WHEN o_orderkey % 90 IN (42, 44, 46) THEN 'Lozingspunt' ELSE CASE o_orderkey % 40 WHEN 0 THEN 'Overstortput' WHEN 1 THEN 'Gemaal' WHEN 12 THEN 'Lozingspunt' WHEN 3 THEN 'Bergbezinkbassin'
    WHEN 14 THEN 'BlindePut' WHEN 5 THEN 'Valput' WHEN 26 THEN 'Uitlaat' WHEN 37 THEN 'LozePut' WHEN 33 THEN 'Lozingsput' ELSE 'Inspectieput' END END AS cls,
  CASE WHEN o_orderkey % 997 = 5 THEN 999999e0 ELSE 100000e0 + (m % 200) * 25e0 + (m * 7919 % 100) / 50e0 + (CASE WHEN o_orderkey % 113 = 1 THEN 0.2e0 ELSE 0e0 END) END AS x,
  400000e0 + floor(m / 200e0) * 25e0 + (m * 104729 % 100) / 50e0 AS y,
  10e0 + floor(o_totalprice / 5e3) * 0.05e0 AS ground,
  CASE WHEN o_orderkey % 17 <> 0 THEN 10e0 + o_totalprice / 1e5 + (o_orderkey % 7 - 3) / 50e0 END AS cover,
  CASE WHEN o_orderkey % 13 <> 0 THEN 10e0 + o_totalprice / 1e5 + (o_orderkey % 11 - 5) / 50e0 END AS z,
  CASE WHEN o_orderkey % 120 = 3 THEN NULL WHEN o_orderkey % 223 = 0 THEN 0e0 WHEN o_orderkey % 211 = 0 THEN 7000e0 WHEN o_orderkey % 19 <> 0 THEN 1000e0 + 100 * (o_orderkey % 25) END AS height_mm,
  CASE WHEN o_orderkey % 23 <> 0 AND o_orderkey % 120 <> 3 THEN 800e0 + 100 * (o_orderkey % 5) END AS width_mm,
  CASE o_orderkey % 5 WHEN 0 THEN 'Beton' WHEN 1 THEN 'PVC' WHEN 2 THEN 'Metselwerk' WHEN 3 THEN 'GewapendBeton' END AS material,
  CASE WHEN o_orderkey % 101 = 0 THEN 1850 WHEN o_orderkey % 103 = 0 THEN 2099 ELSE year(o_orderdate) - 20 END AS begin_year,
  o_orderkey % 301 = 0 AS multipart,
  CASE WHEN o_orderkey % 43 = 7 THEN true ELSE false END AS ended,
  CASE WHEN o_orderkey % 43 = 7 THEN make_date(2019, 5, 17) END AS end_date,
  make_date(CAST(CASE WHEN o_orderkey % 101 = 0 THEN 1850 WHEN o_orderkey % 103 = 0 THEN 2099 ELSE year(o_orderdate) - 20 END AS INT), 1, 1) AS begin_date
FROM (SELECT *, CASE WHEN o_orderkey % 113 = 1 THEN o_orderkey - 1 ELSE o_orderkey END AS m FROM orders)
"""

CONDUIT = """
SELECT k, concat('C', k) AS conduit_id, concat('s-', CASE WHEN k % 70 = 0 THEN k % 700 ELSE k END) AS label,
  CASE WHEN k % 400 = 39 OR kk % 80 = 30 THEN 'Oppervlaktewater' WHEN k % 80 IN (0, 79) THEN 'Hemelwaterriool' WHEN k % 64 = 5 THEN 'Duiker' WHEN kk % 16 < 6 THEN 'GemengdRiool' WHEN kk % 16 < 10 THEN 'Vuilwaterriool' WHEN kk % 16 < 13 THEN 'Hemelwaterriool'
    WHEN kk % 16 = 13 THEN 'Infiltratieriool' WHEN kk % 16 = 14 THEN 'Persleiding' ELSE 'Overstortleiding' END AS cls,
  s.node_id AS start_id, e.node_id AS end_id,
  CASE WHEN k % 199 = 0 THEN e.x WHEN k % 37 = 0 THEN s.x + 0.2e0 ELSE s.x END AS x1,
  CASE WHEN k % 199 = 0 THEN e.y ELSE s.y END AS y1,
  CASE WHEN k % 5 = 0 THEN (s.x + e.x) / 2e0 + (k % 7 - 3) / 4e0 END AS xm,
  CASE WHEN k % 5 = 0 THEN (s.y + e.y) / 2e0 + (k % 11 - 5) / 4e0 END AS ym,
  CASE WHEN k % 199 = 0 THEN s.x ELSE e.x END AS x2,
  CASE WHEN k % 199 = 0 THEN s.y WHEN k % 41 = 0 THEN e.y - 0.3e0 ELSE e.y END AS y2,
  CASE WHEN k % 29 <> 0 THEN s.ground - 1.5e0 - (k % 100) / 50e0 END AS bob_start,
  CASE WHEN k % 29 <> 0 AND k % 47 <> 0 THEN s.ground - 1.5e0 - (k % 100) / 50e0 - (k % 13 - 3) / 37e0 END AS bob_end,
  CASE WHEN kk % 31 <> 0 THEN (CASE WHEN kk % 53 = 0 THEN 30e0 WHEN kk % 59 = 0 THEN 1600e0 ELSE 100e0 * (1 + kk % 12) END) END AS width_mm,
  CASE WHEN kk % 31 <> 0 AND kk % 33 <> 0 THEN (CASE WHEN kk % 53 = 0 THEN 30e0 ELSE 100e0 * (1 + kk % 12) + (CASE WHEN kk % 9 = 0 THEN 100e0 ELSE 0e0 END) END) END AS height_mm,
  CASE kk % 6 WHEN 0 THEN 'Beton' WHEN 1 THEN 'PVC' WHEN 2 THEN 'Metselwerk' WHEN 3 THEN 'Gres' WHEN 4 THEN 'PE' END AS material,
  CASE k % 4 WHEN 0 THEN 'Rond' WHEN 1 THEN 'Eivormig' WHEN 2 THEN 'Muilprofiel' END AS shape,
  CASE WHEN k % 107 = 0 THEN 1860 ELSE yr - 45 + k % 60 END AS begin_year,
  CASE WHEN k % 61 = 0 THEN 0.5e0 WHEN k % 67 = 0 THEN 0e0
    ELSE sqrt((s.x - e.x) * (s.x - e.x) + (s.y - e.y) * (s.y - e.y)) * (1e0 + (k % 13 - 6) / 100e0) END AS length_m,
  k % 307 = 0 AS multipart,
  k % 71 = 3 AS ended,
  CASE WHEN k % 71 = 3 THEN make_date(2020, 11, 3) END AS end_date,
  make_date(CAST(CASE WHEN k % 107 = 0 THEN 1860 ELSE yr - 45 + k % 60 END AS INT), 1, 1) AS begin_date
FROM (
  SELECT o_orderkey AS k, CASE WHEN o_orderkey % 40 = 14 THEN o_orderkey - 1 ELSE o_orderkey END AS kk, year(o_orderdate) AS yr,
    concat('N', CASE WHEN o_orderkey % 77 IN (0, 1, 2) THEN o_orderkey - o_orderkey % 77 ELSE o_orderkey END) AS a,
    concat('N', CASE WHEN o_orderkey % 77 IN (0, 1, 2) THEN o_orderkey - o_orderkey % 77 + 1 WHEN o_orderkey % 97 = 0 THEN o_orderkey
      WHEN o_orderkey % 10 = 8 THEN o_orderkey - 3 WHEN o_orderkey % 10 = 9 AND o_orderkey % 50 > 40 THEN o_orderkey - 2
      WHEN o_orderkey % 10 = 9 THEN o_orderkey + 10 ELSE o_orderkey + 1 END) AS b
  FROM orders) c
JOIN node s ON s.node_id = c.a
JOIN node e ON e.node_id = c.b
"""

FEATURE = """
SELECT concat('F', p_partkey) AS feature_id,
  CASE p_partkey % 4 WHEN 0 THEN 'building' WHEN 1 THEN 'water' WHEN 2 THEN 'cover' ELSE 'structure' END AS role,
  100000e0 + (m % 200) * 25e0 + (m * 7919 % 100) / 50e0 + (p_partkey % 5) * 0.4e0 AS x,
  400000e0 + floor(m / 200e0) * 25e0 + (m * 104729 % 100) / 50e0 + (p_partkey % 3) * 0.3e0 AS y,
  CASE WHEN p_partkey % 3 = 0 THEN 1.5e0 + p_partkey % 4 END AS half
FROM (SELECT p_partkey, p_partkey * 7 AS m FROM part)
"""

RASTER = """
SELECT o_orderkey % 200 AS col, 799 - CAST(floor(o_orderkey / 200e0) AS BIGINT) AS row,
  10e0 + o_totalprice / 1e5 + (o_orderkey % 9 - 4) / 17e0 AS value
FROM orders WHERE o_totalprice IS NOT NULL
"""

WEIR = """
SELECT concat('N', o_orderkey) AS node_id, concat('W', o_orderkey) AS weir_id, 10e0 + o_totalprice / 1e5 - (floor(o_orderkey % 400 / 40e0) + 0.03e0) * 0.1e0 AS level
FROM orders WHERE o_orderkey % 40 = 0
"""

#: Compartments and other nodes within a node, and connections between some of them.
PART = """
SELECT concat('N', o_orderkey - o_orderkey % 50) AS parent_id, concat('N', o_orderkey) AS child_id, CASE WHEN o_orderkey % 50 = 1 THEN 'Compartiment' ELSE 'Inspectieput' END AS child_cls
FROM orders WHERE o_orderkey % 50 IN (1, 2, 3)
"""

CONNECTION = """
SELECT concat('N', o_orderkey) AS a, concat('N', o_orderkey + 1) AS b FROM orders WHERE o_orderkey % 100 = 1
UNION ALL SELECT concat('N', o_orderkey + 1), concat('N', o_orderkey) FROM orders WHERE o_orderkey % 100 = 1
"""

#: Rows of a validation report: one for each event; the first half of the ids is the earlier moment.
REPORT = """
SELECT concat('cfk', event_id % 3) AS cfk, concat('O', user_id) AS focus_node, event_type AS source,
  CASE WHEN value > 50 THEN 'Violation' ELSE 'Warning' END AS severity,
  CASE WHEN user_id % 11 <> 0 THEN concat('T', user_id % 7) END AS object_type,
  hour(ts) < 12 AS early, ts AS seen
FROM events
"""

#: The same network as a WITH clause for DuckDB.
WITH = f"WITH RECURSIVE node AS MATERIALIZED ({NODE}), conduit AS MATERIALIZED ({CONDUIT}), feature AS ({FEATURE}), raster AS ({RASTER}), weir AS ({WEIR}), part_of AS ({PART}), connection AS ({CONNECTION}), report AS ({REPORT})"


#: Networks that have been read in this application, by folder.
_read: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, sf_dir: str, cfg: config.Config | None = None) -> Tables:
    """The network of a folder of the driver's tables. It is built once in an application, as tables in the shared folder that all rules read."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _read:
        _read[key] = _build(spark, sf_dir)
    return _read[key] if cfg is None else replace(_read[key], cfg=cfg, memo={})


def views(spark: SparkSession, sf_dir: str) -> Tables:
    """The network as ``tables`` gives it, but not written where it has not been yet: for a query that passes over it once and asks for few columns and rows."""
    built = (spark.sparkContext.applicationId, sf_dir) in _read
    return tables(spark, sf_dir) if built else _build(spark, sf_dir, lambda df: df)


def _build(spark: SparkSession, sf_dir: str, keep: Callable[[DataFrame], DataFrame] = graph.written) -> Tables:
    source = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderdate")
    of = lambda sql: spark.sql(sql.replace("FROM orders", "FROM {orders}"), orders=source)
    node = keep(of(NODE).withColumn("types", F.array("cls")))
    point = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    conduit = spark.sql(CONDUIT.replace("FROM orders", "FROM {orders}").replace("JOIN node", "JOIN {node}"), orders=source, node=node)
    conduit = conduit.withColumn("types", F.array("cls")).withColumn(
        "pts", F.when(F.col("xm").isNull(), F.array(point("x1", "y1"), point("x2", "y2"))).otherwise(F.array(point("x1", "y1"), point("xm", "ym"), point("x2", "y2")))
    )
    tree = class_tree(spark)
    return Tables(
        node=node,
        conduit=keep(conduit),
        class_edge=tree,
        vocabulary=vocabulary(),
        feature=features(spark, sf_dir),
        raster=of(RASTER),
        weir=of(WEIR),
        part=of(PART).withColumn("child_types", F.array("child_cls")),
        connection=of(CONNECTION),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    return _areas(spark.sql(FEATURE.replace("FROM part", "FROM {part}"), part=parts))


def _areas(feature: DataFrame) -> DataFrame:
    """Features with a half width are squares around their point, the others points."""
    corner = lambda i, j: F.struct((F.col("x") + i * F.col("half")).alias("x"), (F.col("y") + j * F.col("half")).alias("y"))
    ring = F.array(*[corner(i, j) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))])
    return feature.withColumn("ring", F.when(F.col("half").isNotNull(), ring))


def region(feature: DataFrame) -> DataFrame:
    """A region for each role (area_id, part, ring, pts): large squares around its square features, every second with a square hole."""
    square = lambda n: F.array(*[F.struct((F.col("x") + i * n * F.col("half")).alias("x"), (F.col("y") + j * n * F.col("half")).alias("y")) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))])
    holed = F.substring("feature_id", 2, 12).cast("long") % 2 == 0
    return feature.where("half is not null").select(F.col("role").alias("area_id"), F.col("feature_id").alias("part"), F.posexplode(F.when(holed, F.array(square(12), square(4))).otherwise(F.array(square(12)))).alias("ring", "pts"))


#: The same squares for DuckDB: half widths of the outside and of the hole.
REGION_SQL = "SELECT role, feature_id, x, y, 12 * half AS h, CASE WHEN CAST(substr(feature_id, 2) AS BIGINT) % 2 = 0 THEN 4 * half END AS g FROM feature WHERE half IS NOT NULL"


def vocabulary() -> dict[str, set[str]]:
    """Descendants of each class of the package's own tree, a few dozen names."""
    found: dict[str, set[str]] = {}
    parents: dict[str, list[str]] = {}
    for child, parent in config.CLASS_TREE:
        parents.setdefault(child, []).append(parent)
    for child in parents:
        above = list(parents[child])
        while above:
            root = above.pop()
            if child not in found.setdefault(root, {root}):
                found[root].add(child)
                above.extend(parents.get(root, ()))
    return found


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value", "ts")
    return spark.sql(REPORT.replace("FROM events", "FROM {events}"), events=events)


def class_tree(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(config.CLASS_TREE, "child string, parent string")
