"""The registry of queries and of the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipelens import config, findings
from pipelens.operators import attributes, enrich, external, graph, heights, hierarchy, network, regions, reports, summaries, topology  # noqa: F401  (rules register themselves)
from pipelens.plans import export, more, oracles, projection
from pipelens.plans.oracles import COMMON, GRAPH

Query = Callable[[SparkSession, str], DataFrame]


#: Rules that pass over the conduits or the nodes once, with few of their columns: run alone they need no written network.
ONE_PASS = {"ATTR-001", "ATTR-002", "ATTR-003", "ATTR-004", "ATTR-005", "ATTR-008", "ATTR-012", "HGT-005", "HGT-006", "HGT-007", "HGT-008", "HGT-012", "HGT-017", "NET-003", "RVZ-007"}


def _rule(rule_id: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    read = projection.views if rule_id in ONE_PASS else projection.tables
    return findings.run(rule_id, read(spark, sf_dir))


def _on(f: Callable, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query of the projected tables."""
    return f(projection.tables(spark, sf_dir))


def _report(f: Callable, spark: SparkSession, sf_dir: str) -> DataFrame:
    return f(projection.report(spark, sf_dir))


def _patterns(spark: SparkSession) -> DataFrame:
    rows = [("M1", "error", False, True), ("M1", "pur", True, True), ("M2", "s", True, False), ("M3", "absent", False, True)]
    return spark.createDataFrame(rows, "mapping string, shape string, prefix boolean, required boolean")


#: The same patterns for DuckDB.
PATTERNS = "(VALUES ('M1', 'error', false, true), ('M1', 'pur', true, true), ('M2', 's', true, false), ('M3', 'absent', false, true)) p(mapping, shape, prefix, required)"
HITS = f"SELECT mapping, cfk, required, count(*) AS n, count(DISTINCT focus_node) AS objects, string_agg(DISTINCT source, ',' ORDER BY source) AS shapes FROM report r JOIN {PATTERNS} ON CASE WHEN prefix THEN starts_with(source, shape) ELSE source = shape END GROUP BY ALL"


def _evidence(r: DataFrame) -> DataFrame:
    return reports.evidence(r, _patterns(r.sparkSession))


def _verdicts(r: DataFrame) -> DataFrame:
    patterns = _patterns(r.sparkSession)
    return reports.verdicts(reports.evidence(r, patterns), patterns)


def _early_late(r: DataFrame) -> tuple[DataFrame, DataFrame]:
    return r.where("early"), r.where("not early")


def _closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and regions, and orders below customers below nations, as one class tree."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("N"), "n_nationkey").alias("child"), F.concat(F.lit("R"), "n_regionkey").alias("parent"))
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("C"), "c_custkey").alias("child"), F.concat(F.lit("N"), "c_nationkey").alias("parent"))
    return hierarchy.closure(nation.unionByName(customer))


#: Where objects are: a node's point, halfway along a conduit.
PLACES = """,
line AS (SELECT *, sqrt((x1 - xm) * (x1 - xm) + (y1 - ym) * (y1 - ym)) AS l1, sqrt((xm - x2) * (xm - x2) + (ym - y2) * (ym - y2)) AS l2 FROM conduit),
place AS (SELECT node_id AS object_id, x, y FROM node UNION ALL SELECT conduit_id,
  coalesce(CASE WHEN xm IS NULL THEN x1 + 0.5e0 * (x2 - x1) WHEN (l1 + l2) / 2 < l1 THEN x1 + (l1 + l2) / 2 / l1 * (xm - x1) ELSE xm + ((l1 + l2) / 2 - l1) / nullif(l2, 0) * (x2 - xm) END, x1),
  coalesce(CASE WHEN xm IS NULL THEN y1 + 0.5e0 * (y2 - y1) WHEN (l1 + l2) / 2 < l1 THEN y1 + (l1 + l2) / 2 / l1 * (ym - y1) ELSE ym + ((l1 + l2) / 2 - l1) / nullif(l2, 0) * (y2 - ym) END, y1) FROM line)
"""

CLOSURE = """
WITH RECURSIVE e AS (SELECT concat('N', n_nationkey) AS child, concat('R', n_regionkey) AS parent FROM nation UNION ALL SELECT concat('C', c_custkey), concat('N', c_nationkey) FROM customer),
c(root, cls) AS (SELECT parent, parent FROM e UNION SELECT c.root, e.child FROM c JOIN e ON e.parent = c.cls)
SELECT root, cls FROM c
"""

_NETWORK: dict[str, tuple[Callable, str | None]] = {
    "graph_1": (lambda t: network.reach(t, ("Gemaal",)).select(F.col("id").alias("node_id")), f"{COMMON}{GRAPH}, got(id) AS (SELECT node_id FROM node WHERE cls = 'Gemaal' UNION SELECT e.a FROM edge e JOIN got ON e.b = got.id) SELECT id AS node_id FROM got"),
    "graph_2": (network.components, f"{COMMON}{GRAPH} SELECT node_id, component FROM comp"),
    "graph_3": (
        network.strong_components,
        f"{COMMON}{GRAPH}, go(a, b) AS (SELECT a, b FROM edge UNION SELECT go.a, e.b FROM go JOIN edge e ON e.a = go.b) SELECT x.a AS id, min(x.b) AS component FROM go x JOIN go y ON x.a = y.b AND x.b = y.a GROUP BY 1",
    ),
    "graph_4": (summaries.component_attributes, f"{COMMON}{GRAPH} {summaries.COMPONENTS_SQL}"),
    "agg_5": (summaries.per_pair, f"{COMMON} SELECT least(start_id, end_id) AS a, greatest(start_id, end_id) AS b, count(*) AS n FROM conduit GROUP BY ALL"),
    "agg_6": (summaries.per_node, f"{COMMON} SELECT node_id, count(*) AS n, min(bob) AS low, max(bob) AS high FROM ends GROUP BY 1"),
    "agg_9": (summaries.rounding, f"{COMMON} {summaries.ROUNDING_SQL}"),
    "agg_14": (summaries.rising_share, f"{COMMON} SELECT cls, count(*) AS n, count(*) FILTER (bob_end - bob_start > 0.01) AS rising FROM grav WHERE bob_start IS NOT NULL AND bob_end IS NOT NULL GROUP BY 1"),
    "agg_17": (summaries.dead_ends, f"{COMMON} SELECT cls, count(*) AS n FROM node WHERE node_id IN (SELECT end_id FROM grav) AND node_id NOT IN (SELECT start_id FROM grav) GROUP BY 1"),
    "win_2": (summaries.numbered_labels, f"{COMMON} {summaries.LABELS_SQL}"),
    "mod_19": (summaries.node_systems, f"{COMMON} SELECT node_id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS systems FROM inc JOIN kind USING (conduit_id) WHERE kind IS NOT NULL GROUP BY 1"),
    "snk_7": (summaries.extent, f"{COMMON} SELECT 'node' AS layer, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM node UNION ALL SELECT 'conduit', min(least(x1, x2, coalesce(xm, x1))), min(least(y1, y2, coalesce(ym, y1))), max(greatest(x1, x2, coalesce(xm, x1))), max(greatest(y1, y2, coalesce(ym, y1))) FROM conduit"),
    "f_17": (summaries.midpoints, f"{COMMON}{PLACES} SELECT conduit_id, p.x, p.y, CASE WHEN xm IS NULL THEN sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) ELSE l1 + l2 END AS length FROM line JOIN place p ON p.object_id = conduit_id"),
}

def _covered(feature: DataFrame) -> DataFrame:
    return regions.covered(projection.region(feature)).select("areas", F.round("hectares", 4).alias("hectares"))


def _on_features(f: Callable, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query of the external layers alone, without the network."""
    return f(projection.features(spark, sf_dir))


#: Slabs between the sides of all squares, and in each the union of the stretches of those that reach across it.
_COVERED = f""", sq AS ({projection.REGION_SQL}), xs AS (SELECT x - h AS v FROM sq UNION SELECT x + h FROM sq UNION SELECT x - g FROM sq WHERE g IS NOT NULL UNION SELECT x + g FROM sq WHERE g IS NOT NULL),
slab AS (SELECT v AS x0, lead(v) OVER (ORDER BY v) AS x9 FROM xs),
run AS (SELECT x0, x9, y - h AS lo, CASE WHEN g IS NOT NULL AND x - g <= x0 AND x + g >= x9 THEN y - g ELSE y + h END AS hi FROM sq JOIN slab ON x - h <= x0 AND x + h >= x9
  UNION ALL SELECT x0, x9, y + g, y + h FROM sq JOIN slab ON x - g <= x0 AND x + g >= x9),
part AS (SELECT x0, x9, lo, hi, max(hi) OVER (PARTITION BY x0 ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM run)"""

_NETWORK |= {
    "src_5": (
        _covered,
        f"{COMMON}{_COVERED} SELECT (SELECT count(DISTINCT role) FROM sq) AS areas, round(sum(greatest(0, hi - greatest(lo, coalesce(upto, lo))) * (x9 - x0)) / 10000, 4) AS hectares FROM part",
    ),
    "join_8": (
        lambda t: regions.points_in(t.node.select(F.col("node_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay")), projection.region(t.feature)).select(F.col("a").alias("node_id"), "area_id"),
        f"{COMMON}, sq AS ({projection.REGION_SQL}) SELECT DISTINCT node_id, role AS area_id FROM node n JOIN sq ON abs(n.x - sq.x) <= h AND abs(n.y - sq.y) <= h AND NOT coalesce(abs(n.x - sq.x) < g AND abs(n.y - sq.y) < g, false)",
    ),
}

_REPORTS: dict[str, tuple[Callable, str]] = {
    "agg_1": (
        reports.messages,
        f"""{COMMON} SELECT cfk, CASE WHEN grouping(source) = 0 AND grouping(object_type) = 0 THEN 'both' WHEN grouping(source) = 0 THEN 'source' ELSE 'object_type' END AS "grouping", source, object_type,
        count(*) AS n, count(*) FILTER (severity = 'Violation') AS errors, count(*) FILTER (severity = 'Warning') AS warnings FROM report GROUP BY GROUPING SETS ((cfk, source), (cfk, object_type), (cfk, source, object_type))""",
    ),
    "agg_2": (reports.totals, f"{COMMON} SELECT cfk, count(*) AS n, count(*) FILTER (severity = 'Violation') AS errors, count(*) FILTER (severity = 'Warning') AS warnings FROM report GROUP BY 1"),
    "cov_1": (_evidence, f"{COMMON} {HITS}"),
    "cov_2": (_verdicts, f"{COMMON} SELECT mapping, CASE WHEN NOT bool_or(required) THEN 'unverifiable' WHEN coalesce(max(hit), 0) = 1 THEN 'touched' ELSE 'untouched' END AS verdict FROM {PATTERNS} LEFT JOIN (SELECT mapping, max(required::INT) AS hit FROM ({HITS}) GROUP BY 1) USING (mapping) GROUP BY 1"),
    "cmp_1": (
        lambda r: reports.delta(*_early_late(r), "cfk", "source"),
        f"{COMMON} SELECT cfk, source, count(*) FILTER (early) AS earlier, count(*) FILTER (NOT early) AS later, count(*) FILTER (NOT early) - count(*) FILTER (early) AS difference FROM report GROUP BY ALL",
    ),
    "cmp_2": (
        lambda r: reports.object_changes(*_early_late(r)),
        f"{COMMON} SELECT source, focus_node, CASE WHEN bool_and(early) THEN 'resolved' WHEN bool_or(early) THEN 'remaining' ELSE 'new' END AS status FROM report GROUP BY 1, 2",
    ),
    "cmp_3": (
        lambda r: reports.object_changes(*_early_late(r)).groupBy("source", "status").agg(F.count("*").alias("n")),
        f"{COMMON} SELECT source, status, count(*) AS n FROM (SELECT source, focus_node, CASE WHEN bool_and(early) THEN 'resolved' WHEN bool_or(early) THEN 'remaining' ELSE 'new' END AS status FROM report GROUP BY 1, 2) GROUP BY 1, 2",
    ),
}

def _all(t) -> DataFrame:
    """Findings of every rule that can run, written once and shared by the queries on findings. Each rule is a plan of its own, as one of all of them would be too large; some run at once, and what several of them read is written once."""
    many = replace(t, sharing=True)
    return t.once("findings", lambda: graph.gathered([partial(findings.run, r, many) for r in findings.runnable(t)]))


def _placed(t) -> DataFrame:
    return enrich.placed(_all(t), t)


def _judged(t) -> DataFrame:
    """Findings with the priority of their object and whether their rule is systemic."""
    found = _all(t)
    critical = t.node.where(t.is_a(*t.cfg.critical)).select(F.col("node_id").alias("object_id"), F.lit(True).alias("critical"))
    systemic = enrich.outcomes(found, t).select("rule_id", "systemic")
    return found.join(critical, "object_id", "left").join(F.broadcast(systemic), "rule_id", "left").withColumn(
        "priority", F.when((F.col("severity") == "F") & F.coalesce("critical", F.lit(False)), 1).when(F.col("severity") == "F", 2).otherwise(3)
    )


def _found_sql(before: str = "") -> str:
    none = "SELECT NULL::VARCHAR AS object_id, NULL::VARCHAR AS object2_id, NULL::VARCHAR AS detail, NULL::DOUBLE AS value, NULL::DOUBLE AS threshold, NULL::DOUBLE AS x, NULL::DOUBLE AS y, NULL::VARCHAR AS rule_id, NULL::VARCHAR AS severity WHERE false"
    inner = lambda more: f"WITH RECURSIVE {more.lstrip(', ')} " if more else ""
    parts = " UNION ALL BY NAME ".join(
        f"SELECT *, '{r}' AS rule_id, '{findings.RULES[r][0]}' AS severity FROM ({inner(more)}SELECT object_id, * EXCLUDE (object_id) FROM ({body}))" for r, (more, body) in oracles.BODIES.items()
    )
    return f"""{COMMON}{before}, found AS (SELECT *, substr(sha256(concat_ws('|', rule_id, object_id, coalesce(object2_id, ''), coalesce(detail, ''))), 1, 16) AS finding_id FROM ({none} UNION ALL BY NAME {parts})),
outcome AS (SELECT rule_id, severity, status, coalesce(examined, 0) AS examined, coalesce(n, 0) AS found, 0::BIGINT AS omitted, round(100 * coalesce(n, 0) / nullif(examined, 0), 2) AS percentage, coalesce(coalesce(n, 0) / nullif(examined, 0) > 0.8, false) AS systemic
  FROM (VALUES {_rule_values()}) r(rule_id, severity, status, population) LEFT JOIN (SELECT rule_id, count(*) AS n FROM found GROUP BY 1) USING (rule_id)
  LEFT JOIN (SELECT 'node' AS population, count(*) AS examined FROM node UNION ALL SELECT 'gravity', count(*) FROM grav UNION ALL SELECT 'conduit', count(*) FROM conduit) USING (population)),
judged AS (SELECT f.*, systemic, CASE WHEN f.severity = 'F' AND cls IN ('Overstortput', 'Bergbezinkbassin', 'Gemaal') THEN 1 WHEN f.severity = 'F' THEN 2 ELSE 3 END AS priority
  FROM found f LEFT JOIN node ON node_id = object_id LEFT JOIN outcome USING (rule_id)){PLACES},
placed AS (SELECT f.* EXCLUDE (x, y), coalesce(round(f.x, 4), place.x) AS x, coalesce(round(f.y, 4), place.y) AS y FROM found f LEFT JOIN place USING (object_id))
"""


def _rule_values() -> str:
    ran = lambda r: f"'ran', '{enrich._population(r)}'" if r in oracles.BODIES else "'not run', NULL"
    rows = [f"('{r}', '{s}', {ran(r)})" for r, (s, _, _) in findings.RULES.items()]
    return ", ".join(rows + [f"('{r}', 'W', 'skeleton', NULL)" for r in enrich.SKELETONS])


_FINDINGS: dict[str, tuple[Callable, str]] = {
    "snk_1": (lambda t: _all(t).withColumn("category", enrich.category(F.col("rule_id"))), "SELECT *, split_part(rule_id, '-', 1) AS category FROM (SELECT finding_id, rule_id, severity, object_id, object2_id, detail, round(value, 8) AS value, round(threshold, 8) AS threshold, round(x, 4) AS x, round(y, 4) AS y FROM found)"),
    "snk_2": (
        lambda t: enrich.per_object(_judged(t)),
        "SELECT object_id, min(severity) AS worst, count(*) FILTER (severity = 'F') AS errors, count(*) FILTER (severity = 'W') AS warnings, count(*) FILTER (systemic) AS systemic, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules, count(DISTINCT rule_id) AS n_rules, min(priority) AS priority FROM judged GROUP BY 1",
    ),
    "snk_5": (lambda t: enrich.outcomes(_all(t), t), "SELECT * FROM outcome"),
    "fnd_7": (lambda t: _judged(t).groupBy("rule_id", "priority", "systemic").agg(F.count("*").alias("n")), "SELECT rule_id, priority, systemic, count(*) AS n FROM judged GROUP BY ALL"),
    "fnd_8": (lambda t: _placed(t).select("finding_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y")), "SELECT finding_id, round(x, 4) AS x, round(y, 4) AS y FROM placed"),
    "fnd_11": (lambda t: enrich.stacked_objects(_all(t), t.cfg.stacked), "SELECT object_id, count(DISTINCT rule_id) AS n_rules FROM found GROUP BY 1 HAVING count(DISTINCT rule_id) >= 3"),
    "topk_3": (
        lambda t: enrich.shown(_all(t), 25).select("rule_id", "finding_id"),
        "SELECT rule_id, finding_id FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY finding_id) AS r FROM found) WHERE r <= 25",
    ),
    "win_1": (
        lambda t: enrich.stacks(_placed(t)).select("finding_id", "stack_size", "stack_number"),
        """SELECT finding_id, count(*) OVER (PARTITION BY round(x * 1000), round(y * 1000)) AS stack_size, row_number() OVER (PARTITION BY round(x * 1000), round(y * 1000) ORDER BY finding_id) AS stack_number FROM placed WHERE x IS NOT NULL
        UNION ALL SELECT finding_id, 1, 1 FROM placed WHERE x IS NULL""",
    ),
}

#: The label pattern of the query ADM-003; a network's own pattern is a setting.
LABEL_PATTERN = "(put|s)-[0-9]*[0-8]$"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.run("ADM-003", projection.tables(spark, sf_dir, config.Config(label_pattern=LABEL_PATTERN)))


ADM_003 = f"SELECT object_id, label AS detail FROM (SELECT node_id AS object_id, label FROM node UNION ALL SELECT conduit_id, label FROM conduit) WHERE NOT regexp_matches(label, '^(?:{LABEL_PATTERN})')"


def _name(rule_id: str) -> str:
    return rule_id.lower().replace("-", "_")


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {_name(r): partial(_rule, r) for r in oracles.BODIES} | {"adm_003": _labels}
    found |= {name: partial(_on, f) for name, (f, _) in _NETWORK.items()}
    found["src_5"] = partial(_on_features, _covered)
    found |= {name: partial(_on, f) for name, (f, _) in _FINDINGS.items()}
    found |= {name: partial(_report, f) for name, (f, _) in _REPORTS.items()}
    return found | {"hier_1": _closure} | export.queries() | more.queries(_evidence, _patterns, _all)


def oracle_sql() -> dict[str, str]:
    found = {_name(r): oracles.finding_sql(r, findings.RULES[r][0]) for r in oracles.BODIES}
    found["adm_003"] = oracles.wrapped("ADM-003", findings.RULES["ADM-003"][0], "", ADM_003)
    found |= {name: sql for name, (_, sql) in (_NETWORK | _REPORTS).items() if sql}
    some = _found_sql()
    found |= {name: some + sql for name, (_, sql) in _FINDINGS.items()}
    return found | {"hier_1": CLOSURE} | export.oracle_sql() | more.oracle_sql(HITS, PATTERNS, _found_sql)
