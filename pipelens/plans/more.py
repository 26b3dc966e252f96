"""Queries on components, reliability, clusters and measurements, and their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from pipelens import config, findings
from pipelens.operators import analytics, attributes, build, enrich, external, graph, heights, network, reports, summaries, topology  # noqa: F401  (rules register themselves)
from pipelens.plans import projection
from pipelens.plans.oracles import COMMON, GRAPH

_NAMES = """, base AS (SELECT component, concat('ds-', CASE WHEN coalesce(label, '') <> '' THEN label ELSE component END) AS b FROM (SELECT DISTINCT component FROM comp) LEFT JOIN node ON node_id = component),
names AS (SELECT component, CASE WHEN r = 1 THEN b ELSE concat(b, '-', r) END AS name FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY component) AS r FROM base))"""
_OWN = """, own AS (SELECT node_id AS object_id, component FROM comp UNION ALL SELECT conduit_id, min_by(component, side <> 'start') FROM ends JOIN comp USING (node_id) GROUP BY 1)"""
_REACH = ", got(id) AS (SELECT node_id FROM node WHERE cls = 'Gemaal' UNION SELECT e.a FROM edge e JOIN got ON e.b = got.id)"
_BOBS = "(SELECT bob_start AS v FROM conduit WHERE bob_start IS NOT NULL UNION ALL SELECT bob_end FROM conduit WHERE bob_end IS NOT NULL)"
_DELTA = "SELECT cfk, source, count(*) FILTER (early) AS earlier, count(*) FILTER (NOT early) AS later, count(*) FILTER (NOT early) - count(*) FILTER (early) AS difference FROM report GROUP BY ALL"
_COUNTS = "SELECT cfk, source, count(*) AS n, count(*) FILTER (severity = 'Violation') AS errors, count(*) FILTER (severity = 'Warning') AS warnings FROM report GROUP BY ALL"
_LABELS = "SELECT node_id AS id, label FROM node UNION ALL SELECT conduit_id, label FROM conduit"
_TYPED = "(SELECT node_id AS object_id, cls FROM node UNION ALL SELECT conduit_id, cls FROM conduit)"


def _dimensions() -> str:
    return ", ".join(f"('{r}', '{d}')" for r, (_, d, _) in findings.RULES.items())


def _direction(t):
    return build.direction_labels(t)


def _bobs(t):
    return t.ends.select(F.col("bob").alias("v"))


def _generic(t):
    """Classes that stand in for those a report calls too generic."""
    return t.node.sparkSession.createDataFrame([("BlindePut",), ("Duiker",)], "cls string")


def _counts(r):
    return reports.messages(r).where("grouping = 'source'").select("cfk", "source", "n", "errors", "warnings")


def _halves(r):
    return r.where("early"), r.where("not early")


def _delta(r):
    return reports.delta(*_halves(r), "cfk", "source")


def _parts(r):
    """What each class's report has validated, by source and by object type."""
    source = r.select(F.col("cfk").alias("report"), F.lit("source").alias("kind"), F.col("source").alias("part"))
    return source.unionByName(r.where("severity = 'Violation' and object_type is not null and focus_node < 'O2'").select(F.col("cfk").alias("report"), F.lit("object_type"), F.concat_ws("-", "cfk", "object_type")).toDF("report", "kind", "part")).distinct()


def _moments(r):
    at = lambda df: df.groupBy("cfk").agg(F.lit("events").alias("dataset"), F.max("seen").alias("ts"))
    return analytics.comparable(*(at(x) for x in _halves(r)))


def _chain(t):
    """Ways up from every order's node, a hundred at a time, to the node of the hundred."""
    k = F.substring("node_id", 2, 12).cast("long")
    nodes = t.node.select("node_id", k.alias("k"))
    parents = nodes.where("k % 100 <> 0").select(F.col("node_id").alias("child_id"), F.concat(F.lit("N"), F.col("k") - F.when(F.col("k") % 10 == 0, 10).otherwise(F.col("k") % 10)).alias("parent_id"))
    wanted = nodes.where("k % 100 = 0").select(F.col("node_id").alias("id"))
    return build.parent_chain(nodes.select(F.col("node_id").alias("object_id")), parents, wanted)


_CHAIN = """, chain AS (SELECT node_id, CAST(substr(node_id, 2) AS BIGINT) AS k FROM node), up(object_id, link) AS (SELECT node_id, k FROM chain UNION ALL SELECT object_id, link - CASE WHEN link % 10 = 0 THEN 10 ELSE link % 10 END FROM up WHERE link % 100 <> 0),
whole AS (SELECT object_id FROM up WHERE link % 100 = 0 AND link IN (SELECT k FROM chain)
  AND object_id NOT IN (SELECT object_id FROM up WHERE link % 100 <> 0 AND link NOT IN (SELECT k FROM chain)))"""

_ON_NETWORK = {
    "win_3": (analytics.component_names, f"{COMMON}{GRAPH}{_NAMES} SELECT component, name FROM names"),
    "graph_4_profile": (
        analytics.component_profile,
        f"""{COMMON}{GRAPH}{_NAMES} SELECT component, name, nodes, coalesce(systems, '') AS systems, has_endpoint, has_weir, has_storage FROM
        (SELECT component, count(*) AS nodes, bool_or(cls IN ('Gemaal', 'Lozingspunt', 'Uitlaat', 'Lozingsput')) AS has_endpoint, bool_or(cls = 'Bergbezinkbassin') AS has_storage, bool_or(node_id IN (SELECT node_id FROM weir)) AS has_weir FROM comp JOIN node USING (node_id) GROUP BY 1)
        LEFT JOIN (SELECT component, string_agg(DISTINCT kind, ',' ORDER BY kind) AS systems FROM kind JOIN comp ON start_id = node_id WHERE kind IS NOT NULL GROUP BY 1) USING (component) JOIN names USING (component)""",
    ),
    "agg_18": (
        lambda t: analytics.unreachable(t, ("Gemaal",)),
        f"""{COMMON}{GRAPH}{_REACH} SELECT count(*) FILTER (component IN (SELECT component FROM comp JOIN node USING (node_id) WHERE cls = 'Gemaal')) AS with_endpoint,
        count(*) FILTER (component NOT IN (SELECT component FROM comp JOIN node USING (node_id) WHERE cls = 'Gemaal')) AS without_endpoint FROM comp WHERE node_id NOT IN (SELECT id FROM got)""",
    ),
    "agg_10": (
        lambda t: analytics.common_decimals(_bobs(t)),
        f"{COMMON} SELECT lpad(CAST(CAST(round(abs(v) * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') AS decimals, count(*) AS n FROM {_BOBS} GROUP BY 1 ORDER BY n DESC, decimals LIMIT 3",
    ),
    "mod_13": (analytics.roots_of_network, f"{COMMON} SELECT node_id FROM node WHERE cls NOT IN ('none')"),
    "mod_16": (
        lambda t: build.subset(t, t.node.where("node_id like '%7'").select(F.col("node_id").alias("object_id"))).node.select("node_id"),
        f"{COMMON} SELECT node_id FROM node WHERE node_id LIKE '%7'",
    ),
    "mod_18": (
        _direction,
        f"""{COMMON} SELECT conduit_id, CASE WHEN bob_start - bob_end IS NULL OR bob_start = bob_end OR start_id = end_id THEN 'unknown' WHEN (bob_start > bob_end) <> turned THEN 'with' ELSE 'against' END AS direction FROM (
        SELECT c.*, sqrt((c.x1 - e.x) * (c.x1 - e.x) + (c.y1 - e.y) * (c.y1 - e.y)) + sqrt((c.x2 - s.x) * (c.x2 - s.x) + (c.y2 - s.y) * (c.y2 - s.y))
          < sqrt((c.x1 - s.x) * (c.x1 - s.x) + (c.y1 - s.y) * (c.y1 - s.y)) + sqrt((c.x2 - e.x) * (c.x2 - e.x) + (c.y2 - e.y) * (c.y2 - e.y)) AS turned
        FROM conduit c JOIN node s ON s.node_id = start_id JOIN node e ON e.node_id = end_id)""",
    ),
    "hier_3": (_chain, f"{COMMON}{_CHAIN} SELECT DISTINCT object_id, concat('N', link) AS link_id FROM up WHERE object_id IN (SELECT object_id FROM whole)"),
    "snk_3": (
        lambda t: analytics.out_of_scope(t).select("object_id", "system"),
        f"{COMMON} SELECT conduit_id AS object_id, cls AS system FROM conduit WHERE cls = 'Persleiding'",
    ),
    "sort_4": (analytics.components_in_order, f"{COMMON}{GRAPH} SELECT component, count(*) AS nodes FROM comp GROUP BY 1"),
    "fnd_3": (lambda t: analytics.unreliable(t, _generic(t)), f"{COMMON} SELECT object_id FROM {_TYPED} WHERE cls IN ('BlindePut', 'Duiker')"),
    "set_6": (
        lambda t: analytics.present(t.part.select(F.col("child_id").alias("object_id")).distinct(), t),
        f"{COMMON} SELECT DISTINCT child_id AS object_id FROM part_of WHERE child_id IN (SELECT node_id FROM node)",
    ),
    "f_09": (
        lambda t: t.node.select("node_id", analytics.fragment(F.concat(F.lit("http://d/x#"), "label", F.when(F.col("multipart"), F.lit("#more")).otherwise(F.lit("")))).alias("fragment")),
        f"{COMMON} SELECT node_id, concat(label, CASE WHEN multipart THEN '#more' ELSE '' END) AS fragment FROM node",
    ),
}

#: On findings: ``found`` and its neighbours come from the catalog's SQL.
ON_FINDINGS = {
    "fnd_2": (
        lambda found, t: analytics.with_reliability(found, analytics.unreliable(t, _generic(t))).groupBy("rule_id", "typing_reliable").agg(F.count("*").alias("n")),
        f"SELECT rule_id, object_id NOT IN (SELECT object_id FROM {_TYPED} WHERE cls IN ('BlindePut', 'Duiker')) AS typing_reliable, count(*) AS n FROM found GROUP BY ALL",
        "",
    ),
    "fnd_4": (
        lambda found, t: analytics.restricted(found, t.node.where("node_id like '%3'").select(F.col("node_id").alias("object_id")))[1],
        "SELECT rule_id, count(*) AS omitted FROM found WHERE object_id NOT IN (SELECT node_id FROM node WHERE node_id LIKE '%3') GROUP BY 1",
        "",
    ),
    "fnd_12": (
        analytics.shared_components,
        "SELECT component FROM found JOIN own USING (object_id) WHERE rule_id IN ('NET-001', 'NET-002') INTERSECT SELECT component FROM found JOIN own USING (object_id) WHERE rule_id = 'RVZ-006'",
        GRAPH + _OWN,
    ),
    "fnd_13": (
        analytics.clusters,
        """SELECT rule_id, count(*) AS clusters, string_agg(CASE WHEN r <= 5 THEN name END, ',' ORDER BY r) AS names, greatest(count(*) - 5, 0) AS unnamed FROM (
        SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY component) AS r FROM (SELECT DISTINCT rule_id, component FROM found JOIN own USING (object_id)) JOIN names USING (component)) GROUP BY 1""",
        GRAPH + _NAMES + _OWN,
    ),
    "agg_15": (
        lambda found, t: analytics.flagged_classes(found, t, "HGT-004"),
        f"SELECT cls AS type_name, count(*) AS n FROM (SELECT DISTINCT object_id FROM found WHERE rule_id = 'HGT-004') JOIN {_TYPED} USING (object_id) GROUP BY 1 ORDER BY n DESC, type_name LIMIT 5",
        "",
    ),
    "fnd_5": (
        lambda found, t: enrich.full(found, t, "orders", core=t.node.where("node_id like '%3'").select(F.col("node_id").alias("object_id")), unreliable=analytics.unreliable(t, _generic(t))).select(
            "finding_id", "category", "dimension", "object_label", "object2_label", "cluster_id", "scope", "typing_reliable", "priority", "systemic", F.col("attributes")["detail"].alias("detail"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "run_date", "dataset"
        ),
        f"""SELECT CASE WHEN nth > 1 THEN concat(finding_id, '-', nth) ELSE finding_id END AS finding_id, split_part(rule_id, '-', 1) AS category, dimension, l.label AS object_label, m.label AS object2_label, name AS cluster_id,
        CASE WHEN object_id IN (SELECT node_id FROM node WHERE node_id LIKE '%3') THEN 'core' ELSE 'shell' END AS scope, object_id NOT IN (SELECT object_id FROM {_TYPED} WHERE cls IN ('BlindePut', 'Duiker')) AS typing_reliable, priority, systemic, detail,
        round(coalesce(round(f.x, 4), place.x), 6) AS x, round(coalesce(round(f.y, 4), place.y), 6) AS y, DATE '2026-01-01' AS run_date, 'orders' AS dataset
        FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY object_id NULLS FIRST, object2_id NULLS FIRST, detail NULLS FIRST, value NULLS FIRST) AS nth FROM judged) f
        LEFT JOIN ({_LABELS}) l ON l.id = object_id LEFT JOIN ({_LABELS}) m ON m.id = object2_id LEFT JOIN own USING (object_id) LEFT JOIN names USING (component) LEFT JOIN place USING (object_id) JOIN (VALUES {_dimensions()}) d(rule_id, dimension) USING (rule_id)""",
        GRAPH + _NAMES + _OWN,
    ),
    "fnd_14": (
        lambda found, t: analytics.without_location(enrich.placed(found, t.__class__(node=t.node.where("not multipart"), conduit=t.conduit, class_edge=t.class_edge))),
        "SELECT count(*) AS n, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules FROM found WHERE x IS NULL AND (object_id IN (SELECT node_id FROM node WHERE multipart) OR object_id NOT IN (SELECT node_id FROM node) AND object_id NOT IN (SELECT conduit_id FROM conduit))",
        "",
    ),
    "snk_6": (
        lambda found, t: analytics.run_metadata(found, t, "orders", t.node.where("node_id like '%3'").select(F.col("node_id").alias("object_id"))),
        """SELECT 'orders' AS dataset, DATE '2026-01-01' AS run_date, (SELECT count(*) FROM node) AS nodes, (SELECT count(*) FROM conduit) AS conduits, count(*) AS findings, count(*) FILTER (severity = 'F') AS errors,
        count(*) FILTER (severity = 'W') AS warnings, count(DISTINCT rule_id) AS rules, (SELECT count(*) FROM node WHERE node_id LIKE '%3') AS core FROM found""",
        "",
    ),
}

#: The queries that read the findings of a few rules only; the other rules need not run for them.
OF_RULES = {"fnd_12": ["NET-001", "NET-002", "RVZ-006"], "agg_15": ["HGT-004"]}

_ON_REPORTS = {
    "sort_1": (lambda r: analytics.by_count(_counts(r), "cfk", "source"), f"{COMMON} {_COUNTS}"),
    "topk_1": (
        lambda r: analytics.first_rows(_counts(r), F.col("n").desc(), "cfk", "source", n=4),
        f"{COMMON} SELECT *, (SELECT count(*) FROM ({_COUNTS})) AS total FROM ({_COUNTS}) ORDER BY n DESC, cfk, source LIMIT 4",
    ),
    "sort_2": (lambda r: analytics.by_improvement(_delta(r), "cfk", "source"), f"{COMMON} {_DELTA}"),
    "topk_2": (
        lambda r: analytics.largest_changes(_delta(r), "cfk", "source", n=5),
        f"{COMMON} SELECT * FROM ({_DELTA}) WHERE difference <> 0 ORDER BY abs(difference) DESC, cfk, source LIMIT 5",
    ),
    "sort_3": (
        lambda r: analytics.by_status(reports.object_changes(*_halves(r))),
        f"{COMMON} SELECT source, focus_node, CASE WHEN bool_and(early) THEN 'resolved' WHEN bool_or(early) THEN 'remaining' ELSE 'new' END AS status FROM report GROUP BY 1, 2",
    ),
    "set_5": (lambda r: analytics.shared_classes(*_halves(r)), f"{COMMON} SELECT cfk FROM report WHERE early INTERSECT SELECT cfk FROM report WHERE NOT early"),
    "cov_5": (
        lambda r: analytics.unequal_measurement(_parts(r)),
        f"""{COMMON} SELECT kind, count(DISTINCT parts) AS variants FROM (SELECT cfk, 'source' AS kind, string_agg(DISTINCT source, ',' ORDER BY source) AS parts FROM report GROUP BY 1
        UNION ALL SELECT c, 'object_type', coalesce(parts, '') FROM (SELECT DISTINCT cfk AS c FROM report) LEFT JOIN (SELECT cfk, string_agg(DISTINCT concat(cfk, '-', object_type), ',' ORDER BY concat(cfk, '-', object_type)) AS parts FROM report
          WHERE severity = 'Violation' AND object_type IS NOT NULL AND focus_node < 'O2' GROUP BY 1) ON cfk = c) GROUP BY 1 HAVING count(DISTINCT parts) > 1""",
    ),
    "cmp_5": (
        _moments,
        f"""{COMMON} SELECT true AS same_dataset, (SELECT count(*) > 0 FROM (SELECT cfk FROM report WHERE early INTERSECT SELECT cfk FROM report WHERE NOT early)) AS shares_class,
        (SELECT max(seen) FROM report WHERE early) > (SELECT min(m) FROM (SELECT max(seen) AS m FROM report WHERE NOT early GROUP BY cfk)) AS out_of_order""",
    ),
}


def queries(evidence, patterns, all_findings) -> dict:
    """The queries by name; what they share with the catalog is handed in."""

    def on(f, spark, sf_dir):
        return f(projection.tables(spark, sf_dir))

    def on_findings(f, rules, spark, sf_dir):
        t = projection.tables(spark, sf_dir)
        return f(all_findings(t) if rules is None else findings.run_all(t, rules), t)

    def on_report(f, spark, sf_dir):
        return f(projection.report(spark, sf_dir))

    verdicts = lambda r: reports.verdicts(evidence(r), patterns(r.sparkSession))
    scores = lambda r: r.groupBy("cfk").agg((100 * F.count_if(F.col("severity") == "Warning") / F.count("*")).alias("score"))
    found = {name: partial(on, f) for name, (f, _) in _ON_NETWORK.items()}
    found |= {name: partial(on_findings, f, OF_RULES.get(name)) for name, (f, _, _) in ON_FINDINGS.items()}
    found |= {name: partial(on_report, f) for name, (f, _) in _ON_REPORTS.items()}
    found["cov_6"] = partial(on_report, lambda r: analytics.lapsed(verdicts(r), scores(r), config.Config().typing_minimum))
    found["cmp_4"] = partial(on_report, lambda r: analytics.verdict_changes(verdicts(r.where("early")), verdicts(r.where("not early and cfk <> 'cfk1'"))))
    return found


def oracle_sql(hits: str, patterns: str, findings_sql) -> dict[str, str]:
    verdict = lambda where: f"SELECT mapping, CASE WHEN NOT bool_or(required) THEN 'unverifiable' WHEN coalesce(max(hit), 0) = 1 THEN 'touched' ELSE 'untouched' END AS verdict FROM {patterns} LEFT JOIN (SELECT mapping, max(required::INT) AS hit FROM ({hits.replace('FROM report r', f'FROM (SELECT * FROM report WHERE {where}) r')}) GROUP BY 1) USING (mapping) GROUP BY 1"
    found = {name: sql for name, (_, sql) in (_ON_NETWORK | _ON_REPORTS).items()}
    found |= {name: findings_sql(more) + sql for name, (_, sql, more) in ON_FINDINGS.items()}
    low = "(SELECT min(100 * w / n) < 95 FROM (SELECT cfk, count(*) FILTER (severity = 'Warning') AS w, count(*) AS n FROM report GROUP BY 1))"
    found["cov_6"] = f"{COMMON} SELECT mapping, verdict, {low} AND verdict = 'touched' AS reservation FROM ({verdict('true')}) WHERE verdict <> 'touched' OR {low}"
    found["cmp_4"] = f"""{COMMON} SELECT l.mapping, e.verdict AS earlier, l.verdict AS later, e.verdict IS DISTINCT FROM l.verdict AS changed FROM ({verdict("NOT early AND cfk <> 'cfk1'")}) l LEFT JOIN ({verdict('early')}) e ON e.mapping = l.mapping"""
    return found
