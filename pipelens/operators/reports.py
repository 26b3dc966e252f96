"""Analytics on validation reports: aggregates, coverage, and comparisons of two moments.

A report row is (cfk, focus_node, source, value, severity, object_type); see ``sources.reports``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VIOLATION, WARNING = "Violation", "Warning"


def _counts():
    return [F.count("*").alias("n"), F.count_if(F.col("severity") == VIOLATION).alias("errors"), F.count_if(F.col("severity") == WARNING).alias("warnings")]


def messages(rows: DataFrame) -> DataFrame:
    """Messages by source, by object type and by both, in one pass of grouping sets; null keys count."""
    keyed = rows.select("cfk", "severity", "source", "object_type")
    found = keyed.groupingSets(
        [["cfk", "source"], ["cfk", "object_type"], ["cfk", "source", "object_type"]], "cfk", "source", "object_type"
    ).agg(F.grouping_id().alias("g"), *_counts())
    kind = F.when(F.col("g") == 1, "source").when(F.col("g") == 2, "object_type").otherwise("both")
    return found.select("cfk", kind.alias("grouping"), "source", "object_type", "n", "errors", "warnings")


def totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cfk").agg(*_counts())


def evidence(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """Per mapping and class: rows, distinct objects and shapes that match a pattern (mapping, shape, prefix, required)."""
    by_name = rows.join(F.broadcast(patterns.where("not prefix")), F.col("source") == F.col("shape"))
    begins = rows.join(F.broadcast(patterns.where("prefix")), F.col("source").startswith(F.col("shape")))
    hits = by_name.unionByName(begins)
    return hits.groupBy("mapping", "cfk", "required").agg(F.count("*").alias("n"), F.countDistinct("focus_node").alias("objects"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("shapes"))


def verdicts(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """Touched, untouched or unverifiable for each mapping."""
    wanted = patterns.groupBy("mapping").agg(F.max("required").alias("any_required"))
    seen = found.groupBy("mapping").agg(F.max("required").alias("hit"))
    verdict = F.when(~F.col("any_required"), "unverifiable").when(F.coalesce("hit", F.lit(False)), "touched").otherwise("untouched")
    return wanted.join(seen, "mapping", "left").select("mapping", verdict.alias("verdict"))


def delta(earlier: DataFrame, later: DataFrame, *keys: str) -> DataFrame:
    """Counts of two moments by key and their difference."""
    before = earlier.groupBy(*keys).agg(F.count("*").alias("earlier"))
    after = later.groupBy(*keys).agg(F.count("*").alias("later"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return before.join(after, list(keys), "full").select(*keys, zero("earlier"), zero("later"), (F.coalesce("later", F.lit(0)) - F.coalesce("earlier", F.lit(0))).alias("difference"))


def object_changes(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """Each (source, focus node) is resolved, new or remaining."""
    keys = ["source", "focus_node"]
    before, after = earlier.select(*keys).distinct().withColumn("was", F.lit(True)), later.select(*keys).distinct().withColumn("now", F.lit(True))
    status = F.when(F.col("now").isNull(), "resolved").when(F.col("was").isNull(), "new").otherwise("remaining")
    return before.join(after, keys, "full").select(*keys, status.alias("status"))


def typing_score(rows: DataFrame, total: DataFrame) -> DataFrame:
    """Share of objects of a class that are not too generic; null without objects."""
    generic = rows.where("source = 'CfkTypes_typ'").select("cfk", F.col("focus_node").alias("cls")).distinct()
    n = total.join(generic, ["cfk", "cls"], "left_semi").groupBy("cfk").agg(F.sum("n").alias("generic"))
    return total.groupBy("cfk").agg(F.sum("n").alias("n")).join(n, "cfk", "left").select("cfk", (100 * (F.col("n") - F.coalesce("generic", F.lit(0))) / F.nullif(F.col("n"), F.lit(0))).alias("score"))


def drift(mapped: DataFrame, dropped: DataFrame) -> DataFrame:
    """(mapping, side): ids that only the mapping or only the catalog's dropped list has."""
    only = lambda a, b, side: a.select("mapping").distinct().join(b.select("mapping"), "mapping", "left_anti").withColumn("side", F.lit(side))
    return only(mapped, dropped, "mapping only").unionByName(only(dropped, mapped, "catalog only"))


def discrepancies(found: DataFrame, required: DataFrame) -> DataFrame:
    """Mappings that some required classes (mapping, cfk) hit and others do not."""
    hit = required.join(found.select("mapping", "cfk").distinct().withColumn("hit", F.lit(True)), ["mapping", "cfk"], "left")
    return hit.groupBy("mapping").agg(F.count("*").alias("classes"), F.count_if("hit").alias("hits")).where("classes >= 2 and hits > 0 and hits < classes")
