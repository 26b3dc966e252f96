"""Mixing sources to target weights by entropy balancing.

Targets: sources by code point (null last) weigh 5, 2, 1, repeating, and share BUDGET times
all words; a target stops at CAP times its source's words, and the excess is reshared by
weight until none is above.

Rates: of all document rates between 0 and CAP whose words meet each source's target, the
ones closest in entropy to equal rates have the form CAP / (1 + exp(-lambda * x)), x being
the document's words over its source's mean (an exponential tilt of the odds). The dual is
convex; Newton iterations, safeguarded by bisection, run as Spark jobs over the histogram
(source, size), for all sources at once. Rates are rounded to copies by systematic rounding
in order of size, so a source's error is about one document. Positions within a source
come from three small steps: over sizes, over salted parts of a size, over a part's rows.

Defined results: a null or blank text has size 0 and takes 0 words; a null source is one
source; sources of equal name are one; repeated rows are separate documents, and rows
of equal id and text may get different copies; a source of no words has target 0; other columns are kept by
``mix``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
CAP = 2.0
TOLERANCE = 1e-9
#: Parts of the rows of one (source, size) that are numbered apart.
SALTS = 64


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size, target) from a row per source with its words and documents.

    The table has a row per source, so its windows are over as many rows as there are sources.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    ranked = sources.withColumn("weight", F.element_at(weights, (place % len(WEIGHTS) + 1).cast("int"))).withColumn("cap", CAP * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    budget = BUDGET * F.sum("source_size").over(whole)
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    left = budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # The share per weight if exactly the sources before this one stop at their caps; the first source that fits sets the share.
    trial = ranked.withColumn("share", left / weight_left)
    fits = F.min(F.when(F.col("cap") >= F.col("share") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("share")))).over(whole)
    return trial.select("source", "source_size", "n_docs", F.least("cap", F.coalesce(fits["share"] * F.col("weight"), F.col("cap"))).alias("target"))


def _rate(size, mean, tilt):
    return CAP / (1 + F.exp(-tilt * size / mean))


def tilts(cells: DataFrame, goals: DataFrame) -> DataFrame:
    """(key, mean, tilt) of each source whose target lies strictly between 0 and its cap."""
    goals = goals.where((F.col("target") > 0) & (F.col("target") < CAP * F.col("source_size") * (1 - 1e-12)))
    goals = goals.select("key", "target", (F.col("source_size") / F.col("n_docs")).alias("mean"))
    state = common.cut(goals.select("*", F.lit(0.0).alias("tilt"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(False).alias("done")))
    while True:
        rate = _rate(F.col("size"), F.col("mean"), F.col("tilt"))
        sums = (
            cells.join(state.where("not done"), "key")
            .groupBy("key")
            .agg(
                F.sum(F.col("n") * F.col("size") * rate).alias("words"),
                F.sum(F.col("n") * F.col("size") * rate * (1 - rate / CAP) * F.col("size") / F.col("mean")).alias("slope"),
            )
        )
        gap = F.col("words") - F.col("target")
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - gap / F.col("slope")
        # Outside the bracket, bisect; with one side open, go at most four times as far.
        reach = F.greatest(4 * F.abs("tilt"), F.lit(1.0))
        stepped = F.greatest(F.least(newton, F.coalesce(high, F.col("tilt") + reach)), F.coalesce(low, F.col("tilt") - reach))
        inside = F.when((newton > F.coalesce(low, newton - 1)) & (newton < F.coalesce(high, newton + 1)), stepped).otherwise(
            F.coalesce((low + high) / 2, stepped)
        )
        step = F.coalesce(inside, F.col("tilt"))
        # Done where the words fit, or where no number lies between the bracket's ends any more.
        narrow = F.coalesce(high - low <= 1e-14 * F.greatest(F.abs("tilt"), F.lit(1.0)), F.lit(False))
        met = F.coalesce((F.abs(gap) <= TOLERANCE * F.col("target")) | (step == F.col("tilt")), F.lit(True)) | narrow
        state = common.cut(
            state.join(sums, "key", "left").select(
                "key", "target", "mean",
                F.when(met, F.col("tilt")).otherwise(step).alias("tilt"),
                F.when(F.col("words").isNull(), F.col("low")).otherwise(low).alias("low"),
                F.when(F.col("words").isNull(), F.col("high")).otherwise(high).alias("high"),
                met.alias("done"),
            )
        )
        if state.where("not done").isEmpty():
            break
    # Sums come in any order; rounding keeps their last digits out of the rates, so that reruns agree.
    return state.select("key", "mean", F.round("tilt", 9).alias("tilt"))


def _rank_cells(cells: DataFrame) -> DataFrame:
    """Adds ``start``: the sum of rates of the source's documents of smaller size."""
    before = Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("start", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(before), F.lit(0.0)))


def copies(docs: DataFrame) -> DataFrame:
    """(row, size, source_size, target, copies) of each row of ``docs`` (doc_id, text, source and others), packed in ``row``.

    Texts are shuffled once, by source, size and salt; the cells they meet there are sums.
    """
    source = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    keyed = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("source").cast("string").alias("source"), source.alias("key"),
        word_count(F.col("text")).alias("size"), F.xxhash64("doc_id").alias("row_hash"), F.xxhash64("text").alias("text_hash"),
    )
    cells = common.cut(keyed.groupBy("key", "source", "size").agg(F.count("*").alias("n")))
    totals = cells.groupBy("key", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs"))
    goals = common.cut(targets(totals).withColumn("key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))))
    tilt = tilts(cells, goals)
    rate = F.when(F.col("tilt").isNotNull(), _rate(F.col("size"), F.col("mean"), F.col("tilt"))).when(F.col("target") > 0, F.lit(CAP)).otherwise(0.0)
    rated = _rank_cells(cells.join(goals.select("key", "source_size", "target"), "key").join(tilt, "key", "left").withColumn("rate", rate)).select(
        "key", "size", "source_size", "target", "rate", "start"
    )
    salted = keyed.withColumn("salt", F.pmod("row_hash", F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("key", "size", "salt").agg(F.count("*").alias("m"))
    ahead = Window.partitionBy("key", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("skip", F.coalesce(F.sum("m").over(ahead), F.lit(0))).join(rated, ["key", "size"]).drop("m")
    within = Window.partitionBy("key", "size", "salt").orderBy("row_hash", "id", "text_hash")
    placed = salted.withColumn("place", F.row_number().over(within)).join(parts, ["key", "size", "salt"])
    upto = F.col("start") + F.col("rate") * (F.col("skip") + F.col("place"))
    n = F.floor(upto + 0.5 + 1e-9) - F.floor(upto - F.col("rate") + 0.5 + 1e-9)
    return placed.select("row", "size", "source_size", "target", F.least(F.greatest(n, F.lit(0)), F.lit(int(CAP))).cast("int").alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them."""
    return copies(docs).select("row", F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), "copies"))).alias("nth")).select("row.*")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """The contract's query over the whole documents table."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return copies(docs).select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
