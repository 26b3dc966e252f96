"""Connected components of a graph given as pairs, in DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edges in a task, about.
EDGES = 500_000


def connected(pairs: DataFrame) -> DataFrame:
    """(v, label) of every vertex of ``pairs`` (a, b); the label is the smallest vertex it reaches.

    Each round every vertex takes the smallest label around it and then that label's own
    label, so distances halve. Rounds are cut by checkpoints; only counts come back. A hub of
    many edges or a label of many vertices is a hot key and is joined by a broadcast.
    """
    edges = common.cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    # Links are few beside the texts, so rounds write few files.
    tasks = common.tasks_for(pairs.sparkSession, edges.count(), EDGES)
    labels = common.cut(edges.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("label")), tasks)
    while True:
        around = common.spread_join(edges, labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        hooked = common.cut(labels.join(around, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label")), tasks)
        up = hooked.select(F.col("v").alias("label"), F.col("label").alias("above"))
        nxt = common.cut(common.spread_join(hooked, up, "label").select("v", "old", F.least("label", "above").alias("label")), tasks)
        if nxt.where("label <> old").isEmpty():
            return nxt.select("v", "label")
        labels = nxt.select("v", "label")
