"""Line dedup by levelled sorted runs of line hashes. DataFrame functions only.

Texts are split and hashed once, into a table of (row, place in the text, line hash) that
both the runs and the cleaning read. Documents come in batches, from the largest ids to the
smallest; there are as many as the input needs at BATCH_BYTES each. A run is a bucketed and
sorted table of (line hash, documents, keeper), the keeper being the largest id that holds
the line. Each batch merge-anti-joins the runs: lines that no run has are its own to keep,
lines that a run has keep the run's keeper. Then it adds its own run, in which the keepers
are already final. When a level has FANOUT runs they are compacted into one of the next.
Runs share buckets and order, so these joins are merges without a shuffle. The runs leave
the catalog when the repeated lines have been read from them.

A line's key is the line without white space at both ends and with A-Z lower-cased; two
64-bit hashes stand for it. Keys of at least MIN_CHARS code points in at least MIN_DOCS
documents lose their lines in all documents but the keeper.

Defined results: a null or empty text is one empty line, which is never dropped; a null id
counts as one document smaller than all others; rows that share an id are one document,
but each row is cleaned by itself; other columns are kept by ``drop_lines`` as they are;
an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MIN_CHARS = 20
MIN_DOCS = 3
#: Bytes of text in a batch of the one-off run over a table, the least number of batches, and runs on a level before they are compacted.
BATCH_BYTES = 1 << 40
BATCHES = 3
FANOUT = 2
#: Lines in a bucket of a run, about.
BUCKET_LINES = 8_000_000

_LEAST = -(2**63)
_HASH = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _doc(column: Column) -> Column:
    return F.coalesce(column.cast("long"), F.lit(_LEAST))


class LineRuns:
    """The levelled runs of one dedup job, kept as bucketed tables in the shared folder."""

    def __init__(self, spark, buckets: int, fanout: int = FANOUT):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[str]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def merged(self) -> DataFrame | None:
        """All runs as one relation with a row per line hash: the newest counts added to the oldest keeper."""
        return _merge(self.runs())

    def add(self, batch: DataFrame) -> None:
        """Take in (h1, h2, doc), each pair once, of documents below all that came before."""
        own = batch.groupBy(*_HASH).agg(F.count("*").alias("docs"), F.max("doc").alias("keeper"))
        seen = self.merged()
        if seen is not None:
            old = seen.select(*_HASH, F.col("keeper").alias("older"))
            fresh = own.join(old, _HASH, "left_anti")
            known = own.join(old, _HASH).select(*_HASH, "docs", F.col("older").alias("keeper"))
            own = fresh.unionByName(known)
        self._put(own, 0)

    def drop(self) -> None:
        """The runs leave the catalog; their files stay in the shared folder for its own cleaning."""
        for name in [name for level in self.levels for name in level]:
            self.spark.sql(f"DROP TABLE {name}")
        self.levels = [[]]

    def _put(self, run: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        run.write.bucketBy(self.buckets, *_HASH).sortBy(*_HASH).option("path", common.scratch(self.spark, "line-run")).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            merging, self.levels[level] = self.levels[level], []
            self._put(_merge([self.spark.table(x) for x in merging]), level + 1)
            for old in merging:
                self.spark.sql(f"DROP TABLE {old}")


def _merge(runs: list[DataFrame]) -> DataFrame | None:
    """Merge joins of sorted runs. A hash has the same keeper in each run that holds it."""
    if not runs:
        return None
    out = runs[0]
    for run in runs[1:]:
        other = run.select(*_HASH, F.col("docs").alias("more"), F.col("keeper").alias("other"))
        out = out.join(other, _HASH, "full").select(
            *_HASH,
            (F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("docs"),
            F.coalesce("keeper", "other").alias("keeper"),
        )
    return out


def line_table(docs: DataFrame, batches: int | None = None) -> DataFrame:
    """(batch, doc, text_hash, at, h1, h2) of each line that is long enough; batch 0 has the largest ids."""
    doc = _doc(F.col("doc_id"))
    ends = [k / 1000 for k in range(1001)]
    seen = docs.agg(F.percentile_approx(doc, ends, 10_000).alias("ends"), F.sum(F.octet_length("text")).alias("size")).first()
    n = batches or max(BATCHES, 1 + (seen["size"] or 0) // BATCH_BYTES)
    cuts = sorted({seen["ends"][1000 - (k + 1) * 1000 // n] for k in range(n - 1)}) if seen["ends"] else []
    batch = sum((F.when(F.col("doc") < c, 1).otherwise(0) for c in cuts), F.lit(0))
    long_lines = (
        docs.select(doc.alias("doc"), F.xxhash64("text").alias("text_hash"), F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
        .where(F.octet_length("line") >= MIN_CHARS)
        .withColumn("line", F.btrim("line", F.lit(common.SPACE_CHARS)))
        .where(F.char_length("line") >= MIN_CHARS)
        .withColumn("key", common.ascii_lower(F.col("line")))
    )
    return long_lines.select(batch.alias("batch"), "doc", "text_hash", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


def repeated_lines(lines: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(h1, h2, keeper) of the lines that are in at least MIN_DOCS documents, from a written line table."""
    spark = lines.sparkSession
    sizes = {r["batch"]: r["count"] for r in lines.groupBy("batch").count().collect()}
    store = LineRuns(spark, common.tasks_for(spark, sum(sizes.values()), BUCKET_LINES), fanout)
    for batch in sorted(sizes):
        store.add(lines.where(F.col("batch") == batch).select(*_HASH, "doc").distinct())
    merged = store.merged()
    if merged is None:
        return lines.select(*_HASH, F.col("doc").alias("keeper")).limit(0)
    found = common.written(merged.where(F.col("docs") >= MIN_DOCS).select(*_HASH, "keeper"), "repeated-lines")
    store.drop()
    return found


def _without(text: Column, dropped: Column) -> Column:
    """The text without the lines at the places ``dropped``; linear in the lines."""
    kept = lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), dropped), lambda k: F.get(ls, k)), "\n")
    return F.get(F.transform(F.array(lines_of(text)), kept), F.lit(0))


def cleaned(docs: DataFrame, batches: int | None = None, fanout: int = FANOUT) -> DataFrame:
    """(row, kept, n_lines, n_dropped) of each row of ``docs`` (doc_id, text and others), packed in ``row``."""
    lines = common.written(line_table(docs, batches), "lines", "batch")
    dropped = (
        lines.join(repeated_lines(lines, fanout), _HASH)
        .where("doc <> keeper")
        .groupBy("doc", "text_hash")
        .agg(F.collect_set("at").alias("dropped"))
    )
    rows = docs.select(F.struct("*").alias("row"), _doc(F.col("doc_id")).alias("doc"), F.xxhash64("text").alias("text_hash")).join(dropped, ["doc", "text_hash"], "left")
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return rows.select(
        "row",
        F.when(F.col("dropped").isNull(), F.col("row.text")).otherwise(_without(text, F.col("dropped"))).alias("kept"),
        (1 + F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long").alias("n_lines"),
        F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long").alias("n_dropped"),
    )


def drop_lines(docs: DataFrame, batches: int | None = None, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with repeated lines cut out of ``text``."""
    return cleaned(docs, batches, fanout).select(*[F.col("kept").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's query over the whole documents table."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return cleaned(docs).select(
        "row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    )


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), r AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT k.doc_id, count(*)::BIGINT AS n_lines,
       count(*) FILTER (WHERE r.key IS NOT NULL AND r.keeper <> k.doc_id)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE r.key IS NULL OR r.keeper = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN r ON k.key = r.key
GROUP BY k.doc_id
"""
