"""What several operators of this folder share: tables, scratch space, words."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and the five ASCII controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(root)
    target = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{name}.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, files in os.walk(root):
            for file in files:
                if file.endswith(".py"):
                    path = os.path.join(folder, file)
                    out.write(path, os.path.join(name, os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; one of our own only where that is unset on a single machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: A key is hot if it has more than this part of the rows, and at least so many.
HOT_SHARE, HOT_ROWS = 1000, 100


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key): the keys of more than a HOT_SHARE-th of the rows; there can't be more than HOT_SHARE of them."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") > max(total // HOT_SHARE, HOT_ROWS)).select(key)


def spread_join(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join with a table that has each key once. Rows of hot keys stay where they are and meet their few table rows by a broadcast."""
    hot = cut(hot_keys(rows, key).repartition(1))
    if hot.isEmpty():
        return rows.join(table, key)
    hot = F.broadcast(hot)
    warm = rows.join(F.broadcast(table.join(hot, key, "left_semi")), key)
    return warm.unionByName(rows.join(hot, key, "left_anti").join(table, key))


def cut(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """The frame with its lineage cut by a checkpoint in the shared folder; with ``tasks`` in so many files at most."""
    shared_folder(df.sparkSession)
    return (df if tasks is None else df.coalesce(tasks)).checkpoint()


def tasks_for(spark: SparkSession, rows: int, each: int) -> int:
    """Tasks, and so files, for so many rows: a small table does not need as many as the session's shuffles have."""
    return max(2 * spark.sparkContext.defaultParallelism, 1 + rows // each)


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """The frame written as Parquet to the shared folder and read again."""
    path = scratch(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(column: Column) -> Column:
    """A-Z lower-cased and nothing else. Texts of ASCII alone take the fast function."""
    return F.when(F.octet_length(column) == F.char_length(column), F.lower(column)).otherwise(
        F.translate(column, UPPER, UPPER.lower())
    )


def id_bucket(column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; an id of null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % modulus


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def partitions(spark: SparkSession, least: int = 1) -> int:
    """As many partitions as the session's shuffles have, or more where the input needs more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), least)


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8 with A-Z lower-cased; bytes split at exactly the contracts' white space."""
    return text.encode().lower().split() if text else []


def slices(batches, size: int = 1 << 20):
    """The rows of Arrow batches, some ``size`` bytes of text at a time, so that a task's memory does not follow the batch size."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        ends = np.cumsum(lengths)
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
            yield batch.slice(at, to - at)
            at = to
