"""Compression of vectors by part codebooks, with a dictionary of values for each dimension.

Components become integers once. A block of vectors is written with, for each dimension,
its distinct integers and the index of each vector's integer among them. A round tabulates
the squared differences of the distinct integers to all codebook entries; the distance of
a part is then gathered from its dimensions' tables by index and added up. Tasks return a
sum and a count for each entry, which Spark adds; only entries come back to the driver
(ENTRIES for each of PARTS), and go out again with the next round.

Defined results: vectors that are null, empty or hold null or non-finite components are
dropped, as are those whose length is not that of the vector of the smallest id or which
cannot be cut into equal parts; null ids are larger than others, and rows of equal id go
by their integers; null labels are one label; equal rows are all kept; other columns are
ignored; a table without vectors gives no rows. Integers must be under 2^24 in size, so
that no distance leaves 63 bits; larger ones are an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors in a block.
BLOCK = 4096
LARGEST = 1 << 24

_BLOCK = "ids array<long>, labels array<string>, dims int, sizes array<int>, values binary, indexes binary"
_RESULT = "vec_id long, code string, error long, label string"


def _rows(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """(vec_id, label, v): integers of the vectors that are kept; the label as text, with a sign before it, so that null differs from every text."""
    x = F.col("embedding").cast("array<double>")
    fine = (F.size(x) > 0) & (F.size(x) % parts == 0)
    fine = fine & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    label = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.transform(x, lambda c: F.floor(c * SCALE)).alias("v"))


def first_entries(rows: DataFrame, entries: int = ENTRIES, parts: int = PARTS) -> np.ndarray | None:
    """(parts, entries, dims of a part): the parts of the vectors of the smallest ids. None if there is no vector."""
    order = [F.col("vec_id").isNull(), "vec_id", "v"]
    first = rows.orderBy(*order).select(F.size("v").alias("n")).first()
    if first is None:
        return None
    found = rows.where(F.size("v") == first["n"]).orderBy(*order).limit(entries).select("v").collect()
    v = np.array([r["v"] for r in found], dtype=np.int64)
    return v.reshape(len(v), parts, -1).transpose(1, 0, 2)


def _blocks(size: int, dims: int):
    """Blocks of a task's rows."""

    def packed(ids: list, labels: list, v: np.ndarray) -> pa.RecordBatch:
        if np.abs(v).max(initial=0) >= LARGEST:
            raise ValueError(f"a component times {SCALE} is {LARGEST} or more")
        found = [np.unique(v[:, d], return_inverse=True) for d in range(dims)]
        values = np.concatenate([x for x, _ in found])
        indexes = np.stack([y.reshape(-1) for _, y in found])
        pack = lambda x, kind: pa.array([zstandard.compress(x.astype(kind).tobytes(), 3)], pa.binary())
        return pa.record_batch(
            {
                "ids": pa.array([ids], pa.list_(pa.int64())),
                "labels": pa.array([labels], pa.list_(pa.string())),
                "dims": pa.array([dims], pa.int32()),
                "sizes": pa.array([[len(x) for x, _ in found]], pa.list_(pa.int32())),
                "values": pack(values, "<i4"),
                "indexes": pack(indexes, "<u2"),
            }
        )

    def run(batches):
        ids, labels, vs = [], [], []
        for batch in batches:
            ids += batch["vec_id"].to_pylist()
            labels += batch["label"].to_pylist()
            vs.append(batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
            while len(ids) >= size:
                v = np.concatenate(vs)
                yield packed(ids[:size], labels[:size], v[:size])
                ids, labels, vs = ids[size:], labels[size:], [v[size:]]
        if ids:
            yield packed(ids, labels, np.concatenate(vs))

    return run


def encode(rows: DataFrame, dims: int, block: int = BLOCK) -> DataFrame:
    """The rows in blocks of dictionary indexes, written to the shared folder."""
    common.ship_package(rows.sparkSession)
    return common.written(rows.where(F.size("v") == dims).mapInArrow(_blocks(min(block, 1 << 16), dims), _BLOCK), "vector-blocks")


def part_distances(values: list[np.ndarray], indexes: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of vectors' parts to all entries: one table for each dimension, gathered by index and added up."""
    largest = max((int(np.abs(x).max(initial=0)) for x in values), default=0) + int(np.abs(entries).max(initial=0))
    kind = np.int32 if largest * largest * max(1, len(values)) < 2**31 else np.int64
    total = np.zeros((indexes.shape[1], len(entries)), dtype=kind)
    for d, distinct in enumerate(values):
        table = ((distinct[:, None] - entries[None, :, d]) ** 2).astype(kind)
        total += table[indexes[d]]
    return total


def _assigned(batch: pa.RecordBatch, codebooks: np.ndarray):
    """Of each block: ids, labels, vectors, the entry of each part, and its distance."""
    width = codebooks.shape[2]
    for ids, labels, dims, sizes, values, indexes in zip(*(batch[c].to_pylist() for c in ("ids", "labels", "dims", "sizes", "values", "indexes")), strict=True):
        flat = np.frombuffer(zstandard.decompress(values), dtype="<i4").astype(np.int64)
        values = np.split(flat, np.cumsum(sizes)[:-1])
        indexes = np.frombuffer(zstandard.decompress(indexes), dtype="<u2").reshape(dims, -1)
        codes, errors = [], []
        for part, entries in enumerate(codebooks):
            mine = slice(part * width, (part + 1) * width)
            far = part_distances(values[mine], indexes[mine], entries)
            codes.append(far.argmin(axis=1))
            errors.append(far[np.arange(len(far)), codes[-1]].astype(np.int64))
        yield ids, labels, values, indexes, np.stack(codes), np.stack(errors)


def _sums(codebooks: np.ndarray):
    """(part, entry, n, sums) of all the vectors of a task."""

    def run(batches):
        parts, entries, width = codebooks.shape
        n, sums = np.zeros((parts, entries), dtype=np.int64), np.zeros(codebooks.shape, dtype=np.int64)
        for batch in batches:
            for _, _, values, indexes, codes, _ in _assigned(batch, codebooks):
                for part in range(parts):
                    n[part] += np.bincount(codes[part], minlength=entries)
                    for d in range(width):
                        at = part * width + d
                        cell = codes[part] * np.int64(len(values[at])) + indexes[at]
                        times = np.bincount(cell, minlength=entries * len(values[at])).reshape(entries, -1)
                        sums[part, :, d] += times @ values[at]
        part, entry = np.nonzero(n)
        yield pa.record_batch({"part": part.astype(np.int32), "entry": entry.astype(np.int32), "n": n[part, entry], "sums": pa.array(list(sums[part, entry]), pa.list_(pa.int64()))})

    return run


def train(blocks: DataFrame, codebooks: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after ``rounds`` of assigning every part to its nearest entry and taking the floors of the means."""
    for _ in range(rounds):
        sums = blocks.mapInArrow(_sums(codebooks), "part int, entry int, n long, sums array<long>")
        each = sums.select("part", "entry", "n", F.posexplode("sums").alias("d", "s")).groupBy("part", "entry", "d")
        means = each.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # an integer for each place of each entry
        codebooks = codebooks.copy()
        for r in means:
            codebooks[r["part"], r["entry"], r["d"]] = int(r["s"]) // r["n"]
    return codebooks


def _codes(codebooks: np.ndarray):
    def run(batches):
        for batch in batches:
            for ids, labels, _, _, codes, errors in _assigned(batch, codebooks):
                code = ["".join([f"{x:02x}" for x in row]) for row in codes.T.tolist()]
                yield pa.record_batch({"vec_id": pa.array(ids, pa.int64()), "code": code, "error": errors.sum(axis=0), "label": labels})

    return run


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all integers of the entries by part, entry and place."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, code, error, label) of each kept vector, and the codebooks."""
    rows = _rows(vectors, parts)
    codebooks = first_entries(rows, entries, parts)
    if codebooks is None:
        return vectors.sparkSession.createDataFrame([], _RESULT), None
    blocks = encode(rows, codebooks.shape[0] * codebooks.shape[2])
    codebooks = train(blocks, codebooks, rounds)
    return common.cut(blocks.mapInArrow(_codes(codebooks), _RESULT)), codebooks


def decode(codes: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """(vec_id, v): the integers that each code stands for."""
    parts, width = codebooks.shape[0], codebooks.shape[2]

    def run(batches):
        for batch in batches:
            at = np.array([[int(c[2 * p : 2 * p + 2], 16) for p in range(parts)] for c in batch["code"].to_pylist()], dtype=np.int64).reshape(-1, parts)
            v = np.concatenate([codebooks[p][at[:, p]] for p in range(parts)], axis=1).reshape(-1, parts * width)
            yield pa.record_batch({"vec_id": batch["vec_id"], "v": pa.array(list(v), pa.list_(pa.int64()))})

    return codes.select("vec_id", "code").mapInArrow(run, "vec_id long, v array<long>")


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """The contract's query over the whole embeddings table."""
    found, codebooks = compress(common.table(spark, sf_dir, "embeddings"))
    sha = digest(codebooks) if codebooks is not None else ""
    sums = found.groupBy("label").agg(F.sum("error").alias("label_error"))
    return common.spread_join(found, sums, "label").select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
