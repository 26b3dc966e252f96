"""SimHash near-dedup by pigeonhole blocks.

The 64 bits are cut into PIECES pieces. Two fingerprints at no more than DISTANCE bits
agree in at least PIECES - DISTANCE pieces, so each choice of that many pieces is a block
key, and every close pair shares a block. Distinct fingerprints are dealt to their blocks,
and the distance of pairs is checked there. A block of many fingerprints reports the edges
of a spanning forest of its links instead of all pairs; a block beyond BLOCK_ROWS is cut
into chunks and every two chunks meet in a task of their own, so that no link is lost and
no task holds more than two chunks. Components then come from rounds of hooking and
pointer jumping.

Defined results: a null or blank text has fingerprint zero, linked like any other; rows
that share an id are separate members; a null id is never the smallest of a component
that has another id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected

DISTANCE = 3
PIECES = 5
SHINGLE = 3
SEED = 42
#: Fingerprints of a block that one task compares; up to SMALL all pairs are reported.
BLOCK_ROWS = 8192
SMALL = 16


def simhash(text: str | None) -> int:
    """The unsigned fingerprint of a text: bits that more than half of the shingle hashes have."""
    words = common.words_of(text)
    if not words:
        return 0
    shingles = [b" ".join(x) for x in zip(words, words[1:], words[2:], strict=False)] if len(words) >= SHINGLE else [b" ".join(words)]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(shingles), 1 << 15):
        part = shingles[at : at + (1 << 15)]
        h = np.fromiter([xxhash.xxh64_intdigest(s, SEED) for s in part], dtype=">u8", count=len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big")


def _fingerprints(batches):
    for batch in common.slices(batches):
        h = np.fromiter(map(simhash, batch["text"].to_pylist()), dtype=np.uint64, count=batch.num_rows)
        yield pa.record_batch({"doc_id": batch["doc_id"], "fp": pa.array(h.view(np.int64), pa.int64()), "text_hash": batch["text_hash"]})


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, text_hash) of each row, fp as a signed long."""
    common.ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_fingerprints, "doc_id long, fp long, text_hash long")


def block_masks(distance: int = DISTANCE, pieces: int = PIECES) -> list[int]:
    """The bits of each block key, as signed longs."""
    edges = [64 * k // pieces for k in range(pieces + 1)]
    bits = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(bits, pieces - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    a, b = [], []
    rest = np.unique(fps)
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            fp = front.pop()
            near = np.bitwise_count((rest ^ fp).view(np.uint64)) <= distance  # of signed numbers it would count the bits of the absolute value
            if near.any():
                found = rest[near]
                a.append(np.full(len(found), fp))
                b.append(found)
                front.extend(found)
                rest = rest[~near]
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def links_in_blocks(block: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of fingerprints that stand by block: all of small blocks, a spanning forest of large ones."""
    starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(starts, len(block)))
    size = np.repeat(sizes, sizes)
    a, b = [], []
    for step in range(1, min(SMALL, int(sizes.max(initial=1)))):
        same = (block[step:] == block[:-step]) & (size[step:] <= SMALL)
        near = same & (np.bitwise_count((fps[step:] ^ fps[:-step]).view(np.uint64)) <= distance)
        a.append(fps[:-step][near])
        b.append(fps[step:][near])
    for k in np.flatnonzero(sizes > SMALL):
        x, y = _forest(fps[starts[k] : starts[k] + sizes[k]], distance)
        a.append(x)
        b.append(y)
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _links(distance: int):
    def run(batches):
        blocks, fps = np.zeros((0, 4), dtype=np.int64), np.zeros(0, dtype=np.int64)

        def flush(until: int):
            number = np.cumsum(np.concatenate([[0], (blocks[1:until] != blocks[: until - 1]).any(axis=1)])) if until else np.zeros(0, dtype=np.int64)
            x, y = links_in_blocks(number, fps[:until], distance)
            return pa.record_batch({"a": pa.array(np.minimum(x, y), pa.int64()), "b": pa.array(np.maximum(x, y), pa.int64())})

        for batch in batches:
            new = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("table", "key", "i", "j")], axis=1)
            blocks, fps = np.concatenate([blocks, new]), np.concatenate([fps, batch["fp"].to_numpy()])
            if len(blocks) == 0:
                continue
            last = (blocks != blocks[-1]).any(axis=1)
            until = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if until:
                yield flush(until)
                blocks, fps = blocks[until:], fps[until:]
        if len(blocks):
            yield flush(len(blocks))

    return run


def close_pairs(fps: DataFrame, distance: int = DISTANCE, pieces: int = PIECES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b): links among the distinct fingerprints ``fps`` (fp) that connect whatever all links connect."""
    masks = block_masks(distance, pieces)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("table", "key"))
    large = keyed.groupBy("table", "key").agg(F.count("*").alias("n")).where(F.col("n") > block_rows)
    chunks = F.ceil(F.coalesce("n", F.lit(1)) / block_rows).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    dealt = (
        keyed.join(large, ["table", "key"], "left")
        .withColumn("chunks", chunks)
        .withColumn("own", own)
        .select("fp", "table", "key", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        .select("fp", "table", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )
    place = ["table", "key", "i", "j"]
    return dealt.repartition(common.partitions(fps.sparkSession), *place).sortWithinPartitions(*place).mapInArrow(_links(distance), "a long, b long").distinct()


def _labelled(docs: DataFrame, distance: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, fp, text_hash), and (fp, first, label) of each fingerprint: its smallest document, and one label for all that are linked."""
    rows = common.cut(fingerprints(docs))
    firsts = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    labels = connected(close_pairs(firsts.select("fp"), distance))
    return rows, firsts.join(labels.select(F.col("v").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def components(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) of each row of ``docs``."""
    rows, of = _labelled(docs, distance)
    smallest = of.groupBy("label").agg(F.min("first").alias("component_id"))
    of = common.cut(common.spread_join(of, smallest, "label").select("fp", "component_id"))
    return common.spread_join(rows, of, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` with one row of each component: that of the smallest id, then of the smallest hash of the text; null ids come last.

    Of rows that are equal in id and text one stays; which one's other columns is not defined.
    """
    rows, of = _labelled(docs, distance)
    counts = rows.groupBy("fp", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    labelled = common.spread_join(counts, of.select("fp", "label"), "fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "n")).alias("m")
    kept = common.cut(labelled.groupBy("label").agg(first).select(F.col("m.doc_id").alias("k_id"), F.col("m.text_hash").alias("k_hash"), F.col("m.n").alias("k_n")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("k_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("k_hash"))
    once = docs.join(kept.where("k_n = 1"), same, "left_semi")
    again = kept.where("k_n > 1")
    return once if again.isEmpty() else once.unionByName(docs.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """The contract's query over the whole documents table."""
    found = components(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
