"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the K smallest distinct 64-bit hashes of a text's five-word shingles.
Sketches of parts merge into the sketch of the whole; two sketches estimate resemblance,
containment and the number of distinct shingles. Texts with at most K shingles are exact.

Defined results: words are split at ASCII white space and A-Z are lower-cased; texts of
one to four words have one shingle, the whole sequence; null, empty and blank texts have
the empty sketch, which resembles only itself. Neighbours are taken by descending id, then
by the hash of the text; null ids come last; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Hashes in a sketch, and words in a shingle.
K = 128
WORDS = 5
#: Ranges of ids are at most so many, of about so many bytes of text.
RANGES = 1 << 16
RANGE_BYTES = 4 << 20

_LEAST = -(2**63)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _finish(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class WordHashes(dict):
    """Hashes of the words met by a task; emptied when it has grown to a million."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 7)
        return h


def sketch(text: str | None, hashes: dict[bytes, int], k: int = K, width: int = WORDS) -> np.ndarray:
    """The k smallest distinct shingle hashes, sorted."""
    words = common.words_of(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter([hashes[x] for x in words], dtype=np.uint64, count=len(words))
    take = min(width, len(w))
    n = len(w) - take + 1
    h = np.full(n, take, dtype=np.uint64)
    for j in range(take):
        h = (h ^ w[j : j + n]) * _ODD[j % 5]
        h ^= h >> np.uint64(29)
    return np.unique(_finish(h))[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two parts together."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness of the shingle sets; two empty sets are alike."""
    both = merge(a, b, k)
    if not len(both):
        return 1.0
    common_part = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(both, common_part, assume_unique=True).sum() / len(both))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    both = distinct(merge(a, b, k), k) * resemblance(a, b, k)
    return min(1.0, both / distinct(a, k))


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), dtype=">u8").astype(np.uint64)


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m] if m else text


def _neighbours(batches):
    """Rows come by range and descending id; a range ends with copies of the next range's first row."""
    hashes = WordHashes()
    held = None
    for batch in common.slices(batches):
        out = {c: [] for c in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles", "contained")}
        for doc_id, text, part, copy in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "part", "copy")), strict=True):
            text = text or ""
            own = sketch(text, hashes)
            if held is not None and held[2] == part:
                _emit(out, *held[:2], held[3], text, own, hashes)
            held = None if copy else (doc_id, text, part, own)
        yield pa.record_batch({c: pa.array(v, _TYPES[c]) for c, v in out.items()})


_TYPES = {
    "doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(),
    "near_edited": pa.float64(), "near_next": pa.float64(), "n_shingles": pa.float64(), "contained": pa.float64(),
}
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, contained double"


def _emit(out, doc_id, text, own, following, next_sketch, hashes) -> None:
    changed = edited(text, following)
    other = sketch(changed, hashes)
    row = (doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), to_text(own), to_text(other), resemblance(own, other), resemblance(own, next_sketch), distinct(own), containment(own, other))
    for values, value in zip(out.values(), row, strict=True):
        values.append(value)


def compare_neighbours(docs: DataFrame, ranges: int = RANGES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprints of each text and of its edited text, and the likeness to it and to the next document.

    The ids are cut into ranges. Texts are shuffled once, by range; each range also gets a
    copy of the first row of the next one, so that every neighbour stands in one task. The
    only thing collected is a row per range (65,536 at most).
    """
    spark = docs.sparkSession
    common.ship_package(spark)
    key = F.coalesce(F.col("doc_id"), F.lit(_LEAST))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", "text", key.alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))
    n = min(ranges, max(1 + common.text_bytes(docs) // range_bytes, common.partitions(spark)))
    cuts = keyed.agg(F.percentile_approx("key", [k / n for k in range(1, n + 1)], 10 * n).alias("cuts")).first()["cuts"]
    splits = [-math.inf, *sorted({float(c) for c in cuts or [0]}), math.inf]
    parted = (
        Bucketizer(splits=splits, inputCol="as_double", outputCol="bucket")
        .transform(keyed.withColumn("as_double", F.col("key").cast("double")))
        .select("doc_id", "text", "key", "tie", F.col("bucket").cast("int").alias("part"))
    )
    heads = sorted((r["part"], r["head"]["key"], r["head"]["tie"]) for r in parted.groupBy("part").agg(F.max(F.struct("key", "tie")).alias("head")).collect())
    after = [(*head, heads[(k + 1) % len(heads)][0]) for k, head in enumerate(heads)]  # the part of larger ids that ends with this head
    firsts = F.broadcast(spark.createDataFrame(after, "part int, key long, tie long, goes_to int"))
    targets = F.array_compact(F.array(F.struct("part", F.lit(False).alias("copy")), F.when(F.col("goes_to").isNotNull(), F.struct(F.col("goes_to").alias("part"), F.lit(True).alias("copy")))))
    dealt = (
        parted.join(firsts, ["part", "key", "tie"], "left")
        .select("doc_id", "text", "key", "tie", F.explode(targets).alias("to"))
        .select("doc_id", "text", "key", "tie", "to.part", "to.copy")
    )
    return (
        dealt.repartition(common.partitions(spark, n), "part")
        .sortWithinPartitions("part", "copy", F.col("key").desc(), F.col("tie").desc())
        .select("doc_id", "text", "part", "copy")
        .mapInArrow(_neighbours, _SCHEMA)
    )


def op4_fingerprint(spark, sf_dir: str) -> DataFrame:
    """The contract's query over the whole documents table."""
    return compare_neighbours(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
