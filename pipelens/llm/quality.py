"""Quality rules: a hashed n-gram log-likelihood ratio with a fixed threshold.

Two multinomials over BUCKETS hashed features are counted in one pass: the raw corpus over
all documents, and the trusted target over documents that ``labels`` marks as good (a
bounded set of SAMPLE labels, see there). Features of a text are its words, its word pairs
and pairs of word shapes (letters, digits and symbols reduced to classes, with a mark where
a word stands twice), so that layout, symbol and repetition junk is seen whatever its words. A text's score is the mean over its features of
log((target + PRIOR) / (expected from raw + PRIOR)). Every document is thresholded alike:
score below THRESHOLD is rejected. The base rules reject very short and very repetitive
texts before that.

Defined results: a null or blank text has no words and fails the base rules; repeated rows
are counted and judged once per row; a null id has no label; null labels are ignored; with
no good label the score is 0 and the base rules alone decide; other columns are kept by
``keep``; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 16
#: Labels that the trusted target is fitted on, at most; the same ones at every run.
SAMPLE = 20_000
PRIOR = 5.0
THRESHOLD = -0.35
#: Words of a window whose repetition counts.
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT = 30

_SYMBOLS = re.compile(r"[#*$%&|<>]")


def shape(word: str) -> str:
    """Letters, digits and repeated symbols reduced to classes."""
    if word.isalpha():
        return "a" if word.islower() else "A" if word.isupper() and len(word) > 1 else "Aa" if word[1:].islower() else "m"
    upper = word.isupper() and len(word) > 1
    out = re.sub(r"\d+", "0", re.sub(r"[^\W\d_]+", "W" if upper else "a", word))
    return re.sub(r"([^\w\s])\1+", r"\1\1", out)


class _Vocabulary(dict):
    """Numbers of the words of a batch, with what is known of each word."""

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self)
        return k


def _batch_words(texts: list[str | None]):
    """Number of each word, words per text, and the distinct words of a batch."""
    vocabulary = _Vocabulary()
    ids, lengths = [], []
    for text in texts:
        words = text.encode().split() if text else []
        lengths.append(len(words))
        ids.extend([vocabulary[w] for w in words])
    return np.array(ids, dtype=np.int64), np.array(lengths, dtype=np.int64), list(vocabulary)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(31))


def features(ids: np.ndarray, lengths: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the texts of a batch, and the text each belongs to."""
    of = np.repeat(np.arange(len(lengths)), lengths)
    if not len(ids):
        return np.zeros(0, dtype=np.int64), of
    word = np.fromiter((zlib.crc32(w.lower()) for w in words), dtype=np.uint64, count=len(words))[ids]
    form = np.fromiter((zlib.crc32(shape(w.decode("utf-8", "replace")).encode()) for w in words), dtype=np.uint64, count=len(words))[ids]
    pair = of[1:] == of[:-1]
    again = (ids[1:] == ids[:-1]).astype(np.uint64) << np.uint64(42)
    found = [_mix(word), _mix(_mix(word[:-1] + np.uint64(1 << 40)) + word[1:])[pair], _mix(_mix(form[:-1] + np.uint64(1 << 41)) + form[1:] + again)[pair]]
    hashed = np.concatenate(found) >> np.uint64(48)
    return (hashed % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([of, of[1:][pair], of[1:][pair]])


def _count(batches):
    raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
    for batch in common.slices(batches):
        ids, lengths, words = _batch_words(batch["text"].to_pylist())
        hashed, of = features(ids, lengths, words)
        raw += np.bincount(hashed, minlength=BUCKETS)
        good = np.array(batch["good"].to_pylist(), dtype=bool)
        if good.any():
            target += np.bincount(hashed[good[of]], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.record_batch({"bucket": pa.array(at, pa.int64()), "raw": pa.array(raw[at], pa.int64()), "target": pa.array(target[at], pa.int64())})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The log-likelihood ratio of each bucket; BUCKETS numbers come to the driver."""
    trusted = (
        labels.where("quality = 1 and doc_id is not null")
        .select(F.col("doc_id").cast("long").alias("label_id"))
        .distinct()
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(sample)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(trusted), F.col("doc_id") == F.col("label_id"), "left").select("text", F.col("label_id").isNotNull().alias("good"))
    sums = rows.mapInArrow(_count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = sums["bucket"].to_numpy()
    raw[at], target[at] = sums["raw"].to_numpy(), sums["target"].to_numpy()
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + PRIOR) / (raw * (target.sum() / raw.sum()) + PRIOR))


def repeated_words(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per text, the words that lie in a window found at least twice in it."""
    n, texts = len(ids), len(lengths)
    if n < WINDOW:
        return np.zeros(texts, dtype=np.int64)
    of = np.repeat(np.arange(texts), lengths)
    h = np.zeros(n - WINDOW + 1, dtype=np.uint64)
    for k in range(WINDOW):
        h = _mix(h + ids[k : n - WINDOW + 1 + k].astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    start = np.flatnonzero(of[: n - WINDOW + 1] == of[WINDOW - 1 :])
    if not len(start):
        return np.zeros(texts, dtype=np.int64)
    key = _mix(h[start] ^ _mix(of[start].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(start), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    marks = np.zeros(n + 1, dtype=np.int64)
    np.add.at(marks, start[twice], 1)
    np.add.at(marks, start[twice] + WINDOW, -1)
    covered = np.cumsum(marks[:-1]) > 0
    return np.bincount(of[covered], minlength=texts)


def line_repeats(text: str | None) -> int:
    """Lines with a word that equal an earlier line."""
    if not text or "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(common.SPACE_CHARS)]
    return len(lines) - len(set(lines))


def _judged(texts: list[str | None], ratio: np.ndarray, threshold: float) -> dict[str, pa.Array]:
    """Counts, score and verdict of some texts."""
    ids, lengths, words = _batch_words(texts)
    hashed, of = features(ids, lengths, words)
    n = np.bincount(of, minlength=len(texts))
    score = np.bincount(of, weights=ratio[hashed], minlength=len(texts)) / np.maximum(n, 1)
    chars = np.fromiter((len(w.decode()) for w in words), dtype=np.int64, count=len(words))
    text_of = np.repeat(np.arange(len(texts)), lengths)
    repeat = repeated_words(ids, lengths)
    failed = (lengths < MIN_WORDS) | (100 * repeat > MAX_REPEAT * lengths)
    return {
        "n_words": pa.array(lengths, pa.int64()),
        "word_chars": pa.array(np.bincount(text_of, weights=chars[ids] if len(ids) else None, minlength=len(texts)).astype(np.int64), pa.int64()),
        "n_symbols": pa.array([len(_SYMBOLS.findall(t)) if t else 0 for t in texts], pa.int64()),
        "n_dup_lines": pa.array([line_repeats(t) for t in texts], pa.int64()),
        "n_repeat_words": pa.array(repeat, pa.int64()),
        "base_failed": pa.array(failed, pa.bool_()),
        "score": pa.array(score, pa.float64()),
        "kept": pa.array(~failed & (score >= threshold), pa.bool_()),
    }


def _judge(model, threshold: float):
    def run(batches):
        for batch in common.slices(batches):
            yield pa.record_batch({"doc_id": batch["doc_id"], **_judged(batch["text"].to_pylist(), model.value, threshold)})

    return run


def _keep(model, threshold: float):
    def run(batches):
        for batch in common.slices(batches):
            yield batch.filter(_judged(batch["text"].to_pylist(), model.value, threshold)["kept"])

    return run


_JUDGED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, score and verdict of each row of ``docs`` (doc_id, text)."""
    common.ship_package(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return asked.mapInArrow(_judge(model, threshold), f"doc_id long, {_JUDGED}")


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the rules keep. Each row goes to a task once, and only kept rows come back."""
    common.ship_package(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(_keep(model, threshold), docs.schema)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """The contract's query over the whole documents table."""
    found = judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
