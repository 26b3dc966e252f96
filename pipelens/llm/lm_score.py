"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

``P(word | history) = P(class | history) * P(slot | class, history) * P(word | leaf)``. A
leaf is a slot of a class. The TOP most frequent training words have a leaf of their own,
dealt to classes in turn by rank so that classes weigh about the same; the other words
share the leaves of the last classes by a hash, so that no table of them is needed; class 0
holds the end token alone. Both softmaxes have hashed n-gram and skip features of the words
before: the previous word's leaf (a word bigram), the word two back where it is one of the
most frequent, and both together. ``P(word | leaf)`` is the smoothed share of the word in
its leaf, with one slot for unknown words.

Three passes read the texts. The first counts words: documents are dealt to blocks of some
8 MB by a hash of the row, each block sends its distinct words once to the shard of the
word, where they are summed, and gets the sums back; no task holds the whole vocabulary.
The second counts cells (previous leaf, word two back, leaf) of the training rows, packed
and summed over tasks; there are at most LEAVES * SKIPS * LEAVES whatever the input. The
third scores. Between them the weights are trained by distributed gradient updates over
the cells, with a ridge to the unigram model; each update is kept only if it raises the
penalised likelihood of all training rows, else its step is halved.

Defined results: a null or empty text is one end token; a null id counts as the empty text
for the split; repeated rows are scored (and counted) once per row; other columns are
ignored; without training rows every base score is 0 and the model is uniform; an empty
table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Classes of the first softmax and slots of the second; class 0 is the end token.
CLASSES = SLOTS = 32
LEAVES = CLASSES * SLOTS
#: Classes of words that have a leaf of their own, and the number of those words.
TOP_CLASSES = 24
TOP = TOP_CLASSES * SLOTS
RARE = LEAVES - (1 + TOP_CLASSES) * SLOTS
#: Values of the word two back: the most frequent words, or 0.
SKIPS = 32
#: Rows of the hashed weight table, and features of a context in each softmax.
BUCKETS = 1 << 16
FEATURES = 4
#: Additive smoothing of words, as in the base score.
SMOOTH = 0.1
#: Gradient updates, and how much weights are drawn to the unigram model.
ROUNDS = 12
RIDGE = 2.0
MOMENTUM = 0.5
#: Bytes of text in a block, and pieces of the cell table.
BLOCK_BYTES = 8 << 20
CHUNKS = 16
#: Cells of a piece: those of neighbouring leaves before, so that few features are in more than one piece.
PIECE = LEAVES * SKIPS * LEAVES // CHUNKS
#: Tokens that are counted at a time, and streams that sum a piece at most.
COUNT_TOKENS = 1 << 21
SALTS = 512

END = b""


def rare_leaf(word: bytes) -> int:
    """Number of the shared leaf of a word that has none of its own; 0 to RARE - 1."""
    return zlib.crc32(word) % RARE


class Leaves(dict):
    """Leaves of words; ``top`` has the frequent words by rank. Emptied of other words when it has grown to half a million."""

    def __init__(self, top: list[bytes]):
        self.top = {word: (1 + k % TOP_CLASSES) * SLOTS + k // TOP_CLASSES for k, word in enumerate(top)} | {END: 0}
        self.update(self.top)

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
            self.update(self.top)
        self[word] = k = (1 + TOP_CLASSES) * SLOTS + rare_leaf(word)
        return k


def skip_values() -> np.ndarray:
    """The value of a leaf as the word two back: rank + 1 of the most frequent words, else 0."""
    out = np.zeros(LEAVES, dtype=np.int64)
    rank = np.arange(SKIPS - 1)
    out[(1 + rank % TOP_CLASSES) * SLOTS + rank // TOP_CLASSES] = rank + 1
    return out


def _row(kind: int, key: np.ndarray) -> np.ndarray:
    """Hashed row of a feature; the first rows are the biases'."""
    mixed = (key.astype(np.uint64) + (np.uint64(kind) << np.uint64(40))) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    first = 1 + CLASSES
    return first + ((mixed >> np.uint64(32)) % np.uint64(BUCKETS - first)).astype(np.int64)


def class_features(context: np.ndarray) -> np.ndarray:
    """Rows of the class softmax for contexts (previous leaf, word two back): bias, bigram, skip, both; shape (n, FEATURES)."""
    before, skip = context // SKIPS, context % SKIPS
    return np.stack([np.zeros_like(context), _row(1, before), _row(2, skip), _row(3, context)], axis=1)


def slot_features(context: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Rows of the slot softmax within a class: bias, bigram, skip, class bigram with skip; shape (n, FEATURES)."""
    before, skip = context // SKIPS, context % SKIPS
    wide = (before // SLOTS * SKIPS + skip) * CLASSES
    return np.stack([1 + cls, _row(4, before * CLASSES + cls), _row(5, skip * CLASSES + cls), _row(6, wide + cls)], axis=1)


def log_softmax(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Natural log probabilities for rows of features."""
    logits = weights[features[:, 0]]
    for k in range(1, features.shape[1]):
        logits = logits + weights[features[:, k]]
    logits -= logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def _slots(weights: np.ndarray, context: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Log probabilities of the slots of a class; the end token's class has one slot."""
    out = log_softmax(weights, slot_features(context, cls))
    out[cls == 0] = np.where(np.arange(SLOTS) == 0, 0.0, -np.inf)
    return out


class _Index(dict):
    """Numbers of the distinct tokens met so far."""

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self)
        return k


def _numbered(texts: list[str | None], numbers: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Each token's number in ``numbers``, and tokens per text; each text ends with the end token."""
    ids, lengths = [], np.zeros(len(texts), dtype=np.int64)
    for k, text in enumerate(texts):
        words = common.words_of(text)
        words.append(END)
        ids.append(np.array([numbers[word] for word in words], dtype=np.int32))
        lengths[k] = len(words)
    return np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32), lengths


def _indexed(texts: list[str | None]) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """Numbers for the distinct tokens of some texts, each token's number, and tokens per text."""
    index = _Index({END: 0})
    ids, lengths = _numbered(texts, index)
    return index, ids, lengths


def _contexts(leaves: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Packed context of each token: the leaf before it and the value of the word two back; before a document stand end tokens."""
    n = len(leaves)
    offset = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    before, two = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    before[1:] = leaves[:-1]
    two[2:] = skip_values()[leaves[:-2]]
    before[offset < 1] = 0
    two[offset < 2] = 0
    return before * SKIPS + two


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def _block_words(shards: int):
    schema = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("words", pa.list_(pa.binary())), ("n", pa.list_(pa.int64()))])

    def run(group: pa.Table) -> pa.Table:
        index, ids, lengths = _indexed(group["text"].to_pylist())
        train = np.repeat(np.array(group["train"].to_pylist(), dtype=bool), lengths)
        counts = np.bincount(ids[train], minlength=len(index))
        by_shard: dict[int, list[tuple[bytes, int]]] = {}
        for word, k in index.items():
            by_shard.setdefault(zlib.crc32(word) % shards, []).append((word, int(counts[k])))
        block = group["block"][0].as_py()
        return pa.table(
            {
                "block": pa.array([block] * len(by_shard), pa.int64()),
                "shard": pa.array(list(by_shard), pa.int32()),
                "words": pa.array([[w for w, _ in v] for v in by_shard.values()], pa.list_(pa.binary())),
                "n": pa.array([[n for _, n in v] for v in by_shard.values()], pa.list_(pa.int64())),
            },
            schema=schema,
        )

    return run, "block long, shard int, words array<binary>, n array<long>"


def _flat(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The values of a column of lists one after the other, and the length of each list."""
    lists = column.combine_chunks()
    return lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)


def _sum_shard(group: pa.Table) -> pa.Table:
    """Counts of a shard's words over all blocks; its first row also has the shard's totals by shared leaf and its most frequent words."""
    words, sizes = _flat(group["words"])
    coded = words.dictionary_encode()
    at = coded.indices.to_numpy()
    total = np.bincount(at, weights=_flat(group["n"])[0].to_numpy(), minlength=len(coded.dictionary)).astype(np.int64)
    names = coded.dictionary.to_pylist()
    of = np.fromiter(map(rare_leaf, names), dtype=np.int64, count=len(total))
    tokens = np.bincount(of, weights=total, minlength=RARE).astype(np.int64).tolist()
    types = np.bincount(of, weights=total > 0, minlength=RARE).astype(np.int64).tolist()
    best = sorted((k for k in np.argsort(-total, kind="stable")[: 2 * TOP] if total[k]), key=lambda k: (-total[k], names[k]))[: TOP + 1]
    if len(total) > 2 * TOP:
        # Ties at the cut go by the word.
        least = total[best[-1]] if best else 0
        best = sorted((int(k) for k in np.flatnonzero(total >= max(least, 1))), key=lambda k: (-total[k], names[k]))[: TOP + 1]
    top = [{"word": names[k], "count": int(total[k])} for k in best]
    rest = [None] * (len(sizes) - 1)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.table(
        {
            "block": group["block"],
            "words": group["words"],
            "n": pa.ListArray.from_arrays(pa.array(offsets), pa.array(total[at], pa.int64())),
            "tokens": pa.array([tokens, *rest], pa.list_(pa.int64())),
            "types": pa.array([types, *rest], pa.list_(pa.int64())),
            "top": pa.array([top, *rest], pa.list_(pa.struct([("word", pa.binary()), ("count", pa.int64())]))),
        }
    )


_COUNTED = "block long, words array<binary>, n array<long>, tokens array<long>, types array<long>, top array<struct<word: binary, count: long>>"


def _packed_cells(code: np.ndarray, n: np.ndarray, salts: int) -> pa.RecordBatch:
    """A row for each piece of the cell table: sorted codes as differences, and their counts."""
    piece = code // PIECE
    order = np.argsort(piece, kind="stable")
    code, n, ends = code[order], n[order], np.cumsum(np.bincount(piece, minlength=CHUNKS))
    parts = [k for k in range(CHUNKS) if ends[k] > (ends[k - 1] if k else 0)]
    span = [slice(ends[k - 1] if k else 0, ends[k]) for k in parts]
    pack = zstandard.ZstdCompressor(level=3).compress
    task = TaskContext.get()
    return pa.record_batch(
        {
            "part": pa.array(parts, pa.int32()),
            "salt": pa.array([(task.partitionId() if task else 0) % salts] * len(parts), pa.int32()),
            "codes": pa.array([pack(np.diff(code[x], prepend=0).astype("<u4").tobytes()) for x in span], pa.binary()),
            "counts": pa.array([pack(n[x].astype("<u8").tobytes()) for x in span], pa.binary()),
        }
    )


def _unpacked(codes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    read = zstandard.decompress
    return np.cumsum(np.frombuffer(read(codes), dtype="<u4"), dtype=np.int64), np.frombuffer(read(counts), dtype="<u8").astype(np.int64)


_CELLS = "part int, salt int, codes binary, counts binary"


def _count_cells(top, salts: int):
    """Packed counts of (context, leaf) over a task's rows, some tokens at a time."""

    def run(batches):
        leaves, held, size = Leaves(top.value), [], 0
        for batch in common.slices(batches):
            ids, lengths = _numbered(batch["text"].to_pylist(), leaves)
            held.append((_contexts(ids, lengths) * LEAVES + ids).astype(np.int32))
            size += len(ids)
            if size >= COUNT_TOKENS:
                yield _packed_cells(*np.unique(np.concatenate(held), return_counts=True), salts)
                held, size = [], 0
        if held:
            yield _packed_cells(*np.unique(np.concatenate(held), return_counts=True), salts)

    return run


def _sum_cells(batches):
    """Rows stand by part and salt: one dense piece of the table is summed at a time."""
    total, at = np.zeros(PIECE, dtype=np.int64), None

    def flush(part: int):
        where = np.flatnonzero(total)
        return _packed_cells(part * PIECE + where, total[where], 1)

    for batch in batches:
        for part, salt, codes, counts in zip(*(batch[c].to_pylist() for c in ("part", "salt", "codes", "counts")), strict=True):
            if at not in (None, (part, salt)):
                yield flush(at[0])
                total[:] = 0
            at = (part, salt)
            code, n = _unpacked(codes, counts)
            total[code - part * PIECE] += n
    if at is not None:
        yield flush(at[0])


def count_cells(texts: DataFrame, top, salts: int) -> DataFrame:
    """The cell table of ``texts`` (text) as CHUNKS packed pieces, summed in two steps of bounded memory."""
    summed = texts.mapInArrow(_count_cells(top, salts), _CELLS)
    if salts > 1:
        summed = summed.repartition(CHUNKS * salts, "part", "salt").sortWithinPartitions("part", "salt").mapInArrow(_sum_cells, _CELLS)
    whole = summed.withColumn("salt", F.lit(0)).repartition(CHUNKS, "part").sortWithinPartitions("part")
    return whole.mapInArrow(_sum_cells, _CELLS)


def _piece(codes: bytes, counts: bytes):
    """Contexts with their class counts, and (context, class) pairs with their slot counts; the end token's class has no slots to tell apart."""
    code, n = _unpacked(codes, counts)
    context, at = np.unique(code // LEAVES, return_inverse=True)
    by_class = np.zeros((len(context), CLASSES), dtype=np.float32)
    np.add.at(by_class, (at, code // SLOTS % CLASSES), n)
    code, n = code[code // SLOTS % CLASSES > 0], n[code // SLOTS % CLASSES > 0]
    pair, at = np.unique(code // SLOTS, return_inverse=True)
    by_slot = np.zeros((len(pair), SLOTS), dtype=np.float32)
    by_slot[at, code % SLOTS] = n
    return context, by_class, pair // CLASSES, pair % CLASSES, by_slot


def _statistics(weights):
    """Feature counts of each piece for the touched rows: observed ones, or those that ``weights`` expects with the log likelihood in row -1."""

    def run(batches):
        for batch in batches:
            for codes, counts in zip(batch["codes"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                context, by_class, pair_context, pair_class, by_slot = _piece(codes, counts)
                out, touched = np.zeros((BUCKETS, SLOTS), dtype=np.float32), np.zeros(BUCKETS, dtype=bool)
                likelihood = 0.0
                for seen, rows_of in ((by_class, lambda x: class_features(context[x])), (by_slot, lambda x: slot_features(pair_context[x], pair_class[x]))):
                    for lo in range(0, len(seen), 1 << 14):
                        part = slice(lo, lo + (1 << 14))
                        features, values = rows_of(part), seen[part]
                        if weights is not None:
                            logs = log_softmax(weights.value, features)
                            likelihood += float((values * logs).sum(dtype=np.float64))
                            values = values.sum(axis=1, keepdims=True) * np.exp(logs)
                        for k in range(FEATURES):
                            np.add.at(out, features[:, k], values)
                            touched[features[:, k]] = True
                rows = np.append(np.flatnonzero(touched), -1)
                found = np.concatenate([out[rows[:-1]], np.full((1, SLOTS), likelihood / SLOTS, dtype=np.float32)])
                yield pa.record_batch({"row": pa.array(rows, pa.int64()), "found": _vectors(found), "likelihood": pa.array([0.0] * (len(rows) - 1) + [likelihood], pa.float64())})

    return run


def _vectors(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel(), pa.float32()))


def _summed(cells: DataFrame, weights) -> tuple[np.ndarray, float]:
    """Feature counts over all pieces; what comes to the driver is bounded by the weight table, not by the input."""
    got = cells.mapInArrow(_statistics(weights), "row long, found array<float>, likelihood double").toArrow()
    out = np.zeros((BUCKETS, SLOTS), dtype=np.float32)
    for batch in got.to_batches():
        row = batch["row"].to_numpy()
        np.add.at(out, row[row >= 0], batch["found"].flatten().to_numpy(zero_copy_only=False).reshape(-1, SLOTS)[row >= 0])
    return out, float(sum(batch["likelihood"].to_numpy().sum() for batch in got.to_batches()))


def fit(cells: DataFrame, start: np.ndarray, rounds: int = ROUNDS, ridge: float = RIDGE) -> tuple[np.ndarray, list[float]]:
    """Weights by gradient updates from ``start``, and the penalised log likelihood of each update that was kept.

    A step is the gradient over a bound of the curvature: FEATURES weights share a logit, so
    each gets that part of its own counts. An update that lowers the penalised likelihood is
    taken back and tried again at half the step, without momentum.
    """
    context = cells.sparkSession.sparkContext
    observed, _ = _summed(cells, None)
    weights, best, move, step, kept = start, None, None, 1.0, []
    for _ in range(rounds + 1):
        shared = context.broadcast(weights)
        expected, likelihood = _summed(cells, shared)
        shared.unpersist()
        likelihood -= ridge / 2 * float(np.square(weights - start, dtype=np.float64).sum())
        if best is not None and likelihood < kept[-1]:
            step, move = step / 2, direction
            weights = best + step * move
            continue
        best = weights
        kept.append(likelihood)
        direction = (observed - expected - ridge * (weights - start)) / (FEATURES * (observed + expected) / 2 + ridge)
        move = direction if move is None else MOMENTUM * move + direction
        weights = best + step * move
    return (start if best is None else best), kept


def unigram_weights(leaf_tokens: np.ndarray) -> np.ndarray:
    """Weights of which only the biases are set: the shares of classes, and of slots within them."""
    tokens = leaf_tokens.reshape(CLASSES, SLOTS) + SMOOTH
    weights = np.zeros((BUCKETS, SLOTS), dtype=np.float32)
    weights[0] = np.log(tokens.sum(axis=1) / tokens.sum())
    weights[1 : 1 + CLASSES] = np.log(tokens / tokens.sum(axis=1, keepdims=True))
    return weights


def word_logs(leaf: np.ndarray, count: np.ndarray, tokens: np.ndarray, types: np.ndarray) -> np.ndarray:
    """Natural log of P(word | leaf); a leaf of one word has no other."""
    rare = leaf - (1 + TOP_CLASSES) * SLOTS
    own = rare < 0
    rare = np.maximum(rare, 0)
    return np.where(own, 0.0, np.log((count + SMOOTH) / (tokens[rare] + SMOOTH * (types[rare] + 1))))


def token_logs(weights: np.ndarray, context: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """Natural log of P(leaf | context) of each token: each distinct context and (context, class) is worked out once."""
    code, at = np.unique(context * CLASSES + leaf // SLOTS, return_inverse=True)
    logs = np.zeros(len(code), dtype=np.float64)
    for lo in range(0, len(code), 1 << 14):
        part = code[lo : lo + (1 << 14)]
        seen, of = np.unique(part // CLASSES, return_inverse=True)
        logs[lo : lo + len(part)] = log_softmax(weights, class_features(seen))[of, part % CLASSES]
    out = logs[at]
    order = np.argsort(at, kind="stable")
    bounds = np.searchsorted(at[order], np.arange(0, len(code) + (1 << 14), 1 << 14))
    for k, lo in enumerate(range(0, len(code), 1 << 14)):
        part, here = code[lo : lo + (1 << 14)], order[bounds[k] : bounds[k + 1]]
        out[here] += _slots(weights, part // CLASSES, part % CLASSES)[at[here] - lo, leaf[here] % SLOTS]
    return out


def _score_block(model):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
    )

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        if docs.num_rows == 0:
            return schema.empty_table()
        weights, top, tokens, types, n_all, v_all = model.value
        index, ids, lengths = _indexed(docs["text"].to_pylist())
        count = np.zeros(len(index), dtype=np.float64)
        sent = _flat(words["words"])[0].to_pylist()
        if len(sent) + (END not in sent) != len(index):
            raise ValueError(f"{len(index)} words in the block, counts for {len(sent)}")
        count[[index[w] for w in sent]] = _flat(words["n"])[0].to_numpy()
        leaves = Leaves(top)
        leaf = np.fromiter((leaves[w] for w in index), dtype=np.int64, count=len(index))
        base = np.log10((count + SMOOTH) / (n_all + SMOOTH * (v_all + 1)))
        inside = word_logs(leaf, count, tokens, types)
        of = leaf[ids]
        model_log = token_logs(weights, _contexts(of, lengths), of) + inside[ids]
        starts = np.cumsum(lengths) - lengths
        return pa.table(
            {
                "doc_id": docs["doc_id"],
                "held_out": pa.array([not t for t in docs["train"].to_pylist()], pa.bool_()),
                "n_tokens": pa.array(lengths, pa.int64()),
                "n_known": pa.array(np.add.reduceat((count[ids] > 0).astype(np.int64), starts), pa.int64()),
                "base_score": pa.array(np.add.reduceat(base[ids], starts), pa.float64()),
                "score": pa.array(np.add.reduceat(model_log, starts) / np.log(10.0), pa.float64()),
            },
            schema=schema,
        )

    return run


def totals(counted: DataFrame) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, int, int]:
    """The most frequent words, tokens by leaf, tokens and types by shared leaf, and all tokens and types. TOP words and some sums come to the driver."""
    firsts = counted.where("tokens is not null")
    sums = firsts.agg(*[F.sum(F.col(c)[k]).alias(f"{c}_{k}") for c in ("tokens", "types") for k in range(RARE)]).first()
    tokens, types = (np.array([sums[f"{c}_{k}"] or 0 for k in range(RARE)], dtype=np.float64) for c in ("tokens", "types"))
    n_all, v_all = int(tokens.sum()), int(types.sum())
    ranked = firsts.select(F.explode("top").alias("w")).select("w.word", "w.count").orderBy(F.col("count").desc(), "word").limit(TOP + 1).collect()
    top = [(bytes(r["word"]), r["count"]) for r in ranked]
    end = dict(top).get(END, 0)
    leaf_tokens = np.zeros(LEAVES)
    own = [(word, n) for word, n in top if word != END][:TOP]
    for word, n in [*own, *([(END, end)] if end else [])]:
        tokens[rare_leaf(word)] -= n
        types[rare_leaf(word)] -= 1
    of = Leaves([word for word, _ in own])
    for word, n in [*own, (END, end)]:
        leaf_tokens[of[word]] = n
    leaf_tokens[(1 + TOP_CLASSES) * SLOTS :] = tokens
    return [word for word, _ in own], leaf_tokens, tokens, types, n_all, v_all


def score(docs: DataFrame, train, block_bytes: int = BLOCK_BYTES, rounds: int = ROUNDS) -> DataFrame:
    """Scores of all rows of ``docs`` (doc_id, text) by a model of the rows where the column ``train`` holds."""
    spark = docs.sparkSession
    common.ship_package(spark)
    blocks = 1 + common.text_bytes(docs) // block_bytes
    n = common.partitions(spark, 2 * blocks)
    dealt = docs.select(
        "doc_id", "text", train.alias("train"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("block")
    ).repartition(n, "block")
    run, schema = _block_words(n)
    counted = common.written(dealt.groupBy("block").applyInArrow(run, schema).groupBy("shard").applyInArrow(_sum_shard, _COUNTED), "word-counts")
    top, leaf_tokens, tokens, types, n_all, v_all = totals(counted)
    names = spark.sparkContext.broadcast(top)
    cells = common.cut(count_cells(docs.where(train).select("text"), names, min(SALTS, 1 + blocks // 256)))
    weights, _ = fit(cells, unigram_weights(leaf_tokens), rounds)
    model = spark.sparkContext.broadcast((weights, top, tokens, types, n_all, v_all))
    scored = dealt.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(
        _score_block(model), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.withColumn("train_tokens", F.lit(n_all).cast("long"))


def op1_lm_score(spark, sf_dir: str) -> DataFrame:
    """The contract's query over the whole documents table."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, common.id_bucket(F.col("doc_id"), 10) != 0).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
