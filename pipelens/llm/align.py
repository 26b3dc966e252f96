"""Alignment of two tokenizers' tokens by their common byte offsets.

A text with a space before it is cut into segments at places where both vocabularies have
a token boundary whatever stands around: before a space that a visible character follows
and no space precedes. A block of some 10 MB of texts encodes and aligns each of its
distinct segments once. Offsets where tokens of both end come from a galloping
intersection: each end of the shorter list searches the longer one by doubling steps and
then by halving, from where the end before it stopped. Common offsets slice the tokens
into groups, and the ranks in both lists give the ranges of tokens that overlap.

Blocks are written once. In how many documents a pair of ids is linked is counted in each
block, summed by pair in Spark, and joined back to the blocks, each pair once a block.

Defined results: null and empty texts, and texts whose tokens do not spell them, have no
tokens (zeros and an empty digest); repeated rows and rows of equal or null ids count as
documents of their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from bisect import bisect_left

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, common

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text in a block, and segments encoded and aligned at a time.
BLOCK_BYTES = 10 << 20
SEGMENTS = 4096
#: Segments of fewer characters are encoded together.
SHORT = 200
#: Linked pairs of a block's documents that are sorted at a time.
LINKED = 1 << 19
#: A list of more ends searches alone, shorter ones of many segments in step.
IN_STEP = 32
#: Groups of more pairs are linked by distinct ids and how often each stands there.
GROUP_PAIRS = 256
#: A pair of ids as one number: the id of A times this, plus the id of B.
ID_SPAN = 1 << 24

_ODD_SPACE = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r"(?<! )(?= \S)")


@functools.lru_cache(maxsize=2)
def _encoder_a(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings inside texts are plain text
    return tokenizer


@functools.lru_cache(maxsize=2)
def _ranks_a(path: str):
    """The same vocabulary in a library that is some times as fast on many words; None if its merges are not in the order of their ids."""
    import tiktoken

    data, starts, lengths = bpe._pieces(path)
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, special = spec["model"], {x["id"] for x in spec["added_tokens"]}
    merged = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
    if merged != sorted(set(merged)) or set(merged) & set(range(256)) or spec["normalizer"] or not spec["pre_tokenizer"].get("use_regex"):
        return None
    ranks = {data[a : a + n].tobytes(): k for k, (a, n) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)) if k not in special}
    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == len(model["vocab"]) - len(special & set(model["vocab"].values())) else None


@functools.lru_cache(maxsize=2)
def _encoder_b(path: str):
    """The processor, its pieces' bytes, starts and lengths, and whether no piece has a space after something else."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows, apart = [], True
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        rows.append(bytes([int(piece[3:5], 16)]) if model.is_byte(k) else piece.replace("▁", " ").encode())
        apart &= "▁" not in piece.lstrip("▁")
    lengths = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    return model, (np.frombuffer(b"".join(rows), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths), apart


def split_segments(text: str, apart: bool = True) -> list[str]:
    """Segments of the text with a space before it; one after the other they are encoded as the whole is."""
    whole = " " + text
    if not apart:
        return [whole]
    if "\0" not in whole and not _ODD_SPACE.search(whole):
        return whole.replace(" ", "\0 ").split("\0")[1:]
    return [x for x in _CUT.split(whole) if x]


def encode_a(segments: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all segments one after the other, and how many each has.

    Short segments that start with a space and a visible character are encoded in one string
    and told apart by their bytes; the others alone.
    """
    tokenizer, ranks, lengths = _encoder_a(path), _ranks_a(path), bpe._pieces(path)[2]
    plain = np.fromiter((1 < len(s) < SHORT and s[0] == " " and not s[1].isspace() for s in segments), dtype=bool, count=len(segments))
    counts, together = np.zeros(len(segments), dtype=np.int64), np.zeros(0, dtype=np.int64)
    if plain.any():
        chosen = segments if plain.all() else [segments[k] for k in np.flatnonzero(plain)]
        whole = "".join(chosen)
        together = np.array(ranks.encode_ordinary(whole) if ranks else tokenizer.encode(whole, add_special_tokens=False).ids, dtype=np.int64)
        ends = np.cumsum(lengths[together])
        want = np.cumsum([len(s.encode()) for s in chosen])
        at = np.searchsorted(ends, want)
        if len(ends) and at[-1] < len(ends) and (ends[at] == want).all():
            counts[plain] = np.diff(at, prepend=-1)
        else:
            plain[:], together = False, together[:0]
    if plain.all():
        return together, counts
    alone = [e.ids for e in tokenizer.encode_batch_fast([segments[k] for k in np.flatnonzero(~plain)], add_special_tokens=False)]
    counts[~plain] = [len(x) for x in alone]
    flat, own = np.zeros(counts.sum(), dtype=np.int64), np.repeat(plain, counts)
    flat[own] = together
    flat[~own] = [i for ids in alone for i in ids]
    return flat, counts


def encode_b(segments: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all segments one after the other, and how many each has; the model itself puts the first space."""
    got = _encoder_b(path)[0].encode([s[1:] for s in segments], num_threads=1) if segments else []
    counts = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
    return np.fromiter((i for ids in got for i in ids), dtype=np.int64, count=int(counts.sum())), counts


def gallop(short, long, start: int = 0) -> tuple[list[int], list[int]]:
    """Indexes of the common elements of two sorted lists; the shorter one drives."""
    at, mine, theirs, n = start, [], [], len(long)
    for k, end in enumerate(short):
        step = 1
        while at + step < n and long[at + step] < end:
            step *= 2
        at = bisect_left(long, end, at + step // 2, min(n, at + step + 1))
        if at == n:
            break
        if long[at] == end:
            mine.append(k)
            theirs.append(at)
    return mine, theirs


def gallop_in_step(short: np.ndarray, s_from: np.ndarray, s_to: np.ndarray, long: np.ndarray, l_from: np.ndarray, l_to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``gallop`` of many short lists at once: slices of ``short`` against slices of ``long``, as positions in both."""
    mine, theirs = [], []
    lane, at, k = np.arange(len(s_from)), l_from.copy(), s_from.copy()
    while True:
        alive = (k < s_to[lane]) & (at < l_to[lane])
        lane, at, k = lane[alive], at[alive], k[alive]
        if not len(lane):
            break
        end, top = short[k], l_to[lane]
        step = np.ones(len(lane), dtype=np.int64)
        while True:
            probe = at + step
            below = (probe < top) & (long[np.minimum(probe, len(long) - 1)] < end)
            if not below.any():
                break
            step[below] *= 2
        lo, hi = at + step // 2, np.minimum(top, at + step + 1)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            less = open_ & (long[np.minimum(mid, len(long) - 1)] < end)
            lo = np.where(less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        at = lo
        hit = (at < top) & (long[np.minimum(at, len(long) - 1)] == end)
        mine.append(k[hit])
        theirs.append(at[hit])
        k = k + 1
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *mine]), np.concatenate([none, *theirs])


def common_ends(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions, in two flat lists cut into segments at ``starts`` (one more than segments), of the ends that both lists of a segment have, in order."""
    n_a, n_b = np.diff(a_starts), np.diff(b_starts)
    i, j = [], []
    few = np.minimum(n_a, n_b) <= IN_STEP
    for first in (True, False):  # the lists of A are the shorter ones, those of B are
        lanes = np.flatnonzero(few & ((n_a <= n_b) == first))
        x, xs, y, ys = (a, a_starts, b, b_starts) if first else (b, b_starts, a, a_starts)
        mine, theirs = gallop_in_step(x, xs[lanes], xs[lanes + 1], y, ys[lanes], ys[lanes + 1])
        i.append(mine if first else theirs)
        j.append(theirs if first else mine)
    for k in np.flatnonzero(~few):
        x, y = a[a_starts[k] : a_starts[k + 1]].tolist(), b[b_starts[k] : b_starts[k + 1]].tolist()
        mine, theirs = gallop(x, y) if len(x) <= len(y) else gallop(y, x)[::-1]
        i.append(np.array(mine, dtype=np.int64) + a_starts[k])
        j.append(np.array(theirs, dtype=np.int64) + b_starts[k])
    i, j = np.concatenate(i), np.concatenate(j)
    order = np.argsort(i, kind="stable")
    return i[order], j[order]


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _spelled(flat: np.ndarray, starts: np.ndarray, pieces, raw: list[bytes]) -> np.ndarray:
    """Whether each segment's tokens have exactly its bytes."""
    data, taken = bpe._gather(*pieces, flat)
    per_token = _starts(taken)
    whole = data.tobytes()
    if whole == b"".join(raw) and (np.diff(per_token[starts]) == np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))).all():
        return np.ones(len(raw), dtype=bool)
    cuts = per_token[starts].tolist()
    return np.fromiter((whole[x:y] == r for x, y, r in zip(cuts, cuts[1:], raw, strict=False)), dtype=bool, count=len(raw))


def _pairs(ids_a, a0, p, ids_b, b0, q) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair, times) of the linked ids of groups, given where their tokens start and how many there are."""
    small = np.flatnonzero(p * q <= GROUP_PAIRS)
    n = (p * q)[small]
    group = np.repeat(small, n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    pair = ids_a[a0[group] + k // np.maximum(q[group], 1)] * ID_SPAN + ids_b[b0[group] + k % np.maximum(q[group], 1)]
    groups, pairs, times = [group], [pair], [np.ones(len(pair), dtype=np.int64)]
    for g in np.flatnonzero(p * q > GROUP_PAIRS):
        x, n_x = np.unique(ids_a[a0[g] : a0[g] + p[g]], return_counts=True)
        y, n_y = np.unique(ids_b[b0[g] : b0[g] + q[g]], return_counts=True)
        pairs.append((x[:, None] * ID_SPAN + y).ravel())
        times.append((n_x[:, None] * n_y).ravel())
        groups.append(np.full(len(pairs[-1]), g))
    return np.concatenate(groups), np.concatenate(pairs), np.concatenate(times)


def align_segments(segments: list[str], path_a: str, path_b: str) -> dict:
    """Of each segment: whether both spell it, counts of tokens, groups and links, the groups as text, and its linked pairs (flat, with starts)."""
    raw = [s.encode() for s in segments]
    model_b = _encoder_b(path_b)
    ids_a, n_a = encode_a(segments, path_a)
    ids_b, n_b = encode_b(segments, path_b)
    a_starts, b_starts = _starts(n_a), _starts(n_b)
    good = _spelled(ids_a, a_starts, bpe._pieces(path_a), raw) & _spelled(ids_b, b_starts, model_b[1], raw)
    ends_a, ends_b = np.cumsum(bpe._pieces(path_a)[2][ids_a]), np.cumsum(model_b[1][2][ids_b])
    # Offsets count from the segment's own start; those of segments that are not spelled are not looked at.
    base_a, base_b = np.concatenate([[0], ends_a])[a_starts[:-1]], np.concatenate([[0], ends_b])[b_starts[:-1]]
    keep_a, keep_b = np.repeat(good, n_a), np.repeat(good, n_b)
    n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
    ids_a, ids_b = ids_a[keep_a], ids_b[keep_b]
    ends_a, ends_b = ends_a[keep_a] - np.repeat(base_a, n_a), ends_b[keep_b] - np.repeat(base_b, n_b)
    a_starts, b_starts = _starts(n_a), _starts(n_b)
    i, j = common_ends(ends_a, a_starts, ends_b, b_starts)
    # A group starts after the group before it; every spelled segment's own end is common, so none reaches over it.
    a0, b0 = np.concatenate([[0], i[:-1] + 1])[: len(i)], np.concatenate([[0], j[:-1] + 1])[: len(j)]
    p, q = i + 1 - a0, j + 1 - b0
    owner = np.searchsorted(a_starts, i, side="right") - 1
    n_groups = np.bincount(owner, minlength=len(segments))
    n_links = np.bincount(owner, weights=p * q, minlength=len(segments)).astype(np.int64) if len(i) else np.zeros(len(segments), dtype=np.int64)
    text_a, text_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
    parts = [
        f"{text_a[x]}|{text_b[y]}" if m == n == 1 else f"{','.join(text_a[x : x + m])}|{','.join(text_b[y : y + n])}"
        for x, m, y, n in zip(a0.tolist(), p.tolist(), b0.tolist(), q.tolist(), strict=True)
    ]
    cuts = _starts(n_groups).tolist()
    group, pair, times = _pairs(ids_a, a0, p, ids_b, b0, q)
    order = np.argsort(owner[group], kind="stable")
    return {
        "good": good, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links,
        "text": [";".join(parts[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)],
        "pair": pair[order], "times": times[order], "n_pairs": np.bincount(owner[group], minlength=len(segments)),
    }


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_BLOCK = "block long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, shas array<string>, pairs binary, docs binary, doc_pairs array<long>, linked binary, times binary"


def _packed(values: np.ndarray, kind: str) -> bytes:
    return zstandard.compress(values.astype(kind).tobytes(), 3)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype=kind).astype(np.int64)


def _runs(sizes: np.ndarray, most: int):
    """Ranges of neighbours of about ``most`` in sum, at least one each."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


def _align_block(block: int, ids: list, texts: list[str], path_a: str, path_b: str) -> pa.RecordBatch:
    """A block's row: its documents' counts and digests, its distinct pairs with the number of documents that link each, and each document's pairs as indexes of those."""
    apart = _encoder_b(path_b)[2]
    index: dict[str, int] = {}
    of = []
    for text in texts:
        segments = split_segments(text, apart) if text else []
        of.append(np.fromiter([index.setdefault(s, len(index)) for s in segments], dtype=np.int64, count=len(segments)))
    distinct, found = list(index), []
    del index
    for at in range(0, len(distinct), SEGMENTS):
        found.append(align_segments(distinct[at : at + SEGMENTS], path_a, path_b))
    joined = {c: np.concatenate([np.zeros(0, dtype=np.int64), *[x[c] for x in found]]) for c in ("good", *_COUNTS, "pair", "times", "n_pairs")}
    strings = [t for x in found for t in x["text"]]
    del found, distinct
    pairs, inverse = np.unique(joined["pair"], return_inverse=True)
    starts = np.cumsum(joined["n_pairs"]) - joined["n_pairs"]
    docs = np.zeros(len(pairs), dtype=np.int64)
    sizes = np.fromiter(map(len, of), dtype=np.int64, count=len(of))
    flat = np.concatenate([np.zeros(0, dtype=np.int64), *of])
    cuts = _starts(sizes)
    good = (sizes > 0) & (np.diff(_starts(joined["good"][flat])[cuts]) == sizes)
    sums = {c: np.where(good, np.diff(_starts(joined[c][flat])[cuts]), 0) for c in _COUNTS}
    shas = [hashlib.sha256(";".join([strings[k] for k in segments.tolist()]).encode()).hexdigest() if ok else "" for segments, ok in zip(of, good, strict=True)]
    n_linked = np.where(good, np.diff(_starts(joined["n_pairs"][flat])[cuts]), 0)
    doc_pairs, linked, times = [], [], []
    for lo, hi in _runs(n_linked, LINKED):
        segments = flat[cuts[lo] : cuts[hi]][np.repeat(good[lo:hi], sizes[lo:hi])]
        mine, _ = bpe._gather(inverse, starts, joined["n_pairs"], segments)
        often, _ = bpe._gather(joined["times"], starts, joined["n_pairs"], segments)
        key = np.repeat(np.arange(hi - lo), n_linked[lo:hi]) * max(1, len(pairs)) + mine
        if (often == 1).all():
            key, often = np.unique(key, return_counts=True)
        else:
            key, place = np.unique(key, return_inverse=True)
            often = np.bincount(place, weights=often, minlength=len(key)).astype(np.int64)
        mine = key % max(1, len(pairs))
        docs += np.bincount(mine, minlength=len(pairs))
        doc_pairs.append(np.bincount(key // max(1, len(pairs)), minlength=hi - lo))
        linked.append(mine.astype(np.uint32))
        times.append(often)
    lists = lambda values, kind: pa.array([values], pa.list_(kind))
    return pa.record_batch(
        {
            "block": pa.array([block], pa.int64()),
            "ids": lists(ids, pa.int64()),
            **{c: lists(sums[c].tolist(), pa.int64()) for c in _COUNTS},
            "shas": lists(shas, pa.string()),
            "pairs": pa.array([_packed(np.diff(pairs, prepend=0), "<u8")], pa.binary()),
            "docs": pa.array([_packed(docs, "<u4")], pa.binary()),
            "doc_pairs": lists(np.concatenate(doc_pairs).tolist(), pa.int64()),
            "linked": pa.array([_packed(np.concatenate(linked), "<u4")], pa.binary()),
            "times": pa.array([_packed(np.concatenate(times), "<u8")], pa.binary()),
        }
    )


def _align(path_a: str, path_b: str, block_bytes: int):
    def run(batches):
        for block, ids, texts in bpe._blocks(batches, block_bytes):
            yield _align_block(block, ids, texts, path_a, path_b)

    return run


def _block_pairs(batches):
    """(block, at, pair, docs) of each distinct pair of each block."""
    for batch in batches:
        for block, pairs, docs in zip(*(batch[c].to_pylist() for c in ("block", "pairs", "docs")), strict=True):
            pair = np.cumsum(_unpacked(pairs, "<u8"))
            for at in range(0, len(pair), 1 << 16):
                part = pair[at : at + (1 << 16)]
                n = len(part)
                yield pa.record_batch({"block": np.full(n, block), "at": np.arange(at, at + n), "pair": part, "docs": _unpacked(docs, "<u4")[at : at + n]})


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _with_counts(blocks: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of a block with the counts of their pairs, which come in any order."""
    tables = []
    for row in blocks.to_pylist():
        at = counts["at"].to_numpy()
        docs, best = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        docs[at], best[at] = counts["docs"].to_numpy(), counts["best"].to_numpy()
        linked, times = _unpacked(row["linked"], "<u4"), _unpacked(row["times"], "<u8")
        cuts = _starts(np.array(row["doc_pairs"], dtype=np.int64))
        sum_of = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[cuts])  # noqa: B023, E731
        columns = [pa.array(row[c], pa.int64()) for c in ("ids", *_COUNTS)]
        columns += [pa.array(sum_of(times * best[linked]), pa.int64()), pa.array(sum_of(times * docs[linked]), pa.int64()), pa.array(row["shas"], pa.string())]
        tables.append(pa.table(columns, names=["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"]))
    return pa.concat_tables(tables) if tables else pa.table({c: pa.array([], pa.string() if c == "groups_sha256" else pa.int64()) for c in ("doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256")})


def link_counts(blocks: DataFrame) -> DataFrame:
    """(pair, docs, best) over all blocks: in how many documents a pair is linked, and 1 if no pair of the same id of A is in more."""
    counts = blocks.select("block", "pairs", "docs").mapInArrow(_block_pairs, "block long, at long, pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))
    counts = common.cut(counts.withColumn("a", F.expr(f"pair div {ID_SPAN}")))
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return counts.join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).cast("long").alias("best"))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Counts of tokens, groups and links of each row's text, its links' counts over all documents, and the digest of its groups."""
    spark = docs.sparkSession
    common.ship_package(spark)
    path_a, path_b = path_a or public_tokenizers.path(TOKENIZER_A), path_b or public_tokenizers.path(TOKENIZER_B)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = common.written(docs.mapInArrow(_align(path_a, path_b, block_bytes), _BLOCK), "aligned")
    own = blocks.select("block", "pairs", "docs").mapInArrow(_block_pairs, "block long, at long, pair long, docs long")
    back = own.select("block", "at", "pair").join(link_counts(blocks), "pair").select("block", "at", "docs", "best")
    n = common.partitions(spark, blocks.count())
    return blocks.drop("pairs", "docs").repartition(n, "block").groupBy("block").cogroup(back.repartition(n, "block").groupBy("block")).applyInArrow(_with_counts, _RESULT)


def op11_align(spark, sf_dir: str) -> DataFrame:
    """The contract's query over the whole documents table."""
    return align(common.table(spark, sf_dir, "documents"))
