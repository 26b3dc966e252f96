"""BPE encoding and decoding by a distinct-word table.

Texts are split into words (a space with what follows it; a run of white space stays with
the word before it, so that words can be encoded apart). A block of some 8 MB of texts
sends each of its distinct words once to the word's shard; there each distinct word of the
corpus is encoded once; the ids return to the block and are joined to the words by
position. Decoding joins every id with the table of pieces.

A block's texts travel packed with zstd. Should a block be made anew with other rows (its
input in another order after a lost executor), the checksums of its word lists differ and
the block encodes those words itself: results never depend on the order of the input.

Defined results: a null or empty text has no ids; repeated rows and null ids are kept row
by row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of text in a block.
BLOCK_BYTES = 8 << 20
#: Words given to the encoder at a time.
ENCODE_WORDS = 2048
TOKENIZER = "byte_bpe_50k.json"

_JOINED_SPACE = re.compile(r" (?:\s|\Z)")


def split_words(text: str | None) -> list[str]:
    """Words whose encodings, one after the other, are the text's encoding.

    A cut stands before a space that a visible character follows. The pretokenizer's
    pattern has a token start at each such place, whatever stands before it.
    """
    if not text:
        return []
    if "\0" not in text and not _JOINED_SPACE.search(text):
        words = text.replace(" ", "\0 ").split("\0")
        return words if words[0] else words[1:]
    out: list[str] = []
    for k, part in enumerate(text.split(" ")):
        word = " " + part if k else part
        if out and (not part or part[0].isspace()):
            out[-1] += word
        elif word:
            out.append(word)
    return out


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=2)
def _pieces(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The id-to-piece table: all pieces' bytes, and each id's start and length."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    table = {k: bytes(byte_of[c] for c in piece) for piece, k in spec["model"]["vocab"].items()}
    table |= {x["id"]: x["content"].encode() for x in spec["added_tokens"]}
    rows = [table.get(k, b"") for k in range(max(table) + 1)]
    lengths = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    return np.frombuffer(b"".join(rows), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths


def encode_words(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after the other, and how many each word has."""
    flat, lengths = [np.zeros(0, dtype=np.uint32)], [np.zeros(0, dtype=np.uint32)]
    # What the library makes of a word is some hundred times its ids, so it gets some words at a time.
    for at in range(0, len(words), ENCODE_WORDS):
        got = [e.ids for e in _tokenizer(path).encode_batch_fast(words[at : at + ENCODE_WORDS], add_special_tokens=False)]
        lengths.append(np.fromiter(map(len, got), dtype=np.uint32, count=len(got)))
        flat.append(np.fromiter((i for ids in got for i in ids), dtype=np.uint32, count=int(lengths[-1].sum())))
    return np.concatenate(flat), np.concatenate(lengths)


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices ``of`` of ``flat`` one after the other, and the lengths taken."""
    taken = lengths[of].astype(np.int64)
    before = np.cumsum(taken) - taken
    return flat[np.repeat(starts[of] - before, taken) + np.arange(taken.sum())], taken


def _pack(words: list[str]) -> bytes:
    """Words one after the other; the byte between them is in no UTF-8 text."""
    return zstandard.compress(b"\xff".join([w.encode() for w in words]), 3)


def _unpack(packed: bytes) -> list[str]:
    return [w.decode() for w in zstandard.decompress(packed).split(b"\xff")]


def _checksum(words: list[str]) -> int:
    return zlib.crc32("\0".join(words).encode()) ^ len(words)


def _blocks(batches, block_bytes: int):
    """(block, ids, texts) of the rows of a task, in order; ids of blocks are the task's partition and a number."""
    ids, texts, size, k = [], [], 0, 0
    part = TaskContext.get().partitionId() << 24
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            ids.append(doc_id)
            texts.append(text or "")
            size += len(texts[-1])
            if size >= block_bytes:
                yield part + k, ids, texts
                ids, texts, size, k = [], [], 0, k + 1
    if ids:
        yield part + k, ids, texts


def _by_shard(words, shards: int) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for word in words:
        out.setdefault(zlib.crc32(word.encode()) % shards, []).append(word)
    return out


def _distinct(texts: list[str]) -> dict[str, int]:
    found: dict[str, None] = {}
    for text in texts:
        found.update(dict.fromkeys(split_words(text)))
    return {word: k for k, word in enumerate(found)}


def _block_words(shards: int, block_bytes: int):
    def run(batches):
        for block, _, texts in _blocks(batches, block_bytes):
            parts = _by_shard(_distinct(texts), shards)
            yield pa.record_batch(
                {
                    "block": pa.array([block] * len(parts), pa.int64()),
                    "shard": pa.array(list(parts), pa.int32()),
                    "words": pa.array([_pack(words) for words in parts.values()], pa.binary()),
                }
            )

    return run


def _block_texts(block_bytes: int):
    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for block, ids, texts in _blocks(batches, block_bytes):
            raw = [t.encode() for t in texts]
            yield pa.record_batch(
                {
                    "block": pa.array([block], pa.int64()),
                    "ids": pa.array([ids], pa.list_(pa.int64())),
                    "sizes": pa.array([[len(t) for t in raw]], pa.list_(pa.int64())),
                    "packed": pa.array([pack.compress(b"".join(raw))], pa.binary()),
                }
            )

    return run


def _encode_shards(path: str):
    """Rows of a shard stand together: each distinct word of the shard is encoded when it is first met."""

    def run(batches):
        shard, known = None, {}
        flat = np.zeros(0, dtype=np.uint32)
        starts, lengths = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32)
        for batch in batches:
            for block, at, packed in zip(batch["block"].to_pylist(), batch["shard"].to_pylist(), batch["words"].to_pylist(), strict=True):
                words = _unpack(packed)
                if at != shard:
                    shard, known, flat = at, {}, flat[:0]
                    starts, lengths = starts[:0], lengths[:0]
                new = [w for w in words if w not in known]
                if new:
                    ids, taken = encode_words(new, path)
                    starts = np.concatenate([starts, len(flat) + np.cumsum(taken, dtype=np.int64) - taken])
                    lengths, flat = np.concatenate([lengths, taken]), np.concatenate([flat, ids])
                    known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                ids, taken = _gather(flat, starts, lengths, np.fromiter((known[w] for w in words), dtype=np.int64, count=len(words)))
                yield pa.record_batch(
                    {
                        "block": pa.array([block], pa.int64()),
                        "shard": pa.array([at], pa.int32()),
                        "check": pa.array([_checksum(words)], pa.int64()),
                        "lengths": pa.array([zstandard.compress(taken.astype("<u4").tobytes(), 3)], pa.binary()),
                        "token_ids": pa.array([zstandard.compress(ids.astype("<u4").tobytes(), 3)], pa.binary()),
                    }
                )

    return run


_ENCODED = "doc_id long, n_tokens long, token_ids binary, decoded binary"


def _join_block(path: str, shards: int, out):
    def run(docs: pa.Table, coded: pa.Table) -> pa.Table:
        tables = []
        got = {s: k for k, s in enumerate(coded["shard"].to_pylist())}
        for ids, sizes, packed in zip(docs["ids"].to_pylist(), docs["sizes"].to_pylist(), docs["packed"].to_pylist(), strict=True):
            raw, at, texts = zstandard.ZstdDecompressor().decompress(packed), 0, []
            for n in sizes:
                texts.append(raw[at : at + n].decode())
                at += n
            del raw
            index = _distinct(texts)
            flat, starts, lengths = [], np.zeros(len(index), dtype=np.int64), np.zeros(len(index), dtype=np.int64)
            filled = 0
            for shard, words in _by_shard(index, shards).items():
                k = got.get(shard)
                if k is not None and coded["check"][k].as_py() == _checksum(words):
                    taken = np.frombuffer(zstandard.decompress(coded["lengths"][k].as_py()), dtype="<u4").astype(np.int64)
                    part = np.frombuffer(zstandard.decompress(coded["token_ids"][k].as_py()), dtype="<u4")
                else:
                    part, taken = encode_words(words, path)
                    taken = taken.astype(np.int64)
                where = np.fromiter((index[w] for w in words), dtype=np.int64, count=len(words))
                starts[where], lengths[where] = filled + np.cumsum(taken) - taken, taken
                flat.append(part.astype(np.uint32))
                filled += len(part)
            flat = np.concatenate(flat) if flat else np.zeros(0, dtype=np.uint32)
            tables.append(_encoded_rows(ids, texts, index, flat, starts, lengths, _pieces(path), out))
        return pa.concat_tables(tables) if tables else out([], [], [])

    return run


def _encoded_rows(ids, texts, index, flat, starts, lengths, pieces, out) -> pa.Table:
    """Rows of a block, some megabytes of text at a time."""
    tables, at = [], 0
    while at < len(texts) or not tables:
        to, size = at, 0
        while to < len(texts) and (to == at or size < 1 << 19):
            size += len(texts[to])
            to += 1
        words = [split_words(t) for t in texts[at:to]]
        of = np.fromiter((index[w] for ws in words for w in ws), dtype=np.int64, count=sum(map(len, words)))
        token_ids, taken = _gather(flat, starts, lengths, of)
        per_word = np.concatenate([[0], np.cumsum(taken)])
        ends = per_word[np.cumsum([len(ws) for ws in words], dtype=np.int64)] if words else np.zeros(0, dtype=np.int64)
        decoded, sizes = _gather(pieces[0], pieces[1], pieces[2], token_ids.astype(np.int64))
        per_id = np.concatenate([[0], np.cumsum(sizes)])
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        tables.append(
            out(
                ids[at:to],
                [token_ids[a:b].astype("<u4") for a, b in zip(begins, ends, strict=True)],
                [decoded[per_id[a] : per_id[b]].tobytes() for a, b in zip(begins, ends, strict=True)],
            )
        )
        at = max(to, at + 1)
    return pa.concat_tables(tables)


def _out_ids(ids, token_ids, decoded) -> pa.Table:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in token_ids])]).astype(np.int32)
    return pa.table(
        {
            "doc_id": pa.array(ids, pa.int64()),
            "token_ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(token_ids).astype(np.int32) if token_ids else np.zeros(0, dtype=np.int32))),
            "decoded": pa.array([x.decode(errors="replace") for x in decoded], pa.string()),
        }
    )


def _out_digests(ids, token_ids, decoded) -> pa.Table:
    return pa.table(
        {
            "doc_id": pa.array(ids, pa.int64()),
            "n_tokens": pa.array([len(x) for x in token_ids], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in token_ids], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(x.decode(errors="replace").encode()).hexdigest() for x in decoded], pa.string()),
        }
    )


def encode(docs: DataFrame, path: str | None = None, digests: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Token ids of each row's text and the text decoded from them; with ``digests`` their SHA-256 in place of them."""
    spark = docs.sparkSession
    common.ship_package(spark)
    path = path or public_tokenizers.path(TOKENIZER)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = common.partitions(spark, 2 * (1 + common.text_bytes(docs) // block_bytes))
    words = docs.mapInArrow(_block_words(n, block_bytes), "block long, shard int, words binary")
    coded = (
        words.repartition(n, "shard")
        .sortWithinPartitions("shard")
        .mapInArrow(_encode_shards(path), "block long, shard int, check long, lengths binary, token_ids binary")
    )
    texts = docs.mapInArrow(_block_texts(block_bytes), "block long, ids array<long>, sizes array<long>, packed binary")
    out, schema = (
        (_out_digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
        if digests
        else (_out_ids, "doc_id long, token_ids array<int>, decoded string")
    )
    return (
        texts.repartition(n, "block").groupBy("block").cogroup(coded.repartition(n, "block").groupBy("block")).applyInArrow(_join_block(path, n, out), schema)
    )


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    """The contract's query over the whole documents table."""
    return encode(common.table(spark, sf_dir, "documents"), digests=True)
