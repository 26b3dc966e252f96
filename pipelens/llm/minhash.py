"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures.

A document's set is its distinct word shingles. Its signature keeps BITS bits of each of
POSITIONS minima; the distance of two signatures is the number of positions that differ.
Signatures are cut into CHUNKS chunks. By pigeonhole, of two signatures at no more than
RADIUS places one chunk differs in at most ERRORS places, so each chunk is a key once for
every choice of ERRORS positions to leave out, and all pairs within RADIUS share a key.

Of equal sets one goes into the join. Keys of few sets report their close pairs; keys of
many report a spanning forest of them, in chunks of KEY_ROWS that meet two by two. The
parts that hang together by signatures are candidates: their texts are shuffled once, by
part, and compared as full sets, again as a spanning forest, large parts in pieces that
meet two by two. So no link is taken without its full sets, and no group writes its pairs.

Documents at the threshold itself differ in a fifth of the positions; with 40 positions and
a radius of 19 a link at exactly 0.8 is missed with probability 2e-5, one at 0.85 with
2e-7. All pairs within the radius are found, whatever their group's size.

Defined results: null, empty and blank texts have the empty set, are linked with nothing
and stand alone; rows that share an id are separate members; a null id is never the
smallest of a component that has another id, and such a row is kept if its component has
no other; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import _gather
from .components import connected
from .fingerprint import _ODD, WordHashes, _finish

WORDS = 4
PERCENT = 80
POSITIONS, CHUNKS, ERRORS = 40, 10, 1
#: What the chunks guarantee: one more error in every chunk would make this plus one.
RADIUS = CHUNKS * (ERRORS + 1) - 1
#: Bits of a minimum in a signature: 8, a byte each.
BITS = 8
#: Sets of a key that one task compares at a time; up to SMALL all pairs are looked at.
KEY_ROWS, SMALL = 8192, 16
#: Of keys with more rows than KEY_ROWS so many at most are broadcast; more of them are joined.
LARGE_KEYS = 100_000
#: Shingles of a part's piece; two pieces stand in a task at a time.
PIECE = 1 << 19
#: So many sets are compared in full only; among more, signatures come first.
FEW = 64

_MIX = np.random.default_rng(20).integers(1, 2**63, size=(2, 1024), dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str | None, hashes: dict[bytes, int], width: int = WORDS) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    words = common.words_of(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter([hashes[x] for x in words], dtype=np.uint64, count=len(words))
    take = min(width, len(w))
    n = len(w) - take + 1
    h = np.full(n, take, dtype=np.uint64)
    for j in range(take):
        h = (h ^ w[j : j + n]) * _ODD[j % len(_ODD)]
        h ^= h >> np.uint64(29)
    return np.unique(_finish(h))


def set_id(shingles: np.ndarray) -> bytes:
    """16 bytes that equal sets share."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signatures(sets: list[np.ndarray], positions: int = POSITIONS) -> np.ndarray:
    """(sets, positions): BITS bits of the smallest value of each position's mix over each set, none of which is empty."""
    out = np.zeros((len(sets), positions), dtype=np.uint8)
    if not sets:
        return out
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    for k in range(positions):
        mixed = (flat ^ _MIX[0, k]) * _MIX[1, k]
        mixed ^= mixed >> np.uint64(32)
        out[:, k] = (np.minimum.reduceat(mixed, starts) >> np.uint64(20)).astype(np.uint8)
    return out


def _sketches(positions: int, width: int):
    def run(batches):
        hashes = WordHashes()
        for batch in common.slices(batches):
            sets = [shingle_set(t, hashes, width) for t in batch["text"].to_pylist()]
            full = [k for k, s in enumerate(sets) if len(s)]
            sig: list = [None] * len(sets)
            for k, row in zip(full, signatures([sets[k] for k in full], positions), strict=True):
                sig[k] = row.tobytes()
            yield pa.record_batch(
                {
                    "doc_id": batch["doc_id"],
                    "text_hash": batch["text_hash"],
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "id": pa.array([set_id(s) if len(s) else None for s in sets], pa.binary()),
                    "sig": pa.array(sig, pa.binary()),
                }
            )

    return run


def _plain(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("text_hash", F.xxhash64("text"))


def sketches(docs: DataFrame, positions: int = POSITIONS, width: int = WORDS) -> DataFrame:
    """(doc_id, text_hash, n, id, sig) of each row; id and sig are null for the empty set."""
    common.ship_package(docs.sparkSession)
    return _plain(docs).mapInArrow(_sketches(positions, width), "doc_id long, text_hash long, n long, id binary, sig binary")


def masks(positions: int = POSITIONS, chunks: int = CHUNKS, errors: int = ERRORS) -> list[list[int]]:
    """The positions that each key looks at, chunk by chunk."""
    edges = [positions * k // chunks for k in range(chunks + 1)]
    return [[p for p in range(lo, hi) if p not in left] for lo, hi in zip(edges, edges[1:], strict=False) for left in combinations(range(lo, hi), errors)]


def keyed(sets: DataFrame, looked_at: list[list[int]]) -> DataFrame:
    """The rows of ``sets`` with each of their keys: a hash of the mask's number and of the bytes that it looks at."""
    keys = [F.xxhash64(F.lit(k), *[F.substring("sig", p + 1, 1) for p in mask]) for k, mask in enumerate(looked_at)]
    return sets.withColumn("key", F.explode(F.array(*keys)))


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many positions signatures differ."""
    return (a != b).sum(axis=-1)


def forest(n: int, near) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges of a spanning forest of 0..n-1; ``near(k, rest)`` says which of ``rest`` link with k."""
    a, b = [], []
    rest = np.arange(n)
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            k = front.pop()
            linked = near(k, rest)
            found = rest[linked]
            if len(found):
                a.append(np.full(len(found), k))
                b.append(found)
                front.extend(found.tolist())
                rest = rest[~linked]
    return a, b


def close_in_keys(key: np.ndarray, ids: np.ndarray, sig: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of close pairs of rows that stand by key: all of keys of few rows, a spanning forest of keys of many."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(starts, len(key)))
    size = np.repeat(sizes, sizes)
    a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for step in range(1, min(SMALL, int(sizes.max(initial=1)))):
        x = np.flatnonzero((key[step:] == key[:-step]) & (size[step:] <= SMALL))
        x = x[differing(sig[x], sig[x + step]) <= radius]
        a.append(x)
        b.append(x + step)
    for k in np.flatnonzero(sizes > SMALL):
        mine = starts[k] + np.unique(ids[starts[k] : starts[k] + sizes[k]], return_index=True)[1]
        own = sig[mine]
        x, y = forest(len(mine), lambda i, rest: differing(own[rest], own[i]) <= radius)  # noqa: B023
        a += [mine[v] for v in x]
        b += [mine[v] for v in y]
    return np.concatenate(a), np.concatenate(b)


def _close(positions: int, radius: int):
    """Rows come by (key, i, j)."""

    def run(batches):
        place, ids, sig = np.zeros((0, 3), dtype=np.int64), np.zeros(0, dtype="S16"), np.zeros((0, positions), dtype=np.uint8)

        def flush(until: int):
            number = np.cumsum(np.concatenate([[0], (place[1:until] != place[: until - 1]).any(axis=1)]))
            x, y = close_in_keys(number, ids[:until], sig[:until], radius)
            raw = ids[:until].tobytes()
            found = {(p, q) if p < q else (q, p) for p, q in ((raw[16 * u : 16 * u + 16], raw[16 * v : 16 * v + 16]) for u, v in zip(x.tolist(), y.tolist(), strict=True)) if p != q}
            return pa.record_batch({"a": pa.array([p for p, _ in found], pa.binary()), "b": pa.array([q for _, q in found], pa.binary())})

        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.concatenate([place, np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "i", "j")], axis=1)])
            ids = np.concatenate([ids, np.frombuffer(b"".join(batch["id"].to_pylist()), dtype="S16")])
            sig = np.concatenate([sig, np.frombuffer(b"".join(batch["sig"].to_pylist()), dtype=np.uint8).reshape(-1, positions)])
            last = (place != place[-1]).any(axis=1)
            until = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if until:
                yield flush(until)
                place, ids, sig = place[until:], ids[until:], sig[until:]
        if len(place):
            yield flush(len(place))

    return run


def _two_by_two(rows: DataFrame, chunks, own) -> DataFrame:
    """The rows with (i, j): a row of chunk ``own`` of ``chunks`` goes to its meetings with all chunks, itself included."""
    dealt = rows.withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0), chunks.cast("int") - 1)).alias("other"))
    return dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("own", "other")


def close_pairs(sets: DataFrame, positions: int = POSITIONS, chunks: int = CHUNKS, errors: int = ERRORS, key_rows: int = KEY_ROWS) -> DataFrame:
    """(a, b): pairs of the distinct ``sets`` (id, sig) within the radius that connect whatever all such pairs connect."""
    spark = sets.sparkSession
    rows = keyed(sets.select("id", "sig"), masks(positions, chunks, errors))
    large = common.cut(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > key_rows))
    if large.count() <= LARGE_KEYS:
        large = F.broadcast(large)
    meets = F.ceil(F.coalesce("n", F.lit(1)) / key_rows)
    dealt = _two_by_two(rows.join(large, "key", "left"), meets, F.pmod(F.xxhash64("id"), meets).cast("int")).select("key", "i", "j", "id", "sig")
    place = ["key", "i", "j"]
    return dealt.repartition(common.partitions(spark), *place).sortWithinPartitions(*place).mapInArrow(_close(positions, chunks * (errors + 1) - 1), "a binary, b binary").distinct()


def links_of_sets(sets: list[np.ndarray], positions: int = POSITIONS, radius: int = RADIUS, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among full sets, none of which is empty; among many sets only those within the radius are compared."""
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    flat, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
    sig = signatures(sets, positions) if len(sets) > FEW else None

    def near(k: int, rest: np.ndarray) -> np.ndarray:
        out = 100 * np.minimum(sizes[rest], sizes[k]) >= percent * np.maximum(sizes[rest], sizes[k])
        if sig is not None:
            out[out] = differing(sig[rest[out]], sig[k]) <= radius
        of = rest[out]
        if len(of):
            values, taken = _gather(flat, starts, sizes, of)
            at = np.searchsorted(sets[k], values)
            both = np.add.reduceat(sets[k][np.minimum(at, sizes[k] - 1)] == values, np.cumsum(taken) - taken, dtype=np.int64)
            out[out] = 100 * both >= percent * (taken + sizes[k] - both)
        return out

    a, b = forest(len(sets), near)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _verified(positions: int, radius: int, width: int, percent: int):
    """Rows come by (label, i, j); each such group is compared when it is complete."""

    def run(batches):
        hashes, place, ids, sets = WordHashes(), None, {}, []

        def flush():
            x, y = links_of_sets(sets, positions, radius, percent)
            names = list(ids)
            return pa.record_batch({"a": pa.array([names[k] for k in x.tolist()], pa.binary()), "b": pa.array([names[k] for k in y.tolist()], pa.binary())})

        for batch in batches:
            for part in common.slices([batch]):
                for label, i, j, own, text in zip(*(part[c].to_pylist() for c in ("label", "i", "j", "id", "text")), strict=True):
                    if (label, i, j) != place:
                        if len(sets) > 1:
                            yield flush()
                        place, ids, sets = (label, i, j), {}, []
                    if own not in ids:
                        ids[own] = len(sets)
                        sets.append(shingle_set(text, hashes, width))
        if len(sets) > 1:
            yield flush()

    return run


def links(docs: DataFrame, sets: DataFrame, positions: int = POSITIONS, chunks: int = CHUNKS, errors: int = ERRORS, width: int = WORDS, percent: int = PERCENT, key_rows: int = KEY_ROWS, piece: int = PIECE) -> DataFrame:
    """(a, b): ids of linked sets, confirmed on the full sets, that connect whatever all links connect. ``sets``: (id, sig, n, rep) with a row of ``docs`` for each."""
    spark = docs.sparkSession
    parts = connected(close_pairs(sets, positions, chunks, errors, key_rows)).withColumnRenamed("v", "id")
    members = common.cut(parts.join(sets.select("id", "n", "rep"), "id"))
    totals = members.groupBy("label").agg(F.sum("n").alias("total"))
    placed = common.spread_join(members, totals, "label").select("id", "label", "total", F.col("rep.doc_id").alias("r_id"), F.col("rep.text_hash").alias("r_hash"))
    texts = _plain(docs)
    texts = texts.join(placed, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_hash") == F.col("r_hash")))
    meets = F.ceil(F.col("total") / piece)
    dealt = _two_by_two(texts, meets, F.pmod(F.xxhash64("id"), meets).cast("int")).select("label", "i", "j", "id", "text")
    place = ["label", "i", "j"]
    radius = chunks * (errors + 1) - 1
    return dealt.repartition(common.partitions(spark), *place).sortWithinPartitions(*place).mapInArrow(_verified(positions, radius, width, percent), "a binary, b binary").distinct()


def components(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, n, component_id) of each row of ``docs``."""
    sketched = {k: v for k, v in how.items() if k in ("positions", "width")}
    rows = common.cut(sketches(docs, **sketched))
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("rep")
    full = rows.where("id is not null")
    sets = common.cut(full.groupBy("id").agg(F.min("sig").alias("sig"), F.min("n").alias("n"), rep))
    labels = connected(links(docs, sets, **how)).withColumnRenamed("v", "id")
    firsts = sets.select("id", F.col("rep.doc_id").alias("first")).join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    smallest = firsts.groupBy("label").agg(F.min("first").alias("component_id"))
    of = common.cut(common.spread_join(firsts, smallest, "label").select("id", "component_id"))
    alone = rows.where("id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return common.spread_join(full, of, "id").select("doc_id", "n", "component_id").unionByName(alone)


def op12_minhash(spark, sf_dir: str) -> DataFrame:
    """The contract's query over the whole documents table."""
    found = components(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
