"""Vector codes against plain arithmetic on whole vectors."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from pipelens.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, error int"


def oracle(rows, entries=256):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label, _ in rows if v and len(v) % 4 == 0 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    v = np.array([r[1] for r in kept], dtype=np.int64)
    w = v.shape[1] // 4
    books = [v[:entries, p * w : (p + 1) * w].copy() for p in range(4)]

    def assign():
        far = [((v[:, None, p * w : (p + 1) * w] - books[p][None]) ** 2).sum(axis=-1) for p in range(4)]
        return [f.argmin(axis=1) for f in far], sum(f.min(axis=1) for f in far)

    for _ in range(4):
        of, _ = assign()
        for p in range(4):
            for e in range(len(books[p])):
                mine = v[of[p] == e][:, p * w : (p + 1) * w]
                if len(mine):
                    books[p][e] = mine.sum(axis=0) // len(mine)
    of, error = assign()
    labels = Counter()
    for r, e in zip(kept, error, strict=True):
        labels[r[2]] += int(e)
    sha = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    return Counter((r[0], "".join(f"{of[p][k]:02x}" for p in range(4)), int(error[k]), labels[r[2]], sha) for k, r in enumerate(kept))


def vectors(n=700):
    rng = random.Random(9)
    rows = [(k, [rng.gauss(0, 0.3) for _ in range(8)], rng.choice([0, 1, 2, None]), 0) for k in range(n)]
    rows += [(1000 + k, rows[3][1], 1, 0) for k in range(300)] + [rows[5], rows[5], (2, [0.5] * 8, 1, 0)]
    rows += [(None, [0.1] * 8, None, 0), (4000, None, 1, 0), (4001, [], 1, 0), (4002, [0.1, None] * 4, 1, 0), (4003, [float("nan")] * 8, 1, 0), (4004, [float("inf")] * 8, 1, 0)]
    rows += [(4005, [0.1] * 12, 1, 0), (-1, [0.1] * 7, 1, 0), (4006, [900.0] * 8, 5, 0), (4007, [-900.0] * 8, 5, 0)]
    rng.shuffle(rows)
    return rows


def found(rows):
    return Counter(tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in rows)


def query(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return vector_codes.op13_vector_codes(spark, str(folder)).collect()


def test_vector_codes(spark, tmp_path):
    rows = vectors()
    assert found(query(spark, tmp_path, rows)) == oracle(rows)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, tmp_path, n):
    rows = [(k, [0.01 * k] * 4, None, 0) for k in range(n)]
    assert found(query(spark, tmp_path, rows)) == (oracle(rows) if n else Counter())


def test_distances_by_tables_are_the_distances():
    rng = np.random.default_rng(2)
    for high in (500, 1 << 23):
        v, entries = rng.integers(-high, high, size=(300, 6)), rng.integers(-high, high, size=(17, 6))
        found_ = [np.unique(v[:, d], return_inverse=True) for d in range(6)]
        got = vector_codes.part_distances([x for x, _ in found_], np.stack([y.reshape(-1) for _, y in found_]), entries)
        assert (got == ((v[:, None] - entries[None]) ** 2).sum(axis=-1)).all()


def test_small_blocks_give_the_same(spark):
    frame = spark.createDataFrame(vectors(), SCHEMA)
    rows = vector_codes._rows(frame)
    first = vector_codes.first_entries(rows)
    a, b = (vector_codes.train(vector_codes.encode(rows, 8, block), first) for block in (50, 4096))
    assert (a == b).all()


def test_too_large_components_are_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="16777216 or more"):
        query(spark, tmp_path, [(1, [1e30] * 4, 0, 0)])


def test_decode_gives_the_entries(spark):
    found_, books = vector_codes.compress(spark.createDataFrame(vectors(), SCHEMA))
    r = found_.where("vec_id = 7").first()
    v = vector_codes.decode(found_, books).where("vec_id = 7").first()["v"]
    own = next(x[1] for x in vectors() if x[0] == 7)
    assert sum((math.floor(1024 * x) - y) ** 2 for x, y in zip(own, v, strict=True)) == r["error"]
