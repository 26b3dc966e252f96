"""Near-dedup by MinHash signatures against sets of shingles compared one by one."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from pipelens.llm import minhash

from . import fixture
from .test_operators import WORD, lower


def shingles(text):
    words = WORD.findall(lower(text or ""))
    return frozenset(tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3))) if words else frozenset()


def oracle(docs):
    """(doc_id, n_shingles, component_id, kept) of each row."""
    sets = [shingles(d[1]) for d in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, d in enumerate(docs):
        if d[0] is not None:
            least[root(k)].append(d[0])
    return Counter((d[0], len(sets[k]), c := min(least[root(k)], default=None), d[0] == c) for k, d in enumerate(docs))


def found(rows):
    return Counter(tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in rows)


def near_copies(n=12, words=60, seed=3):
    """A chain and a star of texts at about the threshold, and texts that share a passage only."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(words)]
    out, chain = [], list(base)
    for k in range(n):
        chain = list(chain)
        chain[rng.randrange(words)] = word()
        star = list(base)
        star[rng.randrange(words)] = word()
        out += [" ".join(chain), " ".join(star), " ".join([*base[:20], *[word() for _ in range(40)]])]
    return [(k, t, "en", "src", 0) for k, t in enumerate(out)]


def test_minhash(spark, tmp_path):
    docs = fixture.documents()
    assert found(minhash.op12_minhash(spark, fixture.tables(spark, tmp_path, docs)).collect()) == oracle(docs)


@pytest.mark.parametrize(("key_rows", "piece"), [(20, 1000)])
def test_no_link_between_texts_is_lost(spark, key_rows, piece):
    docs = near_copies() + [(1000 + k, t, "en", "src", 0) for k, t in enumerate(["one two", "ONE two", "one two three", " \t", None, "a b c d", "a b c d"])]
    rows = minhash.components(fixture.frame(spark, docs), key_rows=key_rows, piece=piece).selectExpr("doc_id", "n as n_shingles", "component_id", "doc_id <=> component_id as kept").collect()
    assert found(rows) == oracle(docs)


def test_keys_guarantee_all_pairs_within_the_radius(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 256, size=(30, minhash.POSITIONS)).astype(np.uint8)
    sig, at = [], []
    for row in base:
        for k in range(6):
            other = row.copy()
            places = rng.permutation(minhash.POSITIONS)[: rng.integers(0, minhash.RADIUS + 1) if k else 0]
            other[places] += 1
            sig.append(other)
            at.append(len(at))
    sig = np.array(sig)
    rows = spark.createDataFrame([(bytes([0] * 14 + [k // 256, k % 256]), s.tobytes()) for k, s in enumerate(sig)], "id binary, sig binary")
    keys = defaultdict(set)
    for r in minhash.keyed(rows, minhash.masks()).collect():
        keys[bytes(r["id"])[-1] + 256 * bytes(r["id"])[-2]].add(r["key"])
    near = [(a, b) for a in range(len(sig)) for b in range(a) if (sig[a] != sig[b]).sum() <= minhash.RADIUS]
    assert len(near) > 200 and all(keys[a] & keys[b] for a, b in near)


def test_signatures_estimate_likeness():
    rng = np.random.default_rng(1)
    whole = np.unique(rng.integers(0, 2**63, size=1200, dtype=np.uint64))
    a, b = np.sort(whole[:1000]), np.sort(whole[200:])
    sig = minhash.signatures([a, b, a], 1000)
    same = (sig[0] == sig[1]).mean()
    assert abs(same - 800 / 1200) < 0.06 and (sig[0] == sig[2]).all()


def test_empty_table_and_clashing_columns(spark, tmp_path):
    assert minhash.op12_minhash(spark, fixture.tables(spark, tmp_path, [])).count() == 0
    assert minhash.components(fixture.clashing(spark)).count() == len(fixture.documents())
