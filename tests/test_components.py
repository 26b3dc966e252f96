"""Components: near pairs are joined up by tasks, what was seen apart in rounds."""

import random

from pipelens.operators import graph


def _brute(pairs):
    root = {}

    def top(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in pairs:
        p, q = sorted((top(a), top(b)))
        root[q] = p
    return {v: top(v) for v in list(root)}


def _found(spark, pairs):
    return {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "a string, b string")).collect()}


def test_chains_of_near_ids_take_no_rounds(spark, monkeypatch):
    cuts, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: cuts.append(1) or cut(df))
    pairs = [(f"N{k}", f"N{k + 1}") for k in range(2000) if k % 100 != 99]
    assert _found(spark, pairs) == _brute(pairs)
    assert len(cuts) <= 3


def test_components_of_far_ids_loops_hubs_and_odd_names(spark, monkeypatch):
    monkeypatch.setattr(graph, "LOCAL", 7, raising=False)
    rng = random.Random(3)
    pairs = [(f"v{rng.randrange(900)}", f"v{rng.randrange(900)}") for _ in range(500)] + [("hub", f"é{k}") for k in range(40)]
    pairs += [("alone", "alone"), ("", "x"), ("\U0001f600", "￮"), ("v1", "v1")] + [(f"w{k * 37 % 100}", f"w{(k + 1) * 37 % 100}") for k in range(99)]
    rng.shuffle(pairs)
    assert _found(spark, pairs) == _brute(pairs)
    assert _found(spark, [(None, "a"), ("a", "b")]) == {"a": "a", "b": "a"}
    assert _found(spark, []) == {}
