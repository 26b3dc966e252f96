"""Cycles are found in tasks, a component whole."""

import random

import pytest

from pipelens.operators import graph


def _never(*_):
    raise AssertionError("not needed here")


def _strong(edges):
    go = {}
    for a, b in edges:
        go.setdefault(a, set()).add(b)
        go.setdefault(b, set())
    def reach(v):
        seen, todo = set(), [v]
        while todo:
            for w in go[todo.pop()] - seen:
                seen.add(w)
                todo.append(w)
        return seen

    far = {v: reach(v) for v in go}
    return {v: min(w for w in far[v] if v in far[w]) for v in go if v in far[v]}


@pytest.mark.parametrize("whole", [100_000, 9])
def test_cycles_by_component(spark, monkeypatch, whole):
    draw = random.Random(11)
    edges = [(f"{c}-{draw.randrange(9):02d}", f"{c}-{draw.randrange(9):02d}") for c in range(25) for _ in range(10)]
    edges += [("x", "x"), ("y", "z"), ("z", "y"), ("z", "y"), ("z", "w"), ("w", "w"), ("q", "r"), ("r", "s")]
    edges += [(f"c{k:02d}", f"c{(k + 1) % 40:02d}") for k in range(40)]
    frame = spark.createDataFrame(edges, "a string, b string")
    parts = graph.components(frame)
    monkeypatch.setattr(graph, "WHOLE", whole)
    if whole > len(edges):
        monkeypatch.setattr(graph, "_colouring", _never)
    rows = graph.strong_components(frame, parts).collect()
    assert len(rows) == len({r["id"] for r in rows}) and {r["id"]: r["component"] for r in rows} == _strong(edges)


def test_a_long_cycle_in_a_task():
    import pyarrow as pa

    n = 30_000
    rows = pa.table({"a": [f"{k:06d}" for k in range(n)], "b": [f"{(k + 1) % n:06d}" for k in range(n)], "component": ["c"] * n})
    found = list(graph._strong(10)(iter(rows.to_batches(max_chunksize=5_000))))
    assert [b.num_rows for b in found] == [n] and set(found[0]["component"].to_pylist()) == {"000000"}
