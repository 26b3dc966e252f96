"""Reach is worked out in tasks, a component whole; only large components cost rounds of joins."""

import random

import pytest

from pipelens.operators import graph, network


def _reached(edges, goals):
    into, seen, todo = {}, set(goals), list(goals)
    for a, b in edges:
        into.setdefault(b, []).append(a)
    while todo:
        for a in into.get(todo.pop(), ()):
            if a not in seen:
                seen.add(a)
                todo.append(a)
    return seen


def _frames(spark, edges, goals):
    frame = spark.createDataFrame(edges, "a string, b string")
    parts = graph.components(frame)
    return frame, spark.createDataFrame([(v,) for v in goals], "id string"), parts


def _never(*_):
    raise AssertionError("not needed here")


def test_small_components_cost_no_rounds(spark, monkeypatch):
    draw = random.Random(5)
    edges = [(f"{c}-{draw.randrange(12)}", f"{c}-{draw.randrange(12)}") for c in range(80) for _ in range(14)]
    edges += [("x", "x"), ("x", "y"), ("x", "y"), ("y", "x")]
    goals = [f"{c}-{draw.randrange(12)}" for c in range(0, 80, 2)] + ["alone", "y", "y"]
    frames = _frames(spark, edges, goals)
    monkeypatch.setattr(graph, "_jumping", _never)
    got = [r["id"] for r in graph.reaching(*frames).collect()]
    assert len(got) == len(set(got)) and set(got) == _reached(edges, goals)


@pytest.mark.parametrize("whole", [1, 5, 20])
def test_large_components_go_to_rounds(spark, monkeypatch, whole):
    chain = [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(60)]
    edges = chain + [("c059", "c000"), ("p", "q"), ("q", "r"), ("s", "r"), ("t", "u")]
    goals = ["c030", "r", "lone"]
    frames = _frames(spark, edges, goals)
    monkeypatch.setattr(graph, "WHOLE", whole)
    got = [r["id"] for r in graph.reaching(*frames).collect()]
    assert len(got) == len(set(got)) and set(got) == _reached(edges, goals)


def test_components_are_whole_in_a_task():
    import pyarrow as pa

    rows = [(f"{c}{k}", f"{c}{k + 1}", c) for c in "abcd" for k in range(7)] + [(f"{c}7", None, c) for c in "abd"]
    rows.sort(key=lambda r: r[2])
    table = pa.table({n: pa.array(list(v), pa.string()) for n, v in zip(("a", "b", "component"), zip(*rows))})
    for size in (1, 8, 9, 100):
        for step in (1, 3, 50):
            got = sorted(v for batch in graph._reached(size)(iter(table.to_batches(max_chunksize=step))) for v in batch["id"].to_pylist())
            assert got == sorted(f"{c}{k}" for c in "abd" for k in range(7)), (size, step)


def test_the_network_uses_its_components(spark, monkeypatch):
    import os

    from pipelens.plans import projection

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("the given tables are not here")
    t = projection._build(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(graph, "_jumping", _never)
    assert network.reach(t, ("Gemaal",)).count() > 0
