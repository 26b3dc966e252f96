"""Ways up from objects to the first wanted one, where each has one parent and where some have several."""

import pytest

from pipelens.operators import build, hierarchy


def _expected(objects, parents, wanted):
    def ways(o, seen):
        if o in wanted:
            return [[o]]
        return [[o, *w] for c, p in parents if c == o and p not in seen and p != o for w in ways(p, seen | {p})]

    return {(o, link) for o in objects for w in ways(o, {o}) for link in w}


FOREST = [(f"c{k}", f"c{k + 1}") for k in range(20)] + [("l1", "c3"), ("l2", "c3"), ("a", "b"), ("b", "c"), ("c", "a"), ("t", "a"), ("d1", "d2"), ("s", "s"), ("c20", "e"), ("c7", "c7")]


@pytest.mark.parametrize("more", [[], [("l1", "c9"), ("d2", "c15")]])
def test_links_are_those_on_ways_to_a_goal(spark, more):
    parents = FOREST + more
    objects, wanted = ["c0", "c5", "c20", "e", "l1", "l2", "a", "t", "d1", "s", "none"], {"c20", "c12"}
    got = build.parent_chain(spark.createDataFrame([(o,) for o in objects + ["c0"]], "object_id string"), spark.createDataFrame(parents + parents[:3], "child_id string, parent_id string"), spark.createDataFrame([(w,) for w in wanted], "id string"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == _expected(objects, parents, wanted)


def test_single_parents_need_no_closure(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "closure", lambda edges: pytest.fail("all pairs of a forest are worked out"))
    parents = spark.createDataFrame([("a", "b"), ("b", "c")], "child_id string, parent_id string")
    got = build.parent_chain(spark.createDataFrame([("a",)], "object_id string"), parents, spark.createDataFrame([("c",)], "id string"))
    assert {tuple(r) for r in got.collect()} == {("a", "a"), ("a", "b"), ("a", "c")}
