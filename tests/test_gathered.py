"""Frames made at once and read as one."""

from threading import Barrier

from pipelens.operators import graph


def test_frames_are_made_at_once(spark):
    both = Barrier(2, timeout=60)

    def make(k):
        both.wait()
        return spark.range(k, k + 1).selectExpr("id", "id < 0 as odd")

    rows = graph.gathered([lambda: make(1), lambda: make(2), lambda: make(3), lambda: make(4)], at_once=2).collect()
    assert sorted(r["id"] for r in rows) == [1, 2, 3, 4]
