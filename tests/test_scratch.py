"""Scratch tables are gone after the block that made them, and stay after a failure."""

from pathlib import Path

import pytest

from sparklex.plans.components import connected_components
from sparklex.plans.scratch import Scratch, scratch_root, tidy
from sparklex.plans.skew import join_counted


def folders(spark):
    return {p.name for p in Path(scratch_root(spark)).iterdir()}


def test_tidy_deletes_what_the_block_made(spark):
    before = folders(spark)
    keep = Scratch(spark, "keep")
    with tidy(spark):
        edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (None, 7), (8, 8)], "a int, b int")
        roots = keep.save(connected_components(edges), "roots")
        assert len(folders(spark)) > len(before) + 1
    assert folders(spark) - before == {Path(keep.base).name}
    assert sorted(tuple(r) for r in roots.collect()) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)]
    keep.drop(roots)
    with pytest.raises(ZeroDivisionError), tidy(spark):
        Scratch(spark, "failed").save(spark.range(1))
        raise ZeroDivisionError
    assert any(p.startswith("failed") for p in folders(spark))
    assert connected_components(edges.where("a > 100")).count() == 0


@pytest.mark.parametrize("rows", [10, 5_000])
def test_join_counted_is_a_join(spark, rows):
    big = spark.range(rows).selectExpr("id % 3 * (id % 2) as k", "id as v")
    small = big.groupBy("k").count().selectExpr("k", "count as n", "k * 10 as w").where("k <> 1")
    got = sorted(tuple(r) for r in join_counted(big, small, ["k"], "n", rows).select("k", "v", "w").collect())
    assert got == sorted(tuple(r) for r in big.join(small, "k").select("k", "v", "w").collect())
