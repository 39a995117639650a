"""States carried along records, for any number of ranges."""

import random

import pytest
from pyspark.sql import functions as F

from copperbook.operators import ordered as od

SCHEMA = "g string, at int, v int, again boolean"


def rows_for(seed, count=600):
    """A group with more than a third of the rows, small ones, a null one."""
    rng = random.Random(seed)
    groups = ["hot"] * 4 + ["a", "b", "c", None]
    return [
        (rng.choice(groups), at, rng.choice([None, rng.randrange(-50, 50)]), rng.choice([True, None, *[False] * 12]))
        for at in rng.sample(range(10_000), count)
    ]


def by_hand(rows):
    out, state = {}, {}
    for g, at, v, again in sorted(rows, key=lambda r: r[1]):
        if again or g not in state:
            state[g] = []
        if v is not None:
            state[g].append(v)
        held = state[g]
        out[at] = (sum(held), max(held), min(held), held[-1], held[0]) if held else (None,) * 5
    return out


def states():
    v = F.col("v")
    return {"total": (od.TOTAL, v), "most": (od.MOST, v), "least": (od.LEAST, v), "last": (od.LAST, v), "first": (od.FIRST, v)}


@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
def test_any_number_of_ranges(spark, ranges):
    rows = rows_for(3)
    df = spark.createDataFrame(rows, SCHEMA)
    found = od.running_state(df, ["at"], states(), F.col("again"), ("g",), ranges)
    assert found.columns == ["g", "at", "v", "again", "total", "most", "least", "last", "first"]
    assert {r.at: tuple(r)[4:] for r in found.collect()} == by_hand(rows)


def test_one_sequence_without_groups_or_resets(spark):
    rows = [("x", at, v, None) for at, v in enumerate([None, 3, None, 5, -2, None])]
    found = od.running_state(spark.createDataFrame(rows, SCHEMA), ["at"], states(), ranges=4)
    assert [tuple(r)[4:] for r in found.orderBy("at").collect()] == [
        (None,) * 5, (3, 3, 3, 3, 3), (3, 3, 3, 3, 3), (8, 5, 3, 5, 3), (6, 5, -2, -2, 3), (6, 5, -2, -2, 3),
    ]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert od.running_state(df, ["at"], states(), F.col("again"), ("g",)).collect() == []


@pytest.mark.parametrize("test_after", [False, True])
def test_rows_until(spark, test_after):
    rows = rows_for(5)
    df = spark.createDataFrame(rows, SCHEMA)
    found = od.rows_until(df, ["at"], F.col("v") > 45, ("g",), test_after)
    wanted, done = set(), set()
    for g, at, v, _ in sorted(rows, key=lambda r: r[1]):
        holds = v is not None and v > 45
        if g not in done and (test_after or not holds):
            wanted.add(at)
        if holds:
            done.add(g)
    assert {r.at for r in found.collect()} == wanted


def test_no_window_over_a_whole_group(spark):
    df = spark.createDataFrame(rows_for(1, 50), SCHEMA)
    plan = od.running_state(df, ["at"], states(), F.col("again"), ("g",), 4)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    # rows by range, and the one row of each range in the order of ranges
    assert windows and all("__range" in line for line in windows)
