"""EVALUATE with ranges, SEARCH by bisection, against loops."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from copperbook.functions import fields as fl
from copperbook.operators import records as rc


def first_when(values, whens, other):
    for _, *bounds, then in sorted(whens, key=lambda w: w[0]):
        for value, low, high in zip(values, bounds[::2], bounds[1::2]):
            if low is None and high is None:
                continue
            if value is None or (low is not None and value < low) or (high is not None and value > high):
                break
        else:
            return then
    return other


@pytest.mark.parametrize("subjects", [1, 2, 3])
def test_against_a_loop(spark, subjects):
    rng = random.Random(subjects)
    maybe = lambda v: None if rng.random() < 0.15 else v
    whens = []
    for place in range(80):
        bounds = []
        for _ in range(subjects):
            low = rng.randrange(60)
            bounds += [maybe(low), maybe(low + rng.choice([0, 0, 1, 5, -3]))]
        whens.append((place, *bounds, f"w{place}"))
    rng.shuffle(whens)
    names = ["place"] + [f"{s}_{i}" for i in range(1, subjects + 1) for s in ("low", "high")] + ["then"]
    rows = [(n, *[maybe(rng.randrange(-3, 70)) for _ in range(subjects)]) for n in range(400)]
    columns = ["n"] + [f"s{i}" for i in range(subjects)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in columns))
    table = spark.createDataFrame(whens, ", ".join(f"{c} {'string' if c == 'then' else 'int'}" for c in names))
    found = rc.evaluate_ranges(df, columns[1:], table, "rate", "other")
    assert found.columns == [*columns, "rate"]
    assert {r.n: r.rate for r in found.collect()} == {n: first_when(v, whens, "other") for n, *v in rows}


def test_text_subjects_and_no_whens(spark):
    df = spark.createDataFrame([("apple",), ("b",), ("mango",), (None,)], "s string")
    whens = spark.createDataFrame([(1, "a", "b", "first"), (2, "m", "m", "never"), (3, "l", "n", "third")], "place int, low_1 string, high_1 string, then string")
    found = rc.evaluate_ranges(df, ["s"], whens, "rate").collect()
    assert sorted(found, key=str) == sorted([("apple", "first"), ("b", "first"), ("mango", "third"), (None, None)], key=str)
    none = rc.evaluate_ranges(df, ["s"], whens.limit(0), "rate", "x").collect()
    assert {r.rate for r in none} == {"x"}


def test_plan_joins_by_equality(spark):
    df = spark.range(10).withColumnRenamed("id", "s")
    whens = spark.range(1000).selectExpr("id AS place", "id * 3 AS low_1", "id * 3 + 1 AS high_1", "id AS then")
    plan = rc.evaluate_ranges(df, ["s"], whens, "rate")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_lists_are_not_sent_to_every_task(spark):
    df = spark.range(10).selectExpr("id AS s", "id AS t")
    whens = spark.range(20).selectExpr("id AS place", "0L AS low_1", "id AS high_1", "id AS low_2", "id AS high_2", "id AS then")
    found = rc.evaluate_ranges(df, ["s", "t"], whens, "rate")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {r.s: r.rate for r in found.collect()} == {n: n for n in range(10)}


def test_wide_ranges_make_no_lists(spark):
    """Every WHEN covers every value; neither rows nor points hold lists of them."""
    df = spark.range(60).selectExpr("id * 50 AS s", "id % 7 AS t")
    whens = spark.range(3000).selectExpr("3000 - id AS place", "-id AS low_1", "9000 + id AS high_1", "id % 7 AS low_2", "id % 7 AS high_2", "id AS then")
    found = rc.evaluate_ranges(df, ["s", "t"], whens, "rate")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_" not in plan and "ubquery" not in plan
    assert {(r.t, r.rate) for r in found.collect()} == {(t, max(n for n in range(3000) if n % 7 == t)) for t in range(7)}


@pytest.mark.parametrize("top", [0, 1, 2, 3, 14, 15, 16, 61, 64])
def test_nodes_cover_a_range_once(spark, top):
    pairs = spark.range(-1, top + 1).selectExpr("id AS a").crossJoin(spark.range(-1, top + 1).selectExpr("id AS b")).where("a <= b")
    ranges = pairs.select("a", "b", rc._nodes_of_range(F.col("a"), F.col("b"), top).alias("nodes"))
    under = {r.id: r.nodes for r in spark.range(-1, top + 1).select("id", rc._nodes_of_code(F.col("id"), top).alias("nodes")).collect()}
    for r in ranges.collect():
        assert {x for x, nodes in under.items() for n in nodes if n in r.nodes} == set(range(r.a, r.b + 1))
        assert sum(n in r.nodes for nodes in under.values() for n in nodes) == r.b - r.a + 1


def test_numbers_that_are_none_and_whens_without_place(spark):
    nan = float("nan")
    df = spark.createDataFrame([(-0.0,), (0.0,), (nan,), (5.0,), (None,)], "s double")
    whens = spark.createDataFrame([(2, 0.0, 0.0, "zero"), (1, nan, None, "nan"), (None, 0.0, 5.0, "nowhere")], "place int, low_1 double, high_1 double, then string")
    found = rc.evaluate_ranges(df, ["s"], whens, "rate", "other").collect()
    assert sorted((str(r.s), r.rate) for r in found) == [("-0.0", "zero"), ("0.0", "zero"), ("5.0", None), ("None", "other"), ("nan", "nan")]


def test_search_all(spark):
    rng = random.Random(9)
    rows = [(n, sorted(rng.choices(range(50), k=rng.randrange(30))), rng.randrange(-2, 53)) for n in range(300)]
    df = spark.createDataFrame(rows, "n int, items array<int>, key int")
    up = fl.search_all(F.col("items"), F.col("key"))
    down = fl.search_all(F.reverse("items"), F.col("key"), descending=True)
    for r in df.select("*", up.alias("up"), down.alias("down")).collect():
        at = bisect.bisect_left(r["items"], r.key)
        assert r.up == (at + 1 if r.key in r["items"] else None)
        assert r.down == (r["items"][::-1].index(r.key) + 1 if r.key in r["items"] else None)


def test_search_varying_starts_and_stops(spark):
    df = spark.createDataFrame([([1, 0, 4, 2],)], "items array<int>")
    # elements behind the hit are not tested: 8 / 0 would fail
    hit = fl.search_table(F.col("items"), lambda x: 8 / x > 4)
    later = fl.search_table(F.col("items"), lambda x: x > 0, 2)
    beyond = fl.search_table(F.col("items"), lambda x: x > 0, 9)
    until = fl.perform_until(F.col("items"), lambda x: x == 0)
    assert tuple(df.select(hit, later, beyond, until).first()) == (1, 4, None, [1])
