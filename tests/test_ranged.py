"""Keyed tables by key range: changes against a dict, browses against a sorted list."""

import glob
import os
import random
import re

import pytest

from copperbook.operators import ranged as rg

SCHEMA = "k long, name string, n int"


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "table")


def rows_of(spark, path):
    return sorted(map(tuple, rg.read_ranges(spark, path).select("k", "name", "n").collect()))


def files(path):
    return {os.path.dirname(f): {*glob.glob(f"{os.path.dirname(f)}/*.parquet")} for f in glob.glob(f"{path}/rows/*/*.parquet")}


def made(spark, path, count=1000, per_range=100):
    rows = [(10 * k, f"n{k}", k) for k in range(count)]
    rg.write_ranges(spark.createDataFrame(rows, SCHEMA), path, ["k"], per_range)
    return {r[0]: r for r in rows}


def test_layout_follows_the_key(spark, path):
    made(spark, path)
    seen = []
    for folder in sorted(files(path), key=lambda f: int(f.rsplit("=", 1)[1])):
        keys = [r.k for r in spark.read.parquet(folder).collect()]
        assert keys == sorted(keys)
        seen += keys
    assert seen == [10 * k for k in range(1000)] and len(files(path)) == 10


def test_rounds_of_changes(spark, path):
    table, rng = made(spark, path), random.Random(1)
    for _ in range(3):
        log = []
        for seq in range(60):
            k = rng.choice([*range(-50, 500, 5), *range(9900, 10100, 5)])
            op = rng.choice(["WRITE", "REWRITE", "DELETE"])
            row = (k, f"x{seq}", rng.choice([None, seq]))
            log.append((*row, seq, op))
            if op == "DELETE":
                table.pop(k, None)
            elif op == "WRITE" or k in table:
                table[k] = row
        df = spark.createDataFrame(log, SCHEMA + ", seq int, op string")
        rg.change_ranges(spark, path, df, ["k"])
        assert rows_of(spark, path) == sorted(table.values())
        rg.change_ranges(spark, path, df, ["k"])
        assert rows_of(spark, path) == sorted(table.values())


def test_untouched_ranges_keep_their_files(spark, path):
    made(spark, path)
    before = files(path)
    rg.merge_ranges(spark, path, spark.createDataFrame([(1005, "new", 1), (1010, "old", 2)], SCHEMA), ["k"])
    after = files(path)
    changed = [f for f in before if before[f] != after[f]]
    assert len(changed) == 1 and before.keys() == after.keys()


def test_a_range_can_be_emptied_and_filled(spark, path):
    table = made(spark, path)
    gone = spark.range(1000, 2000).withColumnRenamed("id", "k")
    rg.delete_ranges(spark, path, gone, ["k"])
    left = sorted(r for k, r in table.items() if not 1000 <= k < 2000)
    assert rows_of(spark, path) == left
    page, place = rg.read_next(spark, path, ["k"], rg.start_browse(990), 3)
    assert [r.k for r in page.collect()] == [990, 2000, 2010]
    rg.rewrite_ranges(spark, path, spark.createDataFrame([(1500, "no", 1)], SCHEMA), ["k"])
    assert rows_of(spark, path) == left
    rg.merge_ranges(spark, path, spark.createDataFrame([(1500, "yes", 1)], SCHEMA), ["k"])
    assert rows_of(spark, path) == sorted([*left, (1500, "yes", 1)])


def test_no_changes(spark, path):
    table = made(spark, path, 20, 5)
    rg.merge_ranges(spark, path, spark.createDataFrame([], SCHEMA), ["k"])
    assert rows_of(spark, path) == sorted(table.values())


def test_last_row_of_a_key_stands(spark, path):
    made(spark, path, 20, 5)
    rows = spark.createDataFrame([(50, "a", 1, 2), (50, "b", 2, 1)], SCHEMA + ", seq int")
    rg.rewrite_ranges(spark, path, rows, ["k"], "seq")
    assert (50, "a", 1) in rows_of(spark, path)


def keys_of(page):
    return [r.k for r in page.collect()]


def test_browse_goes_on_both_ways(spark, path):
    table = sorted(made(spark, path))
    at, place, seen = 333, rg.start_browse(3330), []
    for n in (1, 150, 7, 260):
        page, place = rg.read_next(spark, path, ["k"], place, n)
        seen += keys_of(page)
    assert seen == table[at : at + len(seen)] and len(seen) == 418
    page, place = rg.read_next(spark, path, ["k"], place, 300, backward=True)
    end = at + len(seen) - 1
    assert keys_of(page) == table[end - 300 : end][::-1]
    page, place = rg.read_next(spark, path, ["k"], place, 2)
    assert keys_of(page) == table[end - 299 : end - 297]


@pytest.mark.parametrize(
    "start, n, backward, expected",
    [
        (-5, 2, False, [0, 10]),
        (-5, 2, True, []),
        (0, 2, True, [0]),
        (9985, 5, False, [9990]),
        (10**6, 2, False, []),
        (10**6, 2, True, [9990, 9980]),
        (505, 2, False, [510, 520]),
        (505, 2, True, [500, 490]),
    ],
)
def test_ends_and_gaps(spark, path, start, n, backward, expected):
    made(spark, path)
    page, place = rg.read_next(spark, path, ["k"], rg.start_browse(start), n, backward)
    assert keys_of(page) == expected
    assert place == (rg.Place((expected[-1],)) if expected else rg.start_browse(start))


def test_a_page_reads_two_ranges_at_most(spark, path):
    made(spark, path)
    page, _ = rg.read_next(spark, path, ["k"], rg.start_browse(3330), 90)
    plan = page._jdf.queryExecution().executedPlan().toString()
    low, high = (int(re.search(rf"key_range#\d+ {op} (\d+)", plan)[1]) for op in (">=", "<="))
    assert high - low <= 1 and "Exchange" not in plan
    assert len(keys_of(page)) == 90


def test_keys_of_several_columns(spark, path):
    rows = [(a, b, f"{a}{b}") for a in range(40) for b in "xyz"]
    rg.write_ranges(spark.createDataFrame(rows, "a int, b string, v string"), path, ["a", "b"], 10)
    page, place = rg.read_next(spark, path, ["a", "b"], rg.start_browse(7, "y"), 4)
    assert [(r.a, r.b) for r in page.collect()] == [(7, "y"), (7, "z"), (8, "x"), (8, "y")]
    rg.delete_ranges(spark, path, spark.createDataFrame([(8, "z")], "a int, b string"), ["a", "b"])
    page, _ = rg.read_next(spark, path, ["a", "b"], place, 2)
    assert [(r.a, r.b) for r in page.collect()] == [(9, "x"), (9, "y")]


def test_empty_table(spark, path):
    rg.write_ranges(spark.createDataFrame([], SCHEMA), path, ["k"])
    page, place = rg.read_next(spark, path, ["k"], rg.start_browse(1), 3)
    assert keys_of(page) == [] and place == rg.start_browse(1)
    rg.merge_ranges(spark, path, spark.createDataFrame([(1, "a", None)], SCHEMA), ["k"])
    assert rows_of(spark, path) == [(1, "a", None)]


def test_many_ranges_send_little_to_the_driver(spark, tmp_path):
    path, context = str(tmp_path / "many"), spark.sparkContext
    context.setJobGroup("many ranges", "")
    try:
        rg.write_ranges(spark.range(300).withColumnRenamed("id", "k"), path, ["k"], 2)
        page, _ = rg.read_next(spark, path, ["k"], rg.start_browse(100), 5)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert [r.k for r in page.collect()] == [100, 101, 102, 103, 104]
    tracker = context.statusTracker()
    infos = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("many ranges") for s in tracker.getJobInfo(j).stageIds]
    listed = [i.numTasks for i in infos if i and i.name.startswith("parquet at")]
    assert listed and sum(n > 4 * context.defaultParallelism for n in listed) <= 1  # but the write itself


def test_only_the_log_looks_for_its_ranges(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rg.write_ranges(spark.range(0, 1000, 10).selectExpr("id", "'old' AS v"), path, ["id"], 20)
    sought = []

    def in_range(df, *rest):
        sought.append(df.count())
        return found(df, *rest)

    found = rg._in_range
    monkeypatch.setattr(rg, "_in_range", in_range)
    log = [(-5, "new", 1, "WRITE"), (10, "new", 1, "REWRITE"), (15, "new", 1, "WRITE"), (20, None, 1, "DELETE"), (5000, "new", 1, "WRITE")]
    rg.change_ranges(spark, path, spark.createDataFrame(log, "id long, v string, seq int, op string"), ["id"])
    assert sought == [5]
    kept = {k: "old" for k in range(0, 1000, 10) if k not in (10, 20)}
    assert {r.id: r.v for r in rg.read_ranges(spark, path).collect()} == kept | {k: "new" for k in (-5, 10, 15, 5000)}
    # each record lies where its key is looked for
    rows = rg._rows(spark, path)
    again = found(rows.withColumnRenamed("key_range", "lies"), path, ["id"])
    assert again.where("lies <> key_range").count() == 0 and rows.select("key_range").distinct().count() > 3
