"""Differences of two states of files, against an edit made by hand."""

import itertools
import random

from pyspark.sql import functions as F

from copperbook.operators import differences as df
from copperbook.plans import estate_queries

SCHEMA = "path string, name string, n int, pic string, use string"


def diff(spark, a, b):
    """From {path: [(name, pic, use), ...]} on both sides to rows without the path."""

    def rows(side):
        return spark.createDataFrame(
            [(path, name, i + 1, pic, use) for path, items in side.items() for i, (name, pic, use) in enumerate(items)], SCHEMA
        )

    found = df.diff_rows(rows(a), rows(b), "name", "n", ("pic", "use"))
    return sorted((tuple(r) for r in found.collect()), key=str)


A = [("A", "X", ""), ("B", "9", None), ("C", "X(2)", "COMP"), ("D", "X", "")]


def test_equal_and_empty(spark):
    assert diff(spark, {"p": A}, {"p": A}) == []
    assert diff(spark, {}, {}) == []


def test_fields_with_both_values(spark):
    b = [("A", "X", ""), ("B", "99", "COMP"), ("C", "X(2)", None), ("D", "X", "")]
    assert diff(spark, {"p": A}, {"p": b}) == [
        ("p", "changed", "B", 2, 2, "pic", "9", "99"),
        ("p", "changed", "B", 2, 2, "use", None, "COMP"),
        ("p", "changed", "C", 3, 3, "use", "COMP", None),
    ]


def test_added_removed_and_files_of_one_side(spark):
    b = [("A", "X", ""), ("N", "X", ""), ("C", "X(2)", "COMP"), ("D", "X", "")]
    assert diff(spark, {"p": A, "q": A[:1]}, {"p": b, "r": A[1:2]}) == [
        ("p", "added", "N", None, 2, None, None, None),
        ("p", "removed", "B", 2, None, None, None, None),
        ("q", "removed", "A", 1, None, None, None, None),
        ("r", "added", "B", None, 1, None, None, None),
    ]


def test_one_moved_item_is_one_row(spark):
    b = [A[1], A[2], A[3], A[0]]
    assert diff(spark, {"p": A}, {"p": b}) == [("p", "moved", "A", 1, 4, None, None, None)]


def test_moved_and_changed(spark):
    b = [("D", "9", ""), A[0], A[1], A[2]]
    assert diff(spark, {"p": A}, {"p": b}) == [
        ("p", "changed", "D", 4, 1, "pic", "X", "9"),
        ("p", "moved", "D", 4, 1, None, None, None),
    ]


def test_repeated_names_match_by_declaration_first(spark):
    a = [("FILLER", "X(1)", ""), ("FILLER", "X(2)", ""), ("K", "9", ""), ("FILLER", "X(2)", ""), ("FILLER", "X(3)", "")]
    b = a[1:]
    assert diff(spark, {"p": a}, {"p": b}) == [("p", "removed", "FILLER", 1, None, None, None, None)]
    b = [*a[:3], ("FILLER", "X(9)", ""), a[4]]
    assert diff(spark, {"p": a}, {"p": b}) == [("p", "changed", "FILLER", 4, 4, "pic", "X(2)", "X(9)")]


def longest(places):
    """Length of the longest rising subsequence, by trying all."""
    for size in range(len(places), 0, -1):
        if any(list(c) == sorted(c) for c in itertools.combinations(places, size)):
            return size
    return 0


def test_longest_order_is_kept(spark):
    rng = random.Random(4)
    rows = [(k, rng.sample(range(20), rng.randrange(11))) for k in range(60)] + [(60, [3])]
    found = spark.createDataFrame(rows, "k int, places array<int>").withColumn("kept", df._kept_order(F.col("places")))
    for r in found.collect():
        kept = [p for p, ok in zip(r.places, r.kept) if ok]
        assert kept == sorted(kept) and len(kept) == longest(r.places)


def test_only_changed_files_go_on(spark):
    a = spark.createDataFrame([("same", "x"), ("none", None), ("new text", "x"), ("gone", "x"), ("lost", "x")], "path string, text string")
    b = spark.createDataFrame([("same", "x"), ("none", None), ("new text", "y"), ("come", "x"), ("lost", None)], "path string, text string")
    was, now = df.changed_sources(a, b)
    assert sorted(r.path for r in was.collect()) == ["gone", "lost", "new text"]
    assert sorted(r.path for r in now.collect()) == ["come", "lost", "new text"]


def test_texts_are_not_shuffled_to_be_compared(spark):
    a = spark.range(5).selectExpr("string(id) AS path", "repeat(string(id), 10) AS text")
    was, _ = df.changed_sources(a, a.withColumn("text", F.concat("text", F.lit("x"))))
    plan = was._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan and "Exchange hashpartitioning" not in plan
    assert was.count() == 5


def test_items_of_programs(spark, sources):
    text = """       IDENTIFICATION DIVISION.
       PROGRAM-ID. P.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
       01  REC.
           05  A PIC X(3).
           05  B PIC 9(2) VALUE 7.
       77  C PIC X.
"""
    other = text.replace("VALUE 7", "VALUE 8").replace("       77  C PIC X.\n", "       77  D PIC X.\n")
    found = df.diff_items(sources({"p": text, "q": text}), sources({"p": other, "q": text}))
    assert sorted((tuple(r) for r in found.collect()), key=str) == [
        ("p", "added", "D", None, 4, None, None, None),
        ("p", "changed", "B", 3, 3, "value", "7", "8"),
        ("p", "removed", "C", 4, None, None, None, None),
    ]


def test_matched_rows_are_not_sent_to_every_task(spark):
    rows = spark.createDataFrame([("p", "A", 1, "X", "")], SCHEMA)
    found = df.diff_rows(rows, rows.withColumn("pic", F.lit("9")), "name", "n", ("pic", "use"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert [r.value_b for r in found.collect()] == ["9"]


def test_estates_are_compared_without_the_places_of_items(spark, sf_dir):
    found = estate_queries.diff_estates(spark, sf_dir)
    assert "depth" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() > 0
