"""Stored queues against lists."""

import pytest
from pyspark.sql import functions as F

from copperbook.operators import queues as qu

SCHEMA = "queue string, data string, at int"


@pytest.fixture
def store(spark, tmp_path):
    qu.open_store(spark, str(tmp_path / "q"))
    return str(tmp_path / "q")


def append(spark, store, *rows):
    qu.append_items(spark, store, spark.createDataFrame([(q, d, n) for n, (q, d) in enumerate(rows)], SCHEMA), ["at"])


def taken(df):
    return [(r.item, r.data) for r in df.collect()]


def test_appends_go_on_and_readers_keep_their_places(spark, store):
    append(spark, store, ("a", "1"), ("b", "x"), ("a", "2"))
    assert taken(qu.read_next(spark, store, "r", "a")) == [(1, "1")]
    append(spark, store, ("a", "3"), ("c", "y"))
    append(spark, store, ("a", "4"), ("a", "5"))
    assert taken(qu.read_next(spark, store, "r", "a", 3)) == [(2, "2"), (3, "3"), (4, "4")]
    assert taken(qu.read_next(spark, store, "s", "a", 2)) == [(1, "1"), (2, "2")]
    assert taken(qu.read_next(spark, store, "r", "a", 9)) == [(5, "5")]
    assert taken(qu.read_next(spark, store, "r", "a", 9)) == []
    append(spark, store, ("a", "6"))
    assert taken(qu.read_next(spark, store, "r", "a", 9)) == [(6, "6")]
    assert taken(qu.items_between(spark, store, "b", 1, 1)) == [(1, "x")]
    assert taken(qu.items_between(spark, store, "none", 1, 5)) == []


def test_a_deleted_queue_begins_again(spark, store):
    append(spark, store, ("a", "1"), ("a", "2"), ("b", "x"))
    qu.delete_queue(spark, store, "a")
    assert taken(qu.items_between(spark, store, "a", 1, 9)) == []
    append(spark, store, ("a", "3"), ("b", "y"))
    assert taken(qu.items_between(spark, store, "a", 1, 9)) == [(1, "3")]
    assert taken(qu.items_between(spark, store, "b", 1, 9)) == [(1, "x"), (2, "y")]


def test_opening_again_changes_nothing(spark, store):
    append(spark, store, ("a", "1"))
    qu.open_store(spark, store)
    assert taken(qu.items_between(spark, store, "a", 1, 9)) == [(1, "1")]


def test_an_append_without_marks_is_not_seen(spark, store):
    append(spark, store, ("a", "1"))
    lost = spark.createDataFrame([("a", 2, "lost")], "queue string, item bigint, data string")
    lost.write.parquet(f"{store}/items/batch=2")
    assert taken(qu.items_between(spark, store, "a", 1, 9)) == [(1, "1")]
    append(spark, store, ("a", "2"))
    assert taken(qu.items_between(spark, store, "a", 1, 9)) == [(1, "1"), (2, "2")]


def test_a_read_opens_only_the_batches_it_needs(spark, store):
    for n in range(4):
        append(spark, store, ("a", str(n)), ("b", str(n)))
    found = qu.items_between(spark, store, "a", 3, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert taken(found) == [(3, "2")] and "PartitionFilters" in plan and "batch" in plan.split("PartitionFilters")[1].split("]")[0]


def test_empty_append(spark, store):
    append(spark, store, ("a", "1"))
    qu.append_items(spark, store, spark.createDataFrame([], SCHEMA), ["at"])
    append(spark, store, ("a", "2"))
    assert taken(qu.read_next(spark, store, "r", "a", 9)) == [(1, "1"), (2, "2")]
    assert qu._live_marks(spark, store).agg(F.max("last")).first()[0] == 2
