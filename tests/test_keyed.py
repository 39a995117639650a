"""Keyed tables, queues, embedded SQL and the streams that feed them."""

import random

import pytest

from copperbook.operators import keyed as ky
from copperbook.streaming import changes


def _rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_read_write_rewrite_delete(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    asked = spark.createDataFrame([(2,), (9,), (2,)], "k int")
    assert _rows(ky.keyed_read(asked, table, "k"), "k") == [(2, "b", "00"), (2, "b", "00"), (9, None, "23")]
    rows = spark.createDataFrame([(2, None), (9, "z")], "k int, v string")
    assert _rows(ky.keyed_rewrite(table, rows, "k"), "k") == [(1, "a"), (2, None), (3, "c")]
    assert _rows(ky.duplicate_keys(ky.keyed_write(table, rows), "k"), "k") == [(2, 2, "22")]
    assert _rows(ky.keyed_delete(table, asked, "k"), "k") == [(1, "a"), (3, "c")]


def _replayed(table, log):
    state = dict(table)
    for key, _, op, value in sorted(log, key=lambda r: r[1]):
        if op == "DELETE":
            state.pop(key, None)
        elif op == "WRITE" or key in state:
            state[key] = value
    return sorted(state.items())


def _log(rng, n):
    seqs = rng.sample(range(n * 3), n)
    return [
        (1 if rng.random() < 0.4 else rng.randint(0, 40), s, rng.choice(["WRITE", "REWRITE", "DELETE"]), rng.choice(["x", "y", None]))
        for s in seqs
    ]


def test_apply_changes_matches_a_replay(spark):
    rng = random.Random(2)
    table = [(k, f"v{k}") for k in range(0, 40, 2)]
    log = _log(rng, 400)
    got = ky.apply_changes(
        spark.createDataFrame(table, "k int, v string"), spark.createDataFrame(log, "k int, seq int, op string, v string"), "k"
    )
    assert _rows(got, "k") == _replayed(table, log)


def test_streamed_changes_match_a_replay_whatever_the_batches(spark, tmp_path):
    rng = random.Random(4)
    table = [(k, f"v{k}") for k in range(0, 40, 2)]
    log = _log(rng, 300)
    base = spark.createDataFrame(table, "k int, v string")
    frame = spark.createDataFrame(log, "k int, seq int, op string, v string").repartition(5)
    frame.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    root = str(tmp_path / "table")
    for _ in range(2):  # the second run finds nothing new
        changes.start_changes(stream, root, "k", str(tmp_path / "checkpoint")).awaitTermination()
    assert _rows(changes.current(spark, base, root, "k"), "k") == _replayed(table, log)
    compacted = changes.compact(spark, base, root, "k", str(tmp_path / "base2"))
    assert _rows(compacted, "k") == _replayed(table, log)
    assert changes.compact(spark, base, root, "k", str(tmp_path / "base3")).count() == len(_replayed(table, log))
    later = [(k, s + 10_000, op, v) for k, s, op, v in _log(rng, 60)]
    spark.createDataFrame(later, frame.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    changes.start_changes(stream, root, "k", str(tmp_path / "checkpoint")).awaitTermination()
    assert _rows(changes.current(spark, base, root, "k"), "k") == _replayed(table, log + later)
    assert changes.changes_after(spark, root, 4).count() == len({r[0] for r in later})


def test_several_rows_for_a_key(spark):
    table = spark.createDataFrame([(1, "a", "o"), (2, "b", "o")], "k int, v string, op string")
    rows = spark.createDataFrame([(1, "x", "p", 2), (1, "y", "p", 1), (9, "z", "p", 1)], "k int, v string, op string, seq int")
    assert _rows(ky.keyed_rewrite(table, rows, "k", "seq"), "k") == [(1, "x", "p"), (2, "b", "o")]
    assert _rows(ky.keyed_rewrite(table, rows, "k"), "k") == [(1, "y", "p"), (2, "b", "o")]
    assert _rows(ky.sql_merge(table, rows, "k", "seq"), "k") == [(1, "x", "p"), (2, "b", "o"), (9, "z", "p")]
    assert [r["k"] for r in ky.duplicate_keys(rows, "k").collect()] == [1]


def test_quoted_text_of_embedded_sql_stays(spark):
    t = spark.createDataFrame([(1, "a")], "id int, name string")
    row = ky.sql_select_into(
        spark, "SELECT ':NOT-ONE', '10:20-03', NAME INTO :A, :B, :C FROM {t} WHERE ID = :WS-ID ORDER BY ID", {"WS-ID": 1}, t=t
    )
    assert tuple(row.first()) == (":NOT-ONE", "10:20-03", "a")


def test_merge_and_dml(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    source = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert _rows(ky.sql_merge(table, source, "k"), "k") == [(1, "a"), (2, "B"), (3, "C")]
    nulls = spark.createDataFrame([(1, None), (2, "b")], "k int, v string")
    assert _rows(ky.sql_delete(nulls, nulls.v == "b"), "k") == [(1, None)]


def test_browse_and_organize(spark):
    table = spark.createDataFrame([(k, 100 - k) for k in range(20)] + [(5, 0)], "k int, v int")
    assert [r["k"] for r in ky.browse(table.distinct(), "k", 7, 3).collect()] == [7, 8, 9]
    assert [r["k"] for r in ky.browse(table, "k", 1, 5, backward=True).collect()] == [1, 0]
    flags = ky.organize(table, "KSDS", ["k"]).where("NOT unique_key").count()
    assert flags == 2
    numbered = _rows(ky.organize(table, "RRDS", ["v"], ranges=4).select("relative_no", "v"), "relative_no")
    assert [n for n, _ in numbered] == list(range(1, 22)) and [v for _, v in numbered] == sorted(v for _, v in numbered)
    with pytest.raises(ValueError):
        ky.organize(table, "HEAP", ["k"])


def test_queues(spark):
    queues = spark.createDataFrame([("q", 1, "old"), ("r", 1, "r1")], "queue string, item bigint, data string")
    rows = spark.createDataFrame([("q", "b", 2), ("q", "a", 1), ("s", "c", 3)], "queue string, data string, seq int")
    after = ky.queue_append(queues, rows, ["seq"])
    assert [r["data"] for r in ky.queue_read(after, "q").collect()] == ["old", "a", "b"]
    assert ky.queue_read(after, "q", 3).first()["data"] == "b"
    assert sorted(r["queue"] for r in ky.queue_delete(after, "q").collect()) == ["r", "s"]


def test_embedded_sql(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    row = ky.sql_select_into(
        spark, "SELECT NAME, ID INTO :WS-NAME, :WS-ID FROM {t} WHERE ID > :WS-MIN ORDER BY ID", {"WS-MIN": 0}, t=t
    )
    assert row.columns == ["ws_name", "ws_id"] and tuple(row.first()) == ("a", 1)
    rows = ky.sql_cursor(spark, "DECLARE C1 CURSOR FOR SELECT ID FROM {t} WHERE NAME = :W-N", {":W-N": "b"}, t=t)
    assert [r[0] for r in rows.collect()] == [2]
