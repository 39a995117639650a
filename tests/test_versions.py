"""A folder of files that come, change and go; a change stream before its first batch."""

import os
import time

import pytest

from copperbook.operators import outline as ol
from copperbook.streaming import changes, versions

PROGRAM = "       IDENTIFICATION DIVISION.\n       PROGRAM-ID. {}.\n"
TABLES = {"headers": ol.program_header, "lines": lambda outlined: outlined.select("path", "code")}


class Folder:
    def __init__(self, spark, root):
        self.spark, self.root, self.store = spark, root / "src", str(root / "store")
        self.root.mkdir()
        self.clock = time.time() - 10_000

    def put(self, name, program):
        path = self.root / name
        path.write_text(PROGRAM.format(program))
        self.clock += 10
        os.utime(path, (self.clock, self.clock))

    def round(self, tables=TABLES):
        found = versions.folder(self.spark, str(self.root))
        return versions.take_in(self.spark, self.store, found, tables, prepare=ol.outline)

    def programs(self):
        rows = versions.current_rows(self.spark, self.store, "headers").collect()
        return sorted((r.path.rsplit("/", 1)[1], r.program_id) for r in rows)


@pytest.fixture
def folder(spark, tmp_path):
    out = Folder(spark, tmp_path)
    out.put("a.cbl", "A1")
    out.put("b.cbl", "B1")
    return out


def test_four_rounds(folder):
    assert folder.round() == 1 and folder.programs() == [("a.cbl", "A1"), ("b.cbl", "B1")]
    folder.put("a.cbl", "A2")
    (folder.root / "b.cbl").unlink()
    folder.put("c.cbl", "C1")
    assert folder.round() == 2 and folder.programs() == [("a.cbl", "A2"), ("c.cbl", "C1")]
    assert folder.round() is None
    folder.put("b.cbl", "B2")
    assert folder.round() == 3
    assert folder.programs() == [("a.cbl", "A2"), ("b.cbl", "B2"), ("c.cbl", "C1")]


def test_only_changed_files_are_read(folder, spark):
    folder.round()
    folder.put("b.cbl", "B2")
    folder.round()
    rows = spark.read.parquet(f"{folder.store}/headers/version=2").collect()
    assert [r.program_id for r in rows] == ["B2"]


def test_a_failed_round_is_not_seen_and_is_repeated(folder):
    folder.round()
    folder.put("a.cbl", "A2")

    def fails(_):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        folder.round({"headers": ol.program_header, "lines": fails})
    assert folder.programs() == [("a.cbl", "A1"), ("b.cbl", "B1")]
    folder.put("a.cbl", "A3")
    assert folder.round() == 2 and folder.programs() == [("a.cbl", "A3"), ("b.cbl", "B1")]


def test_all_files_gone(folder):
    folder.round()
    for name in ("a.cbl", "b.cbl"):
        (folder.root / name).unlink()
    assert folder.round() == 2 and folder.programs() == []


def test_compact(folder, spark):
    folder.round()
    folder.put("a.cbl", "A2")
    folder.round()
    assert versions.compact(spark, folder.store, list(TABLES)) == 3
    assert folder.programs() == [("a.cbl", "A2"), ("b.cbl", "B1")]
    assert spark.read.parquet(f"{folder.store}/headers").count() == 2
    assert folder.round() is None
    (folder.root / "a.cbl").unlink()
    assert folder.round() == 4 and folder.programs() == [("b.cbl", "B1")]


def test_changes_before_the_first_batch_and_vacuum(spark, tmp_path):
    root, source = str(tmp_path / "t"), tmp_path / "log"
    source.mkdir()
    schema = "k int, v string, seq int, op string"
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")

    def run():
        log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        changes.start_changes(log, root, "k", str(tmp_path / "checkpoint")).awaitTermination()

    def rows():
        return sorted(map(tuple, changes.current(spark, base, root, "k").collect()))

    run()
    assert rows() == [(1, "a"), (2, "b")]
    assert changes.compact(spark, base, root, "k", str(tmp_path / "base0")).count() == 2
    assert changes.vacuum(spark, root) == 0
    for n, change in enumerate([(1, "x", 1, "REWRITE"), (3, "c", 2, "WRITE")]):
        spark.createDataFrame([change], schema).coalesce(1).write.mode("append").parquet(str(source))
    run()
    assert rows() == [(1, "x"), (2, "b"), (3, "c")]
    changes.compact(spark, base, root, "k", str(tmp_path / "base1"))
    assert changes.vacuum(spark, root) == 2 and changes.vacuum(spark, root) == 0
    assert rows() == [(1, "x"), (2, "b"), (3, "c")]
    spark.createDataFrame([(2, None, 3, "DELETE")], schema).write.mode("append").parquet(str(source))
    run()
    assert rows() == [(1, "x"), (3, "c")]
