"""Folders listed and files opened by tasks, against Spark's own file sources."""

import os
import random

import pytest
from pyspark.sql import functions as F

from copperbook.sources import files, folders
from copperbook.streaming import intake


@pytest.fixture
def tree(tmp_path):
    rng = random.Random(4)
    root = tmp_path / "in"
    names = ["a.txt", "_hidden.txt", ".dot.txt", "_k=1.txt", "x._COPYING_", "b.dat", "é +%25.txt", "_d/c.txt", "_p=1/q/r/s/t.txt", "e/f.txt", "e/_metadata.txt", "_metadata_d/g.txt"]
    for name in names:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"".join(rng.choice([b"ab", b"\n", b"\r", b"\r\n", b"\xff", b"long " * 5]) for _ in range(200)))
    (root / "e" / "none.txt").write_bytes(b"")
    (root / "bom.txt").write_bytes(b"\xef\xbb\xbfone\n\xef\xbb\xbftwo")
    os.symlink(root / "nowhere", root / "broken.txt")
    os.symlink(root / "a.txt", root / "link.txt")
    return str(root)


def test_listing_is_that_of_spark(spark, tree):
    theirs = files.found_files(spark, tree, (".txt",)).select("path", "modificationTime", "length", "content")
    ours = folders.with_content(folders.listed(spark, f"file://{tree}/", (".txt",)))
    assert ours.schema.simpleString() == theirs.schema.simpleString()
    assert sorted(ours.collect()) == sorted(theirs.collect()) and ours.count() == 8
    assert "FileScan" not in ours._jdf.queryExecution().executedPlan().toString()


def test_patterns_and_files_are_left_to_spark(spark, tree):
    assert folders.listed(spark, f"{tree}/*", (".txt",)) is None
    assert folders.listed(spark, f"{tree}/a.txt", (".txt",)) is None
    assert folders.listed(spark, tree, (".t?t",)) is None
    assert files.decoded_lines(spark, f"{tree}/{{e,_p=1}}", (".txt",), above=0).select("path").distinct().count() == 2


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 4096])
def test_blocks_hold_the_lines_that_spark_reads(spark, tree, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        lines = folders.with_lines(folders.listed(spark, tree, (".txt",)))
        plan = lines._jdf.queryExecution().executedPlan().toString()
        found = lines.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    # the driver holds no entry of a file
    assert "FileScan" not in plan
    for path in {r.path for r in found}:
        text = spark.read.text(path.removeprefix("file:")).select(F.col("value").cast("binary")).collect()
        ours = sorted((r.block, r.at, bytes(r.value)) for r in found if r.path == path)
        assert [v for _, _, v in ours] == [bytes(r[0]) for r in text]
        assert len({(b, a) for b, a, _ in ours}) == len(ours)
        assert all(b % size == 0 for b, _, _ in ours)


def test_lines_of_files_have_no_scan(spark, tree):
    lines = files.decoded_lines(spark, tree, (".txt",), above=0)
    assert "FileScan" not in lines._jdf.queryExecution().executedPlan().toString()
    longer = files.decoded_lines(spark, tree, (".txt",), above=20)
    names = lambda df: {r.path.rsplit("/", 1)[1] for r in df.select("path").distinct().collect()}
    assert names(lines) - names(longer) == {"bom.txt"}


def test_sources_have_no_scan(spark, tree):
    read = files.read_sources(spark, tree, (".txt",))
    assert "FileScan" not in read._jdf.queryExecution().executedPlan().toString()
    theirs = files.decoded_sources(spark, files.found_files(spark, tree, (".txt",)), tree, (".txt",), "utf-8")
    assert sorted(read.collect()) == sorted(theirs.collect()) and read.count() == 8
    patterned = files.read_sources(spark, f"{tree}/{{e,_p=1}}", (".txt",))
    assert patterned.count() == 2


@pytest.fixture
def intake_of(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def run(stream=lambda s: s, n=2):
        sources = intake.source_stream(spark, str(tmp_path / "in"), files_per_batch=n)
        intake.start_intake(stream(sources), {"t": lambda s: s.select("path")}, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return sorted(r.path.rsplit("/", 1)[1] for r in intake.intake_table(spark, str(tmp_path / "out"), "t").collect())

    return run


def test_an_intake_notes_what_is_new(spark, tmp_path, intake_of):
    for i in range(5):
        (tmp_path / "in" / f"{i}.cbl").write_text("x")
    assert intake_of() == [f"{i}.cbl" for i in range(5)]
    (tmp_path / "in" / "old.cbl").write_text("x")
    os.utime(tmp_path / "in" / "old.cbl", (1, 1))
    found = [f"{i}.cbl" for i in range(5)] + ["old.cbl"]
    assert intake_of() == intake_of() == found
    notes = sorted(spark.read.parquet(str(f)).count() for f in (tmp_path / "cp" / "arrivals").glob("*.parquet"))
    # the stream knows the notes only, and each is one batch
    assert notes == [1, 1, 2, 2] and len(list((tmp_path / "out" / "t").glob("batch=*"))) == 4


def test_an_intake_goes_on_with_the_source_it_began_with(tmp_path, intake_of):
    (tmp_path / "in" / "a.cbl").write_text("x")
    assert intake_of(lambda s: s.select("*")) == ["a.cbl"]
    (tmp_path / "in" / "b.cbl").write_text("x")
    assert intake_of() == ["a.cbl", "b.cbl"] and not (tmp_path / "cp" / "arrivals").exists()


def test_files_that_have_gone(spark, tree):
    listing = folders.listed(spark, tree, (".txt",)).localCheckpoint()
    os.remove(f"{tree}/a.txt")
    left = {r.path.rsplit("/", 1)[1] for r in folders.with_content(listing, missing=True).collect()}
    assert "bom.txt" in left and not {"a.txt", "link.txt"} & left and len(left) == 6
    with pytest.raises(Exception, match="FileNotFoundError"):
        folders.with_content(listing).collect()
