"""Long files by blocks against the same files as one row each."""

import random

import pytest

from copperbook.operators import long_sources as lg
from copperbook.operators import outline as ol
from copperbook.sources import files


def program(seed, lines=1500):
    """Fixed-format lines of every kind, in no sensible order."""
    rng = random.Random(seed)
    pick = [
        "       IDENTIFICATION DIVISION.",
        "       DATA DIVISION.",
        "       PROCEDURE DIVISION.",
        "       WORKING-STORAGE SECTION.",
        "       FILE SECTION.",
        "       LINKAGE SECTION.",
        "      * a comment",
        "      -    continued text",
        "      -",
        "",
        "AB",
        "       MOVE A TO B.",
        "       01  A PIC X(3) VALUE 'é'.",
        "\t\t\ttabs",
    ]
    return "\n".join(rng.choice(pick) + ("" if rng.random() < 0.5 else f" {n}") for n in range(lines)) + rng.choice(["", "\n"])


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


TEXTS = {
    "a.cbl": program(1),
    "b.cbl": "      - alone\n      - still alone\n" + program(2),
    "sub dir+1/c.cob": program(3).replace("\n", "\r\n"),
    "free.cbl": "\n".join(["*> note", "x", " y ", "", "id division.", "DATA DIVISION.", "LINKAGE SECTION."] * 300).replace("x", "*>x"),
    "short.cbl": "      *\n" * 2000 + "x\n",
}


@pytest.fixture
def root(tmp_path):
    for name, text in TEXTS.items():
        path = tmp_path / "src" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    return str(tmp_path / "src")


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_blocks_give_what_whole_files_give(spark, root, small_blocks):
    whole = files.read_sources(spark, root)
    lines = lg.long_lines(spark, root, above=0)
    blocks = files.decoded_lines(spark, root, above=0).select("path", "block").distinct().count()
    assert blocks > 3 * len(TEXTS)
    assert rows(lines, "path", "line_no", "raw") == rows(ol.physical_lines(whole), "path", "line_no", "raw")
    for format in ("fixed", "free", "auto"):
        cleaned = lg.clean_long_lines(lines, format)
        assert rows(cleaned, "path", "line_no", "content") == rows(ol.clean_lines(whole, format), "path", "line_no", "content")
    columns = ["path", "line_no", "division", "data_section", "content"]
    tagged = lg.tag_long_lines(lg.clean_long_lines(lines))
    assert rows(tagged, *columns) == rows(ol.tagged_lines(ol.outline(whole)), *columns)


def test_only_files_above_the_limit(spark, root):
    long_ones = lg.long_lines(spark, root, above=len(TEXTS["short.cbl"].encode()))
    names = {r.path.rsplit("/", 1)[1] for r in long_ones.select("path").distinct().collect()}
    assert names == {n.rsplit("/", 1)[-1] for n, t in TEXTS.items() if len(t.encode()) > len(TEXTS["short.cbl"])}
    assert lg.tag_long_lines(lg.clean_long_lines(lg.long_lines(spark, root))).collect() == []


def test_encoding(spark, tmp_path, small_blocks):
    text = "       MOVE '日本語' TO A.\n" * 700
    (tmp_path / "j.cbl").write_bytes(text.encode("shift_jis"))
    lines = lg.long_lines(spark, str(tmp_path), encoding="Shift_JIS", above=0)
    assert {r.raw for r in lines.collect()} == {"       MOVE '日本語' TO A."} and lines.count() == 700


def test_paths_do_not_pass_through_the_driver(spark, root):
    spark.sparkContext.setJobGroup("lines of long files", "")
    try:
        lines = files.decoded_lines(spark, root, above=0)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("lines of long files")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert lines.select("path").distinct().count() == len(TEXTS)
