"""Files in and out, and streams of files."""

import pytest
from pyspark.sql import functions as F

from copperbook.operators import outline as ol
from copperbook.operators import statements as sm
from copperbook.sources import files
from copperbook.streaming import intake

PROGRAM = "       IDENTIFICATION DIVISION.\n       PROGRAM-ID. %s.\n       PROCEDURE DIVISION.\n       A-1.\n           STOP RUN.\n"


def _tree(root):
    (root / "a" / "b").mkdir(parents=True)
    (root / "top.cbl").write_text(PROGRAM % "TOP")
    (root / "a" / "one.COB").write_text(PROGRAM % "ONE")
    (root / "a" / "b" / "two.cobol").write_text(PROGRAM % "TWO")
    (root / "a" / "skip.txt").write_text("no")


def test_read_sources_walks_folders(spark, tmp_path):
    _tree(tmp_path)
    read = files.read_sources(spark, str(tmp_path))
    assert {r["rel_dir"] for r in read.collect()} == {".", "a", "a/b"}
    ids = {r["program_id"] for r in ol.program_header(ol.outline(read)).collect()}
    assert ids == {"TOP", "ONE", "TWO"}


def test_other_files_are_not_opened(spark, tmp_path):
    _tree(tmp_path)
    (tmp_path / "big.bin").write_bytes(b"x" * 1000)
    (tmp_path / "large.cbl").write_text("x" * 1000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 400)
    try:
        assert files.read_sources(spark, str(tmp_path)).count() == 3
        left = files.unread_sources(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert [(r["path"].rsplit("/", 1)[1], r["length"], r["status"]) for r in left] == [("large.cbl", 1000, "too large")]


def test_encodings_and_bad_bytes(spark, tmp_path):
    (tmp_path / "sjis.cbl").write_bytes("      * 日本語\n".encode("shift_jis"))
    (tmp_path / "bad.cbl").write_bytes(b"       77 A\xff PIC X.\n")
    before = spark.conf.get("spark.sql.legacy.javaCharsets", None)
    sjis = files.read_sources(spark, str(tmp_path), ("sjis.cbl",), "Shift_JIS").first()
    assert sjis["text"] == "      * 日本語\n"
    bad = files.read_sources(spark, str(tmp_path), ("bad.cbl",)).first()
    assert bad["text"] == "       77 A� PIC X.\n"
    assert spark.conf.get("spark.sql.legacy.javaCharsets", None) == before


def test_write_estate(spark, tmp_path):
    table = spark.createDataFrame([("d1", "x"), ("d2", "y")], "rel_dir string, v string")
    files.write_estate({"t": table}, str(tmp_path))
    assert (tmp_path / "t" / "rel_dir=d1").is_dir()
    assert files.read_estate(spark, str(tmp_path), "t").count() == 2
    headers = spark.createDataFrame([("in/a/b/p.cbl", 1), ("in/q.cbl", 2)], "path string, v int")
    files.write_estate({"h": headers}, str(tmp_path), source_root="in")
    assert {(r["rel_dir"], r["v"]) for r in files.read_estate(spark, str(tmp_path), "h").collect()} == {("a/b", 1), (".", 2)}


def test_intake_reads_each_file_once(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    _tree(root)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        stream = intake.source_stream(spark, str(root), files_per_batch=1)
        tables = {"headers": ol.program_header, "statements": sm.statements}
        intake.start_intake(stream, tables, out, checkpoint, prepare=ol.outline).awaitTermination()
        return sorted(r["program_id"] for r in intake.intake_table(spark, out, "headers").collect())

    assert run() == ["ONE", "TOP", "TWO"]
    (root / "late.cbl").write_text(PROGRAM % "LATE")
    assert run() == ["LATE", "ONE", "TOP", "TWO"]
    assert intake.intake_table(spark, out, "statements").count() == 4


def test_sources_are_written_as_sparks_writers_do(spark, tmp_path):
    names = ["a/b:c%2F=d", "it's [x]^{y}\\z\"#*?", "ü ñ", "tab\there", None, "", "twice", "twice"]
    rows = spark.createDataFrame([(n, f"text {i}\r\nü" if i else None) for i, n in enumerate(names)], "path string, text string").coalesce(1)
    files.write_sources(rows, f"file://{tmp_path}/ours")
    rows.select(F.col("path").alias("program"), "text").write.partitionBy("program").option("lineSep", "\n").text(f"{tmp_path}/theirs")

    def folders(root):
        return {f.parent.name: b"".join(sorted(f.read_bytes().splitlines(True))) for f in root.glob("program=*/part-*.txt")}

    assert folders(tmp_path / "ours") == folders(tmp_path / "theirs") and len(folders(tmp_path / "ours")) == 6
    # a file and no more: the others of Spark's writers cost a process each
    assert {f.name for f in (tmp_path / "ours").glob("program=*/*")} == {"part-00000.txt"}
    back = files.read_sources(spark, f"{tmp_path}/ours", (".txt",))
    assert {r.text for r in back.where(F.col("path").contains("ü")).collect()} == {"text 2\r\nü\n"}
    with pytest.raises(FileExistsError):
        files.write_sources(rows, f"{tmp_path}/ours")


def test_a_batch_of_files_is_listed_by_few_tasks(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    for i in range(200):
        (root / f"{i}.cbl").write_text(PROGRAM % f"P{i}")
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    stream = intake.source_stream(spark, str(root))
    with files.few_listing_tasks(spark):
        query = intake.start_intake(stream, {"headers": ol.program_header}, str(tmp_path / "out"), str(tmp_path / "cp"), prepare=ol.outline)
        query.awaitTermination()
    tracker = spark.sparkContext.statusTracker()
    stages = [s for job in tracker.getJobIdsForGroup(str(query.runId)) for s in tracker.getJobInfo(job).stageIds]
    assert 0 < max(tracker.getStageInfo(s).numTasks for s in stages) <= 4 * spark.sparkContext.defaultParallelism
    assert intake.intake_table(spark, str(tmp_path / "out"), "headers").count() == 200
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before
