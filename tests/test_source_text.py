"""Lines, divisions and headers."""

import random

from pyspark.sql import functions as F

from copperbook.functions import source_text as st
from copperbook.functions.text import BLANKS
from copperbook.operators import outline as ol


def _code(spark_sources, text, format="auto"):
    rows = ol.clean_lines(spark_sources(text), format).orderBy("line_no").collect()
    return [r["content"] for r in rows]


def test_physical_lines_take_every_line_end(sources):
    rows = ol.physical_lines(sources("a\r\nb\n\rc\n")).orderBy("line_no").collect()
    assert [(r["line_no"], r["raw"]) for r in rows] == [(1, "a"), (2, "b"), (3, ""), (4, "c")]


def test_fixed_format_columns(sources):
    text = "\n".join(
        [
            "000100 IDENTIFICATION DIVISION.",
            "000200* A COMMENT",
            "000300/ PAGE",
            "000400D DEBUG",
            "000500d debug",
            "000600" + " " * 66 + "BEYOND COLUMN 72",
            "SHORT",
            "       77 A PIC X(5)".ljust(72) + "SEQ00010",
        ]
    )
    assert _code(sources, text) == ["IDENTIFICATION DIVISION.", "SHORT", "77 A PIC X(5)"]


def test_continuation_joins_the_previous_kept_line(sources):
    text = "\n".join(
        ["      -LOST", "       01 T PIC X(9) VALUE \"A", "      * NOTE", "      -    B\".", "      -", "       02 X."]
    )
    assert _code(sources, text) == ['01 T PIC X(9) VALUE "A B".', "02 X."]


def test_tabs_are_trimmed_and_markers_are_blanks(sources):
    assert _code(sources, "      \t\tMOVE A TO B.\t\n       X\x02Y.") == ["MOVE A TO B.", "X Y."]


def test_free_format_when_fixed_leaves_nothing(sources):
    text = "      * only\n      * comments\n*> gone"
    assert _code(sources, text) == ["* only", "* comments"]
    assert _code(sources, text, "fixed") == ["e"]
    assert _code(sources, "MOVE A TO B.\n*> gone", "free") == ["MOVE A TO B."]


def test_empty_file_has_no_lines_but_a_summary(sources):
    from copperbook.operators import summaries as su

    empty = sources({"e.cbl": ""})
    assert ol.clean_lines(empty).count() == 0
    row = su.program_summary(ol.outline(empty)).first()
    assert (row["lines"], row["items"], row["paragraphs"], row["files"]) == (0, 0, 0, 0)
    row = su.class_summary(ol.outline(empty)).first()
    assert (row["data_classes"], row["services"], row["total"]) == (0, 0, 1)


def test_header_takes_the_last_of_each_kind(sources):
    text = """\
       ID DIVISION.
       PROGRAM-ID. FIRST.
       PROGRAM-ID. SECOND.
       AUTHOR. A. PERSON.
       DATE-WRITTEN. TODAY.
       CLASS-ID. KLASS INHERITS BASE.
       PROCEDURE DIVISION.
           DISPLAY "PROGRAM-ID. NOT-THIS".
"""
    row = ol.program_header(ol.outline(sources(text))).first()
    assert row["program_id"] == "SECOND" and row["class_id"] == "KLASS" and row["is_class"]
    assert row["author"] == "A. PERSON" and row["date_written"] == "TODAY"


def test_class_name_stands_in_for_a_program_name(sources):
    row = ol.program_header(ol.outline(sources("       ID DIVISION.\n       CLASS-ID. K."))).first()
    assert (row["program_id"], row["is_class"]) == ("K", True)


FILES = """\
       ENVIRONMENT DIVISION.
       COPY ENVBOOK.
       FILE-CONTROL.
           SELECT IN-FILE ASSIGN TO "IN.DAT"
               ORGANIZATION IS LINE SEQUENTIAL
               ACCESS MODE IS RANDOM
               FILE STATUS WS-FS.
           SELECT OUT-FILE ASSIGN TO OUTDD.
       DATA DIVISION.
       FILE SECTION.
       COPY LOST.
       FD in-file.
       01 IN-REC PIC X(10).
       FD EXTRA-FILE
           LABEL RECORDS ARE STANDARD.
       COPY EXTRAREC.
       01 EXTRA-REC PIC X.
       WORKING-STORAGE SECTION.
       COPY WSBOOK REPLACING A BY
       01 WS-A PIC X.
"""


def test_files_join_select_and_fd(sources):
    rows = ol.file_control(ol.outline(sources(FILES))).orderBy("file_no").collect()
    assert [tuple(r)[2:] for r in rows] == [
        ("IN-FILE", "IN", "LINE SEQUENTIAL", "RANDOM", "WS-FS", "IN-FILE"),
        ("OUT-FILE", "OUTDD", "SEQUENTIAL", "SEQUENTIAL", "", ""),
        ("EXTRA-FILE", "", "SEQUENTIAL", "SEQUENTIAL", "", "EXTRA-FILE"),
    ]


def test_copies_by_division(sources):
    rows = ol.copies(ol.outline(sources(FILES))).collect()
    assert sorted((r["member"], r["division"]) for r in rows) == [
        ("ENVBOOK", "ENVIRONMENT"),
        ("EXTRAREC", "DATA"),
        ("WSBOOK", "DATA"),
    ]


def test_second_program_of_a_file_is_not_read(sources):
    text = """\
       IDENTIFICATION DIVISION.
       PROGRAM-ID. ONE.
       PROCEDURE DIVISION.
       A-1.
           STOP RUN.
       IDENTIFICATION DIVISION.
       PROGRAM-ID. TWO.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
       01 X PIC X.
       PROCEDURE DIVISION.
       B-1.
           GOBACK.
"""
    from copperbook.operators import items as it
    from copperbook.operators import statements as sm

    outlined = ol.outline(sources(text))
    assert ol.program_header(outlined).first()["program_id"] == "ONE"
    assert it.data_items(outlined).count() == 0
    assert [r["paragraph"] for r in sm.paragraphs(outlined).collect()] == ["A-1"]


def _fixed(text):
    """Clean text of a fixed-format file, line by line."""
    out = []
    for raw in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        mark, code = raw[6:7], (raw[6:72] if len(raw) > 6 else raw).strip(BLANKS)
        if mark and mark in "*/Dd":
            continue
        if mark == "-":
            code = raw[7:72].strip(BLANKS)
            if code and out:
                out[-1] += " " + code
        elif code:
            out.append(code)
    return "\n".join(out)


def test_fixed_text_equals_a_reading_line_by_line(spark):
    rng = random.Random(5)

    def line():
        body = "".join(rng.choice("A -*\t\u3000é𝒳.$") for _ in range(rng.choice([0, 1, 5, 65, 66, 80])))
        return rng.choice(["", "      ", "000100", "  "]) + rng.choice(["-", "*", "D", " ", "- ", ""]) + body

    texts = ["".join(line() + rng.choice(["\n", "\r\n", "\r"]) for _ in range(rng.randrange(9))) for _ in range(500)]
    texts += ["", "      -", "      * X\n" * 30_000, "\n" * 30_000, " " * 50_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").withColumn("code", st.fixed_text(F.col("text")))
    for row in rows.collect():
        assert row.code == _fixed(row.text), row.text[:200]


def test_lines_are_cut_by_patterns_of_the_whole_text(spark):
    # a lambda of many steps for each line took a third of the time of an estate
    plan = spark.createDataFrame([("x",)], "text string").select(st.fixed_text(F.col("text")).alias("c"))
    assert "72" in plan._jdf.queryExecution().optimizedPlan().toString()
    assert "substring" not in plan._jdf.queryExecution().optimizedPlan().toString()
