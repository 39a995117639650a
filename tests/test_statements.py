"""Statements, blocks, edges and summaries."""

from pyspark.sql import functions as F

from copperbook.operators import outline as ol
from copperbook.operators import statements as sm
from copperbook.operators import summaries as su


def _program(*lines):
    head = ["IDENTIFICATION DIVISION.", "PROGRAM-ID. T.", "PROCEDURE DIVISION."]
    return "\n".join("       " + x for x in [*head, *lines])


def _outline(sources, *lines):
    return ol.outline(sources(_program(*lines)))


def _statements(sources, *lines):
    return sm.statements(_outline(sources, *lines)).orderBy("stmt_no").collect()


VERB_TYPES = [
    ("MOVE A TO B", "MOVE"), ("compute X = 1", "COMPUTE"), ("GO TO P", "GO TO"), ("STOP RUN", "STOP RUN"),
    ("STOP", "UNKNOWN"), ("XML GENERATE D FROM S", "XML GENERATE"), ("JSON PARSE D INTO S", "JSON PARSE"),
    ("EXEC SQL COMMIT END-EXEC", "EXEC SQL"), ("EXEC CICS RETURN END-EXEC", "EXEC CICS"),
    ("EXEC DLI GU END-EXEC", "EXEC DLI"), ("EXEC HTML X END-EXEC", "EXEC OTHER"),
    ("REWRITE R", "UNKNOWN"), ("ENTER TAL X", "ENTER"), ("INVOKE SELF 'M'", "INVOKE"), ("GOBACK", "GOBACK"),
    ("END-IF", None), ("END-ADD", None), ("ELSE", None), ("WHEN OTHER", None),
]


def test_verb_types(sources):
    rows = _statements(sources, *[text + "." for text, _ in VERB_TYPES])
    assert [(r["text"], r["stmt_type"]) for r in rows] == VERB_TYPES


def test_statements_join_lines_and_name_their_paragraph(sources):
    rows = _statements(
        sources, "DISPLAY 'EARLY'.", "A-1.", "COMPUTE X =", "    Y + 1", "MOVE X TO", "    Z W.",
        "COPY SKIPPED.", "S-1 SECTION.", "EXIT.", "B-1.", "GOBACK.",
    )
    assert [(r["section"], r["paragraph"], r["sentence_no"], r["text"]) for r in rows] == [
        ("", "MAIN", 1, "DISPLAY 'EARLY'"),
        ("", "A-1", 1, "COMPUTE X = Y + 1"),
        ("", "A-1", 1, "MOVE X TO Z W"),
        ("S-1", "MAIN", 1, "EXIT"),
        ("S-1", "B-1", 1, "GOBACK"),
    ]


def test_exec_block_is_one_statement_whatever_its_lines(sources):
    rows = _statements(
        sources, "P-1.", "EXEC SQL", "SELECT A", "INTO :B FROM T", "OPEN.", "END-EXEC", "MOVE 1 TO X.",
        "EXEC CICS RETURN END-EXEC.", "EXEC SQL NEVER", "MOVE CLOSED.",
    )
    assert [r["text"] for r in rows] == [
        "EXEC SQL SELECT A INTO :B FROM T OPEN. END-EXEC",
        "MOVE 1 TO X",
        "EXEC CICS RETURN END-EXEC",
        "EXEC SQL NEVER MOVE CLOSED",
    ]


def _depths(sources, *lines):
    rows = sm.block_depth(_outline(sources, *lines)).orderBy("stmt_no").collect()
    return [(r["text"], r["depth"], r["branch"]) for r in rows]


def test_nested_if(sources):
    assert _depths(
        sources, "IF A = 1", "IF B = 2", "IF C = 3", 'DISPLAY "DEEP"', "END-IF", "END-IF", "ELSE", "CONTINUE", "END-IF", "STOP RUN."
    ) == [
        ("IF A = 1", 0, ""),
        ("IF B = 2", 1, "THEN"),
        ("IF C = 3", 2, "THEN"),
        ('DISPLAY "DEEP"', 3, "THEN"),
        ("END-IF", 2, "THEN"),
        ("END-IF", 1, "THEN"),
        ("ELSE", 0, ""),
        ("CONTINUE", 1, "ELSE"),
        ("END-IF", 0, ""),
        ("STOP RUN", 0, ""),
    ]


def test_evaluate_has_one_branch_per_when(sources):
    rows = _depths(
        sources, "EVALUATE TRUE", "WHEN A >= 90", "MOVE 1 TO G", "WHEN OTHER", "IF X", "MOVE 3 TO G", "END-IF", "END-EVALUATE."
    )
    assert ("MOVE 1 TO G", 1, "WHEN A >= 90") in rows
    assert ("MOVE 3 TO G", 2, "THEN") in rows
    assert ("IF X", 1, "WHEN OTHER") in rows


def test_read_keeps_both_branches_and_stray_ends_count_for_nothing(sources):
    rows = _depths(
        sources, "END-IF", "READ F AT END", "MOVE 1 TO E", "NOT AT END", "ADD 1 TO N", "END-READ", "READ G", "END-READ", "DISPLAY N."
    )
    assert rows == [
        ("END-IF", 0, ""),
        ("READ F AT END", 0, ""),
        ("MOVE 1 TO E", 1, "AT END"),
        ("NOT AT END", 0, ""),
        ("ADD 1 TO N", 1, "NOT AT END"),
        ("END-READ", 0, ""),
        ("READ G", 0, ""),
        ("END-READ", 0, ""),
        ("DISPLAY N", 0, ""),
    ]


def test_period_closes_every_block(sources):
    rows = _depths(sources, "IF A", "IF B", "MOVE 1 TO X.", "MOVE 2 TO X.")
    assert rows[-1] == ("MOVE 2 TO X", 0, "")


def test_sql_and_cics_details(sources):
    blocks = sm.exec_blocks(
        _outline(
            sources,
            "EXEC SQL INCLUDE SQLCA END-EXEC.",
            "EXEC SQL UPDATE T SET A = :W-A WHERE B = ':NOT'",
            "    AND C = :W-C END-EXEC.",
            "EXEC CICS HANDLE AID PF1(P-1) pf1(P-2) CLEAR(P-3) END-EXEC.",
            "EXEC CICS FROB END-EXEC.",
        )
    )
    sql = sm.sql_blocks(blocks).orderBy("block_no").collect()
    assert [(r["sql_class"], r["copybook"], r["host_vars"]) for r in sql] == [
        ("INCLUDE", "SQLCA", []),
        ("DML", "", ["W-A", "W-C"]),
    ]
    cics = sm.cics_blocks(blocks).orderBy("block_no").collect()
    assert [(r["cics_class"], r["params"]) for r in cics] == [
        ("HANDLE_AID", {"PF1": "P-2", "CLEAR": "P-3"}),
        ("OTHER", {}),
    ]


def test_edges(sources):
    outlined = sm.statements(
        _outline(
            sources, "M-1.", 'CALL "SUB" USING BY CONTENT A B.', "CALL WS-NAME.", "GO TO E-1.", "PERFORM A-1.",
            "PERFORM A-1 THRU B-1.", "PERFORM A-1 5 TIMES.", "PERFORM A-1 UNTIL X.", "PERFORM UNTIL X", "CONTINUE", "END-PERFORM.",
            "PERFORM A-1 VARYING I FROM 1 BY 1 UNTIL I > 3.", "PERFORM 3 TIMES", "END-PERFORM.",
        )
    )
    assert [(r["callee"], r["args"]) for r in sm.calls(outlined).collect()] == [("SUB", ["A", "B"])]
    assert [(r["source"], r["target"]) for r in sm.goto_targets(outlined).collect()] == [("M-1", "E-1")]
    forms = sm.perform_targets(outlined).orderBy("stmt_no").collect()
    assert [(r["form"], r["target"], r["thru_target"]) for r in forms] == [
        ("PLAIN", "A-1", ""), ("THRU", "A-1", "B-1"), ("TIMES", "A-1", ""), ("UNTIL", "A-1", ""),
        ("INLINE", "", ""), ("VARYING", "A-1", ""), ("INLINE", "", ""),
    ]


def test_services_entry_and_readiness(sources):
    outlined = _outline(
        sources, "S-0 SECTION.", "IN-SEC.", "EXIT.", "CALC-A.", "EXIT.", "CALC-B.", "UNSTRING X.", "CALC-C.", "SORT F.", "OTHER-A.", "EXIT."
    )
    groups = su.service_groups(outlined).collect()
    assert [(r["prefix"], r["class_name"], r["paragraphs"]) for r in groups] == [("CALC", "CalcService", 3)]
    members = su.service_members(outlined).collect()
    assert sorted((r["paragraph_no"], r["paragraph"]) for r in members) == [(2, "CALC-A"), (3, "CALC-B"), (4, "CALC-C")]
    assert su.entry_paragraph(outlined).first()["paragraph"] == "IN-SEC"
    left = su.readiness(sm.statements(outlined)).collect()
    assert sorted((r["stmt_type"], r["statements"]) for r in left) == [("UNKNOWN", 1), ("UNSTRING", 1)]


def test_dialect_ties_go_to_the_earlier_and_silence_is_standard(sources):
    rows = su.detect_dialect(
        sources({"a": "ACOS GCOS", "b": "nothing here", "c": "call 'CBL_OC_NANOSLEEP'", "d": "MCP", "e": "pic  n(4)"})
    ).collect()
    assert {r["path"]: (r["dialect"], r["score"]) for r in rows} == {
        "a": ("nec", 8), "b": ("standard", 0), "c": ("gnucobol", 18), "d": ("standard", 0), "e": ("fujitsu", 4),
    }


def test_diff_counts_copies(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x int")
    b = spark.createDataFrame([(1,), (3,)], "x int")
    rows = su.diff_estates(a, b).collect()
    assert sorted(map(str, map(tuple, rows))) == ["(1, 'a')", "(2, 'a')", "(3, 'b')", "(None, 'a')"]
    many = spark.range(25_001).selectExpr("7 AS x")
    assert su.diff_estates(b.limit(0), many.selectExpr("CAST(x AS int) AS x")).groupBy("side").count().collect() == [("b", 25_001)]


def test_using_arguments_are_parted_by_commas(sources):
    rows = sm.calls(sm.statements(_outline(sources, "A-1.", 'CALL "SUB" USING A, B; BY CONTENT C.'))).collect()
    assert [(r["callee"], r["args"]) for r in rows] == [("SUB", ["A", "B", "C"])]


def test_a_class_shows_in_the_summary(sources):
    texts = {"c": "       IDENTIFICATION DIVISION.\n       CLASS-ID. PARTS.\n", "p": "       IDENTIFICATION DIVISION.\n       PROGRAM-ID. P.\n"}
    rows = su.program_summary(ol.outline(sources(texts))).collect()
    assert {r["path"]: r["has_class"] for r in rows} == {"c": True, "p": False}


def test_one_file_with_most_of_the_estate(sources):
    """A file of 40,000 statements next to small ones."""
    body = ["A-1."]
    for i in range(10000):
        body += [f"IF X > {i}", f"ADD {i} TO X", "ELSE", "SUBTRACT 1 FROM X."]
    texts = {"big": _program(*body), **{f"s{i}": _program("B-1.", "GOBACK.") for i in range(20)}}
    rows = sm.block_depth(ol.outline(sources(texts)))
    assert rows.count() == 40020
    assert rows.where("path = 'big'").agg(F.sum("depth")).first()[0] == 20000
    assert rows.where("text LIKE 'SUBTRACT%' AND branch <> 'ELSE'").count() == 0


def test_several_statements_in_a_line(sources):
    outlined = _outline(
        sources, "A-1. MOVE 0 TO A. MOVE 1.5 TO B.", "IF A = 1 GO TO M-1.", "DISPLAY 'X. ADD Y' B. ADD 1 TO A.",
        "IF A = 'GO TO' MOVE 1 TO A", "ELSE PERFORM M-1.", "M-1. EXIT.",
    )
    rows = sm.statements(outlined).orderBy("stmt_no").collect()
    assert [r["text"] for r in rows] == [
        "MOVE 0 TO A", "MOVE 1.5 TO B", "IF A = 1", "GO TO M-1", "DISPLAY 'X. ADD Y' B", "ADD 1 TO A",
        "IF A = 'GO TO'", "MOVE 1 TO A", "ELSE", "PERFORM M-1", "EXIT",
    ]
    assert [r["target"] for r in sm.goto_targets(sm.statements(outlined)).collect()] == ["M-1"]
    assert [r["paragraph"] for r in sm.paragraphs(outlined).orderBy("paragraph_no").collect()] == ["A-1", "M-1"]
