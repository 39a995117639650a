"""Data items, types and hierarchy."""

import random

from copperbook.operators import items as it
from copperbook.operators import outline as ol


def _program(*lines, section="WORKING-STORAGE"):
    head = ["IDENTIFICATION DIVISION.", "PROGRAM-ID. T.", "DATA DIVISION.", f"{section} SECTION."]
    return "\n".join("       " + x for x in [*head, *lines])


def _items(sources, *lines, section="WORKING-STORAGE"):
    return it.data_items(ol.outline(sources(_program(*lines, section=section)))).orderBy("item_no")


CLAUSES = [
    ("01 WS-NAME PIC X(30).", dict(level=1, name="WS-NAME", picture="X(30)")),
    ("05 WS-PACKED PIC S9(7)V99 COMP-3.", dict(picture="S9(7)V99", usage="COMP-3")),
    ("05 WS-BIN PIC S9(4) USAGE IS BINARY.", dict(usage="BINARY")),
    ("05 WS-FPTR USAGE FUNCTION-POINTER.", dict(usage="FUNCTION-POINTER", picture="")),
    ('77 WS-MSG PIC X(80) VALUE "Hello World".', dict(value="Hello World")),
    ("77 WS-COUNT PIC 9(5) VALUE 100.", dict(value="100")),
    ("77 WS-BLANK PIC X(10) VALUE SPACE.", dict(value="SPACES")),
    ("77 WS-ZERO PIC 9(5) VALUE ZEROES.", dict(value="ZEROS")),
    ("77 WS-EMPTY PIC X VALUE ''.", dict(value=None)),
    ("05 WS-ITEM PIC X(10) OCCURS 50.", dict(occurs=50, occurs_depending="")),
    ("05 R OCCURS 1 TO 80 TIMES DEPENDING ON N PIC X.", dict(occurs=80, occurs_depending="N")),
    ("05 WS-REDEF PIC X(10) REDEFINES WS-ORIG.", dict(redefines="WS-ORIG")),
    ("05 FILLER PIC X(10).", dict(is_filler=True)),
    ("05 WS-SHORT BINARY-SHORT.", dict(usage="BINARY-SHORT")),
    ("05 WS-F PIC S9(5)V99 COMP-3 VALUE 123.45 OCCURS 10.",
     dict(picture="S9(5)V99", usage="COMP-3", occurs=10, value="123.45")),
    ("05 WS-V VALUE 123.45 COMP-3 PIC S9(5)V99.", dict(value="123.45", usage="COMP-3")),
    ("88 STATUS-ACTIVE VALUE \"Y\".", dict(level=88, is_88=True, value=None)),
    ("77 WS-QUOTE PIC X(9) VALUE 'IT''S'.", dict(value="IT'S")),
    ('77 WS-QUOTE PIC X(9) VALUE "A ""B"" PIC 9".', dict(value='A "B" PIC 9', picture="X(9)")),
    ("77 WS-DOT PIC X(9) VALUE 'END.'.", dict(value="END.")),
    ("05 WS-PIC-OF PICTURE IS 9(4) USAGE BINARY.", dict(picture="9(4)", usage="BINARY")),
    ("05 WS-OCCURS OCCURS 99999999999 TIMES PIC X.", dict(occurs=None, picture="X")),
]


def _by_number(sources, lines, make):
    """Rows of many one-item programs, in the order of the lines."""
    texts = {str(n): _program(line) for n, line in enumerate(lines)}
    rows = make(it.data_items(ol.outline(sources(texts)))).collect()
    return [row.asDict() for row in sorted(rows, key=lambda r: int(r["path"]))]


def test_clauses(sources):
    rows = _by_number(sources, [line for line, _ in CLAUSES], lambda items: items)
    assert [{k: row[k] for k in expected} for row, (_, expected) in zip(rows, CLAUSES)] == [e for _, e in CLAUSES]


TYPES = [
    ("PIC S9(7) COMP-3", "decimal(7,0)"),
    ("PIC S9(7)V99 COMP-3", "decimal(9,2)"),
    ("PIC S9(9)V99 PACKED-DECIMAL", "decimal(11,2)"),
    ("PIC S9(18)V9(4) COMP-3", "decimal(22,4)"),
    ("PIC S9(4) BINARY", "int"),
    ("PIC S9(18) COMP", "bigint"),
    ("COMP", "int"),
    ("COMP-1", "float"),
    ("COMP-2", "double"),
    ("COMP-5", "int"),
    ("BINARY-LONG", "int"),
    ("BINARY-SHORT", "smallint"),
    ("BINARY-DOUBLE", "bigint"),
    ("BINARY-CHAR", "tinyint"),
    ("BINARY-C-LONG", "int"),
    ("POINTER", "bigint"),
    ("USAGE OBJECT-REFERENCE", "unsupported"),
    ("FLOAT-LONG", "double"),
    ("NATIVE-8", "bigint"),
    ("DISPLAY-1", "string"),
    ("PIC N(10)", "string"),
    ("PIC X(30)", "string"),
    ("PIC 9(5)", "int"),
    ("PIC 9(9)", "int"),
    ("PIC 9(10)", "bigint"),
    ("PIC 9(15)", "bigint"),
    ("PIC 9(19)", "decimal(19,0)"),
    ("PIC 9(39)", "string"),
    ("PIC 9(5)V99", "decimal(7,2)"),
    ("PIC ZZ9.99", "decimal(5,2)"),
    ("PIC ZZ,ZZ9.99-", "string"),
    ("PIC S9(4)", "int"),
    ("", "string"),
]


def test_types(sources):
    rows = _by_number(sources, [f"05 WS-X {clauses}." for clauses, _ in TYPES], it.item_types)
    assert [(c, row["spark_type"]) for row, (c, _) in zip(rows, TYPES)] == TYPES


def test_sentences_span_lines_and_stop_at_copy_and_exec(sources):
    rows = _items(
        sources, "01 A", "   PIC X(4)", "   VALUE 'AB'.", "COPY BOOK", "05 B PIC X.",
        "EXEC SQL INCLUDE", "01 NOT-AN-ITEM.", "END-EXEC.", "05 C PIC X.",
    ).collect()
    assert [(r["name"], r["value"]) for r in rows] == [("A", "AB"), ("B", None), ("C", None)]


def test_condition_values(sources):
    placed = _items(
        sources, "05 S PIC X(9).", '88 C1 VALUES ARE "NEW YORK" \'B\'.', "88 C2 VALUE 1 THRU 5, 9 THROUGH 12 20."
    )
    rows = it.conditions(placed).orderBy("item_no").collect()
    assert rows[0]["condition_values"] == ["NEW YORK", "B"]
    assert rows[1]["condition_values"] == ["1 THRU 5", "9 THROUGH 12", "20"]


def _brute_parents(levels):
    """Nearest earlier lower level, written as the rule says it."""
    parents, depths = [], []
    for i, level in enumerate(levels):
        found = None
        if level not in (1, 77):
            for j in range(i - 1, -1, -1):
                if levels[j] != 88 and levels[j] < level:
                    found = j
                    break
        parents.append(found)
        depths.append(0 if found is None else depths[found] + 1)
    return parents, depths


def test_hierarchy_matches_the_rule_on_random_levels(sources):
    rng = random.Random(5)
    texts, expected = {}, {}
    for n in range(30):
        levels = [rng.choice([1, 2, 3, 5, 5, 10, 15, 49, 66, 77, 88, 88]) for _ in range(rng.randint(1, 60))]
        texts[f"p{n}"] = _program(*[f"{level:02d} N-{i} PIC X." for i, level in enumerate(levels)])
        expected[f"p{n}"] = _brute_parents(levels)
    rows = it.item_hierarchy(it.data_items(ol.outline(sources(texts)))).collect()
    for path, (parents, depths) in expected.items():
        mine = sorted((r for r in rows if r["path"] == path), key=lambda r: r["item_no"])
        assert [r["parent_no"] and r["parent_no"] - 1 for r in mine] == parents
        assert [r["depth"] for r in mine] == depths


def test_hierarchy_of_a_very_long_section(sources):
    """One file with far more items than any block of the fold."""
    lines = []
    for i in range(4000):
        lines += [f"01 R-{i}.", f"05 G-{i}.", f"10 F-{i} PIC 9(4).", f"88 C-{i} VALUE 1."]
    rows = it.item_hierarchy(_items(sources, *lines))
    assert rows.where("level = 10 AND (depth <> 2 OR parent_no <> item_no - 1)").count() == 0
    assert rows.where("level = 88 AND (depth <> 3 OR parent_no <> item_no - 1)").count() == 0
    assert rows.count() == 16000


def test_record_schema_and_struct_type(sources):
    lines = [
        "01 CUST-REC.", "05 CUST-ID PIC 9(8).", "05 FILLER PIC X.", "05 CUST-NAME PIC X(20).",
        "05 BALANCE PIC S9(7)V99 COMP-3 OCCURS 3.", "05 ADDR.", "10 STREET PIC X.",
        "01 FILLER.", "05 A PIC X.", "01 ONLY-FILLER.", "05 FILLER PIC X.", "01 ELEMENTARY PIC X.",
    ]
    typed = it.item_types(_items(sources, *lines))
    schemas = it.record_schemas(typed).collect()
    assert [(r["record"], r["fields"], r["class_name"]) for r in schemas] == [("CUST-REC", 4, "CustRec")]
    struct = it.struct_type(it.record_fields(typed).collect())
    assert struct.simpleString() == (
        "struct<cust_id:int,cust_name:string,balance:array<decimal(9,2)>,addr:string>"
    )


def test_enums_need_two_conditions_in_working_or_local_storage(sources):
    lines = ["05 A PIC X.", "88 A-1 VALUE 1.", "88 A-2 VALUE 2.", "05 B PIC X.", "88 B-1 VALUE 1."]
    outlined = ol.outline(sources(_program(*lines)))
    found = it.enum_candidates(outlined).collect()
    assert [(r["name"], r["members"], r["enum_name"]) for r in found] == [("A", 2, "AType")]
    assert sorted(r["member"] for r in it.enum_members(outlined).collect()) == ["A_1", "A_2"]
    linkage = ol.outline(sources(_program(*lines, section="LINKAGE")))
    assert it.enum_candidates(linkage).count() == 0 and it.enum_members(linkage).count() == 0


def test_screen_fields(sources):
    text = _program(
        '05 TITLE LINE 1 COLUMN 20 HIGHLIGHT VALUE "PARTS: ".',
        "05 KEY-IN LINE NUMBER IS 3 COL 5 PIC 9(5)",
        "    FROM WS-N TO WS-K BLINK.",
        section="SCREEN",
    )
    rows = it.screen_fields(ol.outline(sources(text))).orderBy("item_no").collect()
    assert tuple(rows[0])[3:] == ("TITLE", 1, 20, "", "PARTS: ", "", "", "HIGHLIGHT")
    assert tuple(rows[1])[3:] == ("KEY-IN", 3, 5, "9(5)", "", "WS-N", "WS-K", "BLINK")


def test_odd_declarations_do_not_end_the_job(sources):
    typed = it.item_types(_items(sources, "77 HUGE PIC 9(99999999999).", "77 MANY PIC X OCCURS 99999999999.", "77 OK PIC 9(4)."))
    assert {r["name"]: r["spark_type"] for r in typed.collect()} == {"HUGE": "string", "MANY": "string", "OK": "int"}


def test_condition_values_keep_their_text(sources):
    lines = ["05 A PIC X(9).", "88 ONE VALUE 'IT''S'.", "88 TWO VALUES ARE 1 THRU 5, 7 'A B' THROUGH \"C\"."]
    found = {r["name"]: r["condition_values"] for r in it.conditions(_items(sources, *lines)).collect()}
    assert found == {"ONE": ["IT'S"], "TWO": ["1 THRU 5", "7", "A B THROUGH C"]}


def test_screen_words_are_not_found_in_names(sources):
    lines = ["05 S-A LINE 99999999999 COL 4 PIC X(3) FROM WS-GOTO", "TO WS-TO-X VALUE 'FROM LINE 9'."]
    (row,) = it.screen_fields(ol.outline(sources(_program(*lines, section="SCREEN")))).collect()
    assert (row["line"], row["col"], row["from_field"], row["to_field"], row["value"]) == (None, 4, "WS-GOTO", "WS-TO-X", "FROM LINE 9")


def test_words_of_an_item_are_found_once(spark, sources):
    items = it.data_items(ol.outline(sources(""))).select("path", "picture", "usage", "value", "occurs", "redefines")
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"""(?=[,;]?(?:\s|\z))""") == 1


def test_the_first_spelling_of_a_keyword_counts(sources):
    text = """       IDENTIFICATION DIVISION.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
       01  A   PICTURE IS X(3) VALUES ARE IS "B" PIC 9.
       05.
       05
           C
           PIC  X VALUE ALL "Z".
"""
    rows = it.data_items(ol.outline(sources(text))).orderBy("item_no").collect()
    assert [(r.name, r.picture, r.value) for r in rows] == [("A", "X(3)", "B"), ("C", "X", 'ALL "Z')]


def test_items_without_hierarchy_are_the_same_items(spark, sources):
    lines = ["01 R.", "   05 A PIC 9.", "      88 A-ON VALUE 1.", "   05 FILLER PIC X.", "77 B COMP-2."]
    outlined = ol.outline(sources({"p": _program(*lines), "q": _program(*lines, section="LINKAGE"), "r": ""}))
    plain = it.data_items(outlined, hierarchy=False)
    placed = it.data_items(outlined)
    assert set(placed.columns) - set(plain.columns) == {
        "parent_no", "depth", "has_children", "parent_level", "parent_name", "parent_clauses"
    }
    assert plain.count() == 10 and plain.exceptAll(placed.select(plain.columns)).count() == 0
    # no stack of open groups is carried along the sentences
    assert "depth" not in plain._jdf.queryExecution().optimizedPlan().toString()
