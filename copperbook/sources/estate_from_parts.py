"""A program estate derived from the ``part`` table: one program per part.

The statement is plain SQL that Spark and other engines read alike. What a
program contains depends on its part, so the estate grows with the table.
"""

from pyspark.sql import DataFrame, SparkSession

_KEY = "CAST(p_partkey AS STRING)"
_SIZE = "CAST(p_size AS STRING)"

# One entry per source line. A plain string is a literal line; a tuple is an SQL
# expression; a dict maps a condition to lines present only when it holds.
_LINES = [
    "       IDENTIFICATION DIVISION.",
    (f"concat('       PROGRAM-ID. PART', {_KEY}, '.')",),
    {"p_size % 9 = 0": ["       CLASS-ID. PARTS-CLASS.", "       METHOD-ID. PRICE-OF."]},
    (f"concat('       AUTHOR. TEAM-', CAST(p_size % 6 AS STRING), '.')",),
    {"p_size % 2 = 0": ["       DATE-WRITTEN. 1989-04-01."]},
    ("concat('      * ', p_name)",),
    "       ENVIRONMENT DIVISION.",
    {"p_size % 10 = 0": ["       COPY ENVBOOK."]},
    "       INPUT-OUTPUT SECTION.",
    "       FILE-CONTROL.",
    (f"concat('           SELECT PART-FILE ASSIGN TO \"P', {_KEY}, '.DAT\"')",),
    ("concat('               ORGANIZATION IS ', CASE p_size % 3 WHEN 0 THEN 'INDEXED' "
     "WHEN 1 THEN 'SEQUENTIAL' ELSE 'LINE SEQUENTIAL' END)",),
    {"p_size % 3 = 0": ["               ACCESS MODE IS DYNAMIC"]},
    "               FILE STATUS IS WS-FS.",
    {"p_size % 4 = 0": ["           SELECT LOG-FILE ASSIGN TO LOGOUT."]},
    "       DATA DIVISION.",
    "       FILE SECTION.",
    "       FD PART-FILE.",
    "       01 PART-REC.",
    (f"concat('          05 PR-KEY PIC 9(', CAST(4 + p_partkey % 20 AS STRING), ').')",),
    ("concat('          05 PR-NAME PIC X(', CAST(10 + p_size AS STRING), ').')",),
    "          05 PR-ALT REDEFINES PR-NAME PIC X(5).",
    "          05 PR-PRICE PIC S9(7)V99 COMP-3.",
    {"p_size % 5 = 0": ["       FD AUDIT-FILE.", "       01 AUDIT-REC PIC X(80)."]},
    "       WORKING-STORAGE SECTION.",
    ("concat('       COPY BOOK', CAST(p_size % 4 AS STRING), '.')",),
    {"p_partkey % 4 = 0": ["           EXEC SQL INCLUDE SQLCA END-EXEC.",
                           "           EXEC SQL DECLARE C1 CURSOR FOR",
                           "               SELECT NAME FROM PARTS WHERE ID > :PR-KEY",
                           "           END-EXEC."]},
    "       01 WS-FLAGS.",
    ("concat('          05 WS-TYPE PIC X(10) VALUE \"', p_type, '\".')",),
    '             88 T-ECONOMY VALUE "ECONOMY".',
    '             88 T-OTHER VALUES "STANDARD" "PROMO".',
    (f"concat('          05 WS-TAB PIC S9(4) COMP OCCURS ', {_SIZE}, ' TIMES.')",),
    (f"concat('          05 WS-ROWS OCCURS 1 TO ', CAST(p_size + 1 AS STRING), ' TIMES DEPENDING ON WS-N.')",),
    "             10 WS-CELL PIC 9(3)V9.",
    "             10 FILLER PIC X(2).",
    "          05 WS-GRADE PIC 9(2) VALUE ZEROES.",
    "             88 G-LOW VALUES 1 THRU 5.",
    "             88 G-MID VALUES 6 THRU 9 12.",
    "       01 FILLER PIC X(4) VALUE SPACES.",
    "       01 WS-TITLE PIC X(60) VALUE \"PARTS AND",
    "      -    PRICES\".",
    {"p_size % 6 = 0": ["       01 WS-NATIONAL PIC N(8).", "       01 WS-PTR USAGE POINTER."],
     "p_size % 6 = 1": ["       01 WS-FLOAT COMP-2.", "       01 WS-SHORT BINARY-SHORT."],
     "p_size % 6 = 2": ["       01 WS-BIG PIC S9(17) COMP-X.", "       01 WS-EDIT PIC ZZ9.99."],
     "p_size % 6 = 3": ["       01 WS-MASK PIC ZZ,ZZ9.99-.", "       01 WS-NV USAGE IS NATIVE-4."]},
    # columns 73 to 80 hold a sequence number
    ("concat(rpad('       77 WS-FS PIC XX.', 72, ' '), 'SEQ00010')",),
    "       77 WS-N PIC S9(9) COMP.",
    {"p_size % 7 = 0": ["       LOCAL-STORAGE SECTION.", "       01 LS-AREA.", "          03 LS-A PIC 9(12).",
                        "          03 LS-G.", "             05 LS-B PIC X.", "                88 LS-ON VALUE 'Y'.",
                        "                88 LS-OFF VALUE 'N'.", "          03 LS-C PIC X(3)."]},
    {"p_size % 8 = 0": ["       LINKAGE SECTION.", "       01 LK-PARM.", "          05 LK-LEN PIC S9(4) COMP.",
                        "          05 LK-TEXT PIC X(100)."]},
    {"p_size % 11 = 0": ["       SCREEN SECTION.", "       01 SCR-MAIN.",
                         '          05 SCR-TITLE LINE 1 COLUMN 20 VALUE "PARTS" HIGHLIGHT.',
                         "          05 SCR-KEY LINE NUMBER IS 3 COL 5 PIC 9(5)",
                         "             FROM WS-N TO PR-KEY."]},
    "       PROCEDURE DIVISION.",
    {"p_size % 13 = 0": ["           DISPLAY \"NO HEADER YET\"."]},
    "       000-MAIN.",
    "           OPEN INPUT PART-FILE.",
    {"p_size % 10 = 0": ["           COPY PROCBOOK."]},
    "           PERFORM CALC-PRICE UNTIL WS-FS = \"10\".",
    "           PERFORM CALC-TAX THRU CALC-SUM.",
    {"p_size % 3 = 1": ["           PERFORM CALC-SUM VARYING WS-N FROM 1 BY 1 UNTIL WS-N > 5."],
     "p_size % 3 = 2": ["           PERFORM CALC-SUM 3 TIMES.",
                        "           PERFORM UNTIL WS-N > 9", "               ADD 1 TO WS-N",
                        "           END-PERFORM."]},
    ("concat('           CALL \"SUB', CAST(p_size % 7 AS STRING), '\" USING BY REFERENCE PART-REC WS-N.')",),
    {"p_partkey % 4 = 0": ["           EXEC SQL SELECT NAME INTO :WS-TYPE FROM PARTS",
                           "               WHERE ID = :PR-KEY AND KIND <> ':NOT-ONE'",
                           "           END-EXEC.",
                           "           EXEC SQL OPEN C1 END-EXEC.",
                           "           EXEC SQL FETCH C1 INTO :WS-TYPE END-EXEC."],
     "p_partkey % 4 = 1": ["           EXEC CICS READ DATASET(PARTS)",
                           "               INTO(PART-REC) RIDFLD(PR-KEY)",
                           "           END-EXEC.",
                           "           EXEC CICS HANDLE CONDITION NOTFND(CALC-SUM) END-EXEC.",
                           "           EXEC CICS POST EVENT(E1) event(E2) END-EXEC."],
     "p_partkey % 4 = 2": ["           CALL \"CBL_TOUPPER\" USING PR-NAME.",
                           "           XML GENERATE WS-TITLE FROM WS-FLAGS.",
                           "           EXEC DLI GU SEGMENT(PART) INTO(PART-REC) END-EXEC."],
     "p_partkey % 4 = 3": ["           UNSTRING PR-NAME DELIMITED BY SPACE INTO WS-TYPE.",
                           "           INSPECT PR-NAME TALLYING WS-N FOR ALL \"A\".",
                           "           EXEC HTML PAGE P1 END-EXEC."]},
    "           READ PART-FILE AT END",
    "               MOVE \"10\" TO WS-FS",
    "           NOT AT END",
    "               MOVE PR-KEY TO WS-N",
    "               IF WS-N > 3",
    "                   ADD 1 TO WS-N",
    "               END-IF",
    "           END-READ.",
    {"p_size % 5 = 1": ["           ENTER TAL \"SUBR\".", "           SORT PART-FILE."],
     "p_size % 5 = 2": ["           CHANGE ATTRIBUTE TITLE OF PART-FILE.", "           INVOKE SELF \"PRICE\"."],
     "p_size % 5 = 3": ["           DISPLAY-ALL PART-REC.", "           STORE PART-REC."],
     "p_size % 5 = 4": ["           DISPLAY \"FORMAT FREE\"."]},
    "           STOP RUN.",
    {"p_size % 4 = 1": ["       PRICE-RULES SECTION.", "           MOVE 0 TO WS-N."]},
    "       CALC-PRICE.",
    (f"concat('           IF PR-KEY > ', {_SIZE})",),
    "               EVALUATE TRUE",
    "                   WHEN WS-N >= 90",
    "                       ADD 1 TO WS-N",
    "                   WHEN WS-N >= 80 AND",
    "                        WS-N < 90",
    "                       ADD 2 TO WS-N",
    "                   WHEN OTHER",
    "                       MOVE ZERO TO WS-N",
    "                       CONTINUE",
    "               END-EVALUATE",
    "           ELSE",
    "               SUBTRACT 1 FROM WS-N",
    "               IF WS-N < 0 MOVE 0 TO WS-N.",
    "           GOBACK.",
    "       CALC-TAX.",
    "           COMPUTE WS-N =",
    "               WS-N * 2.",
    "       CALC-SUM.",
    "      D    DISPLAY \"DEBUG ONLY\".",
    "           GO TO CALC-TAX.",
]


def _quoted(line: str) -> str:
    return "'" + line.replace("'", "''") + "'"


def _entry(entry) -> list[str]:
    if isinstance(entry, str):
        return [_quoted(entry)]
    if isinstance(entry, tuple):
        return [entry[0]]
    # lines that depend on a condition form one argument; NULL is left out
    return [
        f"CASE WHEN {condition} THEN concat_ws(chr(10), {', '.join(_quoted(x) for x in lines)}) END"
        for condition, lines in entry.items()
    ]


def estate_sql(part: str = "part") -> str:
    """SQL text: path and text of one program per row of ``part``.

    One program in 29 is a member whose every line is a comment; one in 11 has
    carriage returns in its line ends.
    """
    lines = ", ".join(x for entry in _LINES for x in _entry(entry))
    return f"""
SELECT path, CASE WHEN p_partkey % 11 = 0 THEN replace(body, chr(10), concat(chr(13), chr(10))) ELSE body END AS text
FROM (SELECT p_partkey,
concat('estate/d', CAST(p_size % 5 AS STRING), '/P', {_KEY}, '.cbl') AS path,
CASE WHEN p_partkey % 29 = 0
THEN concat_ws(chr(10), concat('      * RETIRED MEMBER ', {_KEY}), '      * *> NOTHING LEFT', '')
ELSE concat_ws(chr(10), {lines}) END AS body
FROM {part}) AS programs"""


def estate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estate of a data folder: path, text.

    A part row is a few bytes and its program a few kilobytes, so the rows are
    spread before the text is made rather than after.
    """
    spread = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    part = (
        spark.read.parquet(f"{sf_dir}/part.parquet")
        .select("p_partkey", "p_name", "p_type", "p_size")
        .repartition(spread, "p_partkey")
    )
    return spark.sql(estate_sql("{part}"), part=part)
