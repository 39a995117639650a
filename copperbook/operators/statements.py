"""Statements of the procedure divisions and what they refer to.

Cutting a procedure division into statements, and following its blocks, is
work within the row of a file; nothing here needs an exchange.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copperbook.functions import clauses as cl
from copperbook.functions import source_text as st
from copperbook.functions.folds import running
from copperbook.functions.text import built_once, class_of, drop_period, let, strip, word
from copperbook.vocabulary import (
    BULL_WORDS,
    CICS_CLASSES,
    CICS_HANDLE_CLASSES,
    EXEC_KINDS,
    FUJITSU_FORMAT_WORDS,
    NEC_WORDS,
    ONE_WORD_TYPES,
    SQL_CLASSES,
    TERMINATORS,
    TWO_WORD_TYPES,
    UNISYS_RULES,
    USING_WORDS,
)


# An array is exploded as an expression, not as a computed column: a filter on its
# size would be derived for a column and compute the array a second time.


@built_once
def _marked() -> Column:
    return st.marked_statements(st.statement_texts(F.col("procedure_text")))


@built_once
def _paragraphs() -> Column:
    return st.paragraphs(F.col("marked"))


def with_marked(outlined: DataFrame) -> DataFrame:
    """Add ``marked``, the statements with a marker before each."""
    return outlined.withColumn("marked", _marked())


def with_procedure(outlined: DataFrame) -> DataFrame:
    """Add ``marked`` and ``paragraphs``."""
    return with_marked(outlined).withColumn("paragraphs", _paragraphs())


def paragraphs(outlined: DataFrame) -> DataFrame:
    """path, paragraph_no, section, paragraph; section is empty outside sections."""
    return (
        with_marked(outlined)
        .select("path", F.posexplode(_paragraphs()).alias("pos", "p"))
        .select("path", (F.col("pos") + 1).alias("paragraph_no"), "p.section", "p.paragraph")
    )


def paragraph_list() -> Column:
    """array<struct<section, paragraph>> of one file, over ``with_marked``."""
    return _paragraphs()


@built_once
def service_candidates() -> Column:
    """array<struct<part, key>> of one file: a row per paragraph with a prefix."""
    named = F.filter(_paragraphs(), lambda p: p.paragraph.contains("-"))
    return F.transform(
        named,
        lambda p: F.struct(
            F.lit("services").alias("part"), F.substring_index(F.upper(p.paragraph), "-", 1).alias("key")
        ),
    )


def with_verb_type(rows: DataFrame) -> DataFrame:
    """Add stmt_type, null for ELSE, WHEN and block terminators."""
    first, second = F.col("first_word"), F.col("second_word")
    both = F.concat_ws(" ", first, second)
    stmt_type = (
        F.when(first.isin(TERMINATORS + ["ELSE", "WHEN"]), F.lit(None).cast("string"))
        .when((first == "EXEC") & second.isin(EXEC_KINDS), both)
        .when(first == "EXEC", F.lit("EXEC OTHER"))
        .when(both.isin(TWO_WORD_TYPES), both)
        .when(first.isin(ONE_WORD_TYPES), first)
        .otherwise(F.lit("UNKNOWN"))
    )
    words = rows.withColumns(
        {"first_word": F.upper(word(F.col("text"), 1)), "second_word": F.upper(word(F.col("text"), 2))}
    )
    return words.withColumn("stmt_type", stmt_type).drop("first_word", "second_word")


def _statement_rows(outlined: DataFrame, array: Column) -> DataFrame:
    """Rows of an array of statements (with or without their blocks)."""
    rows = with_marked(outlined).select("path", F.posexplode(array).alias("pos", "s"))
    return rows.select("path", (F.col("pos") + 1).alias("stmt_no"), "s.*").where(F.col("text") != "")


@built_once
def _statement_array() -> Column:
    every = st.statements_of(_paragraphs())
    return F.transform(
        every,
        lambda s: F.struct(
            s.paragraph_no.alias("paragraph_no"),
            s.section.alias("section"),
            s.paragraph.alias("paragraph"),
            s.sentence_no.alias("sentence_no"),
            drop_period(s.text).alias("text"),
        ),
    )


def statements(outlined: DataFrame) -> DataFrame:
    """path, stmt_no, paragraph_no, section, paragraph, sentence_no, text,
    stmt_type.

    Block words (ELSE, WHEN, END-...) are rows with a null type. ``text`` has
    no final period.
    """
    return with_verb_type(_statement_rows(outlined, _statement_array()))


def verb_types(stmts: DataFrame) -> DataFrame:
    """The statements that have a type."""
    return stmts.where(F.col("stmt_type").isNotNull())


def _blocks(stmts: Column) -> Column:
    """array<struct<depth, branch>>: a stack of open branches along statements."""
    start = F.struct(
        F.lit("").alias("sentence"),
        F.array().cast("array<string>").alias("open"),
        F.lit(False).alias("in_read"),
    )

    def step(state, s):
        upper = F.upper(s.text)
        sentence = F.concat_ws(":", s.paragraph_no, s.sentence_no)
        facts = F.struct(
            F.when(sentence == state.sentence, state.open)
            .otherwise(F.array().cast("array<string>"))
            .alias("open"),
            ((sentence == state.sentence) & state.in_read).alias("in_read"),
            F.regexp_extract(upper, r"^(\S+)", 1).alias("head"),
            upper.alias("upper"),
        )

        def apply(f):
            head, now = f.getField("head"), f.getField("open")
            opens_read = (head == "READ") & f.upper.contains("AT END") & ~f.upper.contains("END-READ")
            opens = head.isin("IF", "EVALUATE") | opens_read
            closes = head.isin("END-IF", "END-EVALUATE") | ((head == "END-READ") & f.in_read)
            divides = head.isin("ELSE", "WHEN") | ((head == "NOT") & f.upper.rlike(r"^NOT\s+AT\s+END\b"))
            label = (
                F.when(head == "IF", F.lit("THEN"))
                .when(head == "READ", F.lit("AT END"))
                .when(head == "ELSE", F.lit("ELSE"))
                .when(head == "NOT", F.lit("NOT AT END"))
                .when(head == "WHEN", F.concat(F.lit("WHEN "), F.trim(F.substr(s.text, F.lit(5)))))
                .otherwise(F.lit(""))
            )
            outer = F.when(F.size(now) > 0, F.slice(now, F.lit(1), F.size(now) - F.lit(1))).otherwise(now)
            # the stack a statement stands under, and the one that follows it
            around = F.when(closes | divides, outer).otherwise(now)
            after = (
                F.when(opens, F.array_append(now, label))
                .when(closes, outer)
                .when(divides & (F.size(now) > 0), F.array_append(outer, label))
                .otherwise(now)
            )
            return F.struct(
                F.struct(
                    sentence.alias("sentence"),
                    after.alias("open"),
                    F.when(head == "READ", opens_read).otherwise(f.in_read).alias("in_read"),
                ).alias("state"),
                F.struct(
                    F.size(around).alias("depth"),
                    F.coalesce(F.get(around, F.size(around) - F.lit(1)), F.lit("")).alias("branch"),
                ).alias("out"),
            )

        done = let(facts, apply)
        return done

    return running(stmts, start, step, "struct<depth:int,branch:string>")


def block_depth(outlined: DataFrame) -> DataFrame:
    """The columns of ``statements`` with depth and branch.

    IF, EVALUATE and READ ... AT END open a block; END-IF, END-EVALUATE,
    END-READ and the period close it. A closing word with nothing open counts
    for nothing. ``branch`` names the part of the enclosing block: THEN, ELSE,
    WHEN <value>, AT END or NOT AT END; empty at depth 0.
    """
    return with_verb_type(_statement_rows(outlined, _block_array()))


@built_once
def _block_array() -> Column:
    return let(
        _statement_array(),
        lambda every: let(
            _blocks(every),
            lambda blocks: F.transform(
                every,
                lambda s, i: F.struct(
                    s.paragraph_no.alias("paragraph_no"),
                    s.section.alias("section"),
                    s.paragraph.alias("paragraph"),
                    s.sentence_no.alias("sentence_no"),
                    s.text.alias("text"),
                    F.get(blocks, i).depth.alias("depth"),
                    F.get(blocks, i).branch.alias("branch"),
                ),
            ),
        ),
    )


_EXEC = r"(?is)^EXEC\s+(\w+)\s+(.*?)\s*END-EXEC"


def exec_blocks(outlined: DataFrame) -> DataFrame:
    """path, division, block_no, exec_type, command, body.

    Blocks of the procedure division, and SQL blocks of the data division.
    """
    procedure = F.transform(
        F.filter(
            st.statement_texts(F.col("procedure_text")), lambda s: s.rlike(_EXEC)
        ),
        lambda s: F.struct(F.lit("PROCEDURE").alias("division"), s.alias("text")),
    )
    data = F.transform(
        F.filter(
            F.flatten(F.transform(st.data_lists(F.col("data_text")), lambda x: st.data_sentences(x.body))),
            lambda s: s.rlike(_EXEC) & F.upper(s).contains("EXEC SQL"),
        ),
        lambda s: F.struct(F.lit("DATA").alias("division"), s.alias("text")),
    )
    rows = outlined.select("path", F.posexplode(F.concat(data, procedure)).alias("pos", "b")).select(
        "path",
        "b.division",
        (F.col("pos") + 1).alias("block_no"),
        F.upper(F.regexp_extract("b.text", _EXEC, 1)).alias("exec_type"),
        strip(F.regexp_extract("b.text", _EXEC, 2)).alias("body"),
    )
    command = word(F.col("body"), 1)
    known = F.col("exec_type").isin(EXEC_KINDS)
    return rows.select(
        "path",
        "division",
        "block_no",
        "exec_type",
        F.when(known & (command == ""), "UNKNOWN")
        .when(known, F.upper(command))
        .otherwise(command)
        .alias("command"),
        "body",
    )


def sql_blocks(blocks: DataFrame) -> DataFrame:
    """path, division, block_no, command, sql_class, host_vars, copybook.

    Names inside quotes are no host variables.
    """
    unquoted = F.regexp_replace("body", r"""'[^']*'|"[^"]*\"""", " ")
    return blocks.where(F.col("exec_type") == "SQL").select(
        "path",
        "division",
        "block_no",
        "command",
        class_of(F.col("command"), SQL_CLASSES, "OTHER").alias("sql_class"),
        F.regexp_extract_all(unquoted, F.lit(r":([A-Za-z0-9-]+)"), F.lit(1)).alias("host_vars"),
        F.when(F.col("command") == "INCLUDE", word(F.col("body"), 2)).otherwise(F.lit("")).alias("copybook"),
    )


def parameters(body: Column) -> Column:
    """map of the KEY(VALUE) pairs; keys in upper case, the last of a key wins."""
    pairs = F.regexp_extract_all(body, F.lit(r"(\w+\s*\([^)]*\))"), F.lit(1))
    key = lambda p: F.upper(F.regexp_extract(p, r"^(\w+)", 1))
    entries = F.transform(
        pairs,
        lambda p: F.struct(key(p).alias("key"), strip(F.regexp_extract(p, r"\(([^)]*)\)", 1)).alias("value")),
    )
    last = F.filter(
        entries,
        lambda e, n: ~F.exists(F.slice(entries, n + 2, F.size(entries)), lambda o: o.key == e.key),
    )
    return F.map_from_entries(last)


def cics_blocks(blocks: DataFrame) -> DataFrame:
    """path, block_no, command, cics_class, params."""
    command, sub = F.col("command"), F.upper(word(F.col("body"), 2))
    handle = F.when(F.lit(False), F.lit(""))
    for name, label in CICS_HANDLE_CLASSES.items():
        handle = handle.when(sub == name, F.lit(label))
    return blocks.where(F.col("exec_type") == "CICS").select(
        "path",
        "block_no",
        "command",
        F.when(command == "HANDLE", handle.otherwise(F.lit("ERROR_HANDLING")))
        .otherwise(class_of(command, CICS_CLASSES, "OTHER"))
        .alias("cics_class"),
        parameters(F.col("body")).alias("params"),
    )


def dli_blocks(blocks: DataFrame) -> DataFrame:
    """path, block_no, command, dli_class, params."""
    return blocks.where(F.col("exec_type") == "DLI").select(
        "path", "block_no", "command", F.lit("IMS").alias("dli_class"), parameters(F.col("body")).alias("params")
    )


_CALL = r"""(?i)CALL\s+["'](\S+)["']"""


def calls(stmts: DataFrame) -> DataFrame:
    """path, stmt_no, callee, args: CALL with a literal program name."""
    using = F.regexp_extract("text", rf"{_CALL}\s*USING\s+(.*)", 2)
    # a comma or semicolon before a blank parts two arguments like the blank itself
    args = F.filter(F.split(strip(using), r"[,;]?\s+|[,;]$"), lambda a: (a != "") & ~F.upper(a).isin(USING_WORDS))
    return stmts.where((F.col("stmt_type") == "CALL") & F.col("text").rlike(_CALL)).select(
        "path", "stmt_no", F.regexp_extract("text", _CALL, 1).alias("callee"), args.alias("args")
    )


def goto_targets(stmts: DataFrame) -> DataFrame:
    """path, stmt_no, source, target."""
    return stmts.where(F.col("stmt_type") == "GO TO").select(
        "path",
        "stmt_no",
        F.col("paragraph").alias("source"),
        strip(F.regexp_extract("text", r"(?i)GO\s+TO\s+(.*)", 1)).alias("target"),
    )


def perform_targets(stmts: DataFrame) -> DataFrame:
    """path, stmt_no, source, form, target, thru_target.

    Forms are VARYING, UNTIL, TIMES, THRU, PLAIN, and INLINE for a loop that
    performs no paragraph; INLINE has no target.
    """
    cut = cl.words(F.col("text"))
    performed = stmts.where(F.col("stmt_type") == "PERFORM").select("*", cut.alias("cut"), cl.in_capitals(cut).alias("capitals"))

    def at(place: int) -> Column:
        """A word in capitals, the verb being 0; empty past the end."""
        return F.coalesce(F.get("capitals", F.lit(place)), F.lit(""))

    first = F.coalesce(F.get("cut", F.lit(1)), F.lit(""))
    inline = at(1).isin("UNTIL", "VARYING", "WITH", "TEST", "") | (at(2) == "TIMES")
    through = at(2).isin("THRU", "THROUGH") & (at(3) != "")
    varying = (at(2) == "VARYING") & (at(4) == "FROM") & (at(6) == "BY") & (at(8) == "UNTIL")
    form = (
        F.when(inline, "INLINE")
        .when(varying, "VARYING")
        .when((at(2) == "UNTIL") & (at(3) != ""), "UNTIL")
        .when(at(3) == "TIMES", "TIMES")
        .when(through, "THRU")
        .otherwise("PLAIN")
    )
    return performed.select(
        "path",
        "stmt_no",
        F.col("paragraph").alias("source"),
        form.alias("form"),
        F.when(inline, F.lit("")).otherwise(first).alias("target"),
        F.when(~inline & through, F.get("cut", F.lit(3))).otherwise(F.lit("")).alias("thru_target"),
    )


def dialect_flags(stmts: DataFrame) -> DataFrame:
    """path, stmt_no, dialect, flag: statements that use dialect keywords."""
    upper = F.upper("text")

    def any_of(words):
        hit = F.lit(False)
        for w in words:
            hit = hit | upper.contains(w)
        return hit

    unisys = F.lit(None).cast("string")
    for flag, start, *held in reversed(UNISYS_RULES):
        holds = upper.startswith(start)
        for w in held:
            holds = holds & upper.contains(w)
        unisys = F.when(holds, flag).otherwise(unisys)
    flags = F.array(
        F.struct(F.lit("unisys").alias("dialect"), unisys.alias("flag")),
        F.struct(
            F.lit("fujitsu").alias("dialect"),
            F.when(upper.contains("FORMAT") & any_of(FUJITSU_FORMAT_WORDS), "FORMAT").alias("flag"),
        ),
        F.struct(F.lit("nec").alias("dialect"), F.when(any_of(NEC_WORDS), "ACOS").alias("flag")),
        F.struct(F.lit("bull").alias("dialect"), F.when(any_of(BULL_WORDS), "GCOS").alias("flag")),
    )
    return (
        stmts.select("path", "stmt_no", F.explode(flags).alias("f"))
        .where(F.col("f.flag").isNotNull())
        .select("path", "stmt_no", "f.dialect", "f.flag")
    )
