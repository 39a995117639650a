"""Source text of one file -> clean text -> divisions -> sentences.

Everything here is an expression over the text of one file, so a file is never
taken apart by a shuffle and put together again: splitting text into lines or
statements costs no exchange, whatever the number of files or their sizes.
The clean text keeps one line per newline; statements become arrays.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from copperbook.functions.text import BLANKS, drop_period, let, no_dots, split_at, strip, word
from copperbook.vocabulary import (
    DATA_SECTIONS,
    DIVISION_HEADERS,
    TERMINATORS,
    VERBS,
)

# Control characters mark positions inside working text; ``printable`` keeps
# them out of what is read.
CONTINUED = "\x01"
STATEMENT = "\x02"
PARAGRAPH = "\x03"
SECTION = "\x04"

BLANKS_IN_LINE = BLANKS.replace("\n", "")

_WORD = r"[A-Z0-9][-A-Z0-9]*"
_STARTERS = "|".join(VERBS + TERMINATORS + ["ELSE", "WHEN", "NOT"])
# A statement starts at a verb, a block word or a header line, and after a period.
# The line end comes first in the pattern, so other characters are passed over.
_STATEMENT_BREAK = (
    rf"(?i)\n(?:(?=(?:{_STARTERS})(?:\s|\.*(?:\n|\z)))"
    rf"|(?={_WORD}[^\S\n]*(?:\.[^\S\n]*|[^\S\n]+SECTION[^\S\n]*\.?)(?:\n|\z))"
    r"|(?<=\.\n))"
)
# Several statements in a line: the next one stands after a period and a blank, or
# is the verb after a condition; neither inside quotes.
_REST_UNQUOTED = r"""(?=[^"\n]*(?:"[^"\n]*"[^"\n]*)*(?:\n|\z))(?=[^'\n]*(?:'[^'\n]*'[^'\n]*)*(?:\n|\z))"""
_NEXT_IN_LINE = rf"\.[ \t]+(?=[A-Za-z0-9]){_REST_UNQUOTED}"
_VERB_IN_LINE = rf"""(?im)^((?:IF|ELSE)(?=\s)(?:[^"'\n]|"[^"\n]*"|'[^'\n]*')*?)[ \t]+(?=(?:{'|'.join(VERBS)})(?:\s|$))"""
_DATA_BREAK = r"(?i)\n(?:(?=COPY\s)|(?<=\.\n))"
# The first look-ahead turns most lines away before the alternatives are tried.
_DIVISION_BREAK = rf"(?i)\n(?=[^\n]*DIVISION)(?=[^\n]*(?:{'|'.join(h for hs in DIVISION_HEADERS.values() for h in hs)}))"
SECTION_BREAK = rf"(?i)\n(?=[^\n]* SECTION)(?=[^\n]*(?:{'|'.join(DATA_SECTIONS)}) SECTION)"


def _unix(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def physical_lines(text: Column) -> Column:
    """Array of raw lines; a final line end does not open one more line."""
    return F.split(
        let(_unix(text), lambda t: F.when(t.endswith("\n"), F.left(t, F.length(t) - F.lit(1))).otherwise(t)), "\n"
    )


def printable(text: Column) -> Column:
    """The text with a blank for each control character used as a marker."""
    found = text.contains("\x01")
    for mark in "\x02\x03\x04\x05\x06":
        found = found | text.contains(mark)
    return F.when(found, F.translate(text, "\x01\x02\x03\x04\x05\x06", " " * 6)).otherwise(text)


def _odd_blanks(text: Column) -> Column:
    """True when lines may start or end with a blank that is not a space."""
    found = text.contains("\t")
    for blank in "\f\x0b\u00a0\u3000":
        found = found | text.contains(blank)
    return found


def fixed_line(raw: Column, trim=strip) -> tuple[Column, Column]:
    """Kind and content of one fixed-format line.

    Column 7 decides: ``*`` ``/`` ``D`` drop the line, ``-`` continues the
    previous one. Lines shorter than 7 characters are kept whole.
    """
    indicator = F.substring(raw, 7, 1)
    short = F.length(raw) < 7
    kind = (
        F.when(short, "code")
        .when(indicator.isin("*", "/", "D", "d"), "comment")
        .when(indicator == "-", "continuation")
        .otherwise("code")
    )
    content = (
        F.when(short, trim(raw))
        .when(indicator == "-", trim(F.substring(raw, 8, 65)))
        .otherwise(trim(F.substring(raw, 7, 66)))
    )
    return kind, content


# Each line is found after its line end: what stands beyond column 72, a mark in column 7
# with the blanks after it, and the columns before 7 or a whole comment line.
_BEYOND = r"\n([^\n]{72})[^\n]++"
_CONTINUES = rf"\n[^\n]{{6}}-[{BLANKS_IN_LINE}]*+"
_BEFORE = rf"\n[^\n{CONTINUED}][^\n]{{5}}(?:[*/Dd][^\n]*+|(?=[^\n]))"


def fixed_text(text: Column) -> Column:
    """Clean text of a fixed-format file, continuation lines joined.

    Columns are cut by patterns over the whole text; only blanks are trimmed line by
    line, since each step taken line by line costs as much as a pattern.
    """
    within = F.regexp_replace(F.concat(F.lit("\n"), _unix(text)), _BEYOND, "\n$1")
    marked = F.regexp_replace(within, _CONTINUES, f"\n{CONTINUED}")
    lines = F.split(F.regexp_replace(marked, _BEFORE, "\n"), "\n")

    def kept(trim):
        return F.array_join(F.filter(F.transform(lines, lambda x: trim(x)), lambda x: ~x.isin("", CONTINUED)), "\n")

    def continued(joined):
        # a continuation with nothing before it has nothing to continue
        alone = F.regexp_replace(joined, rf"\A(?:{CONTINUED}[^\n]*(?:\n|\z))++", "")
        anchored = F.when(joined.startswith(CONTINUED), alone).otherwise(joined)
        return F.replace(anchored, F.lit("\n" + CONTINUED), F.lit(" "))

    return let(F.when(_odd_blanks(text), kept(strip)).otherwise(kept(F.trim)), continued)


def free_text(text: Column) -> Column:
    """Clean text of a free-format file."""
    trimmed = F.transform(physical_lines(text), strip)
    return F.array_join(F.filter(trimmed, lambda x: (x != "") & ~x.startswith("*>")), "\n")


def has_real_line(clean: Column) -> Column:
    """True when some line has three characters or more."""
    return clean.rlike(r"[^\n]{3}")


def first_line(block: Column) -> Column:
    return F.substring_index(block, "\n", 1)


def body_of(block: Column) -> Column:
    """The block without its first line."""
    return F.when(
        F.instr(block, "\n") > 0, F.substr(block, F.instr(block, "\n") + F.lit(1))
    ).otherwise(F.lit(""))


def division_of(line: Column) -> Column:
    upper = F.upper(line)
    out = F.when(F.lit(False), F.lit(""))
    for name, headers in DIVISION_HEADERS.items():
        hit = F.lit(False)
        for header in headers:
            hit = hit | upper.contains(header)
        out = out.when(hit, F.lit(name))
    return out.otherwise(F.lit(""))


def data_section_of(line: Column) -> Column:
    upper = F.upper(line)
    out = F.when(F.lit(False), F.lit(""))
    for name in DATA_SECTIONS:
        out = out.when(upper.contains(name + " SECTION"), F.lit(name))
    return out.otherwise(F.lit(""))


def division_blocks(code: Column) -> Column:
    """array<struct<division, block>>; the first line of a block is its header.

    Reading stops where the procedure division ends.
    """
    blocks = split_at(code, _DIVISION_BREAK)
    tagged = F.transform(
        blocks,
        lambda b: F.struct(division_of(first_line(b)).alias("division"), b.alias("block")),
    )
    return tagged


def through_procedure(blocks: Column) -> Column:
    """Blocks up to and including the first procedure division."""
    at = F.array_position(F.transform(blocks, lambda b: b.division), "PROCEDURE")
    return F.when(at > 0, F.slice(blocks, F.lit(1), at.cast("int"))).otherwise(blocks)


def division_text(blocks: Column, division: str) -> Column:
    """Lines of one division, without its header line."""
    chosen = F.filter(blocks, lambda b: b.division == division)
    return F.array_join(F.filter(F.transform(chosen, lambda b: body_of(b.block)), lambda x: x != ""), "\n")


def data_lists(data_text: Column) -> Column:
    """array<struct<section, fd, body>>: one entry per section, or per FD.

    REPORT and COMMUNICATION sections hold no items for us. Lines of a FILE
    section before its first FD belong to nothing, and so do lines after an FD
    that stands in another section.
    """
    sections = split_at(data_text, SECTION_BREAK)

    def entry(name, fd, body):
        return F.struct(name.alias("section"), fd.alias("fd"), body.alias("body"))

    def entries(section):
        return let(
            F.struct(
                data_section_of(first_line(section)).alias("name"),
                split_at(F.concat(F.lit("\n"), body_of(section)), r"(?i)\n(?=FD\s)").alias("parts"),
            ),
            lambda s: F.when(
                s.getField("name") == "FILE",
                F.transform(
                    F.filter(s.parts, lambda p: p.rlike(r"(?i)^FD\s")),
                    lambda p: entry(
                        F.lit("FILE"),
                        F.upper(no_dots(F.regexp_extract(first_line(p), r"(?i)^FD\s+(\S+)", 1))),
                        body_of(p),
                    ),
                ),
            )
            .when(
                s.getField("name").isin("WORKING-STORAGE", "LOCAL-STORAGE", "LINKAGE", "SCREEN"),
                F.array(
                    entry(s.getField("name"), F.lit(""), F.ltrim(F.element_at(s.parts, 1), F.lit("\n")))
                ),
            )
            .otherwise(F.filter(F.array(entry(F.lit(""), F.lit(""), F.lit(""))), lambda _: F.lit(False))),
        )

    return F.flatten(F.transform(sections, entries))


# An EXEC line opens a block that runs to the end of the line with END-EXEC, or
# to the end of the text where there is none.
_EXEC_BLOCK = r"(?is)\nEXEC (?:.*?END-EXEC[^\n]*|.*\z)"
_CUT = "\x05"


def _cut(text: Column, plain_pieces) -> Column:
    """Cut text into pieces, keeping each EXEC ... END-EXEC block whole."""

    def interleave(f):
        return F.flatten(
            F.transform(
                F.split(F.regexp_replace(f.text, _EXEC_BLOCK, _CUT), _CUT),
                lambda plain, i: F.concat(plain_pieces(plain), F.slice(f.blocks, i + 1, F.lit(1))),
            )
        )

    def cut(opened):
        blocks = F.transform(
            F.regexp_extract_all(opened, F.lit(_EXEC_BLOCK), F.lit(0)),
            lambda b: F.trim(F.replace(b, F.lit("\n"), F.lit(" "))),
        )
        return F.when(
            opened.rlike(r"(?i)\nEXEC "),
            let(F.struct(opened.alias("text"), blocks.alias("blocks")), interleave),
        ).otherwise(plain_pieces(opened))

    return let(F.concat(F.lit("\n"), text), cut)


def _split_flat(text: Column, pattern: str) -> Column:
    """Split, put each piece on one line and drop the empty ones."""
    return F.filter(
        F.transform(split_at(text, pattern), lambda p: F.trim(F.replace(p, F.lit("\n"), F.lit(" ")))),
        lambda p: p != "",
    )


def data_sentences(body: Column) -> Column:
    """Sentences of a data section body: items, COPY lines and EXEC blocks."""

    def plain(text):
        # a COPY line stands alone, with or without its period
        closed = F.regexp_replace(text, r"(?im)^(COPY\s[^\n]*[^\n.])$", "$1.")
        return _split_flat(F.when(text.rlike(r"(?i)COPY\s"), closed).otherwise(text), _DATA_BREAK)

    return _cut(body, plain)


def statement_texts(procedure: Column) -> Column:
    """Statements and headers of a procedure division, COPY lines left out."""
    without_copy = F.array_join(
        F.filter(F.split(procedure, "\n"), lambda x: F.upper(F.left(x, F.lit(5))) != "COPY "), "\n"
    )
    kept = F.when(procedure.rlike(r"(?im)^COPY "), without_copy).otherwise(procedure)
    one_each = F.regexp_replace(F.regexp_replace(kept, _NEXT_IN_LINE, ".\n"), _VERB_IN_LINE, "$1\n")
    return _cut(one_each, lambda text: _split_flat(text, _STATEMENT_BREAK))


def marked_statements(statements: Column) -> Column:
    """One string per program in which a marker character precedes each
    statement, paragraph header and section header."""

    not_header = VERBS + TERMINATORS + ["ELSE", "WHEN"]

    def mark(s):
        # most statements have a blank and no SECTION, which settles it
        marker = let(
            F.upper(s),
            lambda u: F.when(u.contains(" ") & ~u.contains("SECTION"), F.lit(STATEMENT))
            .when(u.rlike(rf"^{_WORD}\s+SECTION\s*\.*$"), F.lit(SECTION))
            .when(u.rlike(rf"^{_WORD}\s*\.*$") & ~drop_period(u).isin(not_header), F.lit(PARAGRAPH))
            .otherwise(F.lit(STATEMENT)),
        )
        return F.concat(marker, s)

    return F.array_join(F.transform(statements, mark), "")


def section_count(marked: Column) -> Column:
    return F.length(marked) - F.length(F.replace(marked, F.lit(SECTION), F.lit("")))


def paragraphs(marked: Column) -> Column:
    """array<struct<section, paragraph, body>> in source order.

    Statements before the first paragraph header of the program or of a
    section form a paragraph named MAIN.
    """

    def header(block):
        return F.upper(drop_period(F.regexp_extract(block, rf"^([^{STATEMENT}]*)", 1)))

    def paragraph(section, p, k):
        return F.struct(
            section.alias("section"),
            F.when(k > 0, header(p)).otherwise(F.lit("MAIN")).alias("paragraph"),
            F.when(F.instr(p, STATEMENT) > 0, F.substr(p, F.instr(p, STATEMENT) + F.lit(1)))
            .otherwise(F.lit(""))
            .alias("body"),
            (k > 0).alias("has_header"),
        )

    def in_section(block, n):
        return let(
            F.split(block, PARAGRAPH),
            lambda parts: let(
                F.when(n > 0, word(header(F.element_at(parts, 1)), 1)).otherwise(F.lit("")),
                lambda name: F.transform(parts, lambda p, k: paragraph(name, p, k)),
            ),
        )

    blocks = F.split(marked, SECTION)
    every = F.flatten(F.transform(blocks, in_section))
    return F.filter(every, lambda p: p.has_header | (p.body != ""))


def statements_of(paras: Column) -> Column:
    """array<struct<paragraph_no, section, paragraph, sentence_no, text>>."""

    def in_paragraph(p, n):
        sentences = F.split(F.replace(p.body, F.lit("." + STATEMENT), F.lit("." + _CUT)), _CUT)
        return F.flatten(
            F.transform(
                sentences,
                lambda sentence, k: F.transform(
                    F.filter(F.split(sentence, STATEMENT), lambda x: x != ""),
                    lambda s: F.struct(
                        (n + 1).alias("paragraph_no"),
                        p.section.alias("section"),
                        p.paragraph.alias("paragraph"),
                        (k + 1).alias("sentence_no"),
                        s.alias("text"),
                    ),
                ),
            )
        )

    return F.flatten(F.transform(paras, in_paragraph))
