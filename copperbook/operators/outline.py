"""Lines, divisions and headers of a program estate.

``sources`` is a table with ``path`` and ``text``, one row per file. All
operators of this module are narrow: no exchange, no window, no join.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copperbook.functions import clauses as cl
from copperbook.functions import source_text as st
from copperbook.functions.text import built_once, let, no_dots, split_at


def physical_lines(sources: DataFrame) -> DataFrame:
    """path, line_no, raw."""
    return sources.select(
        "path", F.posexplode(st.physical_lines(F.col("text"))).alias("pos", "raw")
    ).select("path", (F.col("pos") + 1).alias("line_no"), "raw")


def clean_fixed(sources: DataFrame) -> DataFrame:
    """path, line_no, kind, content: columns 7-72 of the lines that count.

    ``line_no`` is the physical line; continuation lines are still apart.
    """
    kind, content = st.fixed_line(F.col("raw"))
    return (
        physical_lines(sources)
        .select("path", "line_no", kind.alias("kind"), content.alias("content"))
        .where((F.col("kind") != "comment") & (F.col("content") != ""))
    )


@built_once
def _fixed_code() -> Column:
    return st.fixed_text(F.col("text"))


@built_once
def _free_code() -> Column:
    return st.free_text(F.col("text"))


@built_once
def _auto_code() -> Column:
    fixed = F.col("fixed_code")
    return F.when(st.has_real_line(fixed), fixed).otherwise(_free_code())


@built_once
def _blocks() -> Column:
    return st.division_blocks(F.col("code"))


@built_once
def _division_texts() -> list[Column]:
    read = F.col("read_blocks")
    return [
        st.division_text(read, name).alias(f"{name.lower()}_text")
        for name in ("IDENTIFICATION", "ENVIRONMENT", "DATA", "PROCEDURE")
    ]


def with_clean_text(sources: DataFrame, format: str = "auto") -> DataFrame:
    """Add ``code``, the clean text.

    ``auto`` reads fixed format and falls back to free format when that leaves
    nothing, or only lines of one or two characters.
    """
    if format not in ("auto", "fixed", "free"):
        raise ValueError(f"format is auto, fixed or free, not {format!r}")
    readable = sources.withColumn("text", st.printable(F.col("text")))
    if format == "fixed":
        return readable.withColumn("code", _fixed_code())
    if format == "free":
        return readable.withColumn("code", _free_code())
    return (
        readable.withColumn("fixed_code", _fixed_code()).withColumn("code", _auto_code()).drop("fixed_code")
    )


def clean_lines(sources: DataFrame, format: str = "auto") -> DataFrame:
    """path, line_no, content: comments gone, continuations joined."""
    cleaned = with_clean_text(sources, format)
    return (
        cleaned.select("path", F.posexplode(F.split("code", "\n")).alias("pos", "content"))
        .where(F.col("content") != "")
        .select("path", (F.col("pos") + 1).alias("line_no"), "content")
    )


def outline(sources: DataFrame, format: str = "auto") -> DataFrame:
    """One row per file: path, code, blocks and the text of each division.

    Other columns of ``sources`` but ``text`` are dropped. This is the common
    start of the estate operators; it reads the text once.
    """
    cleaned = with_clean_text(sources.select("path", "text"), format).select("path", "code")
    blocks = cleaned.withColumn("blocks", _blocks()).withColumn(
        "read_blocks", st.through_procedure(F.col("blocks"))
    )
    return blocks.select("path", "code", "blocks", *_division_texts())


def tagged_lines(outlined: DataFrame) -> DataFrame:
    """path, line_no, division, data_section, content.

    A header line belongs to what it opens. ``data_section`` is empty outside
    the data division and before its first section header.
    """

    def lines_of(block):
        # an entry of a section keeps its lines; the block header comes first
        parts = split_at(block.block, st.SECTION_BREAK)

        def tag(part, n):
            section = F.when(
                (block.division == "DATA") & (n > 0), st.data_section_of(st.first_line(part))
            ).otherwise(F.lit(""))
            return F.transform(
                F.split(part, "\n"),
                lambda c: F.struct(
                    block.division.alias("division"), section.alias("data_section"), c.alias("content")
                ),
            )

        return F.flatten(F.transform(parts, tag))

    return (
        outlined.select(
            "path",
            F.posexplode(F.flatten(F.transform("blocks", lines_of))).alias("pos", "line"),
        )
        .select(
            "path",
            (F.col("pos") + 1).alias("line_no"),
            "line.division",
            "line.data_section",
            "line.content",
        )
        .where(F.col("content") != "")
    )


def _last_match(lines: Column, keyword: str, before: list[str], pattern: str) -> Column:
    """Value of the last line that holds ``keyword`` and no keyword of ``before``."""

    def relevant(x):
        upper = F.upper(x)
        hit = upper.contains(keyword) & x.rlike(pattern)
        for other in before:
            hit = hit & ~upper.contains(other)
        return hit

    found = F.filter(lines, relevant)
    return F.when(
        F.size(found) > 0, no_dots(F.regexp_extract(F.element_at(found, -1), pattern, 1))
    )


def class_id() -> Column:
    """Name of the class a file declares, or null."""
    lines = F.split("identification_text", "\n")
    return _last_match(lines, "CLASS-ID", ["PROGRAM-ID"], r"(?i)CLASS-ID\.\s*(\S+)")


def program_header(outlined: DataFrame) -> DataFrame:
    """path, program_id, class_id, author, date_written, is_class."""
    lines = F.split("identification_text", "\n")
    found = outlined.select(
        "path",
        _last_match(lines, "PROGRAM-ID", [], r"(?i)PROGRAM-ID\.\s*(\S+)").alias("named_id"),
        class_id().alias("class_id"),
        _last_match(lines, "AUTHOR", ["PROGRAM-ID", "CLASS-ID"], r"(?i)AUTHOR\.\s*(.*)").alias("author"),
        _last_match(
            lines, "DATE-WRITTEN", ["PROGRAM-ID", "CLASS-ID", "AUTHOR"], r"(?i)DATE-WRITTEN\.\s*(.*)"
        ).alias("date_written"),
    )
    return found.select(
        "path",
        F.coalesce("named_id", "class_id").alias("program_id"),
        "class_id",
        "author",
        "date_written",
        F.col("class_id").isNotNull().alias("is_class"),
    )


def _sentences() -> Column:
    """Environment text cut after each period at a line end; lines kept apart."""
    return F.split(F.replace("environment_text", F.lit(".\n"), F.lit(".\x05")), "\x05")


def _environment_sentences(outlined: DataFrame) -> DataFrame:
    """path, sentences: what ends with a period, lines kept apart."""
    return outlined.select(
        "path", "data_text", _sentences().alias("sentences")
    )


_SELECT_START = r"(?i)(?:\A|\n)(SELECT[\s\S]*)\z"


def file_control(outlined: DataFrame) -> DataFrame:
    """path, file_no, select_name, assign_to, organization, access_mode,
    file_status, fd_name.

    An FD joins the SELECT of the same name within its file; an FD without
    one is a row of its own. Both sides sit in the same row, so the full outer
    join is an array operation.
    """

    def select_entry(sentence):
        text = F.replace(F.regexp_extract(sentence, _SELECT_START, 1), F.lit("\n"), F.lit(" "))
        return let(cl.words(text), lambda cut: let(cl.in_capitals(cut), lambda capitals: entry(cut, capitals)))

    def entry(cut, capitals):
        def word(keyword, *optional):
            return no_dots(cl.after(cut, capitals, (keyword,), optional))

        kind = word("ORGANIZATION", "IS")
        line_sequential = (F.upper(kind) == "LINE") & F.array_contains(capitals, "SEQUENTIAL")
        access = word("ACCESS", "MODE", "IS")
        return F.struct(
            word("SELECT").alias("select_name"),
            F.substring_index(F.trim(word("ASSIGN", "TO"), F.lit("'\"")), ".", 1).alias("assign_to"),
            F.when(kind == "", "SEQUENTIAL").when(line_sequential, F.lit("LINE SEQUENTIAL")).otherwise(kind).alias("organization"),
            F.when(access == "", "SEQUENTIAL").otherwise(access).alias("access_mode"),
            word("STATUS", "IS").alias("file_status"),
        )

    base = _environment_sentences(outlined).select(
        "path",
        F.transform(F.filter("sentences", lambda s: s.rlike(_SELECT_START)), select_entry).alias("selects"),
        F.array_distinct(
            F.transform(
                F.filter(st.data_lists(F.col("data_text")), lambda x: x.section == "FILE"), lambda x: x.fd
            )
        ).alias("fds"),
    )

    def with_fd(s):
        return F.struct(
            s.select_name.alias("select_name"),
            s.assign_to.alias("assign_to"),
            s.organization.alias("organization"),
            s.access_mode.alias("access_mode"),
            s.file_status.alias("file_status"),
            F.when(F.array_contains(F.col("fds"), F.upper(s.select_name)), F.upper(s.select_name))
            .otherwise(F.lit(""))
            .alias("fd_name"),
        )

    def lone_fd(fd):
        return F.struct(
            fd.alias("select_name"),
            F.lit("").alias("assign_to"),
            F.lit("SEQUENTIAL").alias("organization"),
            F.lit("SEQUENTIAL").alias("access_mode"),
            F.lit("").alias("file_status"),
            fd.alias("fd_name"),
        )

    lone = F.array_except("fds", F.transform("selects", lambda s: F.upper(s.select_name)))
    return base.select(
        "path",
        F.posexplode(F.concat(F.transform("selects", with_fd), F.transform(lone, lone_fd))).alias("pos", "f"),
    ).select("path", (F.col("pos") + 1).alias("file_no"), "f.*")


def file_count(lists: Column | None = None) -> Column:
    """Number of rows ``file_control`` has for a file, from its outline row, and from
    its ``data_lists`` where they are a column already."""
    sentences = _sentences()
    names = F.transform(
        F.filter(sentences, lambda s: s.rlike(_SELECT_START)),
        lambda s: F.upper(no_dots(F.regexp_extract(s, r"(?i)(?:\A|\n)SELECT\s+(\S+)", 1))),
    )
    cut = st.data_lists(F.col("data_text")) if lists is None else lists
    fds = F.transform(F.filter(cut, lambda x: x.section == "FILE"), lambda x: x.fd)
    return F.size(names) + F.size(F.array_except(fds, names))


def copies(outlined: DataFrame) -> DataFrame:
    """path, member, division: COPY in the environment and data divisions."""

    def members(sentence):
        # what precedes SELECT in a sentence is read line by line, the rest is SELECT's
        before = F.regexp_replace(sentence, r"(?i)(?:\A|\n)SELECT[\s\S]*\z", "")
        lines = F.filter(F.split(before, "\n"), lambda x: x.rlike(r"(?i)COPY\s+\S"))
        return F.transform(lines, lambda x: no_dots(F.regexp_extract(F.upper(x), r"COPY\s+(\S+)", 1)))

    environment = F.transform(
        F.flatten(F.transform(_sentences(), members)),
        lambda m: F.struct(m.alias("member"), F.lit("ENVIRONMENT").alias("division")),
    )
    data = F.transform(
        F.filter(
            F.flatten(
                F.transform(st.data_lists(F.col("data_text")), lambda x: st.data_sentences(x.body))
            ),
            lambda s: s.rlike(r"(?i)^COPY\s+\S"),
        ),
        lambda s: F.struct(
            no_dots(F.regexp_extract(F.upper(s), r"^COPY\s+(\S+)", 1)).alias("member"),
            F.lit("DATA").alias("division"),
        ),
    )
    return outlined.select("path", F.explode(F.concat(environment, data)).alias("c")).select(
        "path", "c.member", "c.division"
    )


