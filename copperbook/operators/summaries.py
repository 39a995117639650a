"""Summaries per program and over the estate.

Counts that concern one file are expressions over its row. The others group
with partial aggregation first, so a prefix, type or file that owns a large
share of the rows reaches the shuffle as one row per task.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copperbook.functions import source_text as st
from copperbook.functions.text import drop_period, pascal_case
from copperbook.operators import items as it
from copperbook.operators import outline as ol
from copperbook.operators import statements as sm
from copperbook.vocabulary import (
    DIALECT_RULES,
    DIALECTS,
    STATEMENT_TYPES,
    UNCONVERTED_TYPES,
)


def _evidence(upper: Column, hint: str) -> Column:
    return upper.rlike(hint[3:]) if hint.startswith("re:") else upper.contains(hint)


def _scores(sources: DataFrame) -> DataFrame:
    """path and one score column per dialect; the text is upper-cased once."""
    upper = F.col("upper_text")
    totals = {name: F.lit(0) for name in DIALECTS}
    hits = []
    for n, (groups, weights) in enumerate(DIALECT_RULES):
        rule = reduce(
            lambda a, b: a & b,
            [reduce(lambda a, b: a | b, [_evidence(upper, h) for h in group]) for group in groups],
        )
        hits.append(rule.alias(f"rule_{n}"))
        for name, weight in weights.items():
            totals[name] = totals[name] + F.when(F.col(f"rule_{n}"), weight).otherwise(0)
    found = sources.select("path", F.upper("text").alias("upper_text")).select("path", *hits)
    return found.select("path", *[totals[name].alias(name) for name in DIALECTS])


def vendor_scores(sources: DataFrame) -> DataFrame:
    """path, vendor, score for every dialect."""
    pairs = F.array(*[F.struct(F.lit(d).alias("vendor"), F.col(d).alias("score")) for d in DIALECTS])
    return _scores(sources).select("path", F.explode(pairs).alias("v")).select("path", "v.vendor", "v.score")


def detect_dialect(sources: DataFrame) -> DataFrame:
    """path, dialect, score: highest score; the earlier dialect on a tie;
    standard when nothing scores."""
    best = F.greatest(*[F.col(d) for d in DIALECTS])
    name = F.when(best == 0, F.lit("standard"))
    for dialect in DIALECTS:
        name = name.when(F.col(dialect) == best, F.lit(dialect))
    return _scores(sources).select("path", name.alias("dialect"), best.alias("score"))


def program_summary(outlined: DataFrame) -> DataFrame:
    """One row per file, all from its own row: counts and flags.

    ``lines`` is the number of clean lines; the largest files show up there.
    """
    procedure = sm.with_procedure(outlined).withColumn("lists", st.data_lists(F.col("data_text")))
    # columns, so that each section is cut into sentences once
    procedure = procedure.withColumn(
        "cut",
        F.transform(
            "lists",
            lambda x: F.struct(
                x.section.alias("section"), F.transform(st.data_sentences(x.body), drop_period).alias("sentences")
            ),
        ),
    )

    def sentences_of(*sections):
        return F.flatten(F.transform(F.filter("cut", lambda x: x.section.isin(*sections)), lambda x: x.sentences))

    prepared = procedure.select(
        "path",
        "code",
        "marked",
        "paragraphs",
        ol.class_id().isNotNull().alias("has_class"),
        "data_text",
        sentences_of("WORKING-STORAGE").alias("working"),
        sentences_of("WORKING-STORAGE", "LOCAL-STORAGE", "LINKAGE", "SCREEN", "FILE").alias("data"),
        sentences_of("SCREEN").alias("screen"),
        ol.file_count(F.col("lists")).alias("files"),
    )
    level = r"^(\d{1,2})\s+\S"
    data_sql = F.exists("data", lambda s: F.upper(s).startswith("EXEC ") & F.upper(s).contains("EXEC SQL"))

    def uses(kind):
        return F.col("marked").rlike(rf"(?i){st.STATEMENT}EXEC\s+{kind}(?:\s|{st.STATEMENT}|$)")

    return prepared.select(
        "path",
        F.when(F.col("code") == "", 0).otherwise(F.size(F.split("code", "\n"))).alias("lines"),
        F.size(F.filter("data", lambda s: s.rlike(level))).alias("items"),
        F.size(F.filter("working", lambda s: s.rlike(r"^(?:0?1|77)\s+\S"))).alias("working_roots"),
        F.size(F.filter("screen", lambda s: s.rlike(level))).alias("screen_items"),
        F.size(F.filter("paragraphs", lambda p: p.section == "")).alias("paragraphs"),
        F.size(F.filter("paragraphs", lambda p: p.section != "")).alias("section_paragraphs"),
        st.section_count(F.col("marked")).alias("sections"),
        "files",
        (uses("SQL") | data_sql).alias("has_sql"),
        uses("CICS").alias("has_cics"),
        uses("DLI").alias("has_dli"),
        "has_class",
    )


def verb_profile(stmts: DataFrame) -> DataFrame:
    """path and the number of statements of each type, every type a column."""
    counts = [
        F.count_if(F.col("stmt_type") == t).alias(t.lower().replace(" ", "_").replace("-", "_"))
        for t in STATEMENT_TYPES
    ]
    return stmts.groupBy("path").agg(*counts)


def verb_counts(stmts: DataFrame) -> DataFrame:
    """path, stmt_type, statements."""
    return sm.verb_types(stmts).groupBy("path", "stmt_type").agg(F.count("*").alias("statements"))


def run_outcome(outlined: DataFrame) -> DataFrame:
    """outcome, programs: a file without a program name counts as an error."""
    named = ol.program_header(outlined).select(
        F.when(F.col("program_id").isNotNull(), "success").otherwise("error").alias("outcome")
    )
    return named.groupBy("outcome").agg(F.count("*").alias("programs"))


def _prefixed(outlined: DataFrame) -> DataFrame:
    """path and ``named``: paragraphs with a prefix, sorted by it."""
    paras = sm.with_marked(outlined).select("path", sm.paragraph_list().alias("paragraphs"))
    numbered = F.transform(
        "paragraphs",
        lambda p, k: F.struct(
            F.substring_index(F.upper(p.paragraph), "-", 1).alias("prefix"),
            (k + 1).alias("paragraph_no"),
            p.paragraph.alias("paragraph"),
        ),
    )
    return paras.select("path", F.sort_array(F.filter(numbered, lambda p: p.paragraph.contains("-"))).alias("named"))


def _prefix_at(at: Column) -> Column:
    return F.get("named", at).prefix


def service_groups(outlined: DataFrame) -> DataFrame:
    """path, prefix, class_name, paragraphs: three or more paragraphs that
    share the text before the first hyphen."""
    placed = F.transform("named", lambda p, k: F.struct(p.prefix.alias("prefix"), k.alias("k")))
    firsts = _prefixed(outlined).select(
        "path",
        F.size("named").alias("named_size"),
        F.filter(placed, lambda p: F.coalesce(_prefix_at(p.k - 1) != p.prefix, F.lit(True))).alias("firsts"),
    )
    counted = F.transform(
        "firsts",
        lambda p, n: F.struct(
            p.prefix.alias("prefix"), (F.coalesce(F.get("firsts", n + 1).k, F.col("named_size")) - p.k).alias("n")
        ),
    )
    return firsts.select("path", F.explode(F.filter(counted, lambda c: c.n >= 3)).alias("c")).select(
        "path",
        "c.prefix",
        F.concat(pascal_case(F.col("c.prefix")), F.lit("Service")).alias("class_name"),
        F.col("c.n").cast("bigint").alias("paragraphs"),
    )


def service_members(outlined: DataFrame) -> DataFrame:
    """path, prefix, paragraph_no, paragraph of the service groups."""

    def in_run(p, k):
        same = [F.coalesce(_prefix_at(k + d) == p.prefix, F.lit(False)) for d in (-2, -1, 1, 2)]
        return (same[0] & same[1]) | (same[1] & same[2]) | (same[2] & same[3])

    return (
        _prefixed(outlined)
        .select("path", F.explode(F.filter("named", in_run)).alias("p"))
        .select("path", "p.prefix", "p.paragraph_no", "p.paragraph")
    )


def file_handlers(files: DataFrame) -> DataFrame:
    """path, file_no, select_name, class_name, organization."""
    name = F.coalesce(
        F.nullif("select_name", F.lit("")), F.nullif("fd_name", F.lit("")), F.lit("File")
    )
    return files.select(
        "path",
        "file_no",
        "select_name",
        F.concat(pascal_case(name), F.lit("Handler")).alias("class_name"),
        "organization",
    )


def class_summary(outlined: DataFrame) -> DataFrame:
    """path, data_classes, enums, services, file_handlers, total.

    The main class counts one. One row of a file gives all its candidates, so
    the text is taken apart once; a class is a group of enough candidates.
    """
    candidates = F.concat(it.class_candidates(), sm.service_candidates())
    found = sm.with_marked(outlined).select(
        "path", ol.file_count().cast("bigint").alias("file_handlers"), candidates.alias("c")
    )
    least = {"data_classes": 1, "enums": 2, "services": 3}

    def keys(part: str) -> Column:
        return F.sort_array(F.transform(F.filter("c", lambda c: c.part == part), lambda c: c.key))

    sorted_keys = found.select("path", "file_handlers", *[keys(part).alias(part) for part in least])

    def groups(part: str, enough: int) -> Column:
        """Keys that fill ``enough`` places in a row, counted at the first."""

        def begins(key, k):
            before, on = F.get(part, k - 1), F.get(part, k + enough - 1)
            return F.coalesce(before != key, F.lit(True)) & F.coalesce(on == key, F.lit(False))

        return F.size(F.filter(part, begins)).cast("bigint")

    counted = sorted_keys.select("path", *[groups(p, n).alias(p) for p, n in least.items()], "file_handlers")
    return counted.withColumn(
        "total", reduce(lambda a, b: a + b, [F.col(n) for n in [*least, "file_handlers"]], F.lit(1))
    )


def readiness(stmts: DataFrame) -> DataFrame:
    """path, stmt_type, statements that no rule converts.

    CICS commands without a class count as EXEC CICS.
    """
    body = F.regexp_extract("text", r"(?is)^EXEC\s+CICS\s+(.*?)\s*END-EXEC", 1)
    known = [c for words in sm.CICS_CLASSES.values() for c in words] + ["HANDLE"]
    unclassed = (F.col("stmt_type") == "EXEC CICS") & ~F.upper(sm.word(body, 1)).isin(known)
    return (
        stmts.where(F.col("stmt_type").isin(UNCONVERTED_TYPES) | unclassed)
        .groupBy("path", "stmt_type")
        .agg(F.count("*").alias("statements"))
    )


def entry_paragraph(outlined: DataFrame) -> DataFrame:
    """path, paragraph: the first outside any section, else the first of all."""
    paras = sm.with_procedure(outlined).select(
        "path",
        F.concat(
            F.filter("paragraphs", lambda p: p.section == ""),
            F.filter("paragraphs", lambda p: p.section != ""),
        ).alias("ordered"),
    )
    return paras.select("path", F.explode(F.slice("ordered", 1, 1)).alias("p")).select("path", "p.paragraph")


_COPIES = 10_000


def diff_estates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, with ``side`` a or b.

    Copies count: a row held twice here and once there appears once. Each side
    is read once, and both meet as one count per row.
    """
    columns = [F.col(f"`{c}`") for c in a.columns]
    both = a.withColumn("__n", F.lit(1)).unionByName(b.withColumn("__n", F.lit(-1)))
    surplus = both.groupBy(*columns).agg(F.sum("__n").alias("__n")).where("__n <> 0")
    lots = F.sequence(F.lit(0).cast("bigint"), F.floor((F.abs("__n") - 1) / _COPIES))
    cut = surplus.select(*columns, "__n", F.explode(lots).alias("__lot"))
    in_lot = F.least(F.lit(_COPIES).cast("bigint"), F.abs("__n") - F.col("__lot") * _COPIES)
    return cut.select(
        *columns, F.when(F.col("__n") > 0, "a").otherwise("b").alias("side"), F.explode(F.sequence(F.lit(1).cast("bigint"), in_lot)).alias("__copy")
    ).drop("__copy")
