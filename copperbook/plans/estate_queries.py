"""Registered estate queries, each over the whole estate of a data folder."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copperbook.functions.text import camel_case, pascal_case
from copperbook.operators import differences as df
from copperbook.operators import items as it
from copperbook.operators import long_sources as lg
from copperbook.operators import outline as ol
from copperbook.operators import statements as sm
from copperbook.operators import summaries as su
from copperbook.session import scratch_path
from copperbook.sources import files
from copperbook.sources.estate_from_parts import estate



def _pairs(column: str):
    entries = F.transform(F.map_entries(column), lambda e: F.concat(e.key, F.lit("="), e.value))
    return F.array_join(F.array_sort(entries), ";").alias(column)


def estate_files(spark, d) -> str:
    root = scratch_path(spark, "estate-files")
    files.write_sources(estate(spark, d), root)
    return root


def read_sources(spark, d):
    return files.read_sources(spark, estate_files(spark, d), (".txt",)).select("rel_dir", "text")


def tag_long_files(spark, d):
    """The files of the estate read by blocks of lines, as files of any length are."""
    lines = lg.long_lines(spark, estate_files(spark, d), (".txt",), above=0)
    tagged = lg.tag_long_lines(lg.clean_long_lines(lines))
    program = F.url_decode(F.url_decode(F.regexp_extract("path", "program=([^/]+)/", 1)))
    return tagged.select(program.alias("path"), "line_no", "division", "data_section", "content")


def rel_dir(spark, d):
    return files.with_rel_dir(estate(spark, d), "estate").groupBy("rel_dir").agg(F.count("*").alias("files"))


def write_estate(spark, d):
    outlined = ol.outline(estate(spark, d))
    root = scratch_path(spark, "estate-tables")
    files.write_estate({"copies": ol.copies(outlined), "files": ol.file_control(outlined)}, root, source_root="estate")
    rows = [
        files.read_estate(spark, root, name).groupBy("rel_dir", "path").agg(F.count("*").alias("n")).withColumn("name", F.lit(name))
        for name in ("copies", "files")
    ]
    return rows[0].unionByName(rows[1])


def _outline(spark, d):
    return ol.outline(estate(spark, d))


def _items(spark, d):
    return it.data_items(_outline(spark, d))


def _typed(spark, d):
    return it.item_types(_items(spark, d))


def _statements(spark, d):
    return sm.statements(_outline(spark, d))


def _exec(spark, d):
    return sm.exec_blocks(_outline(spark, d))


def data_items(spark, d):
    return _items(spark, d).select(
        "path", "item_no", "section", "fd", "level", "name", "picture", "usage", "value", "occurs",
        "occurs_depending", "redefines", "is_filler", "is_88",
    )


def conditions(spark, d):
    return it.conditions(_items(spark, d)).withColumn(
        "condition_values", F.array_join("condition_values", "|")
    )


def item_types(spark, d):
    return _typed(spark, d).select("path", "item_no", "name", "spark_type", "precision", "scale")


def names(spark, d):
    return _items(spark, d).select(
        "path", "item_no", camel_case(F.col("name")).alias("field_name"), pascal_case(F.col("name")).alias("class_name")
    )


def block_depth(spark, d):
    return sm.block_depth(_outline(spark, d)).select("path", "stmt_no", "text", "depth", "branch")


def sql_blocks(spark, d):
    return sm.sql_blocks(_exec(spark, d)).withColumn("host_vars", F.array_join("host_vars", ","))


def cics_blocks(spark, d):
    return sm.cics_blocks(_exec(spark, d)).withColumn("params", _pairs("params"))


def dli_blocks(spark, d):
    return sm.dli_blocks(_exec(spark, d)).withColumn("params", _pairs("params"))


def calls(spark, d):
    return sm.calls(_statements(spark, d)).withColumn("args", F.array_join("args", ","))


def class_summary(spark, d):
    return su.class_summary(_outline(spark, d))


def diff_estates(spark, d):
    """Items of the estate against the same estate after packed fields became binary."""
    before = estate(spark, d)
    after = before.withColumn("text", F.replace("text", F.lit("V99 COMP-3"), F.lit("V99 COMP")))

    def items_of(sources):
        return it.data_items(ol.outline(sources), hierarchy=False).select("path", "item_no", "name", "picture", "usage")

    was, now = df.changed_sources(before, after)
    return su.diff_estates(items_of(was), items_of(now))


def diff_items(spark, d):
    """The same change, an item taken out, one renamed and two that change places, in
    the programs of one team."""
    before = estate(spark, d).select("path", "text")
    edits = [
        ("V99 COMP-3", "V99 COMP"),
        ("       01 AUDIT-REC PIC X(80).", "      * taken out"),
        ("01 WS-TITLE", "01 WS-HEADING"),
    ]
    edited = F.col("text")
    for old, new in edits:
        edited = F.replace(edited, F.lit(old), F.lit(new))
    edited = F.regexp_replace(edited, r"(05 PR-KEY PIC \S+)(\s+)(05 PR-NAME PIC \S+)", "$3$2$1")
    theirs = F.col("text").contains("AUTHOR. TEAM-4.")
    after = before.select("path", F.when(theirs, edited).otherwise(F.col("text")).alias("text"))
    found = df.diff_items(before, after)
    return found.select("path", "change", "name", "place_a", "field", "value_a", "value_b")


def verb_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many statements of each type does each program have?"""
    return su.verb_counts(_statements(spark, d))


QUERIES = {
    "e1_read_sources": read_sources,
    "e2_rel_dir": rel_dir,
    "e3_write_estate": write_estate,
    "e4_physical_lines": lambda s, d: ol.physical_lines(estate(s, d)),
    "e5_clean_fixed": lambda s, d: ol.clean_fixed(estate(s, d)),
    "e6_clean_free": lambda s, d: ol.clean_lines(estate(s, d), "free"),
    "e7_merge_continuations": lambda s, d: ol.clean_lines(estate(s, d)),
    "e8_tag_long_files": tag_long_files,
    "e8_tag_structure": lambda s, d: ol.tagged_lines(_outline(s, d)),
    "e9_data_items": data_items,
    "e10_conditions": conditions,
    "e11_item_hierarchy": lambda s, d: it.item_hierarchy(_items(s, d)),
    "e12_item_types": item_types,
    "e13_names": names,
    "e14_program_header": lambda s, d: ol.program_header(_outline(s, d)),
    "e15_file_control": lambda s, d: ol.file_control(_outline(s, d)),
    "e16_statements": lambda s, d: _statements(s, d).drop("stmt_type"),
    "e17_verb_types": lambda s, d: sm.verb_types(_statements(s, d)).select("path", "stmt_no", "stmt_type"),
    "e18_block_depth": block_depth,
    "e19_exec_blocks": lambda s, d: _exec(s, d),
    "e20_sql_blocks": sql_blocks,
    "e21_cics_blocks": cics_blocks,
    "e22_dli_blocks": dli_blocks,
    "e23_copies": lambda s, d: ol.copies(_outline(s, d)),
    "e24_calls": calls,
    "e25_screen_fields": lambda s, d: it.screen_fields(_outline(s, d)),
    "e26_goto_targets": lambda s, d: sm.goto_targets(_statements(s, d)),
    "e26_perform_targets": lambda s, d: sm.perform_targets(_statements(s, d)),
    "e27_dialect_flags": lambda s, d: sm.dialect_flags(_statements(s, d)),
    "e28_vendor_scores": lambda s, d: su.vendor_scores(estate(s, d)),
    "e28_detect_dialect": lambda s, d: su.detect_dialect(estate(s, d)),
    "e29_program_summary": lambda s, d: su.program_summary(_outline(s, d)),
    "e30_class_summary": class_summary,
    "e31_run_outcome": lambda s, d: su.run_outcome(_outline(s, d)),
    "e32_record_schemas": lambda s, d: it.record_schemas(_items(s, d)),
    "e32_record_fields": lambda s, d: it.record_fields(_typed(s, d)),
    "e33_enum_candidates": lambda s, d: it.enum_candidates(_outline(s, d)),
    "e33_enum_members": lambda s, d: it.enum_members(_outline(s, d)),
    "e34_service_groups": lambda s, d: su.service_groups(_outline(s, d)),
    "e34_service_members": lambda s, d: su.service_members(_outline(s, d)),
    "e35_file_handlers": lambda s, d: su.file_handlers(ol.file_control(_outline(s, d))),
    "e36_readiness": lambda s, d: su.readiness(_statements(s, d)),
    "e37_verb_counts": verb_counts,
    "e37_verb_profile": lambda s, d: su.verb_profile(_statements(s, d)),
    "e38_entry_paragraph": lambda s, d: su.entry_paragraph(_outline(s, d)),
    "e39_diff_estates": diff_estates,
    "e39_diff_items": diff_items,
}
