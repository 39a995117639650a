"""What the plans must not contain."""

import pytest

from copperbook.operators import items as it
from copperbook.operators import outline as ol
from copperbook.operators import statements as sm
from copperbook.operators import summaries as su
from copperbook.plans import catalog


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Sources read from a table, so that every exchange is the operator's own."""
    path = str(tmp_path_factory.mktemp("plan") / "sources")
    spark.createDataFrame([("p", "       ID DIVISION.")], "path string, text string").write.parquet(path)
    return spark.read.parquet(path)


NARROW = {
    "lines": lambda s: ol.clean_lines(s),
    "tags": lambda s: ol.tagged_lines(ol.outline(s)),
    "header": lambda s: ol.program_header(ol.outline(s)),
    "files": lambda s: ol.file_control(ol.outline(s)),
    "copies": lambda s: ol.copies(ol.outline(s)),
    "items": lambda s: it.item_types(it.data_items(ol.outline(s))),
    "hierarchy": lambda s: it.item_hierarchy(it.data_items(ol.outline(s))),
    "statements": lambda s: sm.statements(ol.outline(s)),
    "blocks": lambda s: sm.block_depth(ol.outline(s)),
    "sql": lambda s: sm.sql_blocks(sm.exec_blocks(ol.outline(s))),
    "dialect": lambda s: su.detect_dialect(s),
    "summary": lambda s: su.program_summary(ol.outline(s)),
    "entry": lambda s: su.entry_paragraph(ol.outline(s)),
    "classes": lambda s: su.class_summary(ol.outline(s)),
    "enums": lambda s: it.enum_candidates(ol.outline(s)),
    "enum_members": lambda s: it.enum_members(ol.outline(s)),
    "services": lambda s: su.service_groups(ol.outline(s)),
    "service_members": lambda s: su.service_members(ol.outline(s)),
}


@pytest.mark.parametrize("name", sorted(NARROW))
def test_work_within_a_file_needs_no_exchange(name, stored):
    plan = _plan(NARROW[name](stored))
    assert "Exchange" not in plan and "Window" not in plan and "Join" not in plan


def test_counts_shuffle_once_after_partial_aggregation(stored):
    plan = _plan(su.verb_counts(sm.statements(ol.outline(stored))))
    assert plan.count("Exchange ") == 1 and plan.count("HashAggregate") == 2


def test_two_estates_are_each_read_once(stored):
    rows = it.data_items(ol.outline(stored)).select("path", "name")
    plan = _plan(su.diff_estates(rows, rows))
    assert plan.count("FileScan") == 2 and plan.count("Exchange ") == 1 and "Join" not in plan


def test_an_array_is_computed_once(stored):
    """No filter on the size of an exploded array repeats the work below it."""
    plan = _plan(sm.statements(ol.outline(stored)))
    assert plan.count("procedure_text#") < 12


def test_scans_read_only_what_is_used(spark, sf_dir):
    plan = _plan(catalog.queries()["r10_if_else"](spark, sf_dir))
    assert "l_extendedprice" not in plan and "l_shipdate" not in plan


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_no_python_in_any_plan(name, spark, sf_dir):
    plan = _plan(catalog.queries()[name](spark, sf_dir))
    assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_sections_are_cut_into_sentences_once(sources):
    plan = su.program_summary(ol.outline(sources("")))._jdf.queryExecution().optimizedPlan().toString()
    # one pattern for text without EXEC blocks and one for the rest between them
    assert plan.count(r"(?i)\n(?:(?=COPY\s)|(?<=\.\n))") == 2
