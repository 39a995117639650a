"""Records of varying length: places behind tables, nested tables, counters out of range."""

import pytest

from copperbook.operators import items as it
from copperbook.operators import outline as ol
from copperbook.operators import records as rc
from copperbook.sources import varying as vr

ORDER = (
    vr.item("id", 3, "int"),
    vr.item("n", 2, "int"),
    vr.item("codes", 2, "string", most=4, least=1, depending="n"),
    vr.item("after", 3, "int"),
)


def read(spark, lines, layout):
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    return [tuple(r) for r in vr.read_text(df, layout).collect()]


def test_fields_start_behind_the_table(spark):
    lines = ["00101AA777", "00203AABBCC888", "00304AABBCCDD999"]
    assert read(spark, lines, ORDER) == [
        (1, 1, ["AA"], 777),
        (2, 3, ["AA", "BB", "CC"], 888),
        (3, 4, ["AA", "BB", "CC", "DD"], 999),
    ]


@pytest.mark.parametrize("counter", ["00", "05", "99", "  ", "x1"])
def test_counter_out_of_range(spark, counter):
    ((id_, n, codes, after),) = read(spark, [f"001{counter}AABBCC888"], ORDER)
    assert (id_, codes, after) == (1, None, None)
    assert n == (int(counter) if counter.isdigit() else None)


def test_short_record(spark):
    assert read(spark, ["00102AA", "001", ""], ORDER) == [(1, 2, ["AA", ""], None), (1, None, None, None), (None, None, None, None)]


def test_no_elements(spark):
    layout = (vr.item("n", 1, "int"), vr.group("t", vr.item("a", 1), most=3, depending="n"), vr.item("z", 1))
    assert read(spark, ["0z", "2abz"], layout) == [(0, [], "z"), (2, [("a",), ("b",)], "z")]


NESTED = (
    vr.item("kinds", 1, "int"),
    vr.group(
        "kind",
        vr.item("name", 2),
        vr.item("m", 1, "int"),
        vr.group("part", vr.item("k", 1, "int"), vr.item("bit", 1, "int", most=3, depending="k"), vr.item("tail", 1), most=2, depending="m"),
        vr.item("fixed", 1, "int", most=2),
        vr.item("close", 1),
        most=3,
        least=1,
        depending="kinds",
    ),
    vr.group("end", vr.item("x", 2, "int"), vr.item("y", 1)),
)


def test_nested_tables(spark):
    line = "2" + "AA2" + "1" + "7" + "p" + "3" + "123" + "q" + "56" + "c" + "BB0" + "78" + "d" + "42y"
    assert read(spark, [line], NESTED) == [
        (
            2,
            [
                ("AA", 2, [(1, [7], "p"), (3, [1, 2, 3], "q")], [5, 6], "c"),
                ("BB", 0, [], [7, 8], "d"),
            ],
            (42, "y"),
        )
    ]


def test_a_bad_inner_counter_loses_what_follows(spark):
    line = "2" + "AA1" + "9" + "7" + "p" + "56" + "c" + "BB0" + "78" + "d" + "42y"
    ((kinds, kind, end),) = read(spark, [line], NESTED)
    assert kinds == 2 and kind[0][:2] == ("AA", 1) and kind[0].close is None
    assert kind[1].name is None and end == (None, None)


def test_round_trip_of_nested_tables(spark, tmp_path):
    schema = """kinds int, kind array<struct<name:string,m:int,part:array<struct<k:int,bit:array<int>,tail:string>>,
        fixed:array<int>,close:string>>, end struct<x:int,y:string>"""
    rows = [
        (1, [("AA", 0, [], [1, 2], "c")], (1, "y")),
        (3, [("AA", 2, [(0, [], "t"), (2, [3, 4], "u")], [1, 2], "c"), ("B", 1, [(3, [1, 2, 3], "v")], [0, 9], "d"), ("CC", 0, [], [5, 5], "e")], (99, "z")),
    ]
    df = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "out")
    vr.write_varying(df, path, NESTED)
    back = vr.read_varying(spark, path, NESTED)
    assert sorted(map(tuple, back.collect())) == rows
    vr.write_varying(df, path, NESTED, "EXTEND")
    assert vr.read_varying(spark, path, NESTED).count() == 4


def test_counters_are_moved_into_bounds_when_written(spark):
    rows = [(1, 0, ["AA", "BB"], 5), (2, 9, ["AA"], 6), (3, None, None, 7), (4, 2, ["AA", "BB", "CC"], 8)]
    df = spark.createDataFrame(rows, "id int, n int, codes array<string>, after int")
    lines = [r.value for r in vr.varying_text(df, ORDER).collect()]
    assert lines == ["00101AA005", "00204AA      006", "00301  007", "00402AABB008"]


def test_layout_of_declared_items(spark, sources):
    text = """       IDENTIFICATION DIVISION.
       PROGRAM-ID. P.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
       01  ORDER-REC.
           05  ORDER-ID PIC 9(3).
           05  LINE-COUNT PIC 9.
           05  LINES OCCURS 1 TO 4 TIMES DEPENDING ON LINE-COUNT.
               10  PART-NO PIC X(2).
               10  PRICE PIC 9(2)V9.
           05  CLOSING PIC X(2).
"""
    rows = it.item_types(it.data_items(ol.outline(sources(text)))).orderBy("item_no").collect()
    layout = vr.varying_layout([r.asDict() for r in rows if r.depth > 0])
    assert [i.name for i in layout] == ["order_id", "line_count", "lines", "closing"]
    assert layout[2].most == 4 and layout[2].depending == "line_count"
    ((order, count, lines, closing),) = read(spark, ["0072AA123BB456zz"], layout)
    assert (order, count, closing) == (7, 2, "zz")
    assert [(x.part_no, str(x.price)) for x in lines] == [("AA", "12.3"), ("BB", "45.6")]


def test_refused_layouts(spark):
    with pytest.raises(ValueError, match="not before it"):
        read(spark, ["1"], (vr.item("t", 1, most=2, depending="n"), vr.item("n", 1, "int")))
    base = {"level": 5, "name": "A", "picture": "9", "spark_type": "int"}
    with pytest.raises(ValueError, match="usage"):
        vr.varying_layout([base | {"usage": "COMP-3"}])
    with pytest.raises(ValueError, match="redefines"):
        vr.varying_layout([base, base | {"redefines": "A"}])


def test_only_wanted_fields_are_cut(spark):
    df = spark.createDataFrame([("00101AA777",)], "value string")
    plan = vr.read_text(df, ORDER).select("id")._jdf.queryExecution().optimizedPlan().toString()
    assert "transform" not in plan.lower()


def test_a_table_is_cut_once_however_it_is_used(spark):
    layout = (
        vr.item("n", 1, "int"),
        vr.group("t", vr.item("m", 1, "int"), vr.item("a", 2, "decimal(2,1)", most=3, depending="m"), most=3, depending="n"),
        vr.item("z", 2, "decimal(2,1)"),
    )
    df = spark.createDataFrame([("2112" + "2345699",), ("012",), ("9",), (None,)], "value string")
    told = rc.occurs_explode(vr.read_text(df, layout), "t", "place")
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1 and "size(" not in plan
    # each decimal is matched once
    assert plan.count("regexp_extract(") == 2
    tenths = [(r.n, r.place, r.t.m, [str(x) for x in r.t.a], str(r.z)) for r in told.collect()]
    assert tenths == [(2, 1, 1, ["1.2"], "9.9"), (2, 2, 2, ["3.4", "5.6"], "9.9")]


@pytest.mark.parametrize(
    ("text", "value"),
    [("-0012", "-0.12"), ("+0012", "0.12"), ("    7", "0.07"), ("12345", "123.45"), ("-0000", "0.00"), ("1.234", None),
     ("01E02", None), ("     ", None), ("1 234", None), ("    -", None), ("٣٣٣٣٣", None)],
)
def test_decimals_with_an_implied_point(spark, text, value):
    ((found,),) = read(spark, [text], (vr.item("d", 5, "decimal(5,2)", True),))
    assert (None if found is None else str(found)) == value
