"""Record verbs, functions and record files."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copperbook.functions import arithmetic as ar
from copperbook.functions import conditions as cd
from copperbook.functions import fields as fl
from copperbook.operators import records as rc
from copperbook.operators.ordered import row_numbers, running_total
from copperbook.sources import records as rs


def _truncated(value, places):
    unit = Decimal(1).scaleb(-places)
    return (value / unit).to_integral_value("ROUND_DOWN") * unit


def test_store_truncates_toward_zero(spark):
    values = [Decimal("1.999"), Decimal("-1.999"), Decimal("0.005"), None]
    df = spark.createDataFrame([(v,) for v in values], "v decimal(10,3)")
    rows = df.select(ar.store(F.col("v"), "decimal(8,2)", T.DecimalType(10, 3)).alias("v")).collect()
    assert [r["v"] for r in rows] == [None if v is None else _truncated(v, 2) for v in values]
    assert [r[0] for r in df.select(ar.store(F.col("v"), "int")).collect()] == [1, -1, 0, None]
    assert df.select(ar.store(F.lit(100000), "decimal(3,1)")).first()[0] is None


@pytest.mark.parametrize("a_type, b_type", [("decimal(9,2)", "decimal(7,3)"), ("decimal(25,4)", "decimal(20,2)"), ("bigint", "int")])
@pytest.mark.parametrize("target", ["bigint", "decimal(18,3)"])
def test_quotient_is_exact(spark, a_type, b_type, target):
    rng = random.Random(3)
    a, b = T.DataType.fromDDL(a_type), T.DataType.fromDDL(b_type)
    scale_a, scale_b = getattr(a, "scale", 0), getattr(b, "scale", 0)
    pairs = [(rng.randint(-10**6, 10**6), rng.randint(-300, 300)) for _ in range(200)] + [(5, 0)]
    rows = [
        (Decimal(x).scaleb(-scale_a) if scale_a else x, Decimal(y).scaleb(-scale_b) if scale_b else y) for x, y in pairs
    ]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("a", a), T.StructField("b", b)]))
    places = 0 if target == "bigint" else 3
    for types in ((a, b), (None, None)):
        got = df.select(ar.quotient(F.col("a"), F.col("b"), target, types).alias("q")).collect()
        for (x, y), r in zip(rows, got):
            if y == 0:
                assert r["q"] is None
            else:
                num = int(Decimal(x).scaleb(scale_a)) * 10 ** (places + scale_b)
                den = int(Decimal(y).scaleb(scale_b)) * 10**scale_a
                whole = abs(num) // abs(den) * (1 if (num < 0) == (den < 0) else -1)
                assert Decimal(r["q"]) == Decimal(whole).scaleb(-places)


def test_divide_forms_and_remainder(spark):
    df = spark.createDataFrame([(7, 2), (-7, 2), (1, 0)], "a int, b int")
    by = rc.divide(df, "a", "b", "q", "int", remainder="r").collect()
    assert [(r["q"], r["r"]) for r in by] == [(3, 1), (-3, -1), (None, None)]
    into = rc.divide_into(df, 2, "a", giving="q", dtype="int").collect()
    assert [r["q"] for r in into] == [3, -3, 0]


def test_move_initialize_and_set(spark):
    df = spark.createDataFrame([(1, "x", Decimal("1.50"))], "n int, s string, d decimal(5,2)")
    row = rc.move(df, "ZEROS", "n", "s", "d").first()
    assert tuple(row) == (0, "0", Decimal("0.00"))
    assert rc.move(df, "HIGH-VALUES", "s", "n").first()[:2] == (255, "ÿ")
    assert tuple(rc.initialize(df, "n", "s", "d").first()) == (0, "", Decimal(0))
    assert rc.set_true(df, "s", ["A THRU C", "Z"]).first()["s"] == "A"
    assert rc.set_down(rc.set_up(df, "n", 5), "n", 2).first()["n"] == 4


def test_compute_names_and_powers(spark):
    df = spark.createDataFrame([(3, 2)], "ws_a int, b int")
    assert rc.compute(df, "t", "(WS-A + 1) ** 2 - b ** 3", "int").first()["t"] == 8
    with pytest.raises(ValueError):
        ar.expression("((a + (b)) ** ")


def test_conditions(spark):
    df = spark.createDataFrame([(5, "12", "ab c")], "n int, d string, a string")
    tests = [
        cd.relation(F.col("n"), "IS GREATER THAN OR EQUAL TO", 5), cd.relation(F.col("n"), "NOT = ", 5),
        cd.relation(F.col("n"), "LESS THAN", 6), cd.is_numeric(F.col("d")), cd.is_alphabetic(F.col("a")),
        cd.condition_name(F.col("n"), [(1, 4), 5]), cd.condition_name(F.col("d"), ["10 THRU 11"]),
    ]
    assert list(df.select(*tests).first()) == [True, False, True, True, True, True, False]
    with pytest.raises(ValueError):
        cd.relation(F.col("n"), "ALMOST", 5)
    pick = cd.evaluate(F.col("n"), {1: "a", 5: "e"}, "o")
    assert df.select(pick).first()[0] == "e"
    assert df.select(cd.if_else(F.lit(None).cast("boolean"), 1, 2)).first()[0] == 2


def test_lookup(spark):
    table = {i: f"v{i}" for i in range(0, 50, 2)}
    found = rc.evaluate_lookup(spark.range(50), "id", table, "r", "none").orderBy("id").collect()
    assert [r["r"] for r in found[:3]] == ["v0", "none", "v2"]


def test_overflow_is_null(spark):
    df = spark.sql(
        "SELECT 2147483647 AS i, 9223372036854775807L AS b, -9223372036854775807L - 1 AS least, 1e30D AS v, "
        "CAST('9999999999.99' AS decimal(12,2)) AS d, CAST(repeat('9', 38) AS decimal(38,0)) AS w"
    )
    calls = [
        (rc.add(df, 1, "i"), "i"), (rc.add(df, 1, "b"), "b"), (rc.subtract(df, 10, "least"), "least"),
        (rc.multiply(df, "b", "b"), "b"), (rc.multiply(df, "w", "w"), "w"), (rc.set_up(df, "b", 1), "b"),
        (rc.set_down(df, "least", 1), "least"), (rc.move(df, F.col("v"), "d"), "d"), (rc.move(df, F.col("v"), "i"), "i"),
        (rc.compute(df, "d", "v ** 2"), "d"), (rc.compute(df, "i", "i + 1"), "i"), (rc.compute(df, "b", "b * b"), "b"),
        (rc.compute(df, "b", "b / 0"), "b"), (rc.divide(df, "w", 3, "q", "decimal(38,10)"), "q"),
        (rc.divide(df, "b", 0, "q", "bigint", remainder="r"), "r"), (rc.divide(df, "least", -1, "q", "bigint"), "q"),
    ]
    assert [out.select(name).first()[0] for out, name in calls] == [None] * len(calls)


def test_compute_takes_operators_by_rank(spark):
    df = spark.sql("SELECT 2 AS a, 3 AS ws_b, 7 AS r")
    cases = {"a + WS-B * 4": 14, "(a + WS-B) * 4": 20, "2 ** 3 ** 2": 64, "-a + 10": 8, "10 - a - WS-B": 5, "(a + 1) ** (WS-B - 1)": 9}
    for text, wanted in cases.items():
        assert rc.compute(df, "r", text).first()["r"] == wanted, text
    for text in ("a +", "(a", "a b", "a $ b", ")"):
        with pytest.raises(ValueError):
            rc.compute(df, "r", text)


def test_text_functions(spark):
    df = spark.createDataFrame([("  aXbXXc",)], "s string")
    s = F.col("s")
    row = df.select(
        fl.unstring(s, "X"), fl.unstring(s, "X", all_=True), fl.inspect_tally(s, "X"), fl.inspect_tally(s, " ", leading=True),
        fl.inspect_replace(s, "X", "yy", first=True), fl.inspect_replace(s, "X", ""), fl.string_into((s, "X"), "!", s),
        fl.display_line("n=", 5, None),
    ).first()
    assert list(row) == [["  a", "b", "", "c"], ["  a", "b", "c"], 3, 2, "  ayybXXc", "  abc", "  a!  aXbXXc", "n=5"]


def test_table_functions(spark):
    df = spark.createDataFrame([([5, 8, 2], 2)], "t array<int>, n int")
    t, n = F.col("t"), F.col("n")
    row = df.select(
        fl.subscript(t, n), fl.subscript(t, 9), fl.table_of(t, n), fl.perform_until(t, lambda x: x > 7),
        fl.perform_until(t, lambda x: x > 70), fl.perform_times(n, F.lit(1), lambda v: v * 3),
        fl.perform_times(F.lit(0), F.lit(1), lambda v: v * 3), fl.search_table(t, lambda x: x < 3), fl.search_table(t, lambda x: x > 9),
    ).first()
    assert list(row) == [8, None, [5, 8], [5], [5, 8, 2], 9, 1, 2, None]


def test_record_files(spark, tmp_path):
    items = [
        dict(name="CUST-ID", picture="9(5)", spark_type="int"),
        dict(name="CUST-NAME", picture="X(6)", spark_type="string"),
        dict(name="BALANCE", picture="S9(4)V99", spark_type="decimal(6,2)"),
    ]
    fields = rs.layout_of(items)
    assert [(f.start, f.length) for f in fields] == [(1, 5), (6, 6), (12, 7)]
    df = spark.createDataFrame(
        [(7, "ANNA", Decimal("-12.34")), (123456, "BARTHOLOMEW", Decimal("0.50"))],
        "cust_id int, cust_name string, balance decimal(6,2)",
    )
    path = str(tmp_path / "records")
    rs.write_records(df, path, fields)
    assert sorted(r[0] for r in spark.read.text(path).collect()) == ["00007ANNA  -001234", "23456BARTHO+000050"]
    rs.write_records(df, path, fields, "EXTEND")
    back = rs.read_records(spark, path, fields)
    assert back.count() == 4
    assert ("ANNA", Decimal("-12.34")) in [(r["cust_name"], r["balance"]) for r in back.collect()]
    rs.write_records(df.limit(1), path, fields, "OUTPUT")
    assert rs.read_records(spark, path, fields).count() == 1
    with pytest.raises(ValueError):
        rs.write_records(df, path, fields, "INPUT")


def test_record_layouts(spark, tmp_path):
    items = [
        dict(name="K", picture="9(4)", spark_type="int"),
        dict(name="K-ALT", picture="X(4)", spark_type="string", redefines="K"),
        dict(name="TAB", picture="9(2)", spark_type="int", occurs=2),
        dict(name="Z", picture="9(3).99", spark_type="decimal(5,2)"),
        dict(name="W", picture="9(21)V9(10)", spark_type="decimal(31,10)"),
    ]
    fields = rs.layout_of(items)
    assert [f.start for f in fields] == [1, 1, 5, 9, 15]
    path = tmp_path / "r.txt"
    path.write_text("00120304123.451234567890123456789012345678901\n" + " " * 45 + "\n")
    first, blank = rs.read_records(spark, str(path), fields).collect()
    assert tuple(first) == (12, "0012", [3, 4], Decimal("123.45"), Decimal("123456789012345678901.2345678901"))
    assert tuple(blank) == (None, "", [None, None], None, None)
    lines = rs.record_text(rs.read_records(spark, str(path), fields), fields).collect()
    assert "\n".join(r["value"] for r in lines) + "\n" == path.read_text()
    for bad in (dict(usage="COMP-3"), dict(usage="BINARY"), dict(redefines="NONE")):
        with pytest.raises(ValueError):
            rs.layout_of([dict(name="A", picture="9(4)", spark_type="int", **bad)])


def test_bad_digits_read_as_null(spark, tmp_path):
    path = tmp_path / "r.txt"
    path.write_text("12A45\n00045\n")
    rows = rs.read_records(spark, str(path), rs.layout(("n", 5, "int"))).collect()
    assert [r["n"] for r in rows] == [None, 45]


def test_running_numbers_with_a_hot_group_and_nulls(spark):
    """Two thirds of the rows in one group, and a hot first order column."""
    rng = random.Random(9)
    rows = [
        ("hot" if rng.random() < 0.66 else f"g{rng.randint(0, 30)}", rng.choice([None, 1, 1, 1, rng.randint(0, 500)]), i)
        for i in range(3000)
    ]
    df = spark.createDataFrame(rows, "g string, k int, i int").repartition(7)
    got = running_total(df, ["k", "i"], "total", F.col("i").cast("bigint"), ("g",), ranges=16).collect()
    numbered = row_numbers(df, ["k", "i"], "no", (), ranges=16).collect()
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    totals, expected = {}, {}
    for g, k, i in order:
        totals[g] = totals.get(g, 0) + i
        expected[i] = totals[g]
    assert {r["i"]: r["total"] for r in got} == expected
    assert {r["i"]: r["no"] for r in numbered} == {r[2]: n for n, r in enumerate(order, 1)}


def test_running_total_of_nothing(spark):
    empty = spark.createDataFrame([], "k int")
    assert row_numbers(empty, ["k"], "no").count() == 0


def test_sorted_and_merged_records_are_in_order(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(rng.randrange(50), k) for k in range(500)], "a int, b int").repartition(6)
    rows = [tuple(r) for r in rc.sort_records(df, F.col("a").desc(), "b").collect()]
    assert rows == sorted(rows, key=lambda r: (-r[0], r[1]))
    merged = [tuple(r) for r in rc.merge_records([df, df], "a", "b").collect()]
    assert merged == sorted(merged) and len(merged) == 1000
