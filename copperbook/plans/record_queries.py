"""Registered record queries with their SQL equivalents."""

from pyspark.sql import functions as F

from copperbook.functions import conditions as cd
from copperbook.functions import fields as fl
from copperbook.operators import ordered
from copperbook.operators import records as rc
from copperbook.session import scratch_path
from copperbook.sources import records as rs
from copperbook.sources import varying as vr

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    """Register a query and its SQL text."""

    def register(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


def _table(spark, d, name, *columns):
    return spark.read.parquet(f"{d}/{name}.parquet").select(*columns)


def _money(column):
    return F.col(column).cast("decimal(12,2)").alias(column)


_LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
_ORDER_LAYOUT = rs.layout(
    ("o_orderkey", 10, "bigint"),
    ("o_custkey", 8, "bigint"),
    ("o_orderstatus", 1, "string"),
    ("o_totalprice", 11, "decimal(10,2)", True),
    ("o_orderpriority", 15, "string"),
)


def _orders(spark, d):
    return _table(
        spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus",
        F.col("o_totalprice").cast("decimal(10,2)").alias("o_totalprice"), "o_orderpriority",
    )


_ORDERS_SQL = """SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(10,2)) AS o_totalprice,
o_orderpriority FROM orders"""


@query("r1_read_records", _ORDERS_SQL)
def read_records(spark, d):
    path = scratch_path(spark, "order-records")
    rs.write_records(_orders(spark, d), path, _ORDER_LAYOUT)
    return rs.read_records(spark, path, _ORDER_LAYOUT)


@query(
    "r2_write_records",
    """SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || lpad(CAST(o_custkey AS VARCHAR), 8, '0') || o_orderstatus
|| '+' || lpad(CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR), 10, '0') || rpad(o_orderpriority, 15, ' ') AS value
FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'F')""",
)
def write_records(spark, d):
    path = scratch_path(spark, "order-records")
    orders = _orders(spark, d)
    rs.write_records(orders, path, _ORDER_LAYOUT, "OUTPUT")
    rs.write_records(orders.where("o_orderstatus = 'F'"), path, _ORDER_LAYOUT, "EXTEND")
    return spark.read.text(path)


@query("r3_sort_records", "SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(12,2)) AS o_totalprice FROM orders")
def sort_records(spark, d):
    orders = _table(spark, d, "orders", "o_orderkey", "o_custkey", _money("o_totalprice"))
    return rc.sort_records(orders, F.col("o_totalprice").desc(), "o_orderkey")


@query(
    "r4_merge_records",
    "SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer",
)
def merge_records(spark, d):
    supplier = _table(spark, d, "supplier", F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    customer = _table(spark, d, "customer", F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return rc.merge_records([supplier, customer], "id", "name")


@query(
    "r5_move",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(trunc(l_quantity) AS BIGINT) AS whole, 0 AS cleared,
'' AS blanked, CAST(CAST(trunc(CAST(l_discount * 100 AS DECIMAL(12,0))) AS BIGINT) // 10 * 0.1 AS DECIMAL(5,1)) AS cut FROM lineitem""",
)
def move(spark, d):
    lines = _table(
        spark, d, "lineitem", *_LINE_KEY,
        F.lit(0).cast("bigint").alias("whole"), F.lit(1).alias("cleared"), F.lit("x").alias("blanked"),
        F.lit(0).cast("decimal(5,1)").alias("cut"), F.col("l_quantity").cast("decimal(12,2)").alias("q"),
        F.col("l_discount").cast("decimal(12,2)").alias("disc"),
    )
    moved = rc.move(rc.move(lines, F.col("q"), "whole"), F.col("disc"), "cut")
    return rc.move(rc.move(moved, "ZEROS", "cleared"), "SPACES", "blanked").drop("q", "disc")


_Q = "CAST(l_quantity AS DECIMAL(12,2))"
_P = "CAST(l_extendedprice AS DECIMAL(12,2))"
_D = "CAST(l_discount AS DECIMAL(12,2))"
_T = "CAST(l_tax AS DECIMAL(12,2))"
_KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


def _lines(spark, d):
    return _table(
        spark, d, "lineitem", *_LINE_KEY, _money("l_quantity"), _money("l_extendedprice"), _money("l_discount"), _money("l_tax")
    )


@query(
    "r6_add_subtract_multiply",
    f"""SELECT {_KEYS}, CAST({_Q} + 1.5 AS DECIMAL(12,2)) AS l_quantity, CAST({_P} - {_T} AS DECIMAL(12,2)) AS l_extendedprice,
{_D} AS l_discount, {_T} AS l_tax,
CAST(trunc({_P} * {_D} * 10) AS DOUBLE) / 10 AS reduction FROM lineitem""",
)
def arithmetic(spark, d):
    lines = rc.multiply(_lines(spark, d), "l_discount", "l_extendedprice", "reduction", "decimal(12,1)")
    lines = rc.add(lines, 1.5, "l_quantity")
    return rc.subtract(lines, "l_tax", "l_extendedprice").withColumn("reduction", F.col("reduction").cast("double"))


@query(
    "r7_divide",
    f"""SELECT {_KEYS}, CAST(p * 1000 // q AS BIGINT) AS unit_mills, CAST(p // q AS BIGINT) AS whole,
CAST(p - p // q * q AS BIGINT) AS left_cents, CAST(q // l_linenumber AS BIGINT) AS per_line
FROM (SELECT {_KEYS}, CAST({_P} * 100 AS BIGINT) AS p, CAST({_Q} * 100 AS BIGINT) AS q FROM lineitem)""",
)
def divide(spark, d):
    lines = rc.divide(
        _lines(spark, d), "l_extendedprice", "l_quantity", "unit", "decimal(18,3)"
    )
    lines = rc.divide(lines, "l_extendedprice", "l_quantity", "whole", "bigint", remainder="rest")
    lines = lines.withColumn("cents", (F.col("l_quantity") * 100).cast("bigint"))
    lines = rc.divide_into(lines, F.col("l_linenumber").cast("bigint"), "cents", giving="per_line", dtype="bigint")
    return lines.select(
        *_LINE_KEY, (F.col("unit") * 1000).cast("bigint").alias("unit_mills"), "whole",
        (F.col("rest") * 100).cast("bigint").alias("left_cents"), "per_line",
    )


@query(
    "r8_compute",
    f"""SELECT {_KEYS}, CAST({_P} * (1 - {_D}) * (1 + {_T}) AS DECIMAL(18,6)) AS net, CAST(pow(l_linenumber, 2) + 1 AS BIGINT) AS squared
FROM lineitem""",
)
def compute(spark, d):
    lines = rc.compute(
        _lines(spark, d), "net", "L-EXTENDEDPRICE * (1 - L-DISCOUNT) * (1 + L-TAX)", "decimal(18,6)"
    )
    return rc.compute(lines, "squared", "L-LINENUMBER ** 2 + 1", "bigint").select(*_LINE_KEY, "net", "squared")


@query(
    "r9_evaluate",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
CASE WHEN l_quantity >= 45 THEN 'A' WHEN l_quantity >= 20 THEN 'B' ELSE 'C' END AS grade,
CASE l_returnflag WHEN 'R' THEN 'RETURNED' WHEN 'A' THEN 'ACCEPTED' ELSE 'NONE' END AS flag,
CASE l_linenumber WHEN 1 THEN 'ONE' WHEN 2 THEN 'TWO' WHEN 3 THEN 'THREE' ELSE 'MANY' END AS line_word FROM lineitem""",
)
def evaluate(spark, d):
    lines = _table(spark, d, "lineitem", *_LINE_KEY, "l_quantity", "l_returnflag")
    grade = cd.evaluate_true([(F.col("l_quantity") >= 45, "A"), (F.col("l_quantity") >= 20, "B")], "C")
    flag = cd.evaluate(F.col("l_returnflag"), {"R": "RETURNED", "A": "ACCEPTED"}, "NONE")
    looked = rc.evaluate_lookup(lines, "l_linenumber", {1: "ONE", 2: "TWO", 3: "THREE"}, "line_word", "MANY")
    return looked.select(*_LINE_KEY, grade.alias("grade"), flag.alias("flag"), "line_word")


@query(
    "r10_if_else",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
CASE WHEN l_discount > 0.05 THEN CASE WHEN l_tax > 0.04 THEN 'both' ELSE 'discount' END ELSE 'neither' END AS band FROM lineitem""",
)
def if_else(spark, d):
    inner = cd.if_else(F.col("l_tax") > 0.04, "both", "discount")
    band = cd.if_else(F.col("l_discount") > 0.05, inner, "neither")
    return _table(spark, d, "lineitem", *_LINE_KEY, "l_discount", "l_tax").select(*_LINE_KEY, band.alias("band"))


@query(
    "r11_condition",
    """SELECT o_orderkey, o_totalprice >= 250000 AND NOT o_orderstatus = 'F' AS large_open,
regexp_matches(o_orderpriority, '^[A-Za-z ]+$') AS alphabetic, regexp_matches(substr(o_orderpriority, 1, 1), '^[0-9]+$') AS numeric_start
FROM orders""",
)
def condition(spark, d):
    orders = _table(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    large = cd.relation(F.col("o_totalprice"), "IS GREATER THAN OR EQUAL TO", 250000)
    return orders.select(
        "o_orderkey",
        (large & ~cd.relation(F.col("o_orderstatus"), "EQUAL TO", "F")).alias("large_open"),
        cd.is_alphabetic(F.col("o_orderpriority")).alias("alphabetic"),
        cd.is_numeric(F.substring("o_orderpriority", 1, 1)).alias("numeric_start"),
    )


@query(
    "r12_condition_name",
    """SELECT p_partkey, p_type IN ('ECONOMY', 'PROMO') AS cheap, p_size BETWEEN 1 AND 10 OR p_size = 50 AS odd_size,
'ECONOMY' AS p_type FROM part""",
)
def condition_name(spark, d):
    part = _table(spark, d, "part", "p_partkey", "p_type", "p_size")
    tested = part.select(
        "p_partkey",
        "p_type",
        cd.condition_name(F.col("p_type"), ["ECONOMY", "PROMO"]).alias("cheap"),
        cd.condition_name(F.col("p_size"), [(1, 10), 50]).alias("odd_size"),
    )
    return rc.set_true(tested, "p_type", ["ECONOMY", "PROMO"])


@query(
    "r13_set_by",
    "SELECT p_partkey, p_size + 2 AS p_size, p_partkey - 1 AS before, 7 AS fixed FROM part",
)
def set_by(spark, d):
    part = _table(
        spark, d, "part", "p_partkey", "p_size", F.col("p_partkey").alias("before"), F.lit(0).alias("fixed")
    )
    return rc.set_to(rc.set_down(rc.set_up(part, "p_size", 2), "before", 1), "fixed", 7)


@query(
    "r14_initialize",
    "SELECT c_custkey, '' AS c_name, 0.0 :: DOUBLE AS c_acctbal, 0 AS c_nationkey, c_mktsegment FROM customer",
)
def initialize(spark, d):
    customer = _table(spark, d, "customer", "c_custkey", "c_name", "c_acctbal", "c_nationkey", "c_mktsegment")
    return rc.initialize(customer, "c_name", "c_acctbal", "c_nationkey")


_PACKED = ["l_quantity", "l_linenumber", "l_suppkey"]


def _packed(spark, d):
    lines = _table(spark, d, "lineitem", *_LINE_KEY, "l_quantity")
    return lines.select(*_LINE_KEY, *[F.col(c).cast("bigint").alias(f"t_{c}") for c in _PACKED])


@query(
    "r15_perform_table",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
CAST(l_quantity AS BIGINT) * 1 + l_linenumber * 2 + l_suppkey * 3 AS weighted,
CAST(pow(2, l_linenumber) AS BIGINT) AS doubled,
CASE WHEN CAST(l_quantity AS BIGINT) > 30 THEN 0 WHEN l_linenumber > 30 THEN 1 WHEN l_suppkey > 30 THEN 2 ELSE 3 END AS passed
FROM lineitem""",
)
def perform_table(spark, d):
    packed = rc.occurs_pack(_packed(spark, d), "items", *[f"t_{c}" for c in _PACKED])
    weights = fl.perform_varying(F.col("items"), lambda x, i: x * i)
    return packed.select(
        *_LINE_KEY,
        F.aggregate(weights, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("weighted"),
        fl.perform_times(F.col("l_linenumber"), F.lit(1).cast("bigint"), lambda v: v * 2).alias("doubled"),
        F.size(fl.perform_until(F.col("items"), lambda x: x > 30)).alias("passed"),
    )


@query(
    "r15_running_total",
    """SELECT o_orderkey, o_custkey, sum(CAST(o_totalprice AS DECIMAL(12,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent FROM orders""",
)
def running_total(spark, d):
    orders = _table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", _money("o_totalprice"))
    return ordered.running_total(
        orders, ["o_orderdate", "o_orderkey"], "spent", F.col("o_totalprice"), ("o_custkey",)
    ).select("o_orderkey", "o_custkey", F.col("spent").cast("decimal(38,2)").alias("spent"))


@query(
    "r16_display_line",
    "SELECT o_orderkey, 'ORDER ' || o_orderkey || ' OF ' || o_custkey || ': ' || o_orderstatus AS line FROM orders",
)
def display_line(spark, d):
    orders = _table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    return orders.select(
        "o_orderkey",
        fl.display_line("ORDER ", F.col("o_orderkey"), " OF ", F.col("o_custkey"), ": ", F.col("o_orderstatus")).alias("line"),
    )


@query(
    "r17_string_into",
    """SELECT doc_id, source || '/' || split_part(text, ' ', 1) || '#' || doc_id AS label FROM documents""",
)
def string_into(spark, d):
    docs = _table(spark, d, "documents", "doc_id", "source", "text")
    label = fl.string_into(F.col("source"), "/", (F.col("text"), " "), "#", F.col("doc_id"))
    return docs.select("doc_id", label.alias("label"))


@query(
    "r18_unstring",
    """SELECT doc_id, p[1] AS first_part, p[2] AS second_part, CAST(len(p) AS INTEGER) AS parts
FROM (SELECT doc_id, string_split(text, '. ') AS p FROM documents)""",
)
def unstring(spark, d):
    docs = _table(spark, d, "documents", "doc_id", "text").select(
        "doc_id", fl.unstring(F.col("text"), ". ").alias("p")
    )
    return docs.select(
        "doc_id", fl.part(F.col("p"), 1).alias("first_part"), fl.part(F.col("p"), 2).alias("second_part"),
        F.size("p").alias("parts"),
    )


@query(
    "r19_inspect",
    """SELECT doc_id, (length(text) - length(replace(text, 'an', ''))) // 2 AS tally,
length(regexp_extract(text, '^( )*')) AS leading, md5(replace(text, 'e', '*')) AS replaced,
md5(translate(text, 'aeiou', '12345')) AS converted FROM documents""",
)
def inspect(spark, d):
    text = F.col("text")
    return _table(spark, d, "documents", "doc_id", "text").select(
        "doc_id",
        fl.inspect_tally(text, "an").alias("tally"),
        fl.inspect_tally(text, " ", leading=True).alias("leading"),
        F.md5(fl.inspect_replace(text, "e", "*")).alias("replaced"),
        F.md5(fl.inspect_converting(text, "aeiou", "12345")).alias("converted"),
    )


@query(
    "r20_subscript",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
CASE l_linenumber WHEN 1 THEN CAST(l_quantity AS BIGINT) WHEN 2 THEN l_linenumber WHEN 3 THEN l_suppkey END AS picked FROM lineitem""",
)
def subscript(spark, d):
    packed = rc.occurs_pack(_packed(spark, d), "items", *[f"t_{c}" for c in _PACKED])
    return packed.select(*_LINE_KEY, fl.subscript(F.col("items"), F.col("l_linenumber")).alias("picked"))


@query(
    "r21_qualify",
    "SELECT c_custkey, c_name AS name_of_customer, c_mktsegment AS segment FROM customer",
)
def qualify(spark, d):
    customer = _table(spark, d, "customer", "c_custkey", F.struct("c_name", "c_mktsegment").alias("customer_rec"))
    return customer.select(
        "c_custkey",
        fl.qualify("c_name", "customer_rec").alias("name_of_customer"),
        fl.qualify("c_mktsegment", "customer_rec").alias("segment"),
    )


@query(
    "r22_occurs",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, i AS subscript,
CASE i WHEN 1 THEN CAST(l_quantity AS BIGINT) WHEN 2 THEN l_linenumber ELSE l_suppkey END AS items
FROM lineitem, (VALUES (1), (2), (3)) AS v(i) WHERE i <= l_linenumber""",
)
def occurs(spark, d):
    packed = rc.occurs_pack(_packed(spark, d), "items", *[f"t_{c}" for c in _PACKED])
    current = packed.withColumn("items", fl.table_of(F.col("items"), F.col("l_linenumber")))
    return rc.occurs_explode(current, "items", counter="l_linenumber")


@query(
    "r23_redefines",
    """SELECT value AS record, CASE WHEN substr(value, 19, 1) = 'F' THEN CAST(substr(value, 1, 10) AS BIGINT)
WHEN substr(value, 19, 1) = 'O' THEN CAST(substr(value, 11, 8) AS BIGINT) END AS account
FROM (SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || lpad(CAST(o_custkey AS VARCHAR), 8, '0') || o_orderstatus AS value FROM orders)""",
)
def redefines(spark, d):
    records = rs.record_text(_orders(spark, d), _ORDER_LAYOUT[:3]).withColumnRenamed("value", "record")
    kind = F.substring("record", 19, 1)
    return rc.redefines_view(
        records, "record", "account", [(kind == "F", 1, 10, "bigint"), (kind == "O", 11, 8, "bigint")]
    )


@query(
    "r24_json",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
'{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS document FROM events""",
)
def json(spark, d):
    events = _table(spark, d, "events", "event_id", "event_type", "props")
    return events.select(
        "event_id",
        fl.json_parse(F.col("props"), "k bigint").getField("k").alias("k"),
        fl.json_generate("event_id", "event_type").alias("document"),
    )


@query(
    "r25_xml",
    "SELECT c_custkey, c_name, c_mktsegment, true AS counted FROM customer",
)
def xml(spark, d):
    customer = _table(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment")
    made = customer.select("c_custkey", fl.xml_generate("c_name", "c_mktsegment").alias("x"))
    back = fl.xml_parse(F.col("x.document"), "c_name string, c_mktsegment string")
    return made.select(
        "c_custkey", back.alias("r"), (F.length("x.document") == F.col("x.count")).alias("counted")
    ).select("c_custkey", "r.c_name", "r.c_mktsegment", "counted")


@query("r26_case", "SELECT p_partkey, upper(p_name) AS upper_name, lower(p_type) AS lower_type FROM part")
def change_case(spark, d):
    part = _table(spark, d, "part", "p_partkey", "p_name", "p_type")
    return part.select(
        "p_partkey", fl.to_upper(F.col("p_name")).alias("upper_name"), fl.to_lower(F.col("p_type")).alias("lower_type")
    )


@query(
    "r27_bits",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_orderkey & l_partkey AS a, l_orderkey | l_partkey AS o,
xor(l_orderkey, l_partkey) AS x, ~l_orderkey AS n, ~xor(l_orderkey, l_partkey) AS e FROM lineitem""",
)
def bits(spark, d):
    a, b = F.col("l_orderkey"), F.col("l_partkey")
    return _table(spark, d, "lineitem", *_LINE_KEY).select(
        *_LINE_KEY,
        fl.bit_and(a, b).alias("a"),
        fl.bit_or(a, b).alias("o"),
        fl.bit_xor(a, b).alias("x"),
        fl.bit_not(a).alias("n"),
        fl.bit_eq(a, b).alias("e"),
    )


@query("r28_format_time", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS formatted FROM events")
def format_time(spark, d):
    return _table(spark, d, "events", "event_id", "ts").select(
        "event_id", fl.format_time(F.col("ts")).alias("formatted")
    )


@query(
    "r29_search_table",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
CASE WHEN CAST(l_quantity AS BIGINT) > 25 THEN CAST(l_quantity AS BIGINT) WHEN l_linenumber > 25 THEN l_linenumber
WHEN l_suppkey > 25 THEN l_suppkey END AS hit FROM lineitem""",
)
def search_table(spark, d):
    packed = rc.occurs_pack(_packed(spark, d), "items", *[f"t_{c}" for c in _PACKED])
    return packed.select(*_LINE_KEY, fl.search_table(F.col("items"), lambda x: x > 25).alias("hit"))


@query(
    "r29_search_all",
    """WITH t AS (SELECT l_orderkey, list({'k': l_partkey, 's': l_suppkey, 'n': l_linenumber} ORDER BY l_partkey, l_suppkey, l_linenumber) AS items
FROM lineitem GROUP BY l_orderkey), p AS (SELECT *, items[(len(items) + 1) // 2].k + l_orderkey % 2 AS probe FROM t)
SELECT l_orderkey, probe, list_position(list_transform(items, lambda x: x.k), probe) AS place,
list_filter(items, lambda x: x.k = probe)[1].s AS supplier,
list_filter(items[2:], lambda x: x.n > 2)[1].k AS later,
len(list_filter(items, lambda x: x.k = probe)) = 0 AS at_end FROM p""",
)
def search_all(spark, d):
    """SEARCH ALL by part in the lines of an order, and SEARCH VARYING from the second."""
    lines = F.struct(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("n"))
    orders = _table(spark, d, "lineitem", *_LINE_KEY).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(lines)).alias("items"))
    middle = F.floor((F.size("items") + 1) / 2).cast("int")
    probed = orders.withColumn("probe", fl.subscript(F.col("items"), middle).getField("k") + F.col("l_orderkey") % 2)
    placed = probed.withColumn("place", fl.search_all(F.col("items"), F.col("probe"), lambda x: x.k))
    return placed.select(
        "l_orderkey",
        "probe",
        F.col("place").cast("bigint").alias("place"),
        fl.subscript(F.col("items"), F.col("place")).getField("s").alias("supplier"),
        fl.search_table(F.col("items"), lambda x: x.n > 2, 2).getField("k").alias("later"),
        F.col("place").isNull().alias("at_end"),
    )


#: An order: its lines, each with its marks, and behind them two fields more.
_VARYING_ORDER = (
    vr.item("l_orderkey", 10, "bigint"),
    vr.item("line_count", 1, "int"),
    vr.group(
        "lines",
        vr.item("part", 8, "bigint"),
        vr.item("mark_count", 1, "int"),
        vr.item("marks", 2, "string", most=4, depending="mark_count"),
        vr.item("quantity", 4, "decimal(4,1)", True),
        most=7,
        least=1,
        depending="line_count",
    ),
    vr.item("pieces", 7, "decimal(7,1)"),
    vr.item("closing", 12, "string"),
)


@query(
    "r22_varying_records",
    """WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS DECIMAL(4,1)) AS quantity, l_returnflag,
row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS place FROM lineitem),
k AS (SELECT * FROM l WHERE place <= 7), o AS (SELECT l_orderkey, count(*) AS line_count, CAST(sum(quantity) AS DECIMAL(7,1)) AS pieces FROM k GROUP BY l_orderkey)
SELECT k.l_orderkey, o.line_count, k.place, k.l_partkey AS part, k.l_partkey % 5 AS mark_count, repeat(k.l_returnflag || k.l_linenumber % 10, CAST(k.l_partkey % 5 AS INT)) AS marks,
k.quantity, o.pieces, 'ORDER ' || o.line_count || ' END' AS closing FROM k JOIN o ON k.l_orderkey = o.l_orderkey""",
)
def varying_records(spark, d):
    """Orders of one to seven lines with nought to four marks each: written, read, and told apart."""
    lines = _table(spark, d, "lineitem", *_LINE_KEY, F.col("l_quantity").cast("decimal(4,1)").alias("quantity"), "l_returnflag")
    marks = (F.col("l_partkey") % 5).cast("int")
    mark = F.concat("l_returnflag", (F.col("l_linenumber") % 10).cast("string"))
    line = F.struct(
        F.struct(*_LINE_KEY[1:]).alias("at"), F.col("l_partkey").alias("part"), marks.alias("mark_count"),
        F.array_repeat(mark, marks).alias("marks"), "quantity",
    )
    orders = lines.groupBy("l_orderkey").agg(F.slice(F.sort_array(F.collect_list(line)), 1, 7).alias("lines"))
    total = F.aggregate("lines", F.lit(0).cast("decimal(7,1)"), lambda s, x: (s + x.quantity).cast("decimal(7,1)"))
    made = orders.withColumn("line_count", F.size("lines")).withColumn("pieces", total)
    made = made.withColumn("closing", F.concat(F.lit("ORDER "), F.col("line_count").cast("string"), F.lit(" END")))
    path = scratch_path(spark, "varying-records")
    vr.write_varying(made, path, _VARYING_ORDER)
    back = rc.occurs_explode(vr.read_varying(spark, path, _VARYING_ORDER), "lines", "place")
    return back.select(
        "l_orderkey", F.col("line_count").cast("bigint").alias("line_count"), F.col("place").cast("bigint").alias("place"),
        "lines.part", F.col("lines.mark_count").cast("bigint").alias("mark_count"),
        F.array_join("lines.marks", "").alias("marks"), "lines.quantity", "pieces", "closing",
    )


@query(
    "r15_balance_resets",
    """WITH s AS (SELECT event_id, user_id, ts, event_type, CAST(value AS DECIMAL(18,2)) AS v,
sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS segment FROM events)
SELECT event_id, user_id, CAST(sum(v) OVER w AS DECIMAL(18,2)) AS balance, max(v) OVER w AS highest, min(v) OVER w AS lowest,
last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER w AS last_click,
first_value(event_type) OVER w AS opened_by, count(*) OVER w AS events FROM s
WINDOW w AS (PARTITION BY user_id, segment ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
)
def balance_resets(spark, d):
    """A balance per user that begins anew with each purchase, and what goes with it."""
    events = _table(spark, d, "events", "event_id", "user_id", "ts", "event_type", F.col("value").cast("decimal(18,2)").alias("v"))
    states = {
        "balance": (ordered.TOTAL, F.col("v")),
        "highest": (ordered.MOST, F.col("v")),
        "lowest": (ordered.LEAST, F.col("v")),
        "last_click": (ordered.LAST, F.when(F.col("event_type") == "click", F.col("event_id"))),
        "opened_by": (ordered.FIRST, F.col("event_type")),
        "events": (ordered.TOTAL, F.lit(1).cast("bigint")),
    }
    found = ordered.running_state(events, ["ts", "event_id"], states, F.col("event_type") == "purchase", ("user_id",))
    return found.select("event_id", "user_id", F.col("balance").cast("decimal(18,2)").alias("balance"), *list(states)[1:])


@query(
    "r15_perform_until",
    """WITH s AS (SELECT event_id, user_id, ts, sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS total FROM events),
t AS (SELECT *, coalesce(max(CASE WHEN total > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM s)
SELECT event_id, user_id, CAST(total AS DECIMAL(18,2)) AS total FROM t WHERE done = 0""",
)
def perform_until(spark, d):
    """The events of a user up to the one with which their total passes a limit."""
    events = _table(spark, d, "events", "event_id", "user_id", "ts", F.col("value").cast("decimal(18,2)").alias("v"))
    order = ["ts", "event_id"]
    summed = ordered.running_state(events, order, {"total": (ordered.TOTAL, F.col("v"))}, None, ("user_id",))
    found = ordered.rows_until(summed, order, F.col("total") > 300, ("user_id",), test_after=True)
    return found.select("event_id", "user_id", F.col("total").cast("decimal(18,2)").alias("total"))


@query(
    "r9_evaluate_ranges",
    """WITH w AS (SELECT p_partkey AS place, p_retailprice * 200 AS lo, p_retailprice * 200 + p_size * 40 AS hi,
p_size % 12 AS lo2, p_size % 12 + 4 AS hi2, p_brand AS rate FROM part)
SELECT o_orderkey, coalesce(arg_min(rate, place), 'none') AS rate FROM orders
LEFT JOIN w ON o_totalprice BETWEEN lo AND hi AND month(o_orderdate) BETWEEN lo2 AND hi2 GROUP BY o_orderkey""",
)
def evaluate_ranges(spark, d):
    """The rate of an order: one WHEN per part, a band of prices ALSO some months."""
    orders = _table(spark, d, "orders", "o_orderkey", "o_totalprice", F.month("o_orderdate").alias("month"))
    low = F.col("p_retailprice") * 200
    months = F.col("p_size") % 12
    whens = _table(
        spark, d, "part", F.col("p_partkey").alias("place"), low.alias("low_1"), (low + F.col("p_size") * 40).alias("high_1"),
        months.alias("low_2"), (months + 4).alias("high_2"), F.col("p_brand").alias("then"),
    )
    found = rc.evaluate_ranges(orders, ["o_totalprice", "month"], whens, "rate", "none")
    return found.select("o_orderkey", "rate")
