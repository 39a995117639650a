"""Registered keyed-table queries with their SQL equivalents."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from copperbook.operators import keyed as ky
from copperbook.operators import queues as qu
from copperbook.operators import ranged as rg
from copperbook.session import scratch_path

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


_COLUMNS = ["c_custkey", "c_name", "c_mktsegment"]


def _customer(spark, d):
    return _table(spark, d, "customer", *_COLUMNS)


def _segment(spark, d, segment):
    return _table(spark, d, "customer", *_COLUMNS, "c_nationkey").where(F.col("c_mktsegment") == segment)


@query(
    "k1_keyed_read",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, o_orderstatus, CASE WHEN o_orderkey IS NULL THEN '23' ELSE '00' END AS status
FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_orderkey + l_suppkey AS k FROM lineitem) LEFT JOIN orders ON k = o_orderkey""",
)
def keyed_read(spark, d):
    requests = _table(
        spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        (F.col("l_orderkey") + F.col("l_suppkey")).alias("o_orderkey"),
    )
    orders = _table(spark, d, "orders", "o_orderkey", "o_orderstatus")
    return ky.keyed_read(requests, orders, "o_orderkey").drop("o_orderkey")


@query(
    "k2_keyed_write",
    """SELECT c_custkey, count(*) AS records, '22' AS status FROM (SELECT c_custkey FROM customer UNION ALL
SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') GROUP BY 1 HAVING count(*) > 1""",
)
def keyed_write(spark, d):
    rows = _table(spark, d, "orders", F.col("o_custkey").alias("c_custkey"), "o_orderpriority").where(
        F.col("o_orderpriority").startswith("1")
    )
    written = ky.keyed_write(_customer(spark, d).select("c_custkey"), rows.select("c_custkey"))
    return ky.duplicate_keys(written, "c_custkey")


@query(
    "k3_keyed_rewrite",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN upper(c_name) ELSE c_name END AS c_name,
CASE WHEN c_mktsegment = 'BUILDING' THEN 'CLOSED' ELSE c_mktsegment END AS c_mktsegment FROM customer""",
)
def keyed_rewrite(spark, d):
    rows = _segment(spark, d, "BUILDING").select(
        "c_custkey", F.upper("c_name").alias("c_name"), F.lit("CLOSED").alias("c_mktsegment")
    )
    stray = rows.withColumn("c_custkey", -F.col("c_custkey") - 1)
    return ky.keyed_rewrite(_customer(spark, d), rows.unionByName(stray), "c_custkey")


@query("k4_keyed_delete", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def keyed_delete(spark, d):
    keys = _table(spark, d, "orders", F.col("o_custkey").alias("c_custkey"), "o_orderstatus").where("o_orderstatus = 'P'")
    return ky.keyed_delete(_customer(spark, d), keys.select("c_custkey"), "c_custkey")


_LOG_SQL = """log AS (SELECT user_id AS k, event_id AS seq, event_type, CASE event_type WHEN 'error' THEN 'DELETE' WHEN 'signup' THEN 'WRITE'
ELSE 'REWRITE' END AS op, 'USER ' || event_type AS name, event_type AS segment FROM events),
last AS (SELECT k, arg_max(op, seq) AS op, arg_max(name, seq) AS name, arg_max(segment, seq) AS segment,
max(CASE WHEN op = 'WRITE' THEN seq END) AS written, max(CASE WHEN op = 'DELETE' THEN seq END) AS deleted FROM log GROUP BY k)"""


def change_log(events):
    """Events as a log of changes to customers, keyed by user."""
    kind = F.col("event_type")
    return events.select(
        F.col("user_id").alias("c_custkey"),
        F.col("event_id").alias("seq"),
        F.when(kind == "error", "DELETE").when(kind == "signup", "WRITE").otherwise("REWRITE").alias("op"),
        F.concat(F.lit("USER "), kind).alias("c_name"),
        kind.alias("c_mktsegment"),
    )


@query(
    "k5_apply_changes",
    f"""WITH {_LOG_SQL} SELECT coalesce(k, c_custkey) AS c_custkey, CASE WHEN k IS NULL THEN c_name ELSE name END AS c_name,
CASE WHEN k IS NULL THEN c_mktsegment ELSE segment END AS c_mktsegment
FROM customer FULL OUTER JOIN last ON c_custkey = k
WHERE op IS NULL OR (op <> 'DELETE' AND coalesce(written > deleted, deleted IS NULL AND (written IS NOT NULL OR c_custkey IS NOT NULL)))""",
)
def apply_changes(spark, d):
    log = change_log(_table(spark, d, "events", "event_id", "user_id", "event_type"))
    return ky.apply_changes(_customer(spark, d), log, "c_custkey")


@query("k6_browse", """SELECT * FROM (SELECT 'next' AS way, o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 700 ORDER BY o_orderkey LIMIT 25)
UNION ALL SELECT * FROM (SELECT 'prev', o_orderkey, o_custkey FROM orders WHERE o_orderkey <= 700 ORDER BY o_orderkey DESC LIMIT 25)""")
def browse(spark, d):
    orders = _table(spark, d, "orders", "o_orderkey", "o_custkey")
    forward = ky.browse(orders, "o_orderkey", 700, 25).withColumn("way", F.lit("next"))
    return forward.unionByName(ky.browse(orders, "o_orderkey", 700, 25, backward=True).withColumn("way", F.lit("prev")))


@query(
    "k7_organize_relative",
    "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS relative_no FROM orders",
)
def organize_relative(spark, d):
    return ky.organize(_table(spark, d, "orders", "o_orderkey", "o_totalprice"), "RRDS", ["o_totalprice", "o_orderkey"])


@query("k7_organize_entry", "SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) AS entry_no FROM events")
def organize_entry(spark, d):
    return ky.organize(_table(spark, d, "events", "event_id", "ts"), "ESDS", ["ts", "event_id"])


@query(
    "k7_organize_keyed",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1 AS unique_key
FROM lineitem""",
)
def organize_keyed(spark, d):
    lines = _table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return ky.organize(lines, "KSDS", ["l_orderkey", "l_linenumber"])


@query(
    "k8_sql_dml",
    """SELECT o_orderkey, o_orderstatus, CASE WHEN o_custkey < 50 THEN 'REVIEW' ELSE o_orderpriority END AS o_orderpriority
FROM (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders UNION ALL
  SELECT -c_custkey - 1, c_custkey, 'N', c_mktsegment FROM customer) WHERE o_orderstatus <> 'P'""",
)
def sql_dml(spark, d):
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    orders = _table(spark, d, "orders", *columns)
    rows = _table(
        spark, d, "customer",
        (-F.col("c_custkey") - 1).alias("o_orderkey"), F.col("c_custkey").alias("o_custkey"),
        F.lit("N").alias("o_orderstatus"), F.col("c_mktsegment").alias("o_orderpriority"),
    )
    changed = ky.sql_update(
        ky.sql_insert(orders, rows), F.col("o_custkey") < 50, {"o_orderpriority": F.lit("REVIEW")}
    )
    return ky.sql_delete(changed, F.col("o_orderstatus") == "P").drop("o_custkey")


@query(
    "k9_sql_select_into",
    "SELECT max(o_totalprice) AS ws_price, count(*) AS ws_count FROM orders WHERE o_orderstatus = 'F'",
)
def sql_select_into(spark, d):
    return ky.sql_select_into(
        spark,
        "SELECT max(o_totalprice), count(*) INTO :WS-PRICE, :WS-COUNT FROM {orders} WHERE o_orderstatus = :WS-STATUS",
        {"WS-STATUS": "F"},
        orders=_table(spark, d, "orders", "o_totalprice", "o_orderstatus"),
    )


@query("k10_sql_cursor", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def sql_cursor(spark, d):
    return ky.sql_cursor(
        spark,
        "DECLARE C1 CURSOR FOR SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > :WS-LIMIT",
        {":WS-LIMIT": 100000},
        orders=_table(spark, d, "orders", "o_orderkey", "o_totalprice"),
    )


def _queues(spark, d):
    events = _table(spark, d, "events", "event_id", "ts", "event_type", "props")
    rows = events.select(F.col("event_type").alias("queue"), F.col("props").alias("data"), "ts", "event_id")
    empty = spark.createDataFrame([], "queue string, item bigint, data string")
    first = ky.queue_append(empty, rows, ["ts", "event_id"])
    signups = events.where("event_type = 'signup'").select(
        F.when(F.col("event_id") % 2 == 0, "click").otherwise("view").alias("queue"),
        F.col("props").alias("data"),
        "event_id",
    )
    return first, signups


_QUEUES_SQL = """q1 AS (SELECT event_type AS queue, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS item, props AS data FROM events),
q2 AS (SELECT * FROM q1 UNION ALL SELECT t.queue, m.most + row_number() OVER (PARTITION BY t.queue ORDER BY event_id), props
FROM (SELECT CASE WHEN event_id % 2 = 0 THEN 'click' ELSE 'view' END AS queue, event_id, props FROM events WHERE event_type = 'signup') t
JOIN (SELECT queue, max(item) AS most FROM q1 GROUP BY queue) m ON t.queue = m.queue)"""


@query("k11_queue_append", f"WITH {_QUEUES_SQL} SELECT * FROM q2")
def queue_append(spark, d):
    first, signups = _queues(spark, d)
    return ky.queue_append(first, signups, ["event_id"])


@query("k11_queue_read", f"WITH {_QUEUES_SQL} SELECT * FROM q1 WHERE queue = 'purchase'")
def queue_read(spark, d):
    return ky.queue_read(_queues(spark, d)[0], "purchase")


@query("k11_queue_delete", f"WITH {_QUEUES_SQL} SELECT * FROM q1 WHERE queue <> 'error'")
def queue_delete(spark, d):
    return ky.queue_delete(_queues(spark, d)[0], "error")


@query(
    "k12_sql_merge",
    """SELECT coalesce(n.k, c_custkey) AS c_custkey, CASE WHEN n.k IS NULL THEN c_name ELSE 'SUPPLIER' END AS c_name,
CASE WHEN n.k IS NULL THEN c_mktsegment ELSE 'NEW' END AS c_mktsegment
FROM customer FULL OUTER JOIN (SELECT DISTINCT (s_suppkey // 2) * 30 AS k FROM supplier) n ON c_custkey = n.k""",
)
def sql_merge(spark, d):
    source = _table(
        spark, d, "supplier", (F.floor(F.col("s_suppkey") / 2) * 30).alias("c_custkey"),
        F.lit("SUPPLIER").alias("c_name"), F.lit("NEW").alias("c_mktsegment"),
    )
    return ky.sql_merge(_customer(spark, d), source, "c_custkey")


#: Records of a range in these queries: several ranges even in small tables.
_PER_RANGE = 5_000


@query(
    "k6_browse_pages",
    """WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber) AS r FROM lineitem),
s AS (SELECT count(*) AS before FROM lineitem WHERE l_orderkey < (SELECT max(l_orderkey) // 3 FROM lineitem))
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, 1 AS page, r - before AS place FROM l, s WHERE r BETWEEN before + 1 AND before + 400
UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, 2, r - before - 400 FROM l, s WHERE r BETWEEN before + 401 AND before + 800
UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, 3, before + 800 - r FROM l, s WHERE r BETWEEN before + 500 AND before + 799""",
)
def browse_pages(spark, d):
    """STARTBR at a third of the orders; 400 records on, 400 more, then 300 back."""
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    path = scratch_path(spark, "lines-by-range")
    lines = _table(spark, d, "lineitem", *keys, "l_quantity")
    rg.write_ranges(lines, path, keys, _PER_RANGE)
    third = lines.agg(F.floor(F.max("l_orderkey") / 3)).first()[0]
    one, place = rg.read_next(spark, path, keys, rg.start_browse(third, -1, -1, -1), 400)
    two, place = rg.read_next(spark, path, keys, place, 400)
    three, _ = rg.read_next(spark, path, keys, place, 300, backward=True)

    def numbered(page, n, backward=False):
        order = [F.col(k).desc() if backward else F.col(k) for k in keys]
        place = F.row_number().over(Window.orderBy(*order)).cast("bigint")  # of one page
        return page.select(*keys, "l_quantity", F.lit(n).alias("page"), place.alias("place"))

    return numbered(one, 1).unionByName(numbered(two, 2)).unionByName(numbered(three, 3, True))


@query(
    "k5_changes_by_range",
    """WITH m AS (SELECT max(o_orderkey) AS top FROM orders),
a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders, m WHERE NOT (o_orderstatus = 'F' AND o_orderkey < top // 4)),
s AS (SELECT top - 5 + s_suppkey AS k, s_acctbal AS price FROM supplier, m),
b AS (SELECT coalesce(k, o_orderkey) AS o_orderkey, CASE WHEN k IS NULL THEN o_orderstatus ELSE 'W' END AS o_orderstatus,
CASE WHEN k IS NULL THEN o_totalprice ELSE price END AS o_totalprice FROM a FULL OUTER JOIN s ON k = o_orderkey),
c AS (SELECT o_orderkey, CASE WHEN p_partkey IS NULL THEN o_orderstatus ELSE 'R' END AS o_orderstatus,
coalesce(p_retailprice, o_totalprice) AS o_totalprice FROM b LEFT JOIN part ON p_partkey = o_orderkey),
n AS (SELECT c_custkey * 2 AS k, c_acctbal AS price, c_nationkey % 3 AS kind FROM customer)
SELECT coalesce(k, o_orderkey) AS o_orderkey, CASE WHEN k IS NULL THEN o_orderstatus ELSE 'C' END AS o_orderstatus,
CASE WHEN k IS NULL THEN o_totalprice ELSE price END AS o_totalprice
FROM c FULL OUTER JOIN n ON k = o_orderkey WHERE k IS NULL OR kind = 0 OR (kind = 1 AND o_orderkey IS NOT NULL)""",
)
def changes_by_range(spark, d):
    """Rounds of DELETE, MERGE and REWRITE, and of a log of all three, which comes twice."""
    keys, path = ["o_orderkey"], scratch_path(spark, "orders-by-range")
    orders = _table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    rg.write_ranges(orders, path, keys, _PER_RANGE)
    top = orders.agg(F.max("o_orderkey")).first()[0]
    rg.delete_ranges(spark, path, orders.where((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") < top // 4)), keys)
    fresh = _table(
        spark, d, "supplier", (top - 5 + F.col("s_suppkey")).alias("o_orderkey"), F.lit("W").alias("o_orderstatus"),
        F.col("s_acctbal").alias("o_totalprice"),
    )
    rg.merge_ranges(spark, path, fresh, keys)
    prices = _table(
        spark, d, "part", F.col("p_partkey").alias("o_orderkey"), F.lit("R").alias("o_orderstatus"),
        F.col("p_retailprice").alias("o_totalprice"),
    )
    rg.rewrite_ranges(spark, path, prices, keys)
    kind = F.col("c_nationkey") % 3
    log = _table(
        spark, d, "customer", (F.col("c_custkey") * 2).alias("o_orderkey"), F.lit("C").alias("o_orderstatus"),
        F.col("c_acctbal").alias("o_totalprice"), F.lit(0).alias("seq"),
        F.when(kind == 0, ky.WRITE).when(kind == 1, ky.REWRITE).otherwise(ky.DELETE).alias("op"),
    )
    for _ in range(2):
        rg.change_ranges(spark, path, log, keys)
    return rg.read_ranges(spark, path)


@query(
    "k11_queue_store",
    """WITH click AS (SELECT row_number() OVER (ORDER BY step, ts, event_id) AS item, props AS data FROM (
SELECT 1 AS step, ts, event_id, props FROM events WHERE event_type = 'click'
UNION ALL SELECT 2, NULL, event_id, props FROM events WHERE event_type = 'signup' AND event_id % 2 = 0
UNION ALL SELECT 3, NULL, event_id, props FROM events WHERE event_type = 'purchase')),
error AS (SELECT row_number() OVER (ORDER BY event_id) AS item, props AS data FROM events WHERE event_type = 'view')
SELECT 'click' AS queue, item, data, CASE WHEN item <= 100 THEN 1 ELSE 2 END AS read FROM click
UNION ALL SELECT 'error', item, data, 3 FROM error WHERE item <= 30""",
)
def queue_store(spark, d):
    """Four appends and a deletion; a reader takes 100 items, then all that is left."""
    store = qu.new_store(spark)
    events = _table(spark, d, "events", "event_id", "ts", "event_type", F.col("props").alias("data"))

    def append(kind, queue, *order):
        rows = events if kind is None else events.where(F.col("event_type") == kind)
        qu.append_items(spark, store, rows.withColumn("queue", queue), list(order))

    append(None, F.col("event_type"), "ts", "event_id")
    one = qu.read_next(spark, store, "report", "click", 100)
    append("signup", F.when(F.col("event_id") % 2 == 0, "click").otherwise("view"), "event_id")
    append("purchase", F.lit("click"), "event_id")
    qu.delete_queue(spark, store, "error")
    append("view", F.lit("error"), "event_id")
    two = qu.read_next(spark, store, "report", "click", 1 << 40)
    three = qu.read_next(spark, store, "report", "error", 30)
    reads = [r.withColumn("read", F.lit(n)) for n, r in enumerate((one, two, three), 1)]
    return reads[0].unionByName(reads[1]).unionByName(reads[2])
