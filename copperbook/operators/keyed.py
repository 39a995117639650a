"""Keyed access, embedded SQL and queues as table operators.

Tables are DataFrames with one row per key. Joins are left to the adaptive
planner: it splits a key that holds a large share of the requests, and sends a
side to every task only when its measured size allows.
"""

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copperbook.operators.ordered import row_numbers
from copperbook.vocabulary import STATUS_DUPLICATE_KEY, STATUS_NOT_FOUND, STATUS_OK

# Operations of a change log.
WRITE, REWRITE, DELETE = "WRITE", "REWRITE", "DELETE"


def keyed_read(requests: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Each request with the record of its key and ``status`` 00 or 23."""
    return (
        requests.join(table.withColumn("__found", F.lit(True)), key, "left")
        .withColumn("status", F.when(F.col("__found"), STATUS_OK).otherwise(STATUS_NOT_FOUND))
        .drop("__found")
    )


def keyed_write(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The table with the rows added."""
    return table.unionByName(rows)


def duplicate_keys(table: DataFrame, key: str) -> DataFrame:
    """key, records, status 22: keys held by more than one record."""
    return (
        table.groupBy(key)
        .agg(F.count("*").alias("records"))
        .where("records > 1")
        .withColumn("status", F.lit(STATUS_DUPLICATE_KEY))
    )


def keyed_rewrite(table: DataFrame, rows: DataFrame, key: str, seq: str | None = None) -> DataFrame:
    """Records of the table replaced by the row of the same key; other rows are
    not added. Of several rows for a key the last by ``seq`` stands, or without
    it the greatest in column order; ``duplicate_keys`` of the rows reports them."""
    fields = [c for c in table.columns if c != key]
    fresh = _one_each(rows, key, fields, seq)
    return table.join(fresh, F.col(key) == F.col("__key"), "left").select(
        *[
            F.col(c)
            if c == key
            else F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c)
            for c in table.columns
        ]
    )


def _one_each(rows: DataFrame, key: str, fields: list[str], seq: str | None) -> DataFrame:
    """__key and __new, the fields of the row that stands."""
    fresh = F.struct(*fields)
    one = F.max(fresh) if seq is None else F.max_by(fresh, F.col(seq))
    return rows.groupBy(F.col(key).alias("__key")).agg(one.alias("__new"))


def keyed_delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys, key, "left_anti").select(*table.columns)


def change_summary(log: DataFrame, key: str, fields: list[str], seq: str = "seq", op: str = "op") -> DataFrame:
    """One row per key of a log: the key, ``__seq`` and ``__op`` of its last
    operation, ``__written`` and ``__deleted`` (when WRITE and DELETE came last),
    and the fields. Operations of a key meet as partial maxima, so a key with a
    third of the log costs no more than any."""
    moment = {name: F.when(F.col(op) == name, F.col(seq)) for name in (WRITE, DELETE)}
    marked = log.select(
        F.col(key), F.col(seq).alias("__seq"), F.col(op).alias("__op"),
        moment[WRITE].alias("__written"), moment[DELETE].alias("__deleted"), *[c for c in fields],
    )
    return merge_summaries(marked, key, fields)


def merge_summaries(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Summaries of several logs, in any order, as the summary of all."""
    met = rows.groupBy(key).agg(
        F.max_by(F.struct("__op", *fields), F.col("__seq")).alias("__last"),
        F.max("__seq").alias("__seq"),
        F.max("__written").alias("__written"),
        F.max("__deleted").alias("__deleted"),
    )
    return met.select(
        key, "__seq", "__last.__op", "__written", "__deleted", *[F.col(f"__last.{c}").alias(c) for c in fields]
    )


def apply_summary(table: DataFrame, summary: DataFrame, key: str) -> DataFrame:
    """The table after the operations of a summary.

    WRITE leaves a record whatever was there, DELETE none, and REWRITE changes
    one that is there; so a record whose last operation is REWRITE needs a WRITE
    after its last DELETE, or no DELETE and a place in the table.
    """
    fields = [c for c in table.columns if c != key]
    last = summary.select(
        F.col(key).alias("__key"), "__op", "__written", "__deleted", F.struct(*fields).alias("__new")
    )
    joined = table.withColumn("__old", F.lit(True)).join(last, F.col(key) == F.col("__key"), "full")
    touched = F.col("__key").isNotNull()
    there = F.coalesce(
        F.col("__written") > F.col("__deleted"),
        F.col("__deleted").isNull() & (F.col("__written").isNotNull() | F.col("__old").isNotNull()),
    )
    return joined.where(~touched | ((F.col("__op") != DELETE) & there)).select(
        *[
            F.coalesce(F.col("__key"), F.col(key)).alias(c)
            if c == key
            else F.when(touched, F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c)
            for c in table.columns
        ]
    )


def apply_changes(table: DataFrame, log: DataFrame, key: str, seq: str = "seq", op: str = "op") -> DataFrame:
    """The table after a log of WRITE, REWRITE and DELETE, in the order of
    ``seq``. Only a WRITE adds a record; one for a key that is there replaces it."""
    fields = [c for c in table.columns if c != key]
    return apply_summary(table, change_summary(log, key, fields, seq, op), key)


def browse(table: DataFrame, key: str, start, n: int, backward: bool = False) -> DataFrame:
    """STARTBR at ``start`` and ``n`` times READNEXT, or READPREV."""
    if backward:
        return table.where(F.col(key) <= F.lit(start)).orderBy(F.col(key).desc()).limit(n)
    return table.where(F.col(key) >= F.lit(start)).orderBy(key).limit(n)


def organize(table: DataFrame, kind: str, order: list[str], ranges: int | None = None) -> DataFrame:
    """The table under a file organisation.

    KSDS adds ``unique_key``, whether a record's key (``order``) is its own.
    RRDS adds ``relative_no`` and ESDS ``entry_no``, counted in that order.
    """
    if kind == "KSDS":
        counts = table.groupBy(*order).agg((F.count("*") == 1).alias("unique_key"))
        return table.join(counts, order)
    if kind in ("RRDS", "ESDS"):
        return row_numbers(table, order, "relative_no" if kind == "RRDS" else "entry_no", ranges=ranges)
    raise ValueError(f"organisation is KSDS, RRDS or ESDS, not {kind!r}")


def sql_insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows)


def sql_update(table: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    return table.withColumns(
        {c: F.when(where, v.cast(table.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()}
    )


def sql_delete(table: DataFrame, where: Column) -> DataFrame:
    """Rows for which the condition is false or unknown stay."""
    return table.where(~F.coalesce(where, F.lit(False)))


def sql_merge(table: DataFrame, source: DataFrame, key: str, seq: str | None = None) -> DataFrame:
    """MERGE: matched rows are updated, the others inserted. Of several source
    rows for a key one stands, as in ``keyed_rewrite``; ``duplicate_keys`` of the
    source reports them."""
    fields = [c for c in table.columns if c != key]
    fresh = _one_each(source, key, fields, seq)
    taken = F.col("__new").isNotNull()
    return table.join(fresh, F.col(key) == F.col("__key"), "full").select(
        *[
            F.coalesce(F.col("__key"), F.col(key)).alias(c)
            if c == key
            else F.when(taken, F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c)
            for c in table.columns
        ]
    )


_LITERAL_OR_HOST = re.compile(r"""('(?:[^']|'')*'|"(?:[^"]|"")*")|:([A-Za-z][A-Za-z0-9-]*)""")


def _markers(sql: str) -> str:
    """:HOST-NAME -> :host_name, the form of a named marker; quoted text stays."""
    return _LITERAL_OR_HOST.sub(lambda m: m[1] or ":" + m[2].replace("-", "_").lower(), sql)


def _arguments(args: dict) -> dict:
    return {k.lstrip(":").replace("-", "_").lower(): v for k, v in args.items()}


def sql_cursor(spark: SparkSession, sql: str, args: dict, **tables: DataFrame) -> DataFrame:
    """DECLARE name CURSOR FOR select: the rows, as a DataFrame.

    ``:HOST-NAME`` takes its value from ``args``; ``{name}`` is a table. The end
    of the rows is the end of the DataFrame.
    """
    select = re.sub(r"(?is)^\s*DECLARE\s+\S+\s+CURSOR\s+FOR\s+", "", sql)
    return spark.sql(_markers(select), args=_arguments(args), **tables)


def sql_select_into(spark: SparkSession, sql: str, args: dict, **tables: DataFrame) -> DataFrame:
    """SELECT ... INTO :A, :B FROM ...: the first row, columns named for the
    receiving fields. The receiving fields take no arguments. Which row is first
    is definite only under an ORDER BY that tells all rows apart."""
    found = re.match(r"(?is)^\s*SELECT\s+(.*?)\s+INTO\s+(.*?)\s+FROM\s+(.*)$", sql)
    if not found:
        raise ValueError("SELECT without INTO")
    columns, into, rest = found.groups()
    targets = [t.strip().lstrip(":").replace("-", "_").lower() for t in into.split(",")]
    rows = spark.sql(_markers(f"SELECT {columns} FROM {rest}"), args=_arguments(args), **tables)
    return rows.limit(1).toDF(*targets)


def queue_append(queues: DataFrame, rows: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """WRITEQ: rows (queue, data and the ``order`` columns) join the end of their
    queues. ``queues`` has queue, item and data; items count from 1."""
    last = queues.groupBy("queue").agg(F.max("item").alias("__last"))
    numbered = row_numbers(rows, order, "item", ("queue",), ranges)
    added = numbered.join(last, "queue", "left").select(
        "queue", (F.col("item") + F.coalesce("__last", F.lit(0))).alias("item"), "data"
    )
    return queues.select("queue", "item", "data").unionByName(added)


def queue_read(queues: DataFrame, queue: str, item: int | None = None) -> DataFrame:
    """READQ: the items of a queue in order, or one of them."""
    found = queues.where(F.col("queue") == queue)
    return found.orderBy("item") if item is None else found.where(F.col("item") == item)


def queue_delete(queues: DataFrame, queue: str) -> DataFrame:
    """DELETEQ: everything but this queue."""
    return queues.where(~F.col("queue").eqNullSafe(F.lit(queue)))
