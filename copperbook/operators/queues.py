"""Queues that stay on disk, with marks of how far they and their readers are.

An append writes its items under ``store``/items/batch=n and then a mark for each
queue it touched under ``store``/marks/batch=n: the first and last item number in the
batch. A later append numbers its items from the marks and reads no items; a read
finds from the marks which batches hold the items it wants and reads only these.
A reader's place is a row under ``store``/readers.

A batch counts once its marks are written. An append that failed before is not seen,
and the next one takes its number and overwrites it. One append at a time, and one
read at a time for each reader.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copperbook.operators.ordered import row_numbers
from copperbook.session import scratch_path

_MARKS = "queue string, first bigint, last bigint"
_PLACES = "reader string, queue string, item bigint"


def open_store(spark: SparkSession, store: str, data: str = "string") -> None:
    """Make the folders of a store; one that is there stays as it is."""
    for name, part, schema in (
        ("items", "batch", f"queue string, item bigint, data {data}"), ("marks", "batch", _MARKS), ("readers", "step", _PLACES),
    ):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{store}/{name}/{part}=0")


def _marks(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(_MARKS + ", batch int").parquet(f"{store}/marks")


def _live_marks(spark: SparkSession, store: str) -> DataFrame:
    """The marks of each queue since it was last deleted."""
    marks = _marks(spark, store)
    ends = marks.where("last = 0").groupBy("queue").agg(F.max("batch").alias("__end"))
    return marks.join(ends, "queue", "left").where("last > 0 AND (__end IS NULL OR batch > __end)").drop("__end")


def _next(rows: DataFrame, number: str) -> int:
    return (rows.agg(F.max(number)).first()[0] or 0) + 1


def append_items(spark: SparkSession, store: str, rows: DataFrame, order: list[str], ranges: int | None = None) -> None:
    """WRITEQ: rows (queue, data and the ``order`` columns) join the ends of their queues."""
    batch = _next(_marks(spark, store), "batch")
    high = _live_marks(spark, store).groupBy("queue").agg(F.max("last").alias("__high"))
    numbered = row_numbers(rows, order, "item", ("queue",), ranges)
    added = numbered.join(high, "queue", "left").select(
        "queue", (F.col("item") + F.coalesce("__high", F.lit(0))).cast("bigint").alias("item"), "data"
    )
    folder = f"{store}/items/batch={batch}"
    added.write.mode("overwrite").parquet(folder)
    written = spark.read.schema(added.schema).parquet(folder)
    marks = written.groupBy("queue").agg(F.min("item").alias("first"), F.max("item").alias("last"))
    marks.write.mode("overwrite").parquet(f"{store}/marks/batch={batch}")


def delete_queue(spark: SparkSession, store: str, queue: str) -> None:
    """DELETEQ: the queue is empty, and its next item is the first."""
    batch = _next(_marks(spark, store), "batch")
    # what a failed append may have left under this number
    _items(spark, store).drop("batch").limit(0).write.mode("overwrite").parquet(f"{store}/items/batch={batch}")
    gone = spark.createDataFrame([(queue, 0, 0)], _MARKS)
    gone.write.mode("overwrite").parquet(f"{store}/marks/batch={batch}")


def _items(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.option("basePath", f"{store}/items").parquet(f"{store}/items")


def items_between(spark: SparkSession, store: str, queue: str, first: int, last: int) -> DataFrame:
    """READQ ITEM: queue, item, data of the items with these numbers, in order."""
    held = _live_marks(spark, store).where((F.col("queue") == queue) & (F.col("first") <= last) & (F.col("last") >= first))
    batches = [r.batch for r in held.select("batch").collect()]  # at most one for each item asked for
    found = _items(spark, store).where(F.col("batch").isin(batches) & (F.col("queue") == queue) & F.col("item").between(first, last))
    return found.select("queue", "item", "data").orderBy("item")


def place_of(spark: SparkSession, store: str, reader: str, queue: str) -> int:
    """The last item a reader has taken, or 0."""
    places = spark.read.schema(_PLACES + ", step int").parquet(f"{store}/readers")
    own = places.where((F.col("reader") == reader) & (F.col("queue") == queue))
    return own.agg(F.max_by("item", "step")).first()[0] or 0


def read_next(spark: SparkSession, store: str, reader: str, queue: str, n: int = 1) -> DataFrame:
    """READQ NEXT ``n`` times: the items after the reader's place, which moves on. At
    the end of the queue fewer come, or none."""
    place = place_of(spark, store, reader, queue)
    high = _live_marks(spark, store).where(F.col("queue") == queue).agg(F.max("last")).first()[0] or 0
    found = items_between(spark, store, queue, place + 1, place + n)
    if high > place:
        places = spark.read.schema(_PLACES + ", step int").parquet(f"{store}/readers")
        moved = spark.createDataFrame([(reader, queue, min(place + n, high))], _PLACES)
        moved.write.parquet(f"{store}/readers/step={_next(places, 'step')}")
    return found


def new_store(spark: SparkSession, data: str = "string") -> str:
    """A store of its own in the scratch folder."""
    store = scratch_path(spark, "queues")
    open_store(spark, store, data)
    return store
