"""A keyed table that follows a stream of changes.

Each batch adds one row for every key it touches, so a batch costs what it
holds, whatever the size of the table. Reading applies the batches to the base.
``compact`` writes the result as a new base with a mark of the last batch in it;
from then on only later batches are read, and ``vacuum`` empties the others.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from copperbook.operators.keyed import apply_summary, change_summary, merge_summaries

_MARK = "target string, last_batch bigint"


def start_changes(log: DataFrame, root: str, key: str, checkpoint: str, seq: str = "seq", op: str = "op") -> StreamingQuery:
    """Follow a log with ``seq``, ``op`` and the fields of the table.

    The order of operations is ``seq``, across batches as well; batches may come
    in any order and may run again. Only a base that ``compact`` has written
    takes later batches as later changes.
    """

    spark, fields = log.sparkSession, [c for c in log.columns if c not in (key, seq, op)]
    # so that the table can be read before its first batch and its first base
    nothing = change_summary(spark.createDataFrame([], log.schema), key, fields, seq, op)
    nothing.write.mode("ignore").parquet(f"{root}/changes/batch=-1")
    spark.createDataFrame([], _MARK).write.mode("ignore").parquet(f"{root}/bases")

    def write(batch: DataFrame, batch_id: int) -> None:
        summary = change_summary(batch, key, fields, seq, op)
        summary.write.mode("overwrite").parquet(f"{root}/changes/batch={batch_id}")

    return (
        log.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _newest_base(spark: SparkSession, root: str) -> tuple[str, int] | None:
    """Target and last batch of the newest mark."""
    marks = spark.read.schema(_MARK).parquet(f"{root}/bases")
    row = marks.agg(F.max(F.struct("last_batch", "target")).alias("m")).first()["m"]
    return (row["target"], row["last_batch"]) if row else None


def changes_after(spark: SparkSession, root: str, batch: int) -> DataFrame:
    """The change rows of batches after one; folders of others are not read."""
    every = spark.read.option("basePath", f"{root}/changes").parquet(f"{root}/changes")
    return every.where(F.col("batch") > batch).drop("batch")


def _applied(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    return apply_summary(table, merge_summaries(changes, key, [c for c in table.columns if c != key]), key)


def current(spark: SparkSession, base: DataFrame, root: str, key: str) -> DataFrame:
    """The table with every change so far: the newest compacted base, or
    ``base`` where there is none, and the batches after it."""
    mark = _newest_base(spark, root)
    start = spark.read.parquet(mark[0]) if mark else base
    return _applied(start, changes_after(spark, root, mark[1] if mark else -1), key)


def compact(spark: SparkSession, base: DataFrame, root: str, key: str, target: str) -> DataFrame:
    """Write the current table to ``target``, a new folder, mark the batches in
    it, and read it from there. Batches that come meanwhile stay unmarked."""
    mark = _newest_base(spark, root)
    start, since = (spark.read.parquet(mark[0]), mark[1]) if mark else (base, -1)
    every = spark.read.option("basePath", f"{root}/changes").parquet(f"{root}/changes")
    last = every.agg(F.max("batch")).first()[0]
    if last is None or last <= since:
        return start
    part = every.where((F.col("batch") > since) & (F.col("batch") <= last)).drop("batch")
    _applied(start, part, key).write.mode("errorifexists").parquet(target)
    spark.range(1).select(F.lit(target).alias("target"), F.lit(last).cast("bigint").alias("last_batch")).write.mode(
        "append"
    ).parquet(f"{root}/bases")
    return spark.read.parquet(target)


def vacuum(spark: SparkSession, root: str) -> int:
    """Empty the batches that the newest base holds, and give their number. Run it
    while nobody reads the table by an older base."""
    mark = _newest_base(spark, root)
    if not mark:
        return 0
    every = spark.read.option("basePath", f"{root}/changes").parquet(f"{root}/changes")
    held = every.where((F.col("batch") >= 0) & (F.col("batch") <= mark[1]))
    done = [r[0] for r in held.select("batch").distinct().collect()]  # one per batch since the last time
    for batch in done:
        every.drop("batch").limit(0).write.mode("overwrite").parquet(f"{root}/changes/batch={batch}")
    return len(done)
