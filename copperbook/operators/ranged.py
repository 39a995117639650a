"""Keyed tables in an ordered layout: one folder for each range of keys.

``write_ranges`` writes a table under ``path``/rows/key_range=n, sorted by key
inside, and the lowest key of each range under ``path``/ranges. The ranges follow
the key order, so a browse reads only the ranges that can hold the next records,
and changes rewrite only the ranges their keys fall into. The format is plain
Parquet with a partition column; any reader of such folders can read it.

The lowest keys stay as they were written. Records with keys below the first of
them belong to the first range, records above to the last one. ``MOST_RANGES``
bounds their number, and with it the array in which a key finds its range by
bisection. Write the table anew when ranges have grown uneven.

A change writes the touched ranges to a staging folder by Spark's own commit of
dynamic partition overwrite, so a job that fails or loses executors leaves the
ranges as they were. There is one writer at a time.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copperbook.functions.fields import leading
from copperbook.operators import keyed as ky
from copperbook.session import scratch_path, settings
from copperbook.sources.files import few_listing_tasks

#: Ranges of a table at most; beyond, ranges hold more records.
MOST_RANGES = 1 << 16
#: Keys for each range, times three, that the driver takes to choose the ends of ranges.
KEYS_OF_RANGE = 10
#: Ranges looked at together for the next records of a browse, at first.
AHEAD = 8


def _at(keys: list[str]) -> Column:
    return F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])


def write_ranges(table: DataFrame, path: str, keys: list[str], per_range: int = 1_000_000) -> None:
    """Lay out a table by its key, a list of columns that tell the records apart.
    Ranges hold about ``per_range`` records; equal keys share one."""
    spark = table.sparkSession
    held = table.count()
    if not held:  # one range that begins before every key
        table.limit(0).write.mode("overwrite").parquet(f"{path}/rows/key_range=0")
        nulls = F.struct(*[F.lit(None).cast(table.schema[k].dataType).alias(f"k{i}") for i, k in enumerate(keys)])
        spark.range(1).select(F.lit(0).alias("key_range"), nulls.alias("low")).write.mode("overwrite").parquet(f"{path}/ranges")
        return
    count = max(1, min(MOST_RANGES, -(-held // per_range)))
    ranged = table.repartitionByRange(count, *keys).withColumn("key_range", F.spark_partition_id())
    with settings(spark, {"spark.sql.execution.rangeExchange.sampleSizePerPartition": str(KEYS_OF_RANGE)}):
        _write(ranged, f"{path}/rows", keys)
    rows = _rows(spark, path)
    lows = rows.groupBy("key_range").agg(F.min(_at(keys)).alias("low"))
    lows.repartition(1).write.mode("overwrite").parquet(f"{path}/ranges")  # at most MOST_RANGES rows


def _write(ranged: DataFrame, rows: str, keys: list[str], mode: str = "static") -> None:
    (
        ranged.sortWithinPartitions("key_range", *keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", mode)
        .partitionBy("key_range")
        .parquet(rows)
    )


def _rows(spark: SparkSession, path: str) -> DataFrame:
    with few_listing_tasks(spark):
        return spark.read.parquet(f"{path}/rows")


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """All records of the table."""
    return _rows(spark, path).drop("key_range")


def _in_range(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Add the ``key_range`` of the key, found by bisection among the lowest keys."""
    ranges = df.sparkSession.read.parquet(f"{path}/ranges")
    kinds = ranges.schema["low"].dataType
    own = F.struct(*[F.col(k).cast(f.dataType).alias(f.name) for k, f in zip(keys, kinds)])
    held = ranges.agg(F.sort_array(F.collect_list(F.struct("low", "key_range"))).alias("held")).scalar()
    before = leading(F.col("__held"), lambda x: x.low <= F.col("__own"))
    return (
        df.withColumns({"__held": held, "__own": own})
        .withColumn("key_range", F.get(F.col("__held"), F.greatest(before, F.lit(1)) - 1).getField("key_range"))
        .drop("__held", "__own")
    )


@dataclass(frozen=True)
class Place:
    """Where a browse stands: a key, and whether its record is still to come."""

    key: tuple
    included: bool = False


def start_browse(*key) -> Place:
    """STARTBR: READNEXT and READPREV begin with the record of this key, if any."""
    return Place(key, True)


def read_next(
    spark: SparkSession, path: str, keys: list[str], place: Place, n: int, backward: bool = False
) -> tuple[DataFrame, Place]:
    """READNEXT (or READPREV) ``n`` times: the records in reading order, and the
    place from which either direction goes on. Reads the range of the place and
    as many after it (before it) as can hold n records: these are counted from
    the files' footers. At the end of the table fewer records come, or none."""
    ranges = spark.read.parquet(f"{path}/ranges")
    rows = _rows(spark, path)
    kinds = ranges.schema["low"].dataType
    here = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(place.key, kinds)])
    first = ranges.where(F.col("low") <= here).agg(F.max("key_range")).first()[0]
    ends = ranges.agg(F.min("key_range"), F.max("key_range")).first()
    if ends[0] is None:
        return rows.drop("key_range").limit(0), place
    step = -1 if backward else 1
    at, last = (ends[0] if first is None else first), (ends[0] if backward else ends[1])
    order = [F.col(k).desc() if backward else F.col(k).asc() for k in keys]
    beyond = _at(keys) < here if backward else _at(keys) > here
    if place.included:
        beyond = beyond | (_at(keys) == here)

    wanted = rows.where((F.col("key_range") == at) & beyond)
    held, reach, look = wanted.count(), at, AHEAD
    while held < n and reach != last:
        low, high = sorted((reach + step, max(ends[0], min(ends[1], reach + step * look))))
        sizes = {r.key_range: r["count"] for r in rows.where(F.col("key_range").between(low, high)).groupBy("key_range").count().collect()}
        for reach in range(low, high + 1) if step > 0 else range(high, low - 1, -1):
            held += sizes.get(reach, 0)
            if held >= n:
                break
        look *= 2
    low, high = sorted((at, reach))
    page = rows.where(F.col("key_range").between(low, high) & beyond).orderBy(*order).limit(n).drop("key_range")
    far = page.agg((F.min if backward else F.max)(_at(keys)).alias("far")).first()["far"]
    return page, (place if far is None else Place(tuple(far)))


def change_ranges(spark: SparkSession, path: str, log: DataFrame, keys: list[str], seq: str = "seq", op: str = "op") -> None:
    """Apply a log of WRITE, REWRITE and DELETE, as ``keyed.apply_changes`` does, to
    the ranges its keys fall into; all others keep their files. A log that is
    applied again changes nothing."""
    rows = _rows(spark, path)
    fields = [c for c in rows.columns if c not in ("key_range", *keys)]
    # one row per key, with its range; written once, as it is read three times
    summary = ky.change_summary(log.withColumn("__id", _at(keys)), "__id", [*keys, *fields], seq, op)
    staged = scratch_path(spark, "changes")
    _in_range(summary, path, keys).write.parquet(staged)
    changes = spark.read.parquet(staged)
    touched = sorted(r[0] for r in changes.select("key_range").distinct().collect())  # at most MOST_RANGES
    if not touched:
        return
    old = rows.where(F.col("key_range").isin(touched)).withColumn("__id", _at(keys))
    new = ky.apply_summary(old, changes.select(*old.columns, "__seq", "__op", "__written", "__deleted"), "__id").drop("__id")
    # a record keeps its range, and so does a change: only the log was looked up
    done = scratch_path(spark, "changed")
    new.write.parquet(done)
    changed = spark.read.parquet(done).select(*rows.columns)
    left = {r[0] for r in changed.select("key_range").distinct().collect()}
    # a range is one task and gives one file
    _write(changed.repartition(len(touched), "key_range"), f"{path}/rows", keys, "dynamic")
    for emptied in sorted(set(touched) - left):
        # no rows, so the dynamic overwrite does not reach it
        rows.drop("key_range").limit(0).write.mode("overwrite").parquet(f"{path}/rows/key_range={emptied}")


def _as_log(rows: DataFrame, op: str, seq: str | None) -> DataFrame:
    return rows.withColumns({"op": F.lit(op), "seq": F.lit(0) if seq is None else F.col(seq)})


def rewrite_ranges(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], seq: str | None = None) -> None:
    """REWRITE: records that are there take the row of their key."""
    change_ranges(spark, path, _as_log(rows, ky.REWRITE, seq), keys)


def merge_ranges(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], seq: str | None = None) -> None:
    """MERGE: records that are there are replaced, others added."""
    change_ranges(spark, path, _as_log(rows, ky.WRITE, seq), keys)


def delete_ranges(spark: SparkSession, path: str, wanted: DataFrame, keys: list[str]) -> None:
    """DELETE: records with these keys go."""
    table = _rows(spark, path)
    missing = [f for f in table.schema if f.name not in ("key_range", *keys)]
    full = wanted.select(*keys).withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})
    change_ranges(spark, path, _as_log(full, ky.DELETE, None), keys)
