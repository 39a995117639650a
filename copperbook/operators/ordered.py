"""Running numbers and totals over long sequences.

A window over a whole sequence, or over one hot key, is one task. Here the rows
are dealt into ranges of group and order, so that a small group falls into one
range and a hot group is cut into many. In a range only the first group can have
begun earlier; its total so far, one row per range at most, is added to a window
within the range. No task sees more than a range, whatever the number of ranges,
and the plan does not depend on it.

The dealt rows are stored before they are read twice, since another evaluation
could cut the ranges elsewhere.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copperbook.session import scratch_path


def _dealt(df: DataFrame, keys: list[str], ranges: int) -> DataFrame:
    """The rows with ``__range``, ascending with the keys; stored."""
    spark = df.sparkSession
    path = scratch_path(spark, "ranges")
    cut = df.repartitionByRange(ranges, *keys).withColumn("__range", F.spark_partition_id())
    cut.write.parquet(path)
    return spark.read.schema(cut.schema).parquet(path)


def running_total(
    df: DataFrame,
    order: list[str],
    name: str,
    value: Column | None = None,
    within: tuple[str, ...] = (),
    ranges: int | None = None,
) -> DataFrame:
    """Add ``name``: the running sum of ``value``, or the running row number.

    ``order`` names columns that put the rows of a group in one definite order,
    nulls first. ``within`` names the group. ``value`` should be an exact type.
    ``ranges`` is the number of shuffle partitions unless given.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = _dealt(df, [*within, *order], ranges)
    measure = F.count("*") if value is None else F.sum(value)
    totals = cut.groupBy(*within, "__range").agg(measure.alias("__sum"))
    earlier = Window.partitionBy(*within).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # only a range whose first group began earlier keeps a row
    before = (
        totals.select(
            *[F.col(c).alias(f"__{c}") for c in within],
            F.col("__range").alias("__at"),
            F.count("*").over(earlier).alias("__ranges"),
            F.sum("__sum").over(earlier).alias("__before"),
        )
        .where("__ranges > 0")
        .drop("__ranges")
    )
    match = F.col("__range") == F.col("__at")
    for c in within:
        match = match & F.col(c).eqNullSafe(F.col(f"__{c}"))
    here = Window.partitionBy(*within, "__range").orderBy(*order)
    local = (
        F.row_number().over(here)
        if value is None
        else F.sum(value).over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    before_ = F.coalesce("__before", F.lit(0))
    return (
        cut.withColumn("__local", local)
        .join(F.broadcast(before), match, "left")  # at most a row per range
        .withColumn(name, F.when(F.col("__local").isNull(), F.col("__before")).otherwise(before_ + F.col("__local")))
        .drop("__range", "__at", "__before", "__local", *[f"__{c}" for c in within])
    )


def row_numbers(df: DataFrame, order: list[str], name: str, within: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """Add consecutive numbers from 1 in the given order, per group."""
    return running_total(df, order, name, None, within, ranges)


@dataclass(frozen=True)
class Rule:
    """How a state takes up values: ``fold`` over rows in order, as an aggregate,
    and ``join`` of the state of earlier rows with that of later ones. ``join`` is
    associative; either side is null where it has taken up nothing."""

    fold: Callable[[Column], Column]
    join: Callable[[Column, Column], Column]


TOTAL = Rule(F.sum, lambda a, b: F.coalesce(a + b, a, b))
MOST = Rule(F.max, F.greatest)
LEAST = Rule(F.min, F.least)
LAST = Rule(lambda v: F.last(v, ignorenulls=True), lambda a, b: F.coalesce(b, a))
FIRST = Rule(lambda v: F.first(v, ignorenulls=True), F.coalesce)


def running_state(
    df: DataFrame,
    order: list[str],
    states: dict[str, tuple[Rule, Column]],
    reset: Column | None = None,
    within: tuple[str, ...] = (),
    ranges: int | None = None,
) -> DataFrame:
    """PERFORM over records with states carried along: add each of ``states``, its
    rule over its values from the last row where ``reset`` holds, or from the first
    of the group, up to the row itself. Nulls are not taken up.

    ``order`` and ``within`` are those of ``running_total``. A range hands on one row
    for each group that goes on: its states since its last reset, and whether it had
    one; a scan over these rows gives each range its start. So a group may spread
    over any number of ranges, and their number does not change the result where the
    rules are exact.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rules = [rule for rule, _ in states.values()]
    at = [f"__v{i}" for i in range(len(rules))]
    restart = F.lit(0) if reset is None else F.coalesce(reset, F.lit(False)).cast("int")
    values = {v: value for v, (_, value) in zip(at, states.values())}
    cut = _dealt(df.withColumns({**values, "__reset": restart}), [*within, *order], ranges)

    def upto(*keys: str, by: list[str]) -> Window:
        return Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    part = [*within, "__range"]
    cut = cut.withColumn("__since", F.sum("__reset").over(upto(*part, by=order)))
    here = upto(*part, "__since", by=order)
    local = cut.withColumns({v: rule.fold(F.col(v)).over(here) for v, rule in zip(at, rules)})
    ends = local.groupBy(*part).agg(
        F.max_by(F.struct(*at), F.struct("__since", *order)).alias("__end"), F.max("__reset").alias("__reset")
    )
    ends = ends.select(*part, "__reset", *[F.col(f"__end.{v}").alias(v) for v in at])
    ends = ends.withColumn("__since", F.sum("__reset").over(upto(*within, by=["__range"])))
    carried = upto(*within, "__since", by=["__range"])
    ends = ends.withColumns({v: rule.fold(F.col(v)).over(carried) for v, rule in zip(at, rules)})
    group = Window.partitionBy(*within).orderBy("__range")
    starts = ends.select(
        *[F.col(c).alias(f"__{c}") for c in within],
        F.col("__range").alias("__at"),
        F.row_number().over(group).alias("__no"),
        *[F.lag(v).over(group).alias(f"__from{v}") for v in at],
    ).where("__no > 1").drop("__no")
    match = F.col("__range") == F.col("__at")
    for c in within:
        match = match & F.col(c).eqNullSafe(F.col(f"__{c}"))
    joined = local.join(F.broadcast(starts), match, "left")  # at most a row per range
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[
            F.when(F.col("__since") > 0, F.col(v)).otherwise(rule.join(F.col(f"__from{v}"), F.col(v))).alias(name)
            for name, v, rule in zip(states, at, rules)
        ],
    )


def rows_until(df: DataFrame, order: list[str], until: Column, within: tuple[str, ...], test_after: bool = False) -> DataFrame:
    """PERFORM UNTIL over records: the rows of each group before the first for which
    ``until`` holds; WITH TEST AFTER, that row too. All rows where it never holds."""
    place = F.struct(*order)
    stops = df.where(until).groupBy(*[F.col(c).alias(f"__{c}") for c in within]).agg(F.min(place).alias("__stop"))
    match = F.lit(True)
    for c in within:
        match = match & F.col(c).eqNullSafe(F.col(f"__{c}"))
    before = place <= F.col("__stop") if test_after else place < F.col("__stop")
    joined = df.join(stops, match, "left").where(F.col("__stop").isNull() | before)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns])
