"""What several operators share: stored steps, packed rows, gapless numbers."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copperbook.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and read it again; cuts the lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(name: str) -> Column:
    """The UTF-8 bytes of a text column; null is empty."""
    return F.coalesce(F.col(f"`{name}`").cast("binary"), F.lit("").cast("binary"))


def texts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, ...]]:
    """Rows in lots of about ``size`` bytes of the last column, as column lists."""
    lot: list[tuple] = []
    held = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            lot.append(row)
            held += len(row[-1]) + 64
            if held >= size:
                yield tuple(map(list, zip(*lot)))
                lot, held = [], 0
    if lot:
        yield tuple(map(list, zip(*lot)))


def numbered(df: DataFrame, name: str, within: list[str], order: list[Column], lots: int) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... in each group, by a random-looking order.

    The first of ``order`` is a long spread evenly over its range. It is cut
    into ``lots`` lots; lots are numbered apart and the sizes of the lots before
    are added, so no window holds a group. ``df`` is read twice: store it first.
    """
    cut = df.withColumn("__lot", F.floor((order[0] / F.lit(2.0**64) + 0.5) * lots).cast("int"))
    sizes = cut.groupBy(*within, "__lot").agg(F.count("*").alias("__size"))
    earlier = Window.partitionBy(*within).orderBy("__lot").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(
        *[F.col(c).alias(f"__{c}") for c in within],
        F.col("__lot").alias("__at"),
        F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__before"),
    )
    same = F.col("__lot") == F.col("__at")
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    here = Window.partitionBy(*within, "__lot").orderBy(*order)
    return (
        cut.withColumn("__here", F.row_number().over(here))
        .join(before, same)
        .withColumn(name, (F.col("__before") + F.col("__here") - 1).cast("long"))
        .drop("__lot", "__at", "__before", "__here", *[f"__{c}" for c in within])
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns cannot clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])
