"""Tables that follow a folder of files which come, change and go.

A round compares the listing of the files with what was taken in so far. Files
that are new or have another time or length are read, and the rows made from them
are written under ``store``/table/version=n; then ``store``/files/version=n says which
files these were, and which are gone. That folder is written last and counts as
the round's end: a round that failed before it is not seen, and the next one takes
its number and overwrites what it left. A round without differences writes nothing.

Rows are current while the version they were written under is the newest of their
file and the file is still there. The stream source of files cannot do this: it
takes a path once and never again.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copperbook.session import scratch_path
from copperbook.sources.files import decoded_sources, found_files
from copperbook.vocabulary import SOURCE_EXTENSIONS

_FILES = "path string, time timestamp, length bigint, is_there boolean"

Tables = dict[str, Callable[[DataFrame], DataFrame]]
#: (listing(path, time, length), contents): ``contents`` gives path and text of the
#: files of a part of the listing.
Folder = tuple[DataFrame, Callable[[DataFrame], DataFrame]]


def folder(spark: SparkSession, root: str, extensions: tuple[str, ...] = SOURCE_EXTENSIONS, encoding: str = "utf-8") -> Folder:
    """The source files under ``root`` as they are now. Listing opens none of them."""
    found = found_files(spark, root, extensions)
    listing = found.select("path", F.col("modificationTime").alias("time"), "length")

    def contents(wanted: DataFrame) -> DataFrame:
        oldest = wanted.agg(F.min("time")).first()[0]
        # the bound reaches the scan, so that older files are not opened
        recent = found.where(F.col("modificationTime") >= F.lit(oldest))
        return decoded_sources(spark, recent, root, extensions, encoding).join(wanted.select("path"), "path", "left_semi")

    return listing, contents


def _versions(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(_FILES + ", version int").parquet(f"{store}/files")


def newest_files(spark: SparkSession, store: str) -> DataFrame:
    """path, time, length, is_there, version of every file ever taken in."""
    newest = F.max_by(F.struct("time", "length", "is_there", "version"), "version")
    return _versions(spark, store).groupBy("path").agg(newest.alias("f")).select("path", "f.*")


def take_in(
    spark: SparkSession, store: str, files: Folder, tables: Tables, prepare: Callable[[DataFrame], DataFrame] | None = None
) -> int | None:
    """One round; gives its version, or null where nothing had changed. ``prepare``,
    such as ``outline``, runs once, and the tables are made from what it gives; each
    keeps ``path``. One round at a time."""
    listing, contents = files
    spark.createDataFrame([], _FILES).write.mode("ignore").parquet(f"{store}/files/version=0")
    known = newest_files(spark, store).where("is_there").select("path", F.struct("time", "length").alias("was"))
    seen = listing.select("path", F.struct("time", "length").alias("now"))
    both = seen.join(known, "path", "full").where(~F.col("now").eqNullSafe(F.col("was")))
    staged = scratch_path(spark, "round")
    both.select("path", "now.time", "now.length", F.col("now").isNotNull().alias("is_there")).write.parquet(staged)
    changed = spark.read.parquet(staged)
    if changed.isEmpty():
        return None
    version = _versions(spark, store).agg(F.max("version")).first()[0]
    version = (version or 0) + 1
    sources = contents(changed.where("is_there"))
    start = prepare(sources).persist() if prepare else sources
    for name, make in tables.items():
        make(start).write.mode("overwrite").parquet(f"{store}/{name}/version={version}")
    if prepare:
        start.unpersist()
    changed.write.mode("overwrite").parquet(f"{store}/files/version={version}")
    return version


def current_rows(spark: SparkSession, store: str, name: str) -> DataFrame:
    """The rows of a table that are current."""
    there = newest_files(spark, store).where("is_there").select("path", "version")
    return _rows(spark, store, name).join(there, ["path", "version"], "left_semi").drop("version")


def _rows(spark: SparkSession, store: str, name: str) -> DataFrame:
    return spark.read.option("basePath", f"{store}/{name}").parquet(f"{store}/{name}")


def compact(spark: SparkSession, store: str, names: list[str]) -> int:
    """Write what is current as one version, and empty the versions before it. Until
    the new version is complete the old ones count; run it while nobody reads."""
    last = _versions(spark, store).agg(F.max("version")).first()[0] or 0
    there = newest_files(spark, store).where("is_there").drop("version")
    for name in names:
        current_rows(spark, store, name).write.mode("overwrite").parquet(f"{store}/{name}/version={last + 1}")
    there.write.mode("overwrite").parquet(f"{store}/files/version={last + 1}")
    for name in names:
        rows = _rows(spark, store, name)
        old = [r[0] for r in rows.where(F.col("version") <= last).select("version").distinct().collect()]  # one per round
        for version in old:
            rows.drop("version").limit(0).write.mode("overwrite").parquet(f"{store}/{name}/version={version}")
    return last + 1
