"""Source files in, derived tables out."""

import itertools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copperbook.session import settings
from copperbook.sources.folders import listed, local_folder, with_content, with_lines
from copperbook.vocabulary import SOURCE_EXTENSIONS

# decode() replaces bad bytes and knows every JVM charset only under these.
_LENIENT = {
    "spark.sql.legacy.codingErrorAction": "true",
    "spark.sql.legacy.javaCharsets": "true",
}


def _lenient_decoding(spark: SparkSession):
    return settings(spark, _LENIENT)


def few_listing_tasks(spark: SparkSession):
    """Spark lists folders, and the files of a streaming batch, by a task each up to
    ten thousand; here by a few for each core."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    return settings(spark, {key: str(min(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get(key))))})


def with_rel_dir(sources: DataFrame, root: str) -> DataFrame:
    """Add rel_dir, the folder of a file under ``root``; '.' for the root itself."""
    below = F.regexp_replace(F.regexp_replace("path", r"[^/]*$", ""), r"/+$", "")
    inside = F.regexp_extract(F.concat(below, F.lit("/")), rf"{_literal(root.rstrip('/'))}/+(.*)$", 1)
    rel = F.rtrim(inside, F.lit("/"))
    return sources.withColumn("rel_dir", F.when(rel == "", ".").otherwise(rel))


def _literal(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in text)


def name_pattern(extensions: tuple[str, ...]) -> str:
    """A file name pattern, so that no other file is opened."""
    return "{" + ",".join(f"*{e}" for e in extensions) + "}"


def size_limit(spark: SparkSession) -> int:
    """Bytes of the largest file that is read."""
    return int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str((1 << 31) - 1)))


def decoded_sources(
    spark: SparkSession, found: DataFrame, root: str, extensions: tuple[str, ...], encoding: str
) -> DataFrame:
    """path, rel_dir, text from the rows of the binary file source."""
    wanted = F.lit(False)
    for extension in extensions:
        wanted = wanted | F.col("path").endswith(extension)
    with _lenient_decoding(spark):
        read = found.where(wanted & (F.col("length") <= size_limit(spark))).select("path", F.decode("content", encoding).alias("text"))
        read.schema  # resolves the expression under the settings above
    return with_rel_dir(read, root).select("path", "rel_dir", "text")


def read_sources(
    spark: SparkSession,
    root: str,
    extensions: tuple[str, ...] = SOURCE_EXTENSIONS,
    encoding: str = "utf-8",
) -> DataFrame:
    """path, rel_dir, text of every file under ``root`` with one of the extensions.

    Bytes that do not decode become replacement characters. A file is one row,
    so its size is bounded by spark.sql.sources.binaryFile.maxLength; larger
    ones are listed by ``unread_sources`` and read by ``long_sources.long_lines``.
    """
    found = listed(spark, root, extensions)
    if found is not None:
        found = with_content(found.where(F.col("length") <= size_limit(spark)))
    else:
        found = found_files(spark, root, extensions)
    return decoded_sources(spark, found, root, extensions, encoding)


def found_files(spark: SparkSession, root: str, extensions: tuple[str, ...]) -> DataFrame:
    """The rows of the binary file source; contents are read only where asked for."""
    with few_listing_tasks(spark):
        return (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", name_pattern(extensions))
            .load(root)
        )


def unread_sources(spark: SparkSession, root: str, extensions: tuple[str, ...] = SOURCE_EXTENSIONS) -> DataFrame:
    """path, length, status of the files ``read_sources`` passes over for their size."""
    found = listed(spark, root, extensions)
    found = found_files(spark, root, extensions) if found is None else found
    return found.where(F.col("length") > size_limit(spark)).select("path", "length", F.lit("too large").alias("status"))


_CODECS = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst")


def decoded_lines(
    spark: SparkSession, root: str, extensions: tuple[str, ...] | None = None, encoding: str = "utf-8", above: int | None = None
) -> DataFrame:
    """path, block, at, raw: the lines of the files longer than ``above`` bytes, in
    blocks; ``block`` is the first byte of one, and ``at`` rises with the lines in it."""
    above = size_limit(spark) if above is None else above
    extensions = extensions or SOURCE_EXTENSIONS
    # Spark's text source unpacks files that are named for a codec
    packed = any(e.endswith(c) or c.endswith(e) for e in extensions for c in _CODECS)
    found = None if packed else listed(spark, root, extensions)
    if found is not None:
        with _lenient_decoding(spark):
            read = with_lines(found.where(F.col("length") > above)).select(
                "path", "block", F.col("at").cast("bigint").alias("at"), F.decode("value", encoding).alias("raw")
            )
            read.schema
        return read
    longer = F.col("_metadata.file_size") > above
    file = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    with few_listing_tasks(spark):
        found = (
            spark.read.option("recursiveFileLookup", "true")
            .option("pathGlobFilter", name_pattern(extensions))
            .text(root)
        )
    with _lenient_decoding(spark):
        # no other file is opened
        read = found.where(longer).select(
            F.regexp_replace(file, "^file:/+", "file:/").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("at"),
            F.decode(F.col("value").cast("binary"), encoding).alias("raw"),
        )
        read.schema
    return read


# characters that a folder named for a value holds as %XX, as Spark's writers have it
_ESCAPED = {ord(c): f"%{ord(c):02X}" for c in "\"#%'*/:=?\\{[]^\x7f" + "".join(map(chr, range(1, 32)))}


def _file_writer(folder: str):
    """For each program of a task, whose rows come one after another: one file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for program, texts in itertools.groupby(rows, lambda row: row[0] or None):
            value = program.translate(_ESCAPED) if program else "__HIVE_DEFAULT_PARTITION__"
            inside = f"{folder}/program={value}"
            os.makedirs(inside, exist_ok=True)
            # a task that runs again puts the same file in its place
            begun = f"{inside}/.{task.taskAttemptId()}"
            with open(begun, "wb") as file:
                for _, text in texts:
                    file.write((text or b"") + b"\n")
            os.replace(begun, f"{inside}/part-{task.partitionId():05d}.txt")
        yield from ()

    return write


def write_sources(sources: DataFrame, root: str) -> None:
    """Write each text to a file of its own, in a folder named for its path.

    The files end in ``.txt`` and close their last line. On mounted disks the tasks
    write them plainly, since there each new file of Spark's own writers starts two
    processes that set its mode.
    """
    named = sources.select(F.col("path").alias("program"), "text")
    folder = local_folder(sources.sparkSession, root)
    if folder is None:
        named.write.partitionBy("program").option("lineSep", "\n").text(root)
        return
    os.makedirs(folder)  # fails if it is there
    bytewise = named.withColumn("text", F.col("text").cast("binary")).sortWithinPartitions("program")
    bytewise.mapInArrow(_file_writer(folder), "program string").write.format("noop").mode("overwrite").save()


def write_estate(
    tables: dict[str, DataFrame], root: str, mode: str = "errorifexists", source_root: str | None = None
) -> None:
    """Write each table as Parquet under ``root``, partitioned by ``rel_dir``.

    With ``source_root``, the folder the sources were read from, a table with a
    ``path`` gets the sub-folder of its file.
    """
    for name, table in tables.items():
        if source_root is not None and "path" in table.columns and "rel_dir" not in table.columns:
            table = with_rel_dir(table, source_root)
        writer = table.write.mode(mode)
        if "rel_dir" in table.columns:
            writer = writer.partitionBy("rel_dir")
        writer.parquet(f"{root.rstrip('/')}/{name}")


def read_estate(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}")
