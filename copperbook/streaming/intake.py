"""Source files as they arrive.

A file is parsed within its own row, so the estate operators run on a stream as
they stand and keep no state.

Spark's stream source of files keeps an entry for each file it has ever seen on the
driver and lists all of them again and again. Where folders are listed by tasks
(``folders.listed``), an intake notes the files that are new at its start under
``checkpoint``/arrivals, ``files_per_batch`` to a file, and streams over these notes.
The files of a note are opened by the tasks of its batch. What is noted is never noted
again, however old a file is, and a note counts for one batch, so each file is read once.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from copperbook.session import scratch_path
from copperbook.sources.files import decoded_sources, few_listing_tasks, name_pattern, size_limit
from copperbook.sources.folders import listed, with_content
from copperbook.vocabulary import SOURCE_EXTENSIONS

_NOTE_SCHEMA = "path string, modificationTime timestamp, length bigint"
#: Notes that a task writes, about.
_NOTES_OF_TASK = 100
_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def source_stream(
    spark: SparkSession,
    root: str,
    extensions: tuple[str, ...] = SOURCE_EXTENSIONS,
    encoding: str = "utf-8",
    files_per_batch: int = 100_000,
) -> DataFrame:
    """path, rel_dir, text of the files that appear under ``root``."""
    with few_listing_tasks(spark):
        found = (
            spark.readStream.format("binaryFile")
            .schema(_FILE_SCHEMA)
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", name_pattern(extensions))
            .option("maxFilesPerTrigger", files_per_batch)
            .load(root)
        )
    stream = decoded_sources(spark, found, root, extensions, encoding)
    # for start_intake, which has a place to note files
    stream._noted = lambda checkpoint: _noted_stream(spark, root, extensions, encoding, files_per_batch, checkpoint)
    return stream


def _noted_stream(
    spark: SparkSession, root: str, extensions: tuple[str, ...], encoding: str, files_per_batch: int, checkpoint: str
) -> DataFrame | None:
    """The same stream by way of notes, or null where Spark's own source has to do: in
    other stores, and for a checkpoint that was begun with it."""
    listing = listed(spark, root, extensions)
    if listing is None:
        return None
    notes = f"{checkpoint.rstrip('/')}/arrivals"
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(notes).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not store.exists(path(notes)):
        if store.exists(path(f"{checkpoint.rstrip('/')}/offsets")):
            return None
        store.mkdirs(path(notes))
    known = spark.read.schema(_NOTE_SCHEMA).parquet(notes).select("path")
    staged = scratch_path(spark, "arrivals")
    listing.join(known, "path", "left_anti").select("path", "modificationTime", "length").write.parquet(staged)
    new = spark.read.schema(_NOTE_SCHEMA).parquet(staged)
    if count := new.count():
        tasks = -(-count // (files_per_batch * _NOTES_OF_TASK))
        order = ["modificationTime", "path"]
        dealt = new.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
        dealt.write.mode("append").option("maxRecordsPerFile", files_per_batch).parquet(notes)
    stream = spark.readStream.schema(_NOTE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(notes)
    wanted = stream.where(F.col("length") <= size_limit(spark)).repartition(spark.sparkContext.defaultParallelism)
    return decoded_sources(spark, with_content(wanted, missing=True), root, extensions, encoding)


def start_intake(
    sources: DataFrame,
    tables: dict[str, Callable[[DataFrame], DataFrame]],
    root: str,
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Write the tables made from each batch of files under ``root``/table/batch=n.

    ``prepare``, such as ``outline``, runs once a batch, and the tables are made
    from what it gives. A batch that runs again replaces its own folder, so a
    lost executor or a restart leaves no row twice. While ``few_listing_tasks``
    holds, the files of a batch are not listed by a task each.
    """

    noted = getattr(sources, "_noted", lambda checkpoint: None)(checkpoint)
    sources = sources if noted is None else noted

    def write(batch: DataFrame, batch_id: int) -> None:
        start = prepare(batch).persist() if prepare else batch
        for name, make in tables.items():
            make(start).write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
        if prepare:
            start.unpersist()

    return (
        sources.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def intake_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The rows of all batches of a table."""
    return spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}").drop("batch")


