"""Registered streaming queries: tables read as streams, run to their end."""

from pyspark.sql import functions as F

from copperbook.operators import outline as ol
from copperbook.operators import statements as sm
from copperbook.operators import summaries as su
from copperbook.plans import estate_oracles, estate_queries, keyed_queries
from copperbook.session import scratch_path
from copperbook.sources import files
from copperbook.sources.estate_from_parts import estate
from copperbook.streaming import changes, intake, versions

_BATCHES = 4
_FILES_PER_BATCH = 1000


def _stream(spark, frame, name):
    """A table as a stream of a few batches, from files in the shared folder."""
    path = scratch_path(spark, name)
    frame.repartition(_BATCHES).write.parquet(path)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)


def intake_statements(spark, d):
    """The files of the estate as they arrive, a few batches of them."""
    found = intake.source_stream(spark, estate_queries.estate_files(spark, d), (".txt",), files_per_batch=_FILES_PER_BATCH)
    root, checkpoint = scratch_path(spark, "intake"), scratch_path(spark, "intake-checkpoint")
    tables = {"statements": sm.statements, "copies": ol.copies}
    with files.few_listing_tasks(spark):
        intake.start_intake(found, tables, root, checkpoint, prepare=ol.outline).awaitTermination()
    # a file lies in a folder named for the path of its program
    program = F.url_decode(F.regexp_extract("path", r"/program=([^/]*)/", 1))
    statements = intake.intake_table(spark, root, "statements").withColumn("path", program)
    return su.verb_counts(statements)


def streaming_changes(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type")
    log = keyed_queries.change_log(_stream(spark, events, "event-stream"))
    root, checkpoint = scratch_path(spark, "changes"), scratch_path(spark, "changes-checkpoint")
    changes.start_changes(log, root, "c_custkey", checkpoint).awaitTermination()
    customer = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment")
    return changes.current(spark, customer, root, "c_custkey").select(*map(F.col, customer.columns))


def intake_versions(spark, d):
    """Four rounds over the estate: all files; some changed and some gone; the same
    once more; half of those that had gone back again."""
    number = F.regexp_extract("path", r"P(\d+)", 1).cast("bigint")
    programs = estate(spark, d).select("path", "text", number.alias("no"))
    edited = F.replace("text", F.lit("AUTHOR. TEAM-"), F.lit("AUTHOR. GROUP-"))
    later = programs.withColumn("text", F.when(number % 5 == 0, edited).otherwise(F.col("text")))
    gone = later.where("no % 7 <> 0")
    store = scratch_path(spark, "estate-versions")
    for state in (programs, gone, gone, later.where("no % 7 <> 0 OR no % 2 = 1")):
        # the time of a file stands for its content
        listed = state.select("path", F.timestamp_seconds(F.crc32(F.col("text").cast("binary"))).alias("time"), F.length("text").cast("bigint").alias("length"))
        contents = lambda wanted, state=state: state.select("path", "text").join(wanted.select("path"), "path", "left_semi")
        versions.take_in(spark, store, (listed, contents), {"headers": ol.program_header}, prepare=ol.outline)
    return versions.current_rows(spark, store, "headers")


QUERIES = {"s1_intake_statements": intake_statements, "s1_intake_versions": intake_versions, "s2_streaming_changes": streaming_changes}
ORACLES = {
    "s1_intake_statements": estate_oracles.ORACLES["e37_verb_counts"],
    "s1_intake_versions": f"""SELECT path, program_id, class_id,
CASE WHEN no % 5 = 0 THEN replace(author, 'TEAM-', 'GROUP-') ELSE author END AS author, date_written, is_class
FROM (SELECT *, CAST(regexp_extract(path, 'P(\\d+)', 1) AS BIGINT) AS no FROM ({estate_oracles.ORACLES["e14_program_header"]}))
WHERE no % 7 <> 0 OR no % 2 = 1""",
    "s2_streaming_changes": keyed_queries.ORACLES["k5_apply_changes"],
}
