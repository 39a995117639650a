"""Quality rules: cross-document line frequency by host.

Lines are normalised (ASCII letters lowered, digits to 0, runs of white space
to one blank) and hashed. A line that occurs in more than ``limit`` distinct
documents of a host, and in more than ``limit_share`` percent of them, is
boilerplate there and is removed; so an ordinary line does not become boilerplate
as its host grows. A document is rejected when it keeps less than ``min_share``
percent of its words. Documents of a host with equal texts count once: whole copies are
a matter for deduplication, and a copied document is not boilerplate.

All of it is DataFrame functions. Line rows are put together per document before
any shuffle, counted with partial aggregates, and the join of a line that a third
of all documents hold is split by adaptive execution.

Rows: null text has no words and fails the base rules; a null host is a host of
its own; repeated rows are each judged; texts of any length are read whole; ties
at a limit keep the line; an empty table gives an empty result. Extra columns
are ignored.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copperbook.llm.common import only, stored

LIMIT = 20
LIMIT_SHARE = 1
MIN_SHARE = 50
#: Fixed values.
_GAP = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"
_SYMBOL = "[#*$%&|<>]"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _GAP), lambda w: w != "")


def _repeat_words(ordered: Column) -> Column:
    """Words covered by windows found twice or more. ``ordered`` holds hash and
    place of each window by hash, so equal ones are neighbours."""

    def same(x, k):
        return F.coalesce(F.get(ordered, k)["h"] == x["h"], F.lit(False))

    twice = F.filter(ordered, lambda x, k: same(x, k - 1) | same(x, k + 1))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    fresh = F.aggregate(
        places,
        F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n")),
        lambda s, i: F.struct(i.alias("at"), (s["n"] + F.least(F.lit(3), i - s["at"])).alias("n")),
        lambda s: s["n"],
    )
    return F.when(ordered.isNull(), 0).otherwise(fresh)


def base_rules(docs: DataFrame) -> DataFrame:
    """From (doc_id, text, host): counts per row, the key of the text, and hash
    and word count of each line that has a word."""
    split = docs.select(
        "doc_id",
        "host",
        F.coalesce("text", F.lit("")).alias("text"),
    ).select(
        "*",
        _words(F.col("text")).alias("words"),
        F.filter(
            F.transform(F.split("text", "\n"), _words), lambda w: F.size(w) > 0
        ).alias("lines"),
    )
    place = F.sequence(F.lit(0), F.size("words") - 3)
    window = F.transform(
        place,
        lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
    )
    hashed = split.select(
        "doc_id",
        "host",
        F.xxhash64("text").alias("text_key"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", _GAP, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", _SYMBOL, ""))).cast("long").alias("n_symbols"),
        F.when(F.size("words") >= 4, window).alias("windows"),
        (F.size("lines") - F.size(F.array_distinct(_raw_lines("text")))).cast("long").alias("n_dup_lines"),
        F.transform(
            "lines",
            lambda w: F.struct(
                F.xxhash64(F.regexp_replace(F.lower(F.array_join(w, " ")), "[0-9]", "0")).alias("line"),
                F.size(w).cast("long").alias("words"),
            ),
        ).alias("lines"),
    )
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    pairs = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    ordered = hashed.select("*", F.when(repeats, F.sort_array(pairs)).alias("ordered"))
    counted = ordered.select(
        "doc_id", "host", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        _repeat_words(F.col("ordered")).cast("long").alias("n_repeat_words"),
        "lines",
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _raw_lines(text: str) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(_WORD))


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    limit: int = LIMIT,
    limit_share: int = LIMIT_SHARE,
    min_share: int = MIN_SHARE,
) -> DataFrame:
    """Per row: the base counts, n_removed_words and kept."""
    plain = only(docs, id_col, text_col, host_col).toDF("doc_id", "text", "host")
    base = stored(base_rules(plain), "quality")
    lines = (
        base.dropDuplicates(["host", "text_key"])
        .select("host", "text_key", F.explode("lines").alias("l"))
        .groupBy("host", F.col("l.line").alias("line"), "text_key")
        .agg(F.sum("l.words").alias("words"))
    )
    hosts = base.groupBy(F.col("host").alias("__of")).agg(F.countDistinct("text_key").alias("texts"))
    frequent = (
        lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > limit)
        .join(hosts, F.col("host").eqNullSafe(F.col("__of")))
        .where(100 * F.col("n") > limit_share * F.col("texts"))
        .select(F.col("host").alias("__host"), F.col("line").alias("__line"))
    )
    removed = (
        lines.join(frequent, F.col("host").eqNullSafe(F.col("__host")) & (F.col("line") == F.col("__line")))
        .groupBy(F.col("host").alias("__host"), F.col("text_key").alias("__key"))
        .agg(F.sum("words").alias("gone"))
    )
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = 100 * left < min_share * F.col("n_words")
    return (
        base.drop("lines")
        .join(removed, F.col("host").eqNullSafe(F.col("__host")) & (F.col("text_key") == F.col("__key")), "left")
        .withColumn("n_removed_words", F.coalesce("gone", F.lit(0)).cast("long"))
        .withColumn("kept", ~F.col("base_failed") & ~depleted)
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "base_failed", "n_removed_words", "kept",
        )
    )


ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM d),
pos AS (
  SELECT r, unnest(range(0, len(words) - 2)) AS i, words FROM w WHERE len(words) >= 3),
win AS (
  SELECT r, i, words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] AS g FROM pos),
again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words
  FROM again, (VALUES (0), (1), (2)) AS t(k) GROUP BY r),
raw AS (
  SELECT r, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
cut AS (
  SELECT *, list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS lw FROM raw),
lines AS (
  SELECT r, source, text, line, len(lw) AS n,
         regexp_replace(lower(array_to_string(lw, ' ')), '[0-9]', '0', 'g') AS norm
  FROM cut WHERE len(lw) > 0),
dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY r),
often AS (
  SELECT source, norm, count(DISTINCT text) AS n FROM lines
  GROUP BY source, norm HAVING count(DISTINCT text) > {LIMIT}),
hosts AS (
  SELECT source, count(DISTINCT text) AS texts FROM d GROUP BY source),
freq AS (
  SELECT o.source, o.norm FROM often o JOIN hosts h ON h.source IS NOT DISTINCT FROM o.source
  WHERE 100 * o.n > {LIMIT_SHARE} * h.texts),
gone AS (
  SELECT r, sum(n) AS gone FROM lines l
  WHERE EXISTS (SELECT 1 FROM freq f WHERE f.source IS NOT DISTINCT FROM l.source AND f.norm = l.norm)
  GROUP BY r),
base AS (
  SELECT doc_id, len(words) AS n_words,
         length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(gone, 0) AS gone
  FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       CAST(gone AS BIGINT) AS n_removed_words,
       NOT base_failed AND NOT 100 * (n_words - gone) < {MIN_SHARE} * n_words AS kept
FROM judged
"""
