"""What changed between two states of an estate, item by item and field by field.

Files with equal texts are told by 128 bits of their texts and go no further:
their texts are neither shuffled nor parsed. The items of the other files are
brought together by file once; all steps after that stay within a file.

Two items of a file match when they have the same name and the same declaration,
the n-th of these with the n-th; of what is left, the n-th of a name matches the
n-th. So taking one FILLER out does not make all others differ. Matched items keep
their order if they belong to a longest sequence whose places rise on both sides;
the others have moved.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copperbook.functions.fields import leading
from copperbook.functions.folds import running
from copperbook.operators import items as it
from copperbook.operators import outline as ol
from copperbook.session import scratch_path

#: What a declaration says of an item.
ITEM_FIELDS = ("section", "level", "picture", "usage", "value", "occurs", "occurs_depending", "redefines")


def changed_sources(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of both sources whose path has another text, or none, in the other."""

    def marks(sources: DataFrame, name: str) -> DataFrame:
        return sources.select("path", F.md5(F.col("text").cast("binary")).alias(name))

    both = marks(a, "__a").join(marks(b, "__b"), "path", "full")
    # written, so that the planner knows their size: while they are few they go to
    # every task and no text is shuffled
    kept = scratch_path(a.sparkSession, "changed-paths")
    both.where(~F.col("__a").eqNullSafe(F.col("__b"))).select("path").write.parquet(kept)
    paths = a.sparkSession.read.schema(a.select("path").schema).parquet(kept)
    return a.join(paths, "path", "left_semi"), b.join(paths, "path", "left_semi")


def _kept_order(places: Column) -> Column:
    """Of an array of distinct numbers: for each, whether it belongs to one longest
    rising subsequence, found from the lengths of those that end at each number."""

    def longer(tails: Column, x: Column) -> Column:
        at = leading(tails, lambda t: t < x)
        put = F.concat(F.slice(tails, F.lit(1), at), F.array(x), F.slice(tails, at + 2, F.size(tails)))
        return F.struct(put.alias("state"), (at + 1).alias("out"))

    lengths = running(places, F.array().cast("array<int>"), longer, "int")

    def take(s: Column, x: Column) -> Column:
        taken = (x.length == s.want) & (x.place < s.below)
        after = F.struct(
            F.when(taken, s.want - 1).otherwise(s.want).alias("want"), F.when(taken, x.place).otherwise(s.below).alias("below")
        )
        return F.struct(after.alias("state"), taken.alias("out"))

    pairs = F.arrays_zip(places.alias("place"), lengths.alias("length"))
    begin = F.struct(F.array_max(lengths).alias("want"), (F.array_max(places) + 1).alias("below"))
    return F.reverse(running(F.reverse(pairs), begin, take, "boolean"))


def diff_rows(a: DataFrame, b: DataFrame, name: str, place: str, fields: tuple[str, ...]) -> DataFrame:
    """path, change, name, place_a, place_b, field, value_a, value_b from the rows
    of files on both sides, numbered by ``place``.

    ``change`` is added, removed, moved or changed; a row that changed has a row
    here for each field that differs, with both values as text.
    """
    columns = [F.col(name).alias("name"), F.col(place).cast("int").alias("place"), F.struct(*fields).alias("said")]
    sides = [side.select("path", *columns, F.lit(n == 0).alias("is_a")) for n, side in enumerate((a, b))]
    rows = sides[0].unionByName(sides[1]).repartition("path")

    def paired(df: DataFrame, *keys: str) -> DataFrame:
        """Rows with the place of their match, or null: the n-th of a key on either side."""
        nth = F.row_number().over(Window.partitionBy("path", "is_a", *keys).orderBy("place"))
        pair = Window.partitionBy("path", *keys, "nth")
        other = F.when(F.count("*").over(pair) == 2, F.sum("place").over(pair).cast("int") - F.col("place"))
        return df.withColumn("nth", nth).withColumn("other", other).drop("nth")

    exact = paired(rows.withColumn("text", F.to_json("said")), "name", "text").withColumnRenamed("other", "equal")
    # once more among what has no equal
    open_ = exact.drop("text").withColumn("is_open", F.col("equal").isNull())
    met = paired(open_, "is_open", "name").withColumn(
        "other", F.when(F.col("is_open"), F.col("other")).otherwise(F.col("equal"))
    )

    matched = F.when(F.col("is_a") & F.col("other").isNotNull(), F.struct("place", "other"))
    order = F.sort_array(F.collect_list(matched))
    files = met.groupBy("path").agg(
        order.alias("pairs"),
        F.collect_list(F.struct("is_a", "name", "place", "other", "said")).alias("rows"),
    )
    files = files.withColumn("kept", _kept_order(F.transform("pairs", lambda p: p.other)))
    moved = F.filter(F.arrays_zip("pairs", "kept"), lambda z: ~z.kept)
    files = files.select("path", "rows", F.transform(moved, lambda z: z.pairs.place).alias("moved"))
    told = files.select("path", F.explode("rows").alias("r"), "moved").select("path", "r.*", "moved")
    # written once, since each kind of change reads it
    kept = scratch_path(a.sparkSession, "matched-rows")
    told.write.parquet(kept)
    each = a.sparkSession.read.schema(told.schema).parquet(kept)
    # the matching row of b, by its place; sorted on both sides, since the size of the
    # files says little of what a broadcast of them would hold
    left = each.where("is_a")
    right = each.where("NOT is_a").select("path", F.col("place").alias("other"), F.col("said").alias("said_b"))
    together = left.join(right.hint("merge"), ["path", "other"], "left")

    def text(said: str, field: str) -> Column:
        return F.col(f"{said}.{field}").cast("string")

    def found(change: str, df: DataFrame, place_a, place_b, field, value_a, value_b) -> DataFrame:
        parts = {"place_a": place_a, "place_b": place_b, "field": field, "value_a": value_a, "value_b": value_b}
        return df.select("path", F.lit(change).alias("change"), "name", *[v.alias(k) for k, v in parts.items()])

    no_place, nothing = F.lit(None).cast("int"), F.lit(None).cast("string")
    differing = F.array_compact(
        F.array(
            *[
                F.when(
                    ~text("said", f).eqNullSafe(text("said_b", f)),
                    F.struct(F.lit(f).alias("field"), text("said", f).alias("a"), text("said_b", f).alias("b")),
                )
                for f in fields
            ]
        )
    )
    changed = together.where("other IS NOT NULL").withColumn("d", F.explode(differing))
    out = found("changed", changed, F.col("place"), F.col("other"), F.col("d.field"), F.col("d.a"), F.col("d.b"))
    shifted = together.where(F.array_contains("moved", F.col("place")))
    out = out.unionByName(found("moved", shifted, F.col("place"), F.col("other"), nothing, nothing, nothing))
    gone = left.where("other IS NULL")
    out = out.unionByName(found("removed", gone, F.col("place"), no_place, nothing, nothing, nothing))
    new = each.where("NOT is_a AND other IS NULL")
    return out.unionByName(found("added", new, no_place, F.col("place"), nothing, nothing, nothing))


def diff_items(a: DataFrame, b: DataFrame) -> DataFrame:
    """``diff_rows`` of the data items of two sources(path, text)."""
    was, now = (it.data_items(ol.outline(side), hierarchy=False) for side in changed_sources(a, b))
    return diff_rows(was, now, "name", "item_no", ITEM_FIELDS)
