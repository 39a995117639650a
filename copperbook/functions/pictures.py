"""Declared type of a data item -> Spark type."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copperbook.vocabulary import USAGE_TYPES


def digit_count(picture: Column) -> Column:
    """Number of digit positions: ``9(5)99`` has seven; null beyond any count."""
    runs = F.regexp_extract_all(picture, F.lit(r"[9Z0](?:\(\d+\))?"), F.lit(0))

    def size(run):
        repeat = F.regexp_extract(run, r"\((\d+)\)", 1)
        return F.when(repeat == "", F.lit(1)).otherwise(repeat.try_cast("int"))

    return F.aggregate(F.transform(runs, size), F.lit(0), lambda a, x: F.try_add(a, x))


def with_spark_type(items: DataFrame) -> DataFrame:
    """Add spark_type, precision and scale.

    ``items`` has picture, usage, is_group and is_88. Precision and scale are
    null unless the picture is numeric.
    """
    pic = F.replace(F.upper("picture"), F.lit(" "), F.lit(""))
    kept = items.columns
    measured = (
        items.withColumn("digits", F.regexp_replace(pic, r"^[S+-]+", ""))
        .withColumn(
            "is_numeric",
            ~F.col("is_88") & ~F.col("is_group")
            & F.col("digits").rlike(r"^(?:[9Z0](?:\(\d+\))?|[V.])+$") & F.col("digits").rlike("[9Z0]"),
        )
        .withColumn("precision", F.when(F.col("is_numeric"), digit_count(F.col("digits"))))
        .withColumn(
            "scale",
            F.when(
                F.col("is_numeric"),
                F.when(F.col("digits").rlike("[V.]"), digit_count(F.regexp_extract("digits", r"[V.](.*)$", 1)))
                .otherwise(F.lit(0)),
            ),
        )
    )
    bare = F.when(F.lit(False), F.lit(""))
    use = F.upper("usage")
    for name, words in USAGE_TYPES.items():
        bare = bare.when(use.isin(words), F.lit(name))
    bare = bare.when(use.contains("COMP") | use.contains("BINARY"), F.lit("int")).otherwise(F.lit("string"))
    packed = F.col("usage").contains("COMP-3") | F.col("usage").contains("PACKED")
    pointed = F.col("digits").rlike("[V.]")
    precision = F.col("precision")
    name = (
        F.when(F.col("is_88"), F.lit("boolean"))
        .when(F.col("is_group"), F.lit("struct"))
        .when(F.col("picture") == "", bare)
        .when(~F.col("is_numeric") | precision.isNull() | (precision > 38), F.lit("string"))
        .when(
            pointed | packed | (precision > 18),
            F.concat(F.lit("decimal("), precision, F.lit(","), F.col("scale"), F.lit(")")),
        )
        .when(precision <= 9, F.lit("int"))
        .otherwise(F.lit("bigint"))
    )
    return measured.select(*kept, name.alias("spark_type"), "precision", "scale")
