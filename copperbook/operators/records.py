"""Verbs over the records of a DataFrame.

A record is a row and a field is a column; every verb is a projection. Column
types are the pictures: results are stored in the type of the receiving field.
"""

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copperbook.functions.arithmetic import expression, quotient, store
from copperbook.functions.conditions import first_value
from copperbook.operators import ordered
from copperbook.session import scratch_path
from copperbook.vocabulary import FIGURATIVE

# What a figurative constant stores, in text and in numbers.
_FIGURATIVE_TEXT = {"SPACES": "", "ZEROS": "0", "HIGH-VALUES": "ÿ", "LOW-VALUES": "\u0000", "NULLS": None}
_FIGURATIVE_NUMBER = {"SPACES": 0, "ZEROS": 0, "HIGH-VALUES": 0xFF, "LOW-VALUES": 0x00, "NULLS": None}


def _dtype(df: DataFrame, name: str, dtype=None) -> T.DataType:
    if dtype is None:
        return df.schema[name].dataType
    return T.DataType.fromDDL(dtype) if isinstance(dtype, str) else dtype


def _store(df: DataFrame, value: Column, dtype: T.DataType) -> Column:
    return store(value, dtype, df.select(value).schema[0].dataType)


def _col(v) -> Column:
    if isinstance(v, Column):
        return v
    return F.col(v) if isinstance(v, str) else F.lit(Decimal(str(v)) if isinstance(v, float) else v)


def figurative(word: str, dtype: T.DataType) -> Column:
    """A figurative constant as a value of ``dtype``."""
    spelling = FIGURATIVE[word.upper()]
    values = _FIGURATIVE_TEXT if isinstance(dtype, T.StringType) else _FIGURATIVE_NUMBER
    return F.lit(values[spelling]).try_cast(dtype)


def move(df: DataFrame, source, *targets: str) -> DataFrame:
    """MOVE source TO targets. ``source`` is a Column, a literal, or the name of
    a figurative constant."""
    out = {}
    for target in targets:
        dtype = _dtype(df, target)
        if isinstance(source, str) and source.upper() in FIGURATIVE:
            out[target] = figurative(source, dtype)
        else:
            out[target] = _store(df, source if isinstance(source, Column) else F.lit(source), dtype)
    return df.withColumns(out)


def add(df: DataFrame, amount, to: str, giving: str | None = None, dtype=None) -> DataFrame:
    """ADD amount TO to [GIVING giving]."""
    target = giving or to
    return df.withColumn(target, _store(df, F.try_add(_col(to), _col(amount)), _dtype(df, target, dtype)))


def subtract(df: DataFrame, amount, from_: str, giving: str | None = None, dtype=None) -> DataFrame:
    """SUBTRACT amount FROM from_ [GIVING giving]."""
    target = giving or from_
    return df.withColumn(target, _store(df, F.try_subtract(_col(from_), _col(amount)), _dtype(df, target, dtype)))


def multiply(df: DataFrame, factor, by: str, giving: str | None = None, dtype=None) -> DataFrame:
    """MULTIPLY factor BY by [GIVING giving]."""
    target = giving or by
    return df.withColumn(target, _store(df, F.try_multiply(_col(factor), _col(by)), _dtype(df, target, dtype)))


def divide(
    df: DataFrame, dividend, divisor, giving: str, dtype=None, remainder: str | None = None
) -> DataFrame:
    """DIVIDE dividend BY divisor GIVING giving [REMAINDER remainder].

    The remainder is what the truncated quotient leaves.
    """
    target = _dtype(df, giving, dtype)
    a, b = _col(dividend), _col(divisor)
    types = [f.dataType for f in df.select(a.alias("a"), b.alias("b")).schema]
    whole = quotient(a, b, target, types)
    out = {giving: whole}
    if remainder:
        out[remainder] = F.try_subtract(a, F.try_multiply(whole, b))
    return df.withColumns(out)


def divide_into(df: DataFrame, divisor, into: str, giving: str | None = None, dtype=None,
                remainder: str | None = None) -> DataFrame:
    """DIVIDE divisor INTO into [GIVING giving] [REMAINDER remainder]: into / divisor."""
    return divide(df, into, divisor, giving or into, dtype, remainder)


def compute(df: DataFrame, target: str, text: str, dtype=None) -> DataFrame:
    """COMPUTE target = text."""
    return df.withColumn(target, _store(df, expression(text), _dtype(df, target, dtype)))


def evaluate_lookup(
    df: DataFrame, subject: str, table: dict, result: str, other=None
) -> DataFrame:
    """EVALUATE subject with many values: a join with the table of values, which
    the planner sends to every task or shuffles by its measured size."""
    values = df.sparkSession.createDataFrame(list(table.items()), ["__when", "__then"]).withColumn(
        "__when", F.col("__when").cast(df.schema[subject].dataType)
    )
    joined = df.join(values, F.col(subject) == F.col("__when"), "left")
    found = F.when(F.col("__when").isNotNull(), F.col("__then")).otherwise(F.lit(other))
    return joined.withColumn(result, found).drop("__when", "__then")


def set_true(df: DataFrame, parent: str, values: list) -> DataFrame:
    """SET condition TO TRUE: the parent takes the first value of the condition."""
    return df.withColumn(parent, F.lit(first_value(values)).cast(_dtype(df, parent)))


def set_up(df: DataFrame, name: str, by) -> DataFrame:
    return df.withColumn(name, _store(df, F.try_add(F.col(name), _col(by)), _dtype(df, name)))


def set_down(df: DataFrame, name: str, by) -> DataFrame:
    return df.withColumn(name, _store(df, F.try_subtract(F.col(name), _col(by)), _dtype(df, name)))


def set_to(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, _store(df, value if isinstance(value, Column) else F.lit(value), _dtype(df, name)))


def initial_value(dtype: T.DataType) -> Column:
    """Default of a type: empty text, zero, false, an empty table."""
    if isinstance(dtype, T.StringType):
        return F.lit("")
    if isinstance(dtype, T.BooleanType):
        return F.lit(False)
    if isinstance(dtype, T.ArrayType):
        return F.array().cast(dtype)
    if isinstance(dtype, T.StructType):
        return F.struct(*[initial_value(f.dataType).alias(f.name) for f in dtype.fields])
    if isinstance(dtype, T.NumericType):
        return F.lit(0).cast(dtype)
    return F.lit(None).cast(dtype)


def initialize(df: DataFrame, *fields: str) -> DataFrame:
    """INITIALIZE: the only verb that writes defaults; elsewhere nulls stay null."""
    return df.withColumns({name: initial_value(_dtype(df, name)) for name in fields})


def occurs_pack(df: DataFrame, table: str, *columns: str) -> DataFrame:
    """Columns of one type become a table (array) field."""
    return df.withColumn(table, F.array(*columns)).drop(*columns)


def occurs_explode(df: DataFrame, table: str, index: str = "subscript", counter: str | None = None) -> DataFrame:
    """One row per element, with its subscript from 1; ``counter`` is the
    DEPENDING ON field."""
    items = F.col(table) if counter is None else F.slice(F.col(table), F.lit(1), F.col(counter).cast("int"))
    others = [c for c in df.columns if c != table]
    # the outer form: for the inner one the planner adds a filter on the size of the
    # table, which makes a table that is computed from the record twice
    placed = df.select(*others, F.posexplode_outer(items).alias("__at", table)).where(F.col("__at").isNotNull())
    return placed.select(*others, (F.col("__at") + 1).alias(index), table)


def redefines_view(df: DataFrame, record: str, field: str, views: list[tuple[Column, int, int, str]], other=None) -> DataFrame:
    """A second reading of the same characters.

    Each view is (condition, start, length, type): the first condition that
    holds says where ``field`` lies in ``record`` and what type it has. Views of
    different types are stored as text.
    """
    same = len({v[3] for v in views}) == 1
    out = F.when(F.lit(False), F.lit(None))
    for test, start, length, dtype in views:
        value = F.trim(F.substring(record, start, length)).try_cast(dtype)
        out = out.when(test, value if same else value.cast("string"))
    return df.withColumn(field, out.otherwise(F.lit(other)))


def sort_records(df: DataFrame, *keys) -> DataFrame:
    """SORT: a range partition per task, no single sorter."""
    return df.orderBy(*keys)


def merge_records(dfs: list[DataFrame], *keys) -> DataFrame:
    """MERGE: the records of several files in one order."""
    merged = dfs[0]
    for other in dfs[1:]:
        merged = merged.unionByName(other)
    return merged.orderBy(*keys)


#: Bits of a level of the nodes that cover a range of codes.
_BITS = 2


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _codes(values: DataFrame, ends: DataFrame) -> tuple[DataFrame, int]:
    """v, code: places of values and of ends among the sorted ends, 2i + 1 at the i-th
    and 2i just below it; and the greatest code there is."""
    marked = ends.select("v", F.lit(1).cast("bigint").alias("end")).unionAll(values.select("v", F.lit(0).cast("bigint")))
    once = marked.where("v IS NOT NULL").groupBy("v").agg(F.max("end").alias("end"))
    upto = ordered.running_total(once, ["v"], "upto", F.col("end"))
    codes = _stored(upto.select("v", (2 * F.col("upto") - F.col("end")).alias("code"), "upto"), "codes")
    return codes.select("v", "code"), 2 * (codes.agg(F.max("upto")).first()[0] or 0)


def _levels(top: int) -> Column:
    return F.sequence(F.lit(0), F.lit(-(-(top + 2).bit_length() // _BITS)))


def _node(index: Column, level: Column) -> Column:
    return index * 64 + level


def _nodes_of_range(low: Column, high: Column, top: int) -> Column:
    """The fewest nodes that cover the codes from ``low`` to ``high``; a node of a level
    covers four of the level below it."""
    # codes begin with -1
    first, behind = low + 1, high + 2

    def cut(level):
        # the nodes of the level that lie within: from begin up to, not with, end
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), level * _BITS)
        return F.call_function("div", first + size - 1, size), F.call_function("div", behind, size)

    def run(begin, end):
        return F.when(begin < end, F.sequence(begin, end - 1)).otherwise(F.array().cast("array<bigint>"))

    def nodes(level):
        begin, end = cut(level)
        above, until = cut(level + 1)
        wide = 1 << _BITS
        own = F.when(above < until, F.concat(run(begin, above * wide), run(until * wide, end))).otherwise(run(begin, end))
        return F.transform(own, lambda index: _node(index, level))

    return F.flatten(F.transform(_levels(top), nodes))


def _nodes_of_code(code: Column, top: int) -> Column:
    """The nodes of all levels that cover a code."""
    return F.transform(_levels(top), lambda level: _node(F.call_function("shiftright", code + 1, level * _BITS), level))


def evaluate_ranges(df: DataFrame, subjects: list[str], whens: DataFrame, result: str, other=None) -> DataFrame:
    """EVALUATE s1 ALSO s2 ...: WHEN low THRU high ALSO low THRU high ...

    ``whens`` has a row for each WHEN: place, low_1, high_1, low_2, high_2, ..., then.
    The first in the order of ``place`` wins that holds for all subjects. A null low
    or high leaves that side open; both null are ANY, which alone holds for a null.

    The ends of a subject's ranges cut its values into points and gaps, numbered in
    order by one sort. A range of these numbers is covered by a few nodes of a tree for
    each of its levels, a number lies in one node of each level. So the WHENs become
    rows by their nodes, of which the first in place stays, and the points and gaps that
    values fall into find the winner among their nodes by equality. Work grows with
    rows and WHENs times levels (of all subjects multiplied), however wide ranges are.

    ``df`` is evaluated twice, for its values and for the result; the steps between are
    stored.
    """
    kinds = [df.schema[s].dataType for s in subjects]
    places = range(1, len(subjects) + 1)
    bounds = [(F.col(f"low_{i}").cast(k), F.col(f"high_{i}").cast(k)) for i, k in zip(places, kinds)]
    named = [c for i, (low, high) in zip(places, bounds) for c in (low.alias(f"low_{i}"), high.alias(f"high_{i}"))]
    sides = [f"{side}_{i}" for i in places for side in ("low", "high")]
    if len(subjects) > 1:
        key, then = F.struct("place", *sides[2:], "then"), F.col("then")
    else:
        # a WHEN without place comes last, and gives nothing
        key, then = F.struct(F.col("place").isNull().alias("no_place"), "place"), F.when(F.col("place").isNotNull(), F.col("then"))
    first = F.min_by("__when", "__when.key").alias("__when")
    table = whens.select("place", *named, "then").select(*sides, F.struct(key.alias("key"), then.alias("then")).alias("__when"))
    table = _stored(table.groupBy(*sides).agg(first), "whens")

    values = [f"__s{i}" for i in places]
    held = _stored(df.select(*[F.col(f"`{s}`").alias(v) for s, v in zip(subjects, values)]).distinct(), "subjects")
    tops = []
    for i, v in zip(places, values):
        ends = table.select(F.col(f"low_{i}").alias("v")).unionAll(table.select(f"high_{i}"))
        codes, top = _codes(held.select(F.col(v).alias("v")), ends)
        tops.append(top)

        def coded(rows: DataFrame, value: str, name: str) -> DataFrame:
            return rows.join(codes.select(F.col("v").alias("__v"), F.col("code").alias(name)), F.col(value) == F.col("__v"), "left").drop("__v")

        held = coded(held, v, f"__c{i}").withColumn(f"__c{i}", F.coalesce(f"__c{i}", F.lit(-1).cast("bigint")))
        table = coded(coded(table, f"low_{i}", "__from"), f"high_{i}", "__to")
        open_low = F.when(F.col(f"high_{i}").isNull(), -1).otherwise(0).cast("bigint")
        table = table.withColumns({f"__from{i}": F.coalesce("__from", open_low), f"__to{i}": F.coalesce("__to", F.lit(top).cast("bigint"))})
        table = table.where(F.col(f"__from{i}") <= F.col(f"__to{i}")).drop("__from", "__to")

    numbers, nodes = [f"__c{i}" for i in places], [f"__n{i}" for i in places]
    winners = table.select("__when", *[_nodes_of_range(F.col(f"__from{i}"), F.col(f"__to{i}"), top).alias(f"__n{i}") for i, top in zip(places, tops)])
    held = _stored(held, "coded")
    cells = held.select(*numbers).distinct()
    found = cells.select(*numbers, *[_nodes_of_code(F.col(f"__c{i}"), top).alias(f"__n{i}") for i, top in zip(places, tops)])
    for n in nodes:
        winners, found = winners.withColumn(n, F.explode(n)), found.withColumn(n, F.explode(n))
    winners = winners.groupBy(*nodes).agg(first)
    found = found.join(winners, nodes).groupBy(*numbers).agg(first)
    won = _stored(held.join(found, numbers).select(*values, F.struct(F.col("__when.then").alias("then")).alias("__when")), "won")

    match = F.lit(True)
    for s, v in zip(subjects, values):
        match = match & F.col(f"`{s}`").eqNullSafe(F.col(v))
    # sorted on both sides: the winners of many values are no small table
    joined = df.join(won.hint("merge"), match, "left")
    value = F.when(F.col("__when").isNotNull(), F.col("__when.then")).otherwise(F.lit(other))
    return joined.withColumn(result, value).drop("__when", *values)
