"""Character records whose layout depends on their data.

A table that OCCURS ... DEPENDING ON a counter takes as many places as the counter
says, so what follows it starts where the table ends. Tables may be groups, and
groups may hold tables of their own counters. Up to the first such table every
place is a number; from there a position is carried along the record: a column
at the outer level, a folded state within the elements of a table. Fields that
are not asked for are not cut out.

A counter counts where it is found first: in the element itself, then in what
holds it, always before its table. When read, a counter that is null or outside
its bounds makes its table null and, as their place is unknown, all fields behind
it in the element. When written, it is moved to the nearer bound, and the table
with it: missing elements are blank, others dropped.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copperbook.functions.text import let
from copperbook.sources.records import (
    Field,
    element_text,
    element_value,
    picture_length,
    write_text,
)

_TEXT = "__text"


@dataclass(frozen=True)
class Item:
    """An elementary item (``field``) or a group (``children``). ``most`` above 0
    makes it a table; ``depending`` names the counter of one that holds ``least``
    to ``most`` elements, else it holds ``most``."""

    name: str
    field: Field | None = None
    children: tuple["Item", ...] = ()
    most: int = 0
    least: int = 0
    depending: str = ""

    @property
    def element_size(self) -> int | None:
        """Characters of one element; null where that depends on the data."""
        if self.field:
            return self.field.length
        sizes = [c.size for c in self.children]
        return None if None in sizes else sum(sizes)

    @property
    def size(self) -> int | None:
        each = self.element_size
        return None if self.depending or each is None else each * max(1, self.most)

    @property
    def element_type(self) -> str:
        if self.field:
            return self.field.dtype
        return "struct<" + ",".join(f"`{c.name}`:{c.dtype}" for c in self.children) + ">"

    @property
    def dtype(self) -> str:
        return f"array<{self.element_type}>" if self.most else self.element_type


def item(name: str, length: int, dtype: str = "string", signed: bool = False, most: int = 0, least: int = 0, depending: str = "") -> Item:
    return Item(name, Field(name, 1, length, dtype, signed), (), most, least, depending)


def group(name: str, *children: Item, most: int = 0, least: int = 0, depending: str = "") -> Item:
    return Item(name, None, children, most, least, depending)


def varying_layout(items: list[dict]) -> tuple[Item, ...]:
    """Layout of one record from its items below the 01 level, in order, each with
    level, name, picture and spark_type, and where it has them usage, occurs,
    occurs_least and occurs_depending. 88 levels are passed over."""
    rows = [i for i in items if i["level"] != 88]

    def name_of(text: str) -> str:
        return text.lower().replace("-", "_")

    def build(at: int, level: int) -> tuple[tuple[Item, ...], int]:
        out: list[Item] = []
        while at < len(rows) and rows[at]["level"] >= level:
            row = rows[at]
            if row.get("redefines"):
                raise ValueError(f"{row['name']} redefines another item, which has no place of its own here")
            depending = name_of(row.get("occurs_depending") or "")
            table = (row.get("occurs") or 0, row.get("occurs_least") or 0, depending)
            if row["picture"]:
                if (row.get("usage") or "").upper() not in ("", "DISPLAY"):
                    raise ValueError(f"{row['name']} has usage {row['usage']}, which is not characters")
                picture, at = row["picture"].upper(), at + 1
                field = Field(name_of(row["name"]), 1, picture_length(picture), row["spark_type"], picture.startswith("S"), "." in picture)
                out.append(Item(field.name, field, (), *table))
            else:
                children, at = build(at + 1, row["level"] + 1)
                out.append(Item(name_of(row["name"]), None, children, *table))
        return tuple(out), at

    return build(0, 0)[0]


def _count(of: Item, scope: dict[str, Column]) -> Column:
    """Elements of a table; null for a counter out of its bounds."""
    if not of.depending:
        return F.lit(of.most)
    if of.depending not in scope:
        raise ValueError(f"the counter {of.depending} of {of.name} is not before it")
    counter = scope[of.depending]
    return F.when(counter.between(of.least, of.most), counter.cast("int"))


def _upto(count: Column) -> Column:
    """0, 1, ... below the count; null for null. The count is used several times."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).when(count == 0, F.array().cast("array<int>"))


def _is_counter(of: Item, before: tuple[Item, ...]) -> bool:
    return of.field is not None and of.name in _bounds(before)


def _behind(of: Item, text: Column, at: Column, scope: dict[str, Column]) -> Column:
    """The position behind an item. Only counters are cut out for it."""
    if of.size is not None:
        return at + of.size
    if not of.most:
        return _behind_element(of, text, at, scope)
    count, each = _count(of, scope), of.element_size
    if each is not None:
        return at + count * each
    # nullable from the start, as the position is lost behind a bad counter
    begin = F.when(text.isNotNull(), at)
    return F.aggregate(let(count, _upto), begin, lambda p, _: _behind_element(of, text, p, scope))


def _behind_element(of: Item, text: Column, at: Column, scope: dict[str, Column]) -> Column:
    def walk(left: tuple[Item, ...], at: Column, scope: dict[str, Column]) -> Column:
        if not left:
            return at
        child, rest = left[0], left[1:]
        if _is_counter(child, rest):
            return let(_value(child, text, at, scope), lambda v: walk(rest, at + child.size, scope | {child.name: v}))
        if child.size is not None:
            return walk(rest, at + child.size, scope)
        # its value is no counter of what follows, so it need not be cut out
        return let(_behind(child, text, at, scope), lambda p: walk(rest, p, scope)) if _bounds(rest) else walk(
            rest, _behind(child, text, at, scope), scope
        )

    return at + of.field.length if of.field else walk(of.children, at, scope)


def _most_characters(of: Item) -> int:
    """Characters of one element at most."""
    if of.field:
        return of.field.length
    return sum(_most_characters(c) * max(1, c.most) for c in of.children)


def _element(of: Item, text: Column, at: Column, scope: dict[str, Column]) -> Column:
    """The value of one element at a position."""
    if of.field:
        return element_value(of.field, F.substr(text, at, F.lit(of.field.length)))

    def children(left: tuple[Item, ...], at: Column, scope: dict[str, Column], done: list[Column]) -> Column:
        if not left:
            return F.struct(*done)
        child, rest = left[0], left[1:]

        def go_on(value: Column) -> Column:
            inner, out = scope | {child.name: value}, [*done, value.alias(child.name)]
            if child.size is not None or not rest:
                return children(rest, at if child.size is None else at + child.size, inner, out)
            # bound once: the places of all that follow need it
            return let(_behind(child, text, at, scope), lambda p: children(rest, p, inner, out))

        value = _value(child, text, at, scope)
        # a counter is cut out once, however many places its table has
        return let(value, go_on) if _is_counter(child, rest) else go_on(value)

    return children(of.children, at, scope, [])


def _value(of: Item, text: Column, at: Column, scope: dict[str, Column]) -> Column:
    """The value of an item at a position."""
    if not of.most:
        return _element(of, text, at, scope)
    count, each = _count(of, scope), of.element_size
    if each is not None:
        places = let(count, _upto) if of.depending else _upto(count)
        return F.transform(places, lambda i: _element(of, text, at + i * each, scope))
    return _elements(of, text, _starts(of, text, at, scope).starts, scope)


def _starts(of: Item, text: Column, at: Column, scope: dict[str, Column]) -> Column:
    """struct(starts, after) of a table whose elements differ in size."""
    none = F.array().cast("array<int>")
    begin = F.when(text.isNotNull(), at)

    def step(s: Column, _: Column) -> Column:
        after = _behind_element(of, text, s.after, scope)
        return F.struct(F.array_append(s.starts, s.after).alias("starts"), after.alias("after"))

    return F.aggregate(let(_count(of, scope), _upto), F.struct(none.alias("starts"), begin.alias("after")), step)


def _elements(of: Item, text: Column, starts: Column, scope: dict[str, Column]) -> Column:
    # each element is taken out of the record first: a place in a long text is counted
    # from its start, so cutting every field there costs the square of its length
    pieces = F.transform(starts, lambda p: F.substr(text, p, F.lit(_most_characters(of))))
    return F.transform(pieces, lambda x: _element(of, x, F.lit(1), scope))


def read_text(lines: DataFrame, layout: tuple[Item, ...], column: str = "value") -> DataFrame:
    """The fields of records held in a text column."""
    df, base, offset, scope = lines.select(F.col(column).alias(_TEXT)), F.lit(1), 0, {}
    for n, of in enumerate(layout):
        at, text = base + offset, F.col(_TEXT)
        if of.size is not None:
            df = df.withColumn(of.name, _value(of, text, at, scope))
            offset += of.size
        else:
            behind = f"__behind{n}"
            if of.most and of.element_size is None:
                df = df.withColumn(f"__starts{n}", _starts(of, text, at, scope))
                df = df.withColumn(behind, F.col(f"__starts{n}.after"))
                df = df.withColumn(of.name, _elements(of, text, F.col(f"__starts{n}.starts"), scope))
            else:
                df = df.withColumn(behind, _behind(of, text, at, scope)).withColumn(of.name, _value(of, text, at, scope))
            base, offset = F.col(behind), 0
        scope[of.name] = F.col(of.name)
    return df.select(*[of.name for of in layout])


def read_varying(spark: SparkSession, path: str, layout: tuple[Item, ...]) -> DataFrame:
    """One row per line."""
    return read_text(spark.read.text(path), layout)


def _bounds(layout: tuple[Item, ...]) -> dict[str, tuple[int, int]]:
    """Counters named within these items, with the bounds of their tables."""
    out: dict[str, tuple[int, int]] = {}
    for of in layout:
        out |= _bounds(of.children)
        if of.depending:
            low, high = out.get(of.depending, (of.least, of.most))
            out[of.depending] = (max(low, of.least), min(high, of.most))
    return out


def _text_of(layout: tuple[Item, ...], get, scope: dict[str, Column]) -> list[Column]:
    bounds, scope, out = _bounds(layout), dict(scope), []
    for of in layout:
        value = get(of.name)
        if of.field and of.name in bounds:
            low, high = bounds[of.name]
            value = F.least(F.greatest(F.coalesce(value, F.lit(low)), F.lit(low)), F.lit(high)).cast(of.field.dtype)
        scope[of.name] = value

        def one(v: Column, of: Item = of, scope: dict[str, Column] = scope) -> Column:
            if of.field:
                return element_text(of.field, v)
            return F.concat(*_text_of(of.children, lambda name: v.getField(name), scope))

        if not of.most:
            out.append(one(value))
            continue
        count = F.least(F.greatest(scope[of.depending], F.lit(of.least)), F.lit(of.most)) if of.depending else F.lit(of.most)
        places = let(count.cast("int"), _upto)
        out.append(F.array_join(F.transform(places, lambda i: one(F.get(value, i))), ""))
    return out


def varying_text(df: DataFrame, layout: tuple[Item, ...]) -> DataFrame:
    """value: the records as characters."""
    return df.select(F.concat(*_text_of(layout, F.col, {})).alias("value"))


def write_varying(df: DataFrame, path: str, layout: tuple[Item, ...], mode: str = "OUTPUT") -> None:
    """OUTPUT replaces what is there; EXTEND and I-O add to it."""
    write_text(varying_text(df, layout), path, mode)
