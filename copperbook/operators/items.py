"""Data items, their hierarchy and what follows from it.

Items and their hierarchy come out of the text of a file without an exchange:
the parent of an item is found with a stack of open groups carried along the
items of a section. Only counts per group are shuffled, partially aggregated.
"""

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copperbook.functions import clauses as cl
from copperbook.functions import source_text as st
from copperbook.functions.folds import running
from copperbook.functions.pictures import with_spark_type
from copperbook.functions.text import built_once, drop_period, let, no_dots, pascal_case
from copperbook.vocabulary import SCREEN_ATTRIBUTES

_CONDITION = 88
_ROOTS = (1, 77)
_STORAGE = ("WORKING-STORAGE", "LOCAL-STORAGE")


def _places(levels: Column) -> Column:
    """array<struct<parent, depth>> for the levels of one section.

    The parent is the nearest earlier item with a lower level, 0 for none; 01
    and 77 have none and an 88 is never a parent. Positions start at 1.
    """
    open_type = "struct<level:int,no:int,depth:int>"
    start = F.struct(
        F.array().cast(f"array<{open_type}>").alias("open"), F.lit(0).alias("no")
    )

    def step(state, level):
        no = state.no + 1
        found = F.struct(
            F.filter(state.open, lambda e: e.level < level).alias("lower"),
            level.isin(*_ROOTS).alias("is_root"),
        )

        def apply(f):
            above = F.get(f.lower, F.size(f.lower) - F.lit(1))
            alone = f.is_root | (F.size(f.lower) == 0)
            depth = F.when(alone, F.lit(0)).otherwise(above.depth + 1)
            entry = F.struct(level.alias("level"), no.alias("no"), depth.alias("depth"))
            after = F.when(level == _CONDITION, state.open).otherwise(F.array_append(f.lower, entry))
            return F.struct(
                F.struct(after.alias("open"), no.alias("no")).alias("state"),
                F.struct(
                    F.when(alone, F.lit(0)).otherwise(above.no).alias("parent"), depth.alias("depth")
                ).alias("out"),
            )

        return let(found, apply)

    return running(levels, start, step, "struct<parent:int,depth:int>")


def _in_lists(use) -> Column:
    """Array of what ``use`` makes of each section or FD and its item sentences."""

    def of_list(entry):
        found = F.transform(st.data_sentences(entry.body), drop_period)
        return use(entry, F.filter(found, lambda s: s.rlike(r"^\d{1,2}\s+\S")))

    return F.flatten(F.transform(st.data_lists(F.col("data_text")), of_list))


@built_once
def _sentences() -> Column:
    """array<struct<section, fd, sentence>>."""

    def mark_all(entry, sentences):
        return F.transform(
            sentences, lambda s: F.struct(entry.section.alias("section"), entry.fd.alias("fd"), s.alias("sentence"))
        )

    return _in_lists(mark_all)


@built_once
def _placed_sentences() -> Column:
    """array<struct<section, fd, no, sentence, place, next_parent, parent_sentence>>."""

    def place_all(entry, found):
        return let(
            found,
            lambda sentences: let(
                let(F.transform(sentences, cl.level_of), _places),
                lambda places: F.transform(
                    sentences,
                    lambda s, i: F.struct(
                        entry.section.alias("section"),
                        entry.fd.alias("fd"),
                        (i + 1).alias("no"),
                        s.alias("sentence"),
                        F.get(places, i).alias("place"),
                        F.get(places, i + 1).parent.alias("next_parent"),
                        F.get(sentences, F.get(places, i).parent - 1).alias("parent_sentence"),
                    ),
                ),
            ),
        )

    return _in_lists(place_all)


def data_items(outlined: DataFrame, hierarchy: bool = True) -> DataFrame:
    """path, item_no, section, fd, level, name, picture, usage, value, occurs,
    occurs_depending, redefines, is_filler, is_88, parent_no, depth,
    has_children, parent_level, parent_name, parent_clauses, clauses.

    Without ``hierarchy`` the columns from parent_no to parent_clauses are left out,
    and the places of the items are not looked for."""
    found = _placed_sentences() if hierarchy else _sentences()
    placed = outlined.select("path", F.posexplode(found).alias("pos", "item"))
    item_no = F.col("pos") + 1
    before = {
        "path": F.col("path"),
        "item_no": item_no,
        "section": F.col("item.section"),
        "fd": F.col("item.fd"),
        "level": cl.level_of(F.col("item.sentence")),
        "name": cl.name_of(F.col("item.sentence")),
    }
    after = {"clauses": cl.clauses_of(F.col("item.sentence"))}
    if hierarchy:
        parent = F.col("item.place.parent")
        after = {
            "parent_no": F.when(parent > 0, item_no - F.col("item.no") + parent),
            "depth": F.col("item.place.depth"),
            # the first child of an item, if it has one, follows it at once
            "has_children": F.coalesce(F.col("item.next_parent") == F.col("item.no"), F.lit(False)),
            "parent_level": cl.level_of(F.col("item.parent_sentence")),
            "parent_name": cl.name_of(F.col("item.parent_sentence")),
            "parent_clauses": cl.clauses_of(F.col("item.parent_sentence")),
        } | after
    rows = placed.select(*[c.alias(name) for name, c in (before | after).items()])
    # an 88 level has values and nothing else
    is_88 = F.col("level") == _CONDITION
    declared = F.when(is_88, F.lit("")).otherwise(F.col("clauses"))
    cut = cl.cut_clauses(rows.select(*before, *after, declared.alias("declared")), "declared", *before, *after)
    return (
        cut.select(*before, *after, *cl.raw_clauses())
        .select(
            *before,
            *cl.item_columns(),
            (F.upper("name") == "FILLER").alias("is_filler"),
            is_88.alias("is_88"),
            *after,
        )
    )


def item_hierarchy(items: DataFrame) -> DataFrame:
    """path, item_no, level, name, parent_no, depth."""
    return items.select("path", "item_no", "level", "name", "parent_no", "depth")


def is_group() -> Column:
    return F.col("has_children") & (F.col("picture") == "")


def item_types(placed: DataFrame) -> DataFrame:
    """Add spark_type, precision and scale to placed items."""
    return with_spark_type(placed.withColumn("is_group", is_group())).drop("is_group")


def conditions(items: DataFrame) -> DataFrame:
    """path, parent_no, item_no, name, condition_values: the 88 levels."""
    return items.where("is_88").select(
        "path", "parent_no", "item_no", "name", cl.condition_values(F.col("clauses")).alias("condition_values")
    )


def _direct_fields(items: DataFrame) -> DataFrame:
    """Fields of the 01 groups: no 88 levels, no fillers; a nested group is one."""
    return items.where(
        F.col("section").isin(*_STORAGE, "LINKAGE")
        & (F.col("depth") == 1)
        & (F.col("parent_level") == 1)
        & (F.upper("parent_name") != "FILLER")
        & ~cl.has_picture(F.col("parent_clauses"))
        & ~F.col("is_88")
        & ~F.col("is_filler")
    )


def record_fields(typed: DataFrame) -> DataFrame:
    """path, record_no, section, record, field_no, field, spark_type, occurs,
    occurs_depending: direct fields of the 01 groups, in order."""
    return _direct_fields(typed).select(
        "path",
        F.col("parent_no").alias("record_no"),
        "section",
        F.col("parent_name").alias("record"),
        F.col("item_no").alias("field_no"),
        F.col("name").alias("field"),
        "spark_type",
        "occurs",
        "occurs_depending",
    )


def record_schemas(items: DataFrame) -> DataFrame:
    """path, record_no, section, record, fields, class_name: records with a
    field or more. The fields themselves, in order, are ``record_fields``."""
    return (
        _direct_fields(items)
        .groupBy("path", F.col("parent_no").alias("record_no"), "section", F.col("parent_name").alias("record"))
        .agg(F.count("*").alias("fields"))
        .withColumn("class_name", pascal_case(F.col("record")))
    )


def struct_type(fields: list[Row]) -> T.StructType:
    """StructType of one record from its ``record_fields`` rows.

    Nested groups and object references keep their text, as strings.
    """
    out = T.StructType()
    for row in sorted(fields, key=lambda r: r["field_no"]):
        name = row["field"].lower().replace("-", "_")
        plain = "string" if row["spark_type"] in ("struct", "unsupported") else row["spark_type"]
        dtype = T.DataType.fromDDL(plain)
        out.add(name, T.ArrayType(dtype) if row["occurs"] else dtype)
    return out


def _held_conditions() -> Column:
    """array<struct<item_no, name, member>> of one file: the 88 levels of stored
    items, in order. Those of one item follow one another."""

    def held(x, pos):
        return F.struct(
            x.section.alias("section"),
            cl.level_of(x.sentence).alias("level"),
            x.place.parent.alias("parent"),
            (pos + 1 - x.no + x.place.parent).alias("item_no"),
            cl.name_of(x.parent_sentence).alias("name"),
            F.replace(F.upper(cl.name_of(x.sentence)), F.lit("-"), F.lit("_")).alias("member"),
        )

    return F.filter(
        F.transform(_placed_sentences(), held),
        lambda h: h.section.isin(*_STORAGE) & (h.level == _CONDITION) & (h.parent > 0),
    )


def _same_item(held: Column, h: Column, at: Column) -> Column:
    return F.coalesce(F.get(held, at).item_no == h.item_no, F.lit(False))


def enum_members(outlined: DataFrame) -> DataFrame:
    """path, item_no, name, member: 88 levels of items that have two or more."""
    held = outlined.select("path", _held_conditions().alias("held"))
    several = F.filter(
        "held", lambda h, k: _same_item(F.col("held"), h, k - 1) | _same_item(F.col("held"), h, k + 1)
    )
    return held.select("path", F.explode(several).alias("h")).select("path", "h.item_no", "h.name", "h.member")


def enum_candidates(outlined: DataFrame) -> DataFrame:
    """path, item_no, name, members, enum_name: items with two 88 levels or more."""
    held = outlined.select("path", _held_conditions().alias("held"))
    placed = F.transform("held", lambda h, k: F.struct(h.alias("h"), k.alias("k")))
    firsts = held.select(
        "path",
        F.size("held").alias("held_size"),
        F.filter(placed, lambda p: ~_same_item(F.col("held"), p.h, p.k - 1)).alias("firsts"),
    )
    counted = F.transform(
        "firsts",
        lambda p, n: F.struct(
            p.h.alias("h"), (F.coalesce(F.get("firsts", n + 1).k, F.col("held_size")) - p.k).alias("members")
        ),
    )
    return (
        firsts.select("path", F.explode(F.filter(counted, lambda c: c.members >= 2)).alias("c"))
        .select("path", "c.h.item_no", "c.h.name", F.col("c.members").cast("bigint").alias("members"))
        .withColumn("enum_name", F.concat(pascal_case(F.col("name")), F.lit("Type")))
    )


@built_once
def class_candidates() -> Column:
    """array<struct<part, key>> of one file: a row per field of a record and per
    88 level of an item, as ``record_schemas`` and ``enum_candidates`` count them."""

    def name(sentence):
        return F.upper(cl.name_of(sentence))

    def holder(x):
        return F.concat_ws(":", x.section, x.fd, x.place.parent)

    def is_field(x):
        return (
            x.section.isin(*_STORAGE, "LINKAGE")
            & (x.place.depth == 1)
            & (cl.level_of(x.sentence) != _CONDITION)
            & (cl.level_of(x.parent_sentence) == 1)
            & (name(x.parent_sentence) != "FILLER")
            & ~cl.has_picture(cl.clauses_of(x.parent_sentence))
            & (name(x.sentence) != "FILLER")
        )

    def part(x):
        return (
            F.when(x.section.isin(*_STORAGE) & (cl.level_of(x.sentence) == _CONDITION), F.lit("enums"))
            .when(is_field(x), F.lit("data_classes"))
        )

    items = F.filter(_placed_sentences(), lambda x: x.place.parent > 0)
    found = F.transform(items, lambda x: F.struct(part(x).alias("part"), holder(x).alias("key")))
    return F.filter(found, lambda c: c.part.isNotNull())


def screen_fields(outlined: DataFrame) -> DataFrame:
    """path, item_no, level, name, line, col, pic, value, from_field, to_field,
    attribute: items of the SCREEN section."""
    rows = data_items(outlined).where(F.col("section") == "SCREEN")
    rows = cl.cut_clauses(rows, "clauses", "path", "item_no", "level", "name", "clauses")

    def word(*keywords, optional=()):
        return cl.after(F.col("cut"), F.col("capitals"), keywords, optional)

    def number(*keywords):
        found = no_dots(word(*keywords, optional=("NUMBER", "IS")))
        return F.when(found == "", F.lit(0)).otherwise(found.try_cast("int"))

    attribute = F.when(F.lit(False), F.lit(""))
    for phrase in SCREEN_ATTRIBUTES:
        attribute = attribute.when(F.array_join("capitals", " ").contains(phrase), F.lit(phrase))
    return rows.select(
        "path",
        "item_no",
        "level",
        "name",
        number("LINE").alias("line"),
        number("COL", "COLUMN").alias("col"),
        no_dots(word(*cl.PICTURE, optional=("IS",))).alias("pic"),
        cl.literal_text(no_dots(word("VALUE", optional=("IS",)))).alias("value"),
        no_dots(word("FROM")).alias("from_field"),
        no_dots(word("TO")).alias("to_field"),
        attribute.otherwise(F.lit("")).alias("attribute"),
    )
