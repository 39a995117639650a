"""Fixed-width character records.

Numeric fields are digits with an implied point; a signed field has a leading
sign character. Packed, zoned and binary fields are not read.
"""

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Open modes that write, and what they do to what is there.
_WRITE_MODES = {"OUTPUT": "overwrite", "EXTEND": "append", "I-O": "append"}


# Usages whose fields are characters.
_CHARACTER_USAGES = ("", "DISPLAY")


# Types that hold whole numbers.
_WHOLE = ("int", "bigint")


@dataclass(frozen=True)
class Field:
    """Place of one field in a record; ``start`` counts from 1. ``length`` is
    that of one element, ``point`` says that the picture shows its decimal point,
    and ``occurs`` above 0 makes the field a table."""

    name: str
    start: int
    length: int
    dtype: str = "string"
    signed: bool = False
    point: bool = False
    occurs: int = 0

    @property
    def scale(self) -> int:
        kind = T.DataType.fromDDL(self.dtype)
        return kind.scale if isinstance(kind, T.DecimalType) else 0

    @property
    def is_text(self) -> bool:
        return self.dtype == "string"

    @property
    def end(self) -> int:
        return self.start + self.length * max(1, self.occurs)


def layout(*fields: tuple) -> list[Field]:
    """Fields one after another from (name, length, dtype[, signed]) tuples."""
    out, start = [], 1
    for name, length, dtype, *signed in fields:
        out.append(Field(name, start, length, dtype, bool(signed and signed[0])))
        start += length
    return out


def picture_length(picture: str) -> int:
    """Characters a DISPLAY picture takes; S stands for a leading sign character."""
    pairs = re.findall(r"([^()])(?:\((\d+)\))?", picture.upper())
    return sum(int(n or 1) for symbol, n in pairs if symbol != "V")


def layout_of(items: list[dict]) -> list[Field]:
    """Layout of one record from its elementary items, in order, each with name,
    picture and spark_type, and usage, occurs and redefines where it has them.

    A field that redefines another starts where that one does. A packed or
    binary usage has no characters and is refused.
    """
    out: list[Field] = []
    start = 1
    for item in items:
        picture, usage = item["picture"].upper(), (item.get("usage") or "").upper()
        if usage not in _CHARACTER_USAGES:
            raise ValueError(f"{item['name']} has usage {usage}, which is not characters")
        name = item["name"].lower().replace("-", "_")
        target = (item.get("redefines") or "").lower().replace("-", "_")
        if target:
            at = next((f.start for f in out if f.name == target), None)
            if at is None:
                raise ValueError(f"{item['name']} redefines {item['redefines']}, which is not before it")
        else:
            at = start
        field = Field(
            name, at, picture_length(picture), item["spark_type"], picture.startswith("S"), "." in picture,
            item.get("occurs") or 0,
        )
        out.append(field)
        start = max(start, field.end)
    return out


def element_value(field: Field, text: Column) -> Column:
    """The value of the characters of one element."""
    if field.is_text:
        return F.rtrim(text)
    shown = F.trim(text)
    if field.point or not field.scale:
        exact = shown.try_cast(f"decimal(38,{field.scale})").try_cast(field.dtype)
        # plain digits, as most are, take a tenth of the way
        return F.coalesce(shown.try_cast(field.dtype), exact) if field.dtype in _WHOLE else exact
    # the point is an exponent behind the digits, so that none is rounded
    number = F.regexp_extract(shown, r"^([+-]?\d+)$", 1)
    return F.concat(number, F.lit(f"E-{field.scale}")).try_cast(field.dtype)


def _read(field: Field) -> Column:
    def at(n: int) -> Column:
        return element_value(field, F.substring("value", field.start + n * field.length, field.length))

    return F.array(*[at(n) for n in range(field.occurs)]) if field.occurs else at(0)


def read_records(spark: SparkSession, path: str, fields: list[Field]) -> DataFrame:
    """One row per line; a field that is not a number where one belongs is null."""
    return spark.read.text(path).select(*[_read(f).alias(f.name) for f in fields])


def element_text(field: Field, value: Column) -> Column:
    """The characters of one element; a null is blank."""
    blank = F.lit(" " * field.length)
    if field.is_text:
        return F.rpad(F.coalesce(value, F.lit("")), field.length, " ")
    digits = min(38, max(0, field.length - (1 if field.signed else 0) - (1 if field.point else 0)))
    exact = value.try_cast(f"decimal(38,{field.scale})")
    # the digits as written, without the point; high-order ones without a place are lost
    plain = F.abs(exact).cast("string")
    if field.scale:
        plain = F.replace(plain, F.lit("."), F.lit(""))
    kept = F.substring(F.concat(F.lit("0" * digits), plain), -digits, digits)
    if field.point:
        kept = F.concat(F.substring(kept, 1, digits - field.scale), F.lit("."), F.right(kept, F.lit(field.scale)))
    if field.signed:
        kept = F.concat(F.when(exact < 0, "-").otherwise("+"), kept)
    return F.coalesce(kept, blank)


def _write(field: Field) -> Column:
    value = F.col(field.name)
    if not field.occurs:
        return element_text(field, value)
    return F.concat(*[element_text(field, F.get(value, F.lit(n))) for n in range(field.occurs)])


def record_text(df: DataFrame, fields: list[Field]) -> DataFrame:
    """value: the record as characters. Of fields in one place the first is
    written; a null is blank, and reads as null again where a number belongs."""
    places = sorted({f.start: f for f in reversed(fields)}.values(), key=lambda f: f.start)
    return df.select(F.concat(*[_write(f) for f in places]).alias("value"))


def write_text(lines: DataFrame, path: str, mode: str) -> None:
    """OUTPUT replaces what is there; EXTEND and I-O add to it."""
    if mode not in _WRITE_MODES:
        raise ValueError(f"a file open for {mode} takes no records")
    lines.write.mode(_WRITE_MODES[mode]).text(path)


def write_records(df: DataFrame, path: str, fields: list[Field], mode: str = "OUTPUT") -> None:
    """Records of one length."""
    write_text(record_text(df, fields), path, mode)
