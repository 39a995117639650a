"""Small text expressions shared by the operators."""

import functools
import weakref

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\f\x0b\u00a0\u3000"


def built_once(build):
    """Keep the expression a function without arguments builds, per context.

    The long expressions over a source text are the same in every query; putting
    one together takes hundreds of calls to the JVM.
    """
    kept = weakref.WeakKeyDictionary()

    @functools.wraps(build)
    def get():
        context = SparkContext.getOrCreate()
        if context not in kept:
            kept[context] = build()
        return kept[context]

    return get


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it occurs.

    Inside lambda functions nothing else shares a repeated expression.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


_SPLIT = "\x06"


def split_at(text: Column, pattern: str) -> Column:
    """Split at a regular expression.

    ``split`` compiles its pattern for every value; a replacement keeps the
    compiled pattern, and splitting at one character needs none.
    """
    return F.split(F.regexp_replace(text, pattern, _SPLIT), _SPLIT)


def strip(c: Column) -> Column:
    """Trim every kind of blank, not only spaces."""
    return F.trim(c, F.lit(BLANKS))


def drop_period(c: Column) -> Column:
    """Text without the period(s) that end a sentence."""
    return F.trim(F.rtrim(F.trim(c), F.lit(".")))


def no_dots(c: Column) -> Column:
    return F.rtrim(c, F.lit("."))


def word(c: Column, n: int) -> Column:
    """n-th blank-separated word, or an empty string."""
    return F.regexp_extract(c, r"^\s*" + r"\S+\s+" * (n - 1) + r"(\S+)", 1)


def pascal_case(name: Column) -> Column:
    """CUSTOMER-MASTER -> CustomerMaster."""
    parts = F.split(F.replace(F.lower(name), F.lit("_"), F.lit("-")), "-")
    return F.array_join(F.transform(parts, F.initcap), "")


def camel_case(name: Column) -> Column:
    """CUSTOMER-MASTER -> customerMaster."""
    pascal = pascal_case(name)
    return F.concat(F.lower(F.substring(pascal, 1, 1)), F.substr(pascal, F.lit(2)))


def class_of(command: Column, classes: dict[str, list[str]], default: str) -> Column:
    """Look a command up in a small fixed table, as a CASE rather than a join."""
    out = F.when(F.lit(False), F.lit(default))
    for name, words in classes.items():
        out = out.when(command.isin(words), F.lit(name))
    return out.otherwise(F.lit(default))
