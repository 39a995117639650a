"""Clauses of one data item sentence.

A sentence is cut into words, a quoted literal being one word whatever it holds.
A clause is the word that follows its keyword, optional words passed over, so no
clause is found inside a name or a literal.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copperbook.functions.text import let, no_dots
from copperbook.vocabulary import FIGURATIVE, USAGE_WORDS

_QUOTED = r"""(?:"(?:[^"]|"")*"|'(?:[^']|'')*')"""
# a literal with its prefix, or characters up to a blank or a separator before one
# (the characters before a literal hold no quote, so none is given back)
_WORD = rf"""[^\s"',;]*+{_QUOTED}|\S+?(?=[,;]?(?:\s|\z))"""
# the same where a comma alone parts two words
_LIST_WORD = rf"""[^\s"',;]*+{_QUOTED}|[^\s,;]+"""
PICTURE = ("PIC", "PICTURE")
_USAGES = rf"^(?:{USAGE_WORDS})$"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def list_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_LIST_WORD), F.lit(0))


def in_capitals(cut: Column) -> Column:
    return F.transform(cut, F.upper)


def place_of(capitals: Column, *keywords: str) -> Column:
    """Place of the first of the keywords, from 1; 0 where there is none."""
    place = F.lit(0)
    for keyword in keywords:
        at = F.array_position(capitals, F.lit(keyword)).cast("int")
        place = at if keyword == keywords[0] else F.when(place == 0, at).when(at == 0, place).otherwise(F.least(place, at))
    return place


def _past(capitals: Column, place: Column, optional: tuple[str, ...]) -> Column:
    """``place`` beyond as many optional words as stand there, each once."""
    for _ in optional:
        place = place + F.coalesce(F.get(capitals, place).isin(*optional), F.lit(False)).cast("int")
    return place


def after(cut: Column, capitals: Column, keywords: tuple[str, ...], optional: tuple[str, ...] = ()) -> Column:
    """The word after a keyword, past optional words; empty text for none."""
    return let(place_of(capitals, *keywords), lambda at: _word_after(cut, capitals, at, optional))


def _word_after(cut: Column, capitals: Column, at: Column, optional: tuple[str, ...] = ()) -> Column:
    return F.when(at > 0, F.coalesce(F.get(cut, _past(capitals, at, optional)), F.lit(""))).otherwise("")


def level_of(sentence: Column) -> Column:
    return F.regexp_extract(sentence, r"^(\d{1,2})", 1).try_cast("int")


def name_of(sentence: Column) -> Column:
    """The second word; ``split`` would compile its pattern for every sentence."""
    return no_dots(F.coalesce(F.regexp_extract(sentence, r"^\S*+\s++(\S*+)", 1), F.lit("")))


def clauses_of(sentence: Column) -> Column:
    """What follows the second word."""
    return no_dots(F.coalesce(F.regexp_extract(sentence, r"(?s)^\S*+\s++\S*+\s++(.*)", 1), F.lit("")))


def has_picture(clauses: Column) -> Column:
    return F.exists(words(clauses), lambda w: F.upper(w).isin(*PICTURE))


_KEYWORDS = {
    "picture": PICTURE, "usage": ("USAGE",), "value": ("VALUE", "VALUES"), "occurs": ("OCCURS",),
    "to": ("TO",), "depending": ("DEPENDING",), "redefines": ("REDEFINES",),
}


def cut_clauses(declared: DataFrame, clauses: str, *kept: str) -> DataFrame:
    """The ``kept`` columns, the words of the clauses as written and in capitals, and
    the place of each keyword: all columns, so that each is found once. ``raw_clauses``
    reads them."""
    cut = declared.select(*kept, words(F.col(clauses)).alias("cut"))
    both = cut.select(*kept, "cut", in_capitals(F.col("cut")).alias("capitals"))
    places = [place_of(F.col("capitals"), *found).alias(f"at_{name}") for name, found in _KEYWORDS.items()]
    return both.select(*kept, "cut", "capitals", *places)


def raw_clauses() -> list[Column]:
    """The clause texts as found, from the columns of ``cut_clauses``."""
    cut, capitals = F.col("cut"), F.col("capitals")

    def word(name: str, *optional: str) -> Column:
        return _word_after(cut, capitals, F.col(f"at_{name}"), optional)

    usages = F.filter(capitals, lambda w: w.rlike(_USAGES))
    to = _past(capitals, F.col("at_value"), ("IS", "ARE"))
    value = (
        F.when(F.col("at_value") == 0, F.lit(""))
        .when(F.get(capitals, to) == "ALL", F.concat_ws(" ", F.get(cut, to), F.get(cut, to + 1)))
        .otherwise(F.coalesce(F.get(cut, to), F.lit("")))
    )
    return [
        no_dots(word("picture", "IS")).alias("picture"),
        F.upper(no_dots(word("usage", "IS"))).alias("named_usage"),
        F.coalesce(F.get(usages, F.lit(0)), F.lit("")).alias("bare_usage"),
        no_dots(value).alias("raw_value"),
        word("occurs").alias("raw_occurs"),
        F.when(F.col("at_depending") > 0, word("to")).otherwise("").alias("raw_most"),
        no_dots(word("depending", "ON")).alias("occurs_depending"),
        no_dots(word("redefines")).alias("redefines"),
    ]


def literal_text(raw: Column) -> Column:
    """The text of a quoted literal, doubled quotes read as one; other words
    without quotes at their ends."""
    whole = F.substr(raw, F.lit(2), F.length(raw) - F.lit(2))
    quote = F.substr(raw, F.lit(1), F.lit(1))
    return F.when(
        raw.rlike(rf"^{_QUOTED}$"), F.replace(whole, F.concat(quote, quote), quote)
    ).otherwise(F.trim(raw, F.lit("'\"")))


def item_columns() -> list[Column]:
    """Clause values from the columns of ``raw_clauses``.

    A USAGE word may stand alone. VALUE has no quotes and one spelling per
    figurative constant, or is null. OCCURS is the maximum under DEPENDING ON,
    0 where there is none, and null beyond any count.
    """
    raw = F.col("raw_value")
    figurative = F.when(F.lit(False), F.lit(""))
    for spelling in sorted(set(FIGURATIVE.values())):
        spelled = [w for w, s in FIGURATIVE.items() if s == spelling]
        figurative = figurative.when(F.upper(raw).isin(spelled), F.lit(spelling))
    value = F.when(raw == "", F.lit(None).cast("string")).otherwise(F.coalesce(figurative, literal_text(raw)))
    times = F.coalesce(F.nullif("raw_most", F.lit("")), F.nullif("raw_occurs", F.lit("")))
    return [
        F.col("picture"),
        F.when(F.col("named_usage") != "", F.col("named_usage")).otherwise(F.col("bare_usage")).alias("usage"),
        F.nullif(value, F.lit("")).alias("value"),
        F.when(times.isNull(), 0).otherwise(times.try_cast("int")).alias("occurs"),
        F.col("occurs_depending"),
        F.col("redefines"),
    ]


def condition_values(clauses: Column) -> Column:
    """Array of values; a range is one value, ``low THRU high``."""

    def listed(cut, capitals):
        first = let(place_of(capitals, "VALUE", "VALUES"), lambda at: _past(capitals, at, ("IS", "ARE")) + 1)
        values = F.transform(F.slice(cut, first, F.size(cut)), lambda w: F.struct(literal_text(w).alias("text"), F.upper(w).alias("word")))

        # a range word joins the value before and the value after
        def step(out, w):
            last = F.element_at(out, -1)
            ranged = w["word"].isin("THRU", "THROUGH")
            open_ = last.rlike(r" (?i:THRU|THROUGH) \z")
            joined = F.concat(last, F.when(ranged, F.concat(F.lit(" "), w["text"], F.lit(" "))).otherwise(w["text"]))
            return F.when(
                (F.size(out) > 0) & (ranged | open_),
                F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(joined)),
            ).otherwise(F.array_append(out, w["text"]))

        return F.aggregate(values, F.array().cast("array<string>"), step)

    return let(list_words(no_dots(clauses)), lambda cut: let(in_capitals(cut), lambda capitals: listed(cut, capitals)))
