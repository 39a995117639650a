"""Field-level functions: text, arrays, JSON and XML, bits, time."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def display_line(*operands) -> Column:
    """DISPLAY: operands side by side, without separators."""
    return F.concat(*[F.coalesce(_col(o).cast("string"), F.lit("")) for o in operands])


def string_into(*parts) -> Column:
    """STRING: each part is a column, or (column, delimiter) to stop before the
    first delimiter; a delimiter of None is DELIMITED BY SIZE."""
    pieces = []
    for part in parts:
        source, delimiter = part if isinstance(part, tuple) else (part, None)
        text = _col(source).cast("string")
        pieces.append(text if delimiter is None else F.substring_index(text, delimiter, 1))
    return F.concat(*pieces)


def unstring(source: Column, delimiter: str, all_: bool = False) -> Column:
    """UNSTRING: array of the delimited parts; ``all_`` takes runs of the
    delimiter as one."""
    quoted = r"\Q" + delimiter + r"\E"
    return F.split(source, f"(?:{quoted})+" if all_ else quoted)


def part(parts: Column, n: int) -> Column:
    """n-th receiving field of UNSTRING; null when there are fewer parts."""
    return F.get(parts, F.lit(n - 1))


def inspect_tally(source: Column, literal: str, leading: bool = False) -> Column:
    """Occurrences of a literal that do not overlap, or only the leading ones."""
    text = source
    if leading:
        text = F.regexp_extract(source, r"^(?:\Q" + literal + r"\E)*+", 0)
    removed = F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))
    return (removed / F.lit(len(literal))).cast("bigint")


def inspect_replace(source: Column, old: str, new: str, first: bool = False) -> Column:
    """REPLACING ALL, or FIRST."""
    if first:
        at = F.instr(source, old)
        return F.when(at > 0, F.overlay(source, F.lit(new), at, F.lit(len(old)))).otherwise(source)
    return F.replace(source, F.lit(old), F.lit(new))


def inspect_converting(source: Column, old: str, new: str) -> Column:
    """CONVERTING: character by character."""
    return F.translate(source, old, new)


def subscript(items: Column, index) -> Column:
    """ITEM(index), from 1; null outside the table."""
    return F.get(items, _col(index).cast("int") - F.lit(1))


def qualify(field: str, record: str) -> Column:
    """FIELD OF RECORD."""
    return F.col(f"{record}.{field}")


def table_of(items: Column, counter) -> Column:
    """The part of a table that OCCURS DEPENDING ON makes current."""
    return F.slice(items, F.lit(1), _col(counter).cast("int"))


def perform_varying(items: Column, body) -> Column:
    """PERFORM VARYING over a table: body(element, index from 1) per element."""
    return F.transform(items, lambda x, i: body(x, i + 1))


def perform_times(times, start: Column, body) -> Column:
    """PERFORM n TIMES: body(value) applied n times."""
    count = _col(times)
    rounds = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, start, lambda value, _: body(value))


def first_index(items: Column, test, start=1) -> Column:
    """Index, from 1, of the first element at or after ``start`` for which ``test``
    holds, or null. Elements after it are not tested."""
    size, begin = F.size(items), F.greatest(_col(start).cast("int"), F.lit(1))
    places = F.when(begin <= size, F.sequence(begin, size)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(
        places,
        F.lit(None).cast("int"),
        lambda found, i: F.when(found.isNotNull(), found).when(test(F.get(items, i - 1)), i),
    )


def perform_until(items: Column, test) -> Column:
    """Elements a PERFORM UNTIL passes before ``test`` first holds."""
    at = first_index(items, test)
    return F.when(at.isNotNull(), F.slice(items, F.lit(1), at - 1)).otherwise(items)


def search_table(items: Column, test, start=1) -> Column:
    """SEARCH VARYING from ``start``: the first element for which ``test`` holds, or
    null (AT END)."""
    return F.get(items, first_index(items, test, start) - 1)


def leading(items: Column, holds) -> Column:
    """How many leading elements ``holds`` is true for, where it is true for those
    before some place and for none after: by bisection."""
    size = F.size(items)
    steps = F.when(size > 0, F.sequence(F.lit(0), F.floor(F.log2(size)).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )

    def halve(s, _):
        middle = F.floor((s.low + s.high) / 2).cast("int")
        here = (s.low < s.high) & holds(F.get(items, middle))
        return F.struct(
            F.when(here, middle + 1).otherwise(s.low).alias("low"),
            F.when(here | (s.low >= s.high), s.high).otherwise(middle).alias("high"),
        )

    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), size.alias("high")), halve, lambda s: s.low)


def search_all(items: Column, key, of=lambda x: x, descending: bool = False) -> Column:
    """SEARCH ALL in a table sorted by ``of(element)``: the index, from 1, of the
    first element with the key, or null (AT END). Takes some twenty steps for a
    million elements."""
    wanted = _col(key)
    before = leading(items, lambda x: of(x) > wanted if descending else of(x) < wanted)
    return F.when(of(F.get(items, before)) == wanted, before + 1)


def json_generate(*fields) -> Column:
    return F.to_json(F.struct(*fields))


def json_parse(source: Column, schema: str) -> Column:
    return F.from_json(source, schema)


def xml_generate(*fields) -> Column:
    """struct(document, count): the text and its length, as COUNT IN gives it."""
    document = F.to_xml(F.struct(*fields))
    return F.struct(document.alias("document"), F.length(document).alias("count"))


def xml_parse(source: Column, schema: str) -> Column:
    return F.from_xml(source, schema)


def to_upper(c: Column) -> Column:
    return F.upper(c)


def to_lower(c: Column) -> Column:
    return F.lower(c)


def bit_and(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def bit_or(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def bit_xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def bit_not(a: Column) -> Column:
    return F.bitwise_not(a)


def bit_eq(a: Column, b: Column) -> Column:
    """Equivalence: one where the bits agree."""
    return F.bitwise_not(a.bitwiseXOR(b))


def ask_time() -> Column:
    return F.current_timestamp()


def format_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def _col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)
