"""Conditions as boolean columns; combine them with ``&``, ``|`` and ``~``."""

import re
from operator import eq, ge, gt, le, lt, ne

from pyspark.sql import Column
from pyspark.sql import functions as F

# Relational operators, IS, THAN and TO left out.
_RELATIONS = {
    "=": eq,
    "EQUAL": eq,
    "NOT =": ne,
    "NOT EQUAL": ne,
    "<>": ne,
    ">": gt,
    "GREATER": gt,
    "NOT >": le,
    "NOT GREATER": le,
    "<": lt,
    "LESS": lt,
    "NOT <": ge,
    "NOT LESS": ge,
    ">=": ge,
    "GREATER OR EQUAL": ge,
    "<=": le,
    "LESS OR EQUAL": le,
}


def relation(left: Column, operator: str, right) -> Column:
    """``relation(col, "IS GREATER THAN OR EQUAL TO", 5)``."""
    key = " ".join(w for w in operator.upper().split() if w not in ("IS", "THAN", "TO"))
    if key not in _RELATIONS:
        raise ValueError(f"no relation {operator!r}")
    return _RELATIONS[key](left, right if isinstance(right, Column) else F.lit(right))


def is_numeric(c: Column) -> Column:
    return c.rlike(r"^[0-9]+$")


def is_alphabetic(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z ]+$")


def condition_name(parent: Column, values: list) -> Column:
    """Test of an 88 level. A value is a literal, a (low, high) pair or the text
    ``low THRU high``."""
    single, ranges = [], []
    for value in values:
        pair = re.split(r"\s+THR(?:U|OUGH)\s+", value) if isinstance(value, str) else value
        if isinstance(pair, (list, tuple)) and len(pair) == 2:
            ranges.append(pair)
        else:
            single.append(value)
    test = parent.isin(single) if single else F.lit(False)
    for low, high in ranges:
        test = test | parent.between(F.lit(low), F.lit(high))
    return test


def first_value(values: list):
    """What SET condition TO TRUE stores: the first value, or the low end of it."""
    first = values[0]
    if isinstance(first, str):
        return re.split(r"\s+THR(?:U|OUGH)\s+", first)[0]
    return first[0] if isinstance(first, (list, tuple)) else first


def evaluate_true(whens: list[tuple[Column, object]], other=None) -> Column:
    """EVALUATE TRUE: the first condition that holds decides."""
    out = F.when(F.lit(False), _value(whens[0][1]))
    for test, result in whens:
        out = out.when(test, _value(result))
    return out.otherwise(_value(other))


def evaluate(subject: Column, whens: dict, other=None) -> Column:
    """EVALUATE subject: a value decides; WHEN OTHER is ``other``."""
    return evaluate_true([(subject == F.lit(k), v) for k, v in whens.items()], other)


def if_else(test: Column, then, otherwise=None) -> Column:
    """IF; an unknown condition takes the ELSE branch."""
    return F.when(test, _value(then)).otherwise(_value(otherwise))


def _value(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)
