"""Arithmetic that stores like the language does: excess digits are cut off."""

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _type(dtype) -> T.DataType | None:
    return T.DataType.fromDDL(dtype) if isinstance(dtype, str) else dtype


def store(value: Column, dtype, source=None) -> Column:
    """``value`` as the target type, truncated toward zero; null on overflow.

    A plain cast would round. ``source`` is the type of ``value`` where known:
    without excess digits there is nothing to cut. Floating-point values pass
    through a decimal with 12 places.
    """
    dtype, source = _type(dtype), _type(source)
    if not isinstance(dtype, T.DecimalType) or isinstance(source, T.IntegralType):
        return value.try_cast(dtype)
    if isinstance(source, T.DecimalType):
        if source.scale <= dtype.scale:
            return value.try_cast(dtype)
    else:
        value = value.try_cast("decimal(38,12)")
    cut = F.when(value >= 0, F.floor(value, F.lit(dtype.scale))).otherwise(F.ceil(value, F.lit(dtype.scale)))
    return cut.try_cast(dtype)


def _whole(value: Column, source, places: int) -> Column:
    """value * 10**places as a whole number, for a value with no more places."""
    if isinstance(source, T.IntegralType) and not places:
        return value
    return F.try_multiply(value, F.lit(10**places).cast(f"decimal({places + 1},0)")).try_cast("bigint")


def quotient(dividend: Column, divisor: Column, dtype, types=(None, None)) -> Column:
    """Quotient truncated toward zero at the scale of ``dtype``; null for a
    zero divisor.

    ``types`` are the operand types where known. Operands that fit whole
    numbers of 18 digits divide as such; others as decimals, where the division
    leaves no remainder and so rounds nothing.
    """
    dtype = _type(dtype)
    scale = dtype.scale if isinstance(dtype, T.DecimalType) else 0
    by = F.nullif(divisor, F.lit(0))
    places = _common_places(types, scale)
    if places is not None:
        top, bottom = _whole(dividend, types[0], places + scale), _whole(divisor, types[1], places)
        # the least whole number has no opposite
        up = F.when(bottom == -1, F.try_subtract(F.lit(0), top)).otherwise(
            F.call_function("div", top, F.nullif(F.nullif(bottom, F.lit(0)), F.lit(-1)))
        )
        return (up if not scale else F.try_multiply(up, F.lit(Decimal(1).scaleb(-scale)))).try_cast(dtype)
    scaled = F.try_multiply(dividend, F.lit(10**scale).cast(f"decimal({scale + 1},0)"))
    whole = F.try_divide(F.try_subtract(scaled, F.try_mod(scaled, by)), by).try_cast("decimal(38,0)")
    return F.try_multiply(whole, F.lit(Decimal(1).scaleb(-scale))).try_cast(dtype)


def _common_places(types, scale: int) -> int | None:
    """Decimal places both operands share, if all digits fit 18."""
    digits, places = [], []
    for t in types:
        if isinstance(t, T.DecimalType):
            digits.append(t.precision - t.scale)
            places.append(t.scale)
        elif isinstance(t, T.IntegralType):
            digits.append({T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10}.get(type(t), 19))
            places.append(0)
        else:
            return None
    most = max(places)
    if most == 0 and scale == 0:
        return 0
    return most if max(digits) + most + scale <= 18 else None


_TOKEN = re.compile(r"\s*(\*\*|[-+*/()]|\d+(?:\.\d+)?|[A-Za-z][A-Za-z0-9]*(?:[-_][A-Za-z0-9]+)*)")


def _tokens(text: str) -> list[str]:
    out, at = [], 0
    while text[at:].strip():
        found = _TOKEN.match(text, at)
        if not found:
            raise ValueError(f"COMPUTE cannot read {text[at:]!r}")
        out.append(found[1])
        at = found.end()
    return out


# Operators by rank, low to high; all take the left pair first.
_RANKS = (
    {"+": F.try_add, "-": F.try_subtract},
    {"*": F.try_multiply, "/": F.try_divide},
    {"**": F.pow},
)


def expression(text: str) -> Column:
    """COMPUTE right-hand side: names are columns, hyphens read as underscores.
    Overflow and division by zero give null."""
    tokens = _tokens(text)

    def ranked(rank: int) -> Column:
        if rank == len(_RANKS):
            return operand()
        left = ranked(rank + 1)
        while tokens and tokens[0] in _RANKS[rank]:
            left = _RANKS[rank][tokens.pop(0)](left, ranked(rank + 1))
        return left

    def operand() -> Column:
        if not tokens:
            raise ValueError(f"COMPUTE ends early in {text!r}")
        token = tokens.pop(0)
        if token == "-":
            return F.try_subtract(F.lit(0), operand())
        if token == "+":
            return operand()
        if token == "(":
            inner = ranked(0)
            if not tokens or tokens.pop(0) != ")":
                raise ValueError(f"a bracket stays open in {text!r}")
            return inner
        if token[0].isdigit():
            return F.lit(Decimal(token) if "." in token else int(token))
        if token[0].isalpha():
            return F.col(token.replace("-", "_").lower() if "-" in token else token)
        raise ValueError(f"COMPUTE has {token!r} out of place in {text!r}")

    found = ranked(0)
    if tokens:
        raise ValueError(f"COMPUTE has {tokens[0]!r} out of place in {text!r}")
    return found
