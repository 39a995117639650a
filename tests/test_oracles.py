"""Every registered query against its SQL text, over whole tables."""

import datetime
import decimal
import math

import pytest

from copperbook.plans import catalog

QUERIES = catalog.queries()
ORACLES = catalog.oracle_sql()


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, decimal.Decimal):
        return format(value, "f")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def _sorted(rows, names, wanted):
    return sorted(tuple(_plain(row[names.index(c)]) for c in wanted) for row in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, spark, duck, sf_dir):
    result = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in result.collect()]
    expected = duck.execute(ORACLES[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == sorted(result.columns)
    wanted = sorted(names)
    assert _sorted(rows, result.columns, wanted) == _sorted(expected.fetchall(), names, wanted)
