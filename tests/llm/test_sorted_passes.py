"""Sorted projection passes against all pairs."""

import math

import numpy as np
import pytest

from copperbook.llm import sorted_passes as sp
from copperbook.llm.common import table

SCHEMA = "vec_id long, embedding array<double>"


def by_hand(rows):
    """vec_id, n_links, component_id, kept by comparing all rows."""
    good = []
    for at, (_, v) in enumerate(rows):
        if v and None not in v and np.isfinite(v).all() and any(v):
            good.append((at, np.array(v) / np.abs(v).max()))
    links, parent = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(good):
        for j, b in good[:k]:
            if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= sp.COSINE:
                links[i] += 1
                links[j] += 1
                parent[max(top(i), top(j))] = min(top(i), top(j))
    out = []
    for at, (vec_id, _) in enumerate(rows):
        ids = [r[0] for k, r in enumerate(rows) if top(k) == top(at) and r[0] is not None]
        component = min(ids) if ids else None
        out.append((vec_id, links[at], component, vec_id == component))
    return sorted(out, key=str)


def got(spark, rows, **options):
    found = sp.near_duplicates(spark.createDataFrame(rows, SCHEMA), **options)
    return sorted(map(tuple, found.collect()), key=str)


def cluster(rng, centre, count, spread):
    return (centre + spread * rng.standard_normal((count, len(centre)))).tolist()


def test_odd_rows(spark):
    near = math.cos(0.3), math.sin(0.3)
    rows = [
        (1, [1.0, 0.0]),
        (2, [2.0, 0.0]),
        (3, [1.0, 0.0]),
        (3, [1.0, 0.0]),
        (3, [0.0, 1.0]),
        (None, [1.0, -0.0]),
        (None, [-1.0, 0.0]),
        (4, list(near)),
        (5, [1e300, 1e299]),
        (6, [1e-320, 0.0]),
        (7, [1.0, 0.0, 0.0]),
        (8, None),
        (9, []),
        (10, [0.0, 0.0]),
        (11, [1.0, None]),
        (12, [1.0, float("nan")]),
        (13, [1.0, float("inf")]),
        (None, None),
    ]
    assert got(spark, rows) == by_hand(rows)


def test_empty_and_extra_columns(spark):
    assert got(spark, []) == []
    plain = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.1])], SCHEMA)
    extra = plain.selectExpr("*", "'k' AS key", "'n' AS node", "1 AS root", "2 AS v", "3 AS copies")
    assert sorted(map(tuple, sp.near_duplicates(extra).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]


@pytest.mark.parametrize("most", [4, 256])
def test_groups_large_and_small(spark, monkeypatch, most):
    """Tight groups, a loose one and a chain, counted in one task and in tiles."""
    monkeypatch.setattr(sp, "TILE", 7)
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((60, 8)).tolist()
    vectors += cluster(rng, rng.standard_normal(8), 40, 0.02) * 2
    vectors += cluster(rng, 3 * rng.standard_normal(8), 60, 0.45)
    vectors += [[math.cos(t), math.sin(t)] + [0.0] * 6 for t in np.arange(0, 5, 0.06)]
    order = rng.permutation(len(vectors))
    rows = [(int(i), vectors[i]) for i in order]
    assert got(spark, rows, most=most) == by_hand(rows)


def test_pairs_at_the_bound_are_found(spark):
    """Of pairs just above the cosine, hidden among others, few may be missed."""
    rng = np.random.default_rng(7)
    base = rng.standard_normal((700, 16))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    aside = rng.standard_normal(base.shape)
    aside -= (aside * base).sum(axis=1, keepdims=True) * base
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    twin = 0.951 * base + math.sqrt(1 - 0.951**2) * aside
    rows = [(i, v) for i, v in enumerate(np.vstack((base, twin)).tolist())]
    found = {r[0]: r for r in got(spark, rows, window=16)}
    hit = sum(found[i][1] > 0 and found[i][2] == found[i + 700][2] for i in range(700))
    assert hit >= 690
    want = {r[0]: r for r in by_hand(rows)}
    assert all(found[i][1] <= want[i][1] for i in found)


def test_number_of_passes():
    counts = [sp.passes_for(10**k) for k in range(1, 11)]
    assert counts == sorted(counts) and counts[0] == 4 and counts[4] < 25
    meet = (1 - math.acos(0.95) / math.pi) ** math.log2(10**6 / sp.WINDOW)
    assert (1 - meet) ** sp.passes_for(10**6) <= sp.MISSED


def test_table(spark, sf_dir):
    source = table(spark, sf_dir, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in source.collect()]
    assert sorted(map(tuple, sp.near_duplicates(source).collect()), key=str) == by_hand(rows)
