"""Fingerprints and components against plain Python."""

import random

import numpy as np
import pytest
import xxhash

from copperbook.llm import simhash as sh
from copperbook.llm.components import components

_BLANK = " \t\n\x0b\x0c\r"


def plain_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in _BLANK:
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_parts(marks):
    marks = sorted(set(marks))
    parent = {m: m for m in marks}

    def root(m):
        while parent[m] != m:
            m = parent[m]
        return m

    array = np.array(marks, np.uint64)
    for k, m in enumerate(marks):
        for j in np.flatnonzero(np.bitwise_count(array[k + 1 :] ^ array[k]) <= 3):
            parent[root(marks[k + 1 + int(j)])] = root(m)
    return {m: root(m) for m in marks}


def clusters(seed, groups):
    rng, marks = random.Random(seed), set()
    for _ in range(groups):
        base = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 30)):
            mark = base
            for _ in range(rng.randrange(6)):
                mark ^= 1 << rng.randrange(64)
            marks.add(mark)
            if rng.random() < 0.3:
                base = mark
    return marks


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    prints = {d: plain_print(t) for d, t in rows}
    parts = plain_parts(prints.values())
    least = {}
    for d, m in prints.items():
        least[parts[m]] = min(least.get(parts[m], d), d)
    wanted = sorted((d, f"{m:016x}", least[parts[m]]) for d, m in prints.items())
    assert sorted(tuple(r)[:3] for r in sh.near_duplicates(docs).collect()) == wanted


@pytest.mark.parametrize("masks_from", [1 << 16, 5])
def test_links_of_dense_groups(spark, masks_from):
    marks = clusters(5, 150)
    df = spark.createDataFrame([(m - (1 << 64) if m >> 63 else m,) for m in marks], "mark long")
    got, wanted = {}, {}
    for r in sh.mark_components(df, masks_from=masks_from).collect():
        got.setdefault(r["root"], set()).add(r["mark"] & (1 << 64) - 1)
    for m, root in plain_parts(marks).items():
        wanted.setdefault(root, set()).add(m)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, wanted.values()))


def test_chains_never_miss_a_link():
    rng = random.Random(6)
    starts = np.arange(16)
    for _ in range(3000):
        unlike = 0
        for _ in range(rng.randrange(4)):
            unlike |= 1 << rng.randrange(64)
        a = np.full(16, rng.getrandbits(64), np.uint64)
        assert sh._linked(a, a ^ np.uint64(unlike), starts, 3).any()


def test_odd_rows(spark):
    rows = [(None, "a b c", 1), (None, "a b c", 1), (1, None, 1), (2, "", 1), (3, " \n", 1), (4, "Q", 1), (4, "q", 1), (5, "other words here", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark int")
    found = sorted(map(str, (tuple(r)[:3] for r in sh.near_duplicates(df).collect())))
    assert sum("'0000000000000000', 1)" in f for f in found) == 3
    kept = sh.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == ["1", "4", "5", "None"]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sh.near_duplicates(empty).count() == 0
    assert sh.one_of_each(empty).count() == 0


def test_components_of_a_long_chain(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 101), (100, 101)]
    found = {r["a"]: r["b"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(1, 61)}, 101: 100}
